"""Main text of web pages by union-free wrappers inferred per host.

A page becomes the nested stream of its block-level tags and texts.  A wrapper
is a union-free regular expression over such streams: a tag with its content,
marked repeated (``+``) or optional (``?``), groups of those, and text slots.  Pages of a
host are aligned with the wrapper so far one after another: equal neighbours
(or short runs of them) fold into repeated groups, a tag on one side only
becomes optional, differing texts become a slot.  Every node adds up the text
it has seen, in all and inside links.

The wrapper then names the host's main region: its outermost article or main
element, or else the whole page, and goes down from there as long as all that is
left out is shown to be boilerplate: menus, headers, footers, sidebars, notices,
adverts, forms and comments, what is nearly all links, and texts that are the same
on most of the host's pages.  Pages are cut to that region; a page without it (an optional part) is decided by its own stream.
Inside the region, slots whose text is the same on nearly all of the host's pages (at least four) are left
out too, but for headings and cells, and never half of a page's text or more.

Flags read whole class names: ``site-header`` and ``comments-section`` are
boilerplate, ``no-sidebar``, ``section-header`` and ``notice-board`` are not.
``html``, ``body`` and ``main`` are never flagged, nor what holds the ``main``
element, a ``header`` inside an article, or a form that frames a page.

Alignment folds in any order, so it runs as partial aggregation: each map task
folds its pages into one wrapper a host, distinct wrappers are folded in
buckets, then per host.  A host with a third of all pages costs a few wrappers
a task.  Every page takes part.  Regions are joined to the (compressed) pages by
host as a plain shuffle join, whose skewed partitions adaptive execution splits.

Defined results: null and empty pages have an empty text; pages without a host
share the host ''; repeated rows are each extracted for themselves; extra columns
are ignored; an empty table gives an empty result.  Nesting beyond ``DEPTH`` is
flattened: texts stay in order, end tags close what they would without the
limit, and boilerplate is still left out.  White space is what Unicode calls so; ``br``
is white space.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelsignal.llm.common import written

DEPTH = 100
FOLD_BUCKETS = 64
LONGEST_GROUP = 3

# Names of HTML elements.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark meter "
    "output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup, up to their own end tag or the end of the page.
RAW = frozenset("script style textarea title iframe".split())
#: Elements that are left out with their content; they end where an element around them ends.
OMITTED = frozenset("template noscript select svg math object head".split())
HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
FOREIGN = frozenset("svg math".split())
#: Inside these, HTML stands in a drawing or formula; elsewhere a tag of BREAKOUT ends it.
INTEGRATION = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu "
    "meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
ENDS_P = frozenset(
    "address article aside blockquote center details dialog div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dt dd tr td th tbody thead".split()
)
#: An opening tag that ends an open element of these names, up to the container beside it.
SAME_LEVEL = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
BOILER_TAGS = frozenset("nav header footer aside form button menu dialog fieldset legend".split())
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment comments "
    "cookie cookies consent disqus footer header masthead menu navbar nav navigation newsletter notice notices "
    "pager pagination popup promo promoted recommended related respond share sharing sidebar social sponsor "
    "sponsored subscribe subscription toolbar widget".split()
)
#: What may stand before or after those words in a class name of boilerplate.
BOILER_BEFORE = frozenset(
    "site page main global top bottom left right primary secondary sticky floating fixed mobile desktop js gdpr email "
    "user google mega".split()
)
BOILER_AFTER = frozenset(
    "section box block wrapper wrap container bar area list links link posts articles stories items item form overlay "
    "modal slot unit zone top bottom left right buttons button icons panel region inner outer".split()
)
#: An article's own parts: its comments, shares and footer are left out, its header is not.
ARTICLE_BEFORE = frozenset("article entry post story".split())
HEADER_WORDS = frozenset("header banner masthead notice notices".split())
NEVER_FLAGGED = frozenset("html body main".split())
#: A form that holds one of these is a page's frame.
FRAMED = frozenset("main article nav h1".split())
#: Labels and cells recur by nature.
RECURRING = frozenset("h1 h2 h3 h4 h5 h6 th td dt dd li caption figcaption pre".split())
MAIN_WORDS = frozenset("article articlebody main content entry post story".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar".split())

_TOKENS = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<[/]?[a-z](?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|<[/]?[a-z][^>]*(?:>|\Z)|<[!?][^>]*(?:>|\Z)|[^<]+|<",
    re.S | re.I,
)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)|\Z", re.I) for name in RAW}
_NAME = re.compile(r"<(/?)([a-z][^\s/>]*)", re.I)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPLIT = re.compile(r"[^a-z]+")


class Node:
    """An element of a page or a wrapper; label ``#`` is text, ``()`` a repeated group."""

    __slots__ = ("label", "kids", "repeated", "optional", "pages", "chars", "links", "text", "boiler", "main")

    def __init__(self, label: str, boiler: bool = False, main: bool = False):
        self.label, self.kids = label, []
        self.repeated = self.optional = False
        self.pages, self.chars, self.links = 1, 0, 0
        self.text: str | None = None  # a text's constant; None once it differs
        self.boiler, self.main = boiler, main

    def to_list(self) -> list:
        flags = self.repeated | self.optional << 1 | self.boiler << 2 | self.main << 3
        return [self.label, flags, self.pages, self.chars, self.links, self.text, [k.to_list() for k in self.kids]]

    @staticmethod
    def of_list(x: list) -> Node:
        n = Node(x[0], bool(x[1] & 4), bool(x[1] & 8))
        n.repeated, n.optional = bool(x[1] & 1), bool(x[1] & 2)
        n.pages, n.chars, n.links, n.text = x[2:6]
        n.kids = [Node.of_list(k) for k in x[6]]
        return n

    def __str__(self) -> str:
        inner = "#" if self.label == "#" else f"{'' if self.label == '()' else self.label}({' '.join(map(str, self.kids))})"
        return inner + "+" * self.repeated + "?" * self.optional


@lru_cache(1 << 14)
def _flagged(name: str) -> bool:
    """Whether a whole class name or id says boilerplate."""
    words = [w for w in _SPLIT.split(name) if w]
    at = [i for i, w in enumerate(words) if w in BOILER_WORDS]
    if not at:
        return False
    before, inside, after = words[: at[0]], words[at[0] : at[-1] + 1], words[at[-1] + 1 :]
    if before and before[0] in ARTICLE_BEFORE and HEADER_WORDS.isdisjoint(inside):
        before = before[1:]
    return len(inside) == len(at) and BOILER_BEFORE.issuperset(before) and BOILER_AFTER.issuperset(after)


def _element(tag: str, name: str, in_article: bool) -> Node:
    attributes = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(tag)} if " " in tag else {}
    words = set(_SPLIT.split(" ".join(attributes.get(k, "") for k in ("class", "id"))))
    role = attributes.get("role", "")
    by_class = any(map(_flagged, " ".join(attributes.get(k, "") for k in ("class", "id")).split()))
    if name == "article":
        by_class = by_class and not words & ARTICLE_BEFORE
    by_tag = name in BOILER_TAGS and not (name == "header" and in_article)
    boiler = name not in NEVER_FLAGGED and (by_tag or by_class or role in BOILER_ROLES)
    explicit = name in ("article", "main") or role in ("main", "article") or "articlebody" in attributes.get("itemprop", "")
    main = not boiler and (explicit or (name in ("div", "section") and bool(words & MAIN_WORDS)))
    mark = re.sub(r"\d+", "0", attributes.get("class") or attributes.get("id") or "")
    return Node(f"{name}.{'.'.join(sorted(mark.split()))}" if mark else name, boiler, main)


def _leaves(omitted: list[str], name: str, token: str, around: Counter) -> bool:
    """Takes a tag inside an element that is left out; True: the tag stands after it."""
    if token[1] == "/":
        if name in omitted:
            del omitted[len(omitted) - 1 - omitted[::-1].index(name) :]
        elif around[name]:
            omitted.clear()
            return True
        return False
    if (
        (name == "body" and "template" not in omitted)
        or (omitted == ["head"] and name not in HEAD)
        or (omitted[0] in FOREIGN and name in BREAKOUT and INTEGRATION.isdisjoint(omitted))
    ):
        omitted.clear()
        return True
    if name not in VOID and not token.endswith("/>"):
        omitted.append(name)
    return False


def parse(source: str) -> Node:
    """A page's block-level tree; its texts are raw (references not decoded)."""
    root = Node("")
    stack, names = [root], [""]
    is_open = Counter(names)
    inside_link = 0
    pending: list[str] = []
    omitted: list[str] = []  # open elements from the one that is left out on

    def flush() -> None:
        text = " ".join(html.unescape("".join(pending)).split()) if pending else ""
        pending.clear()
        if text:
            n = Node("#")
            n.text, n.chars, n.links = text, len(text), len(text) if inside_link else 0
            stack[-1].kids.append(n)

    def close(at: int) -> None:
        flush()
        is_open.subtract(names[at:])
        del stack[at:], names[at:]

    def last(name: str) -> int:
        at = len(names) - 1
        while names[at] != name:
            at -= 1
        return at

    here = 0
    while here < len(source):
        token = _TOKENS.match(source, here)[0]
        here += len(token)
        if token[0] != "<" or token == "<":
            if omitted == ["head"] and token.strip():
                omitted.clear()
            if not omitted:
                pending.append(token)
            continue
        found = _NAME.match(token)
        if not found:
            continue
        name = found[2].lower()
        if name in RAW and not found[1] and not (token.endswith("/>") and not FOREIGN.isdisjoint(omitted)):
            here = _RAW_END[name].search(source, here).end()
            continue
        if omitted and not _leaves(omitted, name, token, is_open):
            continue
        if name in OMITTED:
            if not found[1] and not token.endswith("/>"):
                omitted.append(name)
            continue
        if name in INLINE:
            if name == "a":
                if not "".join(pending).strip():
                    inside_link = not found[1]
                elif found[1]:
                    # a block's text that holds more than the link isn't link text
                    inside_link = inside_link and 1
            elif name == "br":
                pending.append(" ")
            continue
        if found[1]:
            if is_open[name]:
                close(last(name))
            inside_link = 0
            continue
        flush()
        inside_link = 0
        if name in ENDS_P and is_open["p"]:
            at = last("p")
            if not set(names[at:]) & {"table", "button"}:
                close(at)
        if name in SAME_LEVEL:
            ends, walls = SAME_LEVEL[name]
            for at in range(len(names) - 1, 0, -1) if any(map(is_open.__getitem__, ends)) else ():
                if names[at] in walls:
                    break
                if names[at] in ends:
                    close(at)
                    break
        node = _element(token, name, bool(is_open["article"] or is_open["main"]))
        if name in FRAMED and is_open["form"] or name == "main":
            for n, k in zip(stack, names):
                if k == "form" or (name == "main" and k not in BOILER_TAGS):
                    n.boiler = False
        if len(stack) >= DEPTH and (stack[-1].boiler or not node.boiler):
            node = stack[-1]  # flattened: its texts go to the element around it until its end tag
        else:
            stack[-1].kids.append(node)
        if name not in VOID and not token.endswith("/>"):
            stack.append(node)
            names.append(name)
            is_open[name] += 1
    flush()
    return root


# --- inference ----------------------------------------------------------------


def fold(kids: list[Node]) -> list[Node]:
    """Equal neighbours, then equal neighbouring runs, as repeated nodes and groups."""
    out: list[Node] = []
    for k in kids:
        if out and out[-1].label == k.label and k.label != "()":
            out[-1] = merge(out[-1], k, same_page=True)
            out[-1].repeated = True
        else:
            out.append(k)
    for size in range(2, LONGEST_GROUP + 1):
        i = 0
        while i + 2 * size <= len(out):
            labels = [n.label for n in out[i : i + size]]
            if labels != [n.label for n in out[i + size : i + 2 * size]]:
                i += 1
                continue
            group = Node("()")
            group.repeated, group.kids = True, out[i : i + size]
            j = i + size
            while [n.label for n in out[j : j + size]] == labels:
                group.kids = [merge(a, b, same_page=True) for a, b in zip(group.kids, out[j : j + size])]
                j += size
            group.chars, group.links = (sum(getattr(k, f) for k in group.kids) for f in ("chars", "links"))
            out[i:j] = [group]
    return out


def generalise(node: Node) -> Node:
    """A page's tree as a wrapper: text added up, repeated groups folded."""
    if node.label == "#":
        return node
    kids = [generalise(k) for k in node.kids]
    node.chars, node.links = sum(k.chars for k in kids), sum(k.links for k in kids)
    node.kids = fold(kids)
    return node


def align(a: list[Node], b: list[Node]) -> list[Node]:
    """Both lists in one: common nodes merged, the others optional."""
    la, lb = [n.label for n in a], [n.label for n in b]
    if la == lb:
        return [merge(x, y) for x, y in zip(a, b)]
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            rows[i][j] = rows[i + 1][j + 1] + 1 if la[i] == lb[j] else max(rows[i + 1][j], rows[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and la[i] == lb[j]:
            out.append(merge(a[i], b[j]))
            i, j = i + 1, j + 1
        else:
            if j == len(b) or (i < len(a) and rows[i + 1][j] >= rows[i][j + 1]):
                n, i = a[i], i + 1
            else:
                n, j = b[j], j + 1
            n.optional = True
            out.append(n)
    return fold(out)


def merge(a: Node, b: Node, same_page: bool = False) -> Node:
    """The wrapper of what either node matches."""
    out = Node(a.label, a.boiler and b.boiler, a.main or b.main)
    out.repeated, out.optional = a.repeated or b.repeated, a.optional or b.optional
    out.pages = max(a.pages, b.pages) if same_page else a.pages + b.pages
    out.chars, out.links = a.chars + b.chars, a.links + b.links
    if a.label == "#":
        out.text = a.text if a.text == b.text else None
    else:
        out.kids = align(a.kids, b.kids)
    return out


def dump(wrapper: Node) -> str:
    return json.dumps(wrapper.to_list(), ensure_ascii=False, separators=(",", ":"))


def load(s: str) -> Node:
    return Node.of_list(json.loads(s))


# --- the main region -----------------------------------------------------------


def _weight(n: Node) -> int:
    """Text outside links and boilerplate below a node."""
    if n.boiler:
        return 0
    return n.chars - n.links if n.label == "#" else sum(map(_weight, n.kids))


def region(wrapper: Node) -> list[str]:
    """Labels from the root to the main region."""
    best: list = [0, [], wrapper]

    def explicit(n: Node, path: list[str]) -> None:
        if n.boiler:
            return
        if n.main:
            # the outermost one, whole
            if (w := _weight(n)) > best[0]:
                best[:] = [w, path, n]
            return
        for k in n.kids:
            explicit(k, path if k.label == "()" else [*path, k.label])

    explicit(wrapper, [])
    path, node = best[1:]
    while True:
        kids = [g for k in node.kids for g in (k.kids if k.label == "()" else [k])]
        inner = [k for k in kids if not _is_boilerplate(k, wrapper.pages)]
        if not inner or any(k.label != inner[0].label for k in inner) or not inner[0].kids:
            return path
        if len(inner) > 1 or not any(g.label != "#" for g in inner[0].kids):
            return path
        path, node = [*path, inner[0].label], inner[0]


def _is_boilerplate(n: Node, pages: int) -> bool:
    """Shown to be no main text: flagged, empty, nearly all links, or the same text on most of the host's pages."""
    return n.boiler or 10 * n.links >= 9 * n.chars or (pages >= 3 and _is_constant(n, pages))


def _is_constant(n: Node, pages: int) -> bool:
    if n.label == "#":
        return n.text is not None and 2 * n.pages > pages
    return all(_is_constant(k, pages) for k in n.kids)


def constants(wrapper: Node, path: list[str]) -> list[list[str]]:
    """Labels from the main region down to each slot that is the same on nearly all pages, and its text."""
    out: list[list[str]] = []

    def go(n: Node, labels: list[str]) -> None:
        if n.label == "#":
            tag = labels[-1].split(".")[0] if labels else ""
            if n.text is not None and 10 * n.pages >= 9 * wrapper.pages and tag not in RECURRING:
                out.append([*labels, n.text])
        elif not n.boiler:
            for k in n.kids:
                go(k, labels if k.label in ("#", "()") else [*labels, k.label])

    if wrapper.pages >= 4:
        for n in _nodes_at(wrapper, path):
            for k in n.kids:
                go(k, [] if k.label in ("#", "()") else [k.label])
    return out


def texts(node: Node, out: list[tuple[str, bool]], constant: frozenset = frozenset(), labels: tuple = ()) -> None:
    """(text, whether it is one of the host's constants) below a node, in page order."""
    for k in node.kids:
        if k.label == "#":
            out.append((k.text, bool(constant) and (*labels, k.text) in constant))
        elif not k.boiler:
            texts(k, out, constant, (*labels, k.label) if constant else ())


def _nodes_at(node: Node, path: list[str]) -> list[Node]:
    found = [node]
    for label in path:
        kids = (g for n in found if not n.boiler for k in n.kids for g in (k.kids if k.label == "()" else [k]))
        found = [k for k in kids if k.label == label]
    return [n for n in found if not n.boiler]


def main_text(source: str, path: list[str] | None, constant: frozenset = frozenset()) -> str:
    """A page's main text, cut to its host's region without its host's ``constant`` slots; None, or a page without it: to its own."""
    page = parse(source)
    nodes = _nodes_at(page, path) if path is not None else []
    if not any(map(_has_text, nodes)):
        nodes, constant = _nodes_at(page, region(generalise(parse(source)))), frozenset()
    out: list[tuple[str, bool]] = []
    for n in nodes:
        texts(n, out, constant)
    own = [t for t, c in out if not c]
    if 2 * sum(map(len, own)) <= sum(len(t) for t, _ in out):
        own = [t for t, _ in out]
    return "\n".join(own)


def _has_text(n: Node) -> bool:
    out: list = []
    texts(n, out)
    return bool(out)


# --- on Spark ------------------------------------------------------------------


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def wrappers(pages: DataFrame, url: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper as JSON) from all pages; written."""
    base = pages.select(host(F.col(url)).alias("host"), F.col(html_col).cast("string").alias("html")).where("html <> ''")
    schema = "host string, wrapper string"

    def rows(found: dict) -> pa.RecordBatch:
        return pa.record_batch(
            [pa.array(list(found), pa.string()), pa.array([dump(w) for w in found.values()], pa.string())], names=["host", "wrapper"]
        )

    def infer(batches):
        found: dict[str, Node] = {}
        for batch in batches:
            for h, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                page = generalise(parse(source))
                found[h] = merge(found[h], page) if h in found else page
                if len(found) >= 10_000:  # hosts without end: hand on what there is
                    yield rows(found)
                    found = {}
        if found:
            yield rows(found)

    def join(group: pa.Table) -> pa.Table:
        out = None
        for s in sorted(group.column("wrapper").to_pylist()):
            out = load(s) if out is None else merge(out, load(s))
        return pa.table({"host": group.column("host")[:1], "wrapper": pa.array([dump(out)], pa.string())})

    partial = base.mapInArrow(infer, schema)
    partial = partial.groupBy("host", F.pmod(F.xxhash64("wrapper"), F.lit(FOLD_BUCKETS)).alias("bucket")).applyInArrow(join, schema)
    return written(partial.groupBy("host").applyInArrow(join, schema), "wrappers")


def regions(inferred: DataFrame) -> DataFrame:
    """(host, region and its constant slots as JSON) of each host's wrapper; written."""

    def cut_by(s: str) -> str:
        wrapper = load(s)
        path = region(wrapper)
        return json.dumps([path, constants(wrapper, path)])

    def run(batches):
        for batch in batches:
            found = [cut_by(w) for w in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.string())], names=["host", "region"])

    return written(inferred.select("host", "wrapper").mapInArrow(run, "host string, region string"), "regions")


def extract_pages(pages: DataFrame, id_col: str = "page_id", url: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url and ``text`` of every page."""
    found = regions(wrappers(pages, url, html_col))
    base = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url).cast("string").alias("url"),
        host(F.col(url)).alias("host"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"),
    )

    def shrink(batches):
        z = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            packed = [z(x.encode()) for x in batch.column(3).to_pylist()]
            yield pa.record_batch([*batch.columns[:3], pa.array(packed, pa.binary())], names=["page_id", "url", "host", "html"])

    def cut(batches):
        unz = zstandard.ZstdDecompressor().decompress
        known: dict = {}
        for batch in batches:
            out = []
            for packed, found in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if found is not None and found not in known:
                    path, constant = json.loads(found)
                    known[found] = path, frozenset(map(tuple, constant))
                out.append(main_text(unz(packed).decode(), *known.get(found, (None,))))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    shrunk = base.mapInArrow(shrink, "page_id long, url string, host string, html binary")
    joined = shrunk.join(found, "host", "left").select("page_id", "url", "html", "region")
    return joined.mapInArrow(cut, "page_id long, url string, text string")
