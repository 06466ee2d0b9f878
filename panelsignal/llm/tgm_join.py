"""N-gram Jaccard self-join by a token-group matrix.

Similar documents are put into groups; the matrix says which tokens (hashed
shingles) a group's union holds.  A document can link only into a group whose
union covers its share of the document's tokens; only such groups are opened
and their members compared exactly.  The result is the linked components:

1. Every document becomes the set of its hashed shingles.  A link needs all
   but a few of them in common, so a document with too many shingles that no
   other document has links with nothing.  "Other documents have it too" is
   asked of a bit table that has no false negatives (fixed size, filled shard
   by shard from packed counts); this drops most documents without loss.
2. Documents with equal sets are one class; classes go on (and are pruned
   once more, as a class's own copies no longer count).
3. Classes are grouped by the least of their hashes under ``SEEDS`` fixed mixings
   (similar sets agree on it with the probability of their similarity), frequent keys
   in groups of about ``GROUP`` members that share the key's most central member.  Each
   group is opened for its own members; a pair already connected is not compared again.
4. Matrix and bound: tokens are ordered by document frequency; a set that links
   must share one of the first few (its prefix), and from the first shared one on both
   sets must have the whole overlap left.  Tokens whose documents are all
   in one component are done with.  The rest give (document, group) candidates, groups
   split by component; those in the document's component are skipped, the union bounds
   the overlap, and qualifying groups are opened.
5. Components by contraction: every round replaces each end of a link by the
   least label beside it, until no link is left.

No pairs of a group are listed anywhere: links that leave a task form forests.

Hashes have 64 bits; two different shingles of a text or of two compared texts
agree by chance in fewer than one of 10**9 documents of 10**5 shingles.

Defined results: a text without words (or null) has an empty set and links with
nothing; fewer words than a shingle are one shingle; repeated rows are copies
of each other; null ids are never the smallest; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelsignal.llm.blobs import BitShards, WordHashes, mix, shards_of, sum_counts
from panelsignal.llm.common import own, text_or_empty, written
from panelsignal.llm.tokens import kept, slices

WORDS = 5
PERCENT = 80
GROUP = 64
#: Groups a class joins: near copies that one mixing parts meet under another.
SEEDS = 3
QUERIES = 256
BITS_PER_TOKEN = 8
MAX_FILTER_BYTES = 64 << 20
PROBES = 2
#: Bits dropped from hashes in the counting shuffle: may call a token shared that isn't, never the reverse.
DROP = np.uint64(16)

_LOWER = bytes(range(256)).lower()


def shingles(hashes: np.ndarray, words: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a word sequence; fewer words are one shingle."""
    n = len(hashes)
    if not n:
        return hashes
    size = min(words, n)
    out = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        out = mix(out * np.uint64(0x9DDFEA08EB382D69) + hashes[i : n - size + 1 + i])
    return np.unique(out)


def text_sets(texts: list[str], words: int):
    hashed = kept(("words",), WordHashes)
    for t in texts:
        yield shingles(hashed(t.encode().translate(_LOWER).split()), words)


def least_overlap(n, percent: int):
    """A link between sets of n and any other size shares at least this many of the n."""
    return -(-percent * n // 100)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.searchsorted(b, a)
    both[both == len(b)] = 0
    inter = int((b[both] == a).sum())
    return 100 * inter >= percent * (len(a) + len(b) - inter)


def shared_tokens(sets_of, source: DataFrame, shard_bits: int) -> SharedTokens:
    """A bit table that holds every token which two rows of ``source`` have (and few others).

    ``sets_of(batch)`` yields lists of token arrays, one array a row.
    """

    def send(batches):
        for batch in batches:
            for sets in sets_of(batch):
                tokens, counts = np.unique(np.concatenate(sets) >> DROP << DROP, return_counts=True)
                rows = list(shards_of(tokens, counts, shard_bits)) if len(tokens) else []
                if rows:
                    yield pa.record_batch(
                        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())],
                        names=["shard", "blob"],
                    )

    bits = MAX_FILTER_BYTES * 8 >> shard_bits

    def meet(group: pa.Table) -> pa.Table:
        tokens, counts = sum_counts(group.column("blob").to_pylist())
        tokens = tokens[counts > 1]
        # as many bits as the shard's tokens ask for, within the bound
        size = min(bits, 1 << max(6, (BITS_PER_TOKEN * PROBES * len(tokens)).bit_length()))
        words = BitShards.fill(size, np.concatenate([BitShards.places(tokens, p, size) for p in range(PROBES)]))
        return pa.table({"shard": group.column("shard")[:1], "words": pa.array([words.tobytes()], pa.binary())})

    sent = source.mapInArrow(send, "shard long, blob binary")
    # written first: the driver then only reads finished shards, one partition at a time
    filled = written(sent.groupBy("shard").applyInArrow(meet, "shard long, words binary"), "tgm-bits")
    return SharedTokens({r["shard"]: np.frombuffer(r["words"], "<u8") for r in filled.toLocalIterator()}, shard_bits)


class SharedTokens:
    """Shards of their own sizes, each a power of two of bits."""

    def __init__(self, shards: dict[int, np.ndarray], shard_bits: int):
        self.shard_bits = shard_bits
        sizes = np.array([len(shards.get(s, ())) for s in range(1 << shard_bits)], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        self.bits = (sizes * 64).astype(np.uint64)
        self.words = np.concatenate([shards.get(s, np.array([], np.uint64)) for s in range(1 << shard_bits)])

    def has(self, tokens: np.ndarray) -> np.ndarray:
        tokens = tokens >> DROP << DROP
        shard = (tokens >> np.uint64(64 - self.shard_bits)).astype(np.int64)
        bits, start = self.bits[shard], self.starts[shard]
        out = bits > 0
        bits = np.maximum(bits, np.uint64(1))
        if not len(self.words):
            return out
        for p in range(PROBES):
            at = BitShards.places(tokens, p, 1 << 63) & (bits - np.uint64(1))  # sizes are powers of two
            word = self.words[np.minimum(start + (at >> np.uint64(6)).astype(np.int64), len(self.words) - 1)]
            out &= (word >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out


_SETS = "rid long, doc_id long, text_md5 string, n long, digest binary, tokens binary"


def candidate_sets(docs: DataFrame, words: int, percent: int, id_col: str, text: str) -> DataFrame:
    """Every document's row: its number, id, text's MD5, set size, and digest and tokens where it may link; written."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    shard_bits = max(4, min(14, (docs.select(id_col).count() // 4096).bit_length() + 2))

    def sets_of(batch):
        texts = batch.column(1).to_pylist()
        for a, b in slices(texts, 1 << 23):
            yield list(text_sets(texts[a:b], words))

    shared = spark.sparkContext.broadcast(shared_tokens(sets_of, base, shard_bits))

    def run(batches):
        table = shared.value
        for batch in batches:
            doc_ids, rids, texts = batch.column(0), batch.column(2), batch.column(1).to_pylist()
            for a, b in slices(texts, 1 << 22):
                sets = list(text_sets(texts[a:b], words))
                sizes = np.array([len(s) for s in sets], np.int64)
                hits = table.has(np.concatenate(sets)) if sizes.sum() else np.zeros(0, bool)
                owner = np.repeat(np.arange(len(sets)), sizes)
                common = np.bincount(owner[hits], minlength=len(sets))
                may = (common >= least_overlap(sizes, percent)) & (sizes > 0)
                raw = [s.tobytes() if m else None for s, m in zip(sets, may.tolist())]
                yield pa.record_batch(
                    [
                        rids.slice(a, b - a),
                        doc_ids.slice(a, b - a),
                        batch.column(3).slice(a, b - a),
                        pa.array(sizes),
                        pa.array([r and hashlib.blake2b(r, digest_size=16).digest() for r in raw], pa.binary()),
                        pa.array(raw, pa.binary()),
                    ],
                    names=["rid", "doc_id", "text_md5", "n", "digest", "tokens"],
                )

    numbered = base.select("doc_id", "text", F.monotonically_increasing_id().alias("rid"), F.md5("text").alias("text_md5"))
    out = written(numbered.mapInArrow(run, _SETS), "tgm-sets")
    shared.destroy()
    return out


def _tokens(b: bytes) -> np.ndarray:
    return np.frombuffer(b, "<u8")


def prune(reps: DataFrame, percent: int) -> DataFrame:
    """Classes that may link with another class; ``reps``: rid, n, tokens."""
    spark = reps.sparkSession
    names = ["rid", "n", "tokens"]
    i = names.index("tokens")

    def sets_of(batch):
        sets = [_tokens(x) for x in batch.column(i).to_pylist()]
        for a in range(0, len(sets), 4096):
            yield sets[a : a + 4096]

    shard_bits = max(4, min(14, (reps.count() // 4096).bit_length() + 2))
    shared = spark.sparkContext.broadcast(shared_tokens(sets_of, reps.select(*names), shard_bits))

    def run(batches):
        table = shared.value
        for batch in batches:
            keep = [
                int(table.has(_tokens(x)).sum()) >= least_overlap(n, percent)
                for n, x in zip(batch.column(1).to_pylist(), batch.column(i).to_pylist())
            ]
            yield batch.filter(pa.array(keep, pa.bool_()))

    out = written(reps.select(*names).mapInArrow(run, "rid long, n long, tokens binary"), "tgm-classes")
    shared.destroy()
    return out


class Forest:
    """Union-find over a task's members."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.up[self.root(i)] = self.root(j)


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _edges(pairs: list[tuple]) -> pa.Table:
    return pa.table([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], schema=_EDGE)


def groups(classes: DataFrame, central: DataFrame) -> DataFrame:
    """(seed, key, part, rid, central): members of groups of about GROUP.

    A class joins one group per seed.  A key with more members than a group has
    parts that share a pivot: its most central member (``central``: rid, central),
    which in a crowd of near copies is the text they are copies of.
    """

    def keys(batches):
        for batch in batches:
            rids, seeds, least = [], [], []
            for rid, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for seed in range(SEEDS):
                    rids.append(rid)
                    seeds.append(seed)
                    least.append(int(mix(_tokens(x) ^ np.uint64(0xA5A5A5A5A5A5A5A5 * (seed + 1) & 0xFFFFFFFFFFFFFFFF)).min() >> np.uint64(1)))
            yield pa.record_batch([pa.array(c, pa.int64()) for c in (rids, seeds, least)], names=["rid", "seed", "key"])

    keyed = classes.select("rid", "tokens").mapInArrow(keys, "rid long, seed long, key long")
    keyed = written(keyed.join(central.select("rid", "central"), "rid"), "tgm-keys")
    most = F.max(F.struct("central", "rid"))
    sizes = keyed.groupBy("seed", "key").agg(most.alias("pivot"), F.ceil(F.count("*") / GROUP).alias("parts"))
    sizes = written(sizes, "tgm-key-sizes")
    part = F.pmod(F.xxhash64("rid"), "parts").alias("part")
    members = keyed.join(sizes, ["seed", "key"]).select("seed", "key", part, "rid", "central")
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    pivots = sizes.where("parts > 1").select("seed", "key", every, "pivot").select("seed", "key", "part", "pivot.rid", "pivot.central")
    return written(members.unionByName(pivots).distinct(), "tgm-groups")


def open_own(member_sets: DataFrame, percent: int) -> DataFrame:
    """Links inside each group, as forests; ``member_sets``: seed, key, part, rid, central, tokens."""

    def run(group: pa.Table) -> pa.Table:
        # the most central member first: it connects most of the others at once
        group = group.sort_by([("central", "descending"), ("rid", "ascending")])
        rids = group.column("rid").to_pylist()
        sets = [_tokens(x) for x in group.column("tokens").to_pylist()]
        forest, found = Forest(len(rids)), []
        for i in range(len(rids)):
            for j in range(i + 1, len(rids)):
                if forest.root(i) != forest.root(j) and linked(sets[i], sets[j], percent):
                    forest.join(i, j)
                    found.append((rids[i], rids[j]))
        return _edges(found)

    return written(member_sets.groupBy("seed", "key", "part").applyInArrow(run, "a long, b long"), "tgm-own-links")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(rid, label): the least rid reachable, by contraction; ``edges``: a, b."""
    labels = nodes.select("rid", F.col("rid").alias("label"))
    edges = written(edges.where("a <> b").distinct(), "tgm-edges")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = written(both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("p")), "tgm-step")
        up = step.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        step = written(step.join(up, "p").select("a", F.col("pp").alias("p")), "tgm-step")
        to = step.select(F.col("a").alias("label"), "p")
        labels = written(labels.join(to, "label", "left").select("rid", F.coalesce("p", "label").alias("label")), "tgm-labels")
        left = edges.join(step.withColumnRenamed("p", "pa"), "a").select("pa", "b")
        right = step.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        edges = left.join(right, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))
        edges = written(edges.where("a <> b").distinct(), "tgm-edges")
    return labels


def prefixes(classes: DataFrame, percent: int) -> DataFrame:
    """(rid, n, alone, prefix, central) of classes that share a token; written.

    ``prefix``: the first tokens by frequency, of which any link shares one; in that order
    ``alone`` tokens of the class's own come before them;
    ``central``: the mean number of classes that have one of the class's tokens.
    """

    def explode(batches):
        for batch in batches:
            sets = [_tokens(x) for x in batch.column(2).to_pylist()]
            for a in range(0, len(sets), 512):
                sizes = [len(s) for s in sets[a : a + 512]]
                yield pa.record_batch(
                    [
                        pa.array(np.repeat(batch.column(0).to_numpy()[a : a + 512], sizes)),
                        pa.array(np.repeat(batch.column(1).to_numpy()[a : a + 512], sizes)),
                        pa.array(np.concatenate(sets[a : a + 512]).view(np.int64)),
                    ],
                    names=["rid", "n", "token"],
                )

    rows = classes.select("rid", "n", "tokens").mapInArrow(explode, "rid long, n long, token long")
    often = written(rows.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "tgm-frequencies")
    # tokens of one class come first in the order and link with nothing: only the rest of the prefix counts
    first = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    alone = F.col("n") - F.size("shared")
    left = F.greatest(first - alone, F.lit(0)).cast("int")
    return written(
        rows.join(often, "token")
        .groupBy("rid", "n")
        .agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared"), F.sum("df").alias("weight"))
        .select(
            "rid",
            "n",
            alone.alias("alone"),
            F.transform(F.slice("shared", F.lit(1), left), lambda x: x["token"]).alias("prefix"),
            ((F.col("weight") + alone) / F.col("n")).alias("central"),
        ),
        "tgm-prefixes",
    )


def sweep(classes: DataFrame, prefixed: DataFrame, grouped: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Links between groups that join components (forests, per task): matrix, bound, open.

    The members of a group that are in one component (``home``) are a group of their own here.
    A class's ``room`` at a token is what a link may take there: sets of n and m that link share
    at least percent * (n + m) / (100 + percent) tokens, and from their first common token on
    neither has fewer left; so percent * m is at most the n's room, and percent * n the m's.
    """
    homes = grouped.where("seed = 0").select("key", "part", "rid").join(labels.withColumnRenamed("label", "home"), "rid")
    left = F.col("n") - F.col("alone") - F.col("place")
    room = ((100 + percent) * left - percent * F.col("n")).alias("room")
    placed = prefixed.select("rid", "n", "alone", F.posexplode("prefix").alias("place", "token"))
    labelled = written(placed.select("rid", "n", "token", room).join(labels, "rid"), "tgm-labelled")
    extremes = labelled.groupBy("token").agg(F.min("n").alias("least"), F.max("room").alias("widest"))
    fits = (F.col("least") * percent <= F.col("room")) & (F.col("n") * percent <= F.col("widest"))
    fitting = written(labelled.join(written(extremes, "tgm-extremes"), "token").where(fits).select(*labelled.columns), "tgm-fitting")
    open_tokens = fitting.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("token")
    probes = written(fitting.join(written(open_tokens, "tgm-open"), "token"), "tgm-probes")
    matrix = (
        probes.join(homes, "rid")
        .groupBy("token", "key", "part", "home")
        .agg(F.min("n").alias("least"), F.max("room").alias("widest"), F.max("rid").alias("last"))
    )
    candidates = written(
        probes.join(written(matrix, "tgm-matrix"), "token")
        .where("home <> label AND rid < last")
        .where(fits)
        .select("rid", "label", "key", "part", "home")
        .distinct(),
        "tgm-candidates",
    )
    group = ["key", "part", "home"]
    counts = candidates.groupBy(*group).agg(F.ceil(F.count("*") / QUERIES).alias("blocks"))
    counts = written(counts, "tgm-blocks")
    block = F.pmod(F.xxhash64("rid"), "blocks").alias("block")
    asked = candidates.join(counts, group).select(*group, block, "rid", "label").join(classes.select("rid", "tokens"), "rid")
    spread = counts.select(*group, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    offered = spread.join(homes, group).join(classes.select("rid", "tokens"), "rid")

    def run(queries: pa.Table, members: pa.Table) -> pa.Table:
        sets = [_tokens(x) for x in members.column("tokens").to_pylist()]
        union = np.unique(np.concatenate(sets))
        other = members.column("home")[0].as_py()
        joined, found = set(), []
        for q, home, x in zip(*(queries.column(c).to_pylist() for c in ("rid", "label", "tokens"))):
            if home in joined:
                continue
            s = _tokens(x)
            at = np.searchsorted(union, s)
            at[at == len(union)] = 0
            if 100 * int((union[at] == s).sum()) < percent * len(s):
                continue  # the bound: no member can link
            if any(linked(s, t, percent) for t in sets):
                joined.add(home)
                found.append((home, other))
        return _edges(found)

    keys = (*group, "block")
    asked, offered = asked.toDF(*asked.columns), offered.toDF(*offered.columns)  # both sides hold classes' columns
    return written(asked.groupBy(*keys).cogroup(offered.groupBy(*keys)).applyInArrow(run, "a long, b long"), "tgm-links")


def jaccard_components(
    docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: doc_id, text_md5, n_shingles, component_id (the least id
    reachable by links, its own included) and kept (one row of each component).

    Sets link when 100 * intersection >= percent * union.
    """
    rows = candidate_sets(docs, words, percent, id_col, text)
    may = rows.where(F.col("digest").isNotNull())
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("rid").alias("row")))
    copies = written(may.groupBy("digest").agg(F.min("rid").alias("rid"), first.alias("least")), "tgm-copies")
    classes = prune(may.join(copies.select("rid"), "rid"), percent)
    prefixed = prefixes(classes, percent)
    grouped = groups(classes, prefixed)
    links = open_own(grouped.join(classes.select("rid", "tokens"), "rid"), percent)
    labels = components(classes.select("rid"), links)
    more = sweep(classes, prefixed, grouped, labels, percent)
    labels = components(classes.select("rid"), links.unionByName(more))
    of_class = copies.join(labels, "rid", "left").select("digest", F.coalesce("label", "rid").alias("label"), "least")
    of_class = written(of_class, "tgm-of-class")
    least = written(of_class.groupBy("label").agg(F.min("least").alias("least")), "tgm-least")
    named = written(of_class.select("digest", "label").join(least, "label").select("digest", "least"), "tgm-named")
    return rows.join(named, "digest", "left").select(
        "doc_id",
        "text_md5",
        F.col("n").alias("n_shingles"),
        F.coalesce("least.doc_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("least.row") == F.col("rid"), F.lit(True)).alias("kept"),
    )


def dedup_near(
    docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One document of each component, with exactly the columns ``docs`` came with."""
    kid, key, md5, one = own("id"), own("key"), own("md5"), own("n")
    verdict = jaccard_components(docs, words, percent, id_col, text).where("kept")
    verdict = verdict.select(F.col("doc_id").alias(kid), F.col("text_md5").alias(key))
    rows = docs.withColumn(md5, F.md5(text_or_empty(text)))
    same = (F.col(md5) == F.col(key)) & F.col(id_col).eqNullSafe(F.col(kid))
    first = Window.partitionBy(id_col, md5).orderBy(F.lit(1))  # rows equal in id and text: one of them
    stay = rows.join(verdict, same, "left_semi").withColumn(one, F.row_number().over(first)).where(F.col(one) == 1)
    return stay.drop(one, md5)
