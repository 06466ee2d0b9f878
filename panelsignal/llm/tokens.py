"""Tokenising whole texts inside tasks, word by word with a bounded memo.

Both kinds of vocabulary split a text before any merge, and no part of that
split reaches over a blank that stands before a word; so a text's ids are
those of its words, each with the blank before it, in order.  A worker keeps
the ids of the words it has met (two generations of at most ``MEMO`` words, so
that frequent words stay) and computes only new ones, batch by batch.

A text that holds the string of one of a vocabulary's added tokens (such as
``<|endoftext|>``) goes through the library whole, as such strings are cut out
before anything else happens to a text.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext

MEMO = 500_000
#: Words that carry the blank before them, a generation: Python's own objects, of some 150 bytes each.
SPACED_MEMO = 400_000
MEMO_CHARS = 64

# The code points with the Unicode property White_Space, as a class body.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: One optional blank and what follows up to the next white space, or a run of white space.
_SEGMENTS = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+").findall
_OUTER_WHITE = re.compile(f"[{WHITE}]").match


def explicit_white(pattern: str) -> str:
    r"""``pattern`` with ``\s`` spelled out: Python's own class has four code points more."""
    return pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")


def spaced_keys(text: str) -> list:
    r"""Keys of a text's words for vocabularies whose words carry the blank before them.

    ``word`` stands for `` word``, ``\nword`` for itself, ``(s,)`` for ``s``.
    """
    if not text:
        return []
    if (
        "  " in text
        or " \n" in text
        or "\n " in text
        or "\n\n" in text
        or _OUTER_WHITE(text[0])
        or _OUTER_WHITE(text[-1])
    ):
        return [s[1:] if len(s) > 1 and s[0] == " " and not _OUTER_WHITE(s[1]) else (s,) for s in _SEGMENTS(text)]
    keys = text.replace("\n", " \n").split(" ")
    keys[0] = (keys[0],)
    return keys


def spaced_text(key) -> str:
    """The stretch of text that a key stands for."""
    if type(key) is tuple:
        return key[0]
    return key if key[0] == "\n" else " " + key


class Memo:
    """Ids of words, little-endian unsigned 32-bit; ``learn`` computes those of new words."""

    def __init__(self, keys, learn, limit: int = MEMO):
        self.keys, self.learn, self.limit = keys, learn, limit
        self.young: dict = {}
        self.old: dict = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = getattr(self.learn, "whole", None)  # words of a library's vocabulary know their added tokens
        apart = {i: whole(t) for i, t in enumerate(texts) if self.learn.holds_added(t)} if whole else {}
        if not apart:
            return self._by_words(texts)
        rest = iter(self._by_words([t for i, t in enumerate(texts) if i not in apart]))
        return [apart[i] if i in apart else next(rest) for i in range(len(texts))]

    def _by_words(self, texts: list[str]) -> list[bytes]:
        young, old = self.young, self.old
        parts = [self.keys(t) for t in texts]
        unknown = []
        for k in [k for k in set().union(*parts) if k not in young]:
            ids = old.get(k)
            if ids is None:
                unknown.append(k)
            else:
                young[k] = ids
        young.update(zip(unknown, self.learn(unknown)))
        get = young.__getitem__
        out = [b"".join(map(get, p)) for p in parts]
        for k in unknown:
            if len(k[0] if type(k) is tuple else k) > MEMO_CHARS:
                del young[k]
        if len(young) > self.limit:
            self.old, self.young = young, {}
        return out


class BareMemo(Memo):
    """For vocabularies that drop white space: texts are cut at ASCII blanks (others stay inside a word).

    Words and their ids lie in flat arrays, looked up a batch at a time; past
    ``limit`` words those longest out of use make room.
    """

    def __init__(self, learn, limit: int = MEMO):
        super().__init__(None, learn, limit)
        self.words = pa.array([], pa.large_string())
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.used, self.clock = np.zeros(0, np.int64), 0
        self.flat = np.zeros(0, "<u4")

    def _by_words(self, texts: list[str]) -> list[bytes]:
        lists = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        words = lists.flatten().dictionary_encode()
        place = self._places(words.dictionary)[words.indices.to_numpy()]
        sizes = self.sizes[place]
        ends = np.cumsum(sizes)
        cuts = np.concatenate(([0], ends))[lists.offsets.to_numpy()].tolist()
        at = np.repeat(self.starts[place] - (ends - sizes), sizes)
        at += np.arange(len(at))
        ids = self.flat[at]
        self._forget()
        return [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where the distinct ``words`` stand in the memo, after learning those it lacks."""
        self.clock += 1
        place = pc.index_in(words, self.words).fill_null(-1).to_numpy().astype(np.int64)
        new = np.flatnonzero(place < 0)
        if len(new):
            unknown = words.take(pa.array(new))
            ids = self.learn(unknown.to_pylist())
            sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            place[new] = len(self.words) + np.arange(len(new))
            self.words = pa.concat_arrays([self.words, unknown])
            self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(sizes) - sizes))
            self.sizes = np.concatenate((self.sizes, sizes))
            self.used = np.concatenate((self.used, np.zeros(len(new), np.int64)))
            self.flat = np.concatenate((self.flat, np.frombuffer(b"".join(ids), "<u4")))
        self.used[place] = self.clock
        return place

    def _forget(self) -> None:
        if len(self.words) <= self.limit and len(self.flat) <= 8 * self.limit:
            return
        short = np.flatnonzero(self.sizes <= MEMO_CHARS)
        stay = np.sort(short[np.argsort(-self.used[short], kind="stable")[: self.limit // 2]])
        self.words, sizes = self.words.take(pa.array(stay)), self.sizes[stay]
        starts = np.cumsum(sizes) - sizes
        at = np.repeat(self.starts[stay] - starts, sizes)
        at += np.arange(len(at))
        self.flat, self.starts, self.sizes, self.used = self.flat[at], starts, sizes, self.used[stay]


def _unicode_bytes() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes for code points from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: Letters and marks whose category, case and composition are the same in every edition of Unicode in use and don't depend on their place.
_SETTLED = re.compile("[!-~\xa1-\u0377\u0384-\u03a2\u03a4-\u0481\u048a-\u0523\u1e00-\u1ef9\n]+").fullmatch
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class LibraryWords:
    """New words by the tokenizers library: its normaliser and split, then its model."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.pieces: dict[str, bytes] = {}
        self.alphabet = _unicode_bytes()
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content for t in added]
        self.added_normalised = [t.content for t in added if t.normalized]

    def holds_added(self, text: str) -> bool:
        if any(a in text for a in self.added):
            return True
        if not self.added_normalised or self.tokenizer.normalizer is None:
            return False
        normal = self.tokenizer.normalizer.normalize_str
        return any(normal(a) in normal(text) for a in self.added_normalised)

    def whole(self, text: str) -> bytes:
        """A whole text's ids at the library's defaults."""
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _model_ids(self, piece: str) -> bytes:
        """Ids of one split part, given in the byte-level alphabet."""
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _ids(self, piece: str) -> bytes:
        """Ids of one split part."""
        out = self.pieces.get(piece)
        if out is None:
            if piece.isascii() and piece.isprintable():  # the alphabet changes only the blank
                out = self._model_ids(piece.replace(" ", self.alphabet[32]))
            else:
                out = self._model_ids(piece.encode().decode("latin-1").translate(self.alphabet))
            if len(piece) <= MEMO_CHARS:
                if len(self.pieces) >= MEMO // 2:
                    self.pieces.clear()
                self.pieces[piece] = out
        return out


class SpacedWords(LibraryWords):
    """For a byte-level vocabulary; ``pattern`` is its split.

    Under ``_LETTERS_OR_MARKS`` a blank with settled letters is one part, and ASCII
    marks up to the word's end are the next; other words go through the pattern.
    """

    # The split whose parts are known without running it.
    _LETTERS_OR_MARKS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str, pattern: str):
        super().__init__(path)
        import regex

        self.split = regex.compile(explicit_white(pattern)).findall
        self.settles = pattern == self._LETTERS_OR_MARKS

    def __call__(self, keys: list) -> list[bytes]:
        ids, split, settles, out = self._ids, self.split, self.settles, []
        for k in keys:
            head = k.rstrip(_MARKS) if settles and type(k) is str else ""
            if not head.isalpha() or not (head.isascii() or _SETTLED(head)):
                out.append(b"".join(map(ids, split(spaced_text(k)))))
            elif len(head) == len(k):
                out.append(ids(" " + k))
            else:
                out.append(ids(" " + head) + ids(k[len(head) :]))
        return out


class BareWords(LibraryWords):
    """For a vocabulary with a normaliser (NFC, lower case) and word ends, whose split drops white space.

    ``_SETTLED`` are letters and marks whose case and composition are the same in
    every edition of Unicode in use and don't depend on their place; the split is
    the vocabulary's own.  Words with others go through the library's normaliser and split.
    """

    _SETTLED = staticmethod(_SETTLED)
    _MARKS = frozenset(_MARKS)

    def __init__(self, path: str):
        super().__init__(path)
        import regex

        # The normaliser's steps whose outcome ``_lower`` gives for settled words.
        parts = json.loads(self.tokenizer.to_str())
        steps = [n["type"] for n in (parts["normalizer"] or {}).get("normalizers", [])]
        splits = (parts["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.settles = steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in splits] == ["Split", "ByteLevel"]
        if self.settles:
            self.split = regex.compile(explicit_white(splits[0]["pattern"]["Regex"])).findall

    @staticmethod
    def _lower(lines: str) -> str:
        return (lines if lines.isascii() else unicodedata.normalize("NFC", lines)).lower()

    def __call__(self, words: list[str]) -> list[bytes]:
        out = [b""] * len(words)
        words = [w or " " for w in words]  # a blank at a text's end leaves an empty word
        lines = "\n".join(words)
        if not self.settles:
            together = []
        elif self._SETTLED(lines):
            together = range(len(words))
        else:
            together = [i for i, w in enumerate(words) if self._SETTLED(w)]
            lines = "\n".join([words[i] for i in together])
        ids, marks, split = self._ids, self._MARKS, getattr(self, "split", None)
        for i, w in zip(together, self._lower(lines).split("\n")):
            if w.isalpha():
                out[i] = ids(w)
            elif w[-1] in marks and w[:-1].isalpha():
                out[i] = ids(w[:-1]) + ids(w[-1])
            else:
                out[i] = b"".join(map(ids, split(w)))
        if len(together) < len(words):
            normal, cut = self.tokenizer.normalizer.normalize_str, self.tokenizer.pre_tokenizer.pre_tokenize_str
            for i in sorted(set(range(len(words))).difference(together)):
                out[i] = b"".join([self._model_ids(p) for p, _ in cut(normal(words[i]))])
        return out


_KEPT: dict = {}


def kept(key: tuple, make):
    """A worker's table, made once and kept from task to task; a task that makes one drops those only earlier tasks used."""
    context = TaskContext.get()
    task = context and context.taskAttemptId()
    if key in _KEPT:
        table = _KEPT[key][0]
    else:
        for k in [k for k, (_, last) in _KEPT.items() if last != task]:
            del _KEPT[k]
        pa.default_memory_pool().release_unused()
        table = make()
    _KEPT[key] = table, task
    return table


def spaced_encoder(path: str, pattern: str) -> Memo:
    return kept(("spaced", path, pattern), lambda: Memo(spaced_keys, SpacedWords(path, pattern), SPACED_MEMO))


def bare_encoder(path: str) -> Memo:
    return kept(("bare", path), lambda: BareMemo(BareWords(path)))


def slices(texts: list[str], chars: int = 1 << 22):
    """Ranges of rows with about ``chars`` characters each: bounds what one call holds."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
