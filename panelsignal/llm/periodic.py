"""Maximal periodic runs of words, found by block convolution.

A run is a stretch of words in which words ``q`` apart are identical, ``q``
being its smallest period, of at least ``max(least, times * q)`` words, that no
neighbouring word extends.  Per dyadic scale L = 2, 4, 8, ... the words are cut
into blocks of L.  A run whose period lies in ``[lo(L), lo(2L))`` (about 2L/3 to
4L/3) holds a whole block and that block again one period later, since
L - 1 words to the next block, L words of it and one period are at most
four periods.  The sum of squared differences of a block and the words at
each of those distances after it is computed for all distances at once by a
number-theoretic transform of 2L points, exact in the integers modulo a prime.
A distance with sum zero is a seed; a seed's words are compared (so a sum that is only a
multiple of the prime does no harm) and extended to both sides.  As runs have four periods, two
seeds of one stretch whose distances differ are multiples of its smallest
period, and the stretch is kept with the least one.

Two exact shortcuts leave blocks out of the transforms: a block with a word
that does not come again within the largest distance equals nothing there, and
a block deep inside a run already found has only multiples of that run's period.

Documents are handled in slices inside tasks, with no shuffle; a text of any
length is read whole.  Memory grows with the slice (about four million
characters, or one longer text).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelsignal.llm.common import others, own
from panelsignal.llm.tokens import slices

#: 15 * 2**27 + 1: products fit 64 bits, and transforms reach 2**27 points.
PRIME = 2013265921
GENERATOR = 31

#: A run has at least this many words, and at least this many periods.
LEAST_WORDS = 6
LEAST_PERIODS = 4

#: Numbers transformed at once.
CHUNK = 1 << 19
SLICE_CHARS = 1 << 22

_P = np.uint64(PRIME)

RUNS = T.ArrayType(
    T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")]), False
)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo the prime, doubling the known part."""
    out = np.ones(max(n, 1), np.uint64)
    known, step = 1, base % PRIME
    while known < n:
        more = min(known, n - known)
        out[known : known + more] = out[:more] * np.uint64(step) % _P
        known += more
        step = step * step % PRIME
    return out


def transform(x: np.ndarray, inverse_root: bool = False) -> np.ndarray:
    """The number-theoretic transform of each row; rows have a power of two of entries.

    With ``inverse_root`` the inverse root is used; the result is not divided by the length.
    """
    m, n = x.shape
    root = pow(GENERATOR, (PRIME - 1) // n, PRIME)
    if inverse_root:
        root = pow(root, PRIME - 2, PRIME)
    roots = powers(root, n // 2)
    half, width = n // 2, 1
    while half:
        parts = x.reshape(m, 2, half, width)
        a, b = parts[:, 0], parts[:, 1]
        out = np.empty((m, half, 2, width), np.uint64)
        total = a + b
        out[:, :, 0] = np.minimum(total, total - _P)
        out[:, :, 1] = (a + _P - b) * roots[:: n // (2 * half)][:half, None] % _P
        x = out.reshape(m, n)
        half //= 2
        width *= 2
    return x


def squared_differences(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Per row and distance 0..L: the sum of squared differences of the block (L numbers)
    and the window (2L numbers) from that distance on, modulo the prime."""
    m, size = blocks.shape
    padded = np.zeros_like(windows)
    padded[:, :size] = blocks
    product = transform(windows) * transform(padded, inverse_root=True) % _P
    scale = np.uint64(pow(2 * size, PRIME - 2, PRIME))
    cross = transform(product, inverse_root=True)[:, : size + 1] * scale % _P
    squares = np.zeros((m, 2 * size + 1), np.uint64)
    np.cumsum(windows * windows % _P, axis=1, out=squares[:, 1:])
    moving = (squares[:, size:] - squares[:, : size + 1]) % _P
    own_sum = (blocks * blocks % _P).sum(axis=1, dtype=np.uint64) % _P
    return (own_sum[:, None] + moving + np.uint64(2) * (_P - cross)) % _P


def least_distance(size: int) -> int:
    """The smallest period that blocks of ``size`` words look for."""
    return (2 * size + 1) // 3


def next_distance(x: np.ndarray) -> np.ndarray:
    """Per word: how many words later it comes again (2**31 for never)."""
    n = len(x)
    keyed = np.sort((x.astype(np.int64) << 32) | np.arange(n))
    at = keyed & 0xFFFFFFFF
    out = np.full(n, 1 << 31, np.int64)
    same = (keyed[1:] >> 32) == (keyed[:-1] >> 32)
    out[at[:-1][same]] = at[1:][same] - at[:-1][same]
    return out


def stretch(x: np.ndarray, s: int, d: int) -> tuple[int, int]:
    """First and end of the longest stretch through ``s`` whose words ``d`` apart are equal."""
    first, step = s, 64
    while first > 0:
        a = max(0, first - step)
        unequal = np.flatnonzero(x[a:first] != x[a + d : first + d])
        if len(unequal):
            first = a + int(unequal[-1]) + 1
            break
        first, step = a, 2 * step
    end, step, last = s, 64, len(x) - d
    while end < last:
        b = min(last, end + step)
        unequal = np.flatnonzero(x[end:b] != x[end + d : b + d])
        if len(unequal):
            end += int(unequal[0])
            break
        end, step = b, 2 * step
    return first, end + d


def seeds_at(x: np.ndarray, size: int, starts: np.ndarray):
    """(place, distance) pairs, in arrays, whose block of ``size`` words comes again at that distance, modulo the prime."""
    lo, hi = least_distance(size), least_distance(2 * size)
    places, distances = [], []
    per = max(1, CHUNK // (2 * size))
    for i in range(0, len(starts), per):
        at = starts[i : i + per]
        reach = at[:, None] + lo + np.arange(2 * size)
        # past the end stands a number that no word has
        windows = np.where(reach < len(x), x[np.minimum(reach, len(x) - 1)], np.int64(len(x))).astype(np.uint64)
        blocks = x[at[:, None] + np.arange(size)].astype(np.uint64)
        row, k = np.nonzero(squared_differences(blocks, windows)[:, : hi - lo] == 0)
        places.append(at[row])
        distances.append(k + lo)
    return np.concatenate(places), np.concatenate(distances)


def periodic_runs(x: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs in word numbers below 2**31, sorted.

    ``x`` may hold several documents without a word number in common; ``longest``: words of the longest.
    """
    n = len(x)
    if longest < LEAST_WORDS:
        return []
    found: dict[tuple[int, int], int] = {}
    far = next_distance(x)
    # per word: end and period of the run found so far that reaches furthest from it
    run_end, run_period = np.zeros(n, np.int64), np.ones(n, np.int64)
    size, level = 1, far
    while LEAST_PERIODS * least_distance(2 * size) <= max(longest, LEAST_WORDS):
        size *= 2
        lo, hi = least_distance(size), least_distance(2 * size)
        pairs = len(level) // 2
        level = np.maximum(level[0 : 2 * pairs : 2], level[1 : 2 * pairs : 2])
        starts = np.flatnonzero(level < hi) * size
        starts = starts[run_end[starts] < starts + size + hi - 1]
        if not len(starts):
            continue
        s, d = seeds_at(x, size, starts)
        known = (run_end[s] >= s + d + size) & (d % run_period[s] == 0)
        s, d = s[~known], d[~known]
        order = np.lexsort((s, d))
        last_d, last_end = 0, 0
        for at, period in zip(s[order].tolist(), d[order].tolist()):
            if period == last_d and at < last_end - period:
                continue
            first, end = stretch(x, at, period)
            last_d, last_end = period, end
            if end - first >= max(LEAST_WORDS, LEAST_PERIODS * period) and (first, end) not in found:
                found[first, end] = period
                further = np.flatnonzero(run_end[first:end] < end) + first
                run_end[further], run_period[further] = end, period
    return sorted((a, b, q) for (a, b), q in found.items())


def word_numbers(words: list[bytes], base: int) -> tuple[list[int], int]:
    """Numbers of a document's words from ``base`` on, and the next free number."""
    ids = {w: i for i, w in enumerate(dict.fromkeys(words), base)}
    return list(map(ids.__getitem__, words)), base + len(ids)


def runs_of_texts(texts: list[str | None]) -> tuple[list[list[bytes]], list[list[tuple[int, int, int]]]]:
    """Per text: its words, and its runs as (start, length, period)."""
    # bytes.split() cuts at the six ASCII white-space characters
    words = [(t or "").encode().split() for t in texts]
    ends = np.cumsum([len(w) for w in words])
    x, base, at = np.empty(int(ends[-1]) if len(ends) else 0, np.int64), 0, 0
    for w in words:
        ids, base = word_numbers(w, base)
        x[at : at + len(w)] = ids
        at += len(w)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in words]
    for first, end, period in periodic_runs(x, max(map(len, words), default=0)):
        k = int(np.searchsorted(ends, first, side="right"))
        runs[k].append((first - int(ends[k]) + len(words[k]), end - first, period))
    return words, runs


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by blanks, without those of any run after its first period."""
    if not runs:
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()
    return b" ".join([words[i] for i in kept])


def _runs_array(runs: list[list[tuple[int, int, int]]]) -> pa.ListArray:
    flat = np.array([r for doc in runs for r in doc], np.int64).reshape(-1, 3)
    offsets = np.concatenate(([0], np.cumsum([len(doc) for doc in runs]))).astype(np.int32)
    fields = [pa.field(c, pa.int64(), nullable=False) for c in ("start", "length", "period")]
    items = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, i])) for i in range(3)], fields=fields)
    return pa.ListArray.from_arrays(pa.array(offsets), items)


def find_runs(docs: DataFrame, text: str = "text", runs: str = "runs", collapsed_text: str = "collapsed") -> DataFrame:
    """``docs`` with ``runs``, array of (start, length, period) in words by start, then period, and
    ``collapsed``: the words (cut at ASCII white space) joined by one blank, without those that
    any run holds after its first period.

    A row per row of ``docs``, whatever its other columns hold.  Null and empty texts have no
    words, no runs and an empty collapsed text; repeated rows get equal results; an
    empty table gives an empty one.  Columns of ``docs`` named as the two new ones are replaced.
    """
    body = own("text")
    kept = docs.select(*others(docs, runs, collapsed_text))
    source = docs.select(*kept.columns, F.col(text).cast("string").alias(body))
    schema = T.StructType([*kept.schema.fields, T.StructField(runs, RUNS), T.StructField(collapsed_text, T.StringType())])
    n, names = len(kept.columns), [*kept.columns, runs, collapsed_text]

    def run(batches):
        for batch in batches:
            texts = batch.column(n).to_pylist()
            for a, b in slices(["" if t is None else t for t in texts], SLICE_CHARS):
                words, found = runs_of_texts(texts[a:b])
                rest = [collapsed(w, r) for w, r in zip(words, found)]
                part = batch.slice(a, b - a)
                columns = [part.column(i) for i in range(n)]
                yield pa.record_batch([*columns, _runs_array(found), pa.array(rest, pa.string())], names=names)

    return source.mapInArrow(run, schema)


__all__ = ["collapsed", "find_runs", "periodic_runs", "runs_of_texts", "squared_differences", "transform"]
