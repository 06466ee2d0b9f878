"""The asset stage of residual signals: rolling regressions, rolling sums and lags of sorted series in numpy.

The rows are dealt by asset and sorted by (asset, date) by Spark; a task then streams its sorted rows and
adds every signal and lag column at once (``mapInArrow``).  As window operators the ten study signals
need some 60 running sums, each computed, packed and looked up row by row; here a sum costs a few array passes.

A task holds one chunk of rows, and of the asset that goes on beyond it the ``history`` rows that later ones
look back at: neither the number of assets nor the length of a series bounds what it can process.
Rolling sums are anchored in blocks (:class:`Blocks`) as those of :mod:`panelsignal.operators.windows`, so values
of another asset, or of more than two windows ago, have no part in a sum's rounding error.
"""

from __future__ import annotations

import sys
from collections.abc import Mapping, Sequence
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from panelsignal.functions.columns import ColumnOrName, col
from panelsignal.operators.ols import REL_VAR_TOL, check_warmup
from panelsignal.operators.windows import ASSET, DATE, _tmp, quoted

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK = 1 << 16
COND_MAX = 1e10


class Blocks:
    """Sums over the last ``n`` rows of every series of at least ``n`` rows (a shorter one has no full window).

    Series are laid out in blocks of ``n`` rows: a sum is its block's rows so far, and of the block before
    what came after the row n back.
    """

    def __init__(self, starts: np.ndarray, lengths: np.ndarray, n: int):
        starts, lengths = starts[lengths >= n], lengths[lengths >= n]
        blocks = -(-lengths // n)
        first = np.cumsum(blocks) - blocks
        order, before = np.arange(int(lengths.sum())), np.cumsum(lengths) - lengths
        self.n, self.total = n, int(blocks.sum())
        self.rows = np.repeat(starts - before, lengths) + order
        self.at = np.repeat(first * n - before, lengths) + order
        self.goes_on = np.ones((self.total, 1))
        self.goes_on[first] = 0.0

    def sums(self, x: np.ndarray) -> np.ndarray:
        """One sum for each of ``rows``."""
        cells = np.zeros(self.total * self.n)
        cells[self.at] = x[self.rows]
        cells = cells.reshape(self.total, self.n)
        out = np.cumsum(cells, axis=1)
        if self.n > 1 and self.total > 1:
            rest = np.cumsum(cells[:-1, :0:-1], axis=1)[:, ::-1]
            out[1:, :-1] += rest * self.goes_on[1:]
        return out.ravel()[self.at]


def solve(n: int, sy, sx: list, sxy: list, sxx: dict, cond_max: float = COND_MAX) -> list[np.ndarray]:
    """[const, slopes...] of many regressions from their sums (arrays), NaN where a regressor is constant or the
    standardised matrix is singular: the elimination of :mod:`panelsignal.operators.ols`."""
    k = len(sx)
    c = {(i, j): sxx[i, j] - sx[i] * sx[j] / n for i in range(k) for j in range(i, k)}
    d = [np.sqrt(np.where(c[i, i] > REL_VAR_TOL * sxx[i, i], c[i, i], np.nan)) for i in range(k)]
    there = np.where(np.all([~np.isnan(x) for x in d], axis=0), 1.0, np.nan)
    a = [[None] * (k + 1) for _ in range(k)]
    for i in range(k):
        a[i][i] = there
        a[i][k] = there * (sxy[i] - sx[i] * sy / n) / d[i]
        for j in range(i + 1, k):
            a[i][j] = a[j][i] = there * c[i, j] / (d[i] * d[j])
    pivots = []
    for p in range(k):
        pivots.append(np.where(a[p][p] > k / cond_max, a[p][p], np.nan))
        for i in range(k):
            if i != p:
                f = a[i][p] / pivots[p]
                for j in range(p + 1, k + 1):
                    a[i][j] = a[i][j] - f * a[p][j]
    b = [a[i][k] / (pivots[i] * d[i]) for i in range(k)]
    ok = np.where(np.all([~np.isnan(x) for x in b], axis=0), 1.0, np.nan)
    return [ok * (sy - sum(x * s for x, s in zip(b, sx))) / n, *[ok * x for x in b]]


class _Chunk:
    """Series of one chunk; NaN stands for missing, NaN and infinite alike."""

    def __init__(self, table: pa.Table, key: str):
        self.table, n = table, table.num_rows
        k = table.column(key).combine_chunks()
        new = np.ones(n, bool)
        differ = pc.fill_null(pc.not_equal(k.slice(1), k.slice(0, n - 1)), False).to_numpy(zero_copy_only=False)
        null = k.is_null().to_numpy(zero_copy_only=False)
        new[1:] = differ | (null[1:] != null[:-1])
        self.starts = np.flatnonzero(new)
        self.lengths = np.diff(np.append(self.starts, n))
        self.first = np.repeat(self.starts, self.lengths)
        self.last = self.first + np.repeat(self.lengths, self.lengths)
        self.blocks: dict[int, Blocks] = {}
        self.columns: dict[str, np.ndarray] = {}
        self.masks: list[np.ndarray] = []
        self.products: dict[tuple, np.ndarray] = {}

    def column(self, name: str) -> np.ndarray:
        if name not in self.columns:
            x = self.table.column(name).cast(pa.float64()).to_numpy()
            self.columns[name] = np.where(np.isfinite(x), x, np.nan)
        return self.columns[name]

    def by(self, n: int) -> Blocks:
        if n not in self.blocks:
            self.blocks[n] = Blocks(self.starts, self.lengths, n)
        return self.blocks[n]

    def product(self, n: int, valid: np.ndarray, *names: str) -> np.ndarray:
        """Rolling sums of a product of columns over valid rows; regressions with the same valid rows share them."""
        mask = next((i for i, m in enumerate(self.masks) if np.array_equal(m, valid)), len(self.masks))
        if mask == len(self.masks):
            self.masks.append(valid)
        at = (n, mask, *sorted(names))
        if at not in self.products:
            x = valid.astype(float)
            for c in names:
                x = x * np.where(valid, self.column(c), 0.0)
            self.products[at] = self.by(n).sums(x)
        return self.products[at]

    def residual(self, y: str, xs: Sequence[str], n: int, warmup: str) -> np.ndarray:
        valid = np.all([np.isfinite(self.column(c)) for c in (y, *xs)], axis=0)
        full = self.product(n, valid) == n
        rows = self.by(n).rows[full]
        total = lambda *names: self.product(n, valid, *names)[full]
        k = range(len(xs))
        b = solve(
            n, total(y), [total(x) for x in xs], [total(x, y) for x in xs], {(i, j): total(xs[i], xs[j]) for i in k for j in k if i <= j}
        )
        fit = b[0]
        for x, slope in zip(xs, b[1:]):
            fit = fit + slope * self.column(x)[rows]
        out = self.column(y).copy() if warmup == "raw_excess" else np.full(self.table.num_rows, np.nan)
        there = ~np.isnan(b[0])
        out[rows[there]] = self.column(y)[rows[there]] - fit[there]
        return np.where(np.isfinite(out), out, np.nan)

    def full_sum(self, x: np.ndarray, n: int) -> np.ndarray:
        """Sums of full windows; NaN elsewhere."""
        blocks, has, out = self.by(n), ~np.isnan(x), np.full(len(x), np.nan)
        total, count = blocks.sums(np.where(has, x, 0.0)), blocks.sums(has.astype(float))
        out[blocks.rows] = np.where(count == n, total, np.nan)
        return out

    def deviation(self, v: np.ndarray, n: int) -> np.ndarray:
        """Sample deviation of full windows, from values less their series' first one; NaN where zero within rounding."""
        has = ~np.isnan(v)
        seen = np.where(has, np.arange(len(v)), len(v))
        at = np.minimum.reduceat(seen, self.starts)
        anchor = np.repeat(v[np.minimum(at, len(v) - 1)], self.lengths)
        d = v - anchor
        total, squares = self.full_sum(d, n), self.full_sum(d * d, n)
        var = (squares - total * total / n) / max(n - 1, 1)
        return np.sqrt(np.where(var > 1e-13 * squares, var, np.nan))

    def shifted(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the row ``k`` back (k < 0: ahead) of the same series is, and which rows have none."""
        at = np.arange(self.table.num_rows) - k
        none = (at < self.first) | (at >= self.last)
        return np.where(none, 0, at), none


def _signals(specs: Sequence, y: str, lags: Mapping[str, tuple[str, int]], key: str):
    """``table -> {out: array}`` for every signal and lag."""

    def run(table: pa.Table) -> dict[str, pa.Array]:
        chunk, out, made, sums, devs = _Chunk(table, key), {}, {}, {}, {}
        with np.errstate(all="ignore"):
            for s in specs:
                source = (tuple(s.factors), s.ols_window, s.warmup) if s.is_residual else s.series
                if source not in made:
                    made[source] = chunk.residual(y, *source) if s.is_residual else chunk.column(s.series)
                v = made[source]
                if (source, s.lookback) not in sums:
                    sums[source, s.lookback] = chunk.full_sum(np.where(v > -1.0, np.log1p(v), np.nan), s.lookback)
                value = sums[source, s.lookback]
                if s.vol_window:
                    if (source, s.vol_window) not in devs:
                        devs[source, s.vol_window] = chunk.deviation(v, s.vol_window)
                    value = value / devs[source, s.vol_window]
                at, none = chunk.shifted(s.skip)
                value = value[at]
                out[s.name] = pa.array(value, pa.float64(), mask=none | np.isnan(value))
        for name, (c, k) in lags.items():
            at, none = chunk.shifted(k)
            out[name] = table.column(c).take(pa.array(at, mask=none))
        return out

    return run


def _stream(add, key: str, history: int, ahead: int, chunk: int, names: Sequence[str]):
    """Sorted batches in, the same rows with ``add``'s columns out; at most a chunk and ``history`` rows are held."""

    def run(batches):
        held, done, waiting, n = None, 0, [], 0

        def emit(last: bool):
            nonlocal held, done, waiting, n
            table = pa.Table.from_batches(waiting)
            if held is not None:
                table = pa.concat_tables([held, table])
            table, waiting, n = table.combine_chunks(), [], 0
            made = add(table)
            end = table.num_rows if last else max(done, table.num_rows - ahead)
            columns = [made[c] if c in made else table.column(c) for c in names]
            rows = pa.table(columns, names=list(names)).slice(done, end - done)
            # what the next rows look back at: of their own series only
            k, at = table.column(key).combine_chunks(), min(end, table.num_rows - 1)
            same = pc.equal(k, k[at]) if k[at].is_valid else k.is_null()
            first = max(int(np.argmax(same.fill_null(False).to_numpy(zero_copy_only=False))), end - history)
            held, done = table.slice(first), end - first
            return rows.to_batches(max_chunksize=1 << 14)

        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
                n += batch.num_rows
            if n >= chunk:
                yield from emit(False)
        if waiting or held is not None:
            if not waiting:
                waiting = [pa.RecordBatch.from_pylist([], schema=held.schema)]
            yield from emit(True)

    return run


def add_series_signals(
    df: DataFrame,
    specs: Sequence,
    *,
    y: str = "return_rf",
    lags: Mapping[str, tuple[ColumnOrName, int]] | None = None,
    key: str = ASSET,
    order: str = DATE,
    chunk: int = CHUNK,
) -> DataFrame:
    """``df`` with one column per spec and per lag (as :func:`add_lags` has them); one exchange and sort by ``key``."""
    check_warmup([s.warmup for s in specs])
    if any(w < 1 for s in specs for w in (s.lookback, s.ols_window)):
        raise ValueError("window must be >= 1 row")
    given, staged = df.columns, {}
    plain = {}
    for out, (c, k) in (lags or {}).items():
        if not isinstance(c, str) or c not in given:
            staged[_tmp("lag")] = col(c)
            c = list(staged)[-1]
        plain[out] = (c, k)
    df = df.withColumns(staged) if staged else df
    types = {f.name: f.dataType for f in df.schema.fields}
    made = {s.name: T.DoubleType() for s in specs} | {o: types[c] for o, (c, _) in plain.items()}
    names = list(dict.fromkeys([*given, *made]))
    shifts = [k for _, k in plain.values()] + [s.skip for s in specs]
    history = max(
        [0, *shifts, *[(s.ols_window - 1 if s.is_residual else 0) + max(s.lookback, s.vol_window or 0) - 1 + max(s.skip, 0) for s in specs]]
    )
    # plain values: executors need numpy and pyarrow only
    fields = ("name", "series", "factors", "lookback", "skip", "vol_window", "ols_window", "warmup", "is_residual")
    shipped = [SimpleNamespace(**{f: getattr(s, f) for f in fields}) for s in specs]
    run = _stream(_signals(shipped, y, plain, key), key, history, max(0, *[-k for k in shifts]), chunk, names)
    schema = T.StructType([T.StructField(n, made.get(n) or types[n]) for n in names])
    return df.repartition(quoted(key)).sortWithinPartitions(quoted(key), quoted(order)).mapInArrow(run, schema)
