"""Information coefficients (C8): per-date Pearson and rank IC, rolling and
cumulative IC series (A7, W12, W13).

Pearson IC is a grouped aggregate (covariance / product of standard
deviations, all partial-aggregation friendly).  Rank IC ranks alpha and
forward return inside each date with average ranks for ties, then takes
the same guarded correlation.  Keys of at most ``KEY_ROWS`` rows are ranked in
one group each, from values packed before they move (:func:`ranked_correlation`); a wider
key is never handled whole (see :func:`add_average_rank`).  Values are rounded to 1e-10
before ranking so float noise from summation order cannot create or break
ties.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelsignal.functions.columns import safe_div
from panelsignal.operators.windows import ASSET, DATE
from panelsignal.plans.materialize import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TIE_DIGITS = 10
#: A key with more rows is ranked by ranges of its values.
KEY_ROWS = 1 << 21
PACK_ROWS = 1 << 19
_BELOW, _EQUAL, _PART = "__rk_below", "__rk_equal", "__rk_part"


def _local_counts(keys: Sequence[str], value: str):
    """Per row of a sorted partition: how many of its key are smaller there, and how many equal."""

    def run(batches):
        table = pa.Table.from_batches(list(batches))
        n = table.num_rows
        if not n:
            return
        part = TaskContext.get().partitionId()
        columns = [table.column(c).combine_chunks() for c in (*keys, value)]
        new = np.zeros(n, bool)  # rows that begin a key
        for c in columns[:-1]:
            new[1:] |= pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, n - 1)), True).to_numpy(zero_copy_only=False)
        new[0] = True
        null = columns[-1].is_null().to_numpy(zero_copy_only=False)
        v = columns[-1].fill_null(0.0).to_numpy(zero_copy_only=False)
        other = new.copy()  # rows that begin a value
        other[1:] |= (v[1:] != v[:-1]) | (null[1:] != null[:-1])
        at = np.arange(n)
        key_first = np.maximum.accumulate(np.where(new, at, 0))
        first = np.flatnonzero(other)
        many = np.diff(np.append(first, n))
        # NULLs come first and don't count
        nulls = np.concatenate(([0], np.cumsum(null)))
        below = np.repeat(first, many) - key_first - (nulls[np.repeat(first, many)] - nulls[key_first])
        equal = np.repeat(many, many)
        out = table.append_column(_BELOW, pa.array(below)).append_column(_EQUAL, pa.array(equal))
        yield from out.append_column(_PART, pa.array(np.full(n, part, np.int32))).to_batches(max_chunksize=1 << 16)

    return run


def add_average_rank(
    df: DataFrame, value: str, out: str, keys: Sequence[str] = (DATE,), materialize_as: str | None = "checkpoint"
) -> DataFrame:
    """Exact 1-based average rank of ``value`` within ``keys`` (ties share the mean rank).

    The rows move once, by ranges of (keys, value, hash of the row): neither a key nor
    a value that holds a large share of all rows lies in one task.  Each sorted partition
    counts by itself; it is written (``materialize_as``), as the ranges are drawn from a sample and must
    not be drawn twice.  What partitions need of one another is one row per
    (partition, key): its rows, and the counts of its least and greatest
    value, the only ones that a neighbour can share.  There are fewer of these rows than partitions and
    keys together, and they are joined back.

    Rows with a NULL value get a NULL rank.
    """
    keys, names = list(keys), df.columns
    typed = df.withColumn(value, F.col(value).cast("double") + F.lit(0.0))  # -0.0 equals 0.0
    salt = F.xxhash64(*names)
    cut = typed.repartitionByRange(*keys, value, salt).sortWithinPartitions(*keys, value)
    schema = T.StructType(
        [*cut.schema.fields, T.StructField(_BELOW, T.LongType()), T.StructField(_EQUAL, T.LongType()), T.StructField(_PART, T.IntegerType())]
    )
    local = materialize(cut.mapInArrow(_local_counts(keys, value), schema), materialize_as)

    v, off = F.col(value), "__rk_off"
    ends = local.where(v.isNotNull()).groupBy(_PART, *keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.struct(f(value).alias("v"), by(_EQUAL, value).alias("eq"), by(_BELOW, value).alias("lt")).alias(e)
          for e, f, by in (("lo", F.min, F.min_by), ("hi", F.max, F.max_by))],
    )
    before = Window.partitionBy(*keys).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn(off, F.coalesce(F.sum("n").over(before), F.lit(0)))
    # a value at an end: rows below it and rows that have it, over all partitions
    both = F.when(F.col("lo.v") == F.col("hi.v"), F.array("lo")).otherwise(F.array("lo", "hi"))
    shared = ends.select(_PART, *keys, off, F.explode(both).alias("e")).select(
        _PART, *keys, off, F.col("e.v").alias("v"), F.col("e.eq").alias("eq"), (F.col(off) + F.col("e.lt")).alias("lt")
    )
    same = Window.partitionBy(*keys, "v")
    rank = (F.min("lt").over(same) + (F.sum("eq").over(same) + F.lit(1)) / F.lit(2.0)).alias("rank")
    shared = shared.select(_PART, *keys, off, "v", rank).groupBy(_PART, *keys, off)
    table = shared.agg(
        F.min("v").alias("__rk_lo"), F.min_by("rank", "v").alias("__rk_lor"), F.max("v").alias("__rk_hi"), F.max_by("rank", "v").alias("__rk_hir")
    )
    inner = F.col(off) + F.col(_BELOW) + (F.col(_EQUAL) + F.lit(1)) / F.lit(2.0)
    rank = F.when(v == F.col("__rk_lo"), F.col("__rk_lor")).when(v == F.col("__rk_hi"), F.col("__rk_hir")).when(v.isNotNull(), inner)
    if out in names:
        names = [c for c in names if c != out]
    return local.join(table, [_PART, *keys], "left").select(*names, rank.alias(out))


def _pack(keys: Sequence[str], rows: int):
    """Batches to a row per key and chunk of the task: the keys, how many rows, and their values one after another."""

    def pack(waiting):
        table = pa.Table.from_batches(waiting).combine_chunks()
        code = np.zeros(table.num_rows, np.int64)
        for c in keys:
            coded = table.column(c).combine_chunks().dictionary_encode("encode")
            code = code * len(coded.dictionary) + coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")
        code = code[order]
        cuts = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        ends = np.append(cuts, len(code))[1:]
        columns = [table.column(c).take(pa.array(order[cuts])) for c in keys]
        columns.append(pa.array(ends - cuts))
        for c in ("__a", "__r"):
            v = table.column(c).to_numpy()[order] + 0.0  # -0.0 equals 0.0
            columns.append(pa.array([v[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()))
        return pa.table(columns, names=[*keys, "n", "__a", "__r"]).to_batches(max_chunksize=1 << 12)

    def run(batches):
        waiting, n = [], 0
        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
                n += batch.num_rows
            if n >= rows:
                yield from pack(waiting)
                waiting, n = [], 0
        if waiting:
            yield from pack(waiting)

    return run


def average_ranks(v: np.ndarray) -> np.ndarray:
    """1-based ranks; ties share the mean rank, and NaNs are ties."""
    order = np.argsort(v, kind="stable")
    s = v[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) & ~(np.isnan(s[1:]) & np.isnan(s[:-1]))
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, len(s)))
    out = np.empty(len(s))
    out[order] = np.repeat(first + (many + 1) / 2.0, many)
    return out


def _rank_ic(keys: Sequence[str]):
    def run(group: pa.Table) -> pa.Table:
        a, r = (average_ranks(np.frombuffer(b"".join(group.column(c).to_pylist()))) for c in ("__a", "__r"))
        a, r = a - a.mean(), r - r.mean()
        spread = float(np.sqrt((a @ a) * (r @ r)))
        ic = float(a @ r) / spread if spread > 0 else None
        columns = [group.column(c).slice(0, 1) for c in keys]
        return pa.table([*columns, pa.array([len(a)], pa.int64()), pa.array([ic], pa.float64())], names=[*keys, "n", "ic"])

    return run


def _by_ranges(d: DataFrame, keys: Sequence[str]) -> DataFrame:
    d = add_average_rank(d, "__a", "__ra", keys)
    d = add_average_rank(d, "__r", "__rr", keys)
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), guarded_corr("__ra", "__rr").alias("ic"))


def ranked_correlation(
    d: DataFrame, keys: Sequence[str], *, key_rows: int = KEY_ROWS, pack_rows: int = PACK_ROWS, materialize_as: str | None = "parquet"
) -> DataFrame:
    """keys..., n, ic: the rank correlation of ``__a`` and ``__r`` (doubles, not NULL) within ``keys``.

    A map task sends one row per key and chunk, so that values move once, unsorted and as plain bytes.  The
    packs are written first (``materialize_as``): their counts name the keys of more than ``key_rows`` rows,
    whose rows go by ranges of values instead.
    """
    keys = list(keys)
    d = d.select(*keys, F.col("__a").cast("double"), F.col("__r").cast("double"))
    types = {f.name: f.dataType for f in d.schema.fields}
    key_fields = [T.StructField(k, types[k]) for k in keys]
    packed = [T.StructField("n", T.LongType()), T.StructField("__a", T.BinaryType()), T.StructField("__r", T.BinaryType())]
    packs = materialize(d.mapInArrow(_pack(keys, pack_rows), T.StructType([*key_fields, *packed])), materialize_as)
    out = T.StructType([*key_fields, T.StructField("n", T.LongType()), T.StructField("ic", T.DoubleType())])
    wide = packs.groupBy(*keys).agg(F.sum("n").alias("__n")).where(F.col("__n") > key_rows).drop("__n")
    if wide.isEmpty():
        return packs.groupBy(*keys).applyInArrow(_rank_ic(keys), out)
    named = wide.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    # at most one wide key per key_rows rows
    few = packs.join(named, same, "left_anti").groupBy(*keys).applyInArrow(_rank_ic(keys), out)
    return few.unionByName(_by_ranges(d.join(named, same, "left_semi"), keys))


def guarded_corr(a: str, b: str) -> Column:
    """Sample correlation, NULL when n < 2 or either side is constant."""
    return safe_div(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))


def information_coefficient(
    alphas: DataFrame,
    returns: DataFrame | None = None,
    *,
    alpha: str = "alpha",
    ret: str = "fwd_return",
    method: str = "rank",
    keys: Sequence[str] = (DATE,),
) -> DataFrame:
    """Per-key IC of ``alpha`` against ``ret``: columns keys..., n, ic.

    ``returns`` (date, asset_id, ``ret``) is joined on (date, asset_id); without
    it ``alphas`` holds ``ret`` already.  Only rows with both values take part.
    The rank IC reads its input again for keys of more than ``KEY_ROWS`` rows: hand in a
    written or checkpointed frame.
    """
    if method not in ("rank", "pearson"):
        raise ValueError(f"unknown IC method {method!r}")
    keys = list(keys)
    d = alphas if returns is None else alphas.join(returns.select(DATE, ASSET, ret), [DATE, ASSET])
    d = d.where(F.col(alpha).isNotNull() & F.col(ret).isNotNull()).select(
        *keys,
        F.round(F.col(alpha), TIE_DIGITS).alias("__a"),
        F.round(F.col(ret), TIE_DIGITS).alias("__r"),
    )
    if method == "rank":
        return ranked_correlation(d, keys)
    return d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        guarded_corr("__a", "__r").alias("ic"),
    )


def add_rolling_ic(
    ics: DataFrame, window: int = 22, *, by: Sequence[str] = (), out: str = "ic_rolling"
) -> DataFrame:
    """Mean IC over the last ``window`` dates (NULL until the window is full).

    The IC series has one row per date (per ``by`` key), so an
    unpartitioned date window is bounded by the calendar.
    """
    w = Window.partitionBy(*by).orderBy(DATE).rowsBetween(-(window - 1), Window.currentRow)
    return ics.withColumn(out, F.when(F.count("ic").over(w) == window, F.avg("ic").over(w)))


def add_cumulative_ic(ics: DataFrame, *, by: Sequence[str] = (), out: str = "ic_cumulative") -> DataFrame:
    """Running sum of the IC series."""
    w = Window.partitionBy(*by).orderBy(DATE).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ics.withColumn(out, F.sum("ic").over(w))
