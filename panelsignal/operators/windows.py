"""Per-series (time) windows and per-date (cross-section) statistics.

Time-series operators work on row-based frames of one series (an asset,
optionally inside a ``signal``/other key) ordered by date.  All of them
share one ``Window.partitionBy(key).orderBy(date)`` spec, so Spark plans a
single exchange + sort for any number of them in a row.

Rolling sums are *anchored in blocks* by default (:func:`add_rolling_totals`): a
running sum that starts again every ``n`` rows, and of the row n back what its
own block still had to come.  Spark evaluates a sliding frame by
re-aggregating every frame (O(rows x window)); this form is O(rows), reaches
back over one array whatever the number of sums, and its rounding errors are
those of a few hundred additions however long the series is.  ``exact=True``
keeps the sliding-frame form (used as a cross-check in tests).

A rolling value exists only when the whole window is present: a frame
with fewer than ``n`` valid values is NULL (the count guard).

Cross-sectional statistics (per date) are computed with ``groupBy``
(partial aggregation, map-side combine) and joined back with a
size-checked broadcast (:mod:`panelsignal.plans.joins`), so a very wide
date is never funnelled through a single task.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelsignal.functions.columns import ColumnOrName, col, finite_or_null

ASSET = "asset_id"
DATE = "date"


def _tmp(stem: str) -> str:
    return f"__{stem}_{uuid.uuid4().hex[:6]}"


def series_window(key: str = ASSET, order: str = DATE, by: Sequence[str] = ()) -> Window:
    return Window.partitionBy(*by, key).orderBy(order)


def add_lags(
    df: DataFrame,
    lags: Mapping[str, tuple[ColumnOrName, int]],
    *,
    key: str = ASSET,
    order: str = DATE,
    by: Sequence[str] = (),
) -> DataFrame:
    """``out -> (expr, k)``: value of ``expr`` k rows earlier (k < 0: later)."""
    w = series_window(key, order, by)
    cols = {}
    for out, (expr, k) in lags.items():
        cols[out] = F.lag(col(expr), k).over(w) if k >= 0 else F.lead(col(expr), -k).over(w)
    return df.withColumns(cols)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def with_sql(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """``df`` and more columns given as SQL text.

    Built from Python, an expression costs a call for each of its operators; as text it costs one: for stages of
    hundreds of generated expressions that is the greater part of the time to plan them.
    """
    return df.selectExpr("*", *[f"{e} AS {quoted(c)}" for c, e in columns.items()])


def add_rolling_totals(
    df: DataFrame,
    series: Mapping[str, str],
    wanted: Mapping[str, tuple[str, int]],
    *,
    key: str = ASSET,
    order: str = DATE,
    by: Sequence[str] = (),
    exact: bool = False,
) -> DataFrame:
    """``out -> (series, n)``: the sum of that series over the current and ``n - 1`` previous rows, as a double.

    A series is SQL text without NULLs (a row that doesn't count is 0).  Rows before the first count
    as 0, too: guard a sum by a count.  Any number of series and window lengths
    share three Window operators: row numbers, sums inside blocks of as many rows as the
    longest window has, and one look back per length, at an array of all sums.
    """
    if any(n < 1 for _, n in wanted.values()):
        raise ValueError("window must be >= 1 row")
    given, keys, o = df.columns, ", ".join(map(quoted, (*by, key))), quoted(order)
    over = f"PARTITION BY {keys} ORDER BY {o}"
    used = {s: _tmp("s") for s, _ in wanted.values()}
    df = with_sql(df, {t: f"CAST({series[s]} AS DOUBLE)" for s, t in used.items()})
    if exact:
        sums = {out: f"sum({used[s]}) OVER ({over} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for out, (s, n) in wanted.items()}
        return with_sql(df, sums).select(*map(quoted, given), *wanted)

    size = max(n for _, n in wanted.values())
    row, block, packed = _tmp("row"), _tmp("block"), _tmp("packed")
    df = with_sql(df, {row: f"row_number() OVER ({over})"})
    df = with_sql(df, {block: f"CAST(({row} - 1) DIV {size} AS DOUBLE)"})
    run, total = {s: _tmp("run") for s in used}, {s: _tmp("total") for s in used}
    inside, frame = f"PARTITION BY {keys}, {block} ORDER BY {o}", "ROWS BETWEEN UNBOUNDED PRECEDING AND"
    sums = {run[s]: f"sum({t}) OVER ({inside} {frame} CURRENT ROW)" for s, t in used.items()}
    sums |= {total[s]: f"sum({t}) OVER ({inside} {frame} UNBOUNDED FOLLOWING)" for s, t in used.items()}
    df = with_sql(df, sums)
    # what a row n back has to tell: its block, what was still to come in that, and what there was so far
    told = [block, *[f"{total[s]} - {run[s]}" for s in used], *[run[s] for s in used]]
    lengths = {n for _, n in wanted.values()}
    df = with_sql(df, {packed: f"array({', '.join(told if lengths != {size} else told[: 1 + len(used)])})"})
    back = {n: _tmp("back") for n in lengths}
    df = with_sql(df, {b: f"lag({packed}, {n}) OVER ({over})" for n, b in back.items()})
    at, sums = {s: i + 1 for i, s in enumerate(used)}, {}
    for out, (s, n) in wanted.items():
        b = back[n]
        earlier = f"coalesce({b}[{at[s]}], 0D)"
        if n < size:  # then the row n back may lie in the same block
            earlier = f"CASE WHEN {b}[0] = {block} THEN -{b}[{len(used) + at[s]}] ELSE {earlier} END"
        sums[out] = f"{run[s]} + {earlier}"
    return with_sql(df, sums).select(*map(quoted, given), *wanted)


def add_rolling_sums(
    df: DataFrame,
    exprs: Mapping[str, ColumnOrName],
    n: int,
    *,
    valid: Column | None = None,
    count_out: str | None = None,
    key: str = ASSET,
    order: str = DATE,
    by: Sequence[str] = (),
    exact: bool = False,
    finite: bool = False,
) -> DataFrame:
    """Add ``out`` = sum of ``expr`` over the current and ``n-1`` previous rows.

    Without ``valid`` each expression carries its own count guard.  With
    ``valid`` every expression is masked by that row flag and one shared
    count (optionally exposed as ``count_out``) guards all of them: the
    rolling-regression case where a row counts only if y and every
    regressor are present.  ``finite=True`` declares the expressions free
    of NaN/inf already (they are then not wrapped again).
    """
    clean = {name: _tmp("v") for name in exprs}
    given = df.columns
    df = df.withColumns({c: col(exprs[x]) if finite else finite_or_null(exprs[x]) for x, c in clean.items()})
    shared = _tmp("ok")
    if valid is not None:
        df = df.withColumn(shared, F.coalesce(valid, F.lit(False)))
    series, wanted = {}, {}
    for name, c in clean.items():
        mask = shared if valid is not None else f"{c} IS NOT NULL"
        series[name], series[f"n {name}"] = f"CASE WHEN {mask} THEN coalesce({c}, 0D) ELSE 0D END", f"CASE WHEN {mask} THEN 1 ELSE 0 END"
        wanted[f"{c}_sum"], wanted[f"{c}_n"] = (name, n), (f"n {name}", n)
    df = add_rolling_totals(df, series, wanted, key=key, order=order, by=by, exact=exact)
    out = {x: F.when(F.col(f"{c}_n") == n, F.col(f"{c}_sum")) for x, c in clean.items()}
    if count_out and valid is not None:
        out[count_out] = F.col(f"{next(iter(clean.values()))}_n").cast("long")
    return df.withColumns(out).select(*[quoted(c) for c in dict.fromkeys([*given, *out])])


def anchor_column(v: ColumnOrName, *, key: str = ASSET, order: str = DATE, by: Sequence[str] = ()) -> Column:
    """The series' first valid value: what is far from zero gets near to it less this (a window expression)."""
    w = series_window(key, order, by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.first(v, ignorenulls=True).over(w)


def std_from_totals(n: int, count: str, total: str, squares: str) -> str:
    """Sample deviation (ddof 1) of a full window, as SQL, from the sums of the values less their anchor.

    A variance of zero, or within the rounding of the sums, yields NULL, so a later ratio is NULL rather than inf.
    """
    var = f"({squares} - {total} * {total} / {n}D) / {max(n - 1, 1)}D"
    return f"CASE WHEN {count} = {n} AND {var} > 1e-13D * {squares} THEN sqrt({var}) END"


def add_rolling_std(
    df: DataFrame,
    x: ColumnOrName,
    n: int,
    out: str,
    *,
    key: str = ASSET,
    order: str = DATE,
    by: Sequence[str] = (),
    exact: bool = False,
) -> DataFrame:
    """Sample standard deviation (ddof 1) of ``x`` over ``n`` rows, count-guarded; NULL where it is zero."""
    v = _tmp("x")
    df = df.withColumn(v, finite_or_null(x))
    if exact:
        frame = series_window(key, order, by).rowsBetween(-(n - 1), Window.currentRow)
        sd = F.stddev_samp(v).over(frame)
        return df.withColumn(out, F.when((F.count(v).over(frame) == n) & (sd > 0), sd)).drop(v)
    anchor = _tmp("anchor")
    df = df.withColumn(anchor, anchor_column(v, key=key, order=order, by=by))
    series = deviation_series(v, anchor)
    names = {x: _tmp("dev") for x in series}
    df = add_rolling_totals(df, series, {names[x]: (x, n) for x in series}, key=key, order=order, by=by)
    df = df.withColumn(out, F.expr(std_from_totals(n, *names.values())))
    return df.drop(v, anchor, *names.values())


def deviation_series(v: str, anchor: str) -> dict[str, str]:
    """Count, sum and sum of squares that a rolling deviation of column ``v`` needs, as series of SQL."""
    d = f"coalesce({v} - {anchor}, 0D)"
    return {f"n {v}": f"CASE WHEN {v} IS NULL THEN 0 ELSE 1 END", f"s {v}": d, f"q {v}": f"{d} * {d}"}


def cross_section_stats(
    df: DataFrame,
    value: str,
    *,
    keys: Sequence[str] = (DATE,),
    prefix: str = "",
) -> DataFrame:
    """Per-key mean, sample std and count of ``value`` (one row per key)."""
    return df.groupBy(*keys).agg(
        F.avg(value).alias(f"{prefix}mean"),
        F.stddev_samp(value).alias(f"{prefix}std"),
        F.count(value).alias(f"{prefix}n"),
    )
