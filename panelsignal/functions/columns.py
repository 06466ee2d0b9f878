"""Scalar Column helpers (all JVM-side built-ins, codegen friendly).

Null policy (see README): every undefined value is NULL, never NaN/inf,
so that a bad input cannot poison a whole date's mean or a prefix sum.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite_or_null(c: ColumnOrName) -> Column:
    """NaN and +-inf become NULL."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def log1p_or_null(c: ColumnOrName) -> Column:
    """log(1 + x), NULL where x <= -1 (a total loss or worse has no log return)."""
    c = col(c)
    return F.when(c > F.lit(-1.0), F.log1p(c))


def safe_div(num: ColumnOrName, den: ColumnOrName) -> Column:
    """Division that yields NULL for a zero or NULL divisor (ANSI-safe)."""
    return F.try_divide(col(num), col(den))


def sum_skip_nulls(cols: list[ColumnOrName]) -> Column:
    """Horizontal sum that skips NULL terms; all-NULL gives 0.0."""
    return reduce(add, [F.coalesce(col(c), F.lit(0.0)) for c in cols])


def percent_to_fraction(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c) / F.lit(100.0) for c in cols if c in df.columns})


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (used at the edge of reported results)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.round(F.col(f.name), digits).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)
