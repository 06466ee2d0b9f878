"""Panel / factor / weights schemas, loaders (S1, S2) and unit scaling."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelsignal.functions.columns import finite_or_null, percent_to_fraction

ASSET = "asset_id"
DATE = "date"

PANEL_SCHEMA = T.StructType(
    [
        T.StructField("date", T.DateType(), False),
        T.StructField("asset_id", T.LongType(), False),
        T.StructField("price", T.DoubleType(), True),
        T.StructField("return", T.DoubleType(), True),
        T.StructField("specific_return", T.DoubleType(), True),
        T.StructField("specific_risk", T.DoubleType(), True),
        T.StructField("predicted_beta", T.DoubleType(), True),
    ]
)

FACTOR_COLUMNS = ("mkt_rf", "smb", "hml", "rmw", "cma", "rf")

# Columns delivered in percent; divided by 100 at load.
PERCENT_COLUMNS = ("return", "specific_return", "specific_risk")

WEIGHTS_SCHEMA = T.StructType(
    [
        T.StructField("date", T.DateType(), False),
        T.StructField("asset_id", T.LongType(), False),
        T.StructField("weight", T.DoubleType(), True),
    ]
)


@dataclass(frozen=True)
class Span:
    """Inclusive date range of a job; also the proven bound on per-date tables."""

    start: dt.date | None = None
    end: dt.date | None = None

    def where(self, c: str = DATE):
        cond = F.lit(True)
        if self.start is not None:
            cond = cond & (F.col(c) >= F.lit(self.start))
        if self.end is not None:
            cond = cond & (F.col(c) <= F.lit(self.end))
        return cond

    @property
    def days(self) -> int | None:
        if self.start is None or self.end is None:
            return None
        return (self.end - self.start).days + 1


def _frame(source: DataFrame | str, spark: SparkSession | None) -> DataFrame:
    if isinstance(source, DataFrame):
        return source
    if spark is None:
        spark = SparkSession.getActiveSession()
    return spark.read.parquet(source)


def load_assets(
    source: DataFrame | str,
    span: Span = Span(),
    columns: Sequence[str] | None = None,
    *,
    in_universe: str | None = None,
    scale: bool = True,
    spark: SparkSession | None = None,
) -> DataFrame:
    """Date-bounded panel scan with a column list and optional universe flag.

    The filter and projection are plain DataFrame ops, so Catalyst pushes
    the date predicate into the Parquet scan and prunes the columns.
    """
    df = _frame(source, spark).where(span.where())
    if in_universe is not None:
        df = df.where(F.col(in_universe))
    if columns is not None:
        df = df.select(*columns)
    df = finite_doubles(df)
    if scale:
        df = percent_to_fraction(df, list(PERCENT_COLUMNS))
    return df


def finite_doubles(df: DataFrame) -> DataFrame:
    """NaN and infinities become NULL in every floating-point column, at load."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: finite_or_null(c) for c in doubles})


def load_factors(
    source: DataFrame | str,
    span: Span = Span(),
    columns: Sequence[str] | None = None,
    *,
    spark: SparkSession | None = None,
) -> DataFrame:
    """Date-bounded factor-return scan (already fractions)."""
    df = _frame(source, spark).where(span.where())
    if columns is not None:
        df = df.select(DATE, *[c for c in columns if c != DATE])
    return finite_doubles(df)


def validate_panel(
    df: DataFrame,
    required: Sequence[str] = ("date", "asset_id"),
    *,
    check_unique: bool = False,
) -> DataFrame:
    """Check required columns; optionally that (date, asset_id) is a key.

    Uniqueness is what bounds every per-asset window group by the number of
    dates (and makes row-based windows deterministic).  The check is one
    aggregation with map-side combine; only a yes/no reaches the driver.
    """
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"panel is missing columns {missing}")
    if check_unique:
        dup = df.groupBy(DATE, ASSET).count().where(F.col("count") > 1).limit(1).count()
        if dup:
            raise ValueError("panel has duplicate (date, asset_id) rows")
    return df
