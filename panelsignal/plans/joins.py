"""Join helpers: broadcast only behind a proven size bound.

A side is hinted for broadcast only when an upper bound on its row count
is *known from its key structure* (e.g. one row per calendar day of the
requested date range, times the number of signals) and that bound, times
a row width taken from the schema, fits
``spark.sql.autoBroadcastJoinThreshold``.  Otherwise the join is left to
the planner: a shuffle join, which AQE may still turn into a broadcast
from measured runtime sizes, and whose skewed partitions AQE splits.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DEFAULT_THRESHOLD = 10 * 1024 * 1024
_UNITS = {"b": 1, "k": 1024, "kb": 1024, "m": 1024**2, "mb": 1024**2, "g": 1024**3, "gb": 1024**3}


def _parse_bytes(text: str | None) -> int:
    if text is None:
        return _DEFAULT_THRESHOLD
    m = re.fullmatch(r"\s*(-?\d+)\s*([a-zA-Z]*)\s*", str(text))
    if not m:
        return _DEFAULT_THRESHOLD
    return int(m.group(1)) * _UNITS.get(m.group(2).lower() or "b", 1)


def broadcast_threshold(df: DataFrame) -> int:
    return _parse_bytes(df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", None))


def row_width(schema: T.StructType) -> int:
    """Conservative bytes per row for an UnsafeRow-like layout."""
    width = 16
    for f in schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            width += 64
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            width += 256
        else:
            width += 8
    return width


def calendar_days(start: dt.date | None, end: dt.date | None) -> int | None:
    if start is None or end is None:
        return None
    return max((end - start).days + 1, 0)


def bounded_broadcast(small: DataFrame, max_rows: int | None, row_bytes: int | None = None) -> DataFrame:
    """Return ``small`` with a broadcast hint iff ``max_rows`` proves it fits.

    ``row_bytes`` overrides the schema-based row width (e.g. for rows that
    carry arrays of a known length).
    """
    if max_rows is None:
        return small
    threshold = broadcast_threshold(small)
    if threshold <= 0:
        return small
    if max_rows * (row_bytes or row_width(small.schema)) <= threshold:
        return F.broadcast(small)
    return small


def join_per_key(
    rows: DataFrame,
    per_key: DataFrame,
    on: list[str],
    how: str = "inner",
    max_rows: int | None = None,
) -> DataFrame:
    """Join a one-row-per-key table (per date, per date x signal, ...) back to rows."""
    return rows.join(bounded_broadcast(per_key, max_rows), on=on, how=how)
