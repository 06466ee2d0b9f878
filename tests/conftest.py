import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from panelsignal.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("*", app="panelsignal-tests")
    s.conf.set("spark.sql.shuffle.partitions", "8")
    yield s
    s.stop()


def day(i: int) -> dt.date:
    return dt.date(2020, 1, 1) + dt.timedelta(days=i)


def panel_df(spark, rows, cols=("date", "asset_id", "return")):
    """rows: tuples in ``cols`` order; date given as int offset."""
    data = [tuple(day(r[0]) if c == "date" else v for c, v in zip(cols, r)) for r in rows]
    types = {
        "date": "date",
        "asset_id": "bigint",
        "signal": "string",
    }
    schema = ", ".join(f"`{c}` {types.get(c, 'double')}" for c in cols)
    return spark.createDataFrame(data, schema)
