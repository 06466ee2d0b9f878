"""Every registered query against its independent DuckDB SQL (sf0.001)."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from panelsignal.plans.oracle import oracle_sql
from panelsignal.plans.queries import REGISTRY

SF = "/root/testdata/sf0.001"
TABLES = ["lineitem", "supplier", "nation", "region"]

pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="driver test data not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def canon(rows, cols):
    def v(x):
        return repr(x + 0.0) if isinstance(x, float) else repr(x)

    return sorted(tuple(v(r[c]) for c in cols) for r in rows)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    sdf = REGISTRY[name](spark, SF)
    cols = sorted(sdf.columns)
    srows = [r.asDict() for r in sdf.collect()]
    rel = con.sql(oracle_sql()[name])
    assert sorted(rel.columns) == cols
    drows = [dict(zip(rel.columns, r)) for r in rel.fetchall()]
    assert len(srows) == len(drows)
    assert canon(srows, cols) == canon(drows, cols)


def test_every_query_has_oracle_or_is_listed():
    rows_only = {"mvo_factor_risk"}
    assert set(REGISTRY) - set(oracle_sql()) <= rows_only
    assert set(REGISTRY) <= set(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["date", "asset_id", "alpha", "predicted_beta"]


def test_mvo_factor_risk_against_dense_kkt(spark):
    """Rows-only query: brute-force per-date dense KKT on the sf0.001 fixture."""
    import numpy as np

    from panelsignal.plans.queries import FACTOR_VARIANCE, Fixture, GAMMA, read_table
    from panelsignal.sources.fixtures import exposures_from_lineitem

    fx = Fixture(spark, SF)
    got = REGISTRY["mvo_factor_risk"](spark, SF).toPandas()
    al = fx.alphas(fx.spec("momentum"), keep=("specific_risk",)).toPandas()
    al = al[al.alpha.notna()]
    ex = exposures_from_lineitem(
        fx.lineitem, read_table(spark, SF, "supplier"), read_table(spark, SF, "nation")
    ).toPandas()
    factors = list(FACTOR_VARIANCE)
    checked = 0
    for d, g in al.groupby("date"):
        g = g.sort_values("asset_id")
        n = len(g)
        X = (
            ex[ex.date == d]
            .pivot(index="asset_id", columns="factor", values="exposure")
            .reindex(index=g.asset_id, columns=factors)
            .fillna(0.0)
            .to_numpy()
        )
        S = X @ np.diag(list(FACTOR_VARIANCE.values())) @ X.T + np.diag(g.specific_risk.to_numpy() ** 2)
        A = np.vstack([g.predicted_beta.to_numpy(), np.ones(n)])
        K = np.block([[GAMMA * S, A.T], [A, np.zeros((2, 2))]])
        w_got = got[got.date == d].sort_values("asset_id")
        if np.linalg.matrix_rank(A) < 2:
            assert len(w_got) == 0
            continue
        w = np.linalg.solve(K, np.concatenate([g.alpha.to_numpy(), [0.0, 0.0]]))[:n]
        np.testing.assert_allclose(w_got.weight.to_numpy(), np.round(w, 10), atol=2e-10)
        checked += 1
    assert checked > 100


def test_prefix_equals_sliding_on_fixture(spark):
    """The O(rows) prefix form and Spark's sliding frames agree on real data."""
    import numpy as np

    from panelsignal.plans.queries import Fixture

    fx = Fixture(spark, SF)
    for name in ("vol_scaled_momentum", "vol_scaled_capm_momentum", "ff3_momentum"):
        spec = fx.spec(name)
        a = fx.signal_frame(spec).select("date", "asset_id", name).toPandas()
        b = fx.signal_frame(spec, exact=True).select("date", "asset_id", name).toPandas()
        m = a.merge(b, on=["date", "asset_id"])
        assert len(m) == len(a) == len(b)
        x, y = m[f"{name}_x"].astype(float), m[f"{name}_y"].astype(float)
        assert (x.isna() == y.isna()).all()
        np.testing.assert_allclose(x[x.notna()], y[y.notna()], rtol=1e-9, atol=1e-11)


def test_result_tables_round_trip(spark):
    from panelsignal.operators.evaluate import performance_summary
    from panelsignal.plans.queries import Fixture, momentum_portfolio
    from panelsignal.session import scratch_path
    from panelsignal.sources.io import write_result

    fx = Fixture(spark, SF)
    summary = performance_summary(momentum_portfolio(fx))
    path = scratch_path(spark, "summary")
    write_result(summary, path)
    back = spark.read.parquet(path).collect()
    assert len(back) == 1 and set(back[0].asDict()) == {"mean_return", "volatility", "sharpe"}


def test_solve_needs_no_package_on_the_workers():
    """The regressions' functions travel by value: they unpickle where the package can't be imported."""
    import pickle
    import subprocess
    import sys

    from pyspark import cloudpickle

    from panelsignal.operators.factor_risk import solve_date
    from panelsignal.operators.ols import ols_table_from_sums

    sent = cloudpickle.dumps((solve_date, ols_table_from_sums))
    assert pickle.loads(sent)
    code = "import pickle, sys; sys.modules['panelsignal'] = None; pickle.loads(sys.stdin.buffer.read())"
    subprocess.run([sys.executable, "-c", code], input=sent, check=True, cwd="/")


def test_no_python_node_for_a_filtered_regression(spark):
    from panelsignal.plans.inspect import plan_summary

    df = E.queries()["rolling_ols_ff5"](spark, "/root/testdata/sf0.001")
    df.collect()
    assert plan_summary(df)["python_nodes"] == 0


def test_ten_signals_join_per_date_tables_by_broadcast_over_the_whole_span(spark):
    import datetime as dt

    from panelsignal.plans.inspect import plan_summary
    from panelsignal.plans.queries import Fixture, long_weights
    from panelsignal.sources.schema import Span

    fx = Fixture(spark, "/root/testdata/sf0.001", Span(dt.date(1996, 1, 1), dt.date(2024, 12, 31)))
    df = long_weights(fx)
    df.collect()
    s = plan_summary(df)
    assert s["sort_merge_joins"] == 0 and s["broadcast_joins"] >= 2, s


def test_entry_schema_and_plan(spark):
    from panelsignal.plans.inspect import plan_summary

    df = E.entry(spark)
    assert [(f.name, f.dataType.simpleString()) for f in df.schema.fields] == [
        ("date", "date"),
        ("asset_id", "bigint"),
        ("alpha", "double"),
        ("predicted_beta", "double"),
    ]
    df.collect()
    s = plan_summary(df)
    assert s["sort_merge_joins"] == 0 and s["broadcast_joins"] >= 1, s
