"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs end to end from the parquet tables (fixture panel
derivation included) into Spark's no-op sink, so every stage executes
but nothing is collected to the driver.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "alpha",
    "vol_scaled_momentum",
    "ic_rank",
    "rolling_ols_ff5",
    "ff5_momentum",
    "mvo_diag_both",
    "portfolio_returns",
    "factor_regression_ff5",
    "all_signals_long",
    "summary_by_signal",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE

    from panelsignal.plans.queries import REGISTRY
    from panelsignal.session import local_session

    spark = local_session(cpus, app="panelsignal-bench")
    spark.conf.set("spark.sql.shuffle.partitions", str(max(8, 2 * int(cpus))) if cpus.isdigit() else "16")

    # warm-up: JVM, Python workers, parquet footers
    REGISTRY["panel_scan"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr)

    sf = os.path.basename(os.path.normpath(sf_dir)).replace("sf", "")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
