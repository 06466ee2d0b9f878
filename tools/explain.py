"""Print the plan of a registered query: operator counts and, optionally, the
formatted physical plan after execution (AQE's final plan).

Usage: python tools/explain.py <query> [sf_dir] [--formatted]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main(argv: list[str]) -> None:
    args = [a for a in argv[1:] if not a.startswith("--")]
    name = args[0]
    sf_dir = args[1] if len(args) > 1 else "/root/testdata/sf0.01"
    from panelsignal.plans.inspect import plan_summary
    from panelsignal.plans.queries import REGISTRY
    from panelsignal.session import local_session

    spark = local_session(8)
    df = REGISTRY[name](spark, sf_dir)
    df.collect()  # execute so that the adaptive plan is final
    print(plan_summary(df))
    if "--formatted" in argv:
        df.explain("formatted")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
