"""Plan inspection: count the physical operators that matter at scale.

Used by tests to pin plan shapes (number of shuffles, window passes,
Python nodes, broadcasts) and handy when iterating with ``explain``.
Reads the executed plan of the DataFrame's own query execution; after an
action it is AQE's final plan, before it the initial one.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def plan_text(df: DataFrame) -> str:
    text = df._jdf.queryExecution().executedPlan().toString()
    # AQE prints the final plan first and the initial plan after it
    return text.split("+- == Initial Plan ==")[0]


def plan_summary(df: DataFrame) -> dict[str, int]:
    text = plan_text(df)
    lines = text.splitlines()

    def count(pattern: str) -> int:
        return sum(1 for line in lines if re.search(pattern, line))

    return {
        "shuffle_exchanges": count(r"\bExchange hashpartitioning|\bExchange rangepartitioning|\bExchange SinglePartition"),
        "asset_exchanges": count(r"Exchange hashpartitioning\(asset_id"),
        "broadcasts": count(r"BroadcastExchange"),
        "reused_exchanges": count(r"ReusedExchange"),
        "windows": count(r"\bWindow \["),
        "sorts": count(r"\bSort \["),
        "python_nodes": count(r"ArrowEvalPython|BatchEvalPython|FlatMapGroupsInPandas|MapInPandas"),
        "sort_merge_joins": count(r"SortMergeJoin"),
        "broadcast_joins": count(r"BroadcastHashJoin"),
    }
