"""Physical-plan summary of every registered query (development tool).

usage: python tests/plan_report.py [sf_dir] [name ...]

For each query: shuffles (Exchange), broadcasts, Python nodes, joins,
sorts, and whether filters reach the parquet scan.  Plans are taken before
execution, so AQE may still change join strategies at run time.
"""

from __future__ import annotations

import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def summary(plan: str) -> dict:
    count = lambda pat: len(re.findall(pat, plan))
    return {
        "exchanges": count(r"Exchange (?:hashpartitioning|rangepartitioning|RoundRobinPartitioning|SinglePartition)"),
        "broadcasts": count(r"BroadcastExchange"),
        "python": count(r"MapInPandas|ArrowEvalPython|BatchEvalPython|FlatMapGroupsInPandas"),
        "smj": count(r"SortMergeJoin"),
        "bhj": count(r"BroadcastHashJoin"),
        "nlj": count(r"NestedLoopJoin|CartesianProduct"),
        "windows": count(r"\bWindow \["),
        "aggregates": count(r"HashAggregate|ObjectHashAggregate|SortAggregate"),
        "pushed": count(r"PushedFilters: \[[^\]]+\]"),
    }


def main(argv):
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    only = set(argv[2:])
    from tessera.plans.catalog import QUERIES
    from tessera.session import get_session

    spark = get_session()
    for name, fn in QUERIES.items():
        if only and name not in only:
            continue
        try:
            plan = fn(spark, sf)._jdf.queryExecution().executedPlan().toString()
        except Exception as exc:  # noqa: BLE001
            print(f"{name:24s} error {type(exc).__name__}")
            continue
        s = summary(plan)
        print(f"{name:24s} " + " ".join(f"{k}={v}" for k, v in s.items()))


if __name__ == "__main__":
    main(sys.argv)
