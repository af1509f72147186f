"""Lists what the physical plan of each registered query holds: scans, exchanges, windows, joins.

python -m tests.plans [query ...]   (with names: the whole plan)
"""

from __future__ import annotations

import re
import sys

from __spark_entry__ import queries
from gradeloom.session import build_session


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def summary(plan: str) -> dict[str, int]:
    count = lambda p: len(re.findall(p, plan))
    return {
        "scan": count(r"FileScan"), "exchange": count(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange RoundRobin"),
        "single": count(r"Exchange SinglePartition"), "window": count(r"[- ]Window \["), "limit": count("WindowGroupLimit"),
        "loop": count("NestedLoop|Cartesian"), "smj": count("SortMergeJoin"), "bhj": count("BroadcastHashJoin"), "python": count("ArrowEvalPython|MapInArrow|MapInPandas"),
    }


def main(names: list[str]) -> None:
    spark = build_session("plans", "local[4]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                  "spark.ui.showConsoleProgress": "false",
                                                  "spark.sql.autoBroadcastJoinThreshold": "-1"})
    spark.sparkContext.setLogLevel("ERROR")
    for name, fn in queries().items():
        if names and name not in names:
            continue
        plan = plan_of(fn(spark, "/root/testdata/sf0.001"))
        if names:
            print(name, plan)
        print(f"{name:30s}", {k: v for k, v in summary(plan).items() if v})


if __name__ == "__main__":
    main(sys.argv[1:])
