"""Summarise the physical plan of every registered query (for plan review).

    python scripts/plan_report.py [sf_dir] > PLANS.md

Counts shuffles, broadcasts, join strategies, windows and Python nodes as planned
for one run of the library's own queries.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

NODES = ["ShuffleExchange", "BroadcastExchange", "SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin",
         "BroadcastNestedLoopJoin", "CartesianProduct", "Window", "TakeOrderedAndProject", "Generate",
         "MapInPandas", "ArrowEvalPython", "BatchEvalPython"]


def summarize(plan: str) -> dict:
    out = {n: len(re.findall(rf"\b{n}\b", plan)) for n in NODES}
    out["ShuffleExchange"] = len(re.findall(r"Exchange (?:hashpartitioning|rangepartitioning|RoundRobinPartitioning|SinglePartition)", plan))
    out["BroadcastExchange"] = len(re.findall(r"BroadcastExchange", plan))
    out["codegen"] = len(set(re.findall(r"\*\((\d+)\)", plan)))
    return out


def main():
    from tableguard.session import get_spark
    from tableguard.plans.registry import QUERIES as qs, load_all

    load_all()
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark()
    nested = []
    cols = ["ShuffleExchange", "BroadcastExchange", "SortMergeJoin", "BroadcastHashJoin", "BroadcastNestedLoopJoin",
            "CartesianProduct", "Window", "TakeOrderedAndProject", "MapInPandas"]
    print(f"# Physical plans at {sf}\n")
    print("Physical plans of the result as planned (AQE may still turn a sort-merge join into a broadcast join"
          " at run time).  Jobs that a query runs before its result, such as written layouts and size checks,"
          " are not in the counts; shuffle counts include the dealing-out of the test tables' single files"
          " by the registered queries (`plans/layout.py`).\n")
    print("| key | " + " | ".join(cols) + " |")
    print("| --- |" + " --- |" * len(cols))
    for k in sorted(qs):
        df = qs[k](spark, sf)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        s = summarize(plan)
        if s["BroadcastNestedLoopJoin"] or s["CartesianProduct"]:
            nested.append(k)
        print(f"| `{k}` | " + " | ".join(str(s[c]) for c in cols) + " |", flush=True)
    print("\nNested loops and cartesian products: " + (", ".join(f"`{k}`" for k in nested) or "none") + ".")


if __name__ == "__main__":
    main()
