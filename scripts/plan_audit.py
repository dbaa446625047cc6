"""Execute every registry query and audit its final (post-AQE) physical plan.

usage: python scripts/plan_audit.py [sf_dir]
Prints one line per query: exchanges, sort-merge / broadcast joins, scans,
and any cross join, nested-loop join or Python evaluation (expected: none in
the retail queries), any sort-merge join on CustomerID alone under a line scan,
and more than two scans of the lines.
"""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

BAD = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
       "FlatMapGroupsInPandas", "MapInPandas", "LocalCheckpoint")


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from tillroll.session import local_session

    spark = local_session(cpus=4, memory="7g")
    flagged = 0
    from tillroll.plans.catalog import all_queries

    for name, fn in all_queries().items():
        df = fn(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        bad = [b for b in BAD if b in plan]
        final = plan.split("== Initial Plan ==")[0]
        if final.count("lineitem.parquet") > 2:
            bad.append(f"lines read {final.count('lineitem.parquet')} times")
        if "lineitem.parquet" in final and re.search(r"SortMergeJoin \[CustomerID#\d+\]", final) and "partial_" not in final:
            bad.append("raw lines joined on CustomerID")
        flagged += bool(bad)
        print(f"{name:48s} exchanges={len(re.findall(r'Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition', plan)):2d} "
              f"smj={plan.count('SortMergeJoin'):2d} bhj={plan.count('BroadcastHashJoin'):2d} "
              f"scans={plan.count('FileScan') + plan.count('Scan ExistingRDD'):2d} "
              f"{'FLAG ' + ','.join(bad) if bad else 'ok'}", flush=True)
    print(f"flagged {flagged}")


if __name__ == "__main__":
    main()
