"""Shuffle bytes that queries write, from Spark's event log.

usage: python scripts/shuffle_bytes.py sf_dir log_folder query...
Each query's result goes to the no-op sink; jobs it runs while its plan is built count too.
"""

from __future__ import annotations

import json
import os
import sys
from pathlib import Path

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def main(sf_dir: str, folder: str, names: list[str]) -> None:
    from tillroll.plans.catalog import all_queries
    from tillroll.session import local_session

    os.makedirs(folder, exist_ok=True)
    spark = local_session(cpus=4, memory="6g", extra={
        "spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file://{os.path.abspath(folder)}",
        "spark.eventLog.rolling.enabled": "false", "spark.eventLog.compress": "false"})
    log, queries = Path(folder, spark.sparkContext.applicationId), all_queries()
    for name in names:
        spark.sparkContext.setJobGroup(name, name)
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    spark.stop()

    stages, written, records = {}, dict.fromkeys(names, 0), dict.fromkeys(names, 0)
    for line in log.read_text().splitlines():
        e = json.loads(line)
        if e["Event"] == "SparkListenerJobStart":
            for s in e["Stage IDs"]:
                stages[s] = e.get("Properties", {}).get("spark.jobGroup.id")
        elif e["Event"] == "SparkListenerTaskEnd" and stages.get(e["Stage ID"]) in written:
            w = e.get("Task Metrics", {}).get("Shuffle Write Metrics", {})
            written[stages[e["Stage ID"]]] += w.get("Shuffle Bytes Written", 0)
            records[stages[e["Stage ID"]]] += w.get("Shuffle Records Written", 0)
    for name in names:
        print(f"{name:36s} {written[name] / 1e6:9.2f} MB {records[name]:10d} rows")


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2], sys.argv[3:])
