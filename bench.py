"""Headline queries on one machine; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidewatch.plans.catalog import all_queries  # noqa: E402
from tidewatch.session import local_session  # noqa: E402

HEADLINE = (
    "coverage_by_hospital", "trailing_stats", "trailing_slope", "feature_frame", "encounters", "quality_report", "splits",
    "hourly_metrics", "subgroups", "utility", "best_threshold", "alert_metrics", "policy_states", "policy_by_budget",
    "bootstrap_ci", "utility_ci", "feature_drift", "clip_bounds", "top_contributions", "patients",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = local_session(cpus, shuffle_partitions=int(cpus), memory=os.environ.get("BENCH_MEMORY", "12g"))
    entries = all_queries()
    entries["status"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm the JVM once
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        entries[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
