"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs once over its whole tables; results are computed in full and discarded.
"""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from harvestlake.plans import catalog
from harvestlake.session import build_session

HEADLINE = (
    "link_drop_stats",
    "extract_links_shop",
    "classify_pages",
    "jsonld_products",
    "canonicalize_call_urls",
    "filter_links",
    "normalize_products",
    "upsert_latest",
    "upsert_counts",
    "run_stats",
    "record_issues",
    "quality_summary_gate",
    "coverage_report",
    "fetch_metrics",
    "batch_pressure",
    "endpoint_cooldown",
    "profile_health_score",
    "politeness_schedule",
    "frontier_add",
    "resume_pending",
    "robots_verdict",
    "scan_api_payloads",
    "paged_assembly",
    "stream_fetch_metrics",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    # start the workers and the code generator before the clock runs
    spark.range(1000).selectExpr("id % 7 AS k", "cast(id AS string) AS s").groupBy("k").count().collect()
    times = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = Path(sf_dir).name.removeprefix("sf")
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
