"""Time the registered queries: median of three runs after one warm-up, one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from meterline.plans.registry import QUERIES
from meterline.session import local_session

HEADLINE = [
    "accepted_readings_by_day", "a3_feed_read_csv", "a5_checksum", "b8_quarantine_decision", "c5_first_reason", "c6_staging_project",
    "c7_load_stats", "d5_referential_integrity", "e2_fact_load", "e4_fact_merge", "e5_enrich", "e6_mart_daily_energy", "f2_aggregate_recon",
    "f5_layer_recon", "g2_time_series", "g3_anomalies", "g4_site_totals", "g7_site_detail", "g7_latest_readings", "h10_daily_ops_report",
    "h12_rolling_pass_rate", "h13_check_history", "h21_batch_lineage", "i1_lifecycle_fold", "i9_likely_causes", "j9_fact_duplicates",
    "m3_rolling_quality_stream",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cores, shuffle_partitions=cores)
    times: dict[str, float] = {}
    for name in HEADLINE:
        measured = []
        for attempt in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if attempt:
                measured.append(time.perf_counter() - start)
        times[name] = round(statistics.median(measured), 3)
    spark.stop()
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {"metric": "headline queries, sum of medians", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": scale}
        )
    )


if __name__ == "__main__":
    main()
