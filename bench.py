"""Headline queries on whole tables: one warm-up, then the median of one or more timed runs, one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from workload.queries import QUERIES
from workload.session import local_session

HEADLINE = (
    "A3_sniff_delimiter", "C5_select_header", "A4_adaptive_scan", "E8_column_profile", "E8_wide_profile",
    "D4_coerce_numeric", "F3_mean_z", "F5_isolation_forest", "F6_anomaly_ensemble", "F7_mark_anomalies",
    "G4_embedding_consistency", "H9_periodicity", "H12_hierarchy_score", "I6_perceive_table", "J10_correlations",
    "J15_graph_edges",
)


def run(query, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = local_session(cpus=cpus, shuffle_partitions=cpus)
    times = {}
    for name in names:
        run(QUERIES[name], spark, sf_dir)
        times[name] = round(statistics.median(run(QUERIES[name], spark, sf_dir) for _ in range(repeats)), 3)
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
