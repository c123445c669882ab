"""Time the headline queries: ``BENCH_SF_DIR`` (data), ``BENCH_CPUS`` (local threads). Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from lumenwatch.plans import catalog  # noqa: E402

HEADLINE = (
    "a1_window_features", "a1_minute_windows", "a2_batch_features", "w6_statistical_scores", "w15_detect_with_forest",
    "a10_system_summary", "t1_newest_logs", "t2_busiest_services", "a7_confidence_histogram", "p9_normalise", "s3_decode_records",
    "j1_context_logs", "m3_histogram_quantiles", "st4_suppression_of_errors", "r5_route_alerts", "u5_analyze_anomalies",
    "g1_hops_from_gateway", "st1_stream_features", "st7_landing", "st7_landing_at_once",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        catalog.forget_landed()
        started = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    # Compile and start Python workers once, so that times are those of a session in use.
    for name in ("a1_window_features", "st4_suppression_of_errors"):
        run(name)
    times = {name: round(run(name), 3) for name in HEADLINE}
    logs = spark.read.parquet(f"{folder}/events.parquet").count()
    rate = {n: round(logs / times[n]) for n in ("a1_window_features", "w6_statistical_scores", "w15_detect_with_forest", "st1_stream_features", "st7_landing", "st7_landing_at_once")}
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(os.path.normpath(folder)).removeprefix("sf"), "logs": logs, "logs_per_sec": rate,
    }))


if __name__ == "__main__":
    main()
