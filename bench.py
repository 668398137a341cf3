"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` (default ``/root/testdata/sf0.1``) names the tables, ``BENCH_CPUS`` the
cores of ``local[n]``. Every query is run whole into the ``noop`` sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from tidemark.workload import catalog

HEADLINE = (
    "customer_alerts", "customer_alerts_orders", "top_customers", "regional_summary", "customer_anomaly_metrics",
    "detected_rows", "anomaly_listing", "real_time_alerts", "import_main", "import_customers",
    "import_customers_envelope", "main_summary", "quality_overview", "quality_numbers", "profile_report",
    "content_hash", "linear_fill", "daily_continuity", "modelling_table", "feature_table", "rolling_statistics",
    "sequence_windows", "daily_forecast", "city_summary", "climate_enrichment", "compare_sources",
    "reading_payload_rows", "simple_forecasts", "ensemble_forecast", "cross_validated_mean",
    "cross_validated_harmonic", "residual_autocorrelation", "harmonic_forecast", "streamed_daily_rollup",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("tidemark-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["recent_rows"](spark, sf_dir).count()  # starts the executor and loads classes
    only = sys.argv[1:]
    seconds = {}
    for name in HEADLINE:
        if only and name not in only:
            continue
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
