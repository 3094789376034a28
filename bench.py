"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data (default sf0.1), ``BENCH_CPUS`` the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from registry.all import QUERIES

HEADLINE = [
    "scenario_comparison", "recommendations", "recommendation_summary", "resource_needs", "baseline_fit", "baseline_in_sample",
    "forecast_kpis", "regression_metrics", "kpi_block", "weekly_resample", "weekly_resample_by_site",
    "rolling_mean", "naive_forecast", "stock_ledger", "event_spells", "chronological_split", "filled_gaps",
    "clean_rows", "temporal_features", "correlation_matrix", "histogram", "weekday_box_plot", "describe", "column_stats",
    "validation_issues", "column_profile", "drift_comparison", "daily_table", "all_rules", "forest_metrics",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:] or HEADLINE
    # One untimed query starts the code generator and the file readers.
    QUERIES["coverage"](spark, sf).collect()
    seconds, failed = {}, {}
    for name in wanted:
        start = time.perf_counter()
        try:
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        except Exception as error:  # the other figures still count
            failed[name] = f"{type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}"[:300]
            continue
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
    } | ({"failed": failed} if failed else {})))
    spark.stop()


if __name__ == "__main__":
    main()
