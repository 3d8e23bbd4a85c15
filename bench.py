"""Wall time of the headline queries.

Reads ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]`` and prints one JSON line.
Each query runs once to warm up and then three times; the median counts.
Results go to Spark's no-op sink, so every row and column is computed.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from voltlens.parity.queries import QUERIES
from voltlens.session import build_session

HEADLINE = (
    "overall_kpis", "station_kpis", "user_kpis", "weekday_hour_heatmap", "device_kpis",
    "device_operation_kpis", "weather_impact", "recent_overview", "recent_weather_sessions",
    "settled_revenue_trend", "search_orders", "order_quality_issues", "order_facts",
    "quality_summary", "clean_device_status", "validate_tables", "station_hour_features",
    "lag_features", "time_split", "persistence_forecast", "peak_periods_per_station",
    "station_score", "ops_advice", "expected_demand", "cross_table_assertions", "fault_risk",
)


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count() or 4)
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = build_session(
        "voltlens-bench",
        f"local[{cpus}]",
        spark__ui__enabled="false",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory=os.environ.get("BENCH_DRIVER_MEMORY", "8g"),
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        run(spark, name, folder)
        seconds[name] = round(statistics.median(run(spark, name, folder) for _ in range(repeats)), 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
