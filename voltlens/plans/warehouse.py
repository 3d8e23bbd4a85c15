"""The layered warehouse: raw CSV -> ods -> dwd -> dws and ads.

    python -m voltlens.plans.warehouse --input-root RAW --warehouse-root OUT

Each layer is written as Parquet and read back, so a later layer never
recomputes an earlier one and survives the loss of executors.  Tables of a layer that
do not need each other are written side by side.
"""

from __future__ import annotations

import argparse
from functools import partial

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from voltlens.operators import kpis
from voltlens.operators.cleaning import CLEANERS
from voltlens.operators.integrity import valid_device_status, valid_devices, valid_weather
from voltlens.operators.quality import (
    detect_quality_issues,
    detect_reference_issues,
    order_facts,
    quality_summary,
    rejected_orders,
)
from voltlens.session import build_session, side_by_side
from voltlens.sources import RAW_TABLES, read_raw, read_typed_table, write_table

# Large tables laid out by day so that date filters prune folders.
FACT_PARTITIONS = {"charging_orders": ("start_date",)}


def dwd_dimensions(raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Cleaned companion tables, restricted to rows whose parents exist."""
    clean = {name: cleaner(raw[name]) for name, cleaner in CLEANERS.items()}
    devices = valid_devices(clean["devices"], clean["stations"])
    return {
        "users": clean["users"],
        "stations": clean["stations"],
        "devices": devices,
        "weather_hourly": valid_weather(clean["weather_hourly"], clean["stations"]),
        "device_status_log": valid_device_status(clean["device_status_log"], devices),
    }


def checked_orders(raw_orders: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    return detect_reference_issues(
        detect_quality_issues(raw_orders),
        users=dims["users"],
        stations=dims["stations"],
        devices=dims["devices"],
        weather=dims["weather_hourly"],
    )


def result_tables(dwd: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Path under the warehouse root -> result frame, unsorted as written tables are."""
    facts, stations, devices = dwd["charging_orders"], dwd["stations"], dwd["devices"]
    return {
        "dws/station_kpis": kpis.station_kpis(facts, stations, ordered=False),
        "dws/user_kpis": kpis.user_kpis(facts, ordered=False),
        "dws/device_kpis": kpis.device_kpis(facts, devices, ordered=False),
        "dws/weekday_patterns": kpis.weekday_patterns(facts, ordered=False),
        "dws/holiday_patterns": kpis.holiday_patterns(facts, ordered=False),
        "dws/weather_impact": kpis.weather_impact(facts, dwd["weather_hourly"], stations, ordered=False),
        "dws/device_operation_kpis": kpis.device_operation_kpis(
            dwd["device_status_log"], devices, ordered=False
        ),
        "ads/overall_charging_kpis": kpis.overall_kpis(facts),
        "ads/user_summary_kpis": kpis.user_summary(facts),
        "dws/hourly_distribution": kpis.hourly_distribution(facts, ordered=False),
        "dws/weekday_heatmap": kpis.weekday_hour_heatmap(facts, ordered=False),
        "dws/session_count_trend": kpis.session_trend(facts, ordered=False),
        "dws/station_ranking": kpis.rank_stations(facts, stations),
        "dws/station_distribution": kpis.station_distribution(stations, ordered=False),
    }


def build_warehouse(
    spark: SparkSession, inputs: dict[str, str], root: str, mode: str = "overwrite"
) -> None:
    """Build all layers under ``root`` from one CSV path per raw table."""
    root = root.rstrip("/")

    def store(layer: str, name: str, frame: DataFrame) -> DataFrame:
        path = f"{root}/{layer}/{name}"
        days = FACT_PARTITIONS.get(name, ()) if layer == "dwd" else ()
        if days:  # else every task writes a file per day
            frame = frame.hint("rebalance", *days)
        write_table(frame, path, mode=mode, partition_by=days)
        return read_typed_table(spark, path)

    def store_all(layer: str, frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
        return dict(zip(frames, side_by_side(spark, [partial(store, layer, *item) for item in frames.items()]), strict=True))

    ods = store_all("ods", {name: read_raw(spark, name, inputs[name]) for name in RAW_TABLES})
    dims = dwd_dimensions(ods)
    status = {"device_status_log": dims.pop("device_status_log")}
    dwd = store_all("dwd", dims)

    def store_orders() -> dict[str, DataFrame]:
        # Three results share the checked rows; disk-backed cache, recomputable from ods, filled by the first of them.
        checked = checked_orders(ods["charging_orders"], dwd).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            store("ads", "data_quality", quality_summary(checked))
            kept = store_all("dwd", {"charging_orders": order_facts(checked), "charging_rejects": rejected_orders(checked)})
        finally:
            checked.unpersist()
        return kept

    # No check of an order looks at the status log.
    for made in side_by_side(spark, [store_orders, partial(store_all, "dwd", status)]):
        dwd |= made

    side_by_side(spark, [partial(store, *path.split("/"), frame) for path, frame in result_tables(dwd).items()])


def parse_args(argv=None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--input-root", help="folder holding <table>.csv for all six tables")
    for table in RAW_TABLES:
        parser.add_argument(f"--{table.replace('_', '-')}-input", dest=table)
    parser.add_argument("--warehouse-root", required=True)
    parser.add_argument("--mode", choices=("overwrite", "error"), default="overwrite")
    args = parser.parse_args(argv)
    args.inputs = {}
    for table in RAW_TABLES:
        path = getattr(args, table)
        if path is None and args.input_root:
            path = f"{args.input_root.rstrip('/')}/{table}.csv"
        if path is None:
            parser.error(f"give --input-root or --{table.replace('_', '-')}-input")
        args.inputs[table] = path
    return args


def main(argv=None) -> None:
    args = parse_args(argv)
    spark = build_session("voltlens-warehouse")
    build_warehouse(spark, args.inputs, args.warehouse_root, args.mode)
    spark.stop()


if __name__ == "__main__":
    main()
