"""Cross-table integrity: parent filters, validation report and assertions."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from voltlens.functions import wall_clock
from voltlens.operators.calendar import calendar_columns
from voltlens.operators.demand import demand_rate_by_weather
from voltlens.operators.keys import orphan_keys, with_known_key
from voltlens.sources.schemas import TABLE_KEYS

# Columns each table must offer to feature engineering.
EXPECTED_COLUMNS: dict[str, tuple[str, ...]] = {
    "charging_orders": (
        "session_id", "user_id", "station_id", "device_id", "location_id", "weather_id",
        "created_at", "ended_at", "charge_time_hrs", "start_hour", "weekday", "is_weekend",
        "is_holiday", "is_workday", "energy_kwh", "fee_amount_cny", "order_status",
    ),
    "stations": (
        "station_id", "location_id", "facility_type", "device_count",
        "electricity_price_cny_kwh", "service_fee_cny_kwh", "station_status",
    ),
    "devices": (
        "device_id", "station_id", "charger_type", "rated_power_kw", "connector_count",
        "current_status",
    ),
    "users": (
        "user_id", "vehicle_type", "battery_capacity_kwh", "member_level", "user_status",
    ),
    "weather_hourly": (
        "weather_id", "location_id", "weather_time", "weather_type", "temperature_c",
        "humidity_pct", "precipitation_mm", "wind_speed_mps", "visibility_km", "is_rain",
    ),
    "device_status_log": (
        "status_id", "device_id", "station_id", "online_minutes", "offline_minutes",
        "fault_minutes", "fault_count", "avg_output_power_kw", "availability_rate",
        "health_score",
    ),
}

# The checked relations (name, child, child key, parent).
FOREIGN_KEYS = (
    ("order_user_fk_unmatched", "charging_orders", "user_id", "users"),
    ("order_station_fk_unmatched", "charging_orders", "station_id", "stations"),
    ("order_device_fk_unmatched", "charging_orders", "device_id", "devices"),
    ("order_weather_fk_unmatched", "charging_orders", "weather_id", "weather_hourly"),
    ("device_station_fk_unmatched", "devices", "station_id", "stations"),
    ("status_device_fk_unmatched", "device_status_log", "device_id", "devices"),
)


def valid_devices(devices: DataFrame, stations: DataFrame) -> DataFrame:
    return with_known_key(devices, stations, "station_id")


def valid_weather(weather: DataFrame, stations: DataFrame) -> DataFrame:
    return with_known_key(weather, stations, "location_id")


def valid_device_status(status: DataFrame, devices: DataFrame) -> DataFrame:
    """Status rows whose device exists and belongs to the same station (two-column semi join)."""
    pairs = devices.select("device_id", "station_id")
    return status.join(pairs, ["device_id", "station_id"], "left_semi")


def _missing_counts(df: DataFrame) -> dict[str, Column]:
    def missing(name: str, kind: str) -> Column:
        absent = F.col(name).isNull()
        return absent | (F.trim(F.col(name)) == "") if kind == "string" else absent

    return {name: F.count_if(missing(name, kind)) for name, kind in df.dtypes}


def null_counts(df: DataFrame) -> DataFrame:
    """(column_name, missing) for every column; blank text counts as missing.  One aggregate."""
    counts = df.agg(*[count.alias(name) for name, count in _missing_counts(df).items()])
    return counts.unpivot([], df.columns, "column_name", "missing")


def orphan_count(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """One row: how many child rows point to no parent."""
    return orphan_keys(child, child_key, parent, parent_key).agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("unmatched")
    )


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def validate_tables(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Long report (section, table_name, item, value).

    Sections: missing_column and extra_column (value 1 each), row_count,
    missing_values per column, duplicate_keys and foreign_key orphans.
    """
    absent = sorted(set(EXPECTED_COLUMNS) - set(tables))
    if absent:
        raise ValueError("missing tables: " + ", ".join(absent))

    def facts(df: DataFrame, table: str, values: list[tuple[str, str, Column]]) -> DataFrame:
        """The given (section, item, value) of a frame, one report row each."""
        entries = F.array(*[
            F.struct(
                F.lit(section).alias("section"), F.lit(table).alias("table_name"),
                F.lit(item).alias("item"), value.cast("bigint").alias("value"),
            )
            for section, item, value in values
        ])
        return df.select(F.inline(entries))

    parts: list[DataFrame] = []
    for table, expected in EXPECTED_COLUMNS.items():
        frame, key = tables[table], TABLE_KEYS[table]
        header = [("missing_column", n, F.lit(1)) for n in sorted(set(expected) - set(frame.columns))]
        header += [("extra_column", n, F.lit(1)) for n in sorted(set(frame.columns) - set(expected))]
        # One pass for the row and null counts, one narrow pass for the keys.
        counts = frame.agg(
            F.count("*").alias("rows"), *[c.alias(f"_{n}") for n, c in _missing_counts(frame).items()]
        )
        keys = frame.groupBy(key).agg(F.count("*").alias("n")).agg(
            F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus")
        )
        parts.append(facts(counts, table, [
            *header,
            ("row_count", "rows", F.col("rows")),
            *[("missing_values", n, F.col(f"_{n}")) for n in frame.columns],
        ]))
        parts.append(facts(keys, table, [("duplicate_keys", key, F.col("surplus"))]))
    for name, child, key, parent in FOREIGN_KEYS:
        orphans = orphan_count(tables[child], key, tables[parent], TABLE_KEYS[parent])
        parts.append(facts(orphans, child, [("foreign_key", name, F.col("unmatched"))]))
    return _union(parts)


def cross_table_assertions(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Seventeen assertions as (check_name, passed, violations).

    ``tables`` holds the six typed tables under their public column names.
    """
    users, stations = tables["users"], tables["stations"]
    devices, orders = tables["devices"], tables["charging_orders"]
    weather, status = tables["weather_hourly"], tables["device_status_log"]

    def verdict(name: str, df: DataFrame, violations: Column) -> DataFrame:
        counted = df.agg(F.coalesce(violations, F.lit(0)).cast("bigint").alias("violations"))
        return counted.select(
            F.lit(name).alias("check_name"),
            (F.col("violations") == 0).alias("passed"),
            "violations",
        )

    checks: list[DataFrame] = []
    for name, df, key in (
        ("unique_user_id", users, "user_id"),
        ("unique_station_id", stations, "station_id"),
        ("unique_device_id", devices, "device_id"),
        ("unique_weather_id", weather, "weather_id"),
        ("unique_session_id", orders, "session_id"),
        ("unique_status_id", status, "status_id"),
    ):
        per_key = df.groupBy(key).agg((F.count("*") - 1).alias("surplus"))
        checks.append(verdict(name, per_key, F.sum("surplus")))
    for name, child, key, parent in (
        ("order_user_fk", orders, "user_id", users),
        ("order_station_fk", orders, "station_id", stations),
        ("order_device_fk", orders, "device_id", devices),
        ("order_weather_fk", orders, "weather_id", weather),
        ("status_device_fk", status, "device_id", devices),
    ):
        checks.append(verdict(name, orphan_keys(child, key, parent, key), F.sum("rows")))

    # Reduce orders to the compared pair before the join, so a hot device costs one row.
    pairs = orders.groupBy("device_id", "station_id").agg(F.count("*").alias("n"))
    owners = devices.select("device_id", F.col("station_id").alias("owner"))
    checks.append(verdict(
        "order_device_belongs_to_station",
        pairs.join(owners, "device_id", "left"),
        F.sum(F.when(~F.col("station_id").eqNullSafe(F.col("owner")), F.col("n"))),
    ))
    counted = devices.groupBy("station_id").agg(F.count("*").alias("found"))
    checks.append(verdict(
        "station_device_count_matches",
        stations.select("station_id", "device_count").join(counted, "station_id", "full_outer"),
        F.count_if(~F.col("device_count").eqNullSafe(F.col("found"))),
    ))
    registered = users.select("user_id", wall_clock(users, "registered_at").alias("since"))
    checks.append(verdict(
        "users_registered_before_orders",
        orders.select("user_id", "created_at").join(registered, "user_id", "left"),
        F.count_if(~F.coalesce(F.col("since") <= F.col("created_at"), F.lit(False))),
    ))
    checks.append(verdict(
        "orders_end_after_start",
        orders,
        F.count_if(~F.coalesce(F.col("ended_at") > F.col("created_at"), F.lit(False))),
    ))
    flags = ("is_weekend", "is_holiday", "is_workday")
    dated = orders.select("created_at", *flags).withColumns(
        {f"_{name}": column for name, column in calendar_columns(F.to_date("created_at")).items()}
    )
    agree = reduce(lambda a, b: a & b, [F.col(f).eqNullSafe(F.col(f"_{f}")) for f in flags])
    checks.append(verdict("order_holiday_fields_match_calendar", dated, F.count_if(~agree)))

    rates = demand_rate_by_weather(orders, weather, stations).agg(
        *[
            F.max(F.when(F.col("weather_type") == kind, F.col("orders_per_1000_station_hours"))).alias(kind)
            for kind in ("sunny", "light_rain", "heavy_rain")
        ]
    )
    falls = (F.col("light_rain") < F.col("sunny")) & (F.col("heavy_rain") < F.col("light_rain"))
    checks.append(verdict("rain_reduces_demand", rates, F.count_if(~F.coalesce(falls, F.lit(False)))))
    return _union(checks)
