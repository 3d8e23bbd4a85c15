"""Row-level quality reasons of raw charging orders.

Each raw row keeps its place and gains ``quality_issues``, an array of reason
names in rule order.  A rule whose condition is null does not fire; the
missing/invalid rule of the same field reports such values.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F

from voltlens.functions import (
    blank,
    elapsed_seconds,
    folded_in,
    hour_floor,
    lenient_int,
    monday_index,
    parse_wall_clock,
    present,
    require_columns,
    trimmed,
)
from voltlens.operators.keys import mark_repeats, one_per_key
from voltlens.sources.schemas import CORRUPT, RAW_COLUMNS

# Texts and limits of the rule contract.
WEEKDAY_NAMES = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
PLATFORMS = ("android", "ios", "web")
ORDER_STATES = ("completed", "interrupted", "failed")
PAYMENT_STATES = ("paid", "pending", "refunded", "waived")
LONGEST_HOURS = 24
DURATION_SLACK_HOURS = 0.02

ORDER_COLUMNS = RAW_COLUMNS["charging_orders"]
ISSUES = "quality_issues"


def process_charging_time(raw: DataFrame) -> DataFrame:
    """Add the parsed ``_`` columns; no row is dropped and no value changed."""
    require_columns(raw, ORDER_COLUMNS, "charging orders")
    parsed = raw.select(
        "*",
        parse_wall_clock(F.col("created_at")).alias("_created_at"),
        parse_wall_clock(F.col("ended_at")).alias("_ended_at"),
        trimmed("energy_kwh").try_cast("decimal(14,3)").alias("_energy_kwh"),
        trimmed("fee_amount_cny").try_cast("decimal(14,2)").alias("_fee_amount_cny"),
        trimmed("charge_time_hrs").try_cast("double").alias("_charge_time_hrs"),
        *[
            lenient_int(F.col(name)).alias(f"_{name}")
            for name in ("start_hour", "weekday", "is_weekend", "is_holiday", "is_workday")
        ],
        (
            F.nullif(
                F.array_position(F.array(*map(F.lit, WEEKDAY_NAMES)), trimmed("weekday_name")),
                F.lit(0),
            )
            - 1
        ).cast("int").alias("_weekday_from_name"),
    )
    return parsed.select(
        "*",
        (elapsed_seconds(F.col("_created_at"), F.col("_ended_at")) / F.lit(3600.0)).alias(
            "_actual_duration_hrs"
        ),
        monday_index(F.col("_created_at")).alias("_weekday_from_timestamp"),
    )


def _outside(name: str, low: int, high: int) -> Column:
    return F.col(name).isNull() | ~F.col(name).between(low, high)


def _measure(field: str) -> Iterator[tuple[str, Column]]:
    yield f"missing_{field}", blank(field)
    yield f"invalid_{field}_type", present(field) & F.col(f"_{field}").isNull()
    yield f"negative_{field}", F.col(f"_{field}") < 0


def _instant(field: str) -> Iterator[tuple[str, Column]]:
    yield f"missing_{field}", blank(field)
    yield f"invalid_{field}", present(field) & F.col(f"_{field}").isNull()


def _order_rules(has_corrupt: bool) -> Iterator[tuple[str, Column]]:
    hours, actual = F.col("_charge_time_hrs"), F.col("_actual_duration_hrs")
    day = F.col("_weekday")

    yield "corrupt_csv_row", F.col(CORRUPT).isNotNull() if has_corrupt else F.lit(False)
    for owner in ("session", "user", "station", "device", "location", "weather"):
        yield f"missing_{owner}_id", blank(f"{owner}_id")
    yield from _measure("energy_kwh")
    yield from _measure("fee_amount_cny")
    yield from _instant("created_at")
    yield from _instant("ended_at")
    yield "ended_not_after_created", F.col("_ended_at") <= F.col("_created_at")
    yield "invalid_charge_duration", hours.isNull() | (hours <= 0) | (hours > LONGEST_HOURS)
    yield "charge_duration_mismatch", F.abs(actual - hours) > DURATION_SLACK_HOURS
    yield "invalid_start_hour", _outside("_start_hour", 0, 23)
    yield "start_hour_mismatch", F.hour("_created_at") != F.col("_start_hour")
    yield "invalid_weekday", _outside("_weekday", 0, 6)
    yield "invalid_weekday_name", F.col("_weekday_from_name").isNull()
    yield "weekday_name_mismatch", day != F.col("_weekday_from_name")
    yield "weekday_timestamp_mismatch", day != F.col("_weekday_from_timestamp")
    for flag in ("is_weekend", "is_holiday", "is_workday"):
        yield f"invalid_{flag}", _outside(f"_{flag}", 0, 1)
    yield "weekend_flag_mismatch", F.col("_is_weekend") != (day >= 5).cast("int")
    yield "missing_holiday_name", blank("holiday_name")
    for field, allowed in (
        ("platform", PLATFORMS), ("order_status", ORDER_STATES), ("payment_status", PAYMENT_STATES),
    ):
        yield f"invalid_{field}", blank(field) | ~folded_in(field, allowed)
    yield "duplicate_session_id", F.col("_repeated")


def _reasons(rules) -> Column:
    return F.array_compact(F.array(*[F.when(fires, F.lit(name)) for name, fires in rules]))


def detect_quality_issues(raw: DataFrame) -> DataFrame:
    """Attach ``quality_issues`` from the 35 rules on single rows and repeated ids."""
    require_columns(raw, ORDER_COLUMNS, "charging orders")
    # Repeats are marked on the raw text, so that no value is parsed twice.
    marked = process_charging_time(mark_repeats(
        raw,
        key=trimmed("session_id"),
        order=[
            parse_wall_clock(F.col("created_at")).asc_nulls_last(),
            parse_wall_clock(F.col("ended_at")).asc_nulls_last(),
            trimmed("station_id").asc_nulls_last(),
        ],
        name="_repeated",
    ))
    return marked.withColumn(ISSUES, _reasons(_order_rules(CORRUPT in raw.columns))).drop("_repeated")


def _checked(df: DataFrame) -> DataFrame:
    return df if ISSUES in df.columns else detect_quality_issues(df)


def detect_reference_issues(
    orders: DataFrame,
    *,
    users: DataFrame | None = None,
    stations: DataFrame | None = None,
    devices: DataFrame | None = None,
    weather: DataFrame | None = None,
) -> DataFrame:
    """Append reasons found by comparing orders with their parent tables.

    Every parent is optional.  Each is cut to the compared columns, reduced to
    one row per key and left-joined; Spark picks broadcast or shuffle by size,
    and the reasons of all parents are appended in one expression.
    """
    result = _checked(orders)
    kept = result.columns
    rules: list[tuple[str, Column]] = []

    def attach(parent: DataFrame, key: str, carried: dict[str, str]) -> Column:
        nonlocal result
        found = f"_known_{key}"
        side = one_per_key(
            parent.select(
                F.col(key).alias(found), *[F.col(src).alias(dst) for src, dst in carried.items()]
            ),
            found,
        )
        result = result.join(side, trimmed(key) == F.col(found), "left")
        return F.col(found)

    if users is not None:
        known = attach(users, "user_id", {})
        rules.append(("unknown_user_id", present("user_id") & known.isNull()))
    if stations is not None:
        known = attach(stations, "station_id", {"location_id": "_station_location"})
        rules.append(("unknown_station_id", present("station_id") & known.isNull()))
        rules.append(
            ("station_location_mismatch",
             known.isNotNull() & (trimmed("location_id") != F.col("_station_location")))
        )
    if devices is not None:
        known = attach(devices, "device_id", {"station_id": "_device_station"})
        rules.append(("unknown_device_id", present("device_id") & known.isNull()))
        rules.append(
            ("device_station_mismatch",
             known.isNotNull() & (trimmed("station_id") != F.col("_device_station")))
        )
    if weather is not None:
        known = attach(
            weather, "weather_id",
            {"location_id": "_weather_location", "weather_time": "_weather_time"},
        )
        rules.append(("unknown_weather_id", present("weather_id") & known.isNull()))
        rules.append(
            ("weather_location_mismatch",
             known.isNotNull() & (trimmed("location_id") != F.col("_weather_location")))
        )
        rules.append(
            ("weather_time_mismatch",
             known.isNotNull() & (hour_floor(F.col("_created_at")) != F.col("_weather_time")))
        )
    if not rules:
        return result
    return result.withColumn(ISSUES, F.concat(F.col(ISSUES), _reasons(rules))).select(*kept)


def _clean_projection() -> dict[str, Column]:
    lowered = {"platform", "order_status", "payment_status"}
    parsed = {
        "created_at", "ended_at", "energy_kwh", "fee_amount_cny", "charge_time_hrs",
        "start_hour", "weekday", "is_weekend", "is_holiday", "is_workday",
    }
    columns = {}
    for name in ORDER_COLUMNS:
        if name in parsed:
            columns[name] = F.col(f"_{name}")
        elif name in lowered:
            columns[name] = F.lower(trimmed(name))
        else:
            columns[name] = trimmed(name)
    return columns


def clean_orders(df: DataFrame) -> DataFrame:
    """Orders without any reason, typed, under the public column names."""
    columns = _clean_projection()
    return _checked(df).where(F.size(ISSUES) == 0).select(
        *[column.alias(name) for name, column in columns.items()]
    )


# Column order of the analytic order table, and its renamed columns.
FACT_COLUMNS = (
    "session_id", "kwh_total", "charging_fees", "created_at", "ended_at", "start_hour",
    "end_hour", "charge_time_hrs", "start_weekday", "weekday_name", "start_date", "platform",
    "user_id", "station_id", "device_id", "location_id", "weather_id", "is_weekend",
    "is_holiday", "holiday_name", "is_workday", "order_status", "payment_status",
)
FACT_NAMES = {"energy_kwh": "kwh_total", "fee_amount_cny": "charging_fees", "weekday": "start_weekday"}


def order_facts(df: DataFrame) -> DataFrame:
    """Orders without any reason as the 23-column analytic fact table."""
    return as_facts(clean_orders(df))


def as_facts(orders: DataFrame) -> DataFrame:
    """Public-name orders renamed and extended to the analytic fact columns."""
    facts = orders.withColumnsRenamed(FACT_NAMES).withColumns(
        {"end_hour": F.hour("ended_at"), "start_date": F.to_date("created_at")}
    )
    return facts.select(*FACT_COLUMNS)


def rejected_orders(df: DataFrame) -> DataFrame:
    """Rows with at least one reason: raw columns, lineage and the reasons."""
    checked = _checked(df)
    extra = (CORRUPT, "_source_file", "_ingested_at", ISSUES)
    shown = [name for name in (*ORDER_COLUMNS, *extra) if name in checked.columns]
    return checked.where(F.size(ISSUES) > 0).select(*shown)


def quality_summary(df: DataFrame) -> DataFrame:
    """Counts of all, valid and rejected rows and of every reason, ordered by metric.

    One pass: each row contributes its metric names and one count is taken.
    The three overview rows are present even for an empty input.
    """
    checked = _checked(df)
    outcome = F.when(F.size(ISSUES) == 0, F.lit("valid_rows")).otherwise(F.lit("rejected_rows"))
    names = F.concat(
        F.array(F.lit("total_rows"), outcome),
        F.transform(F.col(ISSUES), lambda reason: F.concat(F.lit("issue:"), reason)),
    )
    counted = checked.select(F.explode(names).alias("metric"), F.lit(1).alias("one"))
    floor = checked.sparkSession.range(1).select(
        F.explode(F.array(*map(F.lit, ("total_rows", "valid_rows", "rejected_rows")))).alias("metric"),
        F.lit(0).alias("one"),
    )
    return (
        counted.unionByName(floor)
        .groupBy("metric")
        .agg(F.sum("one").cast("bigint").alias("count"))
        .orderBy("metric")
    )


def rejected_count(df: DataFrame) -> DataFrame:
    """One row with the number of rejected orders."""
    return _checked(df).agg(F.count_if(F.size(ISSUES) > 0).alias("rejected_order_rows"))


def measurement_predicate() -> Column:
    """Plausible energy, fee, duration, hour and weekday on already typed columns."""
    return (
        (F.col("energy_kwh") >= 0)
        & (F.col("fee_amount_cny") >= 0)
        & (F.col("charge_time_hrs") > 0)
        & (F.col("charge_time_hrs") <= LONGEST_HOURS)
        & F.col("start_hour").between(0, 23)
        & F.col("weekday").between(0, 6)
    )


def trim_text_columns(df: DataFrame) -> DataFrame:
    """Trim every text column in one projection."""
    return df.select(
        *[F.trim(F.col(n)).alias(n) if kind == "string" else F.col(n) for n, kind in df.dtypes]
    )
