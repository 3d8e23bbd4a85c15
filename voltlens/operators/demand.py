"""Demand calibration and daily roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voltlens.functions import hour_floor, monday_index, ratio
from voltlens.operators.calendar import calendar_columns
from voltlens.operators.features import explode_hours, hour_span
from voltlens.session import cut_lineage

# Relative demand by weather, limits and smoothing of the factors.
WEATHER_DEMAND = {
    "sunny": 1.00, "cloudy": 0.94, "overcast": 0.84, "fog": 0.70,
    "light_rain": 0.64, "heavy_rain": 0.36, "snow": 0.48,
}
STATION_SMOOTHING, STATION_LIMITS = 4.0, (0.25, 4.0)
HOUR_SMOOTHING, HOUR_LIMITS = 3.0, (0.22, 2.8)
WEEKDAY_SMOOTHING, WEEKDAY_LIMITS = 1.0, (0.72, 1.35)
CAPACITY_LIMITS = (0.55, 2.2)


def _clip(value: Column, limits: tuple[float, float]) -> Column:
    return F.greatest(F.lit(limits[0]), F.least(F.lit(limits[1]), value))


def _mean(df: DataFrame, name: str) -> Column:
    """Mean of a column as a scalar subquery, so no join is planned for it."""
    return df.agg(F.avg(name).alias("mean")).scalar()


def order_counts(orders: DataFrame) -> DataFrame:
    """Orders per station, weekday and hour: all three factors are made of these few rows."""
    at = F.col("created_at")
    return orders.groupBy("station_id", monday_index(at).alias("weekday"), F.hour(at).alias("hour")).agg(
        F.count("*").alias("n")
    )


def _by(orders: DataFrame, counts: DataFrame | None, key: str) -> DataFrame:
    counts = order_counts(orders) if counts is None else counts
    return counts.groupBy(key).agg(F.sum("n").alias("n"))


def station_factors(orders: DataFrame, stations: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(station_id, station_factor): smoothed order count over its mean, clipped."""
    counts = _by(orders, counts, "station_id")
    smoothed = stations.select("station_id").join(counts, "station_id", "left").select(
        "station_id", (F.coalesce("n", F.lit(0)) + F.lit(STATION_SMOOTHING)).alias("smoothed")
    )
    factor = _clip(F.col("smoothed") / _mean(smoothed, "smoothed"), STATION_LIMITS)
    return smoothed.select("station_id", factor.alias("station_factor"))


def hour_factors(orders: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(hour, hour_factor) for all 24 hours."""
    counts = _by(orders, counts, "hour")
    hours = orders.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    smoothed = hours.join(counts, "hour", "left").select(
        "hour", (F.coalesce("n", F.lit(0)) + F.lit(HOUR_SMOOTHING)).alias("smoothed")
    )
    factor = _clip(F.col("smoothed") / _mean(smoothed, "smoothed"), HOUR_LIMITS)
    return smoothed.select("hour", factor.alias("hour_factor"))


def weekday_factors(orders: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(weekday, weekday_factor): orders per available day of the observed span."""
    counts = _by(orders, counts, "weekday")
    span = orders.agg(
        F.to_date(F.min("created_at")).alias("first"), F.to_date(F.max("created_at")).alias("last")
    )
    days = span.where("first is not null").select(
        F.explode(F.sequence("first", "last", F.expr("interval 1 day"))).alias("day")
    )
    available = days.groupBy(monday_index(F.col("day")).alias("weekday")).agg(F.count("*").alias("days"))
    week = orders.sparkSession.range(7).select(F.col("id").cast("int").alias("weekday"))
    per_day = (
        week.join(counts, "weekday", "left")
        .join(available, "weekday", "left")
        .select(
            "weekday",
            (
                (F.coalesce("n", F.lit(0)) + F.lit(WEEKDAY_SMOOTHING)) / F.coalesce("days", F.lit(1))
            ).alias("per_day"),
        )
    )
    factor = _clip(F.col("per_day") / _mean(per_day, "per_day"), WEEKDAY_LIMITS)
    return per_day.select("weekday", factor.alias("weekday_factor"))


def expected_demand(
    orders: DataFrame, stations: DataFrame, weather: DataFrame, target_orders: float
) -> DataFrame:
    """(station_id, datetime, expected_orders) over all station-hours with weather.

    The seven factors of a station-hour are multiplied and scaled so that all
    station-hours add up to ``target_orders``.  The grid meets the weather on
    location and hour: a location with many stations is spread over its hours.
    """
    # One aggregate over the orders, written once: factors, means and the normaliser read its rows.
    counts = cut_lineage(order_counts(orders))
    scaled = stations.select(
        "station_id", "location_id",
        _clip(
            F.sqrt(F.col("device_count") / _mean(stations, "device_count")), CAPACITY_LIMITS
        ).alias("capacity_factor"),
    ).join(station_factors(orders, stations, counts), "station_id")

    def listed(df: DataFrame, key: str, value: str) -> Column:
        # 24 or 7 rows by construction: folded into one literal-sized map.
        return df.agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias("m")).scalar()

    table = F.create_map(*[F.lit(x) for item in WEATHER_DEMAND.items() for x in item])
    warm = F.col("temperature_c")
    comfort = (
        F.when(warm < -5, 0.72).when(warm > 36, 0.78).when(warm > 32, 0.90).otherwise(1.0)
    )
    weekend, workday, holiday = (F.col(c) == 1 for c in ("is_weekend", "is_workday", "is_holiday"))
    hours = weather.select(
        "location_id", "weather_time", "weather_type", "temperature_c",
        *[c.alias(n) for n, c in calendar_columns(F.to_date("weather_time")).items()],
    ).select(
        "location_id",
        F.col("weather_time").alias("datetime"),
        (
            F.element_at(listed(hour_factors(orders, counts), "hour", "hour_factor"), F.hour("weather_time"))
            * F.element_at(
                listed(weekday_factors(orders, counts), "weekday", "weekday_factor"),
                monday_index(F.col("weather_time")),
            )
            * F.coalesce(F.try_element_at(table, F.col("weather_type")), F.lit(1.0))
            * comfort
            * F.when(holiday, 0.72).when(weekend & workday, 1.03).otherwise(1.0)
        ).alias("hour_score"),
    )
    # Sum of products per location first: the normaliser never needs the grid.
    by_location = scaled.groupBy("location_id").agg(
        F.sum(F.col("station_factor") * F.col("capacity_factor")).alias("station_score")
    )
    total = (
        hours.groupBy("location_id").agg(F.sum("hour_score").alias("hours_score"))
        .join(by_location, "location_id")
        .agg(F.sum(F.col("hours_score") * F.col("station_score")).alias("total"))
        .scalar()
    )
    grid = explode_hours(scaled, hour_span(weather, F.col("weather_time")), "station_id").join(
        hours, ["location_id", "datetime"]
    )
    score = F.col("station_factor") * F.col("capacity_factor") * F.col("hour_score")
    return grid.select(
        "station_id", "datetime", (score * (F.lit(float(target_orders)) / total)).alias("expected_orders")
    )


def device_day_rollup(orders: DataFrame, devices: DataFrame) -> DataFrame:
    """One row per device and day of the observed span: session counts and mean output power."""
    day = F.to_date("created_at")
    daily = orders.groupBy("device_id", day.alias("stat_date")).agg(
        F.count_if(F.col("order_status") == "completed").alias("successful_sessions"),
        F.count_if(F.col("order_status") == "failed").alias("failed_sessions"),
        F.count("*").alias("total_sessions"),
        F.avg(ratio(F.col("energy_kwh").cast("double"), F.col("charge_time_hrs"))).alias(
            "avg_output_power_kw"
        ),
    )
    span = orders.agg(F.struct(F.min(day).alias("first"), F.max(day).alias("last")).alias("s")).scalar()
    fleet = devices.select("device_id", "station_id", "commissioned_at").repartition("device_id")
    grid = fleet.select("*", span.alias("_span")).select(
        "device_id", "station_id", "commissioned_at",
        F.explode(F.sequence("_span.first", "_span.last", F.expr("interval 1 day"))).alias("stat_date"),
    )
    return grid.join(daily, ["device_id", "stat_date"], "left").na.fill(
        {"successful_sessions": 0, "failed_sessions": 0, "total_sessions": 0, "avg_output_power_kw": 0.0}
    )


def weather_day_rollup(weather: DataFrame) -> DataFrame:
    """(location_id, stat_date): rain sum, mean humidity and temperature."""
    return weather.groupBy("location_id", F.to_date("weather_time").alias("stat_date")).agg(
        F.sum("precipitation_mm").alias("daily_precipitation_mm"),
        F.avg("humidity_pct").alias("daily_avg_humidity_pct"),
        F.avg("temperature_c").alias("daily_avg_temperature_c"),
    )


def fault_risk(orders: DataFrame, devices: DataFrame, stations: DataFrame, weather: DataFrame) -> DataFrame:
    """Fault probability per device-day from age, rain, humidity and use, clipped."""
    days = device_day_rollup(orders, devices).join(
        stations.select("station_id", "location_id"), "station_id"
    )
    days = days.join(weather_day_rollup(weather), ["location_id", "stat_date"], "left")
    age_years = F.greatest(F.datediff("stat_date", "commissioned_at"), F.lit(0)) / F.lit(365.25)
    rainy = F.coalesce((F.col("daily_precipitation_mm") >= 5).cast("double"), F.lit(0.0))
    humid = F.coalesce((F.col("daily_avg_humidity_pct") >= 85).cast("double"), F.lit(0.0))
    use = _clip(F.col("total_sessions") / F.lit(7.0), (0.0, 1.0))
    # Base risk and weights.
    risk = 0.0025 + age_years * 0.0025 + rainy * 0.007 + humid * 0.004 + use * 0.006
    return days.select(
        "device_id", "stat_date", "total_sessions", _clip(risk, (0.002, 0.12)).alias("fault_probability")
    )


def current_device_state(devices: DataFrame, status: DataFrame) -> DataFrame:
    """Devices with ``current_status`` derived from their newest status row.

    Fault when that row counts a fault, offline below 0.95 availability, else
    online; a device without any row is online.
    """
    newest = status.groupBy("device_id").agg(
        F.max_by(
            F.struct("fault_count", "availability_rate"), F.struct("record_time", "status_id")
        ).alias("last")
    )
    state = (
        F.when(F.col("last.fault_count") > 0, "fault")
        .when(F.col("last.availability_rate") < 0.95, "offline")
        .otherwise("online")
    )
    kept = [name for name in devices.columns if name != "current_status"]
    return devices.select(*kept).join(newest, "device_id", "left").select(
        *kept, state.alias("current_status")
    )


def demand_rate_by_weather(orders: DataFrame, weather: DataFrame, stations: DataFrame) -> DataFrame:
    """Orders per 1000 station-hours by weather type.

    Stations are counted per location and orders per location and hour, so
    the station-hour grid itself is never built.
    """
    per_location = stations.groupBy("location_id").agg(F.count("*").alias("n_stations"))
    per_hour = (
        orders.groupBy("station_id", hour_floor(F.col("created_at")).alias("weather_time"))
        .agg(F.count("*").alias("n_orders"))
        .join(stations.select("station_id", "location_id"), "station_id")
        .groupBy("location_id", "weather_time")
        .agg(F.sum("n_orders").alias("n_orders"))
    )
    return (
        weather.select("location_id", "weather_time", "weather_type")
        .join(per_location, "location_id")
        .join(per_hour, ["location_id", "weather_time"], "left")
        .groupBy("weather_type")
        .agg(
            F.sum("n_stations").alias("station_hours"),
            F.coalesce(F.sum("n_orders"), F.lit(0)).alias("orders"),
        )
        .withColumn(
            "orders_per_1000_station_hours",
            F.bround(F.col("orders") / F.col("station_hours") * 1000, 3),
        )
        .orderBy(F.desc("orders_per_1000_station_hours"), "weather_type")
    )
