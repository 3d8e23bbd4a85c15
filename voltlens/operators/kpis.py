"""Warehouse metrics on the order fact table.

Sessions are distinct ``session_id`` values and calendars are zero-filled.
Results are ordered as presented; pass ``ordered=False`` when the result is
written or joined, which saves the range shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voltlens.functions import ratio, require_columns, zero_decimal
from voltlens.operators.quality import WEEKDAY_NAMES

FACT_NEEDS = (
    "session_id", "kwh_total", "charging_fees", "charge_time_hrs", "start_hour",
    "start_weekday", "weekday_name", "user_id", "station_id",
)


def _sessions() -> Column:
    return F.countDistinct("session_id").alias("charging_sessions")


def _total_kwh() -> Column:
    return F.round(F.sum("kwh_total"), 3).alias("total_kwh")


def _total_fees() -> Column:
    return F.round(F.sum("charging_fees"), 2).alias("total_charging_fees")


def _avg_kwh() -> Column:
    return F.round(F.avg("kwh_total"), 3).alias("avg_kwh_per_session")


def _avg_hours() -> Column:
    return F.round(F.avg("charge_time_hrs"), 4).alias("avg_charge_time_hrs")


def _need(df: DataFrame, *extra: str) -> DataFrame:
    require_columns(df, (*FACT_NEEDS, *extra), "order facts")
    return df


def _sorted(df: DataFrame, ordered: bool, *by) -> DataFrame:
    return df.orderBy(*by) if ordered else df


def overall_kpis(facts: DataFrame) -> DataFrame:
    """One row: sessions, energy, fees, mean hours, energy per session."""
    sums = _need(facts).agg(
        F.countDistinct("session_id").alias("total_charging_sessions"),
        _total_kwh(),
        _total_fees(),
        _avg_hours(),
    )
    per_session = F.round(ratio(F.col("total_kwh"), F.col("total_charging_sessions")), 3)
    return sums.withColumn("avg_kwh_per_session", per_session)


def station_kpis(facts: DataFrame, stations: DataFrame, ordered: bool = True) -> DataFrame:
    """One row per station, idle and unlisted ones included, with per-device ratios."""
    require_columns(stations, ("station_id", "station_name", "device_count"), "stations")
    usage = _need(facts).groupBy("station_id").agg(
        _sessions(), _total_kwh(), _total_fees(), _avg_hours()
    )
    board = stations.select("station_id", "station_name", "device_count").join(
        usage, "station_id", "full_outer"
    )
    board = board.withColumns({
        "charging_sessions": F.coalesce("charging_sessions", F.lit(0).cast("bigint")),
        "total_kwh": F.coalesce("total_kwh", zero_decimal(24, 3)),
        "total_charging_fees": F.coalesce("total_charging_fees", zero_decimal(24, 2)),
    })
    devices = F.when(F.col("device_count") > 0, F.col("device_count"))
    board = board.withColumns({
        "sessions_per_device": F.round(ratio(F.col("charging_sessions"), devices), 3),
        "kwh_per_device": F.round(ratio(F.col("total_kwh"), devices), 3),
        "charging_fees_per_device": F.round(ratio(F.col("total_charging_fees"), devices), 2),
    })
    return _sorted(board, ordered, F.desc("charging_sessions"), "station_id")


def user_kpis(facts: DataFrame, ordered: bool = True) -> DataFrame:
    per_user = _need(facts).groupBy("user_id").agg(
        _sessions(), _total_kwh(), _total_fees(), _avg_kwh(), _avg_hours()
    )
    return _sorted(per_user, ordered, F.desc("charging_sessions"), "user_id")


def user_summary(facts: DataFrame) -> DataFrame:
    """One row over the per-user totals."""
    per_user = _need(facts).groupBy("user_id").agg(
        _sessions(), F.sum("kwh_total").alias("kwh")
    )
    return per_user.agg(
        F.count("*").alias("total_users"),
        F.round(F.avg("charging_sessions"), 3).alias("avg_sessions_per_user"),
        F.round(F.avg("kwh"), 3).alias("avg_kwh_per_user"),
    )


def _numbers(df: DataFrame, count: int) -> DataFrame:
    """The literal calendar side of a zero fill; ``count`` rows in one partition."""
    return df.sparkSession.range(0, count, 1, 1)


def weekday_patterns(facts: DataFrame, ordered: bool = True) -> DataFrame:
    """Seven rows, Monday first, zero where a weekday has no orders."""
    usage = _need(facts).groupBy("start_weekday").agg(_sessions(), _total_kwh(), _avg_kwh())
    names = F.array(*map(F.lit, WEEKDAY_NAMES))
    week = _numbers(facts, 7).select(
        F.col("id").cast("int").alias("start_weekday"),
        F.get(names, F.col("id").cast("int")).alias("weekday_name"),
    )
    filled = week.join(usage, "start_weekday", "left").select(
        "start_weekday",
        "weekday_name",
        F.coalesce("charging_sessions", F.lit(0).cast("bigint")).alias("charging_sessions"),
        F.coalesce("total_kwh", zero_decimal(20, 3)).alias("total_kwh"),
        F.coalesce("avg_kwh_per_session", zero_decimal(20, 3)).alias("avg_kwh_per_session"),
    )
    return _sorted(filled, ordered, "start_weekday")


def holiday_patterns(facts: DataFrame, ordered: bool = True) -> DataFrame:
    """Usage by day type; holiday wins over workday, the rest are rest days."""
    _need(facts, "is_holiday", "holiday_name", "is_workday", "is_weekend")
    day_type = (
        F.when(F.col("is_holiday") == 1, "holiday")
        .when(F.col("is_workday") == 1, "workday")
        .otherwise("non_holiday_rest_day")
    )
    grouped = facts.groupBy(
        day_type.alias("day_type"), "is_holiday", "holiday_name", "is_workday", "is_weekend"
    ).agg(_sessions(), _total_kwh(), _total_fees(), _avg_kwh(), _avg_hours())
    rank = F.array_position(
        F.array(F.lit("holiday"), F.lit("workday"), F.lit("non_holiday_rest_day")), F.col("day_type")
    )
    return _sorted(grouped, ordered, rank, "holiday_name", "is_weekend")


def hourly_distribution(facts: DataFrame, ordered: bool = True) -> DataFrame:
    """Sessions of each of the 24 start hours."""
    usage = _need(facts).groupBy(F.col("start_hour").alias("hour")).agg(_sessions())
    day = _numbers(facts, 24).select(F.col("id").cast("int").alias("hour"))
    filled = day.join(usage, "hour", "left").na.fill(0, ["charging_sessions"])
    return _sorted(filled, ordered, "hour")


def weekday_hour_heatmap(facts: DataFrame, ordered: bool = True) -> DataFrame:
    """168 rows (hour, weekday, sessions) and the same triple as an array.

    The grid is one number range split by division, not a product of two sets.
    """
    usage = _need(facts).groupBy(
        F.col("start_hour").alias("hour"), F.col("start_weekday").alias("weekday")
    ).agg(_sessions())
    grid = _numbers(facts, 168).select(
        F.expr("cast(id div 7 as int)").alias("hour"), F.expr("cast(id % 7 as int)").alias("weekday")
    )
    filled = grid.join(usage, ["hour", "weekday"], "left").na.fill(0, ["charging_sessions"])
    cells = filled.withColumn(
        "echarts_value",
        F.array(*[F.col(c).cast("bigint") for c in ("hour", "weekday", "charging_sessions")]),
    )
    return _sorted(cells, ordered, "hour", "weekday")


def session_trend(facts: DataFrame, ordered: bool = True) -> DataFrame:
    """Sessions per date; dates without orders are absent."""
    return _sorted(_need(facts, "start_date").groupBy("start_date").agg(_sessions()), ordered, "start_date")


RANKING_METRICS = ("charging_sessions", "total_kwh", "total_charging_fees")


def rank_stations(
    facts: DataFrame, stations: DataFrame, by: str = "charging_sessions", top_n: int = 10
) -> DataFrame:
    """The ``top_n`` stations by one of the ranking metrics, ties by station id."""
    if by not in RANKING_METRICS:
        raise ValueError(f"cannot rank by {by!r}; choose one of {', '.join(sorted(RANKING_METRICS))}")
    return station_kpis(facts, stations, ordered=False).orderBy(F.desc(by), "station_id").limit(top_n)


# Columns of the station map.
DISTRIBUTION_COLUMNS = (
    "station_id", "station_name", "address", "location_id", "facility_type", "device_count",
    "latitude", "longitude",
)


def station_distribution(stations: DataFrame, ordered: bool = True) -> DataFrame:
    require_columns(stations, DISTRIBUTION_COLUMNS, "stations")
    return _sorted(stations.select(*DISTRIBUTION_COLUMNS), ordered, F.desc("device_count"), "station_id")


def filtered_hourly(
    facts: DataFrame, date: str | None = None, weekday: int | None = None, station_id=None
) -> DataFrame:
    """``hourly_distribution`` of the orders that match every given filter."""
    _need(facts)
    wanted = {
        "start_date": None if date is None else F.lit(date).cast("date"),
        "start_weekday": None if weekday is None else F.lit(weekday),
        "station_id": None if station_id is None else F.lit(station_id),
    }
    for name, value in wanted.items():
        if value is not None:
            facts = facts.where(F.col(name) == value)
    return hourly_distribution(facts)


def device_kpis(facts: DataFrame, devices: DataFrame, ordered: bool = True) -> DataFrame:
    """Use of each device; observation days span all orders of all devices.

    Days are counted through a set of dates, which the calendar bounds, so
    that ``session_id`` stays the only distinct column and no row is expanded.
    """
    require_columns(facts, ("session_id", "device_id", "kwh_total", "charge_time_hrs", "start_date"), "order facts")
    shown = (
        "device_id", "station_id", "device_code", "charger_type", "rated_power_kw",
        "connector_count", "manufacturer", "current_status",
    )
    require_columns(devices, shown, "devices")
    observed = facts.agg(
        F.greatest(F.datediff(F.max("start_date"), F.min("start_date")) + 1, F.lit(1)).alias("days")
    ).scalar()
    power = ratio(F.col("kwh_total").cast("double"), F.col("charge_time_hrs"))
    usage = facts.groupBy("device_id").agg(
        _sessions(),
        F.size(F.collect_set("start_date")).cast("bigint").alias("charging_days"),
        _total_kwh(),
        F.round(F.sum("charge_time_hrs"), 3).alias("total_charging_hours"),
        _avg_kwh(),
        F.round(F.avg(power), 3).alias("avg_output_power_kw"),
    )
    board = devices.select(*shown).join(usage, "device_id", "left").withColumn("observation_days", observed)
    hours = F.coalesce("total_charging_hours", F.lit(0.0))
    board = board.select(
        *shown,
        F.coalesce("charging_sessions", F.lit(0).cast("bigint")).alias("charging_sessions"),
        F.coalesce("charging_days", F.lit(0).cast("bigint")).alias("charging_days"),
        F.coalesce("total_kwh", zero_decimal(24, 3)).alias("total_kwh"),
        hours.alias("total_charging_hours"),
        "avg_kwh_per_session",
        "avg_output_power_kw",
        F.round(ratio(hours, F.col("observation_days") * F.lit(24.0)), 6).alias(
            "charging_time_utilization_rate"
        ),
        "observation_days",
    )
    return _sorted(board, ordered, F.desc("charging_sessions"), "device_id")


def device_operation_kpis(status: DataFrame, devices: DataFrame, ordered: bool = True) -> DataFrame:
    """Availability, faults and health of each device over its status rows."""
    counters = (
        "online_minutes", "offline_minutes", "fault_minutes", "fault_count",
        "successful_sessions", "failed_sessions",
    )
    require_columns(
        status,
        (*counters, "device_id", "station_id", "record_time", "avg_output_power_kw",
         "availability_rate", "health_score", "maintenance_flag"),
        "device status",
    )
    shown = ("device_code", "charger_type", "rated_power_kw", "current_status")
    require_columns(devices, ("device_id", *shown), "devices")
    tried = F.col("successful_sessions") + F.col("failed_sessions")
    sums = status.groupBy("device_id", "station_id").agg(
        F.countDistinct(F.to_date("record_time")).alias("observed_days"),
        *[F.sum(name).alias(name) for name in counters],
        F.sum("maintenance_flag").alias("maintenance_days"),
        F.sum(F.col("avg_output_power_kw") * tried).alias("_power"),
        F.round(F.avg("health_score"), 3).alias("avg_health_score"),
        F.round(F.min("health_score"), 3).alias("min_health_score"),
    )
    sessions = F.col("successful_sessions") + F.col("failed_sessions")
    minutes = F.col("online_minutes") + F.col("offline_minutes")
    rated = sums.withColumns({
        "availability_rate": F.round(ratio(F.col("online_minutes"), minutes), 6),
        "avg_output_power_kw": F.round(ratio(F.col("_power"), F.when(sessions > 0, sessions)), 3),
    })
    board = devices.select("device_id", *shown).join(rated, "device_id", "left").select(
        "device_id", "station_id", *shown, "observed_days", *counters, "maintenance_days",
        "availability_rate", "avg_output_power_kw", "avg_health_score", "min_health_score",
    )
    return _sorted(board, ordered, F.asc_nulls_first("availability_rate"), "device_id")


def weather_impact(
    facts: DataFrame, weather: DataFrame, stations: DataFrame, ordered: bool = True
) -> DataFrame:
    """Usage by weather kind against its exposure in station-hours.

    Exposure weighs each weather hour with the number of stations at its
    location, so the station-hour product is never materialised.
    """
    require_columns(
        facts, ("session_id", "weather_id", "kwh_total", "charging_fees", "charge_time_hrs"), "order facts"
    )
    kind = ("weather_type", "weather_name", "is_rain")
    measures = ("temperature_c", "humidity_pct", "precipitation_mm", "wind_speed_mps", "visibility_km")
    require_columns(weather, ("weather_id", "location_id", *kind, *measures), "weather")
    require_columns(stations, ("station_id", "location_id"), "stations")

    here = stations.groupBy("location_id").agg(F.count("*").alias("_stations"))

    def weighted_mean(name: str) -> Column:
        known = F.when(F.col(name).isNotNull(), F.col("_stations"))
        return F.round(ratio(F.sum(F.col(name) * F.col("_stations")), F.sum(known)), 3).alias(f"avg_{name}")

    exposure = weather.join(here, "location_id").groupBy(*kind).agg(
        F.sum("_stations").alias("station_hours"), *[weighted_mean(name) for name in measures]
    )
    usage = facts.join(weather.select("weather_id", *kind), "weather_id").groupBy(*kind).agg(
        _sessions(), _total_kwh(), _total_fees(), _avg_kwh(), _avg_hours()
    )
    sessions = F.coalesce("charging_sessions", F.lit(0).cast("bigint"))
    result = exposure.join(usage, list(kind), "left").select(
        *kind,
        "station_hours",
        sessions.alias("charging_sessions"),
        F.round(sessions * F.lit(1000.0) / F.col("station_hours"), 3).alias(
            "sessions_per_1000_station_hours"
        ),
        F.coalesce("total_kwh", zero_decimal(24, 3)).alias("total_kwh"),
        F.coalesce("total_charging_fees", zero_decimal(24, 2)).alias("total_charging_fees"),
        "avg_kwh_per_session",
        "avg_charge_time_hrs",
        *[f"avg_{name}" for name in measures],
    )
    return _sorted(result, ordered, F.desc("sessions_per_1000_station_hours"), "weather_type")
