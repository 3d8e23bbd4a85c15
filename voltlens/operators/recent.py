"""Dashboard metrics over the last N days.

These count rows, slide back from the newest order and fill gaps only where
stated; they differ on purpose from the warehouse metrics in ``kpis``.
Orders come under their public names (energy_kwh, fee_amount_cny).
Money and energy are decimals, so sums do not depend on row order; means are
rounded half to even.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voltlens.functions import monday_index
from voltlens.operators.quality import WEEKDAY_NAMES
from voltlens.plans.snapshot import section_rows

MONTH_DAYS = 30  # fixed value: "this month" on the dashboard


def last_days(df: DataFrame, days: int | None, at: str = "created_at") -> DataFrame:
    """Rows within ``days`` days before the newest row, to the instant; 0 or None keeps all."""
    if not days or days < 0:
        return df
    newest = df.agg(F.max(at).alias("newest")).scalar()
    return df.where(F.col(at) >= newest - F.make_dt_interval(F.lit(days)))


def _with_newest(orders: DataFrame) -> DataFrame:
    """Orders beside the newest order time, a scalar subquery over one column."""
    return orders.withColumn("_newest", orders.agg(F.max("created_at").alias("newest")).scalar())


def _revenue_columns() -> list[Column]:
    """Fees of the newest day, of the last 30 days and of all time."""
    newest = F.col("_newest")
    windows = {
        "revenue_today": F.to_date("created_at") == F.to_date(newest),
        "revenue_30d": F.col("created_at") >= newest - F.make_dt_interval(F.lit(MONTH_DAYS)),
        "revenue_total": F.lit(True),
    }
    zero = F.lit(0).cast("decimal(14,2)")
    return [
        F.coalesce(F.sum(F.when(keep, F.col("fee_amount_cny"))), zero).alias(name)
        for name, keep in windows.items()
    ]


def revenue_totals(orders: DataFrame) -> DataFrame:
    """One row: fees of the newest day, of the last 30 days and of all time."""
    return _with_newest(orders).agg(*_revenue_columns())


def _by_day(orders: DataFrame, days: int | None, value: Column, name: str) -> DataFrame:
    recent = last_days(orders, days)
    return recent.groupBy(F.to_date("created_at").alias("date")).agg(value.alias(name)).orderBy("date")


def volume_trend(orders: DataFrame, days: int | None = 7) -> DataFrame:
    return _by_day(orders, days, F.sum("energy_kwh"), "energy_kwh")


def revenue_trend(orders: DataFrame, days: int | None = 7) -> DataFrame:
    return _by_day(orders, days, F.sum("fee_amount_cny"), "revenue")


def count_trend(orders: DataFrame, days: int | None = 7) -> DataFrame:
    return _by_day(orders, days, F.count("*"), "count")


def hourly_energy(orders: DataFrame, days: int | None = None) -> DataFrame:
    """Energy and rows of each of the 24 hours."""
    recent = last_days(orders, days)
    usage = recent.groupBy(F.hour("created_at").alias("hour")).agg(
        F.sum("energy_kwh").alias("energy_kwh"), F.count("energy_kwh").alias("sessions")
    )
    hours = orders.sparkSession.range(0, 24, 1, 1).select(F.col("id").cast("int").alias("hour"))
    return (
        hours.join(usage, "hour", "left")
        .select(
            "hour",
            F.coalesce("energy_kwh", F.lit(0).cast("decimal(24,3)")).alias("energy_kwh"),
            F.coalesce("sessions", F.lit(0).cast("bigint")).alias("sessions"),
        )
        .orderBy("hour")
    )


def heatmap_counts(orders: DataFrame, days: int | None = None) -> DataFrame:
    """168 rows, weekday-major."""
    recent = last_days(orders, days)
    usage = recent.groupBy(
        monday_index(F.col("created_at")).alias("weekday"), F.hour("created_at").alias("hour")
    ).agg(F.count("session_id").alias("count"))
    grid = orders.sparkSession.range(0, 168, 1, 1).select(
        F.expr("cast(id div 24 as int)").alias("weekday"), F.expr("cast(id % 24 as int)").alias("hour")
    )
    return grid.join(usage, ["weekday", "hour"], "left").na.fill(0, ["count"]).orderBy("weekday", "hour")


def user_metrics(orders: DataFrame, days: int | None = None) -> DataFrame:
    """One row: active users and their mean energy and row count; zeros without orders."""
    per_user = last_days(orders, days).groupBy("user_id").agg(
        F.sum("energy_kwh").alias("energy"), F.count("*").alias("n")
    )
    return per_user.where(F.col("user_id").isNotNull()).agg(
        F.count("*").alias("active_users"),
        F.coalesce(F.bround(F.avg("energy"), 3), F.lit(0).cast("decimal(24,3)")).alias(
            "avg_energy_per_user_kwh"
        ),
        F.coalesce(F.bround(F.avg("n"), 3), F.lit(0.0)).alias("avg_sessions_per_user"),
    )


def weekday_energy(orders: DataFrame, days: int | None = None) -> DataFrame:
    """Energy of the weekdays that occur, Monday first."""
    names = F.array(*map(F.lit, WEEKDAY_NAMES))
    usage = last_days(orders, days).groupBy(monday_index(F.col("created_at")).alias("day")).agg(
        F.sum("energy_kwh").alias("energy_kwh")
    )
    return usage.orderBy("day").select(F.get(names, F.col("day")).alias("weekday"), "energy_kwh")


def weather_sessions(orders: DataFrame, weather: DataFrame, days: int | None = None) -> DataFrame:
    """Rows, energy, fees and mean weather of the orders by weather type and name.

    Orders are first reduced per weather hour, so the join moves one row per
    hour and location instead of every order.
    """
    per_hour = last_days(orders, days).groupBy("weather_id").agg(
        F.count("session_id").alias("sessions"),
        F.count("*").alias("rows"),
        F.sum("energy_kwh").alias("energy_kwh"),
        F.sum("fee_amount_cny").alias("fee_cny"),
    )
    facts = weather.select("weather_id", "weather_type", "weather_name", "temperature_c", "precipitation_mm")

    def mean(name: str) -> Column:
        weight = F.when(F.col(name).isNotNull(), F.col("rows"))
        return F.bround(F.try_divide(F.sum(F.col(name) * F.col("rows")), F.sum(weight)), 3)

    return (
        per_hour.join(facts, "weather_id")
        .groupBy("weather_type", "weather_name")
        .agg(
            F.sum("sessions").alias("sessions"),
            F.sum("energy_kwh").alias("energy_kwh"),
            F.sum("fee_cny").alias("fee_cny"),
            mean("temperature_c").alias("avg_temp_c"),
            mean("precipitation_mm").alias("avg_precip_mm"),
        )
        .orderBy(F.desc("sessions"), "weather_type")
    )


def overview(orders: DataFrame) -> DataFrame:
    """One row of totals; no row when there are no orders.

    One pass besides the newest time: both distinct columns have few values
    against the rows, so their partial aggregates collapse before the shuffle.
    """
    seconds = F.timestamp_diff("SECOND", F.min("created_at"), F.max("created_at"))
    totals = _with_newest(orders).agg(
        F.count("*").alias("total_sessions"),
        F.sum("energy_kwh").alias("total_energy_kwh"),
        *_revenue_columns(),
        F.countDistinct("station_id").alias("active_stations"),
        F.countDistinct("user_id").alias("active_users"),
        F.bround(F.avg("charge_time_hrs"), 3).alias("avg_duration_hrs"),
        F.bround(F.avg("fee_amount_cny"), 3).alias("avg_order_fee_cny"),
        (F.floor(seconds / F.lit(86400)) + 1).cast("int").alias("span_days"),
    )
    return totals.where(F.col("total_sessions") > 0)


def station_online(stations: DataFrame, devices: DataFrame) -> DataFrame:
    """Share of devices online per station in percent, and the free piles it implies."""
    shares = devices.groupBy("station_id").agg(
        (F.avg((F.col("current_status") == "online").cast("double")) * 100).alias("_rate")
    )
    rate, count = F.coalesce("_rate", F.lit(0.0)), F.coalesce("device_count", F.lit(0))
    return stations.join(shares, "station_id", "left").select(
        "station_id",
        F.col("station_name").alias("name"),
        count.alias("pile_count"),
        F.bround(count * rate / F.lit(100.0), 0).cast("int").alias("free_pile_count"),
        F.bround(rate, 1).alias("online_rate"),
    )


def station_ranking(
    orders: DataFrame, stations: DataFrame, days: int | None = None, limit: int = 10
) -> DataFrame:
    """Top stations by energy; the name falls back to the id."""
    names = stations.select("station_id", "station_name")
    top = (
        last_days(orders, days)
        .groupBy("station_id")
        .agg(
            F.sum("energy_kwh").alias("energy_kwh"),
            F.count("energy_kwh").alias("sessions"),
            F.sum("fee_amount_cny").alias("revenue_cny"),
        )
        .orderBy(F.desc("energy_kwh"), "station_id")
        .limit(limit)
    )
    return top.join(names, "station_id", "left").select(
        "station_id",
        F.coalesce("station_name", F.col("station_id").cast("string")).alias("station_name"),
        "energy_kwh", "sessions", "revenue_cny",
    ).orderBy(F.desc("energy_kwh"), "station_id")


def station_board(stations: DataFrame, devices: DataFrame) -> DataFrame:
    """Station attributes beside the online snapshot, nulls as '' or 0."""
    online = station_online(stations, devices)
    texts = {name: F.coalesce(name, F.lit("")) for name in ("address", "city", "station_status")}
    board = stations.withColumns({**texts, "device_count": F.coalesce("device_count", F.lit(0))})
    return board.select(
        "station_id", "station_name", "address", "city", "latitude", "longitude",
        "device_count", "station_status",
    ).join(online, "station_id")


def device_status_by_station(status: DataFrame, days: int | None = 7) -> DataFrame:
    """Mean availability and health, faults and sessions of the recent status rows."""
    return last_days(status, days, at="record_time").groupBy("station_id").agg(
        F.bround(F.avg("availability_rate"), 4).alias("avg_availability"),
        F.sum("fault_count").alias("total_faults"),
        F.sum("successful_sessions").alias("successful_sessions"),
        F.sum("failed_sessions").alias("failed_sessions"),
        F.bround(F.avg("health_score"), 4).alias("avg_health"),
    )


# Accepted weekday texts.
_DAY_TEXTS = {
    text: number
    for number, texts in enumerate(
        (("mon", "monday"), ("tue", "tuesday"), ("wed", "wednesday"), ("thu", "thursday"),
         ("fri", "friday"), ("sat", "saturday"), ("sun", "sunday"))
    )
    for text in texts
}


def filter_orders(
    orders: DataFrame,
    date: str | None = None,
    weekday: int | str | None = None,
    station_id=None,
    device_id=None,
    is_holiday: int | None = None,
    weather_type: str | None = None,
    weather: DataFrame | None = None,
) -> DataFrame:
    """Orders matching every given filter; weekday is a number or an English day name."""
    kept = orders
    if station_id is not None:
        kept = kept.where(F.col("station_id") == F.lit(station_id))
    if device_id is not None:
        kept = kept.where(F.col("device_id") == F.lit(device_id))
    if date is not None:
        kept = kept.where(F.to_date("created_at") == F.lit(date).cast("date"))
    if weekday is not None and str(weekday).strip() != "":
        text = str(weekday).strip().lower()
        number = int(text) if text.lstrip("-").isdigit() else _DAY_TEXTS.get(text, -1)
        kept = kept.where(monday_index(F.col("created_at")) == number)
    if is_holiday is not None:
        kept = kept.where(F.col("is_holiday") == is_holiday)
    if weather_type is not None:
        if weather is None:
            raise ValueError("filtering by weather_type needs the weather table")
        hours = weather.where(F.col("weather_type") == weather_type).select("weather_id")
        kept = kept.join(hours, "weather_id", "left_semi")
    return kept


def filtered_totals(orders: DataFrame, **filters) -> DataFrame:
    return filter_orders(orders, **filters).agg(
        F.coalesce(F.sum("energy_kwh"), F.lit(0).cast("decimal(24,3)")).alias("total_energy_kwh"),
        F.count("*").alias("total_sessions"),
        F.coalesce(F.sum("fee_amount_cny"), F.lit(0).cast("decimal(24,2)")).alias("total_revenue"),
    )


def filtered_daily(orders: DataFrame, **filters) -> DataFrame:
    """Daily points of the filtered orders, zero-filled between first and last day."""
    daily = filter_orders(orders, **filters).groupBy(F.to_date("created_at").alias("date")).agg(
        F.sum("energy_kwh").alias("energy_kwh"),
        F.count("session_id").alias("sessions"),
        F.sum("fee_amount_cny").alias("revenue"),
    )
    days = daily.agg(F.min("date").alias("first"), F.max("date").alias("last")).where(
        "first is not null"
    ).select(F.explode(F.sequence("first", "last", F.expr("interval 1 day"))).alias("date"))
    return days.join(daily, "date", "left").select(
        "date",
        F.coalesce("energy_kwh", F.lit(0).cast("decimal(24,3)")).alias("energy_kwh"),
        F.coalesce("sessions", F.lit(0).cast("bigint")).alias("sessions"),
        F.coalesce("revenue", F.lit(0).cast("decimal(24,2)")).alias("revenue"),
    ).orderBy("date")


# Dashboard labels of device states.
STATUS_LABELS = {"online": "在用", "idle": "闲置", "fault": "故障"}


def device_status_counts(devices: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """Device count of each labelled state, zero-filled; other states are left out."""
    labels = labels or STATUS_LABELS
    counts = devices.groupBy("current_status").agg(F.count("*").alias("n"))
    pairs = F.array(*[F.struct(F.lit(k).alias("state"), F.lit(v).alias("label")) for k, v in labels.items()])
    wanted = devices.sparkSession.range(0, 1, 1, 1).select(F.inline(pairs))
    return wanted.join(counts, F.col("state") == F.col("current_status"), "left").select(
        "label", F.coalesce("n", F.lit(0).cast("bigint")).alias("count")
    )


def ops_bundle(orders: DataFrame, stations: DataFrame, devices: DataFrame, days: int | None = 7) -> DataFrame:
    """Everything one dashboard page shows, as (section, payload) rows of JSON.

    One row per point or station: the station list grows with the data and is
    therefore not folded into a single document.
    """
    sections = {
        "revenue": revenue_totals(orders),
        "revenue_trend": _by_day(orders, days, F.sum("fee_amount_cny"), "revenue"),
        "pile_status": device_status_counts(devices),
        "stations": station_online(stations, devices),
    }
    return section_rows(sections)
