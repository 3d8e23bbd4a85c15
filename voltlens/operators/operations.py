"""Reports on the operational tables: users, stations, piles, orders and logs.

Orders carry id, user_id, pile_id, start_time, end_time, amount, fee, status;
piles id, station_id, code, type, power, status; stations id, name, address,
longitude, latitude, price, pile_count; users id, phone, nickname,
avatar_path, balance, status, created_at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voltlens.functions import elapsed_seconds, great_circle_km
from voltlens.operators.calendar import day_sequence

# States stored in the operational tables.
SETTLED = "已结算"
PENDING = "待结算"
CHARGING = "充电中"
IDLE = "闲置"
IN_USE = "在用"
FAULT = "故障"


def _settled(orders: DataFrame) -> DataFrame:
    return orders.where(F.col("status") == SETTLED)


def _as_day(as_of) -> Column:
    """A date literal from text or date, or the given column."""
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("date")


def revenue_to_date(orders: DataFrame, as_of) -> DataFrame:
    """One row: settled fees of the day, of its calendar month and of all time."""
    today, ended = _as_day(as_of), F.to_date("end_time")

    def fees(keep: Column) -> Column:
        return F.coalesce(F.sum(F.when(keep, F.col("fee"))), F.lit(0))

    dated = _settled(orders).select("fee", "end_time", today.alias("_today"))
    month = F.trunc(ended, "month") == F.trunc("_today", "month")
    return dated.agg(
        fees(ended == F.col("_today")).alias("revenue_today"),
        fees(month).alias("revenue_this_month"),
        fees(F.lit(True)).alias("revenue_total"),
    )


def settled_revenue_trend(orders: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Settled fees of the last ``days`` calendar days including ``as_of``, zero-filled."""
    days = max(1, days)
    last = orders.sparkSession.range(0, 1, 1, 1).select(_as_day(as_of).alias("last"))
    span = last.select(F.date_sub("last", days - 1).alias("first"), "last")
    daily = _settled(orders).groupBy(F.to_date("end_time").alias("date")).agg(F.sum("fee").alias("revenue"))
    return (
        day_sequence(span, "first", "last", "date")
        .join(daily, "date", "left")
        .select("date", F.coalesce("revenue", F.lit(0)).alias("revenue"))
        .orderBy("date")
    )


def pile_state_counts(piles: DataFrame) -> DataFrame:
    return piles.groupBy("status").agg(F.count("*").alias("count"))


def _pile_summary(piles: DataFrame) -> DataFrame:
    return piles.groupBy(F.col("station_id").alias("id")).agg(
        F.count("*").alias("pile_rows"),
        F.count_if(F.col("status") == IDLE).alias("free"),
        F.count_if(F.col("status") != FAULT).alias("working"),
    )


def free_piles(stations: DataFrame, piles: DataFrame) -> DataFrame:
    """Idle piles of every station from one grouped join."""
    return stations.join(_pile_summary(piles), "id", "left").select(
        "id", F.coalesce("free", F.lit(0).cast("bigint")).alias("free_pile_count")
    )


def working_rate(stations: DataFrame, piles: DataFrame) -> DataFrame:
    """Share of piles not in fault in percent; 0 for a station without piles."""
    return stations.join(_pile_summary(piles), "id", "left").select(
        "id", F.coalesce(F.col("working") * F.lit(100.0) / F.col("pile_rows"), F.lit(0.0)).alias("online_rate")
    )


def free_share_board(stations: DataFrame, piles: DataFrame) -> DataFrame:
    """Station board whose rate is idle piles over the stored pile count, in percent."""
    free = F.coalesce("free", F.lit(0).cast("bigint"))
    rate = F.coalesce(F.try_divide(free.cast("double"), F.col("pile_count")) * 100, F.lit(0.0))
    return stations.join(_pile_summary(piles), "id", "left").select(
        F.col("id").alias("station_id"), "name", "pile_count",
        free.alias("free_pile_count"), rate.alias("online_rate"),
    )


ORDER_COLUMNS = ("id", "user_id", "pile_id", "start_time", "end_time", "amount", "fee", "status")


def user_orders(orders: DataFrame, user_id) -> DataFrame:
    """Orders of one user, newest first."""
    return orders.where(F.col("user_id") == F.lit(user_id)).select(*ORDER_COLUMNS).orderBy(F.desc("id"))


def pile_list(piles: DataFrame, stations: DataFrame, station_id=None) -> DataFrame:
    """Piles with their station name in id order, of one station or of all."""
    if station_id is not None:
        piles = piles.where(F.col("station_id") == F.lit(station_id))
    names = stations.select(F.col("id").alias("station_id"), F.col("name").alias("station_name"))
    return piles.join(names, "station_id").select(
        "id", "station_id", "station_name", *[c for c in piles.columns if c not in ("id", "station_id")]
    ).orderBy("id")


def pile_lifetime(orders: DataFrame, piles: DataFrame) -> DataFrame:
    """Finished sessions and their whole minutes per pile, recomputed from the orders."""
    minutes = F.greatest(
        F.floor(elapsed_seconds(F.col("start_time"), F.col("end_time")) / F.lit(60)), F.lit(0)
    )
    finished = orders.where(F.col("status").isin(SETTLED, PENDING))
    totals = finished.groupBy(F.col("pile_id").alias("id")).agg(
        F.count("*").alias("total_sessions"), F.sum(minutes).cast("bigint").alias("total_duration")
    )
    return piles.select("id").join(totals, "id", "left").na.fill(0, ["total_sessions", "total_duration"])


def pile_count_by_station(stations: DataFrame, piles: DataFrame) -> DataFrame:
    """Stations with ``pile_count`` recomputed from the pile rows."""
    return stations.drop("pile_count").join(_pile_summary(piles), "id", "left").select(
        *[c for c in stations.columns if c != "pile_count"],
        F.coalesce("pile_rows", F.lit(0).cast("bigint")).alias("pile_count"),
    )


def find_by_key(df: DataFrame, key: str, value) -> DataFrame:
    """The row with the given key; the comparison reaches the scan."""
    return df.where(F.col(key) == F.lit(value))


def pile_by_id(piles: DataFrame, stations: DataFrame, pile_id) -> DataFrame:
    return pile_list(find_by_key(piles, "id", pile_id), stations)


def in_id_order(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*(columns or df.columns)).orderBy("id")


USER_COLUMNS = ("id", "phone", "nickname", "avatar_path", "balance", "status", "created_at")


def search_users(users: DataFrame, phone: str = "") -> DataFrame:
    """Users whose phone contains the fragment, in id order; no fragment lists all."""
    if phone:
        users = users.where(F.col("phone").contains(phone))
    return in_id_order(users, *USER_COLUMNS)


def search_stations(stations: DataFrame, keyword: str = "") -> DataFrame:
    """Stations whose name or address contains the keyword, whatever its case."""
    word = keyword.strip().lower()
    if word:
        stations = stations.where(
            F.lower("name").contains(word) | F.lower(F.coalesce("address", F.lit(""))).contains(word)
        )
    return in_id_order(stations)


def search_orders(
    orders: DataFrame,
    users: DataFrame,
    piles: DataFrame,
    stations: DataFrame,
    phone: str = "",
    station_id=None,
    from_date: str | None = None,
    to_date: str | None = None,
    status: str = "",
) -> DataFrame:
    """Orders with user phone and station, filtered by any of the arguments, newest id first.

    Filters apply to the single tables, before the joins.
    """
    moment = F.to_date(F.coalesce("end_time", "start_time"))
    if from_date:
        orders = orders.where(moment >= F.lit(from_date).cast("date"))
    if to_date:
        orders = orders.where(moment <= F.lit(to_date).cast("date"))
    if status.strip():
        orders = orders.where(F.col("status") == status.strip())
    if phone.strip():
        users = users.where(F.col("phone").contains(phone.strip()))
    if station_id is not None:
        piles = piles.where(F.col("station_id") == F.lit(station_id))
    return (
        orders.select(*ORDER_COLUMNS)
        .join(users.select(F.col("id").alias("user_id"), F.col("phone").alias("user_phone")), "user_id")
        .join(piles.select(F.col("id").alias("pile_id"), "station_id"), "pile_id")
        .join(stations.select(F.col("id").alias("station_id"), F.col("name").alias("station_name")), "station_id")
        .select(
            "id", "user_id", "user_phone", "pile_id", "station_id", "station_name",
            "start_time", "end_time", "amount", "fee", "status",
        )
        .orderBy(F.desc("id"))
    )


def login_history(logins: DataFrame, phone: str = "", limit: int = 50) -> DataFrame:
    """Newest logins, of one phone or of all."""
    if phone:
        logins = logins.where(F.col("phone") == phone)
    return logins.select("id", "phone", "login_time", "ip_address").orderBy(
        F.desc("login_time"), F.desc("id")
    ).limit(limit)


def operation_history(
    operations: DataFrame, target_table: str = "", operator_id: int | None = None, limit: int = 50
) -> DataFrame:
    """Newest operations by target table and operator."""
    if target_table:
        operations = operations.where(F.col("target_table") == target_table)
    if operator_id is not None and operator_id >= 0:
        operations = operations.where(F.col("operator_id") == operator_id)
    return operations.select(
        "id", "operator_id", "operator_type", "operation_type", "target_table", "target_id",
        "content", "operation_time",
    ).orderBy(F.desc("operation_time"), F.desc("id")).limit(limit)


def open_orders(orders: DataFrame) -> DataFrame:
    """The first order of each user that is still charging or unsettled."""
    return orders.where(F.col("status").isin(CHARGING, PENDING)).groupBy("user_id").agg(
        F.min("id").alias("order_id")
    )


def open_session_estimate(orders: DataFrame, piles: DataFrame, stations: DataFrame, as_of) -> DataFrame:
    """Elapsed time, energy and fee of every charging order at ``as_of``."""
    moment = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp_ntz")
    running = orders.where(F.col("status") == CHARGING).select(
        F.col("id").alias("order_id"), "pile_id", "start_time", moment.alias("_now")
    )
    power = piles.select(F.col("id").alias("pile_id"), "station_id", F.col("power").cast("double").alias("power"))
    price = stations.select(F.col("id").alias("station_id"), F.col("price").cast("double").alias("price"))
    elapsed = F.coalesce(
        F.greatest(elapsed_seconds(F.col("start_time"), F.col("_now")), F.lit(0)), F.lit(0)
    )
    energy = F.col("power") * F.col("elapsed_seconds") / F.lit(3600.0)
    return (
        running.join(power, "pile_id").join(price, "station_id")
        .withColumn("elapsed_seconds", elapsed)
        .select(
            "order_id", "pile_id", "station_id", "elapsed_seconds",
            F.floor(F.col("elapsed_seconds") / F.lit(60)).alias("duration_minutes"),
            energy.alias("estimated_kwh"),
            (energy * F.col("price")).alias("estimated_fee"),
        )
    )


# Texts and limits of the route plausibility rules.
ROUTE_SLACK_KM = 0.5
FASTEST_KMH = 300.0


def route_plausibility(routes: DataFrame) -> DataFrame:
    """Routes with ``reason``: why a route cannot be right, or '' when it can.

    Needs distance_meters, duration_seconds, polyline and the four end-point
    coordinates.  The first failing rule names the reason.
    """
    km = F.col("distance_meters") / F.lit(1000.0)
    straight = great_circle_km(
        F.col("origin_lat"), F.col("origin_lng"), F.col("dest_lat"), F.col("dest_lng")
    )
    speed = F.try_divide(km, F.col("duration_seconds") / F.lit(3600.0))
    reason = (
        F.when(F.coalesce(F.col("distance_meters"), F.lit(0)) <= 0, "路线距离无效")
        .when(F.coalesce(F.col("duration_seconds"), F.lit(0)) <= 0, "路线时长无效（不能为负或零）")
        .when(F.coalesce(F.length("polyline"), F.lit(0)) == 0, "路线缺少折线数据")
        .when(km + ROUTE_SLACK_KM < straight, "路线距离与起终点严重不符")
        .when(speed > FASTEST_KMH, "路线时长与距离矛盾（速度不现实）")
        .when((F.col("duration_seconds") < 60) & (km > 1.0), "路线时长与距离矛盾（例如7公里不可能在1分钟内到达）")
        .otherwise("")
    )
    return routes.withColumn("reason", reason)


def nearest_stations(stations: DataFrame, latitude: float, longitude: float, limit: int = 5) -> DataFrame:
    """The closest stations to one point: a projection and a top-k, no join."""
    if not (-90 <= latitude <= 90 and -180 <= longitude <= 180):
        raise ValueError("latitude or longitude out of range")
    distance = great_circle_km(F.lit(latitude), F.lit(longitude), F.col("latitude"), F.col("longitude"))
    return stations.withColumn("distance_km", distance).orderBy("distance_km", "id").limit(limit)


def recommended_stations(
    stations: DataFrame,
    piles: DataFrame,
    scores: DataFrame,
    latitude: float | None = None,
    longitude: float | None = None,
    limit: int = 5,
) -> DataFrame:
    """Stations by score, then distance, then id; a station without score counts as -1."""
    scored = stations.join(scores.select(F.col("station_id").alias("id"), "score"), "id", "left")
    distance = F.lit(None).cast("double")
    if latitude is not None and longitude is not None:
        distance = great_circle_km(
            F.lit(latitude), F.lit(longitude), F.col("latitude"), F.col("longitude")
        )
    ranked = scored.select(
        *stations.columns,
        distance.alias("distance_km"),
        F.coalesce("score", F.lit(-1.0)).alias("recommend_score"),
    ).orderBy(F.desc("recommend_score"), F.asc_nulls_last("distance_km"), "id").limit(limit)
    return ranked.join(
        _pile_summary(piles).select("id", "free", "working", "pile_rows"), "id", "left"
    ).select(
        *ranked.columns,
        F.coalesce("free", F.lit(0).cast("bigint")).alias("free_pile_count"),
        F.coalesce(F.col("working") * F.lit(100.0) / F.col("pile_rows"), F.lit(0.0)).alias("online_rate"),
    )


def forecast_totals(forecast: DataFrame) -> DataFrame:
    """Predicted load per hour over all stations, in time order."""
    return forecast.groupBy("datetime").agg(F.sum("predicted_load_kwh").alias("load")).orderBy("datetime")


def forecast_by_station(forecast: DataFrame) -> DataFrame:
    """Total, peak and first time of the peak per station, largest total first."""
    load = F.col("predicted_load_kwh")
    best = forecast.groupBy("station_id").agg(
        F.sum(load).alias("total_load"),
        F.min(F.struct((-load).alias("fall"), F.col("datetime"))).alias("_peak"),
    )
    return best.select(
        "station_id", "total_load",
        (-F.col("_peak.fall")).alias("peak_load"),
        F.col("_peak.datetime").alias("peak_time"),
    ).orderBy(F.desc("total_load"), "station_id")


def forecast_summary(forecast: DataFrame) -> DataFrame:
    """One row: total, peak hour load, mean per hour, peak time and station count."""
    hours = forecast.groupBy("datetime").agg(F.sum("predicted_load_kwh").alias("load"))
    stations = forecast.select("station_id").distinct().agg(F.count("*").alias("n")).scalar()
    return hours.agg(
        F.coalesce(F.sum("load"), F.lit(0.0)).alias("total_load"),
        F.coalesce(F.max("load"), F.lit(0.0)).alias("peak_load"),
        F.coalesce(F.avg("load"), F.lit(0.0)).alias("avg_load"),
        F.min(F.struct((-F.col("load")).alias("fall"), F.col("datetime")))["datetime"].alias("peak_time"),
    ).withColumn("station_count", stations)
