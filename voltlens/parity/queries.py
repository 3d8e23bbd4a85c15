"""Registered queries: every operator on the tables of one data folder.

``portable`` gives results plain types (decimals as doubles, times as text,
arrays as JSON) so that they can be compared with another engine's.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voltlens.operators import (
    calendar,
    cleaning,
    demand,
    features,
    forecast,
    integrity,
    keys,
    kpis,
    metrics,
    models,
    nearby,
    operations as ops,
    peaks,
    quality,
    recent,
    recommend,
    series,
)
from voltlens.parity.datasets import Dataset
from voltlens.plans import load, snapshot, training, warehouse
from voltlens.session import shared_folder, side_by_side, written
from voltlens.sources import RAW_COLUMNS, import_csv, read_part_csv, read_raw, write_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def portable(df: DataFrame) -> DataFrame:
    def plain(name: str, kind: str) -> Column:
        column = F.col(f"`{name}`")
        if kind.startswith("decimal") or kind == "float":
            column = column.cast("double")
        elif kind.startswith("timestamp"):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        elif kind == "date":
            column = F.date_format(column, "yyyy-MM-dd")
        elif kind == "array<string>":
            column = F.array_join(column, "|")
        elif kind.startswith(("array", "struct", "map")):
            column = F.to_json(column)
        elif kind == "boolean":
            column = column.cast("int")
        return column.alias(name)

    return df.select(*[plain(name, kind) for name, kind in df.dtypes])


def query(build: Callable[[Dataset], DataFrame]) -> Callable[[Dataset], DataFrame]:
    QUERIES[build.__name__] = lambda spark, folder: portable(build(Dataset(spark, folder)))
    return build


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Round double results whose last bits depend on summation order; only numbers near a tie take the slow decimal rounding."""
    kinds = dict(df.dtypes)

    def near(name: str, n: int) -> Column:
        value, slow = F.col(name), F.round(name, n)
        if kinds[name] != "double" or not 0 <= n <= 6:
            return slow
        # Whole numbers below 2^53 and powers of ten are exact, so their quotient is the double next to the decimal.
        scaled = value * F.lit(10.0**n)
        clear = (F.abs(scaled) < F.lit(1e12)) & (F.abs(F.abs(scaled - F.rint(scaled)) - F.lit(0.5)) > F.lit(1e-3))
        quick = F.rint(scaled) / F.lit(10.0**n) + F.lit(0.0)
        return F.when(value == F.rint(value), value + F.lit(0.0)).when(clear, quick).otherwise(slow)

    return df.withColumns({name: near(name, n) for name, n in digits.items()})


# ---- warehouse metrics ----------------------------------------------------


@query
def overall_kpis(d):
    return kpis.overall_kpis(d.facts)


@query
def station_kpis(d):
    return kpis.station_kpis(d.facts, d.stations)


@query
def user_kpis(d):
    return kpis.user_kpis(d.facts)


@query
def user_summary(d):
    return kpis.user_summary(d.facts)


@query
def weekday_patterns(d):
    return kpis.weekday_patterns(d.facts)


@query
def holiday_patterns(d):
    return kpis.holiday_patterns(d.facts)


@query
def hourly_distribution(d):
    return kpis.hourly_distribution(d.facts)


@query
def weekday_hour_heatmap(d):
    return kpis.weekday_hour_heatmap(d.facts)


@query
def session_trend(d):
    return kpis.session_trend(d.facts)


@query
def rank_stations_by_energy(d):
    return kpis.rank_stations(d.facts, d.stations, "total_kwh", 10)


@query
def rank_stations_by_sessions(d):
    return kpis.rank_stations(d.facts, d.stations)


@query
def station_distribution(d):
    return kpis.station_distribution(d.stations)


@query
def filtered_hourly(d):
    return kpis.filtered_hourly(d.facts, weekday=2)


@query
def device_kpis(d):
    return kpis.device_kpis(d.facts, d.devices)


@query
def device_operation_kpis(d):
    return kpis.device_operation_kpis(d.status, d.devices)


@query
def weather_impact(d):
    return kpis.weather_impact(d.facts, d.weather, d.stations)


# ---- dashboard metrics ----------------------------------------------------


@query
def recent_orders(d):
    return recent.last_days(d.orders, 7).select("session_id", "created_at")


@query
def recent_revenue_totals(d):
    return recent.revenue_totals(d.orders)


@query
def recent_volume_trend(d):
    return recent.volume_trend(d.orders, 7)


@query
def recent_revenue_trend(d):
    return recent.revenue_trend(d.orders, 7)


@query
def recent_count_trend(d):
    return recent.count_trend(d.orders, 7)


@query
def recent_hourly_energy(d):
    return recent.hourly_energy(d.orders, 7)


@query
def recent_heatmap_counts(d):
    return recent.heatmap_counts(d.orders, 7)


@query
def recent_user_metrics(d):
    return recent.user_metrics(d.orders, 7)


@query
def recent_weekday_energy(d):
    return recent.weekday_energy(d.orders, 7)


@query
def recent_weather_sessions(d):
    return recent.weather_sessions(d.orders, d.weather, 7)


@query
def recent_overview(d):
    return recent.overview(d.orders)


@query
def station_online(d):
    return recent.station_online(d.stations, d.devices)


@query
def recent_station_ranking(d):
    return recent.station_ranking(d.orders, d.stations, 30, 10)


@query
def station_board(d):
    return recent.station_board(d.stations, d.devices)


@query
def device_status_by_station(d):
    return recent.device_status_by_station(d.status, 7)


@query
def filtered_daily(d):
    return recent.filtered_daily(d.orders, weekday="Wednesday")


@query
def filtered_totals(d):
    return recent.filtered_totals(d.orders, is_holiday=1)


@query
def filtered_by_weather(d):
    return recent.filtered_daily(d.orders, weather_type="fog", weather=d.weather)


@query
def device_status_counts(d):
    return recent.device_status_counts(d.devices)


@query
def ops_bundle(d):
    return recent.ops_bundle(d.orders, d.stations, d.devices)


# ---- operational reports --------------------------------------------------


@query
def revenue_to_date(d):
    return ops.revenue_to_date(d.op_orders, d.as_of)


@query
def settled_revenue_trend(d):
    return ops.settled_revenue_trend(d.op_orders, d.as_of, 30)


@query
def pile_state_counts(d):
    return ops.pile_state_counts(d.op_piles)


@query
def free_piles(d):
    return ops.free_piles(d.op_stations, d.op_piles)


@query
def working_rate(d):
    return ops.working_rate(d.op_stations, d.op_piles)


@query
def free_share_board(d):
    return ops.free_share_board(d.op_stations, d.op_piles)


@query
def user_orders(d):
    return ops.user_orders(d.op_orders, 7)


@query
def pile_list(d):
    return ops.pile_list(d.op_piles, d.op_stations)


@query
def piles_of_station(d):
    return ops.pile_list(d.op_piles, d.op_stations, 7)


@query
def pile_lifetime(d):
    return ops.pile_lifetime(d.op_orders, d.op_piles)


@query
def pile_count_by_station(d):
    return ops.pile_count_by_station(d.op_stations, d.op_piles)


@query
def find_user(d):
    return ops.find_by_key(d.op_users, "id", 7)


@query
def find_station(d):
    return ops.find_by_key(d.op_stations, "id", 7)


@query
def find_pile(d):
    return ops.pile_by_id(d.op_piles, d.op_stations, 71)


@query
def find_order(d):
    return ops.find_by_key(d.op_orders, "id", 7)


@query
def user_list(d):
    return ops.search_users(d.op_users)


@query
def station_list(d):
    return ops.in_id_order(d.op_stations)


@query
def search_users(d):
    return ops.search_users(d.op_users, "07")


@query
def search_stations(d):
    return ops.search_stations(d.op_stations, "ROAD 1")


@query
def search_orders(d):
    return ops.search_orders(
        d.op_orders, d.op_users, d.op_piles, d.op_stations,
        phone="01", from_date="1997-01-01", to_date="1999-12-31", status="已结算",
    )


@query
def all_orders(d):
    return ops.search_orders(d.op_orders, d.op_users, d.op_piles, d.op_stations)


@query
def login_history(d):
    return ops.login_history(d.logins)


@query
def operation_history(d):
    return ops.operation_history(d.operations, target_table="piles", operator_id=3)


@query
def open_orders(d):
    return ops.open_orders(d.op_orders)


@query
def open_session_estimate(d):
    moment = d.read("orders").selectExpr("max(o_orderdate) + interval 1 day AS m").scalar()
    return rounded(
        ops.open_session_estimate(d.op_orders, d.op_piles, d.op_stations, moment),
        estimated_kwh=3, estimated_fee=3,
    )


@query
def route_plausibility(d):
    return rounded(ops.route_plausibility(d.routes), origin_lat=6, origin_lng=6, dest_lat=6, dest_lng=6)


@query
def nearest_stations(d):
    return rounded(ops.nearest_stations(d.op_stations, 30.3, 110.4, 5), distance_km=6)


# ---- quality --------------------------------------------------------------


def _checked(d):
    return quality.detect_quality_issues(d.raw_orders)


def _referenced(d):
    text = {n: d.raw_copy(n) for n in ("users", "stations", "devices")}
    weather = cleaning.clean_weather(d.raw_copy("weather_hourly"))
    return quality.detect_reference_issues(_checked(d), weather=weather, **text)


@query
def parsed_charging_times(d):
    return quality.process_charging_time(d.raw_orders).select(
        "session_id", *[c for c in (
            "_created_at", "_ended_at", "_energy_kwh", "_fee_amount_cny", "_charge_time_hrs",
            "_start_hour", "_weekday", "_weekday_from_name", "_weekday_from_timestamp",
            "_actual_duration_hrs",
        )],
    )


@query
def order_quality_issues(d):
    return _checked(d)


@query
def order_reference_issues(d):
    return _referenced(d)


@query
def clean_orders(d):
    return quality.clean_orders(_referenced(d))


@query
def order_facts(d):
    return quality.order_facts(_referenced(d))


@query
def rejected_orders(d):
    return quality.rejected_orders(_referenced(d))


@query
def quality_summary(d):
    return quality.quality_summary(_referenced(d))


@query
def rejected_count(d):
    return quality.rejected_count(_referenced(d))


@query
def plausible_measurements(d):
    typed = quality.process_charging_time(d.raw_orders).select(
        "session_id", "created_at",
        *[F.col(f"_{n}").alias(n) for n in ("energy_kwh", "fee_amount_cny", "charge_time_hrs", "start_hour", "weekday")],
    )
    return typed.where(quality.measurement_predicate())


@query
def trimmed_orders(d):
    return quality.trim_text_columns(d.raw_orders)


@query
def repeated_sessions(d):
    events = d.read("events").selectExpr("user_id", "event_id", "ts")
    return keys.mark_repeats(
        events, F.col("user_id").cast("string"), [F.col("ts"), F.col("event_id")], "repeated"
    )


@query
def clean_users(d):
    return cleaning.clean_users(d.raw_doubled("users"))


@query
def clean_stations(d):
    return cleaning.clean_stations(d.raw_doubled("stations"))


@query
def clean_devices(d):
    return cleaning.clean_devices(d.raw_doubled("devices"))


@query
def clean_weather(d):
    return cleaning.clean_weather(d.raw_doubled("weather_hourly"))


@query
def clean_device_status(d):
    return cleaning.clean_device_status(d.raw_doubled("device_status_log"))


@query
def one_order_per_user_and_day(d):
    rows = d.read("events").selectExpr("user_id", "to_date(ts) AS day", "event_type", "event_id")
    return keys.one_per_key(rows, ["user_id", "day"])


@query
def distinct_times(d):
    return d.read("events").selectExpr("cast(date_trunc('hour', ts) AS timestamp_ntz) AS datetime").distinct()


# ---- integrity ------------------------------------------------------------


@query
def valid_devices(d):
    active = d.stations.where("station_status = 'active'")
    return integrity.valid_devices(d.devices, active)


@query
def valid_weather(d):
    active = d.stations.where("station_status = 'active'")
    return integrity.valid_weather(d.weather, active)


@query
def valid_device_status(d):
    moved = d.devices.withColumn("station_id", F.expr("station_id + cast(device_id % 10 = 2 AS int)"))
    return integrity.valid_device_status(d.status, moved)


@query
def null_counts(d):
    return integrity.null_counts(d.raw_orders)


@query
def orphan_count(d):
    return integrity.orphan_count(d.raw_orders, "station_id", d.raw_copy("stations"), "station_id")


@query
def validate_tables(d):
    return integrity.validate_tables(d.tables())


@query
def cross_table_assertions(d):
    return integrity.cross_table_assertions(d.tables())


# ---- features and splits --------------------------------------------------


@query
def time_features(d):
    return features.time_features(d.orders.drop("is_weekend")).select(
        "session_id", "datetime", "hour", "day", "month", "weekday_number", "is_weekend", "is_holiday", "is_workday"
    )


@query
def weather_features(d):
    return features.weather_features(d.weather).drop("weather_name")


@query
def station_features(d):
    return features.station_features(d.stations)


@query
def device_features(d):
    return rounded(
        features.device_features(d.devices, d.status),
        avg_rated_power_kw=6, avg_connector_count=6, avg_availability_rate=6,
        avg_health_score=6, avg_output_power_kw=6,
    )


@query
def user_features(d):
    return features.user_features(d.users)


@query
def merged_orders(d):
    return rounded(
        features.merge_tables(d.tables()), avg_rated_power_kw=6, avg_connector_count=6, avg_availability_rate=6,
        avg_health_score=6, avg_output_power_kw=6,
    )


@query
def user_mix(d):
    mix = features.user_mix(features.merge_tables(d.tables()))
    return rounded(mix, **{n: 6 for n in features.MIX_FEATURES})


@query
def station_hour_targets(d):
    targets = features.station_hour_targets(features.merge_tables(d.tables()))
    return rounded(targets, energy_kwh=3, avg_charge_time_hrs=6)


@query
def station_hour_grid(d):
    return features.station_hour_grid(d.stations, d.orders)


@query
def calendar_rollup(d):
    return features.calendar_rollup(features.merge_tables(d.tables()))


@query
def station_hour_features(d):
    table = features.select_features(features.station_hour_dataset(d.tables()))
    return rounded(table, **{n: 6 for n, kind in table.dtypes if kind == "double"})


@query
def lag_features(d):
    grid = features.station_hour_grid(d.stations, d.orders)
    load = d.orders.groupBy(
        "station_id", F.date_trunc("hour", "created_at").cast("timestamp_ntz").alias("datetime")
    ).agg(F.sum("energy_kwh").alias("energy_kwh"))
    dense = grid.join(load, ["station_id", "datetime"], "left").na.fill(0, ["energy_kwh"])
    return series.lag_features(dense.select("station_id", "datetime", "energy_kwh"), hourly=True)


@query
def global_lag_features(d):
    rows = d.orders.select(F.col("created_at").alias("datetime"), "energy_kwh", "session_id")
    return series.lag_features(rows, lags=(1, 24))


@query
def time_index(d):
    return series.time_index(d.orders.select("created_at"), "created_at")


@query
def time_split(d):
    rows = d.orders.select("session_id", F.col("created_at").alias("datetime"))
    return series.with_split(rows)


@query
def newest_orders_per_station(d):
    rows = d.orders.select("station_id", "session_id", "created_at")
    return keys.newest_rows(rows, ["station_id"], [F.desc("created_at"), F.desc("session_id")], 24)


@query
def load_by_station_hour(d):
    return features.historical_load(d.orders)


@query
def load_by_hour(d):
    return features.historical_load(d.orders, "hourly")


@query
def load_by_station(d):
    return features.historical_load(d.orders, "station-total")


@query
def demand_weight(d):
    load = features.historical_load(d.orders)
    return models.demand_weight(load, 40.0)


@query
def prepared_training_rows(d):
    rows = d.raw_orders.selectExpr(
        "session_id AS id", "created_at AS datetime", "energy_kwh", "fee_amount_cny", "charge_time_hrs"
    )
    return models.prepare(rows, ["fee_amount_cny", "charge_time_hrs"])


# ---- demand ---------------------------------------------------------------


@query
def calendar_dimension(d):
    span = d.read("orders").selectExpr(
        "to_date(min(o_orderdate)) + make_ym_interval(15, 0) AS first_day",
        "to_date(max(o_orderdate)) + make_ym_interval(15, 0) AS last_day",
    ).selectExpr("cast(first_day AS date) AS first_day", "cast(last_day AS date) AS last_day")
    return calendar.calendar_dimension(span)


@query
def station_factors(d):
    return rounded(demand.station_factors(d.orders, d.stations), station_factor=9)


@query
def hour_factors(d):
    return rounded(demand.hour_factors(d.orders), hour_factor=9)


@query
def weekday_factors(d):
    return rounded(demand.weekday_factors(d.orders), weekday_factor=9)


@query
def expected_demand(d):
    return rounded(
        demand.expected_demand(d.orders, d.stations, d.weather, 24000.0), expected_orders=6
    )


@query
def device_day_rollup(d):
    return rounded(demand.device_day_rollup(d.orders, d.devices), avg_output_power_kw=6)


@query
def weather_day_rollup(d):
    return rounded(
        demand.weather_day_rollup(d.weather), daily_avg_humidity_pct=6, daily_avg_temperature_c=6
    )


@query
def fault_risk(d):
    return rounded(
        demand.fault_risk(d.orders, d.devices, d.stations, d.weather), fault_probability=9
    )


@query
def current_device_state(d):
    return demand.current_device_state(d.devices, d.status)


@query
def demand_rate_by_weather(d):
    return demand.demand_rate_by_weather(d.orders, d.weather, d.stations)


# ---- forecasts ------------------------------------------------------------


def _hourly(d):
    """Station-hours that have orders, as forecast history."""
    return features.historical_load(d.orders)


def _forecast(d, horizon=24):
    return forecast.persistence_forecast(_dense(d), horizon)


def _dense(d):
    """The dense station-hour load, so that many stations end on an idle hour."""
    grid = features.station_hour_grid(d.stations, d.orders)
    load = features.historical_load(d.orders).select("station_id", "datetime", "energy_kwh")
    return grid.select("station_id", "datetime").join(load, ["station_id", "datetime"], "left").na.fill(
        0, ["energy_kwh"]
    )


@query
def persistence_forecast(d):
    return rounded(_forecast(d), predicted_load_kwh=6)


@query
def persistence_forecast_from_orders(d):
    return rounded(forecast.persistence_forecast(_hourly(d), 6), predicted_load_kwh=6)


@query
def forecast_totals(d):
    return rounded(ops.forecast_totals(_forecast(d)), load=4)


@query
def forecast_by_station(d):
    steady = rounded(_forecast(d), predicted_load_kwh=6)
    return rounded(ops.forecast_by_station(steady), total_load=4, peak_load=4)


@query
def forecast_summary(d):
    return rounded(ops.forecast_summary(_forecast(d)), total_load=3, peak_load=3, avg_load=3)


@query
def standard_forecast_rows(d):
    loose = _forecast(d, 6).selectExpr(
        "date_format(datetime, 'yyyy-MM-dd HH:mm:ss') AS datetime",
        "cast(predicted_load_kwh AS string) AS prediction", "horizon_hour AS horizon",
    )
    return rounded(
        peaks.forecast_frame(loose).select("station_id", "datetime", "predicted_load_kwh", "horizon_hour"),
        predicted_load_kwh=6,
    )


@query
def peak_periods(d):
    return rounded(
        peaks.peak_periods(_forecast(d), return_all=True), predicted_load_kwh=4, peak_threshold_kwh=4
    )


@query
def top_peak_periods(d):
    return rounded(
        peaks.peak_periods(_forecast(d), top_n=3, threshold=100.0, aggregate="mean"),
        predicted_load_kwh=4, peak_threshold_kwh=4,
    )


@query
def peak_periods_per_station(d):
    steady = rounded(_forecast(d), predicted_load_kwh=6)
    return rounded(
        peaks.peak_periods_per_station(steady, top_n=3), predicted_load_kwh=4, peak_threshold_kwh=4
    )


# ---- recommendation -------------------------------------------------------


def _scoring_inputs(d):
    free = d.devices.groupBy("station_id").agg(
        F.count_if(F.col("current_status") == "online").alias("available_chargers")
    )
    stations = d.stations.join(free, "station_id", "left")
    return rounded(_forecast(d), predicted_load_kwh=6), stations, d.orders


@query
def aggregated_predictions(d):
    return rounded(recommend.aggregate_predictions(_scoring_inputs(d)[0]), predicted_load=4)


@query
def aggregated_history(d):
    return rounded(recommend.aggregate_history(d.orders), historical_volume=3)


@query
def scoring_frame(d):
    frame = recommend.scoring_frame(*_scoring_inputs(d))
    return rounded(frame, latitude=6, longitude=6, predicted_load=4, historical_volume=3)


@query
def station_score(d):
    scored = recommend.station_score(*_scoring_inputs(d))
    return rounded(scored, predicted_load=4)


@query
def recommend_low_load(d):
    best = recommend.recommend_low_load(*_scoring_inputs(d), top_n=5)
    return rounded(recommend.enrich_with_station(best, d.stations), predicted_load=4)


@query
def recommended_stations(d):
    scores = recommend.recommend_low_load(*_scoring_inputs(d), top_n=None)
    return rounded(
        ops.recommended_stations(d.op_stations, d.op_piles, scores, 30.3, 110.4), distance_km=6
    )


def _route_ends(d):
    """Start points of the routes, with the number of routes from each."""
    return d.routes.groupBy(F.col("origin_lat").alias("latitude"), F.col("origin_lng").alias("longitude")).agg(
        F.count("*").alias("routes"))


@query
def nearest_stations_per_route(d):
    return rounded(nearby.nearest_stations_of(_route_ends(d), d.op_stations, 5), latitude=6, longitude=6, distance_km=6)


@query
def recommended_stations_per_route(d):
    scores = recommend.recommend_low_load(*_scoring_inputs(d), top_n=None)
    # Whole scores tie often, so that distance decides.
    whole = scores.select("station_id", F.floor(F.col("score") / 10).cast("double").alias("score"))
    found = nearby.recommended_stations_of(_route_ends(d), d.op_stations, whole, 5)
    return rounded(found, latitude=6, longitude=6, distance_km=6)


@query
def detect_peaks(d):
    load = features.historical_load(d.orders).selectExpr("station_id", "datetime", "energy_kwh AS load")
    return rounded(recommend.detect_peaks(load, 300.0, {"3": 100.0, "5": 900.0}, include_medium=True), predicted_load=3)


@query
def load_alerts(d):
    load = features.historical_load(d.orders).selectExpr("station_id", "datetime", "energy_kwh AS load")
    return rounded(recommend.load_alerts(load, 250.0), predicted_load=3)


@query
def ops_advice(d):
    """Every seventh station is known to the forecast only."""
    predictions, stations, history = _scoring_inputs(d)
    stations, history = (df.where("station_id % 7 <> 3") for df in (stations, history))
    return recommend.ops_advice(stations, predictions, history, threshold=300.0)


# ---- sources and jobs: what Spark derives from the tables, written to the shared folder and read back ----


def _target(d) -> str:
    return f"{shared_folder(d.spark)}/voltlens-{uuid4().hex}"


@query
def raw_lines(d):
    """User lines of which some break off: the reader keeps them with their text."""
    names = RAW_COLUMNS["users"]
    damaged = F.col("user_id").cast("long") % 7 == 3
    whole = F.concat_ws(",", *[F.col(n).cast("string") for n in names])
    users = d.users.withColumn("registered_at", F.date_format("registered_at", "yyyy-MM-dd HH:mm:ss"))
    lines = users.select(F.when(damaged, F.concat_ws(",", "user_id", F.lit("broken"))).otherwise(whole).alias(",".join(names)))
    path = _target(d)
    lines.write.option("header", True).option("sep", "\t").csv(path)
    return read_raw(d.spark, "users", path).drop("_source_file", "_ingested_at")


@query
def imported_csv(d):
    """Untyped import of a comma-separated copy: header freed of spaces, types inferred."""
    source = d.read("nation")
    path = _target(d)
    write_table(source.toDF(*[f" {c} " for c in source.columns]), path, fmt="csv")
    return import_csv(d.spark, path, _target(d))


@query
def part_csv(d):
    path = write_table(d.read("events").select("event_id", "user_id", "event_type", "props"), _target(d), fmt="csv")
    return read_part_csv(d.spark, path)


@query
def typed_part_csv(d):
    rows = _forecast(d)
    path = write_table(rows, _target(d), fmt="csv")
    return rounded(read_part_csv(d.spark, path, rows.schema), predicted_load_kwh=6)


@query
def stored_forecast(d):
    path = _target(d)
    training.write_forecast(_forecast(d), path, 24)
    return rounded(training.lookup_forecast(d.spark, path, 24), predicted_load_kwh=6)


@query
def forecast_peak_job(d):
    path = write_table(_forecast(d), _target(d), fmt="csv")
    found = d.spark.read.parquet(training.write_peaks(d.spark, path, _target(d), top_n=5))
    return rounded(found, predicted_load_kwh=4, peak_threshold_kwh=4)


def _raw_inputs(d) -> dict[str, str]:
    """The damaged text copies as CSV files, one folder per raw table."""
    jobs = []
    for name, columns in RAW_COLUMNS.items():
        copy = d.raw_orders.drop("_corrupt_record") if name == "charging_orders" else d.raw_copy(name)
        jobs.append(partial(write_table, copy.select(*columns), f"{_target(d)}/{name}.csv", fmt="csv"))
    return dict(zip(RAW_COLUMNS, side_by_side(d.spark, jobs), strict=True))


@query
def loaded_table(d):
    """One job of the load: users from CSV, trimmed, cleaned, written and read back."""
    path = f"{_target(d)}/users"
    load.load_table(d.spark, "users", _raw_inputs(d)["users"], path, fmt="parquet")
    return d.spark.read.parquet(path)


@query
def warehouse_quality(d):
    """The whole warehouse from CSV files; its account of rejected rows read back."""
    root = _target(d)
    warehouse.build_warehouse(d.spark, _raw_inputs(d), root)
    return d.spark.read.parquet(f"{root}/ads/data_quality")


@query
def warehouse_snapshot(d):
    """The snapshot of a warehouse, written as JSON lines; rows per section and the overall figures."""
    root = _target(d)
    warehouse.build_warehouse(d.spark, _raw_inputs(d), root)
    target = snapshot.write_snapshot(d.spark, root, f"{root}/snapshot")
    names = [r["s"]["section"] for r in d.spark.read.json(f"{target}/manifest").select(F.explode("sections").alias("s")).collect()]
    parts = [
        d.spark.read.text(f"{target}/{n}").groupBy().agg(F.count("*").alias("rows")).select(F.lit(n).alias("section"), "rows") for n in names
    ]
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    return found


@query
def stored_features(d):
    """The feature table as packed CSV parts, read back with its types."""
    table = features.select_features(features.station_hour_dataset(d.tables()))
    path = write_table(table, _target(d), fmt="csv", compression="gzip")
    back = read_part_csv(d.spark, path, table.schema)
    return rounded(back, **{n: 6 for n, kind in back.dtypes if kind == "double"})


# ---- models ---------------------------------------------------------------


def _persistence_predictions(d):
    """Each hour predicted by the hour before: (model, actual, prediction)."""
    lagged = series.lag_features(_dense(d), lags=(1, 24), hourly=True)
    return lagged.selectExpr(
        "stack(2, 'previous_hour', load_lag_1h, 'previous_day', load_lag_24h) AS (model, prediction)",
        "cast(energy_kwh AS double) AS actual",
    )


@query
def regression_metrics(d):
    result = metrics.regression_metrics(_persistence_predictions(d).where("model = 'previous_hour'"))
    return rounded(result, mae=6, rmse=6, mape=4, r2=6)


@query
def compare_models(d):
    result = metrics.compare_models(_persistence_predictions(d), sort_by="mae")
    return rounded(result, mae=6, rmse=6, mape=4, r2=6)


@query
def select_best(d):
    scores = metrics.regression_metrics(_persistence_predictions(d), by=("model",))
    return rounded(metrics.select_best(scores, "r_squared"), mae=6, rmse=6, mape=4, r2=6)


def _near(table):
    return rounded(table, **{n: 6 for n, kind in table.dtypes if kind == "double"})


def _training_rows(d):
    """The whole feature table, written once: fitting and forecasting read it several times."""
    return written(_near(features.select_features(features.station_hour_dataset(d.tables()))), "features")


@query
def linear_model_predictions(d):
    return rounded(models.train_model(_training_rows(d), "linear_regression").predictions, prediction=3)


@query
def forest_model_predictions(d):
    """``train_model`` writes its rows, so the feature table itself is not written."""
    table = features.select_features(features.station_hour_dataset(d.tables()))
    trained = models.train_model(table, "random_forest", weight=40.0, finish=_near)
    return rounded(trained.predictions, prediction=6)


@query
def boosted_model_predictions(d):
    trained = models.train_model(_training_rows(d), "histogram_trees", weight=40.0)
    return rounded(trained.predictions, prediction=6)


@query
def model_forecast(d):
    rows = _training_rows(d)
    trained = models.train_model(rows, "linear_regression")
    return rounded(forecast.forecast_24h(rows, trained.model, trained.features), predicted_load_kwh=3)


@query
def reloaded_model(d):
    """A saved linear model, loaded again and applied to the test rows."""
    trained = models.train_model(_training_rows(d), "linear_regression")
    model = models.load_model(models.save_model(trained.model, _target(d)))
    test = trained.predictions.select("station_id", "datetime")
    return rounded(model.transform(_training_rows(d).join(test, ["station_id", "datetime"], "left_semi")).select(
        "station_id", "datetime", "prediction"), prediction=3)


@query
def trained_models(d):
    """Several models trained on one table; one that is not installed is left out, the rest compared."""
    found = models.train_models(_training_rows(d), ("linear-regression", "xgboost"))
    assert found.failures.keys() == {"xgboost"} or "xgboost" in found.models
    own = {"linear_regression": found.models["linear_regression"]}
    return rounded(models.comparison(d.spark, own), mae=4, rmse=4, mape=2, r2=4)
