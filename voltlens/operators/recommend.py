"""Station scoring, peak alerts and operating advice.

Inputs may name their columns differently; the first known name found is used.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from voltlens.functions import first_present, min_max_share, require_columns
from voltlens.session import cut_lineage

# Accepted column names, weights, texts and limits.
LOAD_NAMES = ("predicted_load", "predicted_load_kwh", "prediction", "load")
VOLUME_NAMES = ("energy_kwh", "historical_volume", "charge_volume", "charging_volume")
COUNT_NAMES = ("device_count", "charger_count", "total_devices")
FREE_NAMES = ("available_chargers", "available_devices", "available_count")
STATUS_NAMES = ("station_status", "status", "station_status_code")
CONGESTION_NAMES = ("predicted_congestion", "predicted_congestion_level", "congestion_level")
PRICE_NAMES = ("electricity_price_cny_kwh", "electricity_price", "price")
FEE_NAMES = ("service_fee_cny_kwh", "service_fee")
NORMAL_STATES = ("normal", "open", "online", "active", "available", "1", "true")
CONGESTION_LEVELS = {"low": 0.2, "medium": 0.5, "mid": 0.5, "high": 0.8, "critical": 1.0}
# Part -> (weight, whether lower is better).
WEIGHTS = {
    "load": (0.28, True),
    "congestion": (0.20, True),
    "available": (0.18, False),
    "price": (0.08, True),
    "volume": (0.06, False),
    "frequency": (0.06, False),
}
STATUS_WEIGHT = 0.14
DEFAULT_THRESHOLD = 80.0


def _number(df: DataFrame, candidates, default: float = 0.0) -> Column:
    name = first_present(df, candidates)
    if name is None:
        return F.lit(default)
    return F.coalesce(F.col(name).try_cast("double"), F.lit(default))


def _predicted(predictions: DataFrame) -> DataFrame:
    """(station_id, datetime?, load) of a forecast."""
    require_columns(predictions, ["station_id"], "prediction data")
    name = first_present(predictions, LOAD_NAMES)
    if name is None:
        raise ValueError("prediction data needs predicted_load or predicted_load_kwh")
    load = F.coalesce(F.col(name).try_cast("double"), F.lit(0.0)).alias("load")
    at = [F.col("datetime")] if "datetime" in predictions.columns else [F.lit(None).cast("string").alias("datetime")]
    return predictions.select("station_id", *at, load)


def aggregate_predictions(predictions: DataFrame) -> DataFrame:
    """Mean load per station and the earliest time of its largest load."""
    first_peak = F.min(F.struct((-F.col("load")).alias("fall"), F.col("datetime")))
    return _predicted(predictions).groupBy("station_id").agg(
        F.avg("load").alias("predicted_load"), first_peak["datetime"].alias("peak_time")
    )


def aggregate_history(history: DataFrame) -> DataFrame:
    """Energy sum and row count per station; decimal energy is summed exactly."""
    require_columns(history, ["station_id"], "history data")
    name = first_present(history, VOLUME_NAMES)
    exact = name is not None and dict(history.dtypes)[name].startswith("decimal")
    volume = F.coalesce(F.col(name), F.lit(0)) if exact else _number(history, VOLUME_NAMES)
    return history.select("station_id", volume.alias("v")).groupBy("station_id").agg(
        F.sum("v").cast("double").alias("historical_volume"),
        F.count("*").cast("double").alias("historical_frequency"),
    )


def scoring_frame(
    predictions: DataFrame | None = None,
    stations: DataFrame | None = None,
    history: DataFrame | None = None,
) -> DataFrame:
    """Stations with their predicted load and history; either input may be missing."""
    if predictions is None and stations is None:
        raise ValueError("scoring needs stations or predictions")
    ahead = None if predictions is None else aggregate_predictions(predictions)
    if stations is None:
        frame = ahead
    else:
        require_columns(stations, ["station_id"], "station data")
        if ahead is None:
            frame = stations.withColumns(
                {"predicted_load": F.lit(0.0), "peak_time": F.lit(None).cast("string")}
            )
        else:
            frame = stations.join(ahead, "station_id", "left").na.fill(0.0, ["predicted_load"])
    if history is not None:
        frame = frame.join(aggregate_history(history), "station_id", "left")
    for name in ("historical_volume", "historical_frequency"):
        frame = frame.withColumn(
            name, F.coalesce(F.col(name), F.lit(0.0)) if name in frame.columns else F.lit(0.0)
        )
    return frame


def status_score(df: DataFrame) -> Column:
    """1 for a normal status word, 0 for another; numbers are clipped to 0..1; absent is 1."""
    name = first_present(df, STATUS_NAMES)
    if name is None:
        return F.lit(1.0)
    if dict(df.dtypes)[name] == "string":
        word = F.lower(F.trim(F.coalesce(F.col(name), F.lit(""))))
        return word.isin(*NORMAL_STATES).cast("double")
    value = F.coalesce(F.col(name).cast("double"), F.lit(1.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def _congestion(df: DataFrame, load: Column, devices: Column) -> Column:
    name = first_present(df, CONGESTION_NAMES)
    if name is None:
        return F.when(devices == 0, load).otherwise(F.try_divide(load, devices))
    if dict(df.dtypes)[name] != "string":
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    levels = F.create_map(*[F.lit(x) for pair in CONGESTION_LEVELS.items() for x in pair])
    word = F.lower(F.trim(F.coalesce(F.col(name), F.lit(""))))
    return F.coalesce(F.try_element_at(levels, word), F.lit(0.0))


def _parts(frame: DataFrame) -> DataFrame:
    """The scoring inputs of every station under fixed names."""
    devices = _number(frame, COUNT_NAMES)
    stated = _number(frame, FREE_NAMES, -1.0)
    load = F.coalesce(F.col("predicted_load").cast("double"), F.lit(0.0))
    return frame.select(
        "station_id",
        "predicted_load",
        "peak_time",
        load.alias("load"),
        _congestion(frame, load, devices).alias("congestion"),
        F.when(stated >= 0, stated).otherwise(devices).alias("available"),
        (_number(frame, PRICE_NAMES) + _number(frame, FEE_NAMES)).alias("price"),
        F.col("historical_volume").alias("volume"),
        F.col("historical_frequency").alias("frequency"),
        status_score(frame).alias("status"),
    )


def _reason() -> Column:
    free, load = F.col("available"), F.col("load")
    return (
        F.when(F.col("status") < 1, "Station is not in normal operating status")
        .when((free > 0) & (load <= free * 4), "Low predicted congestion")
        .when(free > 0, "Available chargers remain despite forecast load")
        .otherwise("Ranked by prediction and station capacity")
    )


def _scored(predictions, stations, history) -> DataFrame:
    # One row per station, written once: the limits and the shares read it, not the orders again.
    parts = cut_lineage(_parts(scoring_frame(predictions, stations, history)))
    limits = parts.agg(
        F.struct(*[f(name).alias(f"{label}_{name}") for name in WEIGHTS for label, f in (("low", F.min), ("high", F.max))]).alias("l")
    ).scalar()
    ranged = parts.withColumn("_l", limits)
    share = F.lit(STATUS_WEIGHT) * F.col("status")
    for name, (weight, lower_is_better) in WEIGHTS.items():
        share = share + F.lit(weight) * min_max_share(
            F.col(name), F.col(f"_l.low_{name}"), F.col(f"_l.high_{name}"), lower_is_better
        )
    return ranged.select(
        "station_id",
        F.bround(share * 100, 2).alias("score"),
        _reason().alias("reason"),
        "predicted_load",
        "peak_time",
        F.col("status").alias("_status"),
    )


def station_score(
    predictions: DataFrame | None = None,
    stations: DataFrame | None = None,
    history: DataFrame | None = None,
) -> DataFrame:
    """Score 0..100 per station, best first: weighted, min-max scaled parts plus status."""
    return _scored(predictions, stations, history).drop("_status").orderBy(F.desc("score"), "station_id")


def recommend_low_load(
    predictions: DataFrame | None = None,
    stations: DataFrame | None = None,
    history: DataFrame | None = None,
    top_n: int | None = 5,
) -> DataFrame:
    """The best-scored stations in normal status."""
    scored = _scored(predictions, stations, history).where(F.col("_status") >= 1).drop("_status")
    ranked = scored.orderBy(F.desc("score"), "station_id")
    if top_n is not None:
        ranked = ranked.limit(max(0, int(top_n)))
    return ranked.withColumn("predicted_load", F.bround("predicted_load", 6))


def enrich_with_station(recommendations: DataFrame, stations: DataFrame) -> DataFrame:
    """Add station name and address; '' where the station has none."""
    def tidy(name: str) -> Column:
        text = F.trim(F.coalesce(F.col(name), F.lit("")))
        return F.when(F.lower(text).isin("nan", "none"), "").otherwise(text).alias(name)

    facts = stations.select("station_id", "station_name", "address")
    return recommendations.join(facts, "station_id", "left").select(
        *recommendations.columns, tidy("station_name"), tidy("address")
    )


def detect_peaks(
    predictions: DataFrame,
    threshold: float = DEFAULT_THRESHOLD,
    station_thresholds: Mapping[str, float] | DataFrame | None = None,
    include_medium: bool = False,
) -> DataFrame:
    """Forecast rows at or above the threshold with their alert level, highest first.

    ``station_thresholds`` overrides the threshold of single stations, as a
    mapping or as a frame (station_id, threshold).  With ``include_medium``
    rows from 85 % of the threshold on are kept as well.
    """
    rows = _predicted(predictions)
    limit = F.lit(float(threshold))
    if isinstance(station_thresholds, DataFrame):
        own = station_thresholds.select("station_id", F.col("threshold").cast("double").alias("_own"))
        rows = rows.join(own, "station_id", "left")
        limit = F.coalesce("_own", limit)
    elif station_thresholds:
        table = F.create_map(
            *[x for k, v in station_thresholds.items() for x in (F.lit(str(k)), F.lit(float(v)))]
        )
        limit = F.coalesce(F.try_element_at(table, F.col("station_id").cast("string")), limit)
    share = F.try_divide(F.col("load"), F.col("_limit"))
    level = (
        F.when(F.col("_limit") <= 0, "high")
        .when(share >= 1.25, "critical")
        .when(share >= 1.0, "high")
        .when(share >= 0.85, "medium")
        .otherwise("low")
    )
    graded = rows.withColumn("_limit", limit).withColumn("alert_level", level)
    if include_medium:
        kept = graded.where(F.col("alert_level") != "low")
    else:
        kept = graded.where(F.col("load") >= F.col("_limit"))
    return kept.select(
        "station_id", F.col("datetime").alias("peak_time"), F.col("load").alias("predicted_load"), "alert_level"
    ).orderBy(F.desc("predicted_load"), "station_id", "peak_time")


def load_alerts(predictions: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    return detect_peaks(predictions, threshold)


# Advice texts.
ACTION_HIGH = "立即启动高峰前运维：疏导可用充电桩、提醒用户错峰充电，并检查站内设备温度和供电状态。"
ACTION_MEDIUM = "关注站点负荷上升：提前调度备用桩、通知用户选择相邻站点充电。"
ACTION_LOW = "正常运营，继续监控负荷变化并保留备用充电资源。"
NO_SPARE = "当前站点无可用备桩，建议启动跨站协同调度或引导用户前往邻近站点。"
SPARE = "当前可用桩数为 %s，建议保留至少 %d 个桩作为备用。"
ABNORMAL = "站点状态为 %s，建议优先检查设备在线状态与安全巡检。"
BUSY = "历史充电量为 %s kWh，近峰值时段已表现出较高使用强度。"


def ops_advice(
    stations: DataFrame,
    predictions: DataFrame | None = None,
    history: DataFrame | None = None,
    threshold: float = DEFAULT_THRESHOLD,
    station_id=None,
) -> DataFrame:
    """Priority and advice texts for every station, or for one.

    The peak load decides the priority; the texts depend on spare piles, status and
    past volume.  A station without forecast counts as load 0; a station that only the
    forecast knows, or that is asked for and known to neither, has no piles and an unknown status.
    """
    require_columns(stations, ["station_id"], "station data")
    if station_id is not None:
        stations = stations.where(F.col("station_id").cast("string") == str(station_id))
    devices = _number(stations, COUNT_NAMES)
    free_name = first_present(stations, FREE_NAMES)
    free = F.greatest(devices, F.lit(0.0)) if free_name is None else F.coalesce(F.col(free_name).cast("double"), F.lit(0.0))
    status_name = first_present(stations, ("station_status", "status"))
    status = F.lit("unknown") if status_name is None else F.lower(F.coalesce(F.col(status_name).cast("string"), F.lit("unknown")))
    board = stations.select(F.col("station_id").cast("string"), free.alias("free"), status.alias("state"))
    if station_id is not None:
        asked = stations.sparkSession.createDataFrame([(str(station_id),)], "station_id string")
        board = asked.join(board, "station_id", "left")
    if predictions is not None:
        ahead = _predicted(predictions).withColumn("station_id", F.col("station_id").cast("string"))
        peak = ahead.groupBy("station_id").agg(F.max("load").alias("load"))
        board = board.join(peak, "station_id", "full" if station_id is None else "left")
    else:
        board = board.withColumn("load", F.lit(0.0))
    if history is not None:
        past = aggregate_history(history)
        board = board.join(past.withColumn("station_id", F.col("station_id").cast("string")), "station_id", "left")
    else:
        board = board.withColumns({"historical_volume": F.lit(0.0), "historical_frequency": F.lit(0.0)})
    board = board.na.fill(0.0, ["free", "load", "historical_volume", "historical_frequency"]).na.fill("unknown", ["state"])

    limit = F.lit(float(threshold))
    load, volume = F.col("load"), F.col("historical_volume")
    grade = lambda high, medium, low: (
        F.when(load >= limit, high).when(load >= limit * 0.85, medium).otherwise(low)
    )
    spare = F.greatest(F.lit(1), F.floor(F.col("free") * 0.3).cast("int"))
    texts = F.array_compact(F.array(
        grade(ACTION_HIGH, ACTION_MEDIUM, ACTION_LOW),
        F.when(F.col("free") > 0, F.format_string(SPARE, F.col("free").cast("string"), spare)).otherwise(NO_SPARE),
        F.when(~F.col("state").isin(*NORMAL_STATES), F.format_string(ABNORMAL, F.col("state"))),
        F.when(
            volume > 0,
            F.format_string(BUSY, F.bround(volume, 1).cast("decimal(38,1)").cast("string")),
        ),
    ))
    return board.select(
        F.col("station_id").cast("string").alias("station_id"),
        F.bround(load, 2).alias("predicted_load"),
        limit.alias("threshold"),
        grade("high", "medium", "low").alias("priority"),
        F.bround("free", 2).alias("available_chargers"),
        F.bround(volume, 2).alias("historical_volume_kwh"),
        F.bround("historical_frequency", 2).alias("historical_frequency"),
        texts.alias("advice"),
    )
