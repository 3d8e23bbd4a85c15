"""High-load periods of a forecast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from voltlens.functions import first_present, require_columns, wall_clock

LOAD_NAMES = ("predicted_load_kwh", "prediction", "load_prediction")
HORIZON_NAMES = ("horizon_hour", "horizon")
AGGREGATES = {"sum": F.sum, "mean": F.avg, "max": F.max}


def forecast_frame(predictions: DataFrame) -> DataFrame:
    """Forecast rows under their standard names; rows without time or load are dropped."""
    load, horizon = first_present(predictions, LOAD_NAMES), first_present(predictions, HORIZON_NAMES)
    if load is None:
        require_columns(predictions, ["predicted_load_kwh"], "forecast data")
    require_columns(predictions, ["datetime"], "forecast data")
    updates = {
        "datetime": wall_clock(predictions, "datetime"),
        "predicted_load_kwh": F.col(load).try_cast("double"),
    }
    if horizon:
        updates["horizon_hour"] = F.col(horizon)
    if "station_id" not in predictions.columns:
        updates["station_id"] = F.lit("global")
    frame = predictions.withColumns(updates)
    usable = F.col("datetime").isNotNull() & F.col("predicted_load_kwh").isNotNull()
    return frame.where(usable & ~F.isnan("predicted_load_kwh"))


def _checked(top_n: int, quantile: float, aggregate: str) -> None:
    if top_n <= 0:
        raise ValueError("top_n must be positive")
    if not 0 <= quantile <= 1:
        raise ValueError("quantile must lie between 0 and 1")
    if aggregate not in AGGREGATES:
        raise ValueError("aggregate must be sum, mean or max")


SHOWN = (
    "rank", "datetime", "hour", "predicted_load_kwh", "station_count", "peak_threshold_kwh", "is_peak",
)


def peak_periods(
    predictions: DataFrame,
    top_n: int = 3,
    station_id=None,
    threshold: float | None = None,
    quantile: float = 0.9,
    aggregate: str = "sum",
    return_all: bool = False,
) -> DataFrame:
    """Rank time slots by their load over the stations and flag peaks.

    The threshold is absolute, or the quantile over all slots.  After the
    aggregate there is one row per hour of the forecast, so ranking is small;
    unless all slots are wanted, top-k runs before the ranks are numbered.
    """
    _checked(top_n, quantile, aggregate)
    frame = forecast_frame(predictions)
    if station_id is not None:
        frame = frame.where(F.col("station_id").cast("string") == str(station_id))
    slots = frame.groupBy("datetime").agg(
        AGGREGATES[aggregate]("predicted_load_kwh").alias("predicted_load_kwh"),
        F.countDistinct("station_id").alias("station_count"),
    )
    if threshold is not None:
        limit = F.lit(float(threshold))
    else:
        limit = slots.agg(F.percentile("predicted_load_kwh", F.lit(quantile)).alias("t")).scalar()
    order = [F.desc("predicted_load_kwh"), F.asc("datetime")]
    ranked = slots if return_all else slots.orderBy(*order).limit(top_n)
    return (
        ranked.withColumn("peak_threshold_kwh", limit)
        .withColumns({
            "hour": F.hour("datetime"),
            "is_peak": F.col("predicted_load_kwh") >= F.col("peak_threshold_kwh"),
            "rank": F.row_number().over(Window.orderBy(*order)),
        })
        .select(*SHOWN)
        .orderBy("rank")
    )


def peak_periods_per_station(
    predictions: DataFrame,
    top_n: int = 3,
    threshold: float | None = None,
    quantile: float = 0.9,
    aggregate: str = "sum",
    return_all: bool = False,
) -> DataFrame:
    """``peak_periods`` inside every station at once; groups are as long as the horizon."""
    _checked(top_n, quantile, aggregate)
    slots = forecast_frame(predictions).groupBy("station_id", "datetime").agg(
        AGGREGATES[aggregate]("predicted_load_kwh").alias("predicted_load_kwh"),
        F.lit(1).cast("bigint").alias("station_count"),
    )
    station = Window.partitionBy("station_id")
    limit: Column
    if threshold is not None:
        limit = F.lit(float(threshold))
    else:
        limit = F.percentile("predicted_load_kwh", F.lit(quantile)).over(station)
    order = station.orderBy(F.desc("predicted_load_kwh"), F.asc("datetime"))
    ranked = slots.withColumn("peak_threshold_kwh", limit).withColumns({
        "hour": F.hour("datetime"),
        "is_peak": F.col("predicted_load_kwh") >= F.col("peak_threshold_kwh"),
        "rank": F.row_number().over(order),
    })
    if not return_all:
        ranked = ranked.where(F.col("rank") <= top_n)
    return ranked.select("station_id", *SHOWN)
