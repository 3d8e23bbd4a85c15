"""Hourly load forecasts that feed their own predictions back.

A station's newest 24 rows are folded into one row: its latest feature values
and the array of its recent loads.  All forecast hours are then one narrow
projection on that frame, whatever the number of stations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import Column, DataFrame, functions as F

from voltlens.functions import require_columns
from voltlens.functions.clock import wall_clock
from voltlens.operators.keys import newest_rows
from voltlens.operators.linear import LinearModel
from voltlens.operators.trees import flatten
from voltlens.session import cut_lineage

# Fixed values of the forecast contract.
HORIZONS = (1, 6, 24)
HISTORY_HOURS = 24
LAGS = (1, 2, 3, 24)
FLOOR_KWH = 0.05
GLOBAL_STATION = "global"
CALENDAR = ("hour", "day", "month", "weekday_number", "is_weekend", "is_workday")


def _history(data: DataFrame, station_id) -> DataFrame:
    require_columns(data, ("datetime", "energy_kwh"), "history")
    if "station_id" not in data.columns:
        data = data.withColumn("station_id", F.lit(GLOBAL_STATION))
    if station_id is not None:
        data = data.where(F.col("station_id").cast("string") == str(station_id))
    return data.withColumns({
        "datetime": wall_clock(data, "datetime"),
        "energy_kwh": F.col("energy_kwh").try_cast("double"),
    })


def recent_history(data: DataFrame, hours: int = HISTORY_HOURS) -> DataFrame:
    """The newest ``hours`` rows of each station."""
    return newest_rows(data, ["station_id"], [F.col("datetime").desc_nulls_last()], hours)


def load_profiles(history: DataFrame) -> DataFrame:
    """One row per station: mean load by hour as a 24-entry map, and overall mean.

    Sums and counts per (station, hour) serve both means, so the history is
    aggregated once.
    """
    hour = F.col("hour").cast("int") if "hour" in history.columns else F.hour("datetime")
    cells = history.groupBy("station_id", hour.alias("_hour")).agg(
        F.sum("energy_kwh").alias("_sum"), F.count("energy_kwh").alias("_n")
    )
    mean = F.coalesce(F.try_divide(F.col("_sum"), F.col("_n").cast("double")), F.lit(0.0))
    return cells.groupBy("station_id").agg(
        F.map_from_entries(
            F.collect_list(F.when(F.col("_hour").isNotNull(), F.struct("_hour", mean)))
        ).alias("profile"),
        F.coalesce(
            F.try_divide(F.sum("_sum"), F.sum("_n").cast("double")), F.lit(0.0)
        ).alias("station_mean"),
    )


def _states(history: DataFrame, carried: Sequence[str]) -> DataFrame:
    """One row per station: newest values of ``carried`` and the loads, oldest first."""
    valid = recent_history(history).where(
        F.col("datetime").isNotNull() & F.col("energy_kwh").isNotNull()
    )
    fields = F.struct("datetime", "energy_kwh", *[c for c in carried if c not in ("datetime", "energy_kwh")])
    # At most 24 rows per station reach this list.
    folded = valid.groupBy("station_id").agg(F.array_sort(F.collect_list(fields)).alias("_rows"))
    latest = F.element_at("_rows", -1)
    return folded.select(
        "station_id",
        F.transform("_rows", lambda row: row["energy_kwh"]).alias("observed"),
        latest["datetime"].alias("datetime"),
        *[latest[name].alias(name) for name in carried if name not in ("datetime", "energy_kwh")],
        (latest["energy_kwh"] <= 0).alias("idle"),
    ).join(load_profiles(history), "station_id", "left")


def _fallback(at: Column, last: Column) -> Column:
    profiled = F.coalesce(
        F.try_element_at(F.col("profile"), F.hour(at)), F.col("station_mean"), F.lit(0.0)
    )
    return F.greatest(F.lit(0.0), F.when(F.col("idle"), profiled).otherwise(last))


def _require_station(frame: DataFrame, station_id) -> DataFrame:
    """Fail when a single requested station has no history."""
    if station_id is not None and not frame.limit(1).count():
        raise ValueError(f"no history rows for station {station_id}")
    return frame


def persistence_forecast(data: DataFrame, horizon: int, station_id=None) -> DataFrame:
    """Forecast without a model, in closed form.

    A station whose newest load is positive keeps it; an idle one follows its
    mean by hour, else its overall mean.
    """
    if horizon <= 0:
        raise ValueError("horizon must be positive")
    states = _require_station(_states(_history(data, station_id), ()), station_id)
    steps = states.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("horizon_hour"))
    at = F.col("datetime") + F.make_dt_interval(F.lit(0), F.col("horizon_hour"))
    return steps.select(
        "station_id",
        at.alias("datetime"),
        "horizon_hour",
        _fallback(at, F.element_at("observed", -1)).alias("predicted_load_kwh"),
    )


def _advance(state: DataFrame, features: Sequence[str]) -> DataFrame:
    """Move one hour on: calendar fields and lags change, everything else is carried."""
    at = F.col("datetime") + F.make_dt_interval(F.lit(0), F.lit(1))
    weekend = F.weekday(at) >= 5
    fresh = {
        "hour": F.hour(at), "day": F.dayofmonth(at), "month": F.month(at),
        "weekday_number": F.weekday(at), "is_weekend": weekend.cast("int"),
        "is_workday": (~weekend).cast("int"),
    }
    for lag in LAGS:
        value = F.when(F.size("observed") >= lag, F.element_at("observed", -lag))
        fresh.update({f"load_lag_{lag}h": value, f"lag_{lag}h": value, f"lag_{lag}": value})
    updates = {name: column for name, column in fresh.items() if name in features or name in state.columns}
    updates["datetime"] = at
    return state.withColumns(updates)


def _exported(model, features: Sequence[str]):
    """The model as one expression of its features, where it has such a form: own models and pipelines of an
    assembler and a linear or tree model."""
    if hasattr(model, "column"):
        return model
    last = model.stages[-1] if getattr(model, "stages", None) else None
    if len(getattr(model, "stages", ())) == 2 and pipeline_features(model) == list(features):
        if isinstance(last, LinearRegressionModel):
            return LinearModel(tuple(features), tuple(map(float, last.coefficients)), float(last.intercept))
        return flatten(model, features)
    return None


def _folded(model, state: DataFrame, horizon: int, features: Sequence[str]) -> DataFrame:
    """All hours in one projection per station: a fold over the hours carries the recent loads."""
    lags = {name: lag for lag in LAGS for name in (f"load_lag_{lag}h", f"lag_{lag}h", f"lag_{lag}")}

    def step(done: Column, number: Column) -> Column:
        at = F.col("datetime") + F.make_dt_interval(F.lit(0), number)
        weekend = F.weekday(at) >= 5
        fresh = {
            "hour": F.hour(at), "day": F.dayofmonth(at), "month": F.month(at), "weekday_number": F.weekday(at),
            "is_weekend": weekend.cast("int"), "is_workday": (~weekend).cast("int"),
        }
        observed = done["observed"]

        def value(name: str) -> Column:
            if name in lags:
                known = F.when(F.size(observed) >= lags[name], F.element_at(observed, -lags[name]))
            else:
                known = fresh.get(name, F.col(name))
            return F.coalesce(known.cast("double"), F.lit(0.0))

        guess = F.struct(model.column(value).alias("p"), _fallback(at, F.element_at(observed, -1)).alias("f"))
        load = F.transform(F.array(guess), lambda g: F.when(
            (g["p"] < FLOOR_KWH) & (g["f"] > 0), g["f"]).otherwise(F.greatest(F.lit(0.0), g["p"])))
        return F.get(F.transform(load, lambda kwh: F.struct(
            F.slice(F.concat(observed, F.array(kwh)), F.greatest(F.lit(-HISTORY_HOURS), -1 - F.size(observed)), F.lit(HISTORY_HOURS))
            .alias("observed"),
            F.concat(done["forecasts"], F.array(F.struct(
                at.alias("datetime"), number.alias("horizon_hour"), kwh.alias("predicted_load_kwh")))).alias("forecasts"),
        )), F.lit(0))

    start = F.struct(
        F.col("observed").alias("observed"),
        F.array().cast("array<struct<datetime:timestamp_ntz,horizon_hour:int,predicted_load_kwh:double>>").alias("forecasts"),
    )
    folded = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start, step)
    return state.select("station_id", folded["forecasts"].alias("forecasts")).select("station_id", F.inline("forecasts"))


def model_forecast(
    model, data: DataFrame, horizon: int, features: Sequence[str], station_id=None, cut_every: int = 4
) -> DataFrame:
    """Recursive forecast with a fitted model.

    Unknown features count as 0.  A prediction below the floor gives way to a positive fallback.
    Linear and tree models become one expression and all hours one projection per station.  Other
    models run hour by hour; the frame of station states is then checkpointed every ``cut_every``
    hours so that the plan does not grow with the horizon.
    """
    if horizon <= 0:
        raise ValueError("horizon must be positive")
    if model is None:
        return persistence_forecast(data, horizon, station_id)
    features = list(features)
    history = _history(data, station_id)
    computed = {f"{form}{lag}{unit}" for lag in LAGS for form, unit in (("load_lag_", "h"), ("lag_", "h"), ("lag_", ""))}
    carried = [name for name in features if name not in computed and name not in CALENDAR]
    require_columns(history, carried, "history")
    exported = _exported(model, features)
    if exported is not None:
        return _folded(exported, _require_station(_states(history, carried), station_id), horizon, features)
    state = _states(history, carried).withColumn(
        "forecasts",
        F.array().cast("array<struct<datetime:timestamp_ntz,horizon_hour:int,predicted_load_kwh:double>>"),
    )
    # One row per station, so writing it out is cheap, and each hour then plans on a scan.
    state = cut_lineage(_require_station(state, station_id))
    options = _keep_all_rows(model)
    for step in range(1, horizon + 1):
        moved = _advance(state, features)
        # The state travels beside the feature columns under a prefix; features the
        # model reads have their nulls replaced, the state keeps them.
        ready = moved.select(
            *[F.col(n).alias(f"_state_{n}") for n in state.columns],
            *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in features],
            _fallback(F.col("datetime"), F.element_at("observed", -1)).alias("_fallback"),
        )
        load = F.when(
            (F.col("prediction") < FLOOR_KWH) & (F.col("_fallback") > 0), F.col("_fallback")
        ).otherwise(F.greatest(F.lit(0.0), F.col("prediction")))
        predicted = model.transform(ready, options).select(
            *[F.col(f"_state_{n}").alias(n) for n in state.columns], load.alias("_load")
        )
        row = F.struct(
            "datetime", F.lit(step).alias("horizon_hour"), F.col("_load").alias("predicted_load_kwh")
        )
        observed = F.concat("observed", F.array("_load"))
        if step >= HISTORY_HOURS:
            observed = F.slice(observed, -HISTORY_HOURS, HISTORY_HOURS)
        # inline() of one struct keeps the optimizer from merging the steps into one
        # expression, which would double with every use of the previous prediction.
        renewed = F.struct(observed.alias("observed"), F.concat("forecasts", F.array(row)).alias("forecasts"))
        kept = [n for n in state.columns if n not in ("observed", "forecasts")]
        state = predicted.select(*kept, F.inline(F.array(renewed)))
        if step % cut_every == 0 and step < horizon:
            state = cut_lineage(state)
    return state.select("station_id", F.inline("forecasts"))


def _keep_all_rows(model) -> dict:
    """Parameters that stop assemblers from filtering rows; no feature is null here."""
    return {
        stage.handleInvalid: "keep"
        for stage in getattr(model, "stages", [])
        if isinstance(stage, VectorAssembler)
    }


def forecast(model, data: DataFrame, horizon: int, features: Sequence[str] = (), station_id=None) -> DataFrame:
    """The service edge: only 1, 6 or 24 hours."""
    if horizon not in HORIZONS:
        raise ValueError(f"horizon must be one of {HORIZONS}")
    return model_forecast(model, data, horizon, features, station_id)


def forecast_1h(data: DataFrame, model=None, features: Sequence[str] = (), station_id=None) -> DataFrame:
    return forecast(model, data, 1, features, station_id)


def forecast_6h(data: DataFrame, model=None, features: Sequence[str] = (), station_id=None) -> DataFrame:
    return forecast(model, data, 6, features, station_id)


def forecast_24h(data: DataFrame, model=None, features: Sequence[str] = (), station_id=None) -> DataFrame:
    return forecast(model, data, 24, features, station_id)


def forecast_station(data: DataFrame, station_id, model=None, features: Sequence[str] = ()) -> DataFrame:
    """24 hours of one station."""
    if station_id is None:
        raise ValueError("station_id is required")
    return forecast(model, data, 24, features, station_id)


def pipeline_features(model) -> list[str]:
    """Input columns of a model of this library, or of the assembler inside a fitted pipeline."""
    if hasattr(model, "column"):
        return list(model.features)
    for stage in getattr(model, "stages", []):
        if stage.hasParam("inputCols"):
            return list(stage.getInputCols())
    return []
