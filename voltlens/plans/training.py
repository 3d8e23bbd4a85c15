"""Feature table, models and forecasts as jobs.

    python -m voltlens.plans.training features --input-root RAW --output OUT
    python -m voltlens.plans.training train    --input OUT --model-output MODEL
    python -m voltlens.plans.training forecast --input OUT --model MODEL --output PRED
    python -m voltlens.plans.training peaks    --input PRED_CSV --output PEAKS
"""

from __future__ import annotations

import argparse

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from voltlens.operators.cleaning import CLEANERS
from voltlens.operators.features import select_features, station_hour_dataset
from voltlens.operators.forecast import HORIZONS, forecast, pipeline_features
from voltlens.operators.integrity import validate_tables
from voltlens.operators.peaks import peak_periods
from voltlens.operators.models import load_model, save_model, train_models
from voltlens.operators.quality import clean_orders, rejected_count
from voltlens.plans.warehouse import checked_orders
from voltlens.session import build_session
from voltlens.sources import RAW_TABLES, read_part_csv, read_raw, write_table


def clean_inputs(spark: SparkSession, input_root: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """The six cleaned tables and the checked orders they came from."""
    raw = {t: read_raw(spark, t, f"{input_root.rstrip('/')}/{t}.csv") for t in RAW_TABLES}
    tables = {name: cleaner(raw[name]) for name, cleaner in CLEANERS.items()}
    checked = checked_orders(raw["charging_orders"], tables)
    return {**tables, "charging_orders": clean_orders(checked)}, checked


def validation_report(tables: dict[str, DataFrame], checked: DataFrame) -> DataFrame:
    """The table report with the number of rejected orders attached."""
    rejected = rejected_count(checked).select(
        F.lit("rejected").alias("section"),
        F.lit("charging_orders").alias("table_name"),
        F.lit("rejected_order_rows").alias("item"),
        F.col("rejected_order_rows").alias("value"),
    )
    return validate_tables(tables).unionByName(rejected)


def build_features(
    spark: SparkSession, input_root: str, output: str, fmt: str = "csv", mode: str = "overwrite"
) -> DataFrame:
    """Write the station-hour feature table and, beside it, its validation report."""
    tables, checked = clean_inputs(spark, input_root)
    checked = checked.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        tables["charging_orders"] = clean_orders(checked)
        write_table(validation_report(tables, checked), f"{output}.report", mode="overwrite", files=1)
        write_table(select_features(station_hour_dataset(tables)), output, fmt=fmt, mode=mode)
    finally:
        checked.unpersist()
    return read_features(spark, output) if fmt == "csv" else spark.read.parquet(output)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Feature CSV with its known types: no inference pass, ids stay text."""
    text = read_part_csv(spark, path)
    keys = {"station_id", "location_id"}
    return text.select(*[
        F.col(n) if n in keys
        else F.col(n).try_cast("timestamp_ntz").alias(n) if n == "datetime"
        else F.col(n).try_cast("double").alias(n)
        for n in text.columns
    ])


def write_forecast(rows: DataFrame, path: str, horizon: int, station_id=None) -> str:
    """Store a forecast under its horizon; a lookup by horizon reads one folder."""
    if station_id is not None:
        rows = rows.where(F.col("station_id").cast("string") == str(station_id))
    return write_table(rows, f"{path.rstrip('/')}/horizon={int(horizon)}")


def lookup_forecast(spark: SparkSession, path: str, horizon: int, station_id=None) -> DataFrame:
    """Stored forecast of one horizon, for all stations or one.

    Raises ``ValueError`` when nothing is stored for the requested station.
    """
    if horizon not in HORIZONS:
        raise ValueError(f"horizon must be one of {HORIZONS}")
    rows = spark.read.parquet(path).where(F.col("horizon") == int(horizon)).drop("horizon")
    if station_id is not None:
        rows = rows.where(F.col("station_id").cast("string") == str(station_id))
        if not rows.limit(1).count():
            raise ValueError(f"no history rows for station {station_id}")
    return rows.where(F.col("datetime").isNotNull())


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(description=__doc__)
    jobs = parser.add_subparsers(dest="job", required=True)
    job = jobs.add_parser("features")
    job.add_argument("--input-root", required=True)
    job.add_argument("--output", required=True)
    job.add_argument("--mode", choices=("overwrite", "append", "error", "ignore"), default="overwrite")
    job = jobs.add_parser("train")
    job.add_argument("--input", required=True)
    job.add_argument("--model-output", required=True)
    job.add_argument("--models", default="random_forest,boosted_trees")
    job.add_argument("--num-trees", type=int, default=30)
    job.add_argument("--max-depth", type=int, default=10)
    job.add_argument("--demand-weight", type=float, default=40.0)
    job = jobs.add_parser("forecast")
    job.add_argument("--input", required=True)
    job.add_argument("--model", default=None)
    job.add_argument("--horizon", type=int, choices=HORIZONS, default=24)
    job.add_argument("--station-id", default=None)
    job.add_argument("--output", required=True)
    job = jobs.add_parser("peaks")
    job.add_argument("--input", required=True, help="forecast CSV")
    job.add_argument("--output", required=True)
    job.add_argument("--top-n", type=int, default=3)
    job.add_argument("--station-id", default=None)
    return parser


def write_peaks(spark: SparkSession, source: str, path: str, top_n: int = 3, station_id=None) -> str:
    """Rank the peak periods of a stored forecast, optionally of one station, and store them."""
    rows = read_features(spark, source)
    if station_id is not None:
        rows = rows.where(F.col("station_id").cast("string") == str(station_id))
    return write_table(peak_periods(rows, top_n=top_n), path)


def main(argv=None) -> None:
    args = _parser().parse_args(argv)
    spark = build_session(f"voltlens-{args.job}")
    if args.job == "features":
        build_features(spark, args.input_root, args.output, mode=args.mode)
    elif args.job == "train":
        trained = train_models(
            read_features(spark, args.input),
            [name.strip() for name in args.models.split(",") if name.strip()],
            options={
                "random_forest": {"numTrees": args.num_trees, "maxDepth": args.max_depth},
                "boosted_trees": {"maxIter": args.num_trees, "maxDepth": args.max_depth},
                "xgboost": {"n_estimators": args.num_trees, "max_depth": args.max_depth},
            },
            weight=args.demand_weight,
        )
        for name, item in trained.models.items():
            print(name, item.rows, item.validation_metrics, item.test_metrics)
        print("best:", trained.best_name, "failures:", trained.failures)
        save_model(trained.best.model, args.model_output)
    elif args.job == "peaks":
        write_peaks(spark, args.input, args.output, args.top_n, args.station_id)
    else:
        model = load_model(args.model) if args.model else None
        rows = forecast(
            model, read_features(spark, args.input), args.horizon,
            pipeline_features(model) if model else (), args.station_id,
        )
        write_forecast(rows, args.output, args.horizon)
    spark.stop()


if __name__ == "__main__":
    main()
