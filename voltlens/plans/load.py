"""Raw CSV -> cleaned table, one job per table.

    python -m voltlens.plans.load --input-root RAW --output-root OUT [--format csv|parquet]
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from voltlens.operators.cleaning import CLEANERS
from voltlens.operators.quality import clean_orders, trim_text_columns
from voltlens.session import build_session
from voltlens.sources import RAW_TABLES, read_raw, write_table
from voltlens.sources.writers import MODES

TABLE_CLEANERS = {"charging_orders": clean_orders, **CLEANERS}


def load_table(
    spark: SparkSession,
    table: str,
    source: str,
    target: str,
    fmt: str = "csv",
    mode: str = "overwrite",
    files: int | None = None,
) -> DataFrame:
    """Read, trim, clean and write one table; returns the cleaned frame."""
    cleaned = TABLE_CLEANERS[table](trim_text_columns(read_raw(spark, table, source)))
    write_table(cleaned, target, fmt=fmt, mode=mode, files=files)
    return cleaned


def load_all(spark: SparkSession, input_root: str, output_root: str, fmt: str = "csv", **options) -> None:
    for table in RAW_TABLES:
        load_table(
            spark, table,
            f"{input_root.rstrip('/')}/{table}.csv",
            f"{output_root.rstrip('/')}/{table}.{fmt}",
            fmt=fmt, **options,
        )


def parse_args(argv=None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--input-root", required=True)
    parser.add_argument("--output-root", required=True)
    parser.add_argument("--format", choices=("csv", "parquet"), default="csv")
    parser.add_argument("--mode", choices=MODES, default="overwrite")
    parser.add_argument("--partitions", type=int, default=None)
    return parser.parse_args(argv)


def main(argv=None) -> None:
    args = parse_args(argv)
    spark = build_session("voltlens-load")
    load_all(spark, args.input_root, args.output_root, args.format, mode=args.mode, files=args.partitions)
    spark.stop()


if __name__ == "__main__":
    main()
