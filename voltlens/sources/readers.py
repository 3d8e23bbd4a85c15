"""CSV readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from voltlens.sources.schemas import CORRUPT, RAW_COLUMNS, raw_schema

RAW_TABLES = tuple(RAW_COLUMNS)


def read_raw(spark: SparkSession, table: str, path: str) -> DataFrame:
    """One raw table with its source file and load time on every row.

    Malformed lines stay in the result with their text in ``_corrupt_record``.
    """
    if not (path or "").strip():
        raise ValueError(f"no input path given for {table}")
    lines = spark.read.csv(
        path,
        schema=raw_schema(table),
        header=True,
        encoding="UTF-8",
        mode="PERMISSIVE",
        columnNameOfCorruptRecord=CORRUPT,
    )
    return lines.select(
        *lines.columns,
        F.col("_metadata.file_path").alias("_source_file"),
        F.current_timestamp().alias("_ingested_at"),
    )


def read_inferred_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with inferred types and header names freed of spaces; empty rows dropped."""
    frame = spark.read.csv(path, header=True, inferSchema=True, encoding="UTF-8")
    return frame.toDF(*[name.strip() for name in frame.columns]).na.drop(how="all")


def read_part_csv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A directory of CSV parts in which any part may repeat the header line.

    Spark drops one header line per file; lines that repeat the header further
    down are recognised by ``datetime`` holding its own name.  With ``schema``
    given, columns are read as text first and cast after the header lines went.
    """
    text = spark.read.csv(path, header=True, encoding="UTF-8")
    if "datetime" in text.columns:
        text = text.where(~F.col("datetime").eqNullSafe("datetime"))
    if schema is None:
        return text
    return text.select(
        *[F.col(field.name).try_cast(field.dataType).alias(field.name) for field in schema.fields]
    )


def read_typed_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
