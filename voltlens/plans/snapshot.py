"""Snapshot of the result tables for a front end.

Each section is a set of JSON rows.  Sections such as stations and users grow
with the data, so they are written as JSON lines, one folder per section,
rather than gathered into one document.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voltlens.session import side_by_side

# Section name -> (table, sort columns, single row).
SECTIONS: dict[str, tuple[str, tuple[str, ...], bool]] = {
    "overview": ("ads/overall_charging_kpis", (), True),
    "userSummary": ("ads/user_summary_kpis", (), True),
    "stations": ("dws/station_kpis", (), False),
    "users": ("dws/user_kpis", (), False),
    "devices": ("dws/device_kpis", (), False),
    "weekdays": ("dws/weekday_patterns", ("start_weekday",), False),
    "holidays": ("dws/holiday_patterns", (), False),
    "weatherImpact": ("dws/weather_impact", (), False),
    "deviceOperations": ("dws/device_operation_kpis", (), False),
    "hourlyDistribution": ("dws/hourly_distribution", ("hour",), False),
    "weekdayHeatmap": ("dws/weekday_heatmap", ("hour", "weekday"), False),
    "sessionCountTrend": ("dws/session_count_trend", ("start_date",), False),
    "stationRanking": ("dws/station_ranking", (), False),
    "stationDistribution": ("dws/station_distribution", (), False),
    "quality": ("ads/data_quality", (), False),
}


def json_ready(df: DataFrame) -> DataFrame:
    """Decimals as doubles, dates and times as ISO text; other columns unchanged."""
    def ready(name: str, kind: str) -> Column:
        column = F.col(name)
        if kind.startswith("decimal"):
            column = column.cast("double")
        elif kind == "date":
            column = F.date_format(column, "yyyy-MM-dd")
        elif kind.startswith("timestamp"):
            column = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")
        return column.alias(name)

    return df.select(*[ready(name, kind) for name, kind in df.dtypes])


def _json_value(name: str, kind: str) -> Column:
    """A column as JSON text; numbers of any size in plain digits, without an exponent."""
    column = F.col(name)
    listed = F.to_json(F.array(column), {"ignoreNullFields": "false"})
    text = F.substr(listed, F.lit(2), F.length(listed) - 2)
    if kind == "double":
        digits = F.regexp_replace(column.try_cast("decimal(38,18)").cast("string"), "(\\.[0-9]+?)0*$", "$1")
        text = F.when(text.contains("E"), F.coalesce(digits, text)).otherwise(text)
    return F.coalesce(F.when(column.isNotNull(), text), F.lit("null"))


def section_rows(sections: Mapping[str, DataFrame]) -> DataFrame:
    """(section, payload) with one JSON object per row of every section."""
    def rows(name: str, df: DataFrame) -> DataFrame:
        ready = json_ready(df)
        fields = [F.concat(F.lit(json.dumps(n, ensure_ascii=False) + ":"), _json_value(n, kind)) for n, kind in ready.dtypes]
        return ready.select(
            F.lit(name).alias("section"), F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")).alias("payload")
        )

    return reduce(DataFrame.unionByName, [rows(name, df) for name, df in sections.items()])


def snapshot_sections(spark: SparkSession, warehouse_root: str) -> dict[str, DataFrame]:
    """The fifteen sections read from the result tables, re-sorted where order matters."""
    root = warehouse_root.rstrip("/")
    sections = {}
    for name, (table, order, _) in SECTIONS.items():
        frame = spark.read.parquet(f"{root}/{table}")
        sections[name] = frame.orderBy(*order) if order else frame
    return sections


def write_snapshot(spark: SparkSession, warehouse_root: str, target: str) -> str:
    """Write every section as JSON lines under ``target`` and a manifest beside them."""
    target = target.rstrip("/")

    def write(name: str, frame: DataFrame) -> None:
        json_ready(frame).write.mode("overwrite").json(f"{target}/{name}", ignoreNullFields=False)

    side_by_side(spark, [partial(write, *item) for item in snapshot_sections(spark, warehouse_root).items()])
    manifest = spark.range(0, 1, 1, 1).select(
        F.lit(0).alias("code"),
        F.lit("ok").alias("msg"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("generatedAt"),
        F.array(*[
            F.struct(F.lit(name).alias("section"), F.lit(single).alias("single"))
            for name, (_, _, single) in SECTIONS.items()
        ]).alias("sections"),
    )
    manifest.write.mode("overwrite").json(f"{target}/manifest")
    return target
