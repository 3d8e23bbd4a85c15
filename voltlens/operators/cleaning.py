"""Typed cleaners of the five companion tables.

A table is described by its fields: how each is parsed and which parsed values
are acceptable.  A row stays if every field is acceptable; a null verdict
counts as not acceptable.  Of the rows that share a key one is kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from voltlens.functions import (
    lenient_int,
    parse_day,
    parse_wall_clock,
    require_columns,
)
from voltlens.operators.keys import one_per_key
from voltlens.sources.schemas import CORRUPT, RAW_COLUMNS, TABLE_KEYS

Check = Callable[[Column], Column]


@dataclass(frozen=True)
class Field:
    name: str
    parse: Callable[[Column], Column]
    accept: Check


def text(name: str) -> Field:
    return Field(name, F.trim, lambda value: value != "")


def choice(name: str, allowed: Iterable[str], fold: Callable[[Column], Column] = F.lower) -> Field:
    return Field(name, lambda c: fold(F.trim(c)), lambda value: value.isin(*allowed))


def moment(name: str) -> Field:
    return Field(name, parse_wall_clock, Column.isNotNull)


def day(name: str) -> Field:
    return Field(name, parse_day, Column.isNotNull)


def number(name: str, kind: str, accept: Check) -> Field:
    if kind == "int":
        return Field(name, lenient_int, accept)
    return Field(name, lambda c: F.trim(c).try_cast(kind), accept)


def within(low: float, high: float) -> Check:
    return lambda value: value.between(low, high)


def at_least(low: float) -> Check:
    return lambda value: value >= low


def above(low: float) -> Check:
    return lambda value: value > low


def _flag(name: str) -> Field:
    return number(name, "int", lambda value: value.isin(0, 1))


def clean_table(
    raw: DataFrame, table: str, fields: list[Field], across: Callable[[], Column] | None = None
) -> DataFrame:
    """Parse ``fields`` in one projection, drop unacceptable rows, keep one row per key."""
    require_columns(raw, RAW_COLUMNS[table], table)
    if CORRUPT in raw.columns:
        raw = raw.where(F.col(CORRUPT).isNull())
    typed = raw.select(*[field.parse(F.col(field.name)).alias(field.name) for field in fields])
    verdict = F.lit(True)
    for field in fields:
        verdict = verdict & field.accept(F.col(field.name))
    if across is not None:
        verdict = verdict & across()
    return one_per_key(typed, TABLE_KEYS[table], eligible=verdict)


# The choices and limits below are fixed values of the data contract.


def clean_users(raw: DataFrame) -> DataFrame:
    return clean_table(raw, "users", [
        text("user_id"),
        moment("registered_at"),
        text("city"),
        choice("member_level", ("bronze", "silver", "gold", "platinum")),
        choice("vehicle_type", ("sedan", "suv", "mpv", "commercial")),
        number("battery_capacity_kwh", "decimal(8,1)", above(0)),
        choice("preferred_platform", ("android", "ios", "web")),
        choice("registration_channel", ("app", "wechat", "station_qr", "partner")),
        choice("user_status", ("active", "inactive")),
    ])


def clean_stations(raw: DataFrame) -> DataFrame:
    return clean_table(raw, "stations", [
        text("station_id"),
        text("location_id"),
        text("station_name"),
        text("address"),
        text("city"),
        number("latitude", "double", within(-90, 90)),
        number("longitude", "double", within(-180, 180)),
        number("facility_type", "int", above(0)),
        number("device_count", "int", at_least(0)),
        text("open_time"),
        number("electricity_price_cny_kwh", "decimal(10,2)", at_least(0)),
        number("service_fee_cny_kwh", "decimal(10,2)", at_least(0)),
        choice("station_status", ("active", "inactive", "maintenance")),
        day("updated_on"),
    ])


def clean_devices(raw: DataFrame) -> DataFrame:
    return clean_table(
        raw,
        "devices",
        [
            text("device_id"),
            text("station_id"),
            text("device_code"),
            choice("charger_type", ("AC_SLOW", "DC_FAST"), fold=F.upper),
            number("rated_power_kw", "decimal(10,2)", above(0)),
            number("connector_count", "int", above(0)),
            text("manufacturer"),
            day("commissioned_at"),
            day("last_maintenance_at"),
            choice("current_status", ("online", "offline", "fault")),
        ],
        across=lambda: F.col("last_maintenance_at") >= F.col("commissioned_at"),
    )


def clean_weather(raw: DataFrame) -> DataFrame:
    return clean_table(raw, "weather_hourly", [
        text("weather_id"),
        text("location_id"),
        moment("weather_time"),
        Field("weather_type", lambda c: F.lower(F.trim(c)), lambda value: value != ""),
        text("weather_name"),
        number("temperature_c", "double", within(-80, 65)),
        number("humidity_pct", "double", within(0, 100)),
        number("precipitation_mm", "double", at_least(0)),
        number("wind_speed_mps", "double", at_least(0)),
        number("visibility_km", "double", above(0)),
        _flag("is_rain"),
    ])


MINUTES_PER_DAY = 1440
AVAILABILITY_SLACK = 1e-4


def clean_device_status(raw: DataFrame) -> DataFrame:
    def consistent() -> Column:
        online, offline = F.col("online_minutes"), F.col("offline_minutes")
        drift = F.col("availability_rate") - online / F.lit(float(MINUTES_PER_DAY))
        return (
            (online + offline == MINUTES_PER_DAY)
            & (F.col("fault_minutes") <= offline)
            & (F.abs(drift) <= AVAILABILITY_SLACK)
        )

    minutes = within(0, MINUTES_PER_DAY)
    return clean_table(
        raw,
        "device_status_log",
        [
            text("status_id"),
            text("device_id"),
            text("station_id"),
            moment("record_time"),
            number("online_minutes", "int", minutes),
            number("offline_minutes", "int", minutes),
            number("fault_minutes", "int", minutes),
            number("fault_count", "int", at_least(0)),
            number("successful_sessions", "int", at_least(0)),
            number("failed_sessions", "int", at_least(0)),
            text("primary_fault_code"),
            number("avg_output_power_kw", "double", at_least(0)),
            number("availability_rate", "double", within(0, 1)),
            number("health_score", "double", within(0, 100)),
            _flag("maintenance_flag"),
        ],
        across=consistent,
    )


CLEANERS = {
    "users": clean_users,
    "stations": clean_stations,
    "devices": clean_devices,
    "weather_hourly": clean_weather,
    "device_status_log": clean_device_status,
}
