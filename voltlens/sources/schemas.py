"""Raw table layouts.

Every raw column is nullable text.  Parsing happens in the operators, where a
bad value can still be reported, so the reader never turns one into null.
"""

from __future__ import annotations

from pyspark.sql import types as T

CORRUPT = "_corrupt_record"

# Table and column names of the data contract, in file order.
RAW_COLUMNS: dict[str, tuple[str, ...]] = {
    "charging_orders": (
        "session_id", "user_id", "station_id", "device_id", "location_id", "weather_id",
        "created_at", "ended_at", "charge_time_hrs", "start_hour", "weekday", "weekday_name",
        "is_weekend", "is_holiday", "holiday_name", "is_workday", "energy_kwh",
        "fee_amount_cny", "platform", "order_status", "payment_status",
    ),
    "users": (
        "user_id", "registered_at", "city", "member_level", "vehicle_type",
        "battery_capacity_kwh", "preferred_platform", "registration_channel", "user_status",
    ),
    "stations": (
        "station_id", "location_id", "station_name", "address", "city", "latitude", "longitude",
        "facility_type", "device_count", "open_time", "electricity_price_cny_kwh",
        "service_fee_cny_kwh", "station_status", "updated_on",
    ),
    "devices": (
        "device_id", "station_id", "device_code", "charger_type", "rated_power_kw",
        "connector_count", "manufacturer", "commissioned_at", "last_maintenance_at",
        "current_status",
    ),
    "weather_hourly": (
        "weather_id", "location_id", "weather_time", "weather_type", "weather_name",
        "temperature_c", "humidity_pct", "precipitation_mm", "wind_speed_mps", "visibility_km",
        "is_rain",
    ),
    "device_status_log": (
        "status_id", "device_id", "station_id", "record_time", "online_minutes",
        "offline_minutes", "fault_minutes", "fault_count", "primary_fault_code",
        "successful_sessions", "failed_sessions", "avg_output_power_kw", "availability_rate",
        "health_score", "maintenance_flag",
    ),
}

# The key of each table.
TABLE_KEYS = {
    "charging_orders": "session_id",
    "users": "user_id",
    "stations": "station_id",
    "devices": "device_id",
    "weather_hourly": "weather_id",
    "device_status_log": "status_id",
}


def raw_schema(table: str) -> T.StructType:
    """Schema of one raw table: its columns as text plus the corrupt-record column."""
    names = (*RAW_COLUMNS[table], CORRUPT)
    return T.StructType([T.StructField(name, T.StringType(), True) for name in names])
