"""Charging tables derived from the TPC-H-like test tables by plain arithmetic.

events become charging orders, suppliers stations, customers users and nations
weather locations.  Only DataFrame projections and equi-joins: the work of a
query grows with its input tables.
"""

from __future__ import annotations

import math
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from voltlens.operators.quality import as_facts
from voltlens.session import tune

#: Rows of the device status log that one task makes, about.
STATUS_ROWS = 200_000
WEATHER_KINDS = ("sunny", "cloudy", "overcast", "fog", "light_rain", "heavy_rain", "snow")
WEATHER_NAMES = ("晴", "多云", "阴", "雾", "小雨", "大雨", "雪")


def _pick(values, index: str) -> str:
    return f"element_at(array({', '.join(repr(v) for v in values)}), cast(({index}) + 1 as int))"


class Dataset:
    """Charging tables over one folder of driver tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = tune(spark), folder.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _fact(self, name: str) -> DataFrame:
        """A fact table as its files are split; aggregates combine right above the scan."""
        return self.read(name)

    # ---- dimensions -------------------------------------------------------

    @cached_property
    def stations(self) -> DataFrame:
        return self.read("supplier").selectExpr(
            "s_suppkey AS station_id",
            "cast(s_nationkey AS bigint) AS location_id",
            "s_name AS station_name",
            "concat('Road ', cast(s_suppkey % 50 AS string)) AS address",
            "concat('City ', cast(s_nationkey AS string)) AS city",
            "30.0D + (s_suppkey % 97) * 0.01D AS latitude",
            "110.0D + ((s_suppkey * 7) % 89) * 0.01D AS longitude",
            "cast(1 + s_suppkey % 5 AS int) AS facility_type",
            "cast(1 + s_suppkey % 8 AS int) AS device_count",
            "'00:00-24:00' AS open_time",
            "cast((58 + s_suppkey % 35) * 0.01 AS decimal(10,2)) AS electricity_price_cny_kwh",
            "cast((18 + s_suppkey % 28) * 0.01 AS decimal(10,2)) AS service_fee_cny_kwh",
            "CASE WHEN s_suppkey % 17 = 0 THEN 'inactive' WHEN s_suppkey % 11 = 0 THEN 'maintenance'"
            " ELSE 'active' END AS station_status",
            "date_add(date'2023-01-01', cast(s_suppkey % 365 AS int)) AS updated_on",
        )

    @cached_property
    def devices(self) -> DataFrame:
        units = self.stations.selectExpr(
            "station_id", "explode(sequence(1, device_count)) AS seq"
        )
        return units.selectExpr(
            "station_id * 10 + seq AS device_id",
            "station_id",
            "concat('PILE-', cast(station_id * 10 + seq AS string)) AS device_code",
            "CASE WHEN (station_id + seq) % 2 = 0 THEN 'DC_FAST' ELSE 'AC_SLOW' END AS charger_type",
            "cast(CASE WHEN (station_id + seq) % 2 = 0 THEN "
            + _pick((60, 80, 120), "(station_id + seq) % 3") + " ELSE "
            + _pick((7, 11, 22), "(station_id + seq) % 3") + " END AS decimal(10,2)) AS rated_power_kw",
            "cast(1 + seq % 2 AS int) AS connector_count",
            "concat('Maker-', cast(seq % 4 AS string)) AS manufacturer",
            "date_add(date'2021-01-01', cast((station_id * 13 + seq * 29) % 700 AS int)) AS commissioned_at",
            "date_add(date'2021-01-01', cast((station_id * 13 + seq * 29) % 700 + (station_id + seq) % 200"
            " AS int)) AS last_maintenance_at",
            "CASE (station_id * 3 + seq) % 10 WHEN 0 THEN 'fault' WHEN 1 THEN 'offline' ELSE 'online' END"
            " AS current_status",
        )

    @cached_property
    def users(self) -> DataFrame:
        return self.read("customer").selectExpr(
            "c_custkey AS user_id",
            "timestamp_ntz'2022-01-01 00:00:00' + make_dt_interval(cast(c_custkey % 900 AS int))"
            " AS registered_at",
            "concat('City ', cast(c_nationkey AS string)) AS city",
            _pick(("bronze", "silver", "gold", "platinum"), "c_custkey % 4") + " AS member_level",
            _pick(("sedan", "suv", "mpv", "commercial"), "(c_custkey div 4) % 4") + " AS vehicle_type",
            "cast(42 + c_custkey % 60 AS decimal(8,1)) AS battery_capacity_kwh",
            _pick(("android", "ios", "web"), "c_custkey % 3") + " AS preferred_platform",
            _pick(("app", "wechat", "station_qr", "partner"), "c_custkey % 4") + " AS registration_channel",
            "CASE WHEN c_custkey % 13 = 0 THEN 'inactive' ELSE 'active' END AS user_status",
        )

    @cached_property
    def _span(self):
        """First and last hour of the events, as a scalar subquery."""
        return self.read("events").selectExpr(
            "struct(cast(date_trunc('hour', min(ts)) AS timestamp_ntz) AS first,"
            " cast(date_trunc('hour', max(ts)) AS timestamp_ntz) AS last) AS span"
        ).scalar()

    @cached_property
    def weather(self) -> DataFrame:
        hours = self.read("nation").select("n_nationkey", self._span.alias("span")).selectExpr(
            "n_nationkey",
            "span.first AS first",
            "explode(sequence(span.first, span.last, interval 1 hour)) AS weather_time",
        ).selectExpr(
            "n_nationkey", "weather_time", "hour(weather_time) AS h",
            "datediff(weather_time, first) AS d",
        ).selectExpr("*", "(n_nationkey * 31 + h + 120 * d) % 7 AS kind")
        return hours.selectExpr(
            "concat(cast(n_nationkey AS string), '-', date_format(weather_time, 'yyyyMMddHH')) AS weather_id",
            "cast(n_nationkey AS bigint) AS location_id",
            "weather_time",
            _pick(WEATHER_KINDS, "kind") + " AS weather_type",
            _pick(WEATHER_NAMES, "kind") + " AS weather_name",
            "cast(-10 + (n_nationkey * 3 + h * 2 + d * 5) % 48 AS double) AS temperature_c",
            "cast(30 + (n_nationkey * 7 + h * 3 + d) % 70 AS double) AS humidity_pct",
            "CASE kind WHEN 4 THEN 1.5D WHEN 5 THEN 8.5D WHEN 6 THEN 0.5D ELSE 0.0D END AS precipitation_mm",
            "((n_nationkey + h + d) % 20) * 0.5D AS wind_speed_mps",
            "cast(2 + (n_nationkey + h * d) % 18 AS double) AS visibility_km",
            "cast(kind IN (4, 5) AS int) AS is_rain",
        )

    # ---- facts ------------------------------------------------------------

    @cached_property
    def _sessions(self) -> DataFrame:
        """Events with their station; one equi-join, the station count is a scalar subquery."""
        count = self.read("supplier").agg(F.count("*").alias("n")).scalar()
        keyed = self._fact("events").select("*", count.alias("n")).selectExpr(
            "event_id", "ts", "user_id", "event_type",
            "cast(value AS decimal(14,3)) AS energy_kwh",
            "cast(get_json_object(props, '$.k') AS int) AS k",
            "event_id % n AS station_id",
            "event_id div n AS turn",
        )
        site = self.stations.selectExpr(
            "station_id", "location_id", "device_count",
            "electricity_price_cny_kwh + service_fee_cny_kwh AS price",
        )
        return keyed.join(site, "station_id")

    @cached_property
    def orders(self) -> DataFrame:
        """Typed charging orders under their public names."""
        timed = self._sessions.selectExpr(
            "*",
            "0.25D + (k % 32) * 0.25D AS hours",
            "weekday(ts) AS wd",
            "cast(day(ts) = 1 AS int) AS holiday",
        )
        return timed.selectExpr(
            "event_id AS session_id",
            "user_id",
            "station_id",
            "station_id * 10 + 1 + turn % device_count AS device_id",
            "location_id",
            "concat(cast(location_id AS string), '-', date_format(ts, 'yyyyMMddHH')) AS weather_id",
            "ts AS created_at",
            "ts + make_dt_interval(0, 0, cast(hours * 60 AS int)) AS ended_at",
            "hours AS charge_time_hrs",
            "hour(ts) AS start_hour",
            "wd AS weekday",
            _pick(("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"), "wd") + " AS weekday_name",
            "cast(wd >= 5 AS int) AS is_weekend",
            "holiday AS is_holiday",
            "CASE WHEN holiday = 1 THEN '元旦' ELSE '非节假日' END AS holiday_name",
            "cast(wd < 5 AND holiday = 0 AS int) AS is_workday",
            "energy_kwh",
            "cast(energy_kwh * price AS decimal(14,2)) AS fee_amount_cny",
            _pick(("android", "ios", "web"), "event_id % 3") + " AS platform",
            "CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'interrupted'"
            " ELSE 'completed' END AS order_status",
            _pick(("paid", "pending", "refunded", "waived"), "event_id % 4") + " AS payment_status",
        )

    @cached_property
    def facts(self) -> DataFrame:
        return as_facts(self.orders)

    @cached_property
    def _status_parts(self) -> int:
        days = self.read("events").selectExpr("datediff(max(ts), min(ts)) + 1 AS n").first()["n"]
        devices = self.read("supplier").selectExpr("sum(1 + s_suppkey % 8) AS n").first()["n"]
        return max(1, math.ceil((days or 0) * (devices or 0) / STATUS_ROWS))

    @cached_property
    def status(self) -> DataFrame:
        """Device status log: devices x days of the event span, exploded per device in parts of about ``STATUS_ROWS`` rows.

        The number of parts follows the rows to come: the devices alone are so small that they would be
        put into a few parts, each of which then grew with the table.
        """
        days = self.devices.repartition(self._status_parts, "device_id").select("device_id", "station_id", self._span.alias("span")).selectExpr(
            "device_id", "station_id", "to_date(span.first) AS first",
            "explode(sequence(to_date(span.first), to_date(span.last), interval 1 day)) AS stat_date",
        ).selectExpr("*", "datediff(stat_date, first) AS d").selectExpr(
            "*",
            "cast(CASE (device_id * 7 + d * 3) % 11 WHEN 0 THEN 180 WHEN 1 THEN 90 ELSE 0 END AS int) AS off",
            "cast((device_id + d) % 6 AS int) AS ok",
            "cast((device_id * 3 + d) % 3 AS int) AS bad",
        )
        return days.selectExpr(
            "concat(cast(device_id AS string), '-', date_format(stat_date, 'yyyyMMdd')) AS status_id",
            "device_id", "station_id",
            "cast(stat_date AS timestamp_ntz) + make_dt_interval(0, 23, 59) AS record_time",
            "1440 - off AS online_minutes",
            "off AS offline_minutes",
            "cast(CASE WHEN off = 180 THEN 60 ELSE 0 END AS int) AS fault_minutes",
            "cast(CASE WHEN off = 180 THEN 1 + d % 2 ELSE 0 END AS int) AS fault_count",
            "CASE WHEN off = 180 THEN 'E01' ELSE 'NONE' END AS primary_fault_code",
            "ok AS successful_sessions",
            "bad AS failed_sessions",
            "CASE WHEN ok + bad > 0 THEN 3.5D + ((device_id + d * 5) % 40) * 0.5D ELSE 0.0D END"
            " AS avg_output_power_kw",
            "(1440 - off) / 1440.0D AS availability_rate",
            "cast(60 + (device_id * 5 + d) % 41 AS double) AS health_score",
            "cast((device_id + d) % 30 = 0 AS int) AS maintenance_flag",
        )

    # table name -> attribute
    TABLES = {
        "charging_orders": "orders", "users": "users", "stations": "stations", "devices": "devices",
        "weather_hourly": "weather", "device_status_log": "status",
    }

    def table(self, name: str) -> DataFrame:
        return getattr(self, self.TABLES[name])

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.table(name) for name in self.TABLES}

    # ---- raw text copies with damage --------------------------------------

    def _texts(self, df: DataFrame) -> DataFrame:
        def text(name: str, kind: str):
            if kind.startswith("timestamp"):
                return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)
            return F.col(name).cast("string").alias(name)

        return df.select(*[text(n, k) for n, k in df.dtypes])

    @cached_property
    def raw_orders(self) -> DataFrame:
        """Text copy of the orders, damaged by ``session_id % 97``."""
        text = self._texts(self.orders).withColumn("m", F.expr("cast(session_id AS bigint) % 97"))
        damage = {
            "session_id": "CASE m WHEN 1 THEN '  ' WHEN 6 THEN cast(cast(session_id AS bigint) - 1 AS string)"
                          " ELSE session_id END",
            "energy_kwh": "CASE m WHEN 2 THEN concat('-', energy_kwh) WHEN 7 THEN NULL ELSE energy_kwh END",
            "created_at": "CASE m WHEN 3 THEN '2024-13-40 00:00:00' WHEN 14 THEN"
                          " concat(cast(cast(substr(created_at, 9, 2) AS int) AS string), '/',"
                          " cast(cast(substr(created_at, 6, 2) AS int) AS string), '/',"
                          " substr(created_at, 1, 4), ' ', substr(created_at, 12, 5)) ELSE created_at END",
            "ended_at": "CASE m WHEN 15 THEN '2020-01-01 00:00:00' WHEN 14 THEN"
                        " concat(cast(cast(substr(ended_at, 9, 2) AS int) AS string), '/',"
                        " cast(cast(substr(ended_at, 6, 2) AS int) AS string), '/',"
                        " substr(ended_at, 1, 4), ' ', substr(ended_at, 12, 5)) ELSE ended_at END",
            "start_hour": "CASE m WHEN 4 THEN cast((cast(start_hour AS int) + 1) % 24 AS string)"
                          " WHEN 23 THEN '24' WHEN 24 THEN concat(start_hour, '.0') ELSE start_hour END",
            "device_id": "CASE m WHEN 5 THEN '-1' WHEN 25 THEN '1' ELSE device_id END",
            "fee_amount_cny": "CASE m WHEN 8 THEN 'abc' ELSE fee_amount_cny END",
            "weekday_name": "CASE m WHEN 9 THEN 'Xyz' WHEN 26 THEN 'Mon' ELSE weekday_name END",
            "platform": "CASE m WHEN 10 THEN 'console' WHEN 22 THEN concat(' ', upper(platform), ' ')"
                        " ELSE platform END",
            "user_id": "CASE m WHEN 11 THEN '999999999' ELSE user_id END",
            "station_id": "CASE m WHEN 12 THEN '888888888' ELSE station_id END",
            "location_id": "CASE m WHEN 13 THEN cast(cast(location_id AS int) + 1 AS string) ELSE location_id END",
            "weekday": "CASE m WHEN 27 THEN '9' ELSE weekday END",
            "is_weekend": "CASE m WHEN 17 THEN '7' WHEN 19 THEN cast(1 - cast(is_weekend AS int) AS string)"
                          " ELSE is_weekend END",
            "payment_status": "CASE m WHEN 18 THEN 'unknown' ELSE payment_status END",
            "charge_time_hrs": "CASE m WHEN 20 THEN '30' ELSE charge_time_hrs END",
            "holiday_name": "CASE m WHEN 21 THEN '' ELSE holiday_name END",
            "weather_id": "CASE m WHEN 28 THEN 'none' ELSE weather_id END",
        }
        columns = [f"{damage[n]} AS {n}" if n in damage else n for n in self.orders.columns]
        return text.selectExpr(*columns, "CASE m WHEN 16 THEN 'broken line' END AS _corrupt_record")

    def raw_copy(self, table: str) -> DataFrame:
        """Text copy of a companion table with one damaged field in some rows."""
        damage = {
            "users": ("user_id", "member_level",
                      "CASE m WHEN 0 THEN 'diamond' WHEN 1 THEN concat(' ', upper(member_level)) ELSE member_level END"),
            "stations": ("station_id", "latitude",
                         "CASE m WHEN 0 THEN '95.0' WHEN 1 THEN 'north' ELSE latitude END"),
            "devices": ("device_id", "last_maintenance_at",
                        "CASE m WHEN 0 THEN '2001-01-01' WHEN 1 THEN '2024/01/01' ELSE last_maintenance_at END"),
            "weather_hourly": ("location_id", "humidity_pct",
                               "CASE WHEN m = 0 AND is_rain = '1' THEN '130' ELSE humidity_pct END"),
            "device_status_log": ("device_id", "online_minutes",
                                  "CASE m WHEN 0 THEN '1441' WHEN 1 THEN concat(online_minutes, '.0') ELSE online_minutes END"),
        }
        key, field, damaged = damage[table]
        text = self._texts(self.table(table))
        with_class = text.withColumn("m", F.expr(f"cast({key} AS bigint) % 7"))
        return with_class.selectExpr(
            *[f"{damaged} AS {n}" if n == field else n for n in text.columns]
        )

    def raw_doubled(self, table: str) -> DataFrame:
        """The damaged copy together with a second copy of every row (repeated keys)."""
        copy = self.raw_copy(table)
        return copy.unionByName(copy)

    # ---- operational tables ----------------------------------------------

    @cached_property
    def op_stations(self) -> DataFrame:
        return self.stations.selectExpr(
            "station_id AS id", "station_name AS name", "address", "longitude", "latitude",
            "electricity_price_cny_kwh + service_fee_cny_kwh AS price", "device_count AS pile_count",
        )

    @cached_property
    def op_piles(self) -> DataFrame:
        return self.devices.selectExpr(
            "device_id AS id", "station_id", "device_code AS code", "charger_type AS type",
            "rated_power_kw AS power",
            "CASE WHEN current_status = 'fault' THEN '故障' WHEN device_id % 3 = 0 THEN '在用'"
            " ELSE '闲置' END AS status",
        )

    @cached_property
    def op_users(self) -> DataFrame:
        return self.read("customer").selectExpr(
            "c_custkey AS id", "concat('138', lpad(cast(c_custkey AS string), 8, '0')) AS phone",
            "c_name AS nickname", "cast(NULL AS string) AS avatar_path",
            "cast(c_acctbal AS decimal(14,2)) AS balance",
            "CASE WHEN c_custkey % 13 = 0 THEN '冻结' ELSE '正常' END AS status",
            "timestamp_ntz'2022-01-01 00:00:00' + make_dt_interval(cast(c_custkey % 900 AS int)) AS created_at",
        )

    @cached_property
    def op_orders(self) -> DataFrame:
        count = self.read("supplier").agg(F.count("*").alias("n")).scalar()
        keyed = self._fact("orders").select("*", count.alias("n")).selectExpr(
            "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate",
            "cast(o_totalprice AS decimal(14,2)) AS total",
            "o_orderkey % n AS site", "o_orderkey div n AS turn",
        )
        # device_count is 1 + station % 8, so the pile follows from the key without a join
        return keyed.selectExpr(
            "o_orderkey AS id", "o_custkey AS user_id",
            "site * 10 + 1 + turn % (1 + site % 8) AS pile_id",
            "o_orderdate AS start_time",
            "CASE WHEN o_orderstatus <> 'O' THEN o_orderdate"
            " + make_dt_interval(0, 0, cast(20 + o_orderkey % 300 AS int), 30) END AS end_time",
            "CASE WHEN o_orderstatus <> 'O' THEN cast(total / 1000 AS decimal(14,2)) END AS amount",
            "CASE WHEN o_orderstatus <> 'O' THEN total END AS fee",
            "CASE o_orderstatus WHEN 'F' THEN '已结算' WHEN 'P' THEN '待结算' ELSE '充电中' END AS status",
        )

    @cached_property
    def as_of(self):
        """Newest order day, as a scalar subquery."""
        return self.read("orders").selectExpr("to_date(max(o_orderdate)) AS day").scalar()

    @cached_property
    def logins(self) -> DataFrame:
        return self.read("events").selectExpr(
            "event_id AS id", "concat('138', lpad(cast(user_id AS string), 8, '0')) AS phone",
            "ts AS login_time", "concat('10.0.0.', cast(event_id % 250 AS string)) AS ip_address",
        )

    @cached_property
    def operations(self) -> DataFrame:
        return self.read("events").selectExpr(
            "event_id AS id", "cast(user_id % 5 AS int) AS operator_id", "'admin' AS operator_type",
            "event_type AS operation_type",
            _pick(("users", "stations", "piles", "orders"), "event_id % 4") + " AS target_table",
            "user_id AS target_id", "props AS content", "ts AS operation_time",
        )

    @cached_property
    def routes(self) -> DataFrame:
        """Route rows from line items: distance and time by arithmetic, some implausible."""
        return self.read("lineitem").selectExpr(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
            "cast(CASE WHEN l_partkey % 31 = 0 THEN 0 ELSE l_quantity * 1000 END AS int) AS distance_meters",
            "cast(CASE WHEN l_partkey % 29 = 0 THEN 0 WHEN l_partkey % 23 = 0 THEN 30"
            " ELSE l_quantity * 90 END AS int) AS duration_seconds",
            "CASE WHEN l_partkey % 37 = 0 THEN '' ELSE 'p' END AS polyline",
            "30.0D + (l_suppkey % 97) * 0.01D AS origin_lat",
            "110.0D + (l_suppkey % 89) * 0.01D AS origin_lng",
            "30.0D + (l_partkey % 97) * 0.01D AS dest_lat",
            "110.0D + (l_partkey % 89) * 0.01D AS dest_lng",
        )
