"""SQL counterparts of the registered queries, written for DuckDB.

They share no code with the operators.  Energy and fees are kept as whole
thousandths and cents, so that sums are exact and rounding half up is integer
arithmetic; results are given as doubles and text, as ``portable`` gives them.
"""

from __future__ import annotations

import re

BASE: dict[str, str] = {}
ORACLE: dict[str, str] = {}


def oracle(name: str, body: str) -> None:
    """Register ``body``, preceded by the base tables it names, directly or indirectly."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for table in BASE:
            if table not in needed and re.search(rf"\b{table}\b", text):
                visit(BASE[table])
                if table not in needed:
                    needed.append(table)

    visit(body)
    body = body.strip()
    tables = [f"{table} AS MATERIALIZED ({BASE[table].strip()})" for table in needed]
    if body.upper().startswith("WITH "):
        body = body[5:]
        ORACLE[name] = "WITH " + ",\n".join([*tables, body])
    elif tables:
        ORACLE[name] = "WITH " + ",\n".join(tables) + "\n" + body
    else:
        ORACLE[name] = body


def half_up(top: str, bottom: str, digits: int) -> str:
    """``top / bottom`` as whole units, rounded half up, over 10^digits; for values >= 0."""
    return (
        f"CAST((2 * CAST({top} AS HUGEINT) + {bottom}) // (2 * ({bottom})) AS DOUBLE) / 1e{digits}"
    )


def day_text(expression: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d')"


def time_text(expression: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S')"


# ---- base tables ----------------------------------------------------------

BASE["stations"] = """
SELECT s_suppkey AS station_id, CAST(s_nationkey AS BIGINT) AS location_id, s_name AS station_name,
  'Road ' || (s_suppkey % 50) AS address, 'City ' || s_nationkey AS city,
  CAST(30 AS DOUBLE) + CAST(s_suppkey % 97 AS DOUBLE) * CAST(0.01 AS DOUBLE) AS latitude,
  CAST(110 AS DOUBLE) + CAST((s_suppkey * 7) % 89 AS DOUBLE) * CAST(0.01 AS DOUBLE) AS longitude,
  CAST(1 + s_suppkey % 5 AS INTEGER) AS facility_type, CAST(1 + s_suppkey % 8 AS INTEGER) AS device_count,
  58 + s_suppkey % 35 AS price_c, 18 + s_suppkey % 28 AS service_c,
  CASE WHEN s_suppkey % 17 = 0 THEN 'inactive' WHEN s_suppkey % 11 = 0 THEN 'maintenance' ELSE 'active' END AS station_status,
  DATE '2023-01-01' + CAST(s_suppkey % 365 AS INTEGER) AS updated_on
FROM supplier"""

BASE["devices"] = """
SELECT station_id * 10 + seq AS device_id, station_id, 'PILE-' || (station_id * 10 + seq) AS device_code,
  CASE WHEN (station_id + seq) % 2 = 0 THEN 'DC_FAST' ELSE 'AC_SLOW' END AS charger_type,
  CASE WHEN (station_id + seq) % 2 = 0 THEN [60, 80, 120][(station_id + seq) % 3 + 1]
       ELSE [7, 11, 22][(station_id + seq) % 3 + 1] END AS rated_power_kw,
  CAST(1 + seq % 2 AS INTEGER) AS connector_count, 'Maker-' || (seq % 4) AS manufacturer,
  DATE '2021-01-01' + CAST((station_id * 13 + seq * 29) % 700 AS INTEGER) AS commissioned_at,
  DATE '2021-01-01' + CAST((station_id * 13 + seq * 29) % 700 + (station_id + seq) % 200 AS INTEGER) AS last_maintenance_at,
  CASE (station_id * 3 + seq) % 10 WHEN 0 THEN 'fault' WHEN 1 THEN 'offline' ELSE 'online' END AS current_status
FROM (SELECT station_id, unnest(generate_series(1, device_count)) AS seq FROM stations)"""

BASE["members"] = """
SELECT c_custkey AS user_id, TIMESTAMP '2022-01-01' + to_days(CAST(c_custkey % 900 AS INTEGER)) AS registered_at,
  'City ' || c_nationkey AS city,
  ['bronze', 'silver', 'gold', 'platinum'][c_custkey % 4 + 1] AS member_level,
  ['sedan', 'suv', 'mpv', 'commercial'][(c_custkey // 4) % 4 + 1] AS vehicle_type,
  42 + c_custkey % 60 AS battery_capacity_kwh,
  ['android', 'ios', 'web'][c_custkey % 3 + 1] AS preferred_platform,
  ['app', 'wechat', 'station_qr', 'partner'][c_custkey % 4 + 1] AS registration_channel,
  CASE WHEN c_custkey % 13 = 0 THEN 'inactive' ELSE 'active' END AS user_status
FROM customer"""

BASE["span"] = "SELECT date_trunc('hour', min(ts)) AS first_hour, date_trunc('hour', max(ts)) AS last_hour FROM events"

BASE["weather"] = """
SELECT n_nationkey || '-' || strftime(weather_time, '%Y%m%d%H') AS weather_id,
  CAST(n_nationkey AS BIGINT) AS location_id, weather_time,
  ['sunny', 'cloudy', 'overcast', 'fog', 'light_rain', 'heavy_rain', 'snow'][kind + 1] AS weather_type,
  ['晴', '多云', '阴', '雾', '小雨', '大雨', '雪'][kind + 1] AS weather_name,
  CAST(-10 + (n_nationkey * 3 + h * 2 + d * 5) % 48 AS DOUBLE) AS temperature_c,
  CAST(30 + (n_nationkey * 7 + h * 3 + d) % 70 AS DOUBLE) AS humidity_pct,
  CAST(CASE kind WHEN 4 THEN 1.5 WHEN 5 THEN 8.5 WHEN 6 THEN 0.5 ELSE 0 END AS DOUBLE) AS precipitation_mm,
  CAST((n_nationkey + h + d) % 20 AS DOUBLE) * 0.5 AS wind_speed_mps,
  CAST(2 + (n_nationkey + h * d) % 18 AS DOUBLE) AS visibility_km,
  CAST(kind IN (4, 5) AS INTEGER) AS is_rain
FROM (SELECT *, (n_nationkey * 31 + h + 120 * d) % 7 AS kind FROM (
  SELECT n_nationkey, weather_time, hour(weather_time) AS h,
    date_diff('day', CAST(first_hour AS DATE), CAST(weather_time AS DATE)) AS d
  FROM (SELECT n_nationkey, first_hour, unnest(generate_series(first_hour, last_hour, INTERVAL 1 HOUR)) AS weather_time
        FROM nation, span)))"""

BASE["charges"] = """
SELECT event_id AS session_id, user_id, station_id,
  station_id * 10 + 1 + turn % device_count AS device_id, location_id,
  location_id || '-' || strftime(ts, '%Y%m%d%H') AS weather_id,
  ts AS created_at, ts + to_minutes(15 * (1 + k % 32)) AS ended_at,
  0.25 * CAST(1 + k % 32 AS DOUBLE) AS charge_time_hrs, CAST(hour(ts) AS INTEGER) AS start_hour,
  CAST(hour(ts + to_minutes(15 * (1 + k % 32))) AS INTEGER) AS end_hour,
  CAST(isodow(ts) - 1 AS INTEGER) AS weekday,
  ['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'][isodow(ts)] AS weekday_name,
  CAST(isodow(ts) >= 6 AS INTEGER) AS is_weekend, CAST(day(ts) = 1 AS INTEGER) AS is_holiday,
  CASE WHEN day(ts) = 1 THEN '元旦' ELSE '非节假日' END AS holiday_name,
  CAST(isodow(ts) < 6 AND day(ts) <> 1 AS INTEGER) AS is_workday,
  e_m, (e_m * (price_c + service_c) + 500) // 1000 AS f_c,
  ['android', 'ios', 'web'][event_id % 3 + 1] AS platform,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'interrupted' ELSE 'completed' END AS order_status,
  ['paid', 'pending', 'refunded', 'waived'][event_id % 4 + 1] AS payment_status,
  CAST(ts AS DATE) AS start_date, date_trunc('hour', ts) AS at_hour
FROM (SELECT event_id, ts, user_id, event_type, CAST(round(value * 1000) AS BIGINT) AS e_m,
        CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_id % n AS sid, event_id // n AS turn
      FROM events, (SELECT count(*) AS n FROM supplier))
JOIN stations ON stations.station_id = sid"""

BASE["status_log"] = """
SELECT device_id || '-' || strftime(stat_date, '%Y%m%d') AS status_id, device_id, station_id, stat_date,
  stat_date + INTERVAL 23 HOUR + INTERVAL 59 MINUTE AS record_time,
  1440 - off AS online_minutes, off AS offline_minutes,
  CASE WHEN off = 180 THEN 60 ELSE 0 END AS fault_minutes,
  CASE WHEN off = 180 THEN 1 + d % 2 ELSE 0 END AS fault_count,
  CASE WHEN off = 180 THEN 'E01' ELSE 'NONE' END AS primary_fault_code,
  ok AS successful_sessions, bad AS failed_sessions,
  CASE WHEN ok + bad > 0 THEN CAST(3.5 AS DOUBLE) + CAST((device_id + d * 5) % 40 AS DOUBLE) * 0.5 ELSE 0.0 END AS avg_output_power_kw,
  CAST(1440 - off AS DOUBLE) / 1440 AS availability_rate,
  CAST(60 + (device_id * 5 + d) % 41 AS DOUBLE) AS health_score,
  CAST((device_id + d) % 30 = 0 AS INTEGER) AS maintenance_flag
FROM (SELECT *, CASE (device_id * 7 + d * 3) % 11 WHEN 0 THEN 180 WHEN 1 THEN 90 ELSE 0 END AS off,
        (device_id + d) % 6 AS ok, (device_id * 3 + d) % 3 AS bad
      FROM (SELECT device_id, station_id, CAST(g AS DATE) AS stat_date,
              date_diff('day', CAST(first_hour AS DATE), CAST(g AS DATE)) AS d
            FROM (SELECT device_id, station_id, first_hour,
                    unnest(generate_series(date_trunc('day', first_hour), date_trunc('day', last_hour), INTERVAL 1 DAY)) AS g
                  FROM devices, span)))"""

BASE["depots"] = """
SELECT station_id AS id, station_name AS name, address, longitude, latitude,
  price_c + service_c AS tariff_c, device_count AS pile_count FROM stations"""

BASE["piles"] = """
SELECT device_id AS id, station_id, device_code AS code, charger_type AS type, rated_power_kw AS power,
  CASE WHEN current_status = 'fault' THEN '故障' WHEN device_id % 3 = 0 THEN '在用' ELSE '闲置' END AS status
FROM devices"""

BASE["accounts"] = """
SELECT c_custkey AS id, '138' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS phone, c_name AS nickname,
  CAST(NULL AS VARCHAR) AS avatar_path, CAST(CAST(c_acctbal AS DECIMAL(14,2)) AS DOUBLE) AS balance,
  CASE WHEN c_custkey % 13 = 0 THEN '冻结' ELSE '正常' END AS status,
  TIMESTAMP '2022-01-01' + to_days(CAST(c_custkey % 900 AS INTEGER)) AS created_at
FROM customer"""

BASE["bills"] = """
SELECT o_orderkey AS id, o_custkey AS user_id, site * 10 + 1 + turn % (1 + site % 8) AS pile_id,
  o_orderdate AS start_time,
  CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + to_seconds(60 * (20 + o_orderkey % 300) + 30) END AS end_time,
  CASE WHEN o_orderstatus <> 'O' THEN CAST((c + 500) // 1000 AS DOUBLE) / 100 END AS amount,
  CASE WHEN o_orderstatus <> 'O' THEN c END AS fee_c,
  CASE o_orderstatus WHEN 'F' THEN '已结算' WHEN 'P' THEN '待结算' ELSE '充电中' END AS status
FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS c, o_orderkey % n AS site, o_orderkey // n AS turn
      FROM orders, (SELECT count(*) AS n FROM supplier))"""

BASE["logins"] = """
SELECT event_id AS id, '138' || lpad(CAST(user_id AS VARCHAR), 8, '0') AS phone, ts AS login_time,
  '10.0.0.' || (event_id % 250) AS ip_address FROM events"""

BASE["actions"] = """
SELECT event_id AS id, CAST(user_id % 5 AS INTEGER) AS operator_id, 'admin' AS operator_type,
  event_type AS operation_type, ['users', 'stations', 'piles', 'orders'][event_id % 4 + 1] AS target_table,
  user_id AS target_id, props AS content, ts AS operation_time FROM events"""

BASE["station_hours"] = """
SELECT station_id, location_id, unnest(generate_series(first_hour, last_hour, INTERVAL 1 HOUR)) AS datetime
FROM stations, span"""

BASE["hour_load"] = """
SELECT station_id, at_hour AS datetime, sum(e_m) AS e_m FROM charges GROUP BY ALL"""

BASE["dense_load"] = """
SELECT g.station_id, g.datetime, coalesce(l.e_m, 0) AS e_m, CAST(coalesce(l.e_m, 0) AS DOUBLE) / 1000 AS kwh
FROM station_hours g LEFT JOIN hour_load l ON l.station_id = g.station_id AND l.datetime = g.datetime"""

BASE["predicted"] = """
SELECT s.station_id, s.last_hour + to_hours(CAST(h AS INTEGER)) AS datetime, CAST(h AS INTEGER) AS horizon_hour,
  CASE WHEN s.kwh > 0 THEN s.kwh
       ELSE greatest(0.0, coalesce(p.mean, s.mean, 0.0)) END AS load
FROM (SELECT station_id, max(datetime) AS last_hour, arg_max(kwh, datetime) AS kwh,
        CAST(sum(e_m) AS DOUBLE) / 1000 / count(*) AS mean FROM dense_load GROUP BY station_id) s
CROSS JOIN generate_series(1, 24) AS t(h)
LEFT JOIN (SELECT station_id, hour(datetime) AS hr, CAST(sum(e_m) AS DOUBLE) / 1000 / count(*) AS mean
           FROM dense_load GROUP BY ALL) p
  ON p.station_id = s.station_id AND p.hr = hour(s.last_hour + to_hours(CAST(h AS INTEGER)))"""

# ---- raw text copies ------------------------------------------------------

_DAY_FIRST = "(CAST(day({0}) AS VARCHAR) || '/' || month({0}) || '/' || year({0}) || ' ' || strftime({0}, '%H:%M'))"

BASE["raw_orders"] = f"""
SELECT
  CASE m WHEN 1 THEN '  ' WHEN 6 THEN CAST(session_id - 1 AS VARCHAR) ELSE CAST(session_id AS VARCHAR) END AS session_id,
  CASE m WHEN 11 THEN '999999999' ELSE CAST(user_id AS VARCHAR) END AS user_id,
  CASE m WHEN 12 THEN '888888888' ELSE CAST(station_id AS VARCHAR) END AS station_id,
  CASE m WHEN 5 THEN '-1' WHEN 25 THEN '1' ELSE CAST(device_id AS VARCHAR) END AS device_id,
  CASE m WHEN 13 THEN CAST(location_id + 1 AS VARCHAR) ELSE CAST(location_id AS VARCHAR) END AS location_id,
  CASE m WHEN 28 THEN 'none' ELSE weather_id END AS weather_id,
  CASE m WHEN 3 THEN '2024-13-40 00:00:00' WHEN 14 THEN {_DAY_FIRST.format('created_at')} ELSE {time_text('created_at')} END AS created_at,
  CASE m WHEN 15 THEN '2020-01-01 00:00:00' WHEN 14 THEN {_DAY_FIRST.format('ended_at')} ELSE {time_text('ended_at')} END AS ended_at,
  CASE m WHEN 20 THEN '30' ELSE CAST(charge_time_hrs AS VARCHAR) END AS charge_time_hrs,
  CASE m WHEN 4 THEN CAST((start_hour + 1) % 24 AS VARCHAR) WHEN 23 THEN '24' WHEN 24 THEN start_hour || '.0'
    ELSE CAST(start_hour AS VARCHAR) END AS start_hour,
  CASE m WHEN 27 THEN '9' ELSE CAST(weekday AS VARCHAR) END AS weekday,
  CASE m WHEN 9 THEN 'Xyz' WHEN 26 THEN 'Mon' ELSE weekday_name END AS weekday_name,
  CASE m WHEN 17 THEN '7' WHEN 19 THEN CAST(1 - is_weekend AS VARCHAR) ELSE CAST(is_weekend AS VARCHAR) END AS is_weekend,
  CAST(is_holiday AS VARCHAR) AS is_holiday,
  CASE m WHEN 21 THEN '' ELSE holiday_name END AS holiday_name,
  CAST(is_workday AS VARCHAR) AS is_workday,
  CASE m WHEN 2 THEN '-' || energy WHEN 7 THEN NULL ELSE energy END AS energy_kwh,
  CASE m WHEN 8 THEN 'abc' ELSE fee END AS fee_amount_cny,
  CASE m WHEN 10 THEN 'console' WHEN 22 THEN ' ' || upper(platform) || ' ' ELSE platform END AS platform,
  order_status,
  CASE m WHEN 18 THEN 'unknown' ELSE payment_status END AS payment_status,
  CASE m WHEN 16 THEN 'broken line' END AS _corrupt_record
FROM (SELECT *, session_id % 97 AS m, printf('%d.%03d', e_m // 1000, e_m % 1000) AS energy,
        printf('%d.%02d', f_c // 100, f_c % 100) AS fee FROM charges)"""


def _moment(column: str) -> str:
    return (
        f"coalesce(try_strptime(trim({column}), '%Y-%m-%d %H:%M:%S'),"
        f" try_strptime(trim({column}), '%d/%m/%Y %H:%M'))"
    )


def _whole(column: str) -> str:
    return rf"try_cast(regexp_replace(trim({column}), '^([+-]?\d+)\.\d*$', '\1') AS INTEGER)"


BASE["parsed"] = f"""
SELECT *, date_diff('second', c_at, e_at) / 3600.0 AS actual_hrs, CAST(isodow(c_at) - 1 AS INTEGER) AS wd_time
FROM (SELECT *, {_moment('created_at')} AS c_at, {_moment('ended_at')} AS e_at,
  try_cast(trim(energy_kwh) AS DECIMAL(14,3)) AS energy, try_cast(trim(fee_amount_cny) AS DECIMAL(14,2)) AS fee,
  try_cast(trim(charge_time_hrs) AS DOUBLE) AS hrs, {_whole('start_hour')} AS sh, {_whole('weekday')} AS wd,
  nullif(list_position(['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'], trim(weekday_name)), 0) - 1 AS wd_name,
  {_whole('is_weekend')} AS we, {_whole('is_holiday')} AS ho, {_whole('is_workday')} AS wo,
  row_number() OVER (PARTITION BY trim(session_id) ORDER BY {_moment('created_at')} NULLS LAST,
    {_moment('ended_at')} NULLS LAST, trim(station_id) NULLS LAST) AS place
FROM raw_orders)"""

_BLANK = "(coalesce(trim({0}), '') = '')"
_RULES: list[tuple[str, str]] = [("_corrupt_record IS NOT NULL", "corrupt_csv_row")]
_RULES += [(_BLANK.format(f"{o}_id"), f"missing_{o}_id") for o in "session user station device location weather".split()]
for _field, _value in (("energy_kwh", "energy"), ("fee_amount_cny", "fee")):
    _RULES += [
        (_BLANK.format(_field), f"missing_{_field}"),
        (f"NOT {_BLANK.format(_field)} AND {_value} IS NULL", f"invalid_{_field}_type"),
        (f"{_value} < 0", f"negative_{_field}"),
    ]
for _field, _value in (("created_at", "c_at"), ("ended_at", "e_at")):
    _RULES += [
        (_BLANK.format(_field), f"missing_{_field}"),
        (f"NOT {_BLANK.format(_field)} AND {_value} IS NULL", f"invalid_{_field}"),
    ]
_RULES += [
    ("e_at <= c_at", "ended_not_after_created"),
    ("hrs IS NULL OR hrs <= 0 OR hrs > 24", "invalid_charge_duration"),
    ("abs(actual_hrs - hrs) > 0.02", "charge_duration_mismatch"),
    ("sh IS NULL OR sh NOT BETWEEN 0 AND 23", "invalid_start_hour"),
    ("hour(c_at) <> sh", "start_hour_mismatch"),
    ("wd IS NULL OR wd NOT BETWEEN 0 AND 6", "invalid_weekday"),
    ("wd_name IS NULL", "invalid_weekday_name"),
    ("wd <> wd_name", "weekday_name_mismatch"),
    ("wd <> wd_time", "weekday_timestamp_mismatch"),
    ("we IS NULL OR we NOT IN (0, 1)", "invalid_is_weekend"),
    ("ho IS NULL OR ho NOT IN (0, 1)", "invalid_is_holiday"),
    ("wo IS NULL OR wo NOT IN (0, 1)", "invalid_is_workday"),
    ("we <> CASE WHEN wd >= 5 THEN 1 ELSE 0 END AND wd IS NOT NULL", "weekend_flag_mismatch"),
    (_BLANK.format("holiday_name"), "missing_holiday_name"),
    (f"{_BLANK.format('platform')} OR lower(trim(platform)) NOT IN ('android', 'ios', 'web')", "invalid_platform"),
    (f"{_BLANK.format('order_status')} OR lower(trim(order_status)) NOT IN ('completed', 'interrupted', 'failed')", "invalid_order_status"),
    (f"{_BLANK.format('payment_status')} OR lower(trim(payment_status)) NOT IN ('paid', 'pending', 'refunded', 'waived')", "invalid_payment_status"),
    (f"NOT {_BLANK.format('session_id')} AND place > 1", "duplicate_session_id"),
]


def _reason_list(rules: list[tuple[str, str]]) -> str:
    cases = ", ".join(f"CASE WHEN {condition} THEN '{name}' END" for condition, name in rules)
    return f"[x FOR x IN [{cases}] IF x IS NOT NULL]"


BASE["checked"] = f"SELECT *, {_reason_list(_RULES)} AS own_issues FROM parsed"

BASE["raw_users"] = """
SELECT CAST(user_id AS VARCHAR) AS user_id, registered_at, city,
  CASE user_id % 7 WHEN 0 THEN 'diamond' WHEN 1 THEN ' ' || upper(member_level) ELSE member_level END AS member_level,
  vehicle_type, CAST(battery_capacity_kwh AS DOUBLE) AS battery_capacity_kwh, preferred_platform, registration_channel, user_status
FROM members"""

BASE["raw_stations"] = """
SELECT * REPLACE (CAST(station_id AS VARCHAR) AS station_id, CAST(location_id AS VARCHAR) AS location_id,
  CASE station_id % 7 WHEN 0 THEN '95.0' WHEN 1 THEN 'north' ELSE CAST(latitude AS VARCHAR) END AS latitude) FROM stations"""

BASE["raw_devices"] = """
SELECT * REPLACE (CAST(device_id AS VARCHAR) AS device_id, CAST(station_id AS VARCHAR) AS station_id,
  CASE device_id % 7 WHEN 0 THEN '2001-01-01' WHEN 1 THEN '2024/01/01'
    ELSE strftime(last_maintenance_at, '%Y-%m-%d') END AS last_maintenance_at) FROM devices"""

BASE["good_weather"] = """
SELECT * FROM weather WHERE NOT (location_id % 7 = 0 AND is_rain = 1)"""

_REFERENCE_RULES = [
    (f"NOT {_BLANK.format('c.user_id')} AND u.user_id IS NULL", "unknown_user_id"),
    (f"NOT {_BLANK.format('c.station_id')} AND s.station_id IS NULL", "unknown_station_id"),
    ("s.station_id IS NOT NULL AND trim(c.location_id) <> s.location_id", "station_location_mismatch"),
    (f"NOT {_BLANK.format('c.device_id')} AND d.device_id IS NULL", "unknown_device_id"),
    ("d.device_id IS NOT NULL AND trim(c.station_id) <> d.station_id", "device_station_mismatch"),
    (f"NOT {_BLANK.format('c.weather_id')} AND w.weather_id IS NULL", "unknown_weather_id"),
    ("w.weather_id IS NOT NULL AND trim(c.location_id) <> CAST(w.location_id AS VARCHAR)", "weather_location_mismatch"),
    ("w.weather_id IS NOT NULL AND date_trunc('hour', c_at) <> w.weather_time", "weather_time_mismatch"),
]
BASE["referenced"] = f"""
SELECT c.*, list_concat(own_issues, {_reason_list(_REFERENCE_RULES)}) AS issues
FROM checked c LEFT JOIN raw_users u ON trim(c.user_id) = u.user_id
LEFT JOIN raw_stations s ON trim(c.station_id) = s.station_id
LEFT JOIN raw_devices d ON trim(c.device_id) = d.device_id
LEFT JOIN good_weather w ON trim(c.weather_id) = w.weather_id"""

# ---- warehouse metrics ----------------------------------------------------

_KWH = "CAST(sum(e_m) AS DOUBLE) / 1000"
_FEES = "CAST(sum(f_c) AS DOUBLE) / 100"
_AVG_KWH = half_up("sum(e_m)", "count(*)", 3)
_AVG_HRS = "round(avg(charge_time_hrs), 4)"
_SESSIONS = "count(DISTINCT session_id)"

oracle("overall_kpis", f"""
SELECT {_SESSIONS} AS total_charging_sessions, {_KWH} AS total_kwh, {_FEES} AS total_charging_fees,
  {_AVG_HRS} AS avg_charge_time_hrs, {half_up('sum(e_m)', _SESSIONS, 3)} AS avg_kwh_per_session FROM charges""")

BASE["per_station"] = f"""
SELECT station_id, station_name, device_count, coalesce(n, 0) AS charging_sessions,
  CAST(coalesce(e, 0) AS DOUBLE) / 1000 AS total_kwh, CAST(coalesce(f, 0) AS DOUBLE) / 100 AS total_charging_fees,
  h AS avg_charge_time_hrs, round(CAST(coalesce(n, 0) AS DOUBLE) / device_count, 3) AS sessions_per_device,
  {half_up('coalesce(e, 0)', 'device_count', 3)} AS kwh_per_device,
  {half_up('coalesce(f, 0)', 'device_count', 2)} AS charging_fees_per_device
FROM stations LEFT JOIN (SELECT station_id AS sid, {_SESSIONS} AS n, sum(e_m) AS e, sum(f_c) AS f, {_AVG_HRS} AS h
  FROM charges GROUP BY ALL) ON sid = station_id"""
oracle("station_kpis", "SELECT * FROM per_station")
oracle("rank_stations_by_energy", "SELECT * FROM per_station ORDER BY total_kwh DESC, station_id LIMIT 10")
oracle("rank_stations_by_sessions", "SELECT * FROM per_station ORDER BY charging_sessions DESC, station_id LIMIT 10")

oracle("user_kpis", f"""
SELECT user_id, {_SESSIONS} AS charging_sessions, {_KWH} AS total_kwh, {_FEES} AS total_charging_fees,
  {_AVG_KWH} AS avg_kwh_per_session, {_AVG_HRS} AS avg_charge_time_hrs FROM charges GROUP BY user_id""")
oracle("user_summary", f"""
SELECT count(*) AS total_users, round(avg(n), 3) AS avg_sessions_per_user,
  {half_up('sum(e)', 'count(*)', 3)} AS avg_kwh_per_user
FROM (SELECT user_id, {_SESSIONS} AS n, sum(e_m) AS e FROM charges GROUP BY user_id)""")
oracle("weekday_patterns", f"""
SELECT CAST(w AS INTEGER) AS start_weekday, ['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'][w + 1] AS weekday_name,
  coalesce(n, 0) AS charging_sessions, coalesce(e, 0) AS total_kwh, coalesce(a, 0) AS avg_kwh_per_session
FROM range(7) AS t(w) LEFT JOIN (SELECT weekday, {_SESSIONS} AS n, {_KWH} AS e, {_AVG_KWH} AS a
  FROM charges GROUP BY weekday) ON weekday = w""")
oracle("holiday_patterns", f"""
SELECT CASE WHEN is_holiday = 1 THEN 'holiday' WHEN is_workday = 1 THEN 'workday' ELSE 'non_holiday_rest_day' END AS day_type,
  is_holiday, holiday_name, is_workday, is_weekend, {_SESSIONS} AS charging_sessions, {_KWH} AS total_kwh,
  {_FEES} AS total_charging_fees, {_AVG_KWH} AS avg_kwh_per_session, {_AVG_HRS} AS avg_charge_time_hrs
FROM charges GROUP BY ALL""")


def _hours_of_day(where: str) -> str:
    return f"""
SELECT CAST(h AS INTEGER) AS hour, coalesce(n, 0) AS charging_sessions
FROM range(24) AS t(h) LEFT JOIN (SELECT start_hour, {_SESSIONS} AS n FROM charges WHERE {where} GROUP BY ALL) ON start_hour = h"""


oracle("hourly_distribution", _hours_of_day("true"))
oracle("filtered_hourly", _hours_of_day("weekday = 2"))
oracle("weekday_hour_heatmap", f"""
SELECT CAST(h AS INTEGER) AS hour, CAST(w AS INTEGER) AS weekday, coalesce(n, 0) AS charging_sessions,
  '[' || h || ',' || w || ',' || coalesce(n, 0) || ']' AS echarts_value
FROM range(24) AS a(h), range(7) AS b(w)
LEFT JOIN (SELECT start_hour, weekday AS wd, {_SESSIONS} AS n FROM charges GROUP BY ALL) ON start_hour = h AND wd = w""")
oracle("session_trend", f"""
SELECT {day_text('start_date')} AS start_date, {_SESSIONS} AS charging_sessions FROM charges GROUP BY ALL""")
oracle("station_distribution", """
SELECT station_id, station_name, address, location_id, facility_type, device_count, latitude, longitude FROM stations""")
oracle("device_kpis", f"""
WITH seen AS (SELECT date_diff('day', min(start_date), max(start_date)) + 1 AS days FROM charges)
SELECT device_id, station_id, device_code, charger_type, CAST(rated_power_kw AS DOUBLE) AS rated_power_kw, connector_count,
  manufacturer, current_status, coalesce(n, 0) AS charging_sessions, coalesce(dn, 0) AS charging_days,
  coalesce(e, 0) AS total_kwh, coalesce(h, 0) AS total_charging_hours, a AS avg_kwh_per_session, p AS avg_output_power_kw,
  round(coalesce(h, 0) / (days * 24.0), 6) AS charging_time_utilization_rate, CAST(days AS INTEGER) AS observation_days
FROM devices CROSS JOIN seen LEFT JOIN (SELECT device_id AS did, {_SESSIONS} AS n, count(DISTINCT start_date) AS dn,
    {_KWH} AS e, round(sum(charge_time_hrs), 3) AS h, {_AVG_KWH} AS a,
    round(avg(CAST(e_m AS DOUBLE) / 1000 / charge_time_hrs), 3) AS p
  FROM charges GROUP BY ALL) ON did = device_id""")
oracle("device_operation_kpis", """
SELECT d.device_id, s.station_id, device_code, charger_type, CAST(rated_power_kw AS DOUBLE) AS rated_power_kw, current_status,
  s.* EXCLUDE (did, station_id)
FROM devices d LEFT JOIN (SELECT device_id AS did, station_id, count(DISTINCT stat_date) AS observed_days,
  CAST(sum(online_minutes) AS BIGINT) AS online_minutes, CAST(sum(offline_minutes) AS BIGINT) AS offline_minutes,
  CAST(sum(fault_minutes) AS BIGINT) AS fault_minutes, CAST(sum(fault_count) AS BIGINT) AS fault_count,
  CAST(sum(successful_sessions) AS BIGINT) AS successful_sessions, CAST(sum(failed_sessions) AS BIGINT) AS failed_sessions,
  CAST(sum(maintenance_flag) AS BIGINT) AS maintenance_days,
  round(sum(online_minutes) / sum(online_minutes + offline_minutes), 6) AS availability_rate,
  CASE WHEN sum(successful_sessions + failed_sessions) > 0 THEN
    round(sum(avg_output_power_kw * (successful_sessions + failed_sessions)) / sum(successful_sessions + failed_sessions), 3)
  END AS avg_output_power_kw,
  round(avg(health_score), 3) AS avg_health_score, round(min(health_score), 3) AS min_health_score
  FROM status_log GROUP BY ALL) s ON did = d.device_id""")
oracle("weather_impact", f"""
SELECT x.weather_type, x.weather_name, x.is_rain, station_hours, coalesce(n, 0) AS charging_sessions,
  round(coalesce(n, 0) * 1000.0 / station_hours, 3) AS sessions_per_1000_station_hours,
  coalesce(e, 0) AS total_kwh, coalesce(f, 0) AS total_charging_fees, a AS avg_kwh_per_session, h AS avg_charge_time_hrs,
  avg_temperature_c, avg_humidity_pct, avg_precipitation_mm, avg_wind_speed_mps, avg_visibility_km
FROM (SELECT weather_type, weather_name, is_rain, count(*) AS station_hours, round(avg(temperature_c), 3) AS avg_temperature_c,
    round(avg(humidity_pct), 3) AS avg_humidity_pct, round(avg(precipitation_mm), 3) AS avg_precipitation_mm,
    round(avg(wind_speed_mps), 3) AS avg_wind_speed_mps, round(avg(visibility_km), 3) AS avg_visibility_km
  FROM weather w JOIN stations s ON s.location_id = w.location_id GROUP BY ALL) x
LEFT JOIN (SELECT weather_type, weather_name, is_rain, {_SESSIONS} AS n, {_KWH} AS e, {_FEES} AS f, {_AVG_KWH} AS a, {_AVG_HRS} AS h
  FROM charges JOIN weather USING (weather_id) GROUP BY ALL) u
ON u.weather_type = x.weather_type AND u.weather_name = x.weather_name AND u.is_rain = x.is_rain""")

# ---- dashboard metrics ----------------------------------------------------

BASE["recent_week"] = """
SELECT * FROM charges WHERE created_at >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY"""
oracle("recent_orders", f"SELECT session_id, {time_text('created_at')} AS created_at FROM recent_week")

_REVENUE = """
SELECT CAST(coalesce(sum(f_c) FILTER (start_date = CAST(newest AS DATE)), 0) AS DOUBLE) / 100 AS revenue_today,
  CAST(coalesce(sum(f_c) FILTER (created_at >= newest - INTERVAL 30 DAY), 0) AS DOUBLE) / 100 AS revenue_30d,
  CAST(coalesce(sum(f_c), 0) AS DOUBLE) / 100 AS revenue_total
FROM charges, (SELECT max(ts) AS newest FROM events)"""
oracle("recent_revenue_totals", _REVENUE)
for _name, _value, _alias in (
    ("volume", _KWH, "energy_kwh"), ("revenue", _FEES, "revenue"), ("count", "count(*)", '"count"'),
):
    oracle(f"recent_{_name}_trend", f"""
SELECT {day_text('start_date')} AS date, {_value} AS {_alias} FROM recent_week GROUP BY ALL""")
oracle("recent_hourly_energy", f"""
SELECT CAST(h AS INTEGER) AS hour, coalesce(e, 0) AS energy_kwh, coalesce(n, 0) AS sessions
FROM range(24) AS t(h) LEFT JOIN (SELECT start_hour, {_KWH} AS e, count(*) AS n FROM recent_week GROUP BY ALL) ON start_hour = h""")
oracle("recent_heatmap_counts", """
SELECT CAST(w AS INTEGER) AS weekday, CAST(h AS INTEGER) AS hour, coalesce(n, 0) AS count
FROM range(7) AS a(w), range(24) AS b(h)
LEFT JOIN (SELECT start_hour, weekday AS wd, count(*) AS n FROM recent_week GROUP BY ALL) ON start_hour = h AND wd = w""")
oracle("recent_user_metrics", """
SELECT count(*) AS active_users, round_even(CAST(sum(e) AS DOUBLE) / 1000 / count(*), 3) AS avg_energy_per_user_kwh,
  round_even(avg(n), 3) AS avg_sessions_per_user
FROM (SELECT user_id, sum(e_m) AS e, count(*) AS n FROM recent_week GROUP BY user_id)""")
oracle("recent_weekday_energy", f"""
SELECT weekday_name AS weekday, {_KWH} AS energy_kwh FROM recent_week GROUP BY ALL""")
oracle("recent_weather_sessions", f"""
SELECT weather_type, weather_name, count(*) AS sessions, {_KWH} AS energy_kwh, {_FEES} AS fee_cny,
  round_even(avg(temperature_c), 3) AS avg_temp_c, round_even(avg(precipitation_mm), 3) AS avg_precip_mm
FROM recent_week JOIN weather USING (weather_id) GROUP BY ALL""")
oracle("recent_overview", f"""
SELECT count(*) AS total_sessions, {_KWH} AS total_energy_kwh, any_value(r.revenue_today) AS revenue_today,
  any_value(r.revenue_30d) AS revenue_30d, any_value(r.revenue_total) AS revenue_total,
  count(DISTINCT station_id) AS active_stations, count(DISTINCT user_id) AS active_users,
  round_even(avg(charge_time_hrs), 3) AS avg_duration_hrs,
  round_even(CAST(sum(f_c) AS DOUBLE) / 100 / count(*), 3) AS avg_order_fee_cny,
  CAST(floor(date_diff('microsecond', min(created_at), max(created_at)) / 86400e6) + 1 AS INTEGER) AS span_days
FROM charges, ({_REVENUE}) r""")

BASE["online_shares"] = """
SELECT s.station_id, station_name AS name, device_count AS pile_count,
  CAST(round_even(device_count * coalesce(rate, 0) / 100.0, 0) AS INTEGER) AS free_pile_count,
  round_even(coalesce(rate, 0), 1) AS online_rate
FROM stations s LEFT JOIN (SELECT station_id, avg(CAST(current_status = 'online' AS INTEGER)) * 100 AS rate
  FROM devices GROUP BY ALL) r ON r.station_id = s.station_id"""
oracle("station_online", "SELECT * FROM online_shares")
oracle("recent_station_ranking", f"""
SELECT c.station_id, station_name, {_KWH} AS energy_kwh, count(*) AS sessions, {_FEES} AS revenue_cny
FROM charges c JOIN stations USING (station_id)
WHERE created_at >= (SELECT max(ts) FROM events) - INTERVAL 30 DAY
GROUP BY ALL ORDER BY energy_kwh DESC, c.station_id LIMIT 10""")
oracle("station_board", """
SELECT s.station_id, station_name, address, city, latitude, longitude, device_count, station_status,
  o.name, o.pile_count, o.free_pile_count, o.online_rate
FROM stations s JOIN online_shares o ON o.station_id = s.station_id""")
oracle("device_status_by_station", """
SELECT station_id, round_even(avg(availability_rate), 4) AS avg_availability, CAST(sum(fault_count) AS BIGINT) AS total_faults,
  CAST(sum(successful_sessions) AS BIGINT) AS successful_sessions, CAST(sum(failed_sessions) AS BIGINT) AS failed_sessions,
  round_even(avg(health_score), 4) AS avg_health
FROM status_log WHERE record_time >= (SELECT max(record_time) FROM status_log) - INTERVAL 7 DAY GROUP BY ALL""")


def _daily(kept: str) -> str:
    return f"""
WITH kept AS ({kept}), ends AS (SELECT min(start_date) AS a, max(start_date) AS b FROM kept)
SELECT {day_text('day')} AS date, CAST(coalesce(sum(e_m), 0) AS DOUBLE) / 1000 AS energy_kwh,
  count(session_id) AS sessions, CAST(coalesce(sum(f_c), 0) AS DOUBLE) / 100 AS revenue
FROM (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM ends)
LEFT JOIN kept ON start_date = day GROUP BY day"""


oracle("filtered_daily", _daily("SELECT * FROM charges WHERE weekday = 2"))
oracle("filtered_by_weather", _daily(
    "SELECT * FROM charges WHERE weather_id IN (SELECT weather_id FROM weather WHERE weather_type = 'fog')"))
oracle("filtered_totals", f"""
SELECT {_KWH} AS total_energy_kwh, count(*) AS total_sessions, {_FEES} AS total_revenue FROM charges WHERE is_holiday = 1""")
oracle("device_status_counts", """
SELECT label, coalesce(n, 0) AS count FROM (VALUES ('online', '在用'), ('idle', '闲置'), ('fault', '故障')) AS t(state, label)
LEFT JOIN (SELECT current_status, count(*) AS n FROM devices GROUP BY ALL) ON current_status = state""")
oracle("ops_bundle", f"""
SELECT 'revenue' AS section, CAST(to_json(r) AS VARCHAR) AS payload FROM ({_REVENUE}) r
UNION ALL SELECT 'revenue_trend', CAST(to_json(t) AS VARCHAR) FROM (SELECT {day_text('start_date')} AS date, {_FEES} AS revenue FROM recent_week GROUP BY ALL) t
UNION ALL SELECT 'pile_status', CAST(to_json(p) AS VARCHAR) FROM (SELECT label, coalesce(n, 0) AS count FROM (VALUES ('online', '在用'), ('idle', '闲置'), ('fault', '故障')) AS v(state, label)
  LEFT JOIN (SELECT current_status, count(*) AS n FROM devices GROUP BY ALL) ON current_status = state) p
UNION ALL SELECT 'stations', CAST(to_json(o) AS VARCHAR) FROM (SELECT * FROM online_shares) o""")

# ---- operational reports --------------------------------------------------

BASE["newest_day"] = "SELECT CAST(max(o_orderdate) AS DATE) AS today FROM orders"
BASE["settled"] = "SELECT *, CAST(end_time AS DATE) AS end_day FROM bills WHERE status = '已结算'"
oracle("revenue_to_date", """
SELECT CAST(coalesce(sum(fee_c) FILTER (end_day = today), 0) AS DOUBLE) / 100 AS revenue_today,
  CAST(coalesce(sum(fee_c) FILTER (date_trunc('month', end_day) = date_trunc('month', today)), 0) AS DOUBLE) / 100 AS revenue_this_month,
  CAST(coalesce(sum(fee_c), 0) AS DOUBLE) / 100 AS revenue_total FROM settled, newest_day""")
oracle("settled_revenue_trend", f"""
SELECT {day_text('day')} AS date, CAST(coalesce(sum(fee_c), 0) AS DOUBLE) / 100 AS revenue
FROM (SELECT CAST(unnest(generate_series(today - 29, today, INTERVAL 1 DAY)) AS DATE) AS day FROM newest_day)
LEFT JOIN settled ON end_day = day GROUP BY day""")
oracle("pile_state_counts", "SELECT status, count(*) AS count FROM piles GROUP BY ALL")
BASE["pile_totals"] = """
SELECT station_id AS sid, count(*) AS n, count(*) FILTER (status = '闲置') AS free, count(*) FILTER (status <> '故障') AS working
FROM piles GROUP BY ALL"""
oracle("free_piles", "SELECT id, coalesce(free, 0) AS free_pile_count FROM depots LEFT JOIN pile_totals ON sid = id")
oracle("working_rate", "SELECT id, coalesce(working * 100.0 / n, 0) AS online_rate FROM depots LEFT JOIN pile_totals ON sid = id")
oracle("free_share_board", """
SELECT id AS station_id, name, pile_count, coalesce(free, 0) AS free_pile_count,
  CASE WHEN pile_count > 0 THEN CAST(coalesce(free, 0) AS DOUBLE) / pile_count * 100 ELSE 0 END AS online_rate
FROM depots LEFT JOIN pile_totals ON sid = id""")
_BILL = f"""id, user_id, pile_id, {time_text('start_time')} AS start_time, {time_text('end_time')} AS end_time,
  amount, CAST(fee_c AS DOUBLE) / 100 AS fee, status"""
oracle("user_orders", f"SELECT {_BILL} FROM bills WHERE user_id = 7")
oracle("find_order", f"SELECT {_BILL} FROM bills WHERE id = 7")
BASE["named_piles"] = """
SELECT p.id, p.station_id, d.name AS station_name, p.code, p.type, CAST(p.power AS DOUBLE) AS power, p.status
FROM piles p JOIN depots d ON d.id = p.station_id"""
oracle("pile_list", "SELECT * FROM named_piles")
oracle("piles_of_station", "SELECT * FROM named_piles WHERE station_id = 7")
oracle("find_pile", "SELECT * FROM named_piles WHERE id = 71")
oracle("pile_lifetime", """
SELECT p.id, count(b.id) AS total_sessions,
  CAST(coalesce(sum(greatest(date_diff('second', start_time, end_time) // 60, 0)), 0) AS BIGINT) AS total_duration
FROM piles p LEFT JOIN bills b ON b.pile_id = p.id AND b.status IN ('已结算', '待结算') GROUP BY p.id""")
oracle("pile_count_by_station", """
SELECT id, name, address, longitude, latitude, CAST(tariff_c AS DOUBLE) / 100 AS price, coalesce(n, 0) AS pile_count
FROM depots LEFT JOIN pile_totals ON sid = id""")
_ACCOUNT = f"id, phone, nickname, avatar_path, balance, status, {time_text('created_at')} AS created_at"
oracle("find_user", f"SELECT {_ACCOUNT} FROM accounts WHERE id = 7")
oracle("user_list", f"SELECT {_ACCOUNT} FROM accounts")
oracle("search_users", f"SELECT {_ACCOUNT} FROM accounts WHERE phone LIKE '%07%'")
_DEPOT = "id, name, address, longitude, latitude, CAST(tariff_c AS DOUBLE) / 100 AS price, pile_count"
oracle("find_station", f"SELECT {_DEPOT} FROM depots WHERE id = 7")
oracle("station_list", f"SELECT {_DEPOT} FROM depots")
oracle("search_stations", f"SELECT {_DEPOT} FROM depots WHERE name ILIKE '%road 1%' OR address ILIKE '%road 1%'")
BASE["bill_lines"] = f"""
SELECT b.id, b.user_id, a.phone AS user_phone, b.pile_id, p.station_id, d.name AS station_name,
  {time_text('b.start_time')} AS start_time, {time_text('b.end_time')} AS end_time, b.amount,
  CAST(b.fee_c AS DOUBLE) / 100 AS fee, b.status, CAST(coalesce(b.end_time, b.start_time) AS DATE) AS at_day
FROM bills b JOIN accounts a ON a.id = b.user_id JOIN piles p ON p.id = b.pile_id JOIN depots d ON d.id = p.station_id"""
oracle("all_orders", "SELECT * EXCLUDE (at_day) FROM bill_lines")
oracle("search_orders", """
SELECT * EXCLUDE (at_day) FROM bill_lines WHERE user_phone LIKE '%01%' AND at_day BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'
AND status = '已结算'""")
oracle("login_history", f"""
SELECT id, phone, {time_text('login_time')} AS login_time, ip_address FROM (SELECT * FROM logins ORDER BY login_time DESC, id DESC LIMIT 50)""")
oracle("operation_history", f"""
SELECT * REPLACE ({time_text('operation_time')} AS operation_time) FROM (SELECT * FROM actions
WHERE target_table = 'piles' AND operator_id = 3 ORDER BY operation_time DESC, id DESC LIMIT 50)""")
oracle("open_orders", "SELECT user_id, min(id) AS order_id FROM bills WHERE status IN ('充电中', '待结算') GROUP BY user_id")
oracle("open_session_estimate", """
SELECT b.id AS order_id, b.pile_id, p.station_id, s AS elapsed_seconds, s // 60 AS duration_minutes,
  round(CAST(p.power AS DOUBLE) * s / 3600, 3) AS estimated_kwh,
  round(CAST(p.power AS DOUBLE) * s / 3600 * (CAST(d.tariff_c AS DOUBLE) / 100), 3) AS estimated_fee
FROM (SELECT id, pile_id, greatest(date_diff('second', start_time, (SELECT max(o_orderdate) + INTERVAL 1 DAY FROM orders)), 0) AS s
      FROM bills WHERE status = '充电中') b
JOIN piles p ON p.id = b.pile_id JOIN depots d ON d.id = p.station_id""")


def _distance(lat_a: str, lon_a: str, lat_b: str, lon_b: str) -> str:
    chord = (
        f"(pow(sin(radians({lat_b} - ({lat_a})) / 2), 2) + cos(radians({lat_a})) * cos(radians({lat_b}))"
        f" * pow(sin(radians({lon_b} - ({lon_a})) / 2), 2))"
    )
    return f"(12742.0 * atan2(sqrt({chord}), sqrt(1 - {chord})))"


oracle("nearest_stations", f"""
SELECT {_DEPOT}, round({_distance('30.3', '110.4', 'latitude', 'longitude')}, 6) AS distance_km
FROM depots ORDER BY {_distance('30.3', '110.4', 'latitude', 'longitude')}, id LIMIT 5""")
BASE["route_starts"] = """
SELECT 30 + CAST(l_suppkey % 97 AS DOUBLE) * 0.01 AS latitude, 110 + CAST(l_suppkey % 89 AS DOUBLE) * 0.01 AS longitude,
  count(*) AS routes FROM lineitem GROUP BY ALL"""
BASE["route_distances"] = f"""
SELECT r.latitude, r.longitude, r.routes, d.id, {_distance('r.latitude', 'r.longitude', 'd.latitude', 'd.longitude')} AS km
FROM route_starts r, depots d"""
oracle("nearest_stations_per_route", """
SELECT round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, routes, id, round(km, 6) AS distance_km,
  CAST(row_number() OVER (PARTITION BY latitude, longitude ORDER BY km, id) AS INTEGER) AS rank
FROM route_distances QUALIFY rank <= 5""")
oracle("route_plausibility", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, m AS distance_meters, s AS duration_seconds, line AS polyline,
  round(a, 6) AS origin_lat, round(b, 6) AS origin_lng, round(c, 6) AS dest_lat, round(d, 6) AS dest_lng,
  CASE WHEN m <= 0 THEN '路线距离无效' WHEN s <= 0 THEN '路线时长无效（不能为负或零）' WHEN line = '' THEN '路线缺少折线数据'
  WHEN m / 1000.0 + 0.5 < {_distance('a', 'b', 'c', 'd')} THEN '路线距离与起终点严重不符'
  WHEN m / 1000.0 / (s / 3600.0) > 300 THEN '路线时长与距离矛盾（速度不现实）'
  WHEN s < 60 AND m / 1000.0 > 1 THEN '路线时长与距离矛盾（例如7公里不可能在1分钟内到达）' ELSE '' END AS reason
FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CASE WHEN l_partkey % 31 = 0 THEN 0 ELSE l_quantity * 1000 END AS INTEGER) AS m,
  CAST(CASE WHEN l_partkey % 29 = 0 THEN 0 WHEN l_partkey % 23 = 0 THEN 30 ELSE l_quantity * 90 END AS INTEGER) AS s,
  CASE WHEN l_partkey % 37 = 0 THEN '' ELSE 'p' END AS line,
  30 + CAST(l_suppkey % 97 AS DOUBLE) * 0.01 AS a, 110 + CAST(l_suppkey % 89 AS DOUBLE) * 0.01 AS b,
  30 + CAST(l_partkey % 97 AS DOUBLE) * 0.01 AS c, 110 + CAST(l_partkey % 89 AS DOUBLE) * 0.01 AS d FROM lineitem)""")

# ---- quality --------------------------------------------------------------

_RAW_NAMES = """session_id user_id station_id device_id location_id weather_id created_at ended_at charge_time_hrs start_hour
weekday weekday_name is_weekend is_holiday holiday_name is_workday energy_kwh fee_amount_cny platform order_status
payment_status _corrupt_record""".split()
_TYPED = f"""{time_text('c_at')} AS _created_at, {time_text('e_at')} AS _ended_at, CAST(energy AS DOUBLE) AS _energy_kwh,
  CAST(fee AS DOUBLE) AS _fee_amount_cny, hrs AS _charge_time_hrs, sh AS _start_hour, wd AS _weekday,
  CAST(wd_name AS INTEGER) AS _weekday_from_name, wd_time AS _weekday_from_timestamp, actual_hrs AS _actual_duration_hrs"""
_FLAGS = "we AS _is_weekend, ho AS _is_holiday, wo AS _is_workday"
oracle("parsed_charging_times", f"SELECT session_id, {_TYPED} FROM parsed")
oracle("order_quality_issues", f"""
SELECT {", ".join(_RAW_NAMES)}, {_TYPED}, {_FLAGS}, array_to_string(own_issues, '|') AS quality_issues FROM checked""")
oracle("order_reference_issues", f"""
SELECT {", ".join(_RAW_NAMES)}, {_TYPED}, {_FLAGS}, array_to_string(issues, '|') AS quality_issues FROM referenced""")
_CLEAN = f"""
SELECT trim(session_id) AS session_id, trim(user_id) AS user_id, trim(station_id) AS station_id, trim(device_id) AS device_id,
  trim(location_id) AS location_id, trim(weather_id) AS weather_id, {time_text('c_at')} AS created_at, {time_text('e_at')} AS ended_at,
  hrs AS charge_time_hrs, sh AS start_hour, wd AS weekday, trim(weekday_name) AS weekday_name, we AS is_weekend, ho AS is_holiday,
  trim(holiday_name) AS holiday_name, wo AS is_workday, CAST(energy AS DOUBLE) AS energy_kwh, CAST(fee AS DOUBLE) AS fee_amount_cny,
  lower(trim(platform)) AS platform, lower(trim(order_status)) AS order_status, lower(trim(payment_status)) AS payment_status"""
oracle("clean_orders", f"{_CLEAN} FROM referenced WHERE len(issues) = 0")
oracle("order_facts", f"""
SELECT * EXCLUDE (weekday, energy_kwh, fee_amount_cny), energy_kwh AS kwh_total, fee_amount_cny AS charging_fees,
  weekday AS start_weekday, CAST(hour(strptime(ended_at, '%Y-%m-%d %H:%M:%S')) AS INTEGER) AS end_hour, left(created_at, 10) AS start_date
FROM ({_CLEAN} FROM referenced WHERE len(issues) = 0)""")
oracle("rejected_orders", """
SELECT r.session_id, r.user_id, r.station_id, r.device_id, r.location_id, r.weather_id, r.created_at, r.ended_at, r.charge_time_hrs,
  r.start_hour, r.weekday, r.weekday_name, r.is_weekend, r.is_holiday, r.holiday_name, r.is_workday, r.energy_kwh,
  r.fee_amount_cny, r.platform, r.order_status, r.payment_status, r._corrupt_record, array_to_string(issues, '|') AS quality_issues
FROM referenced r WHERE len(issues) > 0""")
oracle("quality_summary", """
SELECT 'total_rows' AS metric, count(*) AS count FROM referenced
UNION ALL SELECT 'valid_rows', count(*) FROM referenced WHERE len(issues) = 0
UNION ALL SELECT 'rejected_rows', count(*) FROM referenced WHERE len(issues) > 0
UNION ALL SELECT 'issue:' || i, count(*) FROM (SELECT unnest(issues) AS i FROM referenced) GROUP BY i""")
oracle("rejected_count", "SELECT count(*) AS rejected_order_rows FROM referenced WHERE len(issues) > 0")
oracle("plausible_measurements", """
SELECT session_id, created_at, CAST(energy AS DOUBLE) AS energy_kwh, CAST(fee AS DOUBLE) AS fee_amount_cny, hrs AS charge_time_hrs,
  sh AS start_hour, wd AS weekday FROM parsed
WHERE energy >= 0 AND fee >= 0 AND hrs > 0 AND hrs <= 24 AND sh BETWEEN 0 AND 23 AND wd BETWEEN 0 AND 6""")
oracle("trimmed_orders", f"SELECT {', '.join(f'trim({n}) AS {n}' for n in _RAW_NAMES)} FROM raw_orders")
oracle("repeated_sessions", f"""
SELECT user_id, event_id, {time_text('ts')} AS ts,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) > 1 AS INTEGER) AS repeated FROM events""")
oracle("clean_users", f"""
SELECT user_id, {time_text('registered_at')} AS registered_at, city, lower(trim(member_level)) AS member_level, vehicle_type,
  battery_capacity_kwh, preferred_platform, registration_channel, user_status
FROM raw_users WHERE lower(trim(member_level)) IN ('bronze', 'silver', 'gold', 'platinum')""")
oracle("clean_stations", f"""
SELECT station_id, location_id, station_name, address, city, try_cast(latitude AS DOUBLE) AS latitude, longitude, facility_type,
  device_count, '00:00-24:00' AS open_time, CAST(price_c AS DOUBLE) / 100 AS electricity_price_cny_kwh,
  CAST(service_c AS DOUBLE) / 100 AS service_fee_cny_kwh, station_status, {day_text('updated_on')} AS updated_on
FROM raw_stations WHERE try_cast(latitude AS DOUBLE) BETWEEN -90 AND 90""")
oracle("clean_devices", f"""
SELECT device_id, station_id, device_code, charger_type, CAST(rated_power_kw AS DOUBLE) AS rated_power_kw, connector_count,
  manufacturer, {day_text('commissioned_at')} AS commissioned_at, last_maintenance_at, current_status
FROM raw_devices WHERE try_strptime(last_maintenance_at, '%Y-%m-%d') >= commissioned_at""")
oracle("clean_weather", f"""
SELECT * REPLACE (CAST(location_id AS VARCHAR) AS location_id, {time_text('weather_time')} AS weather_time) FROM good_weather""")
oracle("clean_device_status", f"""
SELECT status_id, CAST(device_id AS VARCHAR) AS device_id, CAST(station_id AS VARCHAR) AS station_id,
  {time_text('record_time')} AS record_time, CAST(online_minutes AS INTEGER) AS online_minutes,
  CAST(offline_minutes AS INTEGER) AS offline_minutes, CAST(fault_minutes AS INTEGER) AS fault_minutes,
  CAST(fault_count AS INTEGER) AS fault_count, CAST(successful_sessions AS INTEGER) AS successful_sessions,
  CAST(failed_sessions AS INTEGER) AS failed_sessions, primary_fault_code, avg_output_power_kw, availability_rate,
  health_score, maintenance_flag FROM status_log WHERE device_id % 7 <> 0""")
oracle("one_order_per_user_and_day", f"""
SELECT user_id, {day_text('d')} AS day, event_type, event_id FROM (SELECT user_id, CAST(ts AS DATE) AS d, event_type, event_id,
  row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_type, event_id) AS place FROM events) WHERE place = 1""")
oracle("distinct_times", f"SELECT DISTINCT {time_text(chr(100) + 'ate_trunc(' + repr('hour') + ', ts)')} AS datetime FROM events")

# ---- integrity ------------------------------------------------------------

_DEVICE = f"""device_id, station_id, device_code, charger_type, CAST(rated_power_kw AS DOUBLE) AS rated_power_kw, connector_count,
  manufacturer, {day_text('commissioned_at')} AS commissioned_at, {day_text('last_maintenance_at')} AS last_maintenance_at, current_status"""
oracle("valid_devices", f"""
SELECT {_DEVICE} FROM devices WHERE station_id IN (SELECT station_id FROM stations WHERE station_status = 'active')""")
oracle("valid_weather", f"""
SELECT * REPLACE ({time_text('weather_time')} AS weather_time) FROM weather
WHERE location_id IN (SELECT location_id FROM stations WHERE station_status = 'active')""")
oracle("valid_device_status", f"""
SELECT s.* EXCLUDE (stat_date) REPLACE ({time_text('s.record_time')} AS record_time)
FROM status_log s JOIN devices d ON d.device_id = s.device_id
WHERE s.station_id = d.station_id + CAST(d.device_id % 10 = 2 AS INTEGER)""")
oracle("null_counts", "\nUNION ALL ".join(
    f"SELECT '{n}' AS column_name, count(*) FILTER (coalesce(trim({n}), '') = '') AS missing FROM raw_orders" for n in _RAW_NAMES))
oracle("orphan_count", """
SELECT count(*) AS unmatched FROM raw_orders WHERE station_id IS NOT NULL AND station_id NOT IN (SELECT station_id FROM raw_stations)""")

_TABLES = {
    "charging_orders": ("charges", "session_id", _RAW_NAMES[:-1], "session_id user_id station_id device_id location_id weather_id created_at ended_at charge_time_hrs start_hour weekday is_weekend is_holiday is_workday energy_kwh fee_amount_cny order_status".split()),
    "stations": ("stations", "station_id", "station_id location_id station_name address city latitude longitude facility_type device_count open_time electricity_price_cny_kwh service_fee_cny_kwh station_status updated_on".split(), "station_id location_id facility_type device_count electricity_price_cny_kwh service_fee_cny_kwh station_status".split()),
    "devices": ("devices", "device_id", "device_id station_id device_code charger_type rated_power_kw connector_count manufacturer commissioned_at last_maintenance_at current_status".split(), "device_id station_id charger_type rated_power_kw connector_count current_status".split()),
    "users": ("members", "user_id", "user_id registered_at city member_level vehicle_type battery_capacity_kwh preferred_platform registration_channel user_status".split(), "user_id vehicle_type battery_capacity_kwh member_level user_status".split()),
    "weather_hourly": ("weather", "weather_id", "weather_id location_id weather_time weather_type weather_name temperature_c humidity_pct precipitation_mm wind_speed_mps visibility_km is_rain".split(), "weather_id location_id weather_time weather_type temperature_c humidity_pct precipitation_mm wind_speed_mps visibility_km is_rain".split()),
    "device_status_log": ("status_log", "status_id", "status_id device_id station_id record_time online_minutes offline_minutes fault_minutes fault_count primary_fault_code successful_sessions failed_sessions avg_output_power_kw availability_rate health_score maintenance_flag".split(), "status_id device_id station_id online_minutes offline_minutes fault_minutes fault_count avg_output_power_kw availability_rate health_score".split()),
}
# The columns kept under another name, or as a constant, by the base tables.
_STORED = {"energy_kwh": "e_m", "fee_amount_cny": "f_c", "electricity_price_cny_kwh": "price_c",
           "service_fee_cny_kwh": "service_c", "open_time": "station_id"}
_report: list[str] = []
for _table, (_base, _key, _have, _want) in _TABLES.items():
    _report += [f"SELECT 'extra_column' AS section, '{_table}' AS table_name, '{n}' AS item, CAST(1 AS BIGINT) AS value" for n in _have if n not in _want]
    _report += [f"SELECT 'missing_values', '{_table}', '{n}', count(*) - count({_STORED.get(n, n)}) FROM {_base}" for n in _have]
    _report.append(f"SELECT 'row_count', '{_table}', 'rows', count(*) FROM {_base}")
    _report.append(f"SELECT 'duplicate_keys', '{_table}', '{_key}', count(*) - count(DISTINCT {_key}) FROM {_base}")
_LINKS = (
    ("order_user_fk", "charging_orders", "charges", "user_id", "members"),
    ("order_station_fk", "charging_orders", "charges", "station_id", "stations"),
    ("order_device_fk", "charging_orders", "charges", "device_id", "devices"),
    ("order_weather_fk", "charging_orders", "charges", "weather_id", "weather"),
    ("device_station_fk", "devices", "devices", "station_id", "stations"),
    ("status_device_fk", "device_status_log", "status_log", "device_id", "devices"),
)
_report += [
    f"SELECT 'foreign_key', '{_table}', '{_name}_unmatched', count(*) FROM {_child} WHERE {_key} NOT IN (SELECT {_key} FROM {_parent})"
    for _name, _table, _child, _key, _parent in _LINKS
]
oracle("validate_tables", "\nUNION ALL ".join(_report))

BASE["rates_by_weather"] = """
SELECT weather_type, count(*) AS station_hours, CAST(coalesce(sum(n), 0) AS BIGINT) AS orders,
  round_even(CAST(coalesce(sum(n), 0) AS DOUBLE) / count(*) * 1000, 3) AS orders_per_1000_station_hours
FROM weather w JOIN stations s ON s.location_id = w.location_id
LEFT JOIN (SELECT station_id, at_hour, count(*) AS n FROM charges GROUP BY ALL) c ON c.station_id = s.station_id AND at_hour = weather_time
GROUP BY weather_type"""
oracle("demand_rate_by_weather", "SELECT * FROM rates_by_weather")

_checks = [
    (f"unique_{key}", f"SELECT count(*) - count(DISTINCT {key}) AS v FROM {base}")
    for base, key in (("members", "user_id"), ("stations", "station_id"), ("devices", "device_id"),
                      ("weather", "weather_id"), ("charges", "session_id"), ("status_log", "status_id"))
]
_checks += [
    (name, f"SELECT count(*) AS v FROM {child} WHERE {key} NOT IN (SELECT {key} FROM {parent})")
    for name, _, child, key, parent in _LINKS if name != "device_station_fk"
]
_checks += [
    ("order_device_belongs_to_station", "SELECT count(*) AS v FROM charges c LEFT JOIN devices d ON d.device_id = c.device_id WHERE c.station_id IS DISTINCT FROM d.station_id"),
    ("station_device_count_matches", "SELECT count(*) AS v FROM stations s FULL JOIN (SELECT station_id, count(*) AS n FROM devices GROUP BY ALL) d ON d.station_id = s.station_id WHERE device_count IS DISTINCT FROM n"),
    ("users_registered_before_orders", "SELECT count(*) AS v FROM charges c LEFT JOIN members m ON m.user_id = c.user_id WHERE NOT coalesce(registered_at <= created_at, false)"),
    ("orders_end_after_start", "SELECT count(*) AS v FROM charges WHERE NOT ended_at > created_at"),
    ("order_holiday_fields_match_calendar", "SELECT count(*) AS v FROM charges WHERE is_holiday <> 0 OR is_weekend <> CAST(isodow(created_at) >= 6 AS INTEGER) OR is_workday <> CAST(isodow(created_at) < 6 AS INTEGER)"),
    ("rain_reduces_demand", "SELECT count(*) FILTER (NOT coalesce(l < s AND h < l, false)) AS v FROM (SELECT max(orders_per_1000_station_hours) FILTER (weather_type = 'sunny') AS s, max(orders_per_1000_station_hours) FILTER (weather_type = 'light_rain') AS l, max(orders_per_1000_station_hours) FILTER (weather_type = 'heavy_rain') AS h FROM rates_by_weather)"),
]
oracle("cross_table_assertions", "\nUNION ALL ".join(
    f"SELECT '{name}' AS check_name, CAST(v = 0 AS INTEGER) AS passed, CAST(v AS BIGINT) AS violations FROM ({sql})" for name, sql in _checks))

# ---- features and splits --------------------------------------------------

oracle("time_features", f"""
SELECT session_id, {time_text('at_hour')} AS datetime, start_hour AS hour, CAST(day(created_at) AS INTEGER) AS day,
  CAST(month(created_at) AS INTEGER) AS month, weekday AS weekday_number, is_weekend, is_holiday, is_workday FROM charges""")
_WEATHER_CODE = "CAST(list_position(['sunny', 'cloudy', 'overcast', 'fog', 'light_rain', 'heavy_rain', 'snow'], weather_type) - 1 AS INTEGER)"
oracle("weather_features", f"""
SELECT weather_id, location_id, {time_text('weather_time')} AS weather_time, weather_type, temperature_c, humidity_pct,
  precipitation_mm, wind_speed_mps, visibility_km, is_rain, {time_text('weather_time')} AS datetime,
  {_WEATHER_CODE} AS weather_type_code FROM weather""")
BASE["site_features"] = """
SELECT station_id, location_id, CAST(device_count AS DOUBLE) AS device_count, CAST(facility_type AS DOUBLE) AS facility_type_code,
  CAST(price_c AS DOUBLE) / 100 AS electricity_price_cny_kwh, CAST(service_c AS DOUBLE) / 100 AS service_fee_cny_kwh,
  CAST(CASE station_status WHEN 'active' THEN 1 WHEN 'maintenance' THEN 0.5 ELSE 0 END AS DOUBLE) AS station_status_code FROM stations"""
oracle("station_features", "SELECT * FROM site_features")
BASE["fleet_features"] = """
SELECT a.*, round(avg_availability_rate, 6) AS avg_availability_rate, total_fault_count, total_fault_minutes,
  round(avg_health_score, 6) AS avg_health_score, round(avg_output_power_kw, 6) AS avg_output_power_kw
FROM (SELECT station_id, CAST(count(*) FILTER (charger_type = 'DC_FAST') AS DOUBLE) AS dc_fast_device_count,
  CAST(count(*) FILTER (charger_type = 'AC_SLOW') AS DOUBLE) AS ac_slow_device_count,
  round(avg(rated_power_kw), 6) AS avg_rated_power_kw, round(avg(connector_count), 6) AS avg_connector_count FROM devices GROUP BY ALL) a
LEFT JOIN (SELECT station_id, avg(availability_rate) AS avg_availability_rate, CAST(sum(fault_count) AS BIGINT) AS total_fault_count,
  CAST(sum(fault_minutes) AS BIGINT) AS total_fault_minutes, avg(health_score) AS avg_health_score,
  avg(avg_output_power_kw) AS avg_output_power_kw FROM status_log GROUP BY ALL) b ON b.station_id = a.station_id"""
oracle("device_features", "SELECT * FROM fleet_features")
BASE["member_features"] = """
SELECT user_id, vehicle_type, CAST(list_position(['sedan', 'suv', 'mpv', 'commercial'], vehicle_type) - 1 AS DOUBLE) AS vehicle_type_code,
  CAST(battery_capacity_kwh AS DOUBLE) AS battery_capacity_kwh, member_level,
  CAST(list_position(['bronze', 'silver', 'gold', 'platinum'], member_level) - 1 AS DOUBLE) AS member_level_code FROM members"""
oracle("user_features", "SELECT * FROM member_features")
oracle("merged_orders", f"""
SELECT c.* EXCLUDE (e_m, f_c, end_hour, start_date, at_hour) REPLACE ({time_text('c.created_at')} AS created_at, {time_text('c.ended_at')} AS ended_at),
  CAST(e_m AS DOUBLE) / 1000 AS energy_kwh, CAST(f_c AS DOUBLE) / 100 AS fee_amount_cny, {time_text('at_hour')} AS datetime,
  CAST(hour(at_hour) AS INTEGER) AS hour, CAST(day(at_hour) AS INTEGER) AS day, CAST(month(at_hour) AS INTEGER) AS month,
  CAST(isodow(at_hour) - 1 AS INTEGER) AS weekday_number, s.* EXCLUDE (station_id, location_id), f.* EXCLUDE (station_id),
  u.* EXCLUDE (user_id), w.* EXCLUDE (weather_id, location_id) REPLACE ({time_text('w.weather_time')} AS weather_time),
  {_WEATHER_CODE} AS weather_type_code
FROM charges c LEFT JOIN site_features s ON s.station_id = c.station_id LEFT JOIN fleet_features f ON f.station_id = c.station_id
LEFT JOIN member_features u ON u.user_id = c.user_id LEFT JOIN weather w ON w.weather_id = c.weather_id""")
_SHARES = ", ".join(
    f"round(avg(CAST({field} = '{kind}' AS INTEGER)), 6) AS {kind}_share"
    for field, kinds in (("vehicle_type", "sedan suv mpv commercial"), ("member_level", "bronze silver gold platinum"))
    for kind in kinds.split()
)
BASE["mix_by_hour"] = f"""
SELECT station_id, at_hour AS datetime, round(avg(battery_capacity_kwh), 6) AS avg_battery_capacity_kwh,
  round(avg(vehicle_type_code), 6) AS avg_vehicle_type_code, round(avg(member_level_code), 6) AS avg_member_level_code, {_SHARES}
FROM charges LEFT JOIN member_features USING (user_id) GROUP BY ALL"""
oracle("user_mix", f"SELECT * REPLACE ({time_text('datetime')} AS datetime) FROM mix_by_hour")
BASE["targets_by_hour"] = """
SELECT station_id, at_hour AS datetime, CAST(sum(e_m) AS DOUBLE) / 1000 AS energy_kwh, count(*) AS session_count,
  sum(charge_time_hrs) AS charge_time_hrs, round(avg(charge_time_hrs), 6) AS avg_charge_time_hrs,
  count(*) FILTER (order_status = 'completed') AS completed_order_count,
  count(*) FILTER (order_status = 'interrupted') AS interrupted_order_count,
  count(*) FILTER (order_status = 'failed') AS failed_order_count FROM charges GROUP BY ALL"""
oracle("station_hour_targets", f"SELECT * REPLACE ({time_text('datetime')} AS datetime) FROM targets_by_hour")
oracle("station_hour_grid", f"SELECT * REPLACE ({time_text('datetime')} AS datetime) FROM station_hours")
BASE["day_flags"] = """
SELECT start_date AS date, max(is_weekend) AS calendar_is_weekend, max(is_holiday) AS calendar_is_holiday,
  max(is_workday) AS calendar_is_workday FROM charges GROUP BY ALL"""
oracle("calendar_rollup", f"SELECT * REPLACE ({day_text('date')} AS date) FROM day_flags")


def _filled(alias: str, names: str, default: str = "0") -> str:
    return ", ".join(f"coalesce({alias}.{n}, {default}) AS {n}" for n in names.split())


_LAGS = ", ".join(
    f"lag(kwh, {n}) OVER (PARTITION BY station_id ORDER BY datetime) AS load_lag_{n}h" for n in (1, 2, 3, 24)
)
BASE["feature_rows"] = f"""
SELECT g.station_id, g.location_id, g.datetime, l.kwh AS energy_kwh,
  {_filled('t', 'session_count charge_time_hrs completed_order_count interrupted_order_count failed_order_count')},
  CAST(hour(g.datetime) AS INTEGER) AS hour, CAST(day(g.datetime) AS INTEGER) AS day, CAST(month(g.datetime) AS INTEGER) AS month,
  CAST(isodow(g.datetime) - 1 AS INTEGER) AS weekday_number,
  coalesce(d.calendar_is_weekend, CAST(isodow(g.datetime) >= 6 AS INTEGER)) AS is_weekend,
  coalesce(d.calendar_is_holiday, 0) AS is_holiday,
  coalesce(d.calendar_is_workday, CAST(isodow(g.datetime) < 6 AS INTEGER)) AS is_workday,
  coalesce({_WEATHER_CODE}, -1) AS weather_type_code,
  {_filled('w', 'temperature_c humidity_pct precipitation_mm wind_speed_mps visibility_km is_rain')},
  s.device_count, s.facility_type_code, s.electricity_price_cny_kwh, s.service_fee_cny_kwh, s.station_status_code,
  {_filled('f', 'dc_fast_device_count ac_slow_device_count avg_rated_power_kw avg_connector_count avg_availability_rate total_fault_count total_fault_minutes avg_health_score avg_output_power_kw')},
  {_filled('m', 'avg_battery_capacity_kwh')}, {_filled('m', 'avg_vehicle_type_code avg_member_level_code', '-1')},
  {_filled('m', 'sedan_share suv_share mpv_share commercial_share bronze_share silver_share gold_share platinum_share')},
  l.load_lag_1h, l.load_lag_2h, l.load_lag_3h, l.load_lag_24h
FROM station_hours g
JOIN (SELECT *, {_LAGS} FROM dense_load) l ON l.station_id = g.station_id AND l.datetime = g.datetime
LEFT JOIN targets_by_hour t ON t.station_id = g.station_id AND t.datetime = g.datetime
LEFT JOIN mix_by_hour m ON m.station_id = g.station_id AND m.datetime = g.datetime
LEFT JOIN site_features s ON s.station_id = g.station_id
LEFT JOIN fleet_features f ON f.station_id = g.station_id
LEFT JOIN day_flags d ON d.date = CAST(g.datetime AS DATE)
LEFT JOIN weather w ON w.location_id = g.location_id AND w.weather_time = g.datetime"""
oracle("station_hour_features", f"SELECT * REPLACE ({time_text('datetime')} AS datetime) FROM feature_rows")
_ALIASES = ", ".join(f"load_lag_{n}h AS lag_{n}h, load_lag_{n}h AS lag_{n}" for n in (1, 2, 3, 24))
oracle("lag_features", f"""
SELECT station_id, {time_text('datetime')} AS datetime, kwh AS energy_kwh, load_lag_1h, load_lag_2h, load_lag_3h, load_lag_24h, {_ALIASES}
FROM (SELECT *, {_LAGS} FROM dense_load)""")
oracle("global_lag_features", f"""
SELECT {time_text('created_at')} AS datetime, kwh AS energy_kwh, session_id, a AS load_lag_1h, a AS lag_1h, a AS lag_1,
  b AS load_lag_24h, b AS lag_24h, b AS lag_24
FROM (SELECT *, lag(kwh, 1) OVER (ORDER BY created_at) AS a, lag(kwh, 24) OVER (ORDER BY created_at) AS b
      FROM (SELECT *, CAST(e_m AS DOUBLE) / 1000 AS kwh FROM charges))""")
BASE["time_places"] = "SELECT t, row_number() OVER (ORDER BY t) - 1 AS i FROM (SELECT DISTINCT created_at AS t FROM charges)"
oracle("time_index", f"SELECT {time_text('t')} AS created_at, i AS time_index FROM time_places")
oracle("time_split", f"""
WITH n AS (SELECT count(*) AS n FROM time_places)
SELECT session_id, {time_text('created_at')} AS datetime,
  CASE WHEN i < CAST(floor(n * 0.7) AS BIGINT) THEN 'train'
       WHEN i < CAST(floor(n * 0.7) AS BIGINT) + CAST(floor(n * 0.15) AS BIGINT) THEN 'validation' ELSE 'test' END AS split
FROM charges JOIN time_places ON t = created_at, n""")
oracle("newest_orders_per_station", f"""
SELECT station_id, session_id, {time_text('created_at')} AS created_at FROM (SELECT *, row_number() OVER
  (PARTITION BY station_id ORDER BY created_at DESC, session_id DESC) AS place FROM charges) WHERE place <= 24""")
oracle("load_by_station_hour", f"""
SELECT station_id, {time_text('datetime')} AS datetime, CAST(e_m AS DOUBLE) / 1000 AS energy_kwh FROM hour_load""")
oracle("load_by_hour", f"""
SELECT {time_text('datetime')} AS datetime, CAST(sum(e_m) AS DOUBLE) / 1000 AS energy_kwh FROM hour_load GROUP BY ALL""")
oracle("load_by_station", "SELECT station_id, CAST(sum(e_m) AS DOUBLE) / 1000 AS energy_kwh FROM hour_load GROUP BY ALL")
oracle("demand_weight", f"""
SELECT station_id, {time_text('datetime')} AS datetime, CAST(e_m AS DOUBLE) / 1000 AS energy_kwh,
  CAST(CASE WHEN e_m > 0 THEN 41 ELSE 1 END AS DOUBLE) AS sample_weight FROM hour_load""")
oracle("prepared_training_rows", """
SELECT session_id AS id, created_at AS datetime, CAST(energy AS DOUBLE) AS energy_kwh, CAST(fee AS DOUBLE) AS fee_amount_cny,
  hrs AS charge_time_hrs FROM parsed WHERE energy IS NOT NULL AND fee IS NOT NULL AND hrs IS NOT NULL""")

# ---- demand ---------------------------------------------------------------

oracle("calendar_dimension", f"""
WITH days AS (SELECT CAST(unnest(generate_series(min(o_orderdate) + INTERVAL 15 YEAR, max(o_orderdate) + INTERVAL 15 YEAR, INTERVAL 1 DAY)) AS DATE) AS d FROM orders),
named AS (SELECT d, coalesce(name, '非节假日') AS name FROM days LEFT JOIN (VALUES
  (DATE '2015-01-01', DATE '2015-01-03', '元旦'), (DATE '2015-02-18', DATE '2015-02-24', '春节'),
  (DATE '2015-04-04', DATE '2015-04-06', '清明节'), (DATE '2015-05-01', DATE '2015-05-03', '劳动节'),
  (DATE '2015-06-20', DATE '2015-06-22', '端午节'), (DATE '2015-09-03', DATE '2015-09-05', '抗战胜利纪念日'),
  (DATE '2015-09-26', DATE '2015-09-27', '中秋节'), (DATE '2015-10-01', DATE '2015-10-07', '国庆节')) AS h(a, b, name) ON d BETWEEN a AND b)
SELECT {day_text('d')} AS calendar_date, CAST(isodow(d) >= 6 AS INTEGER) AS is_weekend, CAST(name <> '非节假日' AS INTEGER) AS is_holiday,
  name AS holiday_name, CAST((isodow(d) < 6 AND name = '非节假日') OR d IN (DATE '2015-01-04', DATE '2015-02-15', DATE '2015-02-28',
  DATE '2015-09-06', DATE '2015-10-10') AS INTEGER) AS is_workday FROM named""")

BASE["factor_station"] = """
SELECT station_id, least(greatest(v / avg(v) OVER (), 0.25), 4.0) AS factor
FROM (SELECT s.station_id, count(c.session_id) + 4.0 AS v FROM stations s LEFT JOIN charges c ON c.station_id = s.station_id GROUP BY ALL)"""
BASE["factor_hour"] = """
SELECT h, least(greatest(v / avg(v) OVER (), 0.22), 2.8) AS factor
FROM (SELECT h, count(session_id) + 3.0 AS v FROM range(24) AS t(h) LEFT JOIN charges ON start_hour = h GROUP BY ALL)"""
BASE["factor_weekday"] = """
SELECT w, least(greatest(v / avg(v) OVER (), 0.72), 1.35) AS factor
FROM (SELECT w, (count(session_id) + 1.0) / any_value(coalesce(n, 1)) AS v FROM range(7) AS t(w)
  LEFT JOIN charges ON weekday = w
  LEFT JOIN (SELECT isodow(d) - 1 AS wd, count(*) AS n FROM (SELECT unnest(generate_series(date_trunc('day', first_hour),
    date_trunc('day', last_hour), INTERVAL 1 DAY)) AS d FROM span) GROUP BY ALL) ON wd = w GROUP BY w)"""
oracle("station_factors", "SELECT station_id, round(factor, 9) AS station_factor FROM factor_station")
oracle("hour_factors", "SELECT CAST(h AS INTEGER) AS hour, round(factor, 9) AS hour_factor FROM factor_hour")
oracle("weekday_factors", "SELECT CAST(w AS INTEGER) AS weekday, round(factor, 9) AS weekday_factor FROM factor_weekday")
oracle("expected_demand", f"""
WITH scores AS (SELECT s.station_id, w.weather_time, fs.factor
  * least(greatest(sqrt(s.device_count / (SELECT avg(device_count) FROM stations)), 0.55), 2.2) * fh.factor * fw.factor
  * CASE weather_type WHEN 'sunny' THEN 1.0 WHEN 'cloudy' THEN 0.94 WHEN 'overcast' THEN 0.84 WHEN 'fog' THEN 0.70
      WHEN 'light_rain' THEN 0.64 WHEN 'heavy_rain' THEN 0.36 ELSE 0.48 END
  * CASE WHEN temperature_c < -5 THEN 0.72 WHEN temperature_c > 36 THEN 0.78 WHEN temperature_c > 32 THEN 0.90 ELSE 1.0 END AS score
  FROM weather w JOIN stations s ON s.location_id = w.location_id JOIN factor_station fs ON fs.station_id = s.station_id
  JOIN factor_hour fh ON fh.h = hour(weather_time) JOIN factor_weekday fw ON fw.w = isodow(weather_time) - 1)
SELECT station_id, {time_text('weather_time')} AS datetime, round(score * 24000.0 / (SELECT sum(score) FROM scores), 6) AS expected_orders FROM scores""")
BASE["device_days"] = """
SELECT g.device_id, g.station_id, g.commissioned_at, g.day AS stat_date,
  count(session_id) FILTER (order_status = 'completed') AS successful_sessions,
  count(session_id) FILTER (order_status = 'failed') AS failed_sessions, count(session_id) AS total_sessions,
  coalesce(avg(CAST(e_m AS DOUBLE) / 1000 / charge_time_hrs), 0) AS avg_output_power_kw
FROM (SELECT device_id, station_id, commissioned_at, CAST(unnest(generate_series(date_trunc('day', first_hour), date_trunc('day', last_hour), INTERVAL 1 DAY)) AS DATE) AS day
      FROM devices, span) g LEFT JOIN charges c ON c.device_id = g.device_id AND c.start_date = g.day GROUP BY ALL"""
oracle("device_day_rollup", f"""
SELECT * REPLACE ({day_text('stat_date')} AS stat_date, {day_text('commissioned_at')} AS commissioned_at,
  round(avg_output_power_kw, 6) AS avg_output_power_kw) FROM device_days""")
BASE["weather_days"] = """
SELECT location_id, CAST(weather_time AS DATE) AS stat_date, sum(precipitation_mm) AS daily_precipitation_mm,
  avg(humidity_pct) AS daily_avg_humidity_pct, avg(temperature_c) AS daily_avg_temperature_c FROM weather GROUP BY ALL"""
oracle("weather_day_rollup", f"""
SELECT * REPLACE ({day_text('stat_date')} AS stat_date, round(daily_avg_humidity_pct, 6) AS daily_avg_humidity_pct,
  round(daily_avg_temperature_c, 6) AS daily_avg_temperature_c) FROM weather_days""")
oracle("fault_risk", f"""
SELECT device_id, {day_text('d.stat_date')} AS stat_date, total_sessions, round(least(greatest(
  0.0025 + greatest(date_diff('day', commissioned_at, d.stat_date), 0) / 365.25 * 0.0025
  + CASE WHEN daily_precipitation_mm >= 5 THEN 0.007 ELSE 0 END + CASE WHEN daily_avg_humidity_pct >= 85 THEN 0.004 ELSE 0 END
  + least(total_sessions / 7.0, 1.0) * 0.006, 0.002), 0.12), 9) AS fault_probability
FROM device_days d JOIN stations s ON s.station_id = d.station_id
LEFT JOIN weather_days w ON w.location_id = s.location_id AND w.stat_date = d.stat_date""")
oracle("current_device_state", f"""
SELECT d.* REPLACE (CAST(d.rated_power_kw AS DOUBLE) AS rated_power_kw, {day_text('d.commissioned_at')} AS commissioned_at,
    {day_text('d.last_maintenance_at')} AS last_maintenance_at,
    CASE WHEN fault_count > 0 THEN 'fault' WHEN availability_rate < 0.95 THEN 'offline' ELSE 'online' END AS current_status)
FROM devices d LEFT JOIN (SELECT * FROM status_log QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY record_time DESC) = 1) s
ON s.device_id = d.device_id""")

# ---- forecasts ------------------------------------------------------------

oracle("persistence_forecast", f"""
SELECT station_id, {time_text('datetime')} AS datetime, horizon_hour, round(load, 6) AS predicted_load_kwh FROM predicted""")
oracle("persistence_forecast_from_orders", f"""
SELECT s.station_id, {time_text('last_hour + to_hours(CAST(h AS INTEGER))')} AS datetime, CAST(h AS INTEGER) AS horizon_hour,
  round(CASE WHEN s.e_m > 0 THEN CAST(s.e_m AS DOUBLE) / 1000 ELSE greatest(0.0, coalesce(p.mean, s.mean, 0.0)) END, 6) AS predicted_load_kwh
FROM (SELECT station_id, max(datetime) AS last_hour, arg_max(e_m, datetime) AS e_m,
        CAST(sum(e_m) AS DOUBLE) / 1000 / count(*) AS mean FROM hour_load GROUP BY station_id) s
CROSS JOIN generate_series(1, 6) AS t(h)
LEFT JOIN (SELECT station_id, hour(datetime) AS hr, CAST(sum(e_m) AS DOUBLE) / 1000 / count(*) AS mean FROM hour_load GROUP BY ALL) p
  ON p.station_id = s.station_id AND p.hr = hour(s.last_hour + to_hours(CAST(h AS INTEGER)))""")
BASE["steady"] = "SELECT station_id, datetime, round(load, 6) AS load FROM predicted"
BASE["slots"] = "SELECT datetime, sum(load) AS load, count(DISTINCT station_id) AS n, avg(load) AS mean FROM predicted GROUP BY ALL"
oracle("forecast_totals", f"SELECT {time_text('datetime')} AS datetime, round(load, 4) AS load FROM slots")
oracle("forecast_by_station", f"""
SELECT station_id, round(sum(load), 4) AS total_load, round(max(load), 4) AS peak_load,
  {time_text('min(datetime) FILTER (load = top)')} AS peak_time
FROM (SELECT *, max(load) OVER (PARTITION BY station_id) AS top FROM steady) GROUP BY station_id""")
oracle("forecast_summary", f"""
SELECT round(sum(load), 3) AS total_load, round(max(load), 3) AS peak_load, round(avg(load), 3) AS avg_load,
  {time_text('arg_max(datetime, load)')} AS peak_time, any_value(n) AS station_count FROM slots""")
oracle("standard_forecast_rows", f"""
SELECT 'global' AS station_id, {time_text('datetime')} AS datetime, round(load, 6) AS predicted_load_kwh, horizon_hour
FROM predicted WHERE horizon_hour <= 6""")
oracle("peak_periods", f"""
SELECT CAST(row_number() OVER (ORDER BY load DESC, datetime) AS INTEGER) AS rank, {time_text('datetime')} AS datetime,
  CAST(hour(datetime) AS INTEGER) AS hour, round(load, 4) AS predicted_load_kwh, n AS station_count,
  round(t, 4) AS peak_threshold_kwh, CAST(load >= t AS INTEGER) AS is_peak
FROM slots, (SELECT quantile_cont(load, 0.9) AS t FROM slots)""")
oracle("typed_part_csv", f"""
SELECT station_id, {time_text('datetime')} AS datetime, horizon_hour, round(load, 6) AS predicted_load_kwh FROM predicted""")
oracle("stored_forecast", f"""
SELECT station_id, {time_text('datetime')} AS datetime, horizon_hour, round(load, 6) AS predicted_load_kwh FROM predicted""")
oracle("forecast_peak_job", f"""
SELECT CAST(row_number() OVER (ORDER BY load DESC, datetime) AS INTEGER) AS rank, {time_text('datetime')} AS datetime,
  CAST(hour(datetime) AS INTEGER) AS hour, round(load, 4) AS predicted_load_kwh, n AS station_count,
  round(t, 4) AS peak_threshold_kwh, CAST(load >= t AS INTEGER) AS is_peak
FROM slots, (SELECT quantile_cont(load, 0.9) AS t FROM slots) QUALIFY rank <= 5""")
oracle("raw_lines", f"""
SELECT CAST(user_id AS VARCHAR) AS user_id, CASE WHEN cut THEN 'broken' ELSE {time_text('registered_at')} END AS registered_at,
  CASE WHEN NOT cut THEN city END AS city, CASE WHEN NOT cut THEN member_level END AS member_level,
  CASE WHEN NOT cut THEN vehicle_type END AS vehicle_type,
  CASE WHEN NOT cut THEN printf('%.1f', CAST(battery_capacity_kwh AS DOUBLE)) END AS battery_capacity_kwh,
  CASE WHEN NOT cut THEN preferred_platform END AS preferred_platform,
  CASE WHEN NOT cut THEN registration_channel END AS registration_channel, CASE WHEN NOT cut THEN user_status END AS user_status,
  CASE WHEN cut THEN user_id || ',broken' END AS _corrupt_record
FROM (SELECT *, user_id % 7 = 3 AS cut FROM members)""")
oracle("imported_csv", "SELECT * FROM nation")
oracle("part_csv", "SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS user_id, event_type, props FROM events")
oracle("top_peak_periods", f"""
SELECT CAST(row_number() OVER (ORDER BY mean DESC, datetime) AS INTEGER) AS rank, {time_text('datetime')} AS datetime,
  CAST(hour(datetime) AS INTEGER) AS hour, round(mean, 4) AS predicted_load_kwh, n AS station_count,
  100.0::DOUBLE AS peak_threshold_kwh, CAST(mean >= 100 AS INTEGER) AS is_peak
FROM (SELECT * FROM slots ORDER BY mean DESC, datetime LIMIT 3)""")
oracle("peak_periods_per_station", f"""
SELECT station_id, CAST(place AS INTEGER) AS rank, {time_text('datetime')} AS datetime, CAST(hour(datetime) AS INTEGER) AS hour,
  round(load, 4) AS predicted_load_kwh, CAST(1 AS BIGINT) AS station_count, round(t, 4) AS peak_threshold_kwh, CAST(load >= t AS INTEGER) AS is_peak
FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY load DESC, datetime) AS place,
        quantile_cont(load, 0.9) OVER (PARTITION BY station_id) AS t FROM steady) WHERE place <= 3""")

# ---- recommendation -------------------------------------------------------

BASE["ahead"] = """
SELECT station_id, avg(load) AS predicted_load, min(datetime) FILTER (load = top) AS peak_time, max(load) AS peak
FROM (SELECT *, max(load) OVER (PARTITION BY station_id) AS top FROM steady) GROUP BY station_id"""
BASE["past"] = "SELECT station_id, CAST(sum(e_m) AS DOUBLE) / 1000 AS volume, CAST(count(*) AS DOUBLE) AS frequency FROM charges GROUP BY ALL"
BASE["spare"] = "SELECT station_id, count(*) FILTER (current_status = 'online') AS available_chargers FROM devices GROUP BY ALL"
BASE["score_inputs"] = """
SELECT s.station_id, s.station_name, s.address, s.station_status, f.available_chargers, coalesce(a.predicted_load, 0) AS load,
  a.peak_time, coalesce(p.volume, 0) AS volume, coalesce(p.frequency, 0) AS frequency,
  coalesce(a.predicted_load, 0) / s.device_count AS congestion, CAST(f.available_chargers AS DOUBLE) AS free,
  CAST(price_c AS DOUBLE) / 100 + CAST(service_c AS DOUBLE) / 100 AS price, CAST(station_status = 'active' AS INTEGER) AS status
FROM stations s JOIN spare f ON f.station_id = s.station_id LEFT JOIN ahead a ON a.station_id = s.station_id
LEFT JOIN past p ON p.station_id = s.station_id"""


def _share(name: str, down: bool) -> str:
    low, high = f"min({name}) OVER ()", f"max({name}) OVER ()"
    share = f"CASE WHEN {low} = {high} THEN 1.0 ELSE ({name} - {low}) / ({high} - {low}) END"
    return f"(1.0 - {share})" if down else f"({share})"


BASE["scored"] = f"""
SELECT *, round_even(100 * (0.14 * status + 0.28 * {_share('load', True)} + 0.20 * {_share('congestion', True)}
  + 0.18 * {_share('free', False)} + 0.08 * {_share('price', True)} + 0.06 * {_share('volume', False)}
  + 0.06 * {_share('frequency', False)}), 2) AS score,
  CASE WHEN status < 1 THEN 'Station is not in normal operating status'
    WHEN free > 0 AND load <= free * 4 THEN 'Low predicted congestion'
    WHEN free > 0 THEN 'Available chargers remain despite forecast load'
    ELSE 'Ranked by prediction and station capacity' END AS reason FROM score_inputs"""
oracle("aggregated_predictions", f"SELECT station_id, round(predicted_load, 4) AS predicted_load, {time_text('peak_time')} AS peak_time FROM ahead")
oracle("aggregated_history", "SELECT station_id, volume AS historical_volume, frequency AS historical_frequency FROM past")
oracle("scoring_frame", f"""
SELECT s.* EXCLUDE (price_c, service_c) REPLACE (round(s.latitude, 6) AS latitude, round(s.longitude, 6) AS longitude, {day_text('s.updated_on')} AS updated_on),
  '00:00-24:00' AS open_time, CAST(price_c AS DOUBLE) / 100 AS electricity_price_cny_kwh, CAST(service_c AS DOUBLE) / 100 AS service_fee_cny_kwh,
  i.available_chargers, round(i.load, 4) AS predicted_load, {time_text('i.peak_time')} AS peak_time, i.volume AS historical_volume,
  i.frequency AS historical_frequency FROM score_inputs i JOIN stations s ON s.station_id = i.station_id""")
oracle("station_score", f"""
SELECT station_id, score, reason, round(load, 4) AS predicted_load, {time_text('peak_time')} AS peak_time FROM scored""")
oracle("recommend_low_load", f"""
SELECT station_id, score, reason, round(load, 4) AS predicted_load, {time_text('peak_time')} AS peak_time, station_name, address
FROM scored WHERE status >= 1 ORDER BY score DESC, station_id LIMIT 5""")
oracle("recommended_stations", f"""
SELECT {_DEPOT}, round(km, 6) AS distance_km, coalesce(score, -1) AS recommend_score, coalesce(free, 0) AS free_pile_count,
  coalesce(working * 100.0 / n, 0) AS online_rate
FROM (SELECT d.*, s.score, {_distance('30.3', '110.4', 'd.latitude', 'd.longitude')} AS km FROM depots d
  LEFT JOIN (SELECT station_id, score FROM scored WHERE status >= 1) s ON s.station_id = d.id
  ORDER BY coalesce(s.score, -1) DESC, km, d.id LIMIT 5)
LEFT JOIN pile_totals ON sid = id""")


oracle("recommended_stations_per_route", """
SELECT round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, routes, id, round(km, 6) AS distance_km, recommend_score,
  CAST(row_number() OVER (PARTITION BY latitude, longitude ORDER BY recommend_score DESC, km, id) AS INTEGER) AS rank
FROM (SELECT r.*, coalesce(floor(s.score / 10), -1) AS recommend_score FROM route_distances r
  LEFT JOIN (SELECT station_id, score FROM scored WHERE status >= 1) s ON s.station_id = r.id) QUALIFY rank <= 5""")


def _alerts(limit: str, kept: str) -> str:
    return f"""
SELECT station_id, {time_text('datetime')} AS peak_time, round(load, 3) AS predicted_load,
  CASE WHEN load / lim >= 1.25 THEN 'critical' WHEN load / lim >= 1 THEN 'high' WHEN load / lim >= 0.85 THEN 'medium' ELSE 'low' END AS alert_level
FROM (SELECT *, CAST(e_m AS DOUBLE) / 1000 AS load, CAST({limit} AS DOUBLE) AS lim FROM hour_load) WHERE {kept}"""


oracle("detect_peaks", _alerts("CASE station_id WHEN 3 THEN 100 WHEN 5 THEN 900 ELSE 300 END", "load / lim >= 0.85"))
oracle("load_alerts", _alerts("250", "load >= lim"))
oracle("ops_advice", """
SELECT CAST(station_id AS VARCHAR) AS station_id, round_even(peak, 2) AS predicted_load, CAST(300 AS DOUBLE) AS threshold,
  CASE WHEN peak >= 300 THEN 'high' WHEN peak >= 300 * 0.85 THEN 'medium' ELSE 'low' END AS priority,
  free AS available_chargers, round_even(volume, 2) AS historical_volume_kwh, frequency AS historical_frequency,
  concat_ws('|',
    CASE WHEN peak >= 300 THEN '立即启动高峰前运维：疏导可用充电桩、提醒用户错峰充电，并检查站内设备温度和供电状态。'
      WHEN peak >= 300 * 0.85 THEN '关注站点负荷上升：提前调度备用桩、通知用户选择相邻站点充电。'
      ELSE '正常运营，继续监控负荷变化并保留备用充电资源。' END,
    CASE WHEN free > 0 THEN '当前可用桩数为 ' || printf('%.1f', free) || '，建议保留至少 ' || greatest(1, CAST(floor(free * 0.3) AS INTEGER)) || ' 个桩作为备用。'
      ELSE '当前站点无可用备桩，建议启动跨站协同调度或引导用户前往邻近站点。' END,
    CASE WHEN station_status <> 'active' THEN '站点状态为 ' || station_status || '，建议优先检查设备在线状态与安全巡检。' END,
    CASE WHEN volume > 0 THEN '历史充电量为 ' || printf('%.1f', round_even(volume, 1)) || ' kWh，近峰值时段已表现出较高使用强度。' END) AS advice
FROM (SELECT coalesce(i.station_id, a.station_id) AS station_id, coalesce(i.free, 0) AS free, coalesce(i.station_status, 'unknown') AS station_status,
  coalesce(i.volume, 0) AS volume, coalesce(i.frequency, 0) AS frequency, coalesce(a.peak, 0) AS peak
  FROM (SELECT * FROM score_inputs WHERE station_id % 7 <> 3) i FULL JOIN ahead a ON a.station_id = i.station_id)""")

# ---- metrics --------------------------------------------------------------

BASE["guesses"] = """
SELECT model, kwh AS y, CASE model WHEN 'previous_hour' THEN a ELSE b END AS p
FROM (SELECT *, lag(kwh, 1) OVER w AS a, lag(kwh, 24) OVER w AS b FROM dense_load WINDOW w AS (PARTITION BY station_id ORDER BY datetime)),
  (VALUES ('previous_hour'), ('previous_day')) AS t(model)"""
BASE["scores_by_model"] = """
SELECT model, count(*) AS n, round(avg(abs(p - y)), 6) AS mae, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse,
  round(coalesce(avg(abs((p - y) / y)) FILTER (abs(y) > 1e-12) * 100, 0), 4) AS mape,
  round(1 - sum((p - y) * (p - y)) / (var_pop(y) * count(*)), 6) AS r2 FROM guesses WHERE p IS NOT NULL GROUP BY model"""
oracle("regression_metrics", "SELECT * EXCLUDE (model) FROM scores_by_model WHERE model = 'previous_hour'")
oracle("select_best", "SELECT CAST(1 AS INTEGER) AS rank, model, mae, rmse, mape, r2, CAST(1 AS INTEGER) AS is_best FROM scores_by_model ORDER BY r2 DESC, model LIMIT 1")
oracle("compare_models", """
SELECT CAST(row_number() OVER (ORDER BY mae, model) AS INTEGER) AS rank, model, mae, rmse, mape, r2,
  CAST(row_number() OVER (ORDER BY mae, model) = 1 AS INTEGER) AS is_best FROM scores_by_model""")

# ---- linear model ---------------------------------------------------------
# Least squares by elimination in feature order; a feature that earlier ones explain gets the coefficient 0.

_CALENDAR = "hour day month weekday_number is_weekend is_workday".split()
_LAG_NAMES = [f"load_lag_{n}h" for n in (1, 2, 3, 24)]
_MODEL = (
    "hour day month weekday_number is_weekend is_holiday is_workday weather_type_code temperature_c humidity_pct precipitation_mm "
    "wind_speed_mps visibility_km is_rain device_count facility_type_code electricity_price_cny_kwh service_fee_cny_kwh "
    "station_status_code dc_fast_device_count ac_slow_device_count avg_rated_power_kw avg_connector_count avg_availability_rate "
    "total_fault_count total_fault_minutes avg_health_score avg_output_power_kw avg_battery_capacity_kwh avg_vehicle_type_code "
    "avg_member_level_code sedan_share suv_share mpv_share commercial_share bronze_share silver_share gold_share platinum_share"
).split() + _LAG_NAMES
_K = len(_MODEL)
_ALL = [*_MODEL, "energy_kwh"]


def _pair(i: int, j: int) -> str:
    return f"sum(d{min(i, j)} * d{max(i, j)})"


BASE["lin_rows"] = f"""
SELECT station_id, location_id, datetime, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _ALL)}
FROM feature_rows WHERE {" AND ".join(f"{c} IS NOT NULL" for c in _ALL)}"""
BASE["lin_places"] = "SELECT t, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT datetime AS t FROM lin_rows)"
BASE["lin_parts"] = """
SELECT r.*, CASE WHEN i < CAST(floor(n * 0.7) AS BIGINT) THEN 'train'
  WHEN i < CAST(floor(n * 0.7) AS BIGINT) + CAST(floor(n * 0.15) AS BIGINT) THEN 'validation' ELSE 'test' END AS part
FROM lin_rows r JOIN lin_places ON t = datetime"""
BASE["lin_means"] = f"SELECT count(*) AS n, [{', '.join(f'avg({c})' for c in _ALL)}] AS a FROM lin_parts WHERE part = 'train'"
BASE["lin_moments"] = f"""
SELECT [{", ".join("[" + ", ".join(_pair(i, j) for j in range(_K + 1)) + "]" for i in range(_K))}] AS m,
  [{", ".join(_pair(i, i) for i in range(_K + 1))}] AS s
FROM (SELECT {", ".join(f"{c} - a[{i + 1}] AS d{i}" for i, c in enumerate(_ALL))} FROM lin_parts, lin_means WHERE part = 'train')"""
BASE["lin_start"] = f"""
SELECT list_transform(range(1, {_K + 1}), lambda i: list_transform(range(1, {_K + 2}), lambda j:
    m[i][j] / (CASE WHEN s[i] > 0 THEN sqrt(s[i]) ELSE 1 END * CASE WHEN s[j] > 0 THEN sqrt(s[j]) ELSE 1 END))) AS m,
  list_transform(range(1, {_K + 1}), lambda i: s[i] / n > 1e-12 * (1 + a[i] * a[i])) AS live
FROM lin_moments, lin_means"""
BASE["lin_solved"] = f"""
SELECT m, used FROM (
  WITH RECURSIVE e(i, m, live, used) AS (
    SELECT CAST(1 AS BIGINT), m, live, CAST([] AS BOOLEAN[]) FROM lin_start
    UNION ALL
    SELECT i + 1, CASE WHEN live[i] AND m[i][i] > 1e-8 THEN
        list_transform(range(1, {_K + 1}), lambda r: CASE WHEN r = i THEN list_transform(m[i], lambda v: v / m[i][i])
          ELSE list_transform(range(1, {_K + 2}), lambda c: m[r][c] - m[r][i] * (m[i][c] / m[i][i])) END) ELSE m END,
      live, list_append(used, live[i] AND m[i][i] > 1e-8)
    FROM e WHERE i <= {_K})
  SELECT * FROM e WHERE i = {_K + 1})"""
BASE["lin_weights"] = f"""
SELECT list_transform(range(1, {_K + 1}), lambda i:
  CASE WHEN used[i] THEN m[i][{_K + 1}] * sqrt(s[{_K + 1}]) / sqrt(s[i]) ELSE 0.0 END) AS b FROM lin_solved, (SELECT s FROM lin_moments)"""
BASE["lin_model"] = f"""
SELECT b, a[{_K + 1}] - list_sum(list_transform(range(1, {_K + 1}), lambda i: b[i] * a[i])) AS c FROM lin_weights, lin_means"""
oracle("linear_model_predictions", f"""
SELECT station_id, location_id, {time_text('datetime')} AS datetime, energy_kwh,
  round(c + {" + ".join(f"b[{i + 1}] * {f}" for i, f in enumerate(_MODEL))}, 3) AS prediction
FROM lin_parts, lin_model WHERE part = 'test'""")
BASE["lin_states"] = f"""
SELECT station_id, last_hour, seen, idle, c + {" + ".join(
    f"b[{i + 1}] * coalesce(CAST(newest.{f} AS DOUBLE), 0)" for i, f in enumerate(_MODEL) if f not in _CALENDAR + _LAG_NAMES)} AS fixed
FROM (SELECT station_id, max(datetime) AS last_hour, list(energy_kwh ORDER BY datetime) AS seen,
    arg_max(energy_kwh, datetime) <= 0 AS idle, arg_max(q, datetime) AS newest
  FROM (SELECT *, q FROM feature_rows q QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY datetime DESC) <= 24) GROUP BY station_id), lin_model"""
BASE["lin_profile"] = "SELECT station_id, hour AS hr, avg(energy_kwh) AS mean FROM feature_rows GROUP BY ALL"


def _weight(name: str) -> str:
    return f"b[{_MODEL.index(name) + 1}]"


_AT = "s.last_hour + to_hours(CAST(f.h + 1 AS INTEGER))"
oracle("model_forecast", f"""
WITH rolled AS (
  WITH RECURSIVE f(station_id, h, seen, load) AS (
    SELECT station_id, CAST(0 AS INTEGER), seen, CAST(0 AS DOUBLE) FROM lin_states
    UNION ALL
    SELECT station_id, h, list_append(seen, load)[-24:], load FROM (
      SELECT station_id, h, seen, CASE WHEN p < 0.05 AND back > 0 THEN back ELSE greatest(0.0, p) END AS load FROM (
        SELECT f.station_id, CAST(f.h + 1 AS INTEGER) AS h, f.seen,
          s.fixed + {_weight('hour')} * hour({_AT}) + {_weight('day')} * day({_AT}) + {_weight('month')} * month({_AT})
          + {_weight('weekday_number')} * (isodow({_AT}) - 1) + {_weight('is_weekend')} * CAST(isodow({_AT}) >= 6 AS INTEGER)
          + {_weight('is_workday')} * CAST(isodow({_AT}) < 6 AS INTEGER)
          + {" + ".join(f"{_weight(f'load_lag_{n}h')} * coalesce(f.seen[-{n}], 0)" for n in (1, 2, 3, 24))} AS p,
          greatest(0.0, CASE WHEN s.idle THEN coalesce(g.mean, 0.0) ELSE f.seen[-1] END) AS back
        FROM f JOIN lin_states s ON s.station_id = f.station_id CROSS JOIN lin_model
        LEFT JOIN lin_profile g ON g.station_id = f.station_id AND g.hr = hour({_AT})
        WHERE f.h < 24)))
  SELECT * FROM f WHERE h > 0)
SELECT a.station_id, {time_text('s.last_hour + to_hours(a.h)')} AS datetime, a.h AS horizon_hour, round(a.load, 3) AS predicted_load_kwh
FROM rolled a JOIN lin_states s ON s.station_id = a.station_id""")

# ---- what jobs write, read back -------------------------------------------

oracle("loaded_table", f"""
SELECT user_id, {time_text('registered_at')} AS registered_at, city, lower(trim(member_level)) AS member_level, vehicle_type,
  battery_capacity_kwh, preferred_platform, registration_channel, user_status
FROM raw_users WHERE lower(trim(member_level)) IN ('bronze', 'silver', 'gold', 'platinum')""")
oracle("stored_features", f"SELECT * REPLACE ({time_text('datetime')} AS datetime) FROM feature_rows")
# The warehouse checks orders against cleaned parents; a broken line does not outlive its rewriting as CSV.
BASE["sound_users"] = "SELECT * FROM raw_users WHERE lower(trim(member_level)) IN ('bronze', 'silver', 'gold', 'platinum')"
BASE["sound_stations"] = "SELECT * FROM raw_stations WHERE try_cast(latitude AS DOUBLE) BETWEEN -90 AND 90"
BASE["sound_devices"] = """
SELECT * FROM raw_devices WHERE try_strptime(last_maintenance_at, '%Y-%m-%d') >= commissioned_at
  AND station_id IN (SELECT station_id FROM sound_stations)"""
BASE["sound_weather"] = "SELECT * FROM good_weather WHERE CAST(location_id AS VARCHAR) IN (SELECT location_id FROM sound_stations)"
BASE["warehouse_checked"] = f"""
SELECT list_concat([x FOR x IN own_issues IF x <> 'corrupt_csv_row'], {_reason_list(_REFERENCE_RULES)}) AS issues
FROM checked c LEFT JOIN sound_users u ON trim(c.user_id) = u.user_id
LEFT JOIN sound_stations s ON trim(c.station_id) = s.station_id
LEFT JOIN sound_devices d ON trim(c.device_id) = d.device_id
LEFT JOIN sound_weather w ON trim(c.weather_id) = w.weather_id"""
oracle("warehouse_quality", """
SELECT 'total_rows' AS metric, count(*) AS count FROM warehouse_checked
UNION ALL SELECT 'valid_rows', count(*) FROM warehouse_checked WHERE len(issues) = 0
UNION ALL SELECT 'rejected_rows', count(*) FROM warehouse_checked WHERE len(issues) > 0
UNION ALL SELECT 'issue:' || i, count(*) FROM (SELECT unnest(issues) AS i FROM warehouse_checked) GROUP BY i""")
BASE["lin_guesses"] = f"""
SELECT station_id, datetime, energy_kwh AS y, c + {" + ".join(f"b[{i + 1}] * {f}" for i, f in enumerate(_MODEL))} AS p
FROM lin_parts, lin_model WHERE part = 'test'"""
oracle("reloaded_model", f"SELECT station_id, {time_text('datetime')} AS datetime, round(p, 3) AS prediction FROM lin_guesses")
oracle("trained_models", """
SELECT CAST(1 AS INTEGER) AS rank, 'linear_regression' AS model, CAST(1 AS INTEGER) AS is_best, round(avg(abs(p - y)), 4) AS mae,
  round(sqrt(avg((p - y) * (p - y))), 4) AS rmse, round(coalesce(avg(abs((p - y) / y)) FILTER (abs(y) > 1e-12) * 100, 0), 2) AS mape,
  round(1 - sum((p - y) * (p - y)) / (var_pop(y) * count(*)), 4) AS r2 FROM lin_guesses""")
