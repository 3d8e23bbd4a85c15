"""Wall-clock time.

Charging logs carry local wall-clock times without a zone, so all times are
TIMESTAMP_NTZ here and no result depends on ``spark.sql.session.timeZone``.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The two accepted text forms, yyyy-MM-dd HH:mm:ss and d/M/yyyy H:mm.
ISO_FORM = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"
DAY_FIRST_FORM = r"^(\d{1,2})/(\d{1,2})/(\d{4}) (\d{1,2}):(\d{2})$"


def parse_wall_clock(text: Column) -> Column:
    """Parse either accepted text form; anything else, or an impossible date, is null."""
    value = F.trim(text)
    iso_text = F.when(value.rlike(ISO_FORM), value).when(
        value.rlike(DAY_FIRST_FORM),
        F.regexp_replace(value, DAY_FIRST_FORM, "$3-$2-$1 $4:$5:00"),
    )
    return iso_text.try_cast("timestamp_ntz")


def wall_clock(df, name: str) -> Column:
    """Column ``name`` as TIMESTAMP_NTZ, parsing it when it is text."""
    if dict(df.dtypes)[name] == "string":
        return parse_wall_clock(F.col(name))
    return F.col(name).cast("timestamp_ntz")


def parse_day(text: Column) -> Column:
    """``yyyy-MM-dd`` text as a date, else null."""
    value = F.trim(text)
    return F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), value).try_cast("date")


def hour_floor(at: Column) -> Column:
    """Start of the hour, built from date and hour so that no zone is involved."""
    midnight = F.to_date(at).cast("timestamp_ntz")
    return midnight + F.make_dt_interval(F.lit(0), F.hour(at))


def monday_index(at: Column) -> Column:
    """Weekday number with Monday = 0."""
    return F.weekday(at)


def elapsed_seconds(start: Column, end: Column) -> Column:
    return F.timestamp_diff("SECOND", start, end)
