"""Calendar dimension: weekends, holidays, make-up workdays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from voltlens.functions import monday_index

NO_HOLIDAY = "非节假日"  # fixed value

# Public holidays and make-up workdays of 2015.
HOLIDAYS = (
    ("2015-01-01", "2015-01-03", "元旦"),
    ("2015-02-18", "2015-02-24", "春节"),
    ("2015-04-04", "2015-04-06", "清明节"),
    ("2015-05-01", "2015-05-03", "劳动节"),
    ("2015-06-20", "2015-06-22", "端午节"),
    ("2015-09-03", "2015-09-05", "抗战胜利纪念日"),
    ("2015-09-26", "2015-09-27", "中秋节"),
    ("2015-10-01", "2015-10-07", "国庆节"),
)
MAKEUP_WORKDAYS = ("2015-01-04", "2015-02-15", "2015-02-28", "2015-09-06", "2015-10-10")


def calendar_columns(
    day: Column, holidays=HOLIDAYS, makeup_workdays=MAKEUP_WORKDAYS
) -> dict[str, Column]:
    """Calendar attributes of a date.

    The holiday list is short and fixed, so it becomes a CASE expression
    instead of a range join.
    """
    def as_date(value: str) -> Column:
        return F.lit(value).cast("date")

    name = reduce(
        lambda rest, span: F.when(day.between(as_date(span[0]), as_date(span[1])), F.lit(span[2])).otherwise(rest),
        holidays,
        F.lit(NO_HOLIDAY),
    )
    weekend = monday_index(day) >= 5
    holiday = name != NO_HOLIDAY
    made_up = day.isin(*[as_date(value) for value in makeup_workdays])
    return {
        "is_weekend": weekend.cast("int"),
        "is_holiday": holiday.cast("int"),
        "holiday_name": name,
        "is_workday": ((~weekend & ~holiday) | made_up).cast("int"),
    }


def day_sequence(bounds: DataFrame, first: str, last: str, name: str) -> DataFrame:
    """One row per day between two date columns of the one-row frame ``bounds``."""
    return bounds.where(F.col(first).isNotNull()).select(
        F.explode(F.sequence(F.col(first), F.col(last), F.expr("interval 1 day"))).alias(name)
    )


def calendar_dimension(bounds: DataFrame, first: str = "first_day", last: str = "last_day") -> DataFrame:
    """One row per day of the span with its calendar attributes."""
    days = day_sequence(bounds, first, last, "calendar_date")
    columns = calendar_columns(F.col("calendar_date"))
    return days.select("calendar_date", *[column.alias(name) for name, column in columns.items()])
