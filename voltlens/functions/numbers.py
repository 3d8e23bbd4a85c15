"""Number parsing, guarded ratios and scaling."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def lenient_int(text: Column) -> Column:
    """Integer from text, dropping a decimal part ("15.0" is 15); null otherwise."""
    return F.regexp_replace(F.trim(text), r"^([+-]?\d+)\.\d*$", "$1").try_cast("int")


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom``, null when ``bottom`` is 0 or null."""
    return F.try_divide(top, bottom)


def zero_decimal(precision: int, scale: int) -> Column:
    return F.lit(0).cast(f"decimal({precision},{scale})")


def min_max_share(value: Column, low: Column, high: Column, lower_is_better: bool = False) -> Column:
    """Position of ``value`` between ``low`` and ``high`` as 0..1.

    A constant column counts as 1, and therefore as 0 when lower is better.
    """
    share = F.when(high == low, F.lit(1.0)).otherwise((value - low) / (high - low))
    if lower_is_better:
        share = F.lit(1.0) - share
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))
