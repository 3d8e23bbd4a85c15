"""Column builders: text, clock, numeric, code and distance expressions."""

from voltlens.functions.clock import (
    elapsed_seconds,
    hour_floor,
    monday_index,
    parse_day,
    parse_wall_clock,
    wall_clock,
)
from voltlens.functions.codes import code_of
from voltlens.functions.frames import first_present, require_columns
from voltlens.functions.geo import great_circle_km
from voltlens.functions.numbers import lenient_int, min_max_share, ratio, zero_decimal
from voltlens.functions.text import blank, folded_in, present, trimmed

__all__ = [
    "blank", "code_of", "elapsed_seconds", "first_present", "folded_in",
    "great_circle_km", "hour_floor", "lenient_int", "min_max_share",
    "monday_index", "parse_day", "parse_wall_clock", "present", "ratio",
    "require_columns", "trimmed", "wall_clock", "zero_decimal",
]
