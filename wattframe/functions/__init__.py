from wattframe.functions.calendar import SEASONS, day_of, hour_start, parse_hour, season
from wattframe.functions.names import capitalised, capitalise_columns
from wattframe.functions.numeric import (
    SHARE_TYPE,
    clamp_at_zero,
    decimal_range,
    half_even,
    missing,
    or_zero,
    percent,
    row_sum,
    share_key,
    total,
)

__all__ = [
    "SEASONS",
    "SHARE_TYPE",
    "capitalise_columns",
    "capitalised",
    "clamp_at_zero",
    "day_of",
    "decimal_range",
    "half_even",
    "hour_start",
    "missing",
    "or_zero",
    "parse_hour",
    "percent",
    "row_sum",
    "season",
    "share_key",
    "total",
]
