"""Column expressions for naive timestamps (no zone, no daylight saving)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Months of each season.
SEASONS = {
    "Spring": [3, 4, 5],
    "Summer": [6, 7, 8],
    "Autumn": [9, 10, 11],
    "Winter": [1, 2, 12],
}


def season(month: Column) -> Column:
    """Name of the season of a month number."""
    named = F.lit(None).cast("string")
    for name, months in SEASONS.items():
        named = F.when(month.isin(months), F.lit(name)).otherwise(named)
    return named


def day_of(time: Column | str) -> Column:
    return F.to_date(time)


def hour_start(time: Column | str) -> Column:
    """Start of the hour. ``date_trunc`` is avoided: it takes a detour over the session zone."""
    time = F.col(time) if isinstance(time, str) else time
    return F.timestamp_add("HOUR", F.hour(time), F.to_date(time).cast("timestamp_ntz"))


def parse_hour(text: str) -> Column:
    """Literal timestamp from ``yyyy/MM/dd HH:mm`` or ``yyyy/MM/dd HH``, dashes also allowed."""
    text = text.strip().replace("-", "/").replace("T", " ")
    pattern = {0: "yyyy/MM/dd HH", 1: "yyyy/MM/dd HH:mm", 2: "yyyy/MM/dd HH:mm:ss"}
    if " " not in text:
        text += " 00"
    return F.to_timestamp_ntz(F.lit(text), F.lit(pattern[text.count(":")]))
