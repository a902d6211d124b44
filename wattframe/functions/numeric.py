"""Column expressions for numbers: missing values, rounding, clamping, shares."""

from __future__ import annotations

from collections.abc import Iterable
from decimal import Decimal
from functools import reduce
from math import ceil
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shares are compared for equality, so they are decimals and never floats.
SHARE_TYPE = "decimal(12,8)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def missing(c: Column | str) -> Column:
    """NaN becomes null. Otherwise ``NaN > 9`` holds and sums turn into NaN."""
    return F.nullif(_col(c), F.lit(float("nan")))


def or_zero(c: Column | str) -> Column:
    return F.coalesce(_col(c), F.lit(0.0))


def total(c: Column | str) -> Column:
    """Sum that skips missing values and is 0 when all are missing."""
    return F.coalesce(F.sum(_col(c)), F.lit(0.0))


def row_sum(columns: Iterable[Column | str]) -> Column:
    """Sum over columns of one row, a missing value counting as 0."""
    return reduce(add, [or_zero(c) for c in columns], F.lit(0.0))


def clamp_at_zero(c: Column | str) -> Column:
    """``max(c, 0)``, missing when ``c`` is missing (bare ``greatest`` would give 0)."""
    c = _col(c)
    return F.when(c.isNotNull(), F.greatest(c, F.lit(0.0)))


def percent(part: Column | str, whole: Column | str) -> Column:
    """``100 * part / whole``, missing when ``whole`` is 0."""
    return F.try_divide(_col(part), _col(whole)) * F.lit(100.0)


def half_even(c: Column | str, digits: int = 0) -> Column:
    """Round to ``digits``, halves going to the even neighbour: 0.25 gives 0.2."""
    if digits == 0:
        return F.rint(_col(c))
    scale = F.lit(float(10**digits))
    return F.rint(_col(c) * scale) / scale


def share_key(c: Column | str) -> Column:
    """Share as a decimal with 8 digits, fit for equality and grouping."""
    return _col(c).cast(SHARE_TYPE)


def decimal_range(start: str | int, stop: str | int, step: str | int) -> list[Decimal]:
    """Half-open range of exact decimals, for scenario grids."""
    first, last, width = (Decimal(str(v)) for v in (start, stop, step))
    if width <= 0:
        raise ValueError("step must be positive")
    return [first + width * i for i in range(max(0, ceil((last - first) / width)))]
