"""Scale observed profiles to chosen shares of demand."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe.functions import or_zero, total
from wattframe.operators.joins import with_totals


def with_wind(df: DataFrame) -> DataFrame:
    """Add ``Wind``, the sum of offshore and onshore, a missing one counting as 0."""
    return df.withColumn("Wind", or_zero("WindOffshore") + or_zero("WindOnshore"))


def normalize_generation(
    df: DataFrame,
    shares: Mapping[str, float],
    total_demand: float = 0,
    series: Sequence[str] = ("country",),
    time: str = "dateTime",
    demand: str = "Demand",
    constant: str = "Constant",
    stored: Sequence[str] | None = None,
) -> DataFrame:
    """Scale each technology so that its sum is the given share of total demand.

    The name ``constant`` stands for a technology with the same value in every hour. A
    ``total_demand`` of 0 keeps the observed demand. A column that sums to 0 has no profile and
    becomes missing. ``stored`` is that of ``with_totals``.
    """
    factors = {**shares, demand: 1}
    observed = [c for c in factors if c != constant]
    unknown = [c for c in observed if c not in df.columns]
    if unknown:
        raise ValueError(f"no such column: {', '.join(unknown)}")
    series = list(series)
    amounts = {"_hours": F.count("*"), **{f"_sum_{c}": total(c) for c in observed}}
    level = F.col(f"_sum_{demand}") if total_demand == 0 else F.lit(float(total_demand))
    scaled = []
    for name, factor in factors.items():
        if name == constant:
            profile = F.lit(1.0) / F.col("_hours")
        else:
            profile = F.try_divide(F.col(name), F.col(f"_sum_{name}"))
        scaled.append((profile * level * F.lit(float(factor))).alias(name))
    kept = [c for c in stored or () if c not in series]
    wanted = df.select(*series, *kept, time, *observed)
    return with_totals(wanted, amounts, series, time, stored).select(*series, time, *scaled)
