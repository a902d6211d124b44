"""Surplus and shortage per hour, and what they add up to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe.functions import clamp_at_zero, half_even, row_sum, total

MEASURES = ("ExcessSupply", "ExcessDemand")
STATISTICS = ("Total", "TotalPercentOfDemand", "Max", "Hours")


def storage_hourly(
    df: DataFrame,
    supply: Sequence[str] | None = None,
    series: Sequence[str] = ("country",),
    time: str = "dateTime",
    demand: str = "Demand",
) -> DataFrame:
    """Add total supply, and its excess over demand and shortfall below it.

    Without ``supply`` every column but the keys and demand counts as supply. Both measures are
    missing where demand is.
    """
    if supply is None:
        supply = [c for c in df.columns if c not in (*series, time, demand)]
    return (
        df.withColumn("TotalSupply", row_sum(supply))
        .withColumn("ExcessSupply", clamp_at_zero(F.col("TotalSupply") - F.col(demand)))
        .withColumn("ExcessDemand", clamp_at_zero(F.col(demand) - F.col("TotalSupply")))
    )


def storage_stats(
    hourly: DataFrame,
    series: Sequence[str] = ("country",),
    demand: str = "Demand",
    threshold: float = 9,
) -> DataFrame:
    """Total, percent of demand, maximum and number of hours above ``threshold``, per measure.

    One pass over the hours; the turn into one row per measure works on its result.
    """
    aggregates = [total(demand).alias("_demand")]
    for m in MEASURES:
        aggregates += [
            total(m).alias(f"_total_{m}"),
            F.max(m).alias(f"_max_{m}"),
            F.count_if(F.col(m) > threshold).cast("double").alias(f"_hours_{m}"),
        ]
    rows = []
    for m in MEASURES:
        share = F.when(
            F.col("_demand") != 0, F.try_divide(F.col(f"_total_{m}"), F.col("_demand")) * 100
        ).otherwise(0.0)
        values = (F.col(f"_total_{m}"), share, F.col(f"_max_{m}"), F.col(f"_hours_{m}"))
        rows.append(
            F.struct(
                F.lit(m).alias("measure"),
                *(half_even(v, 1).alias(name) for name, v in zip(STATISTICS, values)),
            )
        )
    return hourly.groupBy(list(series)).agg(*aggregates).select(*series, F.inline(F.array(*rows)))


def transpose_stats(stats: DataFrame, series: Sequence[str] = ("country",)) -> DataFrame:
    """The same numbers with one row per statistic and one column per measure."""
    return (
        stats.unpivot([*series, "measure"], list(STATISTICS), "statistic", "value")
        .groupBy(*series, "statistic")
        .pivot("measure", list(MEASURES))
        .agg(F.max("value"))
    )
