"""Sums over bins of n days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wattframe.functions import day_of, or_zero, percent, total


def resample_days(
    df: DataFrame,
    days: int = 1,
    columns: Sequence[str] | None = None,
    series: Sequence[str] = ("country",),
    time: str = "dateTime",
) -> DataFrame:
    """Sum into bins of ``days`` days that start at the first day of each series.

    A bin without rows, and a column missing throughout a bin, give 0. The hours are summed to days
    first; bins, their origin and the empty ones come from the days, of which the calendar allows
    only so many per series.
    """
    if days < 1:
        raise ValueError("days must be at least 1")
    series = list(series)
    columns = list(columns or [c for c in df.columns if c not in (*series, time)])
    daily = (
        df.filter(F.col(time).isNotNull())
        .groupBy(*series, day_of(time).alias("_day"))
        .agg(*(total(c).alias(c) for c in columns))
    )
    numbered = daily.withColumn("_first", F.min("_day").over(W.partitionBy(*series)))
    numbered = numbered.withColumn(
        "_bin", F.floor(F.datediff("_day", "_first") / days).cast("int")
    )
    filled = numbered.groupBy(*series, "_first", "_bin").agg(*(F.sum(c).alias(c) for c in columns))
    # Each filled bin also stands for the empty ones that follow it, up to the next filled bin.
    following = F.lead("_bin").over(W.partitionBy(*series).orderBy("_bin"))
    reach = filled.withColumn("_last", F.coalesce(following - 1, F.col("_bin")))
    spread = reach.withColumn("_at", F.explode(F.sequence("_bin", "_last")))
    start = F.date_add("_first", F.col("_at") * days).cast("timestamp_ntz")
    own = F.col("_at") == F.col("_bin")
    return spread.select(
        *series, start.alias(time), *(F.when(own, or_zero(c)).otherwise(0.0).alias(c) for c in columns)
    )


def resample_days_percent(
    df: DataFrame,
    days: int = 1,
    columns: Sequence[str] | None = None,
    series: Sequence[str] = ("country",),
    time: str = "dateTime",
    demand: str = "Demand",
) -> DataFrame:
    """The same bins in percent of their demand; missing where a bin has no demand."""
    sums = resample_days(df, days, columns, series, time)
    values = [c for c in sums.columns if c not in (*series, time)]
    return sums.select(*series, time, *(percent(c, demand).alias(c) for c in values))
