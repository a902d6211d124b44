"""Mean profiles by hour, month and season; stacking."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattframe.functions import SEASONS, season

YEAR_PROFILE = "Hourly: Year"
MONTH_PROFILE = "Monthly"


def _value_columns(df: DataFrame, series: Sequence[str], time: str) -> list[str]:
    return [c for c in df.columns if c not in (*series, time)]


def _partial(df: DataFrame, columns: Sequence[str], series: Sequence[str], time: str) -> DataFrame:
    """Sums and counts per month and hour: at most 288 rows per series, whatever the input size.

    All profiles are rolled up from these few rows, so the hours are read and shuffled once.
    """
    aggregates = []
    for c in columns:
        aggregates += [F.sum(c).alias(f"_sum_{c}"), F.count(c).alias(f"_n_{c}")]
    return df.groupBy(*series, F.month(time).alias("month"), F.hour(time).alias("hour")).agg(*aggregates)


def _means(columns: Sequence[str]) -> list[Column]:
    return [F.try_divide(F.sum(f"_sum_{c}"), F.sum(f"_n_{c}")).alias(c) for c in columns]


def hour_profile(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    series: Sequence[str] = ("country",),
    time: str = "dateTime",
) -> DataFrame:
    """Mean by hour of day over the whole period."""
    columns = list(columns or _value_columns(df, series, time))
    return df.groupBy(*series, F.hour(time).alias("hour")).agg(*(F.avg(c).alias(c) for c in columns))


def month_profile(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    series: Sequence[str] = ("country",),
    time: str = "dateTime",
) -> DataFrame:
    """Mean by month."""
    columns = list(columns or _value_columns(df, series, time))
    return df.groupBy(*series, F.month(time).alias("month")).agg(*(F.avg(c).alias(c) for c in columns))


def season_profiles(
    df: DataFrame,
    seasons: Sequence[str] = tuple(SEASONS),
    columns: Sequence[str] | None = None,
    series: Sequence[str] = ("country",),
    time: str = "dateTime",
) -> DataFrame:
    """Mean by hour of day within each of the given seasons."""
    columns = list(columns or _value_columns(df, series, time))
    months = [m for name in seasons for m in SEASONS[name]]
    chosen = df if len(months) == 12 else df.filter(F.month(time).isin(months))
    return (
        _partial(chosen, columns, series, time)
        .groupBy(*series, season(F.col("month")).alias("season"), "hour")
        .agg(*_means(columns))
    )


def all_profiles(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    series: Sequence[str] = ("country",),
    time: str = "dateTime",
) -> DataFrame:
    """The year, month and season profiles in one table, told apart by ``profile``.

    ``x`` is the hour of day, or the month for the monthly profile.
    """
    columns = list(columns or _value_columns(df, series, time))
    part = F.explode(
        F.array(
            F.struct(F.lit(YEAR_PROFILE).alias("profile"), F.col("hour").alias("x")),
            F.struct(F.lit(MONTH_PROFILE).alias("profile"), F.col("month").alias("x")),
            F.struct(
                F.concat(F.lit("Hourly: "), season(F.col("month"))).alias("profile"),
                F.col("hour").alias("x"),
            ),
        )
    )
    return (
        _partial(df, columns, series, time)
        .withColumn("_part", part)
        .groupBy(*series, F.col("_part.profile").alias("profile"), F.col("_part.x").alias("x"))
        .agg(*_means(columns))
    )


def stack_columns(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Replace each column in ``order`` by the running sum up to it; absent names are skipped."""
    running, stacked = None, {}
    for name in order:
        if name in df.columns:
            running = F.col(name) if running is None else running + F.col(name)
            stacked[name] = running
    return df.select(*(stacked[c].alias(c) if c in stacked else F.col(c) for c in df.columns))


def stacked_profile(
    profile: DataFrame,
    keys: Sequence[str],
    shown: Sequence[str] | Mapping[str, str],
    order: Sequence[str] | None = None,
) -> DataFrame:
    """Profile table ready to draw: stacked when an order is given, only ``shown`` columns."""
    stacked = profile if order is None else stack_columns(profile, order)
    return stacked.select(*keys, *shown)
