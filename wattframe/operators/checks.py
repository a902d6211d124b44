"""Checks and short looks at a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def duplicate_hours(df: DataFrame, keys: Sequence[str] = ("country", "dateTime")) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(list(keys)).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def require_unique_hours(df: DataFrame, keys: Sequence[str] = ("country", "dateTime")) -> DataFrame:
    """Return ``df``, or raise when a key occurs twice. Runs one job."""
    found = duplicate_hours(df, keys).head(1)
    if found:
        raise ValueError(f"key occurs more than once: {found[0].asDict()}")
    return df


def first_hours(
    df: DataFrame,
    n: int = 24,
    columns: Sequence[str] | None = None,
    series: Sequence[str] = ("country",),
    time: str = "dateTime",
) -> DataFrame:
    """First ``n`` rows of each series in time order.

    Spark keeps at most ``n`` rows per series in every task before it shuffles.
    """
    columns = [c for c in df.columns if c not in (*series, time)] if columns is None else columns
    rank = F.row_number().over(W.partitionBy(*series).orderBy(time))
    ranked = df.select(*series, time, *columns, rank.alias("_rank"))
    return ranked.filter(F.col("_rank") <= n).drop("_rank")


def column_counts(df: DataFrame) -> DataFrame:
    """Number of values present per column, next to the column type."""
    kinds = dict(df.dtypes)
    counts = df.agg(*(F.count(F.col(c)).alias(c) for c in df.columns))
    rows = F.array(
        *(
            F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("type"), F.col(c).alias("present"))
            for c in df.columns
        )
    )
    return counts.select(F.inline(rows))
