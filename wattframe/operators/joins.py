"""Attach totals of a series to each of its hours."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wattframe.functions import day_of

# Hours without a time still belong to their series; they share a day of their own.
NO_DAY = "0001-01-01"


def with_totals(
    rows: DataFrame,
    amounts: Mapping[str, Column],
    series: Sequence[str],
    time: str,
    stored: Sequence[str] | None = None,
) -> DataFrame:
    """``rows`` with one column per entry of ``amounts``: the sum over the row's series.

    Rows are dealt out by series and day, once. Each day is summed where it lies, the days of a series
    are added up in a table with one row per day, and that table is merged with the rows by the same key.
    So there is one scan, no job before the query runs, and no task that gets a whole series.

    ``stored`` names the columns that the table is stored by (see ``store_by_day``), the day last. They
    must settle the series of a row. Then the rows stay where they are, and only the day table moves.
    """
    series = list(series)
    whole = W.partitionBy(*series)
    if stored is None:
        day = [*series, "_day"]
        split = rows.withColumn("_day", F.coalesce(day_of(time), F.lit(NO_DAY).cast("date")))
        split = split.repartition(*day)
    else:
        day, split = list(stored), rows
    keys = [*series, *(c for c in day if c not in series)]
    days = split.groupBy(keys).agg(*(c.alias(name) for name, c in amounts.items()))
    days = days.select(*day, *(F.sum(name).over(whole).alias(name) for name in amounts))
    joined = split.join(days.hint("merge"), day, "left")
    return joined.drop("_day") if stored is None else joined.select(*rows.columns, *amounts)
