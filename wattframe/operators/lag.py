"""Previous value in a ring: the first hour of a series sees the last one."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wattframe.functions import day_of


def circular_lag(
    df: DataFrame,
    columns: Sequence[str],
    series: Sequence[str] = ("country",),
    time: str = "dateTime",
    prefix: str = "previous_",
    totals: Mapping[str, tuple[Column, Callable[[Column], Column]]] | None = None,
    partitions: int | None = None,
    stored: Sequence[str] | None = None,
    unique: bool = False,
) -> DataFrame:
    """Add the previous value of each column in time order, circular within each series.

    A window over a whole series would put a long one into a single task. Rows are therefore split
    by series and day. Only the first row of a day needs more than its own day, and that comes from
    a table with one row per day.

    ``totals`` adds whole-series aggregates through the same day table: a name, the aggregate of a
    day, and the function that combines days. ``partitions`` defaults to the shuffle setting; the
    number is kept as it is, so that work multiplied per row afterwards stays spread out.

    ``stored`` names the columns that the table is stored by (see ``store_by_day``), the day last. They
    must settle the series of a row. Then the rows stay where they are, and only the day table moves.

    With ``unique`` the query stops when a series has two rows of the same time. The rows of a day are
    in time order for the lag anyway, so looking costs no further pass and no job of its own.
    """
    series, columns, totals = list(series), list(columns), dict(totals or {})
    partitions = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    day = [*series, "_day"] if stored is None else list(stored)
    # Rows without a key or a time have no place in the ring. Saying so here, in the terms the join
    # below would use, makes both uses of ``split`` the same, and Spark shuffles it once.
    placed = reduce(and_, [F.col(c).isNotNull() for c in dict.fromkeys([*series, *day])])
    if stored is None:
        split = df.withColumn("_day", day_of(time)).filter(placed).repartition(partitions, *day)
    else:
        split = df.filter(placed & F.col(time).isNotNull())

    in_day = W.partitionBy(*day).orderBy(time)
    rows = split.select(
        "*",
        (F.row_number().over(in_day) == 1).alias("_opens"),
        *([F.lag(time).over(in_day).alias("_same")] if unique else []),
        *(F.lag(c).over(in_day).alias(f"_lag_{c}") for c in columns),
    )
    if unique:
        # A filter, so that the check stays even where no column of it is asked for.
        key = F.concat_ws(", ", *(F.col(c).cast("string") for c in (*series, time)))
        stop = F.raise_error(F.concat(F.lit("key occurs more than once: "), key)).cast("boolean")
        rows = rows.filter(F.when(F.col("_same") == F.col(time), stop).otherwise(F.lit(True)))

    by_day = W.partitionBy(*series).orderBy(day[-1])
    whole = W.partitionBy(*series)
    ring = by_day.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    days = split.groupBy(*dict.fromkeys([*series, *day])).agg(
        *(F.max_by(c, time).alias(f"_last_{c}") for c in columns),
        *(of_day.alias(f"_day_{name}") for name, (of_day, _) in totals.items()),
    )
    days = days.select(
        *day,
        *(
            F.when(F.row_number().over(by_day) == 1, F.last(f"_last_{c}").over(ring))
            .otherwise(F.lag(f"_last_{c}").over(by_day))
            .alias(f"_before_{c}")
            for c in columns
        ),
        *(
            combine(F.col(f"_day_{name}")).over(whole).alias(name)
            for name, (_, combine) in totals.items()
        ),
    )

    previous = [
        F.when(F.col("_opens"), F.col(f"_before_{c}"))
        .otherwise(F.col(f"_lag_{c}"))
        .alias(prefix + c)
        for c in columns
    ]
    # A merge join keeps the rows in their partitions. A broadcast of either side would not: the
    # rows are already sorted for it, and the day table grows with the calendar.
    return rows.join(days.hint("merge"), day).select(*df.columns, *previous, *totals)
