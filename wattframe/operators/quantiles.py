"""Exact quantiles by rank, without a buffer that holds the values of a group.

Each double is mapped to a whole number of the same order. Values are counted per range of these
numbers, the counts are added up in order, and only the ranges that hold a wanted rank are looked into
again, cut finer. After the last cut a range is a single number. Counts combine inside each task before
they are shuffled, so a group with most of the rows is no burden, and the windows that add counts up
have at most 2^24 and 2^20 rows, whatever the number of values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bits left out of the ordered number at each cut.
CUTS = (40, 20, 0)


def with_ordered_number(df: DataFrame, value: str, into: str) -> DataFrame:
    """Add a whole number that orders as the double does; null for null and NaN.

    It is the exponent followed by the fraction, both found by exact arithmetic: powers of two are
    exact, and so is dividing by them. The logarithm may be off by one next to a power of two, which
    the comparison after it puts right. Steps are columns of their own, so that none is worked out, or
    compiled, more than once.
    """
    size, guess, exponent, power = F.abs(value), F.col("_guess"), F.col("_exponent"), F.col("_power")
    least = F.lit(2.0**-1022)
    guessed = F.least(F.greatest(F.floor(F.log2(size)), F.lit(-1022)), F.lit(1023))
    df = df.withColumn("_guess", guessed).withColumn("_power", F.pow(F.lit(2.0), guess.cast("double")))
    below, above = (size < power) & (guess > -1022), (guess < 1023) & (size / 2 >= power)
    df = df.withColumns(
        {
            "_exponent": F.when(below, guess - 1).when(above, guess + 1).otherwise(guess),
            "_power": F.when(below, power / 2).when(above, power * 2).otherwise(power),
        }
    )
    # Numbers below the least normal one have no leading 1, and their exponent counts as 0.
    fraction = F.when(size >= least, size / power - 1).otherwise(size / least)
    place = F.when(size >= least, exponent + 1023).otherwise(F.lit(0)).cast("long")
    number = place * F.lit(1 << 52) + (fraction * F.lit(2.0**52)).cast("long")
    number = F.when(size == float("inf"), F.lit(2047 << 52)).when(size == 0, F.lit(0)).otherwise(number)
    number = F.when(F.isnan(value), F.lit(None)).otherwise(number * F.when(F.col(value) < 0, -1).otherwise(1))
    return df.select(*(c for c in df.columns if c not in ("_guess", "_power", "_exponent")), number.alias(into))


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    fractions: Sequence[float],
    names: Sequence[str],
    count: str = "n",
    lowest: str = "lowest",
    highest: str = "highest",
    few_groups: bool = False,
) -> DataFrame:
    """Per group: number of values, the least, the greatest, and interpolated quantiles.

    Null and NaN are not counted. A group without values has 0 and missing numbers. Between the two
    values next to a quantile's place, (n - 1) * fraction, the quantile is interpolated. Keys may be
    missing; equal ones, missing ones too, are a group.

    ``few_groups`` is for callers whose groups come from a fixed list: the ranges to look into, at most
    two per group and quantile, are then broadcast. Otherwise they are joined as their size tells.
    """
    keys = list(keys)
    rows = with_ordered_number(df.select(*keys, F.col(value).alias("_value")), "_value", "_number")
    group = [F.col(k) for k in keys]

    counted = rows.groupBy(*keys, F.shiftright("_number", CUTS[0]).alias("_range")).agg(
        F.count("_number").alias("_n"),
        F.min(F.when(F.col("_number").isNotNull(), F.col("_value"))).alias("_least"),
        F.max(F.when(F.col("_number").isNotNull(), F.col("_value"))).alias("_most"),
    )
    by_group = W.partitionBy(*group)
    counted = counted.select(
        "*",
        F.sum("_n").over(by_group).alias("_all"),
        F.min("_least").over(by_group).alias("_lowest"),
        F.max("_most").over(by_group).alias("_highest"),
        (F.sum("_n").over(by_group.orderBy(F.col("_range").asc_nulls_last())) - F.col("_n")).alias("_before"),
    )
    # Ranks from 0 of the two values next to each quantile, for each the range that holds it.
    places = [F.lit(float(f)) * (F.col("_all") - 1) for f in fractions]
    ranks = [rank.cast("long") for place in places for rank in (F.floor(place), F.ceil(place))]
    wanted = [f"_rank_{i}" for i in range(len(ranks))]
    whole = ["_all", "_lowest", "_highest"]  # the same in all ranges of a group
    targets = _holding(counted.withColumns(dict(zip(wanted, ranks))), wanted)
    targets = targets.select(*keys, "_range", *whole, *wanted)

    for before, cut in zip(CUTS, CUTS[1:]):
        held = targets.withColumnsRenamed({k: f"_key_{i}" for i, k in enumerate(keys)})
        held = F.broadcast(held) if few_groups else held
        same = [F.col(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys)]
        finer = rows.join(held, [*same, F.shiftright("_number", before) == F.col("_range")]).groupBy(
            *keys, F.col("_range").alias("_held"), F.shiftright("_number", cut).alias("_finer")
        )
        finer = finer.agg(
            F.count("*").alias("_n"),
            *([F.min("_value").alias("_found")] if cut == 0 else []),
            *(F.max(c).alias(c) for c in (*whole, *wanted)),
        )
        within = W.partitionBy(*group, "_held").orderBy("_finer")
        finer = _holding(finer.withColumn("_before", F.sum("_n").over(within) - F.col("_n")), wanted)
        targets = finer.withColumnRenamed("_finer", "_range").drop("_held", "_n", "_before")

    ends = targets.groupBy(*keys).agg(
        *(F.max(c).alias(c) for c in whole),
        *(F.min(F.when(F.col(w).isNotNull(), F.col("_found"))).alias(f"_end_{i}") for i, w in enumerate(wanted)),
    )
    # Groups without values have no range that holds a rank.
    empty = counted.filter("_all = 0").select(*keys, *whole)
    out = ends.unionByName(empty, allowMissingColumns=True).withColumnsRenamed(
        dict(zip(whole, (count, lowest, highest)))
    )
    columns = []
    for i, (fraction, name) in enumerate(zip(fractions, names)):
        place = F.lit(float(fraction)) * (F.col(count) - 1)
        low, high = F.floor(place), F.ceil(place)
        between = (high - place) * F.col(f"_end_{2 * i}") + (place - low) * F.col(f"_end_{2 * i + 1}")
        columns.append(F.when(low == high, F.col(f"_end_{2 * i}")).otherwise(between).alias(name))
    return out.select(*keys, count, lowest, *columns, highest)


def _holding(ranges: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Ranges of values that hold a wanted rank, with the rank within the range; missing for ranks elsewhere."""
    inside = {
        w: F.when((F.col(w) >= F.col("_before")) & (F.col(w) < F.col("_before") + F.col("_n")), F.col(w) - F.col("_before"))
        for w in wanted
    }
    return ranges.withColumns(inside).filter(F.coalesce(*wanted).isNotNull())
