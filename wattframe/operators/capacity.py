"""Generation of a calendar year against installed capacity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe.functions import capitalise_columns, half_even, parse_hour, total
from wattframe.operators.normalize import with_wind
from wattframe.sources.readers import within

KEYS = ("country", "year")
OVERVIEW = ("Wind", "Solar")


def generation_year(
    hourly: DataFrame, country: str | None = None, year: int | None = None
) -> DataFrame:
    """Hours of a calendar year, 1 January 00:00 to 31 December 23:00, both included.

    Columns are capitalised and ``Wind`` is added. Without ``country`` or ``year`` all of them are
    returned, told apart by these two columns.
    """
    if country is not None:
        hourly = hourly.filter(F.col("country") == country)
    if year is not None:
        first, last = parse_hour(f"{year:04d}/01/01 00:00"), parse_hour(f"{year:04d}/12/31 23:00")
        hourly = within(hourly, first, last)
    else:
        hourly = hourly.drop("year")
        last = F.make_timestamp_ntz(
            F.year("dateTime"), F.lit(12), F.lit(31), F.lit(23), F.lit(0), F.lit(0)
        )
        hourly = hourly.filter(F.col("dateTime") <= last)
    named = with_wind(capitalise_columns(hourly, keep=("country", "dateTime")))
    rest = [c for c in named.columns if c not in ("country", "dateTime")]
    return named.select("country", F.year("dateTime").alias("year"), "dateTime", *rest)


def capacity_stats(
    generation: DataFrame,
    capacity: DataFrame,
    keys: Sequence[str] = KEYS,
    time: str = "dateTime",
    demand: str = "Demand",
) -> DataFrame:
    """Capacity, annual generation, full-load hours and demand share per technology.

    Several capacity rows for one key are added up. Without any, capacity and full-load hours are
    missing. Both sides are summed before they meet, so the join is over a few rows per key.
    """
    keys = list(keys)
    technologies = [c for c in generation.columns if c not in (*keys, time)]
    generated = (
        generation.groupBy(keys)
        .agg(*(total(c).alias(c) for c in technologies))
        .withColumn("_demand", F.col(demand))
        .unpivot([*keys, "_demand"], technologies, "technology", "AnnualGeneration")
    )
    installed = capitalise_columns(capacity, keep=keys)
    names = [c for c in installed.columns if c not in keys]
    installed = with_wind(installed.groupBy(keys).agg(*(F.sum(c).alias(c) for c in names)))
    installed = installed.unpivot(keys, [*names, "Wind"], "technology", "Capacity")
    joined = generated.join(installed, [*keys, "technology"], "full_outer")
    # A technology with capacity and no generation column has no generation known; 0 is for a column
    # that has no hours of the key.
    known = F.col("technology").isin(*technologies)
    annual = F.when(known, F.coalesce("AnnualGeneration", F.lit(0.0)))
    return joined.select(
        *keys,
        "technology",
        "Capacity",
        annual.alias("AnnualGeneration"),
        F.try_divide(annual, F.col("Capacity")).alias("FullloadHours"),
        F.try_divide(annual * 100, F.col("_demand")).alias("DemandShare"),
    )


def observed_overview(stats: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Four rounded figures for wind and solar, one row per figure."""
    figures = {
        "Capacity [GW]": F.col("Capacity") / 1000,
        "Annual Gen. [TWh]": F.col("AnnualGeneration") / 1000000,
        "Fullload Hours [#]": F.col("FullloadHours"),
        "Demand Share [%]": F.col("DemandShare"),
    }
    rows = F.array(
        *(
            F.struct(F.lit(name).alias("figure"), half_even(value).alias("value"))
            for name, value in figures.items()
        )
    )
    return (
        stats.filter(F.col("technology").isin(*OVERVIEW))
        .select(*keys, "technology", F.inline(rows))
        .groupBy(*keys, "figure")
        .pivot("technology", list(OVERVIEW))
        .agg(F.max("value"))
    )


def implied_capacity(
    normalised: DataFrame,
    stats: DataFrame,
    keys: Sequence[str] = KEYS,
    technologies: Sequence[str] = OVERVIEW,
) -> DataFrame:
    """Capacity in thousands that the normalised generation takes at observed full-load hours."""
    sums = (
        normalised.groupBy(list(keys))
        .agg(*(total(t).alias(t) for t in technologies))
        .unpivot(list(keys), list(technologies), "technology", "generation")
    )
    # Fixed value: the small number keeps a technology without full-load hours from dividing by 0.
    capacity = F.col("generation") / (F.col("FullloadHours") + F.lit(0.0000001)) / 1000
    hours = stats.select(*keys, "technology", "FullloadHours")
    return sums.join(hours, [*keys, "technology"]).select(
        *keys, "technology", half_even(capacity, 2).alias("impliedCapacity")
    )


def implied_from_hours(
    generation: DataFrame,
    shares: Mapping[str, float],
    total_demand: float = 0,
    capacity: DataFrame | None = None,
    keys: Sequence[str] = KEYS,
    technologies: Sequence[str] = OVERVIEW,
    demand: str = "Demand",
) -> DataFrame:
    """``implied_capacity`` straight from the hours, by one grouping.

    A normalised profile adds up to its share of total demand, and full-load hours need sums alone, so
    the hours are neither normalised nor read twice. Without ``capacity`` the greatest hourly value of
    a technology counts as its capacity, and that of ``Wind`` is the sum of its two parts.
    """
    keys = list(keys)
    parts = ("WindOnshore", "WindOffshore", "Solar")
    sums = generation.groupBy(keys).agg(
        total(demand).alias("_demand"),
        *(total(t).alias(f"_sum_{t}") for t in technologies),
        *(F.max(p).alias(p) for p in parts if capacity is None),
    )
    if capacity is None:
        installed = with_wind(sums)
    else:
        installed = capitalise_columns(capacity, keep=keys)
        names = [c for c in installed.columns if c not in keys]
        installed = with_wind(installed.groupBy(keys).agg(*(F.sum(c).alias(c) for c in names)))
        installed = sums.join(installed, keys, "left")
    level = F.col("_demand") if total_demand == 0 else F.lit(float(total_demand))
    rows = []
    for t in technologies:
        normalised = F.when(F.col(f"_sum_{t}") != 0, level * F.lit(float(shares[t]))).otherwise(0.0)
        hours = F.try_divide(F.col(f"_sum_{t}"), F.col(t))
        # Fixed value: as in ``implied_capacity``.
        implied = half_even(normalised / (hours + F.lit(0.0000001)) / 1000, 2)
        rows.append(F.struct(F.lit(t).alias("technology"), implied.alias("impliedCapacity")))
    return installed.select(*keys, F.inline(F.array(*rows)))
