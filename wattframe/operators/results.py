"""From scenario results to totals, costs, pivot tables and long tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe.functions import half_even, or_zero, percent, share_key
from wattframe.operators.grid import Share

# The columns that tell scenarios apart, those that are summed, and below the prices of a
# unit of potential output, of storage and of unserved energy.
SCENARIO = ("share_storage", "share_generation", "share_renewable", "curtailRenewableFirst")
SUMMED = (
    "nuclear",
    "renewable",
    "netStorage",
    "demand",
    "energyNotServed",
    "curtailNuclear",
    "curtailRenewable",
)
# What a heat map can show.
VARIABLES = (
    "cost",
    "energyNotServed",
    "curtailRenewablePercent",
    "curtailNuclearPercent",
    "curtailRenewable",
    "curtailNuclear",
)


def with_curtailment_order(results: DataFrame) -> DataFrame:
    """Add ``curtailRenewableFirst``: curtailing renewable costs no more than nuclear."""
    return results.withColumn(
        "curtailRenewableFirst", F.col("costCurtailRenewable") <= F.col("costCurtailNuclear")
    )


def hourly_results(
    results: DataFrame,
    share_generation: Share,
    share_storage: Share,
    share_renewable: Share,
    curtail_renewable_first: bool = True,
) -> DataFrame:
    """Hours of the scenarios with these shares and this curtailment order."""
    chosen = results.filter(
        (F.col("share_generation") == share_key(F.lit(str(share_generation))))
        & (F.col("share_storage") == share_key(F.lit(str(share_storage))))
        & (F.col("share_renewable") == share_key(F.lit(str(share_renewable))))
    )
    return with_curtailment_order(chosen).filter(
        F.col("curtailRenewableFirst") == F.lit(curtail_renewable_first)
    )


def annual_results(results: DataFrame, series: Sequence[str] = ("country",)) -> DataFrame:
    """Sums per scenario and curtailment order, with curtailment in percent of potential output.

    Keys are decimals, so a scenario is never split by the noise of floats. Missing numbers end as 0.
    """
    keys = [*series, *SCENARIO]
    sums = (
        with_curtailment_order(results)
        .groupBy(keys)
        .agg(*(or_zero(F.sum(c)).alias(c) for c in SUMMED))
    )
    shares = {
        f"{curtailed}Percent": or_zero(percent(curtailed, F.col(output) + F.col(curtailed)))
        for output, curtailed in (("nuclear", "curtailNuclear"), ("renewable", "curtailRenewable"))
    }
    return sums.withColumns(shares)


def generation_shares(annual: DataFrame) -> DataFrame:
    """Generation shares present, with 3 digits, in ascending order."""
    share = half_even(F.col("share_generation").cast("double"), 3).cast("decimal(12,3)")
    return annual.select(share.alias("share_generation")).distinct().orderBy("share_generation")


def scenario_cost(
    annual: DataFrame,
    cost_renewable: float = 2.0,
    cost_nuclear: float = 1.0,
    cost_storage: float = 10.0,
    cost_unserved: float = 10.0,
    share_generation: Share = 1,
    curtail_renewable_first: bool = True,
    series: Sequence[str] = ("country",),
) -> DataFrame:
    """Total cost per scenario for one generation share and curtailment order.

    Potential output is paid for, whether used or curtailed; storage by its size.
    """
    chosen = annual.filter(
        (F.col("share_generation") == share_key(F.lit(str(share_generation))))
        & (F.col("curtailRenewableFirst") == F.lit(curtail_renewable_first))
    )
    cost = (
        (F.col("nuclear") + F.col("curtailNuclear")) * F.lit(float(cost_nuclear))
        + (F.col("renewable") + F.col("curtailRenewable")) * F.lit(float(cost_renewable))
        + F.col("energyNotServed") * F.lit(float(cost_unserved))
        + F.col("demand") * F.col("share_storage").cast("double") * F.lit(float(cost_storage))
    )
    keys = [*series, "share_storage", "share_renewable"]
    rest = [c for c in annual.columns if c not in (*keys, "curtailRenewableFirst", "share_generation")]
    return chosen.select(*keys, *rest, cost.alias("cost"))


def _label(share: Share) -> str:
    return f"{float(share) * 100:.10g}"


def heatmap_pivot(
    costs: DataFrame,
    share_renewable: Sequence[Share],
    variable: str = "cost",
    series: Sequence[str] = ("country",),
) -> DataFrame:
    """Mean of ``variable`` by storage share (rows) and renewable share (columns), both in percent.

    The renewable shares are given, so no extra job has to find them. A share that occurs but is not
    given stops the query: the table would be incomplete.
    """
    if variable not in VARIABLES:
        raise ValueError(f"no such variable: {variable}")
    cells = (
        F.avg(F.when(F.col("share_renewable") == share_key(F.lit(str(s))), F.col(variable))).alias(_label(s))
        for s in share_renewable
    )
    listed = F.col("share_renewable").isin(*(share_key(F.lit(str(s))) for s in share_renewable))
    share = F.coalesce(F.col("share_renewable").cast("string"), F.lit("missing"))
    other = F.raise_error(F.concat(F.lit("share not given: "), share)).cast("double")
    costs = costs.withColumn(variable, F.when(listed, F.col(variable)).otherwise(other))
    rows = costs.groupBy(*series, "share_storage").agg(*cells)
    percent_storage = (F.col("share_storage") * 100).cast("double").alias("storagePercent")
    return rows.select(*series, percent_storage, *(f"`{_label(s)}`" for s in share_renewable))


def count_per_storage(costs: DataFrame, series: Sequence[str] = ("country",)) -> DataFrame:
    """How many renewable shares there are per storage share."""
    return costs.groupBy(*series, "share_storage").agg(F.count("share_renewable").alias("n"))


def melt_generation(
    results: DataFrame,
    columns: Sequence[str] = ("netStorage", "nuclear", "renewable", "energyNotServed"),
    keys: Sequence[str] = ("date",),
) -> DataFrame:
    """One row per key and technology; 0 becomes missing."""
    long = results.unpivot(list(keys), list(columns), "technology", "value")
    return long.withColumn("value", F.nullif(F.col("value"), F.lit(0.0)))


def union_results(parts: Sequence[DataFrame]) -> DataFrame:
    """Results of several runs in one table, columns matched by name, absent ones missing."""
    if not parts:
        raise ValueError("nothing to put together")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
