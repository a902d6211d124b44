"""Scenario inputs and merit-order dispatch.

The program behind the dispatch minimises, over all hours, unserved energy plus priced curtailment:

    balance     nuclear + renewable + storage level + unserved = demand
    bounds      0 <= generation <= potential,  0 <= storage level <= size
    accounting  previous level + injection - release = level   (circular)

Injection and release are unbounded and have no cost, so the accounting can be met for any path of
the level and binds nothing. Hours are independent, and each is filled in order of marginal cost:
minus the curtailment cost for generation, 0 for storage, 1 for unserved energy. Where costs tie,
technologies go before storage, storage before unserved energy, and nuclear before renewable. Ties
leave the objective and unserved energy as they are; only the split between tied resources depends
on this rule.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattframe.functions import or_zero
from wattframe.operators.grid import DEFAULT_COSTS, Share, scenario_attributes, spread_scenarios
from wattframe.operators.lag import circular_lag

AMOUNTS = (
    "nuclear",
    "renewable",
    "netStorage",
    "demand",
    "energyNotServed",
    "storageLevel",
    "curtailNuclear",
    "curtailRenewable",
)
ATTRIBUTES = (
    "share_generation",
    "share_renewable",
    "share_storage",
    "costCurtailNuclear",
    "costCurtailRenewable",
)

_TOTALS = {
    "_sum_demand": (F.sum, "demand", F.sum),
    "_sum_renewable": (F.sum, "renewable", F.sum),
    "_min_demand": (F.min, "demand", F.min),
    "_max_demand": (F.max, "demand", F.max),
    "_min_renewable": (F.min, "renewable", F.min),
    "_max_renewable": (F.max, "renewable", F.max),
    "_hours": (F.count, "*", F.sum),
}


def _readings(
    hourly: DataFrame, renewable: str, series: Sequence[str], time: str, kept: Sequence[str] = ()
) -> DataFrame:
    """Demand and the chosen renewable source, missing values as 0."""
    if renewable not in hourly.columns:
        raise ValueError(f"no such column: {renewable}")
    return hourly.select(
        *series,
        *kept,
        F.col(time).alias("date"),
        or_zero("demand").alias("demand"),
        or_zero(renewable).alias("renewable"),
    )


def _total_demand(total_demand: float | None) -> Column:
    return F.col("_sum_demand") if total_demand is None else F.lit(float(total_demand))


def hourly_inputs(
    hourly: DataFrame,
    renewable: str = "windOnshore",
    total_demand: float | None = None,
    series: Sequence[str] = ("country",),
    time: str = "dateTime",
    partitions: int | None = None,
    stored: Sequence[str] | None = None,
    unique: bool = False,
) -> DataFrame:
    """Scaled demand and profiles of this and the previous hour, ready to meet the scenarios.

    ``stored`` and ``unique`` are those of ``circular_lag``: an hourly table stored by day is not
    shuffled again, and two rows for one hour stop the query.
    """
    totals = {name: (of_day(c), combine) for name, (of_day, c, combine) in _TOTALS.items()}
    kept = [c for c in stored or () if c not in series]
    inputs = circular_lag(
        _readings(hourly, renewable, series, time, kept),
        ["demand", "renewable"],
        series,
        "date",
        prefix="_before_",
        totals=totals,
        partitions=partitions,
        stored=stored,
        unique=unique,
    )
    size = _total_demand(total_demand)
    return inputs.select(
        *series,
        "date",
        _scaled("demand", size).alias("demand"),
        _profile("renewable").alias("alpha"),
        _scaled("_before_demand", size).alias("demand_before"),
        _profile("_before_renewable").alias("alpha_before"),
        *_summary(total_demand),
    )


def _scaled(c: str, size: Column) -> Column:
    return or_zero(F.try_divide(F.col(c), F.col("_sum_demand"))) * size


def _profile(c: str) -> Column:
    return or_zero(F.try_divide(F.col(c), F.col("_sum_renewable")))


def _summary(total_demand: float | None) -> list[Column]:
    """What is the same in all hours of a series, from its totals."""
    size = _total_demand(total_demand)
    return [
        (F.lit(1.0) / F.col("_hours")).alias("alpha_nuclear"),
        size.alias("total_demand"),
        F.least(_scaled("_min_demand", size), _scaled("_max_demand", size)).alias("demand_least"),
        F.least(_profile("_min_renewable"), _profile("_max_renewable")).alias("alpha_least"),
        F.greatest(_profile("_min_renewable"), _profile("_max_renewable")).alias("alpha_most"),
    ]


def scenario_inputs(
    hourly: DataFrame,
    share_generation: Sequence[Share],
    share_renewable: Sequence[Share],
    share_storage: Sequence[Share],
    cost_curtailment: Sequence[Mapping[str, float]] = DEFAULT_COSTS,
    total_demand: float | None = None,
    renewable: str = "windOnshore",
    series: Sequence[str] = ("country",),
    time: str = "dateTime",
) -> DataFrame:
    """One row per series and scenario: energy per technology, storage size, curtailment costs."""
    readings = _readings(hourly, renewable, series, time)
    sizes = readings.groupBy(list(series)).agg(F.sum("demand").alias("_sum_demand"))
    grid = spread_scenarios(sizes, share_generation, share_renewable, share_storage, cost_curtailment)
    size = _total_demand(total_demand)
    energy = F.col("x_generation") * size
    return grid.select(
        *series,
        "scenario_id",
        *ATTRIBUTES,
        (energy * (1 - F.col("x_renewable"))).alias("energyNuclear"),
        (energy * F.col("x_renewable")).alias("energyRenewable"),
        (size * F.col("x_storage")).alias("storageSize"),
        size.alias("totalDemand"),
    )


def merit_order(
    demand: Column,
    nuclear: Column,
    renewable: Column,
    storage: Column,
    cost_nuclear: Column,
    cost_renewable: Column,
    lowest_cost: float = float("-inf"),
) -> dict[str, Column]:
    """Amount taken from each resource in one hour, as plain column expressions.

    The order depends on the costs alone, so instead of sorting resources per row each one subtracts
    those that go before it. Nothing is sorted, collected or shuffled. ``lowest_cost`` is a bound
    below all costs; comparisons it settles are constants, which Catalyst folds away.
    """
    none = F.lit(0.0)

    def taken(available: Column, before: Column) -> Column:
        return F.greatest(none, F.least(available, demand - before))

    def counted(condition: Column, amount: Column) -> Column:
        return F.when(condition, amount).otherwise(none)

    def at_least(cost: Column, bound: float) -> Column:
        return F.lit(True) if lowest_cost >= bound else cost >= bound

    nuclear_first = cost_nuclear >= cost_renewable
    nuclear_free, renewable_free = at_least(cost_nuclear, 0), at_least(cost_renewable, 0)
    # Dearer than unserved energy: never used.
    nuclear_used, renewable_used = at_least(cost_nuclear, -1), at_least(cost_renewable, -1)
    used_nuclear = taken(nuclear, counted(~nuclear_first, renewable) + counted(~nuclear_free, storage))
    used_renewable = taken(
        renewable, counted(nuclear_first, nuclear) + counted(~renewable_free, storage)
    )
    used_storage = taken(storage, counted(nuclear_free, nuclear) + counted(renewable_free, renewable))
    served = counted(nuclear_used, nuclear) + counted(renewable_used, renewable) + storage
    return {
        "nuclear": counted(nuclear_used, used_nuclear),
        "renewable": counted(renewable_used, used_renewable),
        "storage": used_storage,
        "unserved": F.greatest(none, demand - served),
    }


def _bounds(x_generation: Column, x_renewable: Column) -> dict[str, Column]:
    """What must not be negative in any hour of a feasible scenario, by the name of its resource."""
    energy = x_generation * F.col("total_demand")
    renewable = energy * x_renewable
    return {
        "nuclear": F.col("alpha_nuclear") * (energy * (1 - x_renewable)),
        "renewable": F.least(F.col("alpha_least") * renewable, F.col("alpha_most") * renewable),
    }


def _scenario_hours(hours: DataFrame, grid: Sequence[Sequence]) -> DataFrame:
    """Hours times scenarios, with the potential of each resource.

    A scenario without a feasible dispatch, that is with negative demand or potential in some hour of
    the series, is left out as a whole (``rejected_scenarios`` lists it). Every hour carries the bounds
    of its series, so such scenarios are taken out of the lists before these multiply the hours.
    """
    def kept_energy(x: Column) -> Column:
        bounds = _bounds(x, F.col("_ren.x"))
        return (bounds["nuclear"] >= 0) & (bounds["renewable"] >= 0)

    rows = spread_scenarios(
        hours.filter(F.col("demand_least") >= 0),
        *grid,
        kept_energy=kept_energy,
        kept_storage=lambda x: F.col("total_demand") * x >= 0,
    )
    energy = F.col("x_generation") * F.col("total_demand")
    return rows.withColumns(
        {
            "_nuclear": F.col("alpha_nuclear") * (energy * (1 - F.col("x_renewable"))),
            "_energy": energy * F.col("x_renewable"),
            "_size": F.col("total_demand") * F.col("x_storage"),
        }
    ).withColumn("_renewable", F.col("alpha") * F.col("_energy"))


def rejected_scenarios(
    hourly: DataFrame,
    share_generation: Sequence[Share],
    share_renewable: Sequence[Share],
    share_storage: Sequence[Share],
    cost_curtailment: Sequence[Mapping[str, float]] = DEFAULT_COSTS,
    total_demand: float | None = None,
    renewable: str = "windOnshore",
    series: Sequence[str] = ("country",),
    time: str = "dateTime",
) -> DataFrame:
    """Scenarios that a sweep leaves out since they have no feasible dispatch, and why.

    One row per series and scenario: scenario_id, shares, costs and ``reason``. The hours are summed up
    to one row per series before the scenarios multiply anything.
    """
    readings = _readings(hourly, renewable, series, time).dropna(subset=[*series, "date"])
    sums = readings.groupBy(list(series)).agg(
        *(of_day(c).alias(name) for name, (of_day, c, _) in _TOTALS.items())
    )
    grid = (share_generation, share_renewable, share_storage, cost_curtailment)
    rows = spread_scenarios(sums.select(*series, *_summary(total_demand)), *grid)
    bounds = _bounds(F.col("x_generation"), F.col("x_renewable"))
    reason = F.concat_ws(
        ", ",
        F.when(F.col("demand_least") < 0, F.lit("negative demand")),
        F.when(bounds["nuclear"] < 0, F.lit("negative nuclear potential")),
        F.when(bounds["renewable"] < 0, F.lit("negative renewable potential")),
        F.when(F.col("total_demand") * F.col("x_storage") < 0, F.lit("negative storage size")),
    )
    found = rows.select(*series, "scenario_id", *ATTRIBUTES, reason.alias("reason"))
    return found.filter(F.col("reason") != "")


def _taken(
    demand: str, renewable: Column, cost_curtailment: Sequence[Mapping[str, float]]
) -> dict[str, Column]:
    costs = [float(c.get(name, 0)) for c in cost_curtailment for name in ("nuclear", "renewable")]
    return merit_order(
        F.col(demand),
        F.col("_nuclear"),
        renewable,
        F.col("_size"),
        F.col("costCurtailNuclear"),
        F.col("costCurtailRenewable"),
        min(costs),
    )


def dispatch_hourly(
    hourly: DataFrame,
    share_generation: Sequence[Share],
    share_renewable: Sequence[Share],
    share_storage: Sequence[Share],
    cost_curtailment: Sequence[Mapping[str, float]] = DEFAULT_COSTS,
    total_demand: float | None = None,
    renewable: str = "windOnshore",
    series: Sequence[str] = ("country",),
    time: str = "dateTime",
    partitions: int | None = None,
    stored: Sequence[str] | None = None,
    unique: bool = False,
) -> DataFrame:
    """Dispatch of every scenario in every hour.

    Hours meet the scenarios in place. The storage level of the previous hour, which the net release
    needs, is worked out from the inputs of that hour; those were attached before the scenarios
    multiplied the rows. So the one shuffle is over the hours, whatever the number of scenarios.
    """
    hours = hourly_inputs(hourly, renewable, total_demand, series, time, partitions, stored, unique)
    grid = (share_generation, share_renewable, share_storage, cost_curtailment)
    rows = _scenario_hours(hours, grid)
    now = _taken("demand", F.col("_renewable"), cost_curtailment)
    renewable_before = F.col("alpha_before") * F.col("_energy")
    before = _taken("demand_before", renewable_before, cost_curtailment)
    return rows.select(
        *series,
        "scenario_id",
        "date",
        now["nuclear"].alias("nuclear"),
        now["renewable"].alias("renewable"),
        (before["storage"] - now["storage"]).alias("netStorage"),
        "demand",
        now["unserved"].alias("energyNotServed"),
        now["storage"].alias("storageLevel"),
        (F.col("_nuclear") - now["nuclear"]).alias("curtailNuclear"),
        (F.col("_renewable") - now["renewable"]).alias("curtailRenewable"),
        *ATTRIBUTES,
    )


def _objective() -> Column:
    return (
        F.col("energyNotServed")
        + F.col("costCurtailNuclear") * F.col("curtailNuclear")
        + F.col("costCurtailRenewable") * F.col("curtailRenewable")
    )


def dispatch_totals(dispatch: DataFrame, series: Sequence[str] = ("country",)) -> DataFrame:
    """Sums per series and scenario, and the objective: unserved energy plus priced curtailment."""
    return dispatch.groupBy(*series, "scenario_id").agg(
        *(F.first(c).alias(c) for c in ATTRIBUTES),
        *(F.sum(c).alias(c) for c in AMOUNTS),
        F.sum(_objective()).alias("objective"),
    )


def sweep_totals(
    hourly: DataFrame,
    share_generation: Sequence[Share],
    share_renewable: Sequence[Share],
    share_storage: Sequence[Share],
    cost_curtailment: Sequence[Mapping[str, float]] = DEFAULT_COSTS,
    total_demand: float | None = None,
    renewable: str = "windOnshore",
    series: Sequence[str] = ("country",),
    time: str = "dateTime",
    partitions: int | None = None,
    stored: Sequence[str] | None = None,
    unique: bool = False,
) -> DataFrame:
    """The totals of a sweep straight from the hours, without the hourly results in between.

    Hours are summed per scenario inside each task, so what is shuffled grows with the number of
    scenarios and not with hours. Net release sums to 0 around the ring, and the objective follows
    from the other sums, so neither needs work per hour.
    """
    hours = hourly_inputs(hourly, renewable, total_demand, series, time, partitions, stored, unique)
    grid = (share_generation, share_renewable, share_storage, cost_curtailment)
    rows = _scenario_hours(hours, grid)
    now = _taken("demand", F.col("_renewable"), cost_curtailment)
    sums = (
        rows.select(
            *series,
            "scenario_id",
            "demand",
            now["nuclear"].alias("nuclear"),
            now["renewable"].alias("renewable"),
            now["storage"].alias("storageLevel"),
            now["unserved"].alias("energyNotServed"),
            (F.col("_nuclear") - now["nuclear"]).alias("curtailNuclear"),
            (F.col("_renewable") - now["renewable"]).alias("curtailRenewable"),
        )
        .groupBy(*series, "scenario_id")
        .agg(*(F.sum(c).alias(c) for c in AMOUNTS if c != "netStorage"))
    )
    attributes = scenario_attributes(F.col("scenario_id"), *grid)
    return (
        sums.withColumns(attributes)
        .withColumn("netStorage", F.lit(0.0))
        .select(
            *series, "scenario_id", *ATTRIBUTES, *AMOUNTS, _objective().alias("objective")
        )
    )
