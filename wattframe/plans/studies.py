"""The chains behind the two dashboards, as tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from wattframe.operators.balance import storage_hourly, storage_stats
from wattframe.operators.bins import resample_days, resample_days_percent
from wattframe.operators.capacity import (
    capacity_stats,
    generation_year,
    implied_capacity,
    observed_overview,
)
from wattframe.operators.grid import Share
from wattframe.operators.normalize import normalize_generation
from wattframe.operators.profiles import all_profiles, stacked_profile
from wattframe.operators.results import annual_results, heatmap_pivot, scenario_cost

# Default demand shares, the order of stacking and what is shown.
DEFAULT_SHARES = {"Wind": 0.5, "Solar": 0.3, "Constant": 0.2}
TECH_ORDER = ("Constant", "Wind", "Solar")
SHOWN = ("Demand", "Wind", "Solar", "Constant")


def share_total(shares: Mapping[str, float] = DEFAULT_SHARES) -> int:
    """Sum of the demand shares in percent, cut to a whole number."""
    return int(sum(shares.values()) * 100)


def profile_study(
    hourly: DataFrame,
    capacity: DataFrame,
    country: str | None = None,
    year: int | None = None,
    shares: Mapping[str, float] = DEFAULT_SHARES,
    total_demand: float = 0,
    days: int = 1,
    percent_of_demand: bool = False,
    stack: bool = True,
    cache: bool = False,
) -> dict[str, DataFrame]:
    """All tables of the profile study for one or all countries and years.

    With ``cache`` the balance, which the last four tables share, is kept in the executors; the
    caller releases it with ``unpersist()`` on the table ``hourly``.
    """
    keys = ("country", "year")
    generation = generation_year(hourly, country, year)
    for name, value in (("country", country), ("year", year)):
        if value is not None:
            capacity = capacity.filter(capacity[name] == value)
    stats = capacity_stats(generation, capacity, keys)
    normalised = normalize_generation(generation, shares, total_demand, keys)
    balance = storage_hourly(normalised, series=keys)
    if cache:
        balance = balance.persist()
    bins = resample_days_percent if percent_of_demand else resample_days
    profiles = all_profiles(balance, series=keys)
    return {
        "capacity": stats,
        "overview": observed_overview(stats, keys),
        "implied": implied_capacity(
            normalised, stats, keys, [t for t in ("Wind", "Solar") if t in shares]
        ),
        "hourly": balance,
        "statistics": storage_stats(balance, series=keys),
        "daily": bins(balance, days, [*shares, "Demand"], keys),
        "profiles": stacked_profile(
            profiles, (*keys, "profile", "x"), SHOWN, TECH_ORDER if stack else None
        ),
    }


def result_study(
    results: DataFrame,
    share_renewable: Sequence[Share],
    variable: str = "cost",
    share_generation: Share = 1,
    curtail_renewable_first: bool = True,
    cost_renewable: float = 2.0,
    cost_nuclear: float = 1.0,
    cost_storage: float = 10.0,
    cost_unserved: float = 10.0,
    series: Sequence[str] = ("country",),
) -> dict[str, DataFrame]:
    """Scenario totals, costs and one heat map from hourly scenario results."""
    annual = annual_results(results, series)
    costs = scenario_cost(
        annual,
        cost_renewable,
        cost_nuclear,
        cost_storage,
        cost_unserved,
        share_generation,
        curtail_renewable_first,
        series,
    )
    return {
        "annual": annual,
        "cost": costs,
        "heatmap": heatmap_pivot(costs, share_renewable, variable, series),
    }
