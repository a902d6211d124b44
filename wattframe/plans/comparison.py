"""The reports of the model comparison, each a variable with its categories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattframe.operators.compare import (
    category_rollup,
    category_rows,
    category_spread,
    model_scatter,
    spread,
    sums_by_category,
)
from wattframe.plans import categories as maps

YEAR = "2050"

# Name, variable and categories of a bar report.
BARS = {
    "elecSupply_tech": ("electricity_supply", maps.SUPPLY),
    "elecSupply_tech_net": ("electricity_supply", maps.SUPPLY_NET),
    "elecUse": ("electricity_consumption", maps.USE),
    "elecUse_net": ("electricity_consumption", maps.USE_NET),
    "h2Supply_tech": ("h2_supply", maps.HYDROGEN_SUPPLY),
    "h2Use": ("h2_fec", maps.HYDROGEN_USE),
    "methaneSupply_tech": ("methane_supply", maps.METHANE_SUPPLY),
    "methaneUse": ("methane_fec", maps.METHANE_USE),
    "liquidsSupply_tech": ("liquids_supply", maps.LIQUIDS_SUPPLY),
    "liquidsUse": ("liquids_fec", maps.LIQUIDS_USE),
    "spaceHeating": ("space_heat_useful_energy_supply", maps.SPACE_HEAT),
    "processHeating": ("process_heat_useful_energy_production", maps.PROCESS_HEAT),
    "passenger_road_private_fec": ("passenger_road_private_fec", maps.TRANSPORT),
    "passenger_road_public_fec": ("passenger_road_public_fec", maps.TRANSPORT),
    "freight_road_fec": ("freight_road_fec", maps.TRANSPORT),
}

# Name, variable, categories and their order in a spread report.
SPREADS = {
    "elecDist_tech": (
        "electricity_supply",
        maps.SUPPLY_SPREAD,
        ["Hydro", "Solar", "Wind", "Nuc.", "Waste", "Gas", "Wood", "Geoth.", "H2", "Liquids"],
    ),
    "elecUseDist_use": (
        "electricity_consumption",
        maps.USE_SPREAD,
        ["Base", "Passenger", "Freight", "Space\nheating", "Process\nheat", "Electrolysis"],
    ),
    "spaceHeating_dist": (
        "space_heat_useful_energy_supply",
        maps.SPACE_HEAT_SPREAD,
        ["Heat\npumps", "Wood", "Waste", "Solar", "Geoth.", "Gas", "H2", "Heaters", "Liquids"],
    ),
    "processHeating_dist": (
        "process_heat_useful_energy_production",
        maps.PROCESS_HEAT_SPREAD,
        ["Heat\npumps", "Wood", "Waste", "Solar", "Geoth.", "Gas", "H2", "Heaters", "Liquid"],
    ),
    "passenger_road_private_fec_dist": (
        "passenger_road_private_fec",
        maps.TRANSPORT_SPREAD,
        ["Electricity", "Liquids", "Hydrogen", "Methane"],
    ),
    "passenger_road_public_fec_dist": (
        "passenger_road_public_fec",
        maps.TRANSPORT_SPREAD,
        ["Electricity", "Liquids", "Hydrogen", "Methane"],
    ),
    "freight_road_fec_dist": (
        "freight_road_fec",
        maps.TRANSPORT_SPREAD,
        ["Electricity", "Liquids", "Hydrogen", "Methane"],
    ),
}

SCATTERS = {"elecSupply_aver": ("electricity_supply", "total")}


def report(
    results: DataFrame,
    name: str,
    year: str = YEAR,
    models: Sequence[str] | None = None,
    scale: float = 1,
    on_top: str = "",
) -> DataFrame:
    """One report by name. ``models`` restricts the comparison; ``on_top`` is for bar reports."""
    if name in BARS:
        variable, categories = BARS[name]
        return category_rollup(results, variable, categories, year, models, scale, on_top)
    if name in SPREADS:
        variable, categories, order = SPREADS[name]
        return category_spread(results, variable, categories, year, order, models, scale)
    if name in SCATTERS:
        variable, technology = SCATTERS[name]
        return model_scatter(results, variable, year, technology, models, scale)
    raise ValueError(f"no such report: {name}")


def all_bars(
    results: DataFrame, year: str = YEAR, models: Sequence[str] | None = None, scale: float = 1
) -> DataFrame:
    """Every bar report in one pass over the results, told apart by ``report``."""
    rows = [row for name, (variable, codes) in BARS.items() for row in category_rows(name, variable, codes)]
    return sums_by_category(results, rows, year, models, scale)


def all_spreads(
    results: DataFrame, year: str = YEAR, models: Sequence[str] | None = None, scale: float = 1
) -> DataFrame:
    """Every spread report in one pass over the results, told apart by ``report``."""
    rows = [
        row
        for name, (variable, codes, order) in SPREADS.items()
        for row in category_rows(name, variable, codes, order)
    ]
    return spread(sums_by_category(results, rows, year, models, scale))


def model_table(spark: SparkSession) -> DataFrame:
    """Model ids, names and typical days of summer and winter, in the order of display."""
    rows = [(i, key, name, *maps.TYPICAL_DAYS[key]) for i, (key, name) in enumerate(maps.MODELS.items())]
    schema = "position INT, model STRING, name STRING, summer STRING, summerDay STRING, winter STRING, winterDay STRING"
    return spark.createDataFrame(rows, schema)


def scenario_table(spark: SparkSession) -> DataFrame:
    """Scenario names, in the order of display."""
    return spark.createDataFrame(list(enumerate(maps.SCENARIOS)), "position INT, scenario STRING")


def with_names(results: DataFrame) -> DataFrame:
    """Results with the name, the place in the order and the typical days of their model, and the place
    of their scenario. Models and scenarios that are not listed have none of these.

    Both tables are fixed lists of a few rows, so they are broadcast.
    """
    spark = results.sparkSession
    models = model_table(spark).withColumnRenamed("position", "modelPosition")
    scenarios = scenario_table(spark).withColumnRenamed("position", "scenarioPosition")
    named = results.join(F.broadcast(models), "model", "left")
    return named.join(F.broadcast(scenarios), "scenario", "left")
