"""Compare technologies across models and scenarios."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wattframe.operators.quantiles import quantiles

CategoryMap = Mapping[str, Sequence[str]]
MAP_SCHEMA = "report STRING, variable STRING, position INT, category STRING, technology STRING"


def category_rows(
    report: str, variable: str, categories: CategoryMap, order: Sequence[str] = ()
) -> list[tuple[str, str, int, str, str]]:
    """One row per code of the map. Categories that ``order`` does not name come last."""
    places = [*(c for c in order if c in categories), *(c for c in categories if c not in order)]
    rows, seen = [], set()
    for category, codes in categories.items():
        for code in codes:
            if code in seen:
                raise ValueError(f"code in two categories: {code}")
            seen.add(code)
            rows.append((report, variable, places.index(category), category, code))
    return rows


def category_table(spark: SparkSession, rows: Sequence[tuple[str, str, int, str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rows), MAP_SCHEMA)


def chosen_rows(results: DataFrame, year: str, models: Sequence[str] | None) -> DataFrame:
    condition: Column = F.col("year") == str(year)
    if models is not None:
        condition = condition & F.col("model").isin(list(models))
    return results.filter(condition)


def sums_by_category(
    results: DataFrame,
    rows: Sequence[tuple[str, str, int, str, str]],
    year: str,
    models: Sequence[str] | None = None,
    scale: float = 1,
) -> DataFrame:
    """Value per report, model, scenario and category, for any number of reports in one pass.

    Codes outside the map are left out. The map is a literal of the caller with a few hundred rows
    at most, so it is safe to broadcast, and the input is neither copied per report nor shuffled
    before it has been summed.
    """
    variables = sorted({row[1] for row in rows})
    table = F.broadcast(category_table(results.sparkSession, rows))
    return (
        chosen_rows(results, year, models)
        .filter(F.col("variable").isin(variables))
        .join(table, ["variable", "technology"])
        .groupBy("report", "model", "scenario", "position", "category")
        .agg((F.sum("value") * F.lit(float(scale))).alias("value"))
    )


def category_rollup(
    results: DataFrame,
    variable: str,
    categories: CategoryMap,
    year: str,
    models: Sequence[str] | None = None,
    scale: float = 1,
    on_top: str = "",
) -> DataFrame:
    """Value per model, scenario and category.

    ``on_top`` adds a column ``onTop`` per model and scenario: the sum of the categories for
    ``total``, or the value of another variable.
    """
    rows = category_rows("", variable, categories)
    parts = sums_by_category(results, rows, year, models, scale).drop("report")
    if on_top == "":
        return parts
    if on_top == "total":
        whole = W.partitionBy("model", "scenario")
        return parts.withColumn("onTop", F.sum("value").over(whole))
    other = (
        chosen_rows(results, year, models)
        .filter((F.col("variable") == on_top) & (F.col("technology") != "total"))
        .groupBy("model", "scenario")
        .agg((F.sum("value") * F.lit(float(scale))).alias("onTop"))
    )
    return parts.join(other, ["model", "scenario"], "left")


def spread(parts: DataFrame) -> DataFrame:
    """Quartiles, minimum and maximum per report and category over models and scenarios.

    The quartiles see one value per model and scenario, not the rows behind it.
    """
    return quantiles(
        parts,
        ("report", "position", "category"),
        "value",
        (0.25, 0.5, 0.75),
        ("lowerQuartile", "median", "upperQuartile"),
        few_groups=True,  # reports and categories are literals of the caller
    )


def category_spread(
    results: DataFrame,
    variable: str,
    categories: CategoryMap,
    year: str,
    order: Sequence[str] = (),
    models: Sequence[str] | None = None,
    scale: float = 1,
) -> DataFrame:
    """Spread of one variable; ``position`` follows ``order``."""
    rows = category_rows("", variable, categories, order)
    return spread(sums_by_category(results, rows, year, models, scale)).drop("report")


def model_scatter(
    results: DataFrame,
    variable: str,
    year: str,
    technology: str = "total",
    models: Sequence[str] | None = None,
    scale: float = 1,
) -> DataFrame:
    """Value of one technology per model and scenario, and the mean of the model."""
    points = (
        chosen_rows(results, year, models)
        .filter((F.col("variable") == variable) & (F.col("technology") == technology))
        .groupBy("model", "scenario")
        .agg((F.sum("value") * F.lit(float(scale))).alias("value"))
    )
    return points.withColumn("modelMean", F.avg("value").over(W.partitionBy("model")))
