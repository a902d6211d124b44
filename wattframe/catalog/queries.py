"""One query per operator, over the whole of the given tables.

Results are put into a form that two engines can agree on: doubles rounded, since the order of a
floating sum differs, and times as text. Sums over many hours keep 4 digits, all else 6.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattframe import sources
from wattframe.functions import SEASONS, capitalise_columns
from wattframe.operators import balance as bal
from wattframe.operators import bins, capacity, checks, compare, dispatch, lag, normalize, profiles
from wattframe.operators import results as res
from wattframe.operators.joins import with_totals
from wattframe.plans import comparison, studies, sweep
from wattframe.plans.sweep import STUDY
from wattframe.session import shared_dir
from wattframe.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

GRID = {
    "share_generation": ["1", "1.1", "1.2"],
    "share_renewable": ["0", "0.5", "1"],
    "share_storage": ["0", "0.0003", "0.001"],
    "cost_curtailment": [{"nuclear": 1, "renewable": 0}, {"nuclear": 0, "renewable": 1}],
}
FIXTURE_MAP = {"alpha": ["AO", "AF"], "beta": ["RO", "RF"], "gamma": ["NO"]}
KEYS = ("country", "year")
STUDY_CODES = sorted(
    {
        (variable, code)
        for variable, categories, *_ in (*comparison.BARS.values(), *comparison.SPREADS.values())
        for codes in categories.values()
        for code in codes
    }
)


def comparable(df: DataFrame, digits: int = 6) -> DataFrame:
    columns = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif isinstance(field.dataType, T.DoubleType):
            c = F.round(c, digits) + F.lit(0.0)
        elif isinstance(field.dataType, (T.TimestampNTZType, T.TimestampType, T.DateType)):
            c = c.cast("string")
        columns.append(c.alias(field.name))
    return df.select(columns)


def query(function: Query, digits: int = 6) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return comparable(function(spark, folder), digits)

    run.__name__ = function.__name__
    QUERIES[function.__name__] = run
    return function


def sums_query(function: Query) -> Query:
    return query(function, 4)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ---- sources, projections, filters


@query
def scan_country_period(spark, folder):
    hourly = tables.hourly_shipments(spark, folder)
    return sources.country_period(hourly, "EUROPE", "1996/03/01 00:00", "1998/08/31 23")


@query
def scan_calendar_year(spark, folder):
    return capacity.generation_year(tables.hourly_shipments(spark, folder), "EUROPE", 1999)


@query
def country_list(spark, folder):
    return sources.country_list(tables.capacity(spark, folder))


@query
def rename_capitalised(spark, folder):
    hourly = tables.hourly_shipments(spark, folder)
    return capitalise_columns(hourly, keep=("country", "dateTime"))


@query
def wind_total(spark, folder):
    named = capitalise_columns(tables.hourly_shipments(spark, folder), keep=("country", "dateTime"))
    return normalize.with_wind(named).select("country", "dateTime", "Wind")


# ---- normalised profiles and balance


def _normalised_events(spark, folder):
    return normalize.normalize_generation(
        capacity.generation_year(tables.hourly_events(spark, folder)),
        studies.DEFAULT_SHARES,
    )


def _normalised_shipments(spark, folder, total_demand=0):
    return normalize.normalize_generation(
        capacity.generation_year(tables.hourly_shipments(spark, folder)),
        studies.DEFAULT_SHARES,
        total_demand,
        KEYS,
    )


@query
def normalize_generation(spark, folder):
    return _normalised_events(spark, folder)


@query
def normalize_to_total(spark, folder):
    return _normalised_shipments(spark, folder, 100000)


@query
def storage_hourly(spark, folder):
    return bal.storage_hourly(_normalised_events(spark, folder))


@query
def storage_stats(spark, folder):
    return bal.storage_stats(bal.storage_hourly(_normalised_events(spark, folder)))


@query
def storage_stats_by_year(spark, folder):
    hourly = bal.storage_hourly(_normalised_shipments(spark, folder), series=KEYS)
    return bal.storage_stats(hourly, series=KEYS)


@query
def storage_stats_transposed(spark, folder):
    return bal.transpose_stats(storage_stats_by_year(spark, folder), KEYS)


# ---- profiles, bins, stacking


@query
def hour_profile(spark, folder):
    return profiles.hour_profile(tables.hourly_shipments(spark, folder))


@query
def month_profile(spark, folder):
    return profiles.month_profile(tables.hourly_shipments(spark, folder))


@query
def season_profiles(spark, folder):
    return profiles.season_profiles(tables.hourly_shipments(spark, folder), list(SEASONS))


@query
def all_profiles(spark, folder):
    return profiles.all_profiles(tables.hourly_shipments(spark, folder))


@query
def stacked_profile(spark, folder):
    means = profiles.all_profiles(_normalised_shipments(spark, folder), series=KEYS)
    return profiles.stacked_profile(
        means, (*KEYS, "profile", "x"), studies.SHOWN, studies.TECH_ORDER
    )


@query
def resample_days(spark, folder):
    return bins.resample_days(tables.hourly_shipments(spark, folder), 3)


@query
def resample_single_days(spark, folder):
    return bins.resample_days(tables.hourly_shipments(spark, folder), 1)


@query
def resample_days_percent(spark, folder):
    hourly = _normalised_shipments(spark, folder)
    return bins.resample_days_percent(hourly, 1, [*studies.DEFAULT_SHARES, "Demand"], KEYS)


@query
def first_day(spark, folder):
    hourly = bal.storage_hourly(_normalised_shipments(spark, folder), series=KEYS)
    return checks.first_hours(hourly, 24, ["ExcessSupply", "ExcessDemand"], KEYS)


@query
def column_counts(spark, folder):
    return checks.column_counts(bal.storage_hourly(_normalised_events(spark, folder)))


@query
def duplicate_hours(spark, folder):
    return checks.duplicate_hours(tables.shipment_readings(spark, folder))


# ---- capacity


def _capacity_stats(spark, folder):
    generation = capacity.generation_year(tables.hourly_shipments(spark, folder))
    return capacity.capacity_stats(generation, tables.capacity(spark, folder))


@query
def capacity_stats(spark, folder):
    return _capacity_stats(spark, folder)


@query
def observed_overview(spark, folder):
    return capacity.observed_overview(_capacity_stats(spark, folder))


@query
def implied_capacity(spark, folder):
    generation = capacity.generation_year(tables.hourly_shipments(spark, folder))
    return capacity.implied_from_hours(generation, studies.DEFAULT_SHARES)


@query
def implied_from_stats(spark, folder):
    return capacity.implied_capacity(
        _normalised_shipments(spark, folder), _capacity_stats(spark, folder)
    )


@query
def empty_source(spark, folder):
    generation = capacity.generation_year(tables.hourly_shipments(spark, folder))
    absent = sources.read_capacity(spark, new_folder(spark, "absent"))
    return capacity.capacity_stats(generation, absent)


# ---- scenarios and dispatch


@query
def circular_lag(spark, folder):
    hourly = tables.hourly_shipments(spark, folder).select(
        "country", "dateTime", "demand", "windOnshore"
    )
    return lag.circular_lag(hourly, ["demand", "windOnshore"])


@query
def scenario_grid(spark, folder):
    return dispatch.scenario_inputs(tables.hourly_shipments(spark, folder), **GRID)


@query
def scenario_inputs(spark, folder):
    sums = {"d": F.sum("demand"), "w": F.sum("windOnshore"), "n": F.count("*")}
    hours = with_totals(tables.hourly_events(spark, folder), sums, ["country"], "dateTime")
    inputs = hours.select(
        "country",
        F.col("dateTime").alias("date"),
        (F.lit(1.0) / F.col("n")).alias("nuclear"),
        (F.col("windOnshore") / F.col("w")).alias("renewable"),
        (F.col("demand") / F.col("d") * 100000).alias("demand"),
    )
    long = inputs.unpivot(["country", "date"], ["nuclear", "renewable", "demand"], "name", "value")
    of_demand = F.col("name") == "demand"
    symbol = F.when(of_demand, "dem").otherwise("alpha").alias("symbol")
    element = F.when(~of_demand, F.col("name")).alias("element")
    return long.filter("value IS NOT NULL").select("country", "date", symbol, element, "value")


def _dispatch(spark, folder):
    return dispatch.dispatch_hourly(tables.hourly_events(spark, folder), **GRID)


@query
def dispatch_hourly(spark, folder):
    return _dispatch(spark, folder)


@sums_query
def dispatch_totals(spark, folder):
    return dispatch.dispatch_totals(_dispatch(spark, folder))


@sums_query
def sweep_totals(spark, folder):
    return dispatch.sweep_totals(tables.hourly_shipments(spark, folder), **GRID, renewable="solar")


@sums_query
def sweep_study(spark, folder):
    return dispatch.sweep_totals(tables.hourly_events(spark, folder), **STUDY, total_demand=100000)


@query
def result_join(spark, folder):
    return _dispatch(spark, folder)


@sums_query
def union_scenarios(spark, folder):
    hourly = tables.hourly_events(spark, folder)
    wind = dispatch.sweep_totals(hourly, **GRID).withColumn("source", F.lit("windOnshore"))
    solar = dispatch.sweep_totals(hourly, **GRID, renewable="solar").drop("objective")
    return res.union_results([wind, solar.withColumn("source", F.lit("solar"))])


def _mixed_hours(spark, folder):
    """Hours in which net renewable output, and in one place net demand, may be below zero."""
    south = F.when(F.col("country") == "SOUTH", F.coalesce("windOffshore", F.lit(0.0))).otherwise(0.0)
    hourly = tables.hourly_events(spark, folder)
    return hourly.select(
        "country",
        "dateTime",
        (F.coalesce("demand", F.lit(0.0)) - 2 * south).alias("demand"),
        (F.coalesce("windOnshore", F.lit(0.0)) - F.coalesce("solar", F.lit(0.0))).alias("windOnshore"),
    )


@query
def rejected_scenarios(spark, folder):
    return dispatch.rejected_scenarios(_mixed_hours(spark, folder), **GRID)


@sums_query
def feasible_totals(spark, folder):
    return dispatch.sweep_totals(_mixed_hours(spark, folder), **GRID)


SIMULATED = {"country": "NORTH", "start": "2024/01/03 00:00", "end": "2024/01/20 23:00"}


def _event_file(spark, folder):
    path = new_folder(spark, "hours")
    tables.hourly_events(spark, folder).write.parquet(path)
    return path


@query
def simulated(spark, folder):
    return sweep.simulate(spark, **GRID, **SIMULATED, hourly_path=_event_file(spark, folder))


@query
def resumed_sweep(spark, folder):
    hours, out = _event_file(spark, folder), new_folder(spark, "sweep")
    given = {**GRID, **SIMULATED, "hourly_path": hours, "out_path": out, "parts": 3}
    sweep.simulate(spark, **given, at_most=1)
    return sweep.simulate(spark, **given)


@query
def write_results(spark, folder):
    path = new_folder(spark, "results")
    sources.write_results(_dispatch(spark, folder), path, partition_by=["share_generation"])
    return sources.read_results(spark, path)


# ---- scenario results


@query
def hourly_results(spark, folder):
    return res.hourly_results(_dispatch(spark, folder), "1.1", "0.001", "0.5")


def _annual(spark, folder):
    return res.annual_results(_dispatch(spark, folder))


@sums_query
def annual_results(spark, folder):
    return _annual(spark, folder)


@query
def generation_shares(spark, folder):
    return res.generation_shares(_annual(spark, folder))


@sums_query
def scenario_cost(spark, folder):
    return res.scenario_cost(_annual(spark, folder), share_generation="1.1")


@sums_query
def heatmap_pivot(spark, folder):
    costs = res.scenario_cost(_annual(spark, folder), share_generation="1.1")
    return res.heatmap_pivot(costs, GRID["share_renewable"])


def _heatmap(variable: str) -> Query:
    def run(spark, folder):
        costs = res.scenario_cost(_annual(spark, folder), share_generation="1.1")
        return res.heatmap_pivot(costs, GRID["share_renewable"], variable)

    run.__name__ = f"heatmap_{variable}"
    return sums_query(run)


for _variable in res.VARIABLES[1:]:
    _heatmap(_variable)


@query
def count_per_storage(spark, folder):
    costs = res.scenario_cost(
        _annual(spark, folder), share_generation="1", curtail_renewable_first=False
    )
    return res.count_per_storage(costs)


@query
def melt_generation(spark, folder):
    keys = ("country", "scenario_id", "date")
    return res.melt_generation(_dispatch(spark, folder), keys=keys)


# ---- stored tables


def _stored_hours(spark, folder):
    path = new_folder(spark, "hours")
    sources.store_hourly(tables.hourly_shipments(spark, folder), path)
    return sources.read_hourly(spark, path)


def _stored_results(spark, folder):
    path = new_folder(spark, "results")
    sources.write_results(_dispatch(spark, folder), path)
    return sources.read_results(spark, path)


@query
def stored_country_period(spark, folder):
    hourly = _stored_hours(spark, folder)
    return sources.country_period(hourly, "EUROPE", "1996/03/01 00:00", "1998/08/31 23")


@query
def stored_capacity_stats(spark, folder):
    path = new_folder(spark, "capacity")
    tables.capacity(spark, folder).write.parquet(path)
    generation = capacity.generation_year(_stored_hours(spark, folder).drop("year"))
    return capacity.capacity_stats(generation, sources.read_capacity(spark, path))


@query
def stored_hourly_results(spark, folder):
    return res.hourly_results(_stored_results(spark, folder), "1.1", "0.001", "0.5")


@sums_query
def stored_annual_results(spark, folder):
    return res.annual_results(_stored_results(spark, folder))


def _stored_by_day(spark, folder):
    path = new_folder(spark, "hours")
    sources.store_by_day(tables.hourly_shipments(spark, folder), path)
    return sources.read_by_day(spark, path)


@query
def stored_circular_lag(spark, folder):
    hourly, stored = _stored_by_day(spark, folder)
    columns = ["demand", "windOnshore"]
    hourly = hourly.select("country", "day", "dateTime", *columns)
    return lag.circular_lag(hourly, columns, stored=stored).drop("day")


def _stored_normalised(spark, folder):
    hourly, stored = _stored_by_day(spark, folder)
    generation = capacity.generation_year(hourly.withColumn("Day", F.col("day")))
    return normalize.normalize_generation(
        generation, studies.DEFAULT_SHARES, 100000, KEYS, stored=[c.replace("day", "Day") for c in stored]
    )


@query
def stored_normalize_to_total(spark, folder):
    return _stored_normalised(spark, folder)


@sums_query
def stored_sweep_totals(spark, folder):
    hourly, stored = _stored_by_day(spark, folder)
    return dispatch.sweep_totals(hourly, **GRID, renewable="solar", stored=stored)


@query
def stored_hour_scan(spark, folder):
    path = new_folder(spark, "hours")
    sources.store_by_hour(tables.hourly_shipments(spark, folder), path)
    hourly = sources.read_hourly(spark, path)
    return sources.country_period(hourly, "EUROPE", "1996/03/01 00:00", "1998/08/31 23")


@query
def stored_interleaved_results(spark, folder):
    path = new_folder(spark, "results")
    sources.write_results(_dispatch(spark, folder), path, grid=GRID)
    return res.hourly_results(sources.read_results(spark, path), "1.1", "0.001", "0.5")


@sums_query
def stored_union(spark, folder):
    hourly, paths = tables.hourly_events(spark, folder), []
    for renewable in ("windOnshore", "solar"):
        run = dispatch.sweep_totals(hourly, **GRID, renewable=renewable).withColumn("source", F.lit(renewable))
        paths.append(new_folder(spark, "run"))
        (run.drop("objective") if renewable == "solar" else run).write.parquet(paths[-1])
    return sources.read_runs(spark, paths)


# ---- the chains behind the dashboards

STUDY_PLACE = {"country": "EUROPE", "year": 1999}


def _profile_study(spark, folder):
    hours, installed = new_folder(spark, "hours"), new_folder(spark, "capacity")
    sources.store_hourly(tables.hourly_shipments(spark, folder), hours)
    tables.capacity(spark, folder).write.parquet(installed)
    return studies.profile_study(
        sources.read_hourly(spark, hours),
        sources.read_capacity(spark, installed),
        **STUDY_PLACE,
        percent_of_demand=True,
    )


def _result_study(spark, folder):
    return studies.result_study(
        _stored_results(spark, folder),
        GRID["share_renewable"],
        "curtailRenewablePercent",
        share_generation="1.1",
    )


def _study_table(study: Callable, table: str, prefix: str, digits: int) -> Query:
    def run(spark, folder):
        return study(spark, folder)[table]

    run.__name__ = f"{prefix}_{table}"
    return query(run, digits)


for _table in ("capacity", "overview", "implied", "hourly", "statistics", "daily", "profiles"):
    _study_table(_profile_study, _table, "profile_study", 6)
for _table in ("annual", "cost", "heatmap"):
    _study_table(_result_study, _table, "result_study", 4)


# ---- comparison of models


@query
def category_rollup(spark, folder):
    results = tables.model_results(spark, folder)
    return compare.category_rollup(results, "O", FIXTURE_MAP, "1998", on_top="total")


@query
def category_rollup_on_variable(spark, folder):
    results = tables.model_results(spark, folder)
    return compare.category_rollup(
        results, "O", FIXTURE_MAP, "1998", ["M0", "M2", "M3"], 0.001, on_top="P"
    )


@query
def category_spread(spark, folder):
    results = tables.model_results(spark, folder)
    return compare.category_spread(results, "F", FIXTURE_MAP, "1999", ["gamma", "alpha", "delta"])


@query
def model_scatter(spark, folder):
    return compare.model_scatter(tables.model_results(spark, folder), "P", "2000")


@query
def comparison_csv(spark, folder):
    path = new_folder(spark, "comparison")
    tables.model_results(spark, folder).write.option("header", True).csv(path)
    return sources.read_comparison(spark, path)


def _comparison_file(spark, folder):
    """A file in which every third model's totals, and some years, are not numbers or have a cell too many."""
    path = new_folder(spark, "comparison")
    rows = tables.model_results(spark, folder)
    spoiled = (F.col("technology") == "total") & (F.col("model") == "M1")
    value = F.when(spoiled, F.lit("n/a")).otherwise(F.col("value").cast("string"))
    lines = rows.select(F.concat_ws(",", *(c for c in rows.columns if c != "value"), value).alias("line"))
    broken = F.when(F.col("line").startswith("M2") & F.col("line").contains("1996"), F.concat("line", F.lit(",x")))
    lines = lines.select(F.coalesce(broken, "line").alias("line"))
    # The first row of each file is its header; the first to be read names the columns of all.
    header = spark.createDataFrame([(",".join(rows.columns),)], "line string").withColumn("first", F.lit(0))
    both = header.unionByName(lines.withColumn("first", F.lit(1)))
    both.coalesce(1).sortWithinPartitions("first").select("line").write.text(path)
    return path


@query
def checked_csv(spark, folder):
    good, _ = sources.check_comparison(spark, _comparison_file(spark, folder))
    return good


@query
def bad_csv_cells(spark, folder):
    _, rejected = sources.check_comparison(spark, _comparison_file(spark, folder))
    return sources.bad_cells(rejected)


@query
def named_results(spark, folder):
    points = comparison.report(tables.study_results(spark, folder, STUDY_CODES), "elecSupply_aver")
    return comparison.with_names(points)


@query
def bar_reports(spark, folder):
    return comparison.all_bars(tables.study_results(spark, folder, STUDY_CODES))


@query
def spread_reports(spark, folder):
    return comparison.all_spreads(tables.study_results(spark, folder, STUDY_CODES))


@query
def scatter_report(spark, folder):
    return comparison.report(tables.study_results(spark, folder, STUDY_CODES), "elecSupply_aver")
