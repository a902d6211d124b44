import pytest
from pyspark.sql import functions as F

from tests.conftest import at, plan_of, records
from wattframe.catalog import QUERIES
from wattframe.operators.capacity import (
    capacity_stats,
    generation_year,
    implied_capacity,
    implied_from_hours,
    observed_overview,
)
from wattframe.operators.normalize import normalize_generation
from wattframe.plans.studies import profile_study, share_total

HOURLY = "country STRING, dateTime TIMESTAMP_NTZ, demand DOUBLE, windOnshore DOUBLE, windOffshore DOUBLE, solar DOUBLE"
CAPACITY = "country STRING, year INT, windOnshore DOUBLE, windOffshore DOUBLE, solar DOUBLE"
HOURS = [
    ("DE", at("2020-01-01 00:00:00"), 100.0, 20.0, None, 10.0),
    ("DE", at("2020-06-01 00:00:00"), 300.0, 30.0, 50.0, 30.0),
    ("FR", at("2020-01-01 00:00:00"), 50.0, 5.0, None, 5.0),
]


@pytest.fixture
def hourly(spark):
    return spark.createDataFrame(HOURS, HOURLY)


def stats_by(df):
    return {(r["country"], r["year"], r["technology"]): r for r in records(df)}


def test_capacity_stats(spark, hourly):
    caps = spark.createDataFrame([("DE", 2020, 5.0, None, 0.0), ("DE", 2020, 5.0, None, 0.0)], CAPACITY)
    got = stats_by(capacity_stats(generation_year(hourly), caps))
    wind = got["DE", 2020, "Wind"]
    # Two capacity rows are added up; offshore is missing and counts as 0 in the sum.
    assert (wind["Capacity"], wind["AnnualGeneration"], wind["FullloadHours"]) == (10.0, 100.0, 10.0)
    assert wind["DemandShare"] == 25.0
    assert got["DE", 2020, "WindOffshore"]["Capacity"] is None
    assert got["DE", 2020, "Solar"]["FullloadHours"] is None
    assert got["DE", 2020, "Demand"]["Capacity"] is None
    assert got["FR", 2020, "Wind"]["Capacity"] is None and got["FR", 2020, "Wind"]["DemandShare"] == 10.0
    assert len(got) == 10


def test_capacity_without_hours(spark, hourly):
    caps = spark.createDataFrame([("IT", 2020, 5.0, 1.0, 2.0)], CAPACITY)
    got = stats_by(capacity_stats(generation_year(hourly), caps))
    assert got["IT", 2020, "Wind"]["Capacity"] == 6.0 and got["IT", 2020, "Wind"]["AnnualGeneration"] == 0.0


def test_overview_and_implied_capacity(spark, hourly):
    caps = spark.createDataFrame([("DE", 2020, 2500.0, None, 3500.0)], CAPACITY)
    stats = capacity_stats(generation_year(hourly), caps)
    rows = {(r["country"], r["figure"]): r for r in records(observed_overview(stats))}
    # 2.5 and 3.5 go to the even neighbour.
    assert (rows["DE", "Capacity [GW]"]["Wind"], rows["DE", "Capacity [GW]"]["Solar"]) == (2.0, 4.0)
    assert rows["DE", "Demand Share [%]"]["Wind"] == 25.0
    normal = spark.createDataFrame([("DE", 2020, 200.0, 100.0)], "country STRING, year INT, Wind DOUBLE, Solar DOUBLE")
    implied = {r["technology"]: r["impliedCapacity"] for r in records(implied_capacity(normal, stats))}
    assert implied["Wind"] == round(200 / (100 / 2500 + 1e-7) / 1000, 2)
    assert implied["Solar"] == round(100 / (40 / 3500 + 1e-7) / 1000, 2)


def test_implied_capacity_by_one_grouping(spark, hourly, testdata):
    shares, generation = {"Wind": 0.5, "Solar": 0.3, "Constant": 0.2}, generation_year(hourly)
    caps = spark.createDataFrame([("DE", 2020, 2500.0, None, 3500.0)], CAPACITY)

    def table(df):
        return {(r["country"], r["year"], r["technology"]): r["impliedCapacity"] for r in df.collect()}

    for total_demand in (0, 500):
        normal = normalize_generation(generation, shares, total_demand, ("country", "year"))
        apart = table(implied_capacity(normal, capacity_stats(generation, caps)))
        at_once = table(implied_from_hours(generation, shares, total_demand, caps))
        assert at_once == {k: pytest.approx(v) if v is not None else None for k, v in apart.items()}
    plan = plan_of(QUERIES["implied_capacity"](spark, testdata))
    assert sum("FileScan" in line and "lineitem" in line for line in plan.splitlines()) == 1


@pytest.mark.parametrize("cache", [False, True])
def test_profile_study(spark, hourly, cache):
    caps = spark.createDataFrame([("DE", 2020, 5.0, None, 1.0)], CAPACITY)
    study = profile_study(hourly, caps, "DE", 2020, days=2, cache=cache)
    assert study["hourly"].count() == 2
    assert study["hourly"].agg(F.sum("Wind")).first()[0] == pytest.approx(200.0)
    assert {r["measure"] for r in study["statistics"].collect()} == {"ExcessSupply", "ExcessDemand"}
    assert study["daily"].count() == 77 and study["overview"].count() == 4 and study["implied"].count() == 2
    assert study["profiles"].columns == ["country", "year", "profile", "x", "Demand", "Wind", "Solar", "Constant"]
    study["hourly"].unpersist()
    absent = profile_study(hourly, caps, "XX", 2020)
    assert all(table.isEmpty() for table in absent.values())


def test_share_total():
    assert share_total() == 100
    assert share_total({"Wind": 0.5, "Solar": 0.25}) == 75


def test_capacity_without_a_generation_column_has_no_generation(spark):
    generation = spark.createDataFrame([("A", 2020, 10.0, 1.0, None, None)], "country string, year int, Demand double, Solar double, WindOnshore double, WindOffshore double")
    installed = spark.createDataFrame([("A", 2020, 5.0, 1.0, 1.0, 7.0)], "country string, year int, solar double, windOnshore double, windOffshore double, biomass double")
    stats = {r["technology"]: r for r in capacity_stats(generation, installed).collect()}
    assert stats["Biomass"]["Capacity"] == 7.0
    assert stats["Biomass"]["AnnualGeneration"] is None and stats["Biomass"]["FullloadHours"] is None
    assert stats["WindOnshore"]["AnnualGeneration"] == 0.0
