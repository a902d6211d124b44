from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.conftest import at, plan_of, records
from wattframe.operators import results as res
from wattframe.operators.compare import category_rollup, category_rows, category_spread, model_scatter
from wattframe.operators.dispatch import dispatch_hourly
from wattframe.plans import categories, comparison
from wattframe.plans.studies import result_study

GRID = {
    "share_generation": ["1", "1.1"],
    "share_renewable": ["0", "0.5"],
    "share_storage": ["0", "0.01"],
    "cost_curtailment": [{"nuclear": 1, "renewable": 0}, {"nuclear": 0, "renewable": 1}, {"nuclear": 1}],
}


@pytest.fixture(scope="module")
def hours(spark):
    rows = [("A", at(f"2020-01-01 {h:02d}:00:00"), 3.0 + h % 5, float(h % 7)) for h in range(24)]
    return spark.createDataFrame(rows, "country STRING, dateTime TIMESTAMP_NTZ, demand DOUBLE, windOnshore DOUBLE")


@pytest.fixture(scope="module")
def solved(hours):
    return dispatch_hourly(hours, **GRID).cache()


def test_annual_results(solved):
    annual = records(res.annual_results(solved), "curtailRenewableFirst", "share_generation", "share_storage", "share_renewable")
    # Two of the three cost settings curtail renewable first; they fall into one row.
    assert len(annual) == 16
    first = [r for r in annual if r["curtailRenewableFirst"]]
    nuclear = [r for r in annual if not r["curtailRenewableFirst"]]
    assert all(a["demand"] == pytest.approx(2 * b["demand"]) for a, b in zip(first, nuclear))
    for r in annual:
        whole = r["nuclear"] + r["curtailNuclear"]
        assert r["curtailNuclearPercent"] == pytest.approx(100 * r["curtailNuclear"] / whole)
        if r["share_renewable"] == 0:
            assert r["curtailRenewablePercent"] == 0.0


def test_float_noise_does_not_split_a_scenario(solved):
    noisy = solved.withColumn("share_generation", (F.col("share_generation").cast("double") + F.rand(1) * 1e-12).cast("decimal(12,8)"))
    assert res.annual_results(noisy).count() == 16


def test_cost_heatmap_and_counts(solved):
    annual = res.annual_results(solved)
    costs = res.scenario_cost(annual, 2, 1, 10, 10, 1.1, False)
    assert costs.columns[:3] == ["country", "share_storage", "share_renewable"] and costs.columns[-1] == "cost"
    assert not {"curtailRenewableFirst", "share_generation"} & set(costs.columns)
    for r in costs.collect():
        expected = (r["nuclear"] + r["curtailNuclear"]) + 2 * (r["renewable"] + r["curtailRenewable"])
        expected += 10 * r["energyNotServed"] + 10 * r["demand"] * float(r["share_storage"])
        assert r["cost"] == pytest.approx(expected)
    heat = records(res.heatmap_pivot(costs, ["0", "0.5"], "energyNotServed"), "storagePercent")
    assert [r["storagePercent"] for r in heat] == [0.0, 1.0] and {"0", "50"} < set(heat[0])
    cell = costs.filter("share_storage = 0.01 AND share_renewable = 0.5").first()
    assert heat[1]["50"] == cell["energyNotServed"]
    with pytest.raises(ValueError):
        res.heatmap_pivot(costs, ["0"], "demand")
    with pytest.raises(Exception, match="share not given: 0.5"):
        res.heatmap_pivot(costs, ["0"]).collect()
    assert {r["n"] for r in res.count_per_storage(costs).collect()} == {2}
    assert [r[0] for r in res.generation_shares(annual).collect()] == [Decimal("1.000"), Decimal("1.100")]


def test_result_study_without_series(solved):
    study = result_study(solved.drop("country"), ["0", "0.5"], series=())
    assert study["annual"].count() == 16 and study["heatmap"].columns == ["storagePercent", "0", "50"]


def test_hourly_results(solved):
    found = res.hourly_results(solved, 1.1, 0.01, 0.5, False)
    assert found.count() == 24 and {r["curtailRenewableFirst"] for r in found.collect()} == {False}
    assert res.hourly_results(solved, 1.1, 0.01, 0.4).isEmpty()


def test_melt_turns_zero_into_missing(solved):
    long = res.melt_generation(solved, keys=("scenario_id", "date"))
    assert long.columns == ["scenario_id", "date", "technology", "value"]
    assert long.count() == 4 * solved.count()
    assert long.filter("value = 0").isEmpty()
    zero = solved.filter("renewable = 0").count()
    assert long.filter("technology = 'renewable' AND value IS NULL").count() == zero > 0


def test_union_aligns_columns_by_name(spark):
    a, b = spark.createDataFrame([(1, 2)], "x INT, y INT"), spark.createDataFrame([(3,)], "y INT")
    assert records(res.union_results([a, b]), "y") == [{"x": 1, "y": 2}, {"x": None, "y": 3}]
    with pytest.raises(ValueError):
        res.union_results([])


# ---- comparison of models

ROWS = [
    ("m1", "s1", "v", "a", "2050", 1.0),
    ("m1", "s1", "v", "b", "2050", 2.0),
    ("m1", "s1", "v", "z", "2050", 50.0),
    ("m1", "s1", "v", "total", "2050", 53.0),
    ("m1", "s2", "v", "a", "2050", 3.0),
    ("m2", "s1", "v", "a", "2050", 5.0),
    ("m2", "s1", "v", "c", "2050", 7.0),
    ("m2", "s1", "v", "a", "2040", 99.0),
    ("m2", "s1", "w", "a", "2050", 9.0),
    ("m2", "s1", "w", "total", "2050", 9.0),
    ("m2", "s1", "v", "total", "2050", 12.0),
]
SCHEMA = "model STRING, scenario STRING, variable STRING, technology STRING, year STRING, value DOUBLE"
MAP = {"one": ["a", "b"], "two": ["c"], "three": ["d"]}


@pytest.fixture
def compared(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_category_rollup(compared):
    rows = records(category_rollup(compared, "v", MAP, 2050, scale=10, on_top="total"), "model", "scenario", "position")
    assert [(r["model"], r["scenario"], r["category"], r["value"], r["onTop"]) for r in rows] == [
        ("m1", "s1", "one", 30.0, 30.0),
        ("m1", "s2", "one", 30.0, 30.0),
        ("m2", "s1", "one", 50.0, 120.0),
        ("m2", "s1", "two", 70.0, 120.0),
    ]
    other = records(category_rollup(compared, "v", MAP, "2050", ["m2"], on_top="w"), "position")
    assert [(r["model"], r["onTop"]) for r in other] == [("m2", 9.0), ("m2", 9.0)]


def test_category_spread_and_order(compared):
    rows = records(category_spread(compared, "v", MAP, "2050", ["two", "absent"]), "position")
    assert [(r["position"], r["category"], r["n"]) for r in rows] == [(0, "two", 1), (1, "one", 3)]
    one = rows[1]
    assert (one["lowest"], one["lowerQuartile"], one["median"], one["upperQuartile"], one["highest"]) == (3.0, 3.0, 3.0, 4.0, 5.0)


def test_scatter(compared):
    rows = records(model_scatter(compared, "v", "2050"), "model")
    assert [(r["model"], r["value"], r["modelMean"]) for r in rows] == [("m1", 53.0, 53.0), ("m2", 12.0, 12.0)]


def test_code_in_two_categories_is_rejected():
    with pytest.raises(ValueError, match="two categories"):
        category_rows("", "v", {"one": ["a"], "two": ["a"]})


# Groups and codes per map.
SIZES = {
    "SUPPLY": (12, 16), "SUPPLY_NET": (12, 15), "SUPPLY_SPREAD": (10, 13), "USE": (11, 20), "USE_NET": (11, 21),
    "USE_SPREAD": (6, 12), "HYDROGEN_SUPPLY": (5, 6), "HYDROGEN_USE": (8, 11), "METHANE_SUPPLY": (4, 6),
    "METHANE_USE": (8, 10), "LIQUIDS_SUPPLY": (3, 5), "LIQUIDS_USE": (8, 10), "SPACE_HEAT": (10, 16),
    "SPACE_HEAT_SPREAD": (9, 15), "PROCESS_HEAT": (9, 15), "PROCESS_HEAT_SPREAD": (9, 15), "TRANSPORT": (4, 5),
    "TRANSPORT_SPREAD": (4, 5),
}


@pytest.mark.parametrize("name", SIZES)
def test_map_sizes(name):
    codes = getattr(categories, name)
    assert (len(codes), sum(map(len, codes.values()))) == SIZES[name]
    category_rows("", "", codes)


def test_orders_name_categories_of_their_map():
    for name, (_, codes, order) in comparison.SPREADS.items():
        # Known quirk of the transport order: it names a category its map does not have.
        assert set(order) - set(codes) <= {"Methane"}, name


def test_reports(spark):
    rows = [("stem", "s", "electricity_supply", t, "2050", 1.0) for t in ("hydro_dam", "hydro_ror", "nuclear", "total")]
    rows += [("stem", "s", "freight_road_fec", "methane", "2050", 4.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    names = [*comparison.BARS, *comparison.SPREADS, *comparison.SCATTERS]
    assert (len(comparison.BARS), len(comparison.SPREADS), len(names)) == (15, 7, 23)
    bars = records(comparison.all_bars(df), "report", "position")
    single = records(comparison.report(df, "elecSupply_tech"), "position")
    assert [(r["category"], r["value"]) for r in single] == [("Hydro", 2.0), ("Nuclear", 1.0)]
    assert [r["value"] for r in bars if r["report"] == "elecSupply_tech"] == [2.0, 1.0]
    spreads = {(r["report"], r["category"]): r for r in records(comparison.all_spreads(df))}
    assert spreads["elecDist_tech", "Nuc."]["position"] == 3
    # Biogas is not in the order, so it comes after the three that are.
    assert spreads["freight_road_fec_dist", "Biogas"]["position"] == 3
    assert comparison.report(df, "freight_road_fec_dist").first()["median"] == 4.0
    assert comparison.report(df, "elecSupply_aver").first()["value"] == 1.0
    with pytest.raises(ValueError):
        comparison.report(df, "nothing")
    assert plan_of(comparison.all_bars(df)).count("HashAggregate") == 2
    assert comparison.model_table(spark).count() == 4 and comparison.scenario_table(spark).count() == 8
