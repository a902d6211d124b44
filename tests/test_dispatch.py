import itertools
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import at, plan_of, records
from wattframe.operators.dispatch import (
    AMOUNTS,
    dispatch_hourly,
    dispatch_totals,
    merit_order,
    scenario_inputs,
    sweep_totals,
)
from wattframe.operators.grid import scenario_attributes, spread_scenarios
from wattframe.operators.lag import circular_lag
from wattframe.plans.sweep import STUDY, simulate
from wattframe.sources import read_hourly, read_results, tables

SCHEMA = "country STRING, dateTime TIMESTAMP_NTZ, demand DOUBLE, windOnshore DOUBLE, windOffshore DOUBLE, solar DOUBLE"
COSTS = [
    {"nuclear": 1, "renewable": 0},
    {"nuclear": 0, "renewable": 1},
    {"nuclear": 0, "renewable": 0},
    {"nuclear": 0.5, "renewable": 2},
    {"nuclear": -0.5, "renewable": 0.5},
    {"nuclear": -2, "renewable": -1},
]
GRID = {
    "share_generation": ["0.8", "1.2"],
    "share_renewable": ["0", "0.5", "1"],
    "share_storage": ["0", "0.02"],
    "cost_curtailment": COSTS,
}


def some_hours(days=5, countries=("A", "B"), seed=3):
    rng = random.Random(seed)
    return [
        (c, at(f"2020-02-{27 + d if d < 3 else d - 2:02d} {h:02d}:00:00").replace(month=2 if d < 3 else 3),
         rng.uniform(5, 15), rng.choice([None, rng.uniform(0, 9)]), None, rng.uniform(0, 3))
        for c in countries for d in range(days) for h in range(24) if rng.random() < 0.9
    ]


@pytest.fixture(scope="module")
def hours(spark):
    return spark.createDataFrame(some_hours(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def solved(hours):
    return dispatch_hourly(hours, **GRID).cache()


def cheapest(dem, nuclear, renewable, storage, cn, cr):
    """Least objective over all vertices of the program of one hour."""
    best = None
    caps = [nuclear, renewable, storage, None]
    for free in range(4):
        others = [i for i in range(4) if i != free]
        choices = [(0.0,) if caps[i] is None else (0.0, caps[i]) for i in others]
        for values in itertools.product(*choices):
            x = dict(zip(others, values))
            x[free] = dem - sum(values)
            if x[free] < -1e-12 or (caps[free] is not None and x[free] > caps[free] + 1e-12):
                continue
            cost = x[3] + cn * (nuclear - x[0]) + cr * (renewable - x[1])
            if best is None or cost < best[0] - 1e-12:
                best = (cost, x[3])
            elif abs(cost - best[0]) <= 1e-12:
                best = (best[0], min(best[1], x[3]))
    return best


@pytest.mark.parametrize("lowest", [-2.0, -1.0, 0.0])
def test_merit_order_is_optimal(spark, lowest):
    rng = random.Random(11)
    costs = [c for c in (-2.0, -1.0, -0.5, 0.0, 0.5, 1.0, 2.0) if c >= lowest]
    cases = [
        (i, rng.uniform(0, 10), *(rng.choice([0.0, rng.uniform(0, 6)]) for _ in range(3)), rng.choice(costs), rng.choice(costs))
        for i in range(3000)
    ]
    df = spark.createDataFrame(cases, "id INT, dem DOUBLE, n DOUBLE, r DOUBLE, s DOUBLE, cn DOUBLE, cr DOUBLE")
    taken = merit_order(*(F.col(c) for c in ("dem", "n", "r", "s", "cn", "cr")), lowest)
    for row in df.select("*", *(c.alias("_" + k) for k, c in taken.items())).collect():
        used = row["_nuclear"], row["_renewable"], row["_storage"], row["_unserved"]
        assert sum(used) == pytest.approx(row["dem"], abs=1e-9)
        for amount, cap in zip(used, (row["n"], row["r"], row["s"])):
            assert 0 <= amount <= cap + 1e-12
        assert used[3] >= 0
        cost = used[3] + row["cn"] * (row["n"] - used[0]) + row["cr"] * (row["r"] - used[1])
        best = cheapest(row["dem"], row["n"], row["r"], row["s"], row["cn"], row["cr"])
        assert cost == pytest.approx(best[0], abs=1e-9)


def test_ties_follow_the_rule(spark):
    taken = merit_order(*(F.lit(float(v)) for v in (5, 3, 3, 3, 0, 0)))
    row = spark.range(1).select(*(c.alias(k) for k, c in taken.items())).first()
    assert (row["nuclear"], row["renewable"], row["storage"], row["unserved"]) == (3.0, 2.0, 0.0, 0.0)


def test_dispatch_invariants(solved, hours):
    assert solved.count() == hours.count() * 2 * 3 * 2 * len(COSTS)
    off = solved.filter(
        (F.abs(F.expr("nuclear + renewable + storageLevel + energyNotServed - demand")) > 1e-9)
        | (F.col("curtailNuclear") < -1e-9)
        | (F.col("curtailRenewable") < -1e-9)
        | (F.least("nuclear", "renewable", "storageLevel", "energyNotServed") < 0)
    )
    assert off.isEmpty()
    sums = solved.groupBy("country", "scenario_id").agg(
        F.sum("netStorage").alias("net"),
        F.sum(F.expr("nuclear + curtailNuclear + renewable + curtailRenewable")).alias("potential"),
        (F.first("share_generation").cast("double") * F.sum("demand")).alias("expected"),
    )
    for row in sums.collect():
        assert row["net"] == pytest.approx(0, abs=1e-9)
        assert row["potential"] == pytest.approx(row["expected"])


def test_net_storage_is_the_circular_change_of_the_level(solved):
    rows = records(solved.filter("country = 'A' AND scenario_id = 30"), "date")
    levels = [r["storageLevel"] for r in rows]
    assert [r["netStorage"] for r in rows] == pytest.approx([levels[i - 1] - levels[i] for i in range(len(levels))])
    assert any(r["netStorage"] for r in rows)


def test_more_storage_or_generation_serves_more(solved):
    unserved = {
        (r["country"], r["share_generation"], r["share_renewable"], r["share_storage"]): r["u"]
        for r in records(
            solved.filter("costCurtailNuclear = 1").groupBy("country", "share_generation", "share_renewable", "share_storage")
            .agg(F.sum("energyNotServed").alias("u"))
        )
    }
    for (c, g, r, s), u in unserved.items():
        for other in unserved:
            if other[0] == c and other[2] == r and other[1] >= g and other[3] >= s:
                assert unserved[other] <= u + 1e-9


def test_sweep_totals_equal_the_summed_hours(solved, hours):
    direct = records(sweep_totals(hours, **GRID), "country", "scenario_id")
    summed = records(dispatch_totals(solved), "country", "scenario_id")
    assert len(direct) == len(summed) == 2 * 72
    for a, b in zip(direct, summed):
        assert {k: v for k, v in a.items() if "share" in k} == {k: v for k, v in b.items() if "share" in k}
        for name in (*AMOUNTS, "objective", "costCurtailNuclear", "costCurtailRenewable"):
            assert a[name] == pytest.approx(b[name], abs=1e-7), name


def test_total_demand_rescales(hours):
    grid = {**GRID, "cost_curtailment": COSTS[:1]}
    own = records(sweep_totals(hours, **grid), "country", "scenario_id")
    scaled = records(sweep_totals(hours, **grid, total_demand=100), "country", "scenario_id")
    for a, b in zip(own, scaled):
        assert b["demand"] == pytest.approx(100)
        assert b["energyNotServed"] == pytest.approx(a["energyNotServed"] / a["demand"] * 100)


def test_scenario_without_feasible_dispatch_is_left_out(spark):
    rows = [("A", at("2020-01-01 00:00:00"), 5.0, -1.0, None, 1.0), ("A", at("2020-01-01 01:00:00"), 5.0, 3.0, None, 1.0),
            ("B", at("2020-01-01 00:00:00"), -5.0, 1.0, None, 1.0), ("B", at("2020-01-01 01:00:00"), 9.0, 1.0, None, 1.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = dispatch_hourly(df, ["1"], ["0", "0.5"], ["0"]).select("country", "share_renewable").distinct().collect()
    # Negative wind rules out the scenarios that use it, negative demand rules out all.
    assert [(r[0], float(r[1])) for r in kept] == [("A", 0.0)]
    assert {r[0] for r in dispatch_hourly(df, ["1"], ["0.5"], ["0"], renewable="solar").select("country").collect()} == {"A"}


def test_missing_profile_gives_no_renewable_potential(spark):
    df = spark.createDataFrame([("A", at("2020-01-01 00:00:00"), 5.0, None, None, None)], SCHEMA)
    row = dispatch_hourly(df, ["1"], ["0.5"], ["0.1"]).first()
    assert (row["renewable"], row["nuclear"], row["storageLevel"], row["netStorage"]) == (0.0, 2.5, 0.5, 0.0)


def test_grid_checks():
    for bad in ({"share_renewable": ["1.1"]}, {"share_renewable": ["-0.1"]}, {"share_storage": []}, {"cost_curtailment": [{"coal": 1}]}):
        with pytest.raises(ValueError):
            spread_scenarios(None, **{**GRID, **bad})


def test_scenario_attributes_match_the_grid(spark):
    spread = spread_scenarios(spark.range(1), **GRID)
    looked_up = scenario_attributes(F.col("scenario_id"), **GRID)
    names = list(looked_up)
    both = spread.select("scenario_id", *names, *(c.alias("_" + k) for k, c in looked_up.items()))
    rows = both.collect()
    assert sorted(r["scenario_id"] for r in rows) == list(range(72))
    assert all(r[n] == r["_" + n] for r in rows for n in names)


def test_study_grid_has_1210_scenarios(spark):
    assert spread_scenarios(spark.range(1), **STUDY).count() == 1210


def test_inputs(spark, hours):
    row = scenario_inputs(hours, ["1.2"], ["0.25"], ["0.01"], total_demand=100).first()
    assert row["energyNuclear"] == pytest.approx(90) and row["energyRenewable"] == pytest.approx(30)
    assert row["storageSize"] == pytest.approx(1.0)


def test_circular_lag(spark):
    rows = [("A", at(f"2020-01-0{d} 0{h}:00:00"), float(10 * d + h) if h else None) for d in (1, 2, 4) for h in (0, 1, 5)]
    rows.append(("B", at("2020-01-01 00:00:00"), 7.0))
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "country STRING, dateTime TIMESTAMP_NTZ, x DOUBLE")
    got = records(circular_lag(df, ["x"]), "country", "dateTime")
    a = [r for r in got if r["country"] == "A"]
    assert [r["previous_x"] for r in a] == [a[i - 1]["x"] for i in range(len(a))]
    # A missing value is a value: the hour after it sees it as missing.
    assert a[1]["previous_x"] is None and a[0]["previous_x"] == 45.0
    assert [r["previous_x"] for r in got if r["country"] == "B"] == [7.0]


def test_hours_are_scanned_and_shuffled_once_and_spread_in_place(spark, tmp_path):
    path = str(tmp_path / "h")
    spark.createDataFrame(some_hours(2), SCHEMA).write.parquet(path)
    plan = plan_of(dispatch_hourly(read_hourly(spark, path), **STUDY))
    assert plan.count("FileScan") == 1 and plan.count("ReusedExchange") == 1
    assert plan.count("REPARTITION_BY_NUM") <= 2 and "Python" not in plan
    for join in ("BroadcastNestedLoopJoin", "CartesianProduct", "BroadcastExchange"):
        assert join not in plan
    # No exchange above the step that multiplies the rows.
    assert "Exchange" not in plan[: plan.index("Generate")]
    assert "solar" not in plan


@pytest.mark.parametrize("partitions", [1, 7])
def test_result_does_not_depend_on_partitioning(spark, hours, solved, partitions):
    again = dispatch_hourly(hours.orderBy(F.rand(5)).repartition(partitions), **GRID, partitions=partitions)
    keys = ["country", "scenario_id", "date"]
    joined = solved.select(*keys, *AMOUNTS).join(again.select(*keys, *(F.col(a).alias("_" + a) for a in AMOUNTS)), keys, "full")
    off = [F.abs(F.col(a) - F.col("_" + a)) > 1e-9 for a in AMOUNTS] + [F.col(a).isNull() | F.col("_" + a).isNull() for a in AMOUNTS]
    condition = off[0]
    for o in off[1:]:
        condition = condition | o
    assert joined.filter(condition).isEmpty()


def test_simulate_writes_and_reads_back(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(some_hours(), SCHEMA).write.parquet(source)
    out = simulate(spark, ["1"], ["0.5"], ["0", "0.01"], COSTS[:2], 100, country="A", start="2020/02/28 00:00", end="2020/03/01 23", hourly_path=source, out_path=target)
    lazy = simulate(spark, ["1"], ["0.5"], ["0", "0.01"], COSTS[:2], 100, country="A", start="2020/02/28 00:00", end="2020/03/01 23", hourly_path=source)
    assert out.count() == lazy.count() > 0 and out.agg(F.sum("demand")).first()[0] == pytest.approx(400)
    assert read_results(spark, target).agg(F.min("date"), F.max("date")).first()[0] >= at("2020-02-28 00:00:00")
    spark.createDataFrame(some_hours()[:1] * 2, SCHEMA).write.parquet(str(tmp_path / "twice"))
    with pytest.raises(Exception, match="more than once"):
        simulate(spark, ["1"], ["0.5"], ["0"], country="A", start="2020/01/01 00", end="2020/12/31 23", hourly_path=str(tmp_path / "twice")).collect()
    with pytest.raises(ValueError, match="within 0 and 1"):
        simulate(spark, ["1"], ["2"], ["0"], country="A", start="2020/01/01 00", end="2020/12/31 23", hourly_path=source)


def test_given_tables(spark, testdata):
    totals = sweep_totals(tables.hourly_events(spark, testdata), ["1"], ["0.5"], ["0.001"])
    assert totals.first()["energyNotServed"] > 0
