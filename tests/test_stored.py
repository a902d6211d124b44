"""Stored layouts: what they save, shown by plans, row groups and rows scanned; and sweeps that go on."""

import random
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.conftest import at, plan_of, records
from wattframe.operators.dispatch import dispatch_hourly, rejected_scenarios, sweep_totals
from wattframe.operators.lag import circular_lag
from wattframe.operators.normalize import normalize_generation
from wattframe.plans import sweep
from wattframe.sources import (
    bad_cells,
    check_comparison,
    country_period,
    read_by_day,
    read_hourly,
    read_results,
    read_runs,
    store_by_day,
    store_by_hour,
    write_results,
)

SCHEMA = (
    "country STRING, dateTime TIMESTAMP_NTZ, demand DOUBLE, windOnshore DOUBLE, "
    "windOffshore DOUBLE, solar DOUBLE"
)
GRID = {
    "share_generation": ["1", "1.2"],
    "share_renewable": ["0", "0.5", "1"],
    "share_storage": ["0", "0.001"],
    "cost_curtailment": [{"nuclear": 1}, {"renewable": 1}],
}


def hours(days=20, places=("A", "B", "C")):
    draw = random.Random(3)
    rows = []
    for place in places:
        for d in range(days):
            for h in range(24):
                wind = None if draw.random() < 0.1 else draw.randrange(100) / 4
                rows.append((place, at(f"2020-02-{d + 1:02d} {h:02d}:00:00"), 1.0 + draw.randrange(40), wind, 1.0, 2.0))
    draw.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def hourly(spark):
    return spark.createDataFrame(hours(), SCHEMA)


@pytest.fixture(scope="module")
def by_day(spark, hourly, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored") / "hours")
    store_by_day(hourly, path, buckets=5)
    return path


def moved_rows(plan):
    """Exchanges of a plan with no aggregation below them: those that move the hours themselves."""
    lines = plan.splitlines()
    depth = [len(re.match(r"[ :+\-]*", line)[0]) for line in lines]
    found = []
    for i, line in enumerate(lines):
        if re.search(r"\bExchange\b", line):
            below = []
            for j in range(i + 1, len(lines)):
                if depth[j] <= depth[i]:
                    break
                below.append(lines[j])
            if not any("Aggregate" in b for b in below):
                found.append(line)
    return found


def test_lag_and_totals_of_a_stored_table_do_not_move_the_hours(spark, hourly, by_day):
    stored, keys = read_by_day(spark, by_day)
    assert keys == ["country", "day"] and stored.count() == hourly.count()
    columns = ["demand", "windOnshore"]
    plain, lagged = circular_lag(hourly, columns), circular_lag(stored, columns, stored=keys)
    plan = plan_of(lagged)
    assert moved_rows(plan) == [] and "Bucketed: true" in plan
    assert moved_rows(plan_of(plain))
    order = ["country", "dateTime"]
    assert records(lagged.select(plain.columns), *order) == records(plain, *order)

    def normal(df, **given):
        return normalize_generation(df, {"windOnshore": 0.5, "Constant": 0.5}, 0, demand="demand", **given)

    plan = plan_of(normal(stored, stored=keys))
    assert moved_rows(plan) == [] and moved_rows(plan_of(normal(hourly)))
    a, b = records(normal(stored, stored=keys), *order), records(normal(hourly), *order)
    assert len(a) == len(b) and all(x["demand"] == pytest.approx(y["demand"]) for x, y in zip(a, b))
    assert [x["windOnshore"] for x in a] == pytest.approx([y["windOnshore"] for y in b])

    plan = plan_of(sweep_totals(stored, **GRID, stored=keys))
    assert moved_rows(plan) == []


def test_stored_table_without_times_or_files(spark, tmp_path):
    rows = [("A", at("2020-01-01 00:00:00"), 1.0), ("A", None, 3.0), (None, at("2020-01-01 00:00:00"), 5.0)]
    df = spark.createDataFrame(rows, "country STRING, dateTime TIMESTAMP_NTZ, demand DOUBLE")
    path = str(tmp_path / "h")
    store_by_day(df, path, buckets=2)
    stored, keys = read_by_day(spark, path)
    assert sorted(r["demand"] for r in stored.collect()) == [1.0, 3.0, 5.0]
    out = normalize_generation(stored, {}, 0, demand="demand", stored=keys)
    assert {r["country"]: r["demand"] for r in out.filter("dateTime IS NULL").collect()} == {"A": 3.0}
    assert circular_lag(stored, ["demand"], stored=keys).count() == 1
    store_by_day(df.limit(0), path, buckets=2)  # another table in its place
    assert read_by_day(spark, path)[0].count() == 0
    absent, keys = read_by_day(spark, str(tmp_path / "absent"))
    assert absent.count() == 0 and circular_lag(absent, ["demand"], stored=keys).count() == 0


def scanned(df):
    """Rows that the scan of a query gave, after row groups were skipped."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        fresh = df.select("*")
        fresh.collect()
        leaves = fresh._jdf.queryExecution().executedPlan().collectLeaves()
        return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_hour_numbers_skip_row_groups_without_folders(spark, tmp_path):
    df = spark.createDataFrame(hours(28, ("A", "B", "C", "E", "F")), SCHEMA)
    plain, flat = str(tmp_path / "plain"), str(tmp_path / "flat")
    df.coalesce(1).write.parquet(plain)
    store_by_hour(df, flat, files=2, block_size=4096)
    given = ("C", "2020/02/10 00:00", "2020/02/12 23:00")
    a = country_period(read_hourly(spark, plain), *given)
    b = country_period(read_hourly(spark, flat), *given)
    assert records(a, "dateTime") == records(b.select(a.columns), "dateTime") and len(a.collect()) == 72
    assert "GreaterThanOrEqual(hourNumber," in plan_of(b)
    assert scanned(a) == df.count() and scanned(b) < df.count() / 4
    # A country within the range of the others, but not there: the Bloom filter rules it out.
    assert scanned(country_period(read_hourly(spark, flat), "D", *given[1:])) == 0


def sweep_rows(spark):
    shares = {
        "share_generation": [f"{100 + 5 * i}" for i in range(5)],
        "share_renewable": [f"{10 * i}" for i in range(11)],
        "share_storage": [f"{i}" for i in range(11)],
    }
    df = spark.range(96).select(F.col("id").cast("double").alias("nuclear"))
    for name, values in shares.items():
        share = F.explode(F.array(*(F.lit(v).cast("decimal(12,8)") for v in values)))
        df = df.select("*", share.alias(name))
    return df, shares


def groups_read(path, column, value):
    """Part of the row groups whose range of a column holds a value."""
    held = total = 0
    for file in sorted(path.glob("*.parquet")):
        meta = pq.ParquetFile(file).metadata
        at_column = [meta.schema.column(i).name for i in range(meta.num_columns)].index(column)
        for i in range(meta.num_row_groups):
            stats = meta.row_group(i).column(at_column).statistics
            total += 1
            held += stats.min <= value <= stats.max
    return held / total, total


def test_interleaved_shares_skip_row_groups_for_each_of_them(spark, tmp_path):
    df, shares = sweep_rows(spark)
    write_results(df.coalesce(1), str(tmp_path / "plain"), block_size=2048)
    write_results(df.coalesce(1), str(tmp_path / "grid"), grid=shares, block_size=2048)
    worst = plain = 0
    for name, values in shares.items():
        for v in values:
            value = df.filter(F.col(name) == v).first()[name]
            part, total = groups_read(tmp_path / "grid", name, value)
            assert total > 60 and part < 1 / 3, (name, v, part, total)
            worst, plain = max(worst, part), max(plain, groups_read(tmp_path / "plain", name, value)[0])
    assert worst < plain  # what a plain sort does for its last share
    back = spark.read.parquet(str(tmp_path / "grid"))
    assert back.count() == df.count()
    assert scanned(back.filter("share_renewable = 50")) < df.count() / 3


def given(spark, tmp_path, name="in", rows=None):
    path = str(tmp_path / name)
    spark.createDataFrame(rows or hours(6), SCHEMA).write.parquet(path)
    return {**GRID, "country": "A", "start": "2020/02/01 00", "end": "2020/02/06 23", "hourly_path": path}


def test_a_stopped_sweep_goes_on_where_it_was(spark, tmp_path):
    asked = given(spark, tmp_path)
    out = str(tmp_path / "out")
    whole = records(sweep.simulate(spark, **asked), "scenario_id", "date")
    first = sweep.simulate(spark, **asked, out_path=out, parts=3, at_most=1)
    assert {str(r[0]) for r in first.select("share_renewable").distinct().collect()} == {"0E-8"}
    kept = {f: f.stat().st_mtime_ns for f in (tmp_path / "out").glob("share_renewable=0*0/*.parquet")}
    # A part that was stopped half-way has left some rows behind.
    left = first.limit(3).withColumn("share_renewable", F.lit("0.5").cast("decimal(12,8)"))
    write_results(left, out, partition_by=["share_renewable"], replace="dynamic")
    columns = list(whole[0])
    done = sweep.simulate(spark, **asked, out_path=out, parts=3).select(columns)
    assert records(done, "scenario_id", "date") == whole
    again = sweep.simulate(spark, **asked, out_path=out, parts=3).select(columns)
    assert records(again, "scenario_id", "date") == whole
    assert kept and {f: f.stat().st_mtime_ns for f in kept} == kept
    with pytest.raises(ValueError, match="another sweep"):
        sweep.simulate(spark, **{**asked, "country": "B"}, out_path=out, parts=3)
    assert records(read_results(spark, out).select(columns), "scenario_id", "date") == whole
    # Without parts the folder is replaced, its notes included.
    sweep.simulate(spark, **{**asked, "country": "B"}, out_path=out)
    assert {r[0] for r in read_results(spark, out).select("country").distinct().collect()} == {"B"}
    sweep.simulate(spark, **asked, out_path=out, parts=2)
    assert records(read_results(spark, out).select(columns), "scenario_id", "date") == whole


def test_repeated_hours_stop_the_sweep_without_a_job_of_their_own(spark, tmp_path):
    rows = hours(6)
    asked = given(spark, tmp_path, "twice", [*rows, rows[0]])
    asked = {**asked, "country": rows[0][0]}

    def jobs():
        return spark._jsc.sc().dagScheduler().numTotalJobs()

    before = jobs()
    read_hourly(spark, asked["hourly_path"])
    reading = jobs() - before
    before = jobs()
    results = sweep.simulate(spark, **asked)
    assert jobs() - before == reading
    for run in (results.collect, results.count):
        with pytest.raises(Exception, match="key occurs more than once"):
            run()


def test_rejected_scenarios_are_those_that_dispatch_leaves_out(spark):
    rows = [(p, at(f"2020-01-01 {h:02d}:00:00"), d, w, None, None) for p, h, d, w in (
        ("low", 0, 5.0, 2.0), ("low", 1, 5.0, -1.0), ("off", 0, -1.0, 1.0), ("off", 1, 5.0, 1.0),
        ("fine", 0, 5.0, 1.0), ("fine", 1, 0.0, 0.0), ("none", 0, None, None))]
    df = spark.createDataFrame([*rows, (None, at("2020-01-01 00:00:00"), -5.0, 1.0, None, None)], SCHEMA)
    found = {(r["country"], r["scenario_id"]): r["reason"] for r in rejected_scenarios(df, **GRID).collect()}
    n = 2 * 3 * 2 * 2
    solved = {(r[0], r[1]) for r in dispatch_hourly(df, **GRID).select("country", "scenario_id").distinct().collect()}
    assert solved | set(found) == {(p, i) for p in ("low", "off", "fine", "none") for i in range(n)}
    assert not solved & set(found)
    assert {found["off", i] for i in range(n)} == {"negative demand"}
    # Without renewable energy, its negative hours do no harm.
    assert {i for p, i in found if p == "low"} == set(range(8, n)) and found["low", 8] == "negative renewable potential"
    assert not any(p in ("fine", "none") for p, _ in found)
    odd = {**GRID, "share_generation": ["-1"], "share_storage": ["-0.1"], "share_renewable": ["0", "1"]}
    reasons = {r["reason"] for r in rejected_scenarios(df.filter("country = 'fine'"), **odd).collect()}
    assert reasons == {
        "negative nuclear potential, negative storage size", "negative renewable potential, negative storage size"
    }


def test_negative_total_turns_the_largest_demand_into_the_least(spark):
    rows = [("A", at("2020-01-01 00:00:00"), -9.0, 1.0, None, None), ("A", at("2020-01-01 01:00:00"), 2.0, 1.0, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert dispatch_hourly(df, **GRID, total_demand=100).count() == 0
    assert {r["reason"] for r in rejected_scenarios(df, **GRID, total_demand=100).collect()} == {"negative demand"}


def test_infeasible_scenarios_cost_no_hour_rows(spark, hourly):
    bad = hourly.withColumn("windOnshore", F.when(F.hour("dateTime") == 0, -1.0).otherwise(F.col("windOnshore")))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = dispatch_hourly(bad, **GRID)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        found, waiting = [], [plan]
        while waiting:
            node = waiting.pop()
            if node.nodeName() == "Generate":
                found.append(node.metrics().apply("numOutputRows").value())
            waiting += [node.children().apply(i) for i in range(node.children().size())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    n = hourly.count()
    # Only the share 0 is feasible: the hours meet 3 shares, then 1 x 2 pairs, and their 2 x 2 further lists.
    assert sorted(found) == [2 * n, 3 * n, 4 * n, 8 * n]


def test_rejected_rows_of_a_comparison_file(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text(
        "year,model,extra,scenario,variable,technology,value\n"
        "2050,m,x,s,v,t,1.5\n2050,m,x,s,v,t,\n2050,m,x,s,v,t,1;5\n2050,m,x,s,v\n2050,m,x,s,v,t,oops,more\n"
    )
    good, rejected = check_comparison(spark, str(path))
    assert sorted((r["value"] is None, r["value"]) for r in good.collect()) == [(False, 1.5), (True, None)]
    assert sorted(r["bad"] for r in rejected.collect()) == [["line"], ["line", "value"], ["value"]]
    assert {r["column"]: r["n"] for r in bad_cells(rejected).collect()} == {"line": 2, "value": 2}
    good, rejected = check_comparison(spark, str(tmp_path / "absent.csv"))
    assert good.count() == 0 and bad_cells(rejected).count() == 0


def test_runs_with_differing_columns_by_one_scan(spark, tmp_path):
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    spark.createDataFrame([(1.0, 0.5, "a")], "nuclear DOUBLE, share_storage DOUBLE, source STRING").write.parquet(one)
    spark.createDataFrame([("b", float("nan"))], "source STRING, demand DOUBLE").write.parquet(two)
    both = read_runs(spark, [one, two])
    assert plan_of(both).count("FileScan") == 1
    assert dict(both.dtypes)["share_storage"] == "decimal(12,8)"
    rows = records(both, "source")
    assert (rows[0]["nuclear"], rows[0]["demand"], rows[1]["nuclear"], rows[1]["demand"]) == (1.0, None, None, None)
    with pytest.raises(ValueError):
        read_runs(spark, [])
