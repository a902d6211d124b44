import pytest
from pyspark.sql import functions as F

from tests.conftest import at, plan_of, records
from wattframe.operators.balance import storage_hourly, storage_stats, transpose_stats
from wattframe.operators.bins import resample_days, resample_days_percent
from wattframe.operators.checks import column_counts, duplicate_hours, first_hours, require_unique_hours
from wattframe.operators.joins import with_totals
from wattframe.operators.normalize import normalize_generation
from wattframe.operators.profiles import all_profiles, season_profiles, stack_columns, stacked_profile

SCHEMA = "country STRING, dateTime TIMESTAMP_NTZ, Wind DOUBLE, Solar DOUBLE, Demand DOUBLE"
THREE = [
    ("A", at("2020-01-01 00:00:00"), 1.0, 0.0, 2.0),
    ("A", at("2020-01-01 01:00:00"), 3.0, None, 2.0),
    ("A", at("2020-01-01 02:00:00"), None, 4.0, 4.0),
    ("B", at("2020-01-01 00:00:00"), 5.0, 1.0, 0.0),
]


@pytest.fixture
def hours(spark):
    return spark.createDataFrame(THREE, SCHEMA)


def test_normalize_generation(hours):
    shares = {"Wind": 0.5, "Solar": 0.25, "Constant": 0.25}
    rows = records(normalize_generation(hours, shares), "country", "dateTime")
    assert list(rows[0]) == ["country", "dateTime", "Wind", "Solar", "Constant", "Demand"]
    assert [r["Wind"] for r in rows[:3]] == [1.0, 3.0, None]
    assert [r["Solar"] for r in rows[:3]] == [0.0, None, 2.0]
    assert [r["Constant"] for r in rows[:3]] == pytest.approx([2 / 3] * 3)
    assert [r["Demand"] for r in rows[:3]] == [2.0, 2.0, 4.0]
    # No demand at all: shares of nothing, and a demand profile that is missing.
    assert (rows[3]["Wind"], rows[3]["Demand"]) == (0.0, None)
    assert shares == {"Wind": 0.5, "Solar": 0.25, "Constant": 0.25}


def test_normalize_to_a_given_total(hours):
    scaled = normalize_generation(hours, {"Wind": 0.5}, total_demand=80)
    sums = scaled.filter("country = 'A'").agg(F.sum("Wind"), F.sum("Demand")).first()
    assert tuple(sums) == pytest.approx((40.0, 80.0))
    assert scaled.columns == ["country", "dateTime", "Wind", "Demand"]


def test_normalize_rejects_unknown_technology(hours):
    with pytest.raises(ValueError, match="Hydro"):
        normalize_generation(hours, {"Hydro": 1})


def test_column_without_profile_is_missing(spark):
    df = spark.createDataFrame([("A", at("2020-01-01 00:00:00"), None, 0.0, 2.0)], SCHEMA)
    row = normalize_generation(df, {"Wind": 1, "Solar": 1}).first()
    assert (row["Wind"], row["Solar"], row["Demand"]) == (None, None, 2.0)


def test_storage_hourly_signs(spark):
    rows = [
        ("A", at("2020-01-01 00:00:00"), 3.0, 1.0, 2.0),
        ("A", at("2020-01-01 01:00:00"), 2.0, None, 2.0),
        ("A", at("2020-01-01 02:00:00"), None, None, 2.0),
        ("A", at("2020-01-01 03:00:00"), 1.0, 1.0, None),
    ]
    got = records(storage_hourly(spark.createDataFrame(rows, SCHEMA)), "dateTime")
    assert [r["TotalSupply"] for r in got] == [4.0, 2.0, 0.0, 2.0]
    assert [r["ExcessSupply"] for r in got] == [2.0, 0.0, 0.0, None]
    assert [r["ExcessDemand"] for r in got] == [0.0, 0.0, 2.0, None]
    for r in got[:3]:
        assert r["ExcessSupply"] - r["ExcessDemand"] == r["TotalSupply"] - r["Demand"]


def test_storage_stats(spark):
    rows = [("A", at(f"2020-01-01 0{i}:00:00"), w, 0.0, 10.0) for i, w in enumerate([19.0, 19.01, 1.0, 0.5])]
    rows.append(("B", at("2020-01-01 00:00:00"), 1.25, 0.0, 0.0))
    stats = storage_stats(storage_hourly(spark.createDataFrame(rows, SCHEMA)))
    got = {(r["country"], r["measure"]): r for r in records(stats)}
    supply = got["A", "ExcessSupply"]
    # 9 is not above the threshold of 9, 9.01 is.
    assert (supply["Total"], supply["Max"], supply["Hours"]) == (18.0, 9.0, 1.0)
    assert supply["TotalPercentOfDemand"] == 45.0
    assert (got["A", "ExcessDemand"]["Total"], got["A", "ExcessDemand"]["Hours"]) == (18.5, 1.0)
    # Demand 0 gives 0 percent, and 1.25 rounds to the even 1.2.
    assert (got["B", "ExcessSupply"]["TotalPercentOfDemand"], got["B", "ExcessSupply"]["Total"]) == (0.0, 1.2)
    wide = {(r["country"], r["statistic"]): r for r in records(transpose_stats(stats))}
    assert wide["A", "Total"]["ExcessSupply"] == 18.0 and wide["A", "Hours"]["ExcessDemand"] == 1.0


def test_storage_of_no_rows(spark):
    empty = storage_hourly(spark.createDataFrame([], SCHEMA))
    assert empty.isEmpty() and storage_stats(empty).isEmpty()
    assert resample_days(empty, 2).isEmpty() and all_profiles(empty).isEmpty()


def profile_rows(spark):
    return spark.range(0, 24 * 366).select(
        F.lit("A").alias("country"),
        (F.lit("2020-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("dateTime"),
        F.when(F.col("id") % 7 != 0, (F.col("id") % 97).cast("double")).alias("Wind"),
        F.when(F.col("id") < 0, 1.0).alias("Solar"),
        (F.col("id") % 5).cast("double").alias("Demand"),
    )


def test_all_profiles_against_single_means(spark):
    df = profile_rows(spark)
    got = {(r["profile"], r["x"]): r for r in records(all_profiles(df))}
    assert len(got) == 24 + 12 + 4 * 24
    assert {p for p, _ in got} == {"Hourly: Year", "Monthly"} | {
        f"Hourly: {s}" for s in ("Spring", "Summer", "Autumn", "Winter")
    }
    winter = df.filter(F.month("dateTime").isin(1, 2, 12) & (F.hour("dateTime") == 5))
    assert got["Hourly: Winter", 5]["Wind"] == pytest.approx(winter.agg(F.avg("Wind")).first()[0])
    may = df.filter(F.month("dateTime") == 5).agg(F.avg("Demand")).first()[0]
    assert got["Monthly", 5]["Demand"] == pytest.approx(may)
    assert got["Monthly", 5]["Solar"] is None


def test_season_profiles_of_some_seasons(spark):
    got = records(season_profiles(profile_rows(spark), ["Summer"], ["Wind"]))
    assert len(got) == 24 and {r["season"] for r in got} == {"Summer"}


def test_profiles_read_and_shuffle_the_hours_once(spark, tmp_path):
    path = str(tmp_path / "h")
    profile_rows(spark).write.parquet(path)
    plan = plan_of(all_profiles(spark.read.parquet(path)))
    assert plan.count("FileScan") == 1 and plan.count("Expand") == 0
    assert plan.index("partial_sum(Wind") > plan.index("Generate")


def test_stacking(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 4.0), (2, None, 1.0, 1.0)], "x INT, a DOUBLE, b DOUBLE, c DOUBLE")
    rows = records(stack_columns(df, ["b", "absent", "c", "a"]), "x")
    assert (rows[0]["b"], rows[0]["c"], rows[0]["a"]) == (2.0, 6.0, 7.0)
    assert rows[1]["a"] is None
    assert stacked_profile(df, ["x"], {"c": "Black"}, None).columns == ["x", "c"]


BINNED = [
    ("A", at("2023-01-02 05:00:00"), 1.0, None, 1.0),
    ("A", at("2023-01-03 00:00:00"), 2.0, None, 1.0),
    ("A", at("2023-01-09 01:00:00"), 3.0, None, 0.0),
    ("B", at("2023-01-03 23:00:00"), 7.0, 1.0, 2.0),
]


def test_resample_starts_at_the_first_day_and_fills_gaps(spark):
    rows = records(resample_days(spark.createDataFrame(BINNED, SCHEMA), 3), "country", "dateTime")
    assert [(r["country"], r["dateTime"], r["Wind"]) for r in rows] == [
        ("A", at("2023-01-02 00:00:00"), 3.0),
        ("A", at("2023-01-05 00:00:00"), 0.0),
        ("A", at("2023-01-08 00:00:00"), 3.0),
        ("B", at("2023-01-03 00:00:00"), 7.0),
    ]
    assert [r["Solar"] for r in rows] == [0.0, 0.0, 0.0, 1.0]


def test_resample_percent_without_demand_is_missing(spark):
    rows = records(resample_days_percent(spark.createDataFrame(BINNED, SCHEMA), 3), "country", "dateTime")
    assert [r["Wind"] for r in rows] == [150.0, None, None, 350.0]


@pytest.mark.parametrize("days", [1, 2, 7, 10])
def test_resampled_total_equals_hourly_total(spark, days):
    df = profile_rows(spark)
    binned = resample_days(df, days)
    assert binned.agg(F.sum("Wind")).first()[0] == df.agg(F.sum("Wind")).first()[0]
    assert binned.count() == -(-366 // days)
    with pytest.raises(ValueError):
        resample_days(df, 0)


def test_checks(spark):
    twice = spark.createDataFrame(THREE + THREE[:1], SCHEMA)
    assert [(r["country"], r["n"]) for r in duplicate_hours(twice).collect()] == [("A", 2)]
    with pytest.raises(ValueError, match="more than once"):
        require_unique_hours(twice)
    hours = spark.createDataFrame(THREE, SCHEMA)
    assert require_unique_hours(hours) is hours
    counts = {r["column"]: (r["type"], r["present"]) for r in column_counts(hours).collect()}
    assert counts["Solar"] == ("double", 3) and counts["dateTime"] == ("timestamp_ntz", 4)
    first = records(first_hours(hours, 2, ["Wind"]), "country", "dateTime")
    assert [(r["country"], r["Wind"]) for r in first] == [("A", 1.0), ("A", 3.0), ("B", 5.0)]
    assert "WindowGroupLimit" in plan_of(first_hours(hours, 2))


def test_totals_take_one_scan_and_no_job(spark, hours, tmp_path):
    hours.write.parquet(str(tmp_path / "hours"))
    stored = spark.read.parquet(str(tmp_path / "hours"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("totals", "")
    out = with_totals(stored, {"n": F.count("*")}, ["country"], "dateTime")
    assert not tracker.getJobIdsForGroup("totals")
    spark.sparkContext.setJobGroup("after", "")
    assert "BroadcastHashJoin" not in plan_of(out)
    counts = {r["country"]: r["n"] for r in stored.groupBy("country").agg(F.count("*").alias("n")).collect()}
    assert {(r["country"], r["n"]) for r in out.collect()} == set(counts.items())


def test_totals_of_hours_without_a_time(spark):
    rows = spark.createDataFrame([("A", None, 1.0), ("A", None, 2.0)], "country string, dateTime timestamp_ntz, v double")
    out = with_totals(rows, {"s": F.sum("v")}, ["country"], "dateTime")
    assert [r["s"] for r in out.collect()] == [3.0, 3.0]
