import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import at, plan_of, records
from wattframe.functions import capitalise_columns
from wattframe.operators.capacity import generation_year
from wattframe.operators.results import hourly_results
from wattframe.sources import (
    country_list,
    country_period,
    read_capacity,
    read_comparison,
    read_hourly,
    read_results,
    store_hourly,
    write_results,
)

HOURS = [
    ("DE", at("2017-12-31 22:00:00"), 1.0, 2.0, None, 4.0),
    ("DE", at("2017-12-31 23:00:00"), 2.0, float("nan"), None, 4.0),
    ("DE", at("2018-01-01 00:00:00"), 3.0, 2.0, None, 4.0),
    ("FR", at("2017-12-31 23:00:00"), 4.0, 2.0, None, 4.0),
]
SCHEMA = (
    "country STRING, dateTime TIMESTAMP_NTZ, demand DOUBLE, windOnshore DOUBLE, "
    "windOffshore DOUBLE, solar DOUBLE"
)


@pytest.fixture
def hourly_file(spark, tmp_path):
    path = str(tmp_path / "hourly")
    spark.createDataFrame(HOURS, SCHEMA).write.parquet(path)
    return path


def test_country_period_is_closed_and_pushed_down(spark, hourly_file):
    chosen = country_period(read_hourly(spark, hourly_file), "DE", "2017/12/31 22:00", "2017/12/31 23")
    rows = records(chosen, "dateTime")
    assert [r["demand"] for r in rows] == [1.0, 2.0]
    assert rows[1]["windOnshore"] is None
    plan = plan_of(chosen)
    assert "EqualTo(country,DE)" in plan
    assert "GreaterThanOrEqual(dateTime," in plan and "LessThanOrEqual(dateTime," in plan


def test_calendar_year_is_pushed_down(spark, hourly_file):
    chosen = generation_year(read_hourly(spark, hourly_file), "DE", 2017)
    assert [r["Demand"] for r in records(chosen, "dateTime")] == [1.0, 2.0]
    assert chosen.columns[:4] == ["country", "year", "dateTime", "Demand"]
    assert "EqualTo(country,DE)" in plan_of(chosen) and "LessThanOrEqual(dateTime," in plan_of(chosen)


def test_calendar_year_drops_what_follows_the_last_hour(spark):
    rows = [("DE", at("2017-12-31 23:00:00"), 1.0), ("DE", at("2017-12-31 23:30:00"), 2.0)]
    df = spark.createDataFrame(rows, "country STRING, dateTime TIMESTAMP_NTZ, demand DOUBLE")
    df = df.withColumns({c: F.lit(None).cast("double") for c in ("windOnshore", "windOffshore", "solar")})
    assert [r["Demand"] for r in records(generation_year(df))] == [1.0]
    assert [r["Demand"] for r in records(generation_year(df, "DE", 2017))] == [1.0]


def test_only_needed_columns_are_read(spark, tmp_path):
    path = str(tmp_path / "capacity")
    rows = [("FR", 2017, 1.0, 2.0, 3.0), ("DE", 2017, 1.0, 2.0, 3.0), ("DE", 2018, 1.0, 2.0, 3.0)]
    schema = "country STRING, year INT, windOnshore DOUBLE, windOffshore DOUBLE, solar DOUBLE"
    spark.createDataFrame(rows, schema).write.parquet(path)
    names = country_list(read_capacity(spark, path))
    assert [r["country"] for r in names.collect()] == ["DE", "FR"]
    assert "ReadSchema: struct<country:string>" in plan_of(names)


def test_further_technologies_are_kept_and_absent_ones_added(spark, tmp_path):
    path = str(tmp_path / "h")
    df = spark.createDataFrame(
        [("DE", at("2017-01-01 00:00:00"), 1, float("nan"))],
        "country STRING, dateTime TIMESTAMP_NTZ, demand INT, hydro DOUBLE",
    )
    df.write.parquet(path)
    row = read_hourly(spark, path).first().asDict()
    assert row["demand"] == 1.0 and row["hydro"] is None and row["solar"] is None
    assert "Hydro" in capitalise_columns(read_hourly(spark, path)).columns


def test_absent_path_gives_typed_empty_table(spark, tmp_path):
    empty = read_results(spark, str(tmp_path / "nothing"))
    assert empty.isEmpty() and dict(empty.dtypes)["share_storage"] == "decimal(12,8)"


def test_path_from_session_setting(spark, hourly_file):
    with pytest.raises(ValueError, match="spark.wattframe.hourly"):
        read_hourly(spark)
    spark.conf.set("spark.wattframe.hourly", hourly_file)
    try:
        assert read_hourly(spark).count() == 4
    finally:
        spark.conf.unset("spark.wattframe.hourly")


def results_frame(spark):
    amounts = "nuclear renewable netStorage demand energyNotServed storageLevel".split()
    amounts += ["curtailNuclear", "curtailRenewable"]
    rows = spark.range(40).select(
        *(F.col("id").cast("double").alias(a) for a in amounts),
        (F.lit(1.0) + F.col("id") % 2 * 0.1).alias("share_generation"),
        (F.col("id") % 5 * 0.1).alias("share_renewable"),
        F.lit(0.00003).alias("share_storage"),
        F.lit(1.0).alias("costCurtailNuclear"),
        F.lit(0.0).alias("costCurtailRenewable"),
        F.lit(at("2017-01-01 00:00:00")).cast("timestamp_ntz").alias("date"),
    )
    return rows


def test_results_with_float_shares_are_found_by_decimal_keys(spark, tmp_path):
    path = str(tmp_path / "floats")
    results_frame(spark).write.parquet(path)
    found = hourly_results(read_results(spark, path), 1.1, 0.00003, 0.3)
    assert sorted(r["nuclear"] for r in found.collect()) == [3.0, 13.0, 23.0, 33.0]


def test_share_filters_reach_the_scan_of_written_results(spark, tmp_path):
    path, folders = str(tmp_path / "plain"), str(tmp_path / "folders")
    typed = results_frame(spark)
    for c in ("share_generation", "share_renewable", "share_storage"):
        typed = typed.withColumn(c, F.col(c).cast("decimal(12,8)"))
    write_results(typed, path)
    plan = plan_of(hourly_results(read_results(spark, path), "1.1", "0.00003", "0.3"))
    assert "EqualTo(share_renewable,0.30000000)" in plan and "EqualTo(share_generation,1.10000000)" in plan
    write_results(typed, folders, partition_by=["share_generation"])
    found = hourly_results(read_results(spark, folders), "1.1", "0.00003", "0.3")
    assert found.count() == 4


def test_comparison_csv(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text("model,scenario,variable,technology,year,value\nm,s,v,total,2050,1.5\nm,s,v,a,2050,\n")
    rows = records(read_comparison(spark, str(path)), "technology")
    assert [(r["technology"], r["year"], r["value"]) for r in rows] == [("a", "2050", None), ("total", "2050", 1.5)]


def test_stored_hours_are_pruned_by_folder(spark, hourly_file, tmp_path):
    path = str(tmp_path / "stored")
    store_hourly(read_hourly(spark, hourly_file), path)
    stored = read_hourly(spark, path)
    period = country_period(stored, "DE", "2017/12/31 23:00", "2017/12/31 23")
    year = generation_year(stored, "DE", 2018)
    assert [r["demand"] for r in period.collect()] == [2.0]
    assert [r["Demand"] for r in year.collect()] == [3.0]
    assert sorted(r["Demand"] for r in generation_year(stored).collect()) == [1.0, 2.0, 3.0, 4.0]
    for chosen, bound in ((period, "2017"), (year, "2018")):
        filters = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", plan_of(chosen)).group(1)
        assert "year#" in filters and f">= {bound}" in filters and "= DE" in filters
        assert "year" not in period.columns


def test_comparison_goes_by_column_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("value,year,technology,variable,scenario,model\n1.5,2030,wind,F,high,M1\n,2030,solar,F,high,M1\n")
    rows = read_comparison(spark, str(tmp_path / "a.csv")).collect()
    first = rows[0].asDict()
    assert (first["model"], first["scenario"], first["value"]) == ("M1", "high", 1.5) and rows[1]["value"] is None
    assert read_comparison(spark, str(tmp_path / "none.csv")).isEmpty()
    (tmp_path / "b.csv").write_text("value,year\n1,2030\n")
    with pytest.raises(ValueError, match="no such column"):
        read_comparison(spark, str(tmp_path / "b.csv"))
