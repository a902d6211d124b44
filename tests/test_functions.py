from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.conftest import at, records
from wattframe.functions import (
    SEASONS,
    capitalise_columns,
    clamp_at_zero,
    decimal_range,
    half_even,
    hour_start,
    missing,
    parse_hour,
    percent,
    row_sum,
    season,
    share_key,
    total,
)


def values(df, column="y"):
    return [row[column] for row in df.collect()]


def test_half_even(spark):
    df = spark.createDataFrame([(0.25,), (0.35,), (0.05,), (None,)], "x DOUBLE").coalesce(1)
    assert values(df.select(half_even("x", 1).alias("y"))) == [0.2, 0.4, 0.0, None]
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "x DOUBLE").coalesce(1)
    assert values(df.select(half_even("x").alias("y"))) == [0.0, 2.0, 2.0]


def test_missing_values(spark):
    df = spark.createDataFrame([(float("nan"), 1.0), (2.0, None)], "a DOUBLE, b DOUBLE").coalesce(1)
    assert values(df.select(missing("a").alias("y"))) == [None, 2.0]
    assert values(df.select(row_sum([missing("a"), "b"]).alias("y"))) == [1.0, 2.0]
    assert values(df.filter("b IS NULL").select(total("b").alias("y"))) == [0.0]
    assert values(df.select(clamp_at_zero(F.col("b") - 3).alias("y"))) == [0.0, None]


def test_percent_of_zero_is_missing(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (1.0, 4.0)], "a DOUBLE, b DOUBLE").coalesce(1)
    assert values(df.select(percent("a", "b").alias("y"))) == [None, None, 25.0]


def test_decimal_range():
    assert decimal_range("1", "1.25", "0.05") == [Decimal(s) for s in ("1", "1.05", "1.10", "1.15", "1.20")]
    assert len(decimal_range("0", "1.1", "0.1")) == 11
    assert len(decimal_range("0", "0.00011", "0.00001")) == 11
    assert decimal_range(0, 0, 1) == []
    with pytest.raises(ValueError):
        decimal_range(0, 1, 0)


def test_share_key_absorbs_float_noise(spark):
    df = spark.createDataFrame([(0.1 + 0.2,), (0.3,)], "x DOUBLE")
    assert df.select(share_key("x").alias("y")).distinct().count() == 1


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2017/12/31 23", datetime(2017, 12, 31, 23)),
        ("2017/06/01 00:00", datetime(2017, 6, 1)),
        ("2017-06-01 05:30:10", datetime(2017, 6, 1, 5, 30, 10)),
        ("2017-06-01", datetime(2017, 6, 1)),
    ],
)
def test_parse_hour(spark, text, expected):
    assert spark.range(1).select(parse_hour(text)).first()[0] == expected


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_hour_start_ignores_the_session_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        # 02:30 does not exist in New York on that day.
        df = spark.createDataFrame([(at("2024-03-10 02:30:59"),)], "t TIMESTAMP_NTZ")
        assert df.select(hour_start("t")).first()[0] == at("2024-03-10 02:00:00")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_every_month_has_a_season(spark):
    rows = records(spark.range(1, 13).select("id", season(F.col("id")).alias("s")))
    assert {r["id"]: r["s"] for r in rows} == {m: n for n, ms in SEASONS.items() for m in ms}


def test_capitalise_columns(spark):
    df = spark.createDataFrame([("x", 1, 2)], "country STRING, windOnshore INT, solar INT")
    assert capitalise_columns(df, ["country"]).columns == ["country", "WindOnshore", "Solar"]
