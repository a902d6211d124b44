"""Domain tables derived from a star schema of orders and an event stream.

They stand in for power data: summed quantities become hourly demand and generation. Values have
two decimals and are summed as whole hundredths, so the result does not depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattframe.functions import hour_start
from wattframe.plans.categories import MODELS, SCENARIOS

def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _hundredths(value: str) -> Column:
    return F.rint(F.col(value) * 100).cast("long")


def _amount(condition: Column | None = None) -> Column:
    part = F.col("hundredths") if condition is None else F.when(condition, F.col("hundredths"))
    return F.sum(part) / F.lit(100.0)


def hourly_events(spark: SparkSession, folder: str) -> DataFrame:
    """One month of hours for two places, one of which has two thirds of the rows.

    Each event type feeds one column.
    """
    kind = F.col("event_type")
    place = F.when(F.col("user_id") % 3 == 0, "SOUTH").otherwise("NORTH")
    return (
        _table(spark, folder, "events")
        .select(
            place.alias("country"),
            hour_start("ts").alias("dateTime"),
            "event_type",
            _hundredths("value").alias("hundredths"),
        )
        .groupBy("country", "dateTime")
        .agg(
            _amount(kind.isin("click", "error")).alias("demand"),
            _amount(kind == "view").alias("windOnshore"),
            _amount(kind == "purchase").alias("windOffshore"),
            _amount(kind == "signup").alias("solar"),
        )
    )


def shipment_readings(spark: SparkSession, folder: str) -> DataFrame:
    """Single readings before they are summed per hour; several share one (country, hour).

    No broadcast is forced: suppliers grow with the data, so the optimizer decides by their size.
    They meet the lines first, as a plain table whose size it knows.
    """
    lines = _table(spark, folder, "lineitem").select(
        "l_suppkey",
        "l_returnflag",
        "l_linestatus",
        _hundredths("l_quantity").alias("hundredths"),
        F.timestamp_add("HOUR", (F.col("l_orderkey") % 24).cast("int"), "l_shipdate").alias("dateTime"),
    )
    suppliers = _table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    nations = _table(spark, folder, "nation").select("n_nationkey", "n_regionkey")
    regions = _table(spark, folder, "region").select("r_regionkey", F.col("r_name").alias("country"))
    return (
        lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("country", "dateTime", "l_returnflag", "l_linestatus", "hundredths")
    )


def hourly_shipments(spark: SparkSession, folder: str) -> DataFrame:
    """Seven years of hours for five places, with hours and technologies missing here and there."""
    flag = F.col("l_returnflag")
    return (
        shipment_readings(spark, folder)
        .groupBy("country", "dateTime")
        .agg(
            _amount().alias("demand"),
            _amount(flag == "A").alias("windOnshore"),
            _amount((flag == "R") & (F.col("l_linestatus") == "O")).alias("windOffshore"),
            _amount(flag == "N").alias("solar"),
        )
    )


def capacity(spark: SparkSession, folder: str) -> DataFrame:
    """Highest hourly value per country, year and technology."""
    return (
        hourly_shipments(spark, folder)
        .groupBy("country", F.year("dateTime").alias("year"))
        .agg(*(F.max(c).alias(c) for c in ("windOnshore", "windOffshore", "solar")))
    )


def model_results(spark: SparkSession, folder: str) -> DataFrame:
    """Value per model, scenario, variable, technology and year, plus the technology ``total``."""
    lines = _table(spark, folder, "lineitem").select(
        "l_orderkey",
        F.concat(F.lit("M"), (F.col("l_suppkey") % 4).cast("string")).alias("model"),
        F.concat("l_returnflag", "l_linestatus").alias("technology"),
        F.year("l_shipdate").cast("string").alias("year"),
        _hundredths("l_quantity").alias("hundredths"),
    )
    orders = _table(spark, folder, "orders").select(
        "o_orderkey",
        F.col("o_orderpriority").alias("scenario"),
        F.col("o_orderstatus").alias("variable"),
    )
    return _with_totals(lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")))


def study_results(spark: SparkSession, folder: str, codes: Sequence[tuple[str, str]]) -> DataFrame:
    """The same shape for the year 2050, with the model, scenario and technology names of the study.

    ``codes`` lists pairs of variable and technology; lines are dealt out to them in turn.
    """

    def dealt(names: Sequence[str], key: str) -> Column:
        return F.get(F.array(*(F.lit(n) for n in names)), (F.col(key) % len(names)).cast("int"))

    pairs = F.array(
        *(F.struct(F.lit(v).alias("variable"), F.lit(t).alias("technology")) for v, t in codes)
    )
    pair = F.get(pairs, (F.col("l_partkey") % len(codes)).cast("int"))
    lines = _table(spark, folder, "lineitem").select(
        dealt(list(MODELS), "l_suppkey").alias("model"),
        dealt(SCENARIOS, "l_orderkey").alias("scenario"),
        pair.alias("pair"),
        F.lit("2050").alias("year"),
        _hundredths("l_quantity").alias("hundredths"),
    )
    return _with_totals(lines.select("*", "pair.variable", "pair.technology"))


def _with_totals(lines: DataFrame) -> DataFrame:
    keys = ["model", "scenario", "variable", "technology", "year"]
    single = lines.groupBy(keys).agg(F.sum("hundredths").alias("hundredths"))
    # The second step works on the few rows of the first and not on the lines again.
    both = single.withColumn("technology", F.explode(F.array(F.col("technology"), F.lit("total"))))
    return both.groupBy(keys).agg(_amount().alias("value"))
