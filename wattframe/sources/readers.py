"""Typed readers. Filters and column choices made on their result reach the Parquet scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattframe.functions import missing, parse_hour
from wattframe.sources import schemas
from wattframe.sources.layout import bucketed


def _path(spark: SparkSession, path: str | None, setting: str) -> str:
    path = path or spark.conf.get(setting, None)
    if not path:
        raise ValueError(f"give a path or set {setting}")
    return path


def _parquet(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Read what is there; a path that does not exist gives no rows of the expected schema."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _clean(df: DataFrame, schema: str) -> DataFrame:
    """Cast the expected columns, add absent ones as missing, and turn NaN into null.

    Columns beyond the schema are kept: any further numeric column is one more technology.
    """
    wanted = {f.name: f.dataType for f in T.StructType.fromDDL(schema)}
    present = dict(df.dtypes)
    columns = []
    for name, kind in wanted.items():
        column = F.col(name) if name in present else F.lit(None)
        if present.get(name) != kind.simpleString():
            column = column.cast(kind)
        columns.append((missing(column) if isinstance(kind, T.DoubleType) else column).alias(name))
    for name, kind in present.items():
        if name not in wanted:
            column = missing(F.col(name)) if kind in ("double", "float") else F.col(name)
            columns.append(column.alias(name))
    return df.select(columns)


def read_hourly(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Hourly demand and generation; the path defaults to ``spark.wattframe.hourly``."""
    path = _path(spark, path, "spark.wattframe.hourly")
    return _clean(_parquet(spark, path, schemas.HOURLY), schemas.HOURLY)


def read_by_day(spark: SparkSession, path: str | None = None) -> tuple[DataFrame, list[str]]:
    """An hourly table written by ``store_by_day``, and the columns it is stored by, the day last.

    Given to ``with_totals``, ``circular_lag`` and what is built on them as ``stored``, these columns
    save the shuffle of the hours. A path that does not exist gives an empty table.
    """
    path = _path(spark, path, "spark.wattframe.hourly")
    found = bucketed(spark, path)
    if found is None:
        empty = _clean(_parquet(spark, path, schemas.HOURLY), schemas.HOURLY)
        return empty.withColumn("day", F.col("dateTime").cast("date")), ["country", "day"]
    return _clean(found[0], schemas.HOURLY), found[1]


def read_capacity(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Capacity per country and year; the path defaults to ``spark.wattframe.capacity``."""
    path = _path(spark, path, "spark.wattframe.capacity")
    return _clean(_parquet(spark, path, schemas.CAPACITY), schemas.CAPACITY)


def read_results(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Scenario results; the path defaults to ``spark.wattframe.results``.

    Shares become decimals. Tables written by this library hold them as such, and then equality
    filters on shares reach the scan.
    """
    path = _path(spark, path, "spark.wattframe.results")
    return _clean(_parquet(spark, path, schemas.RESULTS), schemas.RESULTS)


def read_runs(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Results of several runs as one table, by one scan.

    Columns go by their names; one that a run does not have is missing in its rows. Columns of the
    result schema get its types.
    """
    if not paths:
        raise ValueError("nothing to read")
    rows = spark.read.option("mergeSchema", "true").parquet(*paths)
    wanted = {f.name: f.dataType for f in T.StructType.fromDDL(schemas.RESULTS)}
    columns = []
    for name, kind in rows.dtypes:
        column = F.col(name)
        if name in wanted and kind != wanted[name].simpleString():
            column = column.cast(wanted[name])
        columns.append((missing(column) if kind in ("double", "float") else column).alias(name))
    return rows.select(columns)


def _comparison_text(spark: SparkSession, path: str | None, corrupt: bool) -> DataFrame | None:
    """The columns of the file as text, and the line where it does not fit them; None without a file."""
    path = _path(spark, path, "spark.wattframe.comparison")
    wanted = T.StructType.fromDDL(schemas.COMPARISON)
    try:
        rows = spark.read.option("header", True).csv(path)  # all text; columns go by their names
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    absent = [f.name for f in wanted if f.name not in rows.columns]
    if absent and rows.columns:
        raise ValueError(f"no such column: {', '.join(absent)}")
    if absent:
        return None
    if corrupt:
        schema = T.StructType([*rows.schema.fields, T.StructField("_line", T.StringType())])
        reader = spark.read.option("header", True).option("columnNameOfCorruptRecord", "_line")
        # All cells are looked at, whichever columns a query needs.
        rows = reader.option("columnPruning", False).csv(path, schema)
    return rows


def check_comparison(spark: SparkSession, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows) of a comparison CSV.

    A row is rejected if it has more or fewer cells than the header, or text where a number should be.
    Rejected rows keep their cells as text; ``bad`` lists the columns at fault, ``line`` standing for
    the number of cells. Together both have every row of the file.
    """
    wanted = T.StructType.fromDDL(schemas.COMPARISON)
    rows = _comparison_text(spark, path, corrupt=True)
    if rows is None:
        text = ", ".join(f"{f.name} STRING" for f in wanted)
        good = spark.createDataFrame([], schemas.COMPARISON)
        return good, spark.createDataFrame([], f"{text}, bad ARRAY<STRING>")
    faults = [F.when(F.col("_line").isNotNull(), F.lit("line"))]
    for f in wanted:
        if not isinstance(f.dataType, T.StringType):
            unread = F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull()
            faults.append(F.when(unread, F.lit(f.name)))
    marked = rows.withColumn("bad", F.array_compact(F.array(*faults)))
    good = marked.filter(F.size("bad") == 0)
    good = good.select(*(F.col(f.name).try_cast(f.dataType).alias(f.name) for f in wanted))
    rejected = marked.filter(F.size("bad") > 0).select(*(f.name for f in wanted), "bad")
    return good.withColumn("value", missing("value")), rejected


def bad_cells(rejected: DataFrame) -> DataFrame:
    """Number of bad cells per column of the rejected rows of ``check_comparison``."""
    return rejected.select(F.explode("bad").alias("column")).groupBy("column").agg(F.count("*").alias("n"))


def read_comparison(spark: SparkSession, path: str | None = None) -> DataFrame:
    """CSV with a header: results of several models; defaults to ``spark.wattframe.comparison``.

    Text where a number should be becomes missing; ``check_comparison`` tells such rows apart.
    """
    wanted = T.StructType.fromDDL(schemas.COMPARISON)
    rows = _comparison_text(spark, path, corrupt=False)
    if rows is None:
        return spark.createDataFrame([], schemas.COMPARISON)
    rows = rows.select(*(F.col(f.name).try_cast(f.dataType).alias(f.name) for f in wanted))
    return rows.withColumn("value", missing("value"))


def within(hourly: DataFrame, first: Column, last: Column) -> DataFrame:
    """Hours from ``first`` to ``last``, both included.

    Parquet row groups are not skipped by naive timestamps. A table stored in folders per year (see
    ``store_hourly``) has a column ``year``; a filter on it skips whole folders. One stored by
    ``store_by_hour`` has a column ``hourNumber``, one stored by ``store_by_day`` a column ``day``;
    filters on these skip row groups.
    """
    if "hourNumber" in hourly.columns:
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        hours = [F.timestamp_diff("HOUR", epoch, end) for end in (first, last)]
        hourly = hourly.filter(F.col("hourNumber").between(*hours)).drop("hourNumber")
    if "day" in hourly.columns:
        hourly = hourly.filter(F.col("day").between(first.cast("date"), last.cast("date")))
    if "year" in hourly.columns:
        hourly = hourly.filter(F.col("year").between(F.year(first), F.year(last))).drop("year")
    return hourly.filter(F.col("dateTime").between(first, last))


def country_period(hourly: DataFrame, country: str, start: str, end: str) -> DataFrame:
    """Hours of one country from ``start`` to ``end``, both included."""
    return within(hourly.filter(F.col("country") == country), parse_hour(start), parse_hour(end))


def country_list(capacity: DataFrame) -> DataFrame:
    """Countries in alphabetical order; only that column is read."""
    return capacity.select("country").distinct().orderBy("country")
