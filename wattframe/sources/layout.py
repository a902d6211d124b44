"""How stored tables are laid out: what is written next to the files so that later sessions know it."""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

#: Folders whose names begin with an underscore are no part of the table.
LAYOUT = "_layout"
MANIFEST = "_manifest"
NOTE = "buckets INT, keys ARRAY<STRING>, time STRING, columns STRING"


def table_name(path: str) -> str:
    """The name under which a session's catalog knows the table at ``path``."""
    return "wattframe_" + hashlib.sha256(path.rstrip("/").encode()).hexdigest()[:24]


def register(spark: SparkSession, path: str) -> str:
    """The name of the table at ``path``, forgotten by the catalog; its files stay."""
    name = table_name(path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    return name


def bucketed(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]] | None:
    """The table that ``store_by_day`` wrote, with the columns it is stored by; None where there is none."""
    found = records(spark, path, LAYOUT, NOTE)
    if not found:
        return None
    buckets, keys, time = found[0]["buckets"], found[0]["keys"], found[0]["time"]
    name = register(spark, path)
    listed = ", ".join(f"`{k}`" for k in keys)
    where = path.replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE {name} ({found[0]['columns']}) USING parquet CLUSTERED BY ({listed}) "
        f"SORTED BY ({listed}, `{time}`) INTO {buckets} BUCKETS LOCATION '{where}'"
    )
    return spark.table(name), keys


def records(spark: SparkSession, path: str, folder: str, schema: str) -> list:
    """The few rows of a note written next to a table; none where there is no such note."""
    try:
        return spark.read.schema(schema).json(f"{path}/{folder}").collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
