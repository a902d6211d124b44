"""Session settings, and the folder that all executors can reach."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

_own: tempfile.TemporaryDirectory | None = None

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def get_session(app: str = "wattframe", master: str | None = None, **settings: str) -> SparkSession:
    """Session with the settings the library expects; ``settings`` are added to them.

    Dots in setting names are written as double underscores, for example
    ``spark__sql__shuffle__partitions="8"``.
    """
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    for name, value in settings.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder for written tables, from ``spark.checkpoint.dir``.

    Only a local session may go without the setting, since driver and executors are one process there;
    it then gets one folder of its own, removed when the process ends.
    """
    global _own
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is None:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors can reach")
    if _own is None:
        _own = tempfile.TemporaryDirectory(prefix="wattframe-", ignore_cleanup_errors=True)
    return _own.name
