"""What the operators share: reading tables, shipping code, cutting lineage, joins that stand hot keys."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattframe.session import shared_dir

PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
#: Largest number of rows of a lookup table that is broadcast, and of hot groups that are.
BROADCAST_ROWS = 200_000
HOT_GROUPS = 1000
#: Groups of up to so many rows are never hot.
COLD_ROWS = 1000
#: With it, Spark deletes the shuffle files of a query when it ends, not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables written since ``settled`` began.
_made: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once per session, for functions that run there."""
    context = spark.sparkContext
    if getattr(context, "_wattframe_shipped", False):
        return
    handle, path = tempfile.mkstemp(prefix="wattframe-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(PACKAGE)))
    context.addPyFile(path)
    context._wattframe_shipped = True


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def without_shuffle_files(spark: SparkSession) -> Iterator[None]:
    """Writes made inside leave no shuffle files behind."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, from a table in the shared folder: later work neither repeats nor loses them."""
    path = new_folder(df.sparkSession, name)
    with without_shuffle_files(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    again = df.sparkSession.read.schema(df.schema).parquet(path)
    again._written_at = path
    if (made := _made.get()) is not None:
        made.append(again)
    return again


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The rows of the frame that ``make`` returns, as a written table; those written for it are deleted."""
    made: list[DataFrame] = []
    mark = _made.set(made)
    try:
        rows = make()
    finally:
        _made.reset(mark)
    rows = written(rows, name)
    discard(*made)
    return rows


def discard(*frames: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lookup(df: DataFrame, small: DataFrame, on: list[str], how: str, rows: int) -> DataFrame:
    """Join a lookup table of a counted size: broadcast up to the bound, shuffled beyond it."""
    return df.join(F.broadcast(small) if rows <= BROADCAST_ROWS else small, on, how)


def join_groups(
    rows: DataFrame, groups: DataFrame, key: list[str], size: str, total: int
) -> DataFrame:
    """Attach its group to every row that has one; each key stands once in ``groups``.

    Groups with more than ``total / HOT_GROUPS`` rows cannot be more than ``HOT_GROUPS`` in number, so
    they are broadcast, and their rows are not moved. The others are joined by a shuffle, in which no
    key is hot. Both frames should be cheap to read twice.
    """
    limit = max(COLD_ROWS, total // HOT_GROUPS)
    large = F.broadcast(groups.filter(F.col(size) > limit))
    small = groups.filter(F.col(size) <= limit)
    hot = rows.join(large, key, "inner")
    rest = rows.join(large.select(*key), key, "left_anti").join(small, key, "inner")
    return hot.unionByName(rest.select(hot.columns))


def join_written_groups(
    rows: DataFrame, groups: DataFrame, key: list[str], size: str, counted: DataFrame
) -> DataFrame:
    """As ``join_groups``, for written groups; the bound comes from the number of rows of ``counted``.

    Where no group can be hot this is one plain join: no broadcasts for the driver to build, ``rows`` are
    read once and ``counted`` is not counted.
    """
    if groups.filter(F.col(size) > COLD_ROWS).isEmpty():
        return rows.join(groups, key, "inner")
    return join_groups(rows, groups, key, size, counted.count())


def words_of(cell: Column) -> Column:
    """The 64-bit word of a filter that holds the bit of a cell."""
    return F.shiftright(cell, 6)


def bit_of(cell: Column) -> Column:
    return F.call_function(
        "shiftleft", F.lit(1).cast("long"), cell.bitwiseAND(F.lit(63)).cast("int")
    )


def repeated_filter(hashes: DataFrame, column: str, total: int) -> tuple[DataFrame, int, int]:
    """Bloom filter of the hashes that may occur more than once: ``(word, bits)``, cells, words.

    A hash sets the counter of one cell out of 32 or more per hash; cells hit at least twice become the
    bits of the filter. A hash that occurs twice always finds its bit set. One that occurs once finds it
    set if another shares its cell, for about one in 32. Counting combines inside each task first, so a
    hash that a third of the rows have is no burden.
    """
    cells = 1 << max(16, (32 * max(1, total) - 1).bit_length())
    hit = hashes.select(F.col(column).bitwiseAND(F.lit(cells - 1)).alias("cell"))
    twice = hit.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    words = twice.groupBy(words_of(F.col("cell")).alias("word")).agg(
        F.bit_or(bit_of(F.col("cell"))).alias("bits")
    )
    words = written(words, "bloom")
    return words, cells, words.count()


def may_repeat(df: DataFrame, column: str, bloom: tuple[DataFrame, int, int]) -> DataFrame:
    """Rows of ``df`` with a column ``may_repeat``: whether the filter has the bit of their hash."""
    words, cells, n = bloom
    cell = F.col(column).bitwiseAND(F.lit(cells - 1))
    marked = df.withColumn("word", words_of(cell))
    marked = lookup(marked, words, ["word"], "left", n)
    hit = F.coalesce(F.col("bits").bitwiseAND(bit_of(cell)) != 0, F.lit(False))
    return marked.withColumn("may_repeat", hit).drop("word", "bits")
