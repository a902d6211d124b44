"""Sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattframe.functions import day_of, share_key
from wattframe.operators.joins import NO_DAY
from wattframe.sources.layout import LAYOUT, NOTE, register

SHARES = ("share_generation", "share_storage", "share_renewable")


def interleaved(ranks: Sequence[Column], bits: int) -> Column:
    """One number from several ranks, their bits taken in turn: near numbers are near in every rank."""
    code = F.lit(0).cast("long")
    for bit in range(bits):
        for place, rank in enumerate(ranks):
            at = F.shiftright(rank.cast("long"), bit).bitwiseAND(F.lit(1))
            code = code + at * F.lit(1 << (bit * len(ranks) + place))
    return code


def write_results(
    results: DataFrame,
    path: str,
    partition_by: Sequence[str] = (),
    sort: bool = True,
    mode: str = "overwrite",
    grid: Mapping[str, Sequence] | None = None,
    block_size: int | None = None,
    replace: str = "static",
) -> None:
    """Write scenario results as Parquet.

    Rows are sorted by share inside each task, without a shuffle, so that the row groups have
    narrow value ranges and share filters skip most of them. ``partition_by`` gives folders on top.
    Without ``sort`` writing is faster, and looking up single scenarios reads more.

    A plain sort helps a filter on its first share and hardly one on its last. With ``grid``, which
    lists the values of the shares, rows are sorted by the interleaved ranks of the shares, and a filter
    on any one of them skips row groups. ``block_size`` is the size of a row group in bytes.

    ``replace`` as ``dynamic`` lets mode ``overwrite`` replace only the folders that get new rows.
    """
    keys = [c for c in SHARES if c in results.columns and c not in partition_by]
    if partition_by:
        results = results.hint("rebalance", *partition_by)
    rows = results
    if sort and grid is not None:
        listed = sorted((c for c in keys if c in grid), key=lambda c: -len(grid[c]))
        bits = max(((len(grid[c]) - 1).bit_length() for c in listed), default=0)
        ranks = []
        for c in listed:
            rank = F.array_position(F.array(*(share_key(F.lit(str(v))) for v in grid[c])), F.col(c)) - 1
            # Short lists have their bits among the leading ones.
            ranks.append(F.shiftleft(rank, bits - (len(grid[c]) - 1).bit_length()))
        rows = rows.sortWithinPartitions(*partition_by, interleaved(ranks, bits))
    elif sort and keys:
        rows = rows.sortWithinPartitions(*partition_by, *keys)
    writer = rows.write.mode(mode).option("partitionOverwriteMode", replace)
    if block_size is not None:
        writer = writer.option("parquet.block.size", block_size)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def store_hourly(hourly: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write an hourly table in folders per country and year, so that scans skip the others.

    Adaptive execution evens out the files: small folders get one, a large one is split.
    """
    keyed = hourly.withColumn("year", F.year("dateTime"))
    evened = keyed.hint("rebalance", "country", "year")
    evened.write.mode(mode).partitionBy("country", "year").parquet(path)


def store_by_day(
    hourly: DataFrame,
    path: str,
    series: Sequence[str] = ("country",),
    time: str = "dateTime",
    buckets: int | None = None,
) -> None:
    """Write an hourly table in buckets by series and day, for totals and lags without a shuffle.

    The rows of a day are in one bucket, so no bucket holds a whole series. A column ``day`` is added
    (a day of its own for rows without a time). ``buckets`` defaults to the shuffle setting; take as
    many as give files that a task can work through. Buckets are sorted by series and day, so filters
    on them also skip row groups. The layout is written down next to the files, for ``read_by_day``.
    """
    spark = hourly.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*series, "day"]
    keyed = hourly.withColumn("day", F.coalesce(day_of(time), F.lit(NO_DAY).cast("date")))
    # Dealt out as the buckets are, so that each of them becomes one file.
    dealt = keyed.repartition(buckets, *keys)
    name = register(spark, path)
    (
        dealt.write.format("parquet")
        .mode("overwrite")
        .option("path", path)
        .bucketBy(buckets, *keys)
        .sortBy(*keys, time)
        .saveAsTable(name)
    )
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema)
    layout = spark.createDataFrame([(buckets, keys, time, columns)], NOTE)
    layout.coalesce(1).write.mode("overwrite").json(f"{path}/{LAYOUT}")


def store_by_hour(
    hourly: DataFrame, path: str, files: int | None = None, block_size: int | None = None, mode: str = "overwrite"
) -> None:
    """Write an hourly table without folders, for filters on place and time.

    Parquet keeps no usable range for times without a zone, so a column ``hourNumber``, the hours since
    1970, is added, and the rows are ordered by country and hour. Each row group then has a narrow range
    of hours, and a Bloom filter on the country rules out those whose range merely includes it.
    """
    number = F.timestamp_diff("HOUR", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("dateTime"))
    keyed = hourly.withColumn("hourNumber", number)
    keys = ["country", "hourNumber"]
    dealt = keyed.repartitionByRange(files, *keys) if files else keyed.repartitionByRange(*keys)
    writer = (
        dealt.sortWithinPartitions(*keys)
        .write.mode(mode)
        .option("parquet.bloom.filter.enabled#country", "true")
        .option("parquet.bloom.filter.expected.ndv#country", "10000")
    )
    if block_size is not None:
        writer = writer.option("parquet.block.size", block_size)
    writer.parquet(path)
