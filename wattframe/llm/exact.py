"""Exact deduplication: a Bloom filter picks the hashes that may repeat, and only their rows move.

The first pass hashes each text in place and builds a filter of hashes that may occur twice (see
``repeated_filter``). The second tests every row against it. Rows that fail are alone and pass straight
through; the others are grouped by their full SHA-256, sums first, and get their group attached by a
join in which no key is hot. Texts themselves are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattframe.llm.common import join_groups, may_repeat, repeated_filter, written

#: Runs of white space other than a single space.
RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Each run of ``[\\x20\\x09-\\x0D]+`` becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), RUNS, " ")


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    - Null and empty texts are equal to each other; text of any length is read whole.
    - Of equal texts the smallest doc_id stays, null ids last; if rows repeat an id with the same text,
      one of them stays. An empty table gives an empty result; other columns are ignored.
    """
    sha = F.unhex(F.sha2(normalised(F.col("text")), 256))
    prints = docs.select("doc_id", sha.alias("sha"), F.monotonically_increasing_id().alias("row"))
    prints = written(prints, "prints").withColumn("hash", F.xxhash64("sha"))
    total = prints.count()
    marked = may_repeat(prints, "hash", repeated_filter(prints, "hash", total))
    alone = marked.filter(~F.col("may_repeat")).select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
    rows = marked.filter("may_repeat").select("doc_id", "sha", "row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
    groups = rows.groupBy("sha").agg(first, F.count(F.lit(1)).alias("group_size"))
    groups = written(groups, "groups")
    together = join_groups(rows, groups, ["sha"], "group_size", total).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
    return alone.unionByName(together)


SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
