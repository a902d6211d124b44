"""Connected components of a table of links, in rounds over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe.llm.common import discard, written


def components(links: DataFrame) -> DataFrame:
    """``(id, label)`` for every end of a link (a, b): the smallest id that can be reached.

    Each round hands labels along links and then from a label's own label, so the number of rounds
    grows with the logarithm of the longest path. Rounds end when no label changes.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.distinct(), "links")
    start = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("least"))
    labels = written(start.select("id", F.least("id", "least").alias("label")), "labels")
    while True:
        sent = both.join(labels.withColumnRenamed("id", "a"), "a")
        sent = sent.groupBy(F.col("b").alias("id")).agg(F.min("label").alias("sent"))
        moved = labels.join(sent, "id", "left").select(
            "id", F.col("label").alias("old"), F.least("label", "sent").alias("label")
        )
        up = labels.select(F.col("id").alias("label"), F.col("label").alias("up"))
        moved = moved.join(up, "label", "left").select(
            "id", "old", F.least("label", "up").alias("label")
        )
        moved = written(moved, "labels")
        changed = moved.filter("label != old").limit(1).count()
        discard(labels)
        labels = moved.select("id", "label")
        labels._written_at = moved._written_at
        if not changed:
            discard(both)
            return labels
