"""Hard negatives: rows of another label that score nearly as high as a row of the anchor's own.

A multiway hyperplane tree (see ``gnat``), fitted to a bounded sample, deals all rows to its leaves; the
distance ranges it stores come from all rows, by one pass that combines inside each task. Leaves are cut
into blocks of bounded size, by row number, so that neither a crowded leaf nor equal rows make a large
one. Anchors go only to blocks whose leaf can hold rows within their window of scores. In a block a tree
of the same kind, over all its rows, rules out more; its leaves are compared in full, so the result is
exact, whatever the sample.

First each anchor's own leaf gives scores that its best rows of the same label must reach; with these the
other leaves are searched. The scores of these positives set the windows for the negatives.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wattframe.llm import gnat
from wattframe.llm.common import discard, ship, written
from wattframe.llm.vectors import matrix, whole_vectors

SCALE, EVERY, POSITIVES, NEGATIVES = 256, 100, 5, 5
#: A negative scores from LOW to HIGH hundredths of its positive.
LOW, HIGH = 80, 100
#: Rows that the split points are chosen from, split points of a node, and levels at most.
SAMPLE, FANOUT, DEPTH = 4096, 16, 2
#: Rows and anchors of a block, on average.
BLOCK, ANCHORS = 8192, 20_000
#: Scores beyond any that occur.
LEAST, MOST = -(1 << 61), 1 << 61

FOUND = "key long, anchor_id long, window int, positive_id long, positive_score long, id long, score long, row long"
QUERY = "key long, vec_id long, label long, v array<int>, low array<long>, high array<long>, positive_id array<long>, positive_score array<long>"


class Index:
    """Tree and blocks of a table (row, vec_id, label, v); rows of it are in ``blocks``."""

    def __init__(self, rows: DataFrame, sample: int, fanout: int, depth: int, block: int):
        stats = rows.agg(
            F.count("*").alias("n"),
            F.max(F.size("v")).alias("width"),
            F.max(F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x)).alias("size"),
        ).first()
        self.n, self.width, self.greatest = stats["n"], max(1, stats["width"] or 0), stats["size"] or 0
        levels = 0
        while levels < depth and block * fanout**levels < self.n:
            levels += 1
        # Any order that has nothing to do with the vectors makes a fair sample.
        chosen = rows.orderBy(F.xxhash64("vec_id", "row")).select("v").limit(sample).collect()
        points = np.zeros((len(chosen), self.width), np.int64)
        for i, row in enumerate(chosen):
            points[i, : len(row["v"])] = row["v"]
        self.root, self.leaves = gnat.build(points, self.greatest, fanout, levels)
        counts = self._learn(rows)
        self.blocks_of = np.maximum(1, -(-counts // block))
        self.first_of = np.concatenate([[0], np.cumsum(self.blocks_of)])
        self.blocks = written(self._dealt(rows), "blocks")

    def _learn(self, rows: DataFrame) -> np.ndarray:
        """Take the ranges of all rows into the tree; the number of rows of each leaf."""
        root, width, greatest, leaves = self.root, self.width, self.greatest, self.leaves

        def work(batches):
            counts = np.zeros(leaves, np.int64)
            for batch in batches:
                counts += np.bincount(
                    gnat.route(root, matrix(batch.column("v"), width), greatest, learn=True), minlength=leaves
                )
            node, point, child, least, most = [-1] * leaves, [0] * leaves, list(range(leaves)), counts.tolist(), [0.0] * leaves
            for number, one in enumerate(gnat.nodes(root)):
                for i, j in np.argwhere(one.least < np.inf).tolist():
                    node.append(number)
                    point.append(i)
                    child.append(j)
                    least.append(one.least[i, j])
                    most.append(one.most[i, j])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(node, pa.int32()),
                    pa.array(point, pa.int32()),
                    pa.array(child, pa.int32()),
                    pa.array(list(map(float, least)), pa.float64()),
                    pa.array(most, pa.float64()),
                ],
                names=["node", "point", "child", "least", "most"],
            )

        schema = "node int, point int, child int, least double, most double"
        parts = rows.select("v").mapInArrow(work, schema)
        ranges = parts.groupBy("node", "point", "child").agg(
            F.when(F.col("node") < 0, F.sum("least")).otherwise(F.min("least")).alias("least"),
            F.max("most").alias("most"),
        )
        counts, tree = np.zeros(leaves, np.int64), gnat.nodes(root)
        for row in ranges.collect():  # split points times children of each node
            if row["node"] < 0:
                counts[row["child"]] = round(row["least"])
            else:
                tree[row["node"]].least[row["point"], row["child"]] = row["least"]
                tree[row["node"]].most[row["point"], row["child"]] = row["most"]
        return counts

    def _dealt(self, rows: DataFrame) -> DataFrame:
        root, width, greatest = self.root, self.width, self.greatest
        names = ["row", "vec_id", "label", "v"]

        def work(batches):
            for batch in batches:
                leaf = gnat.route(root, matrix(batch.column("v"), width), greatest)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in names), pa.array(leaf)], names=[*names, "leaf"]
                )

        schema = "row long, vec_id long, label long, v array<int>, leaf long"
        dealt = rows.select(names).mapInArrow(work, schema)
        first = F.get(F.array(*map(F.lit, self.first_of.tolist())), F.col("leaf").cast("int"))
        blocks = F.get(F.array(*map(F.lit, self.blocks_of.tolist())), F.col("leaf").cast("int"))
        return dealt.withColumn("block", first + F.pmod(F.xxhash64("row"), blocks))

    def visits(self, queries: DataFrame, home: bool | None = None) -> DataFrame:
        """Queries (with ``leaf``) once per block to search: of their own leaf, of others, or of any."""
        root, width, greatest = self.root, self.width, self.greatest
        first_of, blocks_of = self.first_of, self.blocks_of
        names = [f.split()[0] for f in QUERY.split(", ")]

        def work(batches):
            for batch in batches:
                own = batch.column("leaf").to_numpy()
                if home:
                    places = [(leaf, np.flatnonzero(own == leaf)) for leaf in np.unique(own).tolist()]
                else:
                    low, high = (matrix(batch.column(c), _windows(batch)) for c in ("low", "high"))
                    places = gnat.reach(root, matrix(batch.column("v"), width), low, high, greatest)
                for leaf, here in places:
                    if home is False:
                        here = here[own[here] != leaf]
                    if not len(here):
                        continue
                    some = batch.select(names).take(pa.array(here))
                    for block in range(first_of[leaf], first_of[leaf] + blocks_of[leaf]):
                        yield some.append_column("block", pa.array(np.full(len(here), block, np.int64)))

        return queries.select(*names, "leaf").mapInArrow(work, QUERY + ", block long")

    def search(self, visits: DataFrame, count: int, same: bool, k: int) -> DataFrame:
        """The best ``k`` rows per query and window, of all blocks that the queries visit.

        ``count`` queries are dealt to groups of about ``ANCHORS``; a block meets one group at a time.
        """
        width, greatest = self.width, self.greatest
        groups = max(1, -(-count // ANCHORS))
        visits = visits.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(groups)))
        wanted = visits.select(F.col("block").alias("_block"), F.col("group").alias("_group")).distinct()
        rows = self.blocks.join(wanted, F.col("block") == F.col("_block")).select(
            "row", "vec_id", "label", "v", "block", F.col("_group").alias("group")
        )

        def work(queries: pa.Table, rows: pa.Table) -> pa.Table:
            return best_rows(queries, rows, width, greatest, same, k)

        on = ["block", "group"]
        found = visits.groupBy(on).cogroup(rows.groupBy(on)).applyInArrow(work, FOUND)
        return first_rows(found, k)


def _windows(batch: pa.RecordBatch | pa.Table) -> int:
    column = batch.column("low")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return int(np.diff(column.offsets.to_numpy()).max(initial=1))


def best_rows(
    queries: pa.Table, rows: pa.Table, width: int, greatest: int, same: bool, k: int
) -> pa.Table:
    """Queries of a block against its rows, as a table of finds."""
    names = [f.split()[0] for f in FOUND.split(", ")]
    if not len(queries) or not len(rows):
        return pa.table({n: pa.array([], pa.int32() if n == "window" else pa.int64()) for n in names})
    rows = rows.sort_by([("vec_id", "ascending"), ("row", "ascending")])

    def block(table: pa.Table, key: str) -> gnat.Rows:
        return gnat.Rows(
            table.column(key).to_numpy(),
            table.column("vec_id").to_numpy(),
            table.column("label").to_numpy(),
            matrix(table.column("v"), width),
        )

    asked = block(queries, "key")
    low, high, positive, reached = (
        matrix(queries.column(c), _windows(queries)) for c in ("low", "high", "positive_id", "positive_score")
    )
    # Queries with fewer windows than others have empty ones at the end.
    there = np.arange(low.shape[1]) < np.diff(queries.column("low").combine_chunks().offsets.to_numpy())[:, None]
    low = np.where(there, low, MOST)
    score, ids, keys = gnat.BlockTree(block(rows, "row"), greatest).search(asked, low, high, same, k)
    q, w, i = np.nonzero(score > gnat.NONE)
    return pa.table(
        [
            pa.array(asked.key[q]),
            pa.array(asked.id[q]),
            pa.array(w.astype(np.int32)),
            pa.array(positive[q, w]),
            pa.array(reached[q, w]),
            pa.array(ids[q, w, i]),
            pa.array(score[q, w, i]),
            pa.array(keys[q, w, i]),
        ],
        names=names,
    )


def first_rows(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` finds per query and window, with ``rank`` from 1; at most k per task are sent."""
    order = W.partitionBy("key", "window").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame,
    anchors: DataFrame,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    sample: int = SAMPLE,
    fanout: int = FANOUT,
    depth: int = DEPTH,
    block: int = BLOCK,
) -> DataFrame:
    """Per anchor and positive, the first ``negatives`` rows of other labels with nearly its score.

    ``rows`` has row (a unique number), vec_id, label and v (whole numbers); ``anchors`` is a part of
    it. Positives are the anchor's first ``positives`` other rows of its label, by inner product, ties by
    smaller id. A negative's score is from ``low`` to ``high`` hundredths of the positive's. Returns
    anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    spark = rows.sparkSession
    ship(spark)
    index = Index(rows, sample, fanout, depth, block)
    chosen = anchors.select(F.col("row").alias("key"))
    none, all_scores = F.array(F.lit(0).cast("long")), (F.lit(LEAST), F.lit(MOST))
    queries = index.blocks.join(chosen, F.col("row") == F.col("key"), "left_semi").select(
        F.col("row").alias("key"), "vec_id", "label", "v", "leaf",
        F.array(all_scores[0]).alias("low"), F.array(all_scores[1]).alias("high"),
        none.alias("positive_id"), none.alias("positive_score"),
    )
    queries = written(queries, "anchors")
    count = queries.count()

    near = written(index.search(index.visits(queries, home=True), count, True, positives), "near")
    least = near.groupBy("key").agg(
        F.when(F.count("*") == positives, F.min("score")).alias("_least")
    )
    bounded = queries.join(least, "key", "left").withColumn(
        "low", F.array(F.coalesce("_least", all_scores[0]))
    )
    far = index.search(index.visits(bounded, home=False), count, True, positives)
    best = first_rows(near.drop("rank").unionByName(far.drop("rank")), positives)
    best = written(best.select("key", "id", "score", "rank"), "positives")

    # Whole scores within the window: low * positive <= 100 * score <= high * positive.
    score = F.col("score")
    windows = best.groupBy("key").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "rank",
                    F.expr(f"({low} * score + pmod(-{low} * score, 100)) div 100").alias("low"),
                    F.expr(f"({high} * score - pmod({high} * score, 100)) div 100").alias("high"),
                    F.col("id").alias("id"),
                    score.alias("score"),
                )
            )
        ).alias("_w")
    )
    asked = queries.drop("low", "high", "positive_id", "positive_score").join(windows, "key").select(
        "key", "vec_id", "label", "v", "leaf",
        F.col("_w.low").alias("low"), F.col("_w.high").alias("high"),
        F.col("_w.id").alias("positive_id"), F.col("_w.score").alias("positive_score"),
    )
    asked = written(asked, "windows")
    out = index.search(index.visits(asked), count, False, negatives)
    out = written(
        out.select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score"),
        ),
        "negatives",
    )
    discard(index.blocks, queries, near, best, asked)
    return out


def mine(
    vectors: DataFrame, scale: int = SCALE, every: int = EVERY, changed: int = 7, labels: int = 10
) -> DataFrame:
    """Hard negatives of a table (vec_id, embedding, label); anchors are the ids divisible by ``every``.

    Components are floor(scale * x). Where vec_id is divisible by ``changed``, the label is first
    (label + 1) % ``labels``. Rows with a null label, vector or id, or with a null or non-finite
    component, take no part. Shorter vectors count as filled up with 0; components beyond 2^24 are set
    to that. Rows that repeat an id are rows of their own, as anchors and as partners, equal ones too;
    other columns are not looked at. Without anchors, or without rows, there is no result.
    """
    kept = whole_vectors(vectors, scale).filter("vec_id IS NOT NULL AND label IS NOT NULL")
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % changed == 0, (label + 1) % labels).otherwise(label)
    rows = kept.select(
        # The number is settled by the table it is written to.
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"), label.alias("label"), "v"
    )
    ship(vectors.sparkSession)
    rows = written(rows, "vectors")
    return hard_negatives(rows, rows.filter(F.col("vec_id") % every == 0))


SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
    CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM kept a JOIN kept b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0),
positives AS (
  SELECT * FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES})
SELECT p.anchor_id, p.id AS positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank,
  n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same
  AND {LOW} * p.score <= 100 * n.score AND 100 * n.score <= {HIGH} * p.score
QUALIFY rank <= {NEGATIVES}
"""
