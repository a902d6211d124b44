"""Compression of vectors to codes by parts, with an equal-average search for the nearest entries.

The squared distance of two vectors is at least the squared gap of their component sums over the
dimension. Entries of a codebook are sorted by sum; the search starts at a part's own sum and goes
outward on both sides, and a side ends when the gap alone strictly exceeds the best distance found.
Codebooks are refined in rounds: each task adds up its rows per entry, and the sums of the tasks are
added by a shuffle of at most one row per task and entry.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe.llm.common import discard, join_groups, ship, written
from wattframe.llm.vectors import matrix, whole_vectors

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Entries that are compared together on one side.
STRIP = 8


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each point's nearest entry (ties to the lower one) and the squared distance."""
    n, width = points.shape
    sums = entries.sum(axis=1)
    order = np.argsort(sums, kind="stable")
    sums, ordered = sums[order], entries[order]
    own = points.sum(axis=1)
    place = np.searchsorted(sums, own)
    best = np.full(n, np.iinfo(np.int64).max)
    which = np.full(n, len(entries))
    sides = {1: np.arange(n), -1: np.arange(n)}
    start = {1: place, -1: place - 1}
    strip = np.arange(STRIP)
    step = 0
    while any(len(left) for left in sides.values()):
        for way, left in sides.items():
            first = start[way][left] + way * step
            inside = (first >= 0) & (first < len(entries))
            left, first = left[inside], first[inside]
            # The margin only lets a few more entries be compared; no nearest one is lost to rounding.
            gap = (sums[first] - own[left]).astype(float)
            go = gap * gap * (1 - 1e-12) <= best[left].astype(float) * width
            left, first = left[go], first[go]
            sides[way] = left
            if not len(left):
                continue
            at = np.clip(first[:, None] + way * strip, 0, len(entries) - 1)
            apart = ordered[at] - points[left][:, None, :]
            distance = np.einsum("ijk,ijk->ij", apart, apart)
            least = distance.min(axis=1)
            index = np.where(distance == least[:, None], order[at], len(entries)).min(axis=1)
            better = (least < best[left]) | ((least == best[left]) & (index < which[left]))
            best[left[better]], which[left[better]] = least[better], index[better]
        step += STRIP
    return which, best


def assigned(batch: pa.RecordBatch, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(parts of each row, index of the nearest entry per part, squared distance summed over parts)."""
    parts, _, width = books.shape
    points = matrix(batch.column("v"), parts * width).reshape(-1, parts, width)
    index = np.zeros((len(points), parts), np.int64)
    error = np.zeros(len(points), np.int64)
    for p in range(parts):
        index[:, p], distance = nearest(points[:, p], books[p])
        error += distance
    return points, index, error


def refined(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The next codebooks: floor of the mean of the parts at each entry; unused entries stay."""
    parts, entries, width = books.shape
    names = [f"s{i}" for i in range(width)]

    def work(batches):
        sums = np.zeros((parts, entries, width), np.int64)
        uses = np.zeros((parts, entries), np.int64)
        for batch in batches:
            points, index, _ = assigned(batch, books)
            for p in range(parts):
                np.add.at(sums[p], index[:, p], points[:, p])
                uses[p] += np.bincount(index[:, p], minlength=entries)
        part, entry = np.nonzero(uses)
        columns = [part, entry, uses[part, entry], *sums[part, entry].T]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ascontiguousarray(c)) for c in columns], names=["part", "entry", "n", *names]
        )

    schema = "part long, entry long, n long, " + ", ".join(f"{s} long" for s in names)
    sums = (
        rows.select("v")
        .mapInArrow(work, schema)
        .groupBy("part", "entry")
        .agg(F.sum("n").alias("n"), *(F.sum(s).alias(s) for s in names))
    )
    books = books.copy()
    for row in sums.collect():  # as many as there are entries
        books[row["part"], row["entry"]] = [row[s] // row["n"] for s in names]
    return books


def codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks [part, entry, component] of a table (vec_id, v), which is read once a round.

    They start from the rows with the smallest ids (missing ids last, equal ids by their vectors).
    """
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    width = max(1, -(-longest // parts))
    start = np.zeros((len(first), parts * width), np.int64)
    for i, row in enumerate(first):
        start[i, : len(row["v"])] = row["v"]
    books = np.ascontiguousarray(start.reshape(-1, parts, width).transpose(1, 0, 2))
    for _ in range(rounds if len(first) else 0):
        books = refined(rows, books)
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits per part) and error of every row of (vec_id, label, v)."""

    def work(batches):
        for batch in batches:
            _, index, error = assigned(batch, books)
            codes = ["".join(f"{i:02x}" for i in row) for row in index.tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(error)],
                names=["vec_id", "label", "code", "error"],
            )

    kinds = dict(rows.dtypes)
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"
    return rows.select("vec_id", "label", "v").mapInArrow(work, schema)


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, as decimals joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(
    vectors: DataFrame,
    scale: int = SCALE,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every row with a finite vector.

    Components are floor(scale * x). Vectors are cut into ``parts`` equal parts, each with a codebook
    of ``entries`` (at most 256) that ``rounds`` rounds refine. ``label_error`` is the error summed over
    the rows of the same label; rows without one count together. Rows whose vector is null or has a null
    or non-finite component are left out. Vectors shorter than the longest, or than a multiple of
    ``parts``, count as filled up with 0. Components beyond 2^24 (x beyond 16384) are set to that. Fewer
    rows than entries give smaller codebooks; no rows give none. Repeated rows are rows of their own.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = written(whole_vectors(vectors, scale), "vectors")
    books = codebooks(rows, parts, entries, rounds)
    if not books.size:
        return encode(rows, np.zeros((parts, 1, 1), np.int64)).selectExpr(
            "vec_id", "code", "error", "error AS label_error", f"'{digest(books)}' AS codebooks_sha256"
        )
    coded = encode(rows, books)
    # A missing label is a group as well, so the key has no nulls.
    known = F.coalesce(F.col("label"), F.lit(0).cast(dict(coded.dtypes)["label"]))
    coded = written(
        coded.select("*", F.isnull("label").alias("_none"), known.alias("_label")).drop("label"), "codes"
    )
    discard(rows)
    key = ["_none", "_label"]
    groups = coded.groupBy(key).agg(
        F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"), F.count("*").alias("_n")
    )
    groups = written(groups, "labels")
    total = groups.agg(F.sum("_n")).first()[0] or 0
    return join_groups(coded, groups, key, "_n", total).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")
    )


def _sql() -> str:
    """The whole of it as SQL: codebooks as long tables, one assignment and one mean per round."""
    width = f"(len(v) // {PARTS})"
    ctes = [
        f"""kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""parts AS MATERIALIZED (
  SELECT vec_id, label, p, v[1 + p * {width} : (p + 1) * {width}] AS v
  FROM kept, range({PARTS}) AS t(p))""",
        f"""book0 AS MATERIALIZED (
  SELECT p, CAST(row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS BIGINT) AS e, v FROM parts
  QUALIFY e < {ENTRIES})""",
    ]
    for r in range(ROUNDS + 1):
        ctes.append(
            f"""near{r} AS MATERIALIZED (
  SELECT vec_id, label, p, v, min(struct_pack(d := d, e := e)) AS best FROM (
    SELECT a.vec_id, a.label, a.p, a.v, b.e,
      CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS BIGINT) AS d
    FROM parts a JOIN book{r} b ON a.p = b.p)
  GROUP BY ALL)"""
        )
        if r < ROUNDS:
            ctes.append(
                f"""book{r + 1} AS MATERIALIZED (
  SELECT o.p, o.e, coalesce(m.v, o.v) AS v FROM book{r} o LEFT JOIN (
    SELECT p, e, list(m ORDER BY i) AS v FROM (
      SELECT p, best.e AS e, i,
        CAST((sum(v[i]) - ((sum(v[i]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m
      FROM near{r}, range(1, len(v) + 1) AS t(i) GROUP BY ALL)
    GROUP BY p, e) m ON m.p = o.p AND m.e = o.e)"""
            )
    ctes.append(
        f"""coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code,
    CAST(sum(best.d) AS BIGINT) AS error
  FROM near{ROUNDS} GROUP BY vec_id, label)"""
    )
    ctes.append(
        f"""digest AS (
  SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS h FROM book{ROUNDS})"""
    )
    return (
        "WITH "
        + ",\n".join(ctes)
        + """
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  h AS codebooks_sha256
FROM coded, digest"""
    )


SQL = _sql()
