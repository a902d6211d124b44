"""Substring deduplication by level-wise doubling.

Windows of a base length come first. In each stretch of a document that could hold a full window, the
short window with the smallest hash stands for it; equal full windows have equal ones at the same place.
Short windows that only one document has are alone, and so are all full windows they stand for. The others
are extended to twice the length, where again one stands for each full window that is left, and so on until
the full length is reached or no candidates survive. There two hashes, 96 bits, tell windows apart.

A window that starts in several documents belongs to the smallest doc_id; in the others, its words go.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe.llm.common import discard, join_groups, ship, written
from wattframe.llm.hashing import U, mix, window_hashes, word_hashes

WINDOW = 50
#: Words of the shortest windows. Shorter ones take a scan more for each doubling.
BASE = 25
#: Rows that repeat an id are told apart by their texts.
OWNER = ["doc_id", "text_hash"]
#: Makes other hashes of the same words.
OTHER = 0x5851F42D4C957F2D


def leaders(hashes: np.ndarray, span: int) -> np.ndarray:
    """For every ``span`` consecutive hashes, the place of the smallest, the first of equals."""
    n = len(hashes) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    # The smallest of a span from blocks: suffix minima of one block meet prefix minima of the next.
    pad = -len(hashes) % span
    padded = np.concatenate([hashes, np.full(pad, np.iinfo(np.uint64).max, np.uint64)])
    blocks, at = padded.reshape(-1, span), np.arange(len(padded)).reshape(-1, span)
    least = np.minimum.accumulate(blocks, axis=1)
    new = np.ones(blocks.shape, bool)
    new[:, 1:] = blocks[:, 1:] < least[:, :-1]
    before = np.maximum.accumulate(np.where(new, at, 0), axis=1).ravel()[span - 1 : span - 1 + n]
    back = blocks[:, ::-1]
    least = np.minimum.accumulate(back, axis=1)
    new[:, 1:] = back[:, 1:] <= least[:, :-1]
    after = np.where(new, at[:, ::-1], len(padded))
    after = np.minimum.accumulate(after, axis=1)[:, ::-1].ravel()[:n]
    return np.where(hashes[after] <= hashes[before], after, before)


def minima(hashes: np.ndarray, span: int) -> np.ndarray:
    return np.unique(leaders(hashes, span))


def _rows(kind, *columns):
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=kind)


def lengths(base: int, window: int) -> list[int]:
    """Lengths of the levels: each twice the one before, the last cut to the window."""
    levels = [min(base, window)]
    while levels[-1] < window:
        levels.append(min(2 * levels[-1], window))
    return levels


def anchors(docs: DataFrame, base: int, window: int) -> DataFrame:
    """(hash, doc_id, text_hash, at): the windows of the base length that stand for each document's full ones."""
    kind = pa.schema([("hash", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("at", pa.int32())])

    def find(batches):
        for batch in batches:
            parts, n = [], 0
            for row in zip(*(batch.column(c) for c in ("doc_id", "text_hash", "text"))):
                doc_id, text_hash, text = (cell.as_py() for cell in row)
                words = word_hashes((text or "").encode())
                if len(words) < window:
                    continue
                short = window_hashes(words, base)
                at = minima(short, window - base + 1)
                owner = (np.full(len(at), x, np.int64) for x in (doc_id, text_hash))
                parts.append((short[at].view(np.int64), *owner, at.astype(np.int32)))
                n += len(at)
                if n > 200_000:
                    yield _rows(kind, *map(np.concatenate, zip(*parts)))
                    parts, n = [], 0
            if n:
                yield _rows(kind, *map(np.concatenate, zip(*parts)))

    return docs.mapInArrow(find, "hash long, doc_id long, text_hash long, at int")


def shared(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key..., least, n) of the keys that several documents have; least is the smallest doc_id."""
    groups = rows.groupBy(*key).agg(
        F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("n")
    )
    return written(groups.filter("least != most").select(*key, "least", "n"), "shared")


def alive(words: np.ndarray, length: int, window: int, places: np.ndarray) -> np.ndarray:
    """Which full windows have their short window, of this length, among those at ``places``."""
    short = window_hashes(words, length)
    survived = np.zeros(len(short), bool)
    survived[places[places < len(short)]] = True
    return survived[leaders(short, window - length + 1)]


def doubled(docs: DataFrame, found: DataFrame, length: int, longer: int, window: int) -> DataFrame:
    """(hash, doc_id, text_hash, at) of the next length's windows that stand for the full ones still alive.

    ``found`` has the places of the windows that survived. Full windows also have a second hash, ``more``.
    """
    full = longer == window
    names = "hash long, doc_id long, text_hash long, at int" + ", more int" * full
    fields = [("hash", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("at", pa.int32())]
    kind = pa.schema(fields + [("more", pa.int32())] * full)

    def extend(batches):
        for batch in batches:
            for row in zip(*(batch.column(c) for c in (*OWNER, "text", "places"))):
                doc_id, text_hash, text = (cell.as_py() for cell in row[:3])
                words = word_hashes((text or "").encode())
                if len(words) < window:
                    continue
                left = alive(words, length, window, row[3].values.to_numpy())
                hashes = window_hashes(words, longer)
                at = np.flatnonzero(left) if full else np.unique(leaders(hashes, window - longer + 1)[left])
                if not len(at):
                    continue
                owner = (np.full(len(at), x, np.int64) for x in (doc_id, text_hash))
                columns = [hashes[at].view(np.int64), *owner, at.astype(np.int32)]
                if full:
                    other = window_hashes(mix(words + U(OTHER)), window)[at]
                    columns.append((other >> U(32)).astype(np.uint32).view(np.int32))
                yield _rows(kind, *columns)

    places = found.groupBy(*OWNER).agg(F.collect_list("at").alias("places"))
    rows = docs.join(places.hint("merge"), OWNER).select(*OWNER, "text", "places")
    return rows.mapInArrow(extend, names)


def repeated_windows(docs: DataFrame, window: int = WINDOW, base: int = BASE) -> DataFrame:
    """(doc_id, text_hash, at): windows whose words also start in a document with a smaller doc_id.

    ``docs`` has the columns doc_id, not null, text_hash, and text.
    """
    levels = lengths(base, window)
    if len(levels) == 1:
        levels = [window, window]
    rows, key = written(anchors(docs, levels[0], window), "anchors"), ["hash"]
    for length, longer in zip(levels, levels[1:]):
        groups = shared(rows, key)
        found = join_groups(rows, groups, key, "n", rows.count()).select(*OWNER, "at")
        longer_rows = written(doubled(docs, found, length, longer, window), "windows")
        discard(rows, groups)
        rows = longer_rows
        if rows.isEmpty():
            break
    key = ["hash", "more"]
    if "more" not in rows.columns:  # nothing survived
        return rows.select(*OWNER, "at")
    met = join_groups(rows, shared(rows, key), key, "n", rows.count())
    return met.filter("doc_id != least").select(*OWNER, "at")


def remove_repeats(docs: DataFrame, window: int = WINDOW, base: int = BASE) -> DataFrame:
    """doc_id, n_words, n_removed, text (the words kept, joined by one space) of every document.

    Words are ``[^\\x20\\x09-\\x0D]+``, taken as they are. Null and empty texts have none. If rows repeat a
    doc_id, their texts are taken for one document each with the same id, and never repeat one another.
    Rows without an id take no part: nothing of them is removed. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    known = docs.filter("doc_id IS NOT NULL")
    cut = repeated_windows(known, window, base).groupBy(*OWNER).agg(F.collect_set("at").alias("places"))
    names = "doc_id long, n_words long, n_removed long, text string"
    kind = pa.schema(
        [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())]
    )

    def keep(batches):
        for batch in batches:
            rows = []
            cells = zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("places"))
            for doc_id, text, places in cells:
                words = (text.as_py() or "").encode().split()
                n = len(words)
                if places.is_valid:
                    edge = np.zeros(n + window + 1, np.int32)
                    at = places.values.to_numpy()
                    at = at[at + window <= n]
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    gone = np.cumsum(edge)[:n] > 0
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                text = b" ".join(words).decode()
                rows.append({"doc_id": doc_id, "n_words": n, "n_removed": n - len(words), "text": text})
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    rows = docs.join(cut.hint("merge"), OWNER, "left").select("doc_id", "text", "places")
    return rows.mapInArrow(keep, names)


def substring_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return remove_repeats(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256")
    )


SQL = r"""
WITH t AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM t WHERE len(w) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM s),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS m FROM h) WHERE m < doc_id),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM r),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM t),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n
      FROM x ANTI JOIN g USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN k USING (doc_id)
"""
