"""Jaccard join of documents on word n-grams, by partitioning the universe of tokens.

A document's tokens are its distinct shingles. Two sets of sizes r and s can only reach the threshold if
they differ in at most H = 15 (r + s) / 185 tokens (with 85 of 100, op8's; other values are arguments). Sizes are cut into bands, and each band has its
scheme: a hash deals all possible tokens into m = H + 1 segments, H for the largest sizes of the band.
Sets that differ in at most H tokens agree on a whole segment. A document goes to the scheme of its own
band and to that of the next, so that any two sizes that can reach the threshold meet.

Allocation of the H + 1 votes that a document needs: each segment with tokens has one vote, and its
content is a key. Empty segments would be keys that very many documents share, so they get no vote. For
a document's own size H is often smaller than for the band, which pays for a few of them. What still
lacks is paid by segments of two tokens or more with two votes each: equal, or different by one token,
which needs keys of the segment's content without each of its tokens. A first pass counts how many
leading segments need such keys in each scheme (usually none); they alone get them. If some document
cannot be paid for at all, its scheme gives votes to empty segments, too.

Documents with the same set are one class; only classes are compared. Keys that one class alone has
drop out. The others give candidates in three steps, so that large groups of near copies need no pairs.
The hub of a key is the class that shares most keys. Each class is first compared with one hub, the
greatest of those of its keys; then with the hubs of its other keys that this did not connect it with;
then classes of one key that are still not connected are compared with each other, all of them. Two
sketches rule out pairs that must differ too much, inside the join that finds them: how many tokens fall
into each of 32 cells, and whether their number is odd in each of 512 or more; all others are verified on both
whole sets. Parities have as many cells as a set has tokens, or more, or they would tell nothing about
large sets: any two of these differ in the same half of the cells. Of two sets with other numbers of
cells, the larger sketch is folded.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattframe.llm.common import discard, join_written_groups, lookup, settled, ship, written
from wattframe.llm.components import components
from wattframe.llm.hashing import LOWER, STEP, U, mix, window_hashes, word_hashes

#: Similarity, as a fraction, and words to a shingle, where no others are given.
NEAR, OF = 85, 100
WORDS = 4
#: A document that no number of leading segments pays for.
UNPAID = 1 << 20
#: Cells of a sketch of counts, and least number of words of 64 bits of one of parities.
CELLS = 32
PARITY = 8


def shingles(text: str | None, length: int = WORDS) -> np.ndarray:
    """Hashes of the distinct shingles; fewer words count as one shingle."""
    words = word_hashes((text or "").encode().translate(LOWER))
    if not len(words):
        return words
    return np.unique(window_hashes(words, min(length, len(words))))


@lru_cache(maxsize=1 << 16)
def band(size: int, near: int = NEAR) -> tuple[int, int, int]:
    """(number, first size, last size) of the band of a size."""
    k, low = 0, 1
    while True:
        high = max(low, (low - 1) * OF // near)
        if size <= high:
            return k, low, high
        k, low = k + 1, high + 1


def most_different(r: int, s: int, near: int = NEAR) -> int:
    """Largest symmetric difference of sets of these sizes that reach the threshold."""
    return (OF - near) * (r + s) // (OF + near)


def schemes(size: int, near: int = NEAR) -> Iterator[tuple[int, int, int]]:
    """(scheme, segments, votes needed) of a document."""
    k, _, high = band(size, near)
    partner = size * OF // near
    yield k, most_different(high, high, near) + 1, most_different(size, min(partner, high), near) + 1
    if partner > high:
        k, _, high = band(high + 1, near)
        yield k, most_different(high, high, near) + 1, most_different(size, min(partner, high), near) + 1


class Segments:
    """A set dealt into the segments of one scheme."""

    def __init__(self, tokens: np.ndarray, scheme: int, m: int):
        self.scheme, self.m = scheme, m
        mixed = mix(tokens + U(STEP * (2 * scheme + 1) & (1 << 64) - 1))
        at = ((mixed >> U(32)) * U(m)) >> U(32)
        order = np.argsort(at, kind="stable")
        self.at, self.tokens = at[order].astype(np.int64), mixed[order]
        self.count = np.bincount(self.at, minlength=m)
        filled = np.flatnonzero(self.count)
        self.sums = np.zeros(m, U)
        first = np.concatenate([[0], np.cumsum(self.count[filled])[:-1]])
        self.sums[filled] = np.add.reduceat(self.tokens, first)

    def key(self, sums: np.ndarray, count: np.ndarray, segment: np.ndarray) -> np.ndarray:
        place = U(self.scheme << 32) + segment.astype(U)
        return mix(mix(sums + count.astype(U) * U(STEP)) + place * U(0xD6E8FEB86659FD93))

    def leading(self, needed: int) -> int:
        """How many leading segments must have keys without a token."""
        lacking = needed - int((self.count > 0).sum())
        if lacking <= 0:
            return 0
        able = np.flatnonzero(self.count >= 2)
        return int(able[lacking - 1]) + 1 if len(able) >= lacking else UNPAID

    def keys(self, leading: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of whole segments, and of leading ones without each of their tokens."""
        some = np.arange(self.m) if leading >= UNPAID else np.flatnonzero(self.count)
        whole = self.key(self.sums[some], self.count[some], some)
        if not 0 < leading < UNPAID:
            return whole, np.zeros(0, U)
        rows = np.flatnonzero((self.at < leading) & (self.count[self.at] >= 2))
        at = self.at[rows]
        return whole, self.key(self.sums[at] - self.tokens[rows], self.count[at] - 1, at)


def set_id(tokens: np.ndarray) -> int:
    total = mix(np.array([np.add.reduce(mix(tokens ^ U(STEP))) + U(len(tokens))], U))
    return int(total.view(np.int64)[0])


def classes(docs: DataFrame, length: int, near: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, sid (names the set), and what the document asks of its schemes."""
    kind = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("text_hash", pa.int64()),
            ("n_shingles", pa.int64()),
            ("sid", pa.int64()),
            ("asks", pa.list_(pa.struct([("scheme", pa.int32()), ("leading", pa.int32())]))),
        ]
    )

    def count(batches):
        for batch in batches:
            rows = []
            ids, hashes = batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist()
            for doc_id, text_hash, text in zip(ids, hashes, batch.column("text")):
                tokens = shingles(text.as_py(), length)
                asks = []
                if len(tokens):
                    for scheme, m, needed in schemes(len(tokens), near):
                        leading = Segments(tokens, scheme, m).leading(needed)
                        if leading:
                            asks.append({"scheme": scheme, "leading": leading})
                rows.append(
                    {
                        "doc_id": doc_id,
                        "text_hash": text_hash,
                        "n_shingles": len(tokens),
                        "sid": set_id(tokens) if len(tokens) else None,
                        "asks": asks,
                    }
                )
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    names = "doc_id long, text_hash long, n_shingles long, sid long, asks array<struct<scheme: int, leading: int>>"
    return docs.select("doc_id", text_hash(), "text").mapInArrow(count, names)


def text_hash() -> Column:
    """Tells rows that repeat an id apart."""
    return F.xxhash64("text").alias("text_hash")


def keys(docs: DataFrame, leading: dict[int, int], length: int, near: int) -> DataFrame:
    """(key, sid, whole) of every set; a task emits each set once."""
    kind = pa.schema([("key", pa.int64()), ("sid", pa.int64()), ("whole", pa.bool_())])

    def emit(batches):
        seen: set[int] = set()
        for batch in batches:
            found, ids, whole, n = [], [], [], 0
            for text in batch.column("text"):
                tokens = shingles(text.as_py(), length)
                if not len(tokens) or (sid := set_id(tokens)) in seen:
                    continue
                seen.add(sid)
                for scheme, m, _ in schemes(len(tokens), near):
                    parts = Segments(tokens, scheme, m).keys(leading.get(scheme, 0))
                    for part, is_whole in zip(parts, (True, False)):
                        found.append(part)
                        ids.append(np.full(len(part), sid))
                        whole.append(np.full(len(part), is_whole))
                        n += len(part)
                if n > 500_000:
                    yield batch_of(found, ids, whole)
                    found, ids, whole, n = [], [], [], 0
            if n:
                yield batch_of(found, ids, whole)

    def batch_of(found, ids, whole):
        parts = [np.concatenate(found).view(np.int64), np.concatenate(ids), np.concatenate(whole)]
        return pa.RecordBatch.from_arrays([pa.array(p) for p in parts], schema=kind)

    return docs.select("text").mapInArrow(emit, "key long, sid long, whole boolean")


def parity_words(size: int) -> int:
    """Words of a sketch of parities: a power of two, with a bit or more for each token."""
    return max(PARITY, 1 << (-(-size // 64) - 1).bit_length())


def sets_of(docs: DataFrame, length: int) -> DataFrame:
    """(sid, n, sketch, odd, tokens): the sorted tokens as bytes, their number, how many fall into each of
    ``CELLS`` cells, and the bits of the finer cells that hold an odd number. A task emits each set once."""
    kind = pa.schema(
        [
            ("sid", pa.int64()),
            ("n", pa.int32()),
            ("sketch", pa.list_(pa.int32())),
            ("odd", pa.list_(pa.int64())),
            ("tokens", pa.binary()),
        ]
    )

    def pack(batches):
        seen: set[int] = set()
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                tokens = shingles(text.as_py(), length)
                if not len(tokens) or (sid := set_id(tokens)) in seen:
                    continue
                seen.add(sid)
                mixed = mix(tokens)
                cells = np.bincount((mixed % U(CELLS)).astype(np.int64), minlength=CELLS)
                bits = 64 * parity_words(len(tokens))
                fine = ((mixed >> U(32)) % U(bits)).astype(np.int64)
                odd = np.packbits(np.bincount(fine, minlength=bits) & 1).view(np.int64)
                row = {"sid": sid, "n": len(tokens), "sketch": cells.tolist()}
                rows.append(row | {"odd": odd.tolist(), "tokens": tokens.tobytes()})
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    kinds = "sid long, n int, sketch array<int>, odd array<long>, tokens binary"
    return docs.select("text").mapInArrow(pack, kinds)


def may_be_near(one: str, two: str, near: int) -> Column:
    """Whether sizes and sketches leave room for the threshold: sets differ by at least as much as they do.

    A token in one set alone changes one count by one and turns one parity round, also after folding.
    """
    both = F.col(f"{one}.n") + F.col(f"{two}.n")
    apart = F.aggregate(
        F.zip_with(f"{one}.sketch", f"{two}.sketch", lambda x, y: F.abs(x - y)),
        F.lit(0),
        lambda total, x: total + x,
    )
    words = F.least(F.size(f"{one}.odd"), F.size(f"{two}.odd"))

    def folded(odd: str) -> Column:
        # Cells are dealt by a remainder, and numbers of words are powers of two.
        parts = F.sequence(F.lit(1), (F.size(odd) / words).cast("int") - 1)
        first = F.slice(odd, F.lit(1), words)
        xor = F.aggregate(
            parts, first, lambda so_far, k: F.zip_with(so_far, F.slice(odd, k * words + 1, words), lambda x, y: x.bitwiseXOR(y))
        )
        return F.when(F.size(odd) > words, xor).otherwise(F.col(odd))

    turned = F.aggregate(
        F.zip_with(folded(f"{one}.odd"), folded(f"{two}.odd"), lambda x, y: F.bit_count(x.bitwiseXOR(y))),
        F.lit(0),
        lambda total, x: total + x,
    )
    room = (OF - near) * both
    sizes = (OF + near) * F.abs(F.col(f"{one}.n") - F.col(f"{two}.n")) <= room
    return sizes & ((OF + near) * turned <= room) & ((OF + near) * apart <= room)


def near_pairs(pairs: DataFrame, sets: DataFrame, near: int) -> DataFrame:
    """Those pairs (a, b) of sets whose similarity reaches the threshold; sketches rule out most others."""
    kind = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    short = sets.select("sid", "n", "sketch", "odd")
    one, two = short.alias("one"), short.alias("two")
    pairs = (
        pairs.join(one, F.col("a") == F.col("one.sid"))
        .join(two, (F.col("b") == F.col("two.sid")) & may_be_near("one", "two", near))
        .select("a", "b")
    )
    pairs = written(pairs, "pairs")

    def verify(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                r = np.frombuffer(x.as_buffer(), U)
                s = np.frombuffer(y.as_buffer(), U)
                small, large = (r, s) if len(r) <= len(s) else (s, r)
                place = np.searchsorted(large, small)
                place[place == len(large)] = 0
                common = int((large[place] == small).sum())
                good.append(OF * common >= near * (len(r) + len(s) - common))
            mask = pa.array(good, pa.bool_())
            rows = batch.select(["a", "b"]).filter(mask)
            yield pa.RecordBatch.from_arrays(rows.columns, schema=kind)

    # Sketches leave few pairs, so most sets need not move.
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), "ids")
    asked = lookup(sets.select("sid", "tokens"), ids, ["sid"], "left_semi", ids.count())
    x = asked.select(F.col("sid").alias("a"), F.col("tokens").alias("x"))
    y = asked.select(F.col("sid").alias("b"), F.col("tokens").alias("y"))
    rows = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")
    return rows.mapInArrow(verify, "a long, b long")


def near_classes(docs: DataFrame, members: DataFrame, length: int, near: int) -> DataFrame:
    """(id, label) of every class that has a near one: the smallest class id in its component."""
    asked = members.select(F.explode("asks").alias("ask")).groupBy("ask.scheme")
    leading = {r[0]: r[1] for r in asked.agg(F.max("ask.leading")).collect()}  # a row per band
    emitted = keys(docs, leading, length, near).repartition("key")
    same = Window.partitionBy("key")
    shared = (F.min("sid").over(same) != F.max("sid").over(same)) & F.max("whole").over(same)
    live = emitted.withColumn("shared", shared).filter("shared").drop("shared").distinct()
    live = written(live, "shared-keys")
    weight = live.groupBy("sid").agg(F.count(F.lit(1)).alias("weight"))
    weight = written(weight, "weights")
    hubs = live.join(weight, "sid").groupBy("key").agg(
        F.max(F.struct("weight", "sid")).alias("hub"), F.count(F.lit(1)).alias("n")
    )
    hubs = written(hubs, "hubs")
    reps = members.groupBy("sid").agg(
        F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "text_hash")).alias("rep")
    )
    reps = reps.join(weight, "sid", "left_semi").select("rep.doc_id", "rep.text_hash")
    texts = docs.select("doc_id", text_hash(), "text")
    texts = texts.join(*by_row(reps), "left_semi")
    # Rows that repeat id and text meet in one task of this join, so sets need no shuffle of their own;
    # one that stands twice all the same, in two parts of a split task, only repeats pairs.
    sets = written(sets_of(texts, length), "sets")
    # One hub for each class: the greatest among those of its keys.
    best = join_written_groups(live, hubs, ["key"], "n", live).groupBy("sid").agg(F.max("hub").alias("hub"))
    first = best.select(F.col("sid").alias("a"), F.col("hub.sid").alias("b")).filter("a != b")
    links = written(near_pairs(first, sets, near), "near")
    labels = components(links)
    # The hubs of its other keys, where the first did not connect them.
    marked = labelled(live, labels, "sid", "label")
    far = labelled(hubs.select("key", "n", F.col("hub.sid").alias("hub")), labels, "hub", "far")
    to_hub = join_written_groups(marked, written(far, "hubs"), ["key"], "n", live).filter("label != far")
    to_hub = written(to_hub.select(F.col("sid").alias("a"), F.col("hub").alias("b")).distinct(), "pairs")
    more = written(near_pairs(to_hub, sets, near), "near")
    discard(hubs, weight)
    if not more.isEmpty():
        discard(labels)
        links = links.unionByName(more)
        labels = components(links)
    # What the hubs did not connect: all pairs of different components that share a key.
    marked = labelled(live, labels, "sid", "label")
    open_keys = marked.groupBy("key").agg(
        F.min("label").alias("least"), F.max("label").alias("most"), F.count(F.lit(1)).alias("n")
    )
    open_keys = written(open_keys.filter("least != most").select("key", "n"), "open-keys")
    rest = join_written_groups(marked, open_keys, ["key"], "n", live).drop("n")
    rest = written(rest.join(sets.select("sid", "n", "sketch", "odd"), "sid"), "open")
    left, right = rest.alias("l"), rest.alias("r")
    pairs = left.join(
        right,
        (F.col("l.key") == F.col("r.key"))
        & (F.col("l.sid") < F.col("r.sid"))
        & (F.col("l.label") != F.col("r.label"))
        & (F.col("l.whole") | F.col("r.whole"))
        & may_be_near("l", "r", near),
    )
    pairs = pairs.select(F.col("l.sid").alias("a"), F.col("r.sid").alias("b")).distinct()
    tried = to_hub.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = written(near_pairs(pairs.join(tried, ["a", "b"], "left_anti"), sets, near), "near")
    discard(live, open_keys, rest, sets, to_hub)
    if more.isEmpty():
        return labels
    discard(labels)
    return components(links.unionByName(more))


def labelled(rows: DataFrame, labels: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` with the label of a class; a class without links is its own."""
    known = labels.select(F.col("id").alias(key), F.col("label").alias(name))
    return rows.join(known, key, "left").withColumn(name, F.coalesce(name, key))


def by_row(rows: DataFrame) -> tuple[DataFrame, Column]:
    """``rows`` (doc_id, text_hash) for a shuffled join with documents, and its null-safe condition."""
    other = rows.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).hint("merge")
    return other, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))


def jaccard_components(docs: DataFrame, length: int = WORDS, near: int = NEAR) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Shingles have ``length`` words, and sets are near with a similarity of ``near`` of 100 or more.
    Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased. Documents without words, or with
    a null text, have no shingles and are linked with nothing. Equal sets are linked. The component's id
    is the smallest doc_id reached; null ids are named only by a component that has no other. Rows that
    repeat an id are told apart by their texts. An empty table gives an empty result.
    """
    found, _ = linked_rows(docs, length, near)
    return found.select("doc_id", "n_shingles", "component_id")


def linked_rows(docs: DataFrame, length: int, near: int) -> tuple[DataFrame, DataFrame]:
    """Rows as (doc_id, text_hash, n_shingles, component_id), and those that are not the first of their
    component, as distinct (doc_id, text_hash). The first has the smallest id, then the smallest hash."""
    ship(docs.sparkSession)
    members = written(classes(docs, length, near), "classes")
    labels = near_classes(docs, members, length, near)
    row = F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "text_hash")
    size = members.filter("sid IS NOT NULL").groupBy("sid").agg(
        F.min(row).alias("least"), F.count(F.lit(1)).alias("n")
    )
    size = written(labelled(size, labels, "sid", "label"), "sizes")
    least = size.groupBy("label").agg(F.min("least").alias("first"), F.count(F.lit(1)).alias("k"))
    least = written(least, "least")
    named = join_written_groups(size, least, ["label"], "k", size)
    named = written(named.select("sid", "first", "n"), "named")
    have = members.filter("sid IS NOT NULL").select("doc_id", "text_hash", "n_shingles", "sid")
    linked = join_written_groups(have, named, ["sid"], "n", members)
    alone = members.filter("sid IS NULL").select(
        "doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id")
    )
    columns = ["doc_id", "text_hash", "n_shingles", F.col("first.doc_id").alias("component_id")]
    first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    later = linked.filter(~first).select("doc_id", "text_hash").distinct()
    return linked.select(columns).unionByName(alone), later


def one_of_each(docs: DataFrame, length: int = WORDS, near: int = NEAR) -> DataFrame:
    """Pipeline stage: of each component one document stays, with all its columns.

    It is the one with the smallest id (null ids last, equal ids by a hash of their texts). Documents
    are told apart by id and text: another text under the id of one that goes is not touched, and rows
    that repeat both stay or go together. Documents without words all stay.
    """
    later = settled(lambda: linked_rows(docs, length, near)[1], "later")
    packed = docs.select("doc_id", text_hash(), F.struct(*docs.columns).alias("row"))
    return packed.join(*by_row(later), "left_anti").select("row.*")
