"""Best-fit packing of documents into sequences of bounded length, certified by lower bounds.

Documents are encoded and cut into pieces inside the tasks that read them. Pieces are then dealt, by
their number and not by length or id, to partitions of bounded size. Each partition is packed by
best-fit decreasing, and dual-feasible functions of its lengths give a number of sequences that no
packing can go below. Where that number is reached, the partition is certified. Partitions with a gap
give up every sequence that has room left; certified ones give up the emptiest, as many as hold most of
their room, which other partitions may fill. The documents given up are dealt anew to fewer and larger partitions (up to
``LARGER`` times the size) and packed again, until the bound of all pieces together is reached, or a
round saves nothing at the largest size.
"""

from __future__ import annotations

import gc
import json
import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe.llm.bpe import byte_alphabet
from wattframe.llm.common import discard, ship, written

CAPACITY = 4096
#: Id put at the end of every document.
END = 1
#: Pieces that a partition packs, on average.
GROUP = 20_000
#: Certified partitions keep sequences with at most this part of all their room, the fullest ones.
ROOM = 1 / 16
#: How many times larger partitions get, each round twice the one before.
LARGER = 16
#: Rounds of exchange at most; a packing is whole after each.
ROUNDS = 8
#: Words whose ids a worker keeps, their greatest length, and characters worked on together.
KEPT_WORDS = 400_000
LONGEST_KEPT = 64
SLICE_CHARS = 200_000

PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"


# ---- tokens


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _splitter(limit: int) -> re.Pattern:
    """The vocabulary's word pattern for lower-case characters below ``limit``."""
    kinds = {"L": [], "N": []}
    for i in range(limit):
        kind = unicodedata.category(chr(i))[0]
        if kind in kinds:
            kinds[kind].append(re.escape(chr(i)))
    letter, number = "".join(kinds["L"]), "".join(kinds["N"])
    # The endings that are words of their own.
    endings = "'s|'t|'re|'ve|'m|'ll|'d"
    return re.compile(f"[{letter}]+|{endings}|[{number}]|[^\t-\r \x85\xa0{letter}{number}]+")


class Words(dict):
    """Ids of words, as little-endian bytes, learned from the tokenizers library as they are met.

    Merging never goes beyond a word, so a text's ids are those of its words in turn. Texts with
    characters from U+0180 on (or U+0130, whose lower case is two), or with a special token, are given
    to the library as they are, in slices that end at a space.
    """

    def __init__(self, source: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(source)
        self.library.no_truncation()
        self.library.no_padding()
        self.tokens = self.library.model.tokenize
        # Words reach the model as bytes, each written as one character.
        self.letters = {byte: char for char, byte in byte_alphabet().items()}
        special = [re.escape(t["content"]) for t in json.loads(source).get("added_tokens", [])]
        self.special = re.compile("|".join(special)) if special else None
        self.odd = re.compile("[^\x00-\u012f\u0131-\u017f]")
        self.ascii, self.latin = _splitter(0x80), _splitter(0x180)
        # A space before a printable ASCII character: no word, special token or composition crosses it.
        self.cut = re.compile(" (?=[!-~])")

    def __missing__(self, word: str) -> bytes:
        found = self.tokens(word.encode().decode("latin-1").translate(self.letters))
        ids = np.array([t.id for t in found], "<u4").tobytes()
        if len(word) <= LONGEST_KEPT:
            self[word] = ids
        return ids

    def slices(self, text: str) -> Iterator[str]:
        start = 0
        while len(text) - start > SLICE_CHARS:
            found = self.cut.search(text, start + SLICE_CHARS)
            if found is None:
                break
            yield text[start : found.end()]
            start = found.end()
        yield text[start:] if start else text

    def ids(self, text: str) -> Iterator[bytes]:
        """The ids of a whole text, a bounded number at a time."""
        for part in self.slices(text):
            plain = part.isascii()
            if (self.special and self.special.search(part)) or not (plain or self.odd.search(part) is None):
                found = self.library.encode(part, add_special_tokens=False).ids
                yield np.array(found, "<u4").tobytes()
                continue
            if len(self) > KEPT_WORDS:
                self.clear()
            words = (self.ascii if plain else self.latin).findall(part.lower())
            yield b"".join(map(self.__getitem__, words))


_loaded: dict[str, Words] = {}


def loaded(source: str) -> Words:
    if source not in _loaded:
        _loaded.clear()
        _loaded[source] = Words(source)
    return _loaded[source]


def cut_pieces(parts: Iterator[bytes], capacity: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, checksum of its ids) of one document; ``end`` comes last."""
    number, waiting, full = 0, b"", 4 * capacity
    for part in chain(parts, [np.array([end], "<u4").tobytes()]):
        waiting = waiting + part if waiting else part
        whole = max(0, (len(waiting) - 1) // full * full)  # the last piece waits for what follows
        for at in range(0, whole, full):
            yield number, number * capacity, capacity, zlib.crc32(waiting[at : at + full])
            number += 1
        waiting = waiting[whole:]
    yield number, number * capacity, len(waiting) // 4, zlib.crc32(waiting)


def pieces(
    docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END
) -> DataFrame:
    """The pieces of every whole text: doc_id, piece, start, length, ids_crc32."""
    ship(docs.sparkSession)
    with open(path or default_path(), encoding="utf-8") as file:
        source = file.read()
    schema = PIECES.format(id=dict(docs.dtypes)["doc_id"])

    def work(batches):
        words = loaded(source)
        gc.disable()  # words and ids have no cycles; looking for them takes longer than the work
        for batch in batches:
            rows, found = [], []
            for i, text in enumerate(batch.column("text")):
                text = text.as_py() or ""
                for piece in cut_pieces(words.ids(text), capacity, end):
                    rows.append(i)
                    found.append(piece)
            number, start, length, crc = np.array(found or np.zeros((0, 4)), np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(rows, pa.int64())),
                    pa.array(number.astype(np.int32)),
                    pa.array(start),
                    pa.array(length),
                    pa.array(crc),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", "text").mapInArrow(work, schema)


# ---- bounds and packing of one partition


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """A number of bins that no packing can go below; ``counts[n]`` items have length ``n``.

    The largest of three families of dual-feasible functions: lengths as they are with small ones left
    out and large ones counted as whole bins; rounding to multiples of 1/k; and rounding to steps of
    every size up to half a bin, from above for large items and from below for small ones.
    """
    counts = np.asarray(counts, np.int64)
    size = np.arange(capacity + 1)
    there = np.flatnonzero(counts)
    if not len(there):
        return 0
    n, amount = np.cumsum(counts), np.cumsum(counts * size)
    least = np.arange(1, capacity // 2 + 1)
    # Items above capacity - e are whole bins, those below e nothing.
    whole = (n[-1] - n[capacity - least]) * capacity + amount[capacity - least] - amount[least - 1]
    best = max(int(whole.max()), int(amount[-1]))
    bound = -(-best // capacity)
    x, c = there, counts[there]
    for k in range(1, 101):
        scaled = (k + 1) * x
        value = np.where(scaled % capacity == 0, x * k, scaled // capacity * capacity)
        bound = max(bound, -(-int((value * c).sum()) // (k * capacity)))
    for steps in np.array_split(least, max(1, len(least) * len(x) // 1_000_000)):
        step = steps[:, None]
        bins = capacity // step
        value = np.where(2 * x > capacity, 2 * (bins - (capacity - x) // step), 2 * (x // step))
        value = np.where(2 * x == capacity, bins, value)
        total = (value * c).sum(axis=1)
        bound = max(bound, int((-(-total // (2 * bins[:, 0]))).max()))
    return bound


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each item, its place there, fill of each bin); longer items go first.

    Open bins are kept by the room they have. One whole number has a bit for every room on offer, so
    the tightest bin that fits is its lowest bit from the item's length on.
    """
    bins = np.zeros(len(lengths), np.int64)
    places = np.zeros(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, fills = 0, []
    for item in np.argsort(-np.asarray(lengths), kind="stable").tolist():
        length = int(lengths[item])
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            here = open_bins[room].pop()
            if not open_bins[room]:
                rooms ^= 1 << room
        else:
            room, here = capacity, len(fills)
            fills.append(0)
        bins[item], places[item] = here, fills[here]
        fills[here] += length
        room -= length
        if room:
            if not open_bins[room]:
                rooms |= 1 << room
            open_bins[room].append(here)
    return bins, places, np.array(fills, np.int64)


def pack_group(rows: pa.Table, number: int, turn: int, capacity: int) -> pa.Table:
    """One partition: placed rows, and whether each one's sequence is given up to the next round."""
    lengths = rows.column("length").to_numpy()
    bins, places, fills = best_fit_decreasing(lengths, capacity)
    certified = len(fills) == lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
    room = capacity - fills
    given = room > 0
    if certified:
        fullest = np.argsort(room, kind="stable")
        given[fullest[np.cumsum(room[fullest]) <= ROOM * room.sum()]] = False
    first = (turn << 56) + (number << 24)
    return (
        rows.drop_columns(["_group"])
        .append_column("sequence_id", pa.array(bins + first))
        .append_column("offset", pa.array(places))
        .append_column("_given", pa.array(given[bins]))
    )


# ---- exchange between partitions


def _packed(rows: DataFrame, count: int, turn: int, capacity: int, group: int) -> tuple[DataFrame, int]:
    """Rows dealt to partitions of about ``group`` rows and packed there; and how many those are."""
    groups = max(1, -(-count // group))
    dealt = rows.withColumn("_group", F.pmod(F.xxhash64("_deal", F.lit(turn)), F.lit(groups)))
    schema = PLACED.format(id=dict(rows.dtypes)["doc_id"]) + ", _given boolean"
    names = [*schema_names(PLACED), "_given"]

    def work(key, table):
        out = pack_group(table, key[0].as_py(), turn, capacity)
        return out.select(["_deal", *names])

    packed = dealt.groupBy("_group").applyInArrow(work, "_deal long, " + schema)
    return written(packed, "packed"), groups


def schema_names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(",")]


def pack(
    docs: DataFrame,
    path: str | None = None,
    capacity: int = CAPACITY,
    end: int = END,
    group: int = GROUP,
) -> DataFrame:
    """All whole texts in as few sequences of at most ``capacity`` ids as the exchange finds.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null and empty
    texts are documents of the end id alone. Rows that repeat a doc_id, or have none, are documents of
    their own. Only documents longer than ``capacity`` are cut. An empty table gives no rows; other
    columns of ``docs`` are not looked at. Sequence ids are unique, with gaps between them.
    """
    found = pieces(docs, path, capacity, end)
    # The number of a piece is settled by the table it is written to, so lost tasks do not change it.
    table = written(found.withColumn("_deal", F.monotonically_increasing_id()), "pieces")
    # At most one row per length.
    lengths = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count("*").alias("n")).collect()}
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in lengths.items():
        counts[length] = n
    bound, pool = lower_bound(counts, capacity), int(counts.sum())
    kept: list[DataFrame] = []
    settled = 0  # sequences in ``kept``
    now, groups = _packed(table, pool, 0, capacity, group)
    used, given, waiting = _sizes(now)
    for turn in range(1, ROUNDS + 1):
        if settled + used <= bound or given < 2 or groups == 1:
            break
        times = min(LARGER, 2**turn)
        given_up = now.filter("_given").select(table.columns)
        after, fewer = _packed(given_up, waiting, turn, capacity, group * times)
        again = _sizes(after)
        if again[0] >= given:
            discard(after)
            if times == LARGER or fewer == 1:
                break
            continue
        kept.append(now.filter("NOT _given"))
        settled += used - given
        now, groups = after, fewer
        used, given, waiting = again
    for part in kept:
        now = now.unionByName(part)
    discard(table)
    return now.select(*schema_names(PLACED))


def _sizes(placed: DataFrame) -> tuple[int, int, int]:
    """Sequences, sequences given up, and pieces in those. Each sequence has one piece at place 0."""
    row = placed.agg(
        F.count_if(F.col("offset") == 0).alias("used"),
        F.count_if((F.col("offset") == 0) & F.col("_given")).alias("given"),
        F.count_if("_given").alias("waiting"),
    ).first()
    return row["used"], row["given"], row["waiting"]
