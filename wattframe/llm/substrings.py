"""Removal of byte strings of 200 bytes that start at more than one place, by sorted suffixes.

Suffixes are sorted by external induction (see ``induced``), in shards so made that equal strings meet in one:

- Every 200-byte window is owned by the smallest hash among its 100-byte strings; neighbouring windows with
  the same owner form a stretch. Equal windows have owners with equal hashes at the same offset, so only
  stretches whose owner's hash occurs again can repeat. Of stretches that are equal as a whole, one goes on.
- The others are cut into pieces by the owner's offset. The windows of a piece share a core of bytes, and
  equal windows have equal cores. Pieces are dealt to shards by core, so an owner that much text has is
  spread over as many shards as it has different surroundings. Of equal pieces, again one goes on.
- A core that alone has more pieces than fit a shard, as where a passage of many documents begins or ends, is
  not sorted in one: its pieces are cut into single windows, and equal ones are counted.
- Each shard sorts the suffixes of its pieces, in which equal cores, compared in full, are one symbol; neighbours
  with a common prefix of a core and 24 bytes repeat.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe.llm.common import discard, join_groups, ship, written
from wattframe.llm.hashing import _BYTE, BACK, STEP, U, mix, powers, window_hashes
from wattframe.llm.induced import repeats, scratch_folder
from wattframe.llm.passages import _rows, leaders

WINDOW, SHORT = 200, 100
#: Offsets of the owner that share a piece, and bytes of pieces that a shard is meant to hold.
OFFSETS, SHARD = 25, 1 << 21
#: Bytes that all windows of a piece share.
CORE = WINDOW - OFFSETS + 1


def values(text: str | None) -> np.ndarray:
    return _BYTE[np.frombuffer((text or "").encode(), np.uint8)]


def gathered(batches, size: int = 1 << 22):
    """The same rows in batches of about ``size`` bytes, since each small one has its own cost."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.nbytes
        if n >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def stretches(docs: DataFrame) -> DataFrame:
    """(owner, whole, row, low, high, place): windows low..high, owner's hash and place, hash of all bytes."""
    kind = pa.schema(
        [
            ("owner", pa.int64()),
            ("whole", pa.int64()),
            ("row", pa.int64()),
            ("low", pa.int32()),
            ("high", pa.int32()),
            ("place", pa.int32()),
        ]
    )

    def find(batches):
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text")):
                data = values(text.as_py())
                if len(data) < WINDOW:
                    continue
                short = window_hashes(data, SHORT)
                place = leaders(short, WINDOW - SHORT + 1)
                low = np.flatnonzero(np.diff(place, prepend=-1))
                high = np.append(low[1:] - 1, len(place) - 1)
                prefix = np.zeros(len(data) + 1, U)
                np.cumsum(data * powers(STEP, len(data)), out=prefix[1:])
                whole = (prefix[high + WINDOW] - prefix[low]) * powers(BACK, len(data))[low]
                whole = mix(whole + (high - low).astype(U) * U(BACK))
                yield _rows(
                    kind,
                    short[place[low]].view(np.int64),
                    whole.view(np.int64),
                    np.full(len(low), row, np.int64),
                    low.astype(np.int32),
                    high.astype(np.int32),
                    place[low].astype(np.int32),
                )

    return docs.select("row", "text").mapInArrow(
        lambda batches: gathered(find(batches)), "owner long, whole long, row long, low int, high int, place int"
    )


def with_ranges(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """(row, text, ranges) of the rows that have ranges."""
    fields = [c for c in ranges.columns if c != "row"]
    listed = ranges.groupBy("row").agg(F.collect_list(F.struct(*fields)).alias("ranges"))
    return docs.join(listed.hint("merge"), "row").select("row", "text", "ranges")


def pieces(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """(core, whole, row, low, high, place): the ranges cut by the offset of their owner, core's hash and place."""
    kind = pa.schema(
        [
            ("core", pa.int64()),
            ("whole", pa.int64()),
            ("row", pa.int64()),
            ("low", pa.int32()),
            ("high", pa.int32()),
            ("place", pa.int32()),
        ]
    )

    def cut(batches):
        for batch in batches:
            cells = zip(batch.column("row").to_pylist(), batch.column("text"), batch.column("ranges"))
            for row, text, some in cells:
                data = values(text.as_py())
                prefix = np.zeros(len(data) + 1, U)
                np.cumsum(data * powers(STEP, len(data)), out=prefix[1:])
                low, high, place = (some.values.field(c).to_numpy() for c in ("low", "high", "place"))
                parts = []
                for group in range((WINDOW - SHORT) // OFFSETS + 1):
                    # Windows whose owner has an offset of group * OFFSETS and up.
                    first = place - (group + 1) * OFFSETS + 1
                    last = first + OFFSETS - 1
                    a, b = np.maximum(low, first), np.minimum(high, last)
                    has = a <= b
                    parts.append(np.stack([a[has], b[has], last[has], first[has] + WINDOW, np.full(has.sum(), group)]))
                a, b, core, end, group = np.concatenate(parts, axis=1)
                back = powers(BACK, len(data) + 1)
                inner = mix(mix((prefix[end] - prefix[core]) * back[core]) + group.astype(U))
                whole = mix((prefix[b + WINDOW] - prefix[a]) * back[a])
                whole = mix(whole + (b - a).astype(U) * U(BACK) + (core - a).astype(U) * U(STEP))
                yield _rows(
                    kind,
                    inner.view(np.int64),
                    whole.view(np.int64),
                    np.full(len(a), row, np.int64),
                    a.astype(np.int32),
                    b.astype(np.int32),
                    core.astype(np.int32),
                )

    names = "core long, whole long, row long, low int, high int, place int"
    return with_ranges(docs, ranges).mapInArrow(lambda batches: gathered(cut(batches)), names)


def symbols(parts: list[bytes], cuts: list[int], names: dict[bytes, int], first: int) -> tuple[np.ndarray, np.ndarray]:
    """The pieces as symbols, with their cores, at ``cuts``, as one each, and the lengths of what they become.

    Bytes are 1 to 256. Cores have numbers in ``names``, which grows; each piece ends with a number of its own,
    counted from ``first``. Cores take even numbers beyond those of bytes and ends odd ones.
    """
    pairs = list(zip(parts, cuts))
    raw = b"".join(x for part, at in pairs for x in (part[:at], b"\0", part[at + CORE :], b"\0"))
    size = np.array([len(part) for part in parts]) - CORE + 2
    stop = np.cumsum(size) - 1
    text = np.frombuffer(raw, np.uint8).astype(np.uint32) + 1
    core = [names.setdefault(part[at : at + CORE], len(names)) for part, at in pairs]
    text[stop - size + 1 + np.array(cuts)] = np.array(core, np.uint32) * 2 + 258
    text[stop] = (np.arange(len(parts), dtype=np.uint32) + first) * 2 + 259
    return text, size


def sorted_repeats(docs: DataFrame, ranges: DataFrame, count: int) -> DataFrame:
    """(row, low, high): windows of the pieces (core, row, low, high, place) that start again in their shard."""

    def cut(batches):
        kind = pa.schema(
            [("core", pa.int64()), ("row", pa.int64()), ("low", pa.int32()), ("at", pa.int32()), ("bytes", pa.binary())]
        )
        for batch in batches:
            cells = zip(batch.column("row").to_pylist(), batch.column("text"), batch.column("ranges"))
            for row, text, some in cells:
                data = text.as_py().encode()
                core, low, high, place = (some.values.field(c).to_numpy() for c in ("core", "low", "high", "place"))
                cuts = [data[a : b + WINDOW] for a, b in zip(low.tolist(), high.tolist())]
                yield _rows(kind, core, np.full(len(core), row, np.int64), low, place - low, cuts)

    def sort(batches):
        kind = pa.schema([("row", pa.int64()), ("low", pa.int32()), ("high", pa.int32())])
        held, rows, lows, sizes, names, n = tempfile.TemporaryFile(dir=scratch_folder()), [], [], [], {}, 0
        with held:
            for batch in batches:
                if not batch.num_rows:
                    continue
                rows.append(batch.column("row").to_numpy())
                lows.append(batch.column("low").to_numpy())
                part, size = symbols(batch.column("bytes").to_pylist(), batch.column("at").to_pylist(), names, n)
                held.write(part.tobytes())
                sizes.append(size)
                n += len(size)
            if not n:
                return
            held.write(b"\0" * 4)
            held.flush()
            sizes = np.concatenate(sizes)
            text = np.asarray(np.memmap(held, np.uint32, "r", shape=(int(sizes.sum()) + 1,)))
        begins = np.cumsum(sizes) - sizes
        usable = sizes - 1 - OFFSETS + 1
        starts = np.repeat(begins - (np.cumsum(usable) - usable), usable) + np.arange(usable.sum())
        found = repeats(text, starts, OFFSETS)
        piece = np.searchsorted(begins, found, "right") - 1
        at = (np.concatenate(lows)[piece] + found - begins[piece]).astype(np.int32)
        for i in range(0, len(at), 100_000):
            some = slice(i, i + 100_000)
            yield _rows(kind, np.concatenate(rows)[piece[some]], at[some], at[some])

    shards = max(docs.sparkSession.sparkContext.defaultParallelism, count * (WINDOW + OFFSETS) // SHARD + 1)
    names = "core long, row long, low int, at int, bytes binary"
    cut_out = with_ranges(docs, ranges).mapInArrow(lambda batches: gathered(cut(batches)), names)
    return cut_out.repartition(shards, "core").mapInArrow(sort, "row long, low int, high int")


def one_of_equal(found: DataFrame, key: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Ranges that repeat as a whole, and one of each kind where a key has several kinds.

    A key that occurs once cannot repeat. Only counts are kept of the rows that share key and bytes. ``found``,
    a written table, is deleted once its repeated rows are stored.
    """
    total = found.count()
    keys = found.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), (F.min("whole") != F.max("whole")).alias("mixed")
    )
    keys = written(keys.filter("n > 1"), f"{name}-keys")
    again = written(join_groups(found, keys, [key], "n", total).drop("n"), f"{name}-again")
    discard(found, keys)
    one_kind = again.filter("NOT mixed").select("row", "low", "high")
    mixed = again.filter("mixed").drop("mixed")
    others = [c for c in found.columns if c not in (key, "whole")]
    kinds = mixed.groupBy(key, "whole").agg(
        F.min(F.struct(*others)).alias("one"), F.count(F.lit(1)).alias("n")
    )
    kinds = written(kinds, f"{name}-kinds")
    alike = join_groups(mixed, kinds.filter("n > 1"), [key, "whole"], "n", total)
    return one_kind.unionByName(alike.select("row", "low", "high")), kinds.select(key, "one.*")


def split_cores(kinds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pieces of cores that have at most as many as fit a shard, and those of the others."""
    sizes = written(kinds.groupBy("core").agg(F.count(F.lit(1)).alias("n")), "core-sizes")
    sized = written(join_groups(kinds, sizes, ["core"], "n", kinds.count()), "sized")
    discard(sizes)
    fits = F.col("n") <= SHARD // (WINDOW + OFFSETS)
    return sized.filter(fits).drop("n"), sized.filter(~fits).drop("n")


def counted_windows(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """(row, low, high): those windows of the ranges that stand in them more than once."""
    kind = pa.schema([("window", pa.int64()), ("row", pa.int64()), ("low", pa.int32())])

    def cut(batches):
        for batch in batches:
            cells = zip(batch.column("row").to_pylist(), batch.column("text"), batch.column("ranges"))
            for row, text, some in cells:
                hashes = window_hashes(values(text.as_py()), WINDOW)
                low, high = (some.values.field(c).to_numpy() for c in ("low", "high"))
                usable = high - low + 1
                at = np.repeat(low - np.append(0, np.cumsum(usable)[:-1]), usable) + np.arange(usable.sum())
                yield _rows(
                    kind, hashes[at].view(np.int64), np.full(len(at), row, np.int64), at.astype(np.int32)
                )

    found = with_ranges(docs, ranges).mapInArrow(lambda batches: gathered(cut(batches)), "window long, row long, low int")
    found = written(found, "cut-windows")
    keys = found.groupBy("window").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = join_groups(found, written(keys, "window-keys"), ["window"], "n", found.count())
    return again.select("row", "low", F.col("low").alias("high"))


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """(row, low, high): windows that also start anywhere else."""
    whole, kinds = one_of_equal(written(stretches(docs), "stretches"), "owner", "stretch")
    cut = written(pieces(docs, kinds.drop("owner")), "pieces")
    parts, kinds = one_of_equal(cut, "core", "piece")
    kinds, crowded = split_cores(kinds)
    windows = written(sorted_repeats(docs, kinds, kinds.count()), "windows")
    windows = windows.unionByName(written(counted_windows(docs, crowded), "counted"))
    return whole.unionByName(parts).unionByName(windows)


def remove_substrings(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes) of every row of ``docs``.

    Texts are UTF-8 bytes; null counts as empty. All places at which a repeated 200-byte string starts
    are removed, the first as well. Rows are told apart even if they repeat an id or have none. Shorter
    texts stay whole. An empty table gives an empty result; other columns are ignored.
    """
    ship(docs.sparkSession)
    rows = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    rows = written(rows, "rows")
    cuts = repeated_ranges(rows).groupBy("row").agg(F.collect_list(F.struct("low", "high")).alias("cuts"))
    names = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    kind = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64())]
        + [("n_spans", pa.int64()), ("kept", pa.binary())]
    )

    def keep(batches):
        for batch in batches:
            cells = zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("cuts"))
            for doc_id, text, some in cells:
                data = np.frombuffer((text.as_py() or "").encode(), np.uint8)
                edge = np.zeros(len(data) + 1, np.int32)
                if some.is_valid:
                    low = some.values.field("low").to_numpy()
                    high = some.values.field("high").to_numpy()
                    np.add.at(edge, low, 1)
                    np.add.at(edge, high + WINDOW, -1)
                gone = np.cumsum(edge[:-1]) > 0
                spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
                out = [doc_id, len(data), int(gone.sum()), spans, data[~gone].tobytes()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], t) for v, t in zip(out, kind.types)], schema=kind
                )

    joined = rows.join(cuts.hint("merge"), "row", "left").select("doc_id", "text", "cuts")
    return joined.mapInArrow(lambda batches: gathered(keep(batches)), names)


def substring_removal(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return remove_substrings(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
