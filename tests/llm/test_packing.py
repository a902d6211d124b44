"""Packing against the tokenizers library and, for small cases, against all packings."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tests.llm.test_operators import DOCS, texts
from wattframe.llm import packing

COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_path())


@pytest.fixture(scope="module")
def words():
    with open(packing.default_path(), encoding="utf-8") as file:
        return packing.Words(file.read())


def ids_of(words, text):
    return np.frombuffer(b"".join(words.ids(text)), "<u4").tolist()


def test_ids_are_those_of_the_library(words, library):
    draw = random.Random(1)
    letters = "abcXYZ'sтé ßÉ¼²0123 \t\n\x1c\x1f\x85\xa0!?|>.,'reveÿŻſİıŁ́中"
    for i in range(3000):
        text = "".join(draw.choice(letters) for _ in range(draw.randrange(40)))
        if i % 10 == 0:
            text = f"<|endoftext|>{text}<|startoftext|>x"
        assert ids_of(words, text) == library.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("extra", ["", " тест <|endoftext|> é"])
def test_ids_of_a_very_long_text(words, library, extra):
    draw = random.Random(2)
    text = " ".join(draw.choice(["alpha", "Bêta", "it's", "42", "--", "zürich\n"]) for _ in range(450_000)) + extra
    assert len(text) > 2 << 20
    assert ids_of(words, text) == library.encode(text, add_special_tokens=False).ids


def test_cut_pieces_whatever_the_parts():
    ids = np.arange(1, 24, dtype="<u4")
    for size in (1, 3, 8, 40):
        parts = [ids[i : i + size].tobytes() for i in range(0, len(ids), size)]
        for capacity in (1, 4, 5, 8, 24, 30):
            whole = np.append(ids, np.uint32(1)).astype("<u4")
            want = [
                (i, i * capacity, len(p), zlib.crc32(p.tobytes()))
                for i, p in enumerate(whole[a : a + capacity] for a in range(0, len(whole), capacity))
            ]
            assert list(packing.cut_pieces(iter(parts), capacity, 1)) == want
    assert list(packing.cut_pieces(iter([]), 4, 1)) == [(0, 0, 1, zlib.crc32(b"\1\0\0\0"))]


def fewest(lengths, capacity):
    """Number of bins by trying all packings."""
    best = len(lengths)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for room in set(rooms):
            if room >= lengths[i]:
                left = list(rooms)
                left.remove(room)
                place(i + 1, [*left, room - lengths[i]])
        place(i + 1, [*rooms, capacity - lengths[i]])

    place(0, [])
    return best


def test_bounds_never_exceed_the_fewest_bins():
    draw = random.Random(3)
    met = 0
    for capacity in (10, 13, 24, 60):
        for _ in range(60):
            lengths = sorted((draw.randrange(1, capacity + 1) for _ in range(draw.randrange(1, 10))), reverse=True)
            bound = packing.lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
            least = fewest(lengths, capacity)
            bins, places, fills = packing.best_fit_decreasing(np.array(lengths), capacity)
            assert bound <= least <= len(fills) and fills.max() <= capacity
            met += bound == least
    assert met > 220  # of 240
    assert packing.lower_bound(np.zeros(11, int), 10) == 0
    # Three items of 6 need three bins of 10, which the sum of lengths does not show.
    assert packing.lower_bound(np.bincount([6, 6, 6], minlength=11), 10) == 3


def test_best_fit_takes_the_tightest_bin():
    bins, places, fills = packing.best_fit_decreasing(np.array([2, 7, 5, 3, 3]), 10)
    assert bins.tolist() == [1, 0, 1, 0, 1] and places.tolist() == [8, 0, 0, 7, 5] and fills.tolist() == [10, 10]


def laid_out(rows, capacity):
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("capacity, group", [(4096, 20_000), (64, 4), (16, 3)])
def test_pack_against_brute_force(spark, library, capacity, group):
    long = "many words " * 5000
    rows = [(i, t, "en", "s", 0, 0.5) for i, t in enumerate([*texts(), long])]
    rows += [(3, "a repeated id", None, None, None, None), (3, "a repeated id", None, None, None, None)]
    rows += [(None, "no id", None, None, None, None), (None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    for name in ("piece", "_deal", "_group", "length"):
        docs = docs.withColumn(name, docs.score)
    out = packing.pack(docs, capacity=capacity, group=group)
    assert out.columns == COLUMNS
    found = out.collect()
    want = []
    for row in rows:
        ids = np.array([*library.encode(row[1] or "", add_special_tokens=False).ids, 1], "<u4")
        for i, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            want.append((row[0], i, start, len(part), zlib.crc32(part.tobytes())))
    key = lambda r: tuple(-1 if c is None else c for c in r[:5])
    assert sorted(map(key, found)) == sorted(map(key, want))
    lengths = np.array([w[3] for w in want])
    bound = packing.lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
    used = laid_out(found, capacity)
    assert bound <= used <= bound + 1


def test_exchange_between_partitions_saves_sequences(spark, monkeypatch):
    draw = random.Random(5)
    docs = spark.createDataFrame(
        [(i, "word " * draw.randrange(1, 60)) for i in range(600)], "doc_id long, text string"
    ).repartition(4)
    found = packing.pack(docs, capacity=64, group=30).collect()
    monkeypatch.setattr(packing, "ROUNDS", 0)
    before = laid_out(packing.pack(docs, capacity=64, group=30).collect(), 64)
    lengths = np.array([r["length"] for r in found])
    bound = packing.lower_bound(np.bincount(lengths, minlength=65), 64)
    used = laid_out(found, 64)
    print(bound, used, before)
    assert len(found) == 600 and bound <= used < before and used - bound < (before - bound) / 2


def test_pack_nothing(spark):
    assert packing.pack(spark.createDataFrame([], DOCS)).collect() == []
