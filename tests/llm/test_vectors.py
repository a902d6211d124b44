"""Codes and hard negatives against brute force, on small tables with the odd cases."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattframe.llm import codes, gnat, negatives
from wattframe.llm.vectors import LARGEST

VECTORS = "vec_id long, embedding array<float>, label int, v double, row double, code string"


def vectors(n=300, width=8, seed=1):
    """Clusters, ties, repeated rows, missing and non-finite parts."""
    draw = random.Random(seed)
    centres = [[draw.gauss(0, 1) for _ in range(width)] for _ in range(6)]
    rows = []
    for i in range(n):
        centre = draw.choice(centres)
        spread = draw.choice([0.02, 0.2, 0.5])
        rows.append((i, [float(np.float32(c + draw.gauss(0, spread))) for c in centre], draw.randrange(4)))
    rows += [(n + i, rows[i][1], rows[i][2]) for i in range(0, 40)]  # equal vectors
    rows += [(n + 50 + i, rows[0][1], 1) for i in range(60)]  # a crowd
    rows += [
        (1000, None, 1),
        (1001, [float("nan")] * width, 1),
        (1002, [float("inf"), *rows[0][1][1:]], 1),
        (1003, [None, *rows[0][1][1:]], 1),
        (1004, rows[5][1], None),
        (1005, rows[6][1][: width - 3], 2),
        (1006, [], 2),
        (1007, [1e30, -1e30, *rows[0][1][2:]], 3),
        (1100, rows[9][1], 3),
        (5, rows[5][1], rows[5][2]),  # a row that repeats another in full
        (None, rows[7][1], 0),
    ]
    draw.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0.5, 0.5, "x") for r in rows], VECTORS).repartition(3)


def whole(rows, scale, width):
    kept = []
    for vec_id, v, label in rows:
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ints = [max(-LARGEST, min(LARGEST, math.floor(scale * float(np.float32(x))))) for x in v]
        kept.append((vec_id, label, ints + [0] * (width - len(v))))
    return kept


def test_nearest_is_exact():
    draw = np.random.default_rng(3)
    for width, count, spread in ((1, 5, 3), (4, 40, 5), (16, 256, 100), (3, 17, 2)):
        points = draw.integers(-spread, spread + 1, (400, width))
        entries = draw.integers(-spread, spread + 1, (count, width))
        apart = ((points[:, None] - entries) ** 2).sum(axis=2)
        index, distance = codes.nearest(points, entries)
        assert (index == apart.argmin(axis=1)).all() and (distance == apart.min(axis=1)).all()


def brute_codes(rows, scale=1024, parts=4, entries=256, rounds=4, width=8):
    kept = whole(rows, scale, width)
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    v = np.array([r[2] for r in kept]).reshape(len(kept), parts, -1)
    books = [v[:entries, p].copy() for p in range(parts)]

    def assign():
        apart = [((v[:, p, None] - books[p]) ** 2).sum(axis=2) for p in range(parts)]
        return [a.argmin(axis=1) for a in apart], sum(a.min(axis=1) for a in apart)

    for _ in range(rounds):
        near, _ = assign()
        for p in range(parts):
            for e in set(near[p].tolist()):
                books[p][e] = v[near[p] == e, p].sum(axis=0) // (near[p] == e).sum()
    near, error = assign()
    by_label = {}
    for r, e in zip(kept, error.tolist()):
        by_label[r[1]] = by_label.get(r[1], 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    return [
        (r[0], "".join(f"{near[p][i]:02x}" for p in range(parts)), int(error[i]), by_label[r[1]], digest)
        for i, r in enumerate(kept)
    ]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((c is None, c or 0) for c in r))


@pytest.mark.parametrize("entries", [256, 5])
def test_codes_against_brute_force(spark, entries):
    rows = vectors()
    found = codes.compress(frame(spark, rows), entries=entries)
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert ordered(found.collect()) == ordered(brute_codes(rows, entries=entries))


def test_codes_of_few_rows_and_none(spark):
    rows = [(1, [0.5, -0.25, 1.0], None), (1, [0.5, -0.25, 1.0], None), (2, [], 3)]
    assert ordered(codes.compress(frame(spark, rows)).collect()) == ordered(brute_codes(rows, width=4))
    assert codes.compress(frame(spark, [])).collect() == []
    assert codes.compress(frame(spark, [(1, None, 2)])).collect() == []


def brute_negatives(rows, anchors, width=8, positives=5, negatives_=5):
    kept = whole(rows, 256, width)
    kept = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, v) for i, lab, v in kept if i is not None and lab is not None]
    out = []
    for a, (anchor, label, v) in enumerate(kept):
        if anchor % anchors:
            continue
        scored = [
            (-sum(x * y for x, y in zip(v, other)), i, lab) for b, (i, lab, other) in enumerate(kept) if b != a
        ]
        scored.sort()
        for score, positive, _ in [s for s in scored if s[2] == label][:positives]:
            fits = [s for s in scored if s[2] != label and 80 * -score <= 100 * -s[0] <= 100 * -score]
            for rank, (s, i, _) in enumerate(fits[:negatives_], 1):
                out.append((anchor, positive, rank, i, -score, -s))
    return out


@pytest.mark.parametrize("fanout, depth, block", [(16, 2, 8192), (3, 3, 10), (4, 1, 20)])
def test_negatives_against_brute_force(spark, monkeypatch, fanout, depth, block):
    real = negatives.hard_negatives
    monkeypatch.setattr(
        negatives,
        "hard_negatives",
        lambda rows, anchors: real(rows, anchors, sample=100, fanout=fanout, depth=depth, block=block),
    )
    monkeypatch.setattr(negatives, "ANCHORS", 9)
    rows = vectors()
    found = negatives.mine(frame(spark, rows), every=5)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute_negatives(rows, 5)
    assert len(want) > 300
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)


def test_negatives_without_rows(spark):
    assert negatives.mine(frame(spark, [])).collect() == []
    assert negatives.mine(frame(spark, [(100, [1.0], 1)])).collect() == []
    assert negatives.mine(frame(spark, [(100, [1.0], None), (200, None, 1)])).collect() == []


def test_tree_search_is_exact_and_rules_out_leaves():
    draw = np.random.default_rng(4)
    centres = draw.integers(-300, 300, (12, 6))
    v = centres[draw.integers(0, 12, 3000)] + draw.integers(-9, 10, (3000, 6))
    greatest = int(gnat.lengths(v).max())
    root, leaves = gnat.build(v[:500], greatest, 4, 3)
    leaf = gnat.route(root, v, greatest, learn=True)
    queries = v[:40]
    scores = gnat.products(queries, v)
    top = np.sort(scores, axis=1)[:, -20]
    low, high = top[:, None], np.full((40, 1), gnat.NONE * -1)
    visited = np.zeros((40, leaves), bool)
    for number, here in gnat.reach(root, queries, low, high, greatest):
        visited[here, number] = True
    for q in range(40):
        assert visited[q, leaf[scores[q] >= top[q]]].all()
    assert visited.mean() < 0.5


def test_anchors_go_to_few_blocks(spark):
    draw = np.random.default_rng(6)
    centres = draw.integers(-3000, 3000, (16, 6))
    v = centres[draw.integers(0, 16, 2000)] + draw.integers(-9, 10, (2000, 6))
    rows = spark.createDataFrame(
        [(i, i, int(i % 3), [int(x) for x in r]) for i, r in enumerate(v)],
        "row long, vec_id long, label long, v array<int>",
    )
    index = negatives.Index(rows, 500, 8, 2, 50)
    low, high = 10_000, 1 << 61
    queries = index.blocks.filter("vec_id % 50 = 0").select(
        F.col("row").alias("key"), "vec_id", "label", "v", "leaf",
        F.expr("array(aggregate(v, 0L, (a, x) -> a + x * x) * 99 div 100)").alias("low"),
        F.array(F.lit(high)).alias("high"),
        F.array(F.lit(low).cast("long")).alias("positive_id"),
        F.array(F.lit(low).cast("long")).alias("positive_score"),
    )
    every = 40 * index.blocks.select("block").distinct().count()
    assert index.blocks.groupBy("block").count().agg({"count": "max"}).first()[0] < 150
    assert 40 <= index.visits(queries).count() < every / 2
