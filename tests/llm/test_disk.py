"""What the operators leave on disk, and what they move."""

import os
import random
import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from wattframe.llm import decontam, lines, ngrams
from wattframe.llm.common import CLEANUP, settled, ship, written
from wattframe.session import shared_dir


def shuffles(spark):
    """Numbers of the shuffles that have files on disk."""
    found = set()
    for top in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString():
        for _, _, names in os.walk(top):
            found |= {int(m[1]) for n in names if (m := re.match(r"shuffle_(\d+)_", n))}
    return found


def tables(spark):
    return set(os.listdir(shared_dir(spark).removeprefix("file://")))


def test_written_tables_leave_no_shuffle_files(spark):
    rows = spark.range(5000).withColumn("k", F.col("id") % 50).repartition("k")
    rows = rows.groupBy("k").agg(F.sum("id").alias("s"))
    assert rows.count() == 50
    before, setting = shuffles(spark), spark.conf.get(CLEANUP, None)
    found = written(rows, "sums")
    assert shuffles(spark) <= before
    assert spark.conf.get(CLEANUP, None) == setting
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, rows.collect()))


def test_settled_tables_leave_none_of_those_before(spark):
    def make():
        first = written(spark.range(20), "first")
        inner = settled(lambda: written(first.filter("id > 4"), "second").filter("id < 9"), "inner")
        return inner.join(first, "id")

    before = tables(spark)
    found = settled(make, "found")
    assert {t.split("-")[0] for t in tables(spark) - before} == {"found"}
    assert sorted(r.id for r in found.collect()) == [5, 6, 7, 8]


def test_stages_leave_their_findings_only(spark):
    draw = random.Random(4)
    text = [" ".join(f"w{draw.randrange(500)}" for _ in range(80)) for _ in range(6)]
    question = "A train with 12 wagons leaves from Boston at 9 km and then it goes on to the next stop by noon"
    twin = text[0].rsplit(" ", 1)[0] + " other"
    rows = [*enumerate(text), (6, twin), (7, text[1] + "\n" + text[2]), (8, question), (None, text[3]), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, question)], "item_id long, text string")
    stages = {
        "gone": (lambda: lines.unique_lines(docs), [0, 1, 2, 3, 4, 5, 6, 8, 9]),
        "later": (lambda: ngrams.one_of_each(docs, 5, 80), [0, 1, 2, 3, 4, 5, 7, 8, 9]),
        "leaks": (lambda: decontam.drop_leaks(docs, items), [0, 1, 2, 3, 4, 5, 6, 7, 9, None]),
    }
    for name, (stage, want) in stages.items():
        before = tables(spark)
        out = stage()
        assert {t.split("-")[0] for t in tables(spark) - before} == {name}
        found = [r.doc_id for r in out.collect()]
        assert sorted(found, key=str) == sorted(want, key=str)


def test_the_pipeline_keeps_its_last_table_only(spark, tmp_path):
    draw = random.Random(9)
    known = {"en": "the cat sat on a mat and then it went to the shop", "de": "der Hund ist nicht im Haus und die Katze schläft"}
    rows = []
    for i in range(120):
        lang = ("en", "de")[i % 2]
        rows.append((i, " ".join(draw.choice(known[lang].split()) for _ in range(60)), lang, "s", 0, 0.5))
    question = "The train with 12 wagons leaves from Boston at 9 km and then it goes on to the next stop by noon"
    rows += [(120, rows[0][1], "en", "s", 0, 0.5), (121, question, "en", "s", 0, 0.5)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, score double"
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/documents.parquet")
    items = spark.createDataFrame([(1, question)], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    want = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        want = stage(spark, want, str(tmp_path))
    want = sorted(map(tuple, want.collect()), key=str)
    before = tables(spark)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {t.split("-")[0] for t in tables(spark) - before} == {"benchmark"}
    assert 100 <= len(want) <= 120 and sorted(map(tuple, out.collect()), key=str) == want


def test_sketches_tell_large_sets_apart(spark):
    """Unrelated sets are ruled out at any size, and no pair that is near: also if one sketch is folded."""
    draw = random.Random(3)
    texts = []
    for n in (5, 300, 510, 600, 1020, 1300, 2000, 2100, 4700):
        base = [f"w{n}x{i}" for i in range(n)]
        changed = list(base)
        for _ in range(n // 40):
            changed[draw.randrange(n)] = f"c{draw.random()}"
        texts += [base, changed, base[: -max(1, n // 12)]]
    ship(spark)
    docs = spark.createDataFrame([(" ".join(t),) for t in texts], "text string")
    sets = ngrams.sets_of(docs, 5)
    whole = {r.sid: set(np.frombuffer(r.tokens, np.uint64).tolist()) for r in sets.collect()}
    one, two = (sets.drop("tokens").alias(name) for name in ("one", "two"))
    for near in (80, 30):
        met = one.join(two, (F.col("one.sid") < F.col("two.sid")) & ngrams.may_be_near("one", "two", near))
        passed = {tuple(r) for r in met.select("one.sid", "two.sid").collect()}
        like = {}
        for a in whole:
            for b in whole:
                if a < b:
                    like[a, b] = 100 * len(whole[a] & whole[b]) / len(whole[a] | whole[b])
        assert {pair for pair, x in like.items() if x >= near} <= passed
        if near == 80:
            assert not [pair for pair in passed if like[pair] == 0]


def test_sets_that_are_in_no_pair_do_not_move(spark):
    draw = random.Random(6)
    common = " ".join(f"c{i}" for i in range(5))
    far = [common + " " + " ".join(f"w{draw.randrange(10**6)}" for _ in range(90)) for _ in range(30)]
    near = " ".join(f"n{i}" for i in range(90))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*far, near, near + " x"])], "doc_id long, text string")
    ship(spark)
    sets = written(ngrams.sets_of(docs, 5), "sets")
    pairs = sets.select(F.col("sid").alias("a")).crossJoin(sets.select(F.col("sid").alias("b"))).filter("a < b")
    found = ngrams.near_pairs(pairs, sets, 80)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan
    assert found.count() == 1
