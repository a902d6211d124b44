"""Operators for training text against brute force, on small tables with the odd cases."""

import hashlib
import random
import re

import pytest

from tests.conftest import plan_of
from wattframe.llm import (
    bpe,
    decontam,
    exact,
    langid,
    lines,
    ngrams,
    passages,
    substrings,
    toxicity,
    warc,
)
from wattframe.llm.common import new_folder
from wattframe.llm.queries import ORACLE, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double"


def words(n, seed):
    draw = random.Random(seed)
    return [draw.choice("ab cde fgh ij klm nop qrs tu vwx yz été".split()) + str(draw.randrange(60)) for _ in range(n)]


def texts():
    long = words(400, 1)
    near = list(long)
    near[200] = "changed"
    return [
        " ".join(long),
        " ".join(long),
        " ".join(near),
        " ".join(words(90, 2) + long[50:120] + words(30, 3)),
        " ".join(words(5, 4)),
        " ".join(words(5, 4)),
        "one two",
        "",
        None,
        " \t\n ",
        "A line of text here\nA line of texts here\nshort\nshort\n" + " ".join(words(60, 5)),
        " ".join(words(60, 6)) + "\n" + " ".join(words(60, 5)),
        "x" * 5000,
        " ".join(["same"] * 300),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if t else None, "s", 0, 0.5) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_exact_groups(docs, nothing):
    groups = {}
    for i, t in enumerate(texts()):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    want = {
        (i, g[0], len(g), i == g[0], sha(t.encode())) for t, g in groups.items() for i in g
    }
    assert {tuple(r) for r in exact.exact_groups(docs).collect()} == want
    assert exact.exact_groups(nothing).collect() == []


def test_exact_groups_of_repeated_and_missing_ids(spark):
    rows = spark.createDataFrame([(None, "a"), (2, "a"), (2, "a"), (None, "b")], "doc_id long, text string")
    out = exact.exact_groups(rows).collect()
    assert sorted((r["keep_id"], r["group_size"]) for r in out if r["group_size"] > 1) == [(2, 3)] * 3
    assert sum(r["kept"] for r in out) == 2


def test_substrings(docs, nothing):
    data = [(i, (t or "").encode()) for i, t in enumerate(texts())]
    seen = {}
    for i, b in data:
        for k in range(len(b) - 199):
            seen[b[k : k + 200]] = seen.get(b[k : k + 200], 0) + 1
    want = set()
    for i, b in data:
        gone = [False] * len(b)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = [True] * 200
        spans = sum(g and not h for g, h in zip(gone, [False] + gone))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want.add((i, len(b), sum(gone), spans, sha(kept)))
    assert {tuple(r) for r in substrings.substring_removal(docs).collect()} == want
    assert substrings.substring_removal(nothing).collect() == []


def test_substrings_of_a_crowded_core(spark, monkeypatch):
    draw = random.Random(9)
    letters = lambda n: "".join(draw.choice("abcdefgh") for _ in range(n))
    passage = letters(400)
    data = [letters(260) + passage + letters(260) for _ in range(40)]
    data += [data[0][:250] + letters(50), data[1][240:] + data[0]]
    fit = 5
    monkeypatch.setattr(substrings, "SHARD", fit * (substrings.WINDOW + substrings.OFFSETS))
    sort, most = substrings.sorted_repeats, []

    def spied(docs, ranges, count):
        most.append(max([r["count"] for r in ranges.groupBy("core").count().collect()], default=0))
        return sort(docs, ranges, count)

    monkeypatch.setattr(substrings, "sorted_repeats", spied)
    seen = {}
    for t in data:
        for k in range(len(t) - 199):
            seen[t[k : k + 200]] = seen.get(t[k : k + 200], 0) + 1
    want = {}
    for i, t in enumerate(data):
        gone = [False] * len(t)
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                gone[k : k + 200] = [True] * 200
        want[i] = "".join(x for x, g in zip(t, gone) if not g).encode()
    docs = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string")
    assert {r["doc_id"]: bytes(r["kept"]) for r in substrings.remove_substrings(docs).collect()} == want
    assert most[0] <= fit


def test_passages(docs, nothing):
    first, want = {}, set()
    for i, t in enumerate(texts()):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first.setdefault(tuple(w[k : k + 50]), i) < i:
                gone[k : k + 50] = [True] * 50
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want.add((i, len(w), sum(gone), sha(kept.encode())))
    assert {tuple(r) for r in passages.substring_dedup(docs).collect()} == want
    assert passages.substring_dedup(nothing).collect() == []


@pytest.mark.parametrize("base", [3, 7, 25, 50])
def test_passages_of_repeated_and_missing_ids_from_any_base(spark, base):
    long = words(400, 21)
    rows = [
        (5, " ".join(long[:200])),
        (5, " ".join(long[100:300])),  # one document with the row above
        (9, " ".join(long[140:260] + words(70, 22))),
        (2, " ".join(words(60, 23) + long[230:290])),
        (11, " ".join(long[:49])),
        (12, " ".join(long[150:199] + ["other"] + long[200:249])),
        (None, " ".join(long[:100])),
        (13, None),
        (14, " ".join(words(150_000, 24) + long[:80] + words(150_000, 25))),  # beyond a MiB
        (15, " ".join(long[20:75] + words(150_000, 24))),
    ]
    first, want = {}, []
    for i, t in rows:
        w = (t or "").split()
        for k in range(len(w) - 49):
            if i is not None:
                key = tuple(w[k : k + 50])
                first[key] = min(first.get(key, i), i)
    for i, t in rows:
        w = (t or "").split()
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        want.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("at", lines.F.lit(1)).repartition(3)
    found = [tuple(r) for r in passages.remove_repeats(df, base=base).collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, want))
    assert sum(r[2] > 0 for r in want) >= 4


def test_ngram_components(docs, nothing):
    sets = []
    for t in texts():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        k = min(4, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    parent = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((parent[i], parent[j]))
                parent = [a if p == b else p for p in parent]
    want = {(i, len(s), parent[i]) for i, s in enumerate(sets)}
    assert {tuple(r) for r in ngrams.jaccard_components(docs).collect()} == want
    assert ngrams.jaccard_components(nothing).collect() == []
    stay = {r["doc_id"] for r in ngrams.one_of_each(docs).collect()}
    assert stay == {i for i, p in enumerate(parent) if i == p}


def test_ngram_components_of_other_lengths_and_thresholds(spark):
    import corpus_pipeline

    base = [f"w{i}" for i in range(200)]
    data = [base]
    for changes in range(1, 8):  # around 0.8 of 5-word shingles
        data.append([f"x{i}" if i in range(10, 10 + 11 * changes, 11) else w for i, w in enumerate(base)])
    for size in (3, 4, 5, 6, 9, 40, 41, 44, 45, 46, 50, 51):
        data.append([f"y{i}" for i in range(size)])
    data.append([])
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(data)], "doc_id long, text string")

    def brute(length, near):
        sets = [{tuple(w[i : i + length]) for i in range(max(1, len(w) - length + 1))} if w else set() for w in data]
        parent = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                if sets[i] and 100 * len(sets[i] & sets[j]) >= near * len(sets[i] | sets[j]):
                    a, b = sorted((parent[i], parent[j]))
                    parent = [a if p == b else p for p in parent]
        return {(i, len(s), parent[i]) for i, s in enumerate(sets)}

    assert brute(5, 80) != brute(4, 85)
    assert {tuple(r) for r in ngrams.jaccard_components(df, 5, 80).collect()} == brute(5, 80)
    stay = {r["doc_id"] for r in corpus_pipeline.near_copies(spark, df, "").collect()}
    assert stay == {i for i, _, c in brute(5, 80) if i == c}
    for size in (1, 6, 14, 333, 5000):
        bands = {ngrams.band(s, 80)[0] for s in range((size * 80 + 99) // 100, size * 100 // 80 + 1)}
        assert max(bands) - min(bands) <= 2
        assert all(1 <= needed <= segments for _, segments, needed in ngrams.schemes(size, 80))


@pytest.mark.parametrize("size", [1, 6, 7, 13, 14, 40, 333, 5000])
def test_schemes_pay_for_every_difference(size):
    bands = {ngrams.band(s)[0] for s in range((size * 85 + 99) // 100, size * 100 // 85 + 1)}
    assert max(bands) - min(bands) <= 2
    for _, segments, needed in ngrams.schemes(size):
        assert 1 <= needed <= segments


def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a == b or a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def test_lines(spark, nothing):
    draw = random.Random(5)
    base = ["the quick brown fox", "aaaaaaaaaaaa", "été 😀😀 über alles", "x" * 300 + "y"]

    def changed(line):
        line = list(line)
        for _ in range(draw.randrange(3)):
            i = draw.randrange(len(line))
            line[i : i + draw.randrange(2)] = draw.choice(["", "a", "é", "😀"])
        return "".join(line)

    rows = [
        (d, "\n".join(changed(draw.choice(base)) for _ in range(draw.randrange(8))) if d % 7 else None)
        for d in range(25)
    ] + [(3, ""), (4, "short\nshort\n\n\nshore"), (40, "shore\n\nshort"), (None, "short\nx")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("line", lines.F.lit("clash"))
    keys = {(r["doc_id"], r["text"]): r["text_hash"] for r in lines.with_hash(df).collect()}
    every = sorted(
        ((d, keys[d, t or ""], i, x) for d, t in rows for i, x in enumerate((t or "").split("\n")) if x),
        key=lambda r: (r[0] is None, r[0] or 0, *r[1:]),
    )

    def repeats(line, earlier):
        # Lines below the bound have no near ones.
        short = min(len(line), len(earlier)) < lines.MIN_CHARS
        return line == earlier if short else near(line, earlier)

    gone = {o[:3] for k, o in enumerate(every) if any(repeats(o[3], p[3]) for p in every[:k])}
    want = []
    for d, t in rows:
        kept = [x for i, x in enumerate((t or "").split("\n")) if (d, keys[d, t or ""], i) not in gone]
        want.append((d, "\n".join(kept)))
    found = [(r["doc_id"], r["text"] or "") for r in lines.dedup_lines(df).collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert gone and sorted(found, key=order) == sorted(want, key=order)
    assert lines.unique_lines(df).columns == df.columns
    assert lines.dedup_lines(nothing).collect() == []


def test_bpe_equals_the_library(docs, nothing):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    vocabulary = bpe.Vocabulary(bpe.content(None))
    draw = random.Random(1)
    parts = ["a", "th", " the", "  ", "\n", "'s", "12", "é", "中", "😀", "\x1c", "ª", "<|endoftext|>", "\x00"]
    for _ in range(1500):
        text = "".join(draw.choice(parts) for _ in range(draw.randrange(14)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert vocabulary.encode(text) == ids
        assert vocabulary.decode(ids) == library.decode(ids, skip_special_tokens=False)
    want = set()
    for i, t in enumerate(texts()):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.add((i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert {tuple(r) for r in bpe.round_trip(docs).collect()} == want
    again = bpe.decode(bpe.encode(docs)).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in again)
    assert bpe.tokenize(nothing).collect() == []


def test_warc(spark):
    rows = [(5, "http://a/ b", "same"), (2, None, "same"), (9, "u", None), (7, "u", ""), (None, "u", "same"), (1, "é", "one\r\n\r\ntwo")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    found = {r["page_id"]: r for r in warc.archive(pages).collect()}
    assert {i: (r["record_type"], r["refers_to"]) for i, r in found.items()} == {
        5: ("revisit", 2), 2: ("response", None), 9: ("revisit", 7), 7: ("response", None),
        None: ("revisit", 2), 1: ("response", None),
    }
    assert found[None]["payload_bytes"] == 4 and found[9]["payload_digest"] == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    folder = new_folder(spark, "warc")
    index = warc.write_bundles(pages, folder)
    one = warc.read_records(index.filter("page_id = 1"), folder).collect()
    assert [bytes(r["payload"]) for r in one] == [b"one\r\n\r\ntwo"]
    assert warc.archive(pages.limit(0)).collect() == []


def test_warc_over_frames_and_bundles(spark):
    rows = [(i % 30, f"http://u/{i % 4}", f"page {i % 7} " * (i % 13)) for i in range(60)]
    rows += [(3, "http://u/3", rows[3][2]), (100, "http://long", "ß" * 1_100_000), (None, None, "alone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder = new_folder(spark, "warc")
    index = warc.write_bundles(pages, folder, frame_bytes=700, bundle_bytes=3000)
    places = index.collect()
    assert len(places) == len(rows) and len({r["file"] for r in places}) > 3 and max(r["frame"] for r in places) > 1
    records = warc.read_records(index, folder).collect()
    texts = {(i, u or "urn:page:None"): t for i, u, t in rows}
    held = {r["record_id"]: bytes(r["payload"]) for r in records if r["record_type"] == "response"}
    for r in records:
        text = texts[r["page_id"], r["target_uri"]].encode()
        assert r["payload_bytes"] == len(text)
        # A revisit's reference leads to the record that holds the payload.
        assert held[r["refers_to_record"] or r["record_id"]] == text
    named = {}
    for r in records:
        named.setdefault(r["record_id"], set()).add((r["page_id"], r["target_uri"], r["payload_digest"]))
    assert all(len(v) == 1 for v in named.values()) and len(named) == len(set(rows))
    some = [r["refers_to_record"] for r in records if r["refers_to_record"]][:5] + [None, "<urn:uuid:none>"]
    wanted = spark.createDataFrame([(x, 1) for x in some], "record_id string, file int")
    found = warc.find_records(index, folder, wanted).collect()
    assert {r["record_id"] for r in found} == set(some[:-2])


def test_decontamination(spark):
    question = "A train with 12 wagons leaves from Boston at 9 km and then it goes on to the next stop by noon"
    other = "A train with 15 wagons leaves from Denver at 7 km and then it goes on to the next stop by noon"
    mixed = "Take 3 apples and then 3 more apples and give the rest of those 3 apples to him"
    broken = "Take 4 apples and then 5 more apples and give the rest of those 6 apples to him"
    items = spark.createDataFrame([(1, question), (2, mixed), (3, None), (4, "Yes")], "item_id long, text string")
    rows = [(1, "So. " + question), (2, other.upper()), (3, other), (4, broken), (5, "Nothing of it at all, is there?"), (6, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["changed_slots"] for r in decontam.leaks(docs, items).collect()}
    assert found[1, 1] == 0 and found[3, 1] >= 3
    assert {d for d, _ in found} <= {1, 2, 3}
    assert {r["doc_id"] for r in decontam.drop_leaks(docs, items).collect()} >= {4, 5, 6, 7}
    assert decontam.leaks(docs, items.limit(0)).collect() == []


def test_decontamination_of_names_and_case(spark):
    question = "When John Smith drove 12 miles out of New York with Mary he had 7 hours to get there by noon"
    renamed = "When Anna Maria Jones drove 15 miles out of Los Angeles with Tom she had 9 hours to get there by noon"
    renamed = renamed.replace(" she ", " he ")
    first = "John F. Kennedy gave 3 apples to Mary, and then Mary gave 2 of them back to him"
    other = "Lyndon Johnson gave 5 apples to Anna, and then Anna gave 4 of them back to him"
    wrong = "Lyndon Johnson gave 5 apples to Anna, and then Tom gave 4 of them back to him"
    items = spark.createDataFrame([(1, question), (2, first)], "item_id long, text string")
    texts = [question.upper(), question.lower(), renamed, "Well: " + first, other, wrong, first.upper().replace("3", "8")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]): (r["coverage"], r["changed_slots"]) for r in decontam.leaks(docs, items).collect()}
    assert set(found) == {(0, 1), (1, 1), (2, 1), (3, 2), (4, 2), (6, 2)}
    assert found[0, 1] == found[1, 1] == (1.0, 0) and found[2, 1] == (1.0, 5) and found[4, 2] == (1.0, 4)
    # Tokens with and without values stand at the same places.
    odd = ["3 km of {a} #@& 4,5 O'Brien-Smith in J. K. Rowling. The 7kg", "ÉTÉ Straße 1.2.3 Mr Jones", "", None]
    rows = spark.createDataFrame([(t,) for t in odd], "text string")
    for named in (False, True):
        pair = [decontam.marked(decontam.F.col("text"), named, values) for values in (False, True)]
        for bare, valued in rows.select(*pair).collect():
            assert bare == [t[0] if t[0] in "#@&" else t for t in valued]


def test_decontamination_judges_every_alignment(spark):
    item = "Take 3 apples and then 3 more apples and give the rest of those 3 apples to him"
    sibling = "Take 4 apples and then 5 more apples and give the rest of those 6 apples to him"
    long = " ".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60))
    parted = long.split()
    items = spark.createDataFrame([(1, item), (2, long)], "item_id long, text string")
    rows = [
        (1, sibling + ". " + item),
        (2, item + ". " + sibling),
        (3, sibling + ". " + sibling),
        (4, " ".join(parted[:30] + ["added"] + parted[30:])),
        (5, ". ".join([sibling] * 3 + [item.replace("3", "8")] + [sibling])),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["changed_slots"] for r in decontam.leaks(docs, items).collect()}
    assert found == {(1, 1): 0, (2, 1): 0, (4, 2): 0, (5, 1): 1}


def test_language(spark, nothing):
    known = [("en", "the cat and the dog with this"), ("de", "der hund und die katze nicht"), ("fr", "le chien est avec une autre")]
    rows = [(i, known[i % 3][1] + f" {i}", known[i % 3][0]) for i in range(90)]
    rows += [(100, None, "en"), (101, "123 !", "de"), (None, "und der hund", None), (103, "the dog", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in langid.identify_languages(docs).collect()}
    assert all(found[i]["lang_pred"] == known[i % 3][0] for i in range(90))
    assert found[100]["lang_pred"] == found[101]["lang_pred"] == "und" and found[100]["score"] == 0
    assert found[None]["lang_pred"] == "de" and not found[None]["held_out"]
    kept = langid.reject_unknown(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()}.isdisjoint({100, 101})
    assert langid.identify_languages(nothing).collect() == []


def test_toxicity_in_grades(spark, nothing):
    draw = random.Random(2)
    rows = []
    for i in range(300):
        grade = i % 3
        some = words(20, i) + ["", "rude", "vile"][grade : grade + 1] * 2
        draw.shuffle(some)
        rows.append((i, " ".join(some), grade))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = docs.select("doc_id", "toxic")
    found = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    right = sum(found[i]["toxic"] == (i % 3 > 0) for i in found)
    assert right >= 290 and sum(found[i]["grade"] == i % 3 for i in found) >= 270
    assert found[2]["expected_severity"] > found[1]["expected_severity"] > found[0]["expected_severity"]
    model = toxicity.fit(docs, toxicity.severity(labels.limit(0)))
    odd = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert not any(r["toxic"] for r in toxicity.grade(odd, model).collect())
    assert toxicity.toxicity(nothing, labels).collect() == []


def test_every_operator_is_registered():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES} == set(range(1, 14))
    assert set(ORACLE) <= set(QUERIES)


def test_stages_tell_rows_apart_by_id_and_text(spark):
    base = words(60, 11)
    near_copy = [*base[:-1], "other"]
    unrelated = words(60, 12)
    rows = [
        (3, " ".join(base)),
        (5, " ".join(near_copy)),
        (5, " ".join(unrelated)),
        (None, " ".join([*base[:-1], "third"])),
        (None, " ".join(words(60, 13))),
        (7, None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("__gone", "_id", "_hash", "text_hash", "row", "sid"):
        df = df.withColumn(name, lines.F.lit(1))
    kept = ngrams.one_of_each(df, 5, 80)
    assert kept.columns == df.columns
    left = {(r["doc_id"], r["text"]) for r in kept.collect()}
    assert left == {rows[0], rows[2], rows[4], rows[5]}
    found = ngrams.jaccard_components(df).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in found) == [
        (-1, -1), (-1, 3), (3, 3), (5, 3), (5, 5), (7, 7)
    ]
    # Components without any id are linked all the same.
    nameless = df.withColumn("doc_id", lines.F.lit(None).cast("long"))
    assert {r["text"] for r in ngrams.one_of_each(nameless, 5, 80).collect()} >= {rows[2][1], rows[4][1]}
    assert ngrams.one_of_each(nameless, 5, 80).count() == 4

    question = "A train with 12 wagons leaves from Boston at 9 km and then it goes on to the next stop by noon"
    items = spark.createDataFrame([(1, question)], "item_id long, text string")
    leaky = df.unionByName(df.limit(1).withColumn("text", lines.F.lit(question)).withColumn("doc_id", lines.F.lit(5).cast("long")))
    kept = decontam.drop_leaks(leaky, items)
    assert kept.columns == df.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, df.collect()))


def test_links_of_groups_with_many_near_copies(spark):
    draw = random.Random(8)
    rows = []
    for group in range(3):
        base = words(70, 100 + group)
        for _ in range(60):
            text = list(base)
            for _ in range(draw.randrange(4)):
                text[draw.randrange(70)] = f"w{draw.randrange(10**6)}"
            rows.append((len(rows), " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    sets = [{tuple(t.split()[i : i + 4]) for i in range(67)} for _, t in rows]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                x, y = sorted((root(i), root(j)))
                label[y] = x
    want = {(i, len(sets[i]), root(i)) for i in range(len(rows))}
    assert {tuple(r) for r in ngrams.jaccard_components(df).collect()} == want


def test_joins_without_hot_groups_are_plain(spark):
    rows = [(i, f"a line that stands in each text\nsome line, and here is number {i * 7919}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert "LeftAnti" not in plan_of(lines.drop_lines(df))
    kept = {r["doc_id"]: r["text"] for r in lines.dedup_lines(df).collect()}
    assert sum("stands" in text for text in kept.values()) == 1 and "stands" in kept[0]


def test_hot_groups_of_equal_and_near_lines(spark):
    n = 1200  # more than a group may have without being hot
    rows = [(i, f"a line that stands in each text\nnear lines but for {chr(0x4E00 + i)} here") for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert "LeftAnti" in plan_of(lines.drop_lines(df))
    found = {r["doc_id"]: (r["n_lines"], r["n_removed"]) for r in lines.dedup_lines(df).collect()}
    assert found == {i: (2, 2 if i else 0) for i in range(n)}
