"""Language identification: averaged hashed subword embeddings under a linear softmax.

Subwords are the 1 to 4 byte pieces of lower-cased words, with a space as word mark; digits and ASCII
punctuation count as spaces. Each is hashed into one of ``BUCKETS`` rows of an embedding table. A text
is the mean of its subwords' embeddings; a linear softmax over it gives the languages. Both tables are
trained by stochastic gradient descent in numpy on a bounded sample. A temperature, fitted on sampled
rows that training does not see, calibrates the scores; texts that score below ``min_score`` are
rejected.

After training, embeddings and softmax are multiplied into one score per bucket and language, so a
prediction is one look-up and one sum per subword, over whole texts, in pieces of bounded size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattframe.llm.common import free_name, ship

BUCKETS = 1 << 15
ORDERS = (1, 2, 3, 4)
PIECE = 1 << 19
UNKNOWN = "und"

_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def subwords(data: np.ndarray, start: int, stop: int):
    """Yield ``(starts, buckets)`` for each order: subwords of ``data`` that start in [start, stop)."""
    view = data[start : stop + ORDERS[-1] - 1]
    blank = view == 32
    code = view.astype(np.uint32)
    inner = np.zeros(len(view), bool)  # whether a byte strictly inside is blank
    for n in ORDERS:
        if n > 1:
            if n > 2:
                inner = inner[:-1] | blank[n - 2 : len(view) - 1]
            else:
                inner = inner[:-1]
            code = (code[:-1] << np.uint32(8)) | view[n - 1 :]
        if not len(code):
            return
        good = ~inner
        good &= ~(blank[: len(code)] & blank[n - 1 : n - 1 + len(code)])
        at = np.flatnonzero(good[: stop - start])
        mixed = code[at] * np.uint32(2654435761) + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x85EBCA6B)
        yield at + start, mixed >> np.uint32(32 - 15)


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes of all texts, each between spaces, and where each begins."""
    parts = [t.lower().encode() for t in texts]
    begins = np.cumsum([0] + [len(p) + 1 for p in parts])[:-1]
    raw = np.frombuffer(b" " + b" ".join(parts) + b" ", np.uint8)
    return _FOLD[raw], begins


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and how often each occurs; never more than ``BUCKETS`` of them."""
    data, _ = joined([text])
    total = np.zeros(BUCKETS, np.int64)
    for start in range(0, len(data), PIECE):
        for _, bucket in subwords(data, start, min(start + PIECE, len(data))):
            total += np.bincount(bucket, minlength=BUCKETS)
    found = np.flatnonzero(total)
    return found, total[found]


@dataclass
class LanguageModel:
    languages: list[str]
    scores: np.ndarray  # bucket x language
    bias: np.ndarray
    temperature: float
    min_score: float

    def logits(self, texts: list[str]) -> np.ndarray:
        data, begins = joined(texts)
        total = np.zeros((len(texts), len(self.languages)))
        n = np.zeros(len(texts))
        for start in range(0, len(data), PIECE):
            for at, bucket in subwords(data, start, min(start + PIECE, len(data))):
                if not len(at):
                    continue
                owner = np.searchsorted(begins, at, "right") - 1
                first = np.flatnonzero(np.diff(owner, prepend=-1))
                total[owner[first]] += np.add.reduceat(self.scores[bucket], first, axis=0)
                n[owner[first]] += np.diff(first, append=len(at))
        return total / np.maximum(n, 1)[:, None] + self.bias

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The best language of each text and its calibrated probability."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        p = softmax(self.logits(texts) / self.temperature)
        best = p.argmax(axis=1)
        return [self.languages[i] for i in best], p[np.arange(len(texts)), best]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(
    rows: list[tuple[str, np.ndarray, np.ndarray]],
    held: list[tuple[str, np.ndarray, np.ndarray]],
    size: int = 16,
    epochs: int = 5,
    rate: float = 1.0,
    min_score: float = 0.4,
) -> LanguageModel:
    """Fit on rows of (language, buckets, counts); ``held`` rows calibrate."""
    languages = sorted({r[0] for r in rows})
    number = {x: i for i, x in enumerate(languages)}
    draw = np.random.default_rng(7)
    k = len(languages)
    table = draw.uniform(-1, 1, (BUCKETS, size)).astype(np.float32) / size
    weight, bias = np.zeros((size, k), np.float32), np.zeros(k, np.float32)
    steps, done = max(1, epochs * len(rows)), 0
    for _ in range(epochs):
        for i in draw.permutation(len(rows)):
            language, at, n = rows[i]
            done += 1
            if not len(at):
                continue
            share = (n / n.sum()).astype(np.float32)
            mean = share @ table[at]
            error = softmax(mean @ weight + bias)
            error[number[language]] -= 1
            step = np.float32(rate * (1 - done / (steps + 1)))
            back = weight @ error
            weight -= step * np.outer(mean, error)
            bias -= step * np.float32(0.1) * error
            table[at] -= step * share[:, None] * back * np.float32(size)
    scores = table @ weight
    known = [(number[x], a, n) for x, a, n in held if x in number and len(a)]
    temperature = 1.0
    if known and k > 1:
        z = np.array([(n / n.sum()) @ scores[a] + bias for _, a, n in known])
        right = np.array([x for x, _, _ in known])
        tried = np.geomspace(0.05, 20, 60)
        loss = [-np.log(softmax(z / t)[np.arange(len(z)), right] + 1e-12).mean() for t in tried]
        temperature = float(tried[int(np.argmin(loss))])
    return LanguageModel(languages, scores, bias, temperature, min_score)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; -1 for a missing id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5, F.lit(-1))


def fit(docs: DataFrame, max_rows: int = 4000, min_score: float = 0.4) -> LanguageModel:
    """Learn from text and language of rows whose fold is 1 to 4; fold 1 only calibrates.

    At most about ``max_rows`` rows are used, as many of each language as there are, and never more
    than twice as many in all; they are chosen by a hash of id and text. Their texts are turned into at
    most ``BUCKETS`` counts each on the executors. Rows without text or language do not count. The
    languages themselves must be few enough for a list.
    """
    spark = docs.sparkSession
    ship(spark)
    known = docs.filter("text IS NOT NULL AND lang IS NOT NULL").select(
        F.col("lang"), F.col("text"), fold(F.col("doc_id")).alias("fold"), F.col("doc_id")
    )
    known = known.filter("fold > 0")
    there = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not there:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, min_score)
    shares = [x for k, n in there.items() for x in (F.lit(k), F.lit(max_rows / len(there) / n))]
    chance = F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 40) - 1)) / float(1 << 40)
    sample = (
        known.withColumn("chance", chance)
        .filter(F.col("chance") < F.create_map(*shares)[F.col("lang")])
        .orderBy("chance", "lang")
        .limit(2 * max_rows)
    )

    def count(batches):
        for pdf in batches:
            pairs = [counts(t) for t in pdf["text"]]
            yield pd.DataFrame(
                {
                    "lang": pdf["lang"],
                    "fold": pdf["fold"],
                    "chance": pdf["chance"],
                    "at": [p[0].astype(np.int32) for p in pairs],
                    "n": [p[1].astype(np.int32) for p in pairs],
                }
            )

    kind = "lang string, fold long, chance double, at array<int>, n array<int>"
    found = sample.repartition(8).mapInPandas(count, kind).toArrow()
    data = []
    for lang, part, chance, at, n in zip(
        *(found.column(c) for c in ("lang", "fold", "chance", "at", "n"))
    ):
        data.append(
            (chance.as_py(), lang.as_py(), part.as_py(), at.values.to_numpy(), n.values.to_numpy())
        )
    data.sort(key=lambda r: (r[0], r[1], len(r[3])))
    rows = [(r[1], r[3], r[4]) for r in data if r[2] != 1]
    held = [(r[1], r[3], r[4]) for r in data if r[2] == 1]
    # Small tables may have no row of a language outside the calibration fold.
    rows += [r for r in held if r[0] not in {x[0] for x in rows}]
    return train(rows, held, min_score=min_score)


def predictor(model: LanguageModel):
    """Column function: text to (lang_pred, score). Texts with no letter must be masked by the caller."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(text: pd.Series) -> pd.DataFrame:
        texts = [t or "" for t in text]
        names, score = model.predict(texts) if texts else ([], [])
        return pd.DataFrame({"lang_pred": names, "score": np.round(score, 5)})

    return predict


def identify(docs: DataFrame, model: LanguageModel, into: str = "language") -> DataFrame:
    """All rows and columns of ``docs``, and a struct ``into``: lang_pred, score, rejected.

    - Null texts, empty texts and texts without any letter: ``und``, score 0, rejected.
    - Texts that score below ``model.min_score`` are rejected, but keep their best language.
    - A model that has learned nothing gives ``und`` for all.
    - Equal texts get equal results; other columns are not looked at.
    """
    ship(docs.sparkSession)
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    guess = free_name(docs, "guess")
    text = F.when(letter, F.col("text")).otherwise(F.lit(""))
    out = docs.withColumn(guess, predictor(model)(text))
    name = F.when(letter, F.col(guess)["lang_pred"]).otherwise(F.lit(UNKNOWN))
    score = F.when(letter, F.col(guess)["score"]).otherwise(F.lit(0.0))
    rejected = (name == UNKNOWN) | (score < model.min_score)
    result = F.struct(name.alias("lang_pred"), score.alias("score"), rejected.alias("rejected"))
    return out.withColumn(into, result).drop(guess)


def identify_languages(docs: DataFrame, max_rows: int = 4000) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, rejected. Ids may be null (not held out)."""
    found = identify(docs.select("doc_id", "text", "lang"), fit(docs, max_rows), "language")
    held_out = (fold(F.col("doc_id")) == 0).alias("held_out")
    return found.select("doc_id", held_out, "language.*")


def reject_unknown(docs: DataFrame) -> DataFrame:
    """Pipeline stage: ``docs`` without the documents that the model, fitted on them, rejects."""
    mark = free_name(docs, "language")
    found = identify(docs, fit(docs), mark)
    return found.filter(~F.col(mark)["rejected"]).select(*docs.columns)
