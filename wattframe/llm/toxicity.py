"""Toxicity: cumulative-link ordinal regression on sparse word features.

A text's features are its distinct lower-cased words. One weight per word is shared by all thresholds:
``P(grade >= k) = sigmoid(score - threshold_k)``, with thresholds in increasing order. The likelihood is
maximised in numpy by accelerated proximal gradient steps with an L1 penalty, so most words get no weight, and long
texts gather no noise. The expected severity is the sum of the probabilities over k.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattframe.llm.common import ship

#: Words that a larger share of the sampled harmless texts have say nothing.
COMMON = 0.2
WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class SeverityModel:
    grades: list[int]  # in order; the first is harmless
    weights: dict[str, float]
    thresholds: np.ndarray

    def above(self, texts: list[str | None]) -> np.ndarray:
        """P(grade is at least the k-th after the first), one row per text."""
        get = self.weights.get
        score = np.array([sum(get(w, 0.0) for w in words(t) if w in self.weights) for t in texts])
        return sigmoid(score[:, None] - self.thresholds[None, :])


def train(
    rows: list[tuple[int, set[str]]],
    population: dict[int, int],
    penalty: float = 4e-3,
    steps: int = 400,
    least: int = 3,
) -> SeverityModel:
    """Fit on (grade, words); each row stands for its grade's share of ``population``."""
    grades = sorted(population)
    if len(grades) < 2 or not rows:
        return SeverityModel(grades, {}, np.full(max(0, len(grades) - 1), 40.0))
    there: dict[str, int] = {}
    harmless: dict[str, int] = {}
    for g, some in rows:
        for w in some:
            there[w] = there.get(w, 0) + 1
            harmless[w] = harmless.get(w, 0) + (g == grades[0])
    most = max(least, COMMON * sum(g == grades[0] for g, _ in rows))
    kept = sorted(w for w, n in there.items() if n >= least and harmless[w] <= most)
    number = {w: i for i, w in enumerate(kept)}
    at = [sorted(number[w] for w in some if w in number) for _, some in rows]
    row = np.repeat(np.arange(len(rows)), [len(a) for a in at])
    col = np.array([c for a in at for c in a], np.int64)
    y = np.array([grades.index(g) for g, _ in rows])
    sampled = np.bincount(y, minlength=len(grades))
    share = np.array([population[g] for g in grades]) / np.maximum(sampled, 1)
    weight = share[y] / share[y].sum()
    # Harmless texts are many; half of the weight goes to the rest, so that few grave texts count.
    toxic = y > 0
    for side in (toxic, ~toxic):
        if side.any():
            weight[side] *= 0.5 / weight[side].sum()
    k = len(grades) - 1
    w, _ = _climb(row, col, y, weight, len(kept), k, penalty, steps)
    # The penalty picks the words; those are fitted again almost without it, which undoes its shrinking.
    chosen = np.flatnonzero(w > 0)
    place = np.full(len(kept), -1)
    place[chosen] = np.arange(len(chosen))
    on = place[col] >= 0
    w, theta = _climb(row[on], place[col[on]], y, weight, len(chosen), k, penalty / 100, 3 * steps)
    kept = [kept[i] for i in chosen]
    # Shift the thresholds until the expected share of toxic texts is that among the labels.
    score = np.bincount(row[on], w[place[col[on]]], len(y))
    count = share[y]
    wanted = count[toxic].sum() / count.sum()
    below, above = -30.0, 30.0
    for _ in range(60):
        shift = (below + above) / 2
        if (count * sigmoid(score - theta[0] - shift)).sum() / count.sum() > wanted:
            below = shift
        else:
            above = shift
    theta = theta + shift
    return SeverityModel(grades, {x: float(v) for x, v in zip(kept, w) if v}, theta)


def _climb(row, col, y, weight, m: int, k: int, penalty: float, steps: int):
    """Word weights and thresholds of the largest penalised likelihood."""
    n = len(y)
    # The largest curvature along the words, by the power method.
    v, curve = np.ones(m), 1.0
    for _ in range(30):
        v = np.bincount(col, (weight * np.bincount(row, v[col], n))[row], m).astype(float)
        curve = float(np.linalg.norm(v)) or 1.0
        v /= curve
    rate = 3 / curve
    w, gap, momentum = np.zeros(m), np.zeros(k), 1.0
    ahead = w
    for _ in range(steps):
        theta = gap[0] + np.concatenate([[0], np.cumsum(np.exp(gap[1:]))])
        score = np.bincount(row, ahead[col], n).astype(float)
        upper = sigmoid(score[:, None] - theta[None, :])
        ladder = np.hstack([np.ones((n, 1)), upper, np.zeros((n, 1))])
        low, high = ladder[np.arange(n), y], ladder[np.arange(n), y + 1]
        p = np.maximum(low - high, 1e-9)
        slope = weight * (1 - low - high)
        before = w
        w = ahead + rate * np.bincount(col, slope[row], m)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * penalty, 0)
        last, momentum = momentum, (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        ahead = w + (last - 1) / momentum * (w - before)
        steep = upper * (1 - upper)
        by_theta = np.array(
            [(weight * ((y == j) * steep[:, j] - (y == j + 1) * steep[:, j]) / p).sum() for j in range(k)]
        )
        back = np.cumsum(by_theta[::-1])[::-1]
        back[1:] *= np.exp(gap[1:])
        gap = gap + np.clip(back, -0.2, 0.2)
    return w, gap[0] + np.concatenate([[0], np.cumsum(np.exp(gap[1:]))])


def severity(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): the column ``toxic`` as an ordered grade, 0 harmless; the gravest of an id's labels."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
    return known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("grade"))


def fit(docs: DataFrame, graded: DataFrame, max_rows: int = 8000) -> SeverityModel:
    """Learn from at most ``max_rows`` graded texts, as many of each grade as there are.

    Rows are chosen by a hash of the id. Rows without text, and ids that occur in one table only, do not
    count. Without two grades the model finds everything harmless.
    """
    ship(docs.sparkSession)
    population = {r[0]: r[1] for r in graded.groupBy("grade").agg(F.count(F.lit(1))).collect()}
    if not population:
        return SeverityModel([], {}, np.zeros(0))
    each = max_rows // len(population)
    shares = [x for g, n in population.items() for x in (F.lit(g), F.lit(each / n))]
    chance = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 40) - 1)) / float(1 << 40)
    chosen = graded.withColumn("chance", chance).filter(
        F.col("chance") < F.create_map(*shares)[F.col("grade")]
    )
    chosen = chosen.orderBy("chance", "doc_id").limit(max_rows)
    rows = docs.filter("text IS NOT NULL").select("doc_id", "text")
    rows = rows.join(F.broadcast(chosen), "doc_id")
    rows = rows.orderBy("chance", F.xxhash64("text")).limit(max_rows)

    def count(batches):
        for pdf in batches:
            found = [sorted(words(t)) for t in pdf["text"]]
            yield pd.DataFrame({"grade": pdf["grade"], "words": found})

    found = rows.repartition(8).mapInPandas(count, "grade int, words array<string>").toArrow()
    data = [(r["grade"], set(r["words"])) for r in found.to_pylist()]
    data.sort(key=lambda r: (r[0], len(r[1]), sorted(r[1])[:20]))
    return train(data, population)


def predictor(model: SeverityModel):
    @F.pandas_udf("p_toxic double, expected_severity double, grade int")
    def predict(text: pd.Series) -> pd.DataFrame:
        above = model.above(list(text))
        if not above.shape[1]:
            zero = np.zeros(len(text))
            return pd.DataFrame({"p_toxic": zero, "expected_severity": zero, "grade": zero.astype(int)})
        likely = np.array(model.grades)[(above >= 0.5).sum(axis=1)]
        return pd.DataFrame(
            {
                "p_toxic": np.round(above[:, 0], 6),
                "expected_severity": np.round(above.sum(axis=1), 6),
                "grade": likely,
            }
        )

    return predict


def grade(docs: DataFrame, model: SeverityModel, text: Column | None = None) -> DataFrame:
    """One row per document: doc_id, p_toxic, expected_severity, grade, toxic.

    Null and empty texts have no features and get the thresholds' own probabilities; equal texts get
    equal results. An empty table gives an empty result; other columns are ignored.
    """
    ship(docs.sparkSession)
    text = F.col("text") if text is None else text
    found = docs.select("doc_id", predictor(model)(F.coalesce(text, F.lit(""))).alias("found"))
    return found.select("doc_id", "found.*").withColumn("toxic", F.col("p_toxic") >= 0.5)


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 8000) -> DataFrame:
    return grade(docs, fit(docs, severity(labels), max_rows))
