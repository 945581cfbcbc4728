"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled, and noisy-or joins the two.

A sentence's probability is a logistic function of its distinct features: words, their first 3 to 8 and last 3 to 6 letters. A
document's is 1 - prod(1 - p) over its sentences, so the labels of documents train the scores of sentences, and sentences of
high probability are where the document offends. A Platt step on a held fold of the training rows calibrates the scores.

Training takes at most `sample` labelled documents, the first by the hash of their id. Features are screened by their counts in
the sample (the `n_features` that part the labels most, at |z| >= 4); only what is left goes to the driver. Scoring covers every
whole text, in one pass without a shuffle.

Defined results: a null or empty text scores like one without known features; labels other than 0 and 1 count for nothing, and
of several labels of a document the largest counts; without labels of both kinds all score 0; repeated rows score alike; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import each_text, held, small_batches, text_of

SENTENCE, TOKEN = re.compile(r"[^.!?\n]+"), re.compile(r"\w+")
CACHE = 150_000
#: Features that a task counts before it hands them on; more would be combined better and held longer.
COUNTED = 100_000


def features(word: str) -> list[str]:
    n = len(word)
    return [word, *(word[:k] + "-" for k in range(3, min(n, 9))), *("-" + word[n - k :] for k in range(3, min(n, 7)))]


def sentences(text: str) -> list[set[str]]:
    return [set(TOKEN.findall(s)) for s in SENTENCE.findall(text.lower())]


class Model(NamedTuple):
    bias: float
    weights: dict[str, float]
    slope: float
    shift: float
    known: bool

    def calibrated(self, log_none: np.ndarray) -> np.ndarray:
        """The score of documents with the given sum of log(1 - p)."""
        if not self.known:
            return np.zeros(len(log_none))
        p = np.clip(-np.expm1(log_none), 1e-9, 1 - 1e-9)
        return 1 / (1 + np.exp(-np.clip(self.slope * np.log(p / (1 - p)) + self.shift, -50, 50)))


def split_of(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4; documents with remainder 2 are held out of training. A null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4, F.lit(0))


def counted(docs: DataFrame) -> DataFrame:
    """feature, toxic, clean: in how many documents of (_y, text) each feature is; summed within tasks first."""

    def run(batches):
        import pyarrow as pa

        found = (Counter(), Counter())

        def flush():
            keys = [*(found[0] | found[1])]
            out = pa.RecordBatch.from_pydict({"feature": keys, "toxic": [found[1][k] for k in keys], "clean": [found[0][k] for k in keys]}, pa.schema([("feature", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())]))
            for c in found:
                c.clear()
            return out

        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[y].update({f for w in set(TOKEN.findall(text.lower())) for f in features(w)})
            if len(found[0]) > COUNTED:
                yield flush()
        yield flush()

    return docs.select("_y", text_of().alias("text")).mapInArrow(run, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def screened(counts: DataFrame, n_toxic: int, n_clean: int, n_features: int) -> list[str]:
    """The features whose rates in toxic and clean documents differ most."""
    rate = (F.col("toxic") + F.col("clean")) / (n_toxic + n_clean)
    z = (F.col("toxic") / n_toxic - F.col("clean") / n_clean) / F.sqrt(rate * (1 - rate) * (1 / n_toxic + 1 / n_clean))
    best = counts.where((F.col("toxic") + F.col("clean") >= 3) & (rate < 1)).withColumn("_z", F.abs(z)).where("_z >= 4").orderBy(F.col("_z").desc(), "feature").limit(n_features)
    return [r.feature for r in best.select("feature").collect()]


class Bags(NamedTuple):
    """Documents as bags of sentences of feature numbers."""

    y: np.ndarray
    doc: np.ndarray  # of each sentence that has features
    sentence: np.ndarray  # of each feature
    feature: np.ndarray
    empty: np.ndarray  # sentences without features, of each document


def fit_bags(bags: Bags, n: int, rounds: int = 300, rate: float = 0.1, decay: float = 1e-3) -> tuple[float, np.ndarray]:
    """Bias and weights that maximise the noisy-or likelihood, by Adam on all rows."""
    theta = np.zeros(n + 1)
    theta[n] = -5.0
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    docs = len(bags.y)
    for step in range(1, rounds + 1):
        z = theta[n] + np.bincount(bags.sentence, theta[bags.feature], len(bags.doc))
        p, p0 = 1 / (1 + np.exp(-np.clip(z, -30, 30))), 1 / (1 + math.exp(-theta[n]))
        none = np.bincount(bags.doc, np.log1p(-p), docs) + bags.empty * math.log1p(-p0)
        some = np.clip(-np.expm1(none), 1e-9, 1)
        pull = np.where(bags.y == 1, -(1 - some) / some, 1.0)  # d loss / d z of a sentence is pull * p
        at = pull[bags.doc] * p
        g = np.bincount(bags.feature, at[bags.sentence], n + 1)
        g[n] = at.sum() + (pull * bags.empty).sum() * p0
        g = g / docs + decay * np.append(theta[:n], 0.0) / max(n, 1)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return float(theta[n]), theta[:n]


def log_none(bags: Bags, bias: float, weights: np.ndarray) -> np.ndarray:
    z = bias + np.bincount(bags.sentence, weights[bags.feature], len(bags.doc))
    return np.bincount(bags.doc, -np.logaddexp(0, z), len(bags.y)) - bags.empty * np.logaddexp(0, bias)


def platt(none: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic calibration, by Newton steps with Platt's smoothed targets."""
    p = np.clip(-np.expm1(none), 1e-9, 1 - 1e-9)
    x = np.column_stack([np.log(p / (1 - p)), np.ones(len(y))])
    up, down = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
    target, theta = np.where(y == 1, up, down), np.array([1.0, 0.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hess = (x * (q * (1 - q))[:, None]).T @ x + 1e-3 * np.eye(2)
        theta = theta - np.clip(np.linalg.solve(hess, x.T @ (q - target) + 1e-3 * (theta - [1, 0])), -2, 2)
    return float(theta[0]), float(theta[1])


def bagged(rows: list, n: int) -> Bags:
    """From rows (y, sentences: feature numbers of each sentence that has some, n_empty)."""
    doc, sentence, feature = [], [], []
    for i, r in enumerate(rows):
        for s in r.sentences:
            sentence += [len(doc)] * len(s)
            feature += s
            doc.append(i)
    return Bags(np.array([r.y for r in rows]), np.array(doc, int), np.array(sentence, int), np.array(feature, int), np.array([r.n_empty for r in rows], float))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 12_000, n_features: int = 4096) -> Model:
    """The model, from labelled documents that aren't held out."""
    none = Model(0.0, {}, 1.0, 0.0, False)
    marked = labels.where(F.col("toxic").isin(0, 1) & (split_of(F.col("doc_id")) != 2)).groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("_y"))
    drawn = marked.where("_id is not null").orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(drawn), F.col("doc_id") == F.col("_id"))  # `sample` rows of two numbers
    totals = rows.agg(F.sum("_y"), F.sum(1 - F.col("_y"))).first()
    if not totals[0] or not totals[1]:
        return none
    names = screened(counted(rows), totals[0], totals[1], n_features)
    number = {f: i for i, f in enumerate(names)}

    def taken(texts):
        for t in texts:
            all_of = [sorted({number[f] for w in s for f in features(w) if f in number}) for s in sentences(t)]
            some = [s for s in all_of if s]
            yield some, len(all_of) - len(some)

    found = each_text(rows.select(F.struct("doc_id", "_y").alias("_k"), "text"), lambda texts: list(taken(texts)), "sentences array<array<int>>, n_empty int", "_k")
    found = found.select(F.col("_k._y").alias("y"), F.xxhash64("_k.doc_id").alias("h"), "sentences", "n_empty").collect()
    found.sort(key=lambda r: r.h)
    fold = np.array([r.h % 5 == 0 for r in found])
    own, held = ([r for r, f in zip(found, fold, strict=True) if f == part] for part in (False, True))
    if len({r.y for r in own}) < 2:
        return none
    bias, weights = fit_bags(bagged(own, len(names)), len(names))
    slope, shift = platt(log_none(b := bagged(held, len(names)), bias, weights), b.y) if len({r.y for r in held}) == 2 else (1.0, 0.0)
    return Model(bias, dict(zip(names, weights.tolist(), strict=True)), max(slope, 0.05), shift, True)


class Words(dict):
    """Weight of each word met so far; it starts anew at CACHE words."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.of = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE:
            self.clear()
        w = self[word] = sum(self.of.get(f, 0.0) for f in features(word))
        return w


def scorer(model: Model, threshold: float):
    """A function from texts to their scores and offending sentences."""
    mark = hash((model.bias, len(model.weights), model.slope, model.shift))

    def rows(texts):
        words = held(("toxicity", mark), lambda: Words(model.weights))
        sums, spots = [], []
        for text in texts:
            low, none, found = text.lower(), 0.0, []
            same = len(low) == len(text)  # else positions would be those of the lower-cased text
            for m in SENTENCE.finditer(low):
                # Features of a sentence are distinct: two words can share one, which then counts once, as in training.
                hits = [w for w in set(TOKEN.findall(m[0])) if words[w]]
                z = model.bias + (words[hits[0]] if len(hits) == 1 else sum(model.weights[f] for f in {f for w in hits for f in features(w) if f in model.weights}) if hits else 0.0)
                p = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
                none += math.log1p(-p) if p < 1 else -40.0
                if p >= threshold:
                    found.append({"start": m.start() if same else None, "stop": m.end() if same else None, "score": p})
            sums.append(none)
            spots.append(found)
        return model.calibrated(np.array(sums)).tolist() if sums else [], spots

    return rows


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted (score >= threshold) and offending: the sentences (start, stop, score) at the threshold or above."""
    scored = scorer(model, threshold)

    def rows(texts):
        return [(s, int(s >= threshold), x if s >= threshold else []) for s, x in zip(*scored(texts), strict=True)]

    return each_text(docs, rows, "score double, predicted int, offending array<struct<start: int, stop: int, score: double>>")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of `docs` whose text scores below the threshold, with all their columns."""
    scored = scorer(model, threshold)
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            scores, _ = scored([t or "" for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array([s < threshold for s in scores], pa.bool_()))

    return small_batches(docs).mapInArrow(run, docs.schema)
