"""Toxicity: logistic regression that is penalised where swapping identity terms moves its score.

Words that tell the classes apart are picked by a Spark aggregate over a bounded sample of
labelled rows; a document's features are which of them it has. Each training text that names a
group is paired with its counterfactual, the same text with the terms of a group swapped for
those of another; the loss adds ``FAIRNESS`` times the squared difference of their logits, so a
neutral mention of a group carries no score.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ananas.llm.shared import small_side, written

#: Labelled texts of a class that the model learns from, at most (on average; picked by a hash of the text).
SAMPLE_ROWS = 6000
#: Words the model looks at, besides the identity terms.
WORDS = 1500
#: A word must be in this many sampled texts, with this evidence (log-likelihood ratio, in nats) against chance.
LEAST_TEXTS, LEAST_EVIDENCE = 5, 10.0
FAIRNESS, RIDGE, STEPS = 2.0, 0.02, 400

# Identity terms; terms at one place of two lists of an axis are counterparts.
AXES = [
    [["women", "woman", "female", "girl", "girls", "she", "her"], ["men", "man", "male", "boy", "boys", "he", "his"]],
    [["muslim", "muslims"], ["christian", "christians"], ["jewish", "jews"], ["hindu", "hindus"], ["buddhist", "buddhists"], ["atheist", "atheists"]],
    [["black"], ["white"], ["asian"], ["latino"], ["african"], ["european"]],
    [["gay"], ["straight"], ["lesbian"], ["bisexual"], ["transgender"], ["queer"]],
    [["immigrant", "immigrants"], ["native", "natives"], ["refugee", "refugees"]],
    [["disabled"], ["blind"], ["deaf"], ["elderly"], ["young"]],
]

WORD = re.compile(r"[^\W\d_]+")


def swaps(axes=None) -> dict[str, str]:
    """Each identity term and its counterpart: the term of the next group of its axis."""
    out = {}
    for groups in axes or AXES:
        for k, group in enumerate(groups):
            other = groups[(k + 1) % len(groups)]
            out |= {term: other[min(i, len(other) - 1)] for i, term in enumerate(group)}
    return out


@dataclass
class Model:
    words: dict[str, int]
    weights: np.ndarray
    bias: float

    def scores(self, texts) -> np.ndarray:
        known = self.words.keys()
        z = np.fromiter((self.weights[[self.words[w] for w in known & set(WORD.findall((t or "").lower()))]].sum() for t in texts), dtype=float, count=len(texts))
        return 1 / (1 + np.exp(-(z + self.bias)))


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def training_sample(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, toxic) of at most about ``sample_rows`` labelled, not held-out documents of each class, written.

    A document labelled more than once takes the largest label; null labels and ids are left out.
    """
    known = labels.filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id")))
    known = written(known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")), "labels")
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    kept = F.lit(False)
    for toxic, n in sizes.items():
        kept = F.when(F.col("toxic") == toxic, F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(min(1.0, sample_rows / n) * (1 << 20)) + 1).otherwise(kept)
    picked = small_side(written(known.filter(kept), "picked"))
    return written(docs.filter("text is not null").select("doc_id", "text").join(picked, "doc_id").select("text", "toxic"), "sample")


def telling_words(sample: DataFrame, words: int = WORDS, least: int = LEAST_TEXTS) -> list[str]:
    """The words whose share of texts differs most between the classes, by a log-likelihood statistic."""

    def distinct(batches):
        for batch in batches:
            toxic, texts = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            got = [(w, y) for t, y in zip(texts, toxic) for w in set(WORD.findall(t.lower()))]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in got], pa.string()), pa.array([y for _, y in got], pa.int32())], names=["word", "toxic"])

    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    a, b = max(n.get(1, 0), 1), max(n.get(0, 0), 1)
    c = sample.mapInArrow(distinct, "word string, toxic int").groupBy("word").agg(F.sum("toxic").alias("x"), F.sum(1 - F.col("toxic")).alias("y"))
    both = (F.col("x") + F.col("y")) / (a + b)
    part = lambda k, n: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / (n * both))).otherwise(0.0)
    c = c.filter(F.col("x") + F.col("y") >= least).withColumn("g", part("x", a) + part("y", b)).filter(F.col("g") >= LEAST_EVIDENCE)
    return [r["word"] for r in c.orderBy(F.desc("g"), "word").limit(words).collect()]  # the model's size


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, axes=None, fairness: float = FAIRNESS) -> Model:
    """Fit the model; with labels of one class or none, its score is that class's share for every text."""
    sample = training_sample(docs, labels, sample_rows)
    swap = swaps(axes)
    words = {w: i for i, w in enumerate(dict.fromkeys(telling_words(sample) + sorted(swap)))}

    def features(batches):
        for batch in batches:
            rows = []
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                has = words.keys() & set(WORD.findall(t.lower()))
                named = has & swap.keys()
                other = (has - named) | {swap[w] for w in named}
                rows.append((y, sorted(words[w] for w in has), sorted(words[w] for w in other) if named else None))
            ys, has, other = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(has, pa.list_(pa.int32())), pa.array(other, pa.list_(pa.int32()))], names=["y", "has", "other"])

    rows = sample.mapInArrow(features, "y int, has array<int>, other array<int>").collect()  # bounded by sample_rows
    rows = sorted(((r["y"], list(r["has"]), list(r["other"]) if r["other"] is not None else None) for r in rows), key=str)
    y = np.array([r[0] for r in rows], dtype=float)
    if not len(y) or y.min() == y.max():
        p = float(y.mean()) if len(y) else 0.5
        return Model({}, np.zeros(0), float(np.log((p + 1e-6) / (1 - p + 1e-6))))
    w, bias = _fit(y, [r[1] for r in rows], [(i, r[2]) for i, r in enumerate(rows) if r[2] is not None], len(words), fairness)
    return Model(words, w, bias)


def _flat(lists) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ones of a 0/1 matrix given by its rows."""
    return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.array([j for x in lists for j in x], dtype=int)


def _fit(y, has, pairs, size, fairness) -> tuple[np.ndarray, float]:
    """Gradient descent with momentum estimates (Adam) on mean log loss + fairness + ridge terms."""
    r, c = _flat(has)
    at = np.array([i for i, _ in pairs], dtype=int)
    r2, c2 = _flat([x for _, x in pairs])
    theta = np.zeros(size + 1)
    theta[-1] = np.log(y.mean() / (1 - y.mean()))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, STEPS + 1):
        w, b = theta[:-1], theta[-1]
        z = np.bincount(r, w[c], len(y)) + b
        d = (1 / (1 + np.exp(-z)) - y) / len(y)
        g = np.bincount(c, d[r], size) + RIDGE * w / np.sqrt(len(y))
        if len(at):
            z2 = np.bincount(r2, w[c2], len(at)) + b
            own = np.zeros(len(y))
            own[at] = 2 * fairness * (z[at] - z2) / len(at)
            g += np.bincount(c, own[r], size) - np.bincount(c2, own[at][r2], size)
        g = np.r_[g, d.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:-1].copy(), float(theta[-1])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): score in 0..1 and predicted (score >= 0.5).

    Null and empty texts get the score of a text without any telling word. Rows are judged one by
    one; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # at most WORDS + the identity terms

    def run(batches):
        for batch in batches:
            s = Model(**shared.value).scores(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())], names=["doc_id", "score", "predicted"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, score double, predicted int")


def learn_and_score(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    out = score(docs, train(docs, labels, sample_rows))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
