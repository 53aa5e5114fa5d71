"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence gets a probability from a
logistic model over its words and word beginnings; a document's score is the
noisy-or of its sentences, 1 - prod(1 - p). Only document labels are known: the
sentence model is trained through the noisy-or, and then shows which sentences
made a document's score.

Features count once a sentence. A sentence without any learned feature says nothing (p = 0), so length alone
doesn't raise a score.

Training uses a bounded sample of labelled rows (``most_rows``, expected
number, chosen by a hash of the id, positive rows first); scoring reads every
row whole.

Defined results: null or empty text, or no labels at all, or labels of one kind:
score 0, predicted 0, no sentences. Repeated rows get repeated results. Other
columns are ignored unless named in ``keep``.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granella.llm.common import tidy, written

_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*\n*|[.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")
#: Lengths of word beginnings that are features; words of that length or longer have them.
BEGINNINGS = (3, 4, 5, 6)
REMEMBERED = 300_000
THRESHOLD = 0.3


def word_features(word: str) -> list[str]:
    return ["=" + word, *("^" + word[:k] for k in BEGINNINGS if len(word) > k)]


@dataclass
class Model:
    weights: dict[str, float]
    bias: float


class _Known(dict):
    """A word's learned features."""

    def __init__(self, model: Model):
        self.weights = model.weights

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = out = tuple(f for f in word_features(word) if f in self.weights)
        return out


def train(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", most_rows: int = 3000, most_features: int = 6000, rounds: int = 300) -> Model | None:
    """Fit on about most_rows labelled rows, half of them positive if there are as many.

    labels has key and label, and only rows that may train, one for each key.
    Ids are sampled before texts are read: at most 2 x most_rows ids are
    broadcast. None if one of the labels is missing.
    """
    rows = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(key, F.col(label).cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(counts) < 2:
        return None
    half = most_rows / 2
    u = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 30)) / float(1 << 30)
    rate = F.when(F.col("y") == 1, half / counts[1]).otherwise((most_rows - min(half, counts[1])) / counts[0])
    ids = F.broadcast(rows.filter(u < rate).limit(2 * most_rows))
    texts = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("t"))
    sample = written(texts.join(ids.withColumnRenamed(key, "id"), "id").select("y", F.xxhash64(F.col("id").cast("string")).alias("k"), "t"), "sample")

    def featurise(batches):
        for b in batches:
            out = []
            for t in b.column("t").to_pylist():
                every = {f for s in _SENTENCE.findall(t) for w in _WORD.findall(s.lower()) for f in word_features(w)}
                out.append(sorted(every))
            yield pa.RecordBatch.from_arrays([b.column("y"), b.column("k"), pa.array(out, pa.list_(pa.string()))], names=["y", "k", "f"])

    chosen = _choose(sample.mapInArrow(tidy(featurise), "y int, k bigint, f array<string>"), most_features)
    if not chosen:
        return None
    number = {f: i for i, f in enumerate(chosen)}

    def index(batches):
        for b in batches:
            out = []
            for t in b.column("t").to_pylist():
                sentences = (sorted({number[f] for w in set(_WORD.findall(s.lower())) for f in word_features(w) if f in number}) for s in _SENTENCE.findall(t))
                out.append([x for x in sentences if x])
            yield pa.RecordBatch.from_arrays([b.column("y"), b.column("k"), pa.array(out, pa.list_(pa.list_(pa.int32())))], names=["y", "k", "s"])

    bags = sorted(((r["k"], r["y"], r["s"]) for r in sample.mapInArrow(tidy(index), "y int, k bigint, s array<array<int>>").collect()), key=lambda r: r[:2])
    return _fit(bags, chosen, rounds)


def _choose(rows: DataFrame, most: int) -> list[str]:
    """Features of at least three sampled rows, furthest from even between the labels (log odds over its deviation)."""
    total = rows.agg(F.sum("y").alias("p"), F.count("*").alias("n")).first()
    p, n = total["p"] or 0, total["n"]
    if not p or p == n:
        return []
    c = rows.select("y", F.explode("f").alias("f")).groupBy("f").agg(F.sum("y").alias("a"), F.count("*").alias("d")).filter("d >= 3")
    a, b = F.col("a") + 0.5, F.col("d") - F.col("a") + 0.5
    z = (F.log(a / (p - F.col("a") + 0.5)) - F.log(b / (n - p - (F.col("d") - F.col("a")) + 0.5))) / F.sqrt(1 / a + 1 / b)
    return [r["f"] for r in c.select("f", F.abs(z).alias("z")).filter("z > 2").orderBy(F.desc("z"), "f").limit(most).collect()]


def _fit(bags: list[tuple], names: list[str], rounds: int) -> Model | None:
    y = np.array([b[1] for b in bags], float)
    feature = np.array([f for b in bags for s in b[2] for f in s], np.int64)
    sentence = np.repeat(np.arange(sum(len(b[2]) for b in bags)), [len(s) for b in bags for s in b[2]])
    bag = np.repeat(np.arange(len(bags)), [len(b[2]) for b in bags])
    sentences, k = len(bag), len(names)
    if not sentences:
        return None
    w, bias, m, v = np.zeros(k), -3.0, np.zeros(k + 1), np.zeros(k + 1)
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    for t in range(1, rounds + 1):
        z = np.clip(np.bincount(sentence, w[feature], sentences) + bias, -30, 30)
        p = 1 / (1 + np.exp(-z))
        none = np.exp(np.bincount(bag, np.log1p(-np.minimum(p, 1 - 1e-12)), len(bags)))
        score = np.clip(1 - none, 1e-9, 1)
        # slope of the log loss by z: p for negative bags, -p * (1 - score) / score for positive ones
        slope = weight[bag] * np.where(y[bag] == 1, -p * none[bag] / score[bag], p)
        g = np.append(np.bincount(feature, slope[sentence], k) + 1e-5 * w, slope.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-10)
        w, bias = w - step[:-1], bias - step[-1]
    return Model({f: float(x) for f, x in zip(names, w, strict=True) if abs(x) > 1e-3}, float(bias))


def score(docs: DataFrame, model: Model | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), least: float = 0.5) -> DataFrame:
    """keep columns, score, predicted, and the offending sentences (start, end, score) with p of at least ``least``, in code points."""
    kind = "array<struct<start:int,end:int,score:double>>"
    if model is None:
        return docs.select(*keep, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.array().cast(kind).alias("sentences"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # most_features numbers at most

    def run(batches):
        bias, weights, known = sent.value.bias, sent.value.weights, _Known(sent.value)
        struct = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for b in batches:
            scores, found = [], []
            for t in b.column(text).to_pylist():
                none, bad = 1.0, []
                for m in _SENTENCE.finditer(t or ""):
                    got = {f for x in map(known.__getitem__, _WORD.findall(m[0].lower())) if x for f in x}
                    if got:
                        p = 1 / (1 + math.exp(-max(-30.0, min(30.0, math.fsum(map(weights.__getitem__, got)) + bias))))
                        none *= 1 - p
                        if p >= least:
                            bad.append({"start": m.start(), "end": m.end(), "score": float(p)})
                scores.append(1 - none)
                found.append(bad)
            s = np.array(scores, float)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32)), pa.array(found, struct)], names=[*keep, "score", "predicted", "sentences"])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), f"score double, predicted int, sentences {kind}"])
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(tidy(run), schema)
