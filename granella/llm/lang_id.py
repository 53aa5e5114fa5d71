"""Language identification with error-correcting output codes.

Every language gets a codeword. One binary classifier for each bit of the code,
a ridge classifier over hashed byte n-grams, predicts that bit; the language
whose codeword has the smallest loss-weighted distance to the predicted bits is
chosen. The loss of a bit is exponential in its margin, and a bit weighs, for a
language, as much as it was right on that language's training rows. Where the
two nearest codewords are almost as near as each other, the row is flagged as
ambiguous.

Features are square roots of the relative frequencies of byte bigrams and
trigrams; A-Z are lower-cased, other ASCII characters but a-z are blanks, and
n-grams with two blanks are left out.

Every language that labels a row is learned, however many there are. Training
uses a bounded sample of labelled rows, chosen by a hash of id and text: about
``rows_per_language`` of each language, less where that would be over
``most_rows`` in all, and one of each at least. Scoring reads every row whole.

Defined results: null text, or text without a letter: ``und``, score 0, no
ambiguity; no labelled rows at all: every row is ``und``; one language: that
language for all rows with a letter; a null id never trains. Repeated rows get
repeated results; other columns are ignored unless named in ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granella.llm.common import buffers, free_name, spans, tidy, trim

UNKNOWN = "und"
BITS = 12
WIDTH = 2 << BITS

_CLASS = np.full(256, 32, dtype=np.uint8)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of unit length and WIDTH columns; zero where a row has no n-gram."""
    n, rows = len(data), len(offsets) - 1
    out = np.zeros((rows, WIDTH), np.float32)
    if n < 2:
        return out
    b = _CLASS[data].astype(np.uint32)
    blank = b == 32
    row = np.repeat(np.arange(rows, dtype=np.int64), np.diff(offsets))
    for k, base in ((2, 0), (3, 1 << BITS)):
        m = n - k + 1
        if m <= 0:
            continue
        h = b[:m] * np.uint32(0x9E3779B1) + b[1 : m + 1] * np.uint32(0x85EBCA77)
        ok = (row[:m] == row[k - 1 :]) & ~(blank[:m] & blank[1 : m + 1])
        if k == 3:
            h += b[2:] * np.uint32(0xC2B2AE3D)
            ok &= ~(blank[1 : m + 1] & blank[2:])
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        at = row[:m] * (1 << BITS) + (h >> np.uint32(32 - BITS))
        got = np.bincount(at[ok], minlength=rows << BITS).reshape(rows, 1 << BITS).astype(np.float32)
        out[:, base : base + (1 << BITS)] = np.sqrt(got / np.maximum(got.sum(1, keepdims=True), 1))
    return out * np.float32(2**-0.5)


def codewords(k: int) -> np.ndarray:
    """k rows of +1 and -1: all splits of up to 6 classes, else the best of 200 seeded random codes (of fewer for over 500 classes)."""
    if k == 1:
        return np.ones((1, 1), np.int8)
    if k <= 6:
        bits = (1 << (k - 1)) - 1
        return np.array([[1 if i == k - 1 or not (m >> i) & 1 else -1 for m in range(1, bits + 1)] for i in range(k)], np.int8)
    rng, best, far = np.random.default_rng(7), None, -np.inf
    for _ in range(max(2, min(200, 200 * 500**2 // k**2))):
        code = rng.choice(np.array([-1, 1], np.int8), (k, 10 * int(np.ceil(np.log2(k)))))
        alike = code.astype(np.float32) @ code.T.astype(np.float32)
        np.fill_diagonal(alike, -np.inf)
        if (near := -alike.max()) > far:
            best, far = code, near
    return best


@dataclass
class Model:
    """Languages, code (language x bit), weights (feature x bit), intercepts, and bit weights (language x bit)."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    intercept: np.ndarray
    trust: np.ndarray
    ambiguous_below: float = 0.1

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, score and ambiguity of feature rows."""
        if len(self.languages) == 1:
            return np.zeros(len(x), int), np.ones(len(x)), np.zeros(len(x), bool)
        margin = np.clip(x @ self.weights + self.intercept, -2, 2)
        far = np.exp(-2.0 * margin) @ np.where(self.code > 0, self.trust, 0).T + np.exp(2.0 * margin) @ np.where(self.code < 0, self.trust, 0).T
        two = np.partition(far, 1, axis=1)[:, :2]
        p = np.exp(-4.0 * (far - two[:, :1]) / np.maximum(two[:, :1], 1e-9))
        return far.argmin(1), 1 / p.sum(1), (two[:, 1] - two[:, 0]) < self.ambiguous_below * (two[:, 0] + two[:, 1])


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows_per_language: int = 300, most_rows: int = 4000, penalty: float = 0.02) -> Model | None:
    """Fit on a sample of the labelled rows, of all languages. labelled holds only rows that may train.

    In expectation at most max(most_rows, languages) rows reach the driver, as
    16 KB of features each, and a matrix of rows x rows. None if there is no
    labelled row with a letter.
    """
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(key).isNotNull() & F.col(text).rlike(r"\p{L}"))
    rows = rows.select(F.col(lang).alias("l"), F.col(text).alias("t"), F.xxhash64(F.col(key).cast("string"), F.col(text)).alias("k"))
    rows = rows.withColumn("u", F.pmod("k", F.lit(1 << 30)) / float(1 << 30))
    counts = rows.groupBy("l").agg(F.count("*").alias("n"), F.min("u").alias("least")).collect()  # a row for each language
    if not counts:
        return None
    each = min(rows_per_language, most_rows / len(counts))
    limits = labelled.sparkSession.createDataFrame([(r["l"], max(each / r["n"], r["least"])) for r in counts], "l string, most double")
    if len(counts) <= 100_000:  # else texts are dealt by language
        limits = F.broadcast(limits)
    sample = rows.join(limits, "l").filter("u <= most").groupBy("l", "k").agg(F.first("t").alias("t"))  # rows that repeat train once

    def featurise(batches):
        for b in batches:
            data, offsets = buffers(b.column("t"))
            for lo, hi in spans(offsets):
                x = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                yield pa.RecordBatch.from_arrays([b.column("l").slice(lo, hi - lo), b.column("k").slice(lo, hi - lo), pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())], names=["l", "k", "x"])

    got = sorted(((r["l"], r["k"], bytes(r["x"])) for r in sample.mapInArrow(tidy(featurise), "l string, k bigint, x binary").collect()), key=lambda r: r)
    if not got:
        return None
    languages = sorted({r[0] for r in got})
    number = {name: i for i, name in enumerate(languages)}
    y = np.array([number[r[0]] for r in got])
    x = np.empty((len(got), WIDTH), np.float32)
    for i, r in enumerate(got):
        x[i] = np.frombuffer(r[2], np.float16)
    del got
    code = codewords(len(languages))
    if len(languages) == 1:
        return Model(languages, code, np.zeros((WIDTH, 1), np.float32), np.zeros(1, np.float32), np.ones((1, 1)))
    target = code[y].astype(np.float32)
    balance = (len(y) / (len(languages) * np.bincount(y, minlength=len(languages))))[y]
    mean, centre = x.mean(0), (target * balance[:, None]).sum(0) / balance.sum()
    x -= mean
    gram = (x @ x.T).astype(np.float64)
    gram[np.diag_indices_from(gram)] += penalty / balance * len(y) / 100
    alpha = np.linalg.solve(gram, (target - centre).astype(np.float64))
    weights = (x.T @ alpha.astype(np.float32)).astype(np.float32)
    intercept = (centre - mean @ weights).astype(np.float32)
    # leave-one-out margins of ridge regression, for the bits' weights
    loo = target - alpha / np.diag(np.linalg.inv(gram))[:, None]
    right = np.array([[np.mean(np.sign(loo[y == k, b]) == code[k, b]) for b in range(code.shape[1])] for k in range(len(languages))])
    trust = np.maximum(right, 0.05)
    return Model(languages, code, weights, intercept, trust / trust.sum(1, keepdims=True))


def identify(docs: DataFrame, model: Model | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, lang_pred, score and ambiguous of every row."""
    letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    if model is None:
        return docs.select(*keep, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("ambiguous"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # languages x bits x WIDTH numbers at most
    has = free_name([*keep, text], "letter")

    def run(batches):
        m = sent.value
        for b in batches:
            data, offsets = buffers(b.column(text))
            for lo, hi in spans(offsets, 1 << 20):
                for at in range(lo, hi, 512):
                    to = min(at + 512, hi)
                    x = features(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
                    k, score, doubt = m.decode(x)
                    ok = b.column(has).slice(at, to - at).to_numpy(zero_copy_only=False).astype(bool)
                    names = np.array([*m.languages, UNKNOWN], object)
                    yield pa.RecordBatch.from_arrays(
                        [*(b.column(c).slice(at, to - at) for c in keep), pa.array(names[np.where(ok, k, len(m.languages))], pa.string()), pa.array(np.where(ok, score, 0.0)), pa.array(doubt & ok)],
                        names=[*keep, "lang_pred", "score", "ambiguous"],
                    )

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "lang_pred string, score double, ambiguous boolean"])
    return docs.select(*dict.fromkeys([*keep, text]), letter.alias(has)).mapInArrow(tidy(run), schema)


def with_language(docs: DataFrame, model: Model | None, text: str = "text", out: str = "language") -> DataFrame:
    """All rows and columns, and a struct (lang_pred, score, ambiguous) as column out. Only the text goes to Python."""
    kind = "struct<lang_pred:string,score:double,ambiguous:boolean>"
    none = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("ambiguous"))
    if model is None:
        return docs.withColumn(out, none)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = sent.value
        names = np.array(m.languages, object)
        for b in batches:
            data, offsets = buffers(b)
            parts = []
            for lo, hi in spans(offsets, 1 << 20):
                for at in range(lo, hi, 512):
                    to = min(at + 512, hi)
                    parts.append(m.decode(features(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])))
            k, score, doubt = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, int), np.zeros(0), np.zeros(0, bool))
            yield pa.StructArray.from_arrays([pa.array(names[k], pa.string()), pa.array(score.astype(float)), pa.array(doubt)], names=["lang_pred", "score", "ambiguous"])
        trim()

    letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return docs.withColumn(out, F.when(letter, F.arrow_udf(predict, kind)(F.col(text))).otherwise(none))
