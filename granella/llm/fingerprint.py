"""Similarity digests from improbable features.

Every 16-byte window of a text has the entropy of its bytes, as a whole number
from 0 to 1000. How often each entropy occurs is counted over all documents:
the rarer its entropy, the better a window ranks. Of every 16 windows in a row
the best (leftmost of equals) gets a point; windows with ``points`` or more are
the text's features. Windows of low entropy (runs of one character) are no
features. Texts of all lengths have the same kind of features, so any two can be
compared. Feature hashes, without repeats and in text order, fill a chain of
Bloom filters of 2048 bits, five bits a feature, 160 features a filter.

Likeness of two digests: each filter of the shorter chain takes the best
normalised bit overlap with a filter of the other, where 0 is what chance and a
cutoff explain and 1 is all it could be; the mean over those filters is the
result. A last filter with few features counts only where it is the only one.

Windows are counted with numpy for many texts at once: two numbers for every
byte, how often it stands in the window's bytes before and after, give all entropies
as running sums of whole numbers, so results don't depend on batches.

Defined results: null counts as empty; the empty text has an empty digest, like
only itself (1.0) and unlike all else (0.0); a text shorter than a window, or
without a feature, has one feature (the whole text, or its best window); equal
texts have equal digests; repeated rows get repeated results.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granella.llm.common import U64, _power, buffers, mix, spans, tidy

#: Bytes of a window, windows of a run, points of a feature; for texts of all lengths.
WINDOW, RUN, POINTS = 16, 16, 4
#: The most bytes a window can have.
WIDEST = 64
SCALE = 1000
WEAK = 100
BITS = 2048
HASHES = 5
MOST = 160
FEW = 16
CUTOFF = 0.3
_UNIT = 1 << 16
_F = np.array([round(c * np.log2(c) * _UNIT) if c else 0 for c in range(WIDEST + 1)], np.int64)
_NONE = np.int64(1 << 20)


def entropies(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entropy of every window, the byte where it starts, and where each row's windows begin (rows + 1 numbers)."""
    n, rows = len(data), len(offsets) - 1
    sizes = np.diff(offsets)
    each = np.maximum(sizes - window + 1, 0)
    bounds = np.zeros(rows + 1, np.int64)
    np.cumsum(each, out=bounds[1:])
    if not bounds[-1]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), bounds
    order = np.argsort(data, kind="stable")
    row = np.repeat(np.arange(rows), sizes)
    key = (np.arange(n) + row * window)[order] + data[order].astype(np.int64) * (n + (rows + 2) * window)
    if key[-1] < 2**31:
        key = key.astype(np.int32)
    before, after = np.ones(n, np.uint8), np.ones(n, np.uint8)
    for k in range(1, min(window, n)):
        near = (key[k:] - key[:-k]) < window
        if not near.any():
            break
        before[k:] += near
        after[:-k] += near
    gain = _F[1:] - _F[:-1]  # of a byte that is there c times, by c - 1
    come, go = np.empty(n + 1, np.int64), np.empty(n + 1, np.int64)
    come[0] = go[0] = 0
    come[1:][order] = gain[before - 1]
    go[1:][order] = gain[after - 1]
    come, go = np.cumsum(come), np.cumsum(go)
    start = np.arange(bounds[-1]) + np.repeat(offsets[:-1] - bounds[:-1], each)
    first = np.repeat(offsets[:-1], each)
    total = come[start + window] - come[first] - go[start] + go[first]
    return (_F[window] - total) * SCALE // _F[window], start, bounds


def entropy_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """How many windows of all rows have each entropy."""

    def run(batches):
        count = np.zeros(SCALE + 1, np.int64)
        for b in batches:
            data, offsets = buffers(b.column("t"))
            for lo, hi in spans(offsets):
                e, _, _ = entropies(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                count += np.bincount(e, minlength=SCALE + 1)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some])], names=["e", "n"])

    out = np.zeros(SCALE + 1, np.int64)
    for r in docs.select(F.col(text).alias("t")).mapInArrow(tidy(run), "e bigint, n bigint").groupBy("e").agg(F.sum("n").alias("n")).collect():
        out[r["e"]] = r["n"]
    return out


def ranks(counts: np.ndarray) -> np.ndarray:
    """Rank of each entropy: 0 for the rarest; weak ones have none. For one table of counts or for several."""
    if counts.ndim > 1:
        return np.stack([ranks(c) for c in counts])
    order = np.lexsort((np.arange(SCALE + 1), counts))
    out = np.empty(SCALE + 1, np.int64)
    out[order] = np.arange(SCALE + 1)
    out[: WEAK + 1] = _NONE
    return out


def digests(data: np.ndarray, offsets: np.ndarray, rank: np.ndarray) -> list[list[tuple[int, np.ndarray]]]:
    """For each row its chain of (features, 2048 booleans). rank: of each entropy; of several tables the last holds."""
    rank = rank[-1] if rank.ndim > 1 else rank
    rows, n = len(offsets) - 1, len(data)
    e, start, bounds = entropies(data, offsets)
    sizes = np.diff(bounds)
    row = np.repeat(np.arange(rows), sizes)
    score = np.zeros(len(e), np.int64)
    if len(e):
        low = rank[e] * (1 << 32) + np.arange(len(e))
        width = 1
        while width < RUN:
            low = np.minimum(low[:-width], low[width:]) if len(low) > width else low[:0]
            width *= 2
        won = low[row[: len(low)] == row[RUN - 1 :]] if len(low) else low
        won = won[won < _NONE << 32] & 0xFFFFFFFF
        score += np.bincount(won, minlength=len(e))
    chosen = score >= POINTS
    has = np.bincount(row[chosen], minlength=rows)
    for r in np.flatnonzero((has == 0) & (sizes > 0)):
        chosen[bounds[r] + int(np.argmin(rank[e[bounds[r] : bounds[r + 1]]]))] = True
    p, q = _power(n) if n else (None, None)
    acc = np.zeros(n + 1, U64)
    if n:
        np.cumsum((data.astype(U64) + U64(1)) * p, out=acc[1:])
    at = start[chosen]
    feature = mix((acc[at + WINDOW] - acc[at]) * q[at]) if len(at) else np.zeros(0, U64)
    cut = np.searchsorted(at, offsets)
    out = []
    for r in range(rows):
        f = feature[cut[r] : cut[r + 1]]
        if not len(f) and offsets[r + 1] > offsets[r]:
            s, z = offsets[r], offsets[r + 1]
            f = mix((acc[z : z + 1] - acc[s : s + 1]) * q[s : s + 1] ^ U64(z - s))
        if len(f) > 1:
            _, first = np.unique(f, return_index=True)
            f = f[np.sort(first)]
        chain = []
        for k in range(0, len(f), MOST):
            bits = np.zeros(BITS, bool)
            part = f[k : k + MOST]
            for j in range(HASHES):
                bits[((part >> U64(11 * j)) & U64(BITS - 1)).astype(np.int64)] = True
            chain.append((len(part), bits))
        out.append(chain)
    return out


def packed(chain: list[tuple[int, np.ndarray]]) -> str:
    """The digest as text: two bytes of count and 256 of bits for each filter, in base64."""
    return base64.b64encode(b"".join(c.to_bytes(2, "big") + np.packbits(b).tobytes() for c, b in chain)).decode()


def unpacked(s: str) -> list[tuple[int, np.ndarray]]:
    raw = base64.b64decode(s)
    return [(int.from_bytes(raw[i : i + 2], "big"), np.unpackbits(np.frombuffer(raw[i + 2 : i + 258], np.uint8)).astype(bool)) for i in range(0, len(raw), 258)]


def likeness(a: list, b: list) -> float:
    """0 to 1; the same whichever comes first."""
    if not a or not b:
        return float(not a and not b)
    if (len(a), sum(c for c, _ in a)) > (len(b), sum(c for c, _ in b)):
        a, b = b, a
    rows = [x for x in a if x[0] >= FEW] or a
    other = [x for x in b if x[0] >= FEW] or b
    x, y = np.array([v for _, v in rows], np.float32), np.array([v for _, v in other], np.float32)
    cx, cy = np.array([c for c, _ in rows], float), np.array([c for c, _ in other], float)
    most = np.minimum(x.sum(1)[:, None], y.sum(1)[None])
    p = 1 - 1 / BITS
    chance = BITS * (1 - p ** (HASHES * cx))[:, None] * (1 - p ** (HASHES * cy))[None]
    cutoff = np.minimum(chance + CUTOFF * np.maximum(most - chance, 0), most - 1e-9)
    each = np.clip((x @ y.T - cutoff) / (most - cutoff), 0, 1).max(1)
    return float(min(1.0, each.mean()))


def edited(text: str, following: str) -> str:
    """text with its last third replaced by the beginning of the following text, as long or all of it."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _buffer(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return buffers(pa.array(texts, pa.large_string()))


def neighbours(docs: DataFrame, text: str = "text", key: str = "doc_id", parts: int | None = None) -> DataFrame:
    """(part, last, k, t): rows dealt into ranges of descending key, sorted, each range followed by the next range's first row (last = true).

    Cuts between ranges are quantiles of the keys; what reaches the driver is one
    key for each range. Rows with equal keys go by a hash of the text, then the
    text; null keys come last.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(rows.agg(F.percentile_approx("k", [i / parts for i in range(1, parts)] or [0.5], 100 * parts)).first()[0] or []))
    array = F.array(*(F.lit(c).cast("long") for c in cuts)) if cuts else F.array().cast("array<bigint>")
    part = F.when(F.col("k").isNull(), F.lit(len(cuts))).otherwise(F.size(F.filter(array, lambda c: c > F.col("k"))))
    rows = rows.withColumn("part", part.cast("int"))
    heads = sorted((r["part"], r["k"]) for r in rows.groupBy("part").agg(F.max("k").alias("k")).collect())
    follows = [(heads[i - 1][0], k) for i, (_, k) in enumerate(heads)]
    table = spark.createDataFrame(follows, "part int, k bigint")
    tails = rows.drop("part").join(F.broadcast(table.withColumnRenamed("k", "h")), F.col("k").eqNullSafe(F.col("h"))).select("part", F.lit(True).alias("last"), "k", "t")
    every = rows.select("part", F.lit(False).alias("last"), "k", "t").union(tails)
    return every.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("last", F.col("k").desc_nulls_last(), F.xxhash64("t"), "t")


def compare_neighbours(docs: DataFrame, text: str = "text", key: str = "doc_id", chunk: int = 1 << 20) -> DataFrame:
    """For every row: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next."""
    rank = docs.sparkSession.sparkContext.broadcast(ranks(entropy_counts(docs, text)))
    names = ["k", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def compared(held: list[tuple], following: str):
        texts = [t for _, t in held] + [following]
        own = digests(*_buffer(texts), rank.value)
        changed = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
        other = digests(*_buffer(changed), rank.value)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([k for k, _ in held], pa.int64()),
                pa.array([len(t) for _, t in held], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8")).hexdigest() for t in changed]),
                pa.array([packed(x) for x in own[:-1]]),
                pa.array([packed(x) for x in other]),
                pa.array([likeness(a, b) for a, b in zip(own, other, strict=False)], pa.float64()),
                pa.array([likeness(a, b) for a, b in zip(own, own[1:], strict=False)], pa.float64()),
            ],
            names=names,
        )

    def run(batches):
        held, size, done = [], 0, False
        for b in batches:
            for last, k, t in zip(b.column("last").to_pylist(), b.column("k").to_pylist(), b.column("t").to_pylist(), strict=True):
                if done:
                    continue
                if last or size >= chunk:
                    if held:
                        yield compared(held, t)
                    held, size = [], 0
                    done = last
                if not last:
                    held.append((k, t))
                    size += len(t)

    schema = "k bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return neighbours(docs, text, key).mapInArrow(tidy(run), schema).withColumnRenamed("k", key)
