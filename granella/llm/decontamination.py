"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Seeds are all n-word runs of the test items, however many documents hold them:
copies that are themselves repeated make their own runs frequent. Seeds that a
document holds near each other (closer than the item is long) open a window if
``least_hits`` of them differ, and the window's words are aligned with the
item's words: a match gives 2, a mismatch or a gap takes 1. The score is the
best local alignment over the best possible one, 2 x the item's length; an exact
copy scores 1, a copy with a few changed, added or lost words a little less.
Rows of at least ``threshold`` are reported. Windows whose words can't reach it
in any order aren't aligned.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased, so
punctuation, case and line breaks don't hide a copy.

The items are the stated query set. Their index is broadcast in blocks of at
most ``block_bytes`` of item text; more items mean more passes over the
documents, never a larger broadcast.

Defined results: null or empty texts, and items with fewer than ``least_words``
words, are never reported; a document with several copies of an item is one
row, of the best copy; repeated rows give repeated results; empty tables give
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granella.llm.common import PLAIN, U64, buffers, ngram_hashes, spans, tidy, trim, word_hashes

_MASK_BITS = 20
#: Pairs of a hit and an item that one numpy step handles at once; the pairs of a document stay together.
_PAIRS = 4 << 20


@dataclass
class Index:
    """items: ids; words: their word hashes; seeds: sorted distinct hashes; bounds and owners: the items of each seed."""

    items: list[int]
    words: list[np.ndarray]
    seeds: np.ndarray
    bounds: np.ndarray
    owners: np.ndarray

    def __post_init__(self):
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.mask = np.zeros(1 << _MASK_BITS, bool)
        self.mask[(self.seeds >> U64(64 - _MASK_BITS)).astype(np.int64)] = True

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in grams that hold a seed, and the seeds' numbers."""
        at = np.flatnonzero(self.mask[(grams >> U64(64 - _MASK_BITS)).astype(np.int64)])
        if not len(at) or not len(self.seeds):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = np.searchsorted(self.seeds, grams[at])
        k[k == len(self.seeds)] = 0
        ok = self.seeds[k] == grams[at]
        return at[ok], k[ok]


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = buffers(pa.array(texts, pa.string()))
    words, _, _, bounds = word_hashes(data, offsets, PLAIN)
    return words, bounds


def build(rows: list[tuple[int, str]], n: int, least_words: int) -> Index:
    words, bounds = _words([t or "" for _, t in rows])
    keep = [i for i in range(len(rows)) if bounds[i + 1] - bounds[i] >= least_words]
    grams, b = ngram_hashes(words, bounds, n)
    seed = np.concatenate([grams[b[i] : b[i + 1]] for i in keep]) if keep else np.zeros(0, U64)
    owner = np.repeat(np.arange(len(keep)), [b[i + 1] - b[i] for i in keep]) if keep else np.zeros(0, np.int64)
    return _index([rows[i][0] for i in keep], [words[bounds[i] : bounds[i + 1]].copy() for i in keep], seed, owner)


def _index(items: list[int], words: list[np.ndarray], seed: np.ndarray, owner: np.ndarray) -> Index:
    o = np.lexsort((owner, seed))
    seed, owner = seed[o], owner[o]
    fresh = np.append(True, (seed[1:] != seed[:-1]) | (owner[1:] != owner[:-1])) if len(seed) else np.zeros(0, bool)
    seed, owner = seed[fresh], owner[fresh]
    seeds, first = np.unique(seed, return_index=True)
    return Index(items, words, seeds, np.append(first, len(seed)), owner)


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """Best Smith-Waterman score (match 2, mismatch and gap -1) and the window position after its last word."""
    steps = np.arange(len(window))
    row, best, end = np.zeros(len(window) + 1, np.int64), 0, 0
    for word in item:
        got = np.maximum(row[:-1] + np.where(window == word, 2, -1), row[1:] - 1)
        got = np.maximum(got, 0)
        got = np.maximum.accumulate(got + steps) - steps
        row = np.concatenate(([0], got))
        if len(got) and (top := int(got.max())) > best:
            best, end = top, int(got.argmax()) + 1
    return best, end


def _windows(x: Index, doc: np.ndarray, at: np.ndarray, k: np.ndarray, words: np.ndarray, least_hits: int):
    """(document, item, first word, last word) of each group of hits of a document that are closer than the item is long, in that order."""
    reps = np.diff(x.bounds)[k]
    nth = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
    item = x.owners[np.repeat(x.bounds[k], reps) + nth]
    doc, pos, seed = np.repeat(doc, reps), np.repeat(at, reps), np.repeat(k, reps)
    o = np.lexsort((pos, item, doc))
    doc, item, pos, seed = doc[o], item[o], pos[o], seed[o]
    fresh = np.append(True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (pos[1:] - pos[:-1] > x.sizes[item[1:]]))
    cut, group = np.flatnonzero(fresh), np.cumsum(fresh) - 1
    o = np.lexsort((seed, group))
    other = np.append(True, (group[o][1:] != group[o][:-1]) | (seed[o][1:] != seed[o][:-1]))
    enough = np.flatnonzero(np.bincount(group[o][other], minlength=len(cut)) >= least_hits)
    first, last = cut[enough], np.append(cut[1:], len(pos))[enough] - 1
    n = x.sizes[item[first]]
    return zip(doc[first].tolist(), item[first].tolist(), np.maximum(0, pos[first] - n).tolist(), np.minimum(words[doc[first]], pos[last] + n + 2).tolist(), strict=True)


def _reaches(item: np.ndarray, window: np.ndarray, least: float) -> bool:
    """False if no alignment can score so much: an item's word matches once at most, and only a word that the window holds."""
    return 2 * np.isin(item, window).sum() >= least


def _indexes(docs: DataFrame, items: DataFrame, text: str, item_key: str, item_text: str, n: int, least_words: int, block_bytes: int):
    """The broadcast index of each block of items."""
    spark = docs.sparkSession
    items = items.filter(F.col(item_text).isNotNull() & F.col(item_key).isNotNull()).select(F.col(item_key).cast("long").alias("i"), F.col(item_text).alias("t"))
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    for block in range(blocks):
        rows = sorted((r["i"], r["t"]) for r in items.filter(F.pmod(F.xxhash64("i"), F.lit(blocks)) == block).collect())
        index = build(rows, n, least_words)
        if index.items:
            yield spark.sparkContext.broadcast(index)


def contaminated(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_key: str = "item_id", item_text: str = "text", n: int = 2, least_hits: int = 3, least_words: int = 8, threshold: float = 0.45, block_bytes: int = 16 << 20) -> DataFrame:
    """(key, item_key, score, first_word, end_word) of the documents that hold a copy of an item."""
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, `{item_key}` bigint, score double, first_word int, end_word int"
    out = None
    for index in _indexes(docs, items, text, item_key, item_text, n, least_words, block_bytes):

        def run(batches, index=index):
            for b in batches:
                got = list(_found(b.column("t"), index.value, n, least_hits, threshold))
                rows = pa.array([g[0] for g in got], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("k").take(rows), pa.array([g[1] for g in got], pa.int64()), pa.array([float(g[2]) for g in got], pa.float64()), *(pa.array([g[c] for g in got], pa.int32()) for c in (3, 4))], names=[key, item_key, "score", "first_word", "end_word"])

        found = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(tidy(run), schema)
        out = found if out is None else out.union(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", n: int = 2, least_hits: int = 3, least_words: int = 8, threshold: float = 0.45, block_bytes: int = 16 << 20) -> DataFrame:
    """The rows of docs that hold no copy of an item, dropped where they are read, without a join; only texts go to Python."""
    out = docs
    for index in _indexes(docs, items, text, item_key, item_text, n, least_words, block_bytes):
        out = out.filter(~F.arrow_udf(_holder(index, n, least_hits, threshold), "boolean")(F.coalesce(F.col(text), F.lit(""))))
    return out


def _holder(index, n: int, least_hits: int, threshold: float):
    def holds(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            bad = np.zeros(len(b), bool)
            bad[[g[0] for g in _found(b, index.value, n, least_hits, threshold)]] = True
            yield pa.array(bad)
        trim()

    return holds


def _found(col: pa.Array, x: Index, n: int, least_hits: int, threshold: float):
    """(row, item id, score, first word, end word) of the rows' best copy of each item."""
    data, offsets = buffers(col)
    for lo, hi in spans(offsets):
        words, _, _, bounds = word_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], PLAIN)
        grams, gb = ngram_hashes(words, bounds, n)
        at, k = x.find(grams)
        if not len(at):
            continue
        doc = np.searchsorted(gb, at, side="right") - 1
        at -= gb[doc]
        pairs = np.cumsum(np.diff(x.bounds)[k])
        a = 0
        while a < len(at):
            z = int(np.searchsorted(pairs, (pairs[a - 1] if a else 0) + _PAIRS, side="right"))
            z = int(np.searchsorted(doc, doc[z], side="left")) if z < len(doc) else z
            z = z if z > a else int(np.searchsorted(doc, doc[a], side="right"))
            found = _windows(x, doc[a:z], at[a:z], k[a:z], np.diff(bounds), least_hits)
            for (d, item), group in groupby(found, lambda w: w[:2]):
                size, own = len(x.words[item]), words[bounds[d] : bounds[d + 1]]
                best: tuple = (0,)
                for _, _, first, last in group:
                    if not _reaches(x.words[item], own[first:last], 2 * size * threshold):
                        continue
                    s, end = align(x.words[item], own[first:last])
                    s /= 2 * size
                    if s >= threshold and s > best[0]:
                        best = (s, max(first, first + end - size), first + end)
                if best[0]:
                    yield (lo + d, x.items[item], *best)
            a = z
