"""Similarity join on word n-gram sets: all pairs with Jaccard similarity of at least num/den, as classes.

T-occurrence search by DivideSkip. A set of n n-grams needs T = ceil(n*num/den)
in common with any partner. Its inverted lists are divided: the L longest are
left alone, the others, the short ones, are merged, and how often a partner
occurs in them is counted. Two sets that need t in common share at least
t - max(L, L') n-grams of their short lists; those that occur so often are
candidates, and only for them are the long lists probed. As in DivideSkip
L = T / (1 + mu * log2 M), where M is the length of the set's longest list, and
T - 1 at most: without frequent n-grams few lists are merged, with frequent ones
more, and the count decides.

How that is spread over a cluster:

1. Rows with equal n-gram sets become one node (a 64-bit hash of the set; where a
   second hash differs, the node is renamed), so groups of exact copies, of any
   size, are one entry from here on.
2. List lengths come from a table of hashed counters over all rows. Only the
   order of the lists, and so L, depends on it; the result doesn't. Its size is
   bounded (2**24 bytes).
3. Entries of short lists are dealt to shards by n-gram hash as packed arrays;
   beyond ``direct`` shards in two steps, by lane and then by shard. A shard sorts
   its entries, which merges all its lists at once, drops lists of one entry and
   counts the pairs in the others. Counts are summed over shards.
4. Candidates are verified with their whole sets, by binary probes: whether a
   set stands in an inverted list is asked of the set instead, which is the same
   question, and the long lists need not be built. First each node's most frequent
   partner is verified; what is linked is one class from then on. Then the other
   candidates are, as far as their ends are of different classes.
5. Lists that turn out to hold over ``longest`` entries (near copies by the
   hundred) are long lists too: they aren't counted, and the needed count falls by
   as many as both sets have of them. Each entry meets ``centres`` entries of its
   list. Lists that are expected to hold over ``split`` entries are dealt to several
   shards, and share their centres.
6. Whatever such lists still hold of different classes is paired across classes
   and verified, so no link between classes is lost: the classes are exact. Both
   sides of that join are cut into blocks of a list, and entries of a list's
   largest class meet only those of others. It carries a bitmap of 512 parities for
   each set: two sets differ in as many n-grams as their bitmaps in bits, at least,
   and pairs that differ in too many are no pairs.

N-grams are compared by 64-bit hashes of their words, A-Z lower-cased.

Defined results: null, empty or white-space-only text has 0 n-grams, links with
nothing, and its class is its own id; a text with fewer than n words has one
n-gram, the whole sequence; repeated rows are in one class; a null id takes
part but is never a class's id unless all ids of the class are null; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granella.llm.common import U64, buffers, discard, free_name, let_go, mix, ngram_hashes, pack, signed, spans, tidy, unpack, without_broadcasts, word_hashes, written
from granella.llm.components import components

_COUNTERS = 1 << 14
_FLUSH = 600_000
#: Entries of short lists that a shard holds, about, and shards that entries are dealt to in one step.
_SHARD = 2_000_000
DIRECT = 2048
#: Rows of a block of a long list, on either side of the join across classes; parts that a list's rows are spread over before.
_BLOCK, _PARTS = 512, 32


def _sets(data: np.ndarray, offsets: np.ndarray, n: int):
    """For each row, its distinct n-gram hashes in ascending order."""
    words, _, _, bounds = word_hashes(data, offsets)
    grams, b = ngram_hashes(words, bounds, n, short=True)
    for i in range(len(b) - 1):
        g = np.sort(grams[b[i] : b[i + 1]])
        yield g[np.append(True, g[1:] != g[:-1])] if len(g) > 1 else g


def _hash(g: np.ndarray, salt: int) -> int:
    s = np.add.reduce(mix(g ^ U64(salt)), dtype=U64) + U64(len(g))
    return int(mix(np.array([s], U64)).view(np.int64)[0])


class Names:
    """Numbers of sets. clashes: names of sets with equal first hashes, by both hashes; node_bits: bits of the first hash that are used."""

    def __init__(self, node_bits: int = 64):
        self.node_bits, self.clashes = node_bits, {}

    def first(self, g: np.ndarray) -> int:
        return _hash(g, 0xA24BAED4963EE407) >> (64 - self.node_bits)

    def second(self, g: np.ndarray) -> int:
        return _hash(g, 0x9FB21C651E98DF25)

    def __call__(self, g: np.ndarray) -> int:
        node = self.first(g)
        return self.clashes.get((node, self.second(g)), node) if self.clashes else node

    def column(self, node: Column, other: Column) -> Column:
        """The same for columns of both hashes."""
        out = node
        for (a, b), name in self.clashes.items():
            out = F.when((node == a) & (other == b), name).otherwise(out)
        return out


def _parities(g: np.ndarray) -> list[int]:
    """Eight longs: of each of 512 bits, whether an odd number of n-grams hashes to it."""
    odd = np.bincount((mix(g ^ U64(0x5851F42D4C957F2D)) >> U64(55)).astype(np.int64), minlength=512) & 1
    return np.packbits(odd.astype(bool)).view(np.int64).tolist()


def _required(n, num: int, den: int):
    """Least overlap that a set of size n needs with any partner."""
    return (num * n + den - 1) // den


def _both_required(s, num: int, den: int):
    """Least overlap of two sets whose sizes add up to s."""
    return (num * s + num + den - 1) // (num + den)


def describe(docs: DataFrame, text: str, key: str, n: int, bits: int, names: Names) -> DataFrame:
    """Rows (k, h, size, node, other, bits) of all documents, and rows (block, counts) of hashed n-gram counters."""
    kinds = {"k": pa.int64(), "h": pa.int64(), "size": pa.int64(), "node": pa.int64(), "other": pa.int64(), "bits": pa.list_(pa.int64()), "block": pa.int32(), "counts": pa.binary()}

    def batch(m: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(m, kind) for c, kind in kinds.items()], names=list(kinds))

    def run(batches):
        counters = np.zeros(1 << bits, np.uint32)
        for b in batches:
            data, offsets = buffers(b.column("t"))
            got = []
            for lo, hi in spans(offsets):
                every = []
                for g in _sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], n):
                    got.append((len(g), names.first(g), names.second(g), _parities(g)) if len(g) else (0, None, None, None))
                    every.append(g)
                if every and (at := np.concatenate(every)).size:
                    at = (at >> U64(64 - bits)).astype(np.int64)
                    if len(at) > 1 << bits:
                        counters += np.bincount(at, minlength=1 << bits).astype(np.uint32)
                    else:
                        at, k = np.unique(at, return_counts=True)
                        counters[at] += k.astype(np.uint32)
            own = {c: pa.array([r[i] for r in got], kinds[c]) for i, c in enumerate(("size", "node", "other", "bits"))}
            yield batch(len(got), k=b.column("k"), h=b.column("h"), **own)
        blocks = [i for i in range(0, 1 << bits, _COUNTERS) if counters[i : i + _COUNTERS].any()]
        yield batch(len(blocks), block=pa.array([i // _COUNTERS for i in blocks], pa.int32()), counts=pa.array([zlib.compress(counters[i : i + _COUNTERS].tobytes(), 1) for i in blocks], pa.binary()))

    schema = "k bigint, h bigint, size bigint, node bigint, other bigint, bits array<bigint>, block int, counts binary"
    return docs.select(F.col(key).cast("long").alias("k"), _row_hash(key, text).alias("h"), F.col(text).alias("t")).mapInArrow(tidy(run), schema)


def _row_hash(key: str, text: str) -> Column:
    return F.xxhash64(F.col(key).cast("string"), F.col(text))


class Levels:
    """About how long a list is. levels: a byte for each counter, 0 for those near the mean or below, then four steps for every doubling."""

    def __init__(self, described: DataFrame, bits: int, split: int):
        def total(batches):
            got: dict[int, np.ndarray] = {}
            for b in batches:
                for block, c in zip(b.column("block").to_pylist(), b.column("counts").to_pylist(), strict=True):
                    x = np.frombuffer(zlib.decompress(c), np.uint32)
                    got[block] = got[block] + x if block in got else x.astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int32()), pa.array([v.sum() for v in got.values()], pa.int64()), pa.array([(np.log2(v + 1.0) * 4).astype(np.uint8).tobytes() for v in got.values()], pa.binary())], names=["block", "n", "levels"])

        rows = described.filter("block is not null").select("block", "counts").repartition("block").mapInArrow(tidy(total), "block int, n bigint, levels binary").collect()
        levels = np.zeros(1 << bits, np.uint8)
        for r in rows:
            levels[r["block"] * _COUNTERS : (r["block"] + 1) * _COUNTERS] = np.frombuffer(r["levels"], np.uint8)
        self.entries, self.bits, self.split = sum(r["n"] for r in rows), bits, split
        mean = self.entries / (1 << bits)
        self.floor = int(np.log2(mean + 4 * mean**0.5 + 3) * 4)
        self.levels = np.where(levels > self.floor, levels - self.floor, 0).astype(np.uint8)

    def of(self, grams: np.ndarray) -> np.ndarray:
        return self.levels[(grams >> U64(64 - self.bits)).astype(np.int64)]

    def doublings(self, level: int) -> float:
        """Binary logarithm of a list's length."""
        return (self.floor + int(level)) / 4 if level else 1.0

    def _parts(self, level: np.ndarray) -> np.ndarray:
        level = level.astype(np.float64)
        return np.where(level > 0, np.maximum(1, np.exp2((level + self.floor) / 4) // self.split), 1).astype(np.int64)

    def parts(self, grams: np.ndarray) -> np.ndarray:
        """Shards that a list is dealt to: one for each ``split`` entries it may have."""
        return self._parts(self.of(grams))

    def several(self) -> bool:
        """Whether any list is dealt to several shards. Only the highest level is looked at: arrays of numbers for all counters would take the driver a gigabyte."""
        return bool((self._parts(self.levels.max(keepdims=True)) > 1).any())


def _entries(docs: DataFrame, text: str, n: int, num: int, den: int, mu: float, names: Names, levels, shards: int, lanes: int) -> DataFrame:
    """Short-list entries of every node, packed by shard (or lane of shards) of the n-gram's hash."""

    def run(batches):
        seen: set[int] = set()
        held: list[tuple] = []
        known, count = levels.value, 0
        for b in batches:
            data, offsets = buffers(b.column("t"))
            for lo, hi in spans(offsets):
                for g in _sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], n):
                    if not len(g) or (node := names(g)) in seen:
                        continue
                    seen.add(node)
                    level = known.of(g)
                    need = _required(len(g), num, den)
                    skipped = min(need - 1, int(need / (1 + mu * known.doublings(level.max()))))
                    o = np.argsort(level, kind="stable")[: len(g) - skipped]
                    held.append((g[o], node, len(g), skipped))
                    count += len(o)
                if count >= _FLUSH:
                    yield _dealt(_spread(held, known), lanes, shards)
                    held, count = [], 0
        if held:
            yield _dealt(_spread(held, known), lanes, shards)

    return docs.select(F.col(text).alias("t")).mapInArrow(tidy(run), _PACKED)


_PACKED = "shard int, n int, tok binary, rest binary"
_REST = (np.int64, np.int32, np.int32, np.int32, np.int32)


def _spread(held: list[tuple], known: Levels) -> tuple[np.ndarray, ...]:
    """n-gram, node, size, place, skipped lists and part of every entry."""
    tok = np.concatenate([h[0] for h in held])
    sizes = np.array([len(h[0]) for h in held])
    node, size, skipped = (np.repeat(np.array([h[i] for h in held], kind), sizes) for i, kind in ((1, np.int64), (2, np.int32), (3, np.int32)))
    pos = np.concatenate([np.arange(k, dtype=np.int32) for k in sizes])
    part = (mix(node.view(U64)) % known.parts(tok).astype(U64)).astype(np.int32)
    return tok, node, size, pos, skipped, part


def _shard_of(tok: np.ndarray, part: np.ndarray, shards: int) -> np.ndarray:
    return (mix(tok + part.astype(U64) * U64(0x9E3779B97F4A7C15)) % U64(shards)).astype(np.int64)


def _dealt(entries: tuple[np.ndarray, ...], lanes: int, shards: int) -> pa.RecordBatch:
    """A packed row for each shard that entries go to, or for each of ``lanes`` ranges of shards."""
    tok, *rest = entries
    shard = _shard_of(tok, rest[-1], shards) * lanes // shards
    o = np.lexsort((tok, shard))
    tok, rest, shard = tok[o], [x[o] for x in rest], shard[o]
    at = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
    end = np.append(at[1:], len(shard))
    packed = [(pack(tok[a:z]), pa.compress(b"".join(np.ascontiguousarray(x[a:z].view(np.uint8).reshape(z - a, -1).T).tobytes() for x in rest), codec="zstd", asbytes=True)) for a, z in zip(at, end, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(shard[at], pa.int32()), pa.array(end - at, pa.int32()), pa.array([p[0] for p in packed], pa.binary()), pa.array([p[1] for p in packed], pa.binary())], names=["shard", "n", "tok", "rest"])


def _unpacked(b: pa.RecordBatch):
    """n-gram, node, size, place, skipped lists and part of the entries of each packed row."""
    width = sum(np.dtype(kind).itemsize for kind in _REST)
    for n, tok, rest in zip(b.column("n").to_pylist(), b.column("tok").to_pylist(), b.column("rest").to_pylist(), strict=True):
        raw, out, at = np.frombuffer(pa.decompress(rest, decompressed_size=width * n, codec="zstd", asbytes=True), np.uint8), [], 0
        for kind in _REST:
            size = np.dtype(kind).itemsize
            out.append(np.ascontiguousarray(raw[at : at + size * n].reshape(size, n).T).view(kind).ravel())
            at += size * n
        yield unpack(tok, n), *out


def _to_shards(entries: DataFrame, shards: int, lanes: int, tasks: int) -> DataFrame:
    """Rows of lanes dealt on to their shards, many entries at once, by so many tasks for each lane."""

    def run(batches):
        held, count = [], 0
        for b in batches:
            for e in _unpacked(b):
                held.append(e)
                count += len(e[0])
                if count >= _FLUSH:
                    yield _dealt(tuple(np.concatenate(x) for x in zip(*held, strict=True)), shards, shards)
                    held, count = [], 0
        if held:
            yield _dealt(tuple(np.concatenate(x) for x in zip(*held, strict=True)), shards, shards)

    task = F.col("shard") * tasks + F.pmod(F.xxhash64("tok"), F.lit(tasks)).cast("int")
    return entries.repartitionById(lanes * tasks, task).mapInArrow(tidy(run), _PACKED)


_FOUND = "kind int, a bigint, b bigint, x int, y int, part int"


def _rows(kind: int, a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, part: np.ndarray | None = None) -> pa.RecordBatch:
    n = len(a)
    columns = [pa.array(np.full(n, kind, np.int32)), pa.array(np.ascontiguousarray(a)), pa.array(np.ascontiguousarray(b)), pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32))]
    return pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.int32()) if part is None else pa.array(part.astype(np.int32))], names=["kind", "a", "b", "x", "y", "part"])


def _merge(entries: DataFrame, shards: int, num: int, den: int, levels, longest: int, centres: int) -> DataFrame:
    """Merge each shard's lists.

    Rows of kind 0: pairs (a, b), how often they occur (x) and how often they must
    (y). Kind 1: entries of long lists, node a, n-gram b, size x, place y. Kind 2:
    pairs of an entry and a centre of long lists, and in how many lists (x). Kind 3:
    the centres of lists that are dealt to several shards, as kind 1.
    """

    def distinct(a, b, need):
        """Pairs without repeats, with how often they came."""
        a, b = np.minimum(a, b), np.maximum(a, b)
        o = np.lexsort((b, a))
        a, b = a[o], b[o]
        first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        return a[first], b[first], np.diff(np.append(first, len(a))), need[o][first]

    def run(batches):
        got = [x for b in batches for x in _unpacked(b)]
        if not got:
            return
        tok, node, size, pos, skipped, part = (np.concatenate(x) for x in zip(*got, strict=True))
        del got
        o = np.lexsort((node, tok))
        tok, node, size, pos, skipped, part = (x[o] for x in (tok, node, size, pos, skipped, part))
        fresh = np.append(True, (tok[1:] != tok[:-1]) | (node[1:] != node[:-1]))
        tok, node, size, pos, skipped, part = (x[fresh] for x in (tok, node, size, pos, skipped, part))
        at = np.flatnonzero(np.append(True, tok[1:] != tok[:-1]))
        m = np.diff(np.append(at, len(tok)))
        parts = levels.value.parts(tok[at])
        long = (m > longest) | (parts > 1)
        found: list[tuple] = []

        def flushed(kind: int, least: int):
            if sum(len(f[0]) for f in found) >= max(least, 1):
                a, b, c, need = distinct(*(np.concatenate(x) for x in zip(*found, strict=True)))
                found.clear()
                yield _rows(kind, a, b, c, need)

        def pairs(i, j, early: bool):
            """Those of entries that may be linked: by their sizes, and for centres by their places."""
            both = size[i].astype(np.int64) + size[j]
            t = _both_required(both, num, den)
            ok = (den * np.minimum(size[i], size[j]).astype(np.int64) >= num * np.maximum(size[i], size[j]).astype(np.int64)) & (node[i] != node[j])
            if early:
                ok &= np.minimum(size[i] - pos[i], size[j] - pos[j]) >= t
            i, j = i[ok], j[ok]
            return node[i], node[j], t[ok] - np.maximum(skipped[i], skipped[j])

        for length in np.unique(m[(m > 1) & ~long]):
            i, j = np.triu_indices(length, 1)
            lists = at[(m == length) & ~long]
            step = max(1, 400_000 // len(i))
            for lo in range(0, len(lists), step):
                first = lists[lo : lo + step, None]
                found.append(pairs((first + i).ravel(), (first + j).ravel(), False))
                yield from flushed(0, 500_000)
        yield from flushed(0, 0)
        for first, length, several in zip(at[long], m[long], parts[long] > 1, strict=True):
            every = np.arange(first, first + length)
            # entries late in their order pair with few others: they are centres only where there is nothing else
            early = every[size[every] - pos[every] >= _both_required(2 * size[every].astype(np.int64), num, den)]
            early = early if len(early) else every
            of_all, of_list = (early[np.argsort(mix(node[early].view(U64) ^ salt))] for salt in (U64(0), tok[first]))
            chosen = np.unique(np.concatenate((of_all[: centres - centres // 2], of_list[: centres // 2])))
            if several:
                yield _rows(3, node[chosen], signed(tok[chosen]), size[chosen], pos[chosen])
                continue
            for centre in chosen:
                found.append(pairs(every, np.full(length, centre), True))
            yield from flushed(2, 500_000)
        yield from flushed(2, 0)
        inside = np.repeat(long, m)
        if inside.any():
            yield _rows(1, node[inside], signed(tok[inside]), size[inside], pos[inside], np.where(np.repeat(parts > 1, m), part, -1)[inside])

    return entries.repartitionById(shards, F.col("shard")).mapInArrow(tidy(run), _FOUND)


def _bounds(x: str, y: str, num: int, den: int) -> Column:
    """What sizes and places of two entries of a list allow; columns size_ and pos_ of both."""
    sx, sy = F.col(f"size_{x}").cast("long"), F.col(f"size_{y}").cast("long")
    return (F.least(sx, sy) * den >= F.greatest(sx, sy) * num) & (F.least(sx - F.col(f"pos_{x}"), sy - F.col(f"pos_{y}")) * (num + den) >= (sx + sy) * num)


def _shared_centres(merged: DataFrame, centres: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b, x) of entries of lists in several shards with the list's centres: the same for all its shards."""
    entry = [F.col("a").alias("node"), F.col("b").alias("tok"), F.col("x").alias("size"), F.col("y").alias("pos")]
    rank = F.struct(F.xxhash64("node").alias("r"), "node", "size", "pos")
    best = merged.filter("kind = 3").select(*entry).groupBy("tok").agg(F.slice(F.sort_array(F.collect_set(rank)), 1, centres).alias("c"))
    # a list's parts are known from its entries; a centre goes to each
    parts = merged.filter("kind = 1 and part >= 0").select(F.col("b").alias("tok"), "part").distinct()
    c = best.join(parts, "tok").select("tok", "part", F.explode("c").alias("c")).select("tok", "part", F.col("c.node").alias("node_c"), F.col("c.size").alias("size_c"), F.col("c.pos").alias("pos_c"))
    e = merged.filter("kind = 1 and part >= 0").select(*(x.alias(f"{n}_e") if n != "tok" else x for x, n in zip(entry, ("node", "tok", "size", "pos"), strict=True)), "part")
    met = e.join(c, ["tok", "part"]).filter((F.col("node_e") != F.col("node_c")) & _bounds("e", "c", num, den))
    return met.select(F.least("node_e", "node_c").alias("a"), F.greatest("node_e", "node_c").alias("b")).groupBy("a", "b").agg(F.count("*").cast("int").alias("x"))


def _candidates(merged: DataFrame, num: int, den: int, centres: int, split: bool) -> DataFrame:
    """Pairs (a, b, x) that occur as often as they must, and those of entries and centres."""
    counted = merged.filter("kind = 0").groupBy("a", "b").agg(F.sum("x").alias("x"), F.min("y").alias("need"))
    hot = merged.filter("kind = 1").groupBy("a").agg(F.count("*").alias("n")).withColumnRenamed("a", "node")
    for side in "ab":
        counted = counted.join(hot.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}")), side, "left")
    spare = F.least(F.coalesce("n_a", F.lit(0)), F.coalesce("n_b", F.lit(0)))
    enough = counted.filter(F.col("x") >= F.col("need") - spare).select("a", "b", "x")
    near = merged.filter("kind = 2").groupBy("a", "b").agg(F.sum("x").alias("x"))
    if split:
        near = near.union(_shared_centres(merged, centres, num, den))
    return enough.union(near).groupBy("a", "b").agg(F.sum("x").alias("x"))


def _best(candidates: DataFrame) -> DataFrame:
    """Each node's most frequent partner, as pairs (a, b)."""
    ends = candidates.select(F.col("a").alias("u"), F.col("b").alias("v"), "x").union(candidates.select("b", "a", "x"))
    best = ends.groupBy("u").agg(F.max_by("v", F.struct("x", F.col("v").alias("v"))).alias("v"))
    return best.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()


def _wanted(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """(node, h) of the nodes asked for: a document of each. It is a table, since it is counted, mapped and joined."""
    return written(nodes.join(members.filter("node is not null").groupBy("node").agg(F.min("h").alias("h")), "node"), "wanted", tasks_per_slot=4)


def _set_table(docs: DataFrame, want: DataFrame, text: str, key: str, n: int, names: Names, small: bool) -> DataFrame:
    """(node, grams) of the nodes wanted: one document of each is read again. With small, 16 bits of each n-gram.

    A bitmap of at most 4 MB drops most other documents before they are hashed;
    a join drops the rest.
    """
    bitmap = _bitmap(want, want.count())
    bits, packed = 8 * len(bitmap), docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        for b in batches:
            h = b.column("h").to_numpy(zero_copy_only=False)
            take = np.flatnonzero(packed.value[h % bits >> 3] >> (h % 8).astype(np.uint8) & 1)
            data, offsets = buffers(b.column("t").take(pa.array(take)))
            for lo, hi in spans(offsets):
                g = list(_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], n))
                yield pa.RecordBatch.from_arrays([pa.array([names(x) if len(x) else None for x in g], pa.int64()), pa.array(h[take[lo:hi]]), pa.array([(np.sort((x & U64(0xFFFF)).astype(np.uint16)) if small else x).tobytes() for x in g], pa.binary())], names=["node", "h", "grams"])

    sets = docs.select(_row_hash(key, text).alias("h"), F.col(text).alias("t")).mapInArrow(tidy(run), "node bigint, h bigint, grams binary")
    return sets.join(want, ["node", "h"]).groupBy("node").agg(F.first("grams").alias("grams"))


def _bits(rows: DataFrame, count: int) -> tuple[DataFrame, int]:
    """(bucket, bits) of a bitmap of the rows' column h, and how many bits it has: bit h modulo that number, lowest bits first; 16 bits for each row, 4 MB at most."""
    bits = 1 << min(25, max(15, int(count * 16).bit_length()))
    bit = F.pmod(F.col("h"), F.lit(bits)) + 1  # bitmap functions count from 1
    return rows.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")), bits


def _bitmap(rows: DataFrame, count: int) -> np.ndarray:
    """Its bytes."""
    found, bits = _bits(rows, count)
    out = np.zeros(bits // 8, np.uint8)
    for r in found.collect():
        at = (r["bucket"] - 1) * 4096
        out[at : at + 4096] |= np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def _parted(docs: DataFrame, row: Column, losers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs that a bitmap of the losers has, and the others. Its buckets are a table that is broadcast: as a constant of the plan, megabytes would be spelt out in every text of the plan that the driver makes."""
    buckets, bits = _bits(losers, losers.count())
    buckets = F.broadcast(written(buckets, "bitmap", tasks_per_slot=1))
    bit, bucket, found = F.pmod(row, F.lit(bits)), free_name(docs.columns, "bucket"), free_name(docs.columns, "bits")
    met = docs.join(buckets.toDF(bucket, found), F.bitmap_bucket_number(bit + 1) == F.col(bucket), "left")
    byte = F.conv(F.hex(F.substring(F.col(found), F.floor(bit % 32768 / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    perhaps = F.coalesce(F.call_function("shiftright", byte, (bit % 8).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    return met.filter(perhaps).select(*docs.columns), met.filter(~perhaps).select(*docs.columns)


def _numbered(x: np.ndarray) -> np.ndarray:
    """Sorted 16-bit values made distinct: each with how many of its kind came before."""
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    return (x.astype(np.int64) << 32) + np.arange(len(x)) - np.repeat(first, np.diff(np.append(first, len(x))))


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Binary probes of the longer sorted array with the values of the shorter one."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def _reaching(pairs: DataFrame, sets: DataFrame, num: int, den: int, small: bool) -> DataFrame:
    """Those pairs (a, b) whose sets reach the similarity; with small, those that may."""

    def run(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column("ga"), b.column("gb"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint16 if small else U64) for v in (x, y))
                both = _common(_numbered(x), _numbered(y)) if small else _common(x, y)
                ok.append(den * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    a, b = sets.select(F.col("node").alias("a"), F.col("grams").alias("ga")), sets.select(F.col("node").alias("b"), F.col("grams").alias("gb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "ga", "gb").mapInArrow(tidy(run), "a bigint, b bigint")


def _verified(docs: DataFrame, pairs: DataFrame, members: DataFrame, text: str, key: str, n: int, num: int, den: int, names: Names) -> DataFrame:
    """Those pairs (a, b) whose sets reach the similarity: first by 16 bits of each n-gram, then in full."""
    for small in (True, False):
        want = _wanted(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), members)
        last, pairs = pairs, written(_reaching(pairs, _set_table(docs, want, text, key, n, names, small), num, den, small), "links", tasks_per_slot=4)
        discard(last, want)
        let_go(docs.sparkSession)
    return pairs


def _mixed(long: DataFrame, roots: DataFrame, members: DataFrame) -> DataFrame:
    """Entries of the long lists that hold more than one class, with their class, whether it is the list's largest, blocks and parities."""
    long = long.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(_PARTS)))
    sizes = long.groupBy("tok", "root").agg(F.count("*").alias("n"))
    lists = sizes.groupBy("tok").agg(F.sum("n").alias("m"), F.max("n").alias("most"), F.max_by("root", F.struct("n", "root")).alias("largest"), F.count("*").alias("classes")).filter("classes > 1")
    lists = lists.select("tok", "largest", F.ceil((F.col("m") - F.col("most")) / _BLOCK).cast("int").alias("kx"), F.ceil(F.col("m") / _BLOCK).cast("int").alias("ky"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_PARTS - 1).cast("long"))).alias("salt"))
    long = long.join(lists, ["tok", "salt"])
    bits = members.filter("node is not null").groupBy("node").agg(F.first("bits").alias("bits"))
    out = long.join(bits, "node").select("tok", "node", "root", "size", "pos", "kx", "ky", (F.col("root") == F.col("largest")).alias("main"), *(F.col("bits")[i].alias(f"b{i}") for i in range(8)))
    return written(out, "long", tasks_per_slot=4)


def _across(mixed: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct pairs of entries of one list and of different classes, that pass the bounds of size, position and parities.

    Entries that aren't of a list's largest class meet all entries of other
    classes, a block of the ones and a block of the others at a time.
    """

    def side(s: str, rows: DataFrame, own: str, other: str) -> DataFrame:
        own_block = F.pmod(F.xxhash64("node"), F.col(own)).cast("int").alias(own[1])
        rows = rows.select("*", own_block, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other[1]))
        return rows.select("tok", "x", "y", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "root", "size", "pos", "main", *(f"b{i}" for i in range(8)))))

    x, y = side("x", mixed.filter("not main"), "kx", "ky"), side("y", mixed, "ky", "kx")
    total = (F.col("size_x") + F.col("size_y")).cast("long")
    apart = sum((F.bit_count(F.col(f"b{i}_x").bitwiseXOR(F.col(f"b{i}_y"))) for i in range(8)), F.lit(0))
    once = F.col("main_y") | (F.col("root_x") < F.col("root_y"))
    met = x.join(y, ["tok", "x", "y"]).filter((F.col("root_x") != F.col("root_y")) & once & _bounds("x", "y", num, den) & ((total - apart) * (num + den) >= total * 2 * num))
    return met.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()


def _clashes(members: DataFrame) -> dict[tuple[int, int], int]:
    """New names for sets that share their first hash: n * n / 2**65 of n sets, so hardly ever any."""
    twice = members.filter("node is not null").groupBy("node").agg(F.min("other").alias("least"), F.max("other").alias("most")).filter("least <> most").select("node")
    rows = members.join(twice, "node", "left_semi").select("node", "other").distinct().collect()
    return {(r["node"], r["other"]): int(mix(np.array([(r["node"] ^ (r["other"] * 3)) & (2**64 - 1)], U64)).view(np.int64)[0]) for r in rows}


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b) whose ends are of different classes."""
    for side in "ab":
        pairs = pairs.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"r_{side}")), side, "left")
    return pairs.filter(F.coalesce("r_a", "a") != F.coalesce("r_b", "b")).select("a", "b")


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Classes and further links as classes: a class's links to its root stand for those it was made of."""
    return roots if links.isEmpty() else components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links))


def _named(docs: DataFrame, text: str, key: str, n: int, num: int, den: int, longest: int, centres: int, mu: float, split: int, direct: int, node_bits: int) -> tuple[DataFrame, DataFrame]:
    """Members (k, h, size, node) and, of every node, its class and the least (k, h) of the class with a key."""
    with without_broadcasts(docs.sparkSession):
        return _found(docs, text, key, n, num, den, longest, centres, mu, split, direct, node_bits)


def _found(docs: DataFrame, text: str, key: str, n: int, num: int, den: int, longest: int, centres: int, mu: float, split: int, direct: int, node_bits: int) -> tuple[DataFrame, DataFrame]:
    spark = docs.sparkSession
    rows, names = docs.count(), Names(node_bits)
    bits = min(24, max(16, int(rows * 32).bit_length()))
    described = written(describe(docs, text, key, n, bits, names), "sets")
    members = described.filter("block is null")
    names.clashes = _clashes(members)
    members = members.withColumn("node", names.column(F.col("node"), F.col("other")))
    known = Levels(described, bits, split)
    levels = spark.sparkContext.broadcast(known)
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), known.entries // (2 * _SHARD))
    lanes = shards if shards <= direct else math.isqrt(shards - 1) + 1
    entries = _entries(docs, text, n, num, den, mu, names, levels, shards, lanes)
    if lanes < shards:
        entries = _to_shards(entries, shards, lanes, max(1, shards // (16 * lanes)))
    merged = written(_merge(entries, shards, num, den, levels, longest, centres), "merged", tasks_per_slot=16)
    pairs = written(_candidates(merged, num, den, centres, known.several()), "pairs", tasks_per_slot=4)
    verified = lambda some: _verified(docs, some, members, text, key, n, num, den, names)
    first = written(_best(pairs), "pairs", tasks_per_slot=4)
    roots = components(verified(first))
    rest = written(_apart(pairs.join(_best(pairs), ["a", "b"], "left_anti"), roots), "pairs", tasks_per_slot=4)
    if not rest.isEmpty():
        roots = _joined(roots, verified(rest))
    long = merged.filter("kind = 1").select(F.col("a").alias("node"), F.col("b").alias("tok"), F.col("x").alias("size"), F.col("y").alias("pos"))
    if not long.isEmpty():
        more = written(_across(_mixed(long, roots, members), num, den).join(pairs, ["a", "b"], "left_anti"), "pairs", tasks_per_slot=4)
        if not more.isEmpty():
            roots = _joined(roots, verified(more))
    discard(merged, pairs)
    levels.destroy()
    let_go(spark)
    own = F.when(F.col("k").isNotNull(), F.struct("k", "h"))
    nodes = members.filter("node is not null").groupBy("node").agg(F.min(own).alias("least")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = nodes.groupBy("root").agg(F.min("least").alias("least"))
    return members, nodes.select("node", "root").join(least, "root")


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id", n: int = 5, num: int = 75, den: int = 100, longest: int = 64, centres: int = 4, mu: float = 0.01, split: int = 50_000, direct: int = DIRECT, node_bits: int = 64) -> DataFrame:
    """key, n_shingles and component_id (the smallest key of the class) of every row. Keys are integers."""
    members, named = _named(docs, text, key, n, num, den, longest, centres, mu, split, direct, node_bits)
    named = named.select("node", F.col("least.k").alias("component"))
    return members.join(named, "node", "left").select(F.col("k").alias(key), F.col("size").alias("n_shingles"), F.coalesce("component", F.col("k")).alias("component_id"))


def survivors(docs: DataFrame, text: str = "text", key: str = "doc_id", n: int = 5, num: int = 75, den: int = 100, longest: int = 64, centres: int = 4, mu: float = 0.01, split: int = 50_000, direct: int = DIRECT, node_bits: int = 64) -> DataFrame:
    """docs with one row of each class: the one with the smallest key, and of several texts with that key the one with the least hash.

    Rows go by their key and text, so different texts that share a key are judged
    apart. Rows with a null key and rows without words stay. Rows that a bitmap of
    those that go doesn't have stay where they are; only the others are joined.
    """
    members, named = _named(docs, text, key, n, num, den, longest, centres, mu, split, direct, node_bits)
    losers = members.join(named, "node").filter("k is not null and (k <> least.k or h <> least.h)").select("k", "h").distinct()
    losers = written(losers, "losers", tasks_per_slot=4)
    row = _row_hash(key, text)
    perhaps, others = _parted(docs, row, losers)
    out = others.union(perhaps.join(losers, (F.col(key).cast("long") == losers["k"]) & (row == losers["h"]), "left_anti").select(*docs.columns))
    repeated = members.filter("k is not null and node is not null").groupBy("k", "h").count().filter("count > 1")
    if repeated.isEmpty():
        return out
    alone = F.col(key).isNull() | ~F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    name = free_name(docs.columns, "row_hash")
    once = out.filter(~alone).withColumn(name, row).dropDuplicates([key, name]).select(*docs.columns)
    return once.union(out.filter(alone))
