"""Stupid-backoff scores of documents under n-gram counts of a corpus, computed as joins.

1. Rows are packed, as they are read, into groups of a few MB of text, and the
   groups are written once. A group explodes its texts into n-grams of 1 to
   ``order`` words and sums equal ones (64-bit hashes), with how often training
   rows hold them. One packed row for each (group, range of the hash) goes out,
   so a frequent n-gram costs a group one entry, however often it occurs.
2. Shards, ranges of the hash, are the count tables: each sums its n-grams over
   all groups and answers every group with the counts it asked for. That is the
   join of n-grams and counts, with a packed array for the entries of one group
   in one range instead of a row for each.
3. Groups meet the answers to their own n-grams, look every token up and sum
   logarithms per document.

A group sends a row to every shard it has n-grams of. Beyond ``direct`` shards
these rows would get small, so relays stand between: a group sends a row to each
of about sqrt(shards) lanes, a relay sums the rows of many groups in a lane and
asks the lane's shards in their stead, and splits the answers. Rows then number
groups x sqrt(shards), with thousands of entries each, whatever the corpus.

A token w after context h scores count(h w) / count(h) if h w was seen in the
corpus, else ``backoff`` times its score after the context shortened by its
first word; without context it scores count(w) / N, and an unseen word
``backoff`` / N. At a text's beginning contexts are shorter. The document's
score is the sum of natural logarithms. Counts have 64 bits.

Words are runs of non-white-space, A-Z lower-cased. What is shuffled grows with
the corpus; nothing but its size and N reaches the driver.

Defined results: null, empty or white-space-only text: 0 tokens, log_score 0.0,
mean null; without any training token N counts as 1; rows with a null train
flag don't train; repeated rows count and score once each; a null key is a key
like others; an empty table gives no rows; other columns are ignored. A text is
never split, so the longest text bounds a group from below.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granella.llm.common import U64, buffers, ngram_hashes, pack, spans, tidy, trim, unpack, word_hashes, written

GROUP_BYTES = 4 << 20
#: Groups ask shards themselves up to so many shards, and through relays beyond.
DIRECT = 4096
_REQUEST = "asker bigint, cell int, n int, total bigint, size bigint, hashes binary, counts binary"
_ANSWER = "asker bigint, cell int, n int, total bigint, size bigint, counts binary"


def _pack_counts(c: np.ndarray) -> bytes:
    """Counts as one byte each, and eight more for those of 255 or over."""
    large = c[c >= 255].astype(U64)
    return pa.compress(np.minimum(c, 255).astype(np.uint8).tobytes() + large.tobytes(), codec="zstd", asbytes=True) + len(large).to_bytes(8, "big")


def _unpack_counts(b: bytes, n: int) -> np.ndarray:
    large = int.from_bytes(b[-8:], "big")
    raw = pa.decompress(b[:-8], decompressed_size=n + 8 * large, codec="zstd", asbytes=True)
    c = np.frombuffer(raw[:n], np.uint8).astype(U64)
    c[c == 255] = np.frombuffer(raw[n:], U64)
    return c


def _grams(col: pa.Array | pa.ChunkedArray, order: int):
    """For each order the n-gram hashes of all rows and their row bounds."""
    data, offsets = buffers(col)
    words, counts = [], []
    for lo, hi in spans(offsets):
        w, _, _, b = word_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        words.append(w)
        counts.append(np.diff(b))
    bounds = np.zeros(len(offsets), np.int64)
    if words:
        np.cumsum(np.concatenate(counts), out=bounds[1:])
    words = np.concatenate(words) if words else np.zeros(0, U64)
    return [ngram_hashes(words, bounds, n) for n in range(1, order + 1)]


def _groups(docs: DataFrame, train: Column, text: str, key: str) -> DataFrame:
    """(g, rows): the texts in groups of GROUP_BYTES, one text at least; rows is an Arrow stream of k, t and train."""

    def packed(rows: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        table = pa.Table.from_batches(rows)
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(table)
        g = (TaskContext.get().partitionId() << 32) + number
        return pa.RecordBatch.from_arrays([pa.array([g], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["g", "rows"])

    def run(batches):
        held, size, number = [], 0, 0
        for b in batches:
            offsets = buffers(b.column("t"))[1]
            lo = 0
            while lo < b.num_rows:
                room = offsets[lo] + GROUP_BYTES - size
                hi = int(np.searchsorted(offsets, room, side="right")) - 1
                if hi <= lo and not size:
                    hi = lo + 1
                if hi > lo:
                    held.append(b.slice(lo, hi - lo))
                    size += int(offsets[hi] - offsets[lo])
                    lo = hi
                if lo < b.num_rows:
                    yield packed(held, number)
                    held, size, number = [], 0, number + 1
        if held:
            yield packed(held, number)

    return docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"), train.alias("train")).mapInArrow(tidy(run), "g bigint, rows binary")


def _cells(u: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """The ranges of the hash that ascending hashes fall in, of so many equal ones, and where each begins in u (one more number)."""
    cell = ((u >> U64(32)) * U64(cells)) >> U64(32)
    at = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(u) else np.zeros(0, np.int64)
    return cell[at].astype(np.int64), np.append(at, len(u))


class _Rows:
    """Request rows of one asker after the other."""

    def __init__(self):
        self.rows: list[tuple] = []

    def add(self, asker: int, n: int, u: np.ndarray, c: np.ndarray, cells: int) -> None:
        """Ascending hashes u with their counts c, a row for each range of the hash that is not empty."""
        cell, at = _cells(u, cells)
        for s, a, b in zip(cell.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
            self.rows.append((asker, s, n, int(c[a:b].sum()), b - a, pack(u[a:b]), _pack_counts(c[a:b])))

    def batch(self) -> pa.RecordBatch:
        return _batch(self.rows, 7)


def _batch(rows: list[tuple], columns: int) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())[:columns]
    names = ("asker", "cell", "n", "total", "size", "hashes" if columns == 7 else "counts", "counts")[:columns]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=list(names))


def _requests(groups: DataFrame, orders: tuple[int, ...], cells: int) -> DataFrame:
    def run(batches):
        for b in batches:
            for g, packed in zip(b.column("g").to_pylist(), b.column("rows"), strict=True):
                table = pa.ipc.open_stream(packed.as_buffer()).read_all()
                train = np.asarray(table.column("train").combine_chunks()).astype(bool)
                out = _Rows()
                for n, (grams, bounds) in enumerate(_grams(table.column("t"), max(orders)), 1):
                    if n not in orders or not len(grams):
                        continue
                    if train.all():
                        u, c = np.unique(grams, return_counts=True)
                    else:
                        u, back = np.unique(grams, return_inverse=True)
                        c = np.bincount(back[np.repeat(train, np.diff(bounds))], minlength=len(u))
                    out.add(g, n, u, c, cells)
                yield out.batch()

    return groups.mapInArrow(tidy(run), _REQUEST)


def _by_order(table: pa.Table, *names: str) -> dict[int, list[tuple]]:
    held: dict[int, list] = {}
    for r in zip(*(table.column(c).to_pylist() for c in ("n", *names)), strict=True):
        held.setdefault(r[0], []).append(r[1:])
    return held


def _summed(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending distinct hashes, their summed counts, and the number among them of every hash given."""
    every, counts = np.concatenate(hashes), np.concatenate(counts)
    o = np.argsort(every, kind="stable").astype(np.uint32 if len(every) < 2**32 else np.int64)
    every = every[o]
    fresh = np.append(True, every[1:] != every[:-1])
    first = np.flatnonzero(fresh)
    number = np.empty(len(o), o.dtype)
    number[o] = np.cumsum(fresh) - 1
    return every[first], np.add.reduceat(counts[o], first), number


def _shard(table: pa.Table) -> pa.Table:
    """Every request row of a shard with the counts summed over all askers."""
    held = _by_order(table, "asker", "cell", "total", "size", "hashes", "counts")
    del table
    out = []
    for n, rows in held.items():
        _, total, number = _summed([unpack(r[4], r[3]) for r in rows], [_unpack_counts(r[5], r[3]) for r in rows])
        end = 0
        for asker, cell, own, size, _, _ in rows:
            out.append((asker, cell, n, own, size, _pack_counts(total[number[end : end + size]])))
            end += size
    trim()
    return pa.Table.from_batches([_batch(out, 6)])


def _answers(requests: DataFrame, groups: int, shards: int, direct: int) -> DataFrame:
    """Answer rows (asker, cell, n, total, size, counts) to all request rows."""
    if shards <= direct:
        return requests.groupBy("cell").applyInArrow(_shard, _ANSWER)
    lanes = _lanes(shards)
    subs = -(-shards // lanes)
    relays = max(1, -(-groups // subs))
    requests = written(requests.withColumn("relay", F.col("cell").cast("long") * relays + F.pmod(F.xxhash64("asker"), F.lit(relays))), "requests")

    def ask(table: pa.Table) -> pa.Table:
        out = _Rows()
        for n, rows in _by_order(table, "size", "hashes", "counts").items():
            u, c, _ = _summed([unpack(r[1], r[0]) for r in rows], [_unpack_counts(r[2], r[0]) for r in rows])
            out.add(table.column("relay")[0].as_py(), n, u, c, lanes * subs)
        trim()
        return pa.Table.from_batches([out.batch()])

    def split(asked: pa.Table, told: pa.Table) -> pa.Table:
        answers = {n: np.concatenate([_unpack_counts(c, size) for _, size, c in sorted(rows, key=lambda r: r[0])]) for n, rows in _by_order(told, "cell", "size", "counts").items()}
        out = []
        for n, rows in _by_order(asked, "asker", "cell", "total", "size", "hashes").items():
            hashes = [unpack(r[4], r[3]) for r in rows]
            u = np.unique(np.concatenate(hashes))
            out += [(*r[:2], n, r[2], r[3], _pack_counts(answers[n][np.searchsorted(u, h)])) for r, h in zip(rows, hashes, strict=True)]
        trim()
        return pa.Table.from_batches([_batch(out, 6)])

    told = requests.groupBy("relay").applyInArrow(ask, _REQUEST).groupBy("cell").applyInArrow(_shard, _ANSWER)
    return requests.groupBy("relay").cogroup(told.withColumnRenamed("asker", "relay").groupBy("relay")).applyInArrow(split, _ANSWER)


def _lanes(shards: int) -> int:
    return math.isqrt(shards - 1) + 1


def _scores(grams: list, counts: list[np.ndarray], total: int, backoff: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, summed logarithms and backed-off tokens of each row. counts: of each n-gram of grams."""
    bounds = grams[0][1]
    tokens, rows = np.diff(bounds), len(bounds) - 1
    row = np.repeat(np.arange(rows), tokens)
    place = np.arange(len(row)) - bounds[:-1][row]
    log = np.where(counts[0] > 0, np.log(np.maximum(counts[0], 1) / total), np.log(backoff / total))
    used = np.ones(len(row), np.int64)
    penalty = np.log(backoff)
    for n in range(2, len(grams) + 1):
        c, b = counts[n - 1], grams[n - 1][1]
        at = np.flatnonzero(place >= n - 1)  # the tokens that end an n-gram, in the n-grams' order
        shorter = counts[n - 2][grams[n - 2][1][:-1][row[at]] + place[at] - (n - 1)]
        seen = c > 0
        log[at] = np.where(seen, np.log(np.maximum(c, 1)) - np.log(np.maximum(shorter, 1)), log[at] + penalty)
        used[at[seen]] = n
        assert len(at) == b[-1]
    full = np.minimum(place + 1, len(grams))
    return tokens, np.bincount(row, log, rows), np.bincount(row, used < full, rows).astype(np.int64)


def score(docs: DataFrame, train: Column | None = None, text: str = "text", key: str = "doc_id", order: int = 3, backoff: float = 0.4, direct: int = DIRECT) -> DataFrame:
    """key, n_tokens, log_score, mean_log_score and n_backoff of every row; counts are of the rows where train is true (all by default)."""
    spark = docs.sparkSession
    train = F.lit(True) if train is None else F.coalesce(train, F.lit(False))
    size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    slots = spark.sparkContext.defaultParallelism
    if size < slots * 2 * GROUP_BYTES:  # a few files, perhaps of one row group each, would keep few slots busy
        docs = docs.repartition(slots)
    groups = written(_groups(docs, train, text, key), "groups")
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (2 * GROUP_BYTES)))
    cells = shards if shards <= direct else _lanes(shards)
    number = -(-size // GROUP_BYTES) + 1
    answers = None
    for orders in (tuple(range(1, order)), (order,)):  # the longest n-grams are most of what is shuffled, and go alone
        if orders:
            part = written(_answers(_requests(groups, orders, cells), number, shards, direct), "counts")
            answers = part if answers is None else answers.union(part)
    total = answers.filter("n = 1").agg(F.sum("total")).first()[0] or 1

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        table = pa.ipc.open_stream(left.column("rows")[0].as_buffer()).read_all()
        grams = _grams(table.column("t"), order)
        held, counts = _by_order(right, "cell", "size", "counts"), []
        for n, (g, _) in enumerate(grams, 1):
            c = [_unpack_counts(x, size) for _, size, x in sorted(held.get(n, []), key=lambda r: r[0])]
            counts.append(np.concatenate(c)[np.unique(g, return_inverse=True)[1]].astype(np.int64) if c else np.zeros(0, np.int64))
        tokens, log, off = _scores(grams, counts, max(total, 1), backoff)
        del grams, counts, held
        trim()
        mean = pa.array(np.where(tokens > 0, log / np.maximum(tokens, 1), 0.0), mask=tokens == 0)
        return pa.table([table.column("k"), pa.array(tokens), pa.array(log), mean, pa.array(off)], names=[key, "n_tokens", "log_score", "mean_log_score", "n_backoff"])

    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens bigint, log_score double, mean_log_score double, n_backoff bigint"
    return groups.groupBy("g").cogroup(answers.groupBy("asker")).applyInArrow(run, schema)
