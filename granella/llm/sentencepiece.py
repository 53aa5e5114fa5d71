"""Sampling distinct segmentations into SentencePiece pieces, and decoding.

A text's segmentations are the paths of a lattice. Perturbed A-star search with
Gumbel noise (top-k without replacement) emits k different ones, each as likely
to come first as its probability says:

* Masses of all lattice nodes are computed backwards, so the bound of a partial
  path is exact and the search never goes back on its way to the best leaf.
* The first path is drawn forward from the root. Each node on it leaves a rest,
  all other edges, with known mass; its perturbed value is a Gumbel variable
  cut off at the value of the path. The best rest is expanded next: an edge is
  drawn from it, then a path to the end, which leaves new rests.
* The value of the best rest that is left after k paths is the threshold of the
  inclusion probabilities, 1 - exp(-exp(log_prob - threshold)); they are given
  as logarithms, since a long text's are tiny.

Random numbers come from a hash of (seed, row key, sample, character), so a row
gets the same samples wherever it is computed. Two things are left out that the
numbers don't show: rests whose path is less likely than exp(-60), which would be
among the best about once in 10**26 draws, and rests of less than 1e-9 of a
node's mass, which doubles don't tell from rounding.

The lattice: blanks are the piece mark U+2581, and one stands before the text;
a new unit begins at each mark, and at and after a line break, which no piece
crosses; a run without blanks is one unit, whatever its length. Equal units of a
batch are built once. Masses are a number and a power of two, so that those of
long units neither vanish nor overflow.
A piece's weight is its probability to the power ``alpha``: exp(score) of a
unigram model; for a BPE model, whose scores are negative ranks, 1 / (rank + 2.7).
A character without a piece is spelled in byte pieces.

Defined results: null or empty text: one sample without pieces, log_prob 0 and
log_inclusion 0; a text with fewer than k segmentations gives all it has; a null
key counts as the text ""; rows with equal keys and texts get equal samples; an
empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granella.llm.common import U64, _power, buffers, mix, small_batches, spans, tidy

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK, LITERAL, BREAK = 0x2581, 0x200000, 10
CHUNK = 550_000
#: Characters before a unit's end up to which masses are plain numbers.
PLAIN = 16
_BITS = 21
#: A rest whose path is less likely than exp(FAINT) can't be among the best.
FAINT = -60.0


@dataclass
class Pieces:
    """What a model says: text or byte of each id, and weights of the pieces that segment."""

    raw: list[bytes]
    byte_ids: list[int]
    names: list[str]
    ids: list[int]
    logs: list[float]


def read_model(path: str) -> Pieces:
    """Pieces of a SentencePiece model file. It must have all 256 byte pieces."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = m.get_piece_size()
    raw, byte_ids, names, ids, scores = [], [0] * 256, [], [], []
    for i in range(n):
        p = m.id_to_piece(i)
        if m.is_byte(i):
            byte_ids[int(p[3:-1], 16)] = i
            raw.append(bytes([int(p[3:-1], 16)]))
            continue
        raw.append(b"" if m.is_control(i) or m.is_unknown(i) else p.replace("▁", " ").encode())
        if not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)) and "▁" not in p[1:]:
            names.append(p)
            ids.append(i)
            scores.append(m.get_score(i))
    ranks = all(s <= 0 and float(s).is_integer() for s in scores)  # as BPE models have
    logs = [-math.log(2.7 - s) for s in scores] if ranks else list(scores)
    return Pieces(raw, byte_ids, names, ids, logs)


def decode_ids(raw: list[bytes], ids) -> str:
    """Text of a sequence of ids; the blank before the text is taken off."""
    s = b"".join(map(raw.__getitem__, ids)).decode("utf-8", "replace")
    return s[1:] if s.startswith(" ") else s


class Lattices:
    """Hash tables of the pieces, and lattices of many units at once."""

    def __init__(self, pieces: Pieces, alpha: float):
        self.pieces = pieces
        self.longest = max((len(p) for p in pieces.names), default=1)
        self.mask = np.zeros(1 << _BITS, np.uint8)  # 1: a piece begins so, 2: a piece, 4: more than one
        self.slot = np.zeros(1 << _BITS, np.int32)  # the piece there
        self.full, self.piece_ids, self.weight = np.zeros(len(pieces.names), U64), np.array(pieces.ids, np.int32), np.exp(alpha * np.array(pieces.logs, float))
        for n, name in enumerate(pieces.names):
            codes = np.array([ord(c) for c in name], np.uint32)
            h = self.hashes(np.concatenate(([U64(0)], self.sums(codes))), np.zeros(len(codes), np.int64), np.arange(1, len(codes) + 1))
            at = (h >> U64(64 - _BITS)).astype(np.int64)
            self.full[n] = h[-1]
            self.mask[at] |= 1
            self.mask[at[-1]] |= 4 if self.mask[at[-1]] & 2 else 2
            self.slot[at[-1]] = n
        self.order = np.argsort(self.full)
        self.spelled = math.exp(alpha * (min(pieces.logs, default=0.0) - 1))
        self.byte_ids = np.array(pieces.byte_ids, np.int32)

    @staticmethod
    def sums(codes: np.ndarray) -> np.ndarray:
        return np.cumsum((codes.astype(U64) + U64(1)) * _power(len(codes))[0], dtype=U64)

    @staticmethod
    def hashes(acc: np.ndarray, start: np.ndarray, length) -> np.ndarray:
        n = np.atleast_1d(np.asarray(length)).astype(U64)
        return mix((acc[start + length] - acc[start]) * _power(len(acc))[1][start] ^ n * U64(0x9E3779B97F4A7C15))

    def build(self, codes: np.ndarray, first: np.ndarray, size: np.ndarray) -> None:
        """Lattices of units, given as slices of codes. Unit u has nodes at[u] to at[u] + size[u].

        The edges of node f are edge[f] to edge[f + 1] - 1, with their length,
        id and probability q given f; upto is the running sum of q over all edges.
        """
        n = len(first)
        self.at = np.zeros(n + 1, np.int64)
        np.cumsum(size + 1, out=self.at[1:])
        total = int(self.at[-1])
        left = np.repeat(self.at[1:] - 1, size + 1) - np.arange(total)
        left = left.astype(np.int32)  # characters to the unit's end
        c = np.zeros(total, np.uint32)
        inner = left > 0
        c[inner] = codes[(np.repeat(first - self.at[:-1], size + 1) + np.arange(total))[inner]]
        self.codes, self.left = c, left
        acc = np.concatenate(([U64(0)], self.sums(c)))
        bare, parts = inner.copy(), []
        begins = np.flatnonzero(inner).astype(np.int32)
        for k in range(1, self.longest + 1):
            h = self.hashes(acc, begins, k)
            at = (h >> U64(64 - _BITS)).astype(np.int32)
            what = self.mask[at]
            some = np.flatnonzero(what >= 2)
            if len(some):
                f, own, piece = begins[some], h[some], self.slot[at[some]]
                shared = np.flatnonzero(what[some] >= 4)
                piece[shared] = self.order[np.minimum(np.searchsorted(self.full, own[shared], sorter=self.order), len(self.order) - 1)]
                ok = self.full[piece] == own
                f, piece = f[ok], piece[ok]
                parts.append((f, np.full(len(f), k, np.int32), self.piece_ids[piece], self.weight[piece]))
                if k == 1:
                    bare[f] = False
            begins = begins[(what > 0) & (left[begins] > k)]
        f = np.flatnonzero(bare).astype(np.int32)
        parts.append((f, np.ones(len(f), np.int32), np.where(c[f] < 128, self.byte_ids[np.minimum(c[f], 127)], -2), np.full(len(f), self.spelled)))
        f, k, ids, w = (np.concatenate(x) for x in zip(*reversed(parts), strict=True))  # long pieces, the likelier ones, first
        del parts, acc, begins
        o = np.argsort(f, kind="stable").astype(np.int32)
        f, k, ids, w = f[o], k[o], ids[o].astype(np.int32), w[o]
        mass = np.zeros(total)
        mass[self.at[1:] - 1] = 1.0
        far = int(left.max(initial=0))
        power = np.zeros(total if far > PLAIN else 0, np.int64)  # of two, of long units' masses
        depth = left[f].astype(np.uint16 if far < 1 << 16 else np.int64)
        deep = np.argsort(depth, kind="stable").astype(np.int32)
        cut = np.concatenate(([0], np.cumsum(np.bincount(depth, minlength=1))))
        fd, to, wd = f[deep], (f + k)[deep], w[deep]
        for d, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
            if b > a:
                begin = np.flatnonzero(np.append(True, fd[a + 1 : b] != fd[a : b - 1]))
                node, value = fd[a:b][begin], wd[a:b] * mass[to[a:b]]
                if d > PLAIN:
                    most = np.maximum.reduceat(power[to[a:b]], begin)
                    value = np.ldexp(value, power[to[a:b]] - np.repeat(most, np.diff(np.append(begin, b - a))))
                    mass[node], up = np.frexp(np.add.reduceat(value, begin))
                    power[node] = most + up
                else:
                    mass[node] = np.add.reduceat(value, begin)
        del deep, fd, to, wd
        q = w * mass[f + k] / mass[f]
        if far > PLAIN:
            some = np.flatnonzero(depth > PLAIN)
            q[some] = np.ldexp(q[some], power[(f + k)[some]] - power[f[some]])
        self.source, self.length, self.ids, self.q = f, k, ids, q
        self.upto = np.cumsum(q)
        self.edge = np.zeros(total + 1, np.int32)
        np.cumsum(np.bincount(f, minlength=total), out=self.edge[1:])
        self.before = np.concatenate(([0.0], self.upto))[self.edge]

    def clear(self) -> None:
        """Forgets the units."""
        for name in ("at", "codes", "left", "source", "length", "ids", "q", "upto", "before", "edge"):
            self.__dict__.pop(name, None)

    def draw(self, node: np.ndarray, r: np.ndarray) -> np.ndarray:
        """An edge of each node, by its probability."""
        e = self.edge[node]
        goal = self.before[node] + r
        last = self.edge[node + 1] - 1
        on = np.flatnonzero((self.upto[e] <= goal) & (e < last))
        while len(on):
            e[on] += 1
            to = e[on]
            on = on[(self.upto[to] <= goal[on]) & (to < last[on])]
        return e


class _Random:
    """Uniform numbers by hash of a row's seed, the sample, a stream and a character."""

    def __init__(self, seeds: np.ndarray):
        self.seeds = seeds

    def __call__(self, doc, sample: int, stream: int, place) -> np.ndarray:
        x = mix((np.atleast_1d(self.seeds[doc]) + U64(((sample * 8 + stream + 1) * 0xD1342543DE82EF95) & (2**64 - 1))) ^ (np.atleast_1d(place).astype(U64) * U64(0x9E3779B97F4A7C15)))
        return ((x >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _walk(lat: Lattices, doc: np.ndarray, node: np.ndarray, place: np.ndarray, random: _Random, sample: int):
    """Paths from nodes to the ends of their units: arrays (text, place, edge), by text and place.

    place is a node's character in its text. Nodes come by text and place.
    """
    out = []
    unit = np.arange(len(node), dtype=np.int32)
    doc, node, place = doc.astype(np.int32), node.astype(np.int32), place.astype(np.int32)
    while len(node):
        e = lat.draw(node, random(doc, sample, 0, place))
        out.append((unit, doc, place, e))
        k = lat.length[e]
        go = lat.left[node] > k
        unit, doc, node, place = unit[go], doc[go], (node + k)[go], (place + k)[go]
    if not out:
        z = np.zeros(0, np.int32)
        return z, z, z
    unit, doc, place, e = (np.concatenate(x) for x in zip(*out, strict=True))
    o = np.argsort(unit, kind="stable")  # steps of a unit are in order already
    return doc[o], place[o], e[o]


def _rests(lat: Lattices, doc, place, edge, before, random: _Random, sample: int, most: int):
    """Of the paths of many texts, the best rests of each and the logarithms after each step.

    before: each text's logarithm ahead of its first step. Returns the texts'
    bounds in the arrays, the logarithms, and for each of ``most`` turns the
    unbounded perturbed value (-inf: none) and step of each text's next best rest.
    """
    bounds = np.searchsorted(doc, np.arange(len(before) + 1))
    q = lat.q[edge]
    run = np.concatenate(([0.0], np.cumsum(np.log(q))))
    log = run[1:] - run[bounds[:-1]][doc] + before[doc]
    race = np.full(len(q), -np.inf)
    on = np.flatnonzero((q < 1 - 1e-9) & (log > before[doc] + FAINT))
    race[on] = log[on] - np.log(q[on]) + np.log1p(-q[on]) - np.log(-np.log(random(doc[on], sample, 1, place[on])))
    some = np.flatnonzero(np.diff(bounds) > 0)
    best = []
    for _ in range(most):
        value, step = np.full(len(before), -np.inf), np.zeros(len(before), np.int64)
        if len(some):
            value[some] = np.maximum.reduceat(race, bounds[some])
            at = np.flatnonzero(race == value[doc])[::-1]
            step[doc[at]] = at
            race[step[some]] = -np.inf
        best.append((value, step))
    return bounds, log, best


def _units(texts: list[str]):
    """Characters of all texts with blanks as marks, where texts start, and where units start and how long they are."""
    joined = [t.replace("▁", "\uffff") if "▁" in t else t for t in texts]
    codes = np.frombuffer("".join(" " + t for t in joined).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    starts = np.concatenate(([0], np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))))
    for i, t in enumerate(texts):
        if "▁" in t:
            codes[starts[i] + 1 : starts[i + 1]][np.array([c == "▁" for c in t])] = LITERAL
    codes[codes == 32] = MARK
    line = codes == BREAK
    cut = (codes == MARK) | line
    cut[1:] |= line[:-1]
    cut[starts[:-1]] = True
    first = np.flatnonzero(cut)
    return codes, starts, first, np.diff(np.append(first, len(codes)))


def _sample_batch(lat: Lattices, texts: list[str], seeds: np.ndarray, k: int):
    """For each text its samples: (ids, log_prob, log_inclusion). No text is empty."""
    codes, starts, first, size = _units(texts)
    acc = np.concatenate(([U64(0)], lat.sums(codes)))
    _, some, unit = np.unique(lat.hashes(acc, first, size), return_index=True, return_inverse=True)
    lat.build(codes, first[some], size[some])
    n = len(texts)
    bounds = np.searchsorted(first, starts)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    local = (first - starts[:-1][owner]).astype(np.int32)  # a unit's place in its own text
    random = _Random(seeds)
    root = -np.log(-np.log(random(np.arange(n), 0, 2, np.zeros(n, np.int64))))
    steps = _walk(lat, owner, lat.at[unit], local, random, 0)
    cut, log, best = _rests(lat, *steps, np.zeros(n), random, 0, k)
    heaps: list[list] = [[] for _ in texts]
    # a path is (places, edges, logarithms after each step)
    paths = [[tuple(x[cut[i] : cut[i + 1]] for x in (*steps[1:], log))] for i in range(n)]

    def push(i: int, path: int, step: int, used: tuple, race: float, bound: float) -> None:
        """A rest's value, cut off at the value of the path that left it."""
        heapq.heappush(heaps[i], (float(np.logaddexp(-bound, -race)), path, step, used))

    for value, step in best:
        for i in np.flatnonzero(value > -np.inf).tolist():
            s = int(step[i] - cut[i])
            push(i, 0, s, (int(paths[i][0][1][s]),), float(value[i]), float(root[i]))
    for sample in range(1, k):
        turns = []
        before = np.zeros(n)
        nodes, places, docs = [], [], []
        for i in range(n):
            if not heaps[i]:
                continue
            bound, p, s, used = heapq.heappop(heaps[i])
            place, edge, logs = (x[s] for x in paths[i][p])
            node = int(lat.source[edge])
            lo, hi = lat.edge[node], lat.edge[node + 1]
            q = lat.q[lo:hi].copy()
            q[[e - lo for e in used]] = 0
            e = int(lo) + min(int(np.searchsorted(np.cumsum(q), float(random(i, sample, 3, place)[0]) * q.sum(), side="right")), int(np.flatnonzero(q)[-1]))
            ahead = float(logs) - math.log(lat.q[edge])
            before[i] = ahead + math.log(lat.q[e])
            if len(used) + 1 < hi - lo and (left := q.sum() - q[e - lo]) > 1e-9:
                push(i, p, s, (*used, e), ahead + math.log(left) - math.log(-math.log(float(random(i, sample, 4, place)[0]))), -bound)
            turns.append((i, -bound, p, s, e, int(place)))
            u = bounds[i] + int(np.searchsorted(local[bounds[i] : bounds[i + 1]], place, side="right"))
            if lat.left[node] > lat.length[e]:
                nodes.append([node + int(lat.length[e])])
                places.append([int(place) + int(lat.length[e])])
                docs.append([i])
            nodes.append(lat.at[unit[u : bounds[i + 1]]])
            places.append(local[u : bounds[i + 1]])
            docs.append(owner[u : bounds[i + 1]])
        if not turns:
            break
        steps = _walk(lat, *(np.concatenate(x).astype(np.int64) for x in (docs, nodes, places)), random, sample)
        cut, log, best = _rests(lat, *steps, before, random, sample, k)
        for i, bound, p, s, e, place in turns:
            own = [x[cut[i] : cut[i + 1]] for x in (*steps[1:], log)]
            paths[i].append(tuple(np.concatenate((x[:s], [y], z)) for x, y, z in zip(paths[i][p], (place, e, before[i]), own, strict=True)))
            new = len(paths[i]) - 1
            for value, step in best:
                if value[i] > -np.inf:
                    at = int(step[i] - cut[i])
                    push(i, new, s + 1 + at, (int(own[1][at]),), float(value[i]), bound)
    return [[(_ids(lat, edge), float(log[-1]), _log_inclusion(float(log[-1]), -heaps[i][0][0] if heaps[i] else None)) for _, edge, log in paths[i]] for i in range(n)]


def _ids(lat: Lattices, edge: np.ndarray) -> np.ndarray:
    edge = edge.astype(np.int64)
    ids = lat.ids[edge]
    if (ids == -2).any():
        codes = lat.codes[lat.source[edge]]
        spell = [[i] if i >= 0 else [lat.pieces.byte_ids[b] for b in ("▁" if c == LITERAL else chr(c)).encode("utf-8", "surrogatepass")] for i, c in zip(ids.tolist(), codes.tolist(), strict=True)]
        ids = np.array([x for s in spell for x in s])
    return ids.astype(np.int32)


def _log_inclusion(log: float, threshold: float | None) -> float:
    """log(1 - exp(-exp(log - threshold)))."""
    if threshold is None:
        return 0.0
    x = log - threshold
    return x if x < -30 else math.log(-math.expm1(-math.exp(min(x, 700.0))))


_known: dict = {}


def _lattices(key: tuple, pieces) -> Lattices:
    if key not in _known:
        _known.clear()
        _known[key] = Lattices(pieces.value, key[1])
    return _known[key]


def encode(docs: DataFrame, model: str = DEFAULT_MODEL, text: str = "text", key: str = "doc_id", samples: int = 2, alpha: float = 0.3, seed: int = 0) -> DataFrame:
    """Rows (key, sample, n_pieces, log_prob, log_inclusion, ids, round_trip); round_trip: decoding the ids gives the text."""
    small_batches(docs.sparkSession)
    pieces = docs.sparkSession.sparkContext.broadcast(read_model(model))  # bounded by the vocabulary
    names = [key, "sample", "n_pieces", "log_prob", "log_inclusion", "ids", "round_trip"]

    def run(batches):
        lat = _lattices((model, alpha), pieces)
        raw = pa.array(lat.pieces.raw, pa.binary())
        for b in batches:
            every = mix(b.column("h").to_numpy(zero_copy_only=False).view(U64) ^ U64(seed * 0x9E3779B97F4A7C15 & (2**64 - 1)))
            for lo, hi in spans(buffers(b.column("t"))[1], CHUNK):
                texts, seeds = [t or "" for t in b.column("t").slice(lo, hi - lo).to_pylist()], every[lo:hi]
                full = [i for i, t in enumerate(texts) if t]
                found = dict(zip(full, _sample_batch(lat, [texts[i] for i in full], seeds[full], samples), strict=True)) if full else {}
                rows = [(i, s, *x) for i in range(hi - lo) for s, x in enumerate(found.get(i) or [(np.zeros(0, np.int32), 0.0, 0.0)])]
                ids = [r[2] for r in rows]
                sizes = np.array([len(x) for x in ids], np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(np.concatenate(ids).astype(np.int32)))
                spelled = raw.take(lists.values)
                _, at, spelled = spelled.buffers()
                at, spelled = np.frombuffer(at, np.int32), memoryview(spelled).cast("B") if spelled else b""
                cut = np.concatenate(([0], np.cumsum(sizes)))
                ok = [spelled[at[a] : at[z]] == (b" " + texts[r[0]].encode() if texts[r[0]] else b"") for r, a, z in zip(rows, cut, cut[1:], strict=False)]
                del found
                lat.clear()
                yield pa.RecordBatch.from_arrays([b.column("k").slice(lo, hi - lo).take(pa.array([r[0] for r in rows])), pa.array([r[1] for r in rows], pa.int32()), pa.array(sizes), pa.array([r[3] for r in rows], pa.float64()), pa.array([r[4] for r in rows], pa.float64()), lists, pa.array(ok, pa.bool_())], names=names)
                del rows, ids, lists, spelled, at, texts

    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, sample int, n_pieces int, log_prob double, log_inclusion double, ids array<int>, round_trip boolean"
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("h")).mapInArrow(tidy(run), schema)


def decode(rows: DataFrame, model: str = DEFAULT_MODEL, ids: str = "ids", out: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns and the text of each row's ids; null ids give null."""
    pieces = rows.sparkSession.sparkContext.broadcast(read_model(model).raw)

    def run(batches):
        raw = pieces.value
        for b in batches:
            texts = [None if x is None else decode_ids(raw, x) for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, out])

    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep), f"`{out}` string"])
    return rows.select(*dict.fromkeys([*keep, ids])).mapInArrow(tidy(run), schema)
