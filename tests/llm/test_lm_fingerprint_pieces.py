import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from granella.llm import fingerprint, lm_scoring, sentencepiece
from granella.llm.common import mix

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def stupid_backoff(docs, train, order, alpha=0.4):
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) for d, t in docs}
    counts = Counter(tuple(w[i : i + n]) for d, w in words.items() if d in train for n in range(1, order + 1) for i in range(len(w) - n + 1))
    total = sum(c for g, c in counts.items() if len(g) == 1) or 1

    def s(g):
        if len(g) == 1:
            return (counts[g] or alpha) / total
        return counts[g] / counts[g[:-1]] if counts[g] else alpha * s(g[1:])

    return {d: (len(w), sum(math.log(s(tuple(w[max(0, i - order + 1) : i + 1]))) for i in range(len(w)))) for d, w in words.items()}


def test_stupid_backoff(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice("A a b B c dd É\n".split(" ")) for _ in range(rng.randrange(40)))) for i in range(60)] + [(60, None), (61, ""), (62, "new words"), (63, "a " * 20000)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n int")
    for order in (1, 2, 3):
        want = stupid_backoff(docs, {d for d, _ in docs if d % 3}, order)
        got = lm_scoring.score(df, train=F.col("doc_id") % 3 != 0, order=order).collect()
        assert len(got) == len(docs)
        for r in got:
            assert r["n_tokens"] == want[r["doc_id"]][0] and math.isclose(r["log_score"], want[r["doc_id"]][1], rel_tol=1e-9, abs_tol=1e-9)
    assert lm_scoring.score(df.limit(0)).count() == 0


def test_relays_change_nothing(spark):
    """Groups that ask through relays get the answers they would get from the shards."""
    rng = random.Random(5)
    docs = [(i % 90 if i % 7 else None, " ".join(rng.choice("a b c d e f g".split()) for _ in range(rng.randrange(60)))) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    plain = sorted(lm_scoring.score(df).collect(), key=str)
    assert sorted(lm_scoring.score(df, direct=1).collect(), key=str) == plain and len(plain) == 200


def test_counts_beyond_32_bits():
    c = np.array([3, 254, 255, 2**32 + 7, 0, 2**40], np.uint64)
    assert (lm_scoring._unpack_counts(lm_scoring._pack_counts(c), len(c)) == c).all()
    u = np.arange(1, 7, dtype=np.uint64)
    rows = lm_scoring._Rows()
    for asker in (1, 2):
        rows.add(asker, 1, u, c, 1)
    out = lm_scoring._shard(pa.Table.from_batches([rows.batch()])).to_pylist()
    assert [r["asker"] for r in out] == [1, 2] and out[0]["total"] == int(c.sum())
    assert all((lm_scoring._unpack_counts(r["counts"], 6) == 2 * c).all() for r in out)


def test_rows_grow_with_groups_not_with_shards():
    """A group's rows are bounded by its own n-grams and by the shards it may ask."""
    u = np.sort(mix(np.arange(1000, dtype=np.uint64)))
    for cells in (1, 7, 1000, 10**6):
        cell, at = lm_scoring._cells(u, cells)
        assert len(cell) <= min(cells, len(u)) and at[-1] == len(u)
        sub = lm_scoring._cells(u, cells * 3)[0] // 3
        assert set(sub.tolist()) == set(cell.tolist())


def test_query_counts_every_row(spark, tmp_path):
    from granella.llm.queries import op1_lm_scoring

    docs = [(i, f"own{i} words{i} of document{i} the same end") for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = stupid_backoff(docs, {d for d, _ in docs}, 3)
    for r in op1_lm_scoring(spark, str(tmp_path)).collect():
        assert r["n_backoff"] == 0 and math.isclose(r["log_score"], want[r["doc_id"]][1], abs_tol=1e-6)  # rounded to 6 places


def test_entropies_are_brute_force():
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcde fgh"[: rng.randrange(1, 9)]) for _ in range(rng.choice((0, 5, 63, 64, 65, 200)))) for _ in range(40)]
    data, offsets = fingerprint._buffer(texts)
    for window in (64, 16):
        full = int(fingerprint._F[window])
        e, start, bounds = fingerprint.entropies(data, offsets, window)
        for i, t in enumerate(texts):
            b = t.encode()
            want = []
            for k in range(len(b) - window + 1):
                total = sum(int(fingerprint._F[c]) for c in Counter(b[k : k + window]).values())
                want.append((full - total) * 1000 // full)
            assert e[bounds[i] : bounds[i + 1]].tolist() == want


def test_neighbours(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(400)]
    docs = [(7 * i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 300)))) for i in range(60)] + [(1000, None), (1001, ""), (1002, "é" * 50), (1003, "a" * 3000), (1004, "same text " * 40), (1005, "same text " * 40)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, part string")
    got = {r["doc_id"]: r for r in fingerprint.compare_neighbours(df).collect()}
    order = sorted(docs, reverse=True)
    import hashlib

    for (d, t), (_, n) in zip(order, order[1:] + order[:1]):
        t, n = t or "", n or ""
        k = len(t) // 3
        r = got[d]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256((t[: len(t) - k] + n[:k]).encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if t == n:
            assert r["near_next"] == 1.0
        if t == t[: len(t) - k] + n[:k]:
            assert r["fingerprint"] == r["edited_fingerprint"] and r["near_edited"] == 1.0
    assert got[1005]["fingerprint"] == got[1004]["fingerprint"] and got[1005]["near_next"] == 1.0
    big = [r for d, r in got.items() if d < 1000 and r["n_chars"] > 600]
    assert sum(r["near_edited"] > 0.3 for r in big) > 0.9 * len(big) and sum(r["near_next"] < 0.1 for r in big) > 0.9 * len(big)
    assert fingerprint.compare_neighbours(df.limit(0)).count() == 0
    one = fingerprint.compare_neighbours(df.filter("doc_id = 1004")).first()
    assert one["near_next"] == 1.0


def test_digest_text_form():
    rng = random.Random(4)
    t = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(3000))
    rank = fingerprint.ranks(np.stack([np.arange(1001)] * 2))
    (d,) = fingerprint.digests(*fingerprint._buffer([t]), rank)
    assert len(d) > 1 and fingerprint.packed(fingerprint.unpacked(fingerprint.packed(d))) == fingerprint.packed(d) and fingerprint.likeness(d, d) == 1.0


TEXTS = [None, "", "Hello world", " two  blanks ", "line\nbreak\n\n", "日本語 😀 and ▁ mark", "x", "a" * 500, "Ünïcödé tëxt, " * 2000, "tab\there"]


def test_pieces_round_trip(spark):
    df = spark.createDataFrame([(i, t, "h") for i, t in enumerate(TEXTS)], "doc_id long, text string, h string")
    got = sentencepiece.encode(df, samples=3)
    rows = got.collect()
    assert all(r["round_trip"] for r in rows)
    back = {(r["doc_id"], r["sample"]): r["text"] for r in sentencepiece.decode(got, keep=("doc_id", "sample")).collect()}
    assert all(v == (TEXTS[d] or "") for (d, _), v in back.items())
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(tuple(r["ids"]))
    assert all(len(set(v)) == len(v) for v in by.values()) and len(by[2]) == 3 and len(by[0]) == len(by[1]) == 1
    assert sentencepiece.encode(df.limit(0)).count() == 0


def segmentations(lat, f=0):
    if lat.left[f] == 0:
        return [((), 0.0)]
    return [((int(lat.ids[e]), *rest), math.log(lat.q[e]) + log) for e in range(lat.edge[f], lat.edge[f + 1]) for rest, log in segmentations(lat, f + int(lat.length[e]))]


def test_samples_follow_the_lattice():
    """First samples have the lattice's probabilities; second ones those of drawing without replacement."""
    lat = sentencepiece.Lattices(sentencepiece.read_model(sentencepiece.DEFAULT_MODEL), 0.3)
    n = 6000
    seeds = mix(np.arange(n).astype(np.uint64))
    got = sentencepiece._sample_batch(lat, ["then"] * n, seeds, 2)
    codes = np.array([0x2581, *map(ord, "then")], np.uint32)
    lat.build(codes, np.array([0]), np.array([5]))
    p = {ids: math.exp(log) for ids, log in segmentations(lat)}
    assert math.isclose(sum(p.values()), 1, rel_tol=1e-6)
    first, second = Counter(tuple(g[0][0].tolist()) for g in got), Counter(tuple(g[1][0].tolist()) for g in got)
    for ids, q in p.items():
        assert abs(first[ids] / n - q) < 5 * math.sqrt(q / n) + 1e-3
        want = sum(o * q / (1 - o) for other, o in p.items() if other != ids)
        assert abs(second[ids] / n - want) < 5 * math.sqrt(want / n) + 1e-3
    assert all(math.isclose(g[i][1], math.log(p[tuple(g[i][0].tolist())]), abs_tol=1e-6) for g in got[:50] for i in (0, 1))


def test_long_runs_are_one_lattice():
    """A run without blanks keeps its whole lattice: a sample's probability is its weight over the sum of all paths."""
    pieces = sentencepiece.read_model(sentencepiece.DEFAULT_MODEL)
    rng = random.Random(12)
    for alpha in (0.3, 2.0):
        lat = sentencepiece.Lattices(pieces, alpha)
        weight = {p: alpha * log for p, log in zip(pieces.names, pieces.logs)}
        for text in ("a" * 200, "".join(rng.choice("theringandstion") for _ in range(3000)), "日本語のテキスト" * 40):
            s = "▁" + text
            total = [-math.inf] * len(s) + [0.0]
            for i in range(len(s) - 1, -1, -1):
                found = [weight[s[i : i + k]] + total[i + k] for k in range(1, lat.longest + 1) if i + k <= len(s) and s[i : i + k] in weight]
                if s[i] not in weight:
                    found.append(math.log(lat.spelled) + total[i + 1])
                top = max(found)
                total[i] = top + math.log(sum(math.exp(x - top) for x in found))
            whole = 0
            for ids, log, _ in (x for g in sentencepiece._sample_batch(lat, [text] * 30, mix(np.arange(30, dtype=np.uint64)), 2) for x in g):
                assert sentencepiece.decode_ids(pieces.raw, ids.tolist()) == text
                own, at, spelled, ends = 0.0, 0, 0, set()
                for i in ids.tolist():
                    if len(pieces.raw[i]) == 1 and i in pieces.byte_ids:
                        spelled += 1
                        if spelled == len(s[at].encode()):
                            own, at, spelled = own + math.log(lat.spelled), at + 1, 0
                        continue
                    piece = pieces.raw[i].decode().replace(" ", "▁")
                    own, at = own + weight[piece], at + len(piece)
                    ends.add(at)
                assert at == len(s) and math.isclose(own - total[0], log, rel_tol=1e-6, abs_tol=1e-6)
                whole += 64 not in ends
            assert whole or text[0] != "a"


def test_inclusion_scores_estimate_one():
    """The sum of probability over inclusion of the samples has mean one."""
    lat = sentencepiece.Lattices(sentencepiece.read_model(sentencepiece.DEFAULT_MODEL), 0.3)
    n = 3000
    got = sentencepiece._sample_batch(lat, ["thing"] * n, mix(np.arange(n).astype(np.uint64) + np.uint64(10**6)), 3)
    total = [sum(math.exp(log - inclusion) for _, log, inclusion in g) for g in got]
    assert abs(np.mean(total) - 1) < 0.05


def test_near_copies_of_all_lengths(spark):
    """A text and its copy with a few more or fewer bytes are alike, whatever their lengths."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9))) for _ in range(2000)]
    text = " ".join(rng.choice(words) for _ in range(400))
    docs = [text[: n + 1] for n in (100, 250, 499, 510, 511, 512, 529, 767, 1023, 2000)]
    rank = fingerprint.ranks(fingerprint.entropy_counts(spark.createDataFrame([(t,) for t in docs], "text string")))
    for n in (256, 500, 505, 511, 512, 515, 530, 768, 1024):
        long, short = fingerprint.digests(*fingerprint._buffer([text[: n + 10], text[: n - 10]]), rank)
        assert fingerprint.likeness(long, short) > 0.8, n
        (other,) = fingerprint.digests(*fingerprint._buffer([text[-n:]]), rank)
        assert fingerprint.likeness(long, other) < 0.2, n
