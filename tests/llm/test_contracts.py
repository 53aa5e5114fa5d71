"""The registered queries themselves: contract columns, held-out rows, and results against brute force on a small corpus of odd rows."""

import hashlib
import math
import random
import re
import zlib

import brute
import pytest
from pyspark.sql import functions as F

from granella.llm import decontamination, fingerprint, queries, toxicity
from granella.llm.common import buffers

EN = "the of and to in is that for with was on as by at from this house river".split()
FR = "le la de et les des un une que dans pour qui sur par est avec maison fleuve".split()
BAD = ("zork", "blarg", "grunt")


def corpus():
    rng = random.Random(21)
    rows, toxic = [], {}
    for i in range(240):
        words = EN if i % 2 else FR
        text = ". ".join(" ".join(rng.choice(words) + rng.choice(("", "a", "ing")) for _ in range(9)) for _ in range(rng.randrange(1, 6)))
        if i % 5 == 0:
            text += f". you {rng.choice(BAD)} {rng.choice(BAD)} now"
            toxic[i] = 1
        elif i % 5 < 3:
            toxic[i] = 0
        rows.append((i, text, "en" if i % 2 else "fr", "s", len(text)))
    base = " ".join(f"word{k}" for k in range(60))
    rows += [(300, None, None, None, None), (301, "", "en", "s", 0), (302, " \n", None, "s", 2), (303, base, "en", "s", 1), (304, base, "en", "s", 1), (305, base + " end", "fr", "s", 1), (306, "mail a.b@c.de and 1.2.3.4", "en", "s", 1), (307, "😀" * 300, "en", "s", 1)]
    rows.append((308, "very long text of a document " * 9000, "en", "s", 1))
    return rows, toxic


ITEMS = [(1, " ".join(f"word{k}" for k in range(10, 40))), (2, "too short"), (3, None)]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder of tables with an extra column that is named like an operator's own."""
    path, (rows, toxic) = str(tmp_path_factory.mktemp("tables")), corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"score": F.lit("own"), "k": F.lit("own"), "kind": F.lit("own")})
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int").withColumn("quality", F.lit(1)).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, {r[0]: r[1] for r in rows}, toxic


def run(spark, small, name):
    return queries.queries()[name](spark, small[0]).collect()


def held(i) -> bool:
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_every_query_keeps_every_row(spark, small):
    one_each = ("op1_lm_scoring", "op2_toxicity", "op5_pii", "op6_language_id", "op7_token_counts", "op9_fingerprint", "op10_ngram_jaccard_join")
    for name in one_each:
        assert sorted(r["doc_id"] for r in run(spark, small, name)) == sorted(small[1]), name
    samples = run(spark, small, "op3_sentencepiece")
    assert {r["doc_id"] for r in samples} == set(small[1]) and all(r["round_trip"] for r in samples)


def test_toxicity_contract(spark, small):
    got = {r["doc_id"]: r for r in run(spark, small, "op2_toxicity")}
    assert all(got[i]["held_out"] == held(i) and 0 <= got[i]["score"] <= 1 and got[i]["predicted"] == int(got[i]["score"] >= 0.3) for i in got)
    assert all(got[i]["predicted"] == t for i, t in small[2].items() if held(i))
    assert got[300]["score"] == got[301]["score"] == 0.0


def test_toxicity_is_noisy_or(spark, small):
    """Scores and sentences from a model's weights, sentence by sentence."""
    model = toxicity.Model({"=zork": 3.0, "^zo": 9.0, "^blar": 1.5, "=the": -0.5, "=you": 0.25}, -2.0)
    docs = spark.createDataFrame([(i, t) for i, t in small[1].items()], "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.score(docs, model, least=0.3).collect()}
    for i, t in small[1].items():
        none, bad = 1.0, []
        for m in re.finditer(r"[^.!?\n]+[.!?]*\n*|[.!?\n]+", t or ""):
            known = {f for w in re.findall(r"[^\W\d_]+", m[0].lower()) for f in ["=" + w, *("^" + w[:k] for k in (3, 4, 5, 6) if len(w) > k)] if f in model.weights}
            if known:
                p = 1 / (1 + math.exp(-(sum(model.weights[f] for f in known) + model.bias)))
                none *= 1 - p
                if p >= 0.3:
                    bad.append((m.start(), m.end()))
        assert math.isclose(got[i]["score"], 1 - none, abs_tol=1e-12) and [(s["start"], s["end"]) for s in got[i]["sentences"]] == bad


def test_personal_data_contract(spark, small):
    for r in run(spark, small, "op5_pii"):
        counts, sha = brute.pii_base(small[1][r["doc_id"]])
        assert {k: r[f"n_{k}"] for k in counts} == counts and r["base_sha256"] == sha


def test_language_contract(spark, small):
    got = {r["doc_id"]: r for r in run(spark, small, "op6_language_id")}
    assert all(got[i]["held_out"] == held(i) and 0 <= got[i]["score"] <= 1 and got[i]["lang_pred"] in ("en", "fr", "und") for i in got)
    assert all(got[i]["lang_pred"] == ("en" if i % 2 else "fr") for i in range(240) if held(i)) and all(got[i]["lang_pred"] == "und" for i in (300, 301, 302, 307))


def test_similarity_contract(spark, small):
    want = brute.jaccard_components(list(small[1].items()))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in run(spark, small, "op10_ngram_jaccard_join")} == want


def entropy_ranks(texts):
    """Rank of every entropy over all windows of all texts, window by window."""
    counts = [0] * (fingerprint.SCALE + 1)
    for t in texts:
        for e in window_entropies(t.encode()):
            counts[e] += 1
    order = sorted(range(len(counts)), key=lambda e: (counts[e], e))
    rank = {e: k for k, e in enumerate(order)}
    return {e: (10**9 if e <= fingerprint.WEAK else r) for e, r in rank.items()}


def window_entropies(b: bytes):
    w, full = fingerprint.WINDOW, int(fingerprint._F[fingerprint.WINDOW])
    return [(full - sum(int(fingerprint._F[b[k : k + w].count(c)]) for c in set(b[k : k + w]))) * fingerprint.SCALE // full for k in range(len(b) - w + 1)]


def features(text: str, rank) -> list[bytes]:
    """A text's features one by one: windows that win enough runs of their neighbours."""
    b, w = text.encode(), fingerprint.WINDOW
    e = window_entropies(b)
    points = [0] * len(e)
    for k in range(len(e) - fingerprint.RUN + 1):
        best = min(range(k, k + fingerprint.RUN), key=lambda j: (rank[e[j]], j))
        points[best] += rank[e[best]] < 10**9
    chosen = [k for k in range(len(e)) if points[k] >= fingerprint.POINTS]
    if not chosen and e:
        chosen = [min(range(len(e)), key=lambda j: (rank[e[j]], j))]
    out = [b[k : k + w] for k in chosen] or ([b] if b else [])
    return list(dict.fromkeys(out))


def test_fingerprint_contract(spark, small):
    texts = {i: t or "" for i, t in small[1].items()}
    rows = {r["doc_id"]: r for r in run(spark, small, "op9_fingerprint")}
    order = sorted(texts, reverse=True)
    for i, j in zip(order, order[1:] + order[:1]):
        t, k = texts[i], len(texts[i]) // 3
        assert rows[i]["n_chars"] == len(t) and rows[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - k] + texts[j][:k]).encode()).hexdigest()
        assert 0 <= rows[i]["near_edited"] <= 1 and 0 <= rows[i]["near_next"] <= 1
    assert rows[303]["fingerprint"] == rows[304]["fingerprint"] and rows[304]["near_next"] == 1.0


def test_digest_is_brute_force():
    """Features by single steps, filters bit by bit, likeness by counting bits."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(90)]
    texts = ["", "x", "short text", "a" * 40, "é" * 30] + [" ".join(rng.choice(words) for _ in range(rng.randrange(3, 260))) for _ in range(12)]
    rank = entropy_ranks(texts)
    table = fingerprint.np.array([rank[e] if rank[e] < 10**9 else fingerprint._NONE for e in range(fingerprint.SCALE + 1)], dtype=fingerprint.np.int64)
    got = fingerprint.digests(*buffers(fingerprint.pa.array(texts, fingerprint.pa.large_string())), table)
    for t, chain in zip(texts, got):
        want = features(t, rank)
        assert [c for c, _ in chain] == [len(want[k : k + fingerprint.MOST]) for k in range(0, len(want), fingerprint.MOST)], t[:40]
        assert all(bits.sum() <= fingerprint.HASHES * c for c, bits in chain)

    def like(a, b):
        if not a or not b:
            return float(not a and not b)
        if (len(a), sum(c for c, _ in a)) > (len(b), sum(c for c, _ in b)):
            a, b = b, a
        a, b, each = [x for x in a if x[0] >= fingerprint.FEW] or a, [x for x in b if x[0] >= fingerprint.FEW] or b, []
        for ca, x in a:
            best = 0.0
            for cb, y in b:
                most, both = min(x.sum(), y.sum()), sum(1 for p, q in zip(x, y) if p and q)
                p = 1 - 1 / fingerprint.BITS
                chance = fingerprint.BITS * (1 - p ** (fingerprint.HASHES * ca)) * (1 - p ** (fingerprint.HASHES * cb))
                cutoff = min(chance + fingerprint.CUTOFF * max(most - chance, 0), most - 1e-9)
                best = max(best, min(1.0, max(0.0, (both - cutoff) / (most - cutoff))))
            each.append(best)
        return min(1.0, sum(each) / len(each))

    for x in got:
        for y in got[::3]:
            assert math.isclose(fingerprint.likeness(x, y), like(x, y), abs_tol=1e-4)


def smith_waterman(a, b):
    row, best = [0] * (len(b) + 1), 0
    for x in a:
        diagonal, row[0] = 0, 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], max(0, diagonal + (2 if x == y else -1), row[j] - 1, row[j - 1] - 1)
            best = max(best, row[j])
    return best


def test_decontamination_against_all_pairs(spark):
    """Recall and precision against Smith-Waterman of every document with every item, for exact, edited and partial copies."""
    rng = random.Random(17)
    vocabulary = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(3, 8))) for _ in range(160)]
    items = [(i, [rng.choice(vocabulary) for _ in range(rng.randrange(12, 40))]) for i in range(12)]
    docs = []
    for i in range(150):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 90))]
        if i % 2:
            copy = list(rng.choice(items)[1])
            for _ in range(rng.randrange(len(copy) // 2)):
                k = rng.randrange(len(copy))
                if (what := rng.randrange(3)) == 0:
                    copy[k] = rng.choice(vocabulary)
                elif what == 1 and len(copy) > 3:
                    del copy[k]
                else:
                    copy.insert(k, rng.choice(vocabulary))
            words[10:10] = copy
        docs.append((i, words))
    want = {(d, i): s for d, w in docs for i, item in items if (s := smith_waterman(item, w) / (2 * len(item))) >= 0.45}
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontamination.contaminated(d, b).collect()}
    assert set(got) <= set(want)
    assert len(got) >= 0.97 * len(want), (len(got), len(want))
    assert sum(math.isclose(s, want[k], abs_tol=1e-9) for k, s in got.items()) >= 0.95 * len(got)
    assert {k for k, s in want.items() if s >= 0.6} <= set(got)


def test_decontamination_query(spark, small):
    assert {(r["doc_id"], r["item_id"]) for r in run(spark, small, "op8_decontamination")} == {(303, 1), (304, 1), (305, 1)}


def test_empty_tables(spark, small, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{small[0]}/{name}.parquet").limit(0).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, q in queries.queries().items():
        assert q(spark, str(tmp_path)).count() == 0, name


def test_null_keys_and_repeated_rows(spark, small):
    docs = spark.read.parquet(f"{small[0]}/documents.parquet").filter("doc_id >= 290")
    twice = docs.union(docs).union(docs.withColumn("doc_id", F.lit(None).cast("long")))
    from granella.llm import license_scan, lm_scoring, ngram_join, pii, sentencepiece, token_counts

    n = twice.count()
    assert lm_scoring.score(twice).count() == n and token_counts.count_tokens(twice).count() == n and ngram_join.classes(twice).count() == n and pii.with_spans(twice).count() == n
    assert sentencepiece.encode(twice, samples=1).count() == n and license_scan.scan(twice).count() == 0
    assert fingerprint.compare_neighbours(twice).count() == n
    assert decontamination.contaminated(twice, spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 9
