import random

import brute
import pytest

from granella.llm import ngram_join
from granella.llm.components import components


def check(spark, docs, **options):
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, node long")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.classes(df, **options).collect()}
    assert got == brute.jaccard_components(docs)


def copies(seed, groups=12, most=14, words=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 5)))
    passage = [word() for _ in range(30)]
    docs = []
    for _ in range(groups):
        base = [word() for _ in range(rng.randrange(5, words))]
        for _ in range(rng.randrange(1, most)):
            w = list(base)
            for _ in range(rng.choice((0, 0, 1, 1, 2, 3))):
                w[rng.randrange(len(w))] = word()
            if rng.random() < 0.3:
                w += passage
            docs.append(" ".join(w))
    rng.shuffle(docs)
    return [(3 * i + 1, t) for i, t in enumerate(docs)]


@pytest.mark.parametrize(
    "seed,options",
    [(1, {}), (2, {"longest": 3}), (3, {"longest": 2, "mu": 0.5}), (4, {"longest": 4, "split": 4}), (5, {"direct": 2}), (6, {"node_bits": 5}), (7, {"mu": 0.0, "longest": 2, "split": 3, "node_bits": 6})],
)
def test_brute_force(spark, seed, options):
    """With lists that are merged, left alone, split over shards, dealt in two steps; with sets that share a hash."""
    check(spark, copies(seed), **options)


def test_division_of_lists():
    """Sets that are linked share as many n-grams of their short lists as the count that is asked of them."""
    rng = random.Random(3)
    for _ in range(3000):
        x = {rng.randrange(60) for _ in range(rng.randrange(1, 40))}
        y = {e for e in x if rng.random() < 0.93} | {rng.randrange(60) for _ in range(rng.randrange(3))}
        if not y or 100 * len(x & y) < 75 * len(x | y):
            continue
        t = ngram_join._both_required(len(x) + len(y), 75, 100)
        assert len(x & y) >= t
        skipped = [rng.randrange(ngram_join._required(len(s), 75, 100)) for s in (x, y)]
        short = [set(sorted(s)[: len(s) - k]) for s, k in zip((x, y), skipped)]
        assert len(short[0] & short[1]) >= t - max(skipped) >= 1


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(20000))
    check(spark, [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "A  B"), (6, "a b c d e"), (7, "a b c d e f"), (8, "é"), (9, "É"), (10, long), (11, long + " x"), (12, "a a a a a a a a a a"), (13, "a a a a a")])


def test_empty_and_repeated(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.classes(empty).count() == 0
    rows = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (2, "x y z"), (None, "x y z"), (None, "q")], "doc_id long, text string")
    assert sorted(((r["doc_id"], r["component_id"]) for r in ngram_join.classes(rows).collect()), key=str) == sorted([(5, 5), (5, 5), (2, 2), (None, 2), (None, None)], key=str)
    assert sorted(r["doc_id"] for r in ngram_join.survivors(rows.filter("doc_id is not null")).collect()) == [2, 5]


def test_survivors_by_key_and_text(spark):
    """Different texts that share a key are judged apart; rows without words or key stay."""
    text = "a b c d e f g"
    rows = [(1, text, "p"), (4, text, "q"), (4, "other words are in this text", "q"), (4, "other words are in this text", "r"), (9, "", "s"), (9, "", "s"), (None, text, "t"), (None, None, "u"), (7, "x y", "v")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row_hash string")
    got = ngram_join.survivors(df)
    assert got.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(1, text), (4, "other words are in this text"), (9, ""), (9, ""), (None, text), (None, None), (7, "x y")], key=str)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
