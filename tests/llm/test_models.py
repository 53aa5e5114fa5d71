"""Trained operators: language ID, toxicity; and token counts, licences, benchmark copies."""

import random

from granella.llm import decontamination, lang_id, license_scan, token_counts, toxicity
from granella.llm.common import held_out

EN = "the of and to in is that for with was on as by at from this".split()
FR = "le la de et les des un une que dans pour qui sur par est avec".split()


def prose(rng, words, n=60):
    return " ".join(rng.choice(words) + rng.choice(("", "", "ing" if words is EN else "eux")) for _ in range(n)) + "."


def corpus(spark, n=160):
    rng = random.Random(1)
    rows = [(i, prose(rng, EN if i % 2 else FR), "en" if i % 2 else "fr", i) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score long")


def test_language_held_out(spark):
    docs = corpus(spark)
    model = lang_id.train(docs.filter(~held_out()))
    got = lang_id.identify(docs.filter(held_out()), model, keep=("doc_id", "lang")).collect()
    assert got and all(r["lang_pred"] == r["lang"] and 0.5 < r["score"] <= 1 for r in got)


def test_language_edges(spark):
    model = lang_id.train(corpus(spark))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !!"), (4, "le la de et " * 30000), (4, "le la de et " * 30000), (None, "x")], "doc_id long, text string")
    got = lang_id.identify(odd, model).collect()
    assert [r["lang_pred"] for r in got[:3]] == ["und"] * 3 and got[3]["lang_pred"] == got[4]["lang_pred"] == "fr" and len(got) == 6
    assert lang_id.train(corpus(spark).limit(0)) is None
    assert {r["lang_pred"] for r in lang_id.identify(odd, None).collect()} == {"und"}
    one = lang_id.train(corpus(spark).filter("lang = 'fr'"))
    assert [r["lang_pred"] for r in lang_id.identify(odd.filter("doc_id = 4"), one).collect()] == ["fr", "fr"]


def test_decoding_is_brute_force(spark):
    """Loss-weighted distances, nearest codeword and ambiguity, bit by bit."""
    import math

    import numpy as np

    rng = np.random.default_rng(5)
    for k in (2, 4, 9):
        code = lang_id.codewords(k)
        bits = code.shape[1]
        trust = rng.random((k, bits))
        m = lang_id.Model([f"l{i}" for i in range(k)], code, rng.normal(size=(6, bits)), rng.normal(size=bits), trust / trust.sum(1, keepdims=True))
        x = rng.normal(size=(40, 6)) * 0.3
        best, score, doubt = m.decode(x)
        for i in range(len(x)):
            margins = [min(2.0, max(-2.0, sum(x[i][f] * m.weights[f][b] for f in range(6)) + m.intercept[b])) for b in range(bits)]
            far = [sum(m.trust[c][b] * math.exp(-2 * margins[b] * code[c][b]) for b in range(bits)) for c in range(k)]
            one, two = sorted(far)[:2]
            assert best[i] == far.index(one) and bool(doubt[i]) == (two - one < m.ambiguous_below * (one + two))
            assert math.isclose(score[i], 1 / sum(math.exp(-4 * (f - one) / one) for f in far), rel_tol=1e-6)


def test_every_language_is_learned(spark):
    """No cap on languages: more than there are rows to train on, and one with a single row."""
    rng = random.Random(4)
    words = {k: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)) for _ in range(12)] for k in range(230)}
    rows = [(10 * k + j, " ".join(rng.choice(words[k]) for _ in range(80)), f"x{k:03d}") for k in range(230) for j in range(1 if k == 7 else 3)]
    docs = spark.createDataFrame(rows + rows[:5], "doc_id long, text string, lang string")
    model = lang_id.train(docs, most_rows=300)
    assert model.languages == [f"x{k:03d}" for k in range(230)]
    new = spark.createDataFrame([(k, " ".join(rng.choice(words[k]) for _ in range(80)), f"x{k:03d}") for k in range(230)], "doc_id long, text string, lang string")
    got = lang_id.identify(new, model, keep=("lang",)).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) > 0.9 * len(got)


def test_codewords_are_apart():
    for k in (2, 3, 5, 9, 20):
        code = lang_id.codewords(k)
        assert len({tuple(r) for r in code.tolist()}) == k
    assert min((lang_id.codewords(20)[i] != lang_id.codewords(20)[j]).sum() for i in range(20) for j in range(i)) >= 10


def test_toxicity(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(300):
        toxic = i % 3 == 0
        s = [prose(rng, EN, 12) for _ in range(4)]
        if toxic:
            s[rng.randrange(4)] = prose(rng, EN, 6)[:-1] + " " + rng.choice(("zork", "blarg", "grunt")) + rng.choice(("", "er", "ing")) + " the of."
        rows.append((i, "\n".join(s), 7))
        labels.append((i, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, y long"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, marks.filter("doc_id < 200"))
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert all(got[i]["predicted"] == t for i, t in labels if i >= 200)
    assert all(any(w in rows[i][1][s["start"] : s["end"]] for w in ("zork", "blarg", "grunt")) for i, t in labels if t for s in got[i]["sentences"])
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "zork " * 50000)], "doc_id long, text string")
    assert [r["score"] for r in toxicity.score(odd, model).collect()][:2] == [0.0, 0.0]
    assert toxicity.train(docs, marks.filter("toxic = 0")) is None
    assert {r["score"] for r in toxicity.score(odd, None).collect()} == {0.0}


def greedy(word: bytes, pieces: set[bytes]) -> int:
    n = 0
    while word:
        k = next((k for k in range(len(word), 0, -1) if word[:k] in pieces), 0)
        if not k:
            return 1
        word, n = word[k:], n + 1
    return n


def test_longest_match_is_greedy():
    rng = random.Random(3)
    for alphabet in ("ab", "abc"):
        for _ in range(60):
            pieces = {"".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 6))).encode() for _ in range(rng.randrange(1, 14))}
            automaton = token_counts.LongestMatch(sorted(pieces))
            for _ in range(40):
                w = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 14))).encode()
                assert automaton.length(w) == greedy(w, pieces), (pieces, w)


def test_token_counts(spark):
    pieces = set(token_counts.read_vocabulary(token_counts.DEFAULT_VOCABULARY))
    texts = [None, "", " \n", "Hello world, unwahrscheinlich ñandú", "x" * 30000, "a b " * 20000]
    rows = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    for r in token_counts.count_tokens(rows).collect():
        words = (texts[r["doc_id"]] or "").split()
        assert (r["n_words"], r["n_tokens"]) == (len(words), sum(greedy(b" " + w.encode(), pieces) for w in words))


def test_licences(spark):
    S = license_scan.SENTENCES
    mit = "\n\n".join(S[k] for k in ("mit.grant", "mit.notice", "mit.warranty", "mit.liability")).replace(" and ", "\nand ")
    texts = [None, "", f"Intro text\n{mit}\nEnd", "words. Licensed under CC BY-NC 4.0. More", S["bsd.source"] + " " + S["bsd.grant"], S["mit.grant"] + " Own words. " + S["mit.notice"], "x. Released under the MIT License.\n" * 3, "license " * 20000, "released under the mit license"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [(r["doc_id"], r["licence"], r["rule"]) for r in license_scan.scan(rows).orderBy("doc_id", "start").collect()]
    assert got == [(2, "MIT", "text"), (3, "CC-BY-NC-4.0", "notice"), (5, "MIT", "grant"), (6, "MIT", "notice"), (6, "MIT", "notice"), (6, "MIT", "notice"), (8, "MIT", "notice")]
    r = license_scan.scan(rows).filter("doc_id = 3").first()
    assert texts[3][r["start"] : r["end"]] == "Licensed under CC BY-NC 4.0."


def naive_rules(found, rules, gap):
    """What the rules say, tried one by one: at each unused sentence the longest rule that can be filled with unused ones."""
    out, used = [], set()
    for i in range(len(found)):
        if i in used:
            continue
        best = None
        for licence, rule, ids in rules:
            if ids[0] != found[i][0] or best and len(best[2]) >= len(ids):
                continue
            taken = [i]
            for want in ids[1:]:
                for k in range(taken[-1] + 1, len(found)):
                    if k not in used and found[k][0] == want and found[k][1] - found[taken[-1]][2] <= gap:
                        taken.append(k)
                        break
                else:
                    break
            if len(taken) == len(ids):
                best = (licence, rule, ids, taken)
        if best:
            used |= set(best[3])
            out.append((best[0], best[1], list(best[2]), found[i][3], found[best[3][-1]][4]))
    return out


def test_rules_are_those_of_a_naive_search():
    rng = random.Random(11)
    sentences = {k: f"{k} one two" for k in "abcdef"}
    for _ in range(150):
        rules = tuple({("".join(ids), "r", ids) for ids in (tuple(rng.choice("abcdef") for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 7)))})
        r = license_scan.Rules(sentences, rules)
        text = " ".join(f"{rng.choice('abcdefxy')} one two." for _ in range(rng.randrange(12)))
        for gap in (0, 2):
            assert r.match(text, gap) == naive_rules(r.sentences(text), rules, gap)


def test_licence_catalogue():
    """Every notice, tag and text of the catalogue is found, wrapped and in other case; every rule can pass the filter for telling words."""
    import re

    r, telling = license_scan.Rules(), re.compile(license_scan.TELLING)
    same = {}
    for licence, rule, ids in license_scan.RULES:
        text = "\n".join(license_scan.SENTENCES[i] for i in ids)
        assert telling.search(text), ids
        same.setdefault(tuple(license_scan.words(text)), set()).add(licence)
    for licence, rule, ids in license_scan.RULES:
        text = "\n".join(license_scan.SENTENCES[i] for i in ids)
        for t in (text, "Some words.\n\n" + text.upper().replace(" ", "\n") + "\nMore words."):
            got = r.match(t, 6)
            assert len(got) == 1 and got[0][0] in same[tuple(license_scan.words(text))], (ids, got)


def test_grants_use_sentences_up(spark):
    S = license_scan.SENTENCES
    text = "\n".join(S[f"mit.{k}"] for k in ("grant", "grant", "notice", "warranty", "liability"))
    long = "license words.\n" * 20000 + text
    rows = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (None, S["zlib.grant"], "y"), (2, long, "z")], "doc_id long, text string, licence string")
    got = sorted(((r["doc_id"], r["licence"], r["rule"], r["start"]) for r in license_scan.scan(rows).collect()), key=str)
    second = len(S["mit.grant"]) + 1
    want = [(1, "MIT", "text", 0), (1, "MIT", "grant", second)] * 2 + [(2, "MIT", "text", len(long) - len(text)), (2, "MIT", "grant", len(long) - len(text) + second)]
    assert got == sorted(want, key=str)
    assert license_scan.scan(rows.limit(0)).count() == 0


def smith_waterman(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment_is_smith_waterman():
    import numpy as np

    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(1, 15))] for _ in range(2))
        assert decontamination.align(np.array(a), np.array(b))[0] == smith_waterman(a, b)


def test_decontamination(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(3, 9)))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(8)] + [(90, "too short"), (91, None), (None, "x " * 20)]
    def noise(n):
        return [word() for _ in range(n)]
    edited = items[2][1].split()
    for k in range(0, 30, 6):
        edited[k] = word()
    lost = items[3][1].split()
    del lost[10:13]
    docs = [(0, " ".join(noise(80))), (1, " ".join(noise(50) + items[1][1].upper().split() + noise(9))), (2, ", ".join(noise(20) + edited + noise(20))), (3, " ".join(lost)), (4, " ".join(noise(30) + items[4][1].split()[:8] + noise(30))), (5, None), (6, ""), (7, " ".join(noise(20000)) + " " + items[0][1]), (8, (items[5][1] + " ") * 200)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = [(1, 1), (2, 2), (3, 3), (7, 0), (8, 5)]
    assert sorted((r["doc_id"], r["item_id"]) for r in decontamination.contaminated(d, b).collect()) == want
    assert sorted((r["doc_id"], r["item_id"]) for r in decontamination.contaminated(d, b, block_bytes=300).collect()) == want
    assert sorted(r["doc_id"] for r in decontamination.clean(d, b).collect()) == [0, 4, 5, 6]
    assert decontamination.contaminated(d, b.limit(0)).count() == 0 and decontamination.contaminated(d.limit(0), b).count() == 0


def test_repeated_partial_and_edited_copies(spark):
    """A group of copies is found however large a share of the documents it is."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(3, 9)))
    half, changed = [[word() for _ in range(40)] for _ in range(2)]
    docs = [(i, " ".join(word() for _ in range(60))) for i in range(400)]
    for i in range(0, 400, 10):
        docs[i] = (i, docs[i][1] + " " + " ".join(half[:22]))
        docs[i + 1] = (i + 1, " ".join(w if k % 4 < 3 else word() for k, w in enumerate(changed)) + " " + docs[i + 1][1])
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(half)), (2, " ".join(changed))], "item_id long, text string")
    want = [(i + k, k + 1) for i in range(0, 400, 10) for k in (0, 1)]
    assert sorted((r["doc_id"], r["item_id"]) for r in decontamination.contaminated(d, b).collect()) == want
    assert decontamination.clean(d, b).count() == 400 - len(want)
