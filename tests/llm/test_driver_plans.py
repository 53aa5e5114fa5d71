import re

from granella.llm import ngram_join


def rows(spark):
    return spark.createDataFrame([(i, "one two three four five six seven " + str(i // 3), "x") for i in range(30)], "doc_id long, text string, bits string")


def test_survivors_spell_out_no_bitmap(spark):
    out = ngram_join.survivors(rows(spark))
    assert not re.search(r"[0-9A-Fa-f]{1000}", out._jdf.queryExecution().toString())
    assert sorted(r["doc_id"] for r in out.collect()) == list(range(0, 30, 3)) and out.columns == ["doc_id", "text", "bits"]


def test_join_steps_broadcast_nothing(spark, monkeypatch):
    name, held, write = "spark.sql.adaptive.autoBroadcastJoinThreshold", [], ngram_join.written
    monkeypatch.setattr(ngram_join, "written", lambda *a, **k: held.append(spark.conf.get(name, None)) or write(*a, **k))
    before = spark.conf.get(name, None)
    ngram_join.classes(rows(spark))
    assert len(held) > 5 and set(held) == {"-1"} and spark.conf.get(name, None) == before
