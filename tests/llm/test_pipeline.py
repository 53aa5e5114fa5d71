import corpus_pipeline
from pyspark.sql import functions as F

from granella.llm.common import written


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append(docs.count())
    assert seen[0] >= seen[1] > seen[2] > seen[3] == seen[4]
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert out.filter("not round_trip").count() == 0 and out.select("doc_id").distinct().count() == seen[4]


def test_empty(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_nulls(spark, sf):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", None, 3), (2, "the of and a@b.cd is here", None, "s", None), (3, "the of and was is here that", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf), name)
    assert {r["doc_id"] for r in docs.collect()} == {2, 3}


def test_clashing_names_and_no_labels(spark, sf):
    """Columns that are named like a stage's own pass unchanged; without labels rows with a letter stay."""
    base = spark.read.parquet(f"{sf}/documents.parquet")
    docs = base.withColumns({"language": F.col("doc_id") * 2, "spans": F.lit("own"), "row_hash": F.col("doc_id") + 1})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf), name)
        assert docs.columns == [*base.columns, "language", "spans", "row_hash"]
        assert docs.filter("language <> doc_id * 2 or spans <> 'own' or row_hash <> doc_id + 1").count() == 0
    blank = base.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language_id(spark, blank, sf).count() == base.filter(F.col("text").rlike(r"\p{L}")).count()


def test_very_long_and_repeated_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    text = "the house of the river is a long story and it was told to all of us. " * 12000
    more = spark.createDataFrame([(10**6, text, "en", "s", len(text)), (10**6, text, "en", "s", len(text)), (10**6 + 1, text + "end", "en", "s", len(text))], docs.schema)
    docs = docs.union(more)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf), name)
    assert [r["doc_id"] for r in docs.filter("doc_id >= 1000000").collect()] == [10**6]
    out = corpus_pipeline.encoding(spark, docs, sf)
    assert out.filter("not round_trip").count() == 0
