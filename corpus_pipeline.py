"""Corpus preparation: language ID, near duplicates, decontamination, personal data, encoding.

Every stage takes (spark, docs, sf_dir) and gets all that its predecessor kept,
reread from Parquet. All but the last return the columns of documents.

Stage decisions: documents without a letter, or whose two nearest languages
can't be told apart, go; of each class of near duplicates the document with the
smallest id stays; documents with a copy of a benchmark item go; personal data
and secrets are replaced by marks (and n_chars follows); texts become sampled
piece sequences.

Null texts have no language and go in the first stage; without any labelled row
to learn from, rows that hold a letter stay; an empty table stays empty
throughout. A stage's own columns take names that the table doesn't have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granella.llm import decontamination, lang_id, ngram_join, pii, sentencepiece
from granella.llm.common import discard, free_name, held_out, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = lang_id.train(docs.filter(~held_out()))
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    model.ambiguous_below = 0.02
    name = free_name(docs.columns, "language")
    found = lang_id.with_language(docs, model, out=name)
    return found.filter((F.col(name)["lang_pred"] != lang_id.UNKNOWN) & ~F.col(name)["ambiguous"]).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.survivors(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = free_name(docs.columns, "spans")
    found = pii.with_spans(docs, out=name).withColumn("text", pii.redacted(F.col("text"), F.col(name)))
    return found.withColumn("n_chars", F.when(F.size(name) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece.encode(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("encoding", encoding),
]

#: Stages with models and hashes can't be said in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        last, docs = docs, written(stage(spark, docs, sf_dir), name)
        discard(last)  # a stage's table goes once the next one's is there
    return STAGES[-1][1](spark, docs, sf_dir)
