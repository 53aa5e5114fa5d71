"""The same document plan over a stream of page texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granella.plans import documents as D

PAGES = "doc string, page int, text string, arrived timestamp"


def page_stream(spark: SparkSession, path: str, files_per_trigger: int = 50) -> DataFrame:
    """Pages as they arrive, as JSON lines below a folder."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_trigger).json(path)


def counts(pages: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Pages and characters by arrival window; state older than the watermark goes."""
    return pages.withWatermark("arrived", late).groupBy(F.window("arrived", window)).agg(F.count("*").alias("pages"), F.sum(F.length("text")).alias("chars"))


def start_records(pages: DataFrame, prices: dict[str, float], sink: Callable[[DataFrame, int], None], checkpoint: str, store: str):
    """Every micro-batch adds its pages to the store and gives sink(records, batch) the records of the documents it touched, made of all their pages so far.

    The store is a folder of Parquet files, one for each batch number: a batch
    that is run again replaces its own files. So a document whose pages arrive in
    several batches gets a whole record with the last of them.
    """

    def run(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        batch.select("doc", "page", "text").write.mode("overwrite").parquet(f"{store}/batch={n}")
        every = spark.read.parquet(store).filter(F.col("batch") <= n)
        touched = every.filter(F.col("batch") == n).select("doc").distinct()
        latest = every.join(touched, "doc", "left_semi").groupBy("doc", "page").agg(F.max_by("text", "batch").alias("text"))
        sink(D.run(latest, prices).records, n)

    return pages.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
