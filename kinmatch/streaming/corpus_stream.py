"""Corpus statistics kept up to date from a stream of records: an extension of the batch form.

Each micro-batch's counts are written as a table of its own, so a batch that is run again replaces
its own counts; the sum over the batches equals the counts of all records at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinmatch.functions import text as X
from kinmatch.operators import corpus


def start(records: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Count words by country in every micro-batch of (country, name, ...)."""

    def count(batch: DataFrame, number: int) -> None:
        rec = batch.withColumn("tok", X.tokens(F.col("name"))).withColumn("atok", F.array().cast("array<string>"))
        corpus.token_df(rec).write.mode("overwrite").parquet(f"{folder}/df/batch={number}")
        corpus.country_totals(rec).write.mode("overwrite").parquet(f"{folder}/totals/batch={number}")

    return records.writeStream.foreachBatch(count).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(token counts, country totals) over all batches so far."""
    df = spark.read.parquet(f"{folder}/df").drop("batch")
    totals = spark.read.parquet(f"{folder}/totals").drop("batch")
    return corpus.merge_totals([df], ["country", "token"]), corpus.merge_totals([totals], ["country"])
