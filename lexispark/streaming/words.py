"""Append words from a stream and keep the alignment sites of the cognate sets they belong to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexispark.operators.sites import get_sites


def follow_words(stream: DataFrame, words_path: str, sites_path: str, state_path: str, langs: list[str], minrefs: int = 3) -> StreamingQuery:
    """Start a query over a stream of morphemes (columns as sources.wordlists.morphemes gives them, with structure).

    Each batch is added to words_path, and the sites of its cogids, over all words so far, to sites_path with the batch
    number. Both writes go to a folder named by the batch and replace it, so a batch that is run again after a failure
    leaves nothing twice. latest_sites reads what holds.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{words_path}/batch={number}")
        words = spark.read.parquet(words_path).where(F.col("batch") <= number).drop("batch").dropDuplicates(["id", "m_idx"])
        touched = spark.read.parquet(f"{words_path}/batch={number}").select("cogid").distinct()
        sites = get_sites(words.join(touched, "cogid", "left_semi"), langs, minrefs)
        sites.write.mode("overwrite").parquet(f"{sites_path}/batch={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", state_path).trigger(availableNow=True).start()


def latest_sites(spark: SparkSession, sites_path: str) -> DataFrame:
    """For each cogid the sites of the last batch that touched it."""
    rows = spark.read.parquet(sites_path)
    last = rows.groupBy("cogid").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["cogid", "batch"]).drop("batch")
