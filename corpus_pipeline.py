"""From raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the
columns of documents; no stage needs SQL beyond DataFrames, but language ID is a trained model, so the whole has no
SQL counterpart (ORACLE_SQL is None) and is tested stage by stage against brute force. What a stage keeps is written to the
shared folder once and read from there, so no stage runs twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexispark.functions.storage import stored
from lexispark.llm.lang_id import keep_identified
from lexispark.llm.line_dedup import keep_what_is_left
from lexispark.llm.mixing import apply_mix
from lexispark.llm.ngram_join import keep_one_each
from lexispark.llm.packing import pack
from lexispark.llm.queries import tokenizer


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, of which no language claims three tenths, or whose words are unfamiliar, go."""
    return keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines that stand at an earlier place go; documents of which nothing is left go too."""
    return keep_what_is_left(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id stays."""
    return keep_one_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to twice."""
    return apply_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens; a document taken twice has its pieces twice."""
    return pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources", mix_sources),
    ("packing", packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, one after the other, each on what the one before it has written down."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
