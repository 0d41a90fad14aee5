"""Exact token counts and ids by looking pre-tokens up, map-side, in two tiers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most entries in the broadcast table, most in a worker's own cache, and rows looked at to fill the table.
TABLE, CACHE, SAMPLE = 50_000, 400_000, 2_000
_RUN = re.compile(r"\n| *[^ \n]+| +")


def pre_tokens(text: str) -> list[str]:
    """The text cut where no piece of the vocabulary can reach across.

    No piece has a space inside (only in front) and none has a newline, so a text breaks before each run of
    spaces and around each newline. The library puts one space before a text; a key with leading spaces
    stands for itself, one without starts after a newline.
    """
    if "  " not in text and "\n" not in text and text[0] != " " and text[-1] != " ":
        return [" " + w for w in text.split(" ")]
    return _RUN.findall(" " + text)


class PieceCounter:
    """Counts tokens of texts as the sentencepiece library does by default."""

    def __init__(self, model_file: str, table: dict[str, int] | None = None) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.table, self.cache = table or {}, {}
        self.newline = len(self.library.encode("\n")) - 1

    def lengths(self, keys: list[str]) -> list[int]:
        """Tokens of each pre-token, by the library."""
        heads = [k[1:] if k[0] == " " and k != " " else "\n" + k for k in keys]
        less = [0 if k[0] == " " and k != " " else 1 + self.newline for k in keys]
        less = [self.newline if k == " " else n for k, n in zip(keys, less)]
        heads = ["\n" if k == " " else h for k, h in zip(keys, heads)]
        return [len(ids) - n for ids, n in zip(self.library.encode(heads, num_threads=1), less)]

    def count(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        table, cache = self.table, self.cache
        cut = []
        for text in texts:
            cut.append(pre_tokens(text) if text and "▁" not in text else None)
        new = {k for keys in cut if keys for k in keys if k not in table and k not in cache}
        if len(cache) + len(new) > CACHE:
            cache.clear()
            new = {k for keys in cut if keys for k in keys if k not in table}
        new = list(new)
        cache.update(zip(new, self.lengths(new)))
        for text, keys in zip(texts, cut):
            if keys is None:
                out.append(len(self.library.encode(text)) if text else 0)
            else:
                out.append(sum([table[k] if k in table else cache[k] for k in keys]))
        return out


def frequent_lengths(docs: DataFrame, model_file: str, rows: int = SAMPLE, size: int = TABLE) -> dict[str, int]:
    """Lengths of the most frequent pre-tokens of about `rows` documents, each drawn for itself whatever its id.

    Only speed depends on it, no count. The sample's counts, of about `rows` documents however large the table, are summed by
    a small aggregate; a task holds at most 16 times `size` of them, the most frequent when there are more.
    """

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from collections import Counter

        total: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                if text:
                    total.update(pre_tokens(text))
                    if len(total) > 16 * size:
                        total = Counter(dict(total.most_common(4 * size)))
        yield pd.DataFrame(total.most_common(4 * size), columns=["key", "n"])

    share = min(1.0, rows / max(1, docs.count()))
    sample = docs.select("text").sample(fraction=share, seed=5).mapInPandas(counts, "key string, n long")
    top = sample.groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(size).select("key")
    keys = [r.key for r in top.collect()]
    return dict(zip(keys, PieceCounter(model_file).lengths(keys))) if keys else {}


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit.

    Null and empty texts have 0 bytes and 0 tokens; repeated rows are counted each; null ids stay null.
    The table of frequent pre-tokens has at most TABLE entries and is sent to the workers; the rest is encoded
    where it occurs and kept in a worker's cache of at most CACHE entries. No pre-token of the table is shuffled, only the
    counts of the sample that fills the table (see frequent_lengths).
    """
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, model_file))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(model_file, table.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                counts = counter.count([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    out = rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
