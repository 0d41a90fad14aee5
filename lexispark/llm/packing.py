"""Packing documents into fixed-length sequences, with a target share of each source in every window."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexispark.functions.storage import small_enough, stored

END, SPECIAL = 1, "<|endoftext|>"
#: The byte-level pattern (a fixed value), and texts for which every version of Unicode agrees about it.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PLAIN = re.compile("[\t\n\r -~\u00a1-\u024f\u0391-\u03a1\u03a3-\u03c9\u0400-\u045f\u2010-\u2027\u2030-\u205e\u20ac]*")



def _in_merge_order(path: str):
    """A tiktoken encoding of a byte-level BPE file, if its ids follow its merges; otherwise None."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    model, before = made["model"], made["pre_tokenizer"] or {}
    if model.get("type", "BPE") != "BPE" or made["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    special = {t["content"] for t in made["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in piece): i for piece, i in model["vocab"].items() if piece not in special}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [model["vocab"]["".join(p)] for p in pairs]
    if ids != sorted(ids) or len(ranks) != 256 + len(ids) or max(ranks.values(), default=0) >= len(ranks):
        return None
    return tiktoken.Encoding("plain", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


class IdEncoder:
    """Token ids as the tokenizers library gives them, packed as little-endian unsigned numbers.

    If the vocabulary is in the order of its merges, texts of plain letters are encoded by tiktoken from the same file,
    which gives the same ids in a fifth of the time; others, and texts with the special string, by the library itself.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library, self.quick = Tokenizer.from_file(path), _in_merge_order(path)
        self.code = "H" if self.library.get_vocab_size() <= 65536 else "I"

    def pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def encode(self, text: str) -> bytes:
        if not self.quick or SPECIAL in text or not _PLAIN.fullmatch(text):
            return self.pack(self.library.encode(text, add_special_tokens=False).ids)
        return self.pack(self.quick.encode_ordinary(text))


class Schedule:
    """Deficit round-robin over the queues, in closed form.

    Window w+1 may take from queue k what its quota has grown to, floor((w+1) * window * share) tokens, less
    what it has taken so far; the fraction left over is the deficit that the next window gets. Windows
    are laid out one after the other, so (queue, offset) has one position in the whole stream, whichever task
    asks for it.
    """

    def __init__(self, totals: list[int], shares: list[int], window: int) -> None:
        self.totals, self.shares, self.whole, self.window = totals, shares, sum(shares) or 1, window
        self.start = lru_cache(maxsize=256)(self._start)

    def quota(self, k: int, w: int) -> int:
        return min(self.totals[k], w * self.window * self.shares[k] // self.whole)

    def _start(self, w: int) -> list[int]:
        """For each queue, the position in the stream of its first token in window w."""
        out, at = [], 0
        now, then = ([self.quota(k, x) for k in range(len(self.totals))] for x in (w, w + 1))
        at = sum(now)
        for a, b in zip(now, then):
            out.append(at)
            at += b - a
        return out

    def pieces(self, k: int, first: int, n: int) -> Iterator[tuple[int, int]]:
        """(position, length) of the parts of the tokens first..first+n of queue k."""
        w = max(0, first * self.whole // (self.window * self.shares[k]) - 1)
        while n:
            low, high = self.quota(k, w), self.quota(k, w + 1)
            if first < high:
                m = min(n, high - first)
                yield self.start(w)[k] + first - low, m
                first, n = first + m, n - m
            w += 1


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, source, task, first, n, ids): first counts the tokens of the source before it in its task."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before = IdEncoder(path), {}
        end = encoder.pack([END])
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                ids = [encoder.encode(t or "") + end for t in part.column("text").to_pylist()]
                lengths = [len(x) // len(end) for x in ids]
                first = []
                for source, n in zip(part.column("source").to_pylist(), lengths):
                    first.append(before.get(source, 0))
                    before[source] = first[-1] + n
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("source"), part.column("task"), pa.array(first, pa.int64()), pa.array(lengths, pa.int64()), pa.array(ids, pa.binary())],
                    ["doc_id", "source", "task", "first", "n", "ids"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source"), F.spark_partition_id().alias("task"))
    return rows.mapInArrow(encode, "doc_id long, source string, task int, first long, n long, ids binary")


def _unpack(ids: bytes, n: int) -> bytes:
    """n packed ids as unsigned 32-bit numbers."""
    return ids if len(ids) == 4 * n else np.frombuffer(ids, "<u2").astype("<u4").tobytes()


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, window_sequences: int = 64, weights: dict | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every window of window_sequences sequences holds the sources in the proportions of weights (by default
    their shares of all tokens, so that all queues end together; with weights, a source without one has weight 1),
    as long as they last. Each source is a queue of its own, however many there are; the driver holds a row a source. Sequences are cut from the stream without padding; only the very last one may be
    short. A null or empty text is its end token alone; null source is a source; repeated rows are packed each;
    an empty table gives no rows.

    The ids are written once to the shared folder, with offsets by task and source, so that nothing is
    encoded twice and a lost executor costs no more than its own tasks.
    """
    spark = docs.sparkSession
    ids = stored(tokenised(docs, tokenizer), "ids")
    parts = ids.groupBy("source", "task").agg(F.sum("n").alias("n"))
    sums = parts.groupBy("source").agg(F.sum("n").alias("n"))
    totals = sorted(((r.source, r.n) for r in sums.collect()), key=lambda r: (r[0] is None, r[0] or ""))
    shares = [n if weights is None else weights.get(q, 1) for q, n in totals]
    scale = 1 if all(isinstance(x, int) for x in shares) else 10**9
    number = {q: k for k, (q, _) in enumerate(totals)}
    plan = spark.sparkContext.broadcast(([n for _, n in totals], [max(1, round(x * scale)) for x in shares], number))

    order = Window.partitionBy("source").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.withColumn("base", F.coalesce(F.sum("n").over(order), F.lit(0)))
    bases = small_enough(bases.select(F.col("source").alias("s"), F.col("task").alias("t"), "base"))
    rows = ids.join(bases, F.col("source").eqNullSafe(F.col("s")) & (F.col("task") == F.col("t")))
    rows = rows.select("doc_id", "source", (F.col("base") + F.col("first")).alias("first"), "n", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, part_of, numbers = plan.value
        schedule = Schedule(sizes, part_of, window_sequences * length)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, q, first, n, packed in zip(*(c.to_pylist() for c in batch.columns)):
                data, start = memoryview(_unpack(packed, n)), 0
                for at, m in schedule.pieces(numbers[q], first, n):
                    while m:
                        k = min(m, length - at % length)
                        out.append((doc_id, start, k, zlib.crc32(data[4 * start : 4 * (start + k)]), n, at // length, at % length))
                        start, at, m = start + k, at + k, m - k
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 7)], names)

    return rows.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
