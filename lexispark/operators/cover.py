"""Greedy cover in rounds: each item goes to the first head before it that it fits, and no task holds all of them.

Taken one by one, an item is compared with the heads in the order in which they arose; the first one that it fits takes it in
and grows, and without one it becomes the last head. An item that passes a head leaves no trace on it, so heads can be cut into stages and
items into blocks: stage s sees the blocks in order, each without what the stages before it took in, and makes heads of what is
left until it is full. Block b meets stage s in round b + s, when all that comes before either is done. A round is one job, a task of it holds a
block and a stage, and the result is the same as one by one, whatever the size of blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.functions.numbering import number_rows
from lexispark.functions.sequences import GAP, MISSING
from lexispark.functions.storage import new_path

#: Patterns of a block, and heads of a stage.
BLOCK = 4_096
_HEAD, _TAKEN, _PASSED = 0, 1, 2
_ROWS = "struct string, stage int, number long, head long, pattern array<string>"


def take_in(codes: np.ndarray, heads: np.ndarray, room: int, threshold: int, gap: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The heads, grown and at most `room`, and for each pattern in order the place of its head, or -1 if it passes. 0 is missing."""
    held = len(heads)
    grown = np.zeros((min(room, held + len(codes)), codes.shape[1]), codes.dtype)
    grown[:held], places = heads, np.full(len(codes), -1)
    for i, row in enumerate(codes):
        now = grown[:held]
        same, known = now == row, (now > 0) & (row > 0)
        fits = (same | ~known).all(1) & ((same & known & (row != gap)).sum(1) >= threshold)
        at = int(fits.argmax()) if held else 0
        if held and fits[at]:
            grown[at] = np.where(now[at] > 0, now[at], row)
        elif held < room:
            at, held = held, held + 1
            grown[at] = row
        else:
            continue
        places[i] = at
    return grown[:held], places


def greedy_cover(patterns: DataFrame, order: list[str], threshold: int = 1, missing: str = MISSING, gap: str = GAP, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(struct, pattern, stage, head) for the different patterns of each structure, and the heads: (struct, stage, head, consensus).

    order names the columns by which the patterns of a structure come, unique together in it. Heads are numbered in the order in
    which they arose within a stage, stages in order.
    """
    spark = patterns.sparkSession
    numbered = number_rows(patterns.select("struct", "pattern", *order), ["struct", *order], start=0)
    first = numbered.groupBy("struct").agg(F.min("number").alias("first"))
    numbered = numbered.join(first, "struct").select("struct", (F.col("number") - F.col("first")).alias("number"), "pattern")
    path = new_path(spark, "cover")
    numbered.withColumn("block", F.floor(F.col("number") / block)).write.partitionBy("block").parquet(f"{path}/blocks")  # a round reads its own
    numbered = spark.read.schema("struct string, number long, pattern array<string>, block long").parquet(f"{path}/blocks")
    structs, last = numbered.agg(F.count_distinct("struct"), F.max("block")).first()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("number", kind="stable")
        old, new = frame[frame["kind"] == _HEAD], frame[frame["kind"] != _HEAD]
        number = {missing: 0, gap: 1}
        coded = lambda rows: np.array([[number.setdefault(x, len(number)) for x in p] for p in rows], np.int32)
        codes = coded(new["pattern"]) if len(new) else np.zeros((0, len(old["pattern"].iloc[0])), np.int32)
        heads, places = take_in(codes, coded(old["pattern"]) if len(old) else codes[:0], block, threshold)
        sounds = np.array(list(number), object)
        struct, stage, went = frame["struct"].iloc[0], int(frame["stage"].iloc[0]), places < 0
        out = [
            pd.DataFrame({"number": np.arange(len(heads)), "kind": _HEAD, "stage": stage, "head": -1, "pattern": list(sounds[heads])}),
            pd.DataFrame({"number": new["number"][~went], "kind": _TAKEN, "stage": stage, "head": places[~went], "pattern": None}),
            pd.DataFrame({"number": new["number"][went], "kind": _PASSED, "stage": stage + 1, "head": -1, "pattern": new["pattern"][went]}),
        ]
        return pd.concat([x for x in out if len(x)]).assign(struct=struct)[["struct", "stage", "number", "head", "pattern", "kind"]]

    at, standing = 0, None
    while True:
        rows = numbered.where(F.col("block") == at).select("struct", F.lit(0).alias("stage"), "number", F.lit(-1).cast("long").alias("head"), "pattern", F.lit(_PASSED).alias("kind"))
        rows = rows.unionByName(standing) if standing is not None else rows
        tasks = max(1, min(parts, structs * (at + 1)))
        done = rows.repartition(tasks, "struct", "stage").groupBy("struct", "stage").applyInPandas(work, f"{_ROWS}, kind int")
        done.write.partitionBy("kind").parquet(f"{path}/rounds/round={at}")
        found = spark.read.schema(f"{_ROWS}, kind int").parquet(f"{path}/rounds/round={at}")
        standing, at = found.where(F.col("kind") != _TAKEN), at + 1
        if at > (last or 0) and standing.where(F.col("kind") == _PASSED).isEmpty():
            break
    every = spark.read.schema(f"{_ROWS}, round int, kind int").parquet(f"{path}/rounds")
    taken = every.where(F.col("kind") == _TAKEN).select("struct", "number", "stage", "head")
    heads = found.where(F.col("kind") == _HEAD).select("struct", "stage", F.col("number").alias("head"), F.col("pattern").alias("consensus"))
    return numbered.join(taken, ["struct", "number"]).select("struct", "pattern", "stage", "head"), heads
