"""Which patterns fit, summed up where they meet.

Two patterns of one structure fit if they differ in no doculect that both attest and are alike in enough. Of a million patterns each
may fit thousands, so pairs are never made into rows. The index is by the sound of the doculect that most patterns of a structure attest:
a pattern that has a sound there is sent to the patterns with the same sound and to those that lack one, a pattern that lacks it to
all sounds. What meets under a key is cut into blocks, a task compares two blocks as arrays, and a pattern gets a row, or a row for
each sound it is asked about, from each.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.functions.sequences import GAP, MISSING
from lexispark.functions.storage import materialise, small_enough

#: Patterns of a block, and of it those that are compared with another block at once.
BLOCK, ROWS = 4_000, 256
_KEY = ["struct", "key"]


def coded(patterns: pd.Series, number: dict[str, int]) -> np.ndarray:
    return np.array([[number.setdefault(x, len(number)) for x in p] for p in patterns], np.int32)


def compared(a: np.ndarray, b: np.ndarray, threshold: int):
    """(places in a, fits, matches) for some rows of a at a time; codes are 0 for missing, 1 for a gap."""
    columns = np.ascontiguousarray(b.T)
    for low in range(0, len(a), ROWS):
        some = a[low : low + ROWS]
        same, clash = np.zeros((len(some), len(b)), np.int16), np.zeros((len(some), len(b)), bool)
        for mine, other in zip(some.T, columns):
            mine = mine[:, None]
            equal = mine == other
            same += equal & (mine > 1)
            clash |= ~equal & (mine > 0) & (other > 0)
        yield slice(low, low + len(some)), ~clash & (same >= threshold), same


def meet(left: DataFrame, right: DataFrame, work: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, missing: str = MISSING, block: int = BLOCK) -> DataFrame:
    """work(some of left, some of right) for blocks in which every pair that may fit meets once. left and right have struct and pattern."""
    left, right = materialise(left), materialise(right)
    cells = right.select("struct", F.posexplode("pattern").alias("at", "x")).where(F.col("x") != missing).groupBy("struct", "at").agg(F.count("*").alias("n"))
    best = small_enough(cells.groupBy("struct").agg(F.max_by("at", F.struct("n", -F.col("at"))).alias("at")))
    placed = lambda df: df.join(best, "struct", "left").withColumn("own", F.get("pattern", F.coalesce("at", F.lit(0)))).drop("at")
    held = placed(right).withColumnRenamed("own", "key")
    sizes = small_enough(held.groupBy(*_KEY).agg(F.ceil(F.count("*") / block).cast("int").alias("rights")))
    keys = small_enough(sizes.groupBy("struct").agg(F.collect_set("key").alias("keys")))  # the sounds of a doculect
    asked = placed(left).join(keys, "struct")
    probes = F.when(F.col("own") == missing, F.col("keys")).otherwise(F.array("own", F.lit(missing)))
    asked = asked.withColumn("key", F.explode(probes)).drop("keys", "own")
    sizes = small_enough(asked.groupBy(*_KEY).agg(F.ceil(F.count("*") / block).cast("int").alias("lefts")).join(sizes, _KEY))
    part = lambda c: F.pmod(F.xxhash64("pattern"), c).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    asked = asked.join(sizes, _KEY).withColumn("lb", part("lefts")).withColumn("rb", every("rights")).drop("lefts", "rights")
    held = held.join(sizes, _KEY).withColumn("rb", part("rights")).withColumn("lb", every("lefts")).drop("lefts", "rights")
    held = held.select(*(F.col(c).alias(c) for c in held.columns))  # both sides may be one table
    group = [*_KEY, "lb", "rb"]

    def both(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        return work(asked, held) if len(asked) and len(held) else work(asked.iloc[:0], held.iloc[:0])

    return asked.groupBy(*group).cogroup(held.groupBy(*group)).applyInPandas(both, schema)


def fitting(left: DataFrame, right: DataFrame, sums: dict[str, str | None], maxima: dict[str, str] | None = None, threshold: int = 1, missing: str = MISSING, gap: str = GAP) -> DataFrame:
    """(struct, pattern, matched, measures): for the different patterns on the left, measures over the rows on the right whose
    patterns fit them: no mismatch and at least `threshold` matches (equal sounds, not gaps). Patterns that none fits are left out.

    sums and maxima name columns of whole numbers on the right (None: each row counts 1); matched is the sum of matches.
    """
    maxima = maxima or {}
    asked = left.select("struct", "pattern").distinct().withColumn("id", F.xxhash64("struct", "pattern"))
    held = right.select("struct", "pattern", *(F.lit(1).cast("long").alias(f"_{n}") if c is None else F.col(c).cast("long").alias(f"_{n}") for n, c in {**sums, **maxima}.items()))
    names = ["matched", *sums, *maxima]

    def work(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        number = {missing: 0, gap: 1}
        b, a = coded(held["pattern"], number), coded(asked["pattern"], number)
        weights = np.stack([held[f"_{n}"].to_numpy(np.float64) for n in sums], 1) if sums else np.zeros((len(held), 0))
        out = []
        for rows, fits, same in compared(a, b, threshold) if len(a) and len(b) else ():
            any_ = fits.any(1)
            values = [(fits * same).sum(1, dtype=np.int64), *(fits.astype(np.float64) @ weights).T.round().astype(np.int64)]
            values += [np.where(fits, held[f"_{n}"].to_numpy()[None, :], np.iinfo(np.int64).min).max(1) for n in maxima]
            out.append([v[any_] for v in (asked["id"].to_numpy()[rows], *values)])
        whole = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * (1 + len(names))
        return pd.DataFrame(dict(zip(["id", *names], whole)))

    found = meet(asked, held, work, ", ".join(f"{n} long" for n in ["id", *names]), missing)
    totals = found.groupBy("id").agg(*(F.sum(n).alias(n) for n in ["matched", *sums]), *(F.max(n).alias(n) for n in maxima))
    return asked.join(totals, "id").select("struct", "pattern", *names)


def sounds_of_fitting(left: DataFrame, right: DataFrame, weight: str, spread: str = "pattern", threshold: int = 1, filled: bool = False, but_itself: bool = False, missing: str = MISSING, gap: str = GAP) -> DataFrame:
    """(struct, pattern, col, sound, weight): for the different patterns on the left, the weights of the rows on the right whose
    patterns fit them, by the sounds of their column `spread` (patterns of the same width).

    filled: only in columns that the pattern on the left lacks, and only sounds. but_itself: a row with the same pattern weighs one less.
    """
    asked = left.select("struct", "pattern").distinct().withColumn("id", F.xxhash64("struct", "pattern"))
    held = right.select("struct", "pattern", F.col(spread).alias("_spread"), F.col(weight).cast("long").alias("_w"))

    def work(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        number = {missing: 0, gap: 1}
        b, a = coded(held["pattern"], number), coded(asked["pattern"], number)
        shown: dict[tuple[int, str], int] = {}
        at = np.array([[shown.setdefault((c, x), len(shown)) for c, x in enumerate(p)] for p in held["_spread"]])
        w, out = held["_w"].to_numpy(np.float64), []
        if len(a) and len(b):
            heavy, ones = np.zeros((len(b), len(shown))), np.zeros((len(b), len(shown)))
            heavy[np.arange(len(b))[:, None], at] = w[:, None]
            ones[np.arange(len(b))[:, None], at] = 1
            names = list(shown)
            column, blank = np.array([c for c, _ in names]), np.array([x == missing for _, x in names])
        for rows, fits, _ in compared(a, b, threshold) if len(a) and len(b) else ():
            sums = fits.astype(np.float64) @ heavy
            if but_itself:
                itself = fits & (a[rows][:, None, :] == b[None, :, :]).all(2)
                sums -= itself.astype(np.float64) @ ones
            if filled:
                sums *= (a[rows][:, column] == 0) & ~blank
            i, k = np.nonzero(sums)
            out.append((asked["id"].to_numpy()[rows][i], k, sums[i, k].round().astype(np.int64)))
        ids, k, weights = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
        return pd.DataFrame({"id": ids, "col": column[k] if out else k, "sound": pd.Series([names[x][1] for x in k.tolist()] if out else [], dtype=object), "weight": weights})

    found = meet(asked, held, work, "id long, col int, sound string, weight long", missing)
    totals = materialise(found.groupBy("id", "col", "sound").agg(F.sum("weight").alias("weight")))
    return asked.join(totals, "id").select("struct", "pattern", "col", "sound", "weight")
