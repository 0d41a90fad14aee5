"""Trimming of alignments: sites with many gaps go as long as a syllable skeleton remains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.functions.phonology import sound_class
from lexispark.functions.sequences import GAP
from lexispark.operators.prepare import has_skeleton


def site_table(alignments: DataFrame, gap: str = GAP) -> DataFrame:
    """(cogid, pos, ratio, class): the share of gaps, and the class of the first sound (by id), + if there is none."""
    rows = alignments.select("cogid", "id", F.posexplode("alignment").alias("pos", "x"))
    first = F.min_by("x", F.when(F.col("x") != gap, F.col("id")))
    out = rows.groupBy("cogid", "pos").agg(F.avg((F.col("x") == gap).cast("int")).alias("ratio"), first.alias("x"))
    return out.select("cogid", "pos", "ratio", F.when(F.col("x").isNull(), "+").otherwise(sound_class(F.col("x"))).alias("class"))


def kept_sites(sites: DataFrame, strategy: str = "gap-oriented", threshold: float = 0.5, skeletons: tuple[str, ...] = ("CV", "VC"), strict: bool = True, exclude: str = "_+") -> DataFrame:
    """(cogid, kept): positions that stay, in order.

    Markers always go. Candidates have at least the threshold's share of gaps: gap-oriented in groups of equal share,
    the largest share first, from left to right in a group; core-oriented only those at the ends, from the end
    inwards, then from the start inwards. One goes if what is left still holds a skeleton in order. If strict, the first
    group in which one has to stay is the last.
    """
    if strategy not in ("gap-oriented", "gap", "core-oriented", "core"):
        raise ValueError(f"unknown strategy {strategy}")
    by_gap = strategy.startswith("gap")
    if by_gap:
        ranked = sites.withColumn("place", F.when(F.col("ratio") >= threshold, F.struct((-F.col("ratio")).alias("a"), F.col("pos").cast("double").alias("b"))))
        ranked = ranked.withColumn("group", -F.col("ratio"))
    else:
        full = F.when(F.col("ratio") < threshold, F.col("pos"))
        whole = Window.partitionBy("cogid")
        ranked = sites.withColumn("lo", F.min(full).over(whole)).withColumn("hi", F.max(full).over(whole))
        trailing = F.col("hi").isNull() | (F.col("pos") > F.col("hi"))
        leading = F.col("lo").isNull() | (F.col("pos") < F.col("lo"))
        place = F.when(trailing, F.struct(F.lit(0.0).alias("a"), (-F.col("pos")).cast("double").alias("b"))).when(leading, F.struct(F.lit(1.0).alias("a"), F.col("pos").cast("double").alias("b")))
        ranked = ranked.withColumn("place", place).withColumn("group", F.when(trailing, -F.col("pos")).otherwise(F.col("pos") + 1).cast("double"))
    held = ranked.groupBy("cogid").agg(
        F.array_sort(F.collect_list(F.struct("pos", "class"))).alias("sites"),
        F.array_sort(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "pos", "group")))).alias("candidates"),
    )
    gone = F.transform(F.filter("sites", lambda s: s["class"].isin(*exclude)), lambda s: s["pos"])
    start = F.struct(gone.alias("gone"), F.lit(False).alias("refused"), F.lit(None).cast("double").alias("group"))

    def left(out: Column) -> Column:
        return F.transform(F.filter("sites", lambda s: ~F.array_contains(out, s["pos"])), lambda s: s["class"])

    def step(state: Column, c: Column) -> Column:
        tried = F.array_append(state["gone"], c["pos"])
        stop = state["refused"] & (F.coalesce(state["group"] != c["group"], F.lit(True)))
        fine = ~stop & has_skeleton(left(tried), skeletons)
        return F.struct(
            F.when(fine, tried).otherwise(state["gone"]).alias("gone"),
            (state["refused"] | (~fine if strict else F.lit(False))).alias("refused"),
            F.when(stop, state["group"]).otherwise(c["group"]).alias("group"),
        )

    final = F.aggregate("candidates", start, step, lambda s: s["gone"])
    return held.withColumn("out", final).select("cogid", F.transform(F.filter("sites", lambda s: ~F.array_contains(F.col("out"), s["pos"])), lambda s: s["pos"]).alias("kept"))


def trim(alignments: DataFrame, strategy: str = "gap-oriented", threshold: float = 0.5, skeletons: tuple[str, ...] = ("CV", "VC"), strict: bool = True, exclude: str = "_+", gap: str = GAP) -> DataFrame:
    """The alignments without the sites that trimming takes (see kept_sites)."""
    kept = kept_sites(site_table(alignments, gap), strategy, threshold, skeletons, strict, exclude)
    return alignments.join(kept, "cogid").withColumn("alignment", F.transform("kept", lambda p: F.get("alignment", p))).drop("kept")


def trim_random(alignments: DataFrame, seed: int = 0, strategy: str = "gap-oriented", threshold: float = 0.5, skeletons: tuple[str, ...] = ("CV", "VC"), exclude: str = "_+", gap: str = GAP, strict: bool = True) -> DataFrame:
    """The alignments with as many sites of each class as trimming (with these options) leaves, chosen by a seeded hash of (cogid, pos)."""
    sites = site_table(alignments, gap)
    kept = kept_sites(sites, strategy, threshold, skeletons, strict, exclude).select("cogid", F.explode("kept").alias("pos"))
    quota = kept.join(sites, ["cogid", "pos"]).groupBy("cogid", "class").agg(F.count("*").alias("quota"))
    order = Window.partitionBy("cogid", "class").orderBy(F.md5(F.concat_ws(" ", F.lit(str(seed)), F.col("cogid").cast("string"), F.col("pos").cast("string"))), "pos")
    drawn = sites.withColumn("rank", F.row_number().over(order)).join(quota, ["cogid", "class"]).where("rank <= quota")
    drawn = drawn.groupBy("cogid").agg(F.array_sort(F.collect_list("pos")).alias("kept"))
    return alignments.join(drawn, "cogid").withColumn("alignment", F.transform("kept", lambda p: F.get("alignment", p))).drop("kept")
