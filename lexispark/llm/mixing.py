"""Mixing sources to target weights with hash thresholds (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.functions.numbering import number_rows, running_total
from lexispark.functions.storage import small_enough, stored

WORDS = r"[^\x20\x09-\x0D]+"
#: The hash has 60 bits, in LEVELS digits of BITS bits each.
BITS, LEVELS = 12, 5


def doc_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of the md5 of the id as text and the md5 of the text (null: of the empty text), so texts under one id differ."""
    both = F.concat_ws(" ", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(both), 1, 15), 16, 10).cast("long")


def _digits(upto: int) -> Column:
    """The hash without its last LEVELS - upto digits."""
    return F.shiftright("h", BITS * (LEVELS - upto))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_repeats: int = 2) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    Sources in code point order (null last) get the weights in turn. Together they get share times all
    sizes; a source stops at max_repeats times its own size, and what it can't hold goes to the others
    by weight until none is above its limit. That is a water level: each target is the smaller of the
    limit and level x weight, and the level is the largest one that any set of full sources leaves.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("last", F.col("source").isNull())
    per = number_rows(per, ["last", "source"], "place", 0)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("limit", F.col("source_size") * max_repeats).withColumn("fills", F.col("limit") / F.col("weight"))
    for c in ("limit", "weight"):
        per = running_total(per, ["fills", "place"], c, f"{c}_before")
    whole = per.agg((F.sum("source_size") * F.lit(float(share))).alias("budget"), F.sum("weight").alias("weights"))
    per = per.join(whole).withColumn("level", (F.col("budget") - F.col("limit_before")) / (F.col("weights") - F.col("weight_before")))
    level = per.agg(F.max("level").alias("top"))
    return per.join(level).select("source", "source_size", F.least(F.col("limit").cast("double"), F.col("top") * F.col("weight")).alias("target"))


def thresholds(base: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, source_size, target, repeats, threshold, closed) from base rows (source, size, h).

    Every document is taken `repeats` times, and once more if its hash is under the threshold, or at it
    if closed. Per level a histogram sums the sizes by source and hash digit; only the digit in which the
    budget runs out is looked at again, a digit finer. The last digit holds one hash value: it is taken
    if that brings the source nearer to its target.
    """
    repeats = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    at = wanted.withColumn("repeats", repeats.cast("int")).withColumn("need", F.col("target") - F.col("repeats") * F.col("source_size"))
    at = at.withColumn("threshold", F.lit(0).cast("long"))
    keep = ["source", "source_size", "target", "repeats"]
    for level in range(1, LEVELS + 1):
        inside = base.alias("b").join(at.alias("a"), F.col("b.source").eqNullSafe(F.col("a.source")) & (_digits(level - 1) == F.col("a.threshold")))
        sums = inside.groupBy(*[F.col(f"a.{c}") for c in keep], F.col("a.need"), _digits(level).alias("digit")).agg(F.sum("b.size").alias("held"))
        order = Window.partitionBy("source").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("upto", F.sum("held").over(order)).where(F.col("upto") >= F.col("need"))
        first = sums.groupBy("source").agg(F.min_by(F.struct(*keep[1:], "need", "held", "upto", F.col("digit").alias("threshold")), "digit").alias("x"))
        at = first.select("source", "x.*").withColumn("need", F.col("need") - F.col("upto") + F.col("held"))
    return at.select(*keep, "threshold", (F.col("held") <= 2 * F.col("need")).alias("closed"))


def _extra(h: Column) -> Column:
    return (h < F.col("threshold")) | ((h == F.col("threshold")) & F.col("closed"))


def sized(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, source, size, h), stored: the texts are read once."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")
    return stored(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), doc_hash(F.col(doc_id), F.col(text)).alias("h")), "sizes")


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_repeats: int = 2) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken.

    Null text has size 0; null source is a source of its own (the last). Rows equal in id and text have the same
    hash and are taken together. An empty table gives no rows. The same table gives the same mix again.
    """
    base = sized(docs)
    marks = small_enough(thresholds(base, targets(base, weights, share, max_repeats)))
    both = base.alias("b").join(marks.alias("m"), F.col("b.source").eqNullSafe(F.col("m.source")))
    taken = F.col("size") * (F.col("repeats") + _extra(F.col("h")).cast("int"))
    return both.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def apply_mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_repeats: int = 2) -> DataFrame:
    """The documents of the mix with all their columns, each as often as it is taken, at most max_repeats times.

    Null and empty texts have size 0, fill nothing, and come as often as others of their hash in their source; null source is
    a source of its own. Rows equal in id and text are taken together. An empty table gives no rows. The texts stay where they are: the thresholds, a row a source, go to them if there are few enough sources.
    """
    base = sized(docs)
    marks = small_enough(thresholds(base, targets(base, weights, share, max_repeats)).withColumnRenamed("source", "mark_source"))
    rows = docs.select(F.struct("*").alias("doc"))
    rows = rows.join(marks, F.col("doc.source").eqNullSafe(F.col("mark_source")))
    times = F.least(F.col("repeats") + _extra(doc_hash(F.col("doc.doc_id"), F.col("doc.text"))).cast("int"), F.lit(max_repeats))
    return rows.where(times > 0).select("doc", F.explode(F.sequence(F.lit(1), times)).alias("copy")).select("doc.*")
