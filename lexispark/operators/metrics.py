"""Measures of wordlists, cognate sets and patterns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.operators.fits import fitting


def bcubed(rows: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(keys, precision, recall, f): B-cubed of two labellings of the same items; the mean over items of the share of
    its group in a that its group in b holds too, and the reverse."""
    cells = rows.groupBy(*keys, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    in_a = cells.groupBy(*keys, "a").agg(F.sum("n").alias("na"))
    in_b = cells.groupBy(*keys, "b").agg(F.sum("n").alias("nb"))
    joined = cells.join(in_a, [*keys, "a"]).join(in_b, [*keys, "b"])
    out = joined.groupBy(*keys).agg((F.sum(F.col("n") * F.col("n") / F.col("na")) / F.sum("n")).alias("precision"), (F.sum(F.col("n") * F.col("n") / F.col("nb")) / F.sum("n")).alias("recall"))
    return out.withColumn("f", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))


def compare_cognate_sets(words: DataFrame, ref_a: str, ref_b: str) -> DataFrame:
    """(concept, precision, recall, f) of two cognate judgements."""
    return bcubed(words, ["concept"], ref_a, ref_b)


def cross_semantic_statistics(words: DataFrame, ref: str = "cogids", glosses: str = "morphemes", ignore_affixes: bool = True, affixes: tuple[str, ...] = ("suf", "suffix", "SUF", "SUFFIX")) -> DataFrame:
    """(concept, score), lowest first: how many other concepts the morphemes of its words are found in.

    Per doculect and cogid the number of concepts less one; the mean over a word's morphemes, then over a concept's words.
    Morphemes whose gloss contains an affix label don't count; words of affixes only are left out.
    """
    cells = F.arrays_zip(F.col(ref).alias("cogid"), F.col(glosses).alias("gloss"))
    rows = words.select("id", "doculect", "concept", F.posexplode(cells).alias("m", "c")).select("id", "doculect", "concept", F.col("c.cogid").alias("cogid"), F.col("c.gloss").alias("gloss"))
    if ignore_affixes:
        hit: Column = F.lit(False)
        for a in affixes:
            hit = hit | F.col("gloss").contains(a)
        rows = rows.where(~F.coalesce(hit, F.lit(False)))
    spread = rows.groupBy("doculect", "cogid").agg((F.count_distinct("concept") - 1).alias("others"))
    per_word = rows.join(spread, ["doculect", "cogid"]).groupBy("concept", "id").agg(F.avg("others").alias("score"))
    return per_word.groupBy("concept").agg(F.avg("score").alias("score")).orderBy("score", "concept")


def regularity(clustered: DataFrame, threshold: int = 3, word_threshold: float = 0.75, missing: str = "Ø") -> DataFrame:
    """One row: regular and irregular patterns, sites and words, with their totals and unrounded shares.

    A pattern is regular with at least `threshold` sites. A word is regular if at least word_threshold of the sites of
    its cognate set fit some regular pattern; each set counts with its doculects. Sites that fit none are left out. The
    largest cluster that fits is found once for each different pattern.
    """
    sizes = clustered.groupBy("struct", "consensus").agg(F.count("*").alias("size"))
    big = F.col("size") >= threshold
    patterns = sizes.agg(
        F.count_if(big).alias("regular_patterns"), F.count_if(~big).alias("irregular_patterns"), F.count("*").alias("patterns"),
        F.coalesce(F.sum(F.when(big, F.col("size"))), F.lit(0)).alias("regular_sites"), F.coalesce(F.sum(F.when(~big, F.col("size"))), F.lit(0)).alias("irregular_sites"), F.sum("size").alias("sites"),
    )
    best = fitting(clustered, sizes.withColumnRenamed("consensus", "pattern"), {}, {"size": "size"})
    best = clustered.select("cogid", "pos", "struct", "pattern").join(best, ["struct", "pattern"])
    sets = best.groupBy("cogid").agg(F.avg(big.cast("double")).alias("share"))
    width = clustered.select("cogid", F.posexplode("pattern").alias("lang", "x")).where(F.col("x") != missing).groupBy("cogid").agg(F.count_distinct("lang").alias("refs"))
    good = F.col("share") >= word_threshold
    words = sets.join(width, "cogid").agg(
        F.coalesce(F.sum(F.when(good, F.col("refs"))), F.lit(0)).alias("regular_words"), F.coalesce(F.sum(F.when(~good, F.col("refs"))), F.lit(0)).alias("irregular_words"), F.sum("refs").alias("words")
    )
    out = patterns.join(words)
    for kind in ("patterns", "sites", "words"):
        out = out.withColumn(f"{kind}_share", F.try_divide(F.col(f"regular_{kind}").cast("double"), F.col(kind)))
    return out


def coverage(words: DataFrame) -> DataFrame:
    """(doculect, concepts): concepts with a word."""
    return words.groupBy("doculect").agg(F.count_distinct("concept").alias("concepts"))


def alphabet(words: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, doculect, sounds): different sounds."""
    return words.select(*keys, "doculect", F.explode("tokens").alias("s")).groupBy(*keys, "doculect").agg(F.count_distinct("s").alias("sounds"))


def structure_summary(clustered: DataFrame) -> DataFrame:
    """(struct, regular, singletons): clusters of several sites and of one, per structure."""
    sizes = clustered.groupBy("struct", "consensus").agg(F.count("*").alias("size"))
    return sizes.groupBy("struct").agg(F.count_if(F.col("size") > 1).alias("regular"), F.count_if(F.col("size") == 1).alias("singletons"))


def dataset_summary(clustered: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row (or one for each value of keys): sites, patterns, singletons, and the share of sites that aren't singletons."""
    sizes = clustered.groupBy(*keys, "struct", "consensus").agg(F.count("*").alias("size"))
    return sizes.groupBy(*keys).agg(F.sum("size").alias("sites"), F.count("*").alias("patterns"), F.count_if(F.col("size") == 1).alias("singletons")).withColumn("coverage", (F.col("sites") - F.col("singletons")) / F.col("sites"))


def hit_rate(predicted: DataFrame, gold: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, doculect, accuracy, words) from predicted (keys, cogid, doculect, word) and gold (cogid, doculect, alignment).

    A position whose k-th alternative is right scores 1/k; the mean over positions, then over words.
    """
    both = predicted.join(gold, ["cogid", "doculect"])
    cells = both.select(*keys, "cogid", "doculect", F.posexplode(F.arrays_zip(F.col("word").alias("p"), F.col("alignment").alias("g"))).alias("pos", "c"))
    at = F.array_position(F.split("c.p", r"\|"), F.col("c.g"))
    words = cells.groupBy(*keys, "cogid", "doculect").agg(F.avg(F.when(at > 0, 1 / at).otherwise(0.0)).alias("score"))
    return words.groupBy(*keys, "doculect").agg(F.avg("score").alias("accuracy"), F.count("*").alias("words"))
