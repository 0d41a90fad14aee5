"""Whole analyses: patterns from words, and the leave-out experiment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.functions.storage import materialise
from lexispark.operators.clusters import cluster_sites, fuzziness, mean_site_score, predict_samples, predict_words, purity
from lexispark.operators.metrics import alphabet, dataset_summary, hit_rate
from lexispark.operators.prepare import shrink_alignments
from lexispark.operators.sites import density, get_sites, upper_bound


def correspondence_patterns(morphemes: DataFrame, langs: list[str], minrefs: int = 3, threshold: int = 1, mode: str = "pairs") -> DataFrame:
    """Sites and their clusters (cogid, pos, struct, pattern, consensus), written down once for what follows."""
    return materialise(cluster_sites(get_sites(morphemes, langs, minrefs), threshold, mode))


def prediction_report(morphemes: DataFrame, langs: list[str], minrefs: int = 3) -> DataFrame:
    """(cogid, doculect, concepts, cognates, one_best, two_best, three_best, purity, flag): predicted words for reading.

    cognates are the words of the set; flag is '?' where some sound can't be predicted.
    """
    found = correspondence_patterns(morphemes, langs, minrefs)
    names = {"one_best": 1, "two_best": 2, "three_best": 3}
    made = predict_samples(found, langs, names)
    out = made.select("cogid", "doculect", *(F.array_join(n, " ").alias(n) for n in names), "purity", F.when(F.array_contains("one_best", "Ø"), "?").otherwise("").alias("flag"))
    said = F.concat(F.col("doculect"), F.lit(" "), F.array_join("tokens", " "))
    about = morphemes.groupBy("cogid").agg(F.array_join(F.array_sort(F.collect_set("concept")), " / ").alias("concepts"), F.array_join(F.array_sort(F.collect_set(said)), ", ").alias("cognates"))
    return out.join(about, "cogid").select("cogid", "doculect", "concepts", "cognates", "one_best", "two_best", "three_best", "purity", "flag")


def _all_runs(morphemes: DataFrame, langs: list[str], ratio: float, runs: int, minrefs: int, samples: int, mode: str, seed: int, subset: float = 1.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accuracy by run and doculect, clustered sites, words with run and the mark whether they are out) of all runs at once.

    Each run has cognate sets, words and structures of its own: ids are multiplied by the number of runs and the run is
    added, structures begin with it. So no run meets another in any join, and all are one job.
    """
    each = morphemes.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    share = lambda name, part: F.pmod(F.xxhash64(F.lit(seed), *name), F.lit(1 << 30)) < int(part * (1 << 30))
    if subset < 1:
        each = each.where(share([F.lit("subset"), "run", "cogid"], subset))
    each = each.withColumn("out", share(["run", "id", "cogid"], ratio))
    each = materialise(each.withColumns({c: F.col(c) * runs + F.col("run") for c in ("id", "cogid")}))
    rest = each.where("not out")
    cells = rest.select("cogid", F.posexplode("alignment").alias("pos", "x")).groupBy("cogid", "pos").agg(F.max(F.col("x") != "-").alias("used")).where("used")
    used = cells.groupBy("cogid").agg(F.array_sort(F.collect_list("pos")).alias("used"))
    gold = each.where("out").join(used, "cogid").select("cogid", "doculect", F.transform("used", lambda p: F.get("alignment", p)).alias("alignment"))
    run = F.pmod("cogid", F.lit(runs)).cast("int")
    sites = get_sites(shrink_alignments(rest.drop("out", "run"), ["cogid"]), langs, minrefs)
    sites = sites.withColumn("struct", F.concat(run.cast("string"), F.lit(":"), "struct"))
    found = materialise(cluster_sites(sites, 1, mode).withColumn("run", run))
    rate = hit_rate(predict_words(found, langs, samples).withColumn("run", run), gold, ["run"])
    return rate.select("run", "doculect", "accuracy", "words"), found, each


def leave_out(morphemes: DataFrame, langs: list[str], ratio: float = 0.25, runs: int = 10, minrefs: int = 2, samples: int = 1, mode: str = "pairs", seed: int = 0, subset: float = 1.0) -> DataFrame:
    """(run, doculect, accuracy, words): how well words that are taken out are predicted from the rest.

    Per run a seeded hash takes that share of all words (with subset, of the words of such a share of the cognate sets). Columns that
    then hold gaps only vanish from the alignments, and from the words looked for. All runs are one job.
    """
    return _all_runs(morphemes, langs, ratio, runs, minrefs, samples, mode, seed, subset)[0]


def leave_out_summary(morphemes: DataFrame, langs: list[str], ratio: float = 0.25, runs: int = 10, minrefs: int = 2, samples: int = 1, mode: str = "pairs", seed: int = 0, subset: float = 1.0) -> DataFrame:
    """One row a run: accuracy, predictable and removed words, share of words kept, density, fuzziness, mean site score,
    purity of predictions and of the cluster graph, sounds per doculect, missing share, words per set, sites, clusters,
    share of sites in clusters of several, and clusters by their upper bound. All runs are one job."""
    rate, found, each = _all_runs(morphemes, langs, ratio, runs, minrefs, samples, mode, seed, subset)
    rest, by = each.where("not out"), ["run"]
    words = rate.groupBy("run").agg((F.sum(F.col("accuracy") * F.col("words")) / F.sum("words")).alias("accuracy"), F.sum("words").alias("predictable"))
    counts = each.groupBy("run").agg(F.count_if("out").alias("removed"), F.avg((~F.col("out")).cast("int")).alias("kept"), (F.count_if(~F.col("out")) / F.count_distinct(F.when(~F.col("out"), F.col("cogid")))).alias("words_per_set"))
    missing = found.select("run", F.explode("pattern").alias("x")).groupBy("run").agg(F.avg((F.col("x") == "Ø").cast("int")).alias("missing"))
    predicted = predict_words(found, langs, samples).groupBy(F.pmod("cogid", F.lit(runs)).cast("int").alias("run")).agg(F.avg("purity").alias("prediction_purity"))
    sounds = alphabet(rest, by).groupBy("run").agg(F.avg("sounds").alias("sounds"))
    summary = dataset_summary(found, by).select("run", "sites", F.col("patterns").alias("clusters"), F.col("coverage").alias("shared_sites"))
    scores = mean_site_score(found, found, mode, by).withColumnRenamed("score", "site_score")
    parts = [counts, words, density(rest, keys=by), fuzziness(found, keys=by), scores, predicted, purity(found, keys=by), sounds, missing, summary, upper_bound(found, keys=by)]
    row = reduce(lambda a, b: a.join(b, "run", "left"), parts)
    return row.withColumn("clusters_by_bound", F.try_divide(F.col("clusters").cast("double"), F.col("upper_bound")))
