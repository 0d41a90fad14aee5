"""Correspondence patterns: clustering of alignment sites, assignment, irregular sites and prediction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.functions.numbering import number_rows
from lexispark.functions.sequences import GAP, MISSING, mismatches
from lexispark.functions.storage import materialise
from lexispark.operators.cover import BLOCK, greedy_cover
from lexispark.operators.fits import fitting, sounds_of_fitting
from lexispark.operators.sites import compatible_pairs, score_patterns


def _fill_score(mode: str, width: int) -> Column:
    """score_patterns of a cluster from what _fill sums up; its patterns never conflict. -1 for a lone site."""
    ranks = F.sequence(F.lit(1), F.lit(width))
    weighed = F.aggregate(F.zip_with(F.array_sort("filled"), ranks, lambda a, b: a * b), F.lit(0).cast("long"), lambda a, x: a + x)
    cells = F.aggregate("filled", F.lit(0).cast("long"), lambda a, x: a + x)
    pairs = F.col("row_pairs") + F.aggregate("filled", F.lit(0.0), lambda a, x: a + x * (x - 1) / 2)
    score = {
        "coverage": cells / F.lit(width) / F.col("n"),
        "ranked": weighed / F.lit(width * (width + 1) // 2) / F.col("n"),
        "squared": F.col("squares") / F.lit(width * width) / F.col("n"),
        "pairs": pairs / F.col("n") / F.greatest(F.lit(1), F.size(F.filter("filled", lambda x: x > 0))) / F.lit(width),
    }[mode]
    return F.when(F.col("n") <= 1, -1.0).otherwise(score)


def _fill(missing: str) -> list[Column]:
    """Sums over the sites of a pattern that score a cluster: sites by filled column, pairs of filled cells, squared fill."""
    fill = F.size(F.filter("pattern", lambda x: x != missing)).cast("long")
    return [
        F.transform("pattern", lambda x: F.when(x != missing, F.col("n")).otherwise(F.lit(0))).alias("filled"),
        (fill * (fill - 1) / 2 * F.col("n")).alias("row_pairs"),
        (fill * fill * F.col("n")).alias("squares"),
    ]


def cluster_sites(sites: DataFrame, threshold: int = 1, mode: str = "pairs", missing: str = MISSING, gap: str = GAP, block: int = BLOCK) -> DataFrame:
    """(cogid, pos, struct, pattern, consensus): each site with the consensus of the cluster it falls into.

    Clusters never mix structures. Within a structure, patterns start sorted by (score, size) downwards, ties by the
    smallest (cogid, pos); the head takes in, in order, all that fit the consensus it has grown to; then the next head
    (greedy_cover, in blocks). Passes repeat, ties going by the order of heads, until no two clusters fit by the same threshold.
    Clusters that end with equal consensus are one. Each different pattern counts once with its number of sites, and what
    scores a cluster is summed up, so no task sees sites, members or a whole structure.
    """
    if mode not in ("ranked", "pairs", "squared", "coverage"):
        raise ValueError("mode must be ranked, pairs, squared or coverage")
    sites = materialise(sites.select("cogid", "pos", "struct", "pattern"))
    kinds = sites.groupBy("struct", "pattern").agg(F.count("*").alias("n"), F.min(F.struct("cogid", "pos")).alias("first"))
    now = materialise(kinds.select("struct", "pattern", "n", F.struct("first.cogid", "first.pos").alias("tie"), *_fill(missing)))
    of = now.select("struct", "pattern", F.col("pattern").alias("consensus"))
    before, width = now.agg(F.count("*"), F.max(F.size("pattern"))).first()
    while before:
        ranked = now.withColumns({"score": -_fill_score(mode, width), "size": -F.col("n")})
        placed, heads = greedy_cover(ranked, ["score", "size", "tie"], threshold, missing, gap, block)
        step = materialise(placed.join(heads, ["struct", "stage", "head"]).select("struct", "pattern", "consensus", F.struct("stage", "head").alias("tie")))
        filled = F.array(*[F.sum(F.get("filled", F.lit(i))) for i in range(width)]).alias("filled")
        merged = now.drop("tie").join(step, ["struct", "pattern"]).groupBy("struct", "consensus")
        now = materialise(merged.agg(F.sum("n").alias("n"), F.min("tie").alias("tie"), filled, F.sum("row_pairs").alias("row_pairs"), F.sum("squares").alias("squares")).withColumnRenamed("consensus", "pattern"))
        left = now.count()
        if left == before:
            break
        before = left
        of = materialise(of.withColumnRenamed("consensus", "was").join(step.select("struct", F.col("pattern").alias("was"), "consensus"), ["struct", "was"]).select("struct", "pattern", "consensus"))
    return sites.join(of, ["struct", "pattern"]).select("cogid", "pos", "struct", "pattern", "consensus")


def clusters(clustered: DataFrame) -> DataFrame:
    """(struct, consensus, size, first): the clusters with their number of sites and their smallest (cogid, pos)."""
    return clustered.groupBy("struct", "consensus").agg(F.count("*").alias("size"), F.min(F.struct("cogid", "pos")).alias("first"))


def sites_to_patterns(clustered: DataFrame, threshold: int = 1) -> DataFrame:
    """(cogid, pos, struct, consensus, matches): every cluster of its structure that a site matches without conflict."""
    left = clustered.select("struct", F.col("pattern").alias("l_pattern"))
    right = clustered.select("struct", F.col("consensus").alias("r_pattern"))
    pairs = compatible_pairs(left, right, threshold)
    return clustered.select("cogid", "pos", "struct", F.col("pattern").alias("l_pattern")).join(pairs, ["struct", "l_pattern"]).select("cogid", "pos", "struct", F.col("r_pattern").alias("consensus"), "matches")


def fuzziness(clustered: DataFrame, threshold: int = 1, keys: Sequence[str] = ()) -> DataFrame:
    """One row (or one for each value of keys, which must have structures of their own): clusters that a site fits (see sites_to_patterns), per site that fits any; counted pattern by pattern."""
    kinds = clustered.groupBy(*keys, "struct", "pattern").agg(F.count("*").alias("n"))
    heads = clustered.select("struct", F.col("consensus").alias("pattern")).distinct()
    held = fitting(kinds, heads, {"heads": None}, threshold=threshold)
    return held.join(kinds, ["struct", "pattern"]).groupBy(*keys).agg((F.sum(F.col("heads") * F.col("n")) / F.sum("n")).alias("fuzziness"))


def purity(clustered: DataFrame, missing: str = MISSING, keys: Sequence[str] = ()) -> DataFrame:
    """One row (or one for each value of keys, which must have structures of their own): over all clustered sites, how uniform the clusters of their neighbours in the site graph are.

    Per column sqrt(sum of squared counts of sounds) / neighbours, missing entries counted in the neighbours only; the
    mean over columns; a site without neighbours has 0. Sites of one pattern have the same neighbours but for
    themselves, so patterns are compared, with their numbers of sites, and no edge between sites is ever made.
    """
    kinds = materialise(clustered.groupBy(*keys, "struct", "pattern", "consensus").agg(F.count("*").alias("n")))
    counts = sounds_of_fitting(kinds, kinds, "n", "consensus", but_itself=True, missing=missing)
    squares = F.sum(F.when(F.col("sound") != missing, F.col("weight") * F.col("weight")).otherwise(0))
    columns = counts.groupBy("struct", "pattern", "col").agg((F.sqrt(squares) / F.sum("weight")).alias("p"))
    per = columns.groupBy("struct", "pattern").agg(F.avg("p").alias("p"))
    joined = kinds.join(per, ["struct", "pattern"], "left")
    return joined.groupBy(*keys).agg((F.sum(F.coalesce("p", F.lit(0.0)) * F.col("n")) / F.sum("n")).alias("purity"))


def irregular_patterns(clustered: DataFrame, accepted: int = 2, limit: int = 1, missing: str = MISSING) -> DataFrame:
    """(cogid, pos, struct, pattern, consensus): lone sites with the regular cluster they deviate from, or null.

    A site alone in its cluster goes to the largest cluster of at least `accepted` sites with at most `limit`
    mismatches and more than `limit` matches (structure doesn't count); ties by rank.
    """
    sizes = clusters(clustered)
    lone = clustered.join(sizes.where("size = 1").select("struct", "consensus"), ["struct", "consensus"]).select("cogid", "pos", "struct", "pattern")
    good = sizes.where(F.col("size") >= accepted).select("consensus", F.struct((-F.col("size")).alias("size"), "first", "struct").alias("rank"))
    cell = lambda df, c: df.select(c, F.posexplode(c).alias("lang", "sound")).where(~F.col("sound").isin(missing, GAP)).distinct()
    near = cell(lone.select("pattern").distinct(), "pattern").join(cell(good.select("consensus"), "consensus"), ["lang", "sound"])
    near = near.groupBy("pattern", "consensus").agg(F.count("*").alias("n")).where(F.col("n") > limit)
    near = near.where(mismatches(F.col("pattern"), F.col("consensus"), missing) <= limit)
    near = near.join(good.groupBy("consensus").agg(F.min("rank").alias("rank")), "consensus")
    best = near.groupBy("pattern").agg(F.min_by("consensus", "rank").alias("consensus"))
    return lone.join(best, "pattern", "left").select("cogid", "pos", "struct", "pattern", "consensus")


def mark_irregular(morphemes: DataFrame, irregular: DataFrame, langs: list[str], prefix: str = "!", mark_rest: bool = False, missing: str = MISSING) -> DataFrame:
    """The morphemes with marked alignments: a sound b that deviates from a regular a becomes !b/a.

    With mark_rest (as for wordlists with several cognate sets per word) the sounds of lone sites that belong to no
    regular cluster get the prefix alone.
    """
    place = F.create_map(*[F.lit(x) for i, t in enumerate(langs) for x in (t, i)])
    marks = irregular.select("cogid", F.struct("pos", "consensus").alias("mark")).groupBy("cogid").agg(F.collect_list("mark").alias("marks"))
    rows = morphemes.join(marks, "cogid", "left")
    lang = F.element_at(place, F.col("doculect"))

    def cell(sound: Column, i: Column) -> Column:
        hit = F.get(F.filter("marks", lambda m: m["pos"] == i), 0)
        a = F.get(hit["consensus"], lang)
        b = F.element_at(F.split(sound, "/"), -1)
        changed = F.when(hit["consensus"].isNull(), F.concat(F.lit(prefix), sound) if mark_rest else sound)
        changed = changed.when((a != b) & (a != missing) & (b != missing), F.concat(F.lit(prefix), b, F.lit("/"), a)).otherwise(sound)
        return F.when(F.col("marks").isNull() | hit.isNull(), sound).otherwise(changed)

    return rows.withColumn("alignment", F.transform("alignment", cell)).drop("marks")


def pattern_ids(clustered: DataFrame, langs: list[str], proto: str | None = None) -> DataFrame:
    """(struct, consensus, size, rank, pattern_id): 'rank-size/reflex of the proto-language (or first doculect)'.

    Rank 1 is the largest; ties by the smallest (cogid, pos).
    """
    at = langs.index(proto) if proto else 0
    ranked = number_rows(clusters(clustered).withColumn("down", -F.col("size")), ["down", "first", "struct"], "rank").drop("down", "first")
    return ranked.withColumn("pattern_id", F.concat(F.col("rank").cast("string"), F.lit("-"), F.col("size").cast("string"), F.lit("/"), F.get("consensus", F.lit(at))))


def add_patterns(morphemes: DataFrame, clustered: DataFrame, langs: list[str], proto: str | None = None, irregular: DataFrame | None = None) -> DataFrame:
    """The morphemes with a column patterns: for each sound of the alignment its pattern's id, or 0/n.

    With irregular (from irregular_patterns) lone sites carry the id of the regular pattern they deviate from.
    """
    ids = pattern_ids(clustered, langs, proto)
    of = clustered.select("cogid", "pos", "struct", "consensus")
    if irregular is not None:
        new = irregular.where("consensus is not null").select("cogid", "pos", F.col("consensus").alias("regular"))
        owner = ids.groupBy(F.col("consensus").alias("regular")).agg(F.min_by("pattern_id", "rank").alias("regular_id"))
        of = of.join(new.join(owner, "regular").select("cogid", "pos", "regular_id"), ["cogid", "pos"], "left")
    else:
        of = of.withColumn("regular_id", F.lit(None).cast("string"))
    named = of.join(ids.select("struct", "consensus", "pattern_id"), ["struct", "consensus"])
    named = named.groupBy("cogid").agg(F.map_from_entries(F.collect_list(F.struct("pos", F.coalesce("regular_id", "pattern_id").alias("id")))).alias("ids"))
    rows = morphemes.join(named, "cogid", "left")
    cell = lambda s, i: F.when(s.isin("+", "_"), "+").otherwise(F.coalesce(F.element_at("ids", i), F.lit("0/n")))
    return rows.withColumn("patterns", F.transform("alignment", cell)).drop("ids")


def load_patterns(morphemes: DataFrame, langs: list[str], missing: str = MISSING) -> DataFrame:
    """(pattern_id, pattern, sites) from a column patterns: per doculect the first sound (by id) of a pattern."""
    place = F.create_map(*[F.lit(x) for i, t in enumerate(langs) for x in (t, i)])
    rows = morphemes.select("id", "m_idx", "cogid", F.element_at(place, F.col("doculect")).alias("lang"), F.posexplode(F.arrays_zip("patterns", "alignment")).alias("pos", "c"))
    rows = rows.where(~F.col("c.patterns").isin("0/n", "+")).select("id", "m_idx", "cogid", "lang", "pos", F.col("c.patterns").alias("pattern_id"), F.col("c.alignment").alias("sound"))
    first = rows.where(F.col("sound") != missing).groupBy("pattern_id", "lang").agg(F.min_by("sound", F.struct("id", "m_idx", "pos")).alias("sound"))
    held = F.map_from_entries(F.collect_list(F.struct("lang", "sound")))
    patterns = first.groupBy("pattern_id").agg(held.alias("held"))
    patterns = patterns.select("pattern_id", F.transform(F.sequence(F.lit(0), F.lit(len(langs) - 1)), lambda i: F.coalesce(F.element_at("held", i), F.lit(missing))).alias("pattern"))
    sites = rows.groupBy("pattern_id").agg(F.count_distinct("cogid", "pos").alias("sites"))
    return patterns.join(sites, "pattern_id")


def pattern_table(morphemes: DataFrame, clustered: DataFrame, langs: list[str], proto: str | None = None, irregular: DataFrame | None = None) -> DataFrame:
    """The table of patterns for reading: id, structure, frequency, proto reflex, other reflexes, sites, concepts.

    With irregular, deviating sites stand in rows of their own, with cells regular/irregular, under the id of the regular
    pattern. Sorted by structure, proto reflex and size, all descending.
    """
    at = langs.index(proto) if proto else 0
    ids = pattern_ids(clustered, langs, proto)
    of = clustered.select("cogid", "pos", "struct", "consensus").withColumn("shown", F.col("consensus"))
    if irregular is not None:
        new = irregular.where("consensus is not null").select("cogid", "pos", F.col("consensus").alias("regular"))
        of = of.join(new, ["cogid", "pos"], "left")
        cells = F.zip_with("regular", "consensus", lambda a, b: F.when((a != b) & (b != MISSING), F.concat(a, F.lit("/"), b)).otherwise(b))
        of = of.withColumn("shown", F.when(F.col("regular").isNull(), F.col("shown")).otherwise(cells))
        of = of.withColumn("consensus", F.coalesce("regular", "consensus")).drop("regular")
        ids = ids.groupBy("consensus").agg(F.min_by("pattern_id", "rank").alias("pattern_id"))
        of = of.join(ids, "consensus")
    else:
        of = of.join(ids.select("struct", "consensus", "pattern_id"), ["struct", "consensus"])
    concepts = morphemes.select("cogid", "concept").distinct()
    keys = ["pattern_id", "struct", "shown"]
    sites = of.groupBy(*keys).agg(F.count("*").alias("frequency"), F.array_sort(F.collect_list(F.struct("cogid", "pos"))).alias("sites"))
    about = of.join(concepts, "cogid").groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("concept")), " / ").alias("concepts"))
    out = sites.join(about, keys, "left").select(
        F.split("pattern_id", "/")[0].alias("id"),
        F.col("struct").alias("structure"),
        "frequency",
        *[F.get("shown", F.lit(i)).alias(langs[i]) for i in [at, *[i for i in range(len(langs)) if i != at]]],
        F.array_join(F.transform("sites", lambda s: F.concat(s["cogid"].cast("string"), F.lit(":"), s["pos"].cast("string"))), ", ").alias("cognatesets"),
        "concepts",
    )
    return out.orderBy(F.desc("structure"), F.desc(langs[at]), F.desc("frequency"), "id")


def _votes(clustered: DataFrame, missing: str = MISSING) -> DataFrame:
    """(struct, pattern, lang, sound, weight): for each missing entry of the different patterns what fitting clusters propose."""
    sizes = clusters(clustered).select("struct", F.col("consensus").alias("pattern"), "size")
    return sounds_of_fitting(clustered, sizes, "size", filled=True, missing=missing).withColumnRenamed("col", "lang")


def ranked_predictions(clustered: DataFrame, langs: list[str], missing: str = MISSING) -> DataFrame:
    """(cogid, pos, lang, sound, weight): for each missing entry of a site the sounds that fitting clusters propose.

    A cluster of the site's structure counts with its size if it matches, doesn't conflict, and fills any missing entry.
    """
    return clustered.select("cogid", "pos", "struct", "pattern").join(_votes(clustered, missing), ["struct", "pattern"]).select("cogid", "pos", "lang", "sound", "weight")


def predict_words(clustered: DataFrame, langs: list[str], samples: int = 3, missing: str = MISSING) -> DataFrame:
    """(cogid, doculect, word, purity): for each doculect a cogid lacks, per position the best sounds joined by |.

    Position purity is sqrt(sum of squared shares of the proposed sounds), 0 without any (then Ø); ties by sound.
    """
    return predict_samples(clustered, langs, {"word": samples}, missing)


def predict_samples(clustered: DataFrame, langs: list[str], samples: dict[str, int], missing: str = MISSING) -> DataFrame:
    """(cogid, doculect, words, purity): as predict_words, with a column for each number of sounds asked for.

    What is proposed depends on the pattern alone, so it is ranked once for all sites with that pattern.
    """
    entry = ["struct", "pattern", "lang"]
    share = F.col("weight") / F.sum("weight").over(Window.partitionBy(*entry))
    votes = _votes(clustered, missing).withColumn("share", share).withColumn("rank", F.row_number().over(Window.partitionBy(*entry).orderBy(F.desc("weight"), "sound")))
    best = lambda n: F.array_sort(F.collect_list(F.when(F.col("rank") <= n, F.struct("rank", "sound"))))
    cells = votes.groupBy(*entry).agg(
        F.sqrt(F.sum(F.col("share") * F.col("share"))).alias("purity"),
        *(F.array_join(F.transform(best(n), lambda s: s["sound"]), "|").alias(name) for name, n in samples.items()),
    )
    wide = clustered.select("cogid", "pos", F.posexplode("pattern").alias("lang", "sound"))
    absent = wide.groupBy("cogid", "lang").agg(F.max(F.col("sound") != missing).alias("there")).where("not there").select("cogid", "lang")
    slots = clustered.select("cogid", "pos", "struct", "pattern").join(absent, "cogid").join(cells, entry, "left")
    slots = slots.select("cogid", "lang", "pos", *(F.coalesce(n, F.lit(missing)).alias(n) for n in samples), F.coalesce("purity", F.lit(0.0)).alias("purity"))
    name = F.element_at(F.array(*[F.lit(t) for t in langs]), F.col("lang") + 1)
    words = slots.groupBy("cogid", "lang").agg(F.array_sort(F.collect_list(F.struct("pos", *samples))).alias("w"), F.avg("purity").alias("purity"))
    return words.select("cogid", name.alias("doculect"), *(F.col(f"w.{n}").alias(n) for n in samples), "purity")


def mean_site_score(sites: DataFrame, clustered: DataFrame, mode: str = "pairs", keys: Sequence[str] = ()) -> DataFrame:
    """One row (or one for each value of keys, which must have structures of their own): the mean over sites of the score of their cluster; lone sites count 0."""
    keyed = clustered.withColumn("key", F.xxhash64("struct", "consensus"))
    scores = score_patterns(keyed, ["key"], mode)
    return keyed.join(scores, "key").groupBy(*keys).agg(F.avg(F.greatest("score", F.lit(0.0))).alias("score"))
