"""Alignment sites and what can be said about them pattern by pattern, with joins and aggregates only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.functions.sequences import GAP, MISSING, mismatches, spread_classes
from lexispark.functions.storage import materialise
from lexispark.operators.fits import fitting


def _firsts(morphemes: DataFrame) -> DataFrame:
    """One morpheme per cogid and doculect (the smallest id), with refs, the number of doculects of the cogid, and words: its
    different ids, counted up to 2. The words are read once, and a cogid has a row for each doculect where its rows meet."""
    columns = [F.col(c) for c in morphemes.columns if c not in ("cogid", "doculect")]
    first = morphemes.groupBy("cogid", "doculect").agg(F.min_by(F.struct(*columns), F.struct("id", "m_idx")).alias("_row"), F.min("id").alias("_low"), F.max("id").alias("_high"))
    whole = Window.partitionBy("cogid")
    low, high = F.min("_low").over(whole), F.max("_high").over(whole)
    words = F.when(low.isNull(), 0).when(low == high, 1).otherwise(2)
    first = first.select("cogid", "doculect", "_row.*", F.count("doculect").over(whole).alias("refs"), words.alias("words"))
    return first.where("cogid is not null and doculect is not null")


def alignments(morphemes: DataFrame, least: int = 2) -> DataFrame:
    """One morpheme per cogid and doculect (the smallest id), of cogids with at least `least` words.

    Adds refs, the number of doculects of the cogid.
    """
    rows = _firsts(morphemes)
    if least > 2:
        words = morphemes.groupBy("cogid").agg(F.count_distinct("id").alias("words"))
        rows = rows.drop("words").join(words, "cogid")
    return rows.where(F.col("words") >= least).drop("words")


def reflex(sound: Column, irregular: str = "!?", missing: str = MISSING) -> Column:
    """a/b is b; otherwise a sound that starts with an irregular mark is missing."""
    parts = F.split(sound, "/")
    return F.when(F.size(parts) > 1, parts[1]).when(F.substring(sound, 1, 1).isin(*irregular), missing).otherwise(sound)


def bad_structures(morphemes: DataFrame, gap: str = GAP) -> DataFrame:
    """Morphemes whose classes are not as many as the sounds of their alignment."""
    sounds = F.size(F.filter("alignment", lambda x: x != gap))
    return morphemes.where(F.size("structure") != sounds).select("id", "m_idx", "cogid")


def cells(morphemes: DataFrame, langs: list[str], gap: str = GAP, irregular: str = "!?", missing: str = MISSING) -> DataFrame:
    """(cogid, pos, lang, id, sound, class, refs): one row per entry of each alignment; positions start at 0."""
    rows = alignments(morphemes).withColumn("lang", _place(langs))
    rows = rows.withColumn("spread", spread_classes(F.col("structure"), F.col("alignment"), gap))
    rows = rows.select("cogid", "refs", "lang", "id", F.posexplode(F.arrays_zip("alignment", "spread")).alias("pos", "cell"))
    return rows.select("cogid", "pos", "lang", "id", reflex(F.col("cell.alignment"), irregular, missing).alias("sound"), F.col("cell.spread").alias("class"), "refs")


def _place(langs: list[str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for i, t in enumerate(langs) for x in (t, i)]) if langs else F.lit(None).cast("map<string,int>"), F.col("doculect"))


def _columns(rows: DataFrame, width: int, missing: str, *more: str) -> DataFrame:
    """(cogid, pos, pattern, more): the columns of each cogid, from rows (doculect's place lang, sounds, more arrays), one per cogid and place.

    The rows of a cogid come together as whole arrays, so a group has a row for each doculect and not one for each sound.
    """
    names = ["sounds", *more]
    held = F.map_from_entries(F.collect_list(F.when(F.col("lang").isNotNull(), F.struct("lang", F.struct(*names)))))
    sets = rows.groupBy("cogid").agg(F.max(F.size("sounds")).alias("n"), held.alias("held")).where("n > 0")
    laid = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.element_at("held", i))
    sets = sets.select("cogid", "n", laid.alias("laid")).select("cogid", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pos"), *(F.col(f"laid.{n}").alias(n) for n in names))
    pattern = F.transform("sounds", lambda a: F.coalesce(F.get(a, F.col("pos")), F.lit(missing)))
    return sets.select("cogid", "pos", pattern.alias("pattern"), *(F.transform(n, lambda a: F.get(a, F.col("pos"))).alias(n) for n in more))


def get_sites(morphemes: DataFrame, langs: list[str], minrefs: int = 3, gap: str = GAP, irregular: str = "!?", missing: str = MISSING, check: bool = True) -> DataFrame:
    """(cogid, pos, struct, pattern) of cogids in at least minrefs doculects (and two words).

    struct is the class of the first doculect that has a sound there ('+' if none has). A group has at most one row
    per doculect. With check, a word whose structure doesn't fit its alignment is an error. No words give no sites.
    """
    morphemes = morphemes.select("id", "m_idx", "doculect", "cogid", "alignment", "structure")
    if check:
        fits = F.size("structure") == F.size(F.filter("alignment", lambda x: x != gap))
        wrong = F.raise_error(F.concat(F.lit("alignment and structure do not match in "), F.col("id").cast("string"))).cast("int")
        morphemes = morphemes.where(F.when(fits, F.lit(1)).otherwise(wrong) == 1)
    rows = alignments(morphemes).where(F.col("refs") >= minrefs)
    sounds = F.transform("alignment", lambda x: reflex(x, irregular, missing))
    rows = rows.select("cogid", _place(langs).alias("lang"), sounds.alias("sounds"), spread_classes(F.col("structure"), F.col("alignment"), gap).alias("classes"))
    kind = F.get(F.filter("classes", lambda c: c != gap), F.lit(0))
    return _columns(rows, len(langs), missing, "classes").select("cogid", "pos", F.coalesce(kind, F.lit("+")).alias("struct"), "pattern")


def all_sites(morphemes: DataFrame, langs: list[str], gap: str = GAP, irregular: str = "!?", missing: str = MISSING) -> DataFrame:
    """(cogid, pos, pattern) of every cogid; words that stand alone in theirs give their tokens, one site each."""
    rows = _firsts(morphemes.select("id", "m_idx", "doculect", "cogid", "tokens", "alignment"))
    sounds = F.when(F.col("words") > 1, F.transform("alignment", lambda x: reflex(x, irregular, missing))).otherwise(F.col("tokens"))
    return _columns(rows.select("cogid", _place(langs).alias("lang"), sounds.alias("sounds")), len(langs), missing)


def compatible_pairs(left: DataFrame, right: DataFrame, threshold: int = 1, missing: str = MISSING, gap: str = GAP) -> DataFrame:
    """Pairs of (l_key, struct, l_pattern) and (r_key, struct, r_pattern) with no mismatch and enough matches.

    A match needs a sound in the same doculect, so candidates come from an equi-join on (struct, doculect, sound) of
    different patterns, never from a product of all rows; each is then counted exactly.
    """

    def entries(df: DataFrame, side: str) -> DataFrame:
        one = df.select("struct", f"{side}_pattern").distinct()
        return one.select("struct", f"{side}_pattern", F.posexplode(f"{side}_pattern").alias("lang", "sound")).where(~F.col("sound").isin(missing, gap))

    found = entries(left, "l").join(entries(right, "r"), ["struct", "lang", "sound"])
    found = found.groupBy("struct", "l_pattern", "r_pattern").agg(F.count("*").alias("n")).where(F.col("n") >= threshold)
    ok = found.where(mismatches(F.col("l_pattern"), F.col("r_pattern"), missing) == 0)
    return ok.withColumnRenamed("n", "matches")


def site_graph(sites: DataFrame, missing: str = MISSING, gap: str = GAP) -> DataFrame:
    """Edges (cogid_a, pos_a, cogid_b, pos_b), each once: sites of one structure that match and don't conflict."""
    left = sites.select("struct", F.col("pattern").alias("l_pattern"))
    pairs = compatible_pairs(left, left.withColumnRenamed("l_pattern", "r_pattern"), 1, missing, gap).select("struct", "l_pattern", "r_pattern")
    a = sites.select("struct", F.col("pattern").alias("l_pattern"), F.col("cogid").alias("cogid_a"), F.col("pos").alias("pos_a"))
    b = sites.select("struct", F.col("pattern").alias("r_pattern"), F.col("cogid").alias("cogid_b"), F.col("pos").alias("pos_b"))
    both = a.join(pairs, ["struct", "l_pattern"]).join(b, ["struct", "r_pattern"])
    return both.where(F.struct("cogid_a", "pos_a") < F.struct("cogid_b", "pos_b")).select("cogid_a", "pos_a", "cogid_b", "pos_b")


def site_degrees(sites: DataFrame, missing: str = MISSING, gap: str = GAP) -> DataFrame:
    """(cogid, pos, neighbours) of the sites that have any in the site graph, counted pattern by pattern."""
    kinds = materialise(sites.groupBy("struct", "pattern").agg(F.count("*").alias("n")))
    near = fitting(kinds, kinds, {"n": "n"}, missing=missing, gap=gap)
    own = F.exists("pattern", lambda x: ~x.isin(missing, gap)).cast("long")
    near = near.select("struct", "pattern", (F.col("n") - own).alias("neighbours")).where("neighbours > 0")
    return sites.select("cogid", "pos", "struct", "pattern").join(near, ["struct", "pattern"]).select("cogid", "pos", "neighbours")


def density(words: DataFrame, ref: str = "cogid", keys: Sequence[str] = ()) -> DataFrame:
    """One row (or one for each value of keys): 1 - the mean over concepts of distinct cognate sets per word."""
    per = words.groupBy(*keys, "concept").agg((F.count_distinct(ref) / F.count("*")).alias("share"))
    return per.groupBy(*keys).agg((1 - F.avg("share")).alias("density"))


def score_patterns(rows: DataFrame, keys: list[str], mode: str = "coverage", pattern: str = "pattern", missing: str = MISSING) -> DataFrame:
    """(keys, score) of each group of patterns: how well filled they are.

    -1 for patterns that conflict and for a single pattern. coverage: mean share of filled cells; ranked: columns by
    fill, the fullest weighing most; squared: mean squared fill of the rows; pairs: filled pairs in rows and columns, per
    row, per column that has any, per column.
    """
    if mode not in ("ranked", "pairs", "squared", "coverage"):
        raise ValueError("mode must be ranked, pairs, squared or coverage")
    width = F.size(pattern)
    filled = F.size(F.filter(pattern, lambda x: x != missing))
    per_row = rows.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        F.max(width).alias("width"),
        F.avg(F.pow(filled / width, F.lit(2))).alias("squared"),
        F.sum(filled * (filled - 1) / 2).alias("row_pairs"),
        F.sum(filled).alias("cells"),
    )
    columns = rows.select(*keys, F.posexplode(pattern).alias("col", "x")).groupBy(*keys, "col").agg(
        F.count_if(F.col("x") != missing).alias("fill"), F.count_distinct(F.when(F.col("x") != missing, F.col("x"))).alias("kinds")
    )
    order = Window.partitionBy(*keys).orderBy(F.desc("fill"), "col")
    columns = columns.withColumn("rank", F.count("*").over(Window.partitionBy(*keys)) - F.row_number().over(order) + 1)
    per_col = columns.groupBy(*keys).agg(
        F.max("kinds").alias("kinds"),
        (F.sum(F.col("rank") * F.col("fill")) / F.sum("rank")).alias("ranked"),
        F.sum(F.col("fill") * (F.col("fill") - 1) / 2).alias("col_pairs"),
        F.count_if(F.col("fill") > 0).alias("covered"),
    )
    score = {
        "coverage": F.col("cells") / F.col("width") / F.col("rows"),
        "ranked": F.col("ranked") / F.col("rows"),
        "squared": F.col("squared"),
        "pairs": F.try_divide((F.col("row_pairs") + F.col("col_pairs")) / F.col("rows"), F.col("covered")) / F.col("width"),
    }[mode]
    bad = (F.col("kinds") > 1) | (F.col("rows") <= 1)
    return per_row.join(per_col, keys).select(*keys, F.when(bad, -1.0).otherwise(score).alias("score"))


def consensus(rows: DataFrame, keys: list[str], pattern: str = "pattern", missing: str = MISSING) -> DataFrame:
    """(keys, consensus, conflicts): the sound of each column that isn't missing, and the columns with several.

    conflicts holds '*' or '' for each column; with a conflict the consensus is null.
    """
    cell = F.when(F.col("x") != missing, F.col("x"))
    columns = rows.select(*keys, F.posexplode(pattern).alias("col", "x")).groupBy(*keys, "col").agg(F.max(cell).alias("sound"), F.count_distinct(cell).alias("kinds"))
    ordered = F.array_sort(F.collect_list(F.struct("col", "sound", "kinds")))
    out = columns.groupBy(*keys).agg(ordered.alias("c"))
    whole = F.transform("c", lambda c: F.coalesce(c["sound"], F.lit(missing)))
    return out.select(
        *keys,
        F.when(~F.exists("c", lambda c: c["kinds"] > 1), whole).alias("consensus"),
        F.transform("c", lambda c: F.when(c["kinds"] > 1, "*").otherwise("")).alias("conflicts"),
    )


def upper_bound(sites: DataFrame, missing: str = MISSING, keys: Sequence[str] = ()) -> DataFrame:
    """One row: the largest number of sites that conflict with a site (mismatch or other structure), among those that
    have a partner of their structure without a mismatch.

    A pattern is a partner of its own copies. With keys, each of whose values has structures of its own, a row for each.
    """
    kinds = materialise(sites.groupBy(*keys, "struct", "pattern").agg(F.count("*").alias("n")))
    fine = fitting(kinds, kinds, {"fine": "n"}, threshold=0, missing=missing).where("fine > 1")
    total = kinds.groupBy(*keys).agg(F.sum("n").alias("total"))
    both = fine.join(kinds.select(*keys, "struct").distinct(), "struct").join(total, list(keys)) if keys else fine.join(total)
    return both.groupBy(*keys).agg(F.max(F.col("total") - F.col("fine")).alias("upper_bound"))
