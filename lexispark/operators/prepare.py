"""Preparing wordlists: structures, selection of cognate sets, templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.functions.phonology import sound_class
from lexispark.functions.phonology import structure as structure_of
from lexispark.functions.sequences import GAP, align_to_template, is_subsequence, shrink
from lexispark.operators.sites import alignments
from lexispark.sources.wordlists import morphemes as morphemes_of

TEMPLATE = "CCCCVVccccT_CCCCVVccccT_CCCCVVccccT_CCCCVVccccT_CCCCvvT"


def add_structure(morphemes: DataFrame, model: str = "cv", gap: str = GAP) -> DataFrame:
    """The morphemes with a column structure (see phonology.structure).

    nogap needs alignments: c in columns where the most frequent entry is a sound, gap in others (ties: the sound), for
    the sounds of aligned words; the other words have c everywhere and keep +.
    """
    if model != "nogap":
        return morphemes.withColumn("structure", structure_of(F.col("tokens"), model))
    rows = alignments(morphemes).select("cogid", F.posexplode("alignment").alias("pos", "x"))
    kinds = rows.groupBy("cogid", "pos", "x").count().groupBy("cogid", "pos").agg(F.max_by("x", F.struct("count", F.col("x") != gap, "x")).alias("x"))
    classes = kinds.groupBy("cogid").agg(F.map_from_entries(F.collect_list(F.struct("pos", F.when(F.col("x") == gap, gap).otherwise("c").alias("c")))).alias("classes"))
    out = morphemes.join(classes, "cogid", "left")
    laid = F.transform("alignment", lambda x, i: F.when(x != gap, F.element_at("classes", i)))
    plain = F.transform("tokens", lambda t: F.when(t == "+", t).otherwise("c"))
    return out.withColumn("structure", F.when(F.col("classes").isNull(), plain).otherwise(F.filter(laid, lambda c: c.isNotNull()))).drop("classes")


def prep_wordlist(words: DataFrame, min_refs: int = 3, exclude: str = "_+") -> DataFrame:
    """The first word (by id) per cogid and doculect, of cogids in at least min_refs doculects, without marks in tokens."""
    first = words.groupBy("cogid", "doculect").agg(F.min("id").alias("id"))
    enough = first.groupBy("cogid").agg(F.count("*").alias("n")).where(F.col("n") >= min_refs).select("cogid")
    kept = first.join(enough, "cogid").select("id")
    return words.join(kept, "id", "left_semi").withColumn("tokens", F.filter("tokens", lambda t: ~t.isin(*exclude)))


def skeletons(morphemes: DataFrame, gap: str = GAP) -> DataFrame:
    """(cogid, skeleton): per alignment column the class of its first sound (+ if none), as an array."""
    rows = morphemes.select("cogid", "id", F.posexplode("alignment").alias("pos", "x"))
    first = rows.groupBy("cogid", "pos").agg(F.min_by("x", F.when(F.col("x") != gap, F.col("id"))).alias("x"))
    kind = F.when(F.col("x").isNull(), "+").otherwise(sound_class(F.col("x")))
    columns = first.groupBy("cogid").agg(F.array_sort(F.collect_list(F.struct("pos", kind.alias("c")))).alias("s"))
    return columns.select("cogid", F.transform("s", lambda s: s["c"]).alias("skeleton"))


def has_skeleton(skeleton: Column, wanted: tuple[str, ...] = ("CV", "VC")) -> Column:
    found = F.lit(False)
    for s in wanted:
        found = found | is_subsequence(F.array(*[F.lit(c) for c in s]), skeleton)
    return found


def prep_alignments(morphemes: DataFrame, wanted: tuple[str, ...] = ("CV", "VC")) -> DataFrame:
    """Words of aligned cognate sets (two words or more) whose skeleton holds one of those wanted, with structure."""
    many = morphemes.groupBy("cogid").agg(F.count("*").alias("n")).where("n > 1").select("cogid")
    rows = morphemes.join(many, "cogid")
    good = skeletons(rows).where(has_skeleton(F.col("skeleton"), wanted)).select("cogid")
    return rows.join(good, "cogid", "left_semi").withColumn("structure", F.transform("tokens", sound_class))


def shrink_template(words: DataFrame, converter: dict[str, str] | None = None) -> DataFrame:
    """The words with tokens2 and structure2: neighbouring sounds merged by the converter of classes."""
    converter = converter or {"i m": "I", "i": "I", "n c": "R", "n": "R", "c": "R"}
    made = words.withColumn("shrunk", shrink(F.col("tokens"), F.col("structure"), converter))
    return made.withColumn("tokens2", F.col("shrunk.tokens")).withColumn("structure2", F.col("shrunk.structure")).drop("shrunk")


def shrink_alignments(rows: DataFrame, keys: list[str], column: str = "alignment", gap: str = GAP) -> DataFrame:
    """The rows without the positions in which all rows of their group have a gap."""
    cells = rows.select(*keys, F.posexplode(column).alias("pos", "x")).where(F.col("x") != gap)
    used = cells.select(*keys, "pos").distinct().groupBy(*keys).agg(F.array_sort(F.collect_list("pos")).alias("used"))
    out = rows.join(used, keys, "left")
    return out.withColumn(column, F.transform(F.coalesce("used", F.expr("cast(array() as array<int>)")), lambda p: F.get(F.col(column), p))).drop("used")


def template_alignment(morphemes: DataFrame, template: str = TEMPLATE, gap: str = GAP) -> DataFrame:
    """The morphemes aligned to a template of classes, without the slots that no word of a cognate set uses."""
    placed = morphemes.withColumn("alignment", align_to_template(F.col("tokens"), F.col("structure"), template, gap))
    return shrink_alignments(placed, ["cogid"], gap=gap)


def fuzzy_template_alignment(words: DataFrame, ref: str = "cogids", template: str = TEMPLATE, gap: str = GAP) -> DataFrame:
    """The words with alignments to a template, morpheme by morpheme, put together again.

    Each morpheme is aligned in its cognate set, and a word's are joined by +. Of a cogid that a word has twice the first
    morpheme's alignment stands for both; one whose sounds the word doesn't have is ?.
    """
    placed = template_alignment(morphemes_of(words.drop("alignment"), ref), template, gap)
    asked = words.select("id", F.posexplode(ref).alias("m", "cogid")).withColumn("cogid", F.col("cogid").cast("long"))
    cells = asked.join(placed.select("id", "cogid", "alignment"), ["id", "cogid"], "left").withColumn("part", F.when(F.size("alignment") > 0, F.col("alignment")).otherwise(F.array(F.lit("?"))))
    whole = cells.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("m", "part"))).alias("parts"))
    joined = F.flatten(F.transform("parts", lambda z, i: F.when(i == 0, z["part"]).otherwise(F.concat(F.array(F.lit("+")), z["part"]))))
    return words.drop("alignment").join(whole.select("id", joined.alias("alignment")), "id", "left")


def ungap(morphemes: DataFrame, proto: str, gap: str = GAP) -> DataFrame:
    """Alignments in which columns that only the proto-language fills are joined to the sound before, with a dot.

    If the first column is such a one, nothing in the alignment is joined. Only gaps elsewhere than in the
    proto-language count.
    """
    cells = morphemes.where(F.col("doculect") != proto).select("cogid", F.posexplode("alignment").alias("pos", "x"))
    empty = cells.groupBy("cogid", "pos").agg(F.max(F.col("x") != gap).alias("used")).where("not used")
    empty = empty.groupBy("cogid").agg(F.array_sort(F.collect_list("pos")).alias("empty"))
    rows = morphemes.join(empty, "cogid", "left").withColumn("empty", F.when(~F.array_contains("empty", 0), F.col("empty")))
    blank = F.expr("cast(array() as array<string>)")

    def step(done: Column, cell: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.when(cell["x"] == gap, last).when(last == gap, cell["x"]).otherwise(F.concat(last, F.lit("."), cell["x"]))
        inner = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))
        return F.when(F.coalesce(F.array_contains("empty", cell["i"]), F.lit(False)), inner).otherwise(F.concat(done, F.array(cell["x"])))

    indexed = F.transform("alignment", lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    return rows.withColumn("alignment", F.when(F.col("empty").isNull(), F.col("alignment")).otherwise(F.aggregate(indexed, blank, step))).drop("empty")


def gap_free_pairwise(a: Column, b: Column, syllables: list[int] | None = None, gap: str = GAP) -> Column:
    """struct(a, b) of two aligned sequences in which sounds opposite a gap in b are merged, not gapped.

    At the start of the sequence or of a syllable such a sound is merged to the right (x>), elsewhere to the left (y<x).
    """
    starts = F.array(*[F.lit(int(i)) for i in syllables]) if syllables else F.expr("cast(array() as array<int>)")
    blank = F.expr("cast(array() as array<string>)")
    pairs = F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda z, i: F.struct(z["a"].alias("a"), z["b"].alias("b"), ((i == 0) | F.array_contains(starts, i)).alias("start")))
    begin = F.struct(blank.alias("a"), blank.alias("b"), F.lit(False).alias("merge"))

    def step(s: Column, z: Column) -> Column:
        last = F.concat(F.slice(s["a"], 1, F.size(s["a"]) - 1), F.array(F.concat(F.element_at(s["a"], -1), F.when(s["merge"], F.lit("")).otherwise("<"), z["a"], F.when(s["merge"] & (z["b"] == gap), ">").otherwise(""))))
        opened = F.concat(s["a"], F.array(F.when(z["b"] == gap, F.concat(z["a"], F.lit(">"))).otherwise(z["a"])))
        new = (z["b"] == gap) & z["start"]
        left = F.when(new, opened).when((z["b"] == gap) | s["merge"], last).otherwise(opened)
        right = F.when(z["b"] == gap, s["b"]).otherwise(F.concat(s["b"], F.array(z["b"])))
        return F.struct(left.alias("a"), right.alias("b"), F.when(new, True).when(z["b"] == gap, s["merge"]).otherwise(False).alias("merge"))

    return F.aggregate(pairs, begin, step, lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b")))
