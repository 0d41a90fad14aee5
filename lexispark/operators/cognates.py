"""Cognate sets: partial to full, wrong assignments, colexification."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.functions.numbering import number_rows, running_total
from lexispark.functions.sequences import GAP, MISSING, second_of_slash
from lexispark.functions.storage import materialise
from lexispark.operators.components import connected_components


def concept_base(concept: Column) -> Column:
    """The gloss without brackets, up to the first , ; or /, in capitals with underscores."""
    plain = F.regexp_replace(concept, r"\s*[(\[{][^)\]}]*[)\]}]", "")
    return F.replace(F.upper(F.trim(F.split(plain, "[,;/]")[0])), F.lit(" "), F.lit("_"))


def common_morpheme_cognates(words: DataFrame, cognates: str = "cogids", ref: str = "autoid", glosses: str = "automorphemes") -> DataFrame:
    """The words with full cognate ids from partial ones, and glosses.

    Per concept (alphabetically) the partial cogids are ranked by their number of morphemes, ties by first place; a
    word gets the id of its best-ranked one. Every cogid of every concept uses up an id. The morpheme that decides has
    the concept's base as its gloss, the others the same in small letters after _.
    """
    long = words.select("id", "concept", F.posexplode(cognates).alias("m", "cogid"))
    counts = long.groupBy("concept", "cogid").agg(F.count("*").alias("n"), F.min(F.struct("id", "m")).alias("first"))
    counts = counts.withColumn("rank", F.row_number().over(Window.partitionBy("concept").orderBy(F.desc("n"), "first")))
    sizes = counts.groupBy("concept").agg(F.count("*").alias("size"))
    before = running_total(sizes, ["concept"], "size", "before")
    best = long.join(counts.select("concept", "cogid", "rank"), ["concept", "cogid"]).groupBy("id", "concept").agg(F.min("rank").alias("rank"), F.min_by("m", F.struct("rank", "m")).alias("m"))
    best = best.join(before.select("concept", "before"), "concept").select("id", (F.col("before") + F.col("rank")).alias(ref), "m")
    gloss = F.transform(cognates, lambda c, i: F.when(i == F.col("m"), concept_base(F.col("concept"))).otherwise(F.concat(F.lit("_"), F.lower(concept_base(F.col("concept"))))))
    return words.join(best, "id", "left").withColumn(glosses, gloss).drop("m")


def salient_cognates(words: DataFrame, cognates: str = "cogids", morphemes: str = "morphemes", ref: str = "newcogid") -> DataFrame:
    """The words numbered by their cogids whose gloss doesn't start with _; numbers in the order of first words."""
    pairs = F.filter(F.arrays_zip(F.col(cognates).alias("c"), F.col(morphemes).alias("g")), lambda z: ~z["g"].startswith("_"))
    keyed = words.withColumn("salient", F.transform(pairs, lambda z: z["c"]))
    first = number_rows(keyed.groupBy("salient").agg(F.min("id").alias("first")), ["first"], ref)
    return keyed.join(first.select("salient", ref), "salient").drop("salient")


def bad_internal_alignments(morphemes: DataFrame) -> DataFrame:
    """The morphemes with a cogid of their own where a doculect has several alignments in one cognate set.

    Its most frequent alignment stays (ties: the first word's); each other word gets a new id, counted up from the
    largest in the order of (cogid, id).
    """
    kinds = morphemes.groupBy("cogid", "doculect", "alignment").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    best = kinds.groupBy("cogid", "doculect").agg(F.max_by("alignment", F.struct("n", -F.col("first"))).alias("best"), F.count("*").alias("kinds")).where("kinds > 1")
    wrong = morphemes.join(best, ["cogid", "doculect"]).where("alignment <> best").select("cogid", "id", "m_idx")
    top = morphemes.agg(F.max("cogid").alias("top"))
    new = number_rows(wrong, ["cogid", "id", "m_idx"], "step").join(F.broadcast(top)).select("cogid", "id", "m_idx", (F.col("top") + F.col("step")).alias("new_cogid"))
    out = morphemes.join(new, ["cogid", "id", "m_idx"], "left").withColumn("old_cogid", F.col("cogid"))
    return out.withColumn("cogid", F.coalesce("new_cogid", "cogid")).drop("new_cogid")


def expanded(morphemes: DataFrame, langs: list[str], missing: str = MISSING) -> DataFrame:
    """(cogid, rows, refs): cleaned alignments over all doculects in order; null for a doculect without a word."""
    place = F.create_map(*[F.lit(x) for i, t in enumerate(langs) for x in (t, i)])
    first = morphemes.groupBy("cogid", F.element_at(place, F.col("doculect")).alias("lang")).agg(F.min_by("alignment", F.struct("id", "m_idx")).alias("a"))
    clean = first.withColumn("a", F.transform("a", second_of_slash))
    held = clean.groupBy("cogid").agg(F.map_from_entries(F.collect_list(F.struct("lang", "a"))).alias("held"), F.count("*").alias("refs"), F.max(F.size("a")).alias("width"))
    rows = F.transform(F.sequence(F.lit(0), F.lit(len(langs) - 1)), lambda i: F.coalesce(F.element_at("held", i), F.array_repeat(F.lit(missing), F.col("width"))))
    return held.select("cogid", rows.alias("rows"), "refs")


def shared_words(a: list[list[str]], b: list[list[str]], missing: str = MISSING, gap: str = GAP) -> int:
    """In how many doculects two expanded alignments have the same sounds; -1 if any that both attest differ."""
    same = 0
    for x, y in zip(a, b):
        if missing in x or missing in y:
            if x[0] != missing and y[0] != missing:
                return -1
            continue
        if [s for s in x if s != gap] != [s for s in y if s != gap]:
            return -1
        same += 1
    return same


def merged(a: list[list[str]], b: list[list[str]], missing: str = MISSING, gap: str = GAP) -> list[list[str]]:
    """Two expanded alignments without conflict as one: columns side by side where either has a gap of its own.

    Of columns left over on one side at the end only the first is kept.
    """
    absent = [all(s == missing for s in x) and all(s == missing for s in y) for x, y in zip(a, b)]
    left, right = list(zip(*a)), list(zip(*b))

    def alone(column: tuple) -> list[str]:
        return [gap if s == missing and not gone else s for s, gone in zip(column, absent)]

    out, i, j = [], 0, 0
    while i < len(left) and j < len(right):
        p, q = left[i], right[j]
        verdict = next((("left" if x == gap and y != missing else "right") for x, y in zip(p, q) if x != y and ((x == gap and y != missing) or (y == gap and x != missing))), "both")
        if verdict == "left":
            out.append(alone(p))
            i += 1
        elif verdict == "right":
            out.append(alone(q))
            j += 1
        else:
            out.append([y if x == missing else x for x, y in zip(p, q)])
            i, j = i + 1, j + 1
    if i < len(left):
        out.append(alone(left[i]))
    elif j < len(right):
        out.append(alone(right[j]))
    return [list(r) for r in zip(*out)]


def absorbed(sets: list[list[list[str]]], missing: str = MISSING, gap: str = GAP) -> list[int]:
    """For expanded alignments in order, the place of the one that takes each in: the first that is left takes in, in order, the later
    ones that share a word with what it has become by then and differ in none.

    What may share a word is looked up by doculect and word, so a set is compared with those alone.
    """

    def words(rows: list[list[str]]) -> set[tuple]:
        return {(k, tuple(s for s in r if s != gap)) for k, r in enumerate(rows) if missing not in r}

    index: dict[tuple, list[int]] = {}
    for at, rows in enumerate(sets):
        for w in words(rows):
            index.setdefault(w, []).append(at)
    heads = [-1] * len(sets)
    for head, rows in enumerate(sets):
        if heads[head] >= 0:
            continue
        heads[head], asked, queue, waiting, at = head, set(), set(), [], head
        while True:
            for w in words(rows) - asked:
                asked.add(w)
                for other in index[w] if w in index else ():
                    if other > at and heads[other] < 0 and other not in queue:
                        queue.add(other)
                        heapq.heappush(waiting, other)
            grown = False
            while waiting and not grown:
                at = heapq.heappop(waiting)
                if shared_words(rows, sets[at], missing, gap) >= 1:
                    rows, heads[at], grown = merged(rows, sets[at], missing, gap), head, True
            if not grown:
                break
    return heads


def colexified(morphemes: DataFrame, langs: list[str], ref: str = "crossid", missing: str = MISSING) -> DataFrame:
    """The morphemes with a column for the cognate set that takes theirs in across meanings.

    Sets are tried from the one in most doculects down (ties by cogid): each takes in the later ones that share a word
    with it, and differ in none, and grows by them. Only sets that a chain of equal words of a doculect connects
    can come together, so each such component is worked on by itself; sets with equal alignments in all doculects stand there
    once, with their smallest cogid, and go where that one goes.
    """
    word = F.array_join(F.filter(F.transform("alignment", second_of_slash), lambda x: x != GAP), " ")
    keyed = morphemes.select("cogid", "doculect", word.alias("word")).distinct()
    low = keyed.groupBy("doculect", "word").agg(F.min("cogid").alias("low"))
    parts = connected_components(keyed.join(low, ["doculect", "word"]), "cogid", "low")
    sets = expanded(morphemes.join(parts.select(F.col("node").alias("cogid")), "cogid", "left_semi"), langs, missing)
    sets = materialise(sets.join(parts.withColumnRenamed("node", "cogid"), "cogid"))
    kinds = materialise(sets.groupBy("component", "rows").agg(F.min("cogid").alias("cogid"), F.max("refs").alias("refs")))

    def absorb(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["refs", "cogid"], ascending=[False, True])
        ids = frame["cogid"].tolist()
        heads = absorbed([[list(r) for r in rows] for rows in frame["rows"]], missing)
        return pd.DataFrame({"cogid": ids, "taken": [ids[h] for h in heads]})

    heads = materialise(kinds.groupBy("component").applyInPandas(absorb, "cogid long, taken long"))
    heads = kinds.withColumnRenamed("cogid", "kind").join(heads.withColumnRenamed("cogid", "kind"), "kind")
    found = sets.select("cogid", "component", "rows").join(heads.select("component", "rows", "taken"), ["component", "rows"]).select("cogid", "taken")
    return morphemes.join(found, "cogid", "left").withColumn(ref, F.coalesce("taken", "cogid")).drop("taken")
