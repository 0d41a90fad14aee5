"""Cognates inside families, and likely borrowings across them."""

from __future__ import annotations

import random
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lexispark.functions import alignment as kernels
from lexispark.functions import phonetics
from lexispark.functions.numbering import number_rows
from lexispark.functions.sequences import sound_edit_distance
from lexispark.functions.storage import materialise, small_enough
from lexispark.operators.components import connected_components
from lexispark.operators.markov import markov_clusters

#: Parts into which the word pairs of two doculects are dealt, and random words of a doculect that one row of the generator makes.
PARTS, DRAWN = 8, 500
#: What a task gets: rows of the generator, pairs of words to align, pairs to score by correspondences, pairs of nodes.
ROWS, ALIGNED, SCORED, LINKED = 4, 4000, 1000, 100_000
_PAIR = ["family", "da", "db"]
_CELL = ["x", "p", "y", "q"]


class Mode(NamedTuple):
    """A way to align: global, or overlap with free ends; what opening a gap costs, and by how much less going on with it."""

    name: str = "global"
    gop: float = -1.0
    extend: float = 0.5


MODES = (Mode("global"), Mode("overlap"))


def _tasks(n: int, each: int) -> int:
    """Tasks for n rows. Spark joins small partitions by their bytes, but few short words can be many pairs that take long to align,
    and its number of shuffle partitions, which follows the whole input, would be too many for them."""
    return max(1, -(-n // each))


def _dealt(rows: DataFrame, each: int) -> DataFrame:
    """The rows, written down and dealt out evenly, about `each` a task."""
    held = materialise(rows)
    return held.repartition(_tasks(held.count(), each))


def _distances(pairs: DataFrame, mode: Mode = Mode()) -> DataFrame:
    """pairs (…, a, b) with far: the alignment distance of two sound sequences."""

    @F.pandas_udf("double")
    def far(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(phonetics.distances([list(x) for x in a], [list(x) for x in b], mode.gop, mode.extend, mode.name))

    return pairs.withColumn("far", far("a", "b"))


def _counted(rows: DataFrame, modes: Sequence[Mode]) -> DataFrame:
    """(family, da, db, x, p, y, q, n): how often sounds in their places stand together in aligned pairs, a mean over the modes."""

    @F.pandas_udf("array<struct<x:string,p:string,y:string,q:string>>")
    def columns(a: pd.Series, b: pd.Series) -> pd.Series:
        words = [list(x) for x in a], [list(x) for x in b]
        out: list[list] = [[] for _ in words[0]]
        for m in modes:
            for k, way in enumerate(phonetics.align_pairs(*words, m.gop, m.extend, m.name, columns=True)[1]):
                out[k] += [{"x": x, "p": p, "y": y, "q": q} for (x, p), (y, q) in way]
        return pd.Series(out)

    cells = rows.select(*_PAIR, "n", F.explode(columns("a", "b")).alias("c"))
    return cells.groupBy(*_PAIR, *(F.col(f"c.{c}").alias(c) for c in _CELL)).agg((F.sum("n") / len(modes)).alias("n"))


def random_words(kinds: DataFrame, runs: int, seed: int = 0) -> DataFrame:
    """(family, doculect, run, tokens): words like those of a doculect, from a Markov chain over its sounds in their places.

    kinds are (family, doculect, tokens, n). What follows a sound in its place is drawn by how often it does in the words; each word
    has a generator of its own, seeded by seed, family, doculect and run, so reruns and other partitions give the same words.
    """

    @F.pandas_udf("array<struct<f:string,t:string,n:long>>")
    def steps(tokens: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for word, times in zip(tokens, n):
            word = list(word)
            states = ["", *(f"{p}{x}" for x, p in zip(word, phonetics.profile(word))), ""]
            out.append([{"f": x, "t": y, "n": int(times)} for x, y in zip(states, states[1:])] if word else [])
        return pd.Series(out)

    def draw(batches):
        for batch in batches:
            out = []
            for family, doculect, low, chain in zip(batch["family"], batch["doculect"], batch["low"], batch["chain"]):
                ways: dict[str, tuple[list[str], list[int]]] = {}
                for s in chain:
                    to, n = ways.setdefault(s["f"], ([], []))
                    to.append(s["t"])
                    n.append(s["n"])
                for run in range(low, min(low + DRAWN, runs)):
                    rng, word, state = random.Random(f"{seed}|{family}|{doculect}|{run}"), [], ""
                    while not word or state:
                        to, n = ways[state]
                        state = rng.choices(to, n)[0]
                        word.append(state[1:])
                    out.append((family, doculect, run, word[:-1]))
            yield pd.DataFrame(out, columns=["family", "doculect", "run", "tokens"])

    cells = kinds.select("family", "doculect", F.explode(steps("tokens", "n")).alias("s")).groupBy("family", "doculect", "s.f", "s.t").agg(F.sum("s.n").alias("n"))
    # The chain of a doculect has a row for each two of its sounds, however many words it has.
    chains = materialise(cells.groupBy("family", "doculect").agg(F.array_sort(F.collect_list(F.struct("f", "t", "n"))).alias("chain")))
    parts = chains.withColumn("low", F.explode(F.sequence(F.lit(0), F.lit(max(runs - 1, 0)), F.lit(DRAWN))))
    dealt = parts.repartition(_tasks(chains.count() * _tasks(runs, DRAWN), ROWS))
    return dealt.mapInPandas(draw, kinds.select("family", "doculect", F.lit(0).alias("run"), "tokens").schema)


def correspondences(
    pairs: DataFrame, kinds: DataFrame, runs: int = 10000, seed: int = 0, ratio: tuple[float, float] = (2.0, 1.0), smooth: float = 1.0, threshold: float = 0.7,
    vscale: float = 0.5, restricted_chars: str = "_", modes: Sequence[Mode] = MODES,
) -> DataFrame:
    """(family, da, db, x, p, y, q, weight): how much more often sounds of two doculects stand together than by chance.

    pairs (family, da, db, a, b, n) are the different word pairs of one meaning with their number, kinds (family, doculect,
    tokens, n) the different words. x and y are sounds, p and q their places in the prosodic profile, - and no place for a
    gap. Attested counts come from aligned pairs that aren't too far apart, and of each doculect with itself from its words;
    expected ones from aligning the random words (see random_words) of two doculects run by run, brought to as many pairs. Counts
    are means over the modes. The weight is the mean, by ratio, of log2((attested + smooth) / (expected + smooth)) and how
    alike the two sounds are; that of two vowels is taken times vscale. Places in restricted_chars (_ for markers, T for tones)
    have no odds, and match only each other. Each different pair of random words is aligned once, however many runs give it.
    """
    words = kinds.groupBy("family", "doculect", "tokens").agg(F.sum("n").alias("n"))
    same = words.select("family", F.col("doculect").alias("da"), F.col("doculect").alias("db"), F.col("tokens").alias("a"), F.col("tokens").alias("b"), "n")
    near = _distances(pairs.where("da <> db"), modes[0]).where(F.col("far") <= threshold).drop("far")
    held = materialise(near.select(*same.columns).unionByName(same))
    attested = _counted(held, modes).withColumnRenamed("n", "attested")
    size = held.groupBy(*_PAIR).agg(F.sum("n").alias("size"))

    drawn = materialise(random_words(words, runs, seed))
    side = lambda s: drawn.select("family", "run", F.col("doculect").alias(f"d{s}"), F.col("tokens").alias(s))
    # Of a doculect with itself, the next run's words: a word would else meet itself.
    other = side("b").withColumn("run", F.when(F.col("run") == 0, runs - 1).otherwise(F.col("run") - 1))
    met = size.select(*_PAIR).join(side("a"), ["family", "da"]).join(other, ["family", "db", "run"])
    chance = _counted(_dealt(met.groupBy(*_PAIR, "a", "b").agg(F.count("*").alias("n")), ALIGNED), modes).withColumnRenamed("n", "chance")
    cells = attested.join(chance, [*_PAIR, *_CELL], "full").join(size, _PAIR)
    expected = F.coalesce("chance", F.lit(0.0)) * F.col("size") / F.lit(float(max(runs, 1)))
    cells = cells.withColumn("odds", F.log2((F.coalesce("attested", F.lit(0.0)) + smooth) / (expected + smooth)))

    @F.pandas_udf("double")
    def alike(x: pd.Series, p: pd.Series, y: pd.Series, q: pd.Series) -> pd.Series:
        gop, price = modes[0].gop, lambda place: phonetics.WEIGHTS.get(place, 1.0)
        return pd.Series([gop * price(a[1] or b[1]) if "-" in (a[0], b[0]) else phonetics.alike(a, b) for a, b in zip(zip(x, p), zip(y, q))])

    sounds = cells.select(*_CELL).distinct().withColumn("alike", alike(*_CELL))
    a, b = ratio
    fixed = list(restricted_chars.replace("_", "+"))
    bound = F.col("p").isin(*fixed) | F.col("q").isin(*fixed) if fixed else F.lit(False)
    vowels = F.col("p").isin("X", "Y", "Z") & F.col("q").isin("X", "Y", "Z")
    weight = (a * F.col("odds") + b * F.col("alike")) / (a + b) * F.when(vowels, vscale).otherwise(1.0)
    apart = F.when((F.col("p") == F.col("q")) | (F.col("x") == "-") | (F.col("y") == "-"), F.col("alike")).otherwise(phonetics.NEVER)
    return cells.join(sounds, _CELL).select(*_PAIR, *_CELL, F.when(bound, apart).otherwise(weight).alias("weight"))


def _by_correspondences(pairs: DataFrame, kinds: DataFrame, mode: Mode, ratio: tuple[float, float], vscale: float, restricted_chars: str, **options) -> DataFrame:
    """pairs with far: 1 - 2 x score of the alignment by correspondences / what the two words score with themselves.

    Equal words have 0, whatever their scores; words that score nothing with themselves have 1. Two sounds that stand together neither
    in words nor by chance have odds of 1.
    """
    table = materialise(correspondences(pairs, kinds, ratio=ratio, vscale=vscale, restricted_chars=restricted_chars, **options))

    @F.pandas_udf("array<struct<x:string,p:string>>")
    def placed(tokens: pd.Series) -> pd.Series:
        return pd.Series([[{"x": x, "p": p} for x, p in zip(w, phonetics.profile(list(w)))] for w in map(list, tokens)])

    of_self = table.where("da = db and x = y and p = q").select("family", F.col("da").alias("doculect"), "x", "p", "weight")
    words = kinds.select("family", "doculect", "tokens").distinct()
    sounds = words.select("*", F.explode(placed("tokens")).alias("s")).select("family", "doculect", "tokens", "s.x", "s.p")
    own = sounds.join(of_self, ["family", "doculect", "x", "p"], "left")
    own = own.groupBy("family", "doculect", "tokens").agg(F.sum(F.greatest(F.coalesce("weight", F.lit(0.5)), F.lit(0.0))).alias("own"))
    for side in ("a", "b"):
        pairs = pairs.join(own.select("family", F.col("doculect").alias(f"d{side}"), F.col("tokens").alias(side), F.col("own").alias(f"own_{side}")), ["family", f"d{side}", side], "left")
    (r, d), bound = ratio, set(restricted_chars.replace("_", "+"))

    def score(rows: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        held = dict(zip(zip(zip(table["x"], table["p"]), zip(table["y"], table["q"])), table["weight"]))

        def weight(u: tuple[str, str], v: tuple[str, str]) -> float:
            if (u[1] in bound or v[1] in bound) and u[1] != v[1]:
                return phonetics.NEVER
            known = held.get((u, v))
            both = u[1] in "XYZ" and v[1] in "XYZ"
            return known if known is not None else phonetics.alike(u, v) * d / (r + d) * (vscale if both else 1.0)

        def price(u: tuple[str, str], side: int) -> float:
            known = held.get((u, ("-", "")) if side == 0 else (("-", ""), u))
            return min(known, 0.0) if known is not None else mode.gop * phonetics.WEIGHTS[u[1]]

        words = [list(x) for x in rows["a"]], [list(x) for x in rows["b"]]
        rows["score"] = phonetics.align_pairs(*words, mode.gop, mode.extend, mode.name, weight, price)[0]
        return rows

    keys = [*_PAIR, "part"]
    asked = materialise(pairs.withColumn("part", F.pmod(F.xxhash64("a", "b"), F.lit(PARTS)).cast("int")))
    known = table.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    schema = StructType([*asked.schema.fields, StructField("score", DoubleType())])
    n = _tasks(asked.count(), SCORED)
    scored = asked.repartition(n, *keys).groupBy(*keys).cogroup(known.repartition(n, *keys).groupBy(*keys)).applyInPandas(score, schema).drop("part")
    own = F.coalesce("own_a", F.lit(0.0)) + F.coalesce("own_b", F.lit(0.0))
    far = F.when(F.col("a") == F.col("b"), 0.0).when(own <= 0, 1.0).otherwise(F.least(F.greatest(1 - 2 * F.col("score") / own, F.lit(0.0)), F.lit(1.0)))
    return scored.withColumn("far", far).drop("score", "own_a", "own_b")


def _clustered(pairs: DataFrame, threshold: float, method: str) -> DataFrame:
    """(node, head): flat clusters of nodes from pairs (ka, kb, na, nb, wa, wb, far), those that are in any pair within the threshold.

    wa and wb are the words that nodes are parts of: no two parts of a word come into one cluster.
    """
    near = pairs.where(F.col("far") <= threshold)
    if method == "mcl":
        edges = near.select(F.col("ka").alias("u"), F.col("kb").alias("v"), (1 - F.col("far")).alias("weight"))
        found = markov_clusters(edges)
        return found.select("node", F.col("cluster").alias("head"))
    parts = small_enough(connected_components(near.select("ka", "kb"), "ka", "kb"))
    whose = lambda s: parts.select(F.col("node").alias(f"k{s}"), F.col("component").alias(f"c{s}"))
    inside = pairs.join(whose("a"), "ka").join(whose("b"), "kb").where("ca = cb").drop("cb")

    def cluster(rows: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(np.concatenate([rows["ka"], rows["kb"]]))
        a, b = np.searchsorted(names, rows["ka"]), np.searchsorted(names, rows["kb"])
        sizes, word = np.ones(len(names)), np.zeros(len(names), np.int64)
        sizes[a], sizes[b], word[a], word[b] = rows["na"], rows["nb"], rows["wa"], rows["wb"]
        far = np.ones((len(names), len(names)))
        far[a, b] = far[b, a] = rows["far"]
        heads = kernels.flat_clusters(far, sizes, threshold, method, word[:, None] == word[None, :])
        return pd.DataFrame({"node": names, "head": names[heads]})

    return inside.repartition(_tasks(pairs.count(), LINKED), "ca").groupBy("ca").applyInPandas(cluster, "node long, head long")


def internal_cognates(
    words: DataFrame, method: str = "lexstat", threshold: float = 0.5, ref: str | None = None, runs: int = 10000, seed: int = 0, partial: bool = False, smooth: float = 1.0,
    ratio: tuple[float, float] = (2.0, 1.0), vscale: float = 0.5, restricted_chars: str = "_", modes: Sequence[Mode] = MODES, mode: Mode = Mode(), cluster_method: str = "upgma",
) -> DataFrame:
    """The words (id, doculect, concept, family, tokens) with cognate ids, found per family and concept.

    method: sca: distance of alignments scored by sound classes and prosodic weights; edit: normalised edit distance; lexstat: alignments
    scored by the regular correspondences of each two doculects (see correspondences, whose options runs, seed, smooth,
    ratio, vscale, restricted_chars and modes are). mode is how words are aligned for their distance. What is compared are the
    different words of a doculect under a meaning, and the distance of two words is found once, under however many meanings.

    cluster_method: upgma (mean distance), single, complete, each cut at the threshold and each connected part of pairs within it by
    itself; or mcl, Markov clustering of the graph of such pairs. Equal words of a concept in a family always share an id, but for mcl.

    With partial each morpheme (tokens between +) has an id of its own, in an array. Of two words, a morpheme of one and one of
    the other are compared only if each is the other's closest (ties: the one in the same place, then the first); others count as far apart. Two morphemes of one
    word never share an id; with mcl, of those that would, all but the first get one of their own.

    Ids (autocogid; autocogids if partial) are numbered in the order of first words and never cross a concept or a family.
    """
    if method not in ("sca", "edit", "lexstat"):
        raise ValueError("method must be sca, edit or lexstat")
    if cluster_method not in ("upgma", "single", "complete", "mcl"):
        raise ValueError("cluster_method must be upgma, single, complete or mcl")
    ref = ref or ("autocogids" if partial else "autocogid")
    key = ["family", "concept", "doculect", "tokens"]
    kinds = materialise(words.groupBy(*key).agg(F.count("*").alias("n"), F.min("id").alias("word")))
    whole = F.array(F.col("tokens"))
    parts = F.transform(F.split(F.array_join("tokens", " "), r"(?:^| )[+](?: |$)"), lambda x: F.filter(F.split(x, " "), lambda t: t != ""))
    nodes = kinds.select(*key[:3], "n", "word", F.posexplode(parts if partial else whole).alias("m", "tokens"))
    nodes = materialise(number_rows(nodes, ["word", "m", "family", "concept"], "node"))
    # A word of a doculect goes by its first node, so that pairs, of which each meaning has its own, carry no sounds.
    forms = small_enough(nodes.groupBy("family", "doculect", "tokens").agg(F.min("node").alias("form")))
    met = nodes.groupBy("family", "concept").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0)).cast("long")).first()[0]
    coded = nodes.join(forms, ["family", "doculect", "tokens"]).repartition(_tasks(met, LINKED), "family", "concept")
    side = lambda s: coded.select("family", "concept", F.col("doculect").alias(f"d{s}"), F.col("form").alias(f"f{s}"), F.col("n").alias(f"n{s}"), F.col("node").alias(f"k{s}"), F.col("word").alias(f"w{s}"), F.col("m").alias(f"m{s}"))
    pairs = side("a").join(side("b"), ["family", "concept"]).where(F.struct("da", "wa") < F.struct("db", "wb"))
    spelt = lambda s: forms.select(*(["family"] if s == "a" else []), F.col("doculect").alias(f"d{s}"), F.col("tokens").alias(s), F.col("form").alias(f"f{s}"))
    different = pairs.groupBy("fa", "fb").agg(F.sum(F.col("na") * F.col("nb")).alias("n")).join(spelt("a"), "fa").join(spelt("b"), "fb")
    different = _dealt(different, ALIGNED)
    if method == "lexstat":
        far = _by_correspondences(different, nodes, mode, ratio, vscale, restricted_chars, runs=runs, seed=seed, smooth=smooth, modes=modes)
    elif method == "sca":
        far = _distances(different, mode)
    else:
        far = different.withColumn("far", sound_edit_distance("a", "b", normalized=True))
    far = small_enough(far.select("fa", "fb", "far"))
    pairs = pairs.join(far, ["fa", "fb"]).select("ka", "kb", "na", "nb", "wa", "wb", "ma", "mb", "far")
    if partial:
        best = lambda mine, other: F.row_number().over(Window.partitionBy("wa", "wb", mine).orderBy("far", F.abs(F.col("ma") - F.col("mb")), other))
        pairs = pairs.withColumn("ra", best("ka", "kb")).withColumn("rb", best("kb", "ka"))
        pairs = pairs.withColumn("far", F.when((F.col("ra") == 1) & (F.col("rb") == 1), F.col("far")).otherwise(1.0)).drop("ra", "rb")
    heads = materialise(_clustered(materialise(pairs), threshold, cluster_method))
    flat = nodes.join(heads, "node", "left").withColumn("head", F.coalesce("head", "node"))
    if partial and cluster_method == "mcl":
        first = F.row_number().over(Window.partitionBy("word", "head").orderBy("m"))
        flat = flat.withColumn("_k", first).withColumn("head", F.when(F.col("_k") == 1, F.col("head")).otherwise(-F.col("node"))).drop("_k")
    flat = materialise(flat.select("word", "m", "node", "head"))
    order = number_rows(flat.groupBy("head").agg(F.min("node").alias("first")), ["first"], "number")
    found = flat.join(order.select("head", "number"), "head").groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct("m", "number"))), lambda z: z["number"]).alias("_ids"))
    named = small_enough(kinds.select(*key, "word").join(found, "word").drop("word"))
    out = words.join(named, key)
    return out.withColumn(ref, F.col("_ids") if partial else F.col("_ids")[0]).drop("_ids")


def external_cognates(words: DataFrame, cognates: str = "autocogid", ref: str = "autoborid", threshold: float = 0.3, gop: float = -1.0, align_mode: str = "overlap", extend: float = 0.5) -> DataFrame:
    """The words with an id of likely borrowings, 0 for none.

    Within a concept, two cognate sets of different families are linked if the mean distance of their words is within
    the threshold; connected sets share an id. A set's family is that of its first word; concepts of one family are
    skipped. Ids follow the order of (concept, smallest set). align_mode is overlap (gaps at either end cost nothing) or global.

    A set's equal words are one with their number, which weighs in the mean; the distance of two words is found once, in whatever
    concepts and sets they stand.
    """
    sets = words.groupBy("concept", cognates).agg(F.min_by("family", "id").alias("set_family"))
    several = words.groupBy("concept").agg(F.count_distinct("family").alias("n")).where("n > 1").select("concept")
    rows = words.join(several, "concept", "left_semi").join(sets, ["concept", cognates])
    rows = materialise(rows.groupBy("concept", F.col(cognates).alias("c"), "set_family", "tokens").agg(F.count("*").alias("n")))
    side = lambda s: rows.select("concept", F.col("c").alias(f"c{s}"), F.col("set_family").alias(f"f{s}"), F.col("tokens").alias(s), F.col("n").alias(f"n{s}"))
    pairs = side("a").join(side("b"), "concept").where("ca < cb and fa <> fb")
    far = materialise(_distances(_dealt(pairs.select("a", "b").distinct(), ALIGNED), Mode(align_mode, gop, extend)))
    n = F.col("na") * F.col("nb")
    means = pairs.join(far, ["a", "b"]).groupBy("concept", "ca", "cb").agg((F.sum(n * F.col("far")) / F.sum(n)).alias("far")).where(F.col("far") <= threshold)
    key = lambda c: F.xxhash64("concept", c)
    edges = materialise(means.select("concept", "ca", "cb", key("ca").alias("u"), key("cb").alias("v")))
    parts = connected_components(edges, "u", "v")
    members = edges.select("concept", F.explode(F.array("ca", "cb")).alias(cognates)).distinct().withColumn("node", key(cognates)).join(parts, "node")
    numbered = number_rows(members.groupBy("component", "concept").agg(F.min(cognates).alias("low")), ["concept", "low"], ref)
    found = members.join(numbered.select("component", ref), "component").select("concept", cognates, ref)
    return words.join(found, ["concept", cognates], "left").withColumn(ref, F.coalesce(ref, F.lit(0)))
