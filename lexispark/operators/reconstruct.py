"""Reconstruction of words of a target language from aligned cognates, and its evaluation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.functions import alignment as kernels
from lexispark.functions import phonetics
from lexispark.functions.numbering import number_rows
from lexispark.functions.phonology import prosody
from lexispark.functions.sequences import GAP, MISSING, UNKNOWN, alignment_to_tokens, clean_sound, sound_edit_distance, spread_classes
from lexispark.functions.storage import materialise, small_enough, stored
from lexispark.operators.fits import coded, compared, meet
from lexispark.operators.metrics import bcubed
from lexispark.operators.prepare import ungap


def align_sets(morphemes: DataFrame, keys: list[str], tree: str = "upgma", gop: float = -1.0, extend: float = 0.5) -> DataFrame:
    """The first morpheme per group and doculect with clean tokens and an alignment computed group by group.

    A group is one cognate set: its size is the number of doculects, not of rows. Groups with equal lists of tokens
    are aligned once, by the sound classes and prosodic weights of phonetics, in the order of a guide tree (upgma or nj).
    """
    first = morphemes.groupBy(*keys, "doculect").agg(F.min_by("tokens", F.struct("id", "m_idx")).alias("tokens"), F.min("id").alias("id"))
    clean = first.withColumn("tokens", F.filter(F.transform("tokens", clean_sound), lambda t: t != GAP)).where(F.size("tokens") > 0)
    sets = clean.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("doculect", "id", "tokens"))).alias("rows"))
    sets = sets.withColumn("lists", F.transform("rows", lambda r: r["tokens"]))
    kinds = sets.select("lists").distinct()
    kinds = kinds.repartition(int(morphemes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "lists")  # few bytes, much work

    @F.pandas_udf("array<array<string>>")
    def aligned(groups: pd.Series) -> pd.Series:
        lists = [[list(r) for r in held] for held in groups]
        return pd.Series([phonetics.align_many(held, gop, extend, tree, far) for held, far in zip(lists, phonetics.far_apart(lists, gop, extend))])

    made = sets.join(kinds.withColumn("alms", aligned("lists")), "lists")
    cells = made.select(*keys, F.posexplode(F.arrays_zip("rows", "alms")).alias("i", "z"))
    return cells.select(*keys, F.col("z.rows.doculect").alias("doculect"), F.col("z.rows.id").alias("id"), F.col("z.alms").alias("alignment"))


def feature_rows(aligned: DataFrame, langs: list[str], keys: list[str], target: str | None = None, position: bool = False, startend: bool = False, prosodic: bool = False, firstlast: bool = False, missing: str = MISSING) -> DataFrame:
    """(keys, pos, row, target): per alignment column the sounds of langs in order, missing where there is none.

    Extra features follow as strings: the position; 0, 1 or 2 for first, inner and last column; the most frequent
    prosodic letter (ties: the smallest, gaps least); for each language the first and the last column's sounds.
    """
    of = F.create_map(*[F.lit(x) for i, t in enumerate(langs) for x in (t, i)])
    cells = aligned.select(*keys, "doculect", F.posexplode("alignment").alias("pos", "x")).withColumn("x", clean_sound(F.col("x")))
    held = F.map_from_entries(F.collect_list(F.when(F.element_at(of, F.col("doculect")).isNotNull(), F.struct(F.element_at(of, F.col("doculect")).alias("k"), F.col("x").alias("v")))))
    rows = cells.groupBy(*keys, "pos").agg(held.alias("held"), F.max(F.when(F.col("doculect") == (target or ""), F.col("x"))).alias("target"))
    row = F.transform(F.sequence(F.lit(0), F.lit(len(langs) - 1)), lambda i: F.coalesce(F.element_at("held", i), F.lit(missing)))
    rows = rows.select(*keys, "pos", row.alias("row"), "target")
    group, last = Window.partitionBy(*keys), F.max("pos").over(Window.partitionBy(*keys))
    sounds = F.col("row")
    extra: list[Column] = []
    if position:
        extra.append(F.array(F.col("pos").cast("string")))
    if startend:
        extra.append(F.array(F.when(F.col("pos") == 0, "0").when(F.col("pos") == last, "2").otherwise("1")))
    if prosodic:
        known = aligned.where(F.col("doculect") != (target or "")).withColumn("t", F.filter("alignment", lambda x: x != GAP))
        letters = known.withColumn("p", spread_classes(prosody(F.col("t")), F.col("alignment"))).select(*keys, F.posexplode("p").alias("pos", "p"))
        best = letters.groupBy(*keys, "pos", "p").count().groupBy(*keys, "pos").agg(F.min_by("p", F.struct(-F.col("count"), F.col("p") == GAP, "p")).alias("prosody"))
        rows = rows.join(best, [*keys, "pos"], "left")
        extra.append(F.array(F.coalesce("prosody", F.lit(GAP))))
    if firstlast:
        rows = rows.withColumn("a", F.first_value("row").over(group.orderBy("pos"))).withColumn("z", F.max_by("row", "pos").over(group))
        extra.append(F.flatten(F.zip_with("a", "z", lambda x, y: F.array(x, y))))
    return rows.select(*keys, "pos", F.concat(sounds, *extra).alias("row"), "target")


def training_rows(morphemes: DataFrame, langs: list[str], target: str, keys: list[str] | None = None, rows_of: Callable[..., DataFrame] | None = None, **features: bool) -> DataFrame:
    """feature_rows of every cognate set that has the target and another word; the target's extra columns are joined."""
    keys, rows_of = keys or ["cogid"], rows_of or feature_rows
    sets = morphemes.groupBy(*keys).agg(F.max(F.col("doculect") == target).alias("t"), F.count_distinct("doculect").alias("n")).where("t and n > 1").select(*keys)
    aligned = materialise(align_sets(morphemes.join(sets, keys, "left_semi"), keys))
    if keys != ["cogid"]:
        named = aligned.withColumn("set", F.struct(*keys)).withColumnRenamed("cogid", "real")
        aligned = ungap(named.withColumnRenamed("set", "cogid"), target).select("cogid.*", "doculect", "id", "alignment")
    else:
        aligned = ungap(aligned, target)
    return rows_of(aligned, langs, keys, target, **features)


def linked(nodes: DataFrame, keys: list[str], threshold: int = 1, missing: str = MISSING) -> DataFrame:
    """(node, other), both ways: patterns (keys, node, p) of one value of keys that share `threshold` entries (one at least), gaps too, and
    contradict each other in none. They are compared block by block as arrays (fits.meet), so what only shares an entry is no row."""
    named = nodes.select(F.array(F.lit(""), *(F.col(k).cast("string") for k in keys)).alias("struct"), F.col("p").alias("pattern"), "node")

    def work(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        number, out = {missing: 0, object(): 1}, [np.zeros((2, 0), np.int64)]  # no code stands for a gap
        b, a = coded(held["pattern"], number), coded(asked["pattern"], number)
        mine, others = asked["node"].to_numpy(np.int64), held["node"].to_numpy(np.int64)
        for rows, fits, _ in compared(a, b, max(1, threshold)) if len(a) and len(b) else ():
            i, k = np.nonzero(fits)
            out.append(np.stack([mine[rows][i], others[k]]))
        pairs = np.concatenate(out, 1)
        return pd.DataFrame(pairs[:, pairs[0] != pairs[1]].T, columns=["node", "other"])

    return meet(named, named, work, "node long, other long", missing)


class Model(NamedTuple):
    """What the classifier by patterns has learned: known (keys, row, prediction, size, consensus), the rows of the patterns that have a
    partner, and blocks (keys, names, rows, predictions, sizes), the other consensus rows, up to BLOCK of one value of keys in a row of
    the table: names are the sounds, missing first, rows and predictions numbers of names and sizes numbers, all of 32 bits.
    """

    known: DataFrame
    blocks: DataFrame | None


#: Rows of a block of questions and of one of consensus rows that a task compares; pairs of blocks of a task.
BLOCK, PAIRS = 20_000, 4
#: Patterns of which a task lists the consensus rows at once.
GROUP = 20_000
_NAMES = ["names", "rows", "predictions", "sizes"]
_BLOCKS = "names array<string>, rows binary, predictions binary, sizes binary"


def _coded_texts(texts: pa.ChunkedArray, names: list[str] | None = None, missing: str = MISSING) -> tuple[np.ndarray, list[str]]:
    """Lists of one length as rows of numbers of names, missing being 0; where names are given, -1 for any other."""
    flat = pa.chunked_array([c.flatten() for c in texts.chunks], pa.string()).combine_chunks().dictionary_encode()
    seen = flat.dictionary.to_pylist()
    names = names or [missing, *sorted(set(seen) - {missing})]
    number = {x: i for i, x in enumerate(names)}
    codes = np.array([number.get(x, -1) for x in seen], np.int64)[flat.indices.to_numpy(zero_copy_only=False)]
    return codes.reshape(len(texts), -1), names


def _texts(codes: np.ndarray, names: list[str]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1) * codes.shape[1], pa.int32()), pa.array(names, pa.string()).take(pa.array(codes.ravel())))


def _in_order(rows: np.ndarray, names: list[str]) -> np.ndarray:
    """Places of rows of numbers in the order of their names."""
    rank = np.zeros(len(names), np.int64)
    rank[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
    return np.lexsort(rank[rows].T[::-1])


def _block(rows: np.ndarray, predictions: np.ndarray, sizes: np.ndarray, names: list[str]) -> list:
    return [names, *(np.ascontiguousarray(x, np.int32).tobytes() for x in (rows, predictions, sizes))]


def _unpacked(batch: pa.RecordBatch, i: int) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(names, rows, predictions, sizes) of a block."""
    rows, predictions, sizes = (np.frombuffer(batch[c][i].as_buffer(), np.int32) for c in _NAMES[1:])
    return batch["names"][i].as_py(), rows.reshape(len(sizes), -1), predictions, sizes


def _dealt(nodes: DataFrame, keys: list[str], most: int, missing: str) -> tuple[DataFrame, int]:
    """(keys, p, fixed) and the number of groups (keys, fixed): what a consensus row has in some columns is fixed, and the group has the
    patterns that fit that. Groups are cut by the column that most patterns attest, and by further ones while they have more than `most`."""
    cells = nodes.select(*keys, F.posexplode(F.slice("p", 1, F.size("p") - 1)).alias("at", "x")).where(F.col("x") != missing)
    order = cells.groupBy(*keys, "at").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "at"))).alias("order"))
    order = small_enough(order.withColumn("order", F.transform("order", lambda z: z["at"])))
    held = nodes.select(*keys, "p").join(order, keys or None).withColumn("fixed", F.array().cast("array<struct<at:int,x:string>>"))
    level = 0
    while True:
        at = F.get("order", F.lit(level))
        x = F.get("p", at)
        sizes = materialise(held.groupBy(*keys, "fixed").agg(F.count("*").alias("n"), F.collect_set(x).alias("values")))
        large = sizes.where(F.size("values") > 0).where(F.col("n") > (most if level else 0)).select(*keys, "fixed", "values")
        if large.isEmpty():
            return held.select(*keys, "p", "fixed"), sizes.count()
        one = lambda v: F.struct(at.alias("at"), v.alias("x"))
        held = held.join(small_enough(large), [*keys, "fixed"], "left").withColumn("_x", x)
        fits = F.filter("values", lambda v: (F.col("_x") == missing) | (v == F.col("_x")) | (v == missing))
        longer = F.transform(fits, lambda v: F.concat("fixed", F.array(one(v))))
        held = held.withColumn("fixed", F.explode(F.coalesce(longer, F.array("fixed")))).drop("values", "_x")
        level += 1


def _fit_rows(nodes: DataFrame, keys: list[str], missing: str, most: int = GROUP, block: int = BLOCK) -> Model:
    """fit for patterns that have a target and link by it: two of one target are linked unless they contradict each other.

    So a maximal clique is all patterns that its consensus row holds, and rows are listed (kernels.consensus_rows) instead of sets of
    patterns. A group of patterns fixes what the row has in a column or more, so a row has its cliques of all targets in one task, which
    sends on the row, and for each pattern's row the consensus it is most often in.
    """
    held, groups = _dealt(nodes, keys, most, missing)
    kinds = "".join(f"{k} {nodes.schema[k].dataType.simpleString()}, " for k in keys)
    texts, columns = pa.list_(pa.string()), ["row", "prediction", "size", "n", "best", *_NAMES]
    types = [texts, pa.string(), pa.int32(), pa.int64(), texts, texts, pa.binary(), pa.binary(), pa.binary()]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches))
        codes, names = _coded_texts(held["p"], missing=missing)
        fixed = {z["at"]: z["x"] for z in held["fixed"][0].as_py()}
        if not set(fixed.values()) <= set(names):  # nothing is left that has it
            return
        fixed = {j: names.index(x) for j, x in fixed.items()}
        codes, targets = codes[:, :-1], codes[:, -1]
        rows, asked = np.unique(codes, axis=0, return_inverse=True)
        linked = np.zeros(len(rows), bool)
        linked[asked[kernels.with_partner(codes, targets)]] = True
        lead = [held[k][:1].combine_chunks() for k in keys]

        def batch(n: int, *values) -> pa.RecordBatch:
            filled = [v if isinstance(v, pa.Array) else pa.nulls(n, t) if v is None else pa.array(v, t) for v, t in zip(values, types)]
            return pa.record_batch([*(x.take(pa.array(np.zeros(n, np.int64))) for x in lead), *filled], [*keys, *columns])

        for found, cliques in kernels.consensus_rows(codes, targets, fixed):
            order = _in_order(found, names)
            back = np.empty_like(order)
            back[order] = np.arange(len(order))
            found, size, target = found[order], np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
            cliques = {kind: (own, back[place], members, sizes) for kind, (own, place, members, sizes) in cliques.items()}
            for kind in sorted(cliques, key=names.__getitem__):
                _, place, _, sizes = cliques[kind]
                more = sizes > size[place]
                size[place[more]], target[place[more]] = sizes[more], kind
            n, best = kernels.most_used(asked, len(rows), cliques, len(found))
            use = np.flatnonzero(n)
            to = best[use]
            yield batch(len(use), _texts(rows[use], names), [names[x] for x in target[to].tolist()], size[to], n[use], _texts(found[to], names), *[None] * 4)
            fresh, at = size > 0, kernels.places(found, rows[linked])
            at = at[at >= 0]
            at = at[fresh[at]]
            if len(at):  # rows of patterns, which predict what they are most often in
                yield batch(len(at), _texts(found[at], names), None, None, np.full(len(at), -1), *[None] * 5)
            fresh[at] = False
            fresh = np.flatnonzero(fresh)
            for low in range(0, len(fresh), block):
                some = fresh[low : low + block]
                yield batch(1, *[None] * 5, *([x] for x in _block(found[some], target[some], size[some], names)))

    schema = f"{kinds}row array<string>, prediction string, size int, n long, best array<string>, {_BLOCKS}"
    tasks = max(1, min(groups, 4 * nodes.sparkSession.sparkContext.defaultParallelism))
    found = stored(held.repartition(tasks, *keys, "fixed").groupBy(*keys, "fixed").applyInArrow(listed, schema), "consensus")
    uses = found.where("rows is null").groupBy(*keys, "row")
    best = F.min_by(F.struct("prediction", "size"), F.struct((-F.col("n")).alias("n"), "best"))
    known = uses.agg(best.alias("b"), F.max(F.col("n") < 0).alias("consensus")).select(*keys, "row", "b.prediction", "b.size", "consensus")
    return Model(materialise(known), found.where("rows is not null").select(*keys, *_NAMES))


def _fit_cliques(nodes: DataFrame, keys: list[str], threshold: int, missing: str) -> DataFrame:
    """fit for links of any kind.

    Nodes are ordered by their number of links, and each lists the cliques in which it comes first, from the patterns it is linked to,
    in a task of its own. So a pattern that fits thousands of others lists next to nothing: they come before it.
    """
    own = F.slice("p", 1, F.size("p") - 1)
    nodes = materialise(nodes.withColumn("node", F.xxhash64(*keys, "p")).withColumn("member", F.xxhash64(*keys, own)))
    both = materialise(linked(nodes, keys, threshold, missing))
    degrees = both.groupBy("node").agg(F.count("*").alias("links"))
    of = lambda n: degrees.select(F.col("node").alias(n), F.col("links").alias(f"{n}_links"))
    later = F.struct("other_links", "other") > F.struct("home_links", "home")
    beside = both.withColumnRenamed("node", "home").join(of("home"), "home").join(of("other"), "other").select("home", F.col("other").alias("node"), later.alias("later"))
    first = beside.groupBy("home").agg(F.max("later").alias("any")).where("any").select("home")
    itself = first.select("home", F.col("home").alias("node"), F.lit(None).cast("boolean").alias("later"))
    held = beside.join(first, "home", "left_semi").unionByName(itself).join(nodes, "node").select("home", *keys, "node", "member", "later", "p")
    kinds = "".join(f"{k} {nodes.schema[k].dataType.simpleString()}, " for k in keys)

    def listed(held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values("node", ignore_index=True)
        names = [missing, *sorted({x for q in held["p"] for x in q} - {missing})]
        number = {x: i for i, x in enumerate(names)}
        codes = np.array([[number[x] for x in q] for q in held["p"]])
        me, after = np.flatnonzero(held["later"].isna()), np.flatnonzero(held["later"].eq(True))
        links = kernels.links_as_bits(codes, threshold)
        bits = lambda some: sum(1 << int(i) for i in some)
        before = set(range(len(codes))) - set(after.tolist()) - set(me.tolist())
        lead, ids, out = [held[k].iloc[0] for k in keys], held["member"].tolist(), []
        for clique in kernels.cliques_with(int(me[0]), links, bits(after), bits(before)):
            whole = [names[c] for c in codes[clique].max(0).tolist()]
            out.append((*lead, whole[:-1], whole[-1], len(clique), [ids[i] for i in clique]))
        return pd.DataFrame(out, columns=[*keys, "row", "target", "size", "members"])

    found = held.groupBy("home").applyInPandas(listed, kinds + "row array<string>, target string, size int, members array<long>")
    found = stored(found.withColumn("rid", F.xxhash64(*keys, "row")), "cliques")
    votes = found.groupBy(*keys, "row", "target").agg(F.max("size").alias("size"))
    exact = votes.groupBy(*keys, "row").agg(F.min_by("target", F.struct(-F.col("size"), "target")).alias("prediction"), F.max("size").alias("size"))
    exact = materialise(exact.withColumn("rid", F.xxhash64(*keys, "row")))
    # A row may stand in several nodes, with other targets: what it is most often in counts over all of them.
    mine = nodes.select(*keys, own.alias("row"), "member")
    uses = found.select(F.explode("members").alias("member"), "rid", "size")
    uses = materialise(uses.groupBy("member", "rid").agg(F.sum("size").alias("n")))
    most = uses.groupBy("member").agg(F.max("n").alias("n"))
    best = uses.join(most, ["member", "n"]).join(exact, "rid").groupBy("member").agg(F.min_by(F.struct("prediction", "size"), "row").alias("best"))
    of_nodes = mine.distinct().join(best, "member").select(*keys, "row", "best.prediction", "best.size")
    fresh = exact.join(of_nodes.select(*keys, "row"), [*keys, "row"], "left_anti").select(*keys, "row", "prediction", "size")
    consensus = exact.select(*keys, "row").withColumn("consensus", F.lit(True))
    return of_nodes.unionByName(fresh).join(consensus, [*keys, "row"], "left").withColumn("consensus", F.coalesce("consensus", F.lit(False)))


def _learned(rows: DataFrame, keys: list[str], threshold: int = 1, missing: str = MISSING) -> Model:
    nodes = materialise(rows.where("target is not null").select(*keys, F.concat("row", F.array("target")).alias("p")).distinct())
    if threshold == 1 and nodes.where(F.element_at("p", -1) == missing).isEmpty():
        return _fit_rows(nodes, keys, missing)
    return Model(_fit_cliques(nodes, keys, threshold, missing), None)


def fit(rows: DataFrame, keys: list[str] | None = None, threshold: int = 1, missing: str = MISSING) -> DataFrame:
    """(keys, row, prediction, size, consensus): the classifier of training rows (row, target), one per value of keys.

    Different (row, target) patterns are nodes; two are linked if they share `threshold` entries and contradict in
    none. Each maximal clique makes a consensus row, which votes with its size for its target (of cliques with the same
    row and target the largest counts). A node's row predicts what the consensus it is most often in does.
    Patterns without a partner are in no clique.
    """
    keys = keys or []
    known, blocks = _learned(rows, keys, threshold, missing)
    if blocks is None:
        return known

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                names, codes, predictions, sizes = _unpacked(batch, i)
                n = len(codes)
                lead = [batch[k].take(pa.array(np.full(n, i))) for k in keys]
                values = [_texts(codes, names), pa.array(names, pa.string()).take(pa.array(predictions)), pa.array(sizes), pa.array(np.ones(n, bool))]
                yield pa.record_batch([*lead, *values], [*keys, "row", "prediction", "size", "consensus"])

    return known.unionByName(blocks.mapInArrow(unpacked, known.schema))


def _packed(rows: DataFrame, keys: list[str], block: int, missing: str) -> DataFrame:
    """Blocks, as of a Model, of consensus rows (keys, row, prediction, size)."""
    kinds = "".join(f"{k} {rows.schema[k].dataType.simpleString()}, " for k in keys)
    rows = materialise(rows.select(*keys, "row", "prediction", "size").withColumn("_all", F.lit(0)))
    parts = small_enough(rows.groupBy(*keys, "_all").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")))
    rows = rows.join(parts, [*keys, "_all"]).withColumn("part", F.pmod(F.xxhash64("row"), "parts").cast("int"))

    def pack(held: pa.Table) -> pa.Table:
        codes, names = _coded_texts(held["row"], missing=missing)
        targets = [x for x in set(held["prediction"].to_pylist()) if x not in names]
        names = [*names, *targets]
        number = {x: i for i, x in enumerate(names)}
        order = _in_order(codes, names)
        predictions = np.array([number[x] for x in held["prediction"].to_pylist()])
        values = _block(codes[order], predictions[order], held["size"].to_numpy()[order], names)
        types = [pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([*(held[k][:1] for k in keys), *(pa.array([v], t) for v, t in zip(values, types))], [*keys, *_NAMES])

    return rows.groupBy(*keys, "part").applyInArrow(pack, kinds + _BLOCKS)


def predict(rows: DataFrame, model: DataFrame | Model, keys: list[str] | None = None, model_keys: list[str] | None = None, missing: str = MISSING, unknown: str = UNKNOWN, block: int = BLOCK) -> DataFrame:
    """rows (keys, pos, row) with prediction.

    A known row gets its prediction. Otherwise, of the consensus rows that share an entry (the last feature doesn't
    open candidates), one without contradiction scores its matches plus the width, another its matches less its
    contradictions; the best with a score other than 0 decides, ties by row; with none the sound is unknown.

    The different rows that aren't known are compared with the consensus rows block by block, as arrays; a task sends on the best of its
    block for each question, so candidates never become rows.
    """
    keys, model_keys = keys or ["cogid"], model_keys or []
    model = model if isinstance(model, Model) else Model(model, None)
    ask = rows.select(*model_keys, "row").distinct()
    known = ask.join(model.known.select(*model_keys, "row", "prediction"), [*model_keys, "row"])
    new = materialise(ask.join(known.select(*model_keys, "row"), [*model_keys, "row"], "left_anti").withColumn("ask", F.xxhash64(*model_keys, "row")))
    each = [*model_keys, "_all"]
    asked = new.withColumn("_all", F.lit(0))
    parts = small_enough(asked.groupBy(*each).agg(F.ceil(F.count("*") / block).cast("int").alias("parts")))
    asked = asked.join(parts, each).groupBy(*each, F.pmod("ask", "parts").alias("part")).agg(F.collect_list(F.struct("ask", "row")).alias("asks")).drop("part")
    held = _packed(model.known.where("consensus"), model_keys, block, missing)
    held = (held if model.blocks is None else held.unionByName(model.blocks)).withColumn("_all", F.lit(0))
    pairs = held.join(asked, each).select("names", "rows", "predictions", "sizes", "asks")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                names, codes, predictions, _ = _unpacked(batch, i)
                asks = batch["asks"][i].values
                asked, _ = _coded_texts(pa.chunked_array([asks.field("row")]), names)
                score, at = kernels.best_rows(asked, codes)
                found = np.flatnonzero(at >= 0)
                ids = asks.field("ask").take(pa.array(found))
                to = at[found]
                prediction = pa.array(names, pa.string()).take(pa.array(predictions[to]))
                yield pa.record_batch([ids, pa.array(score[found], pa.int32()), _texts(codes[to], names), prediction], ["ask", "score", "other", "prediction"])

    n = small_enough(held.groupBy(*each).agg(F.count("*").alias("n"))).join(asked.groupBy(*each).agg(F.count("*").alias("m")), each).agg(F.sum(F.col("n") * F.col("m"))).first()[0]
    found = pairs.repartition(max(1, -(-(n or 0) // PAIRS))).mapInArrow(best, "ask long, score int, other array<string>, prediction string")
    found = found.groupBy("ask").agg(F.min_by("prediction", F.struct(-F.col("score"), "other")).alias("prediction"))
    table = known.unionByName(new.join(found, "ask").select(*model_keys, "row", "prediction"))
    return rows.join(table, [*model_keys, "row"], "left").withColumn("prediction", F.coalesce("prediction", F.lit(unknown)))


def words_of(predicted: DataFrame, keys: list[str] | None = None, desegment: bool = True) -> DataFrame:
    """(keys, word): the predictions of each group in order, if wanted without gaps and joined sounds."""
    keys = keys or ["cogid"]
    out = predicted.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "prediction"))).alias("w"))
    word = F.transform("w", lambda x: x["prediction"])
    return out.select(*keys, (alignment_to_tokens(word) if desegment else word).alias("word"))


class Patterns:
    """The classifier by patterns (see fit and predict). Any object with these two methods can take its place."""

    def __init__(self, threshold: int = 1) -> None:
        self.threshold = threshold

    def fit(self, rows: DataFrame, keys: list[str]) -> Model:
        return _learned(rows, keys, self.threshold)

    def predict(self, rows: DataFrame, model: Model, keys: list[str], model_keys: list[str]) -> DataFrame:
        return predict(rows, model, keys, model_keys)


class Estimator:
    """A classifier of pyspark.ml over codes of the sounds of a row, one-hot if wanted.

    `make` gives a new estimator with the columns features and label. Sounds that training hasn't seen have a code of
    their own. With keys (the splits of a fuzzy reconstruction) one model is fitted for each of their values.
    """

    def __init__(self, make: Callable[[], object], onehot: bool = True) -> None:
        self.make, self.onehot = make, onehot

    def _stages(self, width: int) -> list:
        from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler

        cells, codes = [f"x{i}" for i in range(width)], [f"c{i}" for i in range(width)]
        stages = [StringIndexer(inputCols=cells, outputCols=codes, handleInvalid="keep", stringOrderType="alphabetAsc")]
        if self.onehot:
            stages.append(OneHotEncoder(inputCols=codes, outputCols=[f"o{i}" for i in range(width)], handleInvalid="keep", dropLast=False))
            codes = [f"o{i}" for i in range(width)]
        return [*stages, VectorAssembler(inputCols=codes, outputCol="features")]

    def fit(self, rows: DataFrame, keys: list[str]) -> list[tuple]:
        from pyspark.ml import Pipeline
        from pyspark.ml.feature import StringIndexer

        rows = materialise(rows.where("target is not null"))
        out = []
        for r in rows.select(*keys, F.size("row").alias("width")).distinct().collect():
            some = rows
            for k in keys:
                some = some.where(F.col(k) == r[k])
            wide = some.select("target", *[F.col("row")[i].alias(f"x{i}") for i in range(r.width)])
            label = StringIndexer(inputCol="target", outputCol="label", stringOrderType="alphabetAsc").fit(wide)
            model = Pipeline(stages=[*self._stages(r.width), self.make()]).fit(label.transform(wide))
            out.append(({k: r[k] for k in keys}, r.width, model, label.labels))
        return out

    def predict(self, rows: DataFrame, model: list[tuple], keys: list[str], model_keys: list[str]) -> DataFrame:
        parts = []
        for values, width, fitted, labels in model:
            some = rows
            for k in model_keys:
                some = some.where(F.col(k) == values[k])
            wide = some.select(*keys, "pos", "row", *[F.col("row")[i].alias(f"x{i}") for i in range(width)])
            name = F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("prediction").cast("int") + 1)
            parts.append(fitted.transform(wide).select(*keys, "pos", "row", name.alias("prediction")))
        return reduce(DataFrame.unionByName, parts)


def reconstruct(morphemes: DataFrame, langs: list[str], target: str, classifier=None, rows_of: Callable[..., DataFrame] | None = None, **features: bool) -> DataFrame:
    """(cogid, word): words of the target for every cognate set, from the patterns of those that have one.

    classifier is an object with fit and predict (by default Patterns), rows_of a function like feature_rows that makes
    rows of alignments, for training and for what is asked.
    """
    classifier, rows_of, morphemes = classifier or Patterns(), rows_of or feature_rows, materialise(morphemes)
    model = classifier.fit(training_rows(morphemes, langs, target, rows_of=rows_of, **features), [])
    aligned = align_sets(morphemes.where(F.col("doculect") != target), ["cogid"])
    return words_of(classifier.predict(rows_of(aligned, langs, ["cogid"], **features), model, ["cogid"], []))


def one_hot(rows: DataFrame, width: int, column: str = "row") -> DataFrame:
    """The rows with onehot: per column one entry for each value seen there and one for any other."""
    rows = materialise(rows)
    seen = rows.select(F.posexplode(column).alias("col", "x")).groupBy("col").agg(F.array_sort(F.collect_set("x")).alias("values"))
    seen = seen.withColumn("codes", F.transform("values", lambda v: F.concat(F.transform("values", lambda w: (w == v).cast("int")), F.array(F.lit(0)))))
    other = F.concat(F.transform("values", lambda v: F.lit(0)), F.array(F.lit(1)))
    entry = F.struct(F.map_from_arrays("values", "codes").alias("codes"), other.alias("other"))
    book = seen.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("col", entry))).alias("book"))

    def encode(x: Column, i: Column) -> Column:
        of = F.element_at("book", i)
        return F.coalesce(F.element_at(of["codes"], x), of["other"])

    return rows.join(F.broadcast(book)).withColumn("onehot", F.flatten(F.transform(column, encode))).drop("book")


def random_splits(morphemes: DataFrame, target: str, splits: int = 10, retain: float = 0.9, seed: int = 0) -> DataFrame:
    """The morphemes with a column split: per split that share of the other doculects' words, drawn by a seeded hash, and
    the target's words of the cognate sets that are left."""
    rest = morphemes.where(F.col("doculect") != target)
    words = rest.select("id").distinct()
    n = words.count()
    each = words.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    each = number_rows(each.withColumn("draw", F.xxhash64(F.lit(seed), "split", "id")), ["split", "draw", "id"], "rank")
    drawn = each.where(F.col("rank") - F.col("split") * n <= int(retain * n + 0.5)).select("split", "id")
    kept = rest.join(drawn, "id")
    left = kept.select("split", "cogid").distinct()
    return kept.unionByName(morphemes.where(F.col("doculect") == target).join(left, "cogid"), allowMissingColumns=True)


def fuzzy_reconstruct(morphemes: DataFrame, langs: list[str], target: str, splits: int = 10, retain: float = 0.9, seed: int = 0, output: str = "percentiles", classifier=None, rows_of: Callable[..., DataFrame] | None = None, **features: bool) -> DataFrame:
    """Each split's model votes on every column. By output: percentiles: (cogid, pos, percentiles), 'sound:percent' by votes,
    joined by ¦; words: (cogid, split, word); wp: (cogid, words, percentiles), the words by split and the percentiles by place.

    All splits are fitted at once, with split as a key of every join. classifier and rows_of are as in reconstruct.
    """
    if output not in ("percentiles", "words", "wp"):
        raise ValueError("output must be percentiles, words or wp")
    classifier, rows_of, morphemes = classifier or Patterns(), rows_of or feature_rows, materialise(morphemes)
    drawn = random_splits(morphemes, target, splits, retain, seed)
    model = classifier.fit(training_rows(drawn, langs, target, ["split", "cogid"], rows_of=rows_of, **features), ["split"])
    aligned = align_sets(morphemes.where(F.col("doculect") != target), ["cogid"])
    rows = rows_of(aligned, langs, ["cogid"], **features).withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    votes = classifier.predict(rows, model, ["split", "cogid"], ["split"])
    if output == "percentiles":
        return percentiles(votes)
    votes = materialise(votes) if output == "wp" else votes
    words = words_of(votes, ["cogid", "split"], desegment=False)
    if output == "words":
        return words
    by_split = words.groupBy("cogid").agg(F.transform(F.array_sort(F.collect_list(F.struct("split", "word"))), lambda z: z["word"]).alias("words"))
    by_place = percentiles(votes).groupBy("cogid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "percentiles"))), lambda z: z["percentiles"]).alias("percentiles"))
    return by_split.join(by_place, "cogid")


def percentiles(votes: DataFrame, keys: list[str] | None = None, either: str = "¦", score: str = ":") -> DataFrame:
    """(keys, pos, percentiles) of rows (keys, pos, prediction): 'sound:percent' by votes, ties by sound."""
    keys = keys or ["cogid"]
    counts = votes.groupBy(*keys, "pos", "prediction").agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy(*keys, "pos"))
    shares = counts.withColumn("pct", F.floor(F.lit(100.0) * F.col("n") / whole + 0.5).cast("int"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "prediction", "pct")))
    return shares.groupBy(*keys, "pos").agg(F.array_join(F.transform(ordered, lambda s: F.concat(s["prediction"], F.lit(score), s["pct"].cast("string"))), either).alias("percentiles"))


def ntile(rows: DataFrame, keys: list[str], n: int = 5, gap: str = GAP, missing: str = MISSING) -> DataFrame:
    """(keys, ntile) of aligned words (keys, alignment): each position as n sounds in proportion to their counts.

    A sound of c among m attested gets round-half-up(c n / m) slots, most first (ties by sound); too few are repeated until
    there are n, or are missing if there are none at all; n are kept. No attested sound: ?. Positions with gaps in
    all slots but one are left out; one word alone is its sounds without gaps.
    """
    words = rows.groupBy(*keys).agg(F.count("*").alias("words"), F.first("alignment").alias("only"))
    cells = rows.select(*keys, F.posexplode("alignment").alias("pos", "x")).groupBy(*keys, "pos", "x").agg(F.count("*").alias("c"))
    total = F.sum(F.when(F.col("x") != missing, F.col("c"))).over(Window.partitionBy(*keys, "pos"))
    slots = cells.withColumn("m", total).withColumn("slots", F.when(F.col("x") != missing, F.floor(F.col("c") / (F.col("m") / F.lit(float(n))) + 0.5)).cast("int"))
    ordered = F.array_sort(F.collect_list(F.when(F.col("slots") > 0, F.struct((-F.col("slots")).alias("s"), "x"))))
    per = slots.groupBy(*keys, "pos").agg(ordered.alias("o"), F.max("m").alias("m"))
    filled = F.flatten(F.transform("o", lambda s: F.array_repeat(s["x"], -s["s"])))
    repeated = F.when(F.size(filled) == 0, F.array_repeat(F.lit(missing), n)).otherwise(F.slice(F.flatten(F.array_repeat(filled, n)), 1, n))
    per = per.withColumn("cell", F.when(F.col("m").isNull(), F.array(F.lit(UNKNOWN))).otherwise(repeated))
    count = lambda s: F.size(F.filter("cell", lambda y: y == s))
    per = per.withColumn("cell", F.transform(F.array_sort(F.transform("cell", lambda s, i: F.struct((-count(s)).alias("c"), i.alias("i"), s.alias("s")))), lambda z: z["s"]))
    per = per.where(F.size(F.filter("cell", lambda s: s == gap)) != F.size("cell") - 1)
    joined = per.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.array_join("cell", "|").alias("t")))), lambda z: z["t"]), " ").alias("t"))
    out = words.join(joined, keys, "left")
    return out.select(*keys, F.when(F.col("words") == 1, F.array_join(F.filter("only", lambda x: x != gap), " ")).otherwise(F.coalesce("t", F.lit(""))).alias("ntile"))


def mean_distance(pairs: DataFrame, normalized: bool = False, predicted: str = "predicted", attested: str = "attested", distance: Callable[[str, str], Column] | None = None) -> DataFrame:
    """One row: the mean distance of two words, by default the edit distance over sounds; an empty word counts as one unknown
    sound. distance takes the names of the two columns of sounds."""

    filled = pairs.select(*[F.when(F.coalesce(F.size(c), F.lit(0)) <= 0, F.array(F.lit(UNKNOWN))).otherwise(F.col(c)).alias(k) for c, k in ((predicted, "p"), (attested, "a"))])
    return filled.agg(F.avg(distance("p", "a") if distance else sound_edit_distance("p", "a", normalized)).alias("distance"))


def _by_identity(a: list[str], b: list[str]) -> tuple[list[str], list[str]]:
    left, right, _ = kernels.align(a, b, lambda s, t: 1.0 if s == t else -1.0, -1.0)
    return left, right


def bcubed_f(pairs: DataFrame, predicted: str = "predicted", attested: str = "attested", aligner: Callable[[list[str], list[str]], tuple[list[str], list[str]]] = _by_identity) -> DataFrame:
    """One row: the B-cubed F of aligned predicted and attested sounds over all pairs.

    aligner gives two words with gaps, of the same length; by default equal sounds score 1, others and gaps -1.
    """

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for x, y in zip(batch["p"], batch["a"]):
                x, y = ([UNKNOWN] if z is None or not len(z) else list(z) for z in (x, y))
                left, right = aligner(x, y)
                out += list(zip(left, right))
            yield pd.DataFrame(out, columns=["p", "a"])

    sounds = pairs.select(F.col(predicted).alias("p"), F.col(attested).alias("a")).mapInPandas(cells, "p string, a string")
    return bcubed(sounds.withColumn("all", F.lit(0)), ["all"], "p", "a").select("precision", "recall", "f")
