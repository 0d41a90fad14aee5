"""Near-duplicate join on word n-grams: MinHash candidates, pruned by their posterior, verified exactly."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.functions.storage import materialise, stored
from lexispark.llm.blocks import by_group, dealt, least_labels
from lexispark.llm.textnum import mix, window_hashes, word_hashes
from lexispark.operators.components import connected_components

#: Words of a shingle, similarity, MinHash values, values of a band, values compared at a time, tolerance, rows of a tile.
WORDS, SIMILARITY, VALUES, ROWS, STEP, TOLERANCE, TILE = 5, Fraction(4, 5), 128, 4, 16, 1e-9, 512
#: Tasks among which the rows of a group are split while its tiles are told.
SALTS = 16
_A = mix(np.arange(1, VALUES + 1, dtype=np.uint64)) | np.uint64(1)
_B = mix(np.arange(1, VALUES + 1, dtype=np.uint64) << np.uint64(20))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Hashes of the different shingles, sorted. A text of fewer words is one shingle; one without words has none."""
    found = word_hashes(text)
    return np.unique(window_hashes(found, min(words, len(found)))) if len(found) else np.zeros(0, np.uint64)


def _name(grams: np.ndarray) -> bytes:
    """128 bits that name a set of shingles."""
    with np.errstate(over="ignore"):
        a = mix(mix(grams).sum(dtype=np.uint64)[None] + np.uint64(len(grams)))
        b = mix(mix(grams * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)[None] + np.uint64(len(grams)))
    return a.tobytes() + b.tobytes()


def minhash(grams: np.ndarray) -> np.ndarray:
    out = np.full(VALUES, ~np.uint64(0), np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(grams), 512):
            np.minimum(out, (grams[at : at + 512, None] * _A + _B).min(0), out=out)
    return out


@lru_cache(maxsize=64)
def fewest_matches(n: int, similarity: Fraction = SIMILARITY, tolerance: float = TOLERANCE) -> int:
    """Of n MinHash values, how many must agree for P(similarity reaches the threshold) to be at least the tolerance.

    With a uniform prior the posterior of the similarity after m agreements is Beta(m + 1, n - m + 1), and the chance
    that it is at least t is the chance of at most m successes in n + 1 trials of probability t.
    """
    t, total = float(similarity), 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, name, bands): 128 bits that name the shingle set, null for texts without words."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.arange(VALUES // ROWS, dtype=np.uint64)
        for batch in batches:
            nodes, bands = [], []
            for text in batch.column("text").to_pylist():
                grams = shingles(text)
                if not len(grams):
                    nodes.append(None)
                    bands.append(None)
                    continue
                with np.errstate(over="ignore"):
                    nodes.append(_name(grams))
                    low = minhash(grams).reshape(-1, ROWS)
                    key = number.copy()
                    for j in range(ROWS):
                        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + low[:, j])
                bands.append(key.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("mark"), pa.array(nodes, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "mark", "name", "bands"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(sketch, "doc_id long, mark long, name binary, bands array<long>")


def candidate_groups(classes: DataFrame, tile: int | None = None) -> DataFrame:
    """(leader, node, leaders, tile, tile_a, tile_b): nodes that share a band key get its smallest node as a leader.

    Two nodes with a common leader are compared in the group of their smallest common one, and in no other. A group
    in which all have the same smallest leader, not its own, has nothing to compare and is left out; so a family of
    near copies meets in one or two groups, however many bands they share. Groups are dealt into tiles as tiled() does; the
    rows of a large group lie in SALTS tasks when they learn how many tiles it has.
    """
    bands = classes.select("node", F.explode("bands").alias("key"))
    shared = bands.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("other")).where("leader <> other").select("key", "leader")
    led = bands.join(shared, "key").groupBy("node").agg(F.array_sort(F.collect_set("leader")).alias("leaders"))
    led = led.select("node", "leaders", F.explode("leaders").alias("leader"), F.col("leaders")[0].alias("lowest"))
    useful = led.groupBy("leader").agg(F.min("lowest").alias("a"), F.max("lowest").alias("b"), F.count("*").alias("n"))
    useful = useful.where("n > 1 and (a <> b or a = leader)")
    useful = useful.select("leader", F.ceil(F.col("n") / (tile or TILE)).cast("int").alias("tiles"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    led = led.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    return dealt(led.join(useful, ["leader", "salt"]), "node").select("leader", "node", "leaders", "tile", "tile_a", "tile_b")


def _overlaps(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sorted sets a[i] and b[i], all exact: pair by pair, or by products of
    incidence matrices where that is less work."""
    sizes = np.array([len(s) for s in sets])
    used = np.unique(np.concatenate([a, b]))
    pool = np.concatenate([sets[i] for i in used])
    singly = 60e-9 * np.minimum(sizes[a], sizes[b]).sum() + 4e-6 * len(a)
    jointly = 2e-10 * len(used) ** 2 * len(pool) / 2 + 2e-7 * len(pool)
    if singly <= jointly:
        out = np.empty(len(a), np.int64)
        for i, (x, y) in enumerate(zip(a, b)):
            s, t = (sets[x], sets[y]) if sizes[x] <= sizes[y] else (sets[y], sets[x])
            at = np.searchsorted(t, s)
            out[i] = (t[np.minimum(at, len(t) - 1)] == s).sum()
        return out
    _, column, n = np.unique(pool, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(used)), sizes[used])
    common = n[column] > 1
    row, column = row[common], np.unique(column[common], return_inverse=True)[1]
    total = np.zeros((len(used), len(used)), np.float32)
    for low in range(0, int(column.max(initial=-1)) + 1, 2048):
        part = (column >= low) & (column < low + 2048)
        cells = np.zeros((len(used), 2048), np.float32)
        cells[row[part], column[part] - low] = 1
        total += cells @ cells.T
    return total[np.searchsorted(used, a), np.searchsorted(used, b)].astype(np.int64)


def _owned(leader: int, leaders: list[list[int]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether this group is that of the smallest leader the two have in common."""
    lower = sorted({x for xs in leaders for x in xs if x < leader})
    if not lower:
        return np.ones(len(a), bool)
    number = {x: i for i, x in enumerate(lower)}
    cells = np.zeros((len(leaders), len(lower)), np.float32)
    for i, xs in enumerate(leaders):
        cells[i, [number[x] for x in xs if x < leader]] = 1
    return (cells @ cells.T)[a, b] == 0


def _compare(key: tuple, rows: list[tuple], similarity: Fraction, tolerance: float) -> list[tuple]:
    """(node, links, root) of the members of two tiles that have a link among them."""
    leader, tile_a, tile_b = key
    rows = list({r[0]: r for r in rows}.values())
    if len(rows) < 2:
        return []
    nodes, tiles, copies, leaders, texts = zip(*rows)
    a, b = np.triu_indices(len(rows), 1)
    tiles = np.array(tiles)
    if tile_a != tile_b:
        across = tiles[a] != tiles[b]
        a, b = a[across], b[across]
    mine = _owned(leader, [list(x) for x in leaders], a, b)
    a, b = a[mine], b[mine]
    if not len(a):
        return []
    sets = [shingles(t) for t in texts]
    low = np.stack([minhash(s) for s in sets])
    agree = np.zeros(len(a), np.int64)
    for n in range(STEP, VALUES + 1, STEP):
        for j in range(n - STEP, n):
            agree += low[a, j] == low[b, j]
        alive = agree >= fewest_matches(n, similarity, tolerance)
        a, b, agree = a[alive], b[alive], agree[alive]
    if not len(a):
        return []
    sizes = np.array([len(s) for s in sets])
    both = _overlaps(sets, a, b)
    linked = both * similarity.denominator >= (sizes[a] + sizes[b] - both) * similarity.numerator
    a, b = a[linked], b[linked]
    copies = np.array(copies, np.int64)
    links = np.bincount(a, copies[b], len(rows)) + np.bincount(b, copies[a], len(rows))
    order = np.array(sorted(range(len(rows)), key=nodes.__getitem__))
    rank = np.empty(len(rows), np.int64)
    rank[order] = np.arange(len(rows))
    roots = least_labels(len(rows), rank[a], rank[b])
    return [(nodes[i], int(links[i]), nodes[order[roots[rank[i]]]]) for i in np.flatnonzero(links)]


def near_duplicates(docs: DataFrame, similarity: Fraction = SIMILARITY, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per row of docs: doc_id, mark (a hash of its text), n_links, class_id, class_mark.

    n_links counts the other rows whose shingle sets have at least that Jaccard similarity; class_id is the smallest
    doc_id that links reach, and class_mark the mark of the row that has it (the smallest, if several do). Rows with equal shingle sets are joined as one class of copies with their number, so they
    aren't paired; classes are paired only inside tasks, which return counts and a spanning forest. A pair at the
    threshold shares no band with a chance of (1 - 0.8**4)**32, under 1e-7, and is pruned with a chance below the
    tolerance; every link is verified on whole shingle sets (64-bit hashes). Texts of one to four words are one
    shingle; null texts and texts without words link with nothing; a null doc_id is no class's id unless all are null.
    """
    made = stored(sketches(docs), "sketches")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark")).alias("one")
    classes = made.where("name is not null").groupBy("name").agg(one, F.count("*").alias("copies"), F.first("bands").alias("bands"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # written down, a number stays
    groups = candidate_groups(classes)
    wanted = classes.select("node", "copies", "one.doc_id", "one.mark")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    needed = groups.select("node").distinct().join(wanted, "node")
    texts = needed.join(texts, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.xxhash64("text"))).select("node", "copies", "text")
    rows = groups.join(texts, "node").select("leader", "tile_a", "tile_b", "node", "tile", "copies", "leaders", "text")
    found = by_group(rows, ["leader", "tile_a", "tile_b"], lambda k, r: _compare(k, r, similarity, tolerance), "node long, links long, root long")
    found = materialise(found)
    parts = connected_components(found.select("node", "root"), "node", "root")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = classes.select("node", "name", "copies", "one").join(links, "node", "left").join(parts, "node", "left")
    known = known.withColumn("component", F.coalesce("component", "node"))
    least = known.groupBy("component").agg(F.min("one").alias("least"))
    known = known.join(least, "component").select("name", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("least.doc_id").alias("class_id"), F.col("least.mark").alias("class_mark"))
    out = made.select("doc_id", "mark", "name").join(known, "name", "left")
    alone = F.col("name").isNull()
    return out.select(
        "doc_id", "mark", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, F.col("mark")).otherwise(F.col("class_mark")).alias("class_mark"),
    )


def keep_one_each(docs: DataFrame, similarity: Fraction = SIMILARITY) -> DataFrame:
    """The documents, with their columns, without those that a class keeps another one of: the row with the smallest doc_id
    (then the smallest hash of its text) stays.

    Of rows with equal id and text one stays, that with the smallest columns as JSON; near copies under one id are a class
    like any other. Null texts and texts without words are classes of their own, so of those only repeated rows go. A null
    doc_id stays if its class has no other. An empty table gives no rows.
    """
    found = near_duplicates(docs, similarity).groupBy("doc_id", "mark").agg(F.first("class_id").alias("class_id"), F.first("class_mark").alias("class_mark"), F.count("*").alias("n"))
    found = materialise(found)
    stays = F.expr("doc_id <=> class_id and mark <=> class_mark")
    drop = found.where(~stays | (F.col("n") > 1)).select(F.col("doc_id").alias("drop_id"), F.col("mark").alias("drop_mark"), stays.alias("again"))
    rows = docs.select(F.struct("*").alias("doc"), F.xxhash64("text").alias("mark"))
    rows = rows.join(drop, F.col("doc.doc_id").eqNullSafe(F.col("drop_id")) & (F.col("mark") == F.col("drop_mark")), "left")
    single = rows.where("again is null").select("doc.*")
    twice = rows.where("again").groupBy("drop_id", "mark").agg(F.min_by("doc", F.to_json("doc")).alias("doc"))
    return single.unionByName(twice.select("doc.*"))
