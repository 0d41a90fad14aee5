"""How far the words of each source lie from those of its language and of the language's other sources.

A term is a run of ASCII letters and non-ASCII characters, with A-Z lower-cased. A language keeps the terms that stand in
at least 10 of its documents. Each source of a language, and the language as a whole, gives every kept term a smoothed
share p in parts of a thousand million, and two shares p and q lie (p - q)**2 // (p + q) apart. All of it is integers.

The sum over all kept terms for all pairs of sources is the product of a sparse matrix with its transpose, row by row
(Gustavson): each source goes through its terms, and each term's row of the term-major index is scattered into a dense
accumulator with a slot for each peer, so no pair of postings ever becomes a row. A term that a source lacks still has a
share, the source's zero. So the accumulators only take what a common term adds beyond the zeros, and the rest follows
from how often each source has each count: a source has few different counts, however many terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.functions.storage import small_enough, stored

#: Documents of a language that a kept term stands in at least.
LEAST_DOCUMENTS = 10
#: Ranks of terms that are reported for a source.
TOP_TERMS = 10
#: Sources whose accumulators are held at once, postings that a task goes through for them, different counts of a source in one row.
TILE, PART, COUNTS = 256, 250_000, 20_000
#: Counts by term that a task holds before it sends them on.
HELD = 200_000
#: A-Z to a-z, all other ASCII characters that are not a-z to a space.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) as (lang, source, term, n, docs): occurrences and documents of a term, summed up in the task."""
    held: dict[tuple, dict[bytes, list[int]]] = {}

    def out() -> pa.RecordBatch:
        rows = [(lang, source, term, n, docs) for (lang, source), terms in held.items() for term, (n, docs) in terms.items()]
        columns = list(zip(*rows)) or [[]] * 5
        kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
        arrays = [pa.array(c, t) for c, t in zip(columns, kinds)]
        held.clear()
        return pa.RecordBatch.from_arrays([*arrays[:2], arrays[2].cast(pa.string()), *arrays[3:]], ["lang", "source", "term", "n", "docs"])

    size = 0
    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
            terms = held.setdefault((lang, source), {})
            before = len(terms)
            for term, n in Counter(text.translate(_FOLD).split()).items():
                entry = terms.get(term)
                if entry is None:
                    terms[term] = [n, 1]
                else:
                    entry[0] += n
                    entry[1] += 1
            size += len(terms) - before
            if size > HELD:
                yield out()
                size = 0
    yield out()


def _named(documents: DataFrame) -> DataFrame:
    return documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def term_counts(documents: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs), summed over the documents of each task; null lang, source and text read as ''."""
    read = _named(documents).withColumn("text", F.col("text").cast("binary"))
    return read.mapInArrow(_count, "lang string, source string, term string, n long, docs long")


def share(count: Column, total: Column) -> Column:
    """1 + 1000000000 * (count + 2) // total in whole numbers, three digits at a time so that nothing overflows."""
    left, found = count + 2, F.lit(0).cast("long")
    for _ in range(3):
        left = left * 1000
        found = found * 1000 + _over(left, total)
        left = left % total
    return found + 1


def apart(p: Column, q: Column) -> Column:
    return _over((p - q) * (p - q), p + q)


def _over(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    left, found = count + 2, np.zeros_like(count)
    for _ in range(3):
        left = left * 1000
        found = found * 1000 + left // total
        left = left % total
    return found + 1


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _square(lang: str, groups: np.ndarray, peers: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array([lang] * len(values), pa.string()), pa.array(groups, pa.int32()), pa.array(peers, pa.int32()), pa.array(values, pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, ["lang", "group", "peer", "value"])


def _baselines(tile: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A source's counts, each with its number of terms, against the zeros of all sources of its language.

    Rows are (lang, group, zero, total, counts, terms, zeros). A row with the count 0 alone puts all kept terms at the zeros; any
    other says what the terms of its counts add to that, to the pair from either side. Peers are gone through a tile at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, group, zero, total, counts, terms, zeros in zip(*(c.to_pylist() for c in batch.columns)):
                counts, terms, zeros = np.array(counts, np.int64), np.array(terms, np.int64), np.array(zeros, np.int64)
                shares = _share(counts, np.int64(total))
                for at in range(0, len(zeros), tile):
                    peers = zeros[at : at + tile]
                    beyond = _apart(shares[:, None], peers[None, :]) - (counts > 0)[:, None] * _apart(np.int64(zero), peers)[None, :]
                    mine, others, sums = np.full(len(peers), group), np.arange(at, at + len(peers)), (beyond * terms[:, None]).sum(0)
                    yield _square(lang, mine, others, sums)
                    if counts.any():
                        yield _square(lang, others, mine, sums)

    return run


def _scatter(tile: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The common terms of the sources of two tiles: what each adds beyond the zeros, summed for each pair of sources.

    Rows are (lang, tile_a, tile_b, part, term, group, p, zero) in this order. A block of rows of whole terms is a piece of the
    term-major index; each source of tile_a scatters its terms through it into the accumulator of its peers in tile_b.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums, held = None, None, []

        def add(rows: list[tuple]) -> None:
            term, group, p, zero = (np.array(c, np.int64) for c in zip(*rows))
            in_a, in_b = group // tile == now[1], group // tile == now[2]
            starts = np.searchsorted(term[in_b], np.arange(term[-1] + 2))  # rows of the index by term
            peer, q, other = group[in_b] % tile, p[in_b], zero[in_b]
            mine, own, none, of = group[in_a], p[in_a], zero[in_a], term[in_a]
            order = np.argsort(mine, kind="stable")
            for row in np.split(order, np.flatnonzero(np.diff(mine[order])) + 1) if len(order) else []:
                first, size = starts[of[row]], starts[of[row] + 1] - starts[of[row]]
                slots = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                a, z, b, y = np.repeat(own[row], size), np.repeat(none[row], size), q[slots], other[slots]
                np.add.at(sums[mine[row[0]] % tile], peer[slots], _apart(a, b) - _apart(a, y) - _apart(z, b) + _apart(z, y))

        def out() -> Iterator[pa.RecordBatch]:
            if now is not None:
                a, b = np.nonzero(sums)
                lang, tile_a, tile_b, _ = now
                yield _square(lang, a + tile_a * tile, b + tile_b * tile, sums[a, b])
                if tile_a != tile_b:
                    yield _square(lang, b + tile_b * tile, a + tile_a * tile, sums[a, b])

        last, number = None, -1
        for batch in batches:
            for *key, term, group, p, zero in zip(*(c.to_pylist() for c in batch.columns)):
                if (key := tuple(key)) != now or term != last and len(held) > 20_000:
                    if held:
                        add(held)
                    held, number, last = [], -1, None
                    if key != now:
                        yield from out()
                        now, sums = key, np.zeros((tile, tile), np.int64)
                if term != last:
                    last, number = term, number + 1
                held.append((number, group, p, zero))
        if held:
            add(held)
        yield from out()

    return run


def source_divergence(documents: DataFrame, tile: int = TILE, part: int = PART, counts: int = COUNTS) -> DataFrame:
    """(lang, source, part, item, value, rank) of every source of every language.

    Part `pair`: item is each other source of the language, value their distance summed over all kept terms (0 if the language
    keeps none), ranked by falling value, then by item. Part `term`: item is each kept term that the source has and that has a
    larger share in it than in its language, value the distance of the two shares; the first 10 ranks.

    Null lang, source and text read as ''; so null and empty sources are one. A repeated row counts as often as it stands. A source
    without terms has zero counts. An empty table gives no rows. Other columns are not read, whatever their names. Exact for up to
    9e15 kept occurrences a source; beyond that Spark reports an overflow.

    A task sums up its documents before anything is shuffled, so one large source or one frequent term makes a row a task. Tables of
    sources are broadcast only if they are counted and small. The index is dealt into tiles of 256 sources and parts of 250,000
    postings, so a task holds 65,536 sums. A pair of sources makes a row for each part of its tiles, and one in the result.
    """
    spread = term_counts(documents).repartition("lang", "term")
    by_source = spread.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # The term-major index: a row a term, with a posting for each source that has it.
    index = by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("in_lang"), F.collect_list(F.struct("source", "n")).alias("postings"))
    index = stored(index.where(F.col("docs") >= LEAST_DOCUMENTS).drop("docs"), "index")
    postings = index.select("lang", "term", "in_lang", F.explode("postings").alias("_p")).select("lang", "term", "in_lang", "_p.source", "_p.n")

    kept = index.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("in_lang").alias("lang_n"))
    sums = postings.groupBy("lang", "source").agg(F.sum("n").alias("source_n"), F.count("*").alias("rows"))
    named = _named(documents.withColumn("text", F.lit(""))).select("lang", "source").distinct()
    totals = named.join(kept, "lang", "left").join(sums, ["lang", "source"], "left").fillna(0, ["kept", "lang_n", "source_n", "rows"])
    # Sources by number: a row a source, at most the rows of the result's own keys.
    group = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    whole = {t: F.greatest(F.col(n) + 2 * F.col("kept"), F.lit(1)) for t, n in (("total", "source_n"), ("lang_total", "lang_n"))}
    groups = totals.withColumn("group", group).withColumns(whole).withColumn("zero", share(F.lit(0).cast("long"), F.col("total")))
    groups = small_enough(groups)

    pairs = _pairs(groups, postings, tile, part, counts)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    shares = postings.join(groups.select("lang", "source", "total", "lang_total"), ["lang", "source"])
    shares = shares.withColumn("p", share(F.col("n"), F.col("total"))).withColumn("q", share(F.col("in_lang"), F.col("lang_total"))).where("p > q")
    terms = shares.select("lang", "source", F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP_TERMS)
    return pairs.unionByName(terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


def _pairs(groups: DataFrame, postings: DataFrame, tile: int, part: int, most: int) -> DataFrame:
    """(lang, source, item, value) of each two sources of a language."""
    schema = "lang string, group int, peer int, value long"
    known = groups.select("lang", "source", "group", "zero", "total", "rows")
    # The zeros of a language in the order of its sources, and the counts of a source with the number of its terms.
    zeros = groups.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("group", "zero"))), lambda x: x["zero"]).alias("zeros"))
    counts = postings.groupBy("lang", "source", "n").agg(F.count("*").alias("terms")).join(known, ["lang", "source"])
    counts = counts.withColumn("chunk", F.pmod(F.xxhash64("n"), F.ceil(F.col("rows") / most))).drop("source", "rows")
    nothing = {"n": F.lit(0).cast("long"), "terms": F.col("kept"), "chunk": F.lit(-1).cast("long")}
    counts = counts.unionByName(groups.select("lang", "group", "zero", "total", *(c.alias(n) for n, c in nothing.items())))
    counts = counts.groupBy("lang", "group", "zero", "total", "chunk").agg(F.collect_list(F.struct("n", "terms")).alias("c")).join(zeros, "lang")
    lone = counts.select("lang", "group", "zero", "total", "c.n", "c.terms", "zeros").mapInArrow(_baselines(tile), schema)

    tiles = small_enough(groups.groupBy("lang").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"), F.ceil(F.sum("rows") / part).cast("int").alias("parts")))
    dealt = postings.join(known, ["lang", "source"]).join(tiles, "lang")
    dealt = dealt.withColumn("p", share(F.col("n"), F.col("total"))).withColumn("tile", F.floor(F.col("group") / tile).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumn("part", F.pmod(F.xxhash64("term"), "parts").cast("int"))
    keys = ["lang", "tile_a", "tile_b", "part"]
    dealt = dealt.select("lang", F.least("tile", "other").alias("tile_a"), F.greatest("tile", "other").alias("tile_b"), "part", "term", "group", "p", "zero")
    common = dealt.repartition(*keys).sortWithinPartitions(*keys, "term").mapInArrow(_scatter(tile), schema)
    sums = lone.unionByName(common).groupBy("lang", "group", "peer").agg(F.sum("value").alias("value")).where("group <> peer")
    names = groups.select("lang", "group", "source")
    peers = groups.select("lang", F.col("group").alias("peer"), F.col("source").alias("item"))
    return sums.join(names, ["lang", "group"]).join(peers, ["lang", "peer"]).select("lang", "source", "item", "value")
