"""Near-duplicate join of embeddings: pigeonhole over low-dimensional blocks of rotated vectors, verified exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.functions.storage import materialise, stored
from lexispark.llm.blocks import by_group, least_labels, tiled
from lexispark.operators.components import connected_components

#: Least cosine, dimensions of a block, coordinates of a block that place a vector on its grid, and rows of a tile.
COSINE, WIDTH, GRID, CELL = 0.93, 16, 2, 4096
#: Added to each budget (and twice where products of single precision look for candidates).
_SLACK = 1e-4
_CELL = ["label", "dims", "block", "cell", "tile_a", "tile_b"]


def usable(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """(row, vec_id, label, dims, v): vectors that can link, in double precision; row is a number of its own."""
    v = F.transform(F.col(embedding), lambda x: x.cast("double"))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), v.alias("v"))
    fine = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & fine)
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.size("v").alias("dims"), "v")


def _unit(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


class Blocks:
    """How vectors of one length are rotated and cut: axes, the blocks' bounds, and their shares of the squared distance."""

    def __init__(self, n: float, first: np.ndarray, second: np.ndarray, cosine: float) -> None:
        """From the number of the unit vectors, their sum, and the sum of their outer products.

        The principal axes are dealt to the blocks in turn, so that every block gets axes along which vectors differ.
        """
        dims, mean = len(first), first / n
        spread, axes = np.linalg.eigh(second / n - np.outer(mean, mean))
        blocks = -(-dims // WIDTH)
        order = np.concatenate([np.arange(dims)[::-1][b::blocks] for b in range(blocks)])
        spread = np.maximum(spread[order], 1e-12)
        self.axes, self.cuts = axes[:, order], np.cumsum([0] + [len(range(b, dims, blocks)) for b in range(blocks)])
        share = np.array([spread[a:b].sum() for a, b in zip(self.cuts[:-1], self.cuts[1:])])
        self.budgets = (2 - 2 * cosine) * share / share.sum()

    def block(self, rotated: np.ndarray, b: int) -> np.ndarray:
        return rotated[:, self.cuts[b] : self.cuts[b + 1]]


def rotations(rows: DataFrame, cosine: float) -> dict[int, Blocks]:
    """The blocks for each length, from second moments of all its vectors."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for dims, x in _by_length(batch):
                x = _unit(x)
                flat = np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
                held[dims] = held.get(dims, 0) + flat
        for dims, flat in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), dims), pa.int32()), pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], ["dims", "at", "value"])

    sums = rows.select("dims", "v").mapInArrow(moments, "dims int, at int, value double").groupBy("dims", "at").agg(F.sum("value").alias("value"))
    found: dict[int, list[tuple[int, float]]] = {}
    for r in sums.collect():
        found.setdefault(r.dims, []).append((r.at, r.value))
    out = {}
    for dims, cells in found.items():
        flat = np.array([v for _, v in sorted(cells)])
        out[dims] = Blocks(flat[0], flat[1 : dims + 1], flat[dims + 1 :].reshape(dims, dims), cosine)
    return out


def _by_length(batch: pa.RecordBatch, index: bool = False) -> Iterator[tuple]:
    """(length, vectors as rows[, their places in the batch]) for each length in a batch."""
    dims = batch.column("dims").to_numpy(zero_copy_only=False)
    flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(dims)[:-1]]) if len(dims) else np.zeros(0, np.int64)
    for d in np.unique(dims):
        at = np.flatnonzero(dims == d)
        x = flat[starts[at][:, None] + np.arange(d)]
        yield (int(d), x, at) if index else (int(d), x)


def _pieces(rows: np.ndarray) -> list[bytes]:
    held, size = np.ascontiguousarray(rows).tobytes(), rows.itemsize * rows.shape[1]
    return [held[i * size : (i + 1) * size] for i in range(len(rows))]


def _products(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """With x' = (x, -|x|^2 / 2, 1) and y' = (y, 1, -|y|^2 / 2), x'.y' is -|x - y|^2 / 2."""
    half = (x * x).sum(1, keepdims=True) / 2
    ones = np.ones_like(half)
    return np.hstack([x, -half, ones]), np.hstack([x, ones, -half]).T


def _candidates(key: tuple, rows: list[tuple], plans: dict[int, Blocks]) -> list[tuple]:
    """The key and (row, tile, home) of the vectors in a grid cell that keep to the block's distance budget with some other.

    One product compares the vectors at home in the cell with all that are there.
    """
    _, dims, block, _, tile_a, tile_b = key
    names, tiles, home, parts = zip(*rows)
    x = np.frombuffer(b"".join(parts), "<f4").reshape(len(names), -1)
    left, right = _products(x)
    at, least = np.flatnonzero(home), np.float32(-(plans[dims].budgets[block] + 2 * _SLACK) / 2)
    tiles, hit = np.array(tiles), np.zeros(len(names), bool)
    for low in range(0, len(at), 512):
        some = at[low : low + 512]
        near = left[some] @ right >= least
        near[np.arange(len(some)), some] = False
        if tile_a != tile_b:
            near &= tiles[some][:, None] != tiles[None, :]
        hit[some] |= near.any(1)
        hit |= near.any(0)
    return [(*key, names[i], int(tiles[i]), int(home[i])) for i in np.flatnonzero(hit)]


def _verify(key: tuple, rows: list[tuple], plans: dict[int, Blocks], cosine: float) -> list[tuple]:
    """(vec_id, links, root) of the candidates of a cell that have a link there; every cosine is taken in double precision.

    A pair that keeps to the budget in several blocks counts in the first of them. Squared distances in blocks are
    summed in the same way wherever a pair meets, so all blocks agree which is the first.
    """
    _, dims, block, _, tile_a, tile_b = key
    ids, tiles, home, vectors, rotated = zip(*rows)
    plan = plans[dims]
    x, tiles, ids = np.array(vectors), np.array(tiles), np.array(ids)
    r = np.frombuffer(b"".join(rotated), "<f4").reshape(len(ids), dims)
    x = x / np.abs(x).max(1, keepdims=True)
    norm = np.sqrt((x * x).sum(1))
    at, place, links, ends = np.flatnonzero(home), np.arange(len(ids)), np.zeros(len(ids), np.int64), []
    is_home = np.array(home, bool)
    for low in range(0, len(at), 256):
        some = at[low : low + 256]
        ok = (x[some] @ x.T) / (norm[some][:, None] * norm[None, :]) >= cosine
        ok &= ~is_home[None, :] | (place[None, :] > some[:, None])
        if tile_a != tile_b:
            ok &= tiles[some][:, None] != tiles[None, :]
        i, j = np.nonzero(ok)
        i = some[i]
        for k in range(0, len(i), 100_000):
            a, b = i[k : k + 100_000], j[k : k + 100_000]
            mine = np.ones(len(a), bool)
            for z in range(block + 1):
                apart = plan.block(r, z)[a].astype(float) - plan.block(r, z)[b]
                inside = (apart * apart).sum(1) <= plan.budgets[z] + _SLACK
                mine &= inside if z == block else ~inside
            a, b = a[mine], b[mine]
            links += np.bincount(a, minlength=len(ids)) + np.bincount(b, minlength=len(ids))
            ends.append((a, b))
    a, b = (np.concatenate(c) for c in zip(*ends)) if ends else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[order] = place
    roots = least_labels(len(ids), rank[a], rank[b])
    return [(int(ids[i]), int(links[i]), int(ids[order[roots[rank[i]]]])) for i in np.flatnonzero(links)]


def near_vectors(vectors: DataFrame, cosine: float = COSINE, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors link if their labels are equal and their cosine is at least that. Unit vectors u, v with that cosine have
    |u - v|^2 <= 2 - 2 cosine, so in at least one block of the rotated coordinates they keep to the block's share of it.
    Per block a grid over its first coordinates joins each cell with half of its neighbours, tile by tile; only block
    coordinates travel. What keeps to the budget with another vector is a candidate of that cell and block. To the
    candidates, and to them alone, their whole vectors are joined, and in the same cells the pairs of candidates are
    verified exactly. A task returns counts of links and a spanning forest, never pairs.

    Null labels, null or zero vectors, and vectors with null or non-finite parts link with nothing; lengths may differ
    (only equal lengths link, and all lengths go through the same jobs). Equal vec_ids are one node, whose links add up; a
    null vec_id links with nothing. An empty table gives no rows.
    """
    rows = stored(usable(vectors, vec_id, embedding, label), "vectors")
    ids = vectors.select(F.col(vec_id).cast("long").alias("vec_id"))
    found = _links(rows, cosine)
    links = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select("vec_id", "root"), "vec_id", "root").withColumnRenamed("node", "vec_id")
    out = ids.join(links, "vec_id", "left").join(parts, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def _links(rows: DataFrame, cosine: float) -> DataFrame:
    """(vec_id, links, root) of each cell's verified candidates."""
    held = rows.sparkSession.sparkContext.broadcast(rotations(rows, cosine))

    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = [b""] * batch.num_rows
            for dims, x, at in _by_length(batch, index=True):
                for i, piece in zip(at, _pieces((_unit(x) @ held.value[dims].axes).astype("<f4"))):
                    out[i] = piece
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "vec_id", "label", "dims", "v")), pa.array(out, pa.binary())], ["row", "vec_id", "label", "dims", "v", "r"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column("dims").to_numpy(zero_copy_only=False)
            for dims in np.unique(every):
                at = np.flatnonzero(every == dims)
                some, plan = batch.take(pa.array(at)), held.value[int(dims)]
                x, n, out = np.frombuffer(b"".join(some.column("r").to_pylist()), "<f4").reshape(len(at), dims), len(at), []
                for b, budget in enumerate(plan.budgets):
                    part = plan.block(x, b)
                    pieces, grid = _pieces(part), min(GRID, part.shape[1])
                    cell = np.floor(part[:, :grid] / np.sqrt(budget + _SLACK)).astype(np.int64)
                    #: The cell itself, and of each two opposite neighbours one.
                    for s in (s for s in np.ndindex(*[3] * grid) if s >= (1,) * grid):
                        where = ((cell + np.array(s) - 1 + (1 << 20)) << (21 * np.arange(grid))).sum(1)
                        out.append((np.full(n, b, np.int32), where, np.full(n, int(all(k == 1 for k in s)), np.int32), pieces))
                index = pa.array(np.tile(np.arange(n), len(out)))
                block, where, home, pieces = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [*(some.column(c).take(index) for c in ("label", "dims")), pa.array(np.concatenate(block)), pa.array(np.concatenate(where)), some.column("row").take(index), pa.array(np.concatenate(home)), pa.array([p for ps in pieces for p in ps], pa.binary())],
                    ["label", "dims", "block", "cell", "row", "home", "part"],
                )

    rotated = stored(rows.mapInArrow(rotate, "row long, vec_id long, label string, dims int, v array<double>, r binary"), "rotated")
    cells = rotated.select("row", "label", "dims", "r").mapInArrow(place, "label string, dims int, block int, cell long, row long, home int, part binary")
    cells = tiled(cells, ["label", "dims", "block", "cell"], "row", CELL).select(*_CELL, "row", "tile", "home", "part")
    found = by_group(cells, _CELL, lambda k, r: _candidates(k, r, held.value), "label string, dims int, block int, cell long, tile_a int, tile_b int, row long, tile int, home int")
    found = stored(found, "candidates").join(rotated.select("row", "vec_id", "v", "r"), "row").select(*_CELL, "vec_id", "tile", "home", "v", "r")
    return materialise(by_group(found, _CELL, lambda k, r: _verify(k, r, held.value, cosine), "vec_id long, links long, root long"))
