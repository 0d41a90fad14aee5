"""Work on groups of rows in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tiled(df: DataFrame, group: list[str], member: str, size: int) -> DataFrame:
    """The rows with tile, tile_a and tile_b: each group is dealt into tiles of about `size` members."""
    tiles = df.groupBy(*group).agg(F.ceil(F.count("*") / size).cast("int").alias("tiles"))
    return dealt(df.join(tiles, group), member)


def dealt(rows: DataFrame, member: str) -> DataFrame:
    """Rows with a column tiles, the number of tiles of their group, as rows with tile, tile_a and tile_b.

    A row comes once for each tile of its group, keyed by the two tiles in order, so each pair of members meets under
    exactly one key (tile_a, tile_b): under (t, t) if they share a tile.
    """
    rows = rows.withColumn("tile", F.pmod(F.xxhash64(member, F.lit("tile")), F.col("tiles")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return rows.withColumn("tile_a", F.least("tile", "other")).withColumn("tile_b", F.greatest("tile", "other")).drop("tiles", "other")


def by_group(df: DataFrame, keys: list[str], work: Callable[[tuple, list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """work(key, rows) for each key; rows hold the columns of df that aren't keys. Results are rows of schema.

    Rows of a key lie together in a sorted partition and are read as a stream: one group is in memory at a time.
    """
    rest = [c for c in df.columns if c not in keys]
    names, types = zip(*[part.strip().split(" ", 1) for part in schema.split(",")])
    arrow = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "int": pa.int32(), "binary": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows) if rows else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, arrow[t]) for c, t in zip(columns, types)], list(names))

        now, held, made = None, [], []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for key, row in zip(zip(*columns[: len(keys)]), zip(*columns[len(keys) :])):
                if key != now:
                    if held:
                        made += work(now, held)
                    now, held = key, []
                    if len(made) > 10_000:
                        yield out(made)
                        made = []
                held.append(row)
        if held:
            made += work(now, held)
        yield out(made)

    placed = df.select(*keys, *rest).repartition(*keys).sortWithinPartitions(*keys)
    return placed.mapInArrow(run, schema)


def least_labels(n: int, a, b):
    """For nodes 0..n-1 and edges (a, b): the smallest node that each can reach."""
    import numpy as np

    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new
