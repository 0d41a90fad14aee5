"""Markov clustering of a weighted graph, as joins of a sparse matrix with itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.functions.storage import materialise
from lexispark.operators.components import connected_components


def markov_clusters(edges: DataFrame, inflation: float = 2.0, least: float = 1e-4, tolerance: float = 1e-5, rounds: int = 100) -> DataFrame:
    """(node, cluster) of undirected edges (u, v, weight): cluster is the smallest node of each.

    A random walk is let run and its strong currents made stronger: the matrix of steps, with a loop at each node as heavy as its
    heaviest edge, is multiplied by itself (a join of rows and columns), its entries are raised to `inflation`, those under `least`
    of the largest in their column are left out, and columns are brought to a sum of 1, until no entry changes by more than
    `tolerance`. Nodes between which flow is left are a cluster. Of edges given twice the heaviest counts; those without weight are left out.

    The matrix is sparse rows (i, j, v) throughout, so no part of the graph needs a task of its own; a round costs as many rows as there
    are steps of length two between linked nodes, and is written down.
    """
    given = edges.where("weight > 0 and u <> v").select("u", "v", F.col("weight").cast("double").alias("weight"))
    both = given.unionByName(given.select(F.col("v").alias("u"), F.col("u").alias("v"), "weight")).groupBy("u", "v").agg(F.max("weight").alias("w"))
    both = materialise(both)
    loops = both.groupBy("u").agg(F.max("w").alias("w")).select(F.col("u").alias("i"), F.col("u").alias("j"), "w")
    flow = materialise(_columns(both.select(F.col("u").alias("i"), F.col("v").alias("j"), "w").unionByName(loops), 1.0, least))
    for _ in range(rounds):
        steps = flow.select(F.col("i").alias("k"), "j", F.col("v").alias("w"))
        twice = flow.select("i", F.col("j").alias("k"), "v").join(steps, "k").groupBy("i", "j").agg(F.sum(F.col("v") * F.col("w")).alias("w"))
        new = materialise(_columns(twice, inflation, least))
        change = new.join(flow.withColumnRenamed("v", "old"), ["i", "j"], "full").agg(F.max(F.abs(F.coalesce("v", F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))).alias("c"))
        flow = new
        if (change.first()["c"] or 0.0) <= tolerance:
            break
    return connected_components(flow, "i", "j").select("node", F.col("component").alias("cluster"))


def _columns(entries: DataFrame, power: float, least: float) -> DataFrame:
    """(i, j, v) of entries (i, j, w): w to a power, small ones left out, each column j of sum 1."""
    top = entries.groupBy("j").agg(F.max("w").alias("top"))
    raised = entries.join(top, "j").withColumn("p", F.pow(F.col("w") / F.col("top"), F.lit(power))).where(F.col("p") >= least)
    sums = raised.groupBy("j").agg(F.sum("p").alias("sum"))
    return raised.join(sums, "j").select("i", "j", (F.col("p") / F.col("sum")).alias("v"))
