"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import hot_join, materialize

#: Links up to which one task finds the components at once, as steps have a fixed cost.
FEW = 16_384


def _stars(edges: DataFrame) -> bool:
    """Whether each component is a star about its least node: every a has one b, which is no other's a."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("n")).unionByName(edges.select(F.col("b").alias("x"), F.lit(0).alias("n")))
    return ends.groupBy("x").agg(F.sum("n").alias("n"), F.min("n").alias("least")).filter("n > 1 OR n = 1 AND least = 0").isEmpty()


def _with_least(links: DataFrame) -> DataFrame:
    """links (a, b), read from written tables, with m: the least of a and all b of the same a. A hub of many links does not meet in one task."""
    least = links.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("a", "m"))
    return hot_join(links, least, "a", "n", links.count()).drop("n")


def _of_few(batches):
    """Links (a, b), a > b -> (node, root)."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = p
        return x

    for batch in batches:
        for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.int64)) for x in (nodes, [find(x) for x in nodes])], ["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for the nodes of edges (a: long, b: long).

    A large star links the larger neighbours of a node to its least neighbour; a small star links the smaller ones.
    The links only shrink, until each component is a star about its least node. Every step is written to the shared
    folder. Up to FEW links (counted) are taken in one task instead. Links of a node with itself and repeated links tell nothing; an empty table gives an empty result.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    if edges.count() <= FEW:
        ship(edges.sparkSession)
        return materialize(edges.coalesce(1).mapInArrow(_of_few, "node long, root long"))
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        met = _with_least(materialize(large))
        small = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(met.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        edges = materialize(small)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
