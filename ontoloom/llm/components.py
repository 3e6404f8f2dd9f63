"""Distributed union-find: connected components of an edge table by alternating stars.

Every partition first contracts its own edges with a plain union-find, which leaves at most one edge for each node and
partition. If few are left, one task joins them; else large-star and small-star rounds (each node's neighbours are hung under the least of them) run until the
table of stars stands still. Minima are pre-aggregated before the shuffle, so a hub with any number of neighbours is no
hot key; rounds are written to the shared folder, so no lineage builds up and lost executors cost one round at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoloom.llm.shared import Tables, ship

SCHEMA = "u long, v long"
#: Edges that one task joins by itself when no more are left.
SMALL = 200_000


def contracted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) to (node, least node reached within this partition)."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x], x = root, up
        return root

    for b in it:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            u, v = find(u), find(v)
            if u != v:
                parent[max(u, v)] = min(u, v)
    nodes = np.fromiter(parent, np.int64, len(parent))
    roots = np.fromiter((find(x) for x in nodes.tolist()), np.int64, len(parent))
    if len(nodes):
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["u", "v"])


def _large(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _with_roots(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).union(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def components(edges: DataFrame) -> DataFrame:
    """edges (u long, v long, neither null) to (node long, root long): each node of an edge between two nodes, and the least
    node of its component. Nodes that are in no such edge are not listed; no edges give no rows. Repeated edges and loops
    change nothing."""
    spark = edges.sparkSession
    ship(spark)
    tables = Tables(spark)
    kept = tables.write(edges.select("u", "v").mapInArrow(contracted, SCHEMA))
    if kept.count() <= SMALL:  # what is left is one task's work
        kept = tables.write(kept.coalesce(1).mapInArrow(contracted, SCHEMA))
        return _with_roots(kept)
    state = None
    while True:
        now = tables.write(_small(_large(kept)))
        sums = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        tables.drop(kept)
        kept = now
        if tuple(sums) == state or sums[0] == 0:
            return _with_roots(kept)
        state = tuple(sums)
