"""Embedding near-dedup: all pairs with a cosine of at least a threshold, by int8 tile products with rigorous error bounds.

Vectors are dealt to the cells of centroids. A vector also visits every cell that can hold a near one: two unit vectors of
cosine t are at most d = sqrt(2 - 2t) apart, so a vector can have a near one behind the plane halfway between two centroids
only if it lies within d of that plane. Each cell is cut into tiles; of a tile, vectors are quantised to int8, and

    |x.y - x'.y'| <= |x - x'| + |x'| |y - y'|

bounds the error of the quantised product for each pair; only pairs that may reach the threshold are computed again in
double precision. Tiles give counts and the components of their links, not the pairs. Equal vectors are one class throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoloom.llm.components import components
from ontoloom.llm.shared import Tables, ship
from ontoloom.llm.vectors import balanced, comparable, number, rows_of, sample, scaled, shipped, unit

#: Rows of a tile's side.
TILE = 2048


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit rows to int8 rows, their scales, the lengths of the quantised rows and of the errors."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    return q, scale, np.linalg.norm(back, axis=1), np.linalg.norm(x - back, axis=1)


def linked(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of x and y (any length) whose cosine reaches the threshold."""
    x, y = scaled(x), scaled(y)
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    (qx, sx, lx, ex), (qy, sy, _, ey) = quantised(x / nx[:, None]), quantised(y / ny[:, None])
    kind = np.float32 if x.shape[1] * 127 * 127 < 2**24 else np.float64  # sums of int8 products are exact in it
    product = qx.astype(kind) @ qy.astype(kind).T
    # product * sx * sy + ex + lx * ey >= threshold, a little loosened for rounding
    bound = product * (sx[:, None] * sy[None, :]) + ex[:, None] + lx[:, None] * ey[None, :]
    i, j = np.nonzero(bound >= threshold - 1e-9)
    keep = np.zeros(len(i), bool)
    for k in range(0, len(i), 200_000):
        a, b = i[k : k + 200_000], j[k : k + 200_000]
        keep[k : k + 200_000] = np.einsum("nd,nd->n", x[a], y[b]) / (nx[a] * ny[b]) >= threshold
    return i[keep], j[keep]


def spanning(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges between node numbers, to (node, least node of its component) for each node on an edge."""
    nodes, both = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = both[: len(u)], both[len(u) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def near(vectors: DataFrame, threshold: float = 0.95, cell_size: int = 2048, most_cells: int = 4096, most_sample: int = 20_000) -> DataFrame:
    """One row for each row of vectors: vec_id, n_links, component_id (the smallest vec_id that links reach), kept.

    vectors: vec_id, embedding; other columns are not read. Vectors that are null, zero, hold null or non-finite components, or
    are of another dimension than most, link with nothing; so do rows with a null vec_id. Rows that repeat a vec_id with equal
    vectors are one vector; with different vectors each counts as a vector, and their links are added. No rows: no rows.
    Centroids are fitted on at most most_sample vectors; they steer the work and never the result.
    """
    spark = vectors.sparkSession
    ship(spark)
    tables = Tables(spark)
    all_ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
    v, dim = comparable(vectors)
    kind = number(v)

    whole = F.transform("embedding", lambda x: x + F.lit(0).cast(kind))  # no negative zeros
    v = v.withColumns({"k1": F.xxhash64(F.lit(1), whole), "k2": F.xxhash64(F.lit(2), whole)})
    keys = tables.write(v.select("vec_id", "k1", "k2").distinct())
    # a class of equal vectors has a number of its own: one vec_id may be in several classes
    classes = tables.write(keys.groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies")).withColumn("class", F.monotonically_increasing_id()))
    one = v.groupBy("k1", "k2").agg(F.first("embedding").alias("embedding"))
    v = tables.write(one.join(classes, ["k1", "k2"]).select(F.col("class").alias("vec_id"), "copies", "embedding"))
    n = v.count()
    schema = "u long, v long, links long"
    if not n:
        return all_ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    centroids = balanced(sample(v, n, most_sample, dim), min(most_cells, -(-n // cell_size))).astype(np.float64)
    reach = np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
    gaps = np.sqrt(np.maximum(0, 2 - 2 * centroids @ centroids.T)) * reach
    shared = spark.sparkContext.broadcast((centroids, gaps))  # at most most_cells rows

    def visits(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, reach_to = shared.value
        for b in it:
            for k in range(0, b.num_rows, 1024):
                part = b.slice(k, 1024)
                x = rows_of(part.column("embedding"), dim)
                s = unit(x) @ c.T
                home = np.argmax(s, axis=1)
                own = s[np.arange(len(x)), home]
                # a pair of two cells meets in the cell of the smaller number
                row, cell = np.nonzero((own[:, None] - s <= reach_to[home]) & (np.arange(len(c))[None, :] <= home[:, None]))
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(cell == home[row]), part.column("vec_id").take(pa.array(row)), part.column("copies").take(pa.array(row)), shipped(x[row], kind)], ["cell", "home", "vec_id", "copies", "embedding"])

    placed = tables.write(v.select("vec_id", "copies", "embedding").mapInArrow(visits, f"cell long, home boolean, vec_id long, copies long, embedding array<{kind}>"))
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(F.count(F.when(c, 1)) / TILE))
    sizes = placed.groupBy("cell").agg(blocks(F.col("home")).alias("hb"), blocks(~F.col("home")).alias("gb"))
    b = placed.join(F.broadcast(sizes), "cell").withColumn("mine", F.pmod(F.xxhash64("vec_id"), F.when(F.col("home"), F.col("hb")).otherwise(F.col("gb"))))
    # tiles of a cell: home blocks (i, j) with i <= j, and home block i with guest block g as (i, hb + g)
    home = F.expr("transform(sequence(0L, hb + gb - 1), j -> if(j < hb, struct(least(mine, j) as i, greatest(mine, j) as j), struct(mine as i, j as j)))")
    guest = F.expr("transform(sequence(0L, hb - 1), i -> struct(i as i, hb + mine as j))")
    tiles = b.withColumn("t", F.explode(F.when(F.col("home"), home).otherwise(guest))).select("cell", F.col("t.i").alias("i"), F.col("t.j").alias("j"), "home", "mine", "vec_id", "copies", "embedding")

    def tile(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, i, j = key
        own, mine = pdf["home"].to_numpy(), pdf["mine"].to_numpy()
        left = own & (mine == i)
        right = own & (mine == j) if i == j or own[~left].any() else ~own
        a, b = pdf[left], pdf[right]
        if not len(a) or not len(b):
            return pd.DataFrame({"u": [], "v": [], "links": []})
        r, c = linked(np.stack(a["embedding"].to_numpy()).astype(np.float64), np.stack(b["embedding"].to_numpy()).astype(np.float64), threshold)
        ia, ib = a["vec_id"].to_numpy(np.int64), b["vec_id"].to_numpy(np.int64)
        if i == j and own[right].all():
            r, c = r[r < c], c[r < c]
        u, v, cu, cv = ia[r], ib[c], a["copies"].to_numpy(np.int64)[r], b["copies"].to_numpy(np.int64)[c]
        if not len(u):
            return pd.DataFrame({"u": [], "v": [], "links": []})
        node, root = spanning(u, v)
        links = np.zeros(len(node), np.int64)
        np.add.at(links, np.searchsorted(node, u), cv)
        np.add.at(links, np.searchsorted(node, v), cu)
        return pd.DataFrame({"u": node, "v": root, "links": links})

    found = tables.write(tiles.groupBy("cell", "i", "j").applyInPandas(tile, schema))
    links = found.groupBy(F.col("u").alias("class")).agg(F.sum("links").alias("links"))
    roots = tables.write(components(found.select("u", "v")))
    by_class = classes.join(links, "class", "left").join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    first = by_class.groupBy("root").agg(F.min("least").alias("first"))
    by_class = tables.write(by_class.join(first, "root").select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "first"))
    by_id = keys.join(by_class, ["k1", "k2"]).groupBy("vec_id").agg(F.sum("links").alias("links"), F.min("first").alias("root"))
    component = F.coalesce("root", "vec_id")
    return all_ids.join(by_id, "vec_id", "left").select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
