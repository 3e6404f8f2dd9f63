"""Centroid clustering by delta Lloyd: rounds that compare and move only what has changed, in exact whole numbers.

Every row's owner and distance are kept in a table from round to round, and the sums and counts of every cluster on the driver (as many
rows as there are clusters, whatever the input). A centroid that a round left where it was has the distances that it had. So a row whose
owner stood still keeps its distance and is compared with the centroids that moved only; a row whose owner moved is compared with all.
Rows that change their owner are subtracted from one cluster's sums and added to another's: signed transfers, added up by task before
they meet. What a round reads beyond that is nothing but the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoloom.llm.shared import Tables, ship

#: Rows at once in numpy.
ROWS = 4096
#: Components must be smaller than this, so that squared distances and sums over 2**35 rows are exact in 64 bits.
LARGEST = 2**27


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows and centroids, exact. Products of small numbers are exact in doubles, which are faster."""
    dim = max(1, x.shape[1])
    small = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < 2 ** int((53 - np.log2(dim)) / 2)
    kind = np.float64 if small else np.int64
    product = (x.astype(kind) @ c.T.astype(kind)).astype(np.int64)
    return (x * x).sum(axis=1)[:, None] - 2 * product + (c * c).sum(axis=1)[None, :]


def nearest(x: np.ndarray, c: np.ndarray, owner: np.ndarray, distance: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(owner, distance) of rows after the centroids numbered ``moved`` have moved, and how many distances were computed. Rows without
    an owner (-1) and those whose owner moved are compared with all, others with moved ones; of equal distances the smaller number."""
    owner, distance, compared = owner.copy(), distance.copy(), 0
    whole = (owner < 0) | np.isin(owner, moved)
    rows = np.flatnonzero(whole)
    if len(rows):
        d = squared(x[rows], c)
        owner[rows] = d.argmin(axis=1)
        distance[rows] = d.min(axis=1)
        compared += d.size
    rows = np.flatnonzero(~whole)
    if len(rows) and len(moved):
        d = squared(x[rows], c[moved])
        best, at = d.min(axis=1), moved[d.argmin(axis=1)]
        closer = (best < distance[rows]) | ((best == distance[rows]) & (at < owner[rows]))
        owner[rows[closer]], distance[rows[closer]] = at[closer], best[closer]
        compared += d.size
    return owner, distance, compared


def clustered(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """One row for each row of vectors that is kept: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    vectors: vec_id, embedding; other columns are not read. Kept are vectors of exactly dim components, none null or not finite; each
    component x becomes floor(scale * x). Centroids start as the k kept vectors with the least SHA-256 of ``seed:vec_id``, in that order
    (of rows that repeat a vec_id each counts, in the order of their components; with fewer than k kept vectors there are as many
    clusters). A round gives every vector to its nearest centroid (of equally near ones the smaller number) and makes every centroid
    that has vectors the floor of their mean; the rest stay. After the last round vectors are given to the centroids once more.

    Rows with a null vec_id take part but start no cluster unless there are fewer than k others. Repeated rows count each. No kept
    rows: no rows. Components of LARGEST or more in size are refused with a ValueError, as sums of squares would not be exact.
    """
    spark = vectors.sparkSession
    ship(spark)
    tables = Tables(spark)
    x = F.col("embedding")
    fine = (F.size(x) == dim) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding")).filter(x.isNotNull()).filter(fine)
    if v.filter(F.exists(x, lambda y: F.abs(F.lit(float(scale)) * y.cast("double")) >= LARGEST)).take(1):
        raise ValueError(f"components of {LARGEST} or more after scaling")
    v = v.select("vec_id", F.transform(whole, lambda y: y.cast("int")).alias("x"), F.lit(-1).alias("owner"), F.lit(-1).alias("before"), F.lit(0).cast("long").alias("distance"))
    v = tables.write(v)
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = v.select("x", hashed.alias("h")).orderBy(F.asc_nulls_last("h"), "x").limit(k).collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r["x"] for r in first], np.int64)
    sums, counts = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
    moved = np.arange(len(centroids))
    for turn in range(rounds + 1):
        v, old = tables.write(_assigned(v, centroids, moved, dim)), v
        tables.drop(old)
        if turn == rounds:
            break
        for r in _transfers(v, dim).collect():  # a row a cluster
            sums[r["cluster"]] += np.array(r["x"], np.int64)
            counts[r["cluster"]] += r["n"]
        new = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], centroids)
        moved = np.flatnonzero((new != centroids).any(axis=1))
        centroids = new
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    inertia = {r["owner"]: r["d"] for r in v.groupBy("owner").agg(F.sum("distance").alias("d")).collect()}
    told = spark.createDataFrame([(i, inertia.get(i, 0), sum(inertia.values()), h) for i, h in enumerate(digest)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return v.select("vec_id", F.col("owner").alias("cluster"), "distance").join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row a cluster


def _assigned(v: DataFrame, centroids: np.ndarray, moved: np.ndarray, dim: int) -> DataFrame:
    """Rows with their owners after a move; before: the owner until then."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                x = b.column("x").flatten().to_numpy().astype(np.int64).reshape(-1, dim)
                before = b.column("owner").to_numpy()
                owner, distance, _ = nearest(x, centroids, before.astype(np.int64), b.column("distance").to_numpy(), moved)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("x"), pa.array(owner.astype(np.int32)), b.column("owner"), pa.array(distance)], ["vec_id", "x", "owner", "before", "distance"])

    return v.mapInArrow(run, v.schema)


def _transfers(v: DataFrame, dim: int) -> DataFrame:
    """(cluster, x, n): what the rows that changed their owner add to and take from each cluster, by task first."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in it:
            x = b.column("x").flatten().to_numpy().astype(np.int64).reshape(-1, dim)
            x = np.concatenate([x, np.ones((len(x), 1), np.int64)], axis=1)
            for column, sign in (("owner", 1), ("before", -1)):
                owner = b.column(column).to_numpy()
                for c in np.unique(owner[owner >= 0]).tolist():
                    total[c] = total.get(c, 0) + sign * x[owner == c].sum(axis=0)
        if total:
            rows = np.stack(list(total.values()))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, len(rows) * dim + 1, dim), pa.int32()), pa.array(rows[:, :dim].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), flat, pa.array(rows[:, dim])], ["cluster", "x", "n"])

    part = v.filter("owner <> before").mapInArrow(run, "cluster int, x array<long>, n long")
    return part.groupBy("cluster").agg(F.array(*[F.sum(F.col("x")[i]) for i in range(dim)]).alias("x"), F.sum("n").alias("n"))
