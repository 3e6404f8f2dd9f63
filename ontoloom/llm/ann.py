"""Approximate nearest neighbours by balanced posting lists.

Centroids come from a bounded sample, halved again and again at medians, so lists are balanced. A small graph of centroids is
held in memory and searched best-first. A vector enters the list of its nearest centroid and those of others that are
hardly farther (boundary vectors are in several lists). A query reads the lists whose centroids are within a ratio of its
nearest one's distance; the ratio is the least that finds enough neighbours in the sample. Members of those lists are scored
exactly, shard by shard, and a shard gives a query its k best only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ontoloom.llm.shared import Tables, ship
from ontoloom.llm.vectors import balanced, batch_rows, comparable, number, sample, scaled, shipped, unit

#: Vectors of a list's block, and queries that are scored at a time.
BLOCK, QUERIES = 4096, 4096
#: Bytes, as doubles, of the vectors of a shard, and of the queries that meet it in one task.
TILE_BYTES = 32 << 20


class CentroidGraph:
    """A navigable graph: each centroid's nearest ones, and a ring in random order, so that all are reached."""

    def __init__(self, centroids: np.ndarray, degree: int = 16, entries: int = 16, seed: int = 1):
        self.c = centroids
        k = len(centroids)
        rng = np.random.default_rng(seed)
        near = np.zeros((k, min(degree, k)), np.int64)
        for i in range(0, k, 1024):
            s = centroids[i : i + 1024] @ centroids.T
            near[i : i + 1024] = np.argpartition(-s, near.shape[1] - 1, axis=1)[:, : near.shape[1]]
        ring = rng.permutation(k)
        after = np.empty(k, np.int64)
        after[ring] = np.roll(ring, -1)
        self.links = np.hstack([near, after[:, None], rng.integers(0, k, (k, 2))])
        self.entries = ring[:entries]

    def distance(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, 2 - 2 * np.einsum("bd,brd->br", q, self.c[ids])))

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row of q (unit vectors) ids and distances of up to beam centroids, nearest first; -1 and inf where fewer."""
        n, k = len(q), len(self.c)
        beam = min(beam, k)
        seen = np.zeros((n, k), bool)
        ids = np.full((n, beam), -1)
        dist = np.full((n, beam), np.inf, np.float32)
        done = np.ones((n, beam), bool)

        def merge(rows: np.ndarray, new: np.ndarray) -> None:
            fresh = ~seen[rows[:, None], new]
            fresh &= ~np.triu(new[:, :, None] == new[:, None, :], 1).any(axis=1)
            seen[rows[:, None], new] = True
            d = np.where(fresh, self.distance(q[rows], new), np.inf)
            all_d, all_i = np.hstack([dist[rows], d]), np.hstack([ids[rows], new])
            all_done = np.hstack([done[rows], ~fresh])
            best = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
            dist[rows], ids[rows], done[rows] = (np.take_along_axis(x, best, 1) for x in (all_d, all_i, all_done))

        merge(np.arange(n), np.tile(self.entries, (n, 1)))
        while True:
            open_ = np.where(done, np.inf, dist)
            at = np.argmin(open_, axis=1)
            rows = np.flatnonzero(np.isfinite(open_[np.arange(n), at]))
            if not len(rows):
                return np.where(np.isfinite(dist), ids, -1), dist
            node = ids[rows, at[rows]]
            done[rows, at[rows]] = True
            merge(rows, self.links[node])

    def within(self, q: np.ndarray, ratio: float, most: int | None = None, beam: int = 32) -> tuple[np.ndarray, np.ndarray]:
        """(row, centroid) for all centroids found within ratio times the nearest one's distance, the nearest most at most. The
        beam is widened for rows whose whole beam is within the ratio."""
        out, rows = [], np.arange(len(q))
        while len(rows):
            ids, dist = self.search(q[rows], min(beam, most or beam))
            ok = np.isfinite(dist) & (dist <= dist[:, :1] * ratio + 1e-6)
            wider = ok[:, -1] & (ids.shape[1] < len(self.c)) & (most is None)
            r, c = np.nonzero(ok & ~wider[:, None])
            out.append((rows[r], ids[r, c]))
            rows, beam = rows[wider], beam * 2
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int))


def probe_ratio(graph: CentroidGraph, x: np.ndarray, k: int, replicas: int, boundary: float, recall: float, most_queries: int = 500, seed: int = 1) -> float:
    """The least ratio at which queries drawn from x (unit rows) find that share of their k nearest rows of x. In a whole table of
    which x is a sample neighbours are nearer, so that more of them are found."""
    q = np.random.default_rng(seed).permutation(len(x))[:most_queries]
    if len(x) < 2:
        return 1.0
    s = x[q] @ x.T
    s[np.arange(len(q)), q] = -np.inf
    k = min(k, len(x) - 1)
    best = np.argpartition(-s, k - 1, axis=1)[:, :k]
    rows, at = np.unique(best, return_inverse=True)
    ids, lists = graph.within(x[rows], boundary, replicas, beam=replicas)
    held = np.full((len(rows), replicas), -1)
    place = np.arange(len(ids)) - np.searchsorted(np.sort(ids), np.arange(len(rows)))[np.sort(ids)]
    order = np.argsort(ids, kind="stable")
    held[ids[order], place] = lists[order]
    held = held[at.reshape(best.shape)]  # for each query and neighbour the lists that hold it
    d = np.sqrt(np.maximum(0, 2 - 2 * x[q] @ graph.c.T))
    ratio = d / np.maximum(d.min(axis=1, keepdims=True), 1e-6)
    need = np.where(held >= 0, np.take_along_axis(ratio[:, None, :], np.maximum(held, 0), axis=2), np.inf).min(axis=2)
    return float(np.quantile(need, recall, method="higher"))


def _listed(graph, dim: int, kind: str, ratio: float, most: int):
    """Rows (vec_id, embedding) to (list, vec_id, place, embedding), a row for each of at most most lists; place is the row's in its task."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for ids, x in batch_rows(it, dim, 512):
            row, lists = graph.value.within(unit(x).astype(np.float32), ratio, most, beam=most)
            yield pa.RecordBatch.from_arrays([pa.array(lists), pa.array(ids[row]), pa.array(at + row), shipped(x[row], kind)], ["list", "vec_id", "place", "embedding"])
            at += len(ids)

    return run


def shard_of(lists, block, shards: int):
    """The shard of a list's block: neighbouring lists go to different ones."""
    return (lists * 31 + block) % shards


def _asked(graph, blocks, shards: int, dim: int, kind: str, ratio: float):
    """Queries (vec_id, embedding) to (shard, query_id, embedding, lists): a row for each shard that holds a part of its lists."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in batch_rows(it, dim, 512):
            row, lists = graph.value.within(unit(x).astype(np.float32), ratio)
            n = blocks.value[lists]
            row, lists, block = np.repeat(row, n), np.repeat(lists, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            shard = shard_of(lists, block, shards)
            order = np.lexsort((lists, shard, row))
            row, shard, lists = row[order], shard[order], lists[order]
            opens = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (shard[1:] != shard[:-1])])) if len(row) else np.zeros(0, int)
            held = pa.ListArray.from_arrays(pa.array(np.append(opens, len(row)), pa.int32()), pa.array(lists))
            yield pa.RecordBatch.from_arrays([pa.array(shard[opens]), pa.array(ids[row[opens]]), shipped(x[row[opens]], kind), held], ["shard", "query_id", "embedding", "lists"])

    return run


def _nearest(k: int):
    """The k best members of a shard for each of a block of queries, by the lists that each query reads."""

    def matrix(column: pd.Series) -> np.ndarray:
        return scaled(np.stack(column.to_numpy()).astype(np.float64))

    def foremost(member: pd.DataFrame, x: np.ndarray) -> np.ndarray:
        """Places, by list and id, of the members that can be among the best: of equal vectors of a list those of the k + 1 least ids."""
        lists, ids = member["list"].to_numpy(), member["vec_id"].to_numpy(np.int64)
        same = np.unique(np.ascontiguousarray(x).view(f"V{x.itemsize * x.shape[1]}").ravel(), return_inverse=True)[1]
        order = np.lexsort((ids, same, lists))
        opens = np.ones(len(order), bool)
        opens[1:] = (lists[order[1:]] != lists[order[:-1]]) | (same[order[1:]] != same[order[:-1]])
        other = opens.copy()
        other[1:] |= ids[order[1:]] != ids[order[:-1]]
        order, opens = order[other], opens[other]
        start = np.maximum.accumulate(np.where(opens, np.arange(len(order)), 0))
        order = order[np.arange(len(order)) - start <= k]
        return order[np.lexsort((ids[order], lists[order]))]

    def part(asked: pd.DataFrame, lists: np.ndarray, ids: np.ndarray, x: np.ndarray, nx: np.ndarray) -> pd.DataFrame:
        own = asked["query_id"].to_numpy(np.int64)
        y = matrix(asked["embedding"])
        ny = np.linalg.norm(y, axis=1)
        wanted = np.concatenate(asked["lists"].to_numpy())
        asker = np.repeat(np.arange(len(asked)), asked["lists"].map(len))
        order = np.argsort(wanted, kind="stable")
        wanted, asker = wanted[order], asker[order]
        left, right = [], []
        for name in np.unique(wanted):
            a, b = np.searchsorted(lists, [name, name + 1])
            r = asker[slice(*np.searchsorted(wanted, [name, name + 1]))]
            if a == b:
                continue
            s = (y[r] @ x[a:b].T) / (ny[r][:, None] * nx[a:b])
            s[own[r][:, None] == ids[a:b]] = -np.inf
            first = np.flatnonzero(np.concatenate([[True], ids[a + 1 : b] != ids[a : b - 1]]))
            each = np.maximum.reduceat(s, first, axis=1)  # a repeated vec_id is one candidate
            last = -np.partition(-each, min(k, each.shape[1]) - 1, axis=1)[:, min(k, each.shape[1]) - 1]
            i, j = np.nonzero(np.isfinite(s) & (s >= last[:, None] - 1e-9))  # a little more than the best, so that no tie is lost
            left.append(r[i])
            right.append(a + j)
        left, right = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (left, right))
        exact = np.einsum("nd,nd->n", y[left], x[right]) / (ny[left] * nx[right])  # equal vectors get equal scores
        found = pd.DataFrame({"row": left, "query_id": own[left], "vec_id": ids[right], "score": exact})
        found = found.groupby(["row", "query_id", "vec_id"], as_index=False)["score"].max().sort_values(["row", "score", "vec_id"], ascending=[True, False, True])
        return found.groupby("row").head(k)[["query_id", "vec_id", "score"]]

    def score(asked: pd.DataFrame, member: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(member):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        x = matrix(member["embedding"])
        at = foremost(member, x)
        x, lists, ids = x[at], member["list"].to_numpy()[at], member["vec_id"].to_numpy(np.int64)[at]
        nx = np.linalg.norm(x, axis=1)
        return pd.concat([part(asked.iloc[q : q + QUERIES], lists, ids, x, nx) for q in range(0, len(asked), QUERIES)])

    return score


def neighbours(queries: DataFrame, vectors: DataFrame, k: int = 5, list_size: int = 256, replicas: int = 4, boundary: float = 1.2, recall: float = 0.95, probe: float | None = None, most_sample: int = 50_000) -> DataFrame:
    """The k nearest vectors found for each query by cosine in double precision, ties to smaller vec_id.

    queries and vectors: vec_id, embedding; other columns are not read. Returns query_id, rank (from 1), vec_id, score. A query's
    own id is no candidate. Rows with a null id and vectors that are null, zero, or hold null or non-finite components, or are of
    another dimension than most, take no part. Rows that repeat a vec_id count once, with their largest score; of repeated
    queries each row's neighbours are merged likewise. No vectors, or no queries: no rows. Centroids are fitted on at most
    most_sample vectors, and so is the ratio of distances within which a query reads lists: the least at which that share of
    true neighbours is found there (probe names a ratio instead). Of equal vectors in a list only those of the least ids are scored. Every vector is indexed, in up to replicas lists within
    the boundary ratio of its nearest centroid. There are at most 2**16 centroids, so beyond that lists grow; long lists are
    cut into blocks, and blocks are dealt to shards of at most about TILE_BYTES, which score a query once each.
    """
    spark = vectors.sparkSession
    ship(spark)
    tables = Tables(spark)
    v, dim = comparable(vectors)
    n = v.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    drawn = sample(v, n, most_sample, dim)
    graph = CentroidGraph(balanced(drawn, min(2**16, -(-n // list_size))))
    probe = probe_ratio(graph, drawn, k, replicas, boundary, recall) if probe is None else probe
    shared = spark.sparkContext.broadcast(graph)  # at most 2**16 centroids
    q, _ = comparable(queries)
    q = q.filter(F.size("embedding") == dim)
    member = tables.write(v.mapInArrow(_listed(shared, dim, number(v), boundary, replicas), f"list long, vec_id long, place long, embedding array<{number(v)}>"))
    sizes = member.groupBy("list").agg(F.count("*").alias("n")).toPandas()  # at most 2**16 lists
    blocks = np.ones(len(graph.c), np.int64)
    blocks[sizes["list"]] = -(-sizes["n"] // BLOCK)
    rows = max(1, TILE_BYTES // (8 * dim))
    shards = max(1, -(-int(sizes["n"].sum()) // rows))
    dealt = spark.createDataFrame(pd.DataFrame({"list": np.flatnonzero(blocks > 1), "blocks": blocks[blocks > 1]}), "list long, blocks long")
    block = F.pmod(F.xxhash64("vec_id", "place"), F.coalesce("blocks", F.lit(1)))  # rows of one id are spread too
    member = member.join(F.broadcast(dealt), "list", "left").withColumn("shard", shard_of(F.col("list"), block, shards))
    asked = q.mapInArrow(_asked(shared, spark.sparkContext.broadcast(blocks), shards, dim, number(q), probe), f"shard long, query_id long, embedding array<{number(q)}>, lists array<long>")
    asked = tables.write(asked)
    # a shard's queries are cut into parts as large as a shard, so that the fewest vectors are copied
    turns = F.broadcast(asked.groupBy("shard").agg(F.ceil(F.count("*") / rows).alias("turns")))  # one row a shard
    asked = asked.join(turns, "shard").withColumn("turn", F.pmod(F.xxhash64("query_id"), "turns"))
    member = member.join(turns, "shard").withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)))
    asked, member = asked.select("shard", "turn", "query_id", "embedding", "lists"), member.select("shard", "turn", "list", "vec_id", "embedding")
    found = asked.groupBy("shard", "turn").cogroup(member.groupBy("shard", "turn")).applyInPandas(lambda a, m: _nearest(k)(a, m), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
