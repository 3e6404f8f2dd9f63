"""Vectors as numpy rows: which rows can be compared, balanced centroids, cosines in double precision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoloom.llm.shared import ship


def rows_of(column: pa.Array, dim: int) -> np.ndarray:
    """A list column without nulls, each list of dim numbers, as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that their largest component is from 0.5 to 1: no digit is lost, and squares neither
    overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def number(vectors: DataFrame) -> str:
    """The type in which components are shipped: float where they are floats, so nothing is lost, else double."""
    return "float" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "double"


def shipped(rows: np.ndarray, kind: str) -> pa.ListArray:
    """Rows of doubles as a list column of a type that holds them."""
    flat = pa.array(rows.ravel().astype(np.float32 if kind == "float" else np.float64))
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, max(1, rows.shape[1])), pa.int32()), flat)


def comparable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, embedding) of the rows that can be compared, and their dimension: the id is not null; the vector is not null, not
    all zero, without null or non-finite components, and of the most frequent dimension (the smallest of several)."""
    ship(vectors.sparkSession)
    x = F.col("embedding")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{number(vectors)}>").alias("embedding")).filter(F.col("vec_id").isNotNull() & x.isNotNull()).filter(fine)
    top = v.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = top["dim"] if top else 0
    return v.filter(F.size("embedding") == dim), dim


def sample(v: DataFrame, count: int, most: int, dim: int, seed: int = 1) -> np.ndarray:
    """At most most unit vectors of the count rows of v. Rows are chosen one by one, whatever ids they share; of the few more that
    an even share can give the rest is left out."""
    if count > most:
        row = F.pmod(F.xxhash64(F.lit(seed), "vec_id", F.monotonically_increasing_id()), F.lit(2**40))
        v = v.filter(row < int(2**40 * most / count))
    table = v.select("embedding").toArrow()[:most]
    return unit(rows_of(table.column(0).combine_chunks(), dim)).astype(np.float32) if table.num_rows else np.zeros((0, dim), np.float32)


def balanced(x: np.ndarray, lists: int, seed: int = 1) -> np.ndarray:
    """Unit centroids of a power of two of groups, at least lists if there are rows enough: every group is halved at the median
    along the line between the means of its two parts, so all groups of the sample are equally large."""
    rng = np.random.default_rng(seed)
    groups = [np.arange(len(x))]
    while len(groups) < lists and min(map(len, groups)) >= 4:
        halves = []
        for g in groups:
            y = x[g]
            a = y[rng.integers(len(y))]
            b = y[np.argmin(y @ a)]
            for _ in range(4):
                s = y @ (a - b)
                left = s > np.median(s)
                if left.all() or not left.any():
                    break
                a, b = y[left].mean(0), y[~left].mean(0)
            order = np.argsort(y @ (a - b), kind="stable")
            halves += [g[order[: len(g) // 2]], g[order[len(g) // 2 :]]]
        groups = halves
    c = np.stack([x[g].astype(np.float64).mean(0) for g in groups])
    return unit(np.where(np.abs(c).sum(1, keepdims=True) > 0, c, 1.0)).astype(np.float32)


def batch_rows(it: Iterator[pa.RecordBatch], dim: int, size: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and rows of the batches' columns vec_id and embedding."""
    for b in it:
        for k in range(0, b.num_rows, size):
            part = b.slice(k, size)
            yield part.column("vec_id").to_numpy(), rows_of(part.column("embedding"), dim)
