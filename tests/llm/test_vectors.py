"""Nearest neighbours and embedding near-dedup against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from ontoloom.llm import ann, embedding_dups, vectors
from tests.llm.test_text_dedup import roots

SCHEMA = "vec_id long, embedding array<float>, label int, score string, list string, home string"


def made(n: int, dim: int = 16, seed: int = 5) -> list[tuple]:
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for k in range(0, n // 3, 2):
        x[k + n // 2] = x[k] + rng.normal(size=dim) * rng.choice([0.02, 0.2, 0.4])
    x[n - 40 :] = x[0] + rng.normal(size=(40, dim)) * 0.05
    x[n - 30 : n - 20] = x[1]
    return [(i, r.astype(np.float32).tolist(), 0, "s", "l", "h") for i, r in enumerate(x)]


AWKWARD = [(None, [1.0] * 16), (9001, None), (9002, [0.0] * 16), (9003, [float("nan")] + [1.0] * 15), (9004, [float("inf")] + [1.0] * 15), (9005, [None] + [1.0] * 15), (9006, [1.0, 2.0]), (9007, [])]


@pytest.fixture(scope="module")
def table(spark):
    rows = made(700) + [(i, v, 0, "s", "l", "h") for i, v in AWKWARD]
    return spark.createDataFrame(rows, SCHEMA).repartition(4), np.array([r[1] for r in made(700)], np.float32).astype(float)


def test_linked_bounds_are_rigorous():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 24))
    y = np.vstack([x[:150] + rng.normal(size=(150, 24)) * 0.3, rng.normal(size=(150, 24)) * 1e-30 + 1e-25, ])
    cos = (x @ y.T) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1))
    for t in (0.9, 0.95, 0.99):
        assert set(zip(*embedding_dups.linked(x, y, t), strict=True)) == set(zip(*np.nonzero(cos >= t), strict=True))


@pytest.mark.parametrize("cell_size,tile", [(512, 2048), (20, 7)])
def test_near_dedup(table, monkeypatch, cell_size, tile):
    monkeypatch.setattr(embedding_dups, "TILE", tile)
    df, x = table
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    root = roots(range(len(x)), zip(*np.nonzero(link), strict=True))
    out = embedding_dups.near(df, 0.95, cell_size=cell_size).collect()
    assert len(out) == len(x) + len(AWKWARD)
    for r in out:
        i = r["vec_id"]
        if i is not None and i < 9000:
            assert (r["n_links"], r["component_id"], r["kept"]) == (link[i].sum(), root[i], root[i] == i)
        else:
            assert (r["n_links"], r["component_id"]) == (0, i)


def test_near_dedup_empty(table):
    df, _ = table
    assert embedding_dups.near(df.limit(0)).collect() == []
    assert embedding_dups.near(df.filter("vec_id > 9000")).count() == 7


def test_neighbours(table):
    df, x = table
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = ann.neighbours(df.filter("vec_id % 50 = 0 or vec_id > 9000"), df, k=5, list_size=32).collect()
    hits = total = 0
    for q in range(0, len(x), 50):
        got = sorted((r["rank"], r["vec_id"], r["score"]) for r in out if r["query_id"] == q)
        assert [g[0] for g in got] == [1, 2, 3, 4, 5]
        s = u @ u[q]
        s[q] = -2
        assert all(g[2] == pytest.approx(s[g[1]], abs=1e-12) for g in got)
        assert got == sorted(got, key=lambda g: (-g[2], g[1]))
        want = np.lexsort((np.arange(len(s)), -s))[:5]
        hits, total = hits + len(set(want) & {g[1] for g in got}), total + 5
    assert hits / total >= 0.9
    assert {r["query_id"] for r in out} == set(range(0, len(x), 50))


def test_neighbours_empty_and_few(table, spark):
    df, _ = table
    assert ann.neighbours(df, df.limit(0)).collect() == []
    assert ann.neighbours(df.limit(0), df).collect() == []
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (2, [1.0, 0.1]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.neighbours(few, few).collect())
    assert got == [(1, 1, 2), (1, 2, 3), (2, 1, 1), (2, 2, 3), (3, 1, 2), (3, 2, 1)]


def test_neighbours_of_copies(spark, monkeypatch):
    """Most vectors are equal, most rows have one id, in blocks and tiles of few rows: the least ids of equal vectors come first."""
    monkeypatch.setattr(ann, "BLOCK", 16)
    monkeypatch.setattr(ann, "QUERIES", 3)
    monkeypatch.setattr(ann, "TILE_BYTES", 8 * 4 * 20)
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(120)] + [(7, v) for v in rng.normal(size=(200, 4)).tolist()] + [(500 + i, [2.0, 4.0, 6.0, 8.0]) for i in range(9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    out = ann.neighbours(df.filter("vec_id in (0, 50, 503)"), df, list_size=32).collect()
    got = {q: [r["vec_id"] for r in sorted(out, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 50, 503)}
    assert got == {0: [1, 2, 3, 4, 5], 50: [0, 1, 2, 3, 4], 503: [0, 1, 2, 3, 4]}


@pytest.mark.parametrize("most_sample", [50_000, 1_500])
def test_neighbours_by_lists(spark, most_sample):
    """On the table, which has hardly any clusters: recall by brute force, and what a query reads, whether the sample is all of it or a part."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.select("vec_id", "embedding").orderBy("vec_id").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = ann.neighbours(df.filter("vec_id % 50 = 0"), df, most_sample=most_sample).collect()
    hits = total = 0
    for k in np.flatnonzero(ids % 50 == 0):
        s = u @ u[k]
        s[k] = -2
        want = ids[np.lexsort((ids, -s))[:5]]
        hits, total = hits + len(set(want) & {r["vec_id"] for r in out if r["query_id"] == ids[k]}), total + 5
    assert hits / total >= 0.9 and len(out) == total
    graph = ann.CentroidGraph(vectors.balanced(u.astype(np.float32), -(-len(u) // 256)))
    ratio = ann.probe_ratio(graph, u.astype(np.float32), 5, 4, 1.2, 0.95)
    row, _ = graph.within(u[::50].astype(np.float32), ratio)
    assert len(row) < 0.5 * len(u[::50]) * len(graph.c)


def test_neighbours_in_small_shards(table, monkeypatch):
    df, _ = table
    ask = lambda: sorted(tuple(r) for r in ann.neighbours(df.filter("vec_id % 50 = 0"), df, list_size=32).collect())
    want = ask()
    monkeypatch.setattr(ann, "TILE_BYTES", 8 * 16 * 100)
    monkeypatch.setattr(ann, "BLOCK", 10)
    monkeypatch.setattr(ann, "QUERIES", 3)
    got = ask()
    assert [r[:3] for r in got] == [r[:3] for r in want] and [r[3] for r in got] == pytest.approx([r[3] for r in want], abs=1e-15)


def test_huge_and_tiny_components(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e200, 2e200]), (3, [1e-300, 1.1e-300]), (4, [-1e300, 5e-324])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in ann.neighbours(df, df).collect()}
    assert got[1, 1] == (3, pytest.approx(2.1 / np.sqrt(2 * 2.21))) and got[1, 2] == (2, pytest.approx(3 / np.sqrt(10))) and got[4, 3][0] == 1
    near = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dups.near(df, 0.95).collect()}
    assert near == {1: (1, 1), 2: (1, 1), 3: (2, 1), 4: (0, 4)}  # 2 and 3 have a cosine of 0.963, 1 and 2 of 0.949


def test_samples_are_bounded(spark):
    """One id on all rows is no way past the bound."""
    df = spark.createDataFrame([(7, [float(i), 1.0]) for i in range(3000)], "vec_id long, embedding array<double>").repartition(3)
    got = vectors.sample(df, 3000, 500, 2)
    assert 300 < len(got) <= 500


def test_centroid_graph_finds_the_nearest():
    rng = np.random.default_rng(3)
    c = rng.normal(size=(500, 8)).astype(np.float32)
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    q = c[:50] + rng.normal(size=(50, 8)).astype(np.float32) * 0.1
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    ids, dist = ann.CentroidGraph(c).search(q, 32)
    assert (ids[:, 0] == np.argmax(q @ c.T, axis=1)).mean() > 0.95
    assert (np.diff(dist, axis=1) >= 0).all()


@pytest.mark.parametrize(
    "rows,want",
    [
        ("1A 1B 2A 5A 3C", {1: 3, 2: 2, 5: 2, 3: 1}),
        ("0B 1A 1B 3C", {0: 2, 1: 2, 3: 2}),
    ],
)
def test_near_counts_by_class(spark, rows, want):
    """Of rows that repeat a vec_id with different vectors each counts as a vector; links are those of its own class (C is near B)."""
    made = {"A": [1.0, 0.0, 0.0], "B": [0.0, 1.0, 0.0], "C": [0.0, 1.0, 0.1]}
    df = spark.createDataFrame([(int(r[0]), made[r[1]]) for r in rows.split()], "vec_id long, embedding array<float>")
    assert {r["vec_id"]: r["n_links"] for r in embedding_dups.near(df, 0.95).collect()} == want
