"""Concepts with the same links are walked once, and each still gets its own ways."""

from __future__ import annotations

import random

from ontoloom.operators import graph as ops
from ontoloom.sources.model import EDGE, Graph

#: Leaves 10 to 15 in two kinds, a diamond above, a cycle of 3 and 4 with the leaf 20 below it, and 30, which nothing leads to or from.
LINKS = [(10, 1), (10, 2), (11, 2), (11, 1), (12, 1), (13, 1), (14, 1), (15, 2), (15, 1), (1, 5), (2, 5), (5, 6), (20, 3), (3, 4), (4, 3), (4, 6)]
IDS = [1, 2, 3, 4, 5, 6, *range(10, 16), 20, 30]


def _graph(spark, links):
    edges = [(k, a, "14", b, 1 + k % 2, None, "ok") for k, (a, b) in enumerate([*links, *links[:3]])]
    return Graph(spark, spark.createDataFrame([(i,) for i in IDS], "id long"), None, spark.createDataFrame(edges, EDGE), None, None, None)


def test_one_of_each_kind_is_walked(spark):
    step = spark.createDataFrame(LINKS, "a long, b long")
    kinds = {r["id"]: r["kind"] for r in ops.alike(step, spark.createDataFrame([(i,) for i in IDS], "id long")).collect()}
    assert kinds == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 10: 10, 11: 10, 12: 12, 13: 12, 14: 12, 15: 10, 20: 20}


def test_all_reach_what_each_reaches_alone(spark):
    rng = random.Random(7)
    for links, most in ((LINKS, None), (LINKS, 2), ([(rng.choice(IDS), rng.choice(IDS)) for _ in range(25)], None)):
        step, seeds = spark.createDataFrame(links, "a long, b long"), spark.createDataFrame([(i,) for i in [*IDS, 10]], "id long")
        want = {tuple(r) for r in ops.reach(step, seeds.selectExpr("id as seed", "id as node"), most).collect()}
        got = [tuple(r) for r in ops.reach_all(step, seeds, most).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_trees_by_simple_paths(spark):
    g = _graph(spark, LINKS)
    e = [(r["subject"], r["target"], r["context"]) for r in g.edge.collect()]

    def walk(root, node, path, depth):
        for s, t, c in e:
            if s == node and t not in path and depth <= 4:
                yield root, node, t, c, depth
                yield from walk(root, t, [*path, t], depth + 1)

    want = {row for i in IDS for row in walk(i, i, [i], 1)}
    got = [tuple(r) for r in ops.tree_up(g, g.concept, 4).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    deepest = {}
    for root, _, t, _, depth in want:
        deepest[root, t] = max(depth, deepest.get((root, t), 0))
    assert {(r["root"], r["node"]): r["level"] for r in ops.ancestor_layers(g, g.concept, 4).collect()} == deepest


def test_trees_of_a_graph_without_links(spark):
    g = _graph(spark, [])
    assert ops.tree_up(g, g.concept).count() == ops.ancestor_layers(g, g.concept).count() == 0


def test_least_paths_of_all(spark):
    rng = random.Random(11)
    for links in (LINKS, [(rng.choice(IDS), rng.choice(IDS)) for _ in range(25)]):
        step = spark.createDataFrame([(a, b, 100 - k) for k, (a, b) in enumerate([*links, *links[:5]])], "a long, b long, e long")
        seeds = spark.createDataFrame([(i,) for i in IDS], "id long")
        seen = lambda df: sorted((r["seed"], r["node"], r["depth"], tuple(r["edges"])) for r in df.collect())
        assert seen(ops.all_least_paths(step, seeds)) == seen(ops.least_paths(step, seeds))


def test_ends_without_concepts(spark):
    from ontoloom.operators import audit

    g = _graph(spark, [(10, 1), (10, 77), (78, 1), (78, 77)])
    want = sorted((r["subject"], r["target"]) for r in g.edge.collect() if {77, 78} & {r["subject"], r["target"]})
    assert sorted((r["subject"], r["target"]) for r in audit.dangling(g).collect()) == want
