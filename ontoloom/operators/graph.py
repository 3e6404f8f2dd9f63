"""Navigation, closures, witness paths, trees and components over typed edges.

Loops are semi-naive: each round joins only the pairs found in the round before, drops what is known by an anti-join, and
writes the new pairs to the shared folder. They end on cycles, and lineage never grows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ontoloom.plans.tables import materialized
from ontoloom.sources.model import COEXTENSION, GENUS, Graph


def reach(step: DataFrame, start: DataFrame, most: int | None = None, few: bool = False) -> DataFrame:
    """start (seed, node), step (a, b) -> all (seed, node, depth) with the least number of steps. few: little is reached, so rounds read the
    steps where they are instead of a copy."""
    step = step.select("a", "b")
    step = step if few else materialized(step)  # every round reads it
    known = [materialized(start.select("seed", "node").distinct().withColumn("depth", F.lit(0).cast("long")))]
    depth = 0
    while most is None or depth < most:
        depth += 1
        seen = reduce(DataFrame.union, known).select("seed", "node")
        new = known[-1].join(step, F.col("node") == F.col("a")).select("seed", F.col("b").alias("node")).distinct()
        new = materialized(new.join(seen, ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth).cast("long")))
        if new.isEmpty():
            break
        known.append(new)
    return reduce(DataFrame.union, known)


def alike(step: DataFrame, seeds: DataFrame) -> DataFrame:
    """step (a, b, more), seeds (id) to (id, kind) of the seeds that have steps: the least seed with the same steps, whose ways are theirs but for
    the first node. A seed that some step leads to is its own kind, as a way may come back to it."""
    own = step.join(seeds.select(F.col("id").alias("a")), "a", "left_semi").groupBy("a").agg(F.array_sort(F.collect_set(F.struct(*[c for c in step.columns if c != "a"]))).alias("steps"))
    own = materialized(own.join(step.select(F.col("b").alias("a"), F.lit(True).alias("inner")).distinct(), "a", "left"))
    first = own.filter("inner is null").groupBy("steps").agg(F.min("a").alias("first"))
    return materialized(own.join(first, "steps", "left").select(F.col("a").alias("id"), F.when(F.col("inner"), F.col("a")).otherwise(F.col("first")).alias("kind")))


def reach_all(step: DataFrame, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """step (a, b), seeds (id) -> (seed, node, depth) as ``reach`` gives it from every seed. Rounds run for one seed of each kind, and what it
    reaches is then given to all of the kind."""
    kinds = alike(step, seeds)
    walked = kinds.filter("id = kind").select(F.col("kind").alias("seed"), F.col("kind").alias("node"))
    above = materialized(reach(step, walked, most).filter("depth > 0").withColumnRenamed("seed", "kind"))
    mine = seeds.select(F.col("id").alias("seed"), F.col("id").alias("node"), F.lit(0).cast("long").alias("depth")).distinct()
    return mine.union(kinds.withColumnRenamed("id", "seed").join(above, "kind").select("seed", "node", "depth"))


def genus_step(g: Graph, context: int) -> DataFrame:
    return g.code(context, GENUS).select(F.col("subject").alias("a"), F.col("target").alias("b")).distinct()


def closure(g: Graph, context: int = 1) -> DataFrame:
    """Reflexive genus closure of a context: (descendant, ancestor) for every concept. Written once a session."""
    if ("closure", context) not in g.kept:
        all_ = reach_all(genus_step(g, context), g.concept.select("id"))
        g.kept["closure", context] = materialized(all_.select(F.col("seed").alias("descendant"), F.col("node").alias("ancestor")))
    return g.kept["closure", context]


def _extent_links(g: Graph, context: int) -> DataFrame:
    """From a concept to what its extent holds next: down genus links, both ways over coextension; links may stand twice."""
    down = g.code(context, GENUS).select(F.col("target").alias("a"), F.col("subject").alias("b"))
    same = g.code(context, COEXTENSION)
    both = same.select(F.col("subject").alias("a"), F.col("target").alias("b")).union(same.select(F.col("target").alias("a"), F.col("subject").alias("b")))
    return down.union(both)


def extent_step(g: Graph, context: int) -> DataFrame:
    """Each link of ``_extent_links`` once."""
    return _extent_links(g, context).distinct()


def extents(g: Graph, seeds: DataFrame, context: int = 1) -> DataFrame:
    """seeds (id) to (seed, id): every member of each seed's extent."""
    return reach(extent_step(g, context), seeds.select(F.col("id").alias("seed"), F.col("id").alias("node"))).select("seed", F.col("node").alias("id"))


def holders(g: Graph, ids: DataFrame, context: int = 1) -> DataFrame:
    """ids (id) of few concepts to (id, seed): every concept whose extent holds them, found upwards from them."""
    up = _extent_links(g, context).select(F.col("b").alias("a"), F.col("a").alias("b"))
    return reach(up, ids.select(F.col("id").alias("seed"), F.col("id").alias("node")), few=True).select(F.col("seed").alias("id"), F.col("node").alias("seed"))


def merged_closure(g: Graph, most: int = 25) -> DataFrame:
    """The stored closure of all contexts: (ancestor, descendant, depth), no concept with itself, explicit negatives counted. Written once for a
    graph."""
    if ("merged", most) in g.kept:
        return g.kept["merged", most]
    step = g.edge.filter((F.col("status") == "ok") & (F.col("code") == GENUS)).select(F.col("subject").alias("a"), F.col("target").alias("b"))
    all_ = reach_all(step, g.concept.select("id"), most)
    g.kept["merged", most] = materialized(all_.filter("seed <> node").select(F.col("node").alias("ancestor"), F.col("seed").alias("descendant"), "depth"))
    return g.kept["merged", most]


def navigate(g: Graph, ids: DataFrame, op: str, context: int = 1) -> DataFrame:
    """parents, children, ancestors or descendants of a set (id); a seed is its own ancestor only by way of another seed."""
    if op in ("parents", "children"):
        own, other = ("subject", "target") if op == "parents" else ("target", "subject")
        e = g.code(context, GENUS).select(F.col(own).alias("id"), F.col(other).alias("found"))
    else:
        own, other = ("descendant", "ancestor") if op == "ancestors" else ("ancestor", "descendant")
        e = closure(g, context).filter("descendant <> ancestor").select(F.col(own).alias("id"), F.col(other).alias("found"))
    return e.join(ids.select("id"), "id", "left_semi").select(F.col("found").alias("id")).distinct()


def visible(g: Graph, context: int = 1, positive: bool = True) -> DataFrame:
    """(subject, code, target, id) of a context, symmetric codes in both directions."""
    e = g.scope(context, positive).select("subject", "code", "target", "id")
    symmetric = F.broadcast(g.rule.filter("mutual").select("code"))  # the grammar has a few dozen codes
    back = e.join(symmetric, "code", "left_semi").select(F.col("target").alias("subject"), "code", F.col("subject").alias("target"), "id")
    return e.union(back)


def project(g: Graph, code: str, ids: DataFrame, incoming: bool = False, context: int = 1) -> DataFrame:
    """related(code, S), or with incoming subjects(code, T): direct positive relations only."""
    own, other = ("target", "subject") if incoming else ("subject", "target")
    e = visible(g, context).filter(F.col("code") == code).select(F.col(own).alias("id"), F.col(other).alias("found"))
    return e.join(ids.select("id"), "id", "left_semi").select(F.col("found").alias("id")).distinct()


def witness_paths(g: Graph, context: int = 1, start: DataFrame | None = None, coextension: bool = False) -> DataFrame:
    """(subject, ancestor, depth, edges): for each pair the shortest path whose sequence of edge ids is least."""
    step = g.code(context, GENUS).select(F.col("subject").alias("a"), F.col("target").alias("b"), F.col("id").alias("e"))
    if coextension:
        step = step.union(coextension_steps(g, context))
    ways = all_least_paths(step, g.concept) if start is None else least_paths(step, start.select("id"))
    return ways.withColumnsRenamed({"seed": "subject", "node": "ancestor"})


def coextension_steps(g: Graph, context: int = 1) -> DataFrame:
    """(a, b, e) over coextension, both ways."""
    same = g.code(context, COEXTENSION).select(F.col("subject").alias("a"), F.col("target").alias("b"), F.col("id").alias("e"))
    return same.union(same.select("b", "a", "e"))


def least_paths(step: DataFrame, seeds: DataFrame) -> DataFrame:
    """step (a, b, e), seeds (id) to (seed, node, depth, edges): the shortest way to each node that has the least sequence of edge ids,
    compared from the seed on."""
    known = [materialized(seeds.select(F.col("id").alias("seed"), F.col("id").alias("node"), F.lit(0).cast("long").alias("depth"), F.expr("cast(array() as array<long>)").alias("edges")))]
    while True:
        seen = reduce(DataFrame.union, known).select("seed", "node")
        new = known[-1].join(step, F.col("node") == F.col("a")).groupBy("seed", F.col("b").alias("node")).agg(F.min(F.concat("edges", F.array("e"))).alias("edges"))
        new = materialized(new.join(seen, ["seed", "node"], "left_anti").select("seed", "node", F.lit(len(known)).cast("long").alias("depth"), "edges"))
        if new.isEmpty():
            return reduce(DataFrame.union, known)
        known.append(new)


def all_least_paths(step: DataFrame, seeds: DataFrame) -> DataFrame:
    """What ``least_paths`` gives, for many seeds: rounds run from nodes that a step leads to. The least way from another seed is one of its steps
    and the least way from there, so all of those come of one join."""
    step = materialized(step)
    inner = materialized(step.select(F.col("b").alias("id")).distinct())
    above = materialized(least_paths(step.join(inner.toDF("a"), "a", "left_semi").select("a", "b", "e"), inner))
    own = step.join(inner.toDF("a"), "a", "left_anti").join(seeds.select(F.col("id").alias("a")), "a", "left_semi")
    ways = own.join(above.withColumnRenamed("seed", "b"), "b").groupBy("a", "node").agg(F.min(F.struct((F.col("depth") + 1).alias("depth"), F.concat(F.array("e"), "edges").alias("edges"))).alias("m"))
    mine = seeds.select("id").distinct().join(inner, "id", "left_anti").select(F.col("id").alias("seed"), F.col("id").alias("node"), F.lit(0).cast("long").alias("depth"), F.expr("cast(array() as array<long>)").alias("edges"))
    held = above.join(seeds.select(F.col("id").alias("seed")), "seed", "left_semi").select("seed", "node", "depth", "edges")
    return mine.union(held).union(ways.select(F.col("a").alias("seed"), "node", F.col("m.depth").alias("depth"), F.col("m.edges").alias("edges")))


def edge_records(g: Graph, ids: list[int], codes: tuple[str, ...] = ()) -> list[dict]:
    """The named edges in the given order, as records of id, subject, code, target, context and strength. For paths and evidence of
    one concept, which are few. codes: those that the edges can have, if not all, so that no others are read."""
    e = g.edge.filter(F.col("code").isin(*codes)) if codes else g.edge
    found = {r["id"]: r.asDict() for r in e.filter(F.col("id").isin(*ids)).drop("status").collect()} if ids else {}
    return [found[i] for i in ids]


def verify(g: Graph, pairs: DataFrame) -> DataFrame:
    """pairs (a, b) to (a, b, verdict, depth): yes (a lies below b), reverse, direct (any accepted relation either way), indirect
    (one concept between), no; unknown if either is no concept. Contexts are merged."""
    known = merged_closure(g)
    ids = g.concept.select("id")
    p = pairs.select("a", "b").distinct()
    real = materialized(p.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi"))
    up = real.join(known.select(F.col("descendant").alias("a"), F.col("ancestor").alias("b"), "depth"), ["a", "b"]).select("a", "b", F.lit(1).alias("k"), "depth")
    down = real.join(known.select(F.col("ancestor").alias("a"), F.col("descendant").alias("b"), "depth"), ["a", "b"]).select("a", "b", F.lit(2).alias("k"), "depth")
    e = g.edge.filter("status = 'ok'").select("subject", "target")
    near = e.union(e.select("target", "subject"))  # links that stand twice do no harm below
    to_b = materialized(near.toDF("m", "b").join(real.select("b").distinct(), "b", "left_semi").distinct())
    direct = real.join(to_b.toDF("b", "a"), ["a", "b"]).select("a", "b", F.lit(3).alias("k"), F.lit(1).cast("long").alias("depth"))
    # a middle that leads to no asked end is dropped before pairs are made
    from_a = near.toDF("a", "m").join(real.select("a").distinct(), "a", "left_semi").join(to_b.select("m").distinct(), "m", "left_semi")
    indirect = real.join(from_a, "a").join(to_b, ["m", "b"]).select("a", "b", F.lit(4).alias("k"), F.lit(2).cast("long").alias("depth"))
    none = real.select("a", "b", F.lit(5).alias("k"), F.lit(None).cast("long").alias("depth"))
    best = up.union(down).union(direct).union(indirect).union(none).groupBy("a", "b").agg(F.min(F.struct("k", "depth")).alias("m"))
    verdict = F.when(F.col("k") == 1, "yes").when(F.col("k") == 2, "reverse").when(F.col("k") == 3, "direct").when(F.col("k") == 4, "indirect").when(F.col("k") == 5, "no").otherwise("unknown")
    best = best.select("a", "b", F.col("m.k").alias("k"), F.col("m.depth").alias("depth"))
    return p.join(best, ["a", "b"], "left").select("a", "b", verdict.alias("verdict"), "depth")


def tree_up(g: Graph, ids: DataFrame, most: int = 10) -> DataFrame:
    """(root, node, parent, context, depth): ancestor trees by simple paths, with the context of each link."""
    kinds, trees = _trees_up(g, ids, most)
    whole = kinds.withColumnRenamed("id", "root").join(trees, "kind")
    return whole.select("root", F.when(F.col("node") == F.col("kind"), F.col("root")).otherwise(F.col("node")).alias("node"), "parent", "context", "depth")


def _trees_up(g: Graph, ids: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(id, kind) as ``alike`` tells kinds, and (kind, node, parent, context, depth): the ancestor tree of one concept of each kind. Concepts of a
    kind have the same tree but for the node at its bottom."""
    e = g.edge.filter((F.col("status") == "ok") & (F.col("code") == GENUS)).select(F.col("subject").alias("node"), F.col("target").alias("parent"), "context")
    kinds = alike(e.toDF("a", "b", "context"), ids)
    level = kinds.filter("id = kind").select(F.col("kind").alias("root"), F.col("kind").alias("node"), F.array("kind").alias("path"))
    out = [level.select(F.col("root").alias("kind"), "node", F.col("node").alias("parent"), F.col("node").alias("context"), F.lit(0).cast("long").alias("depth")).limit(0)]
    for depth in range(1, most + 1):
        step = level.join(e, "node").filter(~F.array_contains("path", F.col("parent")))
        step = materialized(step.select("root", "node", "parent", "context", F.lit(depth).cast("long").alias("depth"), F.concat("path", F.array("parent")).alias("path")))
        if step.isEmpty():
            break
        out.append(step.select(F.col("root").alias("kind"), "node", "parent", "context", "depth"))
        level = step.select("root", F.col("parent").alias("node"), "path").distinct()
    return kinds, materialized(reduce(DataFrame.union, out).distinct())


def tree_down(g: Graph, ids: DataFrame, most: int = 3, children: int = 200) -> DataFrame:
    """(root, parent, node, depth): descendant trees by levels; a node appears once, under its least parent of the first level
    that reaches it; of each parent the first children by (own children descending, id)."""
    e = g.edge.filter((F.col("status") == "ok") & (F.col("code") == GENUS)).select(F.col("target").alias("parent"), F.col("subject").alias("node")).distinct()
    size = e.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n"))
    e = e.join(size, "node", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    e = e.withColumn("k", F.row_number().over(Window.partitionBy("parent").orderBy(F.desc("n"), "node"))).filter(F.col("k") <= children).select("parent", "node")
    level = ids.select(F.col("id").alias("root"), F.col("id").alias("node"))
    seen, out = level, []
    for depth in range(1, most + 1):
        step = level.withColumnRenamed("node", "parent").join(e, "parent").groupBy("root", "node").agg(F.min("parent").alias("parent"))
        step = materialized(step.join(seen, ["root", "node"], "left_anti").select("root", "parent", "node", F.lit(depth).cast("long").alias("depth")))
        out.append(step)
        level = step.select("root", "node")
        seen = seen.union(level)
    return reduce(DataFrame.union, out)


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) to (id, component): the least node that links reach; labels flow to the least neighbour and jump to their
    label's label until nothing moves."""
    both = materialized(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    label = materialized(both.select(F.col("a").alias("id")).distinct().withColumn("component", F.col("id")))
    while True:
        near = both.join(label.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m"))
        low = label.join(near, "id").select("id", F.least("component", "m").alias("component"))
        jump = low.select(F.col("id").alias("component"), F.col("component").alias("up"))
        new = materialized(low.join(jump, "component", "left").select("id", F.least("component", F.coalesce("up", "component")).alias("component")))
        if new.join(label, ["id", "component"], "left_anti").isEmpty():
            return new
        label = new


def neighbours(g: Graph) -> DataFrame:
    """(id, other, links): accepted links between two concepts in either direction, any code, any context."""
    e = g.edge.filter("status = 'ok' and subject <> target").select(F.col("subject").alias("id"), F.col("target").alias("other"))
    return e.union(e.select("other", "id")).groupBy("id", "other").agg(F.count("*").alias("links"))


def home_parent(g: Graph) -> DataFrame:
    """(id, parent): the genus whose edge is in the concept's home context, else the first by edge id."""
    e = g.edge.filter((F.col("status") == "ok") & (F.col("code") == GENUS)).select(F.col("id").alias("e"), "subject", "target", F.col("context").alias("c"))
    j = e.join(g.concept.select(F.col("id").alias("subject"), "context"), "subject")
    return j.groupBy(F.col("subject").alias("id")).agg(F.min_by("target", F.struct((F.col("c") != F.col("context")).alias("x"), "e")).alias("parent"))


def joined_ids(c: Column | str) -> Column:
    """An array of ids as text."""
    return F.array_join(F.transform(F.col(c) if isinstance(c, str) else c, lambda x: x.cast("string")), ",")


#: Views of a concept's relations by code (fixed ranges); negative: stated not to hold.
VIEWS = {"attributes": (15, 27), "logical": (30, 64), "causal": (70, 74)}


def relation_view(g: Graph, view: str) -> DataFrame:
    """Accepted edges of a view: attributes, logical, causal, negative or all."""
    e = g.edge.filter("status = 'ok'")
    if view == "all":
        return e
    if view == "negative":
        return e.filter("strength = 0")
    low, high = VIEWS[view]
    return e.filter(F.expr("try_cast(code as int)").between(low, high))


def ancestor_layers(g: Graph, ids: DataFrame, most: int = 10) -> DataFrame:
    """ids (id) to (root, node, level): all that lies above a concept, by the longest simple path that leads there."""
    kinds, trees = _trees_up(g, ids, most)
    layers = materialized(trees.groupBy("kind", F.col("parent").alias("node")).agg(F.max("depth").alias("level")))
    return kinds.withColumnRenamed("id", "root").join(layers, "kind").select("root", "node", "level")


def child_pages(g: Graph, size: int = 50) -> DataFrame:
    """(parent, node, page): the children of each concept in order of id, in pages from 0."""
    e = g.edge.filter((F.col("status") == "ok") & (F.col("code") == GENUS)).select(F.col("target").alias("parent"), F.col("subject").alias("node")).distinct()
    place = F.row_number().over(Window.partitionBy("parent").orderBy("node")) - 1
    return e.withColumn("page", F.floor(place / size).cast("long"))


def tree_view(g: Graph, ids: DataFrame, up: int = 10, down: int = 3) -> DataFrame:
    """(side, root, node, parent, depth): the trees above and below each concept in one table; side is up or down."""
    above = tree_up(g, ids, up).select(F.lit("up").alias("side"), "root", "node", "parent", "depth").distinct()
    return above.union(tree_down(g, ids, down).select(F.lit("down"), "root", "node", "parent", "depth"))
