"""Euler operators: pair kinds from stored relations, shared genera, membership regions and counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ontoloom.operators import graph as ops
from ontoloom.operators import terms
from ontoloom.plans.algebra import sampled
from ontoloom.plans.tables import materialized
from ontoloom.sources.model import COEXTENSION, GENUS, Graph

#: Sets of one diagram: a mask has a bit for each.
MOST = 16


def _upward(g: Graph, ids: DataFrame, context: int) -> tuple[DataFrame, DataFrame]:
    """(seed, id) reached by genus and coextension upwards, and by coextension alone."""
    same = g.code(context, COEXTENSION)
    both = same.select(F.col("subject").alias("a"), F.col("target").alias("b")).union(same.select("target", "subject"))
    up = g.code(context, GENUS).select(F.col("subject").alias("a"), F.col("target").alias("b")).union(both).distinct()
    start = ids.select(F.col("id").alias("seed"), F.col("id").alias("node"))
    return ops.reach(up, start).select("seed", F.col("node").alias("id")), ops.reach(both.distinct(), start).select("seed", F.col("node").alias("id"))


def pair_kinds(g: Graph, ids: list[int], context: int = 1) -> DataFrame:
    """(a, b, kind) for each two of the selected concepts, a < b: equal, conflict, inside, contains, overlap, disjoint or unknown.

    Overlap (40) passes along coextension only; exclusion (60, 64) passes down to whatever lies below its two ends. A stored
    relation that adds a kind to another makes a conflict.
    """
    if len(ids) > MOST:
        raise ValueError(f"at most {MOST} concepts")
    sel = g.spark.createDataFrame([(i,) for i in ids], "id long")
    up, same = _upward(g, sel, context)
    p = sel.toDF("a").join(sel.toDF("b"), F.expr("a < b"))  # of at most 16 rows
    flag = lambda df, name: df.select("a", "b").distinct().withColumn(name, F.lit(True))
    eq = flag(same.toDF("a", "b"), "eq")
    inside = flag(up.toDF("a", "b"), "ins")
    holds = flag(up.toDF("b", "a"), "con")

    def stated(codes: tuple[str, ...], reach_: DataFrame, name: str) -> DataFrame:
        e = g.scope(context).filter(F.col("code").isin(*codes)).select("subject", "target")
        e = e.union(e.select("target", "subject")).toDF("x", "y")
        return flag(e.join(reach_.toDF("a", "x"), "x").join(reach_.toDF("b", "y"), "y"), name)

    for extra in (eq, inside, holds, stated(("40",), same, "ovl"), stated(("60", "64"), up, "dis")):
        p = p.join(extra, ["a", "b"], "left")
    on: dict[str, Column] = {c: F.coalesce(c, F.lit(False)) for c in ("eq", "ins", "con", "ovl", "dis")}
    base = F.when(on["eq"], "equal").when(on["ins"] & on["con"], "conflict").when(on["ins"], "inside").when(on["con"], "contains")
    kind = F.when(base.isNotNull() & on["dis"], "conflict").when(base.isNotNull() & on["ovl"], "conflict").when(on["ovl"] & on["dis"], "conflict")
    return p.select("a", "b", kind.when(base.isNotNull(), base).when(on["ovl"], "overlap").when(on["dis"], "disjoint").otherwise("unknown").alias("kind"))


def shared_genera(g: Graph, ids: list[int], context: int = 1, most: int = 8) -> DataFrame:
    """(genus, members): direct genera of at least two selected concepts of which neither lies below the other; members counts the
    selected concepts that have it. Most members first, then by id.

    Concepts that coextension links are one: a concept has the genera of all that are equal to it, and a genus goes by the
    least id of those equal to it. A genus that is selected, or lies below a concept that has it, does not count. A broader
    genus goes if a narrower one has all its members."""
    sel = g.spark.createDataFrame([(i,) for i in dict.fromkeys(ids)], "id long")  # at most MOST rows
    up, same = _upward(g, sel, context)
    up = materialized(up)
    links = same.toDF("member", "subject").join(g.code(context, GENUS).select("subject", "target"), "subject").select("member", "target").distinct()
    links = materialized(links)
    _, aliases = _upward(g, links.select(F.col("target").alias("id")).distinct(), context)
    least = aliases.groupBy(F.col("seed").alias("target")).agg(F.min("id").alias("genus"))
    chosen = same.groupBy("seed").agg(F.min("id").alias("genus")).select("genus")
    has = materialized(links.join(least, "target").select("genus", "member").distinct().join(chosen, "genus", "left_anti"))
    above, _ = _upward(g, has.select(F.col("genus").alias("id")).distinct(), context)
    above = materialized(above.toDF("genus", "above"))
    has = materialized(has.join(above.select("genus", F.col("above").alias("member")), ["genus", "member"], "left_anti"))
    nested = up.toDF("member", "other")
    pairs = has.join(has.toDF("genus", "other"), "genus").filter("member <> other")  # members are at most MOST
    apart = pairs.join(nested, ["member", "other"], "left_anti").join(nested.toDF("other", "member"), ["member", "other"], "left_anti")
    found = materialized(has.join(apart.select("genus").distinct(), "genus", "left_semi"))
    size = found.groupBy("genus").agg(F.count("*").alias("members"))
    narrower = above.select(F.col("genus").alias("low"), F.col("above").alias("genus")).join(size, "genus").join(size.select(F.col("genus").alias("low")), "low").filter("low <> genus")
    narrower = narrower.join(above.toDF("genus", "low"), ["genus", "low"], "left_anti")  # neither of two on a cycle is broader
    shared = narrower.join(found, "genus").join(found.toDF("low", "member"), ["low", "member"]).groupBy("genus", "low", "members").agg(F.count("*").alias("both"))
    broader = shared.filter("both = members").select("genus").distinct()
    return size.join(broader, "genus", "left_anti").orderBy(F.desc("members"), "genus").limit(most)


def members(g: Graph, ids: list[int], context: int = 1) -> DataFrame:
    """(id, mask): of each concept in any of the sets, which sets hold it; bit k is the k-th set."""
    if len(ids) > MOST:
        raise ValueError(f"at most {MOST} sets")
    bit = reduce(lambda c, k: c.when(F.col("seed") == ids[k], 1 << k), range(len(ids)), F).cast("long")
    sel = g.spark.createDataFrame([(i,) for i in ids], "id long")
    real = ops.extents(g, sel, context).join(g.concept.select("id"), "id", "left_semi")
    return real.select("id", bit.alias("bit")).groupBy("id").agg(F.bit_or("bit").alias("mask"))


def catalog(g: Graph, ids: list[int], context: int = 1, sample: int = 6) -> DataFrame:
    """(mask, members, sample): each nonempty region with its first members."""
    return sampled(members(g, ids, context), "mask", sample)


def catalog_pairs(g: Graph, ids: list[int], context: int = 1) -> DataFrame:
    """(a, b, kind) by exact counts: disjoint, equal, inside, contains or overlap; empty sets are disjoint from all."""
    m = members(g, ids, context).groupBy("mask").agg(F.count("*").alias("n"))
    k = len(ids)
    p = g.spark.createDataFrame([(ids[i], ids[j], 1 << i, 1 << j) for i in range(k) for j in range(i + 1, k)], "a long, b long, x long, y long")
    on = lambda c: F.col("mask").bitwiseAND(F.col(c)) != 0
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    c = F.broadcast(p).crossJoin(m)  # at most 120 pairs with at most 2**16 masks
    s = c.groupBy("a", "b").agg(total(on("x") & on("y")).alias("both"), total(on("x") & ~on("y")).alias("left"), total(on("y") & ~on("x")).alias("right"))
    kind = F.when(F.col("both") == 0, "disjoint").when((F.col("left") == 0) & (F.col("right") == 0), "equal").when(F.col("left") == 0, "inside").when(F.col("right") == 0, "contains").otherwise("overlap")
    return s.select("a", "b", kind.alias("kind"), "both", "left", "right")


def region_operation(regions: DataFrame, op: str, bits: tuple[int, ...], universe: int | None = None) -> DataFrame:
    """(members) of a Boolean operation over the sets of the bits: intersection, union, difference (the first without the others),
    xor (exactly one), complement (of their union; universe: concepts in all), all or none."""
    on = [F.col("mask").bitwiseAND(F.lit(b)) != 0 for b in bits]
    any_, every = reduce(Column.__or__, on), reduce(Column.__and__, on)
    if op == "complement":
        return regions.agg((F.lit(universe) - F.coalesce(F.sum(F.when(any_, F.col("members"))), F.lit(0))).alias("members"))
    one = reduce(Column.__add__, [c.cast("int") for c in on]) == 1
    keep = {"intersection": every, "union": any_, "difference": on[0] & ~reduce(Column.__or__, on[1:], F.lit(False)), "xor": one, "all": F.lit(True), "none": F.lit(False)}[op]
    return regions.agg(F.coalesce(F.sum(F.when(keep, F.col("members"))), F.lit(0)).alias("members"))


def equal_groups(pairs: DataFrame) -> DataFrame:
    """(id, component) of concepts that a chain of equal pairs links."""
    return ops.components(pairs.filter("kind = 'equal'").select("a", "b"))


def enclosing(pairs: DataFrame) -> DataFrame:
    """(id, parent): the nearest set that holds a set: of all that hold it, the one that lies in all the others."""
    inside = pairs.filter("kind = 'inside'").select("a", "b").union(pairs.filter("kind = 'contains'").select("b", "a")).toDF("id", "parent")
    wider = inside.join(inside.toDF("inner", "parent"), "parent").join(inside.toDF("id", "inner"), ["id", "inner"]).select("id", "parent").distinct()
    return inside.join(wider, ["id", "parent"], "left_anti").groupBy("id").agg(F.min("parent").alias("parent"))


def set_counts(g: Graph, ids: list[int], context: int = 1) -> DataFrame:
    """(id, members) of each set, and of their union with a null id."""
    masks = members(g, ids, context).groupBy("mask").agg(F.count("*").alias("n"))
    sets = F.array(*[F.when(F.col("mask").bitwiseAND(F.lit(1 << k)) != 0, F.lit(i).cast("long")) for k, i in enumerate(ids)])
    each = masks.select(F.explode(F.array_compact(sets)).alias("id"), "n").groupBy("id").agg(F.sum("n").alias("members"))
    empty = g.spark.createDataFrame([(i,) for i in ids], "id long").join(each, "id", "left").select("id", F.coalesce("members", F.lit(0)).alias("members"))
    return empty.union(masks.agg(F.lit(None).cast("long").alias("id"), F.coalesce(F.sum("n"), F.lit(0)).alias("members")))


def nesting(pairs: DataFrame, most: int = MOST) -> DataFrame:
    """pairs (a, b, kind) to (id, level): how many sets stand around each, along the longest chain; 0 for outermost ones."""
    inside = pairs.filter("kind = 'inside'").select("a", "b").union(pairs.filter("kind = 'contains'").select("b", "a")).toDF("id", "outer")
    level = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct().withColumn("level", F.lit(0).cast("long"))
    for _ in range(most):  # a chain is no longer than there are sets
        higher = inside.join(level.withColumnRenamed("id", "outer"), "outer").groupBy("id").agg((F.max("level") + 1).alias("above"))
        new = materialized(level.join(higher, "id", "left").select("id", F.coalesce("above", F.lit(0)).cast("long").alias("level")))
        if new.exceptAll(level).isEmpty():
            break
        level = new
    return level


def requested(ids: list, most: int = 8, most_raw: int = 32) -> list[int]:
    """The distinct ids of a request in their order; refuses what is no positive whole number, and too many."""
    if len(ids) > most_raw or not all(type(i) is int and i > 0 for i in ids) or len(out := list(dict.fromkeys(ids))) > most:
        raise ValueError(f"a request names 1 to {most} concepts by positive ids, with repeats at most {most_raw}")
    return out


def _ways(g: Graph, ids: list[int], context: int) -> tuple[DataFrame, DataFrame]:
    """(seed, node, edges) upwards by genus and coextension, and by coextension alone."""
    sel = g.spark.createDataFrame([(i,) for i in ids], "id long")
    same = ops.coextension_steps(g, context)
    up = g.code(context, GENUS).select(F.col("subject").alias("a"), F.col("target").alias("b"), F.col("id").alias("e")).union(same)
    return materialized(ops.least_paths(up, sel).select("seed", "node", "edges")), materialized(ops.least_paths(same, sel).select("seed", "node", "edges"))


def evidence(g: Graph, ids: list[int], context: int = 1) -> DataFrame:
    """(a, b, kind, edges, inferred) for each two of the selected concepts, a < b: the ids of the edges that show the pair's kind.

    A way upwards is the shortest one of the least edge ids. Equal concepts are shown by the way over coextension, nested ones by the way
    up, a cycle by both. A stated relation (overlap, then exclusion) is shown by the way from a to one of its ends, the relation's edge, and
    the way from b to the other end: of all relations that apply the one of the least edge id, read forwards rather than backwards.
    inferred: more than one edge was needed, and they do not contradict each other."""
    kinds = pair_kinds(g, ids, context)
    up, same = _ways(g, ids, context)
    way = lambda ways, a, b, name: ways.select(F.col("seed").alias(a), F.col("node").alias(b), F.col("edges").alias(name))

    def stated(codes: tuple[str, ...], ways: DataFrame, name: str) -> DataFrame:
        e = g.scope(context).filter(F.col("code").isin(*codes)).select("id", "subject", "target")
        e = e.select("id", F.lit(0).alias("back"), F.col("subject").alias("x"), F.col("target").alias("y")).union(e.select("id", F.lit(1), "target", "subject"))
        met = e.join(way(ways, "a", "x", "up_a"), "x").join(way(ways, "b", "y", "up_b"), "y").filter("a < b")
        shown = F.concat("up_a", F.array("id"), "up_b")
        return met.groupBy("a", "b").agg(F.min_by(shown, F.struct("id", "back")).alias(name))

    p = kinds
    for extra in (way(same, "a", "b", "eq"), way(up, "a", "b", "above"), way(up, "b", "a", "below"), stated(("40",), same, "ovl"), stated(("60", "64"), up, "dis")):
        p = p.join(extra, ["a", "b"], "left")
    none = F.expr("cast(array() as array<long>)")
    base = F.when(F.col("eq").isNotNull(), F.col("eq")).otherwise(F.concat(F.coalesce("above", none), F.coalesce("below", none)))
    edges = F.concat(base, F.coalesce("ovl", none), F.coalesce("dis", none))
    return p.select("a", "b", "kind", edges.alias("edges"), ((F.size(edges) > 1) & (F.col("kind") != "conflict")).alias("inferred"))


def catalog_paths(g: Graph, ids: list[int], context: int = 1, sample: int = 6) -> DataFrame:
    """(mask, member, root, edges): for the first members of each region and each set that holds them the way from the member to the set's
    concept. It is looked for from the concept down, so of equally short ways the one whose edge ids are least from there counts."""
    m = materialized(members(g, ids, context))
    first = m.withColumn("k", F.row_number().over(Window.partitionBy("mask").orderBy("id"))).filter(F.col("k") <= sample).select("mask", F.col("id").alias("member"))
    down = g.code(context, GENUS).select(F.col("target").alias("a"), F.col("subject").alias("b"), F.col("id").alias("e"))
    real = g.concept.select(F.col("id").alias("b"))
    step = down.union(ops.coextension_steps(g, context)).join(real, "b", "left_semi").select("a", "b", "e")
    ways = ops.least_paths(step, g.spark.createDataFrame([(i,) for i in ids], "id long"))
    return first.join(ways.select(F.col("seed").alias("root"), F.col("node").alias("member"), F.reverse("edges").alias("edges")), "member").select("mask", "member", "root", "edges")


def assembled(g: Graph, ids: list, context: int = 1, catalog_basis: bool = False, lang: str = "en", most: int = 8) -> DataFrame:
    """The answer to a request for a diagram as one table (part, place, a, b, label, n, edges):

    concept: a selected or added concept with its label, in order; missing: an id that no concept has; automatic: a shared genus that was
    added, with the number of selected concepts that have it; omitted: how many more shared genera there are; pair: two concepts with their
    kind as label, n = 1 if it is inferred, and the edges that show it; with catalog_basis, region: a mask (a) with its members (n) and
    the first of them as edges, and member: a region's sample member (a) below a concept (b) with its way up. Ids are refused as in
    ``requested``; pairs are of concepts that are there, at most twice ``most``."""
    ids = requested(ids, most)
    sel = g.spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "a long, place int")
    genera = materialized(shared_genera(g, ids, context, 10**6))
    added = [(r["genus"], r["members"]) for r in genera.orderBy(F.desc("members"), "genus").limit(most).collect()]  # at most eight
    automatic = g.spark.createDataFrame([(i, n, len(ids) + k) for k, (i, n) in enumerate(added)], "a long, n long, place int")
    labels = terms.display(g, lang).select(F.col("id").alias("a"), "label")
    there = materialized(sel.union(automatic.select("a", "place")).join(labels, "a"))  # at most sixteen rows
    known = [r["a"] for r in there.orderBy("place").collect()]
    empty, text, zero = F.expr("cast(array() as array<long>)").alias("edges"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("long")
    row = lambda df, part, place, a, b, label, n, edges: df.select(F.lit(part).alias("part"), place.cast("int").alias("place"), a.alias("a"), b.alias("b"), label, n.cast("long").alias("n"), edges)
    at, a = F.col("place"), F.col("a")
    parts = [
        row(there, "concept", at, a, zero, F.col("label"), zero, empty),
        row(sel.join(there.select("a"), "a", "left_anti"), "missing", at, a, zero, text, zero, empty),
        row(automatic.join(there.select("a"), "a", "left_semi"), "automatic", at, a, zero, text, F.col("n"), empty),
        row(genera.agg(F.greatest(F.count("*") - most, F.lit(0)).alias("n")), "omitted", F.lit(0), zero, zero, text, F.col("n"), empty),
    ]
    if known:
        parts.append(row(evidence(g, known, context), "pair", F.lit(0), a, F.col("b"), F.col("kind").alias("label"), F.col("inferred").cast("long"), F.col("edges")))
    if catalog_basis and known:
        first = F.transform(F.filter(F.split("sample", ","), lambda x: x != ""), lambda x: x.cast("long")).alias("edges")
        parts.append(row(catalog(g, known, context), "region", F.lit(0), F.col("mask"), zero, text, F.col("members"), first))
        parts.append(row(catalog_paths(g, known, context), "member", F.lit(0), F.col("member"), F.col("root"), text, F.col("mask"), F.col("edges")))
    return reduce(DataFrame.union, parts)
