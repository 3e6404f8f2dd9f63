"""Property inheritance with overrides: four states of a property for each concept.

An assertion (subject, code, target) passes to narrower concepts along genus links only. Of all concepts whose assertion
applies to a subject, those with another such concept strictly below them are overridden, however long the paths are.
The owners left decide: all positive, all negative, both (conflict); no owner leaves the state unknown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoloom.operators.graph import closure, edge_records, witness_paths
from ontoloom.plans.tables import materialized
from ontoloom.sources.model import INHERITED, Graph, is_positive


def assertions(g: Graph, context: int = 1, code: str | None = None, target: int | None = None) -> DataFrame:
    """(owner, code, target, strength, edge) of the inheritable codes."""
    a = g.scope(context, positive=False).filter(F.col("code").isin(*INHERITED))
    if code is not None:
        a = a.filter(F.col("code") == code)
    if target is not None:
        a = a.filter(F.col("target") == target)
    return a.select(F.col("subject").alias("owner"), "code", "target", "strength", F.col("id").alias("edge"))


def applicable(g: Graph, a: DataFrame, context: int = 1, ids: DataFrame | None = None) -> DataFrame:
    """(subject, owner, code, target, strength, edge, overridden): every assertion that reaches a subject."""
    up = closure(g, context).select(F.col("descendant").alias("subject"), F.col("ancestor").alias("owner"))
    if ids is not None:
        up = up.join(ids.select(F.col("id").alias("subject")), "subject", "left_semi")
    found = materialized(up.join(a, "owner"))
    # an owner lies strictly above another: owners are few, so this relation is made among owners alone
    owners = a.select("owner").distinct()
    c = closure(g, context).join(owners.select(F.col("owner").alias("descendant")), "descendant", "left_semi").join(owners.select(F.col("owner").alias("ancestor")), "ancestor", "left_semi")
    strict = c.join(c.select(F.col("ancestor").alias("descendant"), F.col("descendant").alias("ancestor")), ["descendant", "ancestor"], "left_anti").filter("descendant <> ancestor")
    lower = found.select("subject", "code", "target", F.col("owner").alias("descendant")).distinct()
    hit = lower.join(strict, "descendant").select("subject", "code", "target", F.col("ancestor").alias("owner")).distinct().withColumn("overridden", F.lit(True))
    return found.join(hit, ["subject", "code", "target", "owner"], "left").withColumn("overridden", F.coalesce("overridden", F.lit(False)))


def states(g: Graph, code: str, target: int, context: int = 1, ids: DataFrame | None = None) -> DataFrame:
    """(id, state) of all concepts, or of ids: positive, negative, conflict or unknown."""
    left = applicable(g, assertions(g, context, code, target), context, ids).filter("not overridden")
    known = left.groupBy(F.col("subject").alias("id")).agg(F.bool_or(is_positive()).alias("p"), F.bool_or(~is_positive()).alias("n"))
    state = F.when(F.col("p") & F.col("n"), "conflict").when(F.col("p"), "positive").when(F.col("n"), "negative").otherwise("unknown")
    return (g.concept if ids is None else ids).select("id").join(known, "id", "left").select("id", state.alias("state"))


def explained(g: Graph, subject: int, code: str, target: int, context: int = 1) -> dict:
    """Why a property has its state for one concept: the assertions that decide, each with the genus path from the concept to its
    owner, and the ids of overridden ones. All of it is evidence of one concept, which is small."""
    one = g.spark.range(subject, subject + 1).select("id")
    found = applicable(g, assertions(g, context, code, target), context, one).orderBy("edge").collect()
    left = [r for r in found if not r["overridden"]]
    signs = {r["strength"] is None or r["strength"] > 0 for r in left}
    state = "unknown" if not signs else "conflict" if len(signs) == 2 else "positive" if signs == {True} else "negative"
    paths = {r["ancestor"]: list(r["edges"]) for r in witness_paths(g, context, one).filter(F.col("ancestor").isin(*[r["owner"] for r in left])).collect()} if left else {}
    edges = {r["id"]: r for r in edge_records(g, sorted({i for p in paths.values() for i in p} | {r["edge"] for r in left}))}
    evidence = [{"edge": edges[r["edge"]], "genus_path": [edges[i] for i in paths[r["owner"]]]} for r in left]
    overridden = sorted(r["edge"] for r in found if r["overridden"])
    return {"subject": subject, "relation": code, "target": target, "context": context, "state": state, "evidence": evidence, "overridden_edge_ids": overridden}


def redundant(g: Graph, context: int = 1) -> DataFrame:
    """(edge, subject, code, target, ancestor): assertions that a proper ancestor makes too, not counting explicit negatives."""
    a = g.scope(context).filter(F.col("code").isin("70", *(str(c) for c in range(20, 28)))).select("id", "subject", "code", "target")
    up = closure(g, context).filter("descendant <> ancestor")
    b = a.select(F.col("subject").alias("ancestor"), "code", "target")
    return a.join(up, F.col("subject") == F.col("descendant")).join(b, ["ancestor", "code", "target"]).select(F.col("id").alias("edge"), "subject", "code", "target", "ancestor")


def prunable(g: Graph, context: int = 1, apart: int = 25) -> DataFrame:
    """redundant() without assertions whose strength differs from the ancestor's by apart or more (no strength: 100)."""
    r = redundant(g, context)
    s = g.scope(context).select("subject", "code", "target", F.coalesce("strength", F.lit(100)).alias("s"))
    own = r.join(s, ["subject", "code", "target"]).withColumnRenamed("s", "own")
    up = own.join(s.withColumnRenamed("subject", "ancestor"), ["ancestor", "code", "target"])
    return up.filter(F.abs(F.col("own") - F.col("s")) < apart).select("edge", "subject", "code", "target", "ancestor")
