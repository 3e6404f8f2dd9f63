"""Changes as pure functions: (tables, batch) to (new tables, report). A commit is a swap of what was written."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ontoloom.operators import graph as ops
from ontoloom.sources.model import GENUS, Graph

KEY = ("subject", "code", "target", "context")


def oriented(g: Graph, edges: DataFrame) -> DataFrame:
    """Symmetric codes with the smaller end as the subject."""
    s = F.broadcast(g.rule.select("code", "mutual"))  # a few dozen codes
    e = edges.join(s, "code", "left")
    swap = F.coalesce("mutual", F.lit(False)) & (F.col("subject") > F.col("target"))
    rest = [c for c in edges.columns if c not in ("subject", "target")]
    return e.select(F.when(swap, F.col("target")).otherwise(F.col("subject")).alias("subject"), F.when(swap, F.col("subject")).otherwise(F.col("target")).alias("target"), *rest)


def validated(g: Graph, batch: DataFrame) -> DataFrame:
    """batch (subject, code, target, context, strength) with verdict and warning. The first fault in this order counts: unknown_code,
    missing, duplicate (any context but for genus), cycle, redundant (a genus already reached, unless it is a direct one of another
    context), signature_subject, signature_object; else ok. warning: an ancestor makes the same assertion."""
    b = oriented(g, batch)
    ids, known = g.concept.select("id"), ops.merged_closure(g)
    yes = lambda df, keys, name: df.select(*keys).distinct().withColumn(name, F.lit(True))
    b = b.join(F.broadcast(yes(g.rule, ["code"], "has_code")), "code", "left")
    b = b.join(yes(ids.toDF("subject"), ["subject"], "has_s"), "subject", "left").join(yes(ids.toDF("target"), ["target"], "has_t"), "target", "left")
    old = g.edge.filter("status <> 'rejected'")
    b = b.join(yes(old, KEY, "same"), list(KEY), "left").join(yes(old, ["subject", "code", "target"], "anywhere"), ["subject", "code", "target"], "left")
    b = b.join(yes(known.toDF("subject", "target", "d"), ["subject", "target"], "above"), ["subject", "target"], "left")
    b = b.join(yes(known.toDF("target", "subject", "d"), ["subject", "target"], "below"), ["subject", "target"], "left")
    for side, end in (("subject", "subject"), ("object", "target")):
        rule = F.broadcast(g.anchor.filter(F.col("side") == side))  # a few anchors a code
        up = known.select(F.col("descendant").alias(end), F.col("ancestor").alias("anchor")).union(ids.select("id", "id"))
        b = b.join(yes(rule, ["code"], f"bound_{side}"), "code", "left").join(yes(up.join(rule, "anchor"), ["code", end], f"fits_{side}"), ["code", end], "left")
    asserted = g.edge.filter("status = 'ok' and (strength is null or strength > 0)").select("code", "target", F.col("subject").alias("ancestor"))
    upper = known.select(F.col("descendant").alias("subject"), "ancestor").join(asserted, "ancestor")
    b = b.join(yes(upper, ["subject", "code", "target"], "inherited"), ["subject", "code", "target"], "left")
    on = lambda c: F.coalesce(c, F.lit(False))
    genus = F.col("code") == GENUS
    verdict = F.when(~on("has_code"), "unknown_code").when(~on("has_s") | ~on("has_t"), "missing").when(on("same") | (~genus & on("anywhere")), "duplicate")
    verdict = verdict.when(genus & ((F.col("subject") == F.col("target")) | on("above")), "cycle").when(genus & on("below") & ~on("anywhere"), "redundant")
    verdict = verdict.when(on("bound_subject") & ~on("fits_subject"), "signature_subject").when(on("bound_object") & ~on("fits_object"), "signature_object").otherwise("ok")
    warned = F.col("code").isin("70", *(str(c) for c in range(20, 28))) & on("inherited") & ~F.coalesce(F.col("strength") == 0, F.lit(False))
    return b.select(*KEY, "strength", verdict.alias("verdict"), warned.alias("warning"))


def edge_id():
    """New edges are numbered by a 62-bit hash of their key, so they need no counter, whatever codes and ids look like."""
    return F.pmod(F.xxhash64(*KEY), F.lit(2**62))


def proposed(g: Graph, batch: DataFrame, status: str = "candidate") -> tuple[DataFrame, DataFrame]:
    """(edges with the sound proposals, report by verdict)."""
    v = validated(g, batch)
    new = v.filter("verdict = 'ok'").dropDuplicates(list(KEY)).select(edge_id().alias("id"), *KEY, F.col("strength").cast("long").alias("strength"), F.lit(status).alias("status"))
    return g.edge.unionByName(new), v.groupBy("verdict").agg(F.count("*").alias("edges"))


def reviewed(edge: DataFrame, ids: DataFrame, accept: bool) -> DataFrame:
    """Candidates among ids accepted or rejected."""
    hit = ids.select("id").distinct().withColumn("hit", F.lit(True))
    new = F.when(F.col("hit") & (F.col("status") == "candidate"), "ok" if accept else "rejected").otherwise(F.col("status"))
    return edge.join(hit, "id", "left").withColumn("status", new).drop("hit")


def with_concepts(g: Graph, names: DataFrame) -> DataFrame:
    """names (name, context) to all concepts: a name that its context has is used again, others get the next ids in order."""
    new = names.select("name", "context").distinct().join(g.concept.select("name", "context"), ["name", "context"], "left_anti")
    top = g.concept.agg(F.max("id").alias("top"))
    numbered = new.crossJoin(F.broadcast(top)).select((F.col("top") + F.row_number().over(Window.orderBy("context", "name"))).alias("id"), "name", "context", F.lit(0).cast("long").alias("processed"))  # one row; a reviewed batch is small
    return g.concept.unionByName(numbered)


def merged(g: Graph, merges: DataFrame, keep_genus: bool = False) -> Graph:
    """merges (src, dst): terms move, edges are retargeted; self-loops, the source's genera (unless kept) and edges that clash with
    one that is there go; the sources go."""
    m = merges.select("src", "dst").distinct()
    to = lambda df, col: df.join(m.toDF(col, f"{col}_new"), col, "left").withColumn(f"{col}_moved", F.col(f"{col}_new").isNotNull()).withColumn(col, F.coalesce(f"{col}_new", col)).drop(f"{col}_new")
    e = to(to(g.edge, "subject"), "target")
    if not keep_genus:
        e = e.filter(~(F.col("subject_moved") & (F.col("code") == GENUS)))
    e = e.filter("subject <> target or not (subject_moved or target_moved)").withColumn("moved", F.col("subject_moved") | F.col("target_moved"))
    # a row that stood there wins over one that moved in, then the least id
    best = F.row_number().over(Window.partitionBy(*KEY).orderBy("moved", "id"))
    e = e.withColumn("k", best).filter("k = 1").select(*g.edge.columns)
    t = to(g.term, "concept_id").select(*g.term.columns).distinct()
    c = g.concept.join(m.select(F.col("src").alias("id")), "id", "left_anti")
    return Graph(g.spark, c, t, e, g.rule, g.anchor, g.context)


def renamed(g: Graph, names: DataFrame, lang: str = "en") -> Graph:
    """names (id, name): old and new names stay as terms; names that their context has already are not given."""
    taken = g.concept.select("name", "context")
    n = names.toDF("id", "new").join(g.concept.select("id", F.col("name").alias("old"), "context"), "id").join(taken.toDF("new", "context"), ["new", "context"], "left_anti").select("id", "old", "new")
    c = g.concept.join(n.select("id", "new"), "id", "left").withColumn("name", F.coalesce("new", "name")).select(*g.concept.columns)
    t = g.term.union(n.select("id", "old", F.lit(lang))).union(n.select("id", "new", F.lit(lang))).distinct()
    return Graph(g.spark, c, t, g.edge, g.rule, g.anchor, g.context)


def with_level(concept: DataFrame, ids: DataFrame, level: int) -> DataFrame:
    if not 0 <= level <= 3:
        raise ValueError("a level is from 0 to 3")
    return concept.join(ids.select("id").distinct().withColumn("hit", F.lit(True)), "id", "left").withColumn("processed", F.when(F.col("hit"), F.lit(level).cast("long")).otherwise(F.col("processed"))).drop("hit")


def recoded(edge: DataFrame, codes: dict[str, str]) -> DataFrame:
    """A migration of codes; a missing strength of a recoded edge becomes 100."""
    c = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])[F.col("code")]
    return edge.withColumn("strength", F.when(c.isNotNull(), F.coalesce("strength", F.lit(100))).otherwise(F.col("strength"))).withColumn("code", F.coalesce(c, "code"))


def difference(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """(key..., change): rows added, removed or changed between two versions."""
    rest = [c for c in before.columns if c not in key]
    digest = lambda df, name: df.select(*key, F.xxhash64(*rest).alias(name))
    j = digest(before, "x").join(digest(after, "y"), key, "full")
    change = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").when(F.col("x") != F.col("y"), "changed")
    return j.select(*key, change.alias("change")).filter("change is not null")


def fingerprint(df: DataFrame) -> DataFrame:
    """(rows, digest): equal for equal bags of rows in any order. Each row's SHA-256 gives 60 bits that are added up, so nothing is
    gathered; sums that grow with the rows stay exact in decimals."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in sorted(df.columns)])
    bits = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(bits), F.lit(0)).cast("string").alias("digest"))


def term_repair(g: Graph, before: DataFrame, add: DataFrame, remove: DataFrame) -> DataFrame:
    """New terms, if the table's fingerprint is the expected one (one row: rows, digest) and all removed terms are there."""
    if g_rows(fingerprint(g.term)) != g_rows(before):
        raise ValueError("the terms are not those that the repair was written for")
    if remove.join(g.term, ["concept_id", "term", "lang"], "left_anti").take(1):
        raise ValueError("a term to remove is not there")
    return g.term.join(remove, ["concept_id", "term", "lang"], "left_anti").unionByName(add).distinct()


def g_rows(one: DataFrame) -> tuple:
    return tuple(one.first())


def relabelled(rule: DataFrame, names: dict[str, str]) -> DataFrame:
    """The relation grammar with the names that a map gives to codes."""
    new = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("code")]
    return rule.withColumn("name", F.coalesce(new, "name"))


def with_genus(g: Graph, pairs: DataFrame, context: int = 1) -> tuple[DataFrame, DataFrame]:
    """pairs (subject, target) proposed as accepted genus edges of a context: (edges, report by verdict)."""
    asked = pairs.select("subject", F.lit(GENUS).alias("code"), "target", F.lit(context).cast("long").alias("context"), F.lit(None).cast("long").alias("strength"))
    return proposed(g, asked, "ok")
