"""Question and answer records from the graph, each solved a second time from its own facts alone."""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ontoloom.functions import text
from ontoloom.operators import graph as ops
from ontoloom.operators import inherit, terms
from ontoloom.plans.tables import materialized
from ontoloom.sources.model import COEXTENSION, GENUS, INHERITED, Graph, is_positive

MAX_FACTS, MAX_BYTES = 36, 24_576
#: Members of a set question's domain, and concepts added to that of a count which are in neither set.
DOMAIN, DISTRACTORS = (3, 24), 2
SETS = ("intersection", "difference", "count")
TASKS = ("parents", "ancestry", "shared_genus", "inference", "property", *SETS)
KINDS = ("siblings_disjoint", "shared_membership", "reverse_genus")
#: Wording of questions by task (of inferences by kind) and language: of a, b and what the property is.
WORDING = {
    "parents": {"en": "What is %1$s directly a kind of?", "ru": "К каким понятиям напрямую относится %1$s?"},
    "ancestry": {"en": "Is %1$s a kind of %2$s?", "ru": "Является ли %1$s видом %2$s?"},
    "shared_genus": {"en": "Which direct genus do %1$s and %2$s share?", "ru": "Какой общий род у %1$s и %2$s?"},
    "property": {"en": "By these facts, does %1$s stand in relation %3$s (positive, negative, conflict or unknown)?", "ru": "Состоит ли %1$s по этим фактам в отношении %3$s (positive, negative, conflict или unknown)?"},
    "intersection": {"en": "Of the concepts listed, which are in both %1$s and %2$s?", "ru": "Какие из перечисленных понятий входят и в %1$s, и в %2$s?"},
    "difference": {"en": "Of the concepts listed, which are in %1$s and not in %2$s?", "ru": "Какие из перечисленных понятий входят в %1$s, но не в %2$s?"},
    "count": {"en": "How many of the concepts listed are in %1$s or in %2$s?", "ru": "Сколько из перечисленных понятий входит в %1$s или в %2$s?"},
    "siblings_disjoint": {"en": "%1$s and %2$s are kinds of one thing. Does it follow that nothing is both?", "ru": "%1$s и %2$s одного рода. Следует ли, что ничто не бывает и тем и другим?"},
    "shared_membership": {"en": "Does it follow that %1$s and %2$s are kinds of one thing?", "ru": "Следует ли, что %1$s и %2$s одного рода?"},
    "reverse_genus": {"en": "%1$s is a kind of %2$s. Does it follow that %2$s is a kind of %1$s?", "ru": "%1$s есть вид %2$s. Следует ли, что %2$s есть вид %1$s?"},
}
#: Functions of the set language by the state that they select.
STATE_CALLS = {"positive": "has", "negative": "lacks", "unknown": "unknown", "conflict": "conflicts"}


def _facts(g: Graph, context: int) -> DataFrame:
    return g.code(context, GENUS).select("subject", "target", F.col("id").alias("edge"))


def parents_pool(g: Graph, context: int = 1, most: int = 4) -> DataFrame:
    """(a, expected): concepts with at most so many direct genera, and these."""
    p = _facts(g, context).groupBy(F.col("subject").alias("a")).agg(F.countDistinct("target").alias("n"), F.slice(F.array_sort(F.collect_set("target")), 1, most + 1).alias("t")).filter(F.col("n") <= most)
    return p.select("a", ops.joined_ids("t").alias("expected"))


def ancestry_pool(g: Graph, context: int = 1, least: int = 2, most: int = 4) -> DataFrame:
    """(a, b, hops, edges): pairs with a shortest genus path of 2 to 4 links."""
    w = ops.witness_paths(g, context).filter(F.col("depth").between(least, most))
    return w.select(F.col("subject").alias("a"), F.col("ancestor").alias("b"), F.col("depth").alias("hops"), ops.joined_ids("edges").alias("edges"))


def shared_genus_pool(g: Graph, context: int = 1, each: int = 3) -> DataFrame:
    """(a, b, genus): for each concept its next siblings in order of id under a genus."""
    e = _facts(g, context)
    w = Window.partitionBy("target").orderBy("subject")
    nexts = F.array(*[F.lead("subject", k).over(w) for k in range(1, each + 1)])
    n = e.select(F.col("target").alias("genus"), F.col("subject").alias("a"), nexts.alias("n"))
    return n.select("genus", "a", F.explode("n").alias("b")).filter("b is not null").select("a", "b", "genus")


def property_pool(g: Graph, code: str, target: int, context: int = 1) -> DataFrame:
    """(a, state): concepts at which a property is stated, their first five children and their parents."""
    own = inherit.assertions(g, context, code, target).select(F.col("owner").alias("id")).distinct()
    e = _facts(g, context)
    kids = e.join(own.toDF("target"), "target", "left_semi").withColumn("k", F.row_number().over(Window.partitionBy("target").orderBy("subject"))).filter("k <= 5").select(F.col("subject").alias("id"))
    up = e.join(own.toDF("subject"), "subject", "left_semi").select(F.col("target").alias("id"))
    ids = materialized(own.union(kids).union(up).distinct())
    return inherit.states(g, code, target, context, ids).select(F.col("id").alias("a"), "state")


def count_pool(g: Graph, pairs: DataFrame, context: int = 1) -> DataFrame:
    """pairs (a, b) to (a, b, expected): concepts that are in both extents."""
    one = ops.extents(g, pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), context)
    both = pairs.join(one.toDF("a", "id"), "a").join(one.toDF("b", "id"), ["b", "id"]).groupBy("a", "b").agg(F.count("*").alias("n"))
    return pairs.join(both, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("expected"))


def blocked(pool: DataFrame, policy: DataFrame) -> DataFrame:
    """Candidates (subject, code, target, strength) that no policy row names; a policy row without a strength names any."""
    hit = (F.col("c.subject") == F.col("p.subject")) & (F.col("c.code") == F.col("p.code")) & (F.col("c.target") == F.col("p.target"))
    return pool.alias("c").join(policy.alias("p"), hit & (F.col("p.strength").isNull() | F.col("p.strength").eqNullSafe(F.col("c.strength"))), "left_anti")


def grounded(g: Graph, seeds: DataFrame, context: int = 1, most: int = MAX_FACTS) -> DataFrame:
    """(a, facts): the genus edges at and above each seed, as (edge, subject, target) in order; seeds with more than most go."""
    up = ops.closure(g, context).join(seeds.select(F.col("a").alias("descendant")).distinct(), "descendant", "left_semi")
    f = up.join(_facts(g, context), F.col("ancestor") == F.col("subject")).groupBy(F.col("descendant").alias("a"))
    return f.agg(F.array_sort(F.collect_list(F.struct("edge", "subject", "target"))).alias("facts")).filter(F.size("facts") <= most)


def inference_pool(g: Graph, seed: int, context: int = 1) -> DataFrame:
    """(a, b, genus, kind, answer): what follows from genus facts and what does not. Siblings are of one kind, but need not be apart;
    a genus need not be a kind of its species (pairs that reach each other are left out)."""
    third = F.pmod(F.xxhash64(F.lit(seed), "a", "b"), F.lit(3)) == 0
    sib = shared_genus_pool(g, context, 1).withColumn("kind", F.when(third, "shared_membership").otherwise("siblings_disjoint"))
    sib = sib.select("a", "b", "genus", "kind", F.when(third, "entailed").otherwise("not_entailed").alias("answer"))
    up = _facts(g, context).select(F.col("subject").alias("a"), F.col("target").alias("b")).distinct().filter(F.pmod(F.xxhash64(F.lit(seed), "a", "b"), F.lit(2)) == 0)
    back = ops.closure(g, context).select(F.col("ancestor").alias("a"), F.col("descendant").alias("b"))
    one_way = up.join(back, ["a", "b"], "left_anti")
    return sib.union(one_way.select("a", "b", F.lit(None).cast("long"), F.lit("reverse_genus"), F.lit("not_entailed")))


def states_pool(g: Graph, context: int = 1, children: int = 5) -> DataFrame:
    """(a, code, target, state, edge): for each property that is stated anywhere its owners, their first children and their parents;
    edge is the least statement that brought the concept in."""
    own = inherit.assertions(g, context).select("owner", "code", "target", "edge")
    e = _facts(g, context).select("subject", F.col("target").alias("genus"))
    first = e.withColumn("k", F.row_number().over(Window.partitionBy("genus").orderBy("subject"))).filter(F.col("k") <= children)
    kids = own.join(first.select(F.col("genus").alias("owner"), F.col("subject").alias("a")), "owner")
    up = own.join(e.select(F.col("subject").alias("owner"), F.col("genus").alias("a")), "owner")
    near = own.withColumn("a", F.col("owner")).select("a", "code", "target", "edge").union(kids.select("a", "code", "target", "edge")).union(up.select("a", "code", "target", "edge"))
    near = materialized(near.groupBy("a", "code", "target").agg(F.min("edge").alias("edge")))
    left = inherit.applicable(g, inherit.assertions(g, context), context, near.select(F.col("a").alias("id")).distinct()).filter("not overridden")
    held = left.groupBy(F.col("subject").alias("a"), "code", "target").agg(F.bool_or(is_positive()).alias("p"), F.bool_or(~is_positive()).alias("n"))
    state = F.when(F.col("p") & F.col("n"), "conflict").when(F.col("p"), "positive").when(F.col("n"), "negative").otherwise("unknown")
    return near.join(held, ["a", "code", "target"], "left").select("a", "code", "target", state.alias("state"), "edge")


def pair_pool(g: Graph, context: int = 1) -> DataFrame:
    """(a, b): siblings, and genera of one concept, whose own extents are no larger than a domain may be."""
    e = _facts(g, context).select("subject", "target").distinct()
    parents = e.toDF("s", "a").join(e.toDF("s", "b"), "s").filter("a < b").select("a", "b")
    sib = shared_genus_pool(g, context, 1).select("a", "b")
    small = ops.closure(g, context).groupBy(F.col("ancestor").alias("id")).agg(F.count("*").alias("n")).filter(F.col("n") <= DOMAIN[1]).select("id")
    return sib.union(parents).distinct().join(small.toDF("a"), "a", "left_semi").join(small.toDF("b"), "b", "left_semi").select("a", "b")


def domains(g: Graph, pairs: DataFrame, context: int = 1) -> DataFrame:
    """pairs (a, b) to (a, b, both, left, domain, outside): the members of both extents, of the first alone, of either, and the first
    concepts above a or b that are in neither; pairs whose domain is too small or too large are left out."""
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    ext = materialized(ops.extents(g, ends, context).join(g.concept.select("id"), "id", "left_semi").select("seed", "id"))
    flag = lambda c: pairs.join(ext.toDF(c, "id"), c).select("a", "b", "id", F.lit(c).alias("side"))
    each = flag("a").union(flag("b")).groupBy("a", "b", "id").agg(F.collect_set("side").alias("sides"))
    held = each.groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("id", F.array_contains("sides", "a").alias("x"), F.array_contains("sides", "b").alias("y")))).alias("m"))
    ids = lambda keep: F.transform(F.filter("m", keep), lambda r: r["id"])
    held = held.select("a", "b", ids(lambda r: r["x"] & r["y"]).alias("both"), ids(lambda r: r["x"] & ~r["y"]).alias("left"), ids(lambda r: F.lit(True)).alias("domain"))
    held = materialized(held.filter(F.size("domain").between(*DOMAIN)))
    above = ops.closure(g, context).toDF("low", "id").join(ends.toDF("low"), "low", "left_semi")
    up = held.select("a", "b", F.explode(F.array("a", "b")).alias("low"), "domain").join(above, "low").filter(~F.array_contains("domain", F.col("id")))
    outside = up.groupBy("a", "b").agg(F.slice(F.array_sort(F.collect_set("id")), 1, DISTRACTORS).alias("outside"))
    return held.join(outside, ["a", "b"], "left").withColumn("outside", F.coalesce("outside", F.expr("cast(array() as array<long>)")))


def _domain_facts(g: Graph, asked: DataFrame, context: int) -> DataFrame:
    """asked (id, domain) to (id, facts): genus and coextension links at and above the domain."""
    m = materialized(asked.select("id", F.explode("domain").alias("seed")))
    same = g.code(context, COEXTENSION).select("subject", "target")
    step = g.code(context, GENUS).select("subject", "target").union(same).union(same.select("target", "subject")).toDF("a", "b").distinct()
    up = ops.reach(step, m.select("seed", F.col("seed").alias("node")).distinct()).select("seed", "node")
    e = g.scope(context).filter(F.col("code").isin(GENUS, COEXTENSION))
    ends = e.withColumn("node", F.explode(F.expr(f"if(code = '{COEXTENSION}', array(subject, target), array(subject))")))
    hit = m.join(up, "seed").select(F.col("id").alias("rid"), "node").distinct().join(ends.withColumnRenamed("id", "edge"), "node")
    return hit.groupBy(F.col("rid").alias("id")).agg(F.array_sort(F.collect_set(F.struct("edge", "subject", "code", "target", "strength"))).alias("facts"))


def solved(records: DataFrame) -> DataFrame:
    """records (id, task, a, b, code, target, kind, domain, facts) to (id, answer, cyclic), from the facts alone and by other means than the
    operators above: each record's few facts are walked as a dictionary. cyclic: genus facts lead back to where they start."""

    def above(x: int, up: dict) -> set:
        seen, todo = {x}, [x]
        while todo:
            for y in up[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        return seen

    def links(r) -> tuple[dict, dict]:
        genus, sets = defaultdict(set), defaultdict(set)
        for f in r.facts:
            if f["strength"] == 0:
                continue
            if f["code"] == GENUS:
                genus[f["subject"]].add(f["target"])
                sets[f["subject"]].add(f["target"])
            elif f["code"] == COEXTENSION:
                sets[f["subject"]].add(f["target"])
                sets[f["target"]].add(f["subject"])
        return genus, sets

    def cyclic(genus: dict) -> bool:
        return any(x in above(y, genus) for x in list(genus) for y in list(genus[x]))

    def one(r, genus: dict, sets: dict) -> str:
        listed = lambda ids: ",".join(map(str, sorted(ids)))
        if r.task == "parents":
            return listed(genus[r.a])
        if r.task == "shared_genus":
            return listed(genus[r.a] & genus[r.b])
        if r.task == "ancestry":
            return "yes" if r.b in above(r.a, genus) else "no"
        if r.task in SETS:
            a, b = ({i for i in r.domain if end in above(i, sets)} for end in (r.a, r.b))
            return listed(a & b) if r.task == "intersection" else listed(a - b) if r.task == "difference" else str(len(a | b))
        if r.task == "property":
            said = [f for f in r.facts if f["code"] == r.code and f["target"] == r.target and f["subject"] in above(r.a, genus)]
            own = {f["subject"] for f in said}
            last = {x for x in own if not any(x in above(y, genus) and y not in above(x, genus) for y in own)}
            signs = {f["strength"] != 0 for f in said if f["subject"] in last}
            return "unknown" if not signs else "conflict" if len(signs) == 2 else "positive" if True in signs else "negative"
        shared = bool(genus[r.a] & genus[r.b])
        if r.kind == "reverse_genus":
            return "not_entailed" if r.b in genus[r.a] and r.a not in above(r.b, genus) else "unsound"
        return "unsound" if not shared else "entailed" if r.kind == "shared_membership" else "not_entailed"

    def run(it):
        for pdf in it:
            both = [(r, *links(r)) for r in pdf.itertuples()]
            yield pd.DataFrame({"id": pdf["id"], "answer": [one(*x) for x in both], "cyclic": [cyclic(genus) for _, genus, _ in both]})

    lone = F.coalesce("b", F.lit(0)).alias("b")
    return records.select("id", "task", "a", lone, "code", F.coalesce("target", F.lit(0)).alias("target"), "kind", "domain", "facts").mapInPandas(run, "id string, answer string, cyclic boolean")


def pools(g: Graph, seed: int, context: int = 1) -> DataFrame:
    """All candidates in eleven pools; answers of set questions are found once their domains are."""
    none, text = F.lit(None).cast("long"), F.lit(None).cast("string")
    row = lambda df, pool, task, a, b, code, target, kind, extra, answer: df.select(pool.alias("pool"), F.lit(task).alias("task"), a, b, code, target, kind, extra, answer).toDF("pool", "task", "a", "b", "code", "target", "kind", "extra", "answer")
    c = F.col
    turned = F.pmod(F.xxhash64(F.lit(seed), "a", "b"), F.lit(2)) == 0  # every other pair is asked the wrong way round
    genera = _facts(g, context)
    shared = shared_genus_pool(g, context, 1).select("a", "b").distinct()
    both = shared.join(genera.select(c("subject").alias("a"), "target"), "a").join(genera.select(c("subject").alias("b"), "target"), ["b", "target"])
    both = both.groupBy("a", "b").agg(ops.joined_ids(F.array_sort(F.collect_set("target"))).alias("t"))
    out = [
        row(parents_pool(g, context), F.lit("parents"), "parents", c("a"), none, text, none, text, none, c("expected")),
        row(ancestry_pool(g, context), F.lit("ancestry"), "ancestry", F.when(turned, c("b")).otherwise(c("a")), F.when(turned, c("a")).otherwise(c("b")), text, none, text, none, F.when(turned, "no").otherwise("yes")),
        row(both, F.lit("shared_genus"), "shared_genus", c("a"), c("b"), text, none, text, none, c("t")),
        row(inference_pool(g, seed, context), F.lit("inference"), "inference", c("a"), c("b"), text, c("genus"), c("kind"), none, c("answer")),
        row(states_pool(g, context), F.concat(F.lit("property_"), c("state")), "property", c("a"), none, c("code"), c("target"), text, F.when(c("state") == "unknown", c("edge")), c("state")),
    ]
    pairs = materialized(pair_pool(g, context))
    out += [row(pairs, F.lit(task), task, c("a"), c("b"), text, none, text, none, text) for task in SETS]
    return reduce(DataFrame.union, out)


def records(g: Graph, seed: int, count: int, context: int = 1, lang: str = "en") -> DataFrame:
    """count records as ``drawn`` makes them. Of each pool twice as many candidates are tried first, as some are rejected; where that leaves too
    few records, four times as many again and again, until there are enough or the pools are at their end."""
    found = materialized(pools(g, seed, context))
    sizes = found.groupBy("pool").count().agg(F.max("count")).first()[0] or 0
    tried = 2 * count
    while True:
        made = drawn(g, seed, count, tried, context, lang, found)
        if tried >= sizes:
            return made
        made = materialized(made)
        if made.count() >= count:
            return made
        tried *= 4


def drawn(g: Graph, seed: int, count: int, tried: int, context: int = 1, lang: str = "en", found: DataFrame | None = None) -> DataFrame:
    """(id, group_id, task, a, b, code, target, kind, domain, question, answer, algebra, facts, messages): at most count records from the first
    ``tried`` candidates of each pool, pools in turn, each in an order that the seed gives; every record's answer is found again by solved(), records over the limits of
    facts and bytes or with a repeated question go. algebra is an expression that gives the answer, where there is one. found: the pools, if made."""
    key = ("task", "a", "b", "code", "target", "kind")
    order = F.sha2(F.concat_ws("|", F.lit(seed), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]).cast("binary"), 256)
    k = F.row_number().over(Window.partitionBy("pool").orderBy("order"))
    # the first of each pool in seeded order: Spark keeps so many rows a pool before the shuffle
    picked = materialized((pools(g, seed, context) if found is None else found).withColumn("order", order).withColumn("k", k).filter(F.col("k") <= tried).drop("k"))
    picked = picked.withColumn("id", F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in key]).cast("binary"), 256))
    nothing = F.expr("cast(array() as array<long>)")
    sets = picked.filter(F.col("task").isin(*SETS)).drop("answer").join(domains(g, picked.filter(F.col("task").isin(*SETS)).select("a", "b").distinct(), context), ["a", "b"])
    listed = F.when(F.col("task") == "intersection", ops.joined_ids("both")).when(F.col("task") == "difference", ops.joined_ids("left")).otherwise(F.size("domain").cast("string"))
    wide = F.when(F.col("task") == "count", F.concat("domain", "outside")).otherwise(F.col("domain"))
    sets = sets.withColumn("answer", listed).withColumn("empty", (F.col("task") == "intersection") & (F.size("both") == 0))
    sets = sets.filter((F.col("task") != "count") | (F.size("outside") > 0)).withColumn("domain", F.array_sort(wide)).filter(F.size("domain") <= DOMAIN[1])
    cols = ["id", "pool", "order", *key, "extra", "answer", "domain", "empty"]
    sets = materialized(sets.select(*cols))
    rest = picked.filter(~F.col("task").isin(*SETS)).withColumn("domain", nothing).withColumn("empty", F.lit(False)).select(*cols)

    # facts: of set questions those above the domain, of inferences the links themselves, of others those above a and b
    edge = g.scope(context, positive=False).select(F.struct(F.col("id").alias("edge"), "subject", "code", "target", "strength").alias("f"), "id", "subject", "code", "target")
    genus = g.code(context, GENUS).select(F.struct(F.col("id").alias("edge"), "subject", "code", "target", "strength").alias("f"), "subject", "target")
    ends = rest.select("id", F.explode(F.array_compact(F.array("a", "b"))).alias("low"), "task", "kind", "target", "b")
    up = ops.closure(g, context).toDF("low", "node")
    wider = ends.filter("task <> 'inference'").join(up, "low").join(genus.select("f", F.col("subject").alias("node")), "node").select("id", "f")
    links = ends.filter("task = 'inference'").join(genus.toDF("f", "low", "high"), "low").filter("high = if(kind = 'reverse_genus', b, target)").select("id", "f")
    asked = rest.filter("task = 'property'").select("id", "a", "code", F.col("target"), "extra")
    stated = asked.join(up.toDF("a", "subject"), "a").join(edge.drop("id"), ["subject", "code", "target"]).select("id", "f")
    far = asked.filter("extra is not null").select(F.col("id").alias("rid"), F.col("extra").alias("id")).join(edge, "id").select("rid", "f", "subject")
    near = far.join(genus.toDF("g", "subject", "t"), "subject").select("rid", F.col("g").alias("f"))
    gathered = wider.union(links).union(stated).union(far.select("rid", "f")).union(near).groupBy("id").agg(F.array_sort(F.collect_set("f")).alias("facts"))
    gathered = gathered.union(_domain_facts(g, sets.select("id", "domain"), context)).filter(F.size("facts").between(1, MAX_FACTS))
    r = materialized(rest.union(sets).join(gathered, "id"))

    name = terms.display(g, lang)
    names = name.withColumnRenamed("label", "name")
    r = r.join(names.toDF("a", "na"), "a").join(names.toDF("b", "nb"), "b", "left").join(names.toDF("target", "nt"), "target", "left")
    r = r.withColumn("group_id", F.sha2(F.concat_ws("|", F.lit(context), "a").cast("binary"), 256))
    question = worded(lang)
    of = lambda c: F.concat(F.lit("#"), F.col(c).cast("string"))
    state = F.create_map(*[F.lit(x) for k, v in STATE_CALLS.items() for x in (k, v)])[F.col("answer")]
    algebra = F.when(F.col("task") == "parents", F.concat(F.lit("parents(exact("), of("a"), F.lit("))"))).when(F.col("task") == "ancestry", F.concat(F.lit("exact("), of("a"), F.lit(") & "), of("b")))
    algebra = algebra.when(F.col("task") == "shared_genus", F.concat(F.lit("parents(exact("), of("a"), F.lit(")) & parents(exact("), of("b"), F.lit("))")))
    algebra = algebra.when(F.col("task") == "intersection", F.concat(of("a"), F.lit(" & "), of("b"))).when(F.col("task") == "difference", F.concat(of("a"), F.lit(" - "), of("b")))
    algebra = algebra.when(F.col("task") == "count", F.concat(F.lit("count("), of("a"), F.lit(" | "), of("b"), F.lit(")"))).when(F.col("task") == "property", F.concat(state, F.lit("("), "code", F.lit(", "), of("target"), F.lit(")")))
    r = r.withColumn("question", question).withColumn("algebra", algebra)
    r = r.join(solved(r).select("id", F.col("answer").alias("again")), "id").filter("answer = again").drop("again")
    r = r.withColumn("messages", chat()).filter(F.octet_length(F.to_json(F.struct("messages", "facts"))) <= MAX_BYTES)
    r = materialized(r.withColumn("q", F.row_number().over(Window.partitionBy("question", "domain").orderBy("order", "id"))).filter("q = 1").drop("q"))
    # empty and witnessed intersections alternate, and so do the pools
    place = F.row_number().over(Window.partitionBy("pool", "empty").orderBy("order"))
    turn = F.row_number().over(Window.partitionBy("pool").orderBy("place", F.desc("empty")))
    chosen = r.withColumn("place", place).withColumn("turn", turn).orderBy("turn", "pool").limit(count)
    return chosen.select("id", "group_id", *key, "domain", "question", "answer", "algebra", "facts", "messages")


def worded(lang: str) -> Column:
    """The question of a record (task, kind, code; na, nb, nt: names of a, b and target)."""
    shape, question = F.coalesce("kind", "task"), F.lit(None).cast("string")
    for form, words in WORDING.items():
        question = F.when(shape == form, F.format_string(words[lang], F.col("na"), F.coalesce("nb", F.lit("")), F.concat_ws(" ", "code", "nt"))).otherwise(question)
    return question


def chat(question: str = "question", answer: str = "answer") -> Column:
    """A record's messages."""
    user = F.concat_ws("\n", F.col(question), F.when(F.size("domain") > 0, F.concat(F.lit("Concepts: "), ops.joined_ids("domain"))))
    return F.array(*[F.struct(F.lit(role).alias("role"), c.alias("content")) for role, c in (("system", F.lit("Answer from the facts.")), ("user", user), ("assistant", F.col(answer)))])


def verified(g: Graph, made: DataFrame, context: int = 1, lang: str = "en") -> DataFrame:
    """(id, errors): each record held against its own form and the graph; errors joined by commas, none for a sound record.

    schema: an unknown task or kind of inference, or an end that the task needs is missing. fact: facts that the graph does not have so.
    facts: a fact twice, of a code that records do not use, or of a strength beyond 0 to 100. limits: more facts, bytes or members of a domain
    than a record may have. domain: a member twice, or one that is no concept. cycle: genus facts that lead back. missing: genus facts above
    a that are left out. answer: not what the facts give. wording, messages: not what the task says in this language. genus, catalog and
    property: what the whole graph answers, by the operators and not from the facts, is something else."""
    f = made.select(F.col("id").alias("rid"), F.explode("facts").alias("f")).select("rid", "f.*")
    known = g.scope(context, positive=False).select(F.col("id").alias("edge"), "subject", "code", "target", F.coalesce("strength", F.lit(-1)).alias("strength"))
    err = lambda df, name: df.select("id", F.lit(name).alias("error"))
    pairs = (*SETS, "ancestry", "shared_genus", "inference")
    ends = F.col("a").isNull() | (F.col("task").isin(*pairs) & F.col("b").isNull()) | ((F.col("task") == "property") & (F.col("code").isNull() | F.col("target").isNull()))
    shapes = ~F.col("task").isin(*TASKS) | ((F.col("task") == "inference") & ~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False))) | ends
    ids = F.transform("facts", lambda x: x["edge"])
    odd = (F.size(F.array_distinct(ids)) < F.size("facts")) | F.exists("facts", lambda x: ~x["code"].isin(GENUS, COEXTENSION, *INHERITED) | (x["strength"] < 0) | (x["strength"] > 100))
    large = (F.size("facts") > MAX_FACTS) | (F.size("domain") > DOMAIN[1]) | (F.octet_length(F.to_json(F.struct("messages", "facts"))) > MAX_BYTES)
    member = made.select("id", F.explode("domain").alias("m"))
    strange = member.join(g.concept.select(F.col("id").alias("m")), "m", "left_anti").select("id").distinct()
    bad = f.withColumn("strength", F.coalesce("strength", F.lit(-1))).join(known, ["edge", "subject", "code", "target", "strength"], "left_anti").select(F.col("rid").alias("id"))
    whole = made.filter("task <> 'inference'").select(F.col("id").alias("rid"), F.col("a").alias("descendant"))
    full = whole.join(ops.closure(g, context), "descendant").join(_facts(g, context), F.col("ancestor") == F.col("subject")).select("rid", "edge").distinct()
    left_out = full.join(f.select("rid", "edge"), ["rid", "edge"], "left_anti").select(F.col("rid").alias("id"))
    again = materialized(solved(made.filter(~shapes)).toDF("id", "again", "cyclic"))
    names = terms.display(g, lang).withColumnRenamed("label", "name")
    said = made.join(names.toDF("a", "na"), "a", "left").join(names.toDF("b", "nb"), "b", "left").join(names.toDF("target", "nt"), "target", "left").withColumn("q", worded(lang))
    found = [
        err(made.filter(shapes), "schema"), err(made.filter(odd), "facts"), err(made.filter(large), "limits"), err(made.filter(F.size(F.array_distinct("domain")) < F.size("domain")), "domain"), err(strange, "domain"), err(bad, "fact"), err(left_out, "missing"),
        err(again.filter("cyclic"), "cycle"), err(made.join(again, "id").filter("not (answer <=> again)"), "answer"), err(said.filter("not (question <=> q)"), "wording"), err(said.filter(~F.col("messages").eqNullSafe(chat("q"))), "messages"),
        *(err(made.join(held.toDF("id", "right"), "id").filter("not (answer <=> right)"), name) for name, held in _by_graph(g, made, context).items()),
    ]
    e = reduce(DataFrame.union, found).distinct().groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("error")), ",").alias("errors"))
    return made.select("id").join(e, "id", "left").select("id", F.coalesce("errors", F.lit("")).alias("errors"))


def _by_graph(g: Graph, made: DataFrame, context: int) -> dict[str, DataFrame]:
    """(id, answer) of records as the operators over the whole graph give it, by family: genera, sets over the domain, property states."""
    up = _facts(g, context).select("subject", F.col("target").alias("genus")).distinct()
    own = made.filter("task in ('parents', 'shared_genus')").select("id", "task", "a", "b")
    a, b = own.join(up.toDF("a", "genus"), "a"), own.join(up.toDF("b", "genus"), "b").select("id", "genus")
    kept = a.join(b.withColumn("both", F.lit(True)), ["id", "genus"], "left").filter("task = 'parents' or both")
    genus = own.select("id").join(kept.groupBy("id").agg(F.collect_set("genus").alias("s")), "id", "left").select("id", ops.joined_ids(F.array_sort(F.coalesce("s", F.expr("cast(array() as array<long>)")))))
    sets = made.filter(F.col("task").isin(*SETS)).select("id", "task", "a", "b", "domain")
    ext = materialized(ops.extents(g, sets.select(F.col("a").alias("id")).union(sets.select("b")).distinct(), context).select("seed", F.col("id").alias("m")))
    each = sets.select("id", "a", "b", F.explode("domain").alias("m"))
    flag = lambda c: ext.select(F.col("seed").alias(c), "m", F.lit(True).alias(f"in_{c}"))
    each = each.join(flag("a"), ["a", "m"], "left").join(flag("b"), ["b", "m"], "left").fillna(False, ["in_a", "in_b"])
    pick = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("m"))))
    held = each.groupBy("id").agg(pick(F.col("in_a") & F.col("in_b")).alias("both"), pick(F.col("in_a") & ~F.col("in_b")).alias("left"), F.count_if(F.col("in_a") | F.col("in_b")).alias("n"))
    catalog = sets.join(held, "id").select("id", F.when(F.col("task") == "intersection", ops.joined_ids("both")).when(F.col("task") == "difference", ops.joined_ids("left")).otherwise(F.col("n").cast("string")))
    asked = made.filter("task = 'property'").select("id", "a", "code", "target")
    left = inherit.applicable(g, inherit.assertions(g, context), context, asked.select(F.col("a").alias("id")).distinct()).filter("not overridden")
    state = left.groupBy(F.col("subject").alias("a"), "code", "target").agg(F.bool_or(is_positive()).alias("p"), F.bool_or(~is_positive()).alias("n"))
    word = F.when(F.col("p") & F.col("n"), "conflict").when(F.col("p"), "positive").when(F.col("n"), "negative").otherwise("unknown")
    return {"genus": genus, "catalog": catalog, "property": asked.join(state, ["a", "code", "target"], "left").select("id", word)}


def question_labels(g: Graph, lang: str = "en", preferred: DataFrame | None = None, excluded: DataFrame | None = None, english: bool = True, most: int = 90) -> DataFrame:
    """(id, label, reason): the name by which a question calls a concept, or why none may. Terms of the language that are usable: not blank, at
    most so many letters, no control characters, in the language's script, no English infinitives. Of these the one that a policy prefers
    (preferred: id, term), then one that names no other concept, then the shortest, by lower case and text. reason: excluded (a policy names
    the concept; excluded: id) or unsuitable (no usable term, or with ``english`` no English term in Latin letters alone)."""
    cyrillic, latin = F.col("term").rlike("[А-Яа-яЁё]"), F.col("term").rlike("[A-Za-z]")
    own = g.term.filter(F.col("lang") == lang).select(F.col("concept_id").alias("id"), "term").distinct()
    canonical = g.concept.select("id", F.col("name").alias("term"))
    if lang == "ru":
        own = own.union(canonical.join(own.select("id").distinct(), "id", "left_anti"))
    fine = (F.trim("term") != "") & (F.length("term") <= most) & ~F.col("term").rlike("[\\x{00}-\\x{1F}\\x{FFFD}]")
    fine &= (latin & ~cyrillic & ~F.lower("term").startswith("to ")) if lang == "en" else cyrillic
    key = text.key(F.col("term"))
    shared = g.term.filter(F.col("lang") == lang).select(F.col("concept_id").alias("i"), key.alias("key")).distinct().groupBy("key").agg(F.count("*").alias("holders"))
    liked = canonical if preferred is None and lang == "ru" else preferred
    if preferred is not None and lang == "ru":
        liked = preferred.union(canonical.join(preferred.select("id"), "id", "left_anti"))
    t = own.filter(fine).withColumn("key", key).join(shared, "key", "left")
    t = t.withColumn("other", F.lit(False)) if liked is None else t.join(liked.select("id", F.col("term").alias("liked")), "id", "left").withColumn("other", F.coalesce(F.col("term") != F.col("liked"), F.lit(False)))
    best = t.groupBy("id").agg(F.min(F.struct("other", (F.coalesce("holders", F.lit(0)) != 1).alias("h"), F.length("term").alias("n"), F.lower("term").alias("l"), "term"))["term"].alias("label"))
    out = g.concept.select("id").join(best, "id", "left")
    if english:
        plain = g.term.filter("lang = 'en'").filter(latin & ~cyrillic).select(F.col("concept_id").alias("id"), F.lit(True).alias("plain")).distinct()
        out = out.join(plain, "id", "left").withColumn("label", F.when(F.col("plain"), F.col("label")))
    out = out.withColumn("gone", F.lit(None).cast("boolean")) if excluded is None else out.join(excluded.select("id", F.lit(True).alias("gone")).distinct(), "id", "left")
    reason = F.when(F.col("gone"), "excluded").when(F.col("label").isNull(), "unsuitable")
    return out.select("id", F.when(reason.isNull(), F.col("label")).alias("label"), reason.alias("reason"))


def report(made: DataFrame) -> DataFrame:
    """(task, answer, records): how many records of each task, by state or verdict where the answer is one; empty sets apart."""
    word = F.when(F.col("task").isin("property", "inference", "ancestry"), F.col("answer")).when(F.col("answer") == "", "empty").otherwise("")
    return made.groupBy("task", word.alias("answer")).agg(F.count("*").alias("records"))
