"""Reviewed batches, restored edges, words and records on small graphs made by hand."""

from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ontoloom.operators import lexical, qa, reviewed
from ontoloom.operators import batch as changes
from ontoloom.operators import graph as ops
from ontoloom.plans.tables import materialized
from ontoloom.sources.derive import derived
from ontoloom.sources.model import ANCHOR, CONCEPT, CONTEXT, EDGE, RULE, TERM, Graph

SF = "/root/testdata/sf0.001"


def graph(spark, edges, names="top mid low other"):
    concepts = [(i, n, 1, 0) for i, n in enumerate(names.split(), 1)]
    rows = [(k, s, c, t, 1, strength, "ok") for k, (s, c, t, strength) in enumerate(edges, 1)]
    terms = [(i, n, lang) for i, n, *_ in concepts for lang in ("en",)]
    rule = [("14", "genus", False), ("22", "action", False), ("61", "coordinate", True)]
    return Graph(spark, spark.createDataFrame(concepts, CONCEPT), spark.createDataFrame(terms, TERM), spark.createDataFrame(rows, EDGE), spark.createDataFrame(rule, RULE), spark.createDataFrame([], ANCHOR), spark.createDataFrame([(1, "everyday")], CONTEXT))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_restored_chain(spark):
    """Of three that assert the same, one below the other, only the top one returns; one that stands already hides them all."""
    g = graph(spark, [(2, "14", 1, None), (3, "14", 2, None), (1, "22", 4, 80), (2, "22", 4, 80), (3, "22", 4, 80), (3, "22", 2, 10)])
    now = g.edge.filter("code = '14'")
    out = reviewed.restored(g.edge, now, ops.merged_closure(g).select("ancestor", "descendant"))
    assert {(r["id"], r["restored"]) for r in out.collect()} == {(3, True), (4, False), (5, False), (6, True)}
    stands = g.edge.filter("code = '14' or id = 3")
    out = reviewed.restored(g.edge, stands, ops.merged_closure(g).select("ancestor", "descendant"))
    assert {(r["id"], r["restored"]) for r in out.collect()} == {(4, False), (5, False), (6, True)}
    assert reviewed.restored(g.edge, g.edge, ops.merged_closure(g).select("ancestor", "descendant")).count() == 0


def test_bags(spark):
    """Rows count as often as they stand, nulls are equal."""
    make = lambda rows: spark.createDataFrame(rows, "src long, a string, b long")
    now = make([(1, "x", None), (1, "x", None), (2, "y", 1), (3, None, None)])
    assert reviewed.unlike(now, now, "src").count() == 0
    assert rows(reviewed.unlike(now, make([(1, "x", None), (2, "y", 1), (3, None, None), (4, "z", 0)]), "src")) == [(1,), (4,)]


def batch(spark, **tables):
    return reviewed.Batch({k: spark.createDataFrame(v, reviewed.SCHEMAS[k]) for k, v in tables.items()})


def test_batch_is_whole_or_nothing(spark):
    g = graph(spark, [(2, "14", 1, None), (3, "14", 2, None), (2, "61", 4, None), (4, "22", 1, 0)])
    good = {"repairs": [(2, 3, "14", 2, 1)], "replacements": [(3, None, "14", 1, None, 1, None)], "concepts": [("new", "fresh", 2, None, 1)], "edges": [(None, "new", "22", 4, None, None, 60)]}
    out = reviewed.applied(g, batch(spark, **good))
    assert out.faults.count() == 0 and dict(rows(out.counts)) == {"concepts_added": 1, "edges_added": 3, "edges_rejected": 1, "levels_set": 1}
    new = out.created.first()["id"]
    assert {(r["subject"], r["code"], r["target"], r["status"]) for r in out.graph.edge.collect()} >= {(3, "14", 2, "rejected"), (3, "14", 1, "ok"), (new, "14", 2, "ok"), (new, "22", 4, "ok")}
    assert reviewed.regressions(g, out.graph, batch(spark, checks=[(3, "14", 1, True, None), (3, "14", 2, False, None)], subtree_checks=[(3, 2, False), (new, 1, True)])).filter("issue like '%check'").count() == 0
    bad = {"repairs": [(2, 3, "14", 1, 1)], "edges": [(4, None, "22", 1, None, 1, 50), (1, None, "14", 3, None, 1, None), (1, None, "22", 99, None, 1, None), (2, "none", "22", None, "none", 1, None)]}
    out = reviewed.applied(g, batch(spark, **{**good, **bad}))
    assert out.graph is g and out.counts.count() == 0
    assert {r["fault"] for r in out.faults.collect()} >= {"edge changed", "changes a strength", "cycle", "missing", "unknown end"}
    again = reviewed.applied(reviewed.applied(g, batch(spark, **good)).graph, batch(spark, **good))
    assert again.faults.count() == 0 and dict(rows(again.counts)) == {"edges_reused": 2}


def test_batch_empty_and_fingerprints(spark):
    g = graph(spark, [(2, "14", 1, None)])
    out = reviewed.applied(g, reviewed.Batch())
    assert out.faults.count() == 0 and out.counts.count() == 0 and rows(out.graph.edge) == rows(g.edge)
    n, digest = changes.fingerprint(g.edge).first()
    assert reviewed.applied(g, batch(spark, fingerprints=[("edge", n, digest)])).faults.count() == 0
    assert rows(reviewed.applied(g, batch(spark, fingerprints=[("edge", n, "0")])).faults) == [("fingerprints", "changed: edge", n)]


def test_routes(spark):
    """No route, two routes, other ends, loops and negations are each named; a reason lets a genus move."""
    g = graph(spark, [(2, "14", 1, None), (2, "22", 4, 50), (3, "14", 1, None), (2, "61", 4, None)])
    archive = [(2, *r) for r in g.edge.filter("subject = 2").select("id", "subject", "code", "target", "context", "strength", "status").collect()]
    plan = lambda routes: reviewed.planned_routes(g, batch(spark, reviewed_merges=[(2, 3, "low")], archived_edges=[tuple(x) for x in archive], routes=routes))
    routes, faults = plan([(1, 3, 1, None), (2, 3, 4, None), (4, 4, 3, None)])
    assert rows(faults) == [("routes", "subject changed", 4), ("routes", "target changed", 4)]
    routes, faults = plan([(1, 3, 4, "a better genus"), (2, 3, 4, None), (4, 3, 4, None)])
    assert rows(faults) == [] and rows(routes) == [(1, 3, "14", 4, 1, None), (2, 3, "22", 4, 1, 50), (4, 3, "61", 4, 1, None)]
    _, faults = plan([(1, 3, 3, "loop"), (2, 3, 4, None), (2, 3, 4, None), (9, 3, 4, None)])
    assert {(f, i) for _, f, i in rows(faults)} == {("self loop", 1), ("several routes", 2), ("no route", 4), ("route without an archived edge", 9)}


def test_verb_groups(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    forms = make([("abcdef",), ("abcdeg",), ("abcdx",), ("abc",), ("abc",), ("zzzzz1",), ("qqqqq",), ("abcdehся",)], "form string")
    got = dict(rows(lexical.verb_groups(forms, make([("zzzzz1", "c"), ("abcdx", "c"), ("none", "c")], "form string, canon string"), make([("abcdx",)], "form string"))))
    assert got["abcdef"] == got["abcdeg"] == got["abcdehся"] == "abcdef" and got["abcdx"] == got["zzzzz1"] == "@c"
    assert got["abc"] == "abc" and got["qqqqq"] == "qqqqq" and len(got) == 7


def test_noun_forms(spark):
    """Long endings are not cut down to three letters, and loans get their own forms."""
    one = lambda v: set(spark.range(1).select(lexical.noun_forms(F.lit(v))).first()[0])
    assert {"печатание", "печать"} <= one("печатать") and "полание" not in one("поливать")
    assert {"планир", "планирование"} & one("планировать") and "импорт" in one("импортировать") and "импортация" in one("импортировать")
    stem = lambda v: spark.range(1).select(lexical.verb_stem(F.lit(v)), lexical.noun_stem(F.lit(v)), lexical.is_infinitive(F.lit(v))).first()
    assert stem("учиться")[0] == "учи" and stem("рисовать")[0] == "рис"
    assert stem("твердость")[2] is False and stem("писать")[2] is True and stem("рисование")[1] == "рис"


@pytest.fixture(scope="module")
def made(spark):
    return materialized(qa.records(derived(spark, SF), 42, 200))


def test_records_enough(spark, made):
    assert made.count() == 200


@pytest.mark.parametrize(
    "column,value,error,tasks",
    [
        ("answer", "concat('9', answer)", "answer", "all"),
        ("question", "concat(question, '!')", "wording", "all"),
        ("messages", "slice(messages, 1, 2)", "messages", "all"),
        ("task", "'riddle'", "schema", "all"),
        ("facts", "array_append(facts, facts[0])", "facts", "all"),
        ("facts", "transform(facts, x -> struct(x.edge, x.subject, x.code, x.subject as target, x.strength))", "cycle", "parents ancestry shared_genus inference property"),
        ("facts", "transform(facts, x -> struct(x.edge, x.subject, x.code, x.target, 7L as strength))", "fact", "all"),
        ("facts", "slice(facts, 2, 50)", "missing", "parents"),
        ("domain", "array_append(domain, 99999999L)", "domain", "intersection difference count"),
        ("domain", "array_append(domain, domain[0])", "domain", "intersection difference count"),
        ("facts", "flatten(array_repeat(facts, 40))", "limits", "all"),
    ],
)
def test_tampering(spark, made, column, value, error, tasks):
    """Whatever is changed in a record of any task is found."""
    g = derived(spark, SF)
    wanted = list(qa.TASKS) if tasks == "all" else tasks.split()
    part = made.filter(F.col("task").isin(*wanted)).withColumn("n", F.row_number().over(Window.partitionBy("task").orderBy("id"))).filter("n <= 4").drop("n")
    kind = dict(part.dtypes)[column]
    out = qa.verified(g, materialized(part.withColumn(column, F.expr(value).cast(kind)))).collect()
    assert len(out) >= len(wanted) and all(error in r["errors"].split(",") for r in out)


def test_graph_disagrees(spark, made):
    """Records whose facts agree with themselves, but not with what the graph says now."""
    g = derived(spark, SF)
    more = g.edge.filter("code = '14' and subject between 2000001 and 2999999 and context = 1").limit(10**6).selectExpr("-id as id", "subject", "code", "7L as target", "context", "strength", "status").dropDuplicates(["subject"])
    changed = replace(g, edge=materialized(g.edge.unionByName(more)), kept={})
    errors = {r["id"]: r["errors"] for r in qa.verified(changed, made).collect()}
    parents = [r["id"] for r in made.filter("task = 'parents' and a between 2000001 and 2999999").collect()]
    assert parents and all("genus" in errors[i] and "missing" in errors[i] for i in parents)


def test_russian_records(spark):
    """Records in Russian are worded in Russian and sound; checked as English ones they are not."""
    g = derived(spark, SF)
    out = materialized(qa.records(g, 7, 40, lang="ru"))
    assert {r["errors"] for r in qa.verified(g, out, lang="ru").collect()} == {""}
    assert all("wording" in r["errors"] for r in qa.verified(g, out).collect())
    assert all(any("А" <= c <= "я" for c in r["question"]) for r in out.select("question").collect())
