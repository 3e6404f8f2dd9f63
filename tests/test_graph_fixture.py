"""Cases on a small graph of boats: a homonym, two contexts, a diamond with opposite statements, coextension, negated links."""

from __future__ import annotations

import json

import pytest

from ontoloom.functions import text
from ontoloom.operators import batch, inherit
from ontoloom.operators import graph as ops
from ontoloom.plans.algebra import Algebra, page
from ontoloom.plans.language import LanguageError, as_dict, parse, written
from ontoloom.sources import snapshot

CONCEPTS = {
    1: "thing", 2: "vessel", 3: "sailboat", 4: "motorboat", 5: "motorsailer", 6: "dinghy", 7: "raft", 8: "hull", 10: "motoring", 11: "auxiliary yacht", 12: "launch",
    13: "harbour", 14: "fortified wine", 15: "crème", 16: "oak", 17: "steaming",
}
MORE_TERMS = [(3, "Segelboot", "de"), (7, "float", "en"), (4, 'the "KICKER"', "en"), (13, "port", "en"), (14, "port", "en")]
#: (id, subject, code, target, context, strength, status)
EDGES = [
    (101, 2, "14", 1, 1, None, "ok"), (102, 3, "14", 2, 1, None, "ok"), (103, 4, "14", 2, 1, None, "ok"), (104, 5, "14", 3, 1, None, "ok"), (105, 5, "14", 4, 1, None, "ok"),
    (106, 6, "14", 3, 1, None, "ok"), (107, 7, "14", 2, 1, None, "ok"), (108, 11, "14", 5, 1, None, "ok"), (109, 17, "14", 10, 1, None, "ok"), (110, 4, "30", 12, 1, None, "ok"),
    (111, 4, "22", 10, 1, 90, "ok"), (112, 3, "22", 10, 1, 0, "ok"), (113, 11, "22", 10, 1, None, "ok"), (114, 3, "23", 16, 1, None, "ok"), (115, 6, "61", 7, 1, None, "ok"),
    (116, 8, "14", 14, 3, None, "ok"), (117, 7, "14", 4, 1, None, "candidate"), (118, 6, "14", 4, 1, None, "rejected"), (119, 8, "14", 2, 1, 0, "ok"),
]


def rows(extra=()):
    edges = [*EDGES, *((200 + k, *e) for k, e in enumerate(extra))]
    return {
        "concept": [{"dharma": i, "nama": n, "universum_id": 3 if i == 14 else 1} for i, n in CONCEPTS.items()],
        "concept_term": [{"concept_id": i, "term": n, "lang": "en"} for i, n in CONCEPTS.items()] + [{"concept_id": i, "term": t, "lang": x} for i, t, x in MORE_TERMS],
        "edge": [dict(zip(("id", "dh1", "kod", "dh2", "universum_id", "strength", "status"), e, strict=True)) for e in edges],
        "relevant": [{"kod": c, "long_name": f"relation {c}", "is_symmetric": int(c in ("30", "61", "64"))} for c in ("14", "15", *map(str, range(20, 28)), "30", "61", "64", "70")],
        "universum": [{"id": 1, "nama": "everyday"}, {"id": 3, "nama": "technical"}],
    }


def loaded(spark, tmp_path, extra=(), change=None):
    data = rows(extra)
    if change:
        change(data)
    path = tmp_path / "graph.json"
    path.write_text("﻿" + json.dumps(data, ensure_ascii=False), encoding="utf-8")
    return snapshot.from_json(spark, str(path))


@pytest.fixture(scope="module")
def g(spark, tmp_path_factory):
    return snapshot.checked(loaded(spark, tmp_path_factory.mktemp("graph")), 1)


def ids(df):
    return {r["id"] for r in df.collect()}


@pytest.mark.parametrize(
    ("expression", "within", "want"),
    [
        ("sailboat & motorboat", None, {5, 11}),
        ("sailboat - motorboat", None, {3, 6}),
        ("sailboat ^ motorboat", None, {3, 4, 6, 12}),
        ("~dinghy", "sailboat", {3, 5, 11}),
        ("parents(exact(#5))", None, {3, 4}),
        ("ancestors(exact(motorsailer))", None, {1, 2, 3, 4}),
        ("ancestors(exact(motorsailer))", "sailboat | exact(vessel)", {2, 3}),
        ("children(exact(vessel))", None, {3, 4, 7}),
        ("descendants(exact(sailboat))", None, {5, 6, 11}),
        ("launch ^ motorboat", None, set()),
        ("ancestors(exact(launch))", None, set()),
        ("related(61, exact(dinghy))", None, {7}),
        ("related(61, exact(#7))", None, {6}),
        ("subjects(22, motoring)", None, {4, 11}),
        ("has(22, motoring)", None, {4, 11}),
        ("lacks(action, motoring)", None, {3, 6}),
        ("conflicts(22, motoring)", None, {5}),
        ("unknown(22, motoring) & vessel", None, {2, 7, 12}),
        ('de:"Segelboot" & #6', None, {6}),
        ("oak | EMPTY", None, {16}),
        ("(U - vessel) & (motoring ∪ #13)", None, {10, 13, 17}),
    ],
)
def test_sets(g, expression, within, want):
    assert ids(Algebra(g).set(expression, within)) == want


def test_contexts_are_apart(g):
    assert ids(Algebra(g, 3).set("#14")) == {8, 14}
    assert ids(Algebra(g, 1).set("#14")) == {14}
    assert ids(Algebra(g, 3).set("#3")) == {3}


@pytest.mark.parametrize(("a", "b"), [("sailboat", "#4"), ("raft", "#2"), ("oak", "EMPTY")])
def test_laws(g, a, b):
    x = Algebra(g)
    assert ids(x.set(f"~({a} | {b})")) == ids(x.set(f"~({a}) & ~({b})"))
    assert ids(x.set(f"({a}) | ~({a})")) == set(CONCEPTS)
    assert x.value(f"{a} & {b} <= {a}").first()["value"]


def test_states_partition(g):
    x = Algebra(g)
    found = [ids(x.set(f"{s}(22, motoring)")) for s in ("has", "lacks", "unknown", "conflicts")]
    assert sum(map(len, found)) == len(CONCEPTS) and set().union(*found) == set(CONCEPTS)


@pytest.mark.parametrize(
    ("expression", "want"),
    [
        ("count(sailboat)", 4), ("empty(sailboat & raft)", True), ("disjoint(motorboat, raft)", True), ("dinghy < sailboat", True), ("motorboat == launch", True), ("motorboat != launch", False),
        ("count(vessel) > count(sailboat)", True), ("count(vessel) == 8", True), ("empty(raft) == (raft < dinghy)", True),
    ],
)
def test_values(g, expression, want):
    assert Algebra(g).value(expression).first()["value"] == want


def test_regions(g):
    got = {r["region"]: (r["members"], r["counterexample"], r["sample"]) for r in Algebra(g).regions("sailboat <= dinghy").collect()}
    assert got == {"left_only": (3, True, "3,5,11"), "intersection": (1, False, "6"), "right_only": (0, False, "")}
    got = {r["region"]: (r["members"], r["sample"], r["truncated"]) for r in Algebra(g).regions("count(vessel) > count(sailboat)").collect()}
    assert got == {"left_counted": (8, "2,3,4,5,6", True), "right_counted": (4, "3,5,6,11", False)}
    assert [r["region"] for r in Algebra(g).regions("count(raft) == 1").collect()] == ["left_counted"]


def test_pages(g):
    got = [tuple(r) for r in page(Algebra(g).set("vessel"), 2, 3).collect()]
    assert got == [(4, 8, True, True), (5, 8, True, True), (6, 8, True, True)]
    assert [tuple(r) for r in page(Algebra(g).set("raft"), 0, 3).collect()] == [(7, 1, False, False)]


def test_specific_beats_near(spark, tmp_path):
    """An owner is overridden by one strictly below it, however short the other path is."""
    g2 = loaded(spark, tmp_path, [(15, "14", 6, 1, None, "ok"), (15, "14", 2, 1, None, "ok"), (2, "22", 10, 1, 50, "ok")])
    assert {r["id"]: r["state"] for r in inherit.states(g2, "22", 10).collect()}[15] == "negative"


def test_cycles_end(spark, tmp_path):
    g2 = loaded(spark, tmp_path, [(3, "14", 4, 1, None, "ok"), (4, "14", 3, 1, None, "ok")])
    state = {r["id"]: r["state"] for r in inherit.states(g2, "22", 10).collect()}
    assert state[3] == state[4] == "conflict" and state[11] == "positive"
    assert {(r["descendant"], r["ancestor"]) for r in ops.closure(g2).collect()} >= {(3, 4), (4, 3), (6, 4)}


@pytest.mark.parametrize(
    "bad",
    [
        "port", "nothing like this", "raft &", "raft < vessel < thing", "count(raft) & raft", "has(30, motoring)", "#0", "'open", "EMPTY & port", "sink(raft)", "raft ? hull", "related(nope, raft)",
        "(" * 70 + "raft" + ")" * 70, "empty(raft) < empty(hull)", "exact(raft | hull)", "has(22, raft | hull)", "de:raft", "()", "count()", "disjoint(raft)", "raft) | (hull", "~", "",
    ],
)
def test_errors(g, bad):
    with pytest.raises(LanguageError):
        Algebra(g).value(bad)


def test_errors_name_the_place(g):
    with pytest.raises(LanguageError) as e:
        Algebra(g).set("oak |\n port")
    assert e.value.candidates == (13, 14) and (e.value.line, e.value.column) == (2, 2) and (e.value.position, e.value.end) == (7, 11)
    with pytest.raises(LanguageError) as e:
        Algebra(g).set("oak", within="count(oak)")
    assert e.value.field == "within"


@pytest.mark.parametrize("e", ["a - b & c | ~d ^ e", 'en:"x y" ∪ #3', "count(a) >= count(exact(#1))", "has(action, #9) - related(61, U)", "disjoint(~(a | b), ∅)", "(a == b) != (c < d)", "a - (b - c)"])
def test_round_trip(e):
    once = written(parse(e))
    assert written(parse(once)) == once


def test_binding():
    assert written(parse("a + b * c")) == '"a" | "b" & "c"' == written(parse("a or (b and c)"))
    assert written(parse("(a | b) & c")) == '("a" | "b") & "c"'
    assert as_dict(parse("~#7 | U")) == {"kind": "binary", "value": "|", "start": 0, "end": 7, "args": [{"kind": "not", "start": 0, "end": 3, "args": [{"kind": "ref", "value": {"id": 7}, "start": 1, "end": 3}]}, {"kind": "constant", "value": "U", "start": 6, "end": 7}]}


def edge_ids(path):
    return None if path is None else [e["id"] for e in path]


def test_explained_sets(g):
    got = Algebra(g).explain("sailboat & motorboat - raft", 11)
    left, right = got["operands"]
    assert got["member"] and got["in_domain"] and left["member"] and not right["member"]
    assert [edge_ids(x["path"]) for x in left["operands"]] == [[108, 104], [108, 105]] and right["path"] is None
    assert not Algebra(g).explain("sailboat", 16)["member"]
    assert Algebra(g).explain("sailboat", 6, within="raft") == {"expression": "#3", "member": False, "path": None, "concept": 6, "in_domain": False}


def test_explained_from_the_concept_upwards(g, monkeypatch):
    """Whether extents hold one concept is told without making the extents, and as the sets tell it."""
    source = "sailboat & motorboat | ~vessel"
    held = {r["id"] for r in Algebra(g).set(source).collect()}
    monkeypatch.setattr(ops, "extents", None)
    assert [Algebra(g).explain(source, i)["member"] for i in (11, 6, 16)] == [i in held for i in (11, 6, 16)] == [True, False, True]


def test_explained_properties(g):
    fact = Algebra(g).explain("has(22, motoring)", 11)["fact"]
    assert fact["state"] == "positive" and fact["overridden_edge_ids"] == [111, 112]
    assert [(x["edge"]["id"], edge_ids(x["genus_path"])) for x in fact["evidence"]] == [(113, [])]
    fact = Algebra(g).explain("~lacks(22, motoring)", 5)["operands"][0]["fact"]
    assert fact["state"] == "conflict" and [(x["edge"]["id"], edge_ids(x["genus_path"])) for x in fact["evidence"]] == [(111, [105]), (112, [104])]
    assert Algebra(g).explain("unknown(22, motoring)", 16)["fact"]["evidence"] == []


def test_explained_navigation(g):
    x = Algebra(g)
    assert edge_ids(x.explain("ancestors(dinghy | exact(#11))", 2)["path"]) == [106, 102]  # 6 is the least seed below 2
    assert edge_ids(x.explain("descendants(exact(vessel))", 6)["path"]) == [106, 102]
    assert edge_ids(x.explain("parents(exact(dinghy))", 3)["path"]) == [106]
    assert x.explain("parents(exact(dinghy))", 2)["path"] is None
    assert edge_ids(x.explain("related(61, exact(#7))", 6)["edges"]) == [115] == edge_ids(x.explain("related(61, exact(#6))", 7)["edges"])
    assert x.explain("exact(#6)", 6)["record_id"] == 6


def test_explained_values(g):
    got = Algebra(g).explain("count(sailboat) > 3", 6)
    assert (got["kind"], got["value"]) == ("bool", True)
    count, number = got["operands"]
    assert (count["kind"], count["value"], number["value"]) == ("int", 4, 3) and count["operands"][0]["member"]


def test_paths_take_least_edge_ids(g):
    p = {(r["subject"], r["ancestor"]): r["edges"] for r in ops.witness_paths(g).collect()}
    assert p[11, 2] == [108, 104, 102] and p[4, 1] == [103, 101] and p[2, 2] == []


def test_unicode_terms(g):
    assert ids(Algebra(g).set('"crème"')) == {15} == ids(Algebra(g).set('"CRÈME"'))


@pytest.mark.parametrize(
    "change",
    [
        lambda d: d["concept"].append({"dharma": 5, "nama": "once more", "universum_id": 1}),
        lambda d: d["concept"].append({"dharma": 30, "nama": None, "universum_id": 1}),
        lambda d: d["concept"].append({"dharma": 30, "nama": "x", "universum_id": 9}),
        lambda d: d["edge"].append({"id": 99, "dh1": 77, "kod": "14", "dh2": 1, "universum_id": 1, "strength": None, "status": "ok"}),
        lambda d: d["edge"].append({"id": 99, "dh1": 2, "kod": "14", "dh2": 1, "universum_id": 1, "strength": None, "status": "ok"}),
        lambda d: d["edge"].append({"id": 99, "dh1": 16, "kod": "22", "dh2": 1, "universum_id": 1, "strength": 101, "status": "ok"}),
        lambda d: d["concept_term"].append({"concept_id": 99, "term": "x", "lang": "en"}),
        lambda d: d["relevant"].append({"kod": "14", "long_name": "x", "is_symmetric": 0}),
    ],
)
def test_bad_snapshots(spark, tmp_path, change):
    with pytest.raises(snapshot.SnapshotError):
        snapshot.checked(loaded(spark, tmp_path, change=change), 1)


def test_faults_elsewhere_do_not_count(spark, tmp_path):
    more = [(77, "14", 1, 3, None, "ok"), (78, "14", 1, 1, None, "rejected")]
    snapshot.checked(loaded(spark, tmp_path, more), 1)


def test_proposals(g, spark):
    b = spark.createDataFrame([(16, "14", 1, 1, None), (2, "14", 5, 1, None), (6, "14", 1, 1, None), (7, "61", 6, 1, None), (99, "14", 1, 1, None), (16, "98", 1, 1, None)], "subject long, code string, target long, context long, strength long")
    edges, report = batch.proposed(g, b)
    assert {r["verdict"]: r["edges"] for r in report.collect()} == {"ok": 1, "cycle": 1, "redundant": 1, "duplicate": 1, "missing": 1, "unknown_code": 1}
    assert edges.count() == g.edge.count() + 1


def test_merge_and_rename(g, spark):
    m = batch.merged(g, spark.createDataFrame([(6, 7)], "src long, dst long"))
    assert 6 not in ids(m.concept) and m.edge.filter("subject = 6 or target = 6").count() == 0
    assert m.term.filter("concept_id = 7").count() == 3
    r = batch.renamed(g, spark.createDataFrame([(16, "ash"), (8, "raft")], "id long, name string"))
    assert {x["id"]: x["name"] for x in r.concept.collect()}[16] == "ash"
    assert {x["id"]: x["name"] for x in r.concept.collect()}[8] == "hull"  # the name is taken
    new = batch.with_concepts(g, spark.createDataFrame([("oak", 1), ("oak", 3), ("brook", 1)], "name string, context long"))
    assert sorted((x["id"], x["name"]) for x in new.filter("id > 17").collect()) == [(18, "brook"), (19, "oak")]


def test_fingerprint_ignores_order(g):
    a, b = batch.fingerprint(g.term).first(), batch.fingerprint(g.term.repartition(7)).first()
    assert a == b != batch.fingerprint(g.term.filter("concept_id <> 7")).first()


def test_text_functions(spark):
    df = spark.createDataFrame([("colour", "color"), ("walking", "walked"), ("abc", "abd"), ("sparrow", "sparrows"), ("table", "tbl")], "a string, b string")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(text.near(F.col("a"), F.col("b"))).collect()] == [True, False, False, True, False]
    words = ["судь", "суд", "суеаоиаоиаед", "день", "дн", "colour", "color", "walking", "walked", "melt", "melts", "ab", "abe", "customer#1", "customer#12345678"]
    pairs = spark.createDataFrame([(x, y) for x in words for y in words], "a string, b string")
    got = pairs.select("a", "b", text.near(F.col("a"), F.col("b")).alias("near"), F.arrays_overlap(text.match_keys(F.col("a"), True), text.match_keys(F.col("b"), False)).alias("meet")).collect()
    alike = {tuple(sorted((r["a"], r["b"]))) for r in got if r["near"] and r["a"] != r["b"]}
    assert alike == {("суд", "судь"), ("color", "colour"), ("melt", "melts")}
    assert all(r["meet"] for r in got if r["near"]) and not any(r["meet"] for r in got if {r["a"], r["b"]} == {"customer#1", "customer#12345678"})


@pytest.mark.parametrize(
    ("article", "term", "genus", "expansion", "names"),
    [
        ("A wok is a round pan used for frying. Also known as a pow or wokpan, it is sometimes called the iron pot.", "wok", "round pan", None, ["pow", "wokpan", "iron pot"]),
        ("Short for wide area network, a WAN is a network of places. Alternatively called a long net (or so).", "WAN", None, "wide area network", ["long net"]),
        ("Developed in the last century by somebody, the zip is a special type of closure kind, 9.", "zip", None, None, []),
        ("The zip is a toothed closure type, for coats. It is also called 9lives and an endless list of words that goes on.", "zip", "toothed closure", None, ["an endless list of words that goes on"][:0]),
        ("A name is a word.", "name", None, None, []),
        ("No definition here", "x", None, None, []),
    ],
)
def test_facts_of_articles(spark, article, term, genus, expansion, names):
    from ontoloom.operators import retrieval

    got = retrieval.extracted(spark.createDataFrame([(1, term, article)], "page_id long, term string, text string")).first()
    assert (got["genus"], got["expansion"], got["synonyms"]) == (genus, expansion, "|".join(names))


def test_answer_lines(spark):
    from pyspark.sql import functions as F

    p = spark.createDataFrame([("- a | b\n2) c\td\nlonely",)], "s string").select(text.parsed_lines(F.col("s"), 2)).first()[0]
    assert p == [["a", "b"], ["c", "d"]]


def test_json_lines_are_not_overwritten(g, tmp_path):
    snapshot.write_json_lines(g.rule, str(tmp_path / "out"))
    with pytest.raises(Exception, match="(?i)exist"):
        snapshot.write_json_lines(g.rule, str(tmp_path / "out"))
    with pytest.raises(ValueError, match="two paths"):
        snapshot.write_records(g.rule, str(tmp_path / "x"), str(tmp_path / "x"))


def test_requests_and_nesting(spark):
    from ontoloom.operators import regions

    assert regions.requested([3, 1, 3, 2]) == [3, 1, 2]
    for bad in ([0], [-1], ["1"], [True], list(range(1, 10)), [1] * 33):
        with pytest.raises(ValueError, match="positive ids"):
            regions.requested(bad)
    pairs = spark.createDataFrame([(1, 2, "inside"), (2, 3, "inside"), (1, 3, "inside"), (3, 4, "contains"), (5, 6, "disjoint")], "a long, b long, kind string")
    assert {r["id"]: r["level"] for r in regions.nesting(pairs).collect()} == {1: 2, 2: 1, 3: 0, 4: 1, 5: 0, 6: 0}


def test_shared_genera(spark, tmp_path):
    """Siblings share a genus under its least alias; a selected genus, one on a cycle, and a broader one that adds no member do not count."""
    from ontoloom.operators import regions

    more = [(6, "14", 2, 1, None, "ok"), (5, "14", 2, 1, None, "ok"), (13, "14", 16, 1, None, "ok"), (16, "14", 13, 1, None, "ok"), (12, "14", 16, 1, None, "ok")]
    g2 = loaded(spark, tmp_path, more)
    found = lambda ids_: [(r["genus"], r["members"]) for r in regions.shared_genera(g2, ids_).collect()]
    assert found([3, 4]) == [(2, 2)] and found([3, 6]) == []
    assert found([5, 6]) == [(3, 2)]  # 2 is broader and has no other member
    assert found([5, 6, 7]) == [(2, 3), (3, 2)]
    assert found([4, 13]) == [(16, 2)][:0]  # 16 lies below 13, which has it
    assert found([2, 3, 4]) == []


def test_questions(g, spark):
    from ontoloom.operators import retrieval

    asked = [(1, "Is the dinghy like other sailboats, or a harbour?"), (2, "How fast are auxiliary yachts!"), (3, "why?"), (4, "Что такое raft («float»)?"), (5, "What is oak?")]
    got = retrieval.asked(g, spark.createDataFrame(asked, "qid long, question string")).orderBy("qid", "place").collect()
    assert [(r["qid"], r["id"], r["words"]) for r in got] == [(1, 6, 1), (1, 3, 1), (2, 11, 2), (4, 7, 1), (5, 16, 1)]
    prompt = retrieval.prompts(g, spark.createDataFrame(asked[4:], "qid long, question string")).first()["prompt"]
    assert prompt.startswith("Known:\n[everyday] ") and "Related: sailboat" in prompt and prompt.endswith("Question: What is oak?")
