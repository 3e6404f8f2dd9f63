"""Queries of reviewed batches, lexical work and diagrams with their evidence, over the derived graph and the text tables.

A batch is planted by SQL over the graph's own tables, so it grows with them; the same text makes it in the oracle.
"""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoloom.operators import audit, batch, lexical, qa, regions, reviewed
from ontoloom.operators import graph as ops
from ontoloom.plans.tables import materialized
from ontoloom.queries import _EUL, _EUP, _GENERA, _GENERA_CTES, _IDS, _KEYS, _KIND, _MASK, _x, query, table_query
from ontoloom.sources.model import Graph

_CUSTOMER = "id BETWEEN 2000001 AND 2999999"
#: A customer that a coextension ties to a supplier is no leaf.
_TIED = "(SELECT subject FROM edge WHERE code = '30')"
#: The tables of the planted batch, by name.
PLANTED = {
    "leaf_merges": f"SELECT c.id AS src, d.id AS dst, d.name AS dst_name FROM concept c JOIN concept d ON d.id = c.id + 1 WHERE c.{_CUSTOMER} AND c.id % 10 = 1 AND c.id NOT IN {_TIED}",
    "reviewed_merges": f"SELECT c.id AS src, d.id AS dst, d.name AS dst_name FROM concept c JOIN concept d ON d.id = c.id + 3 WHERE c.{_CUSTOMER} AND c.id % 20 = 10 AND c.id NOT IN {_TIED} AND c.id NOT IN (SELECT subject FROM edge WHERE strength = 0)",
    "renames": "SELECT id, name AS before, replace(name, '#', ' ') AS name FROM concept WHERE id BETWEEN 501 AND 599",
    "concepts": "SELECT concat('n', id) AS key, concat('office of ', name) AS name, id AS parent, CAST(1 AS BIGINT) AS context FROM concept WHERE id BETWEEN 200 AND 224",
    "concept_terms": "SELECT concat('n', id) AS key, concat('office of ', name) AS term, 'en' AS lang FROM concept WHERE id BETWEEN 200 AND 224 UNION ALL SELECT concat('n', id), concat('контора ', name), 'ru' FROM concept WHERE id BETWEEN 200 AND 224",
    "terms": "SELECT id, name, concat('land of ', name) AS term, 'en' AS lang FROM concept WHERE id BETWEEN 200 AND 224 UNION ALL SELECT id, name, 'brand', 'en' FROM concept WHERE id = 7",
    "remove_terms": "SELECT CAST(7 AS BIGINT) AS id, 'Марка' AS term, 'en' AS lang FROM concept WHERE id = 1",
    "repairs": "SELECT id, subject, code, target, context FROM edge WHERE code = '22' AND subject > 2000000 AND subject % 40 = 0 AND strength > 0",
    "replacements": "SELECT subject, '22' AS code, CAST(401 + (subject + 1) % 5 AS BIGINT) AS target, CAST(1 AS BIGINT) AS context, CAST(40 AS BIGINT) AS strength FROM edge WHERE code = '22' AND subject > 2000000 AND subject % 40 = 0 AND strength > 0",
    "edges": "SELECT id AS subject, '22' AS code, CAST(401 + id % 5 AS BIGINT) AS target, CAST(1 AS BIGINT) AS context, CAST(30 AS BIGINT) AS strength FROM concept WHERE id > 3000000 AND id % 7 = 0",
    "retired": "SELECT subject, code, target FROM edge WHERE code = '61' AND subject % 5 = 0",
    "own_edges": "SELECT id FROM edge WHERE code = '61'",
    "grammar": "SELECT code, name AS before, 'brings forth' AS name FROM rule WHERE code = '70'",
}
#: Archives and routes follow from the merges (mg: both kinds).
ARCHIVED = {
    "retained": "SELECT m.src, t.term, t.lang FROM mg m JOIN term t ON t.concept_id = m.src",
    "archived_concepts": "SELECT m.src, c.* FROM mg m JOIN concept c ON c.id = m.src",
    "archived_terms": "SELECT m.src, t.* FROM mg m JOIN term t ON t.concept_id = m.src",
    "archived_edges": "SELECT m.src, e.id, e.subject, e.code, e.target, e.context, e.strength, e.status FROM mg m JOIN edge e ON e.subject = m.src",
    "routes": "SELECT e.id AS edge, m.dst AS subject, e.target AS target FROM rm m JOIN edge e ON e.subject = m.src",
}


def _planted(g: Graph, changed: dict[str, str] | None = None) -> reviewed.Batch:
    """The planted batch; changed: other SQL for some of its tables."""
    tables = {"concept": g.concept, "term": g.term, "edge": g.edge, "rule": g.rule}

    def sql(text: str) -> DataFrame:
        for name in tables:
            text = text.replace(f"FROM {name}", f"FROM {{{name}}}").replace(f"JOIN {name}", f"JOIN {{{name}}}")
        return g.spark.sql(text, **{k: v for k, v in tables.items() if f"{{{k}}}" in text})

    out = {name: materialized(sql(text)) for name, text in (PLANTED | (changed or {})).items() if name in PLANTED}
    tables |= {"rm": out["reviewed_merges"], "mg": out["leaf_merges"].union(out["reviewed_merges"])}
    out |= {name: materialized(sql((changed or {}).get(name, text))) for name, text in ARCHIVED.items()}
    return reviewed.Batch(out)


def _made(g: Graph) -> reviewed.Outcome:
    if "planted" not in g.kept:
        g.kept["planted"] = reviewed.applied(g, _planted(g))
    return g.kept["planted"]


_PARTS = ", ".join(f"b_{n} AS ({q})" for n, q in PLANTED.items())
#: The graph after the batch: its steps by plain SQL.
_AFTER = f"""{_PARTS}, mg AS (SELECT * FROM b_leaf_merges UNION ALL SELECT * FROM b_reviewed_merges),
  nc AS (SELECT name, context, parent FROM b_concepts),
  ca AS (SELECT id, CASE WHEN id BETWEEN 501 AND 599 THEN replace(name, '#', ' ') ELSE name END AS name, context, processed FROM concept WHERE id NOT IN (SELECT src FROM mg)),
  e0 AS (SELECT * FROM edge WHERE subject NOT IN (SELECT src FROM mg) AND target NOT IN (SELECT src FROM mg)),
  e1 AS (SELECT subject, code, target, context, strength, CASE WHEN id IN (SELECT id FROM b_repairs) OR (code = '61' AND subject % 5 = 0) THEN 'rejected' ELSE status END AS status FROM e0),
  ad AS (SELECT subject, code, target, context, strength FROM b_replacements UNION SELECT subject, code, target, context, strength FROM b_edges UNION SELECT m.dst, e.code, e.target, e.context, e.strength FROM b_reviewed_merges m JOIN edge e ON e.subject = m.src),
  ne AS (SELECT * FROM ad WHERE (subject, code, target, context) NOT IN (SELECT (subject, code, target, context) FROM e0)),
  e2 AS (SELECT * FROM e1 UNION ALL SELECT subject, code, target, context, strength, 'ok' FROM ne)"""


@query(
    "SELECT c.name AS subject, e.code, e.target, e.context, e.strength, e.status FROM e2 e JOIN ca c ON c.id = e.subject UNION ALL SELECT name, '14', parent, context, NULL, 'ok' FROM nc",
    more=_AFTER,
)
def batch_applied(g: Graph) -> DataFrame:
    """All edges after the planted batch, subjects by name."""
    out = _made(g).graph
    return out.edge.join(out.concept.select(F.col("id").alias("subject"), "name"), "subject").select(F.col("name").alias("subject"), "code", "target", "context", "strength", "status")


@query(
    """SELECT * FROM (SELECT 'leaves_merged' AS operation, count(*) AS rows FROM b_leaf_merges UNION ALL SELECT 'concepts_merged', count(*) FROM b_reviewed_merges UNION ALL SELECT 'concepts_renamed', count(*) FROM b_renames UNION ALL SELECT 'concepts_added', count(*) FROM b_concepts
      UNION ALL SELECT 'terms_added', count(*) FROM (SELECT * FROM b_concept_terms UNION SELECT name, term, lang FROM b_terms) UNION ALL SELECT 'terms_removed', 1 UNION ALL SELECT 'edges_rejected', count(*) FROM b_repairs UNION ALL SELECT 'edges_withdrawn', count(*) FROM b_retired
      UNION ALL SELECT 'grammar_repaired', 1 UNION ALL SELECT 'edges_added', (SELECT count(*) FROM ne) + (SELECT count(*) FROM nc) UNION ALL SELECT 'edges_reused', (SELECT count(*) FROM ad) - (SELECT count(*) FROM ne) UNION ALL SELECT 'levels_set', (SELECT count(*) FROM lv WHERE new IS NOT NULL)) WHERE rows > 0""",
    more=_AFTER
    + """, ga AS (SELECT subject AS id FROM ne), lo AS (SELECT subject AS id FROM b_repairs UNION SELECT subject FROM b_retired),
      fl AS (SELECT subject AS id, bool_or(CAST(code AS INT) BETWEEN 15 AND 27 OR CAST(code AS INT) BETWEEN 70 AND 74) AS s, bool_or(CAST(code AS INT) BETWEEN 30 AND 64) AS p FROM e2 WHERE status = 'ok' GROUP BY subject),
      lv AS (SELECT id, CASE WHEN s AND ((have < level AND (g OR l)) OR (have > level AND l)) THEN level END AS new FROM (SELECT ca.id, coalesce(processed, 0) AS have, s, CASE WHEN p THEN 3 ELSE 2 END AS level, ca.id IN (SELECT id FROM ga) AS g, ca.id IN (SELECT id FROM lo) AS l FROM ca JOIN fl ON fl.id = ca.id))""",
)
def batch_counts(g: Graph) -> DataFrame:
    """What the planted batch did."""
    return _made(g).counts


@query("SELECT name, context, 'ca' AS origin FROM ca UNION ALL SELECT name, context, 'new' FROM nc", more=_AFTER)
def batch_concepts(g: Graph) -> DataFrame:
    """All concepts after the planted batch; ids of new ones lie beyond all others."""
    return _made(g).graph.concept.select("name", "context", F.when(F.col("id") >= 2**62, "new").otherwise("ca").alias("origin"))


@query(
    """SELECT c.name, t.term, t.lang FROM (SELECT concept_id, term, lang FROM term WHERE concept_id NOT IN (SELECT src FROM mg) AND NOT (concept_id = 7 AND term = 'Марка') UNION SELECT m.dst, t.term, t.lang FROM mg m JOIN term t ON t.concept_id = m.src
        UNION SELECT id, term, lang FROM b_terms UNION SELECT id, before, 'en' FROM b_renames UNION SELECT id, name, 'en' FROM b_renames) t JOIN ca c ON c.id = t.concept_id
      UNION ALL SELECT n.name, t.term, t.lang FROM b_concept_terms t JOIN b_concepts n ON n.key = t.key""",
    more=_AFTER,
)
def batch_terms(g: Graph) -> DataFrame:
    """All terms after the planted batch, by the names of their concepts."""
    out = _made(g).graph
    return out.term.join(out.concept.select(F.col("id").alias("concept_id"), "name"), "concept_id").select("name", "term", "lang")


#: What is wrong with the refused batch: other ends, archives that miss or repeat a term, routes that lack, repeat or lose an end, and more.
WRONG = {
    "repairs": PLANTED["repairs"].replace("target, context", "target + 1 AS target, context"),
    "renames": "SELECT id, concat(name, '!') AS before, replace(name, '#', ' ') AS name FROM concept WHERE id BETWEEN 501 AND 599",
    "replacements": PLANTED["replacements"] + " UNION ALL SELECT subject, code, target, context, CAST(1 AS BIGINT) FROM edge WHERE code = '61'",
    "own_edges": "SELECT id FROM edge WHERE code = '61' AND subject % 10 = 0",
    "archived_terms": "SELECT m.src, t.* FROM mg m JOIN term t ON t.concept_id = m.src WHERE m.src % 3 > 0 UNION ALL SELECT m.src, t.* FROM mg m JOIN term t ON t.concept_id = m.src WHERE m.src % 3 = 2",
    "routes": """SELECT e.id AS edge, CASE WHEN e.id % 4 = 3 THEN e.target ELSE m.dst END AS subject, CASE WHEN e.id % 16 = 1 THEN 1 ELSE e.target END AS target FROM rm m JOIN edge e ON e.subject = m.src WHERE NOT (e.code = '14' AND m.src % 60 = 10)
      UNION ALL SELECT e.id, m.dst, e.target FROM rm m JOIN edge e ON e.subject = m.src WHERE e.code = '22'""",
}
_BAD = {n: WRONG.get(n, q) for n, q in (PLANTED | ARCHIVED).items()}
_BAD_PARTS = ", ".join([*(f"b_{n} AS ({_BAD[n]})" for n in PLANTED), "mg AS (SELECT * FROM b_leaf_merges UNION ALL SELECT * FROM b_reviewed_merges), rm AS (SELECT * FROM b_reviewed_merges)", *(f"b_{n} AS ({_BAD[n]})" for n in ARCHIVED)])
_ROUTED = "rt AS (SELECT r.edge, r.subject, r.target, o.code, m.dst AS s, o.target AS t FROM b_routes r JOIN edge o ON o.id = r.edge JOIN rm m ON m.src = o.subject)"
_ROUTE_FAULTS = """SELECT 'routes' AS stage, 'no route' AS fault, e.id FROM rm m JOIN edge e ON e.subject = m.src WHERE e.id NOT IN (SELECT edge FROM b_routes) UNION SELECT 'routes', 'several routes', edge FROM b_routes GROUP BY edge HAVING count(*) > 1
  UNION SELECT 'routes', 'subject changed', edge FROM rt WHERE subject <> s UNION SELECT 'routes', 'target changed', edge FROM rt WHERE target <> t UNION SELECT 'routes', 'self loop', edge FROM rt WHERE subject = target"""


@query(_ROUTE_FAULTS, more=f"{_BAD_PARTS}, {_ROUTED}")
def merge_route_faults(g: Graph) -> DataFrame:
    """Archived edges with no route, with several, and with routes to other ends."""
    return reviewed.planned_routes(g, _planted(g, WRONG))[1].distinct()


@query("SELECT e.id AS edge, m.dst AS subject, e.code, e.target, e.context, e.strength FROM b_reviewed_merges m JOIN edge e ON e.subject = m.src", more=_AFTER)
def merge_routes(g: Graph) -> DataFrame:
    """Where every archived edge goes."""
    return reviewed.planned_routes(g, _planted(g))[0]


@query("SELECT src FROM mg WHERE src % 3 <> 1", more=_BAD_PARTS)
def archive_match(g: Graph) -> DataFrame:
    """Sources whose terms are not the bag that their archive holds: a third of the archives has none, a third has them twice."""
    b = _planted(g, WRONG)
    merges = b.tables["leaf_merges"].union(b.tables["reviewed_merges"])
    now = g.term.join(merges.select(F.col("src").alias("concept_id")), "concept_id", "left_semi").withColumn("src", F.col("concept_id"))
    return reviewed.unlike(now, b.tables["archived_terms"], "src")


@query(
    _ROUTE_FAULTS
    + """ UNION SELECT 'leaf_merges', 'terms changed', src FROM b_leaf_merges WHERE src % 3 <> 1 UNION SELECT 'reviewed_merges', 'terms changed', src FROM b_reviewed_merges WHERE src % 3 <> 1
      UNION SELECT 'renames', 'name changed', id FROM concept WHERE id BETWEEN 501 AND 599 UNION SELECT 'repairs', 'edge changed', id FROM b_repairs UNION SELECT 'replacements', 'changes a strength', subject FROM edge WHERE code = '61'
      UNION SELECT 'retired', 'edge of another source', e.id FROM edge e JOIN b_retired r ON r.subject = e.subject AND r.code = e.code AND r.target = e.target WHERE e.subject % 10 <> 0
      UNION SELECT 'routes', 'self loop', subject FROM rt WHERE subject = target
      UNION SELECT 'routes', 'cycle', subject FROM rt WHERE code = '14' AND subject <> target AND (subject, target) IN (SELECT (ancestor, descendant) FROM kb) UNION SELECT 'routes', 'redundant', subject FROM rt WHERE code = '14' AND subject <> target AND (subject, target) IN (SELECT (descendant, ancestor) FROM kb) AND (subject, target) NOT IN (SELECT (subject, target) FROM edge WHERE code = '14')
      UNION SELECT 'routes', CASE WHEN subject NOT IN (SELECT descendant FROM kb WHERE ancestor IN (2, 3)) THEN 'signature_subject' ELSE 'signature_object' END, subject FROM rt WHERE code = '22' AND subject <> target AND (subject NOT IN (SELECT descendant FROM kb WHERE ancestor IN (2, 3)) OR target NOT IN (SELECT descendant FROM kb WHERE ancestor = 5))""",
    more=f"{_BAD_PARTS}, {_ROUTED}",
)
def batch_refused(g: Graph) -> DataFrame:
    """Every precondition that the wrong batch breaks; nothing of it is done."""
    out = reviewed.applied(g, _planted(g, WRONG))
    assert out.graph is g
    return out.faults


def _broken(g: Graph) -> Graph:
    """The graph after a change that went wrong: a new cycle, negations taken away, sources of merges left, English terms lost."""
    e = g.edge.filter("not (code = '22' and strength = 0 and subject % 2 = 0)")
    cycle = g.spark.sql("SELECT -id AS id, CAST(2 AS BIGINT) AS subject, '14' AS code, id AS target, CAST(1 AS BIGINT) AS context, CAST(NULL AS BIGINT) AS strength, 'ok' AS status FROM {concept} WHERE id BETWEEN 100 AND 104", concept=g.concept)
    gone = g.edge.filter("code = '14'").select(F.col("target").alias("id")).distinct()
    term = g.term.join(gone.withColumnRenamed("id", "concept_id"), "concept_id", "left_anti").select(*g.term.columns)
    return replace(g, edge=materialized(e.unionByName(cycle)), term=materialized(term), kept={})


@query(
    """SELECT 'cycle' AS issue, id, '' AS detail FROM ed WHERE code = '14' AND ((subject = 2 AND target BETWEEN 100 AND 104) OR (target = 2 AND subject BETWEEN 100 AND 104)) AND status = 'ok'
      UNION ALL SELECT 'negation lost', id, '' FROM edge WHERE code = '22' AND strength = 0 AND subject % 2 = 0
      UNION ALL SELECT 'missing_' || lang, concept_id, '' FROM (SELECT DISTINCT concept_id, lang FROM term WHERE concept_id IN (SELECT target FROM edge WHERE code = '14'))
      UNION ALL SELECT 'without_latin_en', concept_id, '' FROM (SELECT DISTINCT concept_id FROM term WHERE lang = 'en' AND regexp_matches(term, '[A-Za-z]') AND concept_id IN (SELECT target FROM edge WHERE code = '14'))
      UNION ALL SELECT 'merge unfinished', src, '' FROM mg UNION ALL SELECT 'terms lost', src, '' FROM mg WHERE src IN (SELECT concept_id FROM term)
      UNION ALL SELECT 'route lost', e.id, '' FROM b_reviewed_merges m JOIN edge e ON e.subject = m.src WHERE (m.dst, e.code, e.target, e.context) NOT IN (SELECT (subject, code, target, context) FROM edge)""",
    more=_AFTER + ", ed AS (SELECT * FROM edge UNION ALL SELECT -id, 2, '14', id, 1, NULL, 'ok' FROM concept WHERE id BETWEEN 100 AND 104)",
)
def batch_regressions(g: Graph) -> DataFrame:
    """What a change that went wrong has broken: new cycles, lost negations, unfinished merges, lost terms and routes."""
    return reviewed.regressions(g, _broken(g), _planted(g))


@query("SELECT * FROM (SELECT '' AS issue, CAST(0 AS BIGINT) AS id, '' AS detail) WHERE issue <> ''")
def batch_verified(g: Graph) -> DataFrame:
    """The planted batch breaks nothing: no rows. Concepts that it makes have terms in both languages."""
    return reviewed.regressions(g, _made(g).graph, _planted(g))


def _lexical(g: Graph, wrong: bool) -> reviewed.Batch:
    """Nations get Russian names; wrong: names that are no terms, terms that are not there, and a fingerprint of another table."""
    sql = lambda text: materialized(g.spark.sql(text.replace("FROM concept", "FROM {concept}"), concept=g.concept))
    tables = {name: sql(text) for name, text in (_LEXICAL | (_LEXICAL_WRONG if wrong else {})).items()}
    mark = batch.fingerprint(g.edge if wrong else g.term)
    return reviewed.Batch(tables | {"fingerprints": materialized(mark.select(F.lit("term").alias("table"), "rows", "digest"))})


_LEXICAL = {
    "renames": "SELECT id, name AS before, concat('страна ', id) AS name FROM concept WHERE id BETWEEN 200 AND 224",
    "terms": "SELECT id, concat('страна ', id) AS term, 'ru' AS lang FROM concept WHERE id BETWEEN 200 AND 224 UNION ALL SELECT id, concat('part ', id), 'en' FROM concept WHERE id BETWEEN 1000001 AND 1999999",
    "remove_terms": "SELECT id, name AS term, 'en' AS lang FROM concept WHERE id BETWEEN 1000001 AND 1999999",
}
_LEXICAL_WRONG = {
    "renames": _LEXICAL["renames"].replace("concat('страна ', id)", "concat('земля ', id)"),
    "terms": _LEXICAL["terms"] + " UNION ALL SELECT id, name, 'de' FROM concept WHERE id BETWEEN 300 AND 399",
    "remove_terms": _LEXICAL["remove_terms"] + " UNION ALL SELECT id, 'no such term', 'en' FROM concept WHERE id BETWEEN 100 AND 104",
}


@query(
    "SELECT concept_id, term, lang FROM term WHERE NOT (concept_id BETWEEN 1000001 AND 1999999 AND lang = 'en') UNION SELECT id, 'страна ' || id, 'ru' FROM concept WHERE id BETWEEN 200 AND 224 UNION SELECT id, 'part ' || id, 'en' FROM concept WHERE id BETWEEN 1000001 AND 1999999",
    uses=(),
)
def lexicon_repaired(g: Graph) -> DataFrame:
    """All terms after a repair of names and terms."""
    return reviewed.lexical_repair(g, _lexical(g, False)).graph.term


@query(
    """SELECT 'fingerprints' AS stage, 'changed: term' AS fault, count(*) AS id FROM term UNION ALL SELECT 'renames', 'name is no term', id FROM concept WHERE id BETWEEN 200 AND 224
      UNION ALL SELECT 'terms', 'invalid', id FROM concept WHERE id BETWEEN 300 AND 399 UNION ALL SELECT 'remove_terms', 'not there', id FROM concept WHERE id BETWEEN 100 AND 104""",
    uses=(),
)
def lexicon_refused(g: Graph) -> DataFrame:
    """Why a stale repair is refused."""
    return reviewed.lexical_repair(g, _lexical(g, True)).faults


# restored edges
#: A version whose action edges were pruned; what stands above and what was there before.
_LOST = "SELECT id FROM edge WHERE code = '22' AND (subject < 100 OR subject % 3 > 0)"
_PLUS = """SELECT -subject AS id, subject, code, target, context, strength, status FROM (SELECT CAST(t.s AS BIGINT) AS subject, '22' AS code, CAST(401 + k.k AS BIGINT) AS target, CAST(1 AS BIGINT) AS context, CAST(70 AS BIGINT) AS strength, 'ok' AS status
  FROM (SELECT id AS s FROM concept WHERE id BETWEEN 2 AND 3 OR id BETWEEN 100 AND 104 OR id = 6) t CROSS JOIN (SELECT 1 AS k) k) p"""


@query(
    """SELECT l.subject, l.code, l.target, l.id NOT IN (SELECT b.id FROM los b JOIN kb ON kb.descendant = b.subject JOIN alw u ON u.subject = kb.ancestor AND u.code = b.code AND u.target = b.target) AS restored FROM los l""",
    more=f"""ver AS (SELECT id, subject, code, target, context, strength, status FROM edge UNION ALL {_PLUS}), los AS (SELECT * FROM ver WHERE code = '22' AND (id < 0 OR id IN ({_LOST}))),
      liv AS (SELECT * FROM ver WHERE code = '22' AND id NOT IN (SELECT id FROM los)), alw AS (SELECT subject, code, target FROM liv UNION SELECT subject, code, target FROM los)""",
)
def edges_restored(g: Graph) -> DataFrame:
    """Pruned action edges that come back from the top down. An edge hides those of all that lie below it whether it stood or came back, or is
    itself hidden by one above that does; so what the rounds leave is what has nothing at all above it."""
    plus = g.spark.sql(_PLUS.replace("FROM concept", "FROM {concept}"), concept=g.concept)
    before = materialized(g.edge.unionByName(plus))
    now = g.edge.join(g.spark.sql(_LOST.replace("FROM edge", "FROM {edge}"), edge=g.edge), "id", "left_anti").select(*g.edge.columns)
    return reviewed.restored(before, now, ops.merged_closure(g).select("ancestor", "descendant")).select("subject", "code", "target", "restored")


# diagrams
_WAYS = """cx AS (SELECT subject AS a, target AS b, id AS e FROM pos1 WHERE code = '30' UNION ALL SELECT target, subject, id FROM pos1 WHERE code = '30'), st AS (SELECT subject AS a, target AS b, id AS e FROM pos1 WHERE code = '14' UNION ALL SELECT a, b, e FROM cx)"""


def _ways(name: str, step: str, seeds: str) -> str:
    """Recursion over simple ways, then the shortest of the least edge ids."""
    return f"""{name}0 AS (SELECT id AS seed, id AS node, CAST([] AS BIGINT[]) AS es, [id] AS vs FROM {seeds} UNION ALL SELECT p.seed, s.b, list_append(p.es, s.e), list_append(p.vs, s.b) FROM {name}0 p JOIN {step} s ON s.a = p.node WHERE NOT list_contains(p.vs, s.b)),
      {name} AS (SELECT seed, node, es FROM {name}0 QUALIFY row_number() OVER (PARTITION BY seed, node ORDER BY len(es), es) = 1)"""


def _evidence_sql() -> str:
    shown = lambda codes, ways, name: f"{name} AS (SELECT a, b, es FROM (SELECT l.seed AS a, r.seed AS b, list_concat(list_concat(l.es, [e.id]), r.es) AS es, e.id, e.k FROM (SELECT id, subject AS x, target AS y, 0 AS k FROM pos1 WHERE code IN {codes} UNION ALL SELECT id, target, subject, 1 FROM pos1 WHERE code IN {codes}) e JOIN {ways} l ON l.node = e.x JOIN {ways} r ON r.node = e.y WHERE l.seed < r.seed) QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY id, k) = 1)"
    return f"{_WAYS}, {_ways('wu', 'st', 'sel')}, {_ways('ws', 'cx', 'sel')}, {shown(('40', '40'), 'ws', 'eo')}, {shown(('60', '64'), 'wu', 'ed')}, " + (
        f"kk AS (SELECT a, b, {_KIND} AS kind FROM ek), ev AS (SELECT k.a, k.b, k.kind, list_concat(list_concat(CASE WHEN s.es IS NOT NULL THEN s.es ELSE list_concat(coalesce(u.es, []), coalesce(d.es, [])) END, coalesce(eo.es, [])), coalesce(ed.es, [])) AS es FROM kk k"
        " LEFT JOIN ws s ON s.seed = k.a AND s.node = k.b LEFT JOIN wu u ON u.seed = k.a AND u.node = k.b LEFT JOIN wu d ON d.seed = k.b AND d.node = k.a LEFT JOIN eo ON eo.a = k.a AND eo.b = k.b LEFT JOIN ed ON ed.a = k.a AND ed.b = k.b)"
    )


@query("SELECT a, b, kind, array_to_string(es, ',') AS edges, len(es) > 1 AND kind <> 'conflict' AS inferred FROM ev", more=_EUP + ", " + _evidence_sql())
def euler_evidence(g: Graph) -> DataFrame:
    """The edges that show how each two of the selected concepts lie."""
    return regions.evidence(g, _EUL).select("a", "b", "kind", ops.joined_ids("edges").alias("edges"), "inferred")


_PATHS = f"""dn AS (SELECT target AS a, subject AS b, id AS e FROM pos1 WHERE code = '14' UNION ALL SELECT subject, target, id FROM pos1 WHERE code = '30' UNION ALL SELECT target, subject, id FROM pos1 WHERE code = '30'),
  rs AS (SELECT CAST(unnest({_IDS}) AS BIGINT) AS id), {_ways("wd", "dn", "rs")}, fm AS (SELECT mask, id FROM m QUALIFY row_number() OVER (PARTITION BY mask ORDER BY id) <= 6)"""


@query("SELECT f.mask, f.id AS member, w.seed AS root, array_to_string(list_reverse(w.es), ',') AS edges FROM fm f JOIN wd w ON w.node = f.id", more=_x(*_IDS) + ",\n" + _MASK + ", " + _PATHS)
def catalog_member_paths(g: Graph) -> DataFrame:
    """The ways from the first members of each region up to the sets that hold them."""
    return regions.catalog_paths(g, _IDS).select("mask", "member", "root", ops.joined_ids("edges").alias("edges"))


_ASKED = [100, 2000017, 301, 9999999, 302, 3000017, 205, 501]
#: The asked ids' shared genera under names of their own; then pairs of all that are there.
_ASKED_SQL = (
    re.sub(r"\b(sel|sm|ust|eu|es|ovl|dis|ek|lk|al|h0|gu|hs|sz)\b", r"g_\1", _EUP.replace(str(_EUL)[1:-1], str(_ASKED)[1:-1]) + _GENERA_CTES + f", ag AS (SELECT genus, members, row_number() OVER (ORDER BY members DESC, genus) AS k FROM ({_GENERA}))")
    + f""", rq AS (SELECT CAST(unnest({_ASKED}) AS BIGINT) AS id, unnest(range(8)) AS place),
  th AS (SELECT q.id, q.place, coalesce(t.term, c.name) AS label FROM (SELECT id, place FROM rq UNION ALL SELECT genus, 7 + k FROM ag WHERE k <= 8) q JOIN concept c ON c.id = q.id
    LEFT JOIN (SELECT concept_id, term, row_number() OVER (PARTITION BY concept_id ORDER BY length(term), lower(term), term) AS k FROM term WHERE lang = 'en') t ON t.concept_id = c.id AND t.k = 1), """
    + _EUP.replace(f"SELECT CAST(unnest([{str(_EUL)[1:-1]}]) AS BIGINT) AS id", "SELECT id FROM th")
    + ", "
    + _evidence_sql()
)


@query(
    """SELECT 'concept' AS part, CAST(place AS INT) AS place, id AS a, CAST(NULL AS BIGINT) AS b, label, CAST(NULL AS BIGINT) AS n, '' AS edges FROM th UNION ALL SELECT 'missing', CAST(place AS INT), id, NULL, NULL, NULL, '' FROM rq WHERE id NOT IN (SELECT id FROM concept)
      UNION ALL SELECT 'automatic', CAST(7 + k AS INT), genus, NULL, NULL, members, '' FROM ag WHERE k <= 8 UNION ALL SELECT 'omitted', 0, NULL, NULL, NULL, greatest((SELECT count(*) FROM ag) - 8, 0), ''
      UNION ALL SELECT 'pair', 0, a, b, kind, CASE WHEN len(es) > 1 AND kind <> 'conflict' THEN 1 ELSE 0 END, array_to_string(es, ',') FROM ev""",
    more=_ASKED_SQL,
)
def euler_assembled(g: Graph) -> DataFrame:
    """The whole answer to a request of eight ids, one of which no concept has."""
    return regions.assembled(g, _ASKED).withColumn("edges", ops.joined_ids("edges"))


# lexical work
_WORDS = "SELECT DISTINCT lower(w) AS form FROM (SELECT unnest(regexp_extract_all(text, '(\\p{L}+)', 1)) AS w FROM documents) q"


@table_query(
    f"""WITH RECURSIVE f AS ({_WORDS}), ch AS (SELECT form, left(form, 5) AS k FROM f WHERE length(form) >= 5 AND form NOT LIKE '%x%'), g AS (SELECT c.form AS a, min(c.form) OVER (PARTITION BY c.k) AS b FROM ch c),
      h AS (SELECT form AS a, '@' || left(form, 4) AS b FROM f WHERE length(form) = 6), l AS (SELECT a, b FROM g UNION SELECT b, a FROM g UNION SELECT a, b FROM h UNION SELECT b, a FROM h),
      r AS (SELECT DISTINCT a AS n, a AS o FROM l UNION SELECT r.n, l.b FROM r JOIN l ON l.a = r.o)
      SELECT f.form, coalesce(m.grp, f.form) AS grp FROM f LEFT JOIN (SELECT n, min(o) AS grp FROM r GROUP BY n) m ON m.n = f.form"""
)
def verb_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of the documents in groups by their beginnings, tied by hints from words of six letters to canonical names."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = materialized(docs.select(F.explode(F.regexp_extract_all("text", F.lit("(\\p{L}+)"), F.lit(1))).alias("w")).select(F.lower("w").alias("form")).distinct())
    hints = words.filter(F.length("form") == 6).select("form", F.left("form", F.lit(4)).alias("canon"))
    return lexical.verb_groups(words, hints, words.filter(F.col("form").contains("x")))


_TAGGED = "CASE " + " ".join(f"WHEN regexp_matches(lemma, '(?:{'|'.join(ends)})$') THEN '{pos}'" for pos, ends in lexical.TAGS.items()) + " END"


@table_query(
    f"""WITH w AS (SELECT lower(w) AS lemma, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '(\\p{{L}}+)', 1)) AS w FROM documents) q GROUP BY 1), t AS (SELECT lemma, {_TAGGED} AS pos, n FROM w)
      SELECT lemma, pos, n FROM t WHERE pos IS NOT NULL AND length(lemma) >= 4 AND lemma NOT IN (SELECT lower(p_type) FROM part) AND lemma NOT IN ('other', 'under')"""
)
def lemma_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often words of the documents occur that an ending gives a part of speech and that name no type."""
    docs, part = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "part"))
    known = part.select(F.lower("p_type").alias("lemma"))
    return lexical.lemma_frequencies(lexical.tagged_words(docs), known, stop=("other", "under"))


#: Parts named by infinitives, nouns and both, from letters of their numbers; every fifth brand's are excluded by their names.
_STEM = "translate(CAST(id // 4 AS VARCHAR), '0123456789', 'бвгджзклмн')"
_NAMED = f"SELECT id, CASE id % 4 WHEN 0 THEN concat({_STEM}, 'ать') WHEN 1 THEN concat({_STEM}, 'ание') WHEN 2 THEN CASE WHEN id % 3 = 0 THEN concat({_STEM}, 'ение') ELSE concat({_STEM}, 'ка') END ELSE concat({_STEM}, 'ы') END AS name, context, processed FROM concept WHERE id BETWEEN 1000001 AND 1999999 UNION ALL SELECT id, name, context, processed FROM concept WHERE id < 1000000 OR id > 1999999"


def _named(g: Graph) -> Graph:
    text = _NAMED.replace("FROM concept", "FROM {concept}").replace("id // 4", "id div 4").replace("VARCHAR", "STRING")
    return replace(g, concept=materialized(g.spark.sql(text, concept=g.concept)), kept={})


_FORMS = f"""nm AS ({_NAMED}), vb AS (SELECT id AS verb, left(name, length(name) - 3) AS stem FROM nm WHERE name LIKE '%ать' AND id BETWEEN 1000001 AND 1999999),
  nn AS (SELECT id AS noun, CASE WHEN name LIKE '%ание' OR name LIKE '%ение' THEN left(name, length(name) - 4) ELSE name END AS stem, name LIKE '%ание' OR name LIKE '%ение' AS verbal FROM nm WHERE id BETWEEN 1000001 AND 1999999 AND name NOT LIKE '%ать'),
  sb AS (SELECT v.verb, p.target AS parent, count(*) AS n, min(x.noun) AS noun FROM vb v JOIN okg p ON p.subject = v.verb JOIN okg q ON q.target = p.target JOIN nn x ON x.noun = q.subject AND x.stem = v.stem GROUP BY v.verb, p.target),
  fs AS (SELECT DISTINCT verb, CASE WHEN n = 1 THEN noun END AS noun, CASE WHEN n = 1 THEN 'sibling' ELSE 'ambiguous' END AS source FROM sb),
  wd AS (SELECT v.verb, count(*) AS n, min(x.noun) AS noun FROM vb v JOIN nn x ON x.stem = v.stem AND x.verbal WHERE v.verb NOT IN (SELECT verb FROM fs WHERE noun IS NOT NULL) GROUP BY v.verb)"""


@query("SELECT verb, noun, source FROM fs UNION SELECT verb, CASE WHEN n = 1 THEN noun END, CASE WHEN n = 1 THEN 'stem' ELSE 'ambiguous' END FROM wd", more=_FORMS)
def verb_noun_pairs(g: Graph) -> DataFrame:
    """Parts named by infinitives with the part named by the noun of their stem."""
    return lexical.verb_noun_pairs(_named(g))


_DEVERBAL = lexical.DEVERBAL


@query(
    """SELECT v.verb, CASE WHEN k = 1 THEN a WHEN d = 1 THEN b END AS noun, coalesce(k, 0) AS names, CASE WHEN k IS NULL THEN 'none' WHEN k = 1 THEN 'only' WHEN d = 1 THEN 'ranked' ELSE 'ambiguous' END AS verdict FROM vb v
      LEFT JOIN (SELECT verb, count(*) AS k, min(noun) AS a, count(*) FILTER (dv) AS d, min(noun) FILTER (dv) AS b FROM ft GROUP BY verb) s ON s.verb = v.verb""",
    more=_FORMS
    + """, ft AS (SELECT v.verb, n.id AS noun, n.name LIKE '%ие' AS dv FROM vb v JOIN nm n ON n.id BETWEEN 1000001 AND 1999999 AND (n.name = v.stem || 'ание' OR n.name = v.stem || 'ение' OR (n.name = v.stem || 'ка' AND length(v.stem) >= 4)))""",
)
def attested_nouns(g: Graph) -> DataFrame:
    """Of the noun forms of each part named by an infinitive the one that a part bears."""
    return lexical.attested_nouns(_named(g))


#: Facts by name, with unknown names, unknown relations, repeats and what the rules refuse.
_FACTS = """SELECT name AS subject, '22' AS code, CASE WHEN id % 11 = 0 THEN 'no such thing' ELSE 'priority' END AS target, CAST(id % 100 + 1 AS BIGINT) AS strength FROM concept WHERE id BETWEEN 2000001 AND 2999999
  UNION ALL SELECT name, '22', 'priority', CAST(200 AS BIGINT) FROM concept WHERE id BETWEEN 2000001 AND 2999999 AND id % 4 = 0 UNION ALL SELECT concat(name, ' Ltd'), '22', 'priority', CAST(5 AS BIGINT) FROM concept WHERE id > 3000000
  UNION ALL SELECT name, '99', 'entity', CAST(5 AS BIGINT) FROM concept WHERE id BETWEEN 200 AND 224 UNION ALL SELECT name, '14', 'place', CAST(NULL AS BIGINT) FROM concept WHERE id BETWEEN 200 AND 224
  UNION ALL SELECT 'place', '14', name, CAST(NULL AS BIGINT) FROM concept WHERE id BETWEEN 200 AND 224 UNION ALL SELECT name, '14', 'place', CAST(NULL AS BIGINT) FROM concept WHERE id BETWEEN 100 AND 104"""


@query(
    """SELECT reason, count(*) AS facts FROM (SELECT CASE WHEN s IS NULL THEN 'unresolved subject' WHEN t IS NULL THEN 'unresolved target' WHEN code = '99' THEN 'unknown_code' WHEN code = '14' AND s = 2 THEN 'cycle'
        WHEN code = '14' AND s BETWEEN 100 AND 104 THEN 'duplicate' WHEN code = '14' THEN 'redundant' WHEN row_number() OVER (PARTITION BY s, code, t, c ORDER BY strength) > 1 THEN 'repeated' ELSE 'accepted' END AS reason FROM rf) GROUP BY reason""",
    more=_KEYS
    + f""", fa AS ({_FACTS}), fw AS (SELECT w, min(ka.id) AS id FROM (SELECT subject AS w FROM fa UNION SELECT target FROM fa) q JOIN ka ON ka.key = lower(w) GROUP BY w),
      rf AS (SELECT fa.code, fa.strength, s.id AS s, t.id AS t, c.context AS c FROM fa LEFT JOIN fw s ON s.w = fa.subject LEFT JOIN fw t ON t.w = fa.target LEFT JOIN concept c ON c.id = s.id)""",
)
def fact_reasons(g: Graph) -> DataFrame:
    """Why facts of a batch are accepted or not; the reasons add up to the batch."""
    facts = g.spark.sql(_FACTS.replace("FROM concept", "FROM {concept}"), concept=g.concept)
    return lexical.fact_edges(g, facts)[1]


#: A dictionary of the pages' titles: every third has a genus, known or not.
_ENTRIES = """SELECT term, CASE id % 3 WHEN 0 THEN 'brands' WHEN 1 THEN 'unheard kind' END AS genus, concat('the ', term) AS synonym, CASE WHEN id % 2 = 0 THEN 'AFRICA' END AS expansion
  FROM (SELECT concat(CASE WHEN id % 5 = 0 THEN 'sort of ' WHEN id % 5 = 1 THEN 'brand list ' ELSE '' END, name) AS term, id FROM concept WHERE id BETWEEN 2000001 AND 2999999) q"""
_PARENT_RULES = (("list", "brand"), ("sort", "no such parent"), ("customer", "party"))


@query(
    """SELECT name, parent, how FROM (SELECT term AS name, coalesce(genus, CASE WHEN lower(term) LIKE '%list%' THEN 'brand' WHEN lower(term) LIKE '%customer%' THEN 'party' ELSE 'entity' END) AS parent,
        CASE WHEN genus IS NOT NULL THEN 'genus' WHEN lower(term) LIKE '%list%' OR lower(term) LIKE '%customer%' THEN 'rule' ELSE 'default' END AS how FROM dc WHERE term NOT IN (SELECT name FROM concept WHERE id BETWEEN 2000001 AND 2999999)) UNION ALL SELECT DISTINCT genus, 'entity', 'default' FROM dc WHERE genus = 'unheard kind'""",
    more=f"dc AS ({_ENTRIES})",
)
def dictionary_concepts(g: Graph) -> DataFrame:
    """Where the new terms of a dictionary are hung: below their genus, by a rule, or by default."""
    entries = g.spark.sql(_ENTRIES.replace("FROM concept", "FROM {concept}"), concept=g.concept).select("term", "genus", F.array("synonym").alias("synonyms"), "expansion")
    return lexical.dictionary(g, entries, "entity", _PARENT_RULES)["concepts"].withColumnRenamed("by", "how")


#: Preferred terms are of every third part, in upper case, which is a term of no one; nations are excluded.
@query(
    """SELECT c.id, CASE WHEN c.id NOT BETWEEN 200 AND 224 THEN b.term END AS label, CASE WHEN c.id BETWEEN 200 AND 224 THEN 'excluded' WHEN b.term IS NULL THEN 'unsuitable' END AS reason FROM concept c LEFT JOIN (
        SELECT t.id, t.term FROM (SELECT DISTINCT concept_id AS id, term FROM term WHERE lang = 'en' AND regexp_matches(term, '[A-Za-z]') AND NOT regexp_matches(term, '[А-Яа-яЁё]') AND length(term) <= 90 AND NOT starts_with(lower(term), 'to ')) t
        LEFT JOIN (SELECT key, count(*) AS n FROM ky GROUP BY key) h ON h.key = lower(regexp_replace(trim(t.term), '\\s+', ' ', 'g')) QUALIFY row_number() OVER (PARTITION BY t.id ORDER BY t.id % 3 = 0 AND t.term <> upper(t.term), coalesce(h.n, 0) <> 1, length(t.term), lower(t.term), t.term) = 1) b ON b.id = c.id""",
    more=_KEYS,
)
def qa_labels(g: Graph) -> DataFrame:
    """The names by which questions call concepts."""
    liked = g.concept.filter("id % 3 = 0").select("id", F.upper("name").alias("term"))
    return qa.question_labels(g, "en", liked, g.concept.filter("id between 200 and 224").select("id"))


# small changes
@query("SELECT status, count(*) AS edges FROM (SELECT CASE WHEN status = 'candidate' THEN 'rejected' ELSE status END AS status FROM edge) GROUP BY status", faults=True, uses=())
def review_reject(g: Graph) -> DataFrame:
    """Candidates rejected; accepted and rejected edges stay what they are."""
    return batch.reviewed(g.edge, g.edge.select("id"), False).groupBy("status").agg(F.count("*").alias("edges"))


@query(
    "SELECT id, name, context FROM concept UNION ALL SELECT (SELECT max(id) FROM concept) + row_number() OVER (ORDER BY context, name), name, context FROM (SELECT DISTINCT name || ' annex' AS name, context FROM concept WHERE id BETWEEN 200 AND 224)",
    uses=(),
)
def concepts_added(g: Graph) -> DataFrame:
    """Names added to their contexts: those that are there keep their ids, new ones get the next ids."""
    names = g.concept.select("name", "context").union(g.concept.filter("id between 200 and 224").select(F.concat("name", F.lit(" annex")), "context"))
    return batch.with_concepts(g, names).select("id", "name", "context")


@query(
    "SELECT c.name, t.term, t.lang FROM (SELECT concept_id, term, lang FROM term UNION SELECT id, name, 'en' FROM concept WHERE id BETWEEN 501 AND 599 UNION SELECT id, 'No. ' || id, 'en' FROM concept WHERE id BETWEEN 501 AND 599) t JOIN (SELECT id, CASE WHEN id BETWEEN 501 AND 599 THEN 'No. ' || id ELSE name END AS name FROM concept) c ON c.id = t.concept_id",
    uses=(),
)
def concepts_renamed(g: Graph) -> DataFrame:
    """Terms after brands were renamed; a name that its context has already is not given."""
    names = g.concept.filter("id between 501 and 599").select("id", F.concat(F.lit("No. "), F.col("id").cast("string"))).union(g.concept.filter("id = 200").select("id", F.lit("place")))
    out = batch.renamed(g, names)
    return out.term.join(out.concept.select(F.col("id").alias("concept_id"), "name"), "concept_id").select("name", "term", "lang")


@query("SELECT id, CAST(row_number() OVER (ORDER BY CASE WHEN n > 0 THEN 0 ELSE 1 END, n, id) AS BIGINT) AS place FROM (SELECT c.id, coalesce(n.n, 0) AS n FROM concept c LEFT JOIN (SELECT target, count(*) AS n FROM edge WHERE status = 'ok' AND code = '14' GROUP BY target) n ON n.target = c.id WHERE c.processed < 2) QUALIFY place <= 50", uses=())
def frontier_order(g: Graph) -> DataFrame:
    """The first concepts to work on: those with few children first, leaves after all others."""
    return audit.frontier_first(g, 50)
