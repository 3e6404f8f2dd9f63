"""Registry of the engine's queries and of the DuckDB SQL that each is held against.

Every query derives (or reads) the concept graph of the tables in its folder and applies one operator to the whole of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoloom.functions import text
from ontoloom.operators import audit, batch, inherit, qa, regions, retrieval, terms
from ontoloom.operators import graph as ops
from ontoloom.plans.algebra import Algebra, page
from ontoloom.plans.tables import materialized
from ontoloom.sources.derive import derived, oracle_prefix
from ontoloom.sources.model import Graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: SQL that is too slow on whole tables (it pairs all homonyms of a question); tests hold its queries against it on the smallest ones.
SMALL_SQL: dict[str, str] = {}

#: Common table expressions that oracles build on, by name; later ones use earlier ones.
SHARED = {
    "ok1": "SELECT * FROM edge WHERE status = 'ok' AND context = 1",
    "pos1": "SELECT * FROM ok1 WHERE strength IS NULL OR strength > 0",
    "g14": "SELECT DISTINCT subject, target FROM pos1 WHERE code = '14'",
    "clo": "SELECT id AS descendant, id AS ancestor FROM concept UNION SELECT c.descendant, g.target FROM clo c JOIN g14 g ON g.subject = c.ancestor",
    "up": "SELECT descendant, ancestor FROM clo WHERE descendant <> ancestor",
    "vis": "SELECT subject, code, target, id FROM pos1 UNION ALL SELECT target, code, subject, id FROM pos1 WHERE code IN (SELECT code FROM rule WHERE mutual)",
    "est": "SELECT target AS a, subject AS b FROM g14 UNION SELECT subject, target FROM pos1 WHERE code = '30' UNION SELECT target, subject FROM pos1 WHERE code = '30'",
    "okg": "SELECT DISTINCT subject, target FROM edge WHERE status = 'ok' AND code = '14'",
    "kb0": "SELECT id AS d, id AS a, 0 AS depth FROM concept UNION SELECT k.d, g.target, k.depth + 1 FROM kb0 k JOIN okg g ON g.subject = k.a WHERE k.depth < 25",
    "kb": "SELECT a AS ancestor, d AS descendant, CAST(min(depth) AS BIGINT) AS depth FROM kb0 WHERE a <> d GROUP BY a, d",
}
_SEEDS = "ext AS (SELECT s AS seed, s AS id FROM (SELECT unnest([{}]) AS s) v UNION SELECT e.seed, st.b FROM ext e JOIN est st ON st.a = e.id),\nx AS (SELECT seed, id FROM ext WHERE id IN (SELECT id FROM concept))"


def oracle(body: str, *, uses: tuple[str, ...] = tuple(SHARED), more: str = "", faults: bool = False) -> str:
    parts = [oracle_prefix(faults), *(f"{n} AS ({q})" for n, q in SHARED.items() if n in uses)]
    return ",\n".join([*parts, *([more] if more else [])]) + "\n" + body


def query(sql: str | None = None, *, more: str = "", faults: bool = False, name: str | None = None, uses: tuple[str, ...] = tuple(SHARED), small: bool = False):
    """Register f(graph) -> DataFrame as a query over the derived graph; uses: which common table expressions its SQL needs; small: the SQL is
    for the smallest tables."""

    def add(f: Callable[[Graph], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(derived(spark, sf_dir, faults))
        if sql:
            (SMALL_SQL if small else ORACLE_SQL)[key] = oracle(sql, uses=uses, more=more, faults=faults)
        return f

    return add


def table_query(sql: str | None = None):
    """Register f(spark, sf_dir) -> DataFrame."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _set(name: str, expression: str, sql: str, within: str | None = None, more: str = "") -> None:
    query(sql, more=more, name=name)(lambda g: Algebra(g).set(expression, within))


def _value(name: str, expression: str, sql: str, more: str = "") -> None:
    query(sql, more=more, name=name)(lambda g: Algebra(g).value(expression))


def _x(*seeds: int) -> str:
    return _SEEDS.format(", ".join(f"CAST({s} AS BIGINT)" for s in seeds))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of one region in one segment."""
    return QUERIES["set_intersection"](spark, sf_dir)


# set algebra
_A, _B = "(SELECT id FROM x WHERE seed = 100)", "(SELECT id FROM x WHERE seed = 301)"
_set("set_extent", "#100", f"SELECT id FROM {_A}", more=_x(100))
_set("set_exact", "exact(#100) | exact(#2000017)", "SELECT id FROM concept WHERE id IN (100, 2000017)")
_set("set_union", "#100 ∪ #301", f"{_A} UNION {_B}", more=_x(100, 301))
_set("set_intersection", "#100 & #301", f"{_A} INTERSECT {_B}", more=_x(100, 301))
_set("set_difference", "#100 \\ #301", f"{_A} EXCEPT {_B}", more=_x(100, 301))
_set("set_xor", "#100 xor #301", f"({_A} EXCEPT {_B}) UNION ({_B} EXCEPT {_A})", more=_x(100, 301))
_set("set_complement", "not (#3 or #4)", "SELECT id FROM concept WHERE id NOT IN (SELECT id FROM x)", more=_x(3, 4))
_set("set_within", "~#301", f"{_A} EXCEPT {_B}", within="#100", more=_x(100, 301))
_set("set_precedence", "#100 - #301 & #302 | exact(#5)", f"SELECT id FROM (({_A} EXCEPT {_B}) INTERSECT (SELECT id FROM x WHERE seed = 302)) UNION SELECT CAST(5 AS BIGINT)", more=_x(100, 301, 302))
_set("set_by_term", 'ru:"Африка" & ru:"сегмент" | en:"brand#11"', "SELECT id FROM x WHERE seed = 100 INTERSECT SELECT id FROM x WHERE seed = 6 UNION SELECT id FROM x WHERE seed = 511", more=_x(6, 100, 511))
_value("set_count", "count(#100 & #301)", f"SELECT count(*) AS value FROM ({_A} INTERSECT {_B})", more=_x(100, 301))
_value("set_empty", "empty(#100 & #101)", "SELECT count(*) = 0 AS value FROM (SELECT id FROM x WHERE seed = 100 INTERSECT SELECT id FROM x WHERE seed = 101)", more=_x(100, 101))
_value("set_disjoint", "disjoint(#301, #302)", "SELECT count(*) = 0 AS value FROM (SELECT id FROM x WHERE seed = 301 INTERSECT SELECT id FROM x WHERE seed = 302)", more=_x(301, 302))
_value("cmp_subset", "#301 ⊆ #6", "SELECT count(*) = 0 AS value FROM (SELECT id FROM x WHERE seed = 301 EXCEPT SELECT id FROM x WHERE seed = 6)", more=_x(6, 301))
_value("cmp_proper_subset", "#100 < #2", "SELECT (SELECT count(*) FROM (SELECT id FROM x WHERE seed = 100 EXCEPT SELECT id FROM x WHERE seed = 2)) = 0 AND (SELECT count(*) FROM x WHERE seed = 2) > (SELECT count(*) FROM x WHERE seed = 100) AS value", more=_x(2, 100))
_value("cmp_superset", "#2 ⊇ #3", "SELECT count(*) = 0 AS value FROM (SELECT id FROM x WHERE seed = 3 EXCEPT SELECT id FROM x WHERE seed = 2)", more=_x(2, 3))
_value("cmp_equal", "#100 & #301 == #301 - ~#100", f"SELECT count(*) = 0 AS value FROM ((({_A} INTERSECT {_B}) EXCEPT ({_B} EXCEPT (SELECT id FROM concept EXCEPT {_A}))) UNION ALL (({_B} EXCEPT (SELECT id FROM concept EXCEPT {_A})) EXCEPT ({_A} INTERSECT {_B})))", more=_x(100, 301))
_value("cmp_numeric", "count(#100) > count(#101)", "SELECT (SELECT count(*) FROM x WHERE seed = 100) > (SELECT count(*) FROM x WHERE seed = 101) AS value", more=_x(100, 101))

# navigation, projection, closures
_set("nav_parents", "parents(#100)", "SELECT DISTINCT target AS id FROM g14 WHERE subject IN (SELECT id FROM x) AND target IN (SELECT id FROM concept)", more=_x(100))
_set("nav_children", "children(exact(#6) | exact(#205))", "SELECT DISTINCT subject AS id FROM g14 WHERE target IN (6, 205)")
_set("nav_ancestors", "ancestors(#100 & #301)", f"SELECT DISTINCT ancestor AS id FROM up WHERE descendant IN ({_A} INTERSECT {_B})", more=_x(100, 301))
_set("nav_descendants", "descendants(exact(#100))", "SELECT descendant AS id FROM up WHERE ancestor = 100")
_set("proj_related", "related(70, #205)", "SELECT DISTINCT target AS id FROM vis WHERE code = '70' AND subject IN (SELECT id FROM x)", more=_x(205))
_set("proj_subjects", "subjects(action, #401 | #402)", "SELECT DISTINCT subject AS id FROM vis WHERE code = '22' AND target IN (SELECT id FROM x)", more=_x(401, 402))
_set("proj_symmetric", "related(61, exact(#203))", "SELECT DISTINCT target AS id FROM vis WHERE code = '61' AND subject = 203")


@query("SELECT descendant, ancestor FROM clo")
def closure_genus(g: Graph) -> DataFrame:
    return ops.closure(g)


@query("SELECT seed, id FROM x", more=_SEEDS.replace("SELECT unnest([{}]) AS s", "SELECT id AS s FROM concept"))
def closure_extent(g: Graph) -> DataFrame:
    return ops.extents(g, g.concept.select("id")).join(g.concept.select("id"), "id", "left_semi").select("seed", "id")


@query("SELECT ancestor, descendant, depth FROM kb")
def closure_kb_depth(g: Graph) -> DataFrame:
    return ops.merged_closure(g)


@query(
    "SELECT subject, ancestor, CAST(depth AS BIGINT) AS depth, array_to_string(edges, ',') AS path FROM (SELECT *, row_number() OVER (PARTITION BY subject, ancestor ORDER BY depth, edges) AS k FROM p) WHERE k = 1 AND depth > 0",
    more="p AS (SELECT id AS subject, id AS ancestor, 0 AS depth, CAST([] AS BIGINT[]) AS edges FROM concept UNION ALL SELECT p.subject, e.target, p.depth + 1, list_append(p.edges, e.id) FROM p JOIN pos1 e ON e.subject = p.ancestor AND e.code = '14')",
)
def witness_path(g: Graph) -> DataFrame:
    return ops.witness_paths(g).filter("depth > 0").select("subject", "ancestor", "depth", ops.joined_ids("edges").alias("path"))


_PAIRS = """SELECT a, b FROM (SELECT id AS a, 100 + id % 5 AS b FROM concept WHERE id BETWEEN 2000001 AND 2999999 UNION ALL SELECT 100 + id % 5, id FROM concept WHERE id BETWEEN 2000001 AND 2999999
  UNION ALL SELECT id, 1000000 + id % 100 FROM concept WHERE id BETWEEN 3000001 AND 3999999 UNION ALL SELECT id, id + 1 FROM concept WHERE id BETWEEN 200 AND 223
  UNION ALL SELECT id, 9999999 FROM concept WHERE id = 1) q"""


@query(
    """SELECT p.a, p.b, CASE WHEN p.a NOT IN (SELECT id FROM concept) OR p.b NOT IN (SELECT id FROM concept) THEN 'unknown' WHEN u.depth IS NOT NULL THEN 'yes' WHEN d.depth IS NOT NULL THEN 'reverse'
      WHEN n.x IS NOT NULL THEN 'direct' WHEN m.x IS NOT NULL THEN 'indirect' ELSE 'no' END AS verdict,
      CASE WHEN p.b NOT IN (SELECT id FROM concept) THEN NULL ELSE coalesce(u.depth, d.depth, CASE WHEN n.x IS NOT NULL THEN 1 WHEN m.x IS NOT NULL THEN 2 END) END AS depth
    FROM pairs p LEFT JOIN kb u ON u.descendant = p.a AND u.ancestor = p.b LEFT JOIN kb d ON d.ancestor = p.a AND d.descendant = p.b
    LEFT JOIN nb n ON n.x = p.a AND n.y = p.b LEFT JOIN two m ON m.x = p.a AND m.y = p.b""",
    more=f"""pairs AS (SELECT DISTINCT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM ({_PAIRS})),
      nb AS (SELECT subject AS x, target AS y FROM edge WHERE status = 'ok' UNION SELECT target, subject FROM edge WHERE status = 'ok'),
      two AS (SELECT DISTINCT p.a AS x, p.b AS y FROM pairs p JOIN nb m ON m.x = p.a JOIN nb k ON k.x = m.y AND k.y = p.b)""",
)
def verify_pairs(g: Graph) -> DataFrame:
    return ops.verify(g, g.spark.sql(_PAIRS.replace("concept", "{concept}"), concept=g.concept).select(F.col("a").cast("long"), F.col("b").cast("long")))


@query(
    "SELECT DISTINCT root, node, parent, context, CAST(depth AS BIGINT) AS depth FROM t WHERE depth > 0",
    more="""t AS (SELECT id AS root, CAST(NULL AS BIGINT) AS node, id AS parent, CAST(NULL AS BIGINT) AS context, 0 AS depth, [id] AS path FROM concept
      UNION ALL SELECT t.root, e.subject, e.target, e.context, t.depth + 1, list_append(t.path, e.target) FROM t JOIN edge e ON e.subject = t.parent AND e.code = '14' AND e.status = 'ok' WHERE NOT list_contains(t.path, e.target) AND t.depth < 10)""",
)
def tree_up(g: Graph) -> DataFrame:
    return ops.tree_up(g, g.concept.select("id"))


#: Trees below every concept: levels of the first 200 children by their own numbers of children, each node once a tree.
_DOWN = """dn AS (SELECT target AS parent, subject AS node FROM okg), sz AS (SELECT parent AS node, count(*) AS n FROM dn GROUP BY parent),
      rk AS (SELECT parent, node FROM (SELECT d.parent, d.node, row_number() OVER (PARTITION BY d.parent ORDER BY coalesce(s.n, 0) DESC, d.node) AS k FROM dn d LEFT JOIN sz s ON s.node = d.node) WHERE k <= 200),
      l1 AS (SELECT parent AS root, parent, node, CAST(1 AS BIGINT) AS depth FROM rk WHERE node <> parent),
      l2 AS (SELECT l1.root, min(rk.parent) AS parent, rk.node, CAST(2 AS BIGINT) AS depth FROM l1 JOIN rk ON l1.node = rk.parent WHERE rk.node <> l1.root AND (l1.root, rk.node) NOT IN (SELECT (root, node) FROM l1) GROUP BY l1.root, rk.node),
      l3 AS (SELECT l2.root, min(rk.parent) AS parent, rk.node, CAST(3 AS BIGINT) AS depth FROM l2 JOIN rk ON l2.node = rk.parent WHERE rk.node <> l2.root AND (l2.root, rk.node) NOT IN (SELECT (root, node) FROM l1 UNION ALL SELECT (root, node) FROM l2) GROUP BY l2.root, rk.node),
      td AS (SELECT root, parent, node, depth FROM l1 UNION ALL SELECT root, parent, node, depth FROM l2 UNION ALL SELECT root, parent, node, depth FROM l3)"""


@query("SELECT root, parent, node, depth FROM td", more=_DOWN, uses=("okg",))
def tree_down(g: Graph) -> DataFrame:
    return ops.tree_down(g, g.concept.select("id"))


@query(
    "SELECT id, min(n) AS component FROM r GROUP BY id",
    more="""l AS (SELECT subject AS a, target AS b FROM pos1 WHERE code IN ('30', '61') UNION SELECT target, subject FROM pos1 WHERE code IN ('30', '61')),
      r AS (SELECT DISTINCT a AS id, a AS n FROM l UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.n)""",
)
def components(g: Graph) -> DataFrame:
    return ops.components(g.scope(1).filter(F.col("code").isin("30", "61")).select(F.col("subject").alias("a"), F.col("target").alias("b")))


@query("SELECT subject AS id, target AS parent FROM (SELECT e.subject, e.target, row_number() OVER (PARTITION BY e.subject ORDER BY CASE WHEN e.context = c.context THEN 0 ELSE 1 END, e.id) AS k FROM edge e JOIN concept c ON c.id = e.subject WHERE e.status = 'ok' AND e.code = '14') WHERE k = 1")
def home_parent(g: Graph) -> DataFrame:
    return ops.home_parent(g)


@query("SELECT x AS id, y AS other, count(*) AS links FROM (SELECT subject AS x, target AS y FROM edge WHERE status = 'ok' AND subject <> target UNION ALL SELECT target, subject FROM edge WHERE status = 'ok' AND subject <> target) GROUP BY x, y")
def neighbour_links(g: Graph) -> DataFrame:
    return ops.neighbours(g)


@query(
    """SELECT c.id, c.name, coalesce(p.parents, '') AS parents, coalesce(k.n, 0) AS children, coalesce(o.n, 0) AS outgoing, coalesce(i.n, 0) AS incoming FROM concept c
    LEFT JOIN (SELECT e.subject, string_agg(DISTINCT d.name || '@' || e.context, ', ' ORDER BY d.name || '@' || e.context) AS parents FROM edge e JOIN concept d ON d.id = e.target WHERE e.status = 'ok' AND e.code = '14' GROUP BY e.subject) p ON p.subject = c.id
    LEFT JOIN (SELECT target, count(*) AS n FROM edge WHERE status = 'ok' AND code = '14' GROUP BY target) k ON k.target = c.id
    LEFT JOIN (SELECT subject, count(*) AS n FROM edge WHERE status = 'ok' AND code <> '14' GROUP BY subject) o ON o.subject = c.id
    LEFT JOIN (SELECT target, count(*) AS n FROM edge WHERE status = 'ok' AND code <> '14' GROUP BY target) i ON i.target = c.id"""
)
def concept_card(g: Graph) -> DataFrame:
    e, names = g.edge.filter("status = 'ok'"), g.concept.select(F.col("id").alias("target"), F.col("name").alias("n"))
    genus = F.col("code") == "14"
    up = e.filter(genus).join(names, "target").groupBy(F.col("subject").alias("id")).agg(F.array_join(F.array_sort(F.collect_set(F.concat("n", F.lit("@"), F.col("context").cast("string")))), ", ").alias("parents"))
    out = e.filter(~genus).groupBy(F.col("subject").alias("id")).agg(F.count("*").alias("outgoing"))
    into = e.groupBy(F.col("target").alias("id")).agg(F.count_if(genus).alias("children"), F.count_if(~genus).alias("incoming"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return g.concept.join(up, "id", "left").join(into, "id", "left").join(out, "id", "left").select("id", "name", F.coalesce("parents", F.lit("")).alias("parents"), zero("children"), zero("outgoing"), zero("incoming"))


@query(
    """SELECT e.subject AS id, CASE code WHEN '14' THEN 'parent' ELSE 'out' END AS part, e.target AS other, d.name, e.code, e.context, e.strength, NULL AS lang FROM edge e JOIN concept d ON d.id = e.target WHERE e.status = 'ok'
      UNION ALL SELECT e.target, CASE code WHEN '14' THEN 'child' ELSE 'in' END, e.subject, d.name, e.code, e.context, e.strength, NULL FROM edge e JOIN concept d ON d.id = e.subject WHERE e.status = 'ok' AND (e.code = '14' OR e.subject <> e.target)
      UNION ALL SELECT concept_id, 'term', NULL, term, NULL, NULL, NULL, lang FROM term""",
    uses=(),
)
def concept_card_rows(g: Graph) -> DataFrame:
    """Everything that the cards of all concepts show."""
    return terms.card_rows(g)


@query("SELECT id, (SELECT count(*) FROM x) AS total, (SELECT count(*) FROM x) > 30 AS has_more, least(greatest((SELECT count(*) FROM x) - 20, 0), 10) < (SELECT count(*) FROM x) AS truncated FROM (SELECT id FROM x ORDER BY id LIMIT 10 OFFSET 20)", more=_x(100))
def set_page(g: Graph) -> DataFrame:
    return page(Algebra(g).set("#100"), 20, 10)


# property inheritance
_APP = """app AS (SELECT c.descendant AS subject, e.subject AS owner, e.strength, e.id AS edge FROM clo c JOIN ok1 e ON e.subject = c.ancestor WHERE e.code = '22' AND e.target = 401),
  sup AS (SELECT s.descendant AS lo, s.ancestor AS hi FROM up s WHERE s.ancestor IN (SELECT owner FROM app) AND s.descendant IN (SELECT owner FROM app) AND NOT EXISTS (SELECT 1 FROM up r WHERE r.descendant = s.ancestor AND r.ancestor = s.descendant)),
  ovr AS (SELECT DISTINCT a.subject, a.owner FROM app a JOIN app b ON a.subject = b.subject JOIN sup ON sup.lo = b.owner AND sup.hi = a.owner),
  eff AS (SELECT a.* FROM app a LEFT JOIN ovr o ON o.subject = a.subject AND o.owner = a.owner WHERE o.owner IS NULL),
  st AS (SELECT subject AS id, bool_or(strength IS NULL OR strength > 0) AS p, bool_or(strength = 0) AS n FROM eff GROUP BY subject),
  sta AS (SELECT c.id, CASE WHEN coalesce(p, FALSE) AND coalesce(n, FALSE) THEN 'conflict' WHEN coalesce(p, FALSE) THEN 'positive' WHEN coalesce(n, FALSE) THEN 'negative' ELSE 'unknown' END AS state FROM concept c LEFT JOIN st ON st.id = c.id)"""
for _name, _call, _state in (("prop_has", "has(22, #401)", "positive"), ("prop_lacks", "lacks(action, #401)", "negative"), ("prop_unknown", "unknown(22, #401)", "unknown"), ("prop_conflicts", "conflicts(22, #401)", "conflict")):
    _set(_name, _call, f"SELECT id FROM sta WHERE state = '{_state}'", more=_APP)
_set("prop_within", "~has(22, #401)", "SELECT id FROM sta WHERE state <> 'positive' AND id IN (SELECT id FROM x)", within="#100", more=_APP + ",\n" + _x(100))


@query("SELECT id, state FROM sta", more=_APP)
def prop_states(g: Graph) -> DataFrame:
    return inherit.states(g, "22", 401)


@query("SELECT subject, edge FROM eff", more=_APP)
def prop_evidence(g: Graph) -> DataFrame:
    return inherit.applicable(g, inherit.assertions(g, 1, "22", 401)).filter("not overridden").select("subject", "edge")


@query("SELECT a.subject, a.edge FROM app a JOIN ovr o ON o.subject = a.subject AND o.owner = a.owner", more=_APP)
def prop_overridden(g: Graph) -> DataFrame:
    return inherit.applicable(g, inherit.assertions(g, 1, "22", 401)).filter("overridden").select("subject", "edge")


_RED = "red AS (SELECT a.id AS edge, a.subject, a.code, a.target, u.ancestor, a.strength AS s, b.strength AS t FROM pos1 a JOIN up u ON u.descendant = a.subject JOIN pos1 b ON b.subject = u.ancestor AND b.code = a.code AND b.target = a.target WHERE a.code IN ('20','21','22','23','24','25','26','27','70'))"


@query("SELECT edge, subject, code, target, ancestor FROM red", more=_RED)
def prop_redundant(g: Graph) -> DataFrame:
    return inherit.redundant(g)


@query("SELECT edge, subject, code, target, ancestor FROM red WHERE abs(coalesce(s, 100) - coalesce(t, 100)) < 25", more=_RED)
def prop_prunable(g: Graph) -> DataFrame:
    return inherit.prunable(g)


@query(
    "SELECT ancestor, count(*) AS members FROM c2 GROUP BY ancestor",
    more="g2 AS (SELECT DISTINCT subject, target FROM edge WHERE status = 'ok' AND context = 2 AND code = '14'), c2 AS (SELECT id AS descendant, id AS ancestor FROM concept UNION SELECT c.descendant, g.target FROM c2 c JOIN g2 g ON g.subject = c.ancestor)",
)
def context_isolation(g: Graph) -> DataFrame:
    return ops.closure(g, 2).groupBy("ancestor").agg(F.count("*").alias("members"))


# regions
def _regions(a: int, b: int, wrong: str) -> str:
    part = "SELECT '{0}' AS region, count(*) AS members, {1} AND count(*) > 0 AS counterexample, coalesce((SELECT string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FROM (SELECT id FROM {2} ORDER BY id LIMIT 5)), '') AS sample, count(*) > 5 AS truncated FROM {2}"
    sets = {"left_only": f"(SELECT id FROM x WHERE seed = {a} EXCEPT SELECT id FROM x WHERE seed = {b})", "intersection": f"(SELECT id FROM x WHERE seed = {a} INTERSECT SELECT id FROM x WHERE seed = {b})", "right_only": f"(SELECT id FROM x WHERE seed = {b} EXCEPT SELECT id FROM x WHERE seed = {a})"}
    return " UNION ALL ".join(part.format(n, "TRUE" if n in wrong else "FALSE", q) for n, q in sets.items())


query(_regions(301, 100, "left_only"), more=_x(100, 301), name="cmp_regions")(lambda g: Algebra(g).regions("#301 <= #100"))
query(_regions(3, 2, "left_only right_only"), more=_x(2, 3), name="region_samples")(lambda g: Algebra(g).regions("#3 == #2"))
query(_regions(100, 301, "intersection"), more=_x(100, 301), name="disjoint_regions")(lambda g: Algebra(g).regions("disjoint(#100, #301)"))

_IDS = [100, 101, 301, 302, 2]
_MASK = "m AS (SELECT id, CAST(bit_or(CASE seed WHEN 100 THEN 1 WHEN 101 THEN 2 WHEN 301 THEN 4 WHEN 302 THEN 8 ELSE 16 END) AS BIGINT) AS mask FROM x GROUP BY id)"


@query("SELECT mask, count(*) AS members, array_to_string(list_sort(list(id))[1:6], ',') AS sample FROM m GROUP BY mask", more=_x(*_IDS) + ",\n" + _MASK)
def catalog_regions(g: Graph) -> DataFrame:
    return regions.catalog(g, _IDS)


@query(
    """SELECT a, b, CASE WHEN n = 0 THEN 'disjoint' WHEN l = 0 AND r = 0 THEN 'equal' WHEN l = 0 THEN 'inside' WHEN r = 0 THEN 'contains' ELSE 'overlap' END AS kind, n AS both, l AS "left", r AS "right" FROM (
      SELECT p.a, p.b, CAST(sum(CASE WHEN mask & x <> 0 AND mask & y <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS n, CAST(sum(CASE WHEN mask & x <> 0 AND mask & y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS l, CAST(sum(CASE WHEN mask & x = 0 AND mask & y <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS r FROM p CROSS JOIN m GROUP BY p.a, p.b)""",
    more=_x(*_IDS) + ",\n" + _MASK + ", s AS (SELECT * FROM (VALUES (0, 100, 1), (1, 101, 2), (2, 301, 4), (3, 302, 8), (4, 2, 16)) v(k, id, bit)), p AS (SELECT CAST(a.id AS BIGINT) AS a, CAST(b.id AS BIGINT) AS b, a.bit AS x, b.bit AS y FROM s a JOIN s b ON a.k < b.k)",
)
def catalog_pair_kinds(g: Graph) -> DataFrame:
    return regions.catalog_pairs(g, _IDS)


@query(
    """SELECT op, CAST(members AS BIGINT) AS members FROM (SELECT 'intersection' AS op, count(*) FILTER (mask & 5 = 5) AS members FROM m UNION ALL SELECT 'union', count(*) FILTER (mask & 5 <> 0) FROM m UNION ALL SELECT 'difference', count(*) FILTER (mask & 1 <> 0 AND mask & 4 = 0) FROM m
      UNION ALL SELECT 'xor', count(*) FILTER (mask & 5 IN (1, 4)) FROM m UNION ALL SELECT 'complement', (SELECT count(*) FROM concept) - count(*) FILTER (mask & 5 <> 0) FROM m UNION ALL SELECT 'all', count(*) FROM m UNION ALL SELECT 'none', 0)""",
    more=_x(*_IDS) + ",\n" + _MASK,
)
def region_boolean_ops(g: Graph) -> DataFrame:
    r, n = regions.catalog(g, _IDS), g.concept.count()
    parts = [regions.region_operation(r, op, (1, 4), n).select(F.lit(op).alias("op"), F.col("members").cast("long").alias("members")) for op in ("intersection", "union", "difference", "xor", "complement", "all", "none")]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


_EUL = [2, 6, 100, 101, 200, 300 + 1, 501, 601, 2000017, 3000017, 1000001]
_EUP = """sel AS (SELECT CAST(unnest([{}]) AS BIGINT) AS id), sm AS (SELECT subject AS a, target AS b FROM pos1 WHERE code = '30' UNION SELECT target, subject FROM pos1 WHERE code = '30'),
  ust AS (SELECT subject AS a, target AS b FROM g14 UNION SELECT a, b FROM sm),
  eu AS (SELECT id AS seed, id FROM sel UNION SELECT eu.seed, ust.b FROM eu JOIN ust ON ust.a = eu.id), es AS (SELECT id AS seed, id FROM sel UNION SELECT es.seed, sm.b FROM es JOIN sm ON sm.a = es.id),
  ovl AS (SELECT DISTINCT p.seed AS a, q.seed AS b FROM pos1 e JOIN es p ON p.id = e.subject JOIN es q ON q.id = e.target WHERE e.code = '40' UNION SELECT q.seed, p.seed FROM pos1 e JOIN es p ON p.id = e.subject JOIN es q ON q.id = e.target WHERE e.code = '40'),
  dis AS (SELECT DISTINCT p.seed AS a, q.seed AS b FROM pos1 e JOIN eu p ON p.id = e.subject JOIN eu q ON q.id = e.target WHERE e.code IN ('60', '64') UNION SELECT q.seed, p.seed FROM pos1 e JOIN eu p ON p.id = e.subject JOIN eu q ON q.id = e.target WHERE e.code IN ('60', '64')),
  ek AS (SELECT a.id AS a, b.id AS b, (a.id, b.id) IN (SELECT (seed, id) FROM es) AS eq, (a.id, b.id) IN (SELECT (seed, id) FROM eu) AS i, (b.id, a.id) IN (SELECT (seed, id) FROM eu) AS c, (a.id, b.id) IN (SELECT (a, b) FROM ovl) AS o, (a.id, b.id) IN (SELECT (a, b) FROM dis) AS d FROM sel a JOIN sel b ON a.id < b.id)""".format(", ".join(map(str, _EUL)))
_KIND = "CASE WHEN (eq OR i OR c) AND (o OR d) OR (o AND d) THEN 'conflict' WHEN eq THEN 'equal' WHEN i AND c THEN 'conflict' WHEN i THEN 'inside' WHEN c THEN 'contains' WHEN o THEN 'overlap' WHEN d THEN 'disjoint' ELSE 'unknown' END"


@query(f"SELECT a, b, {_KIND} AS kind FROM ek", more=_EUP)
def euler_pairs(g: Graph) -> DataFrame:
    return regions.pair_kinds(g, _EUL)


@query(
    "SELECT i1.id, min(i1.p) AS parent FROM ins i1 WHERE NOT EXISTS (SELECT 1 FROM ins i2 JOIN ins i3 ON i3.id = i2.p WHERE i2.id = i1.id AND i3.p = i1.p) GROUP BY i1.id",
    more=_EUP + f", kk AS (SELECT a, b, {_KIND} AS kind FROM ek), ins AS (SELECT a AS id, b AS p FROM kk WHERE kind = 'inside' UNION ALL SELECT b, a FROM kk WHERE kind = 'contains')",
)
def euler_enclosing(g: Graph) -> DataFrame:
    return regions.enclosing(regions.pair_kinds(g, _EUL))


_SIB = [200, 201, 205, 300 + 1, 300 + 2, 501, 502, 2000034, 3000034]


_GENERA = """SELECT genus, members FROM sz c WHERE NOT EXISTS (SELECT 1 FROM sz o JOIN gu ON gu.seed = o.genus AND gu.id = c.genus WHERE o.genus <> c.genus
        AND NOT EXISTS (SELECT 1 FROM gu back WHERE back.seed = c.genus AND back.id = o.genus)
        AND NOT EXISTS (SELECT 1 FROM hs x WHERE x.genus = c.genus AND NOT EXISTS (SELECT 1 FROM hs y WHERE y.genus = o.genus AND y.member = x.member)))"""
_GENERA_CTES = """, lk AS (SELECT DISTINCT es.seed AS member, e.target FROM es JOIN pos1 e ON e.subject = es.id AND e.code = '14'),
      al AS (SELECT DISTINCT target AS seed, target AS id FROM lk UNION SELECT al.seed, sm.b FROM al JOIN sm ON sm.a = al.id),
      h0 AS (SELECT DISTINCT m.genus, lk.member FROM lk JOIN (SELECT seed, min(id) AS genus FROM al GROUP BY seed) m ON m.seed = lk.target WHERE m.genus NOT IN (SELECT min(id) FROM es GROUP BY seed)),
      gu AS (SELECT DISTINCT genus AS seed, genus AS id FROM h0 UNION SELECT gu.seed, w.b FROM gu JOIN (SELECT subject AS a, target AS b FROM g14 UNION SELECT a, b FROM sm) w ON w.a = gu.id),
      hs AS (SELECT * FROM h0 WHERE (genus, member) NOT IN (SELECT (seed, id) FROM gu)),
      sz AS (SELECT genus, count(*) AS members FROM hs WHERE genus IN (SELECT x.genus FROM hs x JOIN hs y ON y.genus = x.genus AND x.member < y.member
        WHERE (x.member, y.member) NOT IN (SELECT (seed, id) FROM eu) AND (y.member, x.member) NOT IN (SELECT (seed, id) FROM eu)) GROUP BY genus)"""


@query(_GENERA + " ORDER BY members DESC, genus LIMIT 8", more=_EUP.replace(", ".join(map(str, _EUL)), ", ".join(map(str, _SIB))) + _GENERA_CTES)
def euler_shared_genera(g: Graph) -> DataFrame:
    return regions.shared_genera(g, _SIB)


# terms
_KEYS = "ky AS (SELECT DISTINCT concept_id AS id, lower(regexp_replace(trim(term), '\\s+', ' ', 'g')) AS key FROM term WHERE lang = 'en'), ka AS (SELECT DISTINCT id, key FROM (SELECT concept_id AS id, lower(regexp_replace(trim(term), '\\s+', ' ', 'g')) AS key FROM term UNION ALL SELECT id, lower(regexp_replace(trim(name), '\\s+', ' ', 'g')) FROM concept))"


@query(
    "SELECT w.t AS term, ka.id, n.c AS candidates FROM w JOIN ka ON ka.key = lower(w.t) JOIN (SELECT key, count(DISTINCT id) AS c FROM ka GROUP BY key) n ON n.key = lower(w.t)",
    more=_KEYS + ", w AS (SELECT DISTINCT upper(name) AS t FROM concept)",
)
def term_resolve(g: Graph) -> DataFrame:
    return terms.resolve_all(g, g.concept.select(F.upper("name").alias("term")).distinct())


@query("SELECT key, count(*) AS concepts, min(id) AS least FROM ky GROUP BY key HAVING count(*) > 1", more=_KEYS)
def term_homonyms(g: Graph) -> DataFrame:
    return terms.homonyms(g)


@query(
    """SELECT id, name, CAST(r AS BIGINT) AS rank FROM (SELECT id, name, context, min(r) AS r FROM (SELECT id, name, context, CASE WHEN lower(name) = 'america' THEN 0 WHEN starts_with(lower(name), 'america') THEN 2 ELSE 3 END AS r FROM concept WHERE contains(lower(name), 'america')
      UNION ALL SELECT c.id, c.name, c.context, CASE WHEN lower(t.term) = 'america' THEN 1 ELSE 3 END FROM term t JOIN concept c ON c.id = t.concept_id WHERE contains(lower(t.term), 'america')) GROUP BY id, name, context) ORDER BY r, context, name, id LIMIT 100"""
)
def term_search_ranked(g: Graph) -> DataFrame:
    return terms.search(g, "America")


#: Letters left out of a consonant skeleton (fixed value of the word match).
_SOFT = "аеёиоуыэюяьъaeiouy"


def _near(a: str, b: str) -> str:
    """The word match: lengths at most 3 apart, and a common start or the same first two letters and skeleton."""
    k = f"greatest(4, least(length({a}), length({b})) - 1)"
    s = lambda x: f"translate({x}, '{_SOFT}', '')"
    start = f"length({a}) >= {k} AND length({b}) >= {k} AND left({a}, {k}) = left({b}, {k})"
    bones = f"left({a}, 2) = left({b}, 2) AND {s(a)} = {s(b)} AND length({s(a)}) >= 2"
    return f"({a} = {b} OR (abs(length({a}) - length({b})) <= 3 AND (({start}) OR ({bones}))))"


#: A search asks for every hundredth name, changed a little.
_WORDS = "SELECT concat(lower(name), 's') AS word FROM concept WHERE id % 100 = 0 UNION SELECT replace(lower(name), 'a', 'e') FROM concept WHERE id % 100 = 0 UNION SELECT lower(name) FROM concept WHERE id % 100 = 0"


@query(
    f"SELECT h.word, h.id, CAST(h.tier AS BIGINT) AS tier FROM h JOIN (SELECT word, min(tier) AS b FROM h GROUP BY word) m ON m.word = h.word AND m.b = h.tier",
    more=f"w AS ({_WORDS}), tt AS (SELECT concept_id AS id, lower(term) AS t FROM term WHERE lang = 'en' AND NOT contains(term, ' ')), h AS (SELECT DISTINCT w.word, tt.id, CASE WHEN w.word = tt.t THEN 1 ELSE 2 END AS tier FROM w JOIN tt ON left(w.word, 2) = left(tt.t, 2) AND {_near('w.word', 'tt.t')})",
)
def term_fuzzy(g: Graph) -> DataFrame:
    return terms.fuzzy(g, g.spark.sql(_WORDS.replace("FROM concept", "FROM {concept}"), concept=g.concept))


@query(
    f"""SELECT DISTINCT p.phrase, t.id FROM p JOIN t ON p.n = t.n AND left(p.phrase, 2) = left(t.t, 2) WHERE {_near("split_part(p.phrase, ' ', 1)", "split_part(t.t, ' ', 1)")} AND (p.n < 2 OR {_near("split_part(p.phrase, ' ', 2)", "split_part(t.t, ' ', 2)")}) AND (p.n < 3 OR {_near("split_part(p.phrase, ' ', 3)", "split_part(t.t, ' ', 3)")})""",
    more="p AS (SELECT DISTINCT lower(name) || 's' AS phrase, length(name) - length(replace(name, ' ', '')) + 1 AS n FROM concept WHERE id % 100 = 0), t AS (SELECT concept_id AS id, lower(term) AS t, length(term) - length(replace(term, ' ', '')) + 1 AS n FROM term WHERE lang = 'en' AND length(term) - length(replace(term, ' ', '')) < 3)",
)
def term_phrase_fuzzy(g: Graph) -> DataFrame:
    return terms.fuzzy_phrases(g, g.concept.filter("id % 100 = 0").select(F.concat(F.lower("name"), F.lit("s")).alias("phrase")))


@query("SELECT c.id, coalesce(t.term, c.name) AS label FROM concept c LEFT JOIN (SELECT concept_id, term, row_number() OVER (PARTITION BY concept_id ORDER BY length(term), lower(term), term) AS k FROM term WHERE lang = 'en') t ON t.concept_id = c.id AND t.k = 1", uses=())
def term_display_label(g: Graph) -> DataFrame:
    return terms.display(g)


def _case(values: dict[str, str], key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


#: Definitions: relations from both ends, genera with contexts, species.
_DEFINED = f"""sr AS (SELECT e.subject AS id, 0 AS inc, e.code, e.target AS o, e.strength, e.id AS edge, CASE WHEN e.code = '20' THEN CASE WHEN strength IS NULL THEN 'attribute' WHEN strength = 0 THEN 'no' WHEN strength >= 90 THEN 'inherent' WHEN strength >= 50 THEN 'typical' WHEN strength >= 10 THEN 'sometimes' ELSE 'rarely' END
      ELSE CASE WHEN strength = 0 THEN 'not ' ELSE '' END || {_case(terms.LABELS_OUT["en"], "e.code")} END AS lb, CASE WHEN strength > 0 THEN ' (' || strength || '%)' ELSE '' END AS sh FROM edge e WHERE status = 'ok' AND code <> '14'
    UNION ALL SELECT e.target, 1, e.code, e.subject, e.strength, e.id, CASE WHEN r.mutual THEN coalesce({_case(terms.LABELS_OUT["en"], "e.code")}, {_case(terms.LABELS_IN["en"], "e.code")}) ELSE {_case(terms.LABELS_IN["en"], "e.code")} END, '' FROM edge e LEFT JOIN rule r ON r.code = e.code WHERE status = 'ok' AND e.code <> '14' AND (strength IS NULL OR strength <> 0)),
  sx AS (SELECT s.id, string_agg(s.lb || ': ' || coalesce(d.name, '?') || s.sh, '; ' ORDER BY s.inc, s.code, s.o, s.strength NULLS FIRST, s.edge) AS v FROM sr s LEFT JOIN concept d ON d.id = s.o WHERE s.lb IS NOT NULL GROUP BY s.id),
  gx AS (SELECT e.subject AS id, CASE WHEN count(*) = 1 THEN min(coalesce(d.name, '?')) ELSE string_agg(coalesce(d.name, '?') || ' [' || coalesce(u.name, CAST(e.context AS VARCHAR)) || ']', '; ' ORDER BY e.id) END AS v FROM edge e LEFT JOIN concept d ON d.id = e.target LEFT JOIN universe u ON u.id = e.context WHERE e.status = 'ok' AND e.code = '14' GROUP BY e.subject),
  kx AS (SELECT o.target AS id, string_agg(coalesce(d.name, '?'), ', ' ORDER BY coalesce(d.name, '?'), o.subject) AS v FROM okg o LEFT JOIN concept d ON d.id = o.subject GROUP BY o.target),
  df AS (SELECT c.id, c.context, left(c.name || ' — ' || coalesce(g.v, 'universe (no genus)') || coalesce('; ' || s.v, '') || coalesce('. Species: ' || k.v, ''), 1000) AS definition, s.v IS NULL AND k.v IS NULL AND g.v IS NOT NULL AS weak FROM concept c LEFT JOIN gx g ON g.id = c.id LEFT JOIN sx s ON s.id = c.id LEFT JOIN kx k ON k.id = c.id)"""


@query("SELECT id, definition, weak FROM df", more=_DEFINED, uses=("okg",))
def concept_definition(g: Graph) -> DataFrame:
    return terms.definitions(g)


@query("SELECT CASE WHEN strength IS NULL THEN 'attribute' WHEN strength = 0 THEN 'no' WHEN strength >= 90 THEN 'inherent' WHEN strength >= 50 THEN 'typical' WHEN strength >= 10 THEN 'sometimes' ELSE 'rarely' END AS band, count(*) AS edges, count(*) FILTER (strength IS NULL OR strength > 0) AS positive FROM ok1 WHERE code IN ('22', '70') GROUP BY 1")
def attr_band(g: Graph) -> DataFrame:
    return terms.banded(g)


@query("SELECT concept_id AS id, bool_and(regexp_matches(term, '[\\x{0400}-\\x{04FF}]') AND NOT regexp_matches(term, '[A-Za-z]')) AS cyrillic_only, bool_or(regexp_matches(term, '[A-Za-z]')) AS any_latin FROM term WHERE lang = 'en' GROUP BY concept_id")
def script_flags(g: Graph) -> DataFrame:
    return terms.script_flags(g)


# audits and statistics, over a graph with planted faults where that matters
_COUNT = "SELECT '{}' AS metric, count(*) AS value FROM {}"
_TOTALS = [("concepts", "concept"), ("edges", "edge"), ("candidates", "edge WHERE status = 'candidate'"), ("paths", "kb")]


@query(
    " UNION ALL ".join(_COUNT.format(*x) for x in _TOTALS)
    + " UNION ALL SELECT 'context ' || context, count(*) FROM concept GROUP BY context UNION ALL SELECT 'processed ' || processed, count(*) FROM concept GROUP BY processed",
    faults=True,
)
def audit_totals(g: Graph) -> DataFrame:
    return audit.totals(g)


_REPORT = {
    "concepts": "concept",
    "edges": "edge",
    "accepted_edges": "okx",
    "terms": "(SELECT DISTINCT concept_id, term, lang FROM term)",
    "signature_invalid_edges": "(SELECT DISTINCT id FROM sv)",
    "signature_violations": "sv",
    "self_loops": "okx WHERE subject = target",
    "taxonomy_cycle_edges": "okx WHERE code = '14' AND (subject = target OR (subject, target) IN (SELECT (ancestor, descendant) FROM kb))",
    "dangling_edges": "okx WHERE subject NOT IN (SELECT id FROM concept) OR target NOT IN (SELECT id FROM concept)",
    "deprecated_edges": "rl WHERE name LIKE '%deprecated%'",
    "missing_ru": "concept WHERE id NOT IN (SELECT concept_id FROM term WHERE lang = 'ru')",
    "missing_en": "concept WHERE id NOT IN (SELECT concept_id FROM term WHERE lang = 'en')",
    "concepts_with_cyrillic_only_en": "(SELECT DISTINCT concept_id FROM term WHERE lang = 'en' AND regexp_matches(term, '[Ѐ-ӿ]') AND NOT regexp_matches(term, '[A-Za-z]'))",
    "cyrillic_only_en_terms": "term WHERE lang = 'en' AND regexp_matches(term, '[Ѐ-ӿ]') AND NOT regexp_matches(term, '[A-Za-z]')",
    "concepts_without_latin_en": "concept WHERE id NOT IN (SELECT concept_id FROM term WHERE lang = 'en' AND regexp_matches(term, '[A-Za-z]'))",
    "concepts_with_specific_properties": "sp",
    "concepts_with_parallel_relations": "pa",
    "concepts_without_non_isa": "concept WHERE id NOT IN (SELECT subject FROM sp) AND id NOT IN (SELECT subject FROM pa)",
}


@query(
    " UNION ALL ".join(_COUNT.format(*x) for x in _REPORT.items()) + " UNION ALL SELECT 'accepted ' || code, count(*) FROM okx GROUP BY code",
    more="""okx AS (SELECT * FROM edge WHERE status = 'ok'), kr AS (SELECT descendant AS d, ancestor AS a FROM kb UNION ALL SELECT id, id FROM concept),
      rl AS (SELECT e.*, r.name, CAST(e.code AS INT) AS c FROM okx e JOIN rule r ON r.code = e.code WHERE subject IN (SELECT id FROM concept) AND target IN (SELECT id FROM concept)),
      sv AS (SELECT e.id, 'subject' AS side FROM rl e WHERE code IN (SELECT code FROM anchor WHERE side = 'subject') AND NOT EXISTS (SELECT 1 FROM anchor a JOIN kr ON kr.a = a.anchor WHERE a.side = 'subject' AND a.code = e.code AND kr.d = e.subject)
        UNION ALL SELECT e.id, 'object' FROM rl e WHERE code IN (SELECT code FROM anchor WHERE side = 'object') AND NOT EXISTS (SELECT 1 FROM anchor a JOIN kr ON kr.a = a.anchor WHERE a.side = 'object' AND a.code = e.code AND kr.d = e.target)),
      sp AS (SELECT DISTINCT subject FROM rl WHERE c BETWEEN 15 AND 27 OR c BETWEEN 70 AND 74), pa AS (SELECT DISTINCT subject FROM rl WHERE c BETWEEN 30 AND 64)""",
    faults=True,
)
def audit_report(g: Graph) -> DataFrame:
    return audit.report(g)


@query("SELECT id AS edge, 'self_loop' AS issue FROM okx WHERE subject = target UNION ALL SELECT id, 'dangling' FROM okx WHERE subject NOT IN (SELECT id FROM concept) OR target NOT IN (SELECT id FROM concept) UNION ALL SELECT id, 'unknown_code' FROM okx WHERE code NOT IN (SELECT code FROM rule) UNION ALL SELECT id, 'deprecated_code' FROM okx WHERE code IN (SELECT code FROM rule WHERE contains(name, 'deprecated')) UNION ALL SELECT id, 'strength' FROM okx WHERE strength < 0 OR strength > 100", more="okx AS (SELECT * FROM edge WHERE status = 'ok')", faults=True)
def audit_structural(g: Graph) -> DataFrame:
    return audit.structural(g)


@query("SELECT id AS edge FROM edge e WHERE status = 'ok' AND code = '14' AND EXISTS (SELECT 1 FROM rr WHERE rr.seed = e.target AND rr.n = e.subject)", more="rr AS (SELECT DISTINCT target AS seed, target AS n FROM okg WHERE target IN (SELECT subject FROM okg) AND subject IN (SELECT target FROM okg) UNION SELECT rr.seed, o.target FROM rr JOIN okg o ON o.subject = rr.n)", faults=True)
def audit_cycles(g: Graph) -> DataFrame:
    return audit.cycle_edges(g)


@query(
    "SELECT e.id AS edge, s.side FROM ok1 e JOIN (SELECT DISTINCT code, side FROM anchor) s ON s.code = e.code WHERE NOT EXISTS (SELECT 1 FROM anchor a JOIN clo c ON c.ancestor = a.anchor WHERE a.code = e.code AND a.side = s.side AND c.descendant = CASE WHEN s.side = 'subject' THEN e.subject ELSE e.target END)",
    faults=True,
)
def audit_signature(g: Graph) -> DataFrame:
    return audit.signature_violations(g)


@query("SELECT DISTINCT e.id AS edge FROM pos1 e JOIN up u ON (u.descendant = e.subject AND u.ancestor = e.target) OR (u.descendant = e.target AND u.ancestor = e.subject) WHERE e.code = '61'", faults=True)
def audit_coordinate_ancestor(g: Graph) -> DataFrame:
    return audit.coordinate_with_ancestor(g)


@query("SELECT DISTINCT e.id AS edge FROM pos1 e JOIN pos1 o ON o.subject = e.subject AND o.code = '14' JOIN up u ON u.descendant = o.target AND u.ancestor = e.target WHERE e.code = '14'", faults=True)
def audit_shortcuts(g: Graph) -> DataFrame:
    return audit.shortcuts(g)


@query("SELECT a.descendant AS id FROM clo a JOIN clo b ON b.descendant = a.descendant AND b.ancestor = 6 WHERE a.ancestor = 100")
def audit_under_both(g: Graph) -> DataFrame:
    return audit.under_both(g, 100, 6)


@query("SELECT u.ancestor AS id, count(*) AS descendants FROM up u WHERE u.ancestor NOT IN (SELECT subject FROM edge WHERE status = 'ok' AND code <> '14' UNION SELECT target FROM edge WHERE status = 'ok' AND code <> '14') GROUP BY u.ancestor HAVING count(*) >= 3", faults=True)
def thin_hubs(g: Graph) -> DataFrame:
    return audit.thin_hubs(g)


@query("SELECT e.id AS edge, count(*) AS witnesses FROM pos1 e JOIN clo a ON a.ancestor = e.subject JOIN clo b ON b.ancestor = e.target AND b.descendant = a.descendant WHERE e.code IN ('61', '63', '64') GROUP BY e.id", faults=True)
def audit_exclusion_witness(g: Graph) -> DataFrame:
    return audit.exclusion_witnesses(g)


@query("SELECT CAST(depth AS BIGINT) AS depth, count(*) AS concepts FROM (SELECT n, min(depth) AS depth FROM dd GROUP BY n) GROUP BY depth", more="dd AS (SELECT CAST(1 AS BIGINT) AS n, 0 AS depth UNION SELECT g.subject, dd.depth + 1 FROM dd JOIN g14 g ON g.target = dd.n)")
def depth_histogram(g: Graph) -> DataFrame:
    return audit.depth_histogram(g, 1)


@query(
    "SELECT n AS id, owner, CAST(depth AS BIGINT) AS distance FROM (SELECT owner, n, min(depth) AS depth, min(min(depth)) OVER (PARTITION BY n) AS best FROM dd GROUP BY owner, n) WHERE depth = best",
    more="dd AS (SELECT DISTINCT subject AS owner, subject AS n, 0 AS depth FROM pos1 WHERE code = '22' UNION SELECT dd.owner, g.subject, dd.depth + 1 FROM dd JOIN g14 g ON g.target = dd.n)",
)
def nearest_claims(g: Graph) -> DataFrame:
    return audit.nearest_claims(g)


@query("SELECT u.id AS context, (SELECT count(*) FROM concept c WHERE c.context = u.id) AS concepts, (SELECT count(*) FROM edge e WHERE e.context = u.id AND status = 'ok') AS edges, (SELECT count(*) FROM edge e WHERE e.context = u.id AND status = 'candidate') AS candidates FROM universe u", faults=True)
def stats_by_context(g: Graph) -> DataFrame:
    return audit.context_stats(g)


@query("SELECT code, count(*) AS edges, count(*) FILTER (strength = 0) AS negatives, count(DISTINCT subject) AS subjects FROM edge WHERE status = 'ok' GROUP BY code")
def code_distribution(g: Graph) -> DataFrame:
    return audit.code_distribution(g)


@query("SELECT target AS id, count(DISTINCT subject) AS children FROM edge WHERE status = 'ok' AND code = '14' GROUP BY target HAVING count(DISTINCT subject) >= 5")
def hubs(g: Graph) -> DataFrame:
    return audit.hubs(g)


@query("SELECT subject AS id, count(*) AS genera FROM g14 GROUP BY subject HAVING count(*) > 1")
def multi_genus(g: Graph) -> DataFrame:
    return audit.multi_genus(g)


@query("SELECT ancestor AS id, count(*) AS descendants FROM up GROUP BY ancestor")
def descendant_counts(g: Graph) -> DataFrame:
    return audit.descendant_counts(g)


@query("SELECT id FROM concept WHERE id NOT IN (SELECT subject FROM edge WHERE status = 'ok' AND code = '14')", faults=True)
def genus_roots(g: Graph) -> DataFrame:
    return audit.roots(g)


@query("SELECT context, count(*) AS concepts, count(*) FILTER (id NOT IN (SELECT subject FROM edge WHERE status = 'ok' AND code <> '14' UNION SELECT target FROM edge WHERE status = 'ok' AND code <> '14')) AS genus_only FROM concept GROUP BY context")
def genus_only_share(g: Graph) -> DataFrame:
    return audit.genus_only(g)


@query("SELECT l AS lang, count(*) AS concepts FROM concept CROSS JOIN (SELECT 'en' AS l UNION ALL SELECT 'ru') q WHERE NOT EXISTS (SELECT 1 FROM term t WHERE t.concept_id = concept.id AND t.lang = l) GROUP BY l")
def missing_language(g: Graph) -> DataFrame:
    return audit.missing_language(g)


@query("SELECT c.id, c.processed, coalesce(n.n, 0) AS children FROM concept c LEFT JOIN (SELECT target, count(*) AS n FROM edge WHERE status = 'ok' AND code = '14' GROUP BY target) n ON n.target = c.id WHERE c.processed < 2")
def frontier(g: Graph) -> DataFrame:
    return audit.frontier(g)


@query(
    "SELECT id, CAST(CASE WHEN p AND t >= 2 THEN 3 ELSE t END AS BIGINT) AS level FROM (SELECT id, p, CASE WHEN s AND coalesce(processed, 0) = 1 THEN 2 ELSE coalesce(processed, 0) END AS t FROM (SELECT id, processed, id IN (SELECT subject FROM edge WHERE status = 'ok' AND (CAST(code AS INT) BETWEEN 15 AND 27 OR CAST(code AS INT) BETWEEN 70 AND 74)) AS s, id IN (SELECT subject FROM edge WHERE status = 'ok' AND CAST(code AS INT) BETWEEN 30 AND 64) AS p FROM concept))"
)
def processed_level(g: Graph) -> DataFrame:
    return audit.raised_levels(g)


@query(
    "SELECT target AS parent, count(*) AS leaves, min(subject) AS first FROM (SELECT e.subject, e.target, row_number() OVER (PARTITION BY e.subject ORDER BY CASE WHEN e.context = c.context THEN 0 ELSE 1 END, e.id) AS k FROM edge e JOIN concept c ON c.id = e.subject WHERE e.status = 'ok' AND e.code = '14') WHERE k = 1 AND subject NOT IN (SELECT target FROM okg) GROUP BY target HAVING count(*) >= 2"
)
def leaf_groups(g: Graph) -> DataFrame:
    return audit.leaf_groups(g)


# batches
_BATCH = """SELECT CAST(subject AS BIGINT) AS subject, CAST(code AS STRING) AS code, CAST(target AS BIGINT) AS target, CAST(context AS BIGINT) AS context, CAST(strength AS BIGINT) AS strength FROM (
  SELECT id AS subject, '14' AS code, 2 AS target, 1 AS context, NULL AS strength FROM concept WHERE id BETWEEN 200 AND 224 UNION ALL SELECT 2, '14', id, 1, NULL FROM concept WHERE id BETWEEN 200 AND 224
  UNION ALL SELECT id, '22', 401 + id % 5, 1, 50 FROM concept WHERE id BETWEEN 2000001 AND 2999999 UNION ALL SELECT id, '22', 1, 1, 0 FROM concept WHERE id BETWEEN 300 AND 310
  UNION ALL SELECT 203, '61', 202, 2, NULL UNION ALL SELECT 210, '61', 200, 1, NULL UNION ALL SELECT id, '70', 1000001, 1, 5 FROM concept WHERE id BETWEEN 1000001 AND 1999999
  UNION ALL SELECT 5, '99', 6, 1, NULL UNION ALL SELECT 9999999, '14', 1, 1, NULL UNION ALL SELECT 301, '14', 2, 1, NULL UNION ALL SELECT 6, '14', 6, 2, NULL UNION ALL SELECT 301, '14', 6, 3, NULL) q"""


@query(
    """SELECT subject, code, target, context, strength, CASE WHEN code NOT IN (SELECT code FROM rule) THEN 'unknown_code' WHEN subject NOT IN (SELECT id FROM concept) OR target NOT IN (SELECT id FROM concept) THEN 'missing'
      WHEN EXISTS (SELECT 1 FROM edge e WHERE e.status <> 'rejected' AND e.subject = b.subject AND e.code = b.code AND e.target = b.target AND (e.context = b.context OR b.code <> '14')) THEN 'duplicate'
      WHEN code = '14' AND (subject = target OR EXISTS (SELECT 1 FROM kb WHERE kb.ancestor = b.subject AND kb.descendant = b.target)) THEN 'cycle'
      WHEN code = '14' AND EXISTS (SELECT 1 FROM kb WHERE kb.descendant = b.subject AND kb.ancestor = b.target) AND NOT EXISTS (SELECT 1 FROM edge e WHERE e.status <> 'rejected' AND e.subject = b.subject AND e.code = '14' AND e.target = b.target) THEN 'redundant'
      WHEN code IN (SELECT code FROM anchor WHERE side = 'subject') AND NOT EXISTS (SELECT 1 FROM anchor a JOIN kr ON kr.a = a.anchor WHERE a.side = 'subject' AND a.code = b.code AND kr.d = b.subject) THEN 'signature_subject'
      WHEN code IN (SELECT code FROM anchor WHERE side = 'object') AND NOT EXISTS (SELECT 1 FROM anchor a JOIN kr ON kr.a = a.anchor WHERE a.side = 'object' AND a.code = b.code AND kr.d = b.target) THEN 'signature_object' ELSE 'ok' END AS verdict,
      code IN ('20','21','22','23','24','25','26','27','70') AND coalesce(strength, 1) <> 0 AND EXISTS (SELECT 1 FROM kb JOIN edge e ON e.subject = kb.ancestor WHERE kb.descendant = b.subject AND e.status = 'ok' AND (e.strength IS NULL OR e.strength > 0) AND e.code = b.code AND e.target = b.target) AS warning FROM b""",
    more="b0 AS (" + _BATCH.replace("STRING", "VARCHAR") + "), b AS (SELECT CASE WHEN r.mutual AND subject > target THEN target ELSE subject END AS subject, b0.code, CASE WHEN r.mutual AND subject > target THEN subject ELSE target END AS target, context, strength FROM b0 LEFT JOIN rule r ON r.code = b0.code), kr AS (SELECT descendant AS d, ancestor AS a FROM kb UNION ALL SELECT id, id FROM concept)",
)
def edge_validate(g: Graph) -> DataFrame:
    return batch.validated(g, g.spark.sql(_BATCH.replace("FROM concept", "FROM {concept}"), concept=g.concept))


_MERGES = "SELECT id AS src, id + 1000000 AS dst FROM concept WHERE id BETWEEN 2000001 AND 2999999"
_MERGED = f"""mg AS ({_MERGES}), mv AS (SELECT e.id, coalesce(s.dst, e.subject) AS subject, e.code, coalesce(t.dst, e.target) AS target, e.context, e.strength, e.status, s.dst IS NOT NULL AS sm, t.dst IS NOT NULL AS tm FROM edge e LEFT JOIN mg s ON s.src = e.subject LEFT JOIN mg t ON t.src = e.target),
  me AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject, code, target, context ORDER BY CASE WHEN sm OR tm THEN 1 ELSE 0 END, id) AS k FROM mv WHERE NOT (sm AND code = '14') AND NOT ((sm OR tm) AND subject = target)) WHERE k = 1)"""


def _merge(g: Graph) -> Graph:
    return batch.merged(g, g.spark.sql(_MERGES.replace("FROM concept", "FROM {concept}"), concept=g.concept).join(g.concept.select(F.col("id").alias("dst")), "dst", "left_semi"))


_MERGED = _MERGED.replace(f"mg AS ({_MERGES})", f"mg AS (SELECT * FROM ({_MERGES}) WHERE dst IN (SELECT id FROM concept))")


@query("SELECT id, subject, code, target, context, strength FROM me", more=_MERGED)
def merge_retarget(g: Graph) -> DataFrame:
    return _merge(g).edge.select("id", "subject", "code", "target", "context", "strength")


@query("SELECT e.id, CASE WHEN m.id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM edge e LEFT JOIN me m ON m.id = e.id WHERE m.id IS NULL OR m.subject <> e.subject OR m.target <> e.target", more=_MERGED)
def batch_diff(g: Graph) -> DataFrame:
    return batch.difference(g.edge, _merge(g).edge, ["id"])


@query("SELECT status, count(*) AS edges FROM (SELECT CASE WHEN status = 'candidate' THEN 'ok' ELSE status END AS status FROM edge) GROUP BY status", faults=True)
def review_accept(g: Graph) -> DataFrame:
    return batch.reviewed(g.edge, g.edge.select("id"), True).groupBy("status").agg(F.count("*").alias("edges"))


@query("SELECT count(*) AS rows, CAST(sum(CAST(CAST('0x' || substr(sha256(concat_ws('|', CAST(concept_id AS VARCHAR), lang, term)), 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS digest FROM term")
def table_fingerprint(g: Graph) -> DataFrame:
    return batch.fingerprint(g.term)


# retrieval and extraction
_QUESTIONS = "SELECT p.id AS qid, concat('What is the ', p.name, ' of ', n.name, ' and who sells it?') AS question FROM concept p JOIN concept n ON n.id = 200 + p.id % 25 WHERE p.id BETWEEN 1000001 AND 1999999"
_CLEAN = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}#]+', ' ', 'g'))"
_STOPS = ", ".join(f"'{w}'" for w in text.STOP)
_FOUND = f"""qs AS ({_QUESTIONS}), qw AS (SELECT qid, list_filter(string_split(regexp_replace(lower(question), '[^\\p{{L}}\\p{{N}}#]+', ' ', 'g'), ' '), lambda w: w <> '' AND w NOT IN ({_STOPS})) AS w FROM qs),
  qg AS (SELECT qid, n, i - 1 AS place, array_to_string(w[i:i + n - 1], ' ') AS key FROM (SELECT qid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM qw CROSS JOIN (SELECT unnest([3, 2, 1]) AS n) nn)),
  nm AS (SELECT DISTINCT id, key FROM (SELECT concept_id AS id, {_CLEAN.format("term")} AS key FROM term UNION ALL SELECT id, {_CLEAN.format("name")} FROM concept)),
  fc AS (SELECT qid, id, n AS words, place FROM (SELECT qid, id, n, place, row_number() OVER (PARTITION BY qid ORDER BY n DESC, place, id) AS k FROM (SELECT g.qid, nm.id, max(g.n) AS n, arg_min(g.place, (-g.n, g.place)) AS place FROM qg g JOIN nm ON nm.key = g.key GROUP BY g.qid, nm.id)) WHERE k <= 8)"""


#: Questions about the parts beyond the first million too, whose ids lie in a trillion of their own.
_ALL_QUESTIONS = _QUESTIONS.replace("p.id BETWEEN 1000001 AND 1999999", "(p.id BETWEEN 1000000 AND 1999999 OR p.id BETWEEN 1000000000000 AND 1999999999999)")


def _questions(g: Graph, text: str = _QUESTIONS) -> DataFrame:
    """The questions of a text about parts."""
    return g.spark.sql(text.replace("concept p", "{concept} p").replace("concept n", "{concept} n"), concept=g.concept)


@query("SELECT qid, id, CAST(words AS BIGINT) AS words, CAST(place AS BIGINT) AS place FROM fc", more=_FOUND)
def find_concepts(g: Graph) -> DataFrame:
    return retrieval.found_concepts(g, _questions(g))


@query(
    "SELECT qid, id, links FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY links DESC, id) AS k FROM (SELECT f.qid, l.o AS id, count(*) AS links FROM fc f JOIN (SELECT subject AS i, target AS o FROM edge WHERE status = 'ok' UNION ALL SELECT target, subject FROM edge WHERE status = 'ok' AND code <> '14') l ON l.i = f.id WHERE NOT EXISTS (SELECT 1 FROM fc x WHERE x.qid = f.qid AND x.id = l.o) GROUP BY f.qid, l.o)) WHERE k <= 10",
    more=_FOUND,
)
def related_topk(g: Graph) -> DataFrame:
    return retrieval.once_a_text(_questions(g), lambda q: retrieval.related(g, materialized(retrieval.found_concepts(g, q))))


#: The largest group of linked concepts of each question: links are direct or by a common neighbour.
_LINKED = """nbr AS (SELECT subject AS x, target AS y FROM edge WHERE status = 'ok' AND subject <> target UNION SELECT target, subject FROM edge WHERE status = 'ok' AND subject <> target),
  fn AS (SELECT f.qid, f.id, n.y FROM {0} f JOIN nbr n ON n.x = f.id), lk AS (SELECT f.qid, f.id AS a, f.y AS b FROM fn f JOIN {0} g ON g.qid = f.qid AND g.id = f.y UNION SELECT f.qid, f.id, g.id FROM fn f JOIN fn g ON g.qid = f.qid AND g.y = f.y AND g.id <> f.id),
  lr AS (SELECT qid, a AS id, a AS o FROM lk UNION SELECT lr.qid, lr.id, lk.b FROM lr JOIN lk ON lk.qid = lr.qid AND lk.a = lr.o), lc AS (SELECT qid, id, min(o) AS comp FROM lr GROUP BY qid, id),
  lb AS (SELECT qid, comp FROM (SELECT qid, comp, count(*) AS n FROM lc GROUP BY qid, comp) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY n DESC, comp) = 1),
  cn AS (SELECT f.qid, f.id FROM {0} f LEFT JOIN lc ON lc.qid = f.qid AND lc.id = f.id LEFT JOIN lb ON lb.qid = f.qid WHERE lb.comp IS NULL OR lc.comp = lb.comp)"""


@query("SELECT qid, id FROM cn", more=_FOUND.replace(_QUESTIONS, _ALL_QUESTIONS) + ", " + _LINKED.format("fc"), uses=())
def connected_concepts(g: Graph) -> DataFrame:
    return retrieval.once_a_text(_questions(g, _ALL_QUESTIONS), lambda q: retrieval.connected(g, retrieval.found_concepts(g, q)))


#: Names as near words see them, by language, and the words of questions as they are asked.
_ASKED_WORDS = f"""qs AS ({_QUESTIONS}), aw AS (SELECT qid, 'en' AS lang, list_filter(list_transform(regexp_split_to_array(question, '\\s+'), lambda w: lower(trim(w, '.,?!()\"''«»'))), lambda w: w <> '' AND w NOT IN ({_STOPS})) AS w FROM qs),
  ag AS (SELECT qid, n, i - 1 AS place, array_to_string(w[i:i + n - 1], ' ') AS ph FROM (SELECT qid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM aw CROSS JOIN (SELECT unnest([3, 2, 1]) AS n) nn)), ph AS (SELECT DISTINCT n, ph FROM ag),
  tl AS (SELECT DISTINCT concept_id AS id, lang, translate(lower(term), 'ё', 'е') AS t, len(string_split(term, ' ')) AS n FROM term),
  kl AS (SELECT DISTINCT id, lang, key FROM (SELECT concept_id AS id, lang, lower(regexp_replace(trim(term), '\\s+', ' ', 'g')) AS key FROM term UNION ALL SELECT id, 'name', lower(regexp_replace(trim(name), '\\s+', ' ', 'g')) FROM concept)),
  ah AS (SELECT p.ph, k.id, CASE WHEN k.lang = 'en' THEN 0 ELSE 20 END AS tier FROM ph p JOIN kl k ON k.key = p.ph WHERE p.n > 1
    UNION SELECT p.ph, t.id, CASE WHEN t.lang = 'en' THEN 10 ELSE 30 END FROM ph p JOIN tl t ON t.n = p.n AND left(t.t, 2) = left(p.ph, 2) WHERE p.n > 1 AND {_near("split_part(p.ph, ' ', 1)", "split_part(t.t, ' ', 1)")} AND {_near("split_part(p.ph, ' ', 2)", "split_part(t.t, ' ', 2)")} AND (p.n < 3 OR {_near("split_part(p.ph, ' ', 3)", "split_part(t.t, ' ', 3)")})
    UNION SELECT p.ph, t.id, CASE WHEN t.lang = 'en' THEN 0 ELSE 20 END + CASE WHEN p.ph = t.t THEN 1 ELSE 2 END FROM ph p JOIN tl t ON t.n = 1 AND left(t.t, 2) = left(p.ph, 2) WHERE p.n = 1 AND {_near("p.ph", "t.t")}),
  ab AS (SELECT ph, id FROM ah QUALIFY tier = min(tier) OVER (PARTITION BY ph)), af AS (SELECT qid, id, -min(st[1]) AS words, arg_min(st[2], st) AS place FROM (SELECT g.qid, b.id, [-g.n, g.place] AS st FROM ag g JOIN ab b ON b.ph = g.ph) GROUP BY qid, id),
  {_LINKED.format("af")}, aq AS (SELECT af.qid, af.id, words, place FROM af JOIN cn ON cn.qid = af.qid AND cn.id = af.id QUALIFY row_number() OVER (PARTITION BY af.qid ORDER BY words DESC, place, af.id) <= 8)"""
_FACT = "'[' || u.name || '] ' || array_to_string(string_split(split_part(d.definition, '. Species:', 1), '; ')[1:3], '; ')"


@query("SELECT qid, id, CAST(words AS BIGINT) AS words, CAST(place AS BIGINT) AS place FROM aq", more=_ASKED_WORDS, uses=(), small=True)
def asked_concepts(g: Graph) -> DataFrame:
    """What every question is about: near words too, and only concepts that are linked."""
    return retrieval.asked(g, _questions(g))


@query(
    """SELECT qs.qid, 'Facts:' || chr(10) || coalesce(k.v, '(none)') || coalesce(chr(10) || chr(10) || 'Related facts, one step away:' || chr(10) || n.v, '') || chr(10) || chr(10) || 'Question: ' || question || chr(10) || chr(10) || 'Answer:' AS prompt FROM qs
      LEFT JOIN (SELECT qid, string_agg('- ' || fact, chr(10) ORDER BY words DESC, place, aq.id) AS v FROM aq JOIN fx ON fx.id = aq.id GROUP BY qid) k ON k.qid = qs.qid LEFT JOIN (SELECT qid, string_agg('- ' || fact, chr(10) ORDER BY links DESC, rl.id) AS v FROM rl JOIN fx ON fx.id = rl.id GROUP BY qid) n ON n.qid = qs.qid""",
    more=_ASKED_WORDS.replace(_QUESTIONS, _ALL_QUESTIONS)
    + ", "
    + _DEFINED
    + f""", fx AS (SELECT d.id, {_FACT} AS fact FROM df d JOIN universe u ON u.id = d.context),
      rl AS (SELECT qid, id, links FROM (SELECT f.qid, l.o AS id, count(*) AS links FROM aq f JOIN (SELECT subject AS i, target AS o FROM edge WHERE status = 'ok' UNION ALL SELECT target, subject FROM edge WHERE status = 'ok' AND code <> '14') l ON l.i = f.id WHERE NOT EXISTS (SELECT 1 FROM aq x WHERE x.qid = f.qid AND x.id = l.o) GROUP BY f.qid, l.o) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY links DESC, id) <= 10)""",
    uses=("okg",),
    small=True,
)
def grounded_prompts(g: Graph) -> DataFrame:
    return retrieval.prompts(g, _questions(g, _ALL_QUESTIONS))


@query(f"SELECT d.id, {_FACT} AS fact FROM df d JOIN universe u ON u.id = d.context", more=_DEFINED, uses=("okg",))
def facts_block(g: Graph) -> DataFrame:
    return retrieval.facts(g, g.concept.select("id"))


def _trimmed(x: str) -> str:
    return f"trim(trim(trim({x}), '.,;:'))"


def _cuts(x: str, patterns: tuple[str, ...], by: str, flags: str = "") -> str:
    for p in patterns:
        x = f"regexp_replace({x}, '{p}', '{by}'{flags})"
    return x


_PAGE = "trim(" + _cuts("html", ("(?is)<script[^>]*>.*?</script>", "(?is)<style[^>]*>.*?</style>", "<[^>]+>", "\\s+"), " ", ", 'g'") + ")"
_NAMES = " || ".join(f"regexp_extract_all(text, '{p}', 1)" for p in text.NAMING)
_TAIL = f"(?:(?:^|\\s+)(?:{'|'.join(text.EMPTY_TAILS)}))+$"
_OPENED = _cuts("first", text.OPENINGS, "")
_DEFINED = _trimmed(f"regexp_extract(trim({_OPENED}), '{text.DEFINITION}', 1)")
_GENUS_PHRASE = f"trim(regexp_replace(lower({_DEFINED}), '{_TAIL}', ''))"
_PAGES = f"""WITH t AS (SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS term, {_PAGE} AS text FROM pages),
  f AS (SELECT *, regexp_extract(text, '^\\s*([^.!?]*[.!?])', 1) AS first FROM t), g AS (SELECT *, {_GENUS_PHRASE} AS p FROM f),
  n AS (SELECT page_id, list_transform(flatten(list_transform({_NAMES}, lambda x: regexp_split_to_array({_trimmed("x")}, '\\s+or\\s+|\\s+and\\s+'))), lambda x: {_trimmed("x")}) AS names FROM f),
  x AS (SELECT g.page_id, first, CASE WHEN p <> '' AND len(regexp_split_to_array(p, '\\s+')) <= 4 AND p <> lower(term) AND p NOT IN ({", ".join(f"'{w}'" for w in text.NO_KINDS)}) THEN regexp_replace(p, '\\s+', ' ', 'g') END AS genus,
    nullif({_trimmed(f"regexp_extract(text, '{text.EXPANSION}', 1)")}, '') AS expansion,
    array_to_string(list_filter(names, lambda x: regexp_matches(x, '^\\p{{L}}') AND len(regexp_split_to_array(x, '\\s+')) <= 5), '|') AS synonyms FROM g JOIN n ON n.page_id = g.page_id)
"""


@table_query(_PAGES + "SELECT page_id, first, genus, expansion, synonyms FROM x")
def extract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First sentences and facts of the raw pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return retrieval.extracted(pages.select("page_id", retrieval.page_title().alias("term"), retrieval.page_text().alias("text")))


@table_query(_PAGES + "SELECT page_id, synonyms FROM x")
def extract_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synonyms in all pages."""
    return extract_pages(spark, sf_dir).select("page_id", "synonyms")


@table_query(_PAGES + "SELECT page_id, genus, expansion FROM x")
def extract_genus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genus and expansion in all pages."""
    return extract_pages(spark, sf_dir).select("page_id", "genus", "expansion")


# views, assemblies and small changes
@query(
    """SELECT 'attributes' AS view, id FROM edge WHERE status = 'ok' AND CAST(code AS INT) BETWEEN 15 AND 27 UNION ALL SELECT 'logical', id FROM edge WHERE status = 'ok' AND CAST(code AS INT) BETWEEN 30 AND 64
      UNION ALL SELECT 'causal', id FROM edge WHERE status = 'ok' AND CAST(code AS INT) BETWEEN 70 AND 74 UNION ALL SELECT 'negative', id FROM edge WHERE status = 'ok' AND strength = 0"""
)
def relation_views(g: Graph) -> DataFrame:
    one = [ops.relation_view(g, v).select(F.lit(v).alias("view"), "id") for v in ("attributes", "logical", "causal", "negative")]
    return one[0].union(one[1]).union(one[2]).union(one[3])


_UP = """t AS (SELECT id AS root, CAST(NULL AS BIGINT) AS node, id AS parent, 0 AS depth, [id] AS path FROM concept
      UNION ALL SELECT t.root, t.parent, e.target, t.depth + 1, list_append(t.path, e.target) FROM t JOIN (SELECT DISTINCT subject, target FROM edge WHERE status = 'ok' AND code = '14') e ON e.subject = t.parent WHERE NOT list_contains(t.path, e.target) AND t.depth < 10)"""


@query("SELECT root, parent AS node, CAST(max(depth) AS BIGINT) AS level FROM t WHERE depth > 0 GROUP BY root, parent", more=_UP)
def ancestor_layers(g: Graph) -> DataFrame:
    return ops.ancestor_layers(g, g.concept.select("id"))


@query("SELECT parent, node, CAST((row_number() OVER (PARTITION BY parent ORDER BY node) - 1) // 50 AS BIGINT) AS page FROM (SELECT DISTINCT target AS parent, subject AS node FROM edge WHERE status = 'ok' AND code = '14')")
def child_pages(g: Graph) -> DataFrame:
    return ops.child_pages(g)


@query("SELECT DISTINCT 'up' AS side, root, node, parent, CAST(depth AS BIGINT) AS depth FROM t WHERE depth > 0 UNION ALL SELECT 'down', root, node, parent, depth FROM td", more=_UP + ", " + _DOWN, uses=("okg",))
def tree_views(g: Graph) -> DataFrame:
    """The trees above and below every concept."""
    return ops.tree_view(g, g.concept.select("id"))


@query("SELECT w AS word, min(id) AS id FROM (SELECT DISTINCT upper(name) AS w FROM concept) q JOIN ka ON ka.key = lower(w) GROUP BY w", more=_KEYS)
def term_first_match(g: Graph) -> DataFrame:
    return terms.first_match(g, g.concept.select(F.upper("name").alias("word")).distinct())


@query(
    """SELECT DISTINCT w AS word, id FROM (SELECT w, id, k, min(k) OVER (PARTITION BY w) AS least FROM (
        SELECT w, 0 AS k, w AS key FROM q UNION ALL SELECT w, 1, regexp_replace(w, 's$', '') FROM q UNION ALL SELECT w, 2, regexp_replace(w, 'es$', '') FROM q) JOIN ky USING (key)) WHERE k = least""",
    more=_KEYS + ", q AS (SELECT DISTINCT lower(name) || CASE WHEN id % 2 = 0 THEN 's' ELSE 'es' END AS w FROM concept WHERE id >= 100)",
)
def term_by_singular(g: Graph) -> DataFrame:
    return terms.by_singular(g, g.concept.filter("id >= 100").select(F.concat(F.lower("name"), F.expr("if(id % 2 = 0, 's', 'es')")).alias("word")).distinct())


_VERBS = "SELECT id AS concept_id, 'to ' || lower(name) AS term, 'en' AS lang FROM concept WHERE id BETWEEN 200 AND 224 UNION ALL SELECT id, lower(name), 'en' FROM concept WHERE id BETWEEN 200 AND 211"


def _with_verbs(g: Graph, names: bool = True) -> Graph:
    """The graph with infinitives as terms of nations, and without their names as such."""
    verbs = g.spark.sql(_VERBS.replace("FROM concept", "FROM {concept}"), concept=g.concept)
    term = g.term.filter("concept_id not between 200 and 205" if names else "concept_id not between 200 and 224").union(verbs)
    return Graph(g.spark, g.concept, term, g.edge, g.rule, g.anchor, g.context)


@query(
    """SELECT id, CASE WHEN inf THEN substr(term, 4) ELSE term END AS label FROM (SELECT v.*, row_number() OVER (PARTITION BY id ORDER BY tier, length(term), term) AS k FROM (
        SELECT concept_id AS id, term, term LIKE 'to %' AS inf, CASE WHEN term LIKE 'to %' THEN 2 WHEN (concept_id, term) IN (SELECT (concept_id, substr(term, 4)) FROM vt WHERE term LIKE 'to %') THEN 1 ELSE 0 END AS tier FROM vt) v) WHERE k = 1""",
    more=f"vt AS (SELECT concept_id, term FROM term WHERE lang = 'en' AND concept_id NOT BETWEEN 200 AND 205 UNION ALL SELECT concept_id, term FROM ({_VERBS}))",
)
def term_infinitive_label(g: Graph) -> DataFrame:
    return terms.infinitive_display(_with_verbs(g))


@query(
    "SELECT concept_id, term, lang FROM vt UNION SELECT concept_id, substr(term, 4), lang FROM vt WHERE lang = 'en' AND term LIKE 'to %'",
    more=f"vt AS (SELECT concept_id, term, lang FROM term WHERE concept_id NOT BETWEEN 200 AND 224 UNION ALL SELECT * FROM ({_VERBS}))",
)
def term_bare_forms(g: Graph) -> DataFrame:
    return terms.with_bare_forms(_with_verbs(g, names=False))


@query(
    "SELECT v AS id, count(DISTINCT x.id) AS members FROM (SELECT CAST(unnest([100, 101, 301, 302, 2]) AS BIGINT) AS v) q LEFT JOIN x ON x.seed = v GROUP BY v UNION ALL SELECT NULL, count(DISTINCT id) FROM x",
    more=_x(*_IDS),
)
def catalog_counts(g: Graph) -> DataFrame:
    return regions.set_counts(g, _IDS)


@query(
    "SELECT id, CAST(max(n) AS BIGINT) AS level FROM ch GROUP BY id",
    more=_EUP + f", kk AS (SELECT a, b, {_KIND} AS kind FROM ek), ins AS (SELECT a AS id, b AS p FROM kk WHERE kind = 'inside' UNION ALL SELECT b, a FROM kk WHERE kind = 'contains'), ch AS (SELECT id, id AS at, 0 AS n FROM sel UNION ALL SELECT ch.id, ins.p, ch.n + 1 FROM ch JOIN ins ON ins.id = ch.at)",
)
def euler_nesting(g: Graph) -> DataFrame:
    return regions.nesting(regions.pair_kinds(g, _EUL))


@query(
    "SELECT id, min(o) AS component FROM (SELECT seed AS id, id AS o FROM es) WHERE o IN (SELECT id FROM sel) GROUP BY id HAVING count(*) > 1",
    more=_EUP.replace(", ".join(map(str, _EUL)), ", ".join(map(str, _SIB))),
)
def euler_equal_groups(g: Graph) -> DataFrame:
    return regions.equal_groups(regions.pair_kinds(g, _SIB))


@query(
    "SELECT id FROM edge e WHERE code = '22' AND NOT EXISTS (SELECT 1 FROM pl WHERE pl.subject = e.subject AND pl.target = e.target AND (pl.strength IS NULL OR pl.strength = e.strength))",
    more="pl AS (SELECT id AS subject, 401 + id % 5 AS target, CASE WHEN id % 2 = 0 THEN 80 END AS strength FROM concept)",
)
def policy_blocked(g: Graph) -> DataFrame:
    policy = g.concept.select(F.col("id").alias("subject"), F.lit("22").alias("code"), (401 + F.col("id") % 5).alias("target"), F.expr("if(id % 2 = 0, 80L, null)").alias("strength"))
    return qa.blocked(g.edge.filter("code = '22'"), policy).select("id")


@query("SELECT id, CAST(CASE WHEN id < 300 THEN 3 ELSE processed END AS BIGINT) AS processed FROM concept")
def level_set(g: Graph) -> DataFrame:
    return batch.with_level(g.concept, g.concept.filter("id < 300").select("id"), 3).select("id", "processed")


@query("SELECT id, CASE code WHEN '61' THEN '64' WHEN '22' THEN '21' ELSE code END AS code, CASE WHEN code IN ('61', '22') THEN coalesce(strength, 100) ELSE strength END AS strength FROM edge")
def codes_migrated(g: Graph) -> DataFrame:
    return batch.recoded(g.edge, {"61": "64", "22": "21"}).select("id", "code", "strength")


@query("SELECT code, CASE code WHEN '14' THEN 'kind of' WHEN '70' THEN 'brings forth' ELSE name END AS name, mutual FROM rule")
def relations_relabelled(g: Graph) -> DataFrame:
    return batch.relabelled(g.rule, {"14": "kind of", "70": "brings forth"})


@query(
    """SELECT verdict, count(*) AS edges FROM (SELECT CASE WHEN (s, t) IN (SELECT (subject, target) FROM ok1 WHERE code = '14') THEN 'duplicate' WHEN s = t OR (s, t) IN (SELECT (ancestor, descendant) FROM kb) THEN 'cycle'
        WHEN (s, t) IN (SELECT (descendant, ancestor) FROM kb) THEN 'redundant' ELSE 'ok' END AS verdict FROM gp) GROUP BY verdict""",
    more="gp AS (SELECT id AS s, CAST(100 + id % 5 AS BIGINT) AS t FROM concept)",
)
def genus_added(g: Graph) -> DataFrame:
    return batch.with_genus(g, g.concept.select(F.col("id").alias("subject"), (100 + F.col("id") % 5).alias("target")))[1]


def _traced(g: Graph, source: str, concept: int) -> dict:
    return Algebra(g).explain(source, concept)


@query(
    "SELECT '#100' AS expression, 2000001 IN (SELECT id FROM x WHERE seed = 100) AS member UNION ALL SELECT '#6', 2000001 IN (SELECT id FROM x WHERE seed = 6) UNION ALL SELECT '#3', 2000001 IN (SELECT id FROM x WHERE seed = 3)",
    more=_x(100, 6, 3),
)
def explain_members(g: Graph) -> DataFrame:
    """The operands of a set expression, and whether they hold one customer."""
    trace = _traced(g, "#100 | (#6 & #3)", 2000001)
    left, (right, last) = trace["operands"][0], trace["operands"][1]["operands"]
    return g.spark.createDataFrame([(x["expression"], x["member"]) for x in (left, right, last)], "expression string, member boolean")


_PATH = "p AS (SELECT CAST(2000001 AS BIGINT) AS node, 0 AS depth, CAST([] AS BIGINT[]) AS edges UNION ALL SELECT e.target, p.depth + 1, list_append(p.edges, e.id) FROM p JOIN pos1 e ON e.subject = p.node AND e.code = '14')"


@query("SELECT unnest(edges) AS edge, unnest(range(1, len(edges) + 1)) AS place FROM (SELECT edges FROM p WHERE node = 1 ORDER BY depth, edges LIMIT 1)", more=_PATH)
def explain_path(g: Graph) -> DataFrame:
    """The witness of one customer's membership in the top concept."""
    path = _traced(g, "#1", 2000001)["path"]
    return g.spark.createDataFrame([(e["id"], k) for k, e in enumerate(path, 1)], "edge long, place long")


@query("SELECT unnest(edges) AS edge, unnest(range(1, len(edges) + 1)) AS place FROM (SELECT edges FROM p WHERE node = 1 ORDER BY depth, edges LIMIT 1)", more=_PATH)
def explain_navigation(g: Graph) -> DataFrame:
    """The witness that the top concept is an ancestor of one customer."""
    path = _traced(g, "ancestors(exact(#2000001))", 1)["path"]
    return g.spark.createDataFrame([(e["id"], k) for k, e in enumerate(path, 1)], "edge long, place long")


@query("SELECT edge, o.owner IS NOT NULL AS overridden FROM app a LEFT JOIN ovr o ON o.subject = a.subject AND o.owner = a.owner WHERE a.subject = (SELECT min(id) FROM concept WHERE id > 2000000 AND id % 10 = 0)", more=_APP)
def explain_property(g: Graph) -> DataFrame:
    """The assertions that decide one customer's property, and those that are overridden."""
    one = g.concept.filter("id > 2000000 and id % 10 = 0").agg(F.min("id")).first()[0]
    fact = inherit.explained(g, one, "22", 401)
    return g.spark.createDataFrame([(x["edge"]["id"], False) for x in fact["evidence"]] + [(i, True) for i in fact["overridden_edge_ids"]], "edge long, overridden boolean")


_COUNTED = "SELECT '{0}' AS region, count(*) AS members, FALSE AS counterexample, coalesce((SELECT string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FROM (SELECT id FROM x WHERE seed = {1} ORDER BY id LIMIT 5)), '') AS sample, count(*) > 5 AS truncated FROM x WHERE seed = {1}"
query(_COUNTED.format("left_counted", 100) + " UNION ALL " + _COUNTED.format("right_counted", 301), more=_x(100, 301), name="counted_regions")(lambda g: Algebra(g).regions("count(#100) > count(#301)"))


# questions and answers
@query("SELECT a, expected FROM (SELECT subject AS a, count(*) AS n, array_to_string(list_sort(list(target)), ',') AS expected FROM g14 GROUP BY subject) WHERE n <= 4")
def qa_parents(g: Graph) -> DataFrame:
    return qa.parents_pool(g)


@query(
    "SELECT subject AS a, ancestor AS b, CAST(depth AS BIGINT) AS hops, array_to_string(edges, ',') AS edges FROM (SELECT *, row_number() OVER (PARTITION BY subject, ancestor ORDER BY depth, edges) AS k FROM p) WHERE k = 1 AND depth BETWEEN 2 AND 4",
    more="p AS (SELECT id AS subject, id AS ancestor, 0 AS depth, CAST([] AS BIGINT[]) AS edges FROM concept UNION ALL SELECT p.subject, e.target, p.depth + 1, list_append(p.edges, e.id) FROM p JOIN pos1 e ON e.subject = p.ancestor AND e.code = '14')",
)
def qa_ancestry(g: Graph) -> DataFrame:
    return qa.ancestry_pool(g)


@query("SELECT subject AS a, lead(subject, k) OVER (PARTITION BY target, k ORDER BY subject) AS b, target AS genus FROM g14 CROSS JOIN (SELECT unnest([1, 2, 3]) AS k) q QUALIFY lead(subject, k) OVER (PARTITION BY target, k ORDER BY subject) IS NOT NULL")
def qa_shared_genus(g: Graph) -> DataFrame:
    return qa.shared_genus_pool(g)


@query(
    "SELECT sta.id AS a, state FROM sta WHERE id IN (SELECT subject FROM ow UNION SELECT subject FROM (SELECT subject, row_number() OVER (PARTITION BY target ORDER BY subject) AS k FROM g14 WHERE target IN (SELECT subject FROM ow)) WHERE k <= 5 UNION SELECT target FROM g14 WHERE subject IN (SELECT subject FROM ow))",
    more=_APP + ", ow AS (SELECT DISTINCT subject FROM ok1 WHERE code = '22' AND target = 401)",
)
def qa_property(g: Graph) -> DataFrame:
    return qa.property_pool(g, "22", 401)


@query("SELECT a.s AS a, b.s AS b, (SELECT count(*) FROM ext e JOIN ext f ON f.id = e.id AND f.seed = b.s WHERE e.seed = a.s) AS expected FROM (SELECT CAST(unnest([100, 101, 102, 103, 104]) AS BIGINT) AS s) a CROSS JOIN (SELECT CAST(unnest([301, 302, 303]) AS BIGINT) AS s) b", more=_x(100, 101, 102, 103, 104, 301, 302, 303))
def qa_count(g: Graph) -> DataFrame:
    a, b = g.concept.filter("id between 100 and 104").select(F.col("id").alias("a")), g.concept.filter("id between 301 and 303").select(F.col("id").alias("b"))
    return qa.count_pool(g, a.join(b, F.lit(True)))  # five by three


@query("SELECT a.subject AS a, a.code, a.target, coalesce(t.state, 'unknown') AS state FROM nr a LEFT JOIN st2 t ON t.subject = a.subject AND t.code = a.code AND t.target = a.target",
    more="""asr AS (SELECT subject AS owner, code, target, strength, id FROM ok1 WHERE code IN ('15','20','21','22','23','24','25','26','27')),
      kd AS (SELECT subject, target AS genus FROM (SELECT subject, target, row_number() OVER (PARTITION BY target ORDER BY subject) AS k FROM g14) WHERE k <= 5),
      nr AS (SELECT owner AS subject, code, target FROM asr UNION SELECT kd.subject, code, asr.target FROM asr JOIN kd ON kd.genus = owner UNION SELECT g.target, code, asr.target FROM asr JOIN g14 g ON g.subject = owner),
      ap2 AS (SELECT n.subject, n.code, n.target, a.owner, a.strength FROM nr n JOIN clo c ON c.descendant = n.subject JOIN asr a ON a.owner = c.ancestor AND a.code = n.code AND a.target = n.target),
      ef2 AS (SELECT * FROM ap2 x WHERE NOT EXISTS (SELECT 1 FROM ap2 y JOIN up u ON u.descendant = y.owner AND u.ancestor = x.owner WHERE y.subject = x.subject AND y.code = x.code AND y.target = x.target AND NOT EXISTS (SELECT 1 FROM up r WHERE r.descendant = x.owner AND r.ancestor = y.owner))),
      st2 AS (SELECT subject, code, target, CASE WHEN bool_or(strength = 0) AND bool_or(strength IS NULL OR strength > 0) THEN 'conflict' WHEN bool_or(strength = 0) THEN 'negative' ELSE 'positive' END AS state FROM ef2 GROUP BY subject, code, target)""",
)
def qa_states(g: Graph) -> DataFrame:
    return qa.states_pool(g).select("a", "code", "target", "state")


@query()
def qa_messages(g: Graph) -> DataFrame:
    """A batch of records as chat messages."""
    return qa.records(g, seed=42, count=200).select("id", "task", "question", "answer", F.to_json("messages").alias("messages"))


@query()
def qa_verified(g: Graph) -> DataFrame:
    """The records held against the graph: every one must be without errors."""
    return qa.verified(g, qa.records(g, seed=42, count=200))


@query()
def qa_report(g: Graph) -> DataFrame:
    """What a batch of records holds."""
    return qa.report(qa.records(g, seed=42, count=200))


# the queries of changes, words and diagrams register themselves
from ontoloom import queries_changes  # noqa: E402, F401
