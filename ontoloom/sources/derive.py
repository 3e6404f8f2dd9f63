"""The concept graph of the star-schema tables: regions, nations, segments, brands and types are genera of customers, suppliers and parts.

One SQL text per table serves Spark here and DuckDB in the oracles; it uses only what both read alike. Edge ids are computed
from the edge's own key, so no global sort is needed to number edges and both engines agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ontoloom.plans.tables import materialized
from ontoloom.sources.model import Graph

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

CONCEPT_SQL = """
SELECT CAST(id AS BIGINT) AS id, CAST(name AS STRING) AS name, CAST(CASE WHEN id >= 2000000 AND id % 4 = 0 THEN 2 ELSE 1 END AS BIGINT) AS context,
  CAST(CASE WHEN id % 7 = 0 THEN NULL ELSE id % 4 END AS BIGINT) AS processed
FROM (
  SELECT 1 AS id, 'entity' AS name UNION ALL SELECT 2, 'place' UNION ALL SELECT 3, 'party' UNION ALL SELECT 4, 'product'
  UNION ALL SELECT 5, 'priority' UNION ALL SELECT 6, 'segment' UNION ALL SELECT 7, 'brand' UNION ALL SELECT 8, 'type'
  UNION ALL SELECT 100 + r_regionkey, r_name FROM region
  UNION ALL SELECT 200 + n_nationkey, n_name FROM nation
  UNION ALL SELECT 300 + rank() OVER (ORDER BY s), s FROM (SELECT DISTINCT c_mktsegment AS s FROM customer) a
  UNION ALL SELECT 400 + CAST(substr(p, 1, 1) AS INT), p FROM (SELECT DISTINCT o_orderpriority AS p FROM orders) b
  UNION ALL SELECT 500 + CAST(replace(b, 'Brand#', '') AS INT), b FROM (SELECT DISTINCT p_brand AS b FROM part) c
  UNION ALL SELECT 600 + rank() OVER (ORDER BY t), t FROM (SELECT DISTINCT p_type AS t FROM part) d
  UNION ALL SELECT PART(p_partkey), p_name FROM part
  UNION ALL SELECT CUST(c_custkey), c_name FROM customer
  UNION ALL SELECT SUPP(s_suppkey), s_name FROM supplier
) x
"""

EDGE_SQL = """
SELECT EDGE_ID AS id, subject, code, target, context, strength, status
FROM (
  SELECT CAST(subject AS BIGINT) AS subject, CAST(code AS STRING) AS code, CAST(target AS BIGINT) AS target, CAST(context AS BIGINT) AS context,
    CAST(strength AS BIGINT) AS strength, CAST('ok' AS STRING) AS status
  FROM (
    SELECT 2 AS subject, '14' AS code, 1 AS target, 1 AS context, NULL AS strength UNION ALL SELECT 3, '14', 1, 1, NULL UNION ALL SELECT 4, '14', 1, 1, NULL
    UNION ALL SELECT 5, '14', 1, 1, NULL UNION ALL SELECT 6, '14', 3, 1, NULL UNION ALL SELECT 7, '14', 4, 1, NULL UNION ALL SELECT 8, '14', 4, 1, NULL
    UNION ALL SELECT 100 + r_regionkey, '14', 2, 1, NULL FROM region
    UNION ALL SELECT 200 + n_nationkey, '14', 100 + n_regionkey, 1, NULL FROM nation
    UNION ALL SELECT id, '14', 6, 1, NULL FROM seg
    UNION ALL SELECT DISTINCT 400 + CAST(substr(o_orderpriority, 1, 1) AS INT), '14', 5, 1, NULL FROM orders
    UNION ALL SELECT DISTINCT 500 + CAST(replace(p_brand, 'Brand#', '') AS INT), '14', 7, 1, NULL FROM part
    UNION ALL SELECT id, '14', 8, 1, NULL FROM typ
    UNION ALL SELECT PART(p_partkey), '14', 500 + CAST(replace(p_brand, 'Brand#', '') AS INT), 1, NULL FROM part
    UNION ALL SELECT PART(p_partkey), '14', id, c, NULL FROM part JOIN typ ON p_type = name CROSS JOIN (SELECT 1 AS c UNION ALL SELECT 2) cc
    UNION ALL SELECT CUST(c_custkey), '14', 200 + c_nationkey, 1, NULL FROM customer
    UNION ALL SELECT CUST(c_custkey), '14', id, c, NULL FROM customer JOIN seg ON c_mktsegment = name CROSS JOIN (SELECT 1 AS c UNION ALL SELECT 2) cc
    UNION ALL SELECT SUPP(s_suppkey), '14', 200 + s_nationkey, 1, NULL FROM supplier
    UNION ALL SELECT 200 + n_nationkey, '22', 401 + n_nationkey % 5, 1, CASE WHEN n_nationkey % 3 = 0 THEN 0 END FROM nation
    UNION ALL SELECT id, '22', 401 + (id - 300) % 5, 1, 80 FROM seg
    UNION ALL SELECT CUST(o_custkey), '22', 401 + o_custkey % 5, 1, CAST(floor(CAST(100 * sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS DOUBLE) / count(*)) AS BIGINT)
      FROM orders WHERE o_custkey % 10 = 0 GROUP BY o_custkey
    UNION ALL SELECT CUST(s_suppkey), '30', SUPP(s_suppkey), 1, NULL FROM supplier JOIN customer ON c_custkey = s_suppkey WHERE s_suppkey % 17 = 0
    UNION ALL SELECT DISTINCT 500 + CAST(replace(p_brand, 'Brand#', '') AS INT), '40', id, 1, NULL FROM part JOIN typ ON p_type = name
    UNION ALL SELECT 100, '60', 101, 1, NULL
    UNION ALL SELECT 200 + a.n_nationkey, '61', 200 + b.n_nationkey, 1, NULL FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey
    UNION ALL SELECT SUPP(l_suppkey), '70', PART(l_partkey), 1, min(CAST(round(l_discount * 1000) AS BIGINT)) FROM lineitem GROUP BY l_suppkey, l_partkey
  ) y
) z
"""

#: Ids of the first million parts, customers and suppliers lie in a million each; further ones in a trillion each, so no two meet.
_KINDS = {"PART": 1, "CUST": 2, "SUPP": 3}
#: An edge's id is made of its key's digits; where ids are too large for that, it is a negative number of 60 bits of the key's MD5.
_WIDE = {"spark": "CAST(conv(substr(md5({0}), 1, 15), 16, 10) AS BIGINT)", "duckdb": "CAST('0x' || substr(md5({0}), 1, 15) AS BIGINT)"}


def _for(engine: str, text: str) -> str:
    """The text with ids written out for an engine."""
    import re

    for name, k in _KINDS.items():
        text = re.sub(rf"{name}\((\w+)\)", rf"(CASE WHEN \1 < 1000000 THEN {k}000000 + \1 ELSE {k}000000000000 + \1 END)", text)
    wide = _WIDE[engine].format("concat_ws('|', CAST(subject AS STRING), code, CAST(target AS STRING), CAST(context AS STRING))")
    return text.replace("EDGE_ID", f"CASE WHEN subject < 10000000 AND target < 10000000 THEN ((subject * 100 + CAST(code AS BIGINT)) * 10000000 + target) * 10 + context ELSE -{wide} END")


SEG_SQL = "SELECT 300 + rank() OVER (ORDER BY s) AS id, s AS name FROM (SELECT DISTINCT c_mktsegment AS s FROM customer) a"
TYP_SQL = "SELECT 600 + rank() OVER (ORDER BY t) AS id, t AS name FROM (SELECT DISTINCT p_type AS t FROM part) a"

TERM_SQL = """
SELECT id AS concept_id, name AS term, CAST('en' AS STRING) AS lang FROM concept WHERE id >= 100
UNION ALL SELECT id, term, lang FROM (
  SELECT CAST(100 AS BIGINT) AS id, CAST('Африка' AS STRING) AS term, CAST('ru' AS STRING) AS lang UNION ALL SELECT 101, 'Америка', 'ru' UNION ALL SELECT 102, 'Азия', 'ru'
  UNION ALL SELECT 103, 'Европа', 'ru' UNION ALL SELECT 104, 'Ближний Восток', 'ru' UNION ALL SELECT 6, 'сегмент', 'ru' UNION ALL SELECT 7, 'Марка', 'en'
) r
"""

RULE_SQL = """
SELECT CAST(code AS STRING) AS code, CAST(name AS STRING) AS name, mutual FROM (
  SELECT '14' AS code, 'genus' AS name, FALSE AS mutual UNION ALL SELECT '22', 'action', FALSE UNION ALL SELECT '30', 'coextension', TRUE UNION ALL SELECT '40', 'overlap', TRUE
  UNION ALL SELECT '60', 'incompatible', TRUE UNION ALL SELECT '61', 'coordinate', TRUE UNION ALL SELECT '64', 'contradictory', TRUE UNION ALL SELECT '70', 'produces', FALSE
) r
"""

ANCHOR_SQL = """
SELECT CAST(code AS STRING) AS code, CAST(side AS STRING) AS side, CAST(anchor AS BIGINT) AS anchor FROM (
  SELECT '22' AS code, 'subject' AS side, 2 AS anchor UNION ALL SELECT '22', 'subject', 3 UNION ALL SELECT '22', 'object', 5
  UNION ALL SELECT '61', 'subject', 2 UNION ALL SELECT '61', 'object', 2 UNION ALL SELECT '70', 'subject', 2 UNION ALL SELECT '70', 'object', 4
) a
"""

CONTEXT_SQL = """
SELECT CAST(id AS BIGINT) AS id, CAST(name AS STRING) AS name FROM (SELECT 1 AS id, 'everyday' AS name UNION ALL SELECT 2, 'scientific' UNION ALL SELECT 3, 'technical' UNION ALL SELECT 4, 'legal' UNION ALL SELECT 5, 'logic') c
"""

#: Rows with every structural fault, added to the derived edges by the audits and batch queries.
FAULT_SQL = """
SELECT EDGE_ID AS id, subject, code, target, context, strength, status FROM (
  SELECT CAST(subject AS BIGINT) AS subject, CAST(code AS STRING) AS code, CAST(target AS BIGINT) AS target, CAST(context AS BIGINT) AS context, CAST(strength AS BIGINT) AS strength, CAST(status AS STRING) AS status FROM (
    SELECT 2000001 AS subject, '14' AS code, 9999999 AS target, 1 AS context, NULL AS strength, 'ok' AS status UNION ALL SELECT 9999998, '22', 401, 1, NULL, 'ok'
    UNION ALL SELECT 7, '14', 7, 1, NULL, 'ok' UNION ALL SELECT 8, '61', 8, 1, NULL, 'ok' UNION ALL SELECT 200, '99', 201, 1, NULL, 'ok' UNION ALL SELECT 201, '22', 402, 1, 150, 'ok'
    UNION ALL SELECT 102, '14', 103, 3, NULL, 'ok' UNION ALL SELECT 103, '14', 104, 3, NULL, 'ok' UNION ALL SELECT 104, '14', 102, 3, NULL, 'ok'
    UNION ALL SELECT 1000001, '70', 1000002, 1, 10, 'ok' UNION ALL SELECT 2000002, '14', 2, 1, NULL, 'ok' UNION ALL SELECT 3000001, '14', 1, 1, NULL, 'ok'
    UNION ALL SELECT 2000003, '14', 100, 1, NULL, 'candidate' UNION ALL SELECT 2000004, '14', 101, 1, NULL, 'rejected' UNION ALL SELECT 200, '61', 100, 1, NULL, 'ok'
    UNION ALL SELECT 100, '61', 105, 1, 0, 'ok' UNION ALL SELECT 300, '61', 301, 1, NULL, 'ok' UNION ALL SELECT 301, '61', 200, 1, 60, 'ok'
  ) f
) h
"""

_graphs: dict[tuple[str, str, bool], Graph] = {}
#: Rows that a task has of tables that come of small files; so many concepts have three to four times as many edges but those of lineitem.
TASK_ROWS = 200_000


def _dealt(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The rows dealt to tasks by a key, so that a file of many short rows does not stay one task."""
    return df.repartition(1 + rows // TASK_ROWS, key)


def derived(spark: SparkSession, sf_dir: str, faults: bool = False) -> Graph:
    """The graph of the tables in sf_dir. Its tables are written once a session and read by every query after that."""
    key = (spark.sparkContext.applicationId, sf_dir, faults)
    if key in _graphs:
        return _graphs[key]
    t = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in TABLES}
    if faults:
        clean = derived(spark, sf_dir)
        g = Graph(spark, clean.concept, clean.term, materialized(clean.edge.unionByName(spark.sql(_for("spark", FAULT_SQL)))), clean.rule, clean.anchor, clean.context)
    else:

        def sql(text: str, **more) -> object:
            text = _for("spark", text)
            used = {k: v for k, v in (t | more).items()}
            for name in used:
                text = _named(text, name)
            return spark.sql(text, **used)

        seg, typ = sql(SEG_SQL), sql(TYP_SQL)
        rows = sum(t[name].count() for name in ("part", "customer", "supplier"))
        concept = materialized(_dealt(sql(CONCEPT_SQL), "id", rows))
        edge = sql(EDGE_SQL, seg=seg, typ=typ)
        edge = materialized(edge.filter("code = '70'")).union(materialized(_dealt(edge.filter("code <> '70'"), "subject", rows)))
        g = Graph(spark, concept, materialized(sql(TERM_SQL, concept=concept)), edge, sql(RULE_SQL), sql(ANCHOR_SQL), sql(CONTEXT_SQL))
    _graphs[key] = g
    return g


def _named(text: str, name: str) -> str:
    """Table names in FROM and JOIN become parameters of spark.sql."""
    import re

    return re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", text)


def oracle_prefix(faults: bool = False) -> str:
    """Common table expressions that derive the same tables in DuckDB."""
    s = lambda q: _for("duckdb", q).replace("AS STRING", "AS VARCHAR")
    edge = s(EDGE_SQL) + (" UNION ALL " + s(FAULT_SQL) if faults else "")
    parts = [("seg", SEG_SQL), ("typ", TYP_SQL), ("concept", s(CONCEPT_SQL)), ("edge", edge), ("term", s(TERM_SQL)), ("rule", s(RULE_SQL)), ("anchor", s(ANCHOR_SQL)), ("universe", s(CONTEXT_SQL))]
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({q})" for n, q in parts)
