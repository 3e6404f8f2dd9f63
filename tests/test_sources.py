"""Sources and sinks: one statement's snapshot of a database, versions behind one pointer, collections by bytes, ids of any size."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from ontoloom.functions import text
from ontoloom.plans.tables import materialized
from ontoloom.sources import derive, snapshot
from ontoloom.sources.derive import derived
from ontoloom.sources.model import Graph

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_database_snapshot(spark, tmp_path):
    """All lists come from one statement; a database in memory takes the place of a server."""
    url = "jdbc:derby:memory:graph;create=true"
    lists = {
        "concept": spark.createDataFrame([(1, "top", 1, 0), (2, "понятие", 1, None)], "dharma long, nama string, universum_id long, processed long"),
        "concept_term": spark.createDataFrame([(1, "Top", "en")], "concept_id long, term string, lang string"),
        "edge": spark.createDataFrame([(1, 2, "14", 1, 1, None, "ok"), (2, 2, "22", 1, 1, 0, "ok")], "id long, dh1 long, kod string, dh2 long, universum_id long, strength long, status string"),
        "relevant": spark.createDataFrame([("14", "genus", 0), ("61", "coordinate", 1)], "kod string, long_name string, is_symmetric int"),
        "universum": spark.createDataFrame([(1, "everyday")], "id long, nama string"),
    }
    options = {"url": url, "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    for name, df in lists.items():
        types = ", ".join(f"{c} VARCHAR(200)" for c, t in df.dtypes if t == "string")
        df.coalesce(1).write.format("jdbc").options(**options, dbtable=f'"{name}"', createTableColumnTypes=types).save()
    g = snapshot.from_database(spark, options=options, quote='"')
    assert rows(g.concept) == [(1, "top", 1, 0), (2, "понятие", 1, None)] and rows(g.edge) == [(1, 2, "14", 1, 1, None, "ok"), (2, 2, "22", 1, 1, 0, "ok")]
    assert rows(g.rule) == [("14", "genus", False), ("61", "coordinate", True)] and rows(g.term) == [(1, "Top", "en")] and rows(g.context) == [(1, "everyday")]
    assert snapshot.snapshot_query().count("UNION ALL") == 4


@pytest.mark.parametrize("port,fine", [("3307", True), ("0", False), ("65536", False), ("x", False)])
def test_database_options(port, fine):
    if fine:
        assert snapshot.database_options({"DB_PORT": port, "DB_HOST": "h", "DB_NAME": "n"})["url"] == "jdbc:mysql://h:3307/n"
    else:
        with pytest.raises(ValueError):
            snapshot.database_options({"DB_PORT": port})


def test_versions(spark, tmp_path):
    """The pointer moves from one whole version to the next; a stale writer and a damaged version are refused."""
    g = derived(spark, SF)
    folder = f"file://{tmp_path}/graph"
    with pytest.raises(snapshot.SnapshotError):
        snapshot.current_version(spark, folder)
    first = snapshot.commit_version(g, folder)
    assert rows(snapshot.current_version(spark, folder).edge) == rows(g.edge)
    smaller = Graph(spark, g.concept, g.term, materialized(g.edge.limit(5)), g.rule, g.anchor, g.context)
    second = snapshot.commit_version(smaller, folder, expected=first)
    assert snapshot.current_name(spark, folder) == second and snapshot.current_version(spark, folder).edge.count() == 5
    with pytest.raises(snapshot.SnapshotError):
        snapshot.commit_version(g, folder, expected=first)
    g.term.limit(1).write.mode("overwrite").parquet(f"{folder}/versions/{second}/term.parquet")
    with pytest.raises(snapshot.SnapshotError):
        snapshot.current_version(spark, folder)


def test_collected(spark):
    """Of the examples in order those that fit together, not each by itself."""
    df = spark.createDataFrame([(k % 6, "x" * 100) for k in range(12)], "k long, t string")
    each = len('{"k":0,"t":""}') + 101
    assert [r["k"] for r in snapshot.collected(df, ["k"], most_bytes=3 * each).orderBy("k").collect()] == [0, 1, 2]
    assert snapshot.collected(df, ["k"], most=4).count() == 4 and snapshot.collected(df.limit(0), ["k"]).count() == 0


def test_wide_ids(spark):
    """Ids and edge ids of large tables do not meet, and both engines make the same ones."""
    keys = [1, 999_999, 1_000_000, 1_999_999, 2_000_001, 10**9]
    both = [f"SELECT {name}(k) AS id FROM (VALUES {', '.join(f'(CAST({k} AS BIGINT))' for k in keys)}) AS v(k)" for name in ("PART", "CUST", "SUPP")]
    query = " UNION ALL ".join(both)
    got = [r["id"] for r in spark.sql(derive._for("spark", query)).collect()]
    assert len(set(got)) == 18 and sorted(got) == sorted(x for (x,) in duckdb.sql(derive._for("duckdb", query)).fetchall())
    edges = "SELECT EDGE_ID AS id FROM (SELECT CAST(s AS BIGINT) AS subject, '14' AS code, CAST(t AS BIGINT) AS target, CAST(1 AS BIGINT) AS context FROM (VALUES (2000001, 3), (2000000000001, 3), (3, 1000000000007), (2000000000002, 3)) AS v(s, t)) e"
    got = sorted(r["id"] for r in spark.sql(derive._for("spark", edges)).collect())
    assert got == sorted(x for (x,) in duckdb.sql(derive._for("duckdb", edges).replace("AS STRING", "AS VARCHAR")).fetchall()) and len(set(got)) == 4


def test_match_keys_are_narrow(spark):
    """Numbered names share their keys with few others, although they all begin alike."""
    names = spark.range(5000).select(F.format_string("customer#%09d", "id").alias("t"))
    t = names.withColumn("key", F.explode(text.match_keys(F.col("t"), False)))
    w = names.filter("t like '%00'").select(F.concat("t", F.lit("s")).alias("w")).withColumn("key", F.explode(text.match_keys(F.col("w"), True)))
    met = w.join(t, "key").select("w", "t").distinct()
    assert met.count() <= 50 * 25
    near = met.filter(text.near(F.col("w"), F.col("t"))).count()
    assert near == w.select("w").distinct().join(names, text.near(F.col("w"), F.col("t"))).count()


def test_edges_of_small_tables_are_dealt(spark, monkeypatch):
    from ontoloom.sources import derive

    whole = {tuple(r) for r in derive.derived(spark, "/root/testdata/sf0.001").edge.collect()}
    monkeypatch.setattr(derive, "TASK_ROWS", 50)
    monkeypatch.setattr(derive, "_graphs", {})
    g = derive.derived(spark, "/root/testdata/sf0.001")
    files = [len(df.inputFiles()) for df in (g.concept, g.edge.filter("code <> '70'"))]
    assert min(files) > 6 and {tuple(r) for r in g.edge.collect()} == whole
