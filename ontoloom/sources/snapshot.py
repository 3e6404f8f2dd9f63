"""Snapshots: JSON and Parquet sources, JDBC, validation, and JSON lines sinks."""

from __future__ import annotations

import os
import uuid
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ontoloom.operators.batch import fingerprint
from ontoloom.plans.tables import materialized
from ontoloom.sources.model import ANCHOR, CONCEPT, CONTEXT, EDGE, RULE, TERM, Graph


class SnapshotError(ValueError):
    """A snapshot that breaks the model's rules; the faults are listed."""


#: Names of a snapshot's lists and columns (fixed values of the format) and their places in the model.
LISTS = {
    "concept": (CONCEPT, {"dharma": "id", "nama": "name", "universum_id": "context", "processed": "processed"}),
    "concept_term": (TERM, {"concept_id": "concept_id", "term": "term", "lang": "lang"}),
    "edge": (EDGE, {"id": "id", "dh1": "subject", "kod": "code", "dh2": "target", "universum_id": "context", "strength": "strength", "status": "status"}),
    "relevant": (RULE, {"kod": "code", "long_name": "name", "is_symmetric": "mutual"}),
    "universum": (CONTEXT, {"id": "id", "nama": "name"}),
}


def _rows(schema: T.StructType, names: dict[str, str]) -> T.ArrayType:
    kinds = {f.name: f.dataType for f in schema}
    return T.ArrayType(T.StructType([T.StructField(old, T.StringType() if isinstance(kinds[new], T.BooleanType) else kinds[new]) for old, new in names.items()]))


def from_json(spark: SparkSession, path: str) -> Graph:
    """One JSON object with five lists of rows (a byte order mark is tolerated)."""
    schema = T.StructType([T.StructField(name, _rows(s, names)) for name, (s, names) in LISTS.items()])
    one = spark.read.text(path, wholetext=True).select(F.from_json(F.regexp_replace("value", "^\\x{FEFF}", ""), schema).alias("s")).select("s.*")
    return _graph(spark, {name: one.select(F.explode_outer(name).alias("r")).filter("r is not null").select("r.*") for name in LISTS})


def from_parquet(spark: SparkSession, folder: str) -> Graph:
    """The five lists as Parquet tables of a folder."""
    return _graph(spark, {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in LISTS})


def from_database(spark: SparkSession, environ: Mapping[str, str] = os.environ, options: Mapping[str, str] | None = None, quote: str = "`") -> Graph:
    """The five lists as tables of a database, read by JDBC as one snapshot.

    Reads in several connections, or one after another, can see different states. So all lists are read by one statement, which every
    database answers from one state: a union of the lists, each with columns of its own. It is one task's read, as one connection is, and
    is written at once; a graph too large for that is kept as files (``from_parquet``). options: JDBC options instead of those of the
    environment; quote: the database's quotation mark for names."""
    options = dict(options or database_options(environ))
    rows = spark.read.format("jdbc").options(**options, query=snapshot_query(quote), numPartitions="1").load()
    rows = materialized(rows.toDF("of", *(f"{name}_{old}" for name, (_, names) in LISTS.items() for old in names)))
    return _graph(spark, {name: rows.filter(F.trim("of") == name).select(*[F.col(f"{name}_{old}").alias(old) for old in names]) for name, (_, names) in LISTS.items()})


def snapshot_query(quote: str = "`") -> str:
    """One statement for all lists: the list's name, then the columns of all lists, null but for its own."""
    number, text = ("SIGNED", "CHAR") if quote == "`" else ("BIGINT", "VARCHAR(2000)")
    columns = [(name, old, text if schema[new].dataType == T.StringType() else number) for name, (schema, names) in LISTS.items() for old, new in names.items()]
    q = lambda x: f"{quote}{x}{quote}"
    one = lambda name: f"SELECT CAST('{name}' AS {text}) AS c0, " + ", ".join(f"{q(old) if of == name else f'CAST(NULL AS {kind})'} AS c{i}" for i, (of, old, kind) in enumerate(columns, 1)) + f" FROM {q(name)}"
    return " UNION ALL ".join(map(one, LISTS))


def database_options(environ: Mapping[str, str]) -> dict[str, str]:
    """JDBC options from DB_HOST, DB_PORT, DB_NAME, DB_USER and DB_PASSWORD."""
    port = environ.get("DB_PORT", "3306")
    if not port.isdigit() or not 1 <= int(port) <= 65535:
        raise ValueError("DB_PORT is from 1 to 65535")
    return {"url": f"jdbc:mysql://{environ.get('DB_HOST', 'localhost')}:{port}/{environ.get('DB_NAME', 'graph')}", "user": environ.get("DB_USER", "reader"), "password": environ.get("DB_PASSWORD", "")}


def _graph(spark: SparkSession, lists: dict[str, DataFrame]) -> Graph:
    t = {}
    for name, (schema, names) in LISTS.items():
        df = lists[name]
        kind = {f.name: f.dataType for f in schema}
        t[name] = materialized(df.select(*[_cast(F.col(old) if old in df.columns else F.lit(None), kind[new]).alias(new) for old, new in names.items()]))
    return Graph(spark, t["concept"], t["concept_term"], t["edge"], t["relevant"], spark.createDataFrame([], ANCHOR), t["universum"])


def _cast(c, kind: T.DataType):
    return F.coalesce(c.cast("string").isin("1", "true"), F.lit(False)) if isinstance(kind, T.BooleanType) else c.cast(kind)


def faults(g: Graph, context: int) -> DataFrame:
    """(fault, rows): broken rules; of edges only the accepted ones of the context are judged."""
    e, ids = g.scope(context, positive=False), g.concept.select("id")
    twice = lambda df, *key: df.groupBy(*key).count().filter("count > 1")
    found = {
        "concept id": g.concept.filter("id is null or id <= 0"),
        "concept id twice": twice(g.concept, "id"),
        "concept name": g.concept.filter("name is null"),
        "home context": g.concept.join(g.context.select(F.col("id").alias("context")), "context", "left_anti"),
        "term without concept": g.term.join(ids.toDF("concept_id"), "concept_id", "left_anti"),
        "code twice": twice(g.rule, "code"),
        "edge id twice": twice(e, "id"),
        "edge twice": twice(e, "subject", "code", "target"),
        "dangling subject": e.join(ids.toDF("subject"), "subject", "left_anti"),
        "dangling target": e.join(ids.toDF("target"), "target", "left_anti"),
        "unknown code": e.join(g.rule.select("code"), "code", "left_anti"),
        "strength": e.filter("strength < 0 or strength > 100"),
    }
    out = None
    for name, df in found.items():
        n = df.agg(F.lit(name).alias("fault"), F.count("*").alias("rows"))
        out = n if out is None else out.union(n)
    return out.filter("rows > 0")


def checked(g: Graph, context: int) -> Graph:
    """The graph, if it keeps the rules in a context that it has."""
    if not g.context.filter(F.col("id") == context).take(1):
        raise SnapshotError(f"context {context} is not there")
    found = [(r["fault"], r["rows"]) for r in faults(g, context).collect()]
    if found:
        raise SnapshotError("; ".join(f"{f}: {n}" for f, n in sorted(found)))
    return g


def write_json_lines(df: DataFrame, path: str) -> None:
    """A folder of JSON lines; nothing that is there is overwritten."""
    df.write.mode("errorifexists").json(path)


def write_records(records: DataFrame, path: str, messages_path: str) -> None:
    """Annotated records and, elsewhere, their messages alone."""
    if os.path.normpath(path) == os.path.normpath(messages_path):
        raise ValueError("records and messages need two paths")
    records = materialized(records)
    write_json_lines(records, path)
    write_json_lines(records.select("messages"), messages_path)


def write_frequencies(words: DataFrame, path: str) -> None:
    """words (lemma, pos, n) as tab-separated files by part of speech."""
    words.write.mode("errorifexists").partitionBy("pos").csv(path, sep="\t")


def write_version(g: Graph, folder: str) -> None:
    """All tables of a graph as one new version, with the digests of its tables."""
    for name in VERSIONED:
        getattr(g, name).write.mode("errorifexists").parquet(f"{folder}/{name}.parquet")
    _digests(g).write.mode("errorifexists").parquet(f"{folder}/digest.parquet")


VERSIONED = ("concept", "term", "edge", "rule", "anchor", "context")


def _digests(g: Graph) -> DataFrame:
    """(table, rows, digest) of every table."""
    return reduce(DataFrame.union, [fingerprint(getattr(g, name)).select(F.lit(name).alias("table"), "rows", "digest") for name in VERSIONED])


def commit_version(g: Graph, folder: str, expected: str | None = None) -> str:
    """Write a graph as a new version below folder and make it the current one, whose name is returned. The tables of a version are never
    written again; what is current is one small file, which a rename replaces as a whole, so a reader sees the old version or the new one
    and a job that fails on its way leaves the old one. expected: refuse if another version than this is current by now."""
    spark, name = g.spark, uuid.uuid4().hex
    if expected is not None and current_name(spark, folder) != expected:
        raise SnapshotError("another version is current")
    write_version(g, f"{folder}/versions/{name}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = lambda x: jvm.org.apache.hadoop.fs.Path(f"{folder}/{x}")
    new = path(f"CURRENT-{name}")
    out = new.getFileSystem(conf).create(new, False)
    try:
        out.write(bytearray(name.encode()))
    finally:
        out.close()
    options = jvm.org.apache.hadoop.fs.Options.Rename
    overwrite = spark.sparkContext._gateway.new_array(options, 1)
    overwrite[0] = options.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), conf).rename(new, path("CURRENT"), overwrite)
    return name


def current_name(spark: SparkSession, folder: str) -> str | None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/CURRENT")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.text(str(at.toString()), wholetext=True).first()[0]


def current_version(spark: SparkSession, folder: str) -> Graph:
    """The graph of the current version, if its tables have the digests that were written with them."""
    name = current_name(spark, folder)
    if name is None:
        raise SnapshotError("no version is current")
    at = f"{folder}/versions/{name}"
    g = Graph(spark, *(spark.read.parquet(f"{at}/{t}.parquet") for t in VERSIONED))
    if _digests(g).exceptAll(spark.read.parquet(f"{at}/digest.parquet").select("table", "rows", "digest")).take(1):
        raise SnapshotError(f"version {name} is damaged")
    return g


def collected(examples: DataFrame, identity: list[str], most: int = 50, most_bytes: int = 4 << 20) -> DataFrame:
    """Saved examples: one of each identity, in the order of identities at most so many, and of these the first that fit into so many bytes of
    JSON lines together."""
    size = F.octet_length(F.to_json(F.struct(*examples.columns))) + 1
    first = examples.dropDuplicates(identity).orderBy(*identity).limit(most)  # at most fifty rows
    total = F.sum(size).over(Window.orderBy(*identity).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return first.withColumn("total_", total).filter(F.col("total_") <= most_bytes).drop("total_")
