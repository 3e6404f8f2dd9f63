"""The corpus pipeline: five stages from raw documents to packed training sequences.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ontoloom.llm import jaccard, lines, mixing, packing, quality
from ontoloom.llm.queries import tokenizer_path
from ontoloom.llm.shared import Tables, held_out

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from the labels of sf_dir that are not held out.

    Every row is scored by its whole text, however long; a null or empty text is scored as an empty one. Rows that repeat an id or a text
    are scored each and get one score, so they stay or go together. A null doc_id has no label and is scored like others. Scores of
    exactly the bound stay. Without documents no rows; columns beyond those of documents are dropped, whatever their names."""
    docs, labels = docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out("doc_id", 5, 0))
    return quality.scored(docs, quality.fit(docs, labels)).filter("predicted = 1").select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier one; a document of which no text is left goes.

    Null and empty texts, and those without any line to remove, stay as they are with their n_chars; others get the length of what is
    left. Earlier is the smaller doc_id, then the earlier line; rows that repeat doc_id and text are one document and keep the same
    lines. Lines of a null doc_id stay and remove nothing. Texts and lines of any length are taken whole. Without documents no rows;
    further columns are dropped."""
    out = lines.deduplicated(docs, keep=("lang", "source", "n_chars")).filter((F.col("n_removed") == 0) | F.col("text").rlike("\\S"))
    return out.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near documents the one with the smallest doc_id; documents without words (null and empty texts among them) or
    without id stay. Of rows that repeat a doc_id each is a document; among those of one group the one with the least set, then text,
    source, lang and n_chars, stays. Whole texts of any length are compared. Without documents no rows; further columns are dropped."""
    tables = Tables(spark)
    docs = docs.select(*COLUMNS)
    found = tables.write(jaccard.joined(docs, with_sets=True).filter("root is not null").select("doc_id", "key", "root"))
    firsts = found.groupBy("root").agg(F.min(F.struct("doc_id", "key")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    gone = tables.write(found.join(firsts, "root").filter(F.struct("doc_id", "key") != F.col("first")).select("doc_id", "key").distinct())
    again = tables.write(docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    once = docs.join(again, "doc_id", "left_anti").join(gone.select("doc_id").distinct(), "doc_id", "left_anti").select(*COLUMNS)
    rows = jaccard.keyed(docs.join(again, "doc_id", "left_semi").select(*COLUMNS))
    rest = rows.filter("key is not null").join(gone, ["doc_id", "key"], "left_anti")
    k = F.row_number().over(Window.partitionBy("doc_id", "key").orderBy("text", "source", "lang", "n_chars"))
    rest = rest.withColumn("k", k).filter("k = 1").select(*COLUMNS)
    return once.union(rest).union(rows.filter("key is null").select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document as often as it is taken, documents that are not taken go. Documents of size 0 (null, empty and blank texts) stay
    once. Rows that repeat a doc_id in a source are taken as often as the one of them that is taken most. A null source is a source, and a
    null doc_id an id; among documents of one size a hash of the row chooses. Texts of any length are taken whole. Without documents no
    rows; further columns are dropped."""
    mix = mixing.mixed(docs).select("doc_id", "source", F.when(F.col("size") == 0, 1).otherwise(F.expr("taken div size")).cast("int").alias("times")).filter("times > 0")
    mix = Tables(spark).write(mix.groupBy(F.col("doc_id").alias("id"), F.col("source").alias("s")).agg(F.max("times").alias("times")))
    both = docs.select(*COLUMNS).join(mix, F.col("doc_id").eqNullSafe(F.col("id")) & F.col("source").eqNullSafe(F.col("s")))
    return both.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in sequences of 2048 tokens: one row for each piece of a document. Repeated rows, and those with a null doc_id, are packed each;
    a null or empty text is its end mark alone; ties of length are ordered by a hash; longer texts are cut into pieces, none is cut
    short. Without documents no rows; other columns than doc_id and text are not read."""
    return packing.packed(docs, tokenizer_path(), capacity=2048, end_id=0)


STAGES = [("quality classifier", keep_quality), ("line dedup", dedup_lines), ("n-gram Jaccard join", keep_one_of_near), ("mixing sources to target weights", mix_sources), ("best-fit packing", pack)]

#: SQL can express neither the classifier nor MinHash; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents one after another, each written to the shared folder and read again."""
    tables = Tables(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        last = docs
        docs = tables.write(stage(spark, last, sf_dir))
        tables.drop(last)
    return STAGES[-1][1](spark, docs, sf_dir)
