"""Cases in which an operator once did less than the whole job."""

from __future__ import annotations

import numpy as np

import corpus_pipeline as P
from ontoloom.llm import ann, lines
from ontoloom.llm.queries import QUERIES


def test_short_lines(spark, tmp_path):
    texts = ["Share this\nthe first long line of this text", "share  THIS\n\nthe other has quite unlike words", "Share this\n\nshare thin", "Share this"]
    docs = spark.createDataFrame([(i, t, "aa", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    want = {0: texts[0], 1: "\nthe other has quite unlike words", 2: "\nshare thin", 3: ""}
    assert {r["doc_id"]: r["text"] for r in lines.deduplicated(docs).collect()} == want
    assert {r["doc_id"]: r["text"] for r in P.dedup_lines(spark, docs, "").collect()} == {i: t for i, t in want.items() if t}
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"]: r["n_removed"] for r in QUERIES["op3_line_dedup"](spark, str(tmp_path)).collect()} == {0: 0, 1: 1, 2: 1, 3: 1}


def test_copies_of_a_vector_take_no_places(spark):
    x = np.random.default_rng(5).normal(size=(12, 8)) * 0.1 + 1
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.argsort(-(u[0] @ u[1:].T), kind="stable") + 1
    close = rows + [rows[near[0]]] * 6
    twice = rows * 2
    for table in (close, twice):
        df = spark.createDataFrame(table, "vec_id long, embedding array<double>")
        got = ann.neighbours(df.filter("vec_id = 0"), df, k=5).orderBy("rank").collect()
        assert [r["vec_id"] for r in got] == near[:5].tolist()


def test_lines_of_repeated_shingles(spark):
    texts = ["-" * 30, "-" * 80, "sich " * 40, "sich " * 200, "a line that is like none of the others"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in lines.deduplicated(docs).collect()} == {0: 0, 1: 1, 2: 0, 3: 1, 4: 0}


def test_near_rows_of_one_id(spark):
    a, c = "one two three four five six seven eight", "quite another text with other words in it"
    rows = [(1, a), (2, a), (2, c), (3, a), (3, a), (4, c), (5, "x y z"), (5, "x y z"), (6, None), (6, ""), (None, a)]
    docs = spark.createDataFrame([(i, t, "aa", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {(r["doc_id"], r["text"]) for r in P.keep_one_of_near(spark, docs, "").collect()}
    assert got == {(1, a), (2, c), (5, "x y z"), (6, None), (6, ""), (None, a)}
    assert P.keep_one_of_near(spark, docs, "").count() == 6
