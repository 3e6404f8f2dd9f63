"""The pipeline's stages on a small folder of tables against what each must do to its own input."""

from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline as P
from ontoloom.llm.queries import QUERIES
from tests.llm.test_text_dedup import near, shingles

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet").select(*P.COLUMNS), []
    out.append(docs)
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, SF).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs)
    return out


def test_columns(stages):
    assert all(tuple(d.columns) == P.COLUMNS for d in stages[:-1])
    assert [n for n, _ in P.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "best-fit packing"]


def test_quality_rejects_little(stages, spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = labels.filter("quality = 1")
    kept = stages[1].join(good, "doc_id").count() / stages[0].join(good, "doc_id").count()
    assert kept >= 0.95 and stages[1].count() < stages[0].count()


def test_lines_are_unique(stages):
    seen = set()
    for r in stages[2].orderBy("doc_id").collect():
        assert r["text"] is None or r["text"].strip()
        for line in r["text"].split("\n"):
            x = " ".join(line.lower().split())
            assert not x or x not in seen
            seen.add(x)


def test_one_of_each_group(stages):
    sets = {r["doc_id"]: shingles(r["text"]) for r in stages[2].collect()}
    root = near(sets)
    assert {r["doc_id"] for r in stages[3].collect()} == {i for i, x in root.items() if i == x}


def test_mix_and_packing(stages, spark):
    texts = {r["doc_id"]: r["text"] for r in stages[3].collect()}
    times = {r["doc_id"]: r["count"] for r in stages[4].groupBy("doc_id").count().collect()}
    assert set(times.values()) <= {1, 2} and all(r["text"] == texts[r["doc_id"]] for r in stages[4].collect())
    size = {i: len(t.split()) for i, t in texts.items()}
    assert sum(size[i] * n for i, n in times.items()) == pytest.approx(1.5 * sum(size.values()), rel=0.1)
    pieces = stages[5].filter("piece = 0").groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in pieces} == times
    assert stages[5].agg({"length": "max"}).first()[0] <= 2048


def test_run_equals_stages(stages, spark):
    assert "pipeline" not in QUERIES  # it is registered by the entry module
    key = ["doc_id", "piece", "length", "ids_crc32"]
    assert sorted(map(tuple, P.run(spark, SF).select(*key).collect())) == sorted(map(tuple, stages[5].select(*key).collect()))


def test_awkward_rows(docs, no_docs, rows, spark, tmp_path):
    """Each stage on rows with nulls, empty and very long texts, repeats and clashing columns does what its docstring says."""
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = []
    for n, (_, stage) in enumerate(P.STAGES):
        assert stage(spark, no_docs, str(tmp_path)).count() == 0
        out = stage(spark, docs, str(tmp_path))
        assert n == 4 or tuple(out.columns) == P.COLUMNS
        got.append(out.collect())
    given = {r[0]: r[1] for r in rows if r[0] is not None}
    without_words = {i for i, t in given.items() if not (t or "").split()}
    texts = {}
    for r in rows:
        texts.setdefault(r[1] or "", []).append(r[0])
    kept = [r["text"] for r in got[0]]
    assert all(kept.count(t) + (kept.count(None) if not t else 0) in (0, len(ids)) for t, ids in texts.items())  # copies go together
    after = {r["doc_id"]: r["text"] for r in got[1]}
    assert sum(r["doc_id"] is None for r in got[1]) == sum(r[0] is None for r in rows)
    assert all(after[i] == given[i] for i in without_words)
    assert all(set((t or "").split("\n")) <= set((given[i] or "").split("\n")) for i, t in after.items() if i is not None)
    root = near({i: shingles(t) for i, t in given.items()})
    assert {r["doc_id"] for r in got[2]} - {None} == {i for i, x in root.items() if i == x} | without_words
    times = Counter(r["doc_id"] for r in got[3])
    assert all(times[i] == 1 for i in without_words) and all(times[i] <= 2 for i in given)
    assert Counter(r["doc_id"] for r in got[4] if r["piece"] == 0) == Counter(r[0] for r in rows)
    assert max(r["piece"] for r in got[4]) > 0 and max(r["length"] for r in got[4]) == 2048
