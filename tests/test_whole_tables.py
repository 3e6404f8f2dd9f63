"""Queries that must not stop at a part of the ids."""

from __future__ import annotations

import pytest

from ontoloom import queries as core

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("name", "column"), [("facts_block", "id"), ("neighbour_links", "id"), ("tree_up", "root"), ("closure_extent", "seed"), ("merge_retarget", "subject")])
def test_every_kind_of_concept_is_there(spark, name, column):
    kinds = {r[column] // 1_000_000 for r in core.QUERIES[name](spark, SF).select(column).distinct().collect()}
    assert kinds == {0, 1, 2, 3}


def test_facts_of_every_concept(spark):
    from ontoloom.sources.derive import derived

    assert core.QUERIES["facts_block"](spark, SF).count() == derived(spark, SF).concept.count() > 300


@pytest.mark.parametrize("name", ["find_concepts", "related_topk", "connected_concepts", "grounded_prompts"])
def test_questions_of_every_part(spark, name):
    from ontoloom.sources.derive import derived

    parts = derived(spark, SF).concept.filter("id between 1000001 and 1999999").count()
    assert core.QUERIES[name](spark, SF).select("qid").distinct().count() == parts > 60


@pytest.mark.parametrize("name", ["extract_synonyms", "extract_genus"])
def test_every_page_is_read(spark, name):
    pages = {r["page_id"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert {r["page_id"] for r in core.QUERIES[name](spark, SF).collect()} == pages


def test_ancestry_is_asked_both_ways(spark):
    rows = core.QUERIES["qa_messages"](spark, SF).filter("task = 'ancestry'").collect()
    assert {r["answer"] for r in rows} == {"yes", "no"}


@pytest.fixture(scope="module")
def beyond(spark, tmp_path_factory):
    """The smallest tables with every part once more, beyond the first million of keys."""
    folder = tmp_path_factory.mktemp("beyond")
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        df = spark.read.parquet(f"{SF}/{name}.parquet")
        more = df.withColumn("p_partkey", (df["p_partkey"] + 1_000_000).cast(df.schema["p_partkey"].dataType)) if name == "part" else df.limit(0)
        df.union(more).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["connected_concepts", "grounded_prompts"])
def test_questions_of_parts_beyond_a_million(spark, beyond, name):
    parts = 2 * spark.read.parquet(f"{SF}/part.parquet").count()
    asked = {r["qid"] for r in core.QUERIES[name](spark, beyond).select("qid").distinct().collect()}
    assert len(asked) == parts and max(asked) > 1_000_000_000_000


def test_oracles_ask_all_parts():
    for name in ("connected_concepts", "grounded_prompts"):
        assert "BETWEEN 1000000000000 AND 1999999999999" in (core.ORACLE_SQL | core.SMALL_SQL)[name]
