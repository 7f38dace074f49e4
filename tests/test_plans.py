"""Shapes of plans: what reaches the scan, what stays in the JVM, where ranks are limited early."""

import re

import pytest

from garimpo.operators import dense, library, search, sparse
from garimpo.plans import tables as T
from garimpo.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
#: Sequential by nature, a matrix product by batches, or a reader that the caller brings.
IN_PYTHON = {"q05_hybrid_search", "q06_dense_topk", "q07_dense_filtered", "q08_rrf_fusion", "q09_multi_collection", "q52_rate_limit", "q62_extracted_elements", "q63_extraction_summary", "q93_access"}


def plan(df):
    return df._jdf.queryExecution().toString()


def test_scan_reads_only_needed_columns(spark):
    text = plan(sparse.lengths(T.chunks(spark, SF)))
    assert re.findall(r"ReadSchema: struct<([^>]*)>", text) == ["doc_id:bigint,text:string"]


def test_filters_reach_the_scan(spark):
    df = search.eligible(T.chunks(spark, SF).select("id", "area", "assuntos"), (), ()).where("area = 'en' and id > 10")
    assert "GreaterThan(doc_id,10)" in plan(df) and "EqualTo(lang,en)" in plan(df)


def test_ranks_are_limited_before_the_shuffle(spark):
    v = T.vectors(spark, SF)
    near = dense.dense_top(v, v.where("id % 50 = 0").withColumnRenamed("id", "query_id"), 10)
    assert "WindowGroupLimit" in plan(near) and "Generate" not in plan(near)
    assert "WindowGroupLimit" in plan(sparse.bm25_top(T.chunks(spark, SF), T.queries(spark, SF), 5))


def test_bm25_splits_chunks_twice_and_shuffles_postings_once(spark):
    executed = plan(sparse.scores(T.chunks(spark, SF), T.queries(spark, SF)))
    physical = executed[executed.index("== Physical Plan =="):]
    assert len(re.findall(r"Exchange hashpartitioning\(id#\d+L", physical)) <= 2  # for the scores, and the same one for the frequencies


def test_small_tables_are_broadcast(spark):
    assert "BroadcastHashJoin" in plan(T.library(spark, SF)) and "CartesianProduct" not in plan(library.facets(T.library(spark, SF)))


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in IN_PYTHON])
def test_stays_in_the_jvm(spark, name):
    assert not re.search(r"MapInArrow|MapInPandas|ArrowEvalPython|BatchEvalPython|CartesianProduct", plan(QUERIES[name](spark, SF)))
