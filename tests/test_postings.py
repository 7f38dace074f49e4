"""The stored inverted index against the exhaustive search, and what it skips."""

import random

import pytest
from pyspark.sql import functions as F

from garimpo.operators import postings, sparse
from garimpo.staging import staged_path


def corpus(seed, n=600):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(150)]
    pick = lambda: words[min(149, int(rng.paretovariate(0.6)))]
    rows = [(i, " ".join(pick() for _ in range(rng.choice((0, 3, 9, 30, 120))))) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, "w3 " * 500), (n + 3, "rare w1"), (n + 4, rows[5][1]), (n + 5, rows[5][1])]
    queries = [(i, " ".join(pick() for _ in range(rng.choice((1, 2, 6))))) for i in range(20)] + [(30, "rare w1 w1 w2"), (31, "unknown words"), (32, None), (33, "w1 w1 w1")]
    return rows, queries


def ranks(df):
    return sorted((r.query_id, r.sparse_rank, r.id, round(r.sparse_score, 8)) for r in df.collect())


@pytest.fixture(scope="module")
def tables(spark):
    rows, queries = corpus(1)
    return spark.createDataFrame(rows, "id long, texto string").repartition(4), spark.createDataFrame(queries, "query_id long, query string")


@pytest.mark.parametrize("slice_rows,parts,first,k", [(4096, 64, 2, 5), (20, 4, 1, 3), (7, 1, 3, 40)])
def test_equals_the_exhaustive_search(spark, tables, slice_rows, parts, first, k):
    chunks, queries = tables
    index = postings.build(chunks, staged_path(spark, "index"), slice_rows=slice_rows, parts=parts)
    assert ranks(postings.search(index, queries, k, first=first).hits) == ranks(sparse.bm25_top(chunks, queries, k))
    allowed = chunks.where("id % 3 = 0")
    assert ranks(postings.search(index, queries, k, allowed, first).hits) == ranks(sparse.bm25_top(chunks, queries, k, allowed=allowed))


def test_blocks_are_bounded_and_skipped(spark, tables):
    chunks, queries = tables
    path = staged_path(spark, "index")
    index = postings.build(chunks, path, slice_rows=16, parts=8)
    assert index.blocks.agg(F.max("n")).first()[0] <= 40
    total = {r.token: r.df for r in sparse.document_frequency(chunks).collect()}
    assert {r.token: r.df for r in index.frequency.collect()} == total
    again = postings.open_index(spark, path)  # by another reader
    found = postings.search(again, queries, 1, first=1)
    read = {r.query_id: r for r in found.read.collect()}
    assert ranks(found.hits) == ranks(sparse.bm25_top(chunks, queries, 1))
    assert all(r.first + r.later <= r.blocks for r in read.values())
    assert sum(r.first + r.later for r in read.values()) < 0.5 * sum(r.blocks for r in read.values())
    assert set(read) == {r.query_id for r in found.hits.collect()}


def test_other_parameters_null_ids_and_empty_tables(spark):
    chunks = spark.createDataFrame([("a", "x y"), ("b", "x x z"), ("c", "y")], "id string, texto string").selectExpr("id", "concat(texto, ' ', texto, ' pad', id) as texto")
    queries = spark.createDataFrame([(1, "pada padb")], "query_id long, query string")
    index = postings.build(chunks, staged_path(spark, "index"), k1=0.9, b=0.4)
    assert ranks(postings.search(index, queries, 2).hits) == ranks(sparse.bm25_top(chunks, queries, 2, k1=0.9, b=0.4))
    empty = postings.build(chunks.limit(0), staged_path(spark, "index"))
    assert postings.search(empty, queries, 2).hits.collect() == []
    assert postings.search(index, queries.limit(0), 2).hits.collect() == []
