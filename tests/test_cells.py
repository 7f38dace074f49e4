"""The stored vector collection against the exhaustive search, and the cells that it leaves out."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from garimpo.operators import cells, dense
from garimpo.staging import staged_path


def clustered(seed, n=900, dims=12, groups=30):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    rows = [(i, (centres[i % groups] + 0.05 * rng.normal(size=dims)).tolist()) for i in range(n)]
    rows += [(n, None), (n + 1, [0.0] * dims), (n + 2, rows[3][1]), (n + 3, [2 * x for x in rows[3][1]])]
    return rows


def frames(spark, rows, seed=5):
    rng = random.Random(seed)
    some = rng.sample([r for r in rows if r[1]], 25)
    queries = [(1000 + i, v) for i, (_, v) in enumerate(some)] + [(2000, None), (2001, [0.0] * 12), (2002, [1.0, 2.0]), (2003, [1.0] * 12)]
    return spark.createDataFrame(rows, "id long, vector array<double>").repartition(4), spark.createDataFrame(queries, "query_id long, vector array<double>")


def ranks(df):
    return sorted((r.query_id, r.dense_rank, r.id, round(r.dense_score, 8)) for r in df.collect())


@pytest.mark.parametrize("k,first,most,sample,block", [(10, 2, 1024, 20_000, 2000), (1, 1, 40, 50, 7), (400, 1, 3, 100, 2000)])
def test_equals_the_exhaustive_search(spark, k, first, most, sample, block):
    rows = clustered(k) + [(5000 + i, [float(i), 1.0]) for i in range(40)]  # and vectors of another length
    vectors, queries = frames(spark, rows)
    held = cells.build(vectors, staged_path(spark, "cells"), sample, most)
    assert ranks(cells.search(held, queries, k, first=first, block=block).hits) == ranks(dense.dense_top(vectors, queries, k))
    allowed = vectors.where("id % 7 = 0")
    assert ranks(cells.search(held, queries, k, allowed, first, block).hits) == ranks(dense.dense_top(vectors, queries, k, allowed))


def test_cells_hold_everything_and_most_are_left_out(spark):
    vectors, queries = frames(spark, clustered(2))
    path = staged_path(spark, "cells")
    cells.build(vectors, path)
    held = cells.open_collection(spark, path)  # by another reader
    assert held.vectors.count() == held.cells.agg(F.sum("n")).first()[0] == 902
    inside = held.vectors.join(held.cells, "cell").select(F.acos(F.least(F.lit(1.0), F.aggregate(F.zip_with("v", "centroid", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x))).alias("angle"), "radius")
    assert inside.where("angle > radius + 1e-6").isEmpty()
    found = cells.search(held, queries, 5, first=1)
    read = found.read.where("query_id < 2000").collect()
    assert sum(r.first + r.later for r in read) < 0.3 * sum(r.cells for r in read)
    assert ranks(found.hits) == ranks(dense.dense_top(vectors, queries, 5))


def test_tiny_skewed_and_empty_collections(spark):
    one = spark.createDataFrame([("a", [1.0, 0.0])], "id string, vector array<double>")
    queries = spark.createDataFrame([(1, [1.0, 1.0])], "query_id long, vector array<double>")
    held = cells.build(one, staged_path(spark, "cells"))
    assert [(r.id, round(r.dense_score, 6)) for r in cells.search(held, queries, 3).hits.collect()] == [("a", 0.707107)]
    same = spark.range(2000).select("id", F.when(F.col("id") % 3 > 0, F.array(F.lit(1.0), F.lit(0.5))).otherwise(F.array(F.cos("id"), F.sin("id"))).alias("vector"))
    held = cells.build(same, staged_path(spark, "cells"))
    assert held.cells.agg(F.max("n")).first()[0] >= 1333
    assert ranks(cells.search(held, queries, 20).hits) == ranks(dense.dense_top(same, queries, 20))
    empty = cells.build(one.limit(0), staged_path(spark, "cells"))
    assert cells.search(empty, queries, 3).hits.collect() == []
    assert cells.search(held, queries.limit(0), 3).hits.collect() == []
