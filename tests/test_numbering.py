"""Gapless numbers and staged tables."""

from pyspark.sql import functions as F

from garimpo import staging
from garimpo.operators.numbering import numbered, ranked


def test_numbers_follow_the_order(spark):
    rows = spark.range(5000).select(F.pmod(F.xxhash64("id"), F.lit(700)).alias("k"), "id").repartition(7)
    got = numbered(rows, F.desc("k"), F.col("id"), column="n", first=3).orderBy("n").collect()
    assert [r.n for r in got] == list(range(3, 5003))
    assert [(r.k, r.id) for r in got] == sorted([(r.k, r.id) for r in rows.collect()], key=lambda x: (-x[0], x[1]))


def test_without_an_order_nothing_shuffles(spark):
    rows = spark.range(0, 1000, 1, 9).where("id % 3 = 0").withColumn("id", F.col("id") * 10)
    got = numbered(rows, column="n")
    assert "Exchange hashpartitioning(_part" not in got._jdf.queryExecution().toString()
    assert [tuple(r) for r in got.orderBy("n").collect()] == [(30 * i, i) for i in range(334)]


def test_nulls_ties_and_empty_tables(spark):
    rows = spark.createDataFrame([("b", 1), (None, 1), ("a", 1), ("b", 1), ("", 1)], "k string, id long").repartition(3)
    got = numbered(rows, F.asc_nulls_last("k")).orderBy("id").collect()
    assert [(r.k, r.id) for r in got] == [("", 0), ("a", 1), ("b", 2), ("b", 3), (None, 4)]
    assert numbered(rows.limit(0), F.col("k")).collect() == []


def test_staged_tables_are_cleared(spark):
    before = staging.staged(spark.range(3), "test")
    assert before.count() == 3 and staging.clear(spark) >= 1 and staging.clear(spark) == 0


def test_ranks_within_groups_of_any_size(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 10 < 7, "big").when(F.col("id") % 10 == 7, F.col("id").cast("string")).alias("g"), F.pmod(F.xxhash64("id"), F.lit(500)).alias("v"), "id").repartition(5)
    got = ranked(rows, ["g"], F.desc("v"), F.col("id"))
    groups = {}
    for r in rows.collect():
        groups.setdefault(r.g, []).append((-r.v, r.id))
    want = {(g, i): n for g, found in groups.items() for n, (_, i) in enumerate(sorted(found), 1)}
    assert {(r.g, r.id): r["rank"] for r in got.collect()} == want
