"""Which names are contained in which others, as a join of two tables.

A name that is contained in another one has all its q-grams there.  Each needle
is looked up by one of them, the one that the fewest haystacks hold; only what
that finds is verified.  Names are taken once each, however often they occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import staged

#: Characters of a gram; shorter needles are looked up as a whole.
GRAM = 3


def _grams(text: Column, n: int | Column) -> Column:
    """Distinct runs of ``n`` characters of a text."""
    spots = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(spots, lambda i: F.substring(text, i, F.lit(n) if isinstance(n, int) else n)))


def contained(needles: DataFrame, haystacks: DataFrame, by: list[str] | None = None, gram: int = GRAM) -> DataFrame:
    """Distinct ``(by..., needle, haystack)`` where the lower-cased needle is in the lower-cased haystack.

    ``needles(by..., needle)``, ``haystacks(by..., haystack)``; with ``by`` only
    names of one group meet.  Null and empty names, and null groups, match nothing.
    """
    by = by or []
    low = lambda t, c: t.select(*by, c).where(F.col(c) != "").dropna().distinct().withColumn("low", F.lower(c))
    n = staged(low(needles, "needle"), "needles")
    h = staged(low(haystacks, "haystack").withColumn("key", F.monotonically_increasing_id()), "haystacks")
    sizes = sorted(r.size for r in n.select(F.least(F.length("low"), F.lit(gram)).alias("size")).distinct().collect())  # at most ``gram`` numbers
    if not sizes:
        return n.select(*by, "needle").withColumn("haystack", F.lit(None).cast("string"))  # no needle, no row
    every = F.concat(*[_grams(F.col("low"), k) for k in sizes])
    held = staged(h.select(*by, "key", F.explode(every).alias("gram")), "grams")
    counts = held.groupBy(*by, "gram").agg(F.count("*").alias("n"))
    own = n.select(*by, "needle", F.explode(_grams(F.col("low"), F.least(F.length("low"), F.lit(gram)))).alias("gram"))
    # A needle with a gram that no haystack has is in none; of the others the rarest gram is looked up.
    seen = own.join(counts, [*by, "gram"], "left")
    rarest = seen.groupBy(*by, "needle").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.bool_and(F.col("n").isNotNull()).alias("whole")).where("whole").drop("whole")
    near = rarest.join(held, [*by, "gram"]).select("key", "needle")
    return near.join(h, "key").where(F.contains(F.col("low"), F.lower("needle"))).select(*by, "needle", "haystack")


def either_contains(left: DataFrame, right: DataFrame, by: list[str] | None = None, gram: int = GRAM) -> DataFrame:
    """Distinct ``(by..., left, right)`` of ``left(by..., left)`` and ``right(by..., right)`` where either name contains the other."""
    by = by or []
    one = contained(left.withColumnRenamed("left", "needle"), right.withColumnRenamed("right", "haystack"), by, gram)
    two = contained(right.withColumnRenamed("right", "needle"), left.withColumnRenamed("left", "haystack"), by, gram)
    pairs = one.select(*by, F.col("needle").alias("left"), F.col("haystack").alias("right")).unionByName(two.select(*by, F.col("haystack").alias("left"), F.col("needle").alias("right")))
    return pairs.distinct()


def documents_ok(expected: DataFrame, returned: DataFrame) -> DataFrame:
    """(query_id, doc_ok): whether one of ``returned(query_id, documento)`` matches one of ``expected(query_id, documento)``.

    Queries are those that expect something; either name may contain the other.
    """
    pairs = either_contains(expected.select("query_id", F.col("documento").alias("left")), returned.select("query_id", F.col("documento").alias("right")), ["query_id"])
    hit = pairs.select("query_id").distinct().withColumn("hit", F.lit(True))
    return expected.select("query_id").distinct().join(hit, "query_id", "left").select("query_id", F.coalesce("hit", F.lit(False)).alias("doc_ok"))


def solutions_ok(expected: DataFrame, returned: DataFrame) -> DataFrame:
    """(query_id, solution_ok): whether an id of ``expected(query_id, id)`` is among ``returned(query_id, id, documento)``, or in a document's name.

    Ids and names are compared as they are, upper and lower case apart.
    """
    same = expected.join(returned.select("query_id", "id"), ["query_id", "id"], "left_semi").select("query_id")
    named = contained(expected.select("query_id", F.col("id").alias("needle")), returned.select("query_id", F.col("documento").alias("haystack")), ["query_id"])
    hit = same.unionByName(named.where(F.contains("haystack", F.col("needle"))).select("query_id")).distinct().withColumn("hit", F.lit(True))
    return expected.select("query_id").distinct().join(hit, "query_id", "left").select("query_id", F.coalesce("hit", F.lit(False)).alias("solution_ok"))
