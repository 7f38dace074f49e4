"""Retrieval quality, calibration and answer metrics over batches of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import tokens
from ..staging import checked_broadcast, staged


def percentile(value: Column | str, p: float) -> Column:
    """Exact percentile with linear interpolation; 0 of nothing."""
    return F.coalesce(F.percentile(value, p), F.lit(0.0))


def calibration(cases: DataFrame) -> DataFrame:
    """One row of dense-score statistics and the suggested threshold of ``cases(expected_hit boolean, dense double)``.

    Queries expected to hit are in scope where they found anything; all others
    are out of scope, with 0 where they found nothing.
    """
    inside = F.when(F.col("expected_hit") & F.col("dense").isNotNull(), F.col("dense"))
    outside = F.when(~F.col("expected_hit"), F.coalesce("dense", F.lit(0.0)))
    a = cases.agg(
        F.count(inside).alias("in_scope"), F.count(outside).alias("out_of_scope"), F.coalesce(F.min(inside), F.lit(0.0)).alias("dense_min"),
        F.coalesce(F.avg(inside), F.lit(0.0)).alias("mean"), F.coalesce(F.max(inside), F.lit(0.0)).alias("dense_max"), F.coalesce(F.max(outside), F.lit(0.0)).alias("out_max"),
    )
    found = percentiles(cases.where(inside.isNotNull()), [], "dense", (0.10, 0.25, 0.5)).select(F.struct("p0", "p1", "p2")).scalar()
    a = a.select("*", *[F.coalesce(found[p], F.lit(0.0)).alias(name) for p, name in (("p0", "p10"), ("p1", "p25"), ("p2", "median"))])
    between = F.when(F.col("out_max") < F.col("p25"), F.greatest("p10", (F.col("out_max") + F.col("p25")) / 2)).otherwise(F.col("p25"))
    return a.withColumn("suggested_percent", F.least(F.lit(100), F.greatest(F.lit(1), F.bround(between * 100).cast("int")))).withColumn("actionable", F.col("dense_max") > 0)


def percentiles(rows: DataFrame, by: list[str], value: str, ps: tuple[float, ...], bins: int = 1024, most: int = 100_000) -> DataFrame:
    """Exact percentiles with linear interpolation of each group: ``by``, ``p0``, ``p1``, ... and ``n``.

    No task ever holds a group's values: rows are counted in ``bins`` of the
    group's range (before they shuffle), and only the bins that hold the ranks
    asked for are looked at more closely, again and again where one holds more
    than ``most`` rows that differ.  Two passes over the rows do for most data,
    a third takes the few values that are left.  Each round's ranges lie
    strictly inside those before, so rounds end.

    Nulls don't count.  Infinite values and NaN (the greatest of all) are ranked
    in bins of their own; between an infinite value and another one the
    interpolation is what arithmetic makes of it.  Null groups are left out.
    """
    v, infinite = F.col("v"), F.lit(float("inf"))
    values = staged(rows.select(*by, F.col(value).cast("double").alias("v")).where(v.isNotNull()), "values")
    finite = F.when(~F.isnan(v) & (F.abs(v) < infinite), v)
    ends = values.groupBy(*by).agg(F.min(finite).alias("lo"), F.max(finite).alias("hi"), F.count("*").alias("n"))
    want = F.explode(F.array_distinct(F.flatten(F.array(*[F.array(*[f((F.col("n") - 1) * p).cast("long") for f in (F.floor, F.ceil)]) for p in ps]))))
    keys = [*by, "rank"]
    asked = staged(ends.select(*by, "lo", "hi", want.alias("rank"), F.lit(0).cast("long").alias("before")), "asked")
    met = lambda table: values.join(checked_broadcast(table), by) if by else values.join(F.broadcast(table))  # noqa: E731  without groups it holds a row for each rank asked for
    inside = F.col("v").between(F.col("lo"), F.col("hi"))
    own = F.when(F.isnan(v), F.lit(bins + 1)).when(v == infinite, F.lit(bins)).when(v == -infinite, F.lit(-1))
    near_enough = inside | own.isNotNull()
    while True:
        # Values of each asked rank's range, with how many lie before it.  Halves, as a range may be longer than the largest number.
        span = F.col("hi") / 2 - F.col("lo") / 2
        bin_ = F.when(span > 0, F.least(F.floor((v / 2 - F.col("lo") / 2) / span * bins), F.lit(bins - 1))).otherwise((v > F.col("lo")).cast("long"))
        near = met(asked).where(near_enough).withColumn("bin", F.coalesce(own.cast("long"), bin_))
        filled = near.groupBy(*keys, "before", "bin").agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        w = W.partitionBy(*keys).orderBy("bin")
        placed = filled.withColumn("upto", F.col("before") + F.sum("c").over(w)).withColumn("first", F.col("upto") - F.col("c"))
        asked = staged(placed.where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("upto"))).select(*keys, "lo", "hi", F.col("first").alias("before"), "c"), "asked")
        if asked.where((F.col("c") > most) & (F.col("lo") < F.col("hi"))).isEmpty():
            break
        near_enough = inside
        asked = asked.drop("c")
    near = met(asked.drop("c")).where(inside).groupBy(*keys, "before", "v").agg(F.count("*").alias("c"))
    w = W.partitionBy(*keys).orderBy("v")
    at = near.withColumn("upto", F.col("before") + F.sum("c").over(w)).where(F.col("rank") < F.col("upto")).groupBy(*keys).agg(F.min("v").alias("v"))
    per = at.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))
    j = ends.join(per, by) if by else ends.join(per)
    value_at = lambda r: F.element_at("at", r.cast("long"))
    out = []
    for i, p in enumerate(ps):
        rank = (F.col("n") - 1) * F.lit(float(p))
        low, high, part = value_at(F.floor(rank)), value_at(F.ceil(rank)), rank - F.floor(rank)
        step = high - low
        between = F.when(F.abs(step) < infinite, low + step * part).otherwise(low * (1 - part) + high * part)
        out.append(F.when((part == 0) | (low == high), low).otherwise(between).alias(f"p{i}"))
    return j.select(*by, *out, "n")


def numeric_means(rows: DataFrame) -> DataFrame:
    """One row: the mean of every numeric column."""
    names = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.NumericType)]
    return rows.agg(*[F.avg(F.col(f"`{n}`").cast("double")).alias(n) for n in names])


def either_contains(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def quality_cases(specs: DataFrame, top_hits: DataFrame, threshold: float = 0.18) -> DataFrame:
    """``specs(query_id, expected_area, expected_documents)`` judged by ``top_hits(query_id, area, documento, documents, dense)``.

    A case passes if the best hit has the expected area and one of the documents
    is one of the expected (either contains the other; no expectation passes).
    A case that expects nothing passes if nothing near enough was found.
    """
    j = specs.join(top_hits, "query_id", "left")
    nothing = F.col("expected_area") == "nenhuma"
    area_ok = F.coalesce(F.lower("area") == F.lower("expected_area"), F.lit(False))
    wanted, got = F.coalesce("expected_documents", F.array().cast("array<string>")), F.coalesce("documents", F.array().cast("array<string>"))
    doc_ok = (F.size(wanted) == 0) | F.exists(wanted, lambda e: F.exists(got, lambda r: either_contains(F.lower(r), F.lower(e))))
    passed = F.when(nothing, F.coalesce("dense", F.lit(0.0)) < threshold).otherwise(area_ok & doc_ok)
    return j.select("query_id", area_ok.alias("area_ok"), doc_ok.alias("doc_ok"), passed.alias("passed"))


def quality_summary(cases: DataFrame) -> DataFrame:
    ok = F.count(F.when(F.col("passed"), 1))
    return cases.agg(F.count("*").alias("cases"), ok.alias("passed"), (F.count("*") - ok).alias("failed"), F.round(F.coalesce(F.avg(F.col("passed").cast("double")), F.lit(0.0)), 4).alias("pass_rate"))


def context_recall(terms: Column, context: Column) -> Column:
    """Share of the expected terms in the lower-cased context; 1 without terms."""
    low = F.lower(F.coalesce(context, F.lit("")))
    return F.when(F.size(terms) > 0, F.size(F.filter(terms, lambda t: F.contains(low, F.lower(t)))) / F.size(terms)).otherwise(1.0)


def token_overlap(of: Column, within: Column) -> Column:
    """Share of the distinct tokens of one text that are in the other; 0 if either has none."""
    a, b = F.array_distinct(tokens(of)), tokens(within)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(0.0)


def faithfulness(answer: Column, context: Column) -> Column:
    return token_overlap(answer, context)


def answer_relevancy(question: Column, answer: Column) -> Column:
    return token_overlap(question, answer)


def solution_match(expected: Column, solution_ids: Column, documents: Column) -> Column:
    """1 if nothing is expected, an expected id was returned, or a document's name contains one."""
    none = F.array().cast("array<string>")
    e = F.coalesce(expected, none)
    hit = F.arrays_overlap(e, F.coalesce(solution_ids, none)) | F.exists(e, lambda x: F.exists(F.coalesce(documents, none), lambda d: F.contains(d, x)))
    return F.when(F.size(e) == 0, 1.0).otherwise(F.coalesce(hit, F.lit(False)).cast("double"))


def benchmark_means(rows: DataFrame, metrics=("context_recall", "faithfulness", "answer_relevancy", "solution_match")) -> DataFrame:
    return rows.agg(F.count("*").alias("rows"), *[F.round(F.coalesce(F.avg(m), F.lit(0.0)), 4).alias(m) for m in metrics])
