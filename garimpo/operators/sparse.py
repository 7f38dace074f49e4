"""BM25 over tokens, with statistics of the whole collection.

Filters restrict which chunks are scored, never the statistics.  A query's
repeated tokens count as often as they occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import tokens


def postings(chunks: DataFrame, id: str = "id", text: str = "texto") -> DataFrame:
    """(id, token, tf)"""
    return chunks.select(F.col(id).alias("id"), F.explode(tokens(text)).alias("token")).groupBy("id", "token").agg(F.count("*").alias("tf"))


def lengths(chunks: DataFrame, id: str = "id", text: str = "texto") -> DataFrame:
    """(id, dl, distinct_tokens); chunks without tokens have length 0 and count."""
    t = tokens(text)
    return chunks.select(F.col(id).alias("id"), F.size(t).cast("long").alias("dl"), F.size(F.array_distinct(t)).cast("long").alias("distinct_tokens"))


def document_frequency(chunks: DataFrame, text: str = "texto") -> DataFrame:
    """(token, df): each chunk counts a token once; counts are added up before they shuffle."""
    return chunks.select(F.explode(F.array_distinct(tokens(text))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def query_terms(queries: DataFrame, id: str = "query_id", text: str = "query") -> DataFrame:
    """(query_id, token, qtf)"""
    return queries.select(F.col(id).alias("query_id"), F.explode(tokens(text)).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qtf"))


#: Query tokens up to which their table is broadcast (a token and a few numbers each); beyond, the joins shuffle.
BROADCAST_TERMS = 1_000_000


def scores(chunks: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, id, sparse_score) of all pairs that share a token.

    ``chunks(id, texto)``, ``queries(query_id, query)``; ``allowed(id)`` names
    the chunks to score.  Chunks are split into tokens twice: for the
    collection's size and average length, and for the postings of the queries'
    tokens, which carry their chunk's length and shuffle once, by chunk; all
    that follows is joined and summed where they lie.
    """
    terms = query_terms(queries)
    held = F.broadcast if terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else (lambda t: t)
    split = chunks.select("id", tokens("texto").alias("t"))
    size = F.size("t").cast("long")
    totals = split.agg(F.struct(F.count("*").alias("n"), F.coalesce(F.avg(size), F.lit(0.0)).alias("average")).alias("s")).scalar()
    n, average = totals["n"], totals["average"]
    each = split.select("id", size.alias("dl"), F.explode("t").alias("token")).join(held(terms.select("token").distinct()), "token", "left_semi")
    posted = each.repartition("id").groupBy("id", "dl", "token").agg(F.count("*").alias("tf"))
    idf = posted.groupBy("token").agg(F.count("*").alias("df")).select("token", F.ln((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))
    if allowed is not None:
        posted = posted.join(allowed.select("id"), "id", "left_semi")
    gain = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.greatest(average, F.lit(1e-6))))
    weighed = posted.join(held(idf), "token").select("token", "id", (F.col("idf") * gain).alias("w"))
    return weighed.join(held(terms), "token").groupBy("id", "query_id").agg(F.sum(F.col("w") * F.col("qtf")).alias("sparse_score")).select("query_id", "id", "sparse_score")


def top(scored: DataFrame, score: str, k: int, rank: str, by: str = "query_id") -> DataFrame:
    """The k best of each query, ties by id; ranks from 1."""
    # Rounded for ranking, as the sum's order differs between runs.
    w = W.partitionBy(by).orderBy(F.round(score, 9).desc(), "id")
    return scored.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def bm25_top(chunks: DataFrame, queries: DataFrame, k: int = 5, **options) -> DataFrame:
    return top(scores(chunks, queries, **options).where("sparse_score > 0"), "sparse_score", k, "sparse_rank")
