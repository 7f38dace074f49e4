"""The given tables as the engine's inputs: stand-ins for chunks, queries, libraries and page lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of files of ten pages, three chunks a parent."""
    d = F.col("doc_id")
    tens = F.floor(d / 10).cast("long").cast("string")
    return read(spark, sf_dir, "documents").select(
        d.alias("id"),
        F.col("text").alias("texto"),
        F.col("lang").alias("area"),
        F.array("source", "lang").alias("assuntos"),
        F.concat("source", F.lit("/doc"), tens, F.lit(".pdf")).alias("documento"),
        (d % 10 + 1).cast("int").alias("pagina"),
        F.concat(F.lit("p"), F.floor(d / 3).cast("long").cast("string")).alias("parent_id"),
        F.when(d % 4 == 0, "").otherwise(F.concat(F.lit("Title "), tens)).alias("doc_titulo"),
        F.when(d % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("Ana "), "source"))).alias("doc_autores"),
        F.when(d % 5 != 0, 1990 + d % 36).cast("int").alias("doc_ano"),
        F.when(d % 2 == 0, F.concat(F.lit("Part "), (d % 7).cast("string"))).alias("section_heading"),
        F.when(d % 6 == 0, "table").otherwise("text").alias("content_type"),
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as queries, each with the vector of its number."""
    q = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return q.join(v, "query_id", "left")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents as spans: short first lines large, every third line bold."""
    each = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("documento"), F.posexplode(F.split("text", "\n")).alias("pos", "texto"))
    size = F.when(F.length("texto") < 20, 14.0).otherwise(10.0)
    return each.select("documento", F.floor(F.col("pos") / 20 + 1).cast("int").alias("page"), "pos", "texto", size.alias("font_size"), (F.col("pos") % 3 == 0).alias("is_bold"))


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents as typed elements: lines under 20 characters are sections, those with bars tables."""
    each = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("documento"), F.posexplode(F.split("text", "\n")).alias("pos", "texto"))
    kind = F.when(F.length("texto") < 20, "section").when(F.contains("texto", F.lit(" | ")), "table").otherwise("text")
    return each.select("documento", F.floor(F.col("pos") / 20 + 1).cast("int").alias("pagina"), "pos", kind.alias("tipo"), "texto")


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as library rows: nation as area, segment-like type by key, year from the key."""
    c = read(spark, sf_dir, "customer").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    return c.select(
        F.concat(F.lit("d"), k.cast("string")).alias("id"), F.concat(F.lit("docs/"), "c_name", F.lit(".pdf")).alias("documento_original"), F.col("n_name").alias("area"),
        F.element_at(F.array(*map(F.lit, ("manual", "artigo_cientifico", "outro"))), (k % 3 + 1).cast("int")).alias("tipo"), F.when(k % 7 != 0, 1990 + k % 35).cast("int").alias("ano"),
        F.array(F.lower("n_name"), F.concat(F.lit(" t"), (k % 5).cast("string"), F.lit(" "))).alias("assuntos"),
    )


# Questions in the planner's language.
SPEECH = (
    "Qual a infraestrutura do cluster Kubernetes em 2021?", "LGPD e proteção de dados pessoais", "Diagnóstico médico do paciente no hospital", "Artigo sobre RAG e embeddings, 1999",
    "erro e lentidão no sistema", "guia de segurança da API", "nada em particular", "Solução para falhas de conformidade 2020-2021",
)


def speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions in the planner's language, each with a part's name at its end."""
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(k.alias("query_id"), F.concat(F.element_at(F.array(*map(F.lit, SPEECH)), (k % len(SPEECH) + 1).cast("int")), F.lit(" "), "p_name").alias("query"))
