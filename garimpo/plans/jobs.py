"""Whole jobs: from an input that must be there to written tables or files and a summary of what was done."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..files import Files
from ..operators import evaluation, structure
from ..options import Options
from ..sources import readers, writers


def _needed(spark: SparkSession, path: str, first: str) -> None:
    folder, _, name = path.rstrip("/").rpartition("/")
    if not Files(spark, folder or ".").exists(name):
        raise FileNotFoundError(f"{path} isn't there; {first}")


def run_chunking(spark: SparkSession, source: str, path: str, uploads: DataFrame, library: DataFrame, manual: DataFrame, options: Options = Options()) -> dict:
    """Structured documents at ``source`` as chunk and parent tables below ``path``; the summary is that of the written tables.

    A source that is missing, or holds no document, fails before anything is
    written.  Ids are counters over the whole collection.
    """
    _needed(spark, source, "extract documents first")
    documents = readers.structured(spark, source)
    if documents.isEmpty():
        raise FileNotFoundError(f"{source} holds no documents; extract documents first")
    chunks, parents = structure.chunked(structure.elements_of(documents), uploads, library, manual, options, counters=True)
    writers.chunk_tables(chunks, parents, path)
    made = spark.read.parquet(f"{path}/chunks")
    s = made.agg(
        F.count_distinct("documento").alias("documentos_processados"), F.count_distinct("parent_id").alias("parents_gerados"), F.count("*").alias("total_chunks"), F.coalesce(F.sum("num_palavras"), F.lit(0)).cast("long").alias("total_palavras"),
        F.array_sort(F.collect_set("area")).alias("areas"), F.array_sort(F.collect_set("content_type")).alias("tipos_conteudo"),
    ).first()
    return {"source": source, **s.asDict(), "output_file": f"{path}/chunks", "parents_file": f"{path}/parents"}


def run_calibration(cases: DataFrame, path: str) -> dict:
    """The calibration of ``cases(expected_hit, dense)``, kept as a JSON file at ``path``; fails without cases."""
    if cases.isEmpty():
        raise ValueError("no cases to calibrate with")
    found = evaluation.calibration(cases).first().asDict()
    folder, _, name = path.rpartition("/")
    files = Files(cases.sparkSession, folder or ".")
    if files.exists(name):  # the newest result replaces the last one
        files.delete(name)
    import json

    files.create(name, json.dumps(found, ensure_ascii=False, indent=2))
    return found
