"""Readers: structured documents, chunks, parents, catalog, library, evaluation sets, files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions import text as X
from ..operators.validation import CATALOG

ELEMENT = "struct<tipo:string,texto:string,secao:string,table_index:int>"
STRUCTURED = f"versao int, documentos array<struct<documento:string,paginas:array<struct<pagina:int,texto:string,elementos:array<{ELEMENT}>,ocr_usado:boolean>>>>"
CHUNK = (
    "id long, parent_id string, documento string, pagina int, area string, assuntos array<string>, doc_titulo string, doc_autores array<string>, doc_ano int, section_heading string, "
    "content_type string, ocr_usado boolean, table_index int, chunk_index int, texto string, num_palavras int, parent_num_palavras int, parent_text string"
)
LIBRARY = "id string, documento_original string, titulo string, autores array<string>, ano int, area string, assuntos array<string>, tipo string, ordinal long"
EVALUATION = "id string, question string, reference_answer string, expected_context_terms array<string>, expected_solution_ids array<string>, expected_solution_id string, filtro_area array<string>, filtro_assunto array<string>"


def _json(spark: SparkSession, path: str, schema: str, multi: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", multi).json(path)


def structured(spark: SparkSession, path: str) -> DataFrame:
    """(documento, paginas) of structured payload files; none where the list is absent."""
    return _json(spark, path, STRUCTURED).select(F.explode("documentos").alias("d")).select("d.*")


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk files (a JSON list each); a row without text fails the query, and so does an empty table."""
    rows = _json(spark, path, CHUNK)
    if rows.isEmpty():
        raise ValueError(f"no chunks in {path}")
    return rows.where(F.when(F.col("texto").isNotNull(), True).otherwise(F.raise_error(F.lit("chunk without texto")).cast("boolean")))


def parents(spark: SparkSession, path: str) -> DataFrame:
    """(parent_id, parent_text) of a JSON object; no rows where the file is absent."""
    empty = spark.createDataFrame([], "parent_id string, parent_text string")
    try:
        raw = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return empty
    return raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("parent_id", "parent_text"))


def library(spark: SparkSession, path: str) -> DataFrame:
    """Library rows, or none where the file is absent."""
    fields = ",".join(":".join(f.strip().split(" ", 1)) for f in LIBRARY.split(","))
    try:
        return _json(spark, path, f"versao int, documentos array<struct<{fields}>>").select(F.explode("documentos").alias("d")).select("d.*")
    except AnalysisException:
        return spark.createDataFrame([], LIBRARY)


def upload_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(key, area, assuntos, status) of a JSON object by document."""
    try:
        raw = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return spark.createDataFrame([], "key string, area string, assuntos array<string>, status string")
    return raw.select(F.explode(F.from_json("value", "map<string,struct<area:string,assuntos:array<string>,status:string>>")).alias("key", "m")).select("key", "m.*")


def catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CATALOG).option("multiLine", True).json(path)


def evaluation_set(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list or JSON lines; both spellings of expected ids merged; a row without an id is ``row-N`` by its place (from 1).

    An evaluation set is one file of a bounded number of questions: its rows are numbered in one task.
    """
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).first()
    rows = _json(spark, path, EVALUATION, multi=first is not None and first[0].lstrip().startswith("["))
    one = F.when(F.col("expected_solution_id").isNotNull(), F.array("expected_solution_id")).otherwise(F.array().cast("array<string>"))
    ids = F.array_distinct(F.concat(F.coalesce("expected_solution_ids", F.array().cast("array<string>")), one))
    place = F.row_number().over(W.orderBy(F.monotonically_increasing_id()))
    return rows.withColumn("expected_solution_ids", ids).drop("expected_solution_id").withColumn("id", F.coalesce("id", F.concat(F.lit("row-"), place.cast("string"))))


def categories(spark: SparkSession, text: str) -> DataFrame:
    """(key, area, assuntos) of a manual YAML or JSON map of file names."""
    try:
        import yaml

        data = yaml.safe_load(text) or {}
    except ImportError:
        data = json.loads(text)
    return spark.createDataFrame([(k, v.get("area"), list(v.get("assuntos") or [])) for k, v in data.items()], "key string, area string, assuntos array<string>")


def pdf_files(spark: SparkSession, folders: list[str], ignored=()) -> DataFrame:
    """PDF files of the folders, in their order, then by name; quarantine isn't read."""
    parts = [spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(f).withColumn("folder", F.lit(i)) for i, f in enumerate(folders)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.withColumn("name", X.base_name("path")).where(~F.contains("path", F.lit("/quarantine/")))
    return (out.where(~F.col("name").isin(*ignored)) if ignored else out).withColumn("documento", F.when(F.contains("path", F.lit("/uploads/")), F.concat(F.lit("uploads/"), "name")).otherwise(F.col("name")))


def pages_of_html(pages: DataFrame) -> DataFrame:
    """Raw web pages as elements: headings are sections, other blocks text; (documento, pagina, pos, tipo, texto)."""
    plain = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    marked = F.regexp_replace(F.regexp_replace(plain, r"(?i)<h[1-6]\b[^>]*>", "\n\u0001"), r"(?i)</?(p|div|li|tr|br|h[1-6]|title|table|ul|ol|body|head|html|section|article)\b[^>]*>", "\n")
    text = F.regexp_replace(marked, r"<[^>]*>", "")
    for name, value in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):  # Fixed values: the common entities
        text = F.replace(text, F.lit(name), F.lit(value))
    parts = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: F.trim(F.replace(x, F.lit("\u0001"), F.lit(""))) != "")
    each = pages.select(F.col("page_id").cast("string").alias("documento"), F.lit(1).alias("pagina"), F.posexplode(parts).alias("pos", "raw"))
    return each.select("documento", "pagina", "pos", F.when(F.col("raw").startswith("\u0001"), "section").otherwise("text").alias("tipo"), F.trim(F.replace("raw", F.lit("\u0001"), F.lit(""))).alias("texto"))
