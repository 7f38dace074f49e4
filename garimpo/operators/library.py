"""Facets, library filters, inventories, metadata resolution and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X

# Areas that lists show first, in this order.
AREA_PREFIX = ("ia", "saude", "infraestrutura", "juridico", "tecnologia")


def areas(chunks: DataFrame, prefix=AREA_PREFIX) -> DataFrame:
    """(position, area): the prefix in its order, then further areas sorted."""
    spark = chunks.sparkSession
    first = spark.createDataFrame([(i, a) for i, a in enumerate(prefix)], "position int, area string")
    rest = chunks.select("area").where("area is not null and trim(area) <> ''").distinct().join(first, "area", "left_anti")
    sorted_rest = rest.agg(F.array_sort(F.collect_set("area")).alias("a")).select(F.posexplode("a").alias("position", "area"))
    return first.unionByName(sorted_rest.select((F.col("position") + len(prefix)).alias("position"), "area"))


def subjects(chunks: DataFrame) -> DataFrame:
    """Distinct trimmed subjects."""
    return chunks.select(F.explode("assuntos").alias("assunto")).select(F.trim("assunto").alias("assunto")).where("assunto <> ''").distinct()


def facets(library: DataFrame) -> DataFrame:
    """One row: sorted distinct areas, types, years and subjects of ``library(area, tipo, ano, assuntos)``."""
    each = library.select("area", "tipo", "ano", F.explode_outer("assuntos").alias("s"))
    filled = lambda c: F.array_sort(F.collect_set(F.when(F.trim(c) != "", F.trim(c))))
    return each.agg(filled("area").alias("areas"), filled("tipo").alias("tipos"), F.array_sort(F.collect_set("ano")).alias("anos"), filled("s").alias("assuntos"))


def library_filter(library: DataFrame, area: str | None = None, tipo: str | None = None, ano_min: int | None = None, ano_max: int | None = None) -> DataFrame:
    """Case-insensitive equality and a year range; rows without a year drop out where a bound is given."""
    out = library
    for name, value in (("area", area), ("tipo", tipo)):
        if value and value.strip():
            out = out.where(F.lower(F.trim(name)) == value.strip().lower())
    if ano_min is not None:
        out = out.where(F.col("ano") >= ano_min)
    if ano_max is not None:
        out = out.where(F.col("ano") <= ano_max)
    return out


def lookup(library: DataFrame, doc_id: str) -> DataFrame:
    return library.where(F.col("id") == doc_id).limit(1)


def library_index(library: DataFrame) -> DataFrame:
    """(key, row): each document under its full path and its file name; the last one written wins."""
    keys = F.explode(F.array_distinct(F.array("documento_original", X.base_name("documento_original"))))
    return library.withColumn("key", keys).groupBy("key").agg(F.max_by("id", "ordinal").alias("id"))


def _top_values(chunks: DataFrame, value, k: int, name: str) -> DataFrame:
    counted = chunks.select("documento", value.alias("v")).where("v is not null and trim(v) <> ''").groupBy("documento", "v").agg(F.count("*").alias("n"))
    ranked = counted.withColumn("r", F.row_number().over(W.partitionBy("documento").orderBy(F.desc("n"), "v"))).where(F.col("r") <= k)
    return ranked.groupBy("documento").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "v"))), lambda x: x["v"]).alias(name))


def document_inventory(chunks: DataFrame) -> DataFrame:
    """Per document: chunks, distinct, first and last page, most frequent areas and subjects, first title and year."""
    base = chunks.groupBy("documento").agg(
        F.count("*").alias("chunks"),
        F.count_distinct("pagina").alias("pages"),
        F.min("pagina").alias("first_page"),
        F.max("pagina").alias("last_page"),
        F.min_by("doc_titulo", F.when(F.col("doc_titulo") != "", F.col("id"))).alias("title"),
        F.min_by("doc_ano", F.when(F.col("doc_ano").isNotNull(), F.col("id"))).alias("year"),
    )
    return base.join(_top_values(chunks, F.col("area"), 3, "areas"), "documento", "left").join(_top_values(chunks, F.explode("assuntos"), 5, "subjects"), "documento", "left")


def solution_inventory(chunks: DataFrame, unnamed: str = "solucoes_piloto.json") -> DataFrame:
    """Per document of the catalog: chunks and the first title that isn't empty."""
    name = F.coalesce(F.when(F.col("documento") != "", F.col("documento")), F.lit(unnamed))
    title = F.min_by("doc_titulo", F.when(F.col("doc_titulo") != "", F.col("id")))
    return chunks.groupBy(name.alias("documento")).agg(F.count("*").alias("chunks"), F.coalesce(title, F.lit("")).alias("titulo"))


def listed(inventory: DataFrame, limit: int = 50) -> DataFrame:
    """The first documents by lower-cased name, numbered, each with how many more there are behind the limit."""
    order = F.struct(F.lower("documento").alias("l"), F.col("documento").alias("d"))
    hidden = F.greatest(inventory.agg(F.count("*")).scalar() - limit, F.lit(0))
    first = inventory.orderBy(F.lower("documento"), "documento").limit(limit)
    return first.withColumn("number", F.row_number().over(W.orderBy(order))).withColumn("hidden", hidden)


# The fields of a library row in lists, with their defaults.
SUMMARY = {"id": "", "titulo": "", "autores": (), "ano": None, "area": "geral", "assuntos": (), "tipo": "outro", "paginas_total": 0}


def library_summary(library: DataFrame) -> DataFrame:
    """The few fields that lists show, defaults for what is missing."""

    def field(c: str):
        empty = F.array().cast("array<string>")
        default = SUMMARY[c]
        kind = "int" if c in ("ano", "paginas_total") else "array<string>" if default == () else "string"
        value = F.col(c).cast(kind) if c in library.columns else F.lit(None).cast(kind)
        return (value if default is None else F.coalesce(value, empty if default == () else F.lit(default))).alias(c)

    return library.select(*map(field, SUMMARY))


def specific(area, subjects_):
    """Metadata that says more than the defaults."""
    return F.coalesce((F.trim(area) != "") & (F.lower(F.trim(area)) != "geral"), F.lit(False)) | F.coalesce(F.exists(subjects_, lambda s: (F.trim(s) != "") & (F.lower(F.trim(s)) != "geral")), F.lit(False))


def resolve_metadata(documents: DataFrame, uploads: DataFrame, library: DataFrame, manual: DataFrame) -> DataFrame:
    """Area and subjects of ``documents(documento)`` by priority.

    Upload metadata, a specific library row, manual categories, a generic
    library row, then ``geral``.  The library is looked up by normalised name,
    raw name, then file name; manual categories by raw, then normalised name.
    Each source is ``(key, area, assuntos)``, one row a key.
    """
    side = lambda t, on, p: t.select(F.col("key").alias(on), F.struct("area", "assuntos").alias(p))
    d = documents.withColumn("_norm", X.document_key("documento")).withColumn("_base", X.base_name("documento"))
    d = d.join(side(uploads, "_norm", "up"), "_norm", "left")
    for on, p in (("_norm", "l1"), ("documento", "l2"), ("_base", "l3")):
        d = d.join(side(library, on, p), on, "left")
    for on, p in (("documento", "m1"), ("_norm", "m2")):
        d = d.join(side(manual, on, p), on, "left")
    lib, man = F.coalesce("l1", "l2", "l3"), F.coalesce("m1", "m2")
    is_specific = lib.isNotNull() & specific(lib["area"], lib["assuntos"])
    chosen = F.when(F.col("up").isNotNull(), F.col("up")).when(is_specific, lib).when(man.isNotNull(), man).otherwise(lib)
    source = F.when(F.col("up").isNotNull(), "upload").when(is_specific, "library").when(man.isNotNull(), "manual").when(lib.isNotNull(), "library-generic").otherwise("default")
    out = d.select("documento", chosen.alias("m"), source.alias("metadata_source"))
    area = F.coalesce(F.when(F.trim("m.area") != "", F.trim("m.area")), F.lit("geral"))
    return out.select("documento", area.alias("area"), X.clean_list(F.col("m.assuntos")).alias("assuntos"), "metadata_source")


def library_upsert(library: DataFrame, new: DataFrame) -> DataFrame:
    """Rows with the id, or the original document, of a new one go; the new ones come."""
    kept = library.join(new.select("id").distinct(), "id", "left_anti").join(new.select("documento_original").distinct(), "documento_original", "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def upload_upsert(uploads: DataFrame, new: DataFrame) -> DataFrame:
    """Upload metadata by normalised key; subjects trimmed; fields that the new row lacks stay as they were."""
    n = new.withColumn("key", X.document_key("key")).withColumn("assuntos", X.clean_list(F.col("assuntos")))
    both = uploads.alias("o").join(n.alias("n"), "key", "full_outer")
    names = [c for c in dict.fromkeys([*uploads.columns, *n.columns]) if c != "key"]
    pick = lambda c: F.coalesce(*[F.col(f"{p}.{c}") for p, t in (("n", n), ("o", uploads)) if c in t.columns]).alias(c)
    return both.select("key", *[pick(c) for c in names])


def status_transition(uploads: DataFrame, key: str, to: str = "approved_pending_index") -> DataFrame:
    """A quarantined upload moves on; others stay as they are."""
    moves = (F.col("key") == key) & F.col("status").startswith("quarantined_")
    return uploads.withColumn("status", F.when(moves, F.lit(to)).otherwise(F.col("status")))


def quarantine(uploads: DataFrame) -> DataFrame:
    """Quarantined uploads, the latest first."""
    return uploads.where(F.col("status").startswith("quarantined_")).orderBy(F.desc("uploaded_at"), "key")


def stored_key(uploads: DataFrame, filename: str) -> DataFrame:
    """The first entry (by ``ordinal``) that was stored under a file name, or whose key ends with it."""
    return uploads.where((F.col("stored_filename") == filename) | (X.base_name("key") == filename)).orderBy("ordinal", "key").limit(1)


def quarantine_list(uploads: DataFrame, files: DataFrame) -> DataFrame:
    """Quarantined uploads as administrators see them, the latest first; ``files(stored_filename)`` are those that are there."""
    own = F.coalesce("stored_filename", X.base_name("key"))
    q = uploads.where(F.trim("status").startswith("quarantined_")).withColumn("stored_filename", own)
    there = files.select("stored_filename", F.lit(True).alias("_there")).distinct()
    path = F.coalesce(F.nullif(F.col("quarantine_path"), F.lit("")), F.concat(F.lit("uploads/quarantine/"), "stored_filename"))
    shown = q.join(there, "stored_filename", "left").select(F.col("key").alias("documento"), "stored_filename", F.trim("status").alias("status"), F.coalesce("area", F.lit("geral")).alias("area"), "uploaded_at", path.alias("quarantine_path"), F.coalesce("_there", F.lit(False)).alias("file_exists"))
    return shown.orderBy(F.desc_nulls_last("uploaded_at"), "documento")


def approval(uploads: DataFrame, files: DataFrame, names: DataFrame, root: str = "uploads/quarantine/") -> DataFrame:
    """What becomes of requests ``names(filename)`` to approve uploads: (filename, code, key, approved_path).

    422 for a blank name, 404 for one that isn't known or whose file is gone, 409 for one that
    isn't quarantined, 400 for a path outside ``root``; else 200 and the new place.
    """
    clean = X.base_name(F.trim(F.coalesce("filename", F.lit(""))))
    asked = names.select("filename", clean.alias("_name"))
    known = uploads.select("key", "status", "quarantine_path", "ordinal", F.explode(F.array_distinct(F.array_compact(F.array("stored_filename", X.base_name("key"))))).alias("_name"))
    first = known.groupBy("_name").agg(F.min_by(F.struct("key", "status", "quarantine_path"), F.struct("ordinal", "key")).alias("u"))
    there = files.select(F.col("stored_filename").alias("_name"), F.lit(True).alias("there")).distinct()
    j = asked.join(first, "_name", "left").join(there, "_name", "left")
    path = F.coalesce(F.nullif(F.col("u.quarantine_path"), F.lit("")), F.concat(F.lit(root), "_name"))
    outside = ~path.startswith(root) | path.rlike(r"(^|/)\.\.(/|$)")
    code = F.when(F.col("_name") == "", 422).when(F.col("u").isNull(), 404).when(~F.coalesce(F.trim("u.status"), F.lit("")).startswith("quarantined_"), 409).when(outside, 400).when(F.col("there").isNull(), 404).otherwise(200)
    return j.select("filename", code.alias("code"), F.col("u.key").alias("key"), F.when(code == 200, F.concat(F.lit("uploads/approved/"), "_name")).alias("approved_path"))


def approved(uploads: DataFrame, decided: DataFrame) -> DataFrame:
    """Upload metadata after approvals: moved entries have their new key and status, and no quarantine path."""
    ok = decided.where("code = 200").select("key", F.col("approved_path").alias("_to"))
    j = uploads.join(ok, "key", "left")
    moved = F.col("_to").isNotNull()
    new = {"key": F.coalesce("_to", "key"), "status": F.when(moved, "approved_pending_index").otherwise(F.col("status")), "quarantine_path": F.when(~moved, F.col("quarantine_path"))}
    return j.select(*[new.get(c, F.col(c)).alias(c) for c in uploads.columns])


def chunk_summary(chunks: DataFrame) -> DataFrame:
    return chunks.agg(
        F.count("*").alias("chunks"), F.count_distinct("documento").alias("documents"), F.count_distinct("parent_id").alias("parents"), F.coalesce(F.sum(X.word_count("texto")), F.lit(0)).alias("words"), F.array_sort(F.collect_set("area")).alias("areas"), F.array_sort(F.collect_set("content_type")).alias("content_types")
    )


def useful_chunks(chunks: DataFrame, n: int, seed: int = 0, least_chars: int = 200) -> DataFrame:
    """A seeded sample of n chunks longer than ``least_chars``: those with the least seeded hash."""
    return chunks.where(F.length("texto") > least_chars).orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(n)
