"""Constraint checks of catalog rows and uploads, as columns of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from .classify import injection_findings

# The catalog's constraints by field: (least, most) characters, items, and enumerations.
STRINGS = {"nome": (3, 200), "descricao": (10, 2000), "orgao": (2, 200), "problema": (10, 2000), "solucao": (10, 2000), "causa_raiz": (5, None)}
ENUMS = {"area": ("ia", "saude", "infraestrutura", "juridico", "tecnologia", "geral"), "status": ("ideacao", "piloto", "validacao", "producao", "suspensa")}
ARRAYS = {"tecnologias": (1, True, 2, 200), "sintomas": (1, False, None, None), "pre_condicoes": (0, False, None, None), "passos_implantacao": (1, False, None, None), "riscos": (0, False, None, None)}
COMPLIANCE_STRINGS = {"base_legal_lgpd": (3, 240), "modelo": (2, 200), "licenca_modelo": (2, 200)}
COMPLIANCE_ENUMS = {"dados_pessoais": ("nao", "sim", "a_confirmar"), "hospedagem": ("local", "nuvem-brasil", "nuvem-exterior", "hibrida", "a_confirmar")}
COMPLIANCE_ARRAYS = {"dependencias_open_source": (0, True, 2, 200)}
ID_PATTERN = r"^[a-z0-9][a-z0-9_-]{2,80}$"
CATALOG = T.StructType(
    [T.StructField("id", T.StringType())]
    + [T.StructField(n, T.StringType()) for n in (*STRINGS, *ENUMS)]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in ARRAYS]
    + [T.StructField("conformidade", T.StructType([T.StructField(n, T.StringType()) for n in (*COMPLIANCE_STRINGS, *COMPLIANCE_ENUMS)] + [T.StructField(n, T.ArrayType(T.StringType())) for n in COMPLIANCE_ARRAYS]))]
)


def _strings(prefix: str, rules: dict) -> list[Column]:
    out = []
    for n, (least, most) in rules.items():
        c = F.col(prefix + n)
        out += [F.when(c.isNull(), f"{prefix}{n}: required"), F.when(F.length(c) < least, f"{prefix}{n}: shorter than {least}")]
        if most:
            out.append(F.when(F.length(c) > most, f"{prefix}{n}: longer than {most}"))
    return out


def _enums(prefix: str, rules: dict) -> list[Column]:
    return [v for n, allowed in rules.items() for v in (F.when(F.col(prefix + n).isNull(), f"{prefix}{n}: required"), F.when(~F.col(prefix + n).isin(*allowed), f"{prefix}{n}: not allowed"))]


def _arrays(prefix: str, rules: dict) -> list[Column]:
    out = []
    for n, (items, unique, least, most) in rules.items():
        c = F.col(prefix + n)
        out += [F.when(c.isNull(), f"{prefix}{n}: required"), F.when(F.size(c) < items, f"{prefix}{n}: fewer than {items}")]
        if unique:
            out.append(F.when(F.size(F.array_distinct(c)) < F.size(c), f"{prefix}{n}: repeated item"))
        if least:
            out.append(F.when(F.exists(c, lambda x: (F.length(x) < least) | (F.length(x) > most)), f"{prefix}{n}: item length"))
    return out


def catalog_violations(catalog: DataFrame) -> DataFrame:
    """(id, violations): sorted findings of each row; a repeated id is one too."""
    again = catalog.groupBy("id").agg((F.count("*") > 1).alias("again"))
    rules = [F.when(F.col("id").isNull(), "id: required"), F.when(~F.col("id").rlike(ID_PATTERN), "id: pattern"), F.when(F.col("again"), "id: repeated")]
    rules += _strings("", STRINGS) + _enums("", ENUMS) + _arrays("", ARRAYS) + [F.when(F.col("conformidade").isNull(), "conformidade: required")]
    nested = _strings("conformidade.", COMPLIANCE_STRINGS) + _enums("conformidade.", COMPLIANCE_ENUMS) + _arrays("conformidade.", COMPLIANCE_ARRAYS)
    rules += [F.when(F.col("conformidade").isNotNull(), r) for r in nested]
    return catalog.join(again, "id", "left").select("id", F.array_sort(F.array_compact(F.array(*rules))).alias("violations"))


def catalog_schema() -> dict:
    """The catalog's rules as a JSON Schema, for ``schemas.findings``; a file with the same keywords does as well."""
    text = lambda least, most: {"type": "string", "minLength": least} | ({"maxLength": most} if most else {})
    many = lambda items, unique, least, most: {"type": "array", "minItems": items, "uniqueItems": unique, "items": text(least, most) if least else {"type": "string"}}
    one = lambda strings, enums, arrays: {n: text(*r) for n, r in strings.items()} | {n: {"type": "string", "enum": list(v)} for n, v in enums.items()} | {n: many(*r) for n, r in arrays.items()}
    inner = one(COMPLIANCE_STRINGS, COMPLIANCE_ENUMS, COMPLIANCE_ARRAYS)
    outer = {"id": {"type": "string", "pattern": ID_PATTERN}} | one(STRINGS, ENUMS, ARRAYS) | {"conformidade": {"type": "object", "additionalProperties": False, "required": list(inner), "properties": inner}}
    return {"type": "object", "additionalProperties": False, "required": list(outer), "properties": outer}


def unknown_keys(raw: Column) -> Column:
    """Keys of a JSON row that the catalog doesn't know."""
    return F.array_sort(F.array_except(F.json_object_keys(raw), F.array(*[F.lit(f.name) for f in CATALOG])))


def checked_catalog(catalog: DataFrame) -> DataFrame:
    """The catalog; the query fails with the first finding of a bad row."""
    bad = catalog_violations(catalog).where(F.size("violations") > 0).agg(F.min(F.concat_ws(" ", "id", F.element_at("violations", 1))).alias("v")).scalar()
    return catalog.where(F.when(bad.isNull(), True).otherwise(F.raise_error(F.concat(F.lit("catalog: "), bad)).cast("boolean")))


def solution_text(c: str = "") -> Column:
    """A solution as labelled lines."""
    f = lambda n: F.coalesce(F.col(c + n), F.lit(""))
    many = lambda n: F.array_join(F.coalesce(F.col(c + n), F.array().cast("array<string>")), ", ")
    g = "conformidade."
    parts = [
        ("Nome", f("nome")), ("Descricao", f("descricao")), ("Orgao", f("orgao")), ("Area", f("area")), ("Problema", f("problema")), ("Sintomas", many("sintomas")), ("Causa raiz", f("causa_raiz")), ("Pre-condicoes", many("pre_condicoes")), ("Solucao", f("solucao")),
        ("Passos de implantacao", many("passos_implantacao")), ("Riscos", many("riscos")), ("Tecnologias", many("tecnologias")), ("Status", f("status")), ("Dados pessoais", f(g + "dados_pessoais")), ("Base legal LGPD", f(g + "base_legal_lgpd")),
        ("Hospedagem", f(g + "hospedagem")), ("Modelo", f(g + "modelo")), ("Licenca do modelo", f(g + "licenca_modelo")), ("Dependencias open-source", many(g + "dependencias_open_source")),
    ]
    return F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), v) for k, v in parts])


def catalog_chunks(catalog: DataFrame, source: str = "solucoes_piloto.json") -> DataFrame:
    """One chunk a solution."""
    return catalog.select(
        F.xxhash64("id").alias("id"), F.col("id").alias("solution_id"), F.concat(F.lit(f"{source}#"), "id").alias("documento"), F.lit(None).cast("int").alias("pagina"), "area",
        F.array_sort(F.array_distinct(F.concat(F.array("area", "status"), "tecnologias"))).alias("assuntos"), F.lit("solucao_piloto").alias("content_type"), F.col("nome").alias("doc_titulo"), F.array("orgao").alias("doc_autores"),
        F.lit(None).cast("int").alias("doc_ano"), F.lit("Catalogo de solucoes piloto").alias("section_heading"), F.lit(0).alias("chunk_index"), solution_text().alias("texto"), "conformidade",
    )


def upload_status(files: DataFrame, most_bytes: int = 20_000_000, most_pages: int = 300, most_chars: int = 2_000_000, extension: str = ".pdf") -> DataFrame:
    """``files(name, size_bytes, magic, page_count, text)`` with ``findings`` and ``status``.

    Bad files are rejected by the first rule they break; texts that try to steer
    a model are quarantined for review, all others pending approval.
    """
    chars = F.length(F.coalesce("text", F.lit("")))
    found = injection_findings("text")
    reason = (
        F.when(~F.lower("name").endswith(extension), "extension")
        .when(F.col("size_bytes") > most_bytes, "size")
        .when(F.coalesce(F.col("magic"), F.lit("")) != "%PDF-", "magic")
        .when(F.col("page_count") > most_pages, "pages")
        .when(chars > most_chars, "chars")
    )
    status = F.when(reason.isNotNull(), F.concat(F.lit("rejected_"), reason)).when(F.size(found) > 0, "quarantined_suspicious").otherwise("quarantined_pending_approval")
    return files.select("*", found.alias("findings"), chars.alias("extracted_chars"), status.alias("status"))


# What requests with a bad file are answered with.
REJECTED = {"rejected_size": 413}
REJECTED_CODE = 422


def upload_requests(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, responses) of uploads of several files, ``checked(request_id, position, name, status, ...)`` by ``upload_status``.

    The first bad file ends its request: files before it are kept, those after
    it aren't looked at (``status`` null) and the request is answered with its
    code.  ``responses(request_id, code, detail, saved)``.
    """
    w = W.partitionBy("request_id").orderBy("position")
    bad = F.col("status").startswith("rejected_")
    before = F.coalesce(F.max(bad.cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    files = checked.withColumn("_late", before).withColumn("status", F.when(F.col("_late") == 0, F.col("status"))).drop("_late")
    code = F.when(F.col("f.status").isNull(), 200)
    for status, value in REJECTED.items():
        code = code.when(F.col("f.status") == status, value)
    first = files.groupBy("request_id").agg(F.min(F.when(F.col("status").startswith("rejected_"), F.struct("position", "status", "name"))).alias("f"), F.count(F.when(~F.col("status").startswith("rejected_"), 1)).alias("saved"))
    return files, first.select("request_id", code.otherwise(REJECTED_CODE).alias("code"), F.when(F.col("f").isNotNull(), F.concat_ws(": ", F.col("f.status"), F.col("f.name"))).alias("detail"), "saved")


def dims_agree(vectors: DataFrame, dims: int) -> DataFrame:
    """(dims, n, ok): the vector lengths of an index."""
    return vectors.groupBy(F.size("vector").alias("dims")).agg(F.count("*").alias("n")).withColumn("ok", F.col("dims") == dims)


def index_health(chunks: DataFrame, vectors: DataFrame, dims: int) -> DataFrame:
    """One row: counts of either side, whether they agree, whether all vectors have the right length."""
    c = chunks.agg(F.count("*").alias("chunks"))
    v = vectors.agg(F.count("*").alias("points"), F.coalesce(F.every(F.size("vector") == dims), F.lit(False)).alias("dims_ok"))
    return c.select("chunks", v.select("points").scalar().alias("points"), v.select("dims_ok").scalar().alias("dims_ok")).withColumn("consistent", F.col("chunks") == F.col("points"))


def index_diagnosis(chunks: DataFrame, vectors: DataFrame, dims: int, manifest: DataFrame, probe: DataFrame) -> DataFrame:
    """``index_health`` with what the manifest says (``total_chunks``) and whether a probe's hits (``dense_score``) are any good."""
    said = manifest.agg(F.max("total_chunks")).scalar()
    best = probe.agg(F.coalesce(F.max("dense_score"), F.lit(0.0))).scalar()
    return index_health(chunks, vectors, dims).withColumn("manifest_agrees", F.coalesce(F.col("points") == said, F.lit(False))).withColumn("dense_probe_ok", best > 0)


def bounded_request(query: Column, top_k: Column, most: int = 20) -> Column:
    """Why a request is refused; null if it isn't."""
    return F.when(F.trim(F.coalesce(query, F.lit(""))) == "", "blank query").when(~top_k.between(1, most), f"top_k outside 1..{most}")


def word_stats(texts: DataFrame, text: str = "text") -> DataFrame:
    return texts.agg(F.count("*").alias("rows"), F.sum(X.word_count(text)).alias("words"))
