"""Registered queries over what is stored: indexes that are built once, then searched."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cells, containment, payload, postings, schemas, search, sparse, structure, validation
from ..staging import staged_path
from ..options import Options
from . import tables as T
from .versioned import VersionedTable
from .catalog import CHUNKS_SQL, CLEAN_SQL, LIBRARY_SQL, ORACLE_SQL, RUNS_SQL, chunker_sql, query


def _index(spark, chunks, **options):
    return postings.build(chunks.select("id", "texto"), staged_path(spark, "index"), **options)


def _ranked(found):
    return found.hits.select("query_id", "id", F.round("sparse_score", 6).alias("score"), F.col("sparse_rank").cast("long").alias("sparse_rank"))


@query("q94_stored_bm25", ORACLE_SQL["q03_bm25_topk"])
def q94(spark, d):
    """The index of all chunks, written, opened and searched."""
    return _ranked(postings.search(_index(spark, T.chunks(spark, d)), T.queries(spark, d), 5))


@query("q95_stored_bm25_filtered", ORACLE_SQL["q04_bm25_filtered"])
def q95(spark, d):
    """The same index with small slices, restricted to chunks of an area."""
    c = T.chunks(spark, d)
    return _ranked(postings.search(_index(spark, c, slice_rows=512), T.queries(spark, d), 5, search.eligible(c, " EN ").select("id")))


def _near(found):
    return found.hits.select("query_id", "id", F.round("dense_score", 6).alias("score"), F.col("dense_rank").cast("long").alias("dense_rank"))


@query("q96_stored_vectors", ORACLE_SQL["q06_dense_topk"])
def q96(spark, d):
    """All vectors written by cells; every fiftieth one looks for its nearest."""
    held = cells.build(T.vectors(spark, d), staged_path(spark, "vectors"))
    asked = T.vectors(spark, d).where("id % 50 = 0").withColumnRenamed("id", "query_id")
    return _near(cells.search(held, asked, 10))


EXPECTED_SQL = """expected AS (SELECT item_id AS query_id, unnest(['doc' || item_id, 'SRC' || (item_id % 20) || '/DOC' || item_id || '.pdf', 'uploads/src' || (item_id % 20) || '/doc' || item_id || '.pdf', text]) AS documento FROM benchmark)"""


def _expected(spark, d):
    """Names that benchmark items expect: short ones, whole ones in upper case, ones with a folder, and whole texts."""
    k = F.col("item_id").cast("string")
    folder = (F.col("item_id") % 20).cast("string")
    names = F.array(F.concat(F.lit("doc"), k), F.concat(F.lit("SRC"), folder, F.lit("/DOC"), k, F.lit(".pdf")), F.concat(F.lit("uploads/src"), folder, F.lit("/doc"), k, F.lit(".pdf")), F.col("text"))
    return T.read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(names).alias("documento"))


@query("q97_matching_documents", f"WITH {CHUNKS_SQL}, {EXPECTED_SQL}, r AS (SELECT DISTINCT documento AS d FROM chunks) SELECT DISTINCT documento AS expected, d AS returned FROM expected, r WHERE contains(lower(documento), lower(d)) OR contains(lower(d), lower(documento))")
def q97(spark, d):
    """All expected names against all documents' names, either within the other."""
    found = containment.either_contains(_expected(spark, d).select(F.col("documento").alias("left")), T.chunks(spark, d).select(F.col("documento").alias("right")))
    return found.select(F.col("left").alias("expected"), F.col("right").alias("returned"))


@query(
    "q98_expected_documents",
    f"WITH {CHUNKS_SQL}, {EXPECTED_SQL}, r AS (SELECT item_id AS query_id, documento FROM benchmark JOIN chunks ON id % 40 = item_id % 40) SELECT query_id, max(CASE WHEN contains(lower(e.documento), lower(r.documento)) OR contains(lower(r.documento), lower(e.documento)) THEN 1 ELSE 0 END) = 1 AS doc_ok FROM expected e LEFT JOIN r USING (query_id) GROUP BY 1",
)
def q98(spark, d):
    """Expected against returned documents query by query, both as tables."""
    returned = T.read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 40).alias("k")).join(T.chunks(spark, d).select((F.col("id") % 40).alias("k"), "documento"), "k").select("query_id", "documento")
    return containment.documents_ok(_expected(spark, d), returned)


@query(
    "q99_stored_upserts",
    f"""WITH {LIBRARY_SQL},
n1 AS (SELECT 'd' || s_suppkey AS id, 'uploads/' || s_suppkey || '.pdf' AS documento_original, 'um' AS area FROM supplier WHERE s_suppkey % 2 = 0),
n2 AS (SELECT 'new' || s_suppkey AS id, 'docs/Customer#' || lpad(CAST(s_suppkey * 3 AS VARCHAR), 9, '0') || '.pdf' AS documento_original, 'dois' AS area FROM supplier),
n3 AS (SELECT 'new' || s_suppkey AS id, 'uploads/' || (s_suppkey + 1) || '.pdf' AS documento_original, 'tres' AS area FROM supplier WHERE s_suppkey % 4 = 1),
g AS (SELECT 'd' || s_suppkey AS id FROM supplier WHERE s_suppkey % 5 = 0),
t1 AS (SELECT id, documento_original, area FROM lib WHERE id NOT IN (SELECT id FROM n1) AND documento_original NOT IN (SELECT documento_original FROM n1) UNION ALL FROM n1),
t2 AS (SELECT * FROM t1 WHERE id NOT IN (SELECT id FROM n2) AND documento_original NOT IN (SELECT documento_original FROM n2) UNION ALL FROM n2),
t3 AS (SELECT * FROM t2 WHERE id NOT IN (SELECT id FROM g)),
t4 AS (SELECT * FROM t3 WHERE id NOT IN (SELECT id FROM n3) AND documento_original NOT IN (SELECT documento_original FROM n3) UNION ALL FROM n3)
SELECT id, documento_original, area FROM t4""",
)
def q99(spark, d):
    """The library as a stored table: two upserts, a deletion, a compaction, another upsert, then read."""
    k = F.col("s_suppkey")
    s = T.read(spark, d, "supplier")
    row = lambda rows, id, name, area: rows.select(id.alias("id"), name.alias("documento_original"), F.lit(area).alias("area"))
    old, new = F.concat(F.lit("d"), k.cast("string")), F.concat(F.lit("new"), k.cast("string"))
    upload = lambda n: F.concat(F.lit("uploads/"), n.cast("string"), F.lit(".pdf"))
    table = VersionedTable(spark, staged_path(spark, "library"), ["id", "documento_original"])
    table.replace(T.library(spark, d).select("id", "documento_original", "area"))
    table.upsert(row(s.where("s_suppkey % 2 = 0"), old, upload(k), "um"))
    table.upsert(row(s, new, F.concat(F.lit("docs/Customer#"), F.lpad((k * 3).cast("string"), 9, "0"), F.lit(".pdf")), "dois"))
    table.upsert(s.where("s_suppkey % 5 = 0").select(old.alias("id")), gone=True)
    table.compact()
    table.upsert(row(s.where("s_suppkey % 4 = 1"), new, upload(k + 1), "tres"))
    return table.read()


@query(
    "q100_counted_chunks",
    rf"""WITH RECURSIVE {RUNS_SQL}, g AS (SELECT documento, page, run, arg_min(tipo, pos) AS kind, string_agg(texto, chr(10) ORDER BY pos) AS raw FROM r WHERE tipo <> 'section' GROUP BY documento, page, run),
t AS (SELECT documento, page, run, kind, CASE WHEN kind = 'table' THEN trim(raw) ELSE {CLEAN_SQL.format("raw")} END AS texto FROM g),
w AS (SELECT documento, page, run, list_filter(regexp_split_to_array(texto, '\s+'), lambda x: x <> '') AS w, kind FROM t), p AS (SELECT *, row_number() OVER (ORDER BY documento, page, run) - 1 AS parent FROM w WHERE len(w) >= CASE WHEN kind = 'table' THEN 3 ELSE 20 END),
{chunker_sql("p", "parent", 60, 8)}
SELECT row_number() OVER (ORDER BY parent, chunk_index) - 1 AS id, 'parent-' || parent AS parent_id, CAST(chunk_index AS INTEGER) AS chunk_index, md5(c) AS texto_md5 FROM kids WHERE len(string_split(c, ' ')) >= 3""",
)
def q100(spark, d):
    """Chunks and parents numbered through, without gaps, over the whole collection."""
    chunks, _ = structure.materialise(structure.parents(T.elements(spark, d)), Options(child_words=60, child_overlap=8), counters=True)
    return chunks.select("id", "parent_id", "chunk_index", F.md5(F.col("texto").cast("binary")).alias("texto_md5"))


#: A smaller schema than the catalog's, for rows made of documents.
DOCUMENT_SCHEMA = {
    "type": "object", "additionalProperties": False, "required": ["id", "nome", "area", "n", "tags", "conformidade"],
    "properties": {
        "id": {"type": "string", "pattern": "^[a-z]+-[0-9]+$"}, "nome": {"type": "string", "minLength": 3, "maxLength": 5}, "area": {"type": "string", "enum": ["en", "de"]}, "n": {"type": "integer", "minimum": 300},
        "tags": {"type": "array", "minItems": 1, "uniqueItems": True, "items": {"type": "string", "maxLength": 4}},
        "conformidade": {"type": "object", "additionalProperties": False, "required": ["modelo"], "properties": {"modelo": {"type": "string", "minLength": 5}}},
    },
}


@query(
    "q101_schema_findings",
    """WITH j AS (SELECT doc_id, json_object('id', CASE WHEN doc_id % 9 = 0 THEN 'SOL' ELSE 'sol-' END || doc_id, 'nome', left(text, CAST(doc_id % 8 AS INTEGER)), 'area', lang,
  'n', CASE WHEN doc_id % 7 = 0 THEN to_json(CAST(n_chars AS VARCHAR)) ELSE to_json(n_chars) END, 'tags', CASE WHEN doc_id % 11 = 0 THEN to_json([]::VARCHAR[]) WHEN doc_id % 5 = 0 THEN to_json([source, source]) ELSE to_json([source, lang]) END,
  'conformidade', CASE WHEN doc_id % 13 = 0 THEN json_object('modelo', source, 'outro', 1) ELSE json_object('modelo', source) END) AS j FROM documents),
f AS (SELECT doc_id, list_filter([
  CASE WHEN j->>'$.area' IS NULL THEN '<raiz>' END, CASE WHEN j->>'$.area' NOT IN ('en', 'de') THEN 'area' END, CASE WHEN len(list_filter(json_keys(j, '$.conformidade'), lambda k: k <> 'modelo')) > 0 THEN 'conformidade' END, CASE WHEN length(j->>'$.conformidade.modelo') < 5 THEN 'conformidade.modelo' END,
  CASE WHEN NOT regexp_matches(j->>'$.id', '^[a-z]+-[0-9]+$') THEN 'id' END, CASE WHEN json_type(j, '$.n') NOT IN ('BIGINT', 'UBIGINT') THEN 'n' WHEN CAST(j->>'$.n' AS BIGINT) < 300 THEN 'n' END, CASE WHEN length(j->>'$.nome') NOT BETWEEN 3 AND 5 THEN 'nome' END,
  CASE WHEN json_array_length(j, '$.tags') = 0 THEN 'tags' END, CASE WHEN len(list_distinct(CAST(j->'$.tags' AS VARCHAR[]))) < json_array_length(j, '$.tags') THEN 'tags' END, CASE WHEN length(j->>'$.tags[0]') > 4 THEN 'tags.0' END, CASE WHEN length(j->>'$.tags[1]') > 4 THEN 'tags.1' END], lambda x: x IS NOT NULL) AS p FROM j)
SELECT doc_id, CAST(len(p) AS INTEGER) AS n_findings, coalesce(array_to_string(p, '|'), '') AS paths FROM f""",
)
def q101(spark, d):
    """Rows as JSON against a schema: types, nested keys, items; all paths in order, the first one is what is reported."""
    k = F.col("doc_id")
    n = F.when(k % 7 == 0, F.to_json(F.array(F.col("n_chars").cast("string")))).otherwise(F.to_json(F.array("n_chars")))
    tags = F.when(k % 11 == 0, F.array().cast("array<string>")).when(k % 5 == 0, F.array("source", "source")).otherwise(F.array("source", "lang"))
    rest = F.to_json(F.struct(F.concat(F.when(k % 9 == 0, "SOL").otherwise("sol-"), k.cast("string")).alias("id"), F.substring("text", F.lit(1), (k % 8).cast("int")).alias("nome"), F.col("lang").alias("area"), tags.alias("tags"), F.struct(F.col("source").alias("modelo"), F.when(k % 13 == 0, 1).alias("outro")).alias("conformidade")))
    text = F.concat(F.lit('{"n":'), F.substring(n, F.lit(2), F.length(n) - 2), F.lit(","), F.substring(rest, F.lit(2), F.length(rest)))
    found = schemas.findings(T.read(spark, d, "documents").select("doc_id", text.alias("j")), DOCUMENT_SCHEMA, "j")
    return found.select("doc_id", F.size("findings").alias("n_findings"), F.array_join(F.transform("findings", lambda f: f["path"]), "|").alias("paths"))


PAYLOAD_SQL = """ln AS (SELECT CAST(doc_id AS VARCHAR) AS documento, unnest(string_split(text, chr(10))) AS texto, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
el AS (SELECT documento, CAST(pos // 20 + 1 AS INTEGER) AS page, pos, trim(CASE WHEN pos % 20 = 3 AND CAST(documento AS BIGINT) % 4 > 0 THEN 'Resumo:' ELSE texto END, ' ') AS texto,
  CASE WHEN pos % 20 = 3 AND CAST(documento AS BIGINT) % 4 > 0 THEN 'section' WHEN length(texto) < 20 AND CAST(documento AS BIGINT) % 3 > 0 THEN 'section' WHEN pos % 7 = 6 THEN 'figure' WHEN contains(texto, ' | ') THEN 'table' ELSE 'text' END AS tipo FROM ln),
ok AS (SELECT * FROM el WHERE texto <> '')"""


def _payload(spark, d):
    """Documents as structured payloads: pages of twenty elements; of most documents the fourth of a page opens an abstract."""
    each = T.read(spark, d, "documents").select(F.col("doc_id").alias("k"), F.posexplode(F.split("text", "\n")).alias("pos", "t"))
    mark = (F.col("pos") % 20 == 3) & (F.col("k") % 4 > 0)
    kind = F.when(mark | ((F.length("t") < 20) & (F.col("k") % 3 > 0)), "section").when(F.col("pos") % 7 == 6, "figure").when(F.contains("t", F.lit(" | ")), "table").otherwise("text")
    element = F.struct("pos", kind.alias("tipo"), F.when(mark, "Resumo:").otherwise(F.col("t")).alias("texto"))
    page = each.groupBy("k", F.floor(F.col("pos") / 20).cast("int").alias("page")).agg(F.array_sort(F.collect_list(element)).alias("elementos"))
    whole = F.struct("page", (F.col("page") + 1).alias("pagina"), F.lit("").alias("texto"), F.transform("elementos", lambda e: F.struct(e["tipo"].alias("tipo"), e["texto"].alias("texto"))).alias("elementos"))
    return page.groupBy(F.col("k").cast("string").alias("documento")).agg(F.array_sort(F.collect_list(whole)).alias("paginas"))


@query(
    "q102_payload_abstracts",
    f"""WITH {PAYLOAD_SQL}, o AS (SELECT *, tipo = 'section' AND lower(rtrim(texto, ':')) IN ('resumo', 'abstract', 'summary') AS opens FROM ok WHERE page <= 5),
a AS (SELECT *, max(CAST(opens AS INTEGER)) OVER w AS open FROM o WINDOW w AS (PARTITION BY documento, page ORDER BY pos ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, max(CAST(tipo = 'section' AS INTEGER)) OVER w AS ended FROM a WHERE open = 1 AND NOT opens WINDOW w AS (PARTITION BY documento, page ORDER BY pos ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, coalesce(sum(length(texto) + 1) OVER (PARTITION BY documento, page ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 1 AS chars FROM b WHERE ended = 0 AND tipo IN ('text', 'ocr_text', 'table')),
p AS (SELECT documento, page, left(string_agg(texto, ' ' ORDER BY pos), 2000) AS t FROM c WHERE chars <= 1500 GROUP BY ALL)
SELECT documento, md5(arg_min(t, page)) AS resumo_md5 FROM p GROUP BY 1""",
)
def q102(spark, d):
    """Abstracts from the elements of structured documents (those documents that have one there)."""
    pages = payload.pages_of(_payload(spark, d))
    found = payload.abstracts(pages, payload.lines(pages).limit(0))
    return found.select("documento", F.md5(F.col("resumo").cast("binary")).alias("resumo_md5"))


@query("q103_payload_sections", f"WITH {PAYLOAD_SQL}, f AS (SELECT documento, lower(texto) AS k, min({{'page': page, 'pos': pos, 't': texto}}) AS f FROM ok WHERE tipo = 'section' GROUP BY ALL) SELECT documento, string_agg(f.t, '|' ORDER BY f.page, f.pos) AS secoes FROM f GROUP BY 1")
def q103(spark, d):
    """Section elements of structured documents, once each, in order (those documents that have some)."""
    pages = payload.pages_of(_payload(spark, d))
    return payload.sections(pages, payload.lines(pages).limit(0)).select("documento", F.array_join("secoes", "|").alias("secoes"))


@query("q104_payload_metadata")
def q104(spark, d):
    """All metadata of structured documents, elements first, lines where those say nothing."""
    m = payload.metadata(_payload(spark, d))
    flat = lambda c: F.array_join(c, "|").alias(c)
    return m.select("id", "documento_original", "titulo", flat("autores"), "ano", F.md5(F.col("resumo").cast("binary")).alias("resumo_md5"), flat("secoes_detectadas"), "tipo", "area", flat("assuntos"), "paginas_total")


@query(
    "q105_search_responses",
    "SELECT q.item_id AS query_id, CAST(count(id) AS INTEGER) AS total, coalesce(string_agg(id, '|' ORDER BY r), '') AS ids, any_value(text) AS query FROM benchmark q LEFT JOIN (SELECT query_id, CAST(id AS VARCHAR) AS id, sparse_rank AS r FROM (" + ORACLE_SQL["q03_bm25_topk"] + ")) ON item_id = query_id AND item_id % 7 > 0 GROUP BY 1",
)
def q105(spark, d):
    """The answers to all searches, read back from their JSON; every seventh query finds nothing."""
    chunks, asked = T.chunks(spark, d), T.queries(spark, d)
    best = sparse.bm25_top(chunks, asked.where("query_id % 7 > 0"), 5).withColumnRenamed("sparse_rank", "final_rank").withColumn("score", F.col("sparse_score"))
    made = search.responses(asked, search.api_hits(search.hits(best, chunks)))
    v = F.from_json("response", "query string, total int, resultados array<struct<id: long>>")
    return made.select("query_id", v.alias("v")).select("query_id", "v.total", F.array_join(F.transform("v.resultados", lambda r: r["id"].cast("string")), "|").alias("ids"), "v.query")


@query(
    "q106_upload_requests",
    """WITH f AS (SELECT page_id // 4 AS request_id, page_id % 4 AS position, 'f' || page_id || CASE WHEN page_id % 11 = 0 THEN '.txt' ELSE '.PDF' END AS name,
  CASE WHEN page_id % 11 = 0 THEN 'rejected_extension' WHEN length(html) > 4000 THEN 'rejected_size' WHEN NOT starts_with(html, '<') THEN 'rejected_magic' ELSE 'ok' END AS status FROM pages),
b AS (SELECT request_id, arg_min(status, position) AS status, arg_min(name, position) AS name, min(position) AS first_bad FROM f WHERE status <> 'ok' GROUP BY 1)
SELECT request_id, CAST(CASE WHEN b.status IS NULL THEN 200 WHEN b.status = 'rejected_size' THEN 413 ELSE 422 END AS INTEGER) AS code, b.status || ': ' || b.name AS detail, count(CASE WHEN f.status = 'ok' AND (first_bad IS NULL OR position < first_bad) THEN 1 END) AS saved FROM f LEFT JOIN b USING (request_id) GROUP BY ALL""",
)
def q106(spark, d):
    """Uploads of four files each: the first bad one ends the request."""
    k = F.col("page_id")
    files = T.read(spark, d, "pages").select(
        F.floor(k / 4).cast("long").alias("request_id"), (k % 4).alias("position"), F.concat(F.lit("f"), k.cast("string"), F.when(k % 11 == 0, ".txt").otherwise(".PDF")).alias("name"), F.length("html").alias("size_bytes"),
        F.when(F.col("html").startswith("<"), "%PDF-").otherwise("PK").alias("magic"), F.lit(3).alias("page_count"), F.lit("um texto").alias("text"),
    )
    return validation.upload_requests(validation.upload_status(files, most_bytes=4000))[1]
