"""Further registered queries: extraction, text functions, library services, answers and their events.

Inputs are made from the given tables, with values that hit every rule; each
query's DuckDB counterpart computes the rule from those values.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import answer, classify, evaluation, library, search, structure, validation
from ..sources import extraction
from ..streaming import limits
from . import tables as T
from .catalog import CHUNKS_SQL, CITE_SQL, LINES_SQL, RUNS_SQL, CLEAN_SQL, chunker_sql, joined, query


def _pick(values, k):
    """One of a few literals by a key."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))


def _pick_sql(values, k: str) -> str:
    quoted = ["NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values]
    return f"([{', '.join(quoted)}])[{k} % {len(values)} + 1]"


def _md5(c: str):
    return F.md5(F.col(c).cast("binary")).alias(f"{c}_md5")


# ---------------------------------------------------------------- extraction

def _json_pages(content: bytes) -> Iterator[dict]:
    """A reader of pages kept as JSON, in place of a PDF library."""
    if content[:1] != b"[":
        raise ValueError("not a page list")
    yield from json.loads(content)


def _line_pages(content: bytes) -> Iterator[dict]:
    """A reader of plain text: twenty lines a page, short lines large, each line a block of one span."""
    text = content.decode()
    if not text:
        raise ValueError("empty file")
    rows = text.split("\n")
    for at in range(0, len(rows), 20):
        blocks = [[[{"text": t, "size": 14.0 if len(t) < 20 else 10.0, "font": "Serif-Bold" if (at + i) % 3 == 0 else "Serif"}]] for i, t in enumerate(rows[at : at + 20])]
        yield {"pagina": at // 20 + 1, "blocks": blocks}


def _files(spark, d):
    """Documents as files: one in eleven is empty and can't be read."""
    t = T.read(spark, d, "documents").where("text is not null")
    return t.select(F.col("doc_id").cast("string").alias("documento"), F.when(F.col("doc_id") % 11 == 0, F.lit("")).otherwise(F.col("text")).cast("binary").alias("content"))


PAGES_SQL = r"""raw AS (SELECT CAST(doc_id AS VARCHAR) AS documento, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS p FROM documents WHERE doc_id % 11 <> 0 AND text <> ''),
x AS (SELECT documento, CAST(p // 20 + 1 AS INTEGER) AS pagina, p, regexp_replace(trim(raw, ' '), '\s{2,}', ' ', 'g') AS texto, CASE WHEN length(raw) < 20 THEN 14.0 ELSE 10.0 END AS size, p % 3 = 0 AS bold FROM raw WHERE trim(raw, ' ') <> ''),
m AS (SELECT documento, pagina, median(size) AS m FROM x GROUP BY ALL),
y AS (SELECT *, len(list_filter(regexp_split_to_array(texto, '\s+'), lambda w: w <> '')) AS n FROM x JOIN m USING (documento, pagina)),
e AS (SELECT *, length(trim(texto, ' ')) BETWEEN 1 AND 140 AND NOT (regexp_matches(texto, '[.,;:]$') AND n > 8) AND (regexp_matches(texto, '^(\d+(\.\d+)*|[A-Z]\.)\s+.+') OR (upper(texto) = texto AND n <= 12) OR (size >= m + 1.0 AND (bold OR n <= 10))) AS head FROM y),
g AS (SELECT *, sum(CAST(head AS INTEGER)) OVER (PARTITION BY documento, pagina ORDER BY p ROWS UNBOUNDED PRECEDING) AS run FROM e),
el AS (SELECT documento, pagina, run, head, min(p) AS p, regexp_replace(string_agg(regexp_replace(texto, '\s+$', ''), chr(10) ORDER BY p), '^\s+|\s+$', '', 'g') AS texto FROM g GROUP BY ALL)"""


@query(
    "q62_extracted_elements",
    f"WITH {PAGES_SQL} SELECT documento, pagina, CAST(row_number() OVER (PARTITION BY documento, pagina ORDER BY p) - 1 AS INTEGER) AS pos, CASE WHEN head THEN 'section' ELSE 'text' END AS tipo, md5(texto) AS texto_md5 FROM el WHERE texto <> ''",
)
def q62(spark, d):
    pages = extraction.pages_of_pdf(_files(spark, d), _json_pages, _line_pages)
    return extraction.elements_of_pages(pages.where("error is null")).select("documento", "pagina", "pos", "tipo", _md5("texto"))


@query(
    "q63_extraction_summary",
    f"""WITH {PAGES_SQL}, t AS (SELECT documento, pagina, string_agg(texto, chr(10) || chr(10) ORDER BY p) FILTER (WHERE NOT head AND texto <> '') AS a, string_agg(texto, chr(10) || chr(10) ORDER BY p) FILTER (WHERE texto <> '') AS b FROM el WHERE texto <> '' GROUP BY ALL)
SELECT (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS total_pdfs_encontrados, (SELECT count(*) FROM documents WHERE doc_id % 11 <> 0 AND text <> '') AS pdfs_processados, count(*) AS total_paginas, CAST(sum(length(regexp_replace(coalesce(a, b), '\\n{{4,}}', chr(10) || chr(10) || chr(10), 'g'))) AS BIGINT) AS total_caracteres,
 (SELECT count(*) FROM documents WHERE text IS NOT NULL AND (doc_id % 11 = 0 OR text = '')) AS errors FROM t""",
)
def q63(spark, d):
    pages = extraction.pages_of_pdf(_files(spark, d), _json_pages, _line_pages)
    s = extraction.extraction_summary(_files(spark, d), pages, extraction.elements_of_pages(pages.where("error is null")))
    return s.select("total_pdfs_encontrados", "pdfs_processados", "total_paginas", "total_caracteres", F.size("documento_erros").cast("long").alias("errors"))


@query(
    "q64_span_lines",
    """WITH s AS (SELECT CAST(c_custkey AS VARCHAR) AS documento, c_custkey AS k, c_name AS a, c_mktsegment AS b FROM customer)
SELECT documento, CAST(1 AS INTEGER) AS page, CAST(pos AS INTEGER) AS pos, CASE pos WHEN 0 THEN a || ' ' || b ELSE b END AS texto, CASE pos WHEN 0 THEN CAST(8 + k % 5 AS DOUBLE) ELSE 0.0 + 9 END AS font_size, CASE pos WHEN 0 THEN k % 2 = 0 ELSE FALSE END AS is_bold FROM s, (SELECT unnest([0, 2]) AS pos)""",
)
def q64(spark, d):
    k = F.col("c_custkey")
    span = lambda t, size, font: F.struct(t.alias("text"), size.cast("double").alias("size"), font.alias("font"))
    first = F.array(span(F.concat(F.lit(" "), "c_name", F.lit("  ")), 8 + k % 5, F.when(k % 2 == 0, "Sans-BOLD").otherwise("Sans")), span(F.lit("  "), F.lit(99), F.lit("Sans")), span(F.col("c_mktsegment"), F.lit(1), F.lit(None).cast("string")))
    blocks = F.array(F.array(first, F.array(span(F.lit(" "), F.lit(50), F.lit("Bold")))), F.array(F.array(span(F.col("c_mktsegment"), F.lit(9), F.lit("Sans")))))
    pages = T.read(spark, d, "customer").select(k.cast("string").alias("documento"), F.lit(1).alias("pagina"), blocks.alias("blocks"))
    return extraction.span_lines(pages)


@query(
    "q65_table_elements",
    """WITH r AS (SELECT c_custkey AS k, c_name AS a, c_mktsegment AS b FROM customer)
SELECT CAST(k AS VARCHAR) AS documento, CAST(1 AS INTEGER) AS table_index, '| nome | segmento |  |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| ' || a || ' | ' || b || ' | x y |' || CASE WHEN k % 3 = 0 THEN '' ELSE chr(10) || '| ' || k || ' |  |  |' END AS texto FROM r""",
)
def q65(spark, d):
    k = F.col("c_custkey")
    cells = lambda *c: F.array(*c).cast("array<string>")
    last = F.when(k % 3 == 0, cells(F.lit(" "), F.lit(None))).otherwise(cells(k.cast("string")))
    rows = F.array(cells(F.lit("nome "), F.lit("segmento")), cells(F.lit(None), F.lit("")), cells(F.col("c_name"), F.col("c_mktsegment"), F.lit("x\ny")), last)
    pages = T.read(spark, d, "customer").select(k.cast("string").alias("documento"), F.lit(1).alias("pagina"), F.array(rows, F.array(cells(F.lit("")))).alias("tables"))
    return extraction.table_elements(pages).select("documento", "table_index", "texto")


@query(
    "q66_abstracts",
    rf"""WITH {LINES_SQL}, l AS (SELECT documento, page, pos, CASE WHEN pos % 20 = 1 AND page <> 2 THEN 'Abstract:' ELSE texto END AS texto, pos % 9 = 8 AS is_bold FROM lines WHERE page <= 5),
a AS (SELECT *, max(CAST(lower(trim(texto, ' ')) IN ('resumo', 'abstract', 'summary', 'resumo:', 'abstract:', 'summary:') AS INTEGER)) OVER w AS open, lower(trim(texto, ' ')) IN ('resumo', 'abstract', 'summary', 'resumo:', 'abstract:', 'summary:') AS opens FROM l WINDOW w AS (PARTITION BY documento, page ORDER BY pos ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, max(CAST(is_bold AND len(list_filter(regexp_split_to_array(texto, '\s+'), lambda x: x <> '')) <= 5 AS INTEGER)) OVER w AS ended, coalesce(sum(length(texto) + 1) OVER (PARTITION BY documento, page ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 1 AS chars FROM a WHERE open = 1 AND NOT opens WINDOW w AS (PARTITION BY documento, page ORDER BY pos ROWS UNBOUNDED PRECEDING)),
p AS (SELECT documento, page, left(trim(string_agg(texto, ' ' ORDER BY pos), ' '), 2000) AS t FROM b WHERE ended = 0 AND chars <= 1500 GROUP BY ALL)
SELECT documento, md5(arg_min(t, page)) AS resumo_md5 FROM p GROUP BY 1""",
)
def q66(spark, d):
    l = T.lines(spark, d).withColumn("texto", F.when((F.col("pos") % 20 == 1) & (F.col("page") != 2), "Abstract:").otherwise(F.col("texto"))).withColumn("is_bold", F.col("pos") % 9 == 8)  # noqa: E741
    return structure.abstracts(l).select("documento", _md5("resumo"))


NAMES = (
    "João da Silva Santos", "Ana Maria", "Projeto Framework Artificial", "ana maria souza", "Ludwig van Beethoven", "Maria 2 Souza", "Di Cavalcanti", "A. B. Souza", "J Souza Lima", "Maria Souza.", "  Carla  dos   Reis  ", "Uma Dois Três Quatro Cinco Seis Sete",
    "Érica Álvares", "Ana", "Pedro; Paulo", "Rui de da", "Análise Souza", "Jean-Luc D'Ávila",
)


@query(
    "q67_person_names",
    rf"""WITH n AS (SELECT s_suppkey, {_pick_sql(NAMES, "s_suppkey")} AS x FROM supplier), w AS (SELECT s_suppkey, trim(x, ' ') AS t, list_filter(regexp_split_to_array(x, '\s+'), lambda v: v <> '') AS w FROM n),
o AS (SELECT *, list_filter(w, lambda v: NOT list_contains([{", ".join(f"'{p}'" for p in structure.NAME_PREPOSITIONS)}], lower(v))) AS own FROM w)
SELECT s_suppkey, length(t) BETWEEN 5 AND 80 AND NOT regexp_matches(t, '\d') AND NOT regexp_matches(t, '[^\p{{L}}_\s.''\-]') AND NOT ends_with(t, '.') AND len(w) BETWEEN 2 AND 6 AND len(own) >= 2
 AND len(list_filter(own, lambda v: NOT regexp_matches(v, '^\p{{Lu}}') OR length(v) < 2 OR list_contains([{", ".join(f"'{p}'" for p in structure.NOT_NAMES)}], lower(v)))) = 0 AS person FROM o""",
)
def q67(spark, d):
    return T.read(spark, d, "supplier").select("s_suppkey", structure.person_name(_pick(NAMES, F.col("s_suppkey"))).alias("person"))


CREATED, MODIFIED = ("D:20190305120000Z", None, "D:18990101", "D:20451231", ""), ("D:2021", "1995-01-02", None)


@query(
    "q68_file_properties",
    f"""WITH p AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 3 = 1 THEN '' ELSE s_name || ' ' END AS author, CASE WHEN s_suppkey % 2 = 0 THEN ' Escritor' END AS creator, {_pick_sql(CREATED, "s_suppkey")} AS c, {_pick_sql(MODIFIED, "s_suppkey")} AS m FROM supplier),
y AS (SELECT *, TRY_CAST(regexp_extract(coalesce(c, ''), '(19|20)[0-9][0-9]') AS INTEGER) AS cy, TRY_CAST(regexp_extract(coalesce(m, ''), '(19|20)[0-9][0-9]') AS INTEGER) AS my FROM p)
SELECT k AS s_suppkey, trim(coalesce(nullif(author, ''), creator, '')) AS instituicao, coalesce(CASE WHEN cy BETWEEN 1990 AND 2030 THEN cy END, CASE WHEN my BETWEEN 1990 AND 2030 THEN my END) AS ano FROM y""",
)
def q68(spark, d):
    k = F.col("s_suppkey")
    author, creator = F.when(k % 3 == 1, "").when(k % 3 == 2, F.concat("s_name", F.lit(" "))), F.when(k % 2 == 0, " Escritor")
    return T.read(spark, d, "supplier").select("s_suppkey", structure.institution(author, creator).alias("instituicao"), structure.property_year(_pick(CREATED, k), _pick(MODIFIED, k)).alias("ano"))


# ---------------------------------------------------------------- a model's answers

ANSWERS = (
    'Segue: {"area_tematica": " IA ", "tipo_documento": "manual", "metodologia": "Estudo de Caso", "assuntos": [" RAG ", "", "Chatbot"], "palavras_chave": ["a", "b", "c", "d", "e", "f", "g", "h", "i"]} fim',
    '{"area_tematica": "geral", "tipo_documento": "livro", "assuntos": ["geral"]}', "sem objeto", None, '{"area_tematica": "saude", "assuntos": ["a", "b", "c", "d", "e", "f", "g"], "palavras_chave": [" "]}', '{"area_tematica": "geral", "assuntos": ["X"]}', "{quebrado",
)


def _allowed_sql(c: str, values, old: str) -> str:
    return f"CASE WHEN list_contains([{', '.join(repr(v) for v in values)}], lower(trim(coalesce({c}, '')))) THEN lower(trim({c})) ELSE {old} END"


@query(
    "q69_enrichment",
    f"""WITH m AS (SELECT s_suppkey AS id, {_pick_sql(("geral", "juridico"), "s_suppkey")} AS area, 'outro' AS tipo, 'outro' AS metodo, ['antigo'] AS s, ['velha'] AS w, regexp_extract({_pick_sql(ANSWERS, "s_suppkey")}, '(?s)(\\{{.*\\}})', 1) AS raw FROM supplier),
j AS (SELECT *, CASE WHEN raw IS NOT NULL AND json_valid(raw) THEN CAST(raw AS JSON) END AS j FROM m),
v AS (SELECT *, {_allowed_sql("j->>'area_tematica'", classify.AREAS, "area")} AS na, list_filter(list_transform(CAST(j->'assuntos' AS VARCHAR[]), lambda x: trim(lower(x))), lambda x: x <> '') AS ns, list_filter(list_transform(CAST(j->'palavras_chave' AS VARCHAR[]), lambda x: trim(x)), lambda x: x <> '') AS nw FROM j),
k AS (SELECT *, area <> 'geral' AND na = 'geral' AS keeps FROM v)
SELECT id, CASE WHEN j IS NOT NULL AND NOT keeps THEN na ELSE area END AS area_tematica, CASE WHEN j IS NOT NULL THEN {_allowed_sql("j->>'tipo_documento'", classify.TYPES, "tipo")} ELSE tipo END AS tipo_documento, CASE WHEN j IS NOT NULL THEN {_allowed_sql("j->>'metodologia'", classify.METHODS, "metodo")} ELSE metodo END AS metodologia,
 array_to_string(CASE WHEN j IS NOT NULL AND len(ns) > 0 AND NOT (keeps AND ns = ['geral']) THEN ns[1:6] ELSE s END, '|') AS assuntos, array_to_string(CASE WHEN j IS NOT NULL AND len(nw) > 0 THEN nw[1:8] ELSE w END, '|') AS palavras_chave, CASE WHEN j IS NOT NULL THEN 'alta' ELSE 'baixa' END AS qualidade_extracao FROM k""",
)
def q69(spark, d):
    k = F.col("s_suppkey")
    s = T.read(spark, d, "supplier")
    meta = s.select(k.alias("id"), _pick(("geral", "juridico"), k).alias("area_tematica"), F.lit("outro").alias("tipo_documento"), F.lit("outro").alias("metodologia"), F.array(F.lit("antigo")).alias("assuntos"), F.array(F.lit("velha")).alias("palavras_chave"))
    return classify.enriched(meta, s.select(k.alias("id"), _pick(ANSWERS, k).alias("answer"))).select("id", "area_tematica", "tipo_documento", "metodologia", joined("assuntos"), joined("palavras_chave"), "qualidade_extracao")


FENCED = ('x ```json\n{"question": "a"} ``` y', '```\n{"question": "b"}\n```', '{"question": "c"}', "nada", '```json {"question": "d"}')


@query("q70_fenced_json", f"""WITH a AS (SELECT s_suppkey, replace({_pick_sql([f.replace(chr(10), "~") for f in FENCED], "s_suppkey")}, '~', chr(10)) AS t FROM supplier), b AS (SELECT s_suppkey, trim(CASE WHEN contains(t, '```json') THEN string_split(string_split(t, '```json')[2], '```')[1] WHEN contains(t, '```') THEN string_split(t, '```')[2] ELSE t END, ' ' || chr(10)) AS j FROM a)
SELECT s_suppkey, CASE WHEN json_valid(j) THEN CAST(j AS JSON)->>'question' END AS question FROM b""")
def q70(spark, d):
    return T.read(spark, d, "supplier").select("s_suppkey", X.json_fenced_in(_pick(FENCED, F.col("s_suppkey")), "question string")["question"].alias("question"))


# ---------------------------------------------------------------- text functions

@query(
    "q71_clean_extracted",
    r"""WITH t AS (SELECT doc_id, chr(1) || '  ' || replace(replace(text, ', ', chr(13) || chr(10) || chr(10) || chr(10) || chr(10) || '  '), '. ', '.  ' || chr(13)) || chr(12) || '  ' || chr(10) AS t FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, list_transform(string_split(replace(replace(regexp_replace(t, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: regexp_replace(x, '\s+$', '')) AS l FROM t)
SELECT doc_id, md5(regexp_replace(regexp_replace(array_to_string(l, chr(10)), '\n{4,}', chr(10) || chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS texto_md5 FROM n""",
)
def q71(spark, d):
    t = F.replace(F.replace("text", F.lit(", "), F.lit("\r\n\n\n\n  ")), F.lit(". "), F.lit(".  \r"))
    t = F.concat(F.lit("\x01  "), t, F.lit("\x0c  \n"))
    return T.read(spark, d, "documents").where("text is not null").select("doc_id", X.clean_extracted(t).alias("texto")).select("doc_id", _md5("texto"))


CITED = ("como (Silva, 2020) e (Souza Lima,  s.d.) e (Silva, 2020)", "nada (2020) aqui", "(a, 1999)", "(Reis, 1850) (Ana Reis, 2001)", None)


@query("q72_citations", f"""WITH t AS (SELECT s_suppkey, coalesce({_pick_sql(CITED, "s_suppkey")}, '') AS t FROM supplier), c AS (SELECT s_suppkey, list_transform(regexp_extract_all(t, '(?i)\\([^\\(\\),]{{2,80}},\\s*(?:(?:19|20)[0-9][0-9]|s\\.d\\.)\\)'), lambda x: regexp_replace(x, '^\\(\\s*(.*?)\\s*,\\s*([^,]*?)\\)$', '\\1, \\2')) AS c FROM t),
u AS (SELECT s_suppkey, list_filter(c, lambda x, i: list_position(c, x) = i) AS c FROM c) SELECT s_suppkey, array_to_string(c, '|') AS cited FROM u""")
def q72(spark, d):
    return T.read(spark, d, "supplier").select("s_suppkey", F.array_join(X.citations_in(_pick(CITED, F.col("s_suppkey"))), "|").alias("cited"))


KINDS = (" Manual ", "RELATORIO", "", None, "apresentacao")


@query("q73_allowed_values", f"""WITH t AS (SELECT s_suppkey, {_pick_sql(KINDS, "s_suppkey")} AS k, [' b ', '', s_name, '  ', 'c', 'd'] AS l FROM supplier), f AS (SELECT *, list_filter(list_transform(l, lambda x: trim(x)), lambda x: x <> '') AS g FROM t)
SELECT s_suppkey, CASE WHEN lower(trim(k)) IN ('manual', 'apresentacao') THEN lower(trim(k)) ELSE 'outro' END AS kind, array_to_string(CASE WHEN s_suppkey % 2 = 0 THEN g[1:3] ELSE ['geral'] END, '|') AS subjects, sha256(s_suppkey::VARCHAR) AS digest FROM f""")
def q73(spark, d):
    k = F.col("s_suppkey")
    values = F.when(k % 2 == 0, F.array(F.lit(" b "), F.lit(""), F.col("s_name"), F.lit("  "), F.lit("c"), F.lit("d"))).otherwise(F.array(F.lit(" ")))
    return T.read(spark, d, "supplier").select("s_suppkey", X.one_of(_pick(KINDS, k), ("manual", "apresentacao"), "outro").alias("kind"), F.array_join(X.clean_list(values, 3), "|").alias("subjects"), X.sha256(k.cast("string")).alias("digest"))


# ---------------------------------------------------------------- hits and filters

@query("q74_api_hits", f"WITH {CHUNKS_SQL} SELECT id AS query_id, CAST(1 AS INTEGER) AS final_rank, 0.5::DOUBLE AS score, id, documento, pagina, CASE WHEN id % 7 = 0 THEN 'geral' ELSE area END AS area, array_to_string(assuntos, '|') AS assuntos, doc_titulo, doc_ano, content_type, FALSE AS ocr_usado, CAST(NULL AS INTEGER) AS table_index, CAST(length(texto) AS INTEGER) AS chars FROM chunks")
def q74(spark, d):
    c = T.chunks(spark, d).withColumn("area", F.when(F.col("id") % 7 != 0, F.col("area")))
    best = c.select("id", F.col("id").alias("query_id"), F.lit(1).alias("final_rank"), F.lit(0.5).alias("score"))
    found = search.api_hits(search.hits(best, c.drop("content_type").join(c.select("id", "content_type"), "id")))
    return found.select("query_id", "final_rank", "score", "id", "documento", "pagina", "area", joined("assuntos"), "doc_titulo", "doc_ano", "content_type", "ocr_usado", "table_index", F.length("texto").alias("chars"))


@query("q75_vector_filter", f"WITH {CHUNKS_SQL} SELECT id, 'folded' AS side FROM chunks WHERE lower(trim(CASE WHEN id % 2 = 0 THEN upper(area) ELSE area END)) IN ('en', 'fr') UNION ALL SELECT id, 'stored' FROM chunks WHERE CASE WHEN id % 2 = 0 THEN upper(area) ELSE area END IN ('en', 'fr') AND list_has_any(assuntos, ['en'])")
def q75(spark, d):
    c = T.chunks(spark, d).withColumn("area", F.when(F.col("id") % 2 == 0, F.upper("area")).otherwise(F.col("area")))
    folded = search.eligible(c, [" EN ", "fr", " "]).select("id", F.lit("folded").alias("side"))
    return folded.unionByName(search.eligible(c, [" EN ", "fr"], ["EN"], fold_column=False).select("id", F.lit("stored").alias("side")))


@query(
    "q76_rerank",
    f"""WITH {CHUNKS_SQL}, f AS (SELECT id % 40 AS query_id, id, texto, row_number() OVER (PARTITION BY id % 40 ORDER BY id) AS r FROM chunks), s AS (SELECT *, CAST(length(left(texto, 1200)) AS DOUBLE) AS s FROM f WHERE r <= 20)
SELECT query_id, id, s AS rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, r) AS fused_rank FROM s""",
)
def q76(spark, d):
    """The reranker's place in the plan, with a text's length as its score."""
    c = T.chunks(spark, d).select((F.col("id") % 40).alias("query_id"), "id", "texto")
    ranked = c.withColumn("fused_rank", F.row_number().over(W.partitionBy("query_id").orderBy("id"))).withColumn("query", F.lit("q"))
    out = search.rerank(ranked, lambda q, t: F.length(t).cast("double"), 20)
    return out.select("query_id", "id", "rerank_score", F.col("fused_rank").cast("long").alias("fused_rank"))


# ---------------------------------------------------------------- library and uploads

@query("q77_library_index", "WITH l AS (SELECT 'd' || o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'docs/' ELSE 'uploads/' END || 'f' || (o_orderkey % 500) || '.pdf' AS path, o_orderkey AS ordinal FROM orders), k AS (SELECT path AS key, id, ordinal FROM l UNION ALL SELECT string_split(path, '/')[2], id, ordinal FROM l) SELECT key, arg_max(id, ordinal) AS id FROM k GROUP BY 1")
def q77(spark, d):
    k = F.col("o_orderkey")
    path = F.concat(F.when(k % 2 == 0, "docs/").otherwise("uploads/"), F.lit("f"), (k % 500).cast("string"), F.lit(".pdf"))
    return library.library_index(T.read(spark, d, "orders").select(F.concat(F.lit("d"), k.cast("string")).alias("id"), path.alias("documento_original"), k.alias("ordinal")))


@query("q78_library_summary", "SELECT 'd' || c_custkey AS id, c_name AS titulo, '' AS autores, CAST(NULL AS INTEGER) AS ano, CASE WHEN c_custkey % 2 = 0 THEN 'saude' ELSE 'geral' END AS area, '' AS assuntos, 'outro' AS tipo, CAST(0 AS INTEGER) AS paginas_total FROM customer")
def q78(spark, d):
    k = F.col("c_custkey")
    lib = T.read(spark, d, "customer").select(F.concat(F.lit("d"), k.cast("string")).alias("id"), F.col("c_name").alias("titulo"), F.when(k % 2 == 0, "saude").alias("area"))
    return library.library_summary(lib).select("id", "titulo", joined("autores"), "ano", "area", joined("assuntos"), "tipo", "paginas_total")


STATUSES = ("quarantined_pending_approval", "quarantined_suspicious", "approved_pending_index", " quarantined_x", "rejected_size")
UPLOADS_SQL = f"""u AS (SELECT 'uploads/quarantine/f' || s_suppkey || '.pdf' AS key, CASE WHEN s_suppkey % 3 <> 0 THEN 'g' || s_suppkey || '.pdf' END AS stored_filename, {_pick_sql(STATUSES, "s_suppkey")} AS status, CASE WHEN s_suppkey % 7 = 0 THEN 'uploads/quarantine/../x.pdf' WHEN s_suppkey % 5 = 0 THEN '' END AS quarantine_path, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE lpad(CAST(s_suppkey % 90 AS VARCHAR), 4, '0') END AS uploaded_at, s_suppkey AS ordinal FROM supplier),
o AS (SELECT *, coalesce(stored_filename, 'f' || ordinal || '.pdf') AS own FROM u), fs AS (SELECT own AS f FROM o WHERE ordinal % 2 = 0)"""


def _uploads(spark, d):
    k = F.col("s_suppkey")
    u = T.read(spark, d, "supplier").select(
        F.concat(F.lit("uploads/quarantine/f"), k.cast("string"), F.lit(".pdf")).alias("key"), F.when(k % 3 != 0, F.concat(F.lit("g"), k.cast("string"), F.lit(".pdf"))).alias("stored_filename"), _pick(STATUSES, k).alias("status"), F.when(k % 7 == 0, "uploads/quarantine/../x.pdf").when(k % 5 == 0, "").alias("quarantine_path"),
        F.when(k % 4 != 0, F.lpad((k % 90).cast("string"), 4, "0")).alias("uploaded_at"), k.alias("ordinal"), F.lit(None).cast("string").alias("area"),
    )
    files = u.where("ordinal % 2 = 0").select(F.coalesce("stored_filename", X.base_name("key")).alias("stored_filename"))
    return u, files


@query(
    "q79_quarantine",
    f"""WITH {UPLOADS_SQL} SELECT row_number() OVER (ORDER BY uploaded_at DESC NULLS LAST, key) AS place, key AS documento, own AS stored_filename, trim(status) AS status, 'geral' AS area, uploaded_at, coalesce(nullif(quarantine_path, ''), 'uploads/quarantine/' || own) AS quarantine_path, own IN (SELECT f FROM fs) AS file_exists FROM o WHERE starts_with(trim(status), 'quarantined_')""",
)
def q79(spark, d):
    shown = library.quarantine_list(*_uploads(spark, d))
    return shown.select(F.row_number().over(W.orderBy(F.desc_nulls_last("uploaded_at"), "documento")).cast("long").alias("place"), "*")


@query(
    "q80_approvals",
    f"""WITH {UPLOADS_SQL}, n AS (SELECT ' dir/g' || s_suppkey || '.pdf ' AS filename FROM supplier UNION ALL SELECT 'f' || s_suppkey || '.pdf' FROM supplier UNION ALL SELECT '  ' UNION ALL SELECT 'nobody.pdf'),
c AS (SELECT filename, trim(string_split(trim(filename), '/')[-1]) AS name FROM n), k AS (SELECT own AS name, * FROM o UNION ALL SELECT 'f' || ordinal || '.pdf', * FROM o WHERE stored_filename IS NOT NULL),
j AS (SELECT c.filename, c.name, k.key, k.status, coalesce(nullif(k.quarantine_path, ''), 'uploads/quarantine/' || c.name) AS p FROM c LEFT JOIN k USING (name)),
d AS (SELECT filename, name, key, CASE WHEN name = '' THEN 422 WHEN key IS NULL THEN 404 WHEN NOT starts_with(trim(status), 'quarantined_') THEN 409 WHEN contains(p, '/../') THEN 400 WHEN name NOT IN (SELECT f FROM fs) THEN 404 ELSE 200 END AS code FROM j)
SELECT filename, CAST(code AS INTEGER) AS code, key, CASE WHEN code = 200 THEN 'uploads/approved/' || name END AS approved_path FROM d""",
)
def q80(spark, d):
    u, files = _uploads(spark, d)
    k = F.col("ordinal").cast("string")
    names = u.select(F.concat(F.lit(" dir/g"), k, F.lit(".pdf ")).alias("filename")).unionByName(u.select(F.concat(F.lit("f"), k, F.lit(".pdf")).alias("filename"))).unionByName(spark.createDataFrame([("  ",), ("nobody.pdf",)], "filename string"))
    return library.approval(u, files, names)


@query(
    "q81_approved_uploads",
    f"""WITH {UPLOADS_SQL}, a AS (SELECT *, starts_with(trim(status), 'quarantined_') AND NOT contains(coalesce(quarantine_path, ''), '/../') AND own IN (SELECT f FROM fs) AS ok FROM o)
SELECT CASE WHEN ok THEN 'uploads/approved/' || own ELSE key END AS key, CASE WHEN ok THEN 'approved_pending_index' ELSE status END AS status, CASE WHEN NOT ok THEN quarantine_path END AS quarantine_path, ordinal FROM a""",
)
def q81(spark, d):
    u, files = _uploads(spark, d)
    names = u.select(F.coalesce("stored_filename", X.base_name("key")).alias("filename"))
    return library.approved(u, library.approval(u, files, names)).select("key", "status", "quarantine_path", "ordinal")


@query(
    "q82_upload_upsert",
    """WITH o AS (SELECT 'uploads/' || s_suppkey || '.pdf' AS key, 'ia' AS area, ['a'] AS assuntos, s_name AS nome FROM supplier), n AS (SELECT 'uploads/' || (s_suppkey * 2) || '.pdf' AS key, 'saude' AS area, CASE WHEN s_suppkey % 2 = 0 THEN ['b', 'c'] ELSE ['geral'] END AS assuntos, 'pendente' AS status FROM supplier)
SELECT coalesce(n.key, o.key) AS key, coalesce(n.area, o.area) AS area, array_to_string(coalesce(n.assuntos, o.assuntos), '|') AS assuntos, nome, status FROM o FULL JOIN n ON o.key = n.key""",
)
def q82(spark, d):
    s, k = T.read(spark, d, "supplier"), F.col("s_suppkey")
    old = s.select(F.concat(F.lit("uploads/"), k.cast("string"), F.lit(".pdf")).alias("key"), F.lit("ia").alias("area"), F.array(F.lit("a")).alias("assuntos"), F.col("s_name").alias("nome"))
    new = s.select(F.concat(F.lit("x\\"), (k * 2).cast("string"), F.lit(".pdf")).alias("key"), F.lit("saude").alias("area"), F.when(k % 2 == 0, F.array(F.lit(" b"), F.lit(""), F.lit("c "))).otherwise(F.array(F.lit(" "))).alias("assuntos"), F.lit("pendente").alias("status"))
    return library.upload_upsert(old, new).select("key", "area", joined("assuntos"), "nome", "status")


@query("q83_solution_inventory", f"WITH {CHUNKS_SQL}, c AS (SELECT id, CASE WHEN id % 6 = 0 THEN '' ELSE documento END AS documento, doc_titulo FROM chunks) SELECT coalesce(nullif(documento, ''), 'solucoes_piloto.json') AS documento, count(*) AS chunks, coalesce(arg_min(doc_titulo, CASE WHEN doc_titulo <> '' THEN id END), '') AS titulo FROM c GROUP BY 1")
def q83(spark, d):
    return library.solution_inventory(T.chunks(spark, d).withColumn("documento", F.when(F.col("id") % 6 == 0, "").otherwise(F.col("documento"))))


@query("q84_listed_inventory", f"WITH {CHUNKS_SQL}, i AS (SELECT documento, count(*) AS chunks FROM chunks GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY lower(documento), documento) AS n, count(*) OVER () AS total FROM i) SELECT CAST(n AS INTEGER) AS number, documento, chunks, greatest(0, total - 50) AS hidden FROM r WHERE n <= 50")
def q84(spark, d):
    return library.listed(T.chunks(spark, d).groupBy("documento").agg(F.count("*").alias("chunks"))).select("number", "documento", "chunks", "hidden")


# ---------------------------------------------------------------- chunks with metadata

@query(
    "q85_chunks_with_metadata",
    rf"""WITH RECURSIVE {RUNS_SQL}, g AS (SELECT documento, page, run, arg_min(tipo, pos) AS kind, string_agg(texto, chr(10) ORDER BY pos) AS raw FROM r WHERE tipo <> 'section' GROUP BY documento, page, run),
t AS (SELECT documento, page, run, kind, CASE WHEN kind = 'table' THEN trim(raw) ELSE {CLEAN_SQL.format("raw")} END AS texto FROM g),
w AS (SELECT documento, page, run, list_filter(regexp_split_to_array(texto, '\s+'), lambda x: x <> '') AS w, kind FROM t), p AS (SELECT * FROM w WHERE len(w) >= CASE WHEN kind = 'table' THEN 3 ELSE 20 END),
{chunker_sql("p", "documento, page, run", 300, 35)},
n AS (SELECT documento, count(*) AS chunks, sum(len(string_split(c, ' '))) AS words FROM kids WHERE len(string_split(c, ' ')) >= 3 GROUP BY 1), k AS (SELECT *, CAST(documento AS BIGINT) AS d FROM n)
SELECT documento, chunks, CAST(words AS BIGINT) AS words, CASE WHEN d % 2 = 0 THEN 'up' WHEN d % 3 = 0 THEN 'lib' WHEN d % 5 = 0 THEN 'man' ELSE 'geral' END AS area, CASE WHEN d % 3 = 0 THEN 'Livro ' || d ELSE '' END AS doc_titulo, CASE WHEN d % 3 = 0 THEN CAST(2000 AS INTEGER) END AS doc_ano FROM k""",
)
def q85(spark, d):
    ids = T.read(spark, d, "documents").select(F.col("doc_id").alias("k"), F.col("doc_id").cast("string").alias("name"))
    side = lambda where, key, area: ids.where(where).select(key.alias("key"), F.lit(area).alias("area"), F.array(F.lit("s")).alias("assuntos"), F.concat(F.lit("Livro "), "name").alias("titulo"), F.array(F.lit("Ana")).alias("autores"), F.lit(2000).alias("ano"))
    chunks, _ = structure.chunked(T.elements(spark, d), side("k % 2 = 0", F.concat(F.lit("uploads/"), "name"), "up"), side("k % 3 = 0", F.col("name"), "lib"), side("k % 5 = 0", F.col("name"), "man"))
    return chunks.groupBy("documento", "area", "doc_titulo", "doc_ano").agg(F.count("*").alias("chunks"), F.sum("num_palavras").cast("long").alias("words"))


# ---------------------------------------------------------------- answers

@query(
    "q86_prompts",
    f"""WITH s AS (SELECT s_suppkey AS k, s_name AS q, CASE WHEN s_suppkey % 3 = 0 THEN 'trecho' ELSE '{answer.SOLUTIONS_HEADING}' || chr(10) || CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'Nenhuma solucao candidata.' END || chr(10) || chr(10) || '{answer.EVIDENCE_HEADING}' || chr(10) || 'Nenhuma evidencia documental.' END AS c, CASE WHEN s_suppkey % 4 = 0 THEN 'antes' WHEN s_suppkey % 4 = 1 THEN '' END AS h FROM supplier)
SELECT k AS s_suppkey, md5('SYS' || CASE WHEN contains(c, '{answer.SOLUTIONS_HEADING}') THEN chr(10) || chr(10) || 'REGRAS' || chr(10) || 'Mensagem conservadora: {answer.NO_SOLUTION}' ELSE '' END || chr(10) || chr(10) || CASE WHEN h <> '' THEN '--- HISTORICO DE CONVERSA ---' || chr(10) || h || chr(10) || chr(10) ELSE '' END || '--- CONTEXTO FORNECIDO ---' || chr(10) || c || chr(10) || chr(10) || '--- PERGUNTA ---' || chr(10) || q || chr(10) || chr(10) || '--- RESPOSTA ---' || chr(10)) AS prompt_md5 FROM s""",
)
def q86(spark, d):
    k = F.col("s_suppkey")
    context = F.when(k % 3 == 0, "trecho").otherwise(answer.diagnostic_context(F.when(k % 2 == 0, F.col("s_name")).otherwise(""), F.lit(None).cast("string")))
    past = F.when(k % 4 == 0, "antes").when(k % 4 == 1, "")
    return T.read(spark, d, "supplier").select("s_suppkey", answer.build_prompt("SYS", "REGRAS", F.col("s_name"), context, past).alias("prompt")).select("s_suppkey", _md5("prompt"))


@query(
    "q87_failure_answer",
    f"""WITH {CHUNKS_SQL}, r AS (SELECT *, id // 10 AS query_id, id % 10 + 1 AS r, trim(replace(trim(texto, ' '), chr(10), ' '), ' ') AS one FROM chunks), b AS (SELECT query_id, string_agg('- ' || CASE WHEN length(one) > 240 THEN rtrim(left(one, 240), ' ') || '...' ELSE one END || ' (' || {CITE_SQL} || ') - ' || documento || ' (p. ' || pagina || ')', chr(10) ORDER BY r) AS b FROM r WHERE r <= 3 AND trim(texto, ' ') <> '' GROUP BY 1), q AS (SELECT DISTINCT query_id FROM r UNION SELECT -1)
SELECT query_id, md5(coalesce('{answer.GROUNDED}' || chr(10) || chr(10) || b || chr(10) || chr(10) || 'Pergunta original: Q' || chr(10) || 'Observacao tecnica: a geracao pelo modelo local falhou (timeout).', 'Nao foi possivel consultar o modelo local e tambem nao ha trechos suficientes para gerar um resumo de fallback.')) AS answer_md5 FROM q LEFT JOIN b USING (query_id)""",
)
def q87(spark, d):
    hits = T.chunks(spark, d).withColumn("query_id", F.floor(F.col("id") / 10).cast("long")).withColumn("final_rank", F.col("id") % 10 + 1).withColumn("parent_text", F.lit(""))
    questions = hits.select("query_id").distinct().unionByName(spark.createDataFrame([(-1,)], "query_id long")).withColumn("query", F.lit("Q"))
    return answer.failure_answer(hits, questions, "timeout").select("query_id", _md5("answer"))


@query(
    "q88_faithful",
    r"""WITH s AS (SELECT conv_id, turn, role, text, list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: len(list_filter(regexp_split_to_array(x, '\s+'), lambda w: w <> '')) >= 5) AS c FROM conversations)
SELECT conv_id * 1000 + turn AS query_id, bool_and(len(list_filter(c, lambda x: length(x) % 3 = 0 OR length(x) % 3 = 2)) = 0) AS faithful FROM s GROUP BY 1""",
)
def q88(spark, d):
    """Claims judged by a classifier's logits; here they depend on a claim's length."""
    logits = lambda t: F.array(*[F.when(F.length(t) % 3 == i, 2.0).otherwise(0.5) for i in range(3)])
    a = T.read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.lit("").alias("context"), F.col("text").alias("answer"))
    return answer.faithful(a, lambda context, claim: answer.entailed(logits(claim)))


OUTCOMES = ("generated", "no_solution", "no_evidence", "generated", "no_evidence_with_sources")


@query(
    "q89_events",
    f"""WITH a AS (SELECT s_suppkey AS k, {_pick_sql(OUTCOMES, "s_suppkey")} AS o, s_suppkey % 2 = 0 AS f, s_suppkey % 15 = 0 AS err, s_name AS n FROM supplier),
c AS (SELECT *, CASE WHEN o = 'no_solution' THEN '{answer.NO_SOLUTION}' WHEN starts_with(o, 'no_evidence') THEN '{answer.NO_EVIDENCE}' END AS canned FROM a), t AS (SELECT *, CASE WHEN canned IS NULL THEN string_split('Uma resposta de ' || n, ' ') ELSE [canned] END AS w FROM c),
e AS (SELECT k, 0 AS seq, 'metadata' AS type, CASE WHEN canned IS NULL THEN 'P ' || n ELSE '' END AS text, k % 3 AS n_results, coalesce(o = 'no_solution', FALSE) AS diagnostic FROM t UNION ALL SELECT k, i, 'token', w[i] || CASE WHEN i < len(w) THEN ' ' ELSE '' END, NULL, NULL FROM (SELECT k, w, unnest(range(1, len(w) + 1)) AS i FROM t)
 UNION ALL SELECT k, len(w) + 1, 'faithfulness', CASE WHEN f THEN '' ELSE 'F' END, NULL, NULL FROM t WHERE canned IS NULL AND NOT err UNION ALL SELECT k, len(w) + 1, 'error', 'caiu', NULL, NULL FROM t WHERE canned IS NULL AND err)
SELECT k AS query_id, CAST(seq AS INTEGER) AS seq, type, text, CAST(n_results AS INTEGER) AS n_results, diagnostic FROM e""",
)
def q89(spark, d):
    k = F.col("s_suppkey")
    results = F.transform(F.slice(F.array(F.lit(0), F.lit(1)), F.lit(1), (k % 3).cast("int")), lambda i: F.struct(i.alias("id"), F.col("s_name").alias("documento"), F.lit(0.5).alias("score")))
    a = T.read(spark, d, "supplier").select(
        k.alias("query_id"), _pick(OUTCOMES, k).alias("outcome"), results.alias("results"), F.concat(F.lit("P "), "s_name").alias("prompt"), F.concat(F.lit("Uma resposta de "), "s_name").alias("answer"), (k % 2 == 0).alias("faithful"), F.lit("F").alias("fallback"), F.when(k % 15 == 0, "caiu").alias("error")
    )
    e = answer.events(a, check=True)
    v = F.from_json("event", "type string, prompt string, token string, fallback_response string, message string, resultados array<struct<id: int>>, diagnostic_mode boolean")
    shown = e.select("query_id", "seq", v.alias("v"))
    return shown.select("query_id", "seq", "v.type", F.coalesce("v.prompt", "v.token", "v.fallback_response", "v.message", F.lit("")).alias("text"), F.when(F.col("v.type") == "metadata", F.size("v.resultados")).alias("n_results"), F.col("v.diagnostic_mode").alias("diagnostic"))


# ---------------------------------------------------------------- evaluation and requests

@query("q90_numeric_means", "SELECT round(avg(l_quantity), 6) AS l_quantity, round(avg(l_discount), 6) AS l_discount, round(avg(l_tax), 6) AS l_tax FROM lineitem")
def q90(spark, d):
    m = evaluation.numeric_means(T.read(spark, d, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_returnflag"))
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@query("q91_requests", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'blank query' WHEN o_orderkey % 23 NOT BETWEEN 1 AND 20 THEN 'top_k outside 1..20' END AS refused, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 503 WHEN o_orderkey % 3 = 1 THEN 502 ELSE 500 END AS INTEGER) AS code FROM orders")
def q91(spark, d):
    k = F.col("o_orderkey")
    return T.read(spark, d, "orders").select("o_orderkey", validation.bounded_request(F.when(k % 5 != 0, "q").otherwise("  "), k % 23).alias("refused"), answer.error_code(_pick(("index", "llm", "x"), k)).alias("code"))


@query(
    "q92_solution_text",
    """SELECT s_suppkey, md5('Nome: ' || s_name || chr(10) || 'Descricao: ' || coalesce(s_name || ' d', '') || chr(10) || 'Orgao: ' || chr(10) || 'Area: ia' || chr(10) || 'Problema: p' || chr(10) || 'Sintomas: a, ' || s_name || chr(10) || 'Causa raiz: c' || chr(10) || 'Pre-condicoes: ' || chr(10) || 'Solucao: s' || chr(10) || 'Passos de implantacao: x' || chr(10) || 'Riscos: ' || chr(10) || 'Tecnologias: sql, spark' || chr(10) || 'Status: piloto' || chr(10) || 'Dados pessoais: nao' || chr(10) || 'Base legal LGPD: b' || chr(10) || 'Hospedagem: local' || chr(10) || 'Modelo: m' || chr(10) || 'Licenca do modelo: l' || chr(10) || 'Dependencias open-source: spark') AS t_md5 FROM supplier""",
)
def q92(spark, d):
    many = lambda *v: F.array(*[F.lit(x) if isinstance(x, str) else x for x in v])
    none = F.lit(None).cast("array<string>")
    c = T.read(spark, d, "supplier").select(
        "s_suppkey", F.col("s_name").alias("nome"), F.concat("s_name", F.lit(" d")).alias("descricao"), F.lit(None).cast("string").alias("orgao"), F.lit("ia").alias("area"), F.lit("p").alias("problema"), many("a", F.col("s_name")).alias("sintomas"), F.lit("c").alias("causa_raiz"), none.alias("pre_condicoes"),
        F.lit("s").alias("solucao"), many("x").alias("passos_implantacao"), F.array().cast("array<string>").alias("riscos"), many("sql", "spark").alias("tecnologias"), F.lit("piloto").alias("status"),
        F.struct(F.lit("nao").alias("dados_pessoais"), F.lit("b").alias("base_legal_lgpd"), F.lit("local").alias("hospedagem"), F.lit("m").alias("modelo"), F.lit("l").alias("licenca_modelo"), many("spark").alias("dependencias_open_source")).alias("conformidade"),
    )
    return c.select("s_suppkey", validation.solution_text().alias("t")).select("s_suppkey", _md5("t"))


PATHS, KEYS = ("/search", "/", "/admin/quarantine", "/upload", "/web/app.js", "/biblioteca"), ("r", "", "a", None, "x")


@query(
    "q93_access",
    f"""WITH RECURSIVE q AS (SELECT event_id AS request_id, ts, event_type AS client, {_pick_sql(PATHS, "event_id")} AS path, coalesce({_pick_sql(KEYS, "(event_id // 6)")}, '') AS key, event_id % 29 = 0 AS options FROM events),
j AS (SELECT *, CASE WHEN options OR path IN ('/') OR starts_with(path, '/web') THEN 200 WHEN path IN ('/upload') OR starts_with(path, '/admin/') THEN CASE WHEN key = 'a' THEN NULL WHEN key <> '' THEN 403 ELSE 401 END WHEN key NOT IN ('r', 'a') THEN 401 END AS code FROM q),
e AS (SELECT client, request_id, epoch_us(ts) / 1e6::DOUBLE AS t, row_number() OVER (PARTITION BY client ORDER BY ts, request_id) AS n FROM j WHERE code IS NULL),
s AS (SELECT client, request_id, n, TRUE AS accepted, [t] AS held FROM e WHERE n = 1
 UNION ALL SELECT e.client, e.request_id, e.n, len(list_filter(s.held, lambda x: e.t - x <= 600)) < 3, CASE WHEN len(list_filter(s.held, lambda x: e.t - x <= 600)) < 3 THEN list_append(list_filter(s.held, lambda x: e.t - x <= 600), e.t) ELSE list_filter(s.held, lambda x: e.t - x <= 600) END FROM s JOIN e ON e.client = s.client AND e.n = s.n + 1)
SELECT request_id, CAST(code AS INTEGER) AS code FROM j WHERE code IS NOT NULL UNION ALL SELECT request_id, CAST(CASE WHEN accepted THEN 200 ELSE 429 END AS INTEGER) FROM s""",
)
def q93(spark, d):
    k = F.col("event_id")
    requests = T.read(spark, d, "events").select(k.alias("request_id"), "ts", F.col("event_type").alias("client"), _pick(PATHS, k).alias("path"), _pick(KEYS, F.floor(k / 6)).alias("key"), F.when(k % 29 == 0, "OPTIONS").otherwise("GET").alias("method"))
    return limits.access(requests, "r", "a", 600.0, 3)
