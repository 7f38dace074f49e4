"""Rank fusion, deduplication and the composed search."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..options import Options
from . import classify, dense, numbering, sparse

# Defaults of a hit's fields.
HIT_DEFAULTS = {"documento": "desconhecido", "area": "geral", "content_type": "text"}
COLLECTIONS = {"documentos": 0, "solucoes": 1}


def rrf(rankings: list[tuple[DataFrame, str]], k: int = 60) -> DataFrame:
    """(query_id, id, rrf_score): sum over rankings of 1 / (k + rank), ranks from 1."""
    parts = [r.select("query_id", "id", (F.lit(1.0) / (F.lit(float(k)) + F.col(rank))).alias("s")) for r, rank in rankings]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("query_id", "id").agg(F.sum("s").alias("rrf_score"))


def fuse(dense_ranked: DataFrame, sparse_ranked: DataFrame, k: int = 60) -> DataFrame:
    """Both rankings fused, one row a pair, ordered by ``fused_rank``; ties in dense, then sparse order."""
    d = dense_ranked.select("query_id", "id", "dense_score", "dense_rank")
    s = sparse_ranked.select("query_id", "id", "sparse_score", "sparse_rank")
    part = lambda r: F.coalesce(F.lit(1.0) / (F.lit(float(k)) + F.col(r)), F.lit(0.0))
    both = d.join(s, ["query_id", "id"], "full_outer").withColumn("rrf_score", part("dense_rank") + part("sparse_rank"))
    order = W.partitionBy("query_id").orderBy(F.desc("rrf_score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank"), "id")
    return both.withColumn("fused_rank", F.row_number().over(order))


def dedupe_by_parent(ranked: DataFrame, k: int | None, rank: str, by: str = "query_id", parent: str = "parent_id") -> DataFrame:
    """Of each parent its best-ranked chunk (a chunk without one stands for itself); the k best, ranked from 1 as ``final_rank``.

    Without a ``k`` all are kept and ranked, of groups of any size.
    """
    key = F.coalesce(F.when(F.col(parent) != "", F.col(parent)), F.concat(F.lit("chunk-"), F.col("id").cast("string")))
    if k is None:
        best = ranked.groupBy(F.col(by).alias("_by"), key.alias("_key")).agg(F.min_by(F.struct(*ranked.columns), F.struct(rank, "id")).alias("_x")).select("_x.*")
        return numbering.ranked(best, [by], F.col(rank), F.col("id"), column="final_rank")
    first = ranked.withColumn("_key", key).withColumn("_n", F.row_number().over(W.partitionBy(by, "_key").orderBy(rank, "id"))).where("_n = 1").drop("_n", "_key")
    return first.withColumn("final_rank", F.row_number().over(W.partitionBy(by).orderBy(rank, "id"))).where(F.col("final_rank") <= k)


def eligible(chunks: DataFrame, areas=(), subjects=(), fold_column: bool = True) -> DataFrame:
    """Chunks of any of the areas and with any of the subjects; blank values don't filter.

    Both sides are lower-cased and trimmed; with ``fold_column`` off only the
    query's side is, and stored values are compared as they are.
    """
    wanted = lambda v: sorted({x.strip().lower() for x in ([v] if isinstance(v, str) else v or ()) if x and x.strip()})
    norm = (lambda c: F.lower(F.trim(c))) if fold_column else (lambda c: c)
    out = chunks
    if a := wanted(areas):
        out = out.where(norm(F.col("area")).isin(*a))
    if s := wanted(subjects):
        out = out.where(F.arrays_overlap(F.transform("assuntos", norm), F.array(*map(F.lit, s))))
    return out


def rerank(ranked: DataFrame, scorer: Callable[[Column, Column], Column] | None, candidates: int, rank: str = "fused_rank", text_chars: int = 1200) -> DataFrame:
    """The first candidates in the scorer's order (a column function of query and text); as they are without one.

    The limit comes before the scorer, which is the expensive step.
    """
    pool = ranked.where(F.col(rank) <= candidates)
    if scorer is None:
        return pool.withColumn("rerank_score", F.lit(None).cast("double"))
    scored = pool.withColumn("rerank_score", scorer(F.col("query"), F.substring("texto", 1, text_chars)))
    return scored.withColumn(rank, F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("rerank_score"), rank)))


def plans_of(queries: DataFrame, areas=(), subjects=()) -> DataFrame:
    """(query_id, filtro_area, filtro_assunto) read from each query; given filters are never overridden."""
    p = queries.select("query_id", classify.plan_query("query").alias("p"))
    none = F.lit(None).cast("string")
    return p.select("query_id", (none if areas else F.col("p.filtro_area")).alias("filtro_area"), (none if subjects else F.col("p.filtro_assunto")).alias("filtro_assunto"))


def restricted(scored: DataFrame, chunks: DataFrame, plans: DataFrame) -> DataFrame:
    """Scored pairs whose chunk has the area and the subject that its query's plan names."""
    norm = lambda c: F.lower(F.trim(c))
    j = scored.join(chunks.select("id", norm("area").alias("_a"), F.transform("assuntos", norm).alias("_s")), "id").join(plans, "query_id")
    ok = (F.col("filtro_area").isNull() | (F.col("_a") == F.col("filtro_area"))) & (F.col("filtro_assunto").isNull() | F.array_contains("_s", F.col("filtro_assunto")))
    return j.where(ok).select(*scored.columns)


def search(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, options: Options = Options(), areas=(), subjects=(), scorer=None) -> DataFrame:
    """Hybrid search of ``queries(query_id, query, vector)`` over ``chunks(id, texto, area, assuntos, parent_id, ...)``.

    Filters first, then dense and sparse candidates, fusion, an optional
    reranker over a bounded pool and one chunk a parent.  Statistics are those
    of all chunks.  Payload columns are joined to the few final ids.
    """
    k = options.top_k
    live = queries.where(F.trim(F.coalesce("query", F.lit(""))) != "")
    allowed = eligible(chunks, areas, subjects).select("id") if areas or subjects else None
    n_dense, n_sparse = max(4 * k, options.dense_candidates), max(6 * k, options.sparse_candidates)
    asked = live.select("query_id", "vector")
    by_term = sparse.scores(chunks.select("id", "texto"), live.select("query_id", "query"), options.k1, options.b, allowed).where("sparse_score > 0")
    if options.query_planning:
        plans = plans_of(live, areas, subjects)
        near = vectors.join(allowed, "id", "left_semi") if allowed is not None else vectors
        by_term = restricted(by_term, chunks, plans)
        d = dense.planned_top(near, chunks, asked.join(plans, "query_id"), n_dense)
    else:
        d = dense.dense_top(vectors, asked, n_dense, allowed)
    s = sparse.top(by_term, "sparse_score", n_sparse, "sparse_rank")
    pool = max(3 * k, options.reranker_candidates if scorer else k)
    fused = fuse(d, s, options.rrf_k).where(F.col("fused_rank") <= pool)
    held = fused.join(chunks.select("id", "parent_id", *(["texto"] if scorer else [])), "id")
    if scorer:
        held = held.join(live.select("query_id", "query"), "query_id")
    ranked = rerank(held, scorer, pool).drop("texto", "query")
    best = dedupe_by_parent(ranked, k, "fused_rank")
    score = F.coalesce("rerank_score", "rrf_score", "dense_score")
    return best.withColumn("score", score)


def merge_collections(hits: DataFrame, k: int) -> DataFrame:
    """Hits of several collections (``query_id, id, score, collection, rank``) as one ranking; nothing is deduplicated."""
    place = F.coalesce(*[F.when(F.col("collection") == c, F.lit(n)) for c, n in COLLECTIONS.items()], F.lit(len(COLLECTIONS)))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), place, "rank", "id")
    return hits.withColumn("merged_rank", F.row_number().over(w)).where(F.col("merged_rank") <= max(1, int(k)))


def retrieve_for_answer(questions: DataFrame, documents: DataFrame, solutions: DataFrame, options: Options = Options(), rank: str = "final_rank") -> DataFrame:
    """What an answer is built from: hits of either domain (``query_id, final_rank, ...``), tagged and in order.

    A diagnostic question gets solutions first, then documents, each up to the
    context's size; any other gets documents only.
    """
    most = min(options.top_k + 1, options.max_context_chunks, options.reranker_top_n)
    asked = questions.select("query_id", classify.is_diagnostic("query").alias("diagnostic"))
    part = lambda hits, domain, place: hits.where(F.col(rank) <= most).join(asked, "query_id").withColumn("retrieval_domain", F.lit(domain)).withColumn("_place", F.lit(place))
    both = part(solutions, "solucoes", 0).where("diagnostic").unionByName(part(documents, "documentos", 1), allowMissingColumns=True)
    w = W.partitionBy("query_id").orderBy("_place", rank)
    return both.withColumn("_r", F.row_number().over(w)).drop(rank, "_place").withColumnRenamed("_r", rank)


def hits(best: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ranked ids with their chunks' fields, defaults for what is missing."""
    given = set(chunks.columns)
    fields = [F.coalesce(F.col(f"c.{c}"), F.lit(HIT_DEFAULTS[c])).alias(c) if c in HIT_DEFAULTS else F.col(f"c.{c}").alias(c) for c in chunks.columns if c != "id"]
    fields += [F.lit(v).alias(c) for c, v in HIT_DEFAULTS.items() if c not in given]
    return best.drop(*[c for c in chunks.columns if c != "id"]).alias("b").join(chunks.alias("c"), "id").select("b.*", *fields)


API_FIELDS = ("score", "id", "documento", "pagina", "area", "assuntos", "doc_titulo", "doc_autores", "doc_ano", "section_heading", "content_type", "parent_id", "ocr_usado", "table_index", "texto", "chunk_index")


# Types and defaults of the public fields.
API_TYPES = {
    "score": ("double", 0.0), "id": ("long", 0), "documento": ("string", "desconhecido"), "pagina": ("int", None), "area": ("string", "geral"), "assuntos": ("array<string>", ()), "doc_titulo": ("string", ""), "doc_autores": ("array<string>", ()),
    "doc_ano": ("int", None), "section_heading": ("string", None), "content_type": ("string", "text"), "parent_id": ("string", None), "ocr_usado": ("boolean", False), "table_index": ("int", None), "texto": ("string", ""), "chunk_index": ("int", None),
}


def api_hits(found: DataFrame) -> DataFrame:
    """The public fields, always of the same types, defaults where they are absent or null; component scores and parent texts stay inside."""

    def field(c: str) -> Column:
        kind, default = API_TYPES[c]
        value = F.col(c).cast(kind) if c in found.columns else F.lit(None).cast(kind)
        return (value if default is None else F.coalesce(value, (F.array() if default == () else F.lit(default)).cast(kind))).alias(c)

    return found.select("query_id", "final_rank", *map(field, API_FIELDS))


def responses(queries: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, total, response): each query's answer to a search request, ``{query, total, resultados}`` as JSON.

    ``found`` are hits as ``api_hits`` gives them, at most ``top_k`` a query; a
    query without any is answered as well.
    """
    fields = F.struct(*[F.col(c) for c in API_FIELDS])
    listed = found.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("final_rank", fields.alias("hit")))), lambda x: x["hit"]).alias("resultados"))
    j = queries.select("query_id", "query").join(listed, "query_id", "left")
    total = F.coalesce(F.size("resultados"), F.lit(0))
    body = F.struct("query", total.alias("total"), F.coalesce("resultados", F.array().cast(listed.schema["resultados"].dataType)).alias("resultados"))
    return j.select("query_id", total.alias("total"), F.to_json(body, {"ignoreNullFields": "false"}).alias("response"))


def search_domain(store, domain: str, queries: DataFrame, options: Options = Options(), **filters) -> DataFrame:
    """Hits in the collection of a public domain; ``store`` (``plans.store.Store``) loads it on first use, unknown domains are refused."""
    from ..plans.store import collection_of

    held = store.get(collection_of(domain))
    best = search(held["chunks"], held["vectors"], queries, options, **filters)
    return hits(best, held["chunks"]).withColumn("retrieval_domain", F.lit(domain))


def attach_parents(chunks: DataFrame, parents: DataFrame) -> DataFrame:
    """``parent_text`` from ``parents(parent_id, parent_text)`` where a chunk has none."""
    p = parents.select("parent_id", F.col("parent_text").alias("_parent"))
    own = F.col("parent_text") if "parent_text" in chunks.columns else F.lit(None).cast("string")
    return chunks.join(p, "parent_id", "left").withColumn("parent_text", F.coalesce(F.when(own != "", own), "_parent")).drop("_parent")


def lean_split(chunks: DataFrame, parents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks without parent texts, and parents with those that were only in chunks; given parents win."""
    inline = chunks.where("parent_id is not null and parent_text is not null and parent_text <> ''").groupBy("parent_id").agg(F.min_by("parent_text", "id").alias("parent_text"))
    return chunks.drop("parent_text"), parents.unionByName(inline.join(parents, "parent_id", "left_anti"))
