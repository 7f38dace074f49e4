"""Exhaustive cosine search of a set of query vectors against all vectors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from .sparse import top

#: Query vectors compared in one pass (a bounded broadcast); more are taken in further passes.
BLOCK = 2000


def _units(rows: DataFrame, id: str) -> DataFrame:
    """(id, v): vectors of length one; null and zero vectors drop out."""
    return rows.where("vector is not null").select(id, V.unit(F.col("vector")).alias("v")).where("v is not null")


def _blocks(queries: DataFrame, block: int) -> Iterator[tuple[int, DataFrame]]:
    """(dimensions, query vectors): at most about ``block`` queries at a time, of one length."""
    q = _units(queries, "query_id").withColumn("dims", F.size("v"))
    for dims, n in sorted(tuple(r) for r in q.groupBy("dims").count().collect()):
        parts = -(-n // block)
        for i in range(parts):
            yield dims, q.where((F.col("dims") == dims) & (F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i)).select("query_id", "v")


def scores(vectors: DataFrame, queries: DataFrame, block: int = BLOCK) -> DataFrame:
    """(query_id, id, dense_score) for every pair; ``vectors(id, vector)``, ``queries(query_id, vector)``.

    The queries are a stated set, held against all vectors: up to ``block`` of
    them travel to the vectors as one array; a larger set takes several passes.
    """
    unit, parts = _units(vectors, "id"), []
    for dims, some in _blocks(queries, block):
        packed = some.agg(F.collect_list(F.struct("query_id", F.col("v").alias("q"))).alias("qs"))
        each = unit.where(F.size("v") == dims).join(F.broadcast(packed)).select("id", "v", F.explode("qs").alias("x"))
        parts.append(each.select(F.col("x.query_id").alias("query_id"), "id", V.dot(F.col("v"), F.col("x.q")).alias("dense_score")))
    if not parts:
        return queries.limit(0).select("query_id").join(vectors.limit(0).select("id")).withColumn("dense_score", F.lit(0.0))
    return reduce(DataFrame.unionByName, parts)


def _nearest(held, k: int):
    """The k best of each query within a batch of vectors, by one matrix product."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = held.value
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            dots = v @ q.T
            order_of = np.argsort(np.array(b.column(0).to_pylist(), object), kind="stable")  # ties go by id
            rank = np.empty(len(order_of), np.int64)
            rank[order_of] = np.arange(len(order_of))
            picked = []
            for j in range(len(ids)):
                s = np.round(dots[:, j], 9)
                if len(s) > k:
                    near = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
                    near = near[np.lexsort((rank[near], -s[near]))[:k]]
                else:
                    near = np.arange(len(s))
                picked.append(near)
            rows, which = np.concatenate(picked), np.repeat(np.arange(len(ids)), [len(p) for p in picked])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(which)), b.column(0).take(pa.array(rows)), pa.array(dots[rows, which])], ["query_id", "id", "dense_score"])

    return run


def dense_top(vectors: DataFrame, queries: DataFrame, k: int = 40, allowed: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """The k nearest of each query; filtered before anything is multiplied.

    Batches of vectors meet the queries in a matrix product and give k rows for
    each query, never all pairs; those are ranked (ties by id).
    """
    if allowed is not None:
        vectors = vectors.join(allowed.select("id"), "id", "left_semi")
    unit, context, parts = _units(vectors, "id"), vectors.sparkSession.sparkContext, []
    kind = lambda t, c: t.schema[c].dataType.simpleString()
    schema = f"query_id {kind(queries, 'query_id')}, id {kind(vectors, 'id')}, dense_score double"
    for dims, some in _blocks(queries, block):
        table = some.toArrow().combine_chunks()
        held = context.broadcast((table.column(0).combine_chunks(), table.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, dims)))
        parts.append(unit.where(F.size("v") == dims).mapInArrow(_nearest(held, k), schema))
    found = reduce(DataFrame.unionByName, parts) if parts else vectors.sparkSession.createDataFrame([], schema)
    return top(found, "dense_score", k, "dense_rank")


def _nearest_planned(held, k: int):
    """The k best of each query among the batch's rows that its plan allows; rows come with their area and subjects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, plans = held.value
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            areas, subjects = b.column(2).to_pylist(), b.column(3).to_pylist()
            order_of = np.argsort(np.array(b.column(0).to_pylist(), object), kind="stable")  # ties go by id
            rank = np.empty(len(order_of), np.int64)
            rank[order_of] = np.arange(len(order_of))
            rows, which, scores = [], [], []
            for (area, subject), asked in plans.items():
                mine = np.flatnonzero([(area is None or a == area) and (subject is None or subject in (s or ())) for a, s in zip(areas, subjects, strict=True)])
                dots = v[mine] @ q[asked].T
                for j, query in enumerate(asked.tolist()):
                    s = np.round(dots[:, j], 9)
                    near = np.arange(len(s))
                    if len(s) > k:
                        near = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
                        near = near[np.lexsort((rank[mine[near]], -s[near]))[:k]]
                    rows.append(mine[near])
                    which.append(np.full(len(near), query))
                    scores.append(dots[near, j])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.concatenate(which))), b.column(0).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(scores))], ["query_id", "id", "dense_score"])

    return run


def planned_top(vectors: DataFrame, chunks: DataFrame, queries: DataFrame, k: int = 40, block: int = BLOCK) -> DataFrame:
    """The k nearest of each of ``queries(query_id, vector, filtro_area, filtro_assunto)`` among the chunks that its plan allows.

    ``chunks(id, area, assuntos)`` meet their vectors once; queries with one
    plan are compared together, in one pass over the vectors, with no others
    than the rows that the plan allows.
    """
    norm = lambda c: F.lower(F.trim(c))
    about = chunks.select("id", norm(F.col("area")).alias("_a"), F.transform("assuntos", norm).alias("_s"))
    unit, context, parts = _units(vectors, "id").join(about, "id"), vectors.sparkSession.sparkContext, []
    kind = lambda t, c: t.schema[c].dataType.simpleString()
    schema = f"query_id {kind(queries, 'query_id')}, id {kind(vectors, 'id')}, dense_score double"
    for dims, some in _blocks(queries.select("query_id", "vector"), block):
        table = some.join(queries.select("query_id", "filtro_area", "filtro_assunto"), "query_id").toArrow().combine_chunks()
        plans: dict[tuple, list[int]] = {}
        for i, plan in enumerate(zip(table.column("filtro_area").to_pylist(), table.column("filtro_assunto").to_pylist(), strict=True)):
            plans.setdefault(plan, []).append(i)
        held = context.broadcast((table.column("query_id").combine_chunks(), table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, dims), {p: np.array(i) for p, i in plans.items()}))
        parts.append(unit.where(F.size("v") == dims).select("id", "v", "_a", "_s").mapInArrow(_nearest_planned(held, k), schema))
    found = reduce(DataFrame.unionByName, parts) if parts else vectors.sparkSession.createDataFrame([], schema)
    return top(found, "dense_score", k, "dense_rank")
