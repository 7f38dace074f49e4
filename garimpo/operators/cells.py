"""A stored vector collection, laid out by cells, and an exact search that leaves out cells.

Centroids come from a bounded sample; every vector goes to its nearest centroid
and is written to that cell's folder, with each cell's size and radius (the
widest angle between a member and the centroid).  No member can be nearer to a
query than the query's angle to the centroid less the radius.  A query first
looks into its nearest cells; its k-th best there rules out all cells whose
bound is worse, and the others are looked into as well, so results are those of
``dense.dense_top``.  Where vectors don't cluster, nothing is ruled out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import staged
from . import dense
from .sparse import top

#: Vectors of each length that centroids are made from (those with the least hash of their id), and rounds.
SAMPLE, ROUNDS = 20_000, 8
#: Centroids of each length at most.
MOST_CELLS = 1024
#: Cells of a query that are looked into first.
FIRST = 2
#: What an angle or a cosine may be off by.
SLACK = 1e-6
#: Vectors of a file at most.
FILE_ROWS = 1_000_000


class Collection(NamedTuple):
    """``vectors(cell, id, v)`` and ``cells(cell, dims, centroid, n, radius)``."""

    vectors: DataFrame
    cells: DataFrame


class Found(NamedTuple):
    """The ranked hits, and for each query its ``cells``, those looked into ``first`` and ``later``."""

    hits: DataFrame
    read: DataFrame


def centroids(sample: np.ndarray, n: int, rounds: int = ROUNDS) -> np.ndarray:
    """At most ``n`` unit centroids of unit vectors: evenly spaced ones of the sorted sample, then Lloyd's rounds."""
    distinct = np.unique(sample, axis=0)
    at = distinct[np.linspace(0, len(distinct) - 1, min(n, len(distinct))).astype(int)]
    for _ in range(rounds):
        near = (sample @ at.T).argmax(1)
        sums = np.zeros_like(at)
        np.add.at(sums, near, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        at = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), at)
    return np.unique(at, axis=0)


def _assigner(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = held.value
        for b in batches:
            sizes = np.diff(b.column(1).offsets.to_numpy())
            values = b.column(1).flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            cell, angle = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
            for dims, (first, centres) in tables.items():
                rows = np.flatnonzero(sizes == dims)
                if len(rows):
                    cos = values[(ends[rows] - dims)[:, None] + np.arange(dims)] @ centres.T
                    near = cos.argmax(1)
                    cell[rows] = first + near
                    angle[rows] = np.arccos(np.clip(cos[np.arange(len(rows)), near], -1, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell), pa.array(angle)], ["id", "v", "cell", "angle"])

    return run


def build(vectors: DataFrame, path: str, sample: int = SAMPLE, most_cells: int = MOST_CELLS) -> Collection:
    """Write the collection of ``vectors(id, vector)`` below ``path`` (which must be new) and open it.

    Null and zero vectors are in no cell.  Vectors of different lengths have
    cells of their own.  A cell of very many vectors is written by several tasks.
    """
    spark = vectors.sparkSession
    unit = dense._units(vectors, "id").withColumn("dims", F.size("v"))
    tables, first, rows = {}, 0, []
    for dims, n in sorted(tuple(r) for r in unit.groupBy("dims").count().collect()):  # a row for each length of vectors
        some = unit.where(F.col("dims") == dims).orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow()
        values = some.column(0).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, dims)
        made = centroids(values, max(1, min(most_cells, int(n**0.5))))
        tables[dims] = first, made
        rows += [(first + i, dims, c.tolist()) for i, c in enumerate(made)]
        first += len(made)
    schema = f"id {vectors.schema['id'].dataType.simpleString()}, v array<double>, cell int, angle double"
    placed = unit.select("id", "v").mapInArrow(_assigner(spark.sparkContext.broadcast(tables)), schema)
    placed.hint("rebalance", "cell").write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("cell").parquet(f"{path}/vectors")
    sizes = _vectors(spark, path, vectors.schema["id"].dataType.simpleString(), "angle").groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius"))
    about = spark.createDataFrame(rows, "cell int, dims int, centroid array<double>").join(sizes, "cell")
    about.coalesce(1).write.parquet(f"{path}/cells")
    return open_collection(spark, path, vectors.schema["id"].dataType.simpleString())


def _vectors(spark: SparkSession, path: str, id: str, *more: str) -> DataFrame:
    return spark.read.schema(f"id {id}, v array<double>, {''.join(f'{c} double, ' for c in more)}cell int").parquet(f"{path}/vectors")


def open_collection(spark: SparkSession, path: str, id: str = "bigint") -> Collection:
    """The collection below ``path``; ``id`` is the type of the vectors' ids."""
    return Collection(_vectors(spark, path, id), spark.read.schema("cell int, dims int, centroid array<double>, n long, radius double").parquet(f"{path}/cells"))


def _nearest(held, k: int):
    """The k best of each query among a batch's vectors of the cells that it looks into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, probes = held.value
        for b in batches:
            if not b.num_rows:
                continue
            cells = b.column(2).to_numpy()
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            order_of = np.argsort(np.array(b.column(0).to_pylist(), object), kind="stable")  # ties go by id
            rank = np.empty(len(order_of), np.int64)
            rank[order_of] = np.arange(len(order_of))
            rows, which, scores = [], [], []
            for cell in np.unique(cells).tolist():
                mine, asked = np.flatnonzero(cells == cell), probes[cell]
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


def _look(vectors: DataFrame, names: pa.Array, q: np.ndarray, probes: dict[int, np.ndarray], k: int, schema: str) -> DataFrame:
    """(query_id, id, dense_score): ``probes`` names the queries, by place, that look into each cell."""
    some = vectors.where(F.col("cell").isin(*probes)) if probes else vectors.limit(0)
    held = vectors.sparkSession.sparkContext.broadcast((names, q, probes))
    return some.select("id", "v", "cell").mapInArrow(_nearest(held, k), schema)


def search(collection: Collection, queries: DataFrame, k: int = 40, allowed: DataFrame | None = None, first: int = FIRST, block: int = dense.BLOCK) -> Found:
    """The ``k`` nearest of ``queries(query_id, vector)``: ``hits(query_id, id, dense_score, dense_rank)``.

    ``allowed(id)`` names the vectors that may be found.  Queries are a stated
    set, taken ``block`` at a time; null and zero vectors find nothing.
    """
    spark = queries.sparkSession
    vectors = collection.vectors if allowed is None else collection.vectors.join(allowed.select("id"), "id", "left_semi")
    kind = lambda t, c: t.schema[c].dataType.simpleString()
    schema = f"query_id {kind(queries, 'query_id')}, id {kind(vectors, 'id')}, dense_score double"
    table = collection.cells.toArrow()  # a row for each cell: bounded by MOST_CELLS for each length of vectors
    about = {dims: [i for i, d in enumerate(table.column("dims").to_pylist()) if d == dims] for dims in set(table.column("dims").to_pylist())}
    parts, read = [], []
    for dims, some in dense._blocks(queries, block):
        if dims not in about:
            continue
        sent = some.toArrow().combine_chunks()
        names, q = sent.column(0).combine_chunks(), sent.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(sent.num_rows, dims)
        mine = table.take(about[dims])
        cells, sizes = mine.column("cell").to_numpy(), mine.column("n").to_numpy()
        centres = np.array(mine.column("centroid").to_pylist()).reshape(len(cells), dims)
        angle = np.arccos(np.clip(q @ centres.T, -1, 1))
        least = np.maximum(0, angle - mine.column("radius").to_numpy() - SLACK)  # no member is nearer
        order = np.argsort(angle, axis=1, kind="stable")
        # The nearest cells, and more where they hold fewer than k vectors.
        before = np.cumsum(sizes[order], 1) - sizes[order]
        early = np.zeros(angle.shape, bool)
        np.put_along_axis(early, order, (np.arange(len(cells))[None, :] < first) | (before < k), 1)
        probes = lambda chosen: {int(cells[c]): np.flatnonzero(chosen[:, c]) for c in np.flatnonzero(chosen.any(0))}
        found = staged(top(_look(vectors, names, q, probes(early), k, schema), "dense_score", k, "dense_rank"), "near")
        kth = {r.query_id: r.dense_score for r in found.where(F.col("dense_rank") == k).collect()}  # a number for each query of the block
        worst = np.array([kth.get(name, -2.0) for name in names.to_pylist()])
        late = ~early & (np.cos(least) >= worst[:, None] - SLACK)
        parts += [found.drop("dense_rank"), _look(vectors, names, q, probes(late), k, schema)]
        read += [(name, len(cells), int(a), int(b)) for name, a, b in zip(names.to_pylist(), early.sum(1), late.sum(1), strict=True)]
    hits = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
    return Found(top(hits, "dense_score", k, "dense_rank"), spark.createDataFrame(read, f"query_id {kind(queries, 'query_id')}, cells int, first int, later int"))
