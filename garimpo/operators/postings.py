"""A stored inverted index: postings in blocks with the most that each can contribute, and a search that skips blocks.

Chunks of similar length share a slice of about ``SLICE_ROWS`` chunks, so that
the gains of a token within a slice are alike.  A block holds the postings of
one token in one slice, in order of id, with the greatest gain among them; it is
written once, with the collection's size, average length and the tokens'
document frequencies.  Blocks lie in folders by token, and a search reads only
the folders of its queries' tokens.

A slice's bound for a query is the sum of its blocks' greatest contributions.
The slices with the greatest bounds are scored first; their k-th best score is
a threshold that the other slices must be able to reach.  In those that can,
tokens whose contributions together stay below the threshold find no chunk by
themselves: they only complete the scores of chunks that the others find.
Results are those of ``sparse.bm25_top``, exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..staging import checked_broadcast, staged
from . import sparse

#: Chunks of a slice, about; bounds a block.
SLICE_ROWS = 4096
#: Words that a task gathers before it sends their postings off.
HELD = 2_000_000
#: Folders of postings.
PARTS = 64
#: Slices of a query that are scored for its threshold.
FIRST = 2
#: What sums of the same numbers in another order may differ by.
SLACK = 1e-7


class Index(NamedTuple):
    """``blocks(part, token, slice, n, gain, postings)``, ``frequency(token, df)`` and one row ``stats(n, average, k1, b, parts)``."""

    blocks: DataFrame
    frequency: DataFrame
    stats: DataFrame


class Found(NamedTuple):
    """The ranked hits, and for each query its ``blocks``, those ``first`` and those ``later`` read."""

    hits: DataFrame
    read: DataFrame


def _gain(tf: Column, dl: Column, k1: Column, b: Column, average: Column) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.greatest(average, F.lit(1e-6))))


def _part(token: Column, parts) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(parts)).cast("int")


def _grouper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(id, dl, slice, t)``: chunks' tokens counted, and their postings gathered by slice and token, a bounded number at a time."""
    held: list[pa.RecordBatch] = []
    size = 0

    def flush():
        table = pa.Table.from_batches(held).combine_chunks()
        lists = table.column("t").combine_chunks()
        words = lists.flatten().dictionary_encode()
        chunk = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        slices, place = np.unique(table.column("slice").to_numpy(), return_inverse=True)
        token, n = words.indices.to_numpy().astype(np.int64), max(1, len(words.dictionary))
        # One number for slice, token and chunk; equal ones are a token's repeats in a chunk.
        key, tf = np.unique((place[chunk] * n + token) * len(lists) + chunk, return_counts=True)
        block, chunk = key // len(lists), key % len(lists)
        first = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        values = pa.StructArray.from_arrays([table.column("id").combine_chunks().take(pa.array(chunk)), pa.array(tf.astype(np.int64)), table.column("dl").combine_chunks().take(pa.array(chunk))], ["id", "tf", "dl"])
        postings = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)).astype(np.int32)), values)
        return pa.RecordBatch.from_arrays([pa.array(slices[block[first] // n]), words.dictionary.take(pa.array(block[first] % n)), postings], ["slice", "token", "postings"])

    for b in batches:
        held.append(b)
        size += len(b.column(3).flatten())
        if size >= HELD:
            yield flush()
            held.clear()
            size = 0
    if size:
        yield flush()


def build(chunks: DataFrame, path: str, k1: float = 1.5, b: float = 0.75, slice_rows: int = SLICE_ROWS, parts: int = PARTS) -> Index:
    """Write the index of ``chunks(id, texto)`` below ``path`` (which must be new) and open it.

    Chunks without tokens count in the average length and are in no block.  A
    chunk's tokens are counted where the chunk is, and its postings travel once,
    gathered by block.  Ids are distinct.
    """
    split = chunks.select("id", tokens("texto").alias("t"))
    dl = F.size("t").cast("long")
    kind = F.floor(2 * F.log2(F.lit(1.0) + F.col("dl"))).cast("int")
    sizes = staged(split.select(dl.alias("dl")).withColumn("class", kind).groupBy("class").agg(F.count("*").alias("n"), F.sum("dl").alias("words")), "lengths")
    slices = F.greatest(F.lit(1), F.ceil(F.col("n") / slice_rows)).cast("long")
    base = F.coalesce(F.sum(slices).over(W.orderBy("class").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = sizes.select("class", slices.alias("slices"), base.alias("base"))  # one row for each class of lengths
    stats = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("words") / F.sum("n"), F.lit(0.0)).alias("average")).select("n", "average", F.lit(k1).alias("k1"), F.lit(b).alias("b"), F.lit(parts).alias("parts"))
    stats.coalesce(1).write.parquet(f"{path}/stats")
    each = split.withColumn("dl", dl).withColumn("class", kind).join(F.broadcast(placed), "class")
    each = each.where("dl > 0").select("id", "dl", (F.col("base") + F.pmod(F.xxhash64("id"), "slices")).alias("slice"), "t")
    kind_of_id = chunks.schema["id"].dataType
    posting = f"postings array<struct<id: {kind_of_id.simpleString()}, tf: bigint, dl: bigint>>"
    grouped = each.mapInArrow(_grouper, f"slice long, token string, {posting}").withColumn("part", _part(F.col("token"), parts))
    average = chunks.sparkSession.read.schema(stats.schema).parquet(f"{path}/stats").select("average").scalar()
    blocks = grouped.repartition("part", "slice").groupBy("part", "slice", "token").agg(F.array_sort(F.flatten(F.collect_list("postings"))).alias("postings"))
    gain = F.array_max(F.transform("postings", lambda p: _gain(p["tf"], p["dl"], F.lit(k1), F.lit(b), F.col("_average"))))
    blocks = blocks.withColumn("_average", average).select("part", "token", "slice", F.size("postings").cast("long").alias("n"), gain.alias("gain"), "postings")
    blocks.sortWithinPartitions("part", "token", "slice").write.option("compression", "zstd").partitionBy("part").parquet(f"{path}/postings")
    written = _blocks(chunks.sparkSession, path, chunks.schema["id"].dataType.simpleString())
    written.groupBy("token").agg(F.sum("n").alias("df")).write.parquet(f"{path}/frequency")
    return open_index(chunks.sparkSession, path, chunks.schema["id"].dataType.simpleString())


def _blocks(spark: SparkSession, path: str, id: str) -> DataFrame:
    return spark.read.schema(f"token string, slice long, n long, gain double, postings array<struct<id: {id}, tf: bigint, dl: bigint>>, part int").parquet(f"{path}/postings")


def open_index(spark: SparkSession, path: str, id: str = "bigint") -> Index:
    """The index below ``path``; ``id`` is the type of the chunks' ids."""
    return Index(_blocks(spark, path, id), spark.read.schema("token string, df long").parquet(f"{path}/frequency"), spark.read.schema("n long, average double, k1 double, b double, parts int").parquet(f"{path}/stats"))


def _scored(wanted: DataFrame, blocks: DataFrame, about, allowed: DataFrame | None) -> DataFrame:
    """(query_id, id, sparse_score) from ``wanted(query_id, slice, token, weight, essential)``; chunks without an essential token are left out."""
    wanted = checked_broadcast(wanted)
    # The blocks that are wanted travel once, to their slice; what queries make of them is summed up there.
    held = blocks.select("token", "slice", "postings").join(wanted.select("token", "slice").distinct(), ["token", "slice"], "left_semi").repartition("slice")
    rows = held.join(wanted, ["token", "slice"])
    each = rows.select("slice", "query_id", "essential", "weight", F.explode("postings").alias("p")).select("slice", "query_id", "p.id", "essential", (F.col("weight") * _gain(F.col("p.tf"), F.col("p.dl"), about["k1"], about["b"], about["average"])).alias("w"))
    if allowed is not None:
        each = each.join(allowed.select("id"), "id", "left_semi")
    sums = each.groupBy("slice", "query_id", "id").agg(F.sum("w").alias("sparse_score"), F.bool_or("essential").alias("essential"))
    return sums.where("essential and sparse_score > 0").drop("essential", "slice")


def search(index: Index, queries: DataFrame, k: int = 5, allowed: DataFrame | None = None, first: int = FIRST) -> Found:
    """The ``k`` best chunks of ``queries(query_id, query)`` by BM25: ``hits(query_id, id, sparse_score, sparse_rank)``.

    ``allowed(id)`` names the chunks that may be found; statistics are those of
    all.  Queries without a known token find nothing.
    """
    about = index.stats.first().asDict()  # one row
    terms = sparse.query_terms(queries)
    n, df = F.lit(about["n"]), F.col("df")
    known = staged(terms.join(index.frequency, "token").select("query_id", "token", (F.col("qtf") * F.ln((n - df + 0.5) / (df + 0.5) + 1)).alias("weight")), "terms")
    folders = [r.part for r in known.select(_part(F.col("token"), about["parts"]).alias("part")).distinct().collect()]  # at most the index's folders
    held = index.blocks.where(F.col("part").isin(*folders)) if folders else index.blocks.limit(0)
    about = {c: F.lit(v) for c, v in about.items()}
    # What each block can contribute to each query; arrays of postings aren't read for it.
    most = staged(held.select("token", "slice", "gain").join(checked_broadcast(known), "token").select("query_id", "slice", "token", "weight", (F.col("weight") * F.col("gain")).alias("most")), "bounds")
    bounds = most.groupBy("query_id", "slice").agg(F.sum("most").alias("bound"), F.count("*").alias("blocks"))
    turn = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("bound"), "slice"))
    turns = staged(bounds.withColumn("turn", turn), "turns")
    best_first = most.join(turns.where(F.col("turn") <= first).select("query_id", "slice"), ["query_id", "slice"])
    early = staged(sparse.top(_scored(best_first.select("query_id", "slice", "token", "weight", F.lit(True).alias("essential")), held, about, allowed), "sparse_score", k, "sparse_rank"), "early")
    least = early.where(F.col("sparse_rank") == k).select("query_id", (F.col("sparse_score") - SLACK).alias("least"))
    rest = turns.where(F.col("turn") > first).join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(0.0))).where("bound >= least")
    late = most.join(rest.select("query_id", "slice", "least"), ["query_id", "slice"])
    # Tokens of the least contributions that stay below the threshold all together.
    below = F.sum("most").over(W.partitionBy("query_id", "slice").orderBy("most", "token").rowsBetween(W.unboundedPreceding, W.currentRow))
    late = staged(late.withColumn("essential", (below >= F.col("least")) | (F.col("least") <= 0)).select("query_id", "slice", "token", "weight", "essential"), "late")
    both = early.drop("sparse_rank").unionByName(_scored(late, held, about, allowed))
    counts = turns.groupBy("query_id").agg(F.sum("blocks").alias("blocks"), F.sum(F.when(F.col("turn") <= first, F.col("blocks")).otherwise(0)).alias("first"))
    read = counts.join(late.groupBy("query_id").agg(F.count("*").alias("later")), "query_id", "left").select("query_id", "blocks", "first", F.coalesce("later", F.lit(0)).alias("later"))
    return Found(sparse.top(both, "sparse_score", k, "sparse_rank"), read)
