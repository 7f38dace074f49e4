"""Near-duplicate vectors by PCA-ordered tiled comparison.

Vectors are scaled to length one and turned into the coordinates of their
principal components, which puts most of their length into leading dimensions.
Pairs of tiles accumulate inner products a block of dimensions at a time; what
the remaining dimensions can add is bounded by the product of the suffix norms,
and a pair stops as soon as its cosine can't reach the threshold any more.  What
is left is confirmed in double precision on the vectors as given.

Vectors lie in the cells of pivots; cells are put together to tiles of bounded
size.  Each cell's radius is known before anything travels: where the angle
between two pivots, less both radii, is too wide, neither cell is sent to meet
the other.  How often a vector travels is thus the number of tiles that hold a
cell within its reach.

Equal vectors are one class from the start.  A tile pair emits the number of
links of each of its classes and a spanning forest of the links, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

THRESHOLD = 0.9
#: Numbers (vectors times dimensions) and vectors of a tile at most: what a task holds is two tiles.  Rows and partners multiplied at a time.
TILE_VALUES, TILE, STRIP, CHUNK = 1 << 21, 32_768, 512, 8192
#: Rows whose vectors fit the principal components and the pivots, those with the least hash: a bounded sample.
FIT_ROWS = 20_000
#: Pivots: at least so many, four for each tile, and at most so many.
PIVOTS, MOST_PIVOTS = 64, 1024
#: Entries of the table of routes (pivots times tiles) up to which it is broadcast; beyond, a shuffle join.
ROUTES = 1_000_000
#: Widths of the blocks of dimensions, as shares of all.
BLOCKS = (0.125, 0.125, 0.25, 0.5)
#: Slack for single precision; pairs this near the threshold go on to double precision.
SLACK = 1e-4


def usable(column: str = "embedding"):
    """Neither null, empty nor zero, and every component finite."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(column).isNotNull() & (F.size(column) > 0) & ~bad & F.exists(column, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def unit(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length one (by their largest component first, so that nothing overflows)."""
    m = m / np.abs(m).max(1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


class Basis:
    """Principal axes and pivots, from a bounded sample of unit vectors."""

    def __init__(self, sample: np.ndarray, pivots: int):
        _, axes = np.linalg.eigh(sample.T @ sample)
        self.axes = np.ascontiguousarray(axes[:, ::-1])
        rng = np.random.default_rng(0)
        centres = sample[rng.permutation(len(sample))[:pivots]]
        for _ in range(4):  # spherical k-means
            near = np.argmax(sample @ centres.T, 1)
            centres = np.stack([unit(s)[0] if (s := sample[near == k].sum(0, keepdims=True)).any() else centres[k] for k in range(len(centres))])
        self.centres = centres @ self.axes

    def turn(self, m: np.ndarray) -> np.ndarray:
        return m @ self.axes


def _cells(basis):
    """Each vector's nearest pivot, and the angle to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = basis.value
        for batch in batches:
            if not batch.num_rows:
                continue
            near = b.turn(unit(_matrix(batch.column(2)))) @ b.centres.T
            cell = np.argmax(near, 1)
            angle = np.arccos(np.clip(near[np.arange(len(cell)), cell], -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(angle)], [*batch.schema.names, "cell", "angle"])

    return common.tidied(run)


def reachable(centres: np.ndarray, radius: np.ndarray, threshold: float) -> np.ndarray:
    """Which cells may hold vectors that link: the angle of their pivots less both radii isn't too wide."""
    between = np.arccos(np.clip(centres @ centres.T, -1, 1))
    near = between - radius[:, None] - radius[None, :] <= math.acos(threshold) + 1e-3
    np.fill_diagonal(near, True)
    return near


def tiles_of(counts: dict[int, int], tile: int) -> list[tuple[int, int, int, int]]:
    """(cell, its first tile, tiles it is dealt over, vectors): small neighbouring cells share a tile, large ones are split."""
    out, at, room = [], -1, 0
    for cell, n in sorted(counts.items()):
        parts = max(1, -(-n // tile))
        if parts > 1 or n > room:
            at, room = at + 1, tile
        out.append((cell, at, parts, n))
        at, room = at + parts - 1, room - n if parts == 1 else 0
    return out


def tile_pair(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two tiles (unit vectors, PCA order) whose cosine may reach the threshold."""
    dims, need = a.shape[1], np.float32(threshold - SLACK)
    a, b = a.astype(np.float32), b.astype(np.float32)
    cuts = [0, *sorted({min(dims, max(1, round(dims * s))) for s in np.cumsum(BLOCKS)} | {dims})]
    rest = [(np.sqrt((a[:, c:].astype(np.float64) ** 2).sum(1)).astype(np.float32), np.sqrt((b[:, c:].astype(np.float64) ** 2).sum(1)).astype(np.float32)) for c in cuts]
    dots = np.zeros((len(a), len(b)), np.float32)
    for k in range(1, len(cuts)):
        lo, hi = cuts[k - 1], cuts[k]
        dots += a[:, lo:hi] @ b[:, lo:hi].T
        if hi == dims:
            return np.nonzero(dots >= need)
        open_ = dots + rest[k][0][:, None] * rest[k][1][None, :] >= need
        n = int(open_.sum())
        if n * 16 < open_.size:  # few pairs are left: finish them one by one
            i, j = np.nonzero(open_)
            sums = dots[i, j]
            for k2 in range(k + 1, len(cuts)):
                if not len(i):
                    break
                lo, hi = cuts[k2 - 1], cuts[k2]
                sums = sums + np.einsum("ij,ij->i", a[i, lo:hi], b[j, lo:hi])
                keep = sums + rest[k2][0][i] * rest[k2][1][j] >= need
                i, j, sums = i[keep], j[keep], sums[keep]
            return i, j
    return np.nonzero(dots >= need)


def _compare(basis, near, threshold: float):
    """Tile pairs, sorted by number, each with the side of its members -> link counts and a forest of links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, meets = basis.value, near.value
        name, parts = None, []

        def done():
            rep, copies, second, cell = (np.concatenate([p[i] for p in parts]) for i in range(4))
            one = unit(np.concatenate([p[4] for p in parts]))
            x = base.turn(one)
            order = np.argsort(cell, kind="stable")
            left, right = order[~second[order]], order[second[order]]
            own = not len(right) and name[0] == name[1]  # a tile with itself
            if own:
                right = left
            if not len(left) or not len(right):
                return None
            n, forest = np.zeros(len(rep)), common.Forest(len(rep))
            label = np.arange(len(rep))
            place = np.empty(len(rep), np.int64)
            place[order] = np.arange(len(order))
            for at in range(0, len(left), STRIP):
                strip, side = left[at : at + STRIP], right[at:] if own else right
                side = side[meets[np.unique(cell[strip])].any(0)[cell[side]]]
                for first in range(0, len(side), CHUNK):
                    some = side[first : first + CHUNK]
                    i, j = tile_pair(x[strip], x[some], threshold)
                    i, j = strip[i], some[j]
                    if own:  # in the order of cells, so that a pair within a strip counts once
                        later = place[i] < place[j]
                        i, j = i[later], j[later]
                    if not len(i):
                        continue
                    sure = np.concatenate([np.einsum("ij,ij->i", one[i[k : k + 50_000]], one[j[k : k + 50_000]]) >= threshold for k in range(0, len(i), 50_000)])
                    i, j = i[sure], j[sure]
                    n += np.bincount(i, copies[j], len(rep)) + np.bincount(j, copies[i], len(rep))
                    # Join each row with one partner first: few pairs are then left between different trees.
                    for pick in (np.unique(j, return_index=True)[1], np.unique(i, return_index=True)[1], slice(None)):
                        p, q = i[pick], j[pick]
                        apart = label[p] != label[q]
                        for u, v in zip(p[apart].tolist(), q[apart].tolist(), strict=True):
                            forest.join(u, v)
                        if apart.any():
                            label = np.array([forest.root(k) for k in range(len(rep))])
            if not n.any():
                return None
            seen = np.flatnonzero(n)
            f = np.array(forest.links, np.int64).reshape(-1, 2)
            none = [None] * len(f)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([rep[seen], rep[f[:, 0]]])), pa.array([None] * len(seen) + rep[f[:, 1]].tolist(), pa.int64()), pa.array([int(v) for v in n[seen]] + none, pa.int64())], ["rep", "other", "n"]
            )

        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(c).to_numpy() for c in ("low", "high")], 1)
            cut = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            m = _matrix(b.column("embedding"))
            cols = [b.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "copies", "second", "cell")]
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                key = tuple(keys[lo].tolist())
                if key != name:
                    if name is not None and (out := done()) is not None:
                        yield out
                    name, parts = key, []
                parts.append((*(c[lo:hi] for c in cols), m[lo:hi]))
        if name is not None and (out := done()) is not None:
            yield out

    return common.tidied(run)


def _reached(near):
    """(cell, near): the cells that each cell reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cell in b.column(0).to_pylist():
                found = np.flatnonzero(near.value[cell]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), cell, np.int32)), pa.array(found)], ["cell", "near"])

    return common.tidied(run)


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``vectors(vec_id, embedding)`` -> ``(vec_id, n_links, component_id, kept)``, a row for each row.

    Links are pairs with cosine >= ``threshold`` in double precision.  Vectors
    that are null, empty or zero, or hold null or non-finite components, link
    with nothing.  Vectors of different lengths link with nothing (each length
    is compared by itself).  Rows that share a vec_id count as separate vectors
    and one node; rows with a null vec_id link with nothing (null component,
    kept).  Equal vectors (a negative zero is a zero) are one class, found again
    by a 128-bit hash.  Other columns are ignored; an empty table gives no rows.

    The basis is fitted on ``fit_rows`` vectors; all rows are compared.
    """
    spark = vectors.sparkSession
    common.small_batches(spark)
    kind = "array<float>" if vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType(), vectors.schema["embedding"].dataType.containsNull) else "array<double>"
    all_rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    good = all_rows.where(usable() & F.col("vec_id").isNotNull()).withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0).cast(kind[6:-1])))
    keyed = good.select("vec_id", F.xxhash64(F.lit(7), "embedding").alias("h1"), F.xxhash64(F.lit(11), "embedding").alias("h2"), "embedding")
    facts = [F.first("h1").alias("h1"), F.first("h2").alias("h2"), F.min("vec_id").alias("least"), F.count("*").alias("copies")]
    classes = common.staged(keyed.groupBy("embedding").agg(*facts).withColumn("node", F.monotonically_increasing_id()).withColumn("dims", F.size("embedding")), "vector-classes")
    counts, forests = [], []
    for dims, n in sorted(tuple(r) for r in classes.groupBy("dims").count().collect()):
        links = common.staged(_links(classes.where(F.col("dims") == dims), dims, n, threshold, tile, fit_rows), "vector-links")
        counts.append(links.where("other is null").groupBy("rep").agg(F.sum("n").alias("n")))
        forests.append(links.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    if not counts:
        return all_rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    linked, edges = counts[0], forests[0]
    for c, e in zip(counts[1:], forests[1:], strict=True):
        linked, edges = linked.unionByName(c), edges.unionByName(e)
    # Rows that share a vec_id hang together.
    named = common.staged(keyed.select("vec_id", "h1", "h2").join(classes.select("h1", "h2", "node"), ["h1", "h2"]).select("vec_id", "node"), "vector-names")
    shared = named.groupBy("vec_id").agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a <> last")
    edges = edges.unionByName(named.join(shared, "vec_id").select("a", F.col("node").alias("b")))
    found = common.components(edges)
    group = classes.select("node", "least", "copies").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = group.groupBy("component").agg(F.min("least").alias("component_id"))
    per_class = group.join(least, "component").join(linked.withColumnRenamed("rep", "node"), "node", "left").select("node", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    rows = named.join(per_class, "node").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    rest = all_rows.where(~usable() | F.col("vec_id").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return rows.unionByName(rest)


def _links(classes: DataFrame, dims: int, n: int, threshold: float, tile: int, fit_rows: int) -> DataFrame:
    """``(rep, other, n)``: link counts (null other) and a forest of links of ``classes(node, copies, embedding)`` of one length."""
    spark = classes.sparkSession
    # Tiles so small that there are more pairs of them than cores, if there are vectors enough.
    spread = math.isqrt(4 * spark.sparkContext.defaultParallelism) + 1
    tile = max(1, min(tile, TILE_VALUES // dims, max(1024, -(-n // spread))))
    pivots = min(MOST_PIVOTS, max(PIVOTS, 4 * -(-n // tile)))
    sample = classes.orderBy(F.xxhash64("h1"), "h2").limit(fit_rows).select("embedding").toArrow()["embedding"].combine_chunks()
    base = Basis(unit(_matrix(sample)), pivots)
    basis = spark.sparkContext.broadcast(base)
    schema = f"node long, copies long, embedding {classes.schema['embedding'].dataType.simpleString()}, cell int, angle double"
    placed = common.staged(classes.select("node", "copies", "embedding").mapInArrow(_cells(basis), schema), "cells")
    sizes = {r.cell: (r.n, r.radius) for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()}  # a row a pivot
    radius = np.zeros(len(base.centres))
    for cell, (_, r) in sizes.items():
        radius[cell] = r
    meets = reachable(base.centres, radius, threshold)
    dealt = tiles_of({c: k for c, (k, _) in sizes.items()}, tile)
    near = spark.sparkContext.broadcast(meets)
    starts = spark.createDataFrame([(c, f, p) for c, f, p, _ in dealt], "cell int, first int, parts int")  # a row a cell
    # Which tiles a cell's part travels to, from the cells that it reaches: made by tasks, as many rows as it takes.
    places = starts.select("cell", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1)).alias("tile"))
    reach = starts.select("cell").mapInArrow(_reached(near), "cell int, near int")
    to = places.withColumnRenamed("tile", "other").withColumnRenamed("cell", "near")
    pairs = places.join(reach, "cell").join(to, "near").select("cell", "tile", "other").unionByName(places.withColumn("other", F.col("tile"))).distinct()
    table = common.staged(pairs.groupBy("cell", "tile").agg(F.collect_list("other").alias("others")), "routes")
    small = (table.agg(F.sum(F.size("others"))).first()[0] or 0) <= ROUTES
    tiled = placed.join(F.broadcast(starts), "cell").withColumn("tile", (F.col("first") + F.pmod(F.xxhash64("node", F.lit(2)), F.col("parts"))).cast("int"))
    sent = tiled.join(F.broadcast(table) if small else table, ["cell", "tile"]).select(F.col("node").alias("rep"), "copies", "cell", "embedding", "tile", F.explode("others").alias("other"))
    sent = sent.select(F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), (F.col("tile") > F.col("other")).alias("second"), "rep", "copies", "cell", "embedding")
    tiles = max(f + p for _, f, p, _ in dealt)
    # Pairs of tiles by number, each its own partition while there are few.
    tasks = min(tiles * (tiles + 1) // 2, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 10_000))
    number = (F.col("high").cast("long") * (F.col("high") + 1) / 2).cast("long") + F.col("low")
    return sent.repartitionById(tasks, F.pmod(number, F.lit(tasks)).cast("int")).sortWithinPartitions("low", "high").mapInArrow(_compare(basis, near, threshold), "rep long, other long, n long")


def op9_pca_tiles(spark, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.9."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
