"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document is the set of its distinct word shingles.  Its sketch has ``t``
coordinates filled in rounds: in round i < t every shingle is thrown into a
random bin with the value (i, hash); in round t + b every shingle is thrown
into bin b, so every coordinate is filled for certain.  A bin keeps its least
value, rounds stop once all bins are full, and the share of equal coordinates
concentrates around the Jaccard similarity as if they were drawn without
replacement (Dahlgaard, Knudsen and Thorup, 2017).

Documents with equal word sequences are one class from the start.  Bands of
coordinates hash class representatives into buckets; a bucket yields a star
(each member with its least member), never its pairs.  Components of the stars
are families.  Families are compared on full shingle sets in square tiles of
bounded size, split by set size, and each tile emits only a spanning forest of
the links it confirms.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: A-Z lower-cased, other bytes kept; bytes.split() then splits at 20, 09-0D.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Probability that banding misses a pair right at the threshold.
MISS = 1e-6
TILE_DOCS = 192
TILE_SHINGLES = 1_000_000


def shape(percent: int, miss: float = MISS) -> tuple[int, int]:
    """(bands, rows): so many bands that a pair at the threshold is missed with probability ``miss`` at most."""
    rows = 8 if percent >= 85 else 6 if percent >= 75 else 4
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows)), rows


def shingle_set(text: bytes, k: int) -> tuple[np.ndarray, bytes]:
    """Sorted distinct 64-bit hashes of a text's k-word shingles (all its words as one if it has fewer), and its words joined by spaces."""
    normal = b" ".join(text.translate(LOWER).split())
    if not normal:
        return np.empty(0, np.uint64), normal
    hashes = common.hash_words(normal)[0]
    return np.unique(common.rolling(hashes, min(k, len(hashes)))), normal


def sketch(elements: np.ndarray, t: int) -> np.ndarray:
    """t coordinates of a non-empty set of 64-bit elements."""
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out, done, n = np.full(t, empty), 0, len(elements)
    while done < t:
        rounds = min(t - done, max(1, math.ceil(t * (math.log(t) + 2) / n)))
        i = np.arange(done, done + rounds, dtype=np.uint64)
        x = common.mix64(elements[None, :] ^ common.mix64(i + np.uint64(1))[:, None])
        bins = ((x >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)
        np.minimum.at(out, bins.ravel().astype(np.int64), ((i << np.uint64(32))[:, None] | (x & np.uint64(0xFFFFFFFF))).ravel())
        done += rounds
        if out.max() != empty:
            return out
    for b in np.flatnonzero(out == empty).tolist():
        i = np.uint64(t + b)
        x = common.mix64(elements ^ common.mix64(np.array([i + np.uint64(1)])))
        out[b] = (i << np.uint64(32)) | (x & np.uint64(0xFFFFFFFF)).min()
    return out


def band_keys(coordinates: np.ndarray, bands: int, rows: int) -> np.ndarray:
    c = coordinates.reshape(bands, rows)
    key = np.arange(bands, dtype=np.uint64)
    for r in range(rows):
        key = common.mix64(key * np.uint64(0x9E3779B97F4A7C15) + c[:, r])
    return key.view(np.int64)


SKETCHED = "doc_id long, mark binary, n_shingles long, twin binary, bands array<long>"


def _sketcher(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            sizes, twins, keys, known = [], [], [], {}
            for text in common.byte_lists(b.column(2)):
                elements, normal = shingle_set(text, k)
                sizes.append(len(elements))
                if not normal:
                    twins.append(None)
                    keys.append(None)
                    continue
                twin = xxhash.xxh3_128_digest(normal)
                twins.append(twin)
                if twin not in known:
                    known[twin] = band_keys(sketch(elements, bands * rows), bands, rows)
                keys.append(known[twin])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(twins, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "mark", "n_shingles", "twin", "bands"])

    return common.tidied(run)


def _sets(k: int):
    """Full shingle sets, of equal texts once in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            marks, sets = [], []
            for mark, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if mark not in seen:
                    seen.add(mark)
                    marks.append(mark)
                    sets.append(shingle_set(text.as_py().encode(), k)[0].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(marks, pa.binary()), pa.array(sets, pa.binary())], ["mark", "shingles"])

    return common.tidied(run)


def _sizes(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([len(shingle_set(t, k)[0]) for t in common.byte_lists(b.column(1))], pa.int64())], ["doc_id", "n_shingles"])

    return common.tidied(run)


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """|A & B| for all pairs of the few sets of a tile, through blocks of a 0/1 matrix."""
    n = len(sets)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
    counts = np.diff(np.append(first, len(flat)))
    column = np.repeat(np.where(counts > 1, np.cumsum(counts > 1) - 1, -1), counts)  # those in one set alone can't be shared
    shared = column >= 0
    column, owner = column[shared], owner[shared]
    out = np.zeros((n, n))
    width = 8192
    cuts = np.searchsorted(column, np.arange(0, int(column[-1]) + width + 1 if len(column) else 1, width))
    for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        m = np.zeros((n, width), np.float32)
        m[owner[lo:hi], column[lo:hi] - k * width] = 1
        out += m @ m.T
    return out.astype(np.int64)


def tile_links(names: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links ``100 * |A & B| >= percent * |A | B|`` in a tile."""
    both = intersections(sets)
    sizes = np.array([len(s) for s in sets])
    union = sizes[:, None] + sizes[None, :] - both
    a, b = np.nonzero(np.triu((100 * both >= percent * union) & (both > 0), 1))
    forest = common.Forest(len(sets))
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        forest.join(i, j)
    return [(names[i], names[j]) for i, j in forest.links]


def _linker(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, names, sets, held = None, [], [], set()

        def done():
            links = tile_links(names, sets, percent) if len(names) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])

        for b in batches:
            for key, name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if key != tile:
                    if tile is not None:
                        yield done()
                    tile, names, sets, held = key, [], [], set()
                if name not in held:  # a text that several tasks held
                    held.add(name)
                    names.append(name)
                    sets.append(np.frombuffer(data.as_buffer(), np.uint64).copy())
        if tile is not None:
            yield done()

    return common.tidied(run)


def _tiled(members: DataFrame, percent: int) -> DataFrame:
    """``members(family, rep, mark, n)`` with the tiles each takes part in: rows ``(rep, mark, tile)``.

    A small family is one tile.  A large one is split into size classes so
    narrow that linked sets are in the same or neighbouring classes, and each
    class by hash into tiles; a pair of tiles is compared in one place.
    """
    width = -math.log(percent / 100 * 0.999)
    classed = members.withColumn("s", F.floor(F.log(F.col("n").cast("double")) / F.lit(width)).cast("int"))
    per_class = classed.groupBy("family", "s").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    per_class = per_class.withColumn("tiles", F.greatest(F.ceil(F.col("c") / TILE_DOCS), F.ceil(F.col("w") / TILE_SHINGLES)).cast("int"))
    families = per_class.groupBy("family").agg(F.sum("c").alias("docs"), F.sum("w").alias("weight"), F.map_from_entries(F.collect_list(F.struct("s", "tiles"))).alias("tiles"))  # a few dozen size classes
    j = classed.join(families, "family")
    here = F.pmod(F.xxhash64("rep"), F.element_at("tiles", F.col("s"))).cast("int")
    name = lambda sa, ta, sb, tb: F.concat_ws("/", F.col("family"), sa, ta, sb, tb)
    up = lambda k: F.sequence(F.lit(0), k - 1)
    above, below = F.coalesce(F.try_element_at("tiles", F.col("s") + 1), F.lit(0)), F.coalesce(F.try_element_at("tiles", F.col("s") - 1), F.lit(0))
    many = F.concat(
        F.transform(up(F.element_at("tiles", F.col("s"))), lambda o: name(F.col("s"), F.least(F.col("here"), o), F.col("s"), F.greatest(F.col("here"), o))),
        F.when(above > 0, F.transform(up(above), lambda o: name(F.col("s"), F.col("here"), F.col("s") + 1, o))).otherwise(F.array().cast("array<string>")),
        F.when(below > 0, F.transform(up(below), lambda o: name(F.col("s") - 1, o, F.col("s"), F.col("here")))).otherwise(F.array().cast("array<string>")),
    )
    one = (F.col("docs") <= TILE_DOCS) & (F.col("weight") <= TILE_SHINGLES)
    return j.withColumn("here", here).select("rep", "mark", F.explode(F.when(one, F.array(F.col("family").cast("string"))).otherwise(many)).alias("tile"))


def mark(text="text"):
    """128 bits that name a text (null for a null text)."""
    return F.unhex(F.md5(F.col(text).cast("string").cast("binary")))


def text_groups(docs: DataFrame, shingle: int, percent: int, miss: float = MISS) -> tuple[DataFrame, DataFrame]:
    """Rows ``(doc_id, mark, n_shingles, twin, bands)`` of ``docs(doc_id, text)``, and classes ``(twin, rep, least, group)``.

    Rows with equal word sequences share their twin (128 bits; null without
    words) and are one class; ``least`` is its smallest doc_id.  Classes of a
    component of links have one group, the smallest of their numbers (``rep``).
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    bands, rows = shape(percent, miss)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark().alias("mark"), F.col("text").cast("string").alias("text"))
    sketched = common.staged(source.mapInArrow(_sketcher(shingle, bands, rows), SKETCHED), "sketches", "lz4")
    first = [F.min("doc_id").alias("least"), F.min("mark").alias("mark"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")]
    classes = common.staged(sketched.where("twin is not null").groupBy("twin").agg(*first).withColumn("rep", F.monotonically_increasing_id()), "classes", "lz4")
    banded = classes.select("rep", F.explode("bands").alias("bucket"))
    hubs = banded.groupBy("bucket").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub < last").select("bucket", "hub")
    stars = banded.join(hubs, "bucket").where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b"))
    families = common.components(stars)
    members = common.staged(families.select(F.col("node").alias("rep"), F.col("component").alias("family")).join(classes.select("rep", "mark", "n"), "rep").select("family", "rep", "mark", "n"), "families")
    # The text of a class is found by its mark, whatever its rows are called; copies of it are dropped by the tasks that meet them.
    wanted = source.select("mark", "text").join(common.checked_broadcast(members.select("mark")), "mark", "left_semi")
    sets = wanted.mapInArrow(_sets(shingle), "mark binary, shingles binary")
    tiles = _tiled(members, percent).join(sets, "mark").select("tile", "rep", "shingles")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    links = tiles.repartition(max(n, 64), "tile").sortWithinPartitions("tile").mapInArrow(_linker(percent), "a long, b long")
    of = common.components(links).select(F.col("node").alias("rep"), "component")
    return sketched, classes.select("twin", "rep", "least").join(of, "rep", "left").select("twin", "rep", "least", F.coalesce("component", "rep").alias("group"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, miss: float = MISS) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``(doc_id, n_shingles, component_id, kept)``.

    Links: ``100 * intersection >= percent * union`` on full sets of
    ``shingle``-word shingles (64-bit hashes); ``component_id`` is the smallest
    doc_id reachable.  A text of fewer words is one shingle; null texts and
    texts without words have an empty set and link with nothing.  Rows that
    share a doc_id are one node, whatever their texts: what is linked to one is
    reached from all.  Rows with a null doc_id are never linked (null component,
    kept).  Other columns are ignored; an empty table gives no rows.
    """
    named = docs.where("doc_id is not null").select("doc_id", "text")
    sketched, groups = text_groups(named, shingle, percent, miss)
    groups = common.staged(groups, "groups")
    # Ids with several word sequences, or with and without words, tie what they hold together.
    several = sketched.groupBy("doc_id").agg(F.min("twin").alias("lo"), F.max("twin").alias("hi"), F.count("twin").alias("c"), F.count("*").alias("n")).where("lo < hi or (c > 0 and c < n)")
    several = common.checked_broadcast(common.staged(several.select("doc_id"), "shared-ids"))
    held = common.staged(sketched.select("doc_id", "twin").join(several, "doc_id", "left_semi").join(groups.select("twin", "group"), "twin").groupBy("doc_id", "group").agg(F.min("group").alias("b")).select("doc_id", "b"), "shared-groups")
    ties = held.join(held.groupBy("doc_id").agg(F.min("b").alias("a")), "doc_id")
    tied = common.components(ties.select("a", "b")).select(F.col("node").alias("group"), "component")
    whole = groups.join(tied, "group", "left").select("twin", "least", F.coalesce("component", "group").alias("group"))
    found = whole.join(whole.groupBy("group").agg(F.min("least").alias("component_id")), "group").select("twin", "component_id")
    found = common.staged(found, "components")
    # The same for a row without words whose doc_id has words elsewhere.
    empty = sketched.select("doc_id", "twin").join(several, "doc_id", "left_semi").join(found, "twin").groupBy("doc_id").agg(F.min("component_id").alias("other"))
    empty = common.checked_broadcast(common.staged(empty, "shared-components"))
    out = sketched.select("doc_id", "n_shingles", "twin").join(found, "twin", "left").join(empty, "doc_id", "left")
    component = F.coalesce("component_id", "other", "doc_id")
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
    nameless = docs.where("doc_id is null").select("doc_id", "text").mapInArrow(_sizes(shingle), "doc_id long, n_shingles long")
    return out.unionByName(nameless.select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept")))


def one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80, miss: float = MISS) -> DataFrame:
    """The rows of ``docs`` (all its columns) without near duplicates: of each group of linked texts one row stays.

    Texts are linked as in ``near_duplicates``, but rows are told apart by doc_id
    and text: sharing a doc_id ties nothing, so different texts under one id all
    stay, and a row with a null doc_id is a document like any other.  The row
    with the least doc_id stays (null last; then the least digest of the text);
    a row repeated with that id and text stays once.  Rows without words stay.
    """
    sketched, groups = text_groups(docs.select("doc_id", "text"), shingle, percent, miss)
    rows = sketched.where("twin is not null").groupBy("doc_id", "mark").agg(F.first("twin").alias("twin"), F.count("*").alias("n"))
    rows = common.staged(rows.join(groups.select("twin", "group"), "twin"), "near-rows")
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "mark")
    # Only groups of several rows need a decision; written, so that a group of very many rows isn't dealt to one task.
    best = common.staged(rows.groupBy("group").agg(F.min(place).alias("best"), F.sum("n").alias("total")).where("total > 1").select("group", "best"), "near-best")
    judged = rows.join(common.checked_broadcast(best), "group").withColumn("stays", place == F.col("best"))
    judged = common.staged(judged.select("doc_id", "mark", "stays", "n").where("not stays or n > 1"), "near-judged")
    key = lambda other: F.col("d.doc_id").eqNullSafe(F.col(f"{other}.doc_id")) & (mark("d.text") == F.col(f"{other}.mark"))
    left = docs.alias("d").join(common.checked_broadcast(judged.where("not stays")).alias("x"), key("x"), "left_anti")
    again = judged.where("stays").select("doc_id", "mark")
    if again.isEmpty():
        return left
    again = common.checked_broadcast(again).alias("x")
    once = left.alias("d").join(again, key("x"), "left_semi").dropDuplicates(["doc_id", "text"])
    return left.alias("d").join(again, key("x"), "left_anti").unionByName(once)


def op10_fast_similarity_sketch(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: three-word shingles, similarity 0.85."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 85)
