"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sources share the words of the whole corpus by weight; a target stops at
``CEILING`` times its source's size and the excess is shared anew among the
others.  A source's documents lie end to end, in an order given by hashes, and
are cut into blocks of equal size; its target is a quota of blocks.  Quotas are
exact integers.  The output's shards are the leaves of a binary tree: a node
splits its quotas between its two halves by one draw of the multivariate
hypergeometric distribution (source after source, each a hypergeometric draw
given those before), so that shards hold the sources as if all blocks had been
dealt out by one random permutation, and the quotas of the leaves add up to
those of the root.  A leaf's quota of a source is a range of that source's
draws; draw p is block ``permutation(p)``, a bijection that is computed
(swap-or-not rounds), so draws are disjoint, nothing is sorted to permute, and a
source that is taken more than once is permuted anew each time.  Blocks are put
in hashed order within their shard.

All steps are DataFrame expressions.  Random choices are hashes of the seed and
of what is chosen, so a mix is the same whenever and wherever it is made.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from . import common

WEIGHTS = (1, 2, 3)
CEILING = 3
#: Words of a block at most; a source is cut into ``BLOCKS`` blocks at least, if it has so many words.
BLOCK, BLOCKS = 512, 64
#: Words of an output shard, about.
SHARD_WORDS = 1 << 22
#: Rounds of the permutation, and standard deviations around the mode that draws are taken from.
ROUNDS, SPAN = 24, 10
#: Rows whose positions are summed up together, about.
SLICE_ROWS = 1 << 10
#: Levels of the tree that are one job.
LEVELS = 6


class Mix(NamedTuple):
    """``documents(doc_id, source, size, digest, copy, rank, source_size, target, at)``, ``pieces(rank, at, first, length, times, shard, place)`` and ``sources``."""

    documents: DataFrame
    pieces: DataFrame
    sources: DataFrame


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _uniform(*what: Column) -> Column:
    """A number from 0 (included) to 1 (excluded) that depends on ``what`` alone."""
    return F.shiftrightunsigned(F.xxhash64(*what), 11).cast("double") / F.lit(float(1 << 53))


def _sizes(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, size, digest, copies)``: rows that are equal in all of them are one, counted."""
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return rows.select("doc_id", "source", words.alias("size"), F.xxhash64("text").alias("digest")).groupBy("doc_id", "source", "size", "digest").agg(F.count("*").alias("copies"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """``(source, source_size, rank, weight, target)`` from ``sizes(source, size, copies)``.

    Sources are ranked by code point, null last, and take the weights in turn.
    Each round is one pass over a row a source: what the ceiling leaves over
    raises the share of the others.  The sums are of integers, hence exact in
    any order, and the share is one division.
    """
    totals = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    ranked = numbered(totals, F.asc_nulls_last("source"), column="rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    known = common.staged(ranked.withColumn("weight", weight), "sources")
    most = F.col("source_size") * ceiling
    all_words, free = known.agg(F.sum("source_size"), F.sum("weight")).first()
    share, left = 0.0, None
    while free and free != left:
        left = free
        share = ((all_words or 0) - (fixed if share else 0)) / free
        over = F.col("weight") * F.lit(share) > most
        fixed, free = known.agg(F.coalesce(F.sum(F.when(over, most)), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0))).first()
    return known.withColumn("target", F.least(F.col("weight") * F.lit(share), most.cast("double")))


def _quotas(sources: DataFrame) -> DataFrame:
    """Blocks and draws of each source: words of a block, full blocks, words of the tail, whole rounds, words of the last round, draws."""
    # The words to take, and a block's words.
    n = F.col("source_size")
    out = sources.withColumn("words", F.round("target").cast("long")).withColumn("block", F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(n / BLOCKS))).cast("long"))
    out = out.withColumn("full", F.floor(n / F.col("block")).cast("long")).withColumn("tail", n % F.col("block"))
    per_round = F.col("full") + (F.col("tail") > 0).cast("long")
    some = n > 0
    out = out.withColumn("rounds", F.when(some, F.floor(F.col("words") / F.greatest(n, F.lit(1)))).otherwise(0).cast("long")).withColumn("rest", F.when(some, F.col("words") % F.greatest(n, F.lit(1))).otherwise(0).cast("long"))
    return out.withColumn("per_round", per_round).withColumn("draws", F.col("rounds") * per_round + F.ceil(F.col("rest") / F.col("block")).cast("long"))


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many marked ones are among ``drawn`` of ``total`` things, ``marked`` of them marked; ``u`` is uniform in [0, 1).

    The distribution's weights are those of the mode times the ratios of
    neighbours, over ``SPAN`` standard deviations either way (all that a double
    can tell apart); ``u`` picks from mode upwards, then downwards.
    """

    def of(s: Column) -> Column:
        n, k, d = s["n"], s["k"], s["d"]
        mode = F.floor((d + 1).cast("double") * (k + 1) / (n + 2)).cast("long")
        sd = F.sqrt(F.greatest(F.lit(0.0), d.cast("double") / n * k * (n - k) / n * (n - d) / F.greatest(n - 1, F.lit(1))))
        reach = (F.ceil(SPAN * sd) + SPAN).cast("long")
        lo, hi = F.greatest(F.lit(0).cast("long"), d + k - n), F.least(d, k)
        return _let(
            F.struct(n.alias("n"), k.alias("k"), d.alias("d"), F.greatest(lo, F.least(hi, mode)).alias("m"), lo.alias("lo"), hi.alias("hi"), reach.alias("reach")),
            lambda p: _let(F.struct(*[p[c].alias(c) for c in "nkdm"], F.greatest(p["lo"], p["m"] - p["reach"]).alias("a"), F.least(p["hi"], p["m"] + p["reach"]).alias("b")), picked),
        )

    def side(p: Column, up: bool, beyond: Column) -> Column:
        """Over the values on one side of the mode: their weights' sum, and the first value at which it is over ``beyond``."""

        def step(acc: Column, i: Column) -> Column:
            j = i.cast("double")  # the value before, seen from the mode
            ratio = (p["k"] - j) * (p["d"] - j) / ((j + 1) * (p["n"] - p["k"] - p["d"] + j + 1)) if up else j * (p["n"] - p["k"] - p["d"] + j) / ((p["k"] - j + 1) * (p["d"] - j + 1))
            return _let(
                acc["w"] * ratio,
                lambda w: F.struct(w.alias("w"), (acc["sum"] + w).alias("sum"), F.coalesce(acc["found"], F.when(acc["sum"] + w > beyond, i + (1 if up else -1))).alias("found")),
            )

        at = F.when(p["b"] > p["m"], F.sequence(p["m"], p["b"] - 1)) if up else F.when(p["a"] < p["m"], F.sequence(p["m"], p["a"] + 1, F.lit(-1).cast("long")))
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), F.lit(None).cast("long").alias("found"))
        return F.aggregate(F.coalesce(at, F.array().cast("array<bigint>")), start, step)

    def picked(p: Column) -> Column:
        never = F.lit(float("inf"))
        return _let(
            F.struct(side(p, True, never)["sum"].alias("up"), side(p, False, never)["sum"].alias("down")),
            lambda s: _let(
                u * (s["up"] + s["down"] + 1),
                lambda x: F.when(x < 1, p["m"]).when(x < s["up"] + 1, F.coalesce(side(p, True, x - 1)["found"], p["b"])).otherwise(F.coalesce(side(p, False, x - 1 - s["up"])["found"], p["a"])),
            ),
        )

    simple = F.when((marked <= 0) | (drawn <= 0), F.lit(0).cast("long")).when(marked >= total, drawn).when(drawn >= total, marked)
    return simple.otherwise(_let(F.struct(total.alias("n"), marked.alias("k"), drawn.alias("d")), of))


def split_quotas(quotas: Column, drawn: Column, *name: Column) -> Column:
    """One multivariate-hypergeometric draw: of each quota the part that ``drawn`` random blocks of all take; ``name`` makes it random."""
    long0 = F.lit(0).cast("long")
    start = F.struct(F.aggregate(quotas, long0, lambda a, x: a + x).alias("n"), drawn.alias("d"), F.array().cast("array<bigint>").alias("out"))

    def step(acc: Column, quota: Column) -> Column:
        u = _uniform(*name, F.size(acc["out"]))
        return _let(hypergeometric(acc["n"], quota, acc["d"], u), lambda x: F.struct((acc["n"] - quota).alias("n"), (acc["d"] - x).alias("d"), F.array_append(acc["out"], x).alias("out")))

    return F.aggregate(quotas, start, step, lambda acc: acc["out"])


def leaves(root: DataFrame, shards: int, seed: int) -> DataFrame:
    """``(shard, quotas, froms)``, one row a shard, of a root's ``quotas``; ``froms`` are each source's draws before the shard's."""
    spark = root.sparkSession
    nodes = root.select(F.lit(0).cast("long").alias("first"), F.lit(shards).cast("long").alias("shards"), "quotas", F.transform("quotas", lambda q: q * 0).alias("froms"))
    level = 0
    while 1 << level < shards:
        left_shards = F.floor(F.col("shards") / 2).cast("long")
        total = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, x: a + x)
        # Blocks go to the halves by their numbers of shards.
        share = F.floor(total * left_shards / F.col("shards")).cast("long")
        cut = nodes.withColumn("left", F.when(F.col("shards") > 1, split_quotas(F.col("quotas"), share, F.lit(seed), F.col("first"), F.col("shards"))))
        rest, after = F.zip_with("quotas", "left", lambda a, b: a - b), F.zip_with("froms", "left", lambda a, b: a + b)
        one = F.struct("first", "shards", "quotas", "froms")
        half = F.struct("first", left_shards.alias("shards"), F.col("left").alias("quotas"), "froms")
        other = F.struct((F.col("first") + left_shards).alias("first"), (F.col("shards") - left_shards).alias("shards"), rest.alias("quotas"), after.alias("froms"))
        nodes = cut.select(F.explode(F.when(F.col("shards") > 1, F.array(half, other)).otherwise(F.array(one))).alias("x")).select("x.*")
        level += 1
        if level % LEVELS == 0 and 1 << level < shards:
            nodes = common.staged(nodes, "tree").repartition(min(1 << level, int(spark.conf.get("spark.sql.shuffle.partitions"))), "first")
    return nodes.select(F.col("first").alias("shard"), "quotas", "froms")


def permuted(x: Column, n: Column, *name: Column) -> Column:
    """A bijection of 0 .. n-1 that ``name`` determines: ``ROUNDS`` rounds of swap-or-not."""

    def step(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*name, r), n) - at, n)
        return _let(other, lambda y: F.when(F.xxhash64(*name, r, F.greatest(at, y), F.lit("swap")).bitwiseAND(F.lit(1)) == 1, y).otherwise(at))

    return F.when(n > 1, F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x, step)).otherwise(x)


def _placed(sizes: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """Documents with ``at``, the words of their source before them, in hashed order.

    Sums run within slices of about ``SLICE_ROWS`` rows, then over the slices of
    a stretch, then over a source's stretches: no task holds all of a source.
    """
    bits = max(2, (max(1, sizes.count()) // SLICE_ROWS).bit_length())
    about = sources.select(F.col("source").alias("_source"), "rank", "source_size", "target")
    key = F.xxhash64(F.lit(seed), "doc_id", "size", "digest")
    d = sizes.join(common.checked_broadcast(about), F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("_key", key).withColumn("_slice", F.shiftrightunsigned("_key", 64 - bits))
    words = F.col("size") * F.col("copies")
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = d.groupBy("rank", "_slice").agg(F.sum(words).alias("_n")).withColumn("_stretch", F.shiftright("_slice", bits // 2))
    long = sums.groupBy("rank", "_stretch").agg(F.sum("_n").alias("_n")).withColumn("_long", before(W.partitionBy("rank").orderBy("_stretch"), "_n")).drop("_n")
    offsets = sums.withColumn("_short", before(W.partitionBy("rank", "_stretch").orderBy("_slice"), "_n")).join(long, ["rank", "_stretch"]).select("rank", "_slice", (F.col("_long") + F.col("_short")).alias("_before"))
    inside = before(W.partitionBy("rank", "_slice").orderBy("_key", "doc_id", "size", "digest"), words)
    rows = d.withColumn("_inside", inside).join(offsets, ["rank", "_slice"])
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return rows.select("doc_id", "source", "size", "digest", "copy", "rank", "source_size", "target", (F.col("_before") + F.col("_inside") + F.col("copy") * F.col("size")).alias("at"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING, seed: int = 0, shard_words: int = SHARD_WORDS) -> Mix:
    """A mix of ``docs(doc_id, text, source)`` as long as all of them, with sources near their targets.

    Words are runs of anything but the six ASCII white-space characters; a null
    text has none.  Of each source ``round(target)`` words are taken, its blocks
    all as often, give or take once; blocks cut documents.  A null source is a
    source, the last; sources without words take none.  Rows that are equal in
    doc_id, source and text are separate documents that lie side by side;
    nothing depends on the order or the partitions of the table.  An empty table
    gives an empty mix; other columns are ignored.  A row of the tree holds a
    number for each source.  The last words of a source (less than a block) come
    last in each of its rounds.
    """
    if not weights or min(weights) < 1 or ceiling < 1:
        raise ValueError("weights and the ceiling are 1 or more")
    sizes = common.staged(_sizes(docs), "sizes")
    sources = common.staged(_quotas(targets(sizes, weights, ceiling)), "quotas")
    documents = common.staged(_placed(sizes, sources, seed), "placed")
    words, = sources.agg(F.coalesce(F.sum("words"), F.lit(0))).first()
    shards = max(1, -(-words // shard_words))
    in_turn = F.transform(F.array_sort(F.collect_list(F.struct("rank", "draws"))), lambda x: x["draws"])
    cut = leaves(sources.agg(in_turn.alias("quotas")), shards, seed)
    about = common.checked_broadcast(sources.select("rank", "block", "full", "tail", "rounds", "rest", "per_round"))
    each = cut.repartition(min(shards, 4 * docs.sparkSession.sparkContext.defaultParallelism + shards // 64), "shard").select("shard", F.posexplode(F.arrays_zip("quotas", "froms")).alias("rank", "x")).where("x.quotas > 0")
    draws = each.select("shard", F.col("rank").cast("long").alias("rank"), F.explode(F.sequence("x.froms", F.col("x.froms") + F.col("x.quotas") - 1)).alias("draw")).join(about, "rank")
    draws = draws.withColumn("round", F.floor(F.col("draw") / F.col("per_round")).cast("long")).withColumn("turn", F.col("draw") % F.col("per_round"))
    number = F.when(F.col("turn") >= F.col("full"), F.col("full")).otherwise(permuted(F.col("turn"), F.col("full"), F.lit(seed), F.col("rank"), F.col("round")))
    draws = draws.withColumn("number", number).withColumn("_size", F.when(F.col("turn") >= F.col("full"), F.col("tail")).otherwise(F.col("block")))
    # The last draw takes only what is left of the target.
    end = F.col("number") * F.col("block") + F.when(F.col("round") < F.col("rounds"), F.col("_size")).otherwise(F.least(F.col("_size"), F.col("rest") - F.col("turn") * F.col("block")))
    place = F.row_number().over(W.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "rank", "draw", F.lit("place")), "rank", "draw")) - 1
    drawn = draws.select("rank", "number", "shard", F.col("round").alias("times"), (F.col("number") * F.col("block")).alias("_lo"), end.alias("_hi"), place.alias("place"))
    blocks = F.sequence(F.floor(F.col("at") / F.col("block")).cast("long"), F.floor((F.col("at") + F.col("size") - 1) / F.col("block")).cast("long"))
    lying = documents.where("size > 0").join(about.select("rank", "block"), "rank").select("rank", "at", "size", F.explode(blocks).alias("number"))
    # Spark takes the draws for as few as the shards that they come from, and would broadcast them.
    met = lying.join(drawn.hint("merge"), ["rank", "number"]).withColumn("_from", F.greatest("at", "_lo")).withColumn("_to", F.least(F.col("at") + F.col("size"), F.col("_hi"))).where("_from < _to")
    pieces = met.select("rank", "at", (F.col("_from") - F.col("at")).alias("first"), (F.col("_to") - F.col("_from")).alias("length"), "times", "shard", "place")
    return Mix(documents, pieces, sources)


def taken(mixed: Mix) -> DataFrame:
    """``(doc_id, size, source_size, target, taken, n_pieces, n_shards)``: a row for each document, taken or not."""
    by_piece = mixed.pieces.groupBy("rank", "at").agg(F.sum("length").alias("_taken"), F.count("*").alias("_pieces"), F.size(F.collect_set("shard")).cast("long").alias("_shards"))
    # Where a document begins names it among those with words; those without any share places and take none.
    placed = mixed.documents.withColumn("_at", F.when(F.col("size") > 0, F.col("at")))
    found = placed.join(by_piece.withColumnRenamed("at", "_at"), ["rank", "_at"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return found.select("doc_id", "size", "source_size", "target", zero(F.col("_taken")).alias("taken"), zero(F.col("_pieces")).alias("n_pieces"), zero(F.col("_shards")).alias("n_shards"))


def texts(docs: DataFrame, mixed: Mix) -> DataFrame:
    """The mix itself: ``(shard, place, rank, at, first, times, doc_id, source, text)``; a shard's order is that of place, at and first."""
    one = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text")).withColumn("digest", F.xxhash64("text")).dropDuplicates(["doc_id", "source", "digest"])
    d, m = one.alias("d"), mixed.documents.where("size > 0").join(mixed.pieces, ["rank", "at"]).alias("m")
    same = F.col("m.doc_id").eqNullSafe(F.col("d.doc_id")) & F.col("m.source").eqNullSafe(F.col("d.source")) & (F.col("m.digest") == F.col("d.digest"))
    words = F.filter(F.split("d.text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    part = F.array_join(F.slice(words, (F.col("m.first") + 1).cast("int"), F.col("m.length").cast("int")), " ")
    return m.join(d, same).select("m.shard", "m.place", "m.rank", "m.at", "m.first", "m.times", "m.doc_id", "m.source", part.alias("text"))


def op13_splitting_tree_mix(spark, sf_dir: str) -> DataFrame:
    """All documents mixed, the sources' weights 1, 2, 3 and so on in turn."""
    return taken(mix(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def mix_targets(spark, sf_dir: str) -> DataFrame:
    """The target of every source, and the words that the mix takes of it."""
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    words = mixed.pieces.groupBy("rank").agg(F.sum("length").alias("taken"))
    return mixed.sources.join(words, "rank", "left").select("source", "source_size", "weight", F.round("target", 3).alias("target"), F.coalesce("taken", F.lit(0)).alias("taken"))
