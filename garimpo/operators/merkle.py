"""A tree of SHA-256 digests over a table: one root for its content, and the way to what differs.

Rows go to leaves by the first bits of their key's hash; a leaf's digest is that
of its rows' digests in the order of their keys, a node's that of its two
children's.  A changed, added or lost row, and a row under another key, changes
its leaf and the nodes above it, and nothing else: two tables are compared from
the root downwards, or leaf by leaf.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import staged

#: Rows of a leaf, about.
LEAF_ROWS = 1024
#: The deepest tree: 2^30 leaves.
DEEPEST = 30


def tree(rows: DataFrame, key: str = "id", depth: int | None = None) -> DataFrame:
    """``(level, node, digest, rows)``: all nodes, the root at level 0.

    All columns count, in the order of their names, nulls included.  Rows with
    one key (or none) are ordered by their digests.  ``depth`` fixes the number of levels, to
    compare with another tree; without one it goes by the number of rows.
    """
    columns = sorted(rows.columns)
    content = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`").alias(c) for c in columns]), {"ignoreNullFields": "false"}).cast("binary"), 256)
    each = rows.select(F.col(f"`{key}`").alias("k"), content.alias("d"))
    if depth is None:
        depth = min(DEEPEST, (max(0, rows.count() - 1) // LEAF_ROWS).bit_length())
    leaf = F.shiftrightunsigned(F.xxhash64("k"), 64 - depth) if depth else F.lit(0).cast("long")
    digest = lambda c: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["d"]), "").cast("binary"), 256)
    leaves = each.groupBy(leaf.alias("node")).agg(digest(F.struct("k", "d")).alias("digest"), F.count("*").alias("rows"))
    out = now = staged(leaves.select(F.lit(depth).alias("level"), "node", "digest", "rows"), "leaves")
    for level in range(depth - 1, -1, -1):
        up = now.groupBy(F.shiftright("node", 1).alias("node")).agg(digest(F.struct("node", F.concat(F.col("node").bitwiseAND(F.lit(1)).cast("string"), F.lit(":"), "digest").alias("d"))).alias("digest"), F.sum("rows").alias("rows"))
        now = up.select(F.lit(level).alias("level"), "node", "digest", "rows")
        if level % 8 == 0:
            now = staged(now, "nodes")
        out = out.unionByName(now)
    return out


def root(nodes: DataFrame) -> str:
    """The root's digest; of an empty table that of no bytes."""
    found = nodes.where("level = 0").select("digest").collect()
    return found[0].digest if found else "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(level, node, rows_a, rows_b)`` of the leaves that two trees of one depth don't share."""
    leaves = lambda t, n: t.join(F.broadcast(t.agg(F.max("level").alias("level"))), "level").select("level", "node", F.col("digest").alias(f"digest_{n}"), F.col("rows").alias(f"rows_{n}"))
    both = leaves(a, "a").join(leaves(b, "b"), ["level", "node"], "full_outer")
    return both.where(~F.col("digest_a").eqNullSafe(F.col("digest_b"))).select("level", "node", F.coalesce("rows_a", F.lit(0)).alias("rows_a"), F.coalesce("rows_b", F.lit(0)).alias("rows_b"))


def rows_of(rows: DataFrame, leaves: DataFrame, key: str = "id") -> DataFrame:
    """The rows of some leaves ``(level, node)`` of one level."""
    depth = leaves.agg(F.coalesce(F.max("level"), F.lit(0)).alias("d")).first().d
    leaf = F.shiftrightunsigned(F.xxhash64(F.col(f"`{key}`")), 64 - depth) if depth else F.lit(0).cast("long")
    return rows.withColumn("_node", leaf).join(F.broadcast(leaves.select(F.col("node").alias("_node"))), "_node", "left_semi").drop("_node")
