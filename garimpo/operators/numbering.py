"""Gapless numbers for the rows of a distributed table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..staging import checked_broadcast, staged

_PLACE = "_place"


def numbered(df: DataFrame, *order: Column, column: str = "id", first: int = 0) -> DataFrame:
    """``df`` with a ``column`` of consecutive numbers from ``first`` on, in the given order.

    Each partition counts its own rows; the counts' running sum (a row for each
    partition) gives every partition its offset.  With an ``order`` rows are
    dealt out by ranges of it first, so that each task sorts its own range and
    nothing is sorted as a whole; equal rows are numbered one after the other in
    some order.  Without one, rows are numbered as the table holds them, and
    nothing shuffles.  The rows are written once: numbers don't change when a
    task runs again.  An empty table stays empty.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    rows = staged(dealt.withColumn(_PLACE, F.monotonically_increasing_id()), "numbered")
    # Such an id is the partition's number in the upper bits, the row's place in it in the lower 33.
    part, place = F.shiftright(F.col(_PLACE), 33), F.col(_PLACE).bitwiseAND(F.lit((1 << 33) - 1))
    counts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select("part", F.coalesce(before, F.lit(0)).alias("_before"))
    at = rows.withColumn("_part", part).join(checked_broadcast(offsets), F.col("_part") == F.col("part"))
    return at.select(*[F.col(f"`{c}`") for c in df.columns if c != column], (F.col("_before") + place + first).alias(column))


def ranked(df: DataFrame, by: list[str], *order: Column, column: str = "rank") -> DataFrame:
    """``df`` with ranks from 1 within the groups of ``by``, in the given order, whatever the size of a group.

    Rows are numbered through, group after group; a group's least number is
    taken off.  Unlike a window, no task holds a group.  Null groups are groups.
    """
    rows = numbered(df, *[F.asc_nulls_first(c) for c in by], *order, column=column)
    first = staged(rows.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.min(column).alias("_first")), "groups")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    return rows.join(checked_broadcast(first), same).select(*[F.col(f"`{c}`") for c in df.columns if c != column], (F.col(column) - F.col("_first") + 1).alias(column))
