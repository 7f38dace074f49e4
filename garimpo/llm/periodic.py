"""Periodic runs of words: a harmonic grid, prefix hashes and simultaneous binary searches.

A run is a maximal stretch of consecutive words with smallest period q (words q
apart are identical) that is at least ``max(LEAST, TIMES * q)`` words long.  In
such a stretch word i equals word i + q for at least ``max(LEAST, TIMES * q) - q``
places in a row, so one of these places is a multiple of that number.  The
multiples, for all periods together, are the grid: about n/3 ln n pairs of a
period and a place.  For all pairs at once, prefix hashes and binary search give
how far the words from the place, and before it, agree with those one period
on.  Pairs that lead to the same stretch are one; a stretch with several periods
keeps the least, which is its smallest.  Then every run is verified word by
word.  Equal words always have equal hashes, so a clash can only make a stretch
too long, which verification sees; the text is then done again with another
base.

Texts are independent: no shuffle, one pass, memory bounded by a text's words
and ``PAIRS`` pairs at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: A run holds so many words at least, and so many times its period.
LEAST, TIMES = 6, 4
#: Pairs of a period and a place that are looked at together.
PAIRS = 1 << 19
#: Two primes below 2^31: products of residues fit 64 bits.
PRIMES = (2147483647, 2147483629)


def _powers(base: int, n: int, prime: int) -> np.ndarray:
    """base^0 to base^n modulo a prime, by doubling."""
    out = np.ones(n + 1, np.uint64)
    have, step = 1, base % prime
    while have <= n:
        more = min(have, n + 1 - have)
        out[have : have + more] = out[:more] * np.uint64(step) % np.uint64(prime)
        have += more
        step = step * step % prime
    return out


class Prefixes:
    """Prefix hashes of a sequence of integers, modulo two primes."""

    def __init__(self, ids: np.ndarray, salt: int):
        rng = np.random.default_rng(salt)
        self.parts = []
        for prime in PRIMES:
            powers = _powers(int(rng.integers(1 << 20, prime - 1)), len(ids), prime)
            terms = (ids.astype(np.uint64) + np.uint64(1)) * powers[:-1] % np.uint64(prime)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)]) % np.uint64(prime)
            self.parts.append((np.uint64(prime), powers, sums))

    def equal(self, a: np.ndarray, apart: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the ``size`` numbers from ``a`` hash like those from ``a + apart``."""
        same = np.ones(len(a), bool)
        b = a + apart
        for prime, powers, sums in self.parts:
            left = (sums[a + size] + prime - sums[a]) % prime * powers[apart] % prime
            same &= left == (sums[b + size] + prime - sums[b]) % prime
        return same


def _longest(fits, most: np.ndarray) -> np.ndarray:
    """For each entry the largest size up to ``most`` that fits, by binary search over all entries at once; size 0 always does."""
    low, high = np.zeros(len(most), np.int64), most.copy()
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        middle = (low[open_] + high[open_] + 1) // 2
        good = fits(open_, middle)
        low[open_[good]] = middle[good]
        high[open_[~good]] = middle[~good] - 1


def _grid(n: int, least: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(periods, places) of all pairs, a bounded number at a time."""
    periods = np.arange(1, n // times + 1, dtype=np.int64)
    if n < least or not len(periods):
        return
    steps = np.maximum(least, times * periods) - periods
    counts = (n - periods - 1) // steps + 1
    ends = np.cumsum(counts)
    at = 0
    while at < len(periods):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        some = counts[at:to]
        number = np.arange(int(some.sum())) - np.repeat(np.cumsum(some) - some, some)
        yield np.repeat(periods[at:to], some), number * np.repeat(steps[at:to], some)
        at = to


def _stretches(ids: np.ndarray, least: int, times: int, salt: int) -> np.ndarray:
    """Rows (start, end, period), sorted, one for each stretch with its least period; by hashes."""
    n, found, hashes = len(ids), [], None
    for q, i in _grid(n, least, times):
        same = ids[i] == ids[i + q]
        q, i = q[same], i[same]
        if not len(q):
            continue
        hashes = hashes or Prefixes(ids, salt)
        ahead = _longest(lambda k, size, q=q, i=i: hashes.equal(i[k], q[k], size), n - i - q)
        back = _longest(lambda k, size, q=q, i=i: hashes.equal(i[k] - size, q[k], size), i)
        long = ahead + back + q >= np.maximum(least, times * q)
        found.append(np.stack([i - back, i + q + ahead, q], 1)[long])
    rows = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 3), np.int64)
    return rows[np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(1))] if len(rows) else rows


def runs_of(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (start, end, period) of all runs of a sequence of integers, sorted."""
    salt = 0
    while True:
        rows = _stretches(ids, least, times, salt)
        if all((ids[a : b - q] == ids[a + q : b]).all() for a, b, q in rows.tolist()):
            return rows
        salt += 1


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word; equal words, and only they, have equal numbers."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


RUN = "struct<start: bigint, length: bigint, period: bigint>"


def _finder(least: int, times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, spans, kept = [], [], []
            for text in common.byte_lists(b.column(1)):
                words = text.split()
                rows = runs_of(numbered(words), least, times)
                counts.append(len(words))
                spans.append([{"start": a, "length": e - a, "period": q} for a, e, q in rows.tolist()])
                if len(rows):
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, rows[:, 0] + rows[:, 2], 1)
                    np.add.at(edge, rows[:, 1], -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()]
                kept.append(b" ".join(words))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()).cast(pa.string())], ["key", "n_words", "runs", "collapsed"])

    return common.tidied(run)


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, key: str = "doc_id") -> DataFrame:
    """For every row of ``docs(key, text)``: its words, its periodic runs, and the text with every run cut to one period.

    ``-> (key, n_words, runs, collapsed)``; ``runs`` are sorted by start and
    period, ``collapsed`` is the kept words with one space between.  Words are
    runs of anything but the six ASCII white-space characters, unchanged.  A
    null or empty text has no words and no runs.  ``key`` may be a column of any
    type and is carried along; rows that share a key, or lack one, are separate
    texts and repeated rows get equal results.  Runs may overlap; a word goes if
    any run holds it after that run's first period.  An empty table gives no
    rows; other columns are ignored.
    """
    if times < 2 or least < 2:
        raise ValueError("a run repeats its period: times and least are 2 or more")
    common.small_batches(docs.sparkSession)
    source = docs.select(F.col(key).alias("key"), F.col("text").cast("string").alias("text"))
    found = source.mapInArrow(_finder(least, times), f"key {source.schema[0].dataType.simpleString()}, n_words bigint, runs array<{RUN}>, collapsed string")
    return found.withColumnRenamed("key", key)


def planted(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` where one text in ten repeats a stretch of its words up to its end.

    With h the crc32 of the decimal doc_id and g = h div 10: where h mod 10 is 0,
    the words from number a = g mod n on repeat the p words from there, p being
    1 + (n - a) div (3 + g mod 8).  A null doc_id or a text without words stays.
    """
    hashed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # Only texts that change are split, by a step of its own so that the words are made once.
    changed = docs.select("doc_id", "text", hashed.alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, words))
    n, g = F.size("w").cast("long"), F.floor(F.col("h") / 10)
    a = F.when(F.size("w") > 0, g % n)
    p = 1 + F.floor((n - a) / (3 + g % 8))
    placed = changed.withColumn("n", n).withColumn("a", a).withColumn("p", p)
    period = F.slice("w", (F.col("a") + 1).cast("int"), F.col("p").cast("int"))
    copies = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(period, copies)), F.lit(1), (F.col("n") - F.col("a")).cast("int"))
    whole = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), tail), " ")
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), whole).otherwise(F.col("text")).alias("text"))


def op11_harmonic_runs(spark, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, a tenth of which has one planted."""
    found = periodic_runs(planted(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    # Greatest length first; then the smallest start, then the smallest period.
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.less")).alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * -F.col("best.less") / F.col("best.period")).cast("long").alias("exponent_milli"), sha(listed).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"),
    )
