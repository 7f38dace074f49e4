"""Language ID by rank-order n-gram profiles (out-of-place distance).

A language's profile is the order of its ``PROFILE`` most frequent character
n-grams (one to three letters, words padded by a blank) over all training
documents.  A document's own order is compared to each profile: every one of
its n-grams costs the difference of the two ranks, one that the profile lacks
costs the most; the language with the least sum is predicted.

Training counts cover every training row: workers count their batches and the
counts are added up before they shuffle.  Only the profiles (``PROFILE`` rows a
language) reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

PROFILE = 400
NONE = "und"
#: N-grams of a language that a worker sorts at a time, and distinct ones that it holds before they are sent off.
HELD_GRAMS, HELD_COUNTS = 1_500_000, 1_000_000


def _letters() -> np.ndarray:
    """For each code point its lower-case letter (itself if it has no single one), 0 for what isn't a letter."""
    table = np.zeros(0x110000, np.int32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


_table: list[np.ndarray] = []


def letters(text: str) -> np.ndarray:
    """Letters of a text as code points, runs of anything else as one 0, with a 0 at either end; empty if it has none."""
    if not _table:
        _table.append(_letters())
    x = _table[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
    x = np.concatenate([[0], x, [0]])
    x = x[np.append(True, (x[1:] != 0) | (x[:-1] != 0))]
    return x if len(x) > 1 else np.empty(0, np.int64)


def ngrams(x: np.ndarray) -> np.ndarray:
    """All 1- to 3-grams of a letter array, 21 bits a character; the blank alone isn't one."""
    one = x[x != 0]
    x = np.maximum(x, 1)  # the blank as 1, so that no n-gram is a shorter one
    two = x[:-1] << 21 | x[1:]
    return np.concatenate([one, two, two[:-1] << 21 | x[2:]])


def counted(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = np.sort(grams)
    first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    return s[first], np.diff(np.append(first, len(s)))


def order(grams: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The most frequent n-grams in descending order of count; ties by n-gram."""
    if len(counts) > most:
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        keep = counts >= least
        grams, counts = grams[keep], counts[keep]
    return grams[np.lexsort((grams, -counts))[:most]]


class _Counts:
    """Running n-gram counts of a language."""

    def __init__(self):
        self.parts, self.size = [], 0
        self.grams, self.n = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, grams: np.ndarray) -> None:
        self.parts.append(grams)
        self.size += len(grams)
        if self.size >= HELD_GRAMS:
            self.merge()

    def merge(self) -> None:
        if self.parts:
            grams, n = counted(np.concatenate(self.parts))
            both, weights = np.concatenate([self.grams, grams]), np.concatenate([self.n, n])
            order_ = np.argsort(both, kind="stable")
            both, weights = both[order_], weights[order_]
            first = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
            self.grams, self.n = both[first], np.add.reduceat(weights, first)
            self.parts, self.size = [], 0

    def row_batch(self, lang: str) -> pa.RecordBatch:
        self.merge()
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(self.grams), pa.string()), pa.array(self.grams), pa.array(self.n)], ["lang", "gram", "n"])


@common.tidied
def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, _Counts] = {}
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x = letters(text)
            if len(x):
                held.setdefault(lang, _Counts()).add(ngrams(x))
        if sum(len(c.grams) for c in held.values()) > HELD_COUNTS:
            yield from (c.row_batch(lang) for lang, c in held.items())
            held = {}
    yield from (c.row_batch(lang) for lang, c in held.items())


class Profiles:
    """Ranks of n-grams in each language's profile."""

    def __init__(self, rows: list[tuple[str, int, int]], most: int):
        self.languages = sorted({r[0] for r in rows})
        self.most = most
        self.grams = np.array(sorted({r[1] for r in rows}), np.int64)
        self.ranks = np.full((len(self.grams), max(1, len(self.languages))), most, np.int64)
        lang = {x: i for i, x in enumerate(self.languages)}
        at = np.searchsorted(self.grams, [r[1] for r in rows])
        for i, (name, _, rank) in zip(at.tolist(), rows, strict=True):
            self.ranks[i, lang[name]] = rank

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score); the score is the winner's share under a soft maximum of the mean rank differences."""
        x = letters(text) if text else ()
        if not len(x) or not self.languages:
            return NONE, 0.0
        mine = order(*counted(ngrams(x)), self.most)
        at = np.minimum(np.searchsorted(self.grams, mine), len(self.grams) - 1)
        known = self.grams[at] == mine
        ranks = self.ranks[at]
        own = np.arange(len(mine))[:, None]
        cost = np.where(known[:, None] & (ranks < self.most), np.abs(ranks - own), self.most).sum(0) / (len(mine) * self.most)
        best = int(np.argmin(cost))
        return self.languages[best], 1 / sum(math.exp(-25 * (c - cost[best])) for c in cost.tolist())


def train(rows: DataFrame, most: int = PROFILE) -> Profiles:
    """Profiles from all of ``rows(lang, text)`` with neither null."""
    common.small_batches(rows.sparkSession)
    counts = rows.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and text is not null").mapInArrow(_count_batches, "lang string, gram long, n long")
    total = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = lambda *by: F.row_number().over(W.partitionBy("lang", *by).orderBy(F.desc("n"), "gram")) - 1
    # Ranked in 32 parts of each language first, so that no task sorts a language's whole tail.
    best = total.withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(32))).withColumn("rank", rank("part")).where(F.col("rank") < most)
    ranked = best.withColumn("rank", rank()).where(F.col("rank") < most)
    return Profiles([(r.lang, r.gram, r.rank) for r in ranked.select("lang", "gram", "rank").collect()], most)


def _predictor(profiles):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = profiles.value
        for b in batches:
            out = [p.predict(t) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], [*b.schema.names, "lang_pred", "score"])

    return common.tidied(run)


def predict(docs: DataFrame, profiles: Profiles, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (columns ``keep``, ``text`` last) with ``lang_pred`` and ``score`` (0 to 1).

    A null text, or one without a letter, is ``und`` with score 0.  Rows are
    judged one by one; repeated rows get equal results, an empty table none.
    """
    common.small_batches(docs.sparkSession)
    source = docs.select(*(keep or ["doc_id"]), F.col("text").cast("string").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields)
    return source.mapInArrow(_predictor(docs.sparkSession.sparkContext.broadcast(profiles)), f"{schema}, lang_pred string, score double")


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op7_rank_order_language(spark, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from three quarters of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = predict(docs.select("doc_id", "text"), train(docs.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", F.round("score", 6).alias("score"))
