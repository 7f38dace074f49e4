"""Ranked lexical search, score at a time over impact-ordered postings.

A term's contribution to a document's score, its impact, is an exact integer.
Each shard of documents holds, for every term of the queries, its postings in
groups of equal impact, greatest first.  A query takes the groups of all its
terms in descending order of impact and adds them to accumulators, down to a
level that falls step by step.  What the terms have left bounds what any
document can still gain; once a document that has gained nothing could not reach
the k-th best score so far, only documents whose accumulator and that bound
together reach it are candidates.  Their scores are completed from the shard's
rows, so ranks and scores are exact.

Documents are split into terms once: the postings of the queries' terms are
written to the shared folder, the terms' document frequencies are counted from
them, and the search reads them shard by shard.  A task carries the best k of
each query from shard to shard, so later shards stop earlier, and passes on k
rows for each query, which are ranked in parts first.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Documents that are returned for each query.
TOP = 50
#: Postings, and documents, of a shard; bound a worker's memory.
SHARD_POSTINGS, SHARD_DOCS = 1_500_000, 1 << 16
#: Words of the queries that are searched (and broadcast) together.
BLOCK_WORDS = 2_000_000
#: Each step goes down to this share of the greatest impact that is left.
STEP = 0.7

_LETTERS = [b for b in range(256) if b >= 0x80 or chr(b).isalnum()]
#: A-Z in lower case, other ASCII letters, digits and all bytes beyond ASCII as they are, the rest as blanks.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b in _LETTERS else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


class Queries:
    """Queries of a block: a number for each distinct term, and each query's terms, once each."""

    def __init__(self, rows: list[tuple[object, bytes]]):
        self.numbers: dict[bytes, int] = {}
        terms: dict[object, set[int]] = {}
        for name, text in rows:
            mine = terms.setdefault(name, set())
            for t in terms_of(text):
                mine.add(self.numbers.setdefault(t, len(self.numbers)))
        self.names = [name for name, mine in terms.items() if mine]
        self.terms = [np.array(sorted(mine), np.int64) for mine in terms.values() if mine]


class Statistics:
    """What a corpus says of the queries' terms: documents, all their terms, and each term's weight."""

    def __init__(self, docs: int, length: int, frequency: dict[int, int], terms: int):
        self.docs, self.length = docs, length
        self.weights = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * frequency.get(t, 0) + 1))) for t in range(terms)], np.int64)

    def impacts(self, terms: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Exact contributions of terms that occur ``tf`` times in documents of ``n`` terms."""
        m = 50 + (50 * n * self.docs) // max(1, self.length)
        return self.weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


POSTINGS = "doc_id bigint, n bigint, terms array<int>, tf array<int>"


def _splitter(queries):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = queries.value.numbers
        for b in batches:
            rows, sizes, ends, terms, tf = [], [], [0], [], []
            for i, text in enumerate(common.byte_lists(b.column(1))):
                words = terms_of(text)
                if words:
                    rows.append(i)
                    sizes.append(len(words))
                    for t, c in Counter(words).items():
                        if (number := numbers.get(t)) is not None:
                            terms.append(number)
                            tf.append(c)
                    ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tf)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "tf"])

    return common.tidied(run)


def _frequencies(terms: int):
    """Partial document frequencies of a task; -1 counts documents, -2 all their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, docs, length = np.zeros(terms, np.int64), 0, 0
        for b in batches:
            counts += np.bincount(b.column(1).flatten().to_numpy(), minlength=terms)
            docs += b.num_rows
            length += int(b.column(0).to_numpy().sum())
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([at, [-1, -2]])), pa.array(np.concatenate([counts[at], [docs, length]]))], ["term", "n"])

    return common.tidied(run)


class Shard:
    """Impact-ordered postings of some documents, which are sorted by doc_id (nulls last)."""

    def __init__(self, docs: np.ndarray, terms: np.ndarray, impacts: np.ndarray, size: int):
        """``docs`` (ascending), ``terms`` and ``impacts`` of each posting; ``size`` documents."""
        some = impacts > 0
        docs, terms, impacts = docs[some], terms[some], impacts[some]
        self.size = size
        self.rows = np.searchsorted(docs, np.arange(size + 1))
        self.row_terms, self.row_impacts = terms, impacts
        order = np.lexsort((docs, -impacts, terms))
        self.docs, self.impacts, terms = docs[order], impacts[order], terms[order]
        first = np.flatnonzero(np.append(True, (terms[1:] != terms[:-1]) | (self.impacts[1:] != self.impacts[:-1]))) if len(terms) else np.empty(0, np.int64)
        self.group_start = np.append(first, len(terms))
        self.group_less = -self.impacts[first]  # ascending within a term
        self.group_term = terms[first]
        self.read = 0  # postings that queries added up, of `held` that their terms have
        self.held = 0

    def scores(self, docs: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Complete scores of documents; ``wanted`` marks the query's terms."""
        lo, hi = self.rows[docs], self.rows[docs + 1]
        size = hi - lo
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(lo - (ends - size), size)
        sums = np.concatenate([[0], np.cumsum(self.row_impacts[at] * wanted[self.row_terms[at]])])
        return sums[ends] - sums[ends - size]

    def search(self, terms: np.ndarray, wanted: np.ndarray, k: int, least: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores): all that score at least ``least`` (over 0) and the k-th best of the shard; ``sums`` holds zeros."""
        at = np.searchsorted(self.group_term, terms).tolist()
        ends = np.searchsorted(self.group_term, terms, "right").tolist()
        self.held += int((self.group_start[ends] - self.group_start[at]).sum())
        less = self.group_less
        left = [-int(less[a]) if a < e else 0 for a, e in zip(at, ends, strict=True)]
        least = max(1, least)
        while (rest := sum(left)) >= least:
            level = max(1, math.floor(STEP * max(left)))
            for j, most in enumerate(left):
                if most >= level:
                    to = at[j] + int(np.searchsorted(less[at[j] : ends[j]], -level, "right"))
                    a, b = self.group_start[at[j]], self.group_start[to]
                    sums[self.docs[a:b]] += self.impacts[a:b]
                    self.read += int(b - a)
                    at[j] = to
                    left[j] = -int(less[to]) if to < ends[j] else 0
            # A k-th best so far can't be more than the best; only then is it worth its while.
            if self.size >= k and (rest := sum(left)) < int(sums.max()):
                least = max(least, int(np.partition(sums, self.size - k)[self.size - k]))
        docs = np.flatnonzero(sums + rest >= least)
        found = self.scores(docs, wanted) if rest else sums[docs]
        keep = found >= least
        sums[:] = 0
        return docs[keep], found[keep]


def _best(scores: np.ndarray, ids: np.ndarray, empty: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, empty, -scores))[:k]


def _searcher(queries, statistics, k: int, postings: int, most_docs: int, kind):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, s = queries.value, statistics.value
        none = np.empty(0, np.int64)
        best = [(none, none, np.empty(0, bool))] * len(q.names)
        held: list[pa.RecordBatch] = []

        def flush():
            table = pa.Table.from_batches(held).combine_chunks()
            ids = table.column(0).combine_chunks()
            empty, ids = np.asarray(ids.is_null()), ids.fill_null(0).to_numpy()
            order = np.lexsort((ids, empty))
            ids, empty = ids[order], empty[order]
            lists = table.column(2).combine_chunks()
            sizes = np.diff(lists.offsets.to_numpy())
            doc = np.repeat(np.argsort(order), sizes)
            terms, tf, n = lists.flatten().to_numpy().astype(np.int64), table.column(3).combine_chunks().flatten().to_numpy().astype(np.int64), np.repeat(table.column(1).to_numpy(), sizes)
            by_doc = np.argsort(doc, kind="stable")
            shard = Shard(doc[by_doc], terms[by_doc], s.impacts(terms, tf, n)[by_doc], len(ids))
            sums, wanted = np.zeros(len(ids), np.int64), np.zeros(len(s.weights), np.int64)
            for i, mine in enumerate(q.terms):
                wanted[mine] = 1
                docs, found = shard.search(mine, wanted, k, int(best[i][0][-1]) if len(best[i][0]) == k else 0, sums)
                wanted[mine] = 0
                if len(docs):
                    both = [np.concatenate(x) for x in zip(best[i], (found, ids[docs], empty[docs]), strict=True)]
                    keep = _best(*both, k)
                    best[i] = tuple(x[keep] for x in both)

        size = docs = 0
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                some = b.slice(at, 1000)
                held.append(some)
                size += len(some.column(2).flatten())
                docs += some.num_rows
                if size >= postings or docs >= most_docs:
                    flush()
                    held.clear()
                    size = docs = 0
        if held:
            flush()
        for i, (scores, ids, empty) in enumerate(best):
            if len(scores):
                yield pa.RecordBatch.from_arrays([pa.array([q.names[i]] * len(scores), kind), pa.array(ids, pa.int64(), mask=empty), pa.array(scores)], ["item_id", "doc_id", "score"])

    return common.tidied(run)


def _blocks(items: DataFrame, block_words: int) -> Iterator[Queries]:
    """Queries in blocks of about so many words at most; the rows of one item_id are in one block."""
    some = items.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null")
    chars = some.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-chars // (2 * block_words)))  # a term and its gap take two characters at least
    for k in range(n):
        part = some if n == 1 else some.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k)
        yield Queries([(r[0], r[1].encode("utf-8", "surrogatepass")) for r in part.collect()])


def search(docs: DataFrame, items: DataFrame, k: int = TOP, block_words: int = BLOCK_WORDS, postings: int = SHARD_POSTINGS, most_docs: int = SHARD_DOCS) -> DataFrame:
    """The ``k`` highest-scoring rows of ``docs(doc_id, text)`` for each of ``items(item_id, text)``: ``(item_id, rank, doc_id, score)``.

    Terms are runs of ASCII letters and digits and of characters beyond ASCII,
    only A-Z lower-cased; a query takes each of its terms once.  Only scores
    above 0 count; equal scores are ranked by ascending doc_id, nulls last.
    Rows of ``items`` that share an item_id (or lack one) are one query; null
    texts, and texts without terms, find nothing and are not found.  Rows that
    share a doc_id (or lack one) are separate documents: all of them may be
    ranked.  Other columns are ignored; an empty table on either side gives no
    rows.  Queries of more than ``block_words`` words are searched block by
    block, each with a pass over the documents.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    item = items.select("item_id").schema[0].dataType
    out = None
    for queries in _blocks(items, block_words):
        sent = spark.sparkContext.broadcast(queries)
        split = common.staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_splitter(sent), POSTINGS), "postings")
        counted = split.select("n", "terms").mapInArrow(_frequencies(len(queries.numbers)), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
        counts = {r.term: r.n for r in counted.collect()}  # a row for each term of the block at most
        statistics = spark.sparkContext.broadcast(Statistics(counts.pop(-1, 0), counts.pop(-2, 0), counts, len(queries.numbers)))
        found = split.mapInArrow(_searcher(sent, statistics, k, postings, most_docs, _arrow(item)), f"item_id {item.simpleString()}, doc_id bigint, score bigint")
        out = found if out is None else out.unionByName(found)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    # Ranked in parts first, so that no task sorts what all tasks found for an item.
    part = F.pmod(F.xxhash64("doc_id", "score"), F.lit(16))
    some = out.withColumn("part", part).withColumn("rank", F.row_number().over(W.partitionBy("item_id", "part").orderBy(*order))).where(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def op12_impact_ordered_search(spark, sf_dir: str) -> DataFrame:
    """The 50 best documents for every benchmark item."""
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
