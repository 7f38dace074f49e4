"""Benchmark decontamination with an FM-index over each shard of the training text.

Words are lower-cased runs of letters, digits and non-ASCII characters.  A
benchmark item gives its windows of ``window`` consecutive words (an item of
fewer words is one window).  Each worker takes documents in shards; what no
window can match is left out first (a run of words that all occur in the
benchmark, as long as the shortest window, is needed), the rest is indexed:

* suffix array of the shard's word ids (prefix doubling), its Burrows-Wheeler
  transform in a wavelet tree with block ranks, and every 16th position sampled;
* all windows are searched backward together, one rank step a word;
* occurrences are located by stepping to the next sampled position;
* spans are merged within each document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 10
#: Benchmark words held by a worker at a time; more are searched block by block.
BLOCK_WORDS = 2_000_000
#: Words of a shard (before runs without a possible match are left out) and indexed words at most, but for one long document.
SHARD_WORDS, INDEX_WORDS = 1_500_000, 500_000
SAMPLE = 16

#: Bytes of words, A-Z lower-cased; all others become spaces.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


# ---------------------------------------------------------------- index

def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start positions of the sorted suffixes of an integer text (prefix doubling)."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64)
    step = 1
    while True:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1 if step < n else 0
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(False, ordered[1:] != ordered[:-1]))
        if rank[order[-1]] == n - 1:
            return order
        step *= 2


class Bits:
    """A bit vector with constant-time rank through 64-bit words and counts before each."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """How many ones precede each position."""
        w, r = i >> 6, (i & 63).astype(np.uint64)
        low = self.words[w] & ((np.uint64(1) << r) - np.uint64(1))
        return self.before[w] + np.bitwise_count(low)

    def at(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class WaveletTree:
    """Ranks and symbols of a sequence over 0 .. 2^levels - 1, one bit vector a level (zeros before ones)."""

    def __init__(self, values: np.ndarray, levels: int):
        self.levels: list[tuple[int, Bits, int]] = []
        v = values
        for k in reversed(range(levels)):
            bit = (v >> k) & 1
            zeros = int(len(v) - bit.sum())
            self.levels.append((k, Bits(bit.astype(np.uint8)), zeros))
            v = np.concatenate([v[bit == 0], v[bit == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        lo = np.zeros_like(i)
        for k, bits, zeros in self.levels:
            one = ((symbol >> k) & 1).astype(bool)
            a, b = bits.ones(lo), bits.ones(i)
            lo, i = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, i - b)
        return i - lo

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol at each position, its occurrences before)."""
        symbol, lo = np.zeros_like(i), np.zeros_like(i)
        for k, bits, zeros in self.levels:
            one = bits.at(i).astype(bool)
            a, b = bits.ones(lo), bits.ones(i)
            lo, i = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, i - b)
            symbol = symbol | (one.astype(symbol.dtype) << k)
        return symbol, i - lo


class FMIndex:
    """Of a text of symbols 1 .. size-1; 0 separates documents' runs and ends the text."""

    def __init__(self, text: np.ndarray, size: int, sample: int = SAMPLE):
        text = np.append(text, 0)
        sa = suffix_array(text)
        self.n = len(text)
        bwt = text[sa - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size), dtype=np.int64)])
        self.tree = WaveletTree(bwt, max(1, int(size - 1).bit_length()))
        marked = (sa % sample == 0) | (bwt == 0)  # a step never has to cross a separator
        self.marked, self.samples = Bits(marked.astype(np.uint8)), sa[marked]

    def ranges(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix range of each pattern (rows, right-aligned); empty if lo >= hi."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        width = patterns.shape[1]
        live = np.arange(len(patterns))
        for step in range(width):
            live = live[(lengths[live] > step) & (lo[live] < hi[live])]
            if not len(live):
                break
            c = patterns[live, width - 1 - step]
            both = self.tree.rank(np.concatenate([c, c]), np.concatenate([lo[live], hi[live]]))
            lo[live], hi[live] = self.before[c] + both[: len(live)], self.before[c] + both[len(live) :]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each suffix-array row."""
        out, steps, todo, at = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.arange(len(rows)), rows.copy()
        while len(todo):
            hit = self.marked.at(at).astype(bool)
            out[todo[hit]] = self.samples[self.marked.ones(at[hit])] + steps[todo[hit]]
            todo, at = todo[~hit], at[~hit]
            symbol, rank = self.tree.access(at)
            at = self.before[symbol] + rank
            steps[todo] += 1
        return out


# ---------------------------------------------------------------- benchmark

class Phrases:
    """Distinct windows of a block of items, as word ids; ``owners[i]`` are the items of window i."""

    def __init__(self, items: list[tuple[object, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set] = {}
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                owners = found.setdefault(tuple(ids[i : i + window]), set())
                if name is not None:
                    owners.add(str(name))
        self.lengths = np.array([len(p) for p in found], np.int64)
        self.patterns = np.zeros((len(found), int(self.lengths.max()) if found else 1), np.int64)
        for i, p in enumerate(found):
            self.patterns[i, self.patterns.shape[1] - len(p) :] = p
        self.owners = list(found.values())
        self.shortest = int(self.lengths.min()) if found else 0


def long_runs(ids: np.ndarray, least: int) -> np.ndarray:
    """Which positions lie in a run of at least ``least`` non-zero ids."""
    edge = np.diff(np.concatenate([[0], (ids != 0).astype(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    good = end - start >= least
    mark = np.zeros(len(ids) + 1, np.int64)
    np.add.at(mark, start[good], 1)
    np.add.at(mark, end[good], -1)
    return np.cumsum(mark)[:-1] > 0


def search(ids: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(positions, window numbers) of all occurrences in a shard's ids (0: not a benchmark word, or a document's end)."""
    none = np.empty(0, np.int64)
    if not len(phrases.owners):
        return none, none
    keep = long_runs(ids, phrases.shortest)
    places = np.flatnonzero(keep)
    if not len(places):
        return none, none
    gap = np.append(False, np.diff(places) > 1)
    shift = np.arange(len(places)) + np.cumsum(gap)
    text = np.zeros(int(shift[-1]) + 1, np.int64)
    text[shift] = ids[places]
    back = np.zeros(len(text), np.int64)
    back[shift] = places
    present = np.unique(text)
    small = np.zeros(len(phrases.vocabulary) + 1, np.int64)  # the shard's own, smaller alphabet
    small[present] = np.arange(len(present)) if present[0] == 0 else np.arange(1, len(present) + 1)
    mask = np.arange(phrases.patterns.shape[1]) >= phrases.patterns.shape[1] - phrases.lengths[:, None]
    usable = np.flatnonzero(((small[phrases.patterns] > 0) | ~mask).all(1))
    if not len(usable):
        return none, none
    index = FMIndex(small[text], len(present) + 1)
    lo, hi = index.ranges(small[phrases.patterns[usable]], phrases.lengths[usable])
    n = np.maximum(0, hi - lo)
    rows = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return back[index.locate(rows)], np.repeat(usable, n)


# ---------------------------------------------------------------- operator

HITS = "text string, n_words long, n_hit long, item_ids array<string>, spans array<struct<first:int,end:int>>"


def _scanner(blocks: list, give: str, shard_words: int, index_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single = blocks[0].value if len(blocks) == 1 else None  # kept for the task; more are loaded in turn
        names, texts, counts, shard, words, indexed = [], [], [], [], 0, 0
        with_text, kind = give != "none", None

        def flush() -> pa.RecordBatch:
            ends = np.cumsum(np.array(counts, np.int64) + 1)
            starts = ends - np.array(counts) - 1
            edge = np.zeros(int(ends[-1]) + 1, np.int64)
            owners: dict[int, set] = {}
            for number in range(len(blocks)):
                phrases = single if single is not None else blocks[number].value
                ids = np.concatenate([x for pair in (shard if single is not None else ((_ids(words_of(t), phrases), ZERO) for t in texts)) for x in pair])
                at, which = search(ids, phrases)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + phrases.lengths[which], -1)
                docs = np.searchsorted(ends, at, "right")
                for d, w in np.unique(np.stack([docs, which], 1), axis=0).tolist():
                    owners.setdefault(d, set()).update(phrases.owners[w])
                if single is None:
                    blocks[number].__dict__.pop("_value", None)  # one block in memory at a time
            hit = np.cumsum(edge)[:-1] > 0
            turn = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
            first, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
            doc = np.searchsorted(ends, first, "right")
            spans: dict[int, list] = {}
            for d, a, b in zip(doc.tolist(), first.tolist(), end.tolist(), strict=True):
                spans.setdefault(d, []).append({"first": a - int(starts[d]), "end": b - int(starts[d])})
            n = len(names)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(names, kind),
                    pa.array([without_spans(t, spans[d]) if give == "clean" and d in spans else t for d, t in enumerate(texts)] if with_text else [None] * n, pa.binary()).cast(pa.string()),
                    pa.array(counts, pa.int64()),
                    pa.array([sum(s["end"] - s["first"] for s in spans.get(d, ())) for d in range(n)], pa.int64()),
                    pa.array([sorted(owners.get(d, ())) for d in range(n)], pa.list_(pa.string())),
                    pa.array([spans.get(d, []) for d in range(n)], pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))),
                ],
                ["key", "text", "n_words", "n_hit", "item_ids", "spans"],
            )

        held = 0
        for b in batches:
            kind = b.schema.field(0).type
            for name, text in zip(b.column(0).to_pylist(), common.byte_lists(b.column(1)), strict=True):
                split = words_of(text)
                names.append(name)
                texts.append(text if with_text or single is None else b"")
                counts.append(len(split))
                words += len(split)
                held += len(text)
                if single is not None:
                    ids = _ids(split, single)
                    shard.append((ids, ZERO))
                    indexed += int(long_runs(ids, single.shortest).sum()) if single.owners else 0
                if words >= (shard_words if single is not None else min(shard_words, index_words)) or indexed >= index_words or held >= 24_000_000 or len(names) >= 4000:
                    yield flush()
                    names, texts, counts, shard, words, indexed, held = [], [], [], [], 0, 0, 0
        if names:
            yield flush()

    return common.tidied(run)


ZERO = np.zeros(1, np.int64)


def _ids(words: list[bytes], phrases: Phrases) -> np.ndarray:
    return np.fromiter(map(phrases.vocabulary.get, words, repeat(0)), np.int64, len(words))


def phrase_blocks(benchmark: DataFrame, window: int, block_words: int) -> list:
    """Broadcast blocks of the benchmark, each of about ``block_words`` words at most.

    The benchmark's size is taken first; it decides the number of blocks, and
    the driver holds one block at a time.
    """
    spark = benchmark.sparkSession
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-chars // (2 * block_words)))  # a word and its gap take two characters at least
    out = []
    for k in range(n):
        some = items if n == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k)
        out.append(spark.sparkContext.broadcast(Phrases([(r[0], r[1].encode()) for r in some.collect()], window)))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "whole", block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, index_words: int = INDEX_WORDS, key: str = "doc_id") -> DataFrame:
    """For every row of ``docs(key, text)``: its words, the words inside benchmark windows, the items, merged word spans.

    ``-> (key, text, n_words, n_hit, item_ids, spans)``; ``text`` says what is
    given back: the ``whole`` text, the text ``clean`` of the spans, or ``none``.
    ``key`` may be a column of any type and is carried along.  Null texts have no
    words (and come back empty); items without words give no window; items with
    a null item_id mark words but are not listed.  Rows that share a key (or
    lack one) are separate rows.  Other columns are ignored.  Empty tables on
    either side give no rows, or rows without hits.
    """
    common.small_batches(docs.sparkSession)
    source = docs.select(F.col(key).alias("key"), F.col("text").cast("string").alias("text"))
    found = source.mapInArrow(_scanner(phrase_blocks(benchmark, window, block_words), text, shard_words, index_words), f"key {source.schema[0].dataType.simpleString()}, {HITS}")
    return found.withColumnRenamed("key", key)


_run = re.compile(rb"[^\x20]+")


def without_spans(raw: bytes, spans: list) -> bytes:
    """A text without the words of its spans; what stands between other words stays."""
    places = [m.span() for m in _run.finditer(raw.translate(WORD_BYTES))]
    out, at = [], 0
    for s in spans:
        first, end = s["first"], s["end"]
        out.append(raw[at : places[first][0]])
        at = places[end][0] if end < len(places) else len(raw)
    out.append(raw[at:])
    return b"".join(out).strip()


def op2_fm_index_decontamination(spark, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items, windows of ten words."""
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), text="none")
    listed = F.array_sort("item_ids")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join(listed, ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )

