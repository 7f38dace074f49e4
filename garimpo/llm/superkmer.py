"""Substring dedup: repeated word windows found through super-k-mer partitioning.

A window is ``k`` consecutive words.  Its minimiser is the least hash among its
runs of ``m`` words (leftmost on ties).  Consecutive windows whose minimiser is
the same run form a super-k-mer, which travels as one packed string to the
bucket of its minimiser; windows with equal words have equal minimisers and so
meet in one bucket, where sorting counts them exactly.

Within one super-k-mer no window occurs twice (the leftmost minimiser would
differ), so occurrences are counted between super-k-mers.  Before anything
travels, equal super-k-mers of a batch are merged: one that occurs twice in a
batch is known to repeat, its spans are settled on the spot and one copy, marked
as repeated, goes to the bucket.  What a bucket receives of a passage that a
third of all documents share is therefore one string for each batch.

A run of words that is very frequent in ever other surroundings (a common line)
would gather its super-k-mers in one bucket.  A first pass counts minimisers;
the few that hold more than a small share of all super-k-mers rank behind all
other runs, so that a window which holds any other run takes that one.

Strings of a batch that go to the same bucket are compressed together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

K = 35
M = 6
#: Bytes of packed strings held by a worker before they are sent off.
HELD_BYTES = 12_000_000


def leftmost_minima(x: np.ndarray, w: int) -> np.ndarray:
    """For each run of ``w`` values the index of its least one, the leftmost on ties."""
    n = len(x) - w + 1
    index = np.arange(len(x))
    best, span = index, 1
    while span < w:
        step = min(span, w - span)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(x[b] < x[a], b, a)
        span += step
    return best[:n]


HOT_BIT = np.uint64(1 << 63)


def super_kmers(hashes: np.ndarray, k: int, m: int, hot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, end window, minimiser hash) of each super-k-mer of a text's word hashes; ``hot`` (sorted) hashes rank last."""
    grams = common.rolling(hashes, m) >> np.uint64(1)
    if hot is not None and len(hot):
        at = np.minimum(np.searchsorted(hot, grams), len(hot) - 1)
        grams = np.where(hot[at] == grams, grams | HOT_BIT, grams)
    at = leftmost_minima(grams, k - m + 1)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return first, np.append(first[1:], len(at)), grams[at[first]]


SENT = "bucket int, blob binary"
#: zstandard level of what travels.
LEVEL = 3


def _planes(x: np.ndarray) -> bytes:
    """An integer array byte by byte, all first bytes first: compresses better."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()


def _unplanes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, len(data) // size).T).ravel().view(kind)


def _pack(parts: list[bytes]) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=LEVEL).compress(b"".join(len(p).to_bytes(4, "little") + p for p in parts))


def _unpack(blob: bytes) -> list[bytes]:
    import zstandard

    data, out, at = zstandard.ZstdDecompressor().decompress(blob), [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def _short(hashes: bytes) -> np.ndarray:
    """The sorted 32-bit minimiser hashes of a blob."""
    return np.cumsum(_unplanes(hashes, "<u4"), dtype=np.uint32)


class _Batch:
    """Super-k-mers of some documents, equal ones merged.  Each document has a name of ``NAME`` bytes."""

    def __init__(self, buckets: int):
        self.buckets, self.size = buckets, 0
        self.docs: dict[bytes, int] = {}
        self.first: dict[bytes, list[int]] = {}  # packed string -> minimiser, document, first window, windows, repeated
        self.settled: dict[int, list[int]] = {}

    def add(self, key: bytes, words: list[bytes], k: int, m: int, hot: np.ndarray | None) -> None:
        doc = self.docs.get(key)
        if doc is not None:  # the same row once more: all of it repeats
            self.settled[doc] = [0, len(words) - k + 1]
            return
        doc = self.docs[key] = len(self.docs)
        text = b" ".join(words)
        word_hashes, from_, to = common.hash_words(text)
        starts, ends, hashes = super_kmers(word_hashes, k, m, hot)
        lo, hi = from_[starts], to[ends + k - 2]
        known = self.first
        for s, e, a, b, h in zip(starts.tolist(), ends.tolist(), lo.tolist(), hi.tolist(), hashes.tolist(), strict=True):
            string = text[a:b]
            seen = known.get(string)
            if seen is None:
                known[string] = [h, doc, s, e - s, 0]
                self.size += b - a + 250
            else:
                if not seen[4]:
                    seen[4] = 1
                    self.settled.setdefault(seen[1], []).extend((seen[2], seen[2] + seen[3]))
                self.settled.setdefault(doc, []).extend((s, e))

    def rows(self) -> Iterator[pa.RecordBatch]:
        """For each bucket one blob: strings sorted by minimiser with where each is from; settled spans go anywhere."""
        strings = list(self.first)
        facts = np.array(list(self.first.values()), np.uint64).reshape(-1, 5)
        names = list(self.docs)
        to = (facts[:, 0] % np.uint64(self.buckets)).astype(np.int64)
        order = np.lexsort((facts[:, 0], to))
        cuts = np.searchsorted(to[order], np.arange(self.buckets + 1))
        spare: dict[int, list[int]] = {}
        for doc in self.settled:
            spare.setdefault(int.from_bytes(names[doc][:4], "little") % self.buckets, []).append(doc)
        for bucket in range(self.buckets):
            mine, own = order[cuts[bucket] : cuts[bucket + 1]], spare.get(bucket, [])
            if not len(mine) and not own:
                continue
            docs, place = np.unique(facts[mine, 1].astype(np.int64), return_inverse=True)
            short = (facts[mine, 0] >> np.uint64(32)).astype(np.uint32)  # sorted; equal minimisers stay equal
            parts = [
                _planes(np.diff(short, prepend=np.uint32(0))), _planes(facts[mine, 2].astype("<u4")), _planes(facts[mine, 3].astype("<u2")), facts[mine, 4].astype(np.uint8).tobytes(), _planes(place.astype("<u4")), b"".join([names[i] for i in docs.tolist()]),
                b"\n".join([strings[i] for i in mine.tolist()]),
                b"".join([names[i] for i in own]), np.array([len(self.settled[d]) for d in own], "<u4").tobytes(), b"".join(np.array(self.settled[d], "<u4").tobytes() for d in own),
            ]
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([_pack(parts)], pa.binary())], ["bucket", "blob"])


def _sender(k: int, m: int, buckets: int, held: int, hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch, last = _Batch(buckets), hot.value
        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), common.byte_lists(b.column(1)), strict=True):
                words = text.split()
                if len(words) >= k:
                    batch.add(name, words, k, m, last)
                    if batch.size >= held:
                        yield from batch.rows()
                        batch = _Batch(buckets)
        yield from batch.rows()

    return common.tidied(run)


#: Super-k-mers counted together by a worker in the first pass.
COUNTED = 500_000


def _tally(k: int, m: int, shares: int):
    """Minimisers that are frequent within a worker's batch; -1 counts all super-k-mers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush():
            grams, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= max(2, size // (4 * shares))
            return pa.RecordBatch.from_arrays([pa.array(np.append(grams[often].astype(np.int64), -1)), pa.array(np.append(n[often], size).astype(np.int64))], ["gram", "n"])

        for b in batches:
            for text in common.byte_lists(b.column(0)):
                words = text.split()
                if len(words) >= k:
                    held.append(super_kmers(common.hash_words(b" ".join(words))[0], k, m)[2])
                    size += len(held[-1])
                    if size >= COUNTED:
                        yield flush()
                        held, size = [], 0
        if size:
            yield flush()

    return common.tidied(run)


def hot_minimisers(docs: DataFrame, k: int, m: int, shares: int) -> np.ndarray:
    """Minimisers of at least about one in ``shares`` of all super-k-mers, sorted; 4/3 times so many (8 bytes each) at most."""
    found = docs.select("text").mapInArrow(_tally(k, m, shares), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    found = common.staged(found, "minimisers")  # one pass over the text
    total = found.where("gram = -1").first()
    if total is None:
        return np.empty(0, np.uint64)
    often = found.where((F.col("gram") >= 0) & (F.col("n") > max(2, total.n * 3 // (4 * shares)))).collect()
    return np.sort(np.array([r.gram for r in often], np.uint64))


#: Windows of a group that are sorted together as strings; of larger groups windows are sorted by hash,
#: so many at a time, and only those with equal hashes are compared as strings.
FEW_WINDOWS, MOST_WINDOWS = 512, 1_000_000


def repeated_windows(entries: list[tuple[bytes, int, int]], k: int) -> list[list[tuple[int, int]]]:
    """For super-k-mers of one minimiser, as (string, windows, repeated): which of each one's windows occur again.

    Windows are compared as strings; sorting brings equal ones together.
    Returns runs (first, end) of repeated windows, relative to the super-k-mer.
    """
    total = sum(n for _, n, _ in entries)
    hit: list[list[int]] = [[] for _ in entries]
    if total > FEW_WINDOWS:
        for slice_ in range(slices := -(-total // MOST_WINDOWS)):
            _hashed_windows(entries, k, slice_, slices, hit)
        return [_runs(sorted(h)) for h in hit]
    windows = []
    for i, (string, n, again) in enumerate(entries):
        words = string.split()
        for j in range(n):
            windows.append((b" ".join(words[j : j + k]), i, j, again))
    windows.sort()
    at = 0
    while at < len(windows):
        end = at + 1
        while end < len(windows) and windows[end][0] == windows[at][0]:
            end += 1
        if end - at > 1 or windows[at][3]:
            for _, i, j, _ in windows[at:end]:
                hit[i].append(j)
        at = end
    return [_runs(sorted(h)) for h in hit]


#: Bytes of strings that are hashed together.
HASHED_BYTES = 4_000_000


def _hashed_windows(entries: list[tuple[bytes, int, int]], k: int, slice_: int, slices: int, hit: list[list[int]]) -> None:
    """Add to ``hit`` the repeated windows whose hash falls into a slice; a window takes 24 bytes, never a copy."""
    parts: list[list[np.ndarray]] = [[], [], [], [], []]
    first = 0
    while first < len(entries):
        end, size = first, 0
        while end < len(entries) and (end == first or size < HASHED_BYTES):
            size += len(entries[end][0]) + 1
            end += 1
        some = entries[first:end]
        hashes, starts, ends = common.hash_words(b" ".join(e[0] for e in some))
        windows = np.array([e[1] for e in some], np.int64)
        words = windows + k - 1
        word, byte = np.cumsum(words) - words, np.cumsum([len(e[0]) + 1 for e in some]) - [len(e[0]) + 1 for e in some]
        who = np.repeat(np.arange(len(some)), windows)
        place = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
        at = word[who] + place
        h = common.rolling(hashes, k)[at]
        mine = h % np.uint64(slices) == slice_
        who, place, at = who[mine], place[mine], at[mine]
        for out, x in zip(parts, (h[mine], (who + first).astype(np.uint32), place.astype(np.uint32), (starts[at] - byte[who]).astype(np.uint32), (ends[at + k - 1] - byte[who]).astype(np.uint32)), strict=True):
            out.append(x)
        first = end
    h, who, place, lo, hi = (np.concatenate(p) for p in parts)
    again = np.array([bool(e[2]) for e in entries])
    order = np.argsort(h, kind="stable")
    new = np.flatnonzero(np.append(True, h[order[1:]] != h[order[:-1]])) if len(order) else np.empty(0, np.int64)
    sizes = np.diff(np.append(new, len(order)))
    alone = order[new[sizes == 1]]
    for x in alone[again[who[alone]]].tolist():
        hit[who[x]].append(int(place[x]))
    for a, n in zip(new[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
        same: dict[bytes, list[int]] = {}
        for x in order[a : a + n].tolist():
            same.setdefault(entries[who[x]][0][lo[x] : hi[x]], []).append(x)
        for members in same.values():
            if len(members) > 1 or again[who[members[0]]]:
                for x in members:
                    hit[who[x]].append(int(place[x]))


def _runs(sorted_ints: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for x in sorted_ints:
        if out and out[-1][1] == x:
            out[-1] = (out[-1][0], x + 1)
        else:
            out.append((x, x + 1))
    return out


#: Bytes of a row's name: a digest of its doc_id and text.
NAME = 16
FOUND = "name binary, spans binary"


def _cut(names: bytes) -> list[bytes]:
    return [names[i : i + NAME] for i in range(0, len(names), NAME)]


def _united(flat: list[int]) -> bytes:
    """Spans (first, end, first, end, ...) as uint32, those that meet as one: never more than the text has windows."""
    pairs = np.array(flat, np.int64).reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    new = np.flatnonzero(np.append(True, pairs[1:, 0] > reach[:-1]))
    return np.stack([pairs[new, 0], reach[np.append(new[1:], len(pairs)) - 1]], 1).astype("<u4").tobytes()


def _settle_bucket(hashes, starts, counts, again, keys, strings, k: int, found: dict[bytes, list[int]]) -> None:
    """Add to ``found`` the repeated windows of a bucket's super-k-mers."""
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    sizes = np.diff(np.append(first, len(h)))
    for lo, n in zip(first[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
        merged: dict[bytes, list[int]] = {}
        for i in order[lo : lo + n].tolist():
            merged.setdefault(strings[i], []).append(i)
        if len(merged) == 1:  # the same super-k-mer from several batches: all its windows repeat
            runs = [[(0, int(counts[order[lo]]))]]
        else:
            runs = repeated_windows([(s, int(counts[i[0]]), len(i) > 1 or bool(again[i[0]])) for s, i in merged.items()], k)
        for members, spans in zip(merged.values(), runs, strict=True):
            if not spans:
                continue
            for i in members:
                if not again[i]:  # a super-k-mer marked as repeated is settled where it came from
                    at = int(starts[i])
                    found.setdefault(keys[i], []).extend(x for a, b in spans for x in (at + a, at + b))


def _counter(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Blobs are held as they came; only super-k-mers whose minimiser occurs again are unpacked for good.
        blobs = [blob.as_py() for b in batches for blob in b.column(1)]
        short = np.sort(np.concatenate([_short(_unpack(b)[0]) for b in blobs])) if blobs else np.empty(0, np.uint32)
        again_short = np.unique(short[1:][short[1:] == short[:-1]])
        columns: list[list[np.ndarray]] = [[], [], [], []]
        keys: list[bytes] = []
        strings: list[bytes] = []
        found: dict[bytes, list[int]] = {}
        for blob in blobs:
            hashes, starts, counts, again, place, names, text, own, sizes, spans = _unpack(blob)
            h = _short(hashes)
            pick = np.flatnonzero(np.isin(h, again_short))
            if len(pick):
                for out, x in zip(columns, (h, _unplanes(starts, "<u4"), _unplanes(counts, "<u2"), np.frombuffer(again, np.uint8)), strict=True):
                    out.append(x[pick])
                names = _cut(names)
                keys += [names[i] for i in _unplanes(place, "<u4")[pick].tolist()]
                some = text.split(b"\n")
                strings += [some[i] for i in pick.tolist()]
            ends = np.cumsum(np.frombuffer(sizes, "<u4")).tolist()
            values = np.frombuffer(spans, "<u4").tolist()
            for key, lo, hi in zip(_cut(own), [0, *ends], ends, strict=False):
                found.setdefault(key, []).extend(values[lo:hi])
        if keys:
            _settle_bucket(*(np.concatenate(c) for c in columns), keys, strings, k, found)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array([_united(v) for v in found.values()], pa.binary())], ["name", "spans"])

    return common.tidied(run)


#: Minimisers of less than one in so many super-k-mers are never frequent: bounds the broadcast list to 45 MB.
SHARES = 1 << 22


def repeated_spans(keyed: DataFrame, k: int = K, m: int = M, held: int = HELD_BYTES) -> DataFrame:
    """Rows ``(name, spans)``: runs of repeated windows of each of ``keyed(name, text)`` that has any."""
    spark = keyed.sparkSession
    m = min(m, k)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * keyed.rdd.getNumPartitions())
    hot = spark.sparkContext.broadcast(hot_minimisers(keyed, k, m, min(16 * parts, SHARES)))
    sent = keyed.select("name", "text").mapInArrow(_sender(k, m, parts, held, hot), SENT)
    found = sent.repartitionById(parts, F.col("bucket")).mapInArrow(_counter(k), FOUND)
    return found.groupBy("name").agg(F.collect_list("spans").alias("spans"))  # one for each bucket, none longer than the row's windows


def covered(spans: list[bytes], n_words: int, k: int) -> np.ndarray:
    """Words of a row inside a repeated window."""
    edge = np.zeros(n_words + 1, np.int64)
    for s in spans:
        pairs = np.frombuffer(s, "<u4").reshape(-1, 2).astype(np.int64)
        np.add.at(edge, pairs[:, 0], 1)
        np.add.at(edge, pairs[:, 1] + k - 1, -1)
    return np.cumsum(edge)[:-1] > 0


DONE = "n_words long, n_removed long, kept string, kept_sha256 string"


def _remover(k: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, kept, sha = [], [], [], []
            for text, spans in zip(common.byte_lists(b.column(1)), b.column(2).to_pylist(), strict=True):
                words = text.split()
                n_words.append(len(words))
                if spans:
                    gone = covered(spans, len(words), k)
                    n_removed.append(int(gone.sum()))
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                else:
                    n_removed.append(0)
                left = b" ".join(words)
                sha.append(hashlib.sha256(left).hexdigest())
                kept.append((left if spans else text) if with_text else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(sha, pa.string())], ["key", "n_words", "n_removed", "kept", "kept_sha256"])

    return common.tidied(run)


def remove_repeats(docs: DataFrame, k: int = K, m: int = M, held: int = HELD_BYTES, with_text: bool = True, key: str = "doc_id") -> DataFrame:
    """Remove each word covered by a ``k``-word window whose words also start anywhere else.

    ``docs(doc_id, text)`` -> ``(key, n_words, n_removed, kept, kept_sha256)``
    for every row; ``kept`` is the text as it was where nothing is removed, else
    the kept words joined by one space (null without ``with_text``).  Windows are
    judged on the input, all occurrences go.  Null text has no words (and is
    kept as empty); texts shorter than a window keep all; rows that share a
    doc_id, or lack one, are separate texts, named by a 128-bit digest of id and
    text (rows equal in both have equal results).  ``key`` may be another column, of
    any type, to be carried along.  Other columns are ignored; an empty table
    gives no rows.
    """
    common.small_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    name = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))).cast("binary")))
    keyed = docs.select(F.col(key).alias("key"), name.alias("name"), text.alias("text"))
    spans = common.staged(repeated_spans(keyed, k, m, held), "repeats")
    if spans.limit(common.BROADCAST_ROWS + 1).count() <= common.BROADCAST_ROWS:  # only texts with repeats need travel to their spans
        names = F.broadcast(spans.select("name"))
        touched = keyed.join(names, "name", "left_semi").join(spans, "name").select("key", "text", "spans")
        both = touched.unionByName(keyed.join(names, "name", "left_anti").select("key", "text", F.lit(None).cast("array<binary>").alias("spans")))
    else:
        both = keyed.join(spans, "name", "left").select("key", "text", "spans")
    return both.mapInArrow(_remover(k, with_text), f"key {keyed.schema[0].dataType.simpleString()}, {DONE}").withColumnRenamed("key", key)


def op5_superkmer_dedup(spark, sf_dir: str) -> DataFrame:
    """Repeated 35-word windows removed from all documents."""
    done = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)
    return done.select("doc_id", "n_words", "n_removed", "kept_sha256")
