"""Sequence packing by non-negative least squares over a length histogram.

1. Every document's ids are cut into full windows and one remainder; full
   windows are sequences by themselves.
2. Shallow combinations (two or three remainder lengths that exactly fill a
   window) are enumerated; their repeat counts solve
   ``min |A x - h|, x >= 0`` against the histogram ``h`` of remainders
   (accelerated projected gradient on the sparse incidence matrix).
3. Counts are rounded (to one at least where the solution has a share), largest
   first, as far as the histogram offers the lengths.
4. What the plan leaves over is packed greedily: residual pieces are laid end
   to end, longest first, and cut at window ends; the last, part-filled window
   is cut at powers of two, which need no padding.

Only the histogram (at most ``window`` numbers) meets in one place.  A piece's
place follows from its rank within its length, got from counts for each
(partition, length), so equal lengths never gather in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

WINDOW = 1024
DEPTH = 3
#: Rows of (partition, length) counts up to which they are broadcast (16 bytes each); beyond, a shuffle join.
BROADCAST_ROWS = 2_000_000


def combinations(window: int, depth: int = DEPTH) -> np.ndarray:
    """Rows of ``depth`` lengths (0: none), each row non-increasing and filling the window; two or more lengths."""
    out = []
    half = np.arange(1, window // 2 + 1)
    out.append(np.stack([window - half, half, np.zeros_like(half)], 1))
    if depth >= 3:
        for c in range(1, window // 3 + 1):
            b = np.arange(c, (window - c) // 2 + 1)
            out.append(np.stack([window - c - b, b, np.full_like(b, c)], 1))
    return np.concatenate(out)


def solve_counts(hist: np.ndarray, combos: np.ndarray, rounds: int = 1500) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - h| (FISTA with restarts)."""
    window = len(hist) - 1
    live = (hist[combos] > 0) | (combos == 0)
    used = np.flatnonzero(live.all(1))
    x = np.zeros(len(combos))
    if not len(used):
        return x
    c = combos[used]
    scale = hist.max()
    h = hist[1:] / scale
    flat, width = c.ravel(), c.shape[1]

    def times(y):
        return np.bincount(flat, np.repeat(y, width), window + 1)[1:]

    def back(r):
        return np.concatenate([[0.0], r])[c].sum(1)

    v = np.random.default_rng(0).random(len(c))
    for _ in range(30):
        v = back(times(v))
        norm = float((v * v).sum()) ** 0.5  # elementwise: no BLAS threads for small vectors
        v /= norm
    step, y, z, t = 1 / (1.02 * norm), np.zeros(len(c)), np.zeros(len(c)), 1.0
    for _ in range(rounds):
        new = np.maximum(0, z - step * back(times(z) - h))
        if ((z - new) * (new - y)).sum() > 0:
            t = 1.0
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, moved = new + (t - 1) / t2 * (new - y), np.abs(new - y).max()
        y, t = new, t2
        if moved < 1e-12:
            break
    x[used] = y * scale
    return x


def plan(hist: np.ndarray, window: int = WINDOW, depth: int = DEPTH) -> dict[str, np.ndarray]:
    """Slots for remainders: for each length, ranks from ``first`` on go to sequences from ``sequence`` on, at ``offset``.

    ``hist[l]`` is the number of remainders of length l (l < window).  Returns
    arrays sorted by (length, first), and ``left``: by length, the first rank
    that the plan doesn't place; ``sequences``: how many it fills.
    """
    combos = combinations(window, depth)
    counts = solve_counts(hist.astype(float), combos)
    want = np.where(counts > 1e-3, np.maximum(1, np.rint(counts)), 0).astype(np.int64)
    free = hist.astype(np.int64).copy()
    taken = np.zeros(window, np.int64)
    rows, sequence = [], 0
    for k in np.lexsort((np.arange(len(want)), -counts)):
        if want[k] < 1:
            break
        lengths = [int(v) for v in combos[k] if v]
        n = min([int(want[k]), *(int(free[v]) // lengths.count(v) for v in lengths)])
        if n < 1:
            continue
        offset = 0
        for v in lengths:
            rows.append((v, int(taken[v]), n, sequence, offset))
            taken[v] += n
            free[v] -= n
            offset += v
        sequence += n
    slots = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return {"length": slots[:, 0], "first": slots[:, 1], "n": slots[:, 2], "sequence": slots[:, 3], "offset": slots[:, 4], "left": taken, "sequences": np.int64(sequence)}


PIECES = "part int, doc_id long, start long, length int, rank long, doc_tokens long, ids binary"
PACKED = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def _cutter(path: str, byte_level: bool, end_id: int, window: int, literal: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc, end = TaskContext.get().partitionId(), common.encoder(path, byte_level, literal), np.array([end_id], "<u4").tobytes()
        seen = np.zeros(window + 1, np.int64)
        names = ("doc_id", "start", "length", "rank", "doc_tokens", "ids")
        cols: dict[str, list] = {k: [] for k in names}

        def rows():
            return pa.RecordBatch.from_arrays(
                [pa.array([part] * len(cols["ids"]), pa.int32()), pa.array(cols["doc_id"], pa.int64()), pa.array(cols["start"], pa.int64()), pa.array(cols["length"], pa.int32()), pa.array(cols["rank"], pa.int64()), pa.array(cols["doc_tokens"], pa.int64()), pa.array(cols["ids"], pa.binary())],
                ["part", *names],
            )

        for b in batches:
            docs, texts = b.column(0).to_pylist(), common.byte_lists(b.column(1))
            for doc, ids in zip(docs, enc.encode(texts), strict=True):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, window):
                    size = min(window, n - start)
                    for k, v in zip(names, (doc, start, size, int(seen[size]), n, ids[4 * start : 4 * (start + size)]), strict=True):
                        cols[k].append(v)
                    seen[size] += 1
                if len(cols["ids"]) >= 1000:
                    yield rows()
                    cols = {k: [] for k in names}
        yield rows()

    return common.tidied(run)


def _tail_cuts(total: int, window: int) -> np.ndarray:
    """Where the residual stream is cut within its last, part-filled window: at powers of two, largest first."""
    at, cuts, left = total - total % window, [], total % window
    for k in reversed(range(window.bit_length())):
        if left >> k & 1:
            cuts.append(at)
            at += 1 << k
    return np.array([*cuts, at], np.int64)


def _placer(p: dict[str, np.ndarray], hist: np.ndarray, window: int):
    """Pieces with their rank among all of their length -> placed pieces."""
    keys = p["length"] << np.int64(44) | p["first"]
    left = np.maximum(0, hist[:window] - p["left"])
    left[0] = 0
    order = np.arange(window)[::-1]
    bases = np.zeros(window, np.int64)
    bases[order] = np.concatenate([[0], np.cumsum((left * np.arange(window))[order])[:-1]])
    total = int((left * np.arange(window)).sum())
    tail = _tail_cuts(total, window)
    full, whole = int(hist[window]), total // window

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy().astype(np.int64), b.column("rank").to_numpy()
            sequence, offset = rank.copy(), np.zeros(len(rank), np.int64)
            short = length < window
            loose = short & (rank >= p["left"][np.where(short, length, 0)])
            planned = np.flatnonzero(short & ~loose)
            if len(planned):
                k = np.searchsorted(keys, length[planned] << np.int64(44) | rank[planned], "right") - 1
                sequence[planned] = full + p["sequence"][k] + rank[planned] - p["first"][k]
                offset[planned] = p["offset"][k]
            ids, starts = b.column("ids"), b.column("start").to_numpy()
            doc, tokens = b.column("doc_id"), b.column("doc_tokens")
            fixed = np.flatnonzero(~loose)
            take, lens, begin, seqs, offs, data = [fixed], [length[fixed]], [starts[fixed]], [sequence[fixed]], [offset[fixed]], ids.take(pa.array(fixed)).to_pylist()
            for i in np.flatnonzero(loose).tolist():
                raw, size = ids[i].as_py(), int(length[i])
                at = int(bases[size] + (rank[i] - p["left"][size]) * size)
                done = 0
                while done < size:
                    here = at + done
                    if here < whole * window:
                        seq, off, stop = here // window, here % window, (here // window + 1) * window
                    else:
                        t = int(np.searchsorted(tail, here, "right")) - 1
                        seq, off, stop = whole + t, here - int(tail[t]), int(tail[t + 1])
                    n = min(size - done, stop - here)
                    for out, v in ((take, i), (lens, n), (begin, int(starts[i]) + done), (seqs, full + int(p["sequences"]) + seq), (offs, off)):
                        out.append(np.array([v], np.int64))
                    data.append(raw[4 * done : 4 * (done + n)])
                    done += n
            take = pa.array(np.concatenate(take))
            yield pa.RecordBatch.from_arrays(
                [doc.take(take), pa.array(np.concatenate(begin)), pa.array(np.concatenate(lens)), tokens.take(take), pa.array(np.concatenate(seqs)), pa.array(np.concatenate(offs)), pa.array(data, pa.binary())],
                ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    return common.tidied(place)


def pack(docs: DataFrame, vocabulary: str, byte_level: bool, end_id: int = 0, window: int = WINDOW, depth: int = DEPTH, literal: bool = False) -> DataFrame:
    """Pack ``docs(doc_id, text)`` into sequences; a row for each piece with its ids (little-endian uint32).

    Null text counts as empty, so every document has at least its end id.
    Rows that share a doc_id are separate documents; a null doc_id stays null.
    Other columns are ignored; an empty table gives no pieces.  Documents are
    encoded once; the pieces are staged in the shared folder.  The ids are the
    library's: a control string of the vocabulary is one id wherever it stands,
    unless ``literal`` says that such strings are ordinary text.
    """
    common.small_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = common.staged(source.mapInArrow(_cutter(vocabulary, byte_level, end_id, window, literal), PIECES), "pieces")
    counts = common.staged(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    hist = np.zeros(window + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():
        hist[length] = n
    made = plan(np.append(hist[:window], 0), window, depth)
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = counts.withColumn("base", before).drop("n")
    if counts.count() <= BROADCAST_ROWS:
        bases = F.broadcast(bases)
    ranked = pieces.join(bases, ["part", "length"]).select("doc_id", "start", "length", (F.col("rank") + F.col("base")).alias("rank"), "doc_tokens", "ids")
    return ranked.mapInArrow(_placer(made, hist, window), PACKED)


def op1_nnls_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 1024 ids."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digest(pack(docs, public_tokenizers.path("byte_bpe_50k.json"), True))


def digest(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
