"""Quality score from compression with two zstandard dictionaries.

One dictionary is built from text labelled good, one from text labelled bad.
A text is compressed in pieces of ``PIECE`` bytes (all of them) with either;
``(bad - good) / (bad + good)`` of the summed sizes is positive when the good
dictionary helps more.  A logistic curve fitted on labelled rows that the
dictionaries used for it haven't seen turns it into a probability; rows are weighted so
that the classes weigh as in all training labels.

The fit takes whole texts of a bounded number of labelled rows.  Their pieces
are dealt into buckets of about ``BUCKET`` bytes, whatever the length of a text;
a task trains a dictionary for each bucket, and where there are several, their
dictionaries are what the next round trains on.  Differences are measured where
the texts are: the driver receives six dictionaries and a number for each row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .langid import held_out

PIECE = 512
DICTIONARY_BYTES = 32_768
LEVEL = 3
#: The fitting sample: rows of each label at most (those with the least hash of doc_id).
SAMPLE_ROWS = 3000
#: Bytes of pieces that one dictionary is trained on, about.
BUCKET = 1 << 23
#: Dictionaries are trained on the pieces of either half of a label's texts, and on all of them.
ALL = 2


def pieces(text: bytes, size: int = PIECE) -> list[bytes]:
    return [text[i : i + size] for i in range(0, max(1, len(text)), size)]


def dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary trained on pieces; the pieces themselves where there are too few to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


@dataclass
class Model:
    good: bytes
    bad: bytes
    slope: float
    intercept: float

    def __post_init__(self):
        self._c = None

    def __getstate__(self):
        return {"good": self.good, "bad": self.bad, "slope": self.slope, "intercept": self.intercept, "_c": None}

    def _compressors(self):
        if self._c is None:
            import zstandard

            def of(data: bytes):
                d = zstandard.ZstdCompressionDict(data)
                d.precompute_compress(level=LEVEL)
                return zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False)

            self._c = of(self.good), of(self.bad)
        return self._c

    def difference(self, some: list[bytes]) -> float:
        good, bad = self._compressors()
        g, b = sum(len(good.compress(p)) for p in some), sum(len(bad.compress(p)) for p in some)
        return (b - g) / (b + g)

    def score(self, text: bytes) -> float:
        z = self.slope * self.difference(pieces(text)) + self.intercept
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and intercept of a weighted logistic fit (Newton's method on the standardised value)."""
    mean, scale = float(np.average(x, weights=weight)), float(x.std()) or 1.0
    a = np.stack([(x - mean) / scale, np.ones_like(x)], 1)
    w = np.zeros(2)
    weight = weight / weight.sum()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + ridge * np.eye(2), a.T @ (weight * (p - y)) + ridge * w * [1, 0])
        w -= step
        if np.abs(step).max() < 1e-10:
            break
    return float(w[0] / scale), float(w[1] - w[0] * mean / scale)


def _cutter(buckets: dict[int, int]):
    """Every piece of every text, once for its half and once for all, with its bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, quality, half, text in zip(*[c.to_pylist() for c in b.columns[:3]], common.byte_lists(b.column(3)), strict=True):
                cut = pieces(text)
                for at in range(0, len(cut), 10_000):
                    some = cut[at : at + 10_000]
                    n = len(some)
                    bucket = [zlib.crc32(b"%d:%d" % (doc, i)) % buckets[quality] for i in range(at, at + n)]
                    for part in (half, ALL):
                        yield pa.RecordBatch.from_arrays([pa.array([v] * n, t) for v, t in ((quality, pa.int32()), (part, pa.int32()))] + [pa.array(bucket, pa.int64()), pa.array([doc] * n, pa.int64()), pa.array(range(at, at + n), pa.int64()), pa.array(some, pa.binary())], PIECES)

    return common.tidied(run)


PIECES = ["quality", "part", "bucket", "name", "number", "piece"]
PIECES_SCHEMA = "quality int, part int, bucket long, name long, number long, piece binary"


def _trained(rows: pa.Table) -> pa.Table:
    """One bucket's dictionary; its pieces go by name and number, so that reruns agree."""
    rows = rows.sort_by([("name", "ascending"), ("number", "ascending")])
    return pa.table({c: rows.column(c).slice(0, 1) for c in PIECES[:3]} | {"dictionary": pa.array([dictionary(rows.column("piece").to_pylist())], pa.binary())})


def _recut(together: int):
    """Pieces of dictionaries, so many dictionaries to a bucket (without their first pieces, which hold tables)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for quality, part, bucket, data in zip(*[c.to_pylist() for c in b.columns], strict=True):
                some = pieces(data)[1:] or [data]
                n = len(some)
                yield pa.RecordBatch.from_arrays([pa.array([quality] * n, pa.int32()), pa.array([part] * n, pa.int32()), pa.array([bucket // together] * n, pa.int64()), pa.array([bucket] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(some, pa.binary())], PIECES)

    return common.tidied(run)


def dictionaries(sample: DataFrame, bucket: int = BUCKET) -> dict[tuple[int, int], bytes]:
    """The dictionary of each (quality, half or ``ALL``) of ``sample(doc_id, quality, half, text)``, round by round."""
    sizes = {r.quality: r.n for r in sample.groupBy("quality").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    cut = sample.select("doc_id", "quality", "half", "text").mapInArrow(_cutter({k: max(1, -(-n // bucket)) for k, n in sizes.items()}), PIECES_SCHEMA)
    together = max(2, bucket // DICTIONARY_BYTES)
    while True:
        found = common.staged(cut.groupBy("quality", "part", "bucket").applyInArrow(_trained, "quality int, part int, bucket long, dictionary binary"), "dictionaries")
        if (found.agg(F.max("bucket")).first()[0] or 0) == 0:
            return {(r.quality, r.part): bytes(r.dictionary) for r in found.collect()}
        cut = found.mapInArrow(_recut(together), PIECES_SCHEMA)


def _measurer(halves):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = halves.value
        for b in batches:
            found = [models[1 - half].difference(pieces(t)) for half, t in zip(b.column(2).to_pylist(), common.byte_lists(b.column(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(found, pa.float64())], ["doc_id", "quality", "difference"])

    return common.tidied(run)


def sampled(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[DataFrame, float]:
    """``(doc_id, quality, half, text)`` of at most ``rows`` labelled documents of each quality, and the share of label 1.

    An id counts once for each quality it is labelled with, however often it
    stands in either table; of the texts under one id the one with the least
    hash is taken.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1) and doc_id is not null")
    n, good = known.agg(F.count("*"), F.sum("quality")).first()
    parts = [known.where(F.col("quality") == k).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for k in (0, 1)]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    met = texts.join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id")
    one = common.staged(met.groupBy("doc_id", "quality").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")), "sample")
    half = F.row_number().over(W.partitionBy("quality").orderBy("doc_id")) - 1  # of bounded many ids
    halves = one.select("doc_id", "quality", (half % 2).alias("half"))
    return one.join(F.broadcast(halves), ["doc_id", "quality"]).select("doc_id", "quality", "half", "text"), (good or 0) / n if n else 0.5


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, bucket: int = BUCKET) -> Model:
    """Fit on whole texts of a bounded sample of labelled rows, ``rows`` of each quality.

    Labels other than 0 and 1, and rows with a null doc_id or text, are left
    out.  Where a label has no text the score is the share of label 1.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    sample, share = sampled(docs, labels, rows)
    built = dictionaries(sample, bucket)
    if (1, ALL) not in built or (0, ALL) not in built:
        share = min(max(share, 0.01), 0.99)
        return Model(b"", b"", 0.0, float(np.log(share / (1 - share))))
    # Either half is measured by dictionaries of the other; the final ones are built from both.
    halves = [Model(*(built.get((k, half), built[k, ALL]) for k in (1, 0)), 0.0, 0.0) for half in (0, 1)]
    got = sorted(tuple(r) for r in sample.mapInArrow(_measurer(spark.sparkContext.broadcast(halves)), "doc_id long, quality int, difference double").collect())
    y, x = np.array([r[1] for r in got], float), np.array([r[2] for r in got])
    weight = np.where(y == 1, share / max(1, y.sum()), (1 - share) / max(1, (1 - y).sum()))
    return Model(built[1, ALL], built[0, ALL], *logistic(x, y, weight))


def _scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.score(t) for t in common.byte_lists(b.column(1))], pa.float64())], ["doc_id", "score"])

    return common.tidied(run)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score)`` for every row of ``docs(doc_id, text)``; a null text counts as empty.

    Whole texts are compressed.  Only the text decides: repeated texts get equal
    scores.  Other columns are ignored; an empty table gives no rows.
    """
    common.small_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, score double")


def op4_compression_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from the labels of three quarters of them."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score(docs, train(docs.where(~held_out()), labels.where(~held_out())))
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
