"""Token-id output as files of bit-plane-shuffled chunks.

A file is a row of chunks, each followed by the four bytes "GBPE".  A chunk is
one self-describing byte string (integers are little-endian):

    magic "GBP1" | u32 plane bits (1 or 8) | u32 block ids | u64 ids | u32 documents
    | u32 index bytes | u64 plane bytes | u32 part | u64 ids of the part before it
    | chunk index (zstandard) | planes

The chunk index holds, in order, the document ids (int64), their lengths
(uint32), then for each block its number of planes and the compressed size of
each plane (uint32).  A block is a fixed number of ids transposed into bit or
byte planes, each compressed with zstandard; planes above the block's largest
id are not stored.  Any block can be read alone through the index.

Parts follow each other in ascending document order.  Files are written by
Spark's own committers (as raw lines that end in "GBPE"), so lost executors and
repeated tasks leave no trace and any store Spark reads can hold them; a reader
needs neither Spark nor Parquet (``chunks_of``).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MAGIC = b"GBP1"
END = b"GBPE"
HEAD = struct.Struct("<4sIIQIIQIQ")
#: Chunks in one file at most; what a reader holds is one file.
FILE_CHUNKS = 64
BLOCK_IDS = 16_384
CHUNK_IDS = 131_072


def to_planes(ids: np.ndarray, bits: int) -> list[bytes]:
    """The planes of a block, lowest first; as many as its largest id needs."""
    raw = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    top = int(ids.max()).bit_length() if len(ids) else 0
    if bits == 8:
        return [raw[:, k].tobytes() for k in range((top + 7) // 8)]
    return [np.packbits((ids >> np.uint32(k)).astype(np.uint8) & 1, bitorder="little").tobytes() for k in range(top)]


def from_planes(planes: list[bytes], n: int, bits: int) -> np.ndarray:
    out = np.zeros(n, np.uint32)
    for k, plane in enumerate(planes):
        part = np.frombuffer(plane, np.uint8) if bits == 8 else np.unpackbits(np.frombuffer(plane, np.uint8), count=n, bitorder="little")
        out |= part.astype(np.uint32) << np.uint32(k * bits)
    return out


def encode_chunk(doc_ids: list[int], lengths: list[int], ids: np.ndarray, bits: int = 8, block: int = BLOCK_IDS, level: int = 3, part: int = 0, before: int = 0) -> bytes:
    """One chunk of whole documents; ``ids`` are theirs in turn; ``before`` ids of the part precede them."""
    import zstandard

    press = zstandard.ZstdCompressor(level=level)
    sizes, body = [], []
    for at in range(0, len(ids), block):
        planes = [press.compress(p) for p in to_planes(ids[at : at + block], bits)]
        sizes += [len(planes), *map(len, planes)]
        body += planes
    index = press.compress(np.array(doc_ids, "<i8").tobytes() + np.array(lengths, "<u4").tobytes() + np.array(sizes, "<u4").tobytes())
    return b"".join([HEAD.pack(MAGIC, bits, block, len(ids), len(doc_ids), len(index), sum(map(len, body)), part, before), index, *body])


def decode_chunk(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, lengths, ids) of a chunk."""
    import zstandard

    magic, bits, block, n, docs, size, _, _, _ = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a bit-plane chunk")
    un = zstandard.ZstdDecompressor()
    index = un.decompress(data[HEAD.size : HEAD.size + size])
    doc_ids, lengths = np.frombuffer(index, "<i8", docs), np.frombuffer(index, "<u4", docs, 8 * docs)
    sizes, out, at, k = np.frombuffer(index, "<u4", offset=12 * docs), [], HEAD.size + size, 0
    for start in range(0, n, block):
        planes = []
        for length in sizes[k + 1 : k + 1 + sizes[k]].tolist():
            planes.append(un.decompress(data[at : at + length]))
            at += length
        k += 1 + int(sizes[k])
        out.append(from_planes(planes, min(block, n - start), bits))
    return doc_ids, lengths, np.concatenate(out) if out else np.empty(0, np.uint32)


def chunks_of(data: bytes) -> Iterator[tuple[int, int, int, memoryview]]:
    """(part, ids of the part before, ids, chunk) of each chunk of a file."""
    at, view = 0, memoryview(data)
    while at < len(data):
        magic, _, _, n, _, index, planes, part, before = HEAD.unpack_from(data, at)
        end = at + HEAD.size + index + planes
        if magic != MAGIC or data[end : end + len(END)] != END:
            raise ValueError("not a file of bit-plane chunks")
        yield part, before, n, view[at:end]
        at = end + len(END)


def _writer(path: str, byte_level: bool, end_id: int, bits: int, chunk_ids: int, literal: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc, end = TaskContext.get().partitionId(), common.encoder(path, byte_level, literal), np.array([end_id], "<u4").tobytes()
        ids, docs, lengths, held, before = [], [], [], 0, 0

        def flush():
            nonlocal ids, docs, lengths, held, before
            data = np.frombuffer(b"".join(ids), "<u4")
            row = pa.RecordBatch.from_arrays([pa.array([encode_chunk(docs, lengths, data, bits, part=part, before=before)], pa.binary())], ["chunk"])
            before += len(data)
            ids, docs, lengths, held = [], [], [], 0
            return row

        for b in batches:
            names, texts = b.column(0).to_pylist(), common.byte_lists(b.column(1))
            for name, one in zip(names, enc.encode(texts), strict=True):
                ids += [one, end]
                docs.append(NULL_ID if name is None else name)
                lengths.append(len(one) // 4 + 1)
                held += lengths[-1]
                if held >= chunk_ids:
                    yield flush()
        if docs:
            yield flush()

    return common.tidied(run)


#: Stands for a null document id inside a chunk; ascending order puts nulls first.
NULL_ID = -(2**63)


def write_token_files(docs: DataFrame, path: str, vocabulary: str, byte_level: bool, end_id: int, bits: int = 8, chunk_ids: int = CHUNK_IDS, literal: bool = False) -> None:
    """Write the token ids of ``docs(doc_id, text)`` in ascending doc_id order as files below ``path``.

    Rows are ranged by doc_id, and rows that share one by a hash of their text
    and their place, before they are encoded (text shuffles smaller than
    incompressible ids), encoded in a stream and written chunk by chunk; a worker
    holds one chunk.  Null text counts as empty (only the end id); null doc_id
    sorts first; rows that share a doc_id are all kept, in the order of the hash
    of their text.  Other columns are ignored.  An empty table gives no chunks.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    text = F.col("text").cast("string")
    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("place"))
    ordered = placed.repartitionByRange(parts, "doc_id", "hash", "place").sortWithinPartitions("doc_id", "hash", "text").select("doc_id", "text")
    chunks = ordered.mapInArrow(_writer(vocabulary, byte_level, end_id, bits, chunk_ids, literal), "chunk binary")
    chunks.select(F.col("chunk").cast("string").alias("value")).write.option("lineSep", END.decode()).option("maxRecordsPerFile", FILE_CHUNKS).text(path)


@common.tidied
def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for content in b.column(0):
            heads = [(part, n) for part, _, n, _ in chunks_of(content.as_buffer().to_pybytes())]
            yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in heads], pa.int32()), pa.array([h[1] for h in heads], pa.int64())], ["part", "n"])


def _reader(bases):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = bases.value
        for b in batches:
            for content in b.column(0):
                for part, before, _, chunk in chunks_of(content.as_buffer().to_pybytes()):
                    doc_ids, lengths, ids = decode_chunk(chunk)
                    data, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(lengths, dtype=np.int64)
                    starts = ends - lengths
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array([None if x == NULL_ID else x for x in doc_ids.tolist()], pa.int64()),
                            "start": pa.array(starts + base[part] + before),
                            "n_tokens": pa.array(lengths.astype(np.int64)),
                            "ids_crc32": pa.array([zlib.crc32(data[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], pa.int64()),
                        }
                    )

    return common.tidied(run)


def read_token_files(spark, path: str) -> DataFrame:
    """Rows ``(doc_id, start, n_tokens, ids_crc32)`` read back from the files below ``path``.

    Each part's first position is the sum of the ids in the parts before it:
    one number for each written partition goes through the driver.
    """
    common.small_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    first, bases = 0, {}
    for part, n in sorted(tuple(r) for r in files.mapInArrow(_heads, "part int, n long").groupBy("part").agg(F.sum("n")).collect()):
        bases[part] = first
        first += n
    return files.mapInArrow(_reader(spark.sparkContext.broadcast(bases)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_token_bitplanes(spark, sf_dir: str) -> DataFrame:
    """Every document's ids written in bit planes and read back."""
    import public_tokenizers

    path = common.staged_path(spark, "token-files")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"), False, 2)
    return read_token_files(spark, path)
