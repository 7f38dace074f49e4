"""What the training-data operators share: staging, hashing, components, tokenisers.

Nothing here depends on machine-local folders: staged tables go below the
folder that ``spark.checkpoint.dir`` names, which driver and executors share.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import staging
from ..staging import shared_dir, staged, staged_path  # noqa: F401

#: Rows in one Arrow batch sent to Python; bounds a worker's memory for long texts.
BATCH_ROWS = 1000


def clear(spark: SparkSession) -> int:
    """Delete the staged tables of this application and put its Arrow batch sizes back; how many tables went.

    Results that were not written or collected yet can't be read afterwards.
    """
    while _batches:
        key, old = _batches.popitem()
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)
    return staging.clear(spark)


#: Rows of a few numbers up to which a side of a join is broadcast; beyond, both sides shuffle.
BROADCAST_ROWS = 1_000_000


def checked_broadcast(df: DataFrame) -> DataFrame:
    """``df`` (staged, narrow) marked for broadcast if it is small enough: wide rows then needn't shuffle to meet it."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


#: Bytes of such a batch (one row at least).
BATCH_BYTES = 1 << 25
_ROWS_KEY, _BYTES_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
#: The session's own settings, once they were lowered.
_batches: dict[str, str | None] = {}


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Bound the Arrow batches that go to Python by rows and bytes; keeps lower settings.

    It holds until ``clear``: results are computed after the call that made them.
    """
    for key, most in ((_ROWS_KEY, rows), (_BYTES_KEY, size)):
        now = re.match(r"-?\d+", spark.conf.get(key, None) or "0")
        if now is None or int(now[0]) <= 0 or int(now[0]) > most:
            _batches.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, str(most))


def byte_lists(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


# ---------------------------------------------------------------- hashing

M64 = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer on uint64 (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Bytes of a word that are hashed eight at a time; longer words go to a library digest.
LONG_WORD = 256
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def hash_words(normal: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hashes, first bytes, end bytes) of the words of a text with one space between words.

    Eight bytes at a time are added to a word's state, which a bijective mixer
    then scatters: words of up to eight bytes never clash with ones as long, and
    longer ones only by chance (2^-64 for a pair), whatever pattern they have.
    Words of more than ``LONG_WORD`` bytes take the xxh3 digest of all of them.
    """
    data = np.frombuffer(normal + bytes(8), np.uint8)
    gaps = np.flatnonzero(data[: len(normal)] == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.append(gaps, len(normal))
    eights = np.ndarray((len(normal) + 1,), "<u8", data.tobytes(), strides=(1,))
    left, at = ends - starts, starts
    out = left.astype(np.uint64) * _SPREAD
    long = np.flatnonzero(left > LONG_WORD)
    live = None if not len(long) else np.flatnonzero(left <= LONG_WORD)
    if live is not None:
        left, at = left[live], at[live]
    while len(left):
        state = mix64((out if live is None else out[live]) + (eights[at] & _KEEP[np.minimum(left, 8)]))
        if live is None:
            out = state
        else:
            out[live] = state
        more = np.flatnonzero(left > 8)
        live, left, at = more if live is None else live[more], left[more] - 8, at[more] + 8
    if len(long):
        import xxhash

        for i in long.tolist():
            out[i] = xxhash.xxh3_64_intdigest(normal[starts[i] : ends[i]])
    return out, starts, ends


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every run of ``n`` consecutive word hashes."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(size, np.uint64)
    for i in range(n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += hashes[i : i + size]
        out ^= out >> np.uint64(29)
    return mix64(out)


def tidied(run):
    """A batch function that gives its memory back when its task ends: idle workers keep none of it.

    What encoders remember goes (tokenizers stay), and so does what Arrow's pool holds for later batches.
    """

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            for e in _encoders.values():
                e.forget()
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # not every C library has it
                pass

    return wrapped


# ---------------------------------------------------------------- tokenisers

_tokenizers: dict[tuple[str, bool], object] = {}


def tokenizer(path: str, literal: bool = False):
    """The tokenizer of a vocabulary file, once in each process, on one thread; ``literal``: control strings are ordinary text."""
    if (path, literal) not in _tokenizers:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        if literal:
            t.encode_special_tokens = True
        _tokenizers[path, literal] = t
    return _tokenizers[path, literal]


def _byte_chars() -> dict[int, str]:
    """The public byte-level alphabet: printable Latin-1 bytes are themselves, the others follow from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(256 + i) for i, b in enumerate(hidden)}


BYTE_CHARS = _byte_chars()


class PreTokens(dict):
    """Pre-token -> its ids as bytes, by the library's model (which takes each byte as one printable character)."""

    def __init__(self, model, old: dict | None = None):
        super().__init__()
        self.model, self.old = model, dict(old or ())

    def __missing__(self, t: str) -> bytes:
        ids = self.old.get(t)
        if ids is None:
            plain = t.replace(" ", BYTE_CHARS[32]) if t.isascii() and t.isprintable() else t.encode().decode("latin-1").translate(BYTE_CHARS)
            ids = array("I", [x.id for x in self.model.tokenize(plain)]).tobytes()
        self[t] = ids
        return ids


class WordEncoder:
    """Token ids of whole texts by the tokenizers library, remembered by pre-token.

    Byte-pair merges never cross pre-tokens, so a text's ids are those of its
    pre-tokens in turn, and each distinct pre-token need be encoded only once.
    Pre-tokens are found by the vocabulary's published split pattern, written
    below for the characters where Python's classes and the library's surely
    agree (Latin letters, ASCII digits, common punctuation and white space);
    a text with any other character, or with one of the vocabulary's added
    tokens (in any case), is encoded whole by the library.  With ``literal``
    control strings are split like ordinary text instead of becoming one id.

    ``byte_level`` says which of the two patterns holds: that of byte-level
    vocabularies (a space belongs to the pre-token after it) or that of word
    vocabularies (lower-cased, white space dropped).
    """

    #: Pre-tokens in each of two generations that are remembered; about 200 bytes each.  A full young
    #: generation becomes the old one; what is met again moves back to the young one.
    MOST = 150_000
    LETTER = "A-Za-zÀ-ÖØ-öø-įĲ-ňŊ-ž"
    OTHER = f"[^\\t\\n\\r -~{LETTER}¡¢£¥§©«®°±¶·»¿×÷‐-‧‰-⁞€™]"
    BYTE_LEVEL = re.compile(f"'(?:[sdmt]|ll|ve|re)| ?[{LETTER}]+| ?[0-9]+| ?[^\\s{LETTER}0-9]+|\\s+(?!\\S)|\\s+")
    WORD_LEVEL = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[0-9]|[^\\s{LETTER}0-9]+")

    def __init__(self, path: str, byte_level: bool, literal: bool = False):
        self.whole, self.byte_level = tokenizer(path, literal), byte_level
        self.known = PreTokens(self.whole.model)
        added = [] if literal else [re.escape(t.content) for t in self.whole.get_added_tokens_decoder().values()]
        self.odd = re.compile("|".join([self.OTHER, *(f"(?i:{t})" for t in added)])).search
        self.split = (self.BYTE_LEVEL if byte_level else self.WORD_LEVEL).findall

    def forget(self) -> None:
        """Drop the remembered pre-tokens."""
        self.known = PreTokens(self.known.model)

    def encode(self, texts: Iterable[bytes]) -> Iterator[bytes]:
        """For each UTF-8 text its ids as little-endian unsigned 32-bit integers."""
        odd, split = self.odd, self.split
        for raw in texts:
            text = raw.decode("utf-8", "surrogatepass")
            if odd(text):
                yield np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            else:
                yield b"".join(map(self.known.__getitem__, split(text if self.byte_level else text.lower())))
                if len(self.known) > self.MOST:
                    self.known = PreTokens(self.known.model, self.known)


_encoders: dict[tuple[str, bool, bool], WordEncoder] = {}


def encoder(path: str, byte_level: bool, literal: bool = False) -> WordEncoder:
    """One encoder in each Python worker, kept between tasks; what it remembers lasts for a task (``tidied``)."""
    key = path, byte_level, literal
    if key not in _encoders:
        _encoders[key] = WordEncoder(*key)
    return _encoders[key]


# ---------------------------------------------------------------- union-find

class Forest:
    """Union-find over small local integers; ``links`` are the edges that joined two trees."""

    def __init__(self, n: int):
        self.parent = list(range(n))
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def join(self, a: int, b: int) -> bool:
        ra, rb = self.root(a), self.root(b)
        if ra == rb:
            return False
        self.parent[max(ra, rb)] = min(ra, rb)
        self.links.append((a, b))
        return True


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a long, b long)``: rows ``(node, component)``, the least node of each.

    Alternating large-star and small-star rounds on distributed edge tables;
    minima are aggregated (never collected) and joined back, so that a hub with
    many neighbours is split by adaptive skew joins.  Each half round is written
    to the shared folder once.  Every round brings edges nearer to the least
    nodes, so the rounds end (about log n of them).  Nodes without an edge do
    not appear; null ends and self-loops are ignored.
    """
    spark = edges.sparkSession
    shared_dir(spark)
    hi, lo = F.greatest("a", "b"), F.least("a", "b")
    now = staged(edges.where("a is not null and b is not null and a <> b").select(hi.alias("u"), lo.alias("v")).distinct(), "edges")
    settled = now.isEmpty()
    while not settled:
        # Large star: every larger neighbour of u goes to u's least neighbour (or u itself).
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written, so that the join shuffles both sides anew and adaptive execution can split a hub's rows.
        least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")), "least")
        large = staged(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        # Small star: every smaller neighbour of u, and u, go to the least of them.
        least = staged(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        now = staged(large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct(), "edges")
        # A fixed point is a set of stars: no centre of one is a leaf of another, every leaf has one centre.
        settled = now.groupBy("u").count().where("count > 1").isEmpty() and now.join(now.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()
    pairs = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return pairs.unionByName(now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component")))
