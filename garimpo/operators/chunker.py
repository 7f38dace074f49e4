"""Chunks that end at periods, made by a table function over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X


def windows(words: list[str], size: int, overlap: int) -> list[str]:
    """Word windows, each but the last ended at its last period where that lies in the second half of its characters.

    A window that ends at a period moves the next one back to ``overlap`` words
    before it, if it keeps more words than that; else the next one starts where
    it would have without (words in between belong to no window).
    """
    out, start, stride = [], 0, max(1, size - overlap)
    while start < len(words):
        piece = " ".join(words[start : start + size])
        if start + size >= len(words):
            out.append(piece)
            break
        after, dot = start + stride, piece.rfind(".")
        if 2 * dot > len(piece):
            piece = piece[: dot + 1]
            kept = piece.count(" ") + 1
            if kept > overlap:
                after = max(start + kept - overlap, start + 1)
        out.append(piece)
        start = after
    return out


class _Chunker:
    """The rows' last three columns are a text with one blank between words, the window's size and the overlap."""

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        texts, sizes, overlaps = (c.to_pylist() for c in rows.columns[-3:])
        at, number, pieces = [], [], []
        for i, (text, size, overlap) in enumerate(zip(texts, sizes, overlaps, strict=True)):
            found = windows(text.split(" "), size, overlap) if text else []
            at += [i] * len(found)
            number += range(len(found))
            pieces += found
        names = rows.schema.names[:-3]
        kept = rows.select(names).take(pa.array(at, pa.int64())) if names else None
        columns = {c: kept.column(c) for c in names}
        yield pa.table(columns | {"chunk_index": pa.array(number, pa.int32()), "texto": pa.array(pieces, pa.string())})


def period_chunk_rows(rows: DataFrame, text: str, size, overlap) -> DataFrame:
    """Every row of ``rows`` once for each of its text's chunks: its other columns, ``chunk_index`` and ``texto``.

    ``size`` and ``overlap`` are numbers or columns.  A text without words has no
    chunk.  White space is squeezed in the JVM; the windows are cut in batches,
    in one pass over the words, and nothing shuffles.
    """
    number = lambda v: (F.lit(v) if isinstance(v, int) else v).cast("int")
    kept = [f for f in rows.schema.fields if f.name != text]
    made = T.StructType([*kept, T.StructField("chunk_index", T.IntegerType()), T.StructField("texto", T.StringType())])
    table = rows.select(*[F.col(f"`{f.name}`") for f in kept], X.squeezed(F.coalesce(F.col(text), F.lit(""))).alias("_text"), number(size).alias("_size"), number(overlap).alias("_overlap"))
    return F.arrow_udtf(_Chunker, returnType=made)(table.asTable())
