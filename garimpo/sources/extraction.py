"""From PDF files to structured pages: the seam for extractors, and everything that needs none of them.

Reading a PDF takes libraries that the caller brings: ``reader(bytes)`` yields
pages, each a dict of ``pagina`` and any of ``blocks`` (text blocks of lines of
spans with font and size), ``tables`` (rows of cells), ``text`` (plain) and
``elements`` (already typed).  ``ocr(bytes, pagina)`` gives the text of a page's
picture.  What becomes of it is columns: ``elements_of_pages``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import structure

#: Bytes of files that a worker is sent at a time.
BATCH_BYTES = 1 << 26
SPAN = "struct<text:string,size:double,font:string>"
RAW = f"documento string, pagina int, blocks array<array<array<{SPAN}>>>, tables array<array<array<string>>>, text string, elements array<struct<tipo:string,texto:string>>, ocr string, error string"
_span = pa.struct([("text", pa.string()), ("size", pa.float64()), ("font", pa.string())])
_types = {
    "documento": pa.string(), "pagina": pa.int32(), "blocks": pa.list_(pa.list_(pa.list_(_span))), "tables": pa.list_(pa.list_(pa.list_(pa.string()))), "text": pa.string(),
    "elements": pa.list_(pa.struct([("tipo", pa.string()), ("texto", pa.string())])), "ocr": pa.string(), "error": pa.string(),
}


def _bare(page: dict) -> bool:
    """Whether a page has nothing to read: no typed text, no plain text, no span with a letter or digit."""
    spans = (s for block in page.get("blocks") or () for line in block for s in line)
    typed = any((e.get("texto") or "").strip() for e in page.get("elements") or () if e.get("tipo") != "section")
    return not (typed or (page.get("text") or "").strip() or any((s.get("text") or "").strip() for s in spans))


def _pages(content: bytes, readers: tuple, ocr) -> Iterator[dict]:
    """The pages by the first reader that has any; the last one's failure is the file's."""
    pages: list[dict] = []
    for i, reader in enumerate(readers):
        try:
            pages = list(reader(content))
        except Exception:
            if i == len(readers) - 1:
                raise
            continue  # the next reader's turn
        if pages:
            break
    for page in pages:
        seen = None
        if ocr is not None and _bare(page):
            try:
                seen = ocr(content, page["pagina"])
            except Exception:  # a page that can't be recognised stays without text
                seen = None
        yield {**page, "ocr": seen}


def pages_of_pdf(files: DataFrame, *readers: Callable[[bytes], Iterable[dict]], ocr: Callable[[bytes, int], str | None] | None = None) -> DataFrame:
    """Raw pages of ``files(documento, content)`` (see ``readers.pdf_files``), one file at a time in a task.

    Readers are tried in order until one has pages.  A file that none can read
    gives one row with its ``error`` and no page; other files go on.  Files go
    to Python in batches of ``BATCH_BYTES`` (one file at least), a setting that
    the session keeps unless it has a lower one.
    """
    conf, key = files.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.match(r"\d+", conf.get(key, None) or "")
    if now is None or int(now[0]) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    rows = [{**p, "documento": name} for p in _pages(content.as_py() or b"", readers, ocr)]
                except Exception as e:
                    rows = [{"documento": name, "error": str(e)[:2000]}]
                yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in _types.items()], list(_types))

    return files.select("documento", "content").mapInArrow(run, RAW)


def span_lines(pages: DataFrame) -> DataFrame:
    """Lines of ``pages(documento, pagina, blocks)`` as ``structure`` takes them: (documento, page, pos, texto, font_size, is_bold).

    A line's spans are stripped and joined by blanks; its size is that of its
    largest span with text; it is bold if any of its fonts is called so.
    """
    line = pages.select("documento", F.col("pagina").alias("page"), F.posexplode(F.flatten("blocks")).alias("pos", "spans"))
    filled = F.filter("spans", lambda s: F.trim(F.coalesce(s["text"], F.lit(""))) != "")
    text = F.regexp_replace(F.trim(F.array_join(F.transform("spans", lambda s: F.trim(F.coalesce(s["text"], F.lit("")))), " ")), r"\s{2,}", " ")
    bold = F.contains(F.lower(F.array_join(F.transform("spans", lambda s: F.coalesce(s["font"], F.lit(""))), " ")), F.lit("bold"))
    return line.select("documento", "page", "pos", text.alias("texto"), F.coalesce(F.array_max(F.transform(filled, lambda s: s["size"])), F.lit(0.0)).alias("font_size"), bold.alias("is_bold")).where("texto <> ''")


def table_elements(pages: DataFrame) -> DataFrame:
    """(documento, pagina, table_index, texto): each table that has a filled cell as Markdown, counted from 1 on its page."""
    each = pages.select("documento", "pagina", F.posexplode("tables").alias("i", "rows"))
    return each.select("documento", "pagina", (F.col("i") + 1).alias("table_index"), X.table_markdown(F.col("rows")).alias("texto")).where("texto <> ''")


def _runs(lines: DataFrame) -> DataFrame:
    """Span lines as sections and cleaned runs of text between them: (documento, pagina, pos, tipo, texto)."""
    e = structure.elements_of_lines(lines)
    w = W.partitionBy("documento", "pagina").orderBy("pos")
    run = F.sum((F.col("tipo") == "section").cast("int")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    e = e.withColumn("run", run)
    text = X.clean_extracted(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "texto"))), lambda x: x["texto"]), "\n"))
    return e.groupBy("documento", "pagina", "run", "tipo").agg(F.min("pos").alias("pos"), text.alias("texto")).where("texto <> ''").drop("run")


def elements_of_pages(pages: DataFrame) -> DataFrame:
    """Typed elements of raw pages in order: ``(documento, pagina, pos, tipo, texto, table_index, ocr_usado)``.

    A page's elements as given, else its lines as sections and runs (its plain
    text where it has no lines), then a recognised text if it had none, then its
    tables.
    """
    given = pages.where("size(elements) > 0").select("documento", "pagina", F.posexplode("elements").alias("pos", "e")).select("documento", "pagina", "pos", "e.tipo", F.trim("e.texto").alias("texto")).where("texto <> ''")
    bare = pages.where("coalesce(size(elements), 0) <= 0")
    lined = _runs(span_lines(bare))
    plain = bare.join(lined.select("documento", "pagina").distinct(), ["documento", "pagina"], "left_anti").select("documento", "pagina", F.lit(0).alias("pos"), F.lit("text").alias("tipo"), X.clean_extracted("text").alias("texto")).where("texto <> ''")
    seen = pages.select("documento", "pagina", F.lit(1 << 28).alias("pos"), F.lit("ocr_text").alias("tipo"), X.clean_extracted("ocr").alias("texto")).where("texto <> ''")
    whole = [t.select("documento", "pagina", F.col("pos").cast("int").alias("pos"), "tipo", "texto", F.lit(None).cast("int").alias("table_index")) for t in (given, lined, plain, seen)]
    tables = table_elements(bare).select("documento", "pagina", (F.col("table_index") + (1 << 29)).alias("pos"), F.lit("table").alias("tipo"), "texto", "table_index")
    out = whole[0]
    for t in [*whole[1:], tables]:
        out = out.unionByName(t)
    w = W.partitionBy("documento", "pagina")
    return out.withColumn("ocr_usado", F.max((F.col("tipo") == "ocr_text").cast("int")).over(w) == 1).withColumn("pos", (F.row_number().over(w.orderBy("pos")) - 1).cast("int"))


def page_texts(elements: DataFrame) -> DataFrame:
    """(documento, pagina, texto, n_elements): a page's text without its sections; with them where there is nothing else."""
    joined = lambda keep: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep & (F.col("texto") != ""), F.struct("pos", "texto")))), lambda x: x["texto"]), "\n\n")
    per = elements.groupBy("documento", "pagina").agg(joined(F.col("tipo") != "section").alias("a"), joined(F.lit(True)).alias("b"), F.count("*").alias("n_elements"))
    return per.select("documento", "pagina", X.clean_extracted(F.when(F.trim("a") != "", F.col("a")).otherwise(F.col("b"))).alias("texto"), "n_elements")


def structured_documents(elements: DataFrame) -> DataFrame:
    """(documento, paginas) as the structured payload has them, sections carried forward within a page."""
    e = structure.carry_sections(elements)
    item = F.struct("pos", F.struct("tipo", "texto", F.col("section_heading").alias("secao"), "table_index").alias("e"))
    per = e.groupBy("documento", "pagina").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["e"]).alias("elementos"), F.bool_or("ocr_usado").alias("ocr_usado"))
    pages = per.join(page_texts(elements).select("documento", "pagina", "texto"), ["documento", "pagina"])
    return pages.groupBy("documento").agg(F.array_sort(F.collect_list(F.struct("pagina", "texto", "elementos", "ocr_usado"))).alias("paginas"))


def extraction_summary(files: DataFrame, pages: DataFrame, elements: DataFrame) -> DataFrame:
    """One row: files found and read, pages, characters of their texts, and each unread file's error."""
    bad = F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("documento", F.col("error").alias("erro")))))
    of = lambda df, c: df.scalar() if c is None else df.select(c).scalar()
    found = files.agg(F.count("*"))
    read = pages.agg(F.count_distinct(F.when(F.col("error").isNull(), F.col("documento"))).alias("read"), bad.alias("documento_erros"))
    text = page_texts(elements).agg(F.count("*").alias("total_paginas"), F.coalesce(F.sum(F.length("texto")), F.lit(0)).alias("total_caracteres"))
    return text.select(of(found, None).alias("total_pdfs_encontrados"), of(read, "read").alias("pdfs_processados"), "total_paginas", "total_caracteres", of(read, "documento_erros").alias("documento_erros"))
