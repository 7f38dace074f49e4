"""Metadata of structured documents, from their pages' typed elements; what those don't say comes from their lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from . import structure

#: Where lines end, as Python's str.splitlines has it.
LINES = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"
#: Elements that an abstract is made of.
SPOKEN = ("text", "ocr_text", "table")


def pages_of(structured: DataFrame) -> DataFrame:
    """``(documento, page, texto, elementos, paginas_total)``: pages by their place in the document, from 1.

    A document without pages fails the query.
    """
    some = structured.where(F.when(F.size(F.coalesce("paginas", F.array())) > 0, True).otherwise(F.raise_error(F.concat(F.lit("no pages in "), F.coalesce("documento", F.lit("?")))).cast("boolean")))
    name = F.replace(F.trim("documento"), F.lit("\\"), F.lit("/"))
    each = some.select(name.alias("documento"), F.size("paginas").alias("paginas_total"), F.posexplode("paginas").alias("i", "p"))
    return each.select("documento", (F.col("i") + 1).alias("page"), F.coalesce("p.texto", F.lit("")).alias("texto"), F.col("p.elementos").alias("elementos"), "paginas_total")


def elements(pages: DataFrame) -> DataFrame:
    """``(documento, page, pos, tipo, texto)``: the pages' elements that aren't blank, trimmed."""
    each = pages.select("documento", "page", F.posexplode("elementos").alias("pos", "e"))
    return each.select("documento", "page", "pos", F.coalesce("e.tipo", F.lit("text")).alias("tipo"), X.stripped(F.col("e.texto")).alias("texto")).where("texto <> ''")


def lines(pages: DataFrame) -> DataFrame:
    """``(documento, page, pos, texto, font_size, is_bold)``: elements line by line, sections large and bold; a page without any by its text."""
    cut = lambda c: F.posexplode(F.transform(F.split(c, LINES), X.stripped)).alias("line", "texto")
    section = F.col("tipo") == "section"
    own = elements(pages).select("documento", "page", "pos", section.alias("is_bold"), F.when(section, 14.0).otherwise(12.0).alias("font_size"), cut("texto")).where("texto <> ''")
    filled = F.exists(F.coalesce("elementos", F.array()), lambda e: X.stripped(e["texto"]) != "")
    bare = pages.where(~F.coalesce(filled, F.lit(False))).select("documento", "page", F.lit(0).alias("pos"), F.lit(False).alias("is_bold"), F.lit(12.0).alias("font_size"), cut(X.stripped(F.col("texto")))).where("texto <> ''")
    return own.unionByName(bare).select("documento", "page", (F.col("pos") * 10_000 + F.col("line")).alias("pos"), "texto", "font_size", "is_bold")


def abstracts(pages: DataFrame, span_lines: DataFrame, most_pages: int = 5, enough: int = 1500, most: int = 2000) -> DataFrame:
    """(documento, resumo): what follows a section that opens an abstract, on the first of the first pages that has any.

    A page's text ends before another section, or with the element that takes it
    past ``enough`` characters; it is cut at ``most``.  Documents without one are
    looked through line by line.
    """
    w = W.partitionBy("documento", "page").orderBy("pos")
    sofar, before = w.rowsBetween(W.unboundedPreceding, W.currentRow), w.rowsBetween(W.unboundedPreceding, -1)
    section = F.col("tipo") == "section"
    opens = section & X.stripped(F.regexp_replace(F.lower("texto"), ":+$", "")).isin(*structure.ABSTRACT_OPENS)
    marked = elements(pages).where(F.col("page") <= most_pages).withColumn("opens", opens).withColumn("open", F.max(opens.cast("int")).over(sofar))
    after = marked.where("open = 1 and not opens").withColumn("ended", F.max((F.col("tipo") == "section").cast("int")).over(sofar))
    said = after.where((F.col("ended") == 0) & F.col("tipo").isin(*SPOKEN)).withColumn("chars", F.coalesce(F.sum(F.length("texto") + 1).over(before), F.lit(0)) - 1)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "texto"))), lambda x: x["texto"]), " ")
    per_page = said.where(F.col("chars") <= enough).groupBy("documento", "page").agg(F.substring(text, 1, most).alias("resumo"))
    own = per_page.groupBy("documento").agg(F.min_by("resumo", "page").alias("resumo"))
    return _first_of(own, structure.abstracts(span_lines), "resumo")


def sections(pages: DataFrame, span_lines: DataFrame) -> DataFrame:
    """(documento, secoes): distinct section elements in order, whatever their case; without any, section lines."""
    found = elements(pages).where("tipo = 'section'")
    first = found.groupBy("documento", F.lower("texto").alias("k")).agg(F.min(F.struct("page", "pos", "texto")).alias("f"))
    own = first.groupBy("documento").agg(F.transform(F.array_sort(F.collect_list("f")), lambda x: x["texto"]).alias("secoes"))
    return _first_of(own, structure.sections(span_lines), "secoes")


def _first_of(own: DataFrame, other: DataFrame, column: str) -> DataFrame:
    """Documents' values in the first table, else in the second."""
    return own.withColumnRenamed(column, "_own").join(other, "documento", "full_outer").select("documento", F.coalesce("_own", column).alias(column))


def years(pages: DataFrame, most_pages: int = 3) -> DataFrame:
    """(documento, ano): the first year from 1990 to 2030 in the first pages' texts."""
    found = F.transform(F.regexp_extract_all("texto", F.lit(r"(?<![\p{L}\p{N}_])((?:19|20)[0-9]{2})(?![\p{L}\p{N}_])"), F.lit(1)), lambda y: y.cast("int"))
    valid = F.filter(found, lambda y: y.between(1990, 2030))
    each = pages.where(F.col("page") <= most_pages).select("documento", "page", F.get(valid, F.lit(0)).alias("ano")).where("ano is not null")
    return each.groupBy("documento").agg(F.min_by("ano", "page").alias("ano"))


def metadata(structured: DataFrame, properties: DataFrame | None = None) -> DataFrame:
    """The metadata of ``structured(documento, paginas)``, as ``structure.document_metadata`` gives it, with ``paginas_total``.

    ``properties(documento, author, creator, created, modified)`` are those of
    the files, where they are known.
    """
    pages = pages_of(structured)
    span_lines = lines(pages)
    d = pages.select("documento", "paginas_total").distinct()
    for table in (structure.titles(span_lines), structure.authors(span_lines), abstracts(pages, span_lines), sections(pages, span_lines), years(pages)):
        d = d.join(table, "documento", "left")
    return structure.described(d.withColumn("titulo", F.coalesce("titulo", F.lit(""))), properties, "paginas_total")


def register(table, found: DataFrame, at: Column | None = None) -> int:
    """Upsert metadata into a stored library (``plans.versioned``) by id and document; the version made."""
    return table.upsert(found.withColumn("atualizado_em", F.date_format(F.current_timestamp() if at is None else at, "yyyy-MM-dd'T'HH:mm:ss'Z'")))
