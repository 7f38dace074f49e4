"""Text functions as column expressions; all stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token: two or more letters, digits, underscores or inner hyphens.  Spelt out, as Java's \w is ASCII.
TOKEN = r"[\p{L}\p{N}_][\p{L}\p{N}_\-]*[\p{L}\p{N}_]"
#: White space as Python's str.split sees it (but for the rare separators 1C-1F, 85).
SPACE = r"(?U)\s+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: Column | str) -> Column:
    """Lower-case tokens in order, repeats kept; null gives none."""
    return F.coalesce(F.regexp_extract_all(F.lower(col(text)), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def _folds() -> tuple[str, str]:
    """Accented lower-case letters and the plain letter that each decomposes to."""
    accented, plain = [], []
    for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFKD", chr(c))
        kept = "".join(x for x in base if not unicodedata.combining(x))
        if chr(c).lower() == chr(c) and len(kept) == 1 and kept != chr(c):
            accented.append(chr(c))
            plain.append(kept)
    return "".join(accented), "".join(plain)


ACCENTED, PLAIN = _folds()


def fold(text: Column | str) -> Column:
    """Lower case without accents."""
    return F.regexp_replace(F.translate(F.lower(F.coalesce(col(text), F.lit(""))), ACCENTED, PLAIN), r"\p{M}+", "")


def squeezed(text: Column | str) -> Column:
    """White-space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(col(text), SPACE, " "))


def stripped(text: Column) -> Column:
    """Without white space at either end; null stays null."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def words(text: Column | str) -> Column:
    return F.filter(F.split(squeezed(F.coalesce(col(text), F.lit(""))), " "), lambda w: w != "")


def word_count(text: Column | str) -> Column:
    return F.size(words(text))


def holds_any(text: Column, terms) -> Column:
    """Whether any of a few literal strings is in the text."""
    found = F.lit(False)
    for t in terms:
        found = found | F.contains(text, F.lit(t))
    return F.coalesce(found, F.lit(False))


def holds_keyword(folded: Column, keyword: str) -> Column:
    """Several words: as a substring; one word: as a whole word."""
    if " " in keyword:
        return F.contains(folded, F.lit(keyword))
    edge = r"[\p{L}\p{N}_]"
    return folded.rlike(f"(?<!{edge}){keyword}(?!{edge})")


def trim_parent(text: Column | str, most: int = 900) -> Column:
    """The first ``most`` words, with an ellipsis where there are more."""
    w = words(text)
    return F.when(F.size(w) > most, F.concat(F.array_join(F.slice(w, 1, most), " "), F.lit(" ..."))).otherwise(F.array_join(w, " "))


def excerpt(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most)), F.lit("..."))).otherwise(text)


def lines(text: Column | str) -> Column:
    t = F.replace(F.replace(F.coalesce(col(text), F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.split(t, "\n")


def clean_text(text: Column | str) -> Column:
    """Lines stripped and joined, without blank lines, section marks and lone one- or two-digit numbers."""
    kept = F.filter(F.transform(lines(text), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: (x != "") & ~x.startswith("### SECAO:"))
    joined = F.regexp_replace(F.array_join(kept, " "), r"(?U)\s+(?-U)[0-9]{1,2}(?U)\s+", " ")
    return F.trim(F.regexp_replace(joined, r"(?U)\s{2,}", " "))


def clean_extracted(text: Column | str) -> Column:
    """Without control characters; line ends stripped on the right; at most two blank lines in a row."""
    plain = F.regexp_replace(F.coalesce(col(text), F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    joined = F.array_join(F.transform(lines(plain), lambda x: F.regexp_replace(x, r"(?U)\s+$", "")), "\n")
    return F.regexp_replace(F.regexp_replace(joined, r"\n{4,}", "\n\n\n"), r"(?U)^\s+|\s+$", "")


def base_name(path: Column | str) -> Column:
    return F.element_at(F.split(F.replace(col(path), F.lit("\\"), F.lit("/")), "/"), -1)


def stem(path: Column | str) -> Column:
    """File name without its extension."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def document_key(path: Column | str) -> Column:
    """The join key of uploads: kept below ``uploads/``, else ``uploads/<file name>``."""
    p = F.replace(F.trim(F.coalesce(col(path), F.lit(""))), F.lit("\\"), F.lit("/"))
    return F.when(p == "", F.lit("uploads/desconhecido.pdf")).when(p.startswith("uploads/"), p).otherwise(F.concat(F.lit("uploads/"), base_name(p)))


def document_id(path: Column | str, year: Column, always: bool = False) -> Column:
    """A stable id from the file name, the year in front unless it is there already; ``always``: even then.

    A name may begin with the year's digits by chance (``19988.pdf`` of 1998); where names are numbers, ``always``
    keeps the ids of one form.
    """
    clean = F.regexp_replace(F.trim(F.regexp_replace(stem(path), r"[^\p{L}\p{N}_\s-]", "")), r"\s+", "_")
    y = year.cast("string")
    bare = year.isNull() if always else year.isNull() | clean.startswith(y)
    return F.when(bare, clean).otherwise(F.concat_ws("_", y, clean))


def year_in(text: Column) -> Column:
    """The first year 1900-2099 that stands alone."""
    edge = r"[\p{L}\p{N}_]"
    found = F.regexp_extract(text, f"(?<!{edge})((?:19|20)[0-9]{{2}})(?!{edge})", 1)
    return F.when(found != "", found.cast("int"))


def sentences(text: Column | str, least_words: int = 5) -> Column:
    """Sentences of at least so many words."""
    parts = F.transform(F.split(F.coalesce(col(text), F.lit("")), r"(?<=[.!?])\s+"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: w != "")) >= least_words)


def surname(name: Column) -> Column:
    return F.element_at(F.split(squeezed(name), " "), -1)


def first_author(authors: Column) -> Column:
    a = F.try_element_at(authors, F.lit(1))
    return F.when(a.isNotNull() & (a != ""), a)


def source_label(authors: Column, year: Column, title: Column, document: Column) -> Column:
    """``Surname, year - "title"``, or the file's name and year."""
    who = first_author(authors)
    y = F.when(year.isNotNull() & (year != 0), year.cast("string"))
    named = F.concat(surname(who), F.coalesce(F.concat(F.lit(", "), y), F.lit("")), F.when(title.isNotNull() & (title != ""), F.concat(F.lit(' — "'), title, F.lit('"'))).otherwise(""))
    file = stem(F.coalesce(document, F.lit("desconhecido")))
    return F.when(who.isNotNull(), named).otherwise(F.concat(file, F.coalesce(F.concat(F.lit(" ("), y, F.lit(")")), F.lit(""))))


def citation_label(authors: Column, year: Column, document: Column) -> Column:
    """``Surname, year`` with ``s.d.`` for no year; the file's name where no author is known."""
    who = first_author(authors)
    y = F.coalesce(F.when(year != 0, year.cast("string")), F.lit("s.d."))
    name = squeezed(F.when(who.isNotNull(), surname(who)).otherwise(stem(F.coalesce(document, F.lit("documento")))))
    return F.concat(F.coalesce(F.when(name != "", name), F.lit("Documento")), F.lit(", "), y)


def citations_in(answer: Column) -> Column:
    """``author, year`` pairs cited in an answer."""
    found = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"(?i)\([^\(\),]{2,80},\s*(?:(?:19|20)[0-9]{2}|s\.d\.)\)"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda c: F.regexp_replace(F.substring(c, 2, 10_000_000), r"^\s*(.*?)\s*,\s*([^,]*?)\)$", "$1, $2")))


def table_markdown(rows: Column) -> Column:
    """An array of rows of cells as a Markdown table; empty rows dropped, short ones padded."""
    clean = F.filter(F.transform(rows, lambda r: F.transform(r, lambda c: F.replace(F.trim(F.coalesce(c, F.lit(""))), F.lit("\n"), F.lit(" ")))), lambda r: F.exists(r, lambda c: c != ""))
    width = F.array_max(F.transform(clean, lambda r: F.size(r)))
    padded = F.transform(clean, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = line(F.array_repeat(F.lit("---"), width))
    body = F.when(F.size(padded) > 1, F.transform(F.slice(padded, 2, F.size(padded)), line)).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(clean) > 0, F.array_join(F.concat(F.array(line(F.element_at(padded, 1)), rule), body), "\n")).otherwise("")


def json_object_in(answer: Column, schema: str) -> Column:
    """The object between the first and the last brace of a model's answer, parsed."""
    return F.from_json(F.nullif(F.regexp_extract(answer, r"(?s)(\{.*\})", 1), F.lit("")), schema)


def json_fenced_in(answer: Column, schema: str) -> Column:
    """The JSON of a model's answer, between code fences (marked ``json`` or not) or bare."""
    fenced = lambda mark: F.nullif(F.regexp_extract(answer, rf"(?s)```{mark}(.*?)(?:```|$)", 1), F.lit(""))
    return F.from_json(F.trim(F.coalesce(fenced("json"), fenced(""), answer)), schema)


def one_of(value: Column, allowed, default: Column | str) -> Column:
    v = F.lower(F.trim(value))
    return F.when(v.isin(*allowed), v).otherwise(default)


def argmax(scores: Column) -> Column:
    """Where the greatest of an array is, from 0; the first on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def sha256(content: Column) -> Column:
    """Lower-case hex digest of bytes, or of a string's UTF-8 bytes."""
    return F.sha2(content.cast("binary"), 256)


def clean_list(values: Column, most: int | None = None, default: str = "geral") -> Column:
    """Trimmed, blanks out; the default alone where nothing is left."""
    kept = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.trim(v)), lambda v: v != "")
    kept = F.slice(kept, 1, most) if most else kept
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit(default)))
