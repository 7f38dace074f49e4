"""Metadata from structured documents: elements first, lines where those say nothing, then the library."""

import pytest
from pyspark.sql import functions as F

from garimpo.operators import payload, structure
from garimpo.plans.versioned import VersionedTable

KIND = "documento string, paginas array<struct<pagina: int, texto: string, ocr_usado: boolean, elementos: array<struct<tipo: string, texto: string, secao: string>>>>"


def document(name, *pages):
    return (name, [(i + 1, text, False, None if elements is None else [(k, t, None) for k, t in elements]) for i, (text, elements) in enumerate(pages)])


DOCS = [
    document("uploads\\doc_teste.pdf", ("Framework de Etica em IA\nResumo\nEste documento descreve boas praticas em 2024.", [("section", "Framework de Etica em IA"), ("section", "Resumo"), ("text", "Este documento descreve boas praticas em IA no setor publico.")])),
    document("long", ("", [("text", "x")]), ("em 1980, 2031 e 2005", [("section", " SUMMARY: "), ("figure", "no"), ("text", "a" * 1500), ("table", "b" * 400), ("ocr_text", "c" * 300), ("text", "late"), ("section", "Fim"), ("text", "after")]), ("1999", None)),
    document("lines", ("Notas\nResumo\nlinha um\nlinha dois\n\n", []), ("1 Introdução\nCorpo de 2010", None)),
    document("again", ("", [("section", "Abstract"), ("section", "Outra"), ("text", "not it")]), ("", [("section", "outra"), ("section", "abstract"), ("text", "this"), ("section", "Resumo"), ("text", "and that")])),
    document("late", *[("", [("text", str(i))]) for i in range(5)], ("", [("section", "Resumo"), ("text", "sixth page")])),
]


@pytest.fixture(scope="module")
def pages(spark):
    return payload.pages_of(spark.createDataFrame(DOCS, KIND))


def test_abstracts_and_sections(pages):
    lines = payload.lines(pages)
    got = {r.documento: r.resumo for r in payload.abstracts(pages, lines).collect()}
    assert got == {"uploads/doc_teste.pdf": "Este documento descreve boas praticas em IA no setor publico.", "long": "a" * 1500 + " " + "b" * 400, "lines": "linha um linha dois", "again": "this and that"}
    got = {r.documento: r.secoes for r in payload.sections(pages, lines).collect()}
    assert got == {"uploads/doc_teste.pdf": ["Framework de Etica em IA", "Resumo"], "long": ["SUMMARY:", "Fim"], "lines": ["Resumo", "1 Introdução"], "again": ["Abstract", "Outra", "Resumo"], "late": ["Resumo"]}


def test_metadata_and_registering(spark, tmp_path):
    found = payload.metadata(spark.createDataFrame(DOCS, KIND))
    got = {r.documento_original: r for r in found.collect()}
    one = got["uploads/doc_teste.pdf"]
    assert one.paginas_total == 1 and "Framework de Etica em IA" in one.titulo and one.ano == 2024 and one.id == "2024_doc_teste" and one.resumo.startswith("Este documento descreve")
    assert {d: r.ano for d, r in got.items()} == {"uploads/doc_teste.pdf": 2024, "long": 2005, "lines": 2010, "again": None, "late": None}
    assert got["late"].resumo == "" and got["late"].paginas_total == 6 and len(got) == 5
    table = VersionedTable(spark, str(tmp_path / "library"), ["id", "documento_original"])
    table.replace(found.limit(0).withColumn("atualizado_em", F.lit("")))
    payload.register(table, found)
    payload.register(table, found.where("documento_original = 'long'").withColumn("titulo", F.lit("novo")), F.lit("2024-01-02 03:04:05").cast("timestamp"))
    rows = {r.documento_original: r for r in table.read().collect()}
    assert len(rows) == 5 and rows["long"].titulo == "novo" and rows["long"].atualizado_em == "2024-01-02T03:04:05Z"


def test_a_document_without_pages_fails(spark):
    with pytest.raises(Exception, match="no pages in empty"):
        payload.pages_of(spark.createDataFrame([("empty", [])], KIND)).collect()


def test_names_over_line_ends(spark):
    rows = [("a", 1, 0, "Ana de", 10.0, False), ("a", 1, 1, "Souza Lima¹ e Rui da Costa,", 10.0, False), ("a", 1, 2, "Rui da Costa,", 10.0, False), ("a", 1, 3, "Prof. titular", 10.0, False)]
    lines = spark.createDataFrame(rows, "documento string, page int, pos int, texto string, font_size double, is_bold boolean")
    assert structure.authors(lines).first().autores == ["Ana de\nSouza Lima", "Rui da Costa"]
