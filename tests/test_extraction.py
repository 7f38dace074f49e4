"""The seam to PDF readers, with readers that stand in for the libraries."""

import json

import pytest

from garimpo.operators import answer, library, structure
from garimpo.plans import store
from garimpo.sources import extraction, readers, writers


def _readers():
    """Readers made in a function, so that they travel to workers whole."""

    def paged(content):  # pages kept as JSON
        yield from json.loads(content)

    def nothing(content):
        return []

    def broken(content):
        raise ValueError("no library")

    return paged, nothing, broken


paged, nothing, broken = _readers()


def files(spark, **contents):
    return spark.createDataFrame([(k, bytearray(v if isinstance(v, bytes) else json.dumps(v).encode())) for k, v in contents.items()], "documento string, content binary")


def line(text, size=10.0, font="Serif"):
    return [{"text": text, "size": size, "font": font}]


PAGE = {"pagina": 1, "blocks": [[line("1 Introdução", 14.0, "Serif-Bold"), line("Uma frase."), line("Outra  frase.")], [line("MÉTODO"), line("Mais texto aqui, sem fim")]], "tables": [[["a", "b"], [None, ""], ["c\nd"]], [["", None]]]}


def test_first_reader_with_pages_wins_and_errors_stay_with_their_file(spark):
    f = files(spark, good=[PAGE, {"pagina": 2, "text": "só texto"}], empty=[], bad=b"%PDF-")
    rows = extraction.pages_of_pdf(f, broken, nothing, paged).collect()
    assert sorted((r.documento, r.pagina) for r in rows if r.error is None) == [("good", 1), ("good", 2)]
    assert [r.documento for r in rows if r.error is not None] == ["bad"]
    assert {r.documento: r.error for r in extraction.pages_of_pdf(f, paged, broken).collect() if r.error}["empty"] == "no library"


def test_elements_of_spans_tables_and_plain_pages(spark):
    f = files(spark, a=[PAGE, {"pagina": 2, "text": "linha \x00um\r\n\n\n\n\n\nlinha dois  "}, {"pagina": 3, "elements": [{"tipo": "section", "texto": "S"}, {"tipo": "text", "texto": " corpo "}]}, {"pagina": 4}])
    e = extraction.elements_of_pages(extraction.pages_of_pdf(f, paged))
    got = [(r.pagina, r.pos, r.tipo, r.texto, r.table_index) for r in e.orderBy("pagina", "pos").collect()]
    assert got == [
        (1, 0, "section", "1 Introdução", None), (1, 1, "text", "Uma frase.\nOutra frase.", None), (1, 2, "section", "MÉTODO", None), (1, 3, "text", "Mais texto aqui, sem fim", None), (1, 4, "table", "| a | b |\n| --- | --- |\n| c d |  |", 1),
        (2, 0, "text", "linha um\n\n\nlinha dois", None), (3, 0, "section", "S", None), (3, 1, "text", "corpo", None),
    ]
    texts = {r.pagina: r.texto for r in extraction.page_texts(e).collect()}
    assert texts[1].startswith("Uma frase.") and "MÉTODO" not in texts[1] and texts[3] == "corpo"
    doc = extraction.structured_documents(e).first()
    assert [p.pagina for p in doc.paginas] == [1, 2, 3] and [x.secao for x in doc.paginas[0].elementos] == ["1 Introdução", "1 Introdução", "MÉTODO", "MÉTODO", "MÉTODO"]


def test_ocr_only_where_a_page_has_no_text(spark):
    def ocr(content, page):
        if page == 4:
            raise RuntimeError("no engine")
        return "lido da imagem"

    f = files(spark, a=[{"pagina": 1, "text": "texto"}, {"pagina": 2}, {"pagina": 3, "elements": [{"tipo": "section", "texto": "Só título"}]}, {"pagina": 4}, {"pagina": 5, "blocks": [[line("  ")]]}])
    e = extraction.elements_of_pages(extraction.pages_of_pdf(f, paged, ocr=ocr))
    got = {(r.pagina, r.tipo): r.ocr_usado for r in e.collect()}
    assert got == {(1, "text"): False, (2, "ocr_text"): True, (3, "section"): True, (3, "ocr_text"): True, (5, "ocr_text"): True}


def test_summary_and_files(spark, tmp_path):
    for folder, name in (("docs", "b.pdf"), ("docs", "a.PDF"), ("docs", "note.txt"), ("uploads/approved", "c.pdf"), ("uploads/quarantine", "d.pdf")):
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / folder / name).write_bytes(json.dumps([PAGE]).encode() if name != "b.pdf" else b"%PDF-1.4")
    f = readers.pdf_files(spark, [str(tmp_path / "docs"), str(tmp_path / "uploads/approved")])
    assert sorted(r.documento for r in f.select("documento").collect()) == ["a.PDF", "b.pdf", "uploads/c.pdf"]
    pages = extraction.pages_of_pdf(f, paged)
    s = extraction.extraction_summary(f, pages, extraction.elements_of_pages(pages.where("error is null"))).first()
    assert (s.total_pdfs_encontrados, s.pdfs_processados, s.total_paginas) == (3, 2, 2) and [x.documento for x in s.documento_erros] == ["b.pdf"] and s.total_caracteres > 60
    writers.structured_documents(extraction.structured_documents(extraction.elements_of_pages(pages.where("error is null"))), str(tmp_path / "out"))
    back = readers.structured(spark, str(tmp_path / "out"))
    assert sorted(r.documento for r in back.collect()) == ["a.PDF", "uploads/c.pdf"]
    e = structure.elements_of(back)
    assert e.where("tipo = 'table'").count() == 2


def test_chunks_get_their_documents_metadata(spark):
    e = spark.createDataFrame([("x/a.pdf", 1, 0, "text", " ".join(f"w{i}" for i in range(400)), False)], "documento string, pagina int, pos int, tipo string, texto string, ocr_usado boolean")
    none = spark.createDataFrame([], "key string, area string, assuntos array<string>")
    lib = spark.createDataFrame([("a.pdf", "saude", ["sus"], "Livro", ["Ana"], 2001)], "key string, area string, assuntos array<string>, titulo string, autores array<string>, ano int")
    chunks, parents = structure.chunked(e, none, lib, none)
    got = chunks.orderBy("chunk_index").collect()
    assert len(got) == 2 and {(r.area, tuple(r.assuntos), r.doc_titulo, r.doc_ano) for r in got} == {("saude", ("sus",), "Livro", 2001)} and "parent_text" not in chunks.columns and parents.count() == 1


def test_approvals(spark):
    u = spark.createDataFrame([("uploads/quarantine/a.pdf", "s1.pdf", "quarantined_pending_approval", None, 1), ("uploads/quarantine/b.pdf", "s2.pdf", "approved_pending_index", None, 2), ("uploads/quarantine/c.pdf", "s3.pdf", "quarantined_suspicious", "/etc/c.pdf", 3)], "key string, stored_filename string, status string, quarantine_path string, ordinal int")
    there = spark.createDataFrame([("s1.pdf",), ("s3.pdf",)], "stored_filename string")
    asked = spark.createDataFrame([("s1.pdf",), ("s2.pdf",), ("s3.pdf",), ("a.pdf",), (" ",), (None,), ("z.pdf",)], "filename string")
    decided = library.approval(u, there, asked)
    assert {r.filename: r.code for r in decided.collect()} == {"s1.pdf": 200, "s2.pdf": 409, "s3.pdf": 400, "a.pdf": 404, " ": 422, None: 422, "z.pdf": 404}
    after = {r.ordinal: r for r in library.approved(u, decided).collect()}
    assert after[1].key == "uploads/approved/s1.pdf" and after[1].status == "approved_pending_index" and after[3].status == "quarantined_suspicious"
    assert library.stored_key(u, "b.pdf").first().key == "uploads/quarantine/b.pdf" and library.stored_key(u, "zz").first() is None


def test_status_paths_and_errors(spark):
    assert store.metadata_path("/r", "chunks", lambda p: p.endswith("index/metadata.json")) == "/r/index/metadata.json"
    assert store.metadata_path("/r", "solution_chunks", lambda p: "solution" in p) == "/r/solution_chunks/metadata.json"
    with pytest.raises(store.MissingIndex) as e:
        store.metadata_path("/r", "solution_chunks", lambda p: p.endswith("index/metadata.json"))
    assert store.error_of(e.value)[0] == 503 and store.error_of(ConnectionRefusedError("x"))[0] == 502 and store.error_of(ValueError("x")) == (500, "x")

    def offline():
        raise OSError("down")

    c = spark.createDataFrame([("ia", ["a", " b "]), ("outra", ["a"])], "area string, assuntos array<string>")
    s = store.service_status({"status": "ok", "loaded": True}, c, offline, store.Rebuilds([]).snapshot())
    assert (s["total_chunks"], s["areas_disponiveis"], s["assuntos_disponiveis"], s["llm_online"]) == (2, 6, 2, False) and s["reprocessamento"]["queued"] == 0
    s = store.service_status({"loaded": False}, None, lambda: ["m2", "m1"], {})
    assert s["status"] == "ok" and s["total_chunks"] == 0 and s["modelos_disponiveis"] == ["m1", "m2"]


def test_result_tables(spark, tmp_path):
    writers.result_table(spark.createDataFrame([(1, ["a"], "x,y")], "id int, terms array<string>, text string"), str(tmp_path / "csv"))
    assert [r.asDict() for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()] == [{"id": "1", "terms": '["a"]', "text": "x,y"}]


def test_entailment_by_argmax(spark):
    rows = spark.createDataFrame([([0.1, 2.0, 0.3],), ([3.0, 2.0, 0.3],), ([2.0, 2.0, 0.3],)], "l array<double>").select(answer.entailed(structure.F.col("l")).alias("e")).collect()
    assert [r.e for r in rows] == [True, False, False]
