"""Jobs, requests and domains."""

import json

import pytest
from pyspark.sql import functions as F

from garimpo.operators import search, validation
from garimpo.options import Options
from garimpo.plans import jobs
from garimpo.plans.store import Store


def test_chunking_job(spark, tmp_path):
    empty = spark.createDataFrame([], "key string, area string, assuntos array<string>")
    library = spark.createDataFrame([("a.pdf", "ia", ["rag"], "Um livro", ["Ana"], 2001)], "key string, area string, assuntos array<string>, titulo string, autores array<string>, ano int")
    with pytest.raises(FileNotFoundError, match="extract documents first"):
        jobs.run_chunking(spark, str(tmp_path / "none.json"), str(tmp_path / "out"), empty, library, empty)
    source = tmp_path / "in" / "d.json"
    source.parent.mkdir()
    text = " ".join(f"palavra{i}" for i in range(30)) + "."
    page = lambda n, *e: {"pagina": n, "texto": "", "ocr_usado": False, "elementos": [{"tipo": t, "texto": x} for t, x in e]}
    documents = [{"documento": "b.pdf", "paginas": [page(1, ("section", "Um"), ("text", text), ("table", "a | b | c"))]}, {"documento": "a.pdf", "paginas": [page(1, ("text", text)), page(2, ("text", "curto"))]}]
    source.write_text(json.dumps({"versao": 2, "documentos": documents}))
    got = jobs.run_chunking(spark, str(source), str(tmp_path / "out"), empty, library, empty, Options(child_words=20, child_overlap=2))
    made = spark.read.parquet(got["output_file"]).orderBy("id").collect()
    assert [r.id for r in made] == list(range(len(made))) == list(range(got["total_chunks"])) and made[0].parent_id == "parent-0" and made[0].documento == "a.pdf"
    assert (got["documentos_processados"], got["parents_gerados"], got["areas"], got["tipos_conteudo"]) == (2, 3, ["geral", "ia"], ["table", "text"])
    assert got["total_palavras"] == sum(r.num_palavras for r in made) and spark.read.parquet(got["parents_file"]).count() == 3
    source.write_text(json.dumps({"versao": 2, "documentos": []}))
    with pytest.raises(FileNotFoundError):
        jobs.run_chunking(spark, str(source), str(tmp_path / "out2"), empty, library, empty)


def test_calibration_job(spark, tmp_path):
    cases = spark.createDataFrame([(True, 0.4), (True, 0.6), (True, None), (False, 0.1), (False, None)], "expected_hit boolean, dense double")
    path = f"{tmp_path}/latest.json"
    for _ in range(2):
        got = jobs.run_calibration(cases, path)
        assert json.loads(open(path).read()) == got and got["in_scope"] == 2 and got["actionable"]
    with pytest.raises(ValueError):
        jobs.run_calibration(cases.limit(0), path)


def test_responses_and_domains(spark):
    c = spark.createDataFrame([(i, f"text aa {'bb ' * i}", "x", ["s"], f"p{i}", f"d{i}") for i in range(4)], "id long, texto string, area string, assuntos array<string>, parent_id string, documento string")
    v = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(4)], "id long, vector array<double>")
    q = spark.createDataFrame([(1, "bb aa", [1.0, 0.0]), (2, "  ", None)], "query_id long, query string, vector array<double>")
    loaded = []
    store = Store(lambda name: loaded.append(name) or {"chunks": c, "vectors": v})
    found = search.search_domain(store, "solucoes", q, Options(top_k=2))
    search.search_domain(store, "solucoes", q, Options(top_k=2))
    assert loaded == ["solution_chunks"] and {r.retrieval_domain for r in found.collect()} == {"solucoes"}
    with pytest.raises(ValueError, match="unknown retrieval domain"):
        search.search_domain(store, "outro", q)
    got = {r.query_id: json.loads(r.response) for r in search.responses(q, search.api_hits(found)).collect()}
    assert got[2] == {"query": "  ", "total": 0, "resultados": []}
    assert got[1]["total"] == 2 and set(got[1]["resultados"][0]) == set(search.API_FIELDS) and got[1]["query"] == "bb aa"
    assert got[1]["resultados"][0]["score"] >= got[1]["resultados"][1]["score"]


def test_first_bad_file_ends_its_request(spark):
    rows = [(1, 0, "a.pdf", 10, "%PDF-"), (1, 1, "b.pdf", 99, "%PDF-"), (1, 2, "c.txt", 10, "%PDF-"), (2, 0, "a.pdf", 10, "%PDF-"), (3, 0, "x.exe", 99, "MZ"), (3, 1, "a.pdf", 10, "%PDF-")]
    files = spark.createDataFrame(rows, "request_id long, position int, name string, size_bytes long, magic string").withColumn("page_count", F.lit(1)).withColumn("text", F.lit("t"))
    each, responses = validation.upload_requests(validation.upload_status(files, most_bytes=50))
    assert {(r.request_id, r.position): r.status for r in each.collect()} == {(1, 0): "quarantined_pending_approval", (1, 1): "rejected_size", (1, 2): None, (2, 0): "quarantined_pending_approval", (3, 0): "rejected_extension", (3, 1): None}
    assert sorted(tuple(r) for r in responses.collect()) == [(1, 413, "rejected_size: b.pdf", 1), (2, 200, None, 1), (3, 422, "rejected_extension: x.exe", 0)]
