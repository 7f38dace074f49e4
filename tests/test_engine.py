"""Operators on the fixtures of FIXTURES.md."""

import json
import math
import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from garimpo.functions import text as X
from garimpo.operators import answer, chunker, classify, dense, evaluation, library, merkle, search, sparse, structure, validation
from garimpo.options import Options
from garimpo.sources import readers, writers
from garimpo.streaming import conversations, limits

CHUNKS = "id long, area string, assuntos array<string>"


@pytest.fixture()
def three(spark):
    return spark.createDataFrame([(0, "infraestrutura", ["kubernetes", "seguranca"]), (1, "etica", ["LGPD ", "conformidade"]), (2, "arquitetura", ["rag", "chatbot"])], CHUNKS)


@pytest.mark.parametrize("areas,subjects,ids", [("infraestrutura", (), [0]), ((), "lgpd", [1]), (("arquitetura",), ["chatbot"], [2]), ("metodologia", (), []), (" ", [""], [0, 1, 2])])
def test_filters(three, areas, subjects, ids):
    assert [r.id for r in search.eligible(three, areas, subjects).orderBy("id").collect()] == ids


def test_filter_without_folding_compares_stored_values_as_they_are(three):
    assert search.eligible(three, subjects="lgpd", fold_column=False).count() == 0


def test_planner(spark):
    q = spark.createDataFrame([("Como fazer deploy no cluster Kubernetes?",), ("LGPD e dados pessoais",), ("nada",), (None,)], "q string")
    got = [r.p for r in q.select(classify.plan_query("q").alias("p")).collect()]
    assert got[0].filtro_area == "infraestrutura" and got[0].confidence > 0
    assert got[1].filtro_assunto == "lgpd" and got[2].confidence == 0 and got[3].query_text == ""


def bm25(docs, query, k1=1.5, b=0.75):
    tok = lambda t: __import__("re").findall(r"\b[\w\-]{2,}\b", (t or "").lower())
    tf = {i: Counter(tok(t)) for i, t in docs}
    dl = {i: sum(c.values()) for i, c in tf.items()}
    avg, n, df = sum(dl.values()) / len(docs), len(docs), Counter(t for c in tf.values() for t in c)
    score = lambda i: sum(math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * tf[i][t] * (k1 + 1) / (tf[i][t] + k1 * (1 - b + b * dl[i] / max(avg, 1e-6))) for t in tok(query) if t in tf[i])
    return {i: s for i in tf if (s := score(i)) > 0}


def test_bm25_equals_hand_computation_and_keeps_global_statistics(spark):
    rng = random.Random(0)
    docs = [(i, " ".join(rng.choice(["aa", "bb", "cc", "dd", "ee"]) for _ in range(rng.randrange(12)))) for i in range(40)]
    queries = [(0, "aa bb"), (1, "cc cc dd"), (2, ""), (3, None), (4, "zz")]
    d, q = spark.createDataFrame(docs, "id long, texto string"), spark.createDataFrame(queries, "query_id long, query string")
    got = {(r.query_id, r.id): r.sparse_score for r in sparse.scores(d, q).collect()}
    want = {(k, i): s for k, t in queries for i, s in bm25(docs, t).items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    some = sparse.scores(d, q, allowed=d.where("id < 5").select("id")).collect()
    assert {(r.query_id, r.id) for r in some} == {k for k in want if k[1] < 5} and all(abs(r.sparse_score - want[r.query_id, r.id]) < 1e-9 for r in some)


def test_dense_blocks_agree(spark):
    rng = random.Random(1)
    v = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(30)] + [(99, None), (98, [0.0] * 4)], "id long, vector array<double>")
    q = v.where("id < 7 or id = 99").withColumnRenamed("id", "query_id")
    pairs = lambda df: sorted((r.query_id, r.id, round(r.dense_score, 9)) for r in df.collect())
    assert pairs(dense.scores(v, q)) == pairs(dense.scores(v, q, block=3)) and dense.scores(v, q).count() == 7 * 30


def test_rrf_is_symmetric(spark):
    a = spark.createDataFrame([(0, 1, 1), (0, 2, 2)], "query_id long, id long, rank int")
    b = spark.createDataFrame([(0, 2, 1), (0, 3, 2)], "query_id long, id long, rank int")
    score = lambda x, y: {r.id: round(r.rrf_score, 12) for r in search.rrf([(x, "rank"), (y, "rank")]).collect()}
    assert score(a, b) == score(b, a) == {1: round(1 / 61, 12), 2: round(1 / 62 + 1 / 61, 12), 3: round(1 / 62, 12)}


def test_merge_of_collections(spark):
    rows = [(0, 1, 0.5, "documentos", 2), (0, 2, 0.9, "documentos", 1), (0, 3, 0.95, "solucoes", 1), (0, 4, 0.2, "solucoes", 2)]
    hits = spark.createDataFrame(rows, "query_id long, id long, score double, collection string, rank int")
    assert [r.id for r in search.merge_collections(hits, 3).orderBy("merged_rank").collect()] == [3, 2, 1]


def test_dedupe_by_parent(spark):
    r = spark.createDataFrame([(0, 0, "p1", 1), (0, 1, "p1", 2), (0, 2, "p2", 3), (0, 3, "p3", 4), (0, 4, None, 5), (0, 5, "", 6)], "query_id long, id long, parent_id string, rank int")
    best = lambda df, k: [x.id for x in search.dedupe_by_parent(df, k, "rank").orderBy("final_rank").collect()]
    assert best(r, 3) == [0, 2, 3] and best(r, 9) == [0, 2, 3, 4, 5]
    again = search.dedupe_by_parent(r, 9, "rank").drop("final_rank")
    assert best(again, 9) == [0, 2, 3, 4, 5]
    assert best(r, None) == [0, 2, 3, 4, 5]
    many = spark.range(900).selectExpr("id % 2 as query_id", "id", "concat('p', id div 4) as parent_id", "id as rank")
    whole = search.dedupe_by_parent(many, None, "rank")
    assert sorted(map(tuple, whole.select("query_id", "id", "final_rank").collect())) == sorted((i % 2, i, i // 4 + 1) for i in range(900) if i % 4 < 2)
    limited = search.dedupe_by_parent(many, 20, "rank")  # the most a request may ask for
    assert sorted((r.query_id, r.id, r.final_rank) for r in limited.collect()) == sorted((i % 2, i, i // 4 + 1) for i in range(80) if i % 4 < 2)


def test_search_with_reranker_and_hits(spark):
    c = spark.createDataFrame([(i, f"text aa {'bb ' * i}", "x", ["s"], f"p{i // 2}", f"d{i}") for i in range(8)], "id long, texto string, area string, assuntos array<string>, parent_id string, documento string")
    v = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(8)], "id long, vector array<double>")
    q = spark.createDataFrame([(0, "bb aa", [1.0, 0.0]), (1, "  ", [1.0, 0.0])], "query_id long, query string, vector array<double>")
    plain = search.search(c, v, q, Options(top_k=3))
    assert plain.count() == 3 and {r.query_id for r in plain.collect()} == {0}
    longest = search.search(c, v, q, Options(top_k=3), scorer=lambda query, text: F.length(text).cast("double"))
    assert [r.id for r in longest.orderBy("final_rank").collect()] == [7, 5, 3]
    api = search.api_hits(search.hits(longest, c)).collect()
    assert {r.documento for r in api} == {"d7", "d5", "d3"} and {r.content_type for r in api} == {"text"}


def test_metadata_priority(spark):
    kind = "key string, area string, assuntos array<string>"
    docs = spark.createDataFrame([("a.pdf",), ("b.pdf",), ("c.pdf",), ("d.pdf",), ("e.pdf",)], "documento string")
    up = spark.createDataFrame([("uploads/a.pdf", "juridico", ["x"])], kind)
    lib = spark.createDataFrame([("a.pdf", "ia", ["l"]), ("b.pdf", "ia", ["l"]), ("c.pdf", "geral", ["geral"]), ("d.pdf", "geral", [])], kind)
    man = spark.createDataFrame([("b.pdf", "m", ["m"]), ("c.pdf", "m", ["m"])], kind)
    got = {r.documento: (r.area, r.assuntos, r.metadata_source) for r in library.resolve_metadata(docs, up, lib, man).collect()}
    assert got == {"a.pdf": ("juridico", ["x"], "upload"), "b.pdf": ("ia", ["l"], "library"), "c.pdf": ("m", ["m"], "manual"), "d.pdf": ("geral", ["geral"], "library-generic"), "e.pdf": ("geral", ["geral"], "default")}


def test_upserts_and_transitions(spark):
    old = spark.createDataFrame([("uploads/a.pdf", "ia", ["x"], "quarantined_pending_approval"), ("uploads/b.pdf", "ia", ["x"], "approved")], "key string, area string, assuntos array<string>, status string")
    new = spark.createDataFrame([("a.pdf", "saude", [" ", "y "]), ("c.pdf", None, [])], "key string, area string, assuntos array<string>")
    got = {r.key: (r.area, r.assuntos, r.status) for r in library.upload_upsert(old, new).collect()}
    assert got == {"uploads/a.pdf": ("saude", ["y"], "quarantined_pending_approval"), "uploads/b.pdf": ("ia", ["x"], "approved"), "uploads/c.pdf": (None, ["geral"], None)}
    moved = {r.key: r.status for r in library.status_transition(old, "uploads/a.pdf").collect()}
    assert moved == {"uploads/a.pdf": "approved_pending_index", "uploads/b.pdf": "approved"}


def windows(spark, text, size, overlap):
    return spark.createDataFrame([(text,)], "t string").select(structure.period_chunks("t", size, overlap).alias("c")).first().c


def test_chunk_windows(spark):
    words = [f"w{i}" for i in range(30)]
    got = windows(spark, " ".join(words), 10, 2)
    assert len(got) >= 3 and got[0].split()[-2:] == got[1].split()[:2] and windows(spark, None, 5, 1) == [] and windows(spark, "  ", 5, 1) == []
    assert windows(spark, "aa bb cc dd. ee ff gg", 5, 1) == ["aa bb cc dd.", "dd. ee ff gg"]
    # A cut that keeps no more words than the overlap: the next window starts where it would have without.
    assert windows(spark, "loooooooong. b c d e f", 4, 3)[:2] == ["loooooooong.", "b c d e"]
    # The last window isn't cut; a period in the first half doesn't cut; the period may stand within a word.
    assert windows(spark, "a b c. d", 9, 1) == ["a b c. d"]
    assert windows(spark, "a. bbb ccc ddd eee fff", 4, 1) == ["a. bbb ccc ddd", "ddd eee fff"]
    assert windows(spark, "aaa bbb ccc.x ddd eee fff ggg", 4, 1) == ["aaa bbb ccc.", "ccc.x ddd eee fff", "fff ggg"]
    assert windows(spark, "a b c", 2, 5) == ["a b", "b c"]


def test_stride_equals_period_chunks_without_periods(spark):
    rows = [(" ".join(f"w{i}" for i in range(n)),) for n in (0, 1, 9, 10, 11, 18, 19, 50)]
    for r in spark.createDataFrame(rows, "t string").select(structure.stride_chunks("t", 10, 2).alias("a"), structure.period_chunks("t", 10, 2).alias("b")).collect():
        assert r.a == r.b


def test_parents_and_children(spark):
    items = [("section", "Intro"), ("text", "palavra " * 40), ("text", "outra " * 40), ("table", "| a | b | c |"), ("section", "Fim"), ("text", "curto")]
    page = {"pagina": 1, "texto": "", "ocr_usado": False, "elementos": [{"tipo": t, "texto": x, "secao": None, "table_index": None} for t, x in items]}
    s = spark.createDataFrame([("d", [page])], "documento string, paginas array<struct<pagina:int,texto:string,ocr_usado:boolean,elementos:array<struct<tipo:string,texto:string,secao:string,table_index:int>>>>")
    blocks = structure.parents(structure.elements_of(s))
    got = sorted((r.content_type, r.section_heading, len(r.texto.split())) for r in blocks.collect())
    assert got == [("table", "Intro", 7), ("text", "Intro", 80)]
    chunks, parents = structure.materialise(blocks, Options(child_words=50, child_overlap=5))
    assert parents.count() == 2 and "parent_text" not in chunks.columns
    assert sorted(r.num_palavras for r in chunks.where("content_type = 'text'").collect()) == [35, 50]


def test_parent_attach_and_lean_split(spark):
    c = spark.createDataFrame([(1, "p1", None), (2, "p2", "own"), (3, "p3", None)], "id long, parent_id string, parent_text string")
    p = spark.createDataFrame([("p1", "one"), ("p2", "two")], "parent_id string, parent_text string")
    assert {r.id: r.parent_text for r in search.attach_parents(c, p).collect()} == {1: "one", 2: "own", 3: None}
    lean, all_parents = search.lean_split(c, p.where("parent_id = 'p1'"))
    assert "parent_text" not in lean.columns and {r.parent_id: r.parent_text for r in all_parents.collect()} == {"p1": "one", "p2": "own"}


LINES = "documento string, page int, pos int, texto string, font_size double, is_bold boolean"


def test_titles_sections_authors(spark):
    rows = [
        ("a", 1, 0, "Universidade X", 20.0, True), ("a", 1, 1, "O grande título", 18.0, False), ("a", 1, 2, "Ana de Souza¹", 10.0, False), ("a", 1, 3, "1.2 Introdução", 10.0, False), ("a", 1, 4, "Metodologia:", 10.0, False), ("a", 2, 0, "1.2 introdução", 10.0, False), ("a", 2, 1, "2022", 30.0, True),
        ("b", 1, 0, "Carlos Lima", 10.0, False), ("b", 1, 1, "Parte um do título", 10.0, True), ("b", 1, 2, "e sua segunda linha", 10.0, True), ("b", 1, 3, "corpo", 10.0, False), ("b", 1, 4, "Depois disso", 10.0, True),
    ]
    lines = spark.createDataFrame(rows, LINES)
    assert {r.documento: r.titulo for r in structure.titles(lines).collect()} == {"a": "O grande título", "b": "Parte um do título e sua segunda linha"}
    assert {r.documento: r.secoes for r in structure.sections(lines).collect()} == {"a": ["Universidade X", "1.2 Introdução", "Metodologia:"]}
    assert {r.documento: r.autores for r in structure.authors(lines).collect()} == {"a": ["Ana de Souza"], "b": ["Carlos Lima"]}


def test_classification(spark):
    df = spark.createDataFrame([("Danos e responsabilidade civil", "geral", ["geral"]), ("suspensa", "geral", ["geral"]), ("gpu e nuvem", "ia", ["x"]), ("projeto de lei", None, None)], "t string, a string, s array<string>")
    none = F.lit(None).cast("string")
    got = [r.c for r in df.select(classify.classify_area(F.col("t"), none, F.lit(None).cast("array<string>"), F.col("a"), F.col("s")).alias("c")).collect()]
    assert [(c.area, c.assuntos) for c in got] == [("juridico", ["responsabilidade civil", "danos", "regulacao", "ia"]), ("geral", ["geral"]), ("ia", ["x"]), ("juridico", ["responsabilidade civil", "danos", "regulacao", "ia"])]


def test_intents_and_scans(spark):
    df = spark.createDataFrame([("Há um PROBLEMA  na API",), ("texto",)], "t string")
    assert [r.v for r in df.select(classify.is_diagnostic("t").alias("v")).collect()] == [True, False]
    df = spark.createDataFrame([("Não encontrei nada",), (None,)], "t string")
    assert [r.v for r in df.select(classify.declares_not_found("t").alias("v")).collect()] == [True, False]


SOLUTION = {
    "id": "sol-1", "nome": "Nome", "descricao": "descricao longa", "orgao": "Orgao", "problema": "problema longo", "solucao": "solucao longa", "causa_raiz": "causa", "area": "ia", "status": "piloto", "tecnologias": ["sql"], "sintomas": ["s"], "pre_condicoes": [], "passos_implantacao": ["p"], "riscos": [],
    "conformidade": {"base_legal_lgpd": "base", "modelo": "mm", "licenca_modelo": "mit", "dados_pessoais": "nao", "hospedagem": "local", "dependencias_open_source": []},
}


def test_catalog(spark, tmp_path):
    rows = [SOLUTION, SOLUTION | {"id": "sol-2", "problema": None}, SOLUTION | {"id": "sol-3", "status": "x"}, SOLUTION | {"id": "sol-1"}]
    (tmp_path / "c.json").write_text(json.dumps(rows))
    cat = readers.catalog(spark, str(tmp_path / "c.json"))
    got = sorted((r.id, tuple(r.violations)) for r in validation.catalog_violations(cat).collect())
    assert got == [("sol-1", ("id: repeated",))] * 2 + [("sol-2", ("problema: required",)), ("sol-3", ("status: not allowed",))]
    with pytest.raises(Exception, match="catalog: sol-1 id: repeated"):
        validation.checked_catalog(cat).collect()
    good = validation.checked_catalog(cat.limit(1))
    text = validation.catalog_chunks(good).first().texto.split("\n")
    assert len(text) == 19 and text[0] == "Nome: Nome"


def test_sources(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"p1": "one"}')
    assert [tuple(r) for r in readers.parents(spark, str(tmp_path / "p.json")).collect()] == [("p1", "one")]
    assert readers.parents(spark, str(tmp_path / "none.json")).collect() == []
    (tmp_path / "lib.json").write_text(json.dumps({"versao": 1, "documentos": [{"id": "a", "ano": 2020, "assuntos": ["x"]}]}))
    assert [(r.id, r.ano, r.assuntos) for r in readers.library(spark, str(tmp_path / "lib.json")).collect()] == [("a", 2020, ["x"])]
    assert readers.library(spark, str(tmp_path / "nolib.json")).count() == 0
    (tmp_path / "chunks.json").write_text(json.dumps([{"id": 1, "texto": "a"}, {"id": 2}]))
    with pytest.raises(Exception, match="chunk without texto"):
        readers.chunks(spark, str(tmp_path / "chunks.json")).collect()
    (tmp_path / "empty.json").write_text("[]")
    with pytest.raises(ValueError):
        readers.chunks(spark, str(tmp_path / "empty.json"))
    (tmp_path / "e.jsonl").write_text('{"question": "q", "expected_solution_id": "s"}\n\n{"id": "b", "question": "r", "expected_solution_ids": ["t"]}\n')
    got = {r.question: (r.id[:4], r.expected_solution_ids) for r in readers.evaluation_set(spark, str(tmp_path / "e.jsonl")).collect()}
    assert got == {"q": ("row-", ["s"]), "r": ("b", ["t"])}
    assert [tuple(r) for r in readers.categories(spark, '"a.pdf":\n  area: ia\n  assuntos: ["x"]\n').collect()] == [("a.pdf", "ia", ["x"])]
    (tmp_path / "docs").mkdir()
    for n in ("b.pdf", "A.PDF", "c.txt"):
        (tmp_path / "docs" / n).write_bytes(b"%PDF-")
    assert sorted(r.documento for r in readers.pdf_files(spark, [str(tmp_path / "docs")], ["b.pdf"]).collect()) == ["A.PDF"]


def test_writers(spark, tmp_path):
    c = spark.createDataFrame([(1, "a"), (2, "b")], "id long, texto string")
    v = spark.createDataFrame([(1, [1.0])], "id long, vector array<double>")
    m = writers.index_tables(c, v, c.select(F.lit("p").alias("parent_id"), F.lit("t").alias("parent_text")), str(tmp_path / "i"), "m", 1).first()
    assert m.total_chunks == 2 and len(m.checksum) == 64
    assert json.loads(writers.json_lines(c.where("id = 1").withColumn("n", F.lit(None).cast("string"))).first().line) == {"id": 1, "texto": "a", "n": None}


def test_html_elements(spark):
    df = spark.createDataFrame([(1, "<html><script>x<p></script><h1>T&amp;<b>i</b></h1><p>um</p>dois<!-- no --></html>")], "page_id long, html string")
    assert [(r.tipo, r.texto) for r in readers.pages_of_html(df).orderBy("pos").collect()] == [("section", "T&i"), ("text", "um"), ("text", "dois")]


HIT = "query_id long, final_rank int, documento string, pagina int, area string, assuntos array<string>, doc_titulo string, doc_autores array<string>, doc_ano int, section_heading string, content_type string, texto string, parent_text string, score double, score_dense double, score_sparse double"


@pytest.fixture()
def hits(spark):
    one = ("d.pdf", 3, "ia", ["rag", "x"], "T", ["Ana Lima"], 2020, None, "text", "texto um", None, 0.9, 0.7, 0.0)
    return spark.createDataFrame([(0, 1, *one), (0, 2, *one), (0, 3, "e.pdf", None, "ia", [], "", [], None, "S", None, "t", "parent", 0.1, 0.1, 0.0), (1, 1, "e.pdf", None, "ia", [], "", [], None, "S", None, "t", "", 0.1, 0.1, 0.0)], HIT)


def test_contexts_and_answers(spark, hits):
    c = {r.query_id: r.context for r in answer.build_context(hits).collect()}[0]
    assert c.split("\n\n")[0] == 'Fonte 1: Lima, 2020 — "T" (p. 3)\nCitacao obrigatoria: (Lima, 2020)\nDocumento: d.pdf\nPagina: 3\nSecao: nao informado\nTipo: text\nArea: ia\nAssuntos: rag, x\nTrecho: texto um'
    assert c.split("\n\n")[2].startswith("Fonte 3: e (p. ?)") and c.endswith("Trecho: parent")
    assert {r.query_id: r.sources for r in answer.unique_sources(hits).collect()}[0] == ['Lima, 2020 — "T" (p. 3)', "e (p. ?)"]
    q = spark.createDataFrame([(0, "por quê"), (1, "x"), (2, "y")], "query_id long, query string")
    grounded = {r.query_id: r.answer for r in answer.grounded_answer(hits, q, reason="motivo").collect()}
    assert grounded[2] == answer.NO_EVIDENCE and "Observacao de fidelidade: motivo." in grounded[0] and grounded[0].endswith("- parent (e, s.d.)\n\nPergunta original: por quê")
    failed = {r.query_id: r.answer for r in answer.failure_answer(hits, q, "tempo").collect()}
    assert "(Lima, 2020) - d.pdf (p. 3)" in failed[0] and "falhou (tempo)" in failed[0] and failed[2].startswith("Nao foi possivel")
    assert {r.query_id: r.signal for r in answer.answer_signal(hits).collect()} == {0: True, 1: False}


def test_prompt_and_history(spark):
    turns = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(9)], "conv_id long, turn long, role string, text string")
    h = answer.history(turns).first()
    assert h.n_turns == 6 and h.history.split("\n")[0] == "Assistente: t3" and h.history.endswith("Usuário: t8")
    p = turns.limit(1).select(answer.build_prompt("SYS", "REGRAS", F.lit("q"), answer.diagnostic_context(F.lit(""), F.lit("ev")), F.lit(h.history)).alias("p")).first().p
    assert p.startswith("SYS\n\nREGRAS\nMensagem conservadora: ") and "--- HISTORICO DE CONVERSA ---\nAssistente: t3" in p and p.endswith("--- PERGUNTA ---\nq\n\n--- RESPOSTA ---\n")


def test_faithfulness_with_scorer(spark):
    a = spark.createDataFrame([(0, "a b c d e f", "a b c d e. x y z w v."), (1, "q", "curto."), (2, "x y z w v u", "x y z w v.")], "query_id long, context string, answer string")
    got = {r.query_id: r.faithful for r in answer.faithful(a, lambda c, s: F.contains(c, F.substring(s, 1, 9))).collect()}
    assert got == {0: False, 1: True, 2: True}


def test_events(spark):
    rows = [
        (1, "generated", "P", "uma resposta", None, True, ["a (p. 1)"]), (2, "no_solution", "P", None, None, None, []), (3, "no_evidence_with_sources", "P", None, None, None, ["b (p. 2)"]),
        (4, "generated", "P", "inicio", "caiu", None, []), (5, "generated", "P", "outra", None, False, []),
    ]
    a = spark.createDataFrame(rows, "query_id long, outcome string, prompt string, answer string, error string, faithful boolean, sources array<string>")
    a = a.selectExpr("*", "'melhor assim' as fallback", "'nao confere' as reason", "false as diagnostic", "array(named_struct('id', query_id, 'documento', cast(null as string))) as results")
    for check in (False, True):
        got = {}
        for r in answer.events(a, check).orderBy("query_id", "seq").collect():
            got.setdefault(r.query_id, []).append(json.loads(r.event))
        assert all(e[0]["type"] == "metadata" and [x["type"] for x in e].count("metadata") == 1 for e in got.values())
        text = {q: "".join(x["token"] for x in e if x["type"] == "token") for q, e in got.items()}
        assert text == {1: "uma resposta", 2: answer.NO_SOLUTION, 3: answer.NO_EVIDENCE, 4: "inicio", 5: "outra"}
        assert got[1][0] == {"type": "metadata", "fontes": ["a (p. 1)"], "resultados": [{"id": 1, "documento": None}], "prompt": "P", "diagnostic_mode": False} and got[2][0]["prompt"] is None and got[2][0]["diagnostic_mode"] and got[3][0]["fontes"] == ["b (p. 2)"]
        assert got[4][-1] == {"type": "error", "message": "caiu"}
        assert [len(got[q]) for q in (2, 3)] == [2, 2]  # a canned answer is one token
        last = got[1][-1], got[5][-1]
        assert (last[0]["type"] == "faithfulness") == check
        if check:
            assert last[0] == {"type": "faithfulness", "faithfulness_checked": True, "faithful": True, "reason": "nao confere"} and last[1] == {"type": "faithfulness", "faithfulness_checked": True, "faithful": False, "reason": "nao confere", "fallback_response": "melhor assim"}
            assert [x["type"] for x in got[2]].count("faithfulness") == 0


@pytest.mark.parametrize("bins,most", [(1024, 100_000), (4, 2)])
def test_percentiles_of_infinite_values_and_wide_ranges(spark, bins, most):
    inf, nan = float("inf"), float("nan")
    groups = {"up": [1, 2, 3, 4, 5, inf], "down": [-inf, -inf, 1, 2, 9, 10], "both": [-inf, 0, 0.5, 1, inf, inf], "nan": [1, 2, nan, nan, 3], "none": [inf, -inf, nan], "wide": [-1.7e308, -1e308, 0, 1, 1e308, 1.7e308, 5e-324], "tiny": [0, 5e-324, 5e-324, 1e-323, 0, 0], "one": [inf]}
    df = spark.createDataFrame([(g, float(x)) for g, vs in groups.items() for x in vs] + [("up", None)], "g string, v double").repartition(3)
    got = {r.g: r for r in evaluation.percentiles(df, ["g"], "v", (0, 0.4, 0.5, 1), bins, most).collect()}
    order = lambda x: (x != x, x)
    for g, vs in groups.items():
        vs = sorted(map(float, vs), key=order)
        assert got[g].n == len(vs)
        for name, p in (("p0", 0), ("p1", 0.4), ("p2", 0.5), ("p3", 1)):
            at = (len(vs) - 1) * p
            low, high, part = vs[int(at)], vs[-(-int(at * 1000) // 1000) if at % 1 == 0 else int(at) + 1], at - int(at)
            want = low if part == 0 or low == high else low * (1 - part) + high * part
            found = got[g][name]
            assert (found != found and want != want) or found == want or abs(found - want) <= 1e-12 * abs(want), (g, name, found, want)


def test_percentiles_equal_numpy(spark):
    rng = np.random.default_rng(0)
    rows = [("a", float(x)) for x in rng.normal(size=500)] + [("b", 7.0)] * 300 + [("c", 1.0), ("c", 2.0), ("d", 5.0), ("e", None)] + [("f", 1e9)] + [("f", float(x)) for x in rng.integers(0, 5, 400)]
    df = spark.createDataFrame(rows, "g string, v double")
    for most, bins in ((100_000, 1024), (3, 4)):
        got = {r.g: (r.p0, r.p1, r.p2, r.p3, r.n) for r in evaluation.percentiles(df, ["g"], "v", (0, 0.1, 0.5, 1), bins, most).collect()}
        assert got.keys() == set("abcdf")
        for g, found in got.items():
            v = [x for k, x in rows if k == g]
            assert np.allclose(found[:4], [np.quantile(v, p) for p in (0, 0.1, 0.5, 1)]) and found[4] == len(v)
    whole = evaluation.percentiles(df, [], "v", (0.25,)).first()
    assert abs(whole.p0 - np.quantile([x for _, x in rows if x is not None], 0.25)) < 1e-9
    assert evaluation.percentiles(df.limit(0), ["g"], "v", (0.5,)).collect() == []


def test_enrichment_keeps_specific_areas(spark):
    meta = spark.createDataFrame([(i, a, "outro", "outro", ["x"], ["y"]) for i, a in enumerate(("geral", "juridico", "juridico", "ia"))], "id int, area_tematica string, tipo_documento string, metodologia string, assuntos array<string>, palavras_chave array<string>")
    said = [(0, 'ok {"area_tematica": "Saude", "assuntos": ["A", " "]}'), (1, '{"area_tematica": "geral", "assuntos": ["geral"]}'), (2, '{"area_tematica": "nada", "tipo_documento": "MANUAL"}'), (3, "sem json")]
    got = {r.id: r for r in classify.enriched(meta, spark.createDataFrame(said, "id int, answer string")).collect()}
    assert (got[0].area_tematica, got[0].assuntos, got[0].qualidade_extracao) == ("saude", ["a"], "alta")
    assert (got[1].area_tematica, got[1].assuntos) == ("juridico", ["x"]) and (got[2].area_tematica, got[2].tipo_documento) == ("juridico", "manual")
    assert (got[3].area_tematica, got[3].qualidade_extracao) == ("ia", "baixa")


def test_abstract_is_of_one_page(spark):
    rows = [("a", 1, 0, "Título", True), ("a", 1, 1, "texto", False), ("a", 2, 0, "RESUMO:", True), ("a", 2, 1, "Uma linha.", False), ("a", 2, 2, "Duas.", True), ("a", 2, 3, "fora", False), ("a", 3, 0, "mais", False)]
    rows += [("b", 1, 0, "abstract", False), ("b", 2, 0, "não é dela", False), ("c", 6, 0, "resumo", False), ("c", 6, 1, "tarde demais", False)]
    rows += [("d", 1, 0, "summary", False)] + [("d", 1, 1 + i, "x" * 600, False) for i in range(6)]
    rows += [("e", 1, 0, "abstract", False), ("e", 1, 1, "uma linha em negrito com seis", True), ("e", 1, 2, "fim.", False), ("e", 1, 3, "Introdução", True)]
    got = {r.documento: r.resumo for r in structure.abstracts(spark.createDataFrame(rows, "documento string, page int, pos int, texto string, is_bold boolean")).collect()}
    assert got == {"a": "Uma linha.", "d": " ".join(["x" * 600] * 3)[:2000], "e": "uma linha em negrito com seis fim."}


def test_calibration_fixture(spark):
    c = spark.createDataFrame([(True, 0.71), (True, 0.64), (False, 0.05)], "expected_hit boolean, dense double")
    r = evaluation.calibration(c).first()
    assert (r.in_scope, r.out_of_scope, r.actionable) == (2, 1, True) and r.suggested_percent >= 1 and abs(r.p25 - 0.6575) < 1e-9
    empty = evaluation.calibration(c.limit(0)).first()
    assert (empty.in_scope, empty.p25, empty.suggested_percent, empty.actionable) == (0, 0.0, 1, False)


def test_quality_cases(spark):
    specs = spark.createDataFrame([(0, "juridico", None), (1, "ia", ["Doc"]), (2, "nenhuma", None)], "query_id long, expected_area string, expected_documents array<string>")
    hits = spark.createDataFrame([(0, "infraestrutura", ["a"], 0.7), (1, "IA", [""], 0.7)], "query_id long, area string, documents array<string>, dense double")
    got = {r.query_id: (r.area_ok, r.passed) for r in evaluation.quality_cases(specs, hits).collect()}
    assert got == {0: (False, False), 1: (True, True), 2: (False, True)}  # an empty document name is in every other
    assert tuple(evaluation.quality_summary(evaluation.quality_cases(specs, hits)).first()) == (3, 2, 1, 0.6667)


def test_solution_match(spark):
    df = spark.createDataFrame([(["s"], ["s"], None), (["s"], None, ["x#s"]), (["s"], ["t"], ["y"]), ([], None, None), (None, None, None)], "e array<string>, i array<string>, d array<string>")
    assert [r.m for r in df.select(evaluation.solution_match(F.col("e"), F.col("i"), F.col("d")).alias("m")).collect()] == [1.0, 1.0, 0.0, 1.0, 1.0]


def test_rate_limit(spark):
    times = [0, 1, 2, 3, 61, 61.5, 62.5, 63]
    accepted, _ = limits.decide(times, 60, 3)
    # At 61 s the request at 0 has left, at 61.5 s the one at 1; rejected ones never counted.
    assert accepted == [True, True, True, False, True, True, True, False]
    rows = [("a", datetime(2024, 1, 1) + timedelta(seconds=t), i) for i, t in enumerate(times)] + [("b", datetime(2024, 1, 1), 99)]
    df = spark.createDataFrame(rows, "client string, ts timestamp, request_id long")
    got = {r.request_id: r.accepted for r in limits.rate_limit(df.repartition(3), 60, 3).collect()}
    assert [got[i] for i in range(8)] == accepted and got[99]


def test_chunk_rows_equal_the_chunk_column(spark):
    """The table function and the column give the same windows; other columns come along, long texts are whole."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randrange(1, 7))) + rng.choice(("", "", "", ".", ".x"))
    rows = [(i, rng.choice((" ", "\n ", "\t")).join(word() for _ in range(rng.choice((0, 1, 9, 10, 11, 60))))) for i in range(80)] + [(90, None), (91, "  "), (92, " ".join(word() for _ in range(50_000))), (92, "again.")]
    df = spark.createDataFrame([(k, t, f"c{k}") for k, t in rows], "k long, t string, chunk string")
    for size, overlap in ((10, 3), (5, 9), (1, 0)):
        some = df if size > 1 else df.where("k < 90")
        got = chunker.period_chunk_rows(some, "t", size, overlap)
        assert got.columns == ["k", "chunk", "chunk_index", "texto"]
        plain = some.where("length(t) < 5000 or t is null")
        want = plain.select("k", "chunk", F.posexplode(structure.period_chunks("t", size, overlap)).alias("chunk_index", "texto"))
        assert sorted(map(tuple, got.where("k <> 92 or length(texto) < 8 and texto = 'again.'").collect())) == sorted(map(tuple, want.collect()))
    whole = [r.texto for r in chunker.period_chunk_rows(df.where("k = 92 and length(t) > 99"), "t", 10, 0).orderBy("chunk_index").collect()]
    assert whole[0].split()[0] == rows[-2][1].split()[0] and whole[-1].split()[-1] == rows[-2][1].split()[-1] and len(whole) > 5000
    assert "Exchange" not in chunker.period_chunk_rows(df, "t", 10, 3)._jdf.queryExecution().executedPlan().toString()


def test_counted_ids(spark):
    """Ids as one pass over all documents would count them."""
    blocks = spark.createDataFrame([(f"d{i % 7}", i % 3, i, None, "text", " ".join(f"w{j}" for j in range(i % 5 * 6 + 1))) for i in range(60)], "documento string, pagina int, run long, section_heading string, content_type string, texto string").repartition(5)
    chunks, parents = structure.materialise(blocks, Options(child_words=10, child_overlap=2), counters=True)
    want, ids, n = [], {}, 0
    for number, b in enumerate(sorted(blocks.collect(), key=lambda r: (r.documento, r.pagina, r.run))):
        ids[f"parent-{number}"] = b.texto
        for i, c in enumerate(chunker.windows(b.texto.split(), 10, 2)):
            if len(c.split()) >= 3:
                want.append((n, f"parent-{number}", i, c))
                n += 1
    assert sorted((r.id, r.parent_id, r.chunk_index, r.texto) for r in chunks.collect()) == want
    assert {r.parent_id: r.parent_text for r in parents.collect()} == ids


def test_events_are_delivered_in_order_before_all_are_made(spark, tmp_path):
    """The first line leaves while later partitions aren't computed; all lines come by query and sequence."""
    seen = tmp_path / "made"
    seen.mkdir()

    def generate(batches):  # a model that leaves a mark for each answer
        for b in batches:
            for q in b["query_id"]:
                (seen / str(q)).touch()
            yield b.assign(answer=["uma resposta longa"] * len(b))

    questions = writers.ordered(spark.range(40).select(F.pmod(F.col("id") * 7, F.lit(40)).alias("query_id"), F.lit("P").alias("prompt")).repartition(3))
    questions = spark.createDataFrame(questions.collect(), questions.schema).repartitionByRange(8, "query_id").sortWithinPartitions("query_id")
    answered = questions.mapInPandas(generate, "query_id long, prompt string, answer string").withColumn("outcome", F.lit("generated"))
    events = answer.events(answered)
    lines = writers.deliver(events.withColumn("event", F.concat_ws(" ", "query_id", "seq", "event")))
    first = next(lines)
    assert first.startswith("0 0 ") and len(list(seen.iterdir())) < 40
    rest = [tuple(map(int, x.split(" ")[:2])) for x in (first, *lines)]
    assert rest == [(q, i) for q in range(40) for i in range(4)] and len(list(seen.iterdir())) == 40
    assert "Exchange" not in events._jdf.queryExecution().executedPlan().toString().split("mapInPandas")[0].split("MapInPandas")[0]


def test_digest_trees_name_what_differs(spark):
    rows = spark.range(6000).select("id", F.concat(F.lit("t"), "id").alias("texto"), F.when(F.col("id") % 2 == 0, 1.5).alias("x")).repartition(5)
    whole = merkle.tree(rows, depth=4)
    same = merkle.tree(rows.repartition(2).select("x", "texto", "id"), depth=4)
    assert merkle.root(whole) == merkle.root(same) and merkle.differing(whole, same).isEmpty()
    assert whole.where("level = 0").first().rows == 6000 and whole.where("level = 4").count() == 16
    for name, other in {
        "changed": rows.withColumn("x", F.when(F.col("id") == 77, 9.0).otherwise(F.col("x"))), "lost": rows.where("id <> 77"), "moved": rows.withColumn("id", F.when(F.col("id") == 77, 7777).otherwise(F.col("id"))),
        "null": rows.withColumn("texto", F.when(F.col("id") != 77, F.col("texto"))), "twice": rows.unionByName(rows.where("id = 77")),
    }.items():
        changed = merkle.tree(other, depth=4)
        leaves = merkle.differing(whole, changed)
        assert merkle.root(changed) != merkle.root(whole), name
        assert leaves.count() == (2 if name == "moved" else 1), name
        assert 77 in {r.id for r in merkle.rows_of(rows, leaves).collect()} and merkle.rows_of(rows, leaves).count() < 1200, name
    import hashlib

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    few = spark.createDataFrame([(2, "b"), (1, "a")], "id long, t string")
    assert merkle.root(merkle.tree(few)) == sha(sha('{"id":1,"t":"a"}') + sha('{"id":2,"t":"b"}'))
    assert merkle.root(merkle.tree(few.limit(0))) == hashlib.sha256(b"").hexdigest()


def test_planned_neighbours_equal_filtered_pairs(spark):
    """Each query's plan restricts what it is compared with; the same rows as all pairs, filtered."""
    rng = random.Random(6)
    areas, subjects = ["ia", " IA", "saude", None], ["rag", " Rag ", "sql"]
    c = spark.createDataFrame([(i, rng.choice(areas), rng.sample(subjects, rng.randrange(3)) if i % 9 else None) for i in range(200)], "id long, area string, assuntos array<string>")
    v = spark.createDataFrame([(i, [rng.choice((-1.0, 1.0)) for _ in range(4)] if i % 17 else None) for i in range(220)], "id long, vector array<double>").repartition(3)
    plans = spark.createDataFrame([(i, rng.choice(("ia", "saude", None)), rng.choice(("rag", "nada", None))) for i in range(12)], "query_id long, filtro_area string, filtro_assunto string")
    q = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(12)], "query_id long, vector array<double>")
    got = dense.planned_top(v, c, q.join(plans, "query_id"), 7, block=5)
    want = sparse.top(search.restricted(dense.scores(v, q), c, plans), "dense_score", 7, "dense_rank")
    rows = lambda df: sorted((r.query_id, r.dense_rank, r.id, round(r.dense_score, 8)) for r in df.collect())
    assert rows(got) == rows(want) and len(rows(got)) > 20


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    """Requests in and out of order, over several runs of the stream; the state of a client that stays away goes."""
    rng = random.Random(4)
    schema = "client string, ts timestamp, request_id long"
    start = datetime(2024, 1, 1)
    rows = sorted(((f"c{rng.randrange(3)}", start + timedelta(milliseconds=rng.randrange(200_000)), i) for i in range(200)), key=lambda r: r[1])
    rows += [("idle", start + timedelta(seconds=1), 500), (None, start + timedelta(seconds=2), 501)]
    batches = [rows[:50] + rows[200:], rows[50:100], rows[100:150], rows[150:200], [("c0", start + timedelta(hours=1), 900)], [("c0", start + timedelta(hours=1, seconds=1), 901)], [("c0", start + timedelta(hours=1, seconds=2), 902)]]
    held = lambda: {r.key["client"] for r in spark.read.format("statestore").option("stateVarName", "held").load(str(tmp_path / "ck")).select("key").distinct().collect()}
    for k, some in enumerate(batches):
        rng.shuffle(some)
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        s = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        limits.rate_limit_stream(s, 60.0, 5).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
        if k == 3:
            assert {"c0", "c1", "c2"} <= held()
    assert held() == {"c0"}
    every = [r for some in batches for r in some]
    got = {r.request_id: r.accepted for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.request_id: r.accepted for r in limits.rate_limit(spark.createDataFrame(every, schema), 60.0, 5).collect()}
    assert got == want and len(got) == 205 and False in got.values()


def test_audit_stream_and_memory(spark, tmp_path):
    e = spark.sql("select timestamp'2024-01-01 00:00:30' ts, 'search' event, '1' client_ip, 'GET' method, '/x' path, map('k', 'v') details")
    writers.audit_append(e, str(tmp_path / "audit"))
    writers.audit_append(e, str(tmp_path / "audit"))
    q = conversations.events_by_window(conversations.audit_stream(spark, str(tmp_path / "audit"))).writeStream.format("memory").queryName("audit_counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r.n for r in spark.table("audit_counts").collect()] == [2]
    turns = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    new = spark.createDataFrame([(1, "q", "r"), (2, "q", ""), (3, "q", "s")], "conv_id long, question string, answer string")
    got = sorted(tuple(r) for r in conversations.remembered(turns, new).collect())
    assert got == [(1, 0, "user", "a"), (1, 1, "user", "q"), (1, 2, "assistant", "r"), (3, 0, "user", "q"), (3, 1, "assistant", "s")]


def test_inventory_facets_and_sample(spark):
    c = spark.createDataFrame([(i, "d", i % 3, "ia" if i else "saude", ["b", "a"], "" if i == 0 else f"T{i}", None if i < 2 else 2000 + i, "p", "text", "x" * (i * 100)) for i in range(5)], "id long, documento string, pagina int, area string, assuntos array<string>, doc_titulo string, doc_ano int, parent_id string, content_type string, texto string")
    r = library.document_inventory(c).first()
    assert (r.chunks, r.pages, r.first_page, r.last_page, r.title, r.year, r.areas, r.subjects) == (5, 3, 0, 2, "T1", 2002, ["ia", "saude"], ["a", "b"])
    assert {x.id for x in library.useful_chunks(c, 10).collect()} == {3, 4} and library.useful_chunks(c, 1).count() == 1
    assert X.TOKEN


def test_planned_search_never_overrides_given_filters(spark):
    c = spark.createDataFrame([(0, "kubernetes aa", "infraestrutura", ["kubernetes"], "p0"), (1, "kubernetes bb", "juridico", ["kubernetes"], "p1")], "id long, texto string, area string, assuntos array<string>, parent_id string")
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1])], "id long, vector array<double>")
    q = spark.createDataFrame([(0, "deploy kubernetes cluster", [1.0, 0.0])], "query_id long, query string, vector array<double>")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(search.search(c, v, q)) == [0, 1]
    assert ids(search.search(c, v, q, Options(query_planning=True))) == [0]
    assert ids(search.search(c, v, q, Options(query_planning=True), areas="juridico")) == [1]


def test_metadata_of_documents(spark):
    rows = [
        ("2021-x.pdf", 1, 0, "Chatbot e RAG no governo", 18.0, True), ("2021-x.pdf", 1, 1, "Brasília, 2021", 10.0, False), ("2021-x.pdf", 1, 2, "Resumo", 12.0, True), ("2021-x.pdf", 1, 3, "Texto do resumo", 10.0, False), ("2021-x.pdf", 1, 4, "em duas linhas", 10.0, False), ("2021-x.pdf", 1, 5, "Metodologia", 12.0, True), ("2021-x.pdf", 2, 0, "Resultados", 12.0, True), ("2021-x.pdf", 2, 1, "corpo", 10.0, False),
    ]
    m = structure.document_metadata(spark.createDataFrame(rows, LINES)).first()
    assert (m.titulo, m.ano, m.resumo, m.tipo, m.area) == ("Chatbot e RAG no governo", 2021, "Texto do resumo em duas linhas", "artigo_cientifico", "ia")
    assert m.secoes_detectadas == ["Chatbot e RAG no governo", "Resumo", "Metodologia", "Resultados"] and m.id == "2021-x"


def test_lines_and_elements(spark):
    lines = spark.createDataFrame([("d", 1, 0, "TITULO", 10.0, False), ("d", 1, 1, "um texto comum de uma página qualquer que tem mais de dez palavras", 10.0, False), ("d", 1, 2, " ", 10.0, False)], LINES)
    e = structure.elements_of_lines(lines)
    assert [r.tipo for r in e.orderBy("pos").collect()] == ["section", "text"]
    assert [(r.font_size, r.is_bold) for r in structure.lines_of_elements(e).orderBy("pos").collect()] == [(14.0, True), (12.0, False)]
