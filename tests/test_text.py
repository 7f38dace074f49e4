"""Text functions on small fixtures."""

import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from garimpo.functions import text as X
from garimpo.functions import vectors as V
from garimpo.options import Options


def one(spark, expression, **columns):
    """The value of a column expression over one row of given columns."""
    names = list(columns)
    kinds = {str: "string", int: "int", float: "double", bool: "boolean", list: "array<string>", type(None): "string"}
    schema = ", ".join(f"{n} {kinds[type(v)]}" for n, v in columns.items()) or "x int"
    return spark.createDataFrame([tuple(columns.values()) or (1,)], schema).select(expression.alias("v")).first().v if names else None


TEXTS = ["Olá mundo-novo, a b_c 12 x", "", None, "--ab-- a-b-", "ÀÉ ção ﬁ", "lei. leitura; LEI", "x  y\n z"]


def test_tokens_equal_python(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", X.tokens("t").alias("k")).collect()
    for r in rows:
        assert r.k == re.findall(r"\b[\w\-]{2,}\b", (r.t or "").lower())


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="áÉçÃñoü aB.", max_size=12), min_size=1, max_size=20))
def test_fold_equals_nfkd(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.fold("t").alias("k")).collect()
    for r in rows:
        assert r.k == "".join(c for c in unicodedata.normalize("NFKD", r.t) if not unicodedata.combining(c)).lower()


@pytest.mark.parametrize("raw,clean", [("a  b\n### SECAO: x\n 12 \nc", "a b c"), ("\r\n x \r y", "x y"), (None, ""), ("1 2 3", "1 3")])
def test_clean_text(spark, raw, clean):
    assert one(spark, X.clean_text("t"), t=raw) == clean


def test_clean_extracted(spark):
    assert one(spark, X.clean_extracted("t"), t="a\x07 \r\n\n\n\n\nb  \n") == "a\n\n\nb"


def test_trim_parent_and_excerpt(spark):
    assert one(spark, X.trim_parent("t", 3), t="a b  c d") == "a b c ..."
    assert one(spark, X.trim_parent("t", 4), t=" a b  c d") == "a b c d"
    assert one(spark, X.excerpt(F.col("t"), 4), t="abc def") == "abc..."


@pytest.mark.parametrize("raw,key", [("a\\b.pdf", "uploads/b.pdf"), ("", "uploads/desconhecido.pdf"), ("uploads/x/y.pdf", "uploads/x/y.pdf"), (None, "uploads/desconhecido.pdf")])
def test_document_key(spark, raw, key):
    assert one(spark, X.document_key("t"), t=raw) == key


def test_document_id(spark):
    assert one(spark, X.document_id("t", F.col("y")), t="d/Meu relatório (v2).pdf", y=2024) == "2024_Meu_relatório_v2"
    assert one(spark, X.document_id("t", F.col("y")), t="2024 x.pdf", y=2024) == "2024_x"


@pytest.mark.parametrize("text,year", [("em 1999 e 2020", 1999), ("x2020", None), ("12020", None), ("(2021)", 2021), ("1899", None)])
def test_year(spark, text, year):
    assert one(spark, X.year_in(F.col("t")), t=text) == year


def test_keyword_matching(spark):
    assert one(spark, X.holds_keyword(F.col("t"), "lei"), t="a leitura") is False
    assert one(spark, X.holds_keyword(F.col("t"), "lei"), t="a lei.") is True
    assert one(spark, X.holds_keyword(F.col("t"), "dados pessoais"), t="xdados pessoaisx") is True


def test_labels(spark):
    c = F.col
    label = X.source_label(c("a"), c("y"), c("t"), c("d"))
    assert one(spark, label, a=["Ana  Souza "], y=2020, t="Título", d="x.pdf") == 'Souza, 2020 — "Título"'
    assert one(spark, label, a=[""], y=2020, t="", d="dir/nome.v1.pdf") == "nome.v1 (2020)"
    cite = X.citation_label(c("a"), c("y"), c("d"))
    assert one(spark, cite, a=["Ana Souza"], y=0, d="x.pdf") == "Souza, s.d."
    assert one(spark, cite, a=[""], y=1999, d="") == "Documento, 1999"


def test_citations_and_sentences(spark):
    assert one(spark, X.citations_in(F.col("t")), t="a (Souza, 2020) b (Lima , S.D.) (x) (Souza, 2020)") == ["Souza, 2020", "Lima, S.D."]
    assert one(spark, X.sentences("t"), t="um dois tres quatro cinco. curto! a b c d e f") == ["um dois tres quatro cinco.", "a b c d e f"]


def test_table_markdown(spark):
    df = spark.createDataFrame([([["a", None], ["", " "], ["b\nc"]],), ([[" "]],), ([],)], "r array<array<string>>")
    assert [r.v for r in df.select(X.table_markdown(F.col("r")).alias("v")).collect()] == ["| a |  |\n| --- | --- |\n| b c |  |", "", ""]


def test_json_in_answer_and_lists(spark):
    assert one(spark, X.json_object_in(F.col("t"), "a int")["a"], t='sure: {"a": 3} done') == 3
    assert one(spark, X.clean_list(F.col("t")), t=[" x ", ""]) == ["x"]
    assert one(spark, X.clean_list(F.col("t")), t=[" "]) == ["geral"]
    assert one(spark, X.one_of(F.col("t"), ("ia", "geral"), "geral"), t=" IA ") == "ia"


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0])], "a array<float>, b array<float>")
    r = df.select(V.cosine(F.col("a"), F.col("b")).alias("c"), V.unit(F.col("a")).alias("u"), V.cosine(F.col("a"), F.array(F.lit(0.0), F.lit(0.0))).alias("z")).first()
    assert abs(r.c - 0.96) < 1e-12 and r.u == [0.6, 0.8] and r.z is None
    with pytest.raises(Exception, match="has not 3 dimensions"):
        df.select(V.checked(F.col("a"), 3)).collect()


def test_options():
    o = Options.from_env("X_", {"X_TOP_K": "99", "X_RRF_K": "abc", "X_QUERY_PLANNING": "Sim"})
    assert (o.top_k, o.rrf_k, o.query_planning, o.min_dense) == (20, 60, True, 0.18)
