"""Contexts, prompts, extractive answers and the decision which answer is given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..options import Options
from .classify import declares_not_found, is_diagnostic

# Answers and headings as users see them.
NO_EVIDENCE = "Não encontrei evidências suficientes nos documentos indexados."
NO_SOLUTION = (
    "Nao encontrei uma solucao candidata no catalogo de solucoes piloto para esse problema. "
    "Posso resumir evidencias documentais recuperadas, mas nao vou recomendar passos de implantacao sem uma solucao catalogada."
)
GROUNDED = "Com base nos trechos recuperados, a resposta mais segura e:"
SOLUTIONS_HEADING, EVIDENCE_HEADING = "--- SOLUCOES CANDIDATAS ---", "--- EVIDENCIAS DOCUMENTAIS ---"
DECLINED = ("não encontrei evidências suficientes nos documentos indexados", "nao encontrei evidencias suficientes nos documentos indexados")


def body() -> Column:
    return F.coalesce(F.when(F.col("parent_text") != "", F.col("parent_text")), "texto", F.lit(""))


def _label() -> Column:
    return X.source_label(F.col("doc_autores"), F.col("doc_ano"), F.col("doc_titulo"), F.col("documento"))


def _citation() -> Column:
    return X.citation_label(F.col("doc_autores"), F.col("doc_ano"), F.col("documento"))


def _page() -> Column:
    return F.coalesce(F.col("pagina").cast("string"), F.lit("?"))


def _ordered(rank: str, value: Column, sep: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), value.alias("v")))), lambda x: x["v"]), sep)


def build_context(hits: DataFrame, most_chars: int = 700, rank: str = "final_rank") -> DataFrame:
    """(query_id, context): each query's hits as numbered blocks of labelled lines, in their order."""
    blank = lambda c, d: F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit(d))
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    rows = [
        (F.concat(F.lit("Fonte "), F.col(rank).cast("string"), F.lit(": ")), F.concat(_label(), F.lit(" (p. "), _page(), F.lit(")"))), (F.lit("Citacao obrigatoria: "), F.concat(F.lit("("), _citation(), F.lit(")"))),
        (F.lit("Documento: "), shown("documento")), (F.lit("Pagina: "), shown("pagina")), (F.lit("Secao: "), blank("section_heading", "nao informado")), (F.lit("Tipo: "), blank("content_type", "text")),
        (F.lit("Area: "), shown("area")), (F.lit("Assuntos: "), F.array_join("assuntos", ", ")), (F.lit("Trecho: "), X.excerpt(body(), most_chars)),
    ]
    block = F.concat_ws("\n", *[F.concat(k, F.coalesce(v, F.lit(""))) for k, v in rows])
    return hits.groupBy("query_id").agg(_ordered(rank, block, "\n\n").alias("context"))


def diagnostic_context(solutions: Column, evidence: Column) -> Column:
    filled = lambda c, none: F.coalesce(F.when(c != "", c), F.lit(none))
    return F.concat(F.lit(f"{SOLUTIONS_HEADING}\n"), filled(solutions, "Nenhuma solucao candidata."), F.lit(f"\n\n{EVIDENCE_HEADING}\n"), filled(evidence, "Nenhuma evidencia documental."))


def history(turns: DataFrame, n: int = 6) -> DataFrame:
    """The last n turns of each conversation, in order, as labelled lines: (conv_id, n_turns, history)."""
    last = turns.withColumn("r", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role"), F.desc("text")))).where(F.col("r") <= n)
    line = F.concat(F.when(F.col("role") == "user", "Usuário: ").otherwise("Assistente: "), F.coalesce("text", F.lit("")))
    return last.withColumn("o", -F.col("r")).groupBy("conv_id").agg(F.count("*").alias("n_turns"), _ordered("o", line, "\n").alias("history"))


def build_prompt(system: str, diagnostic_rules: str, question: Column, context: Column, past: Column) -> Column:
    """System text (with the diagnostic contract where the context asks for it), history, context, question."""
    asks = F.contains(F.coalesce(context, F.lit("")), F.lit(SOLUTIONS_HEADING))
    head = F.when(asks, f"{system}\n\n{diagnostic_rules}\nMensagem conservadora: {NO_SOLUTION}").otherwise(system)
    before = F.when(past.isNotNull() & (past != ""), F.concat(F.lit("--- HISTORICO DE CONVERSA ---\n"), past, F.lit("\n\n"))).otherwise("")
    return F.concat(head, F.lit("\n\n"), before, F.lit("--- CONTEXTO FORNECIDO ---\n"), F.coalesce(context, F.lit("")), F.lit("\n\n--- PERGUNTA ---\n"), question, F.lit("\n\n--- RESPOSTA ---\n"))


def _one_line(most: int) -> Column:
    return X.excerpt(F.trim(F.replace(F.trim(body()), F.lit("\n"), F.lit(" "))), most)


def grounded_answer(hits: DataFrame, questions: DataFrame, options: Options = Options(), reason: str | None = None, rank: str = "final_rank") -> DataFrame:
    """(query_id, answer): the first hits as bullets with citations; the no-evidence answer without any."""
    filled = hits.where((F.col(rank) <= options.max_context_chunks) & (F.trim(body()) != ""))
    bullets = filled.groupBy("query_id").agg(_ordered(rank, F.concat(F.lit("- "), _one_line(320), F.lit(" ("), _citation(), F.lit(")")), "\n").alias("b"))
    head = GROUNDED + (f"\n\nObservacao de fidelidade: {reason}." if reason else "")
    text = F.concat(F.lit(f"{head}\n\nTrechos mais relevantes recuperados:\n"), "b", F.lit("\n\nPergunta original: "), F.coalesce("query", F.lit("")))
    return questions.join(bullets, "query_id", "left").select("query_id", F.coalesce(text, F.lit(NO_EVIDENCE)).alias("answer"))


def failure_answer(hits: DataFrame, questions: DataFrame, error: str, options: Options = Options(), rank: str = "final_rank") -> DataFrame:
    """(query_id, answer) when generation failed: fewer bullets, with their sources, and a note."""
    filled = hits.where((F.col(rank) <= options.reranker_top_n) & (F.trim(body()) != ""))
    source = F.concat(F.coalesce("documento", F.lit("desconhecido")), F.lit(" (p. "), _page(), F.lit(")"))
    bullets = filled.groupBy("query_id").agg(_ordered(rank, F.concat(F.lit("- "), _one_line(240), F.lit(" ("), _citation(), F.lit(") - "), source), "\n").alias("b"))
    text = F.concat(F.lit(f"{GROUNDED}\n\n"), "b", F.lit("\n\nPergunta original: "), F.coalesce("query", F.lit("")), F.lit(f"\nObservacao tecnica: a geracao pelo modelo local falhou ({error})."))
    none = "Nao foi possivel consultar o modelo local e tambem nao ha trechos suficientes para gerar um resumo de fallback."
    return questions.join(bullets, "query_id", "left").select("query_id", F.coalesce(text, F.lit(none)).alias("answer"))


def unique_sources(hits: DataFrame, rank: str = "final_rank") -> DataFrame:
    """(query_id, sources): distinct ``label (p. n)`` in order of first appearance."""
    label = F.concat(_label(), F.lit(" (p. "), _page(), F.lit(")"))
    first = hits.groupBy("query_id", label.alias("label")).agg(F.min(rank).alias("r"))
    return first.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "label"))), lambda x: x["label"]).alias("sources"))


def answer_signal(hits: DataFrame, options: Options = Options(), rank: str = "final_rank") -> DataFrame:
    """(query_id, signal): whether the best hit is near enough, or shares a term."""
    d, s = F.col("score_dense"), F.col("score_sparse")
    good = F.when(d.isNull() & s.isNull(), F.col("score") > 0).otherwise((F.coalesce(d, F.lit(0.0)) >= options.min_dense) | (F.coalesce(s, F.lit(0.0)) > 0))
    return hits.where(F.col(rank) == 1).select("query_id", F.coalesce(good, F.lit(False)).alias("signal"))


def declined(answer: Column) -> Column:
    return X.holds_any(F.lower(X.squeezed(answer)), DECLINED)


def outcomes(questions: DataFrame, hits: DataFrame, generated: DataFrame | None = None, options: Options = Options(), rank: str = "final_rank") -> DataFrame:
    """(query_id, diagnostic, outcome): which answer each question gets.

    ``hits`` may carry ``retrieval_domain``; ``generated(query_id, answer,
    faithful)`` is a model's answer, a null one a failure.
    """
    domain = F.col("retrieval_domain") == "solucoes" if "retrieval_domain" in hits.columns else F.lit(False)
    per = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.coalesce(F.bool_or(domain), F.lit(False)).alias("has_solution"))
    g = generated if generated is not None else questions.select("query_id", F.lit(None).cast("string").alias("answer"), F.lit(None).cast("boolean").alias("faithful"))
    j = questions.select("query_id", is_diagnostic("query").alias("diagnostic")).join(per, "query_id", "left").join(answer_signal(hits, options, rank), "query_id", "left").join(g, "query_id", "left")
    n = F.coalesce("n", F.lit(0))
    outcome = (
        F.when(F.col("diagnostic") & ~F.coalesce("has_solution", F.lit(False)), "no_solution")
        .when(n == 0, "no_evidence")
        .when(~F.coalesce("signal", F.lit(False)), "no_evidence_with_sources")
        .when(F.col("answer").isNull(), "failure_extract")
        .when(declined(F.col("answer")), "grounded_declined")
        .when(F.col("faithful") == F.lit(False), "grounded_unfaithful")
        .otherwise("generated")
    )
    return j.select("query_id", "diagnostic", outcome.alias("outcome"))


def claims(answer: Column | str) -> Column:
    """Sentences that state something: five words or more, none that finds nothing."""
    return F.filter(X.sentences(answer), lambda s: ~declares_not_found(s))


def faithful(answers: DataFrame, scorer) -> DataFrame:
    """(query_id, faithful): every claim entailed by the context, as ``scorer(context, claim)`` says; true without claims."""
    each = answers.select("query_id", "context", F.explode_outer(claims("answer")).alias("claim"))
    ok = F.when(F.col("claim").isNull(), F.lit(True)).otherwise(scorer(F.col("context"), F.col("claim")))
    return each.groupBy("query_id").agg(F.bool_and(ok).alias("faithful"))


def entailed(logits: Column, entailment: int = 1) -> Column:
    """Whether a classifier's logits (contradiction, entailment, neutral) say that a claim is entailed."""
    return X.argmax(logits) == entailment


def events(answered: DataFrame, check: bool = False) -> DataFrame:
    """Answers as streams of JSON lines ``(query_id, seq, event)``.

    ``answered(query_id, outcome, diagnostic, sources, results, prompt, answer,
    tokens, error, faithful, reason, fallback)``; columns that are absent count
    as null, ``tokens`` then is the answer cut after each blank.  First the
    metadata with sources, results and prompt; then the answer token by token, or
    the whole of a canned one (outcomes without evidence or solution, which have
    no prompt) as one token; then, with ``check``, whether it is faithful and,
    only if it isn't, the answer to show instead; an error ends the stream.
    Every row gives its own lines, in order: nothing shuffles.
    """
    have = lambda c, kind: F.col(c).cast(kind) if c in answered.columns else F.lit(None).cast(kind)
    none = F.array().cast("array<string>")
    results = F.col("results") if "results" in answered.columns else none
    made = F.filter(F.split(F.coalesce(have("answer", "string"), F.lit("")), "(?<= )"), lambda t: t != "")
    a = answered.select("query_id", have("outcome", "string").alias("outcome"), F.coalesce(have("diagnostic", "boolean"), F.lit(False)).alias("diagnostic"), F.coalesce(have("sources", "array<string>"), none).alias("sources"), results.alias("results"), F.coalesce(have("tokens", "array<string>"), made).alias("tokens"), *[have(c, "string").alias(c) for c in ("prompt", "error", "reason", "fallback")], have("faithful", "boolean").alias("faithful"))
    unsolved = F.coalesce(F.col("outcome") == "no_solution", F.lit(False))
    canned = F.when(unsolved, NO_SOLUTION).when(F.col("outcome").isin("no_evidence", "no_evidence_with_sources"), NO_EVIDENCE)
    a = a.withColumn("canned", canned)
    line = lambda *c: F.to_json(F.struct(*c), {"ignoreNullFields": "false"})
    kind = lambda t: F.lit(t).alias("type")
    meta = line(kind("metadata"), F.col("sources").alias("fontes"), F.col("results").alias("resultados"), F.when(F.col("canned").isNull(), F.col("prompt")).alias("prompt"), (F.col("diagnostic") | unsolved).alias("diagnostic_mode"))
    said = F.transform(F.when(F.col("canned").isNotNull(), F.array("canned")).otherwise(F.col("tokens")), lambda t: line(kind("token"), t.alias("token")))
    judged = line(kind("faithfulness"), F.lit(True).alias("faithfulness_checked"), "faithful", "reason")
    replaced = line(kind("faithfulness"), F.lit(True).alias("faithfulness_checked"), "faithful", "reason", F.col("fallback").alias("fallback_response"))
    end = F.when(F.col("canned").isNotNull(), none).when(F.col("error").isNotNull(), F.array(line(kind("error"), F.col("error").alias("message"))))
    if check:
        end = end.when(F.col("faithful"), F.array(judged)).when(~F.col("faithful"), F.array(replaced))
    return a.select("query_id", F.posexplode(F.concat(F.array(meta), said, end.otherwise(none))).alias("seq", "event"))


# How failures are told to clients.
ERROR_CODES = (("index", 503), ("llm", 502))


def error_code(kind: Column) -> Column:
    """The status of a failure: 503 without an index, 502 without the model's server, else 500."""
    out = F.when(F.lit(False), 0)
    for name, code in ERROR_CODES:
        out = out.when(kind == name, code)
    return out.otherwise(500)
