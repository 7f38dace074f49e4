"""Query planning, area and type classification, intents and scans by keyword."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as X

# Planner keywords of areas, subjects and document types.
PLAN_AREAS = {
    "infraestrutura": ("infraestrutura", "infra", "kubernetes", "cluster", "deploy", "devops", "qdrant", "docker"),
    "juridico": ("juridico", "juridica", "lgpd", "lei", "privacidade", "conformidade", "regulacao", "etica"),
    "saude": ("saude", "clinico", "clinica", "hospital", "paciente", "diagnostico", "medico"),
    "ia": ("ia", "inteligencia artificial", "llm", "rag", "embedding", "embeddings", "modelo", "chatbot"),
    "tecnologia": ("tecnologia", "software", "sistema", "api", "dados", "plataforma"),
}
PLAN_SUBJECTS = {
    "kubernetes": ("kubernetes", "k8s", "cluster"),
    "lgpd": ("lgpd", "privacidade", "dados pessoais"),
    "rag": ("rag", "retrieval augmented generation", "recuperacao aumentada"),
    "chatbot": ("chatbot", "assistente", "bot"),
    "embedding": ("embedding", "embeddings", "vetor", "vetorial"),
    "seguranca": ("seguranca", "seguro", "vulnerabilidade"),
    "conformidade": ("conformidade", "compliance", "regulacao"),
}
PLAN_TYPES = {
    "artigo_cientifico": ("artigo", "paper", "estudo"),
    "relatorio_tecnico": ("relatorio", "relatorio tecnico"),
    "manual": ("manual", "guia", "tutorial"),
    "apresentacao": ("apresentacao", "slides", "deck"),
}
# Classifier keywords of areas (substrings), in the order that breaks ties, and default subjects.
CLASS_AREAS = {
    "juridico": ("direito", "juridico", "responsabilidade civil", "responsabilidade", "dano", "danos", "civil-constitucional", "constitucional", "legislacao", "regulacao", "regulatorio", "lei", "projeto de lei", "vitima", "ordenamento juridico"),
    "infraestrutura": ("infraestrutura", "servidor", "servidores", "gpu", "cluster", "nuvem", "kubernetes", "storage", "deploy", "disponibilidade"),
    "ia": ("rag", "chatbot", "modelo de linguagem", "llm", "machine learning", "aprendizado de maquina", "inteligencia artificial", "ia generativa"),
    "saude": ("saude", "sus", "paciente", "hospital", "clinico", "medico", "epidemiologia"),
    "tecnologia": ("tecnologia", "inovacao", "software", "sistema", "plataforma", "api", "automacao"),
}
STRONG_LEGAL = ("responsabilidade civil", "civil-constitucional", "ordenamento juridico", "projeto de lei")
DEFAULT_SUBJECTS = {
    "juridico": ("responsabilidade civil", "danos", "regulacao", "ia"),
    "infraestrutura": ("servidores", "nuvem", "gpu", "seguranca"),
    "ia": ("rag", "chatbot", "modelos", "ia"),
    "saude": ("saude", "pesquisa", "ia"),
    "tecnologia": ("inovacao", "sistemas", "tecnologia"),
}
# Terms of a question that asks for a diagnosis.
DIAGNOSTIC_TERMS = (
    "problema", "problemas", "sintoma", "sintomas", "causa", "causa raiz", "diagnostico", "diagnosticar", "resolver", "resolucao", "solucao", "solucoes", "recomendar",
    "recomendacao", "falha", "falhas", "erro", "erros", "lentidao", "demora", "gargalo", "backlog", "risco", "riscos", "priorizar",
)
# Phrases that try to steer a model from within a document.
INJECTION_PATTERNS = (
    "ignore previous instructions", "ignore all instructions", "ignore as instrucoes anteriores", "system prompt", "developer message", "reveal your prompt", "revele seu prompt",
    "do not cite", "nao cite", "always answer", "responda sempre", "forget the context", "esqueca o contexto",
)
# Markers of an answer that found nothing.
NOT_FOUND = (
    "não encontrei evidências suficientes nos documentos indexados", "nao encontrei evidencias suficientes nos documentos indexados", "nao encontrei", "não encontrei",
    "nao foi encontrado", "não foi encontrado", "suporte suficiente", "nao ha informacao", "não há informação",
)
# Sections of an article, and words of titles by document type.
ARTICLE_SECTIONS = ("metodologia", "método", "resultados", "conclusão", "referências", "abstract", "resumo", "introdução", "revisão da literatura", "referencial teórico")
TITLE_TYPES = (("manual", ("manual", "guia", "tutorial")), ("relatorio_tecnico", ("relatório", "relatorio", "fase", "mvp", "framework")), ("apresentacao", ("apresentação", "dinâmica", "oficina")))


def keyword_count(folded: Column, keywords, whole_words: bool) -> Column:
    hit = X.holds_keyword if whole_words else (lambda t, k: F.contains(t, F.lit(k)))
    total = F.lit(0)
    for k in keywords:
        total = total + hit(folded, k).cast("int")
    return total


def best_label(folded: Column, labels: dict, whole_words: bool, ties: str) -> Column:
    """struct(label, score) of the label with most keywords; null label where none has any.

    ``ties``: "name" takes the alphabetically first, "order" the first in the dictionary.
    """
    names = sorted(labels) if ties == "name" else list(labels)
    scored = F.array(*[F.struct(keyword_count(folded, labels[n], whole_words).alias("score"), F.lit(-i).alias("place"), F.lit(n).alias("label")) for i, n in enumerate(names)])
    top = F.array_max(scored)
    return F.struct(F.when(top["score"] > 0, top["label"]).alias("label"), top["score"].alias("score"))


def plan_query(question: Column | str) -> Column:
    """struct(query_text, filtro_area, filtro_assunto, ano, tipo_documento, confidence) of a question."""
    text = F.trim(F.coalesce(X.col(question), F.lit("")))
    folded = X.fold(text)
    area, subject, kind = (best_label(folded, d, True, "name") for d in (PLAN_AREAS, PLAN_SUBJECTS, PLAN_TYPES))
    year = X.year_in(folded)
    signals = area["score"] + subject["score"] + kind["score"] + year.isNotNull().cast("int")
    # 0.25 + 0.15 a signal, in hundredths: exact, as the binary sum isn't.
    confidence = F.when(signals > 0, F.least(F.lit(95), F.lit(25) + signals * 15) / F.lit(100.0)).otherwise(0.0)
    return F.struct(text.alias("query_text"), area["label"].alias("filtro_area"), subject["label"].alias("filtro_assunto"), year.alias("ano"), kind["label"].alias("tipo_documento"), confidence.alias("confidence"))


def classify_area(title: Column, abstract: Column, sections: Column, area: Column, subjects: Column) -> Column:
    """struct(area, assuntos): a specific area stays; else the area with two keywords or more, or a clearly legal text."""
    text = X.fold(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(abstract, F.lit("")), F.array_join(F.coalesce(sections, F.array().cast("array<string>")), " ")))
    best = best_label(text, CLASS_AREAS, False, "order")
    legal = (best["label"] == "juridico") & X.holds_any(text, STRONG_LEGAL)
    found = F.when((best["score"] >= 2) | legal, best["label"])
    has = F.coalesce((area != "") & (area != "geral"), F.lit(False))
    defaults = F.create_map(*[v for n, s in DEFAULT_SUBJECTS.items() for v in (F.lit(n), F.array(*map(F.lit, s)))])
    plain = F.coalesce((F.size(subjects) == 0) | (subjects == F.array(F.lit("geral"))), F.lit(True))
    new = F.when(~has & found.isNotNull(), found)
    return F.struct(F.coalesce(new, area, F.lit("geral")).alias("area"), F.when(new.isNotNull() & plain, F.try_element_at(defaults, new)).otherwise(subjects).alias("assuntos"))


# What a model may answer.
AREAS = ("ia", "saude", "infraestrutura", "juridico", "tecnologia", "geral")
TYPES = ("artigo_cientifico", "relatorio_tecnico", "manual", "apresentacao", "outro")
METHODS = ("estudo de caso", "revisao-sistematica", "pesquisa-quantitativa", "relatorio", "manual", "outro")
ANSWER = "area_tematica string, tipo_documento string, metodologia string, assuntos array<string>, palavras_chave array<string>"


def enriched(metadata: DataFrame, answers: DataFrame, most_subjects: int = 6, most_keywords: int = 8) -> DataFrame:
    """Document metadata with a model's answers ``(id, answer)`` merged in.

    ``metadata(id, area_tematica, tipo_documento, metodologia, assuntos,
    palavras_chave, ...)``.  An answer's object counts only with values that are
    allowed; a specific area is never replaced by ``geral``, nor are its subjects
    by ``geral`` alone.  ``qualidade_extracao`` is ``alta`` with an answer that
    could be read, else ``baixa`` and nothing changes.
    """
    a = F.col("_a")
    j = metadata.join(answers.select("id", X.json_object_in(F.col("answer"), ANSWER).alias("_a"), X.json_object_in(F.col("answer"), "map<string,string>").alias("_any")), "id", "left")
    read = F.col("_any").isNotNull()
    area = X.one_of(F.coalesce(a["area_tematica"], F.lit("")), AREAS, F.col("area_tematica"))
    keeps = (F.col("area_tematica") != "geral") & (area == "geral")
    listed = lambda c, lower: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda v: F.trim(F.lower(v) if lower else v)), lambda v: v != "")
    subjects, words = listed(a["assuntos"], True), listed(a["palavras_chave"], False)
    new = {
        "area_tematica": F.when(read & ~keeps, area).otherwise(F.col("area_tematica")),
        "tipo_documento": F.when(read, X.one_of(F.coalesce(a["tipo_documento"], F.lit("")), TYPES, F.col("tipo_documento"))).otherwise(F.col("tipo_documento")),
        "metodologia": F.when(read, X.one_of(F.coalesce(a["metodologia"], F.lit("")), METHODS, F.col("metodologia"))).otherwise(F.col("metodologia")),
        "assuntos": F.when(read & (F.size(subjects) > 0) & ~(keeps & (subjects == F.array(F.lit("geral")))), F.slice(subjects, 1, most_subjects)).otherwise(F.col("assuntos")),
        "palavras_chave": F.when(read & (F.size(words) > 0), F.slice(words, 1, most_keywords)).otherwise(F.col("palavras_chave")),
    }
    kept = [new.get(c, F.col(c)).alias(c) for c in metadata.columns if c != "qualidade_extracao"]
    return j.select(*kept, F.when(read, "alta").otherwise("baixa").alias("qualidade_extracao"))


def is_diagnostic(question: Column | str) -> Column:
    return X.holds_any(X.squeezed(X.fold(question)), DIAGNOSTIC_TERMS)


def injection_findings(text: Column | str) -> Column:
    """Sorted patterns found; which of a few literals are in the lower-cased text."""
    low = F.lower(F.coalesce(X.col(text), F.lit("")))
    return F.array_sort(F.array_compact(F.array(*[F.when(F.contains(low, F.lit(p)), F.lit(p)) for p in INJECTION_PATTERNS])))


def declares_not_found(answer: Column | str) -> Column:
    return X.holds_any(F.lower(F.coalesce(X.col(answer), F.lit(""))), NOT_FOUND)


def document_type(sections: Column, title: Column) -> Column:
    """By its sections (three of an article's), then its title, then one section of an article's; else a report."""
    n = F.size(F.array_intersect(F.transform(F.coalesce(sections, F.array().cast("array<string>")), lambda s: F.lower(s)), F.array(*map(F.lit, ARTICLE_SECTIONS))))
    low = F.lower(F.coalesce(title, F.lit("")))
    out = F.when(n >= 3, "artigo_cientifico")
    for kind, keys in TITLE_TYPES:
        out = out.when(X.holds_any(low, keys), kind)
    return out.when(n >= 1, "artigo_cientifico").otherwise("relatorio_tecnico")
