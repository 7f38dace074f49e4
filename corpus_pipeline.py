"""The corpus pipeline: each stage is one of the training-data operators at work.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns what it keeps, with the columns of ``documents``; the last returns
packed pieces.  ``run`` writes each stage's result to the shared folder and
reads it again as the next one's input.  Stages judge what their predecessor
kept.  Only rows that a stage's operator objects to go: clean documents stay.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garimpo.llm import common, fmindex, langid, minhash, packing, superkmer

REST = "_rest"
#: The least score of a prediction that overrules a document's language label.
CONTRADICTED = 0.9


def _packed(docs: DataFrame) -> DataFrame:
    """Documents with all columns but the text carried as one, whatever their names."""
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    return docs.select("doc_id", "text", rest.alias(REST))


def _unpacked(done: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` again, the text from ``done`` and n_chars to match."""
    new = {"text": F.col(text), "n_chars": F.length(text).cast("long")}
    return done.select(*[new.get(c, F.col(f"{REST}.`{c}`")).alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have no language, or surely another one than they are labelled with.

    Profiles are learnt from the labelled languages of all documents.  Rejected:
    a text without a letter (or no text), and a text that is predicted to be in
    another language than its non-null ``lang`` with a score of ``CONTRADICTED``
    or more (mislabelled, or for the larger part in another language).  All
    else stays: any language, texts without a label, and texts with letters
    where there was no label to learn from.  Rows are judged one by one, so
    repeated rows and rows without a doc_id fare as their texts do.
    """
    profiles = langid.train(docs)
    if not profiles.languages:
        profiles = langid.Profiles([(langid.NONE, 0, 0)], langid.PROFILE)
    found = langid.predict(_packed(docs), profiles, [REST])
    lang = F.col(f"{REST}.lang").cast("string")
    wordless = (F.col("lang_pred") == langid.NONE) & (F.col("score") <= 0)
    contradicted = F.coalesce(lang != F.col("lang_pred"), F.lit(False)) & (F.col("score") >= CONTRADICTED)
    return _unpacked(found.where(~wordless & ~contradicted), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the row with the least doc_id stays, once.

    Rows go by their own text: different texts under one doc_id are different
    documents, and so are rows with a null doc_id.
    """
    return minhash.one_of_each(docs, 5, 80)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside windows of 35 words that occur again are cut out; a document of which nothing is left goes.

    Rows that share a doc_id, or lack one, are separate texts.
    """
    done = superkmer.remove_repeats(_packed(docs), key=REST)
    return _unpacked(done.where("n_removed = 0 or n_removed < n_words"), docs, "kept")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside windows of ten words of a benchmark item are cut out; a document of which nothing is left goes.

    Rows are judged one by one, whatever their doc_id.
    """
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    done = fmindex.contamination(_packed(docs), bench, text="clean", key=REST)
    return _unpacked(done.where("n_hit = 0 or n_hit < n_words"), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 ids, a row for each piece; rows that share a doc_id, or lack one, are separate documents."""
    return packing.digest(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), True))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("decontaminate", decontaminate),
    ("pack", pack),
]

#: Sketches, indexes and token ids aren't SQL; tests/llm/test_pipeline.py runs it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
