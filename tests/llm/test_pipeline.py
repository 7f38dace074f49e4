"""The corpus pipeline against brute force, stage by stage, on a small corpus."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from garimpo.llm import common, langid

from . import test_fmindex, test_minhash

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def corpus():
    rng = random.Random(5)
    vocabulary = {"en": ["the", "of", "and", "with", "house", "water", "light", "stone", "river"], "de": ["der", "und", "nicht", "wasser", "haus", "licht", "stein", "fluss", "über"]}
    passage = " ".join(f"p{i}" for i in range(60))
    item = " ".join(f"b{i}" for i in range(20))
    rows = []
    for i in range(60):
        lang = rng.choice(list(vocabulary))
        words = [rng.choice(vocabulary[lang]) + rng.choice("abcdefgh") * rng.randrange(3) for _ in range(rng.choice((3, 40, 120)))]
        text = " ".join(words)
        if i % 9 == 0:
            text += "\n" + passage
        if i % 11 == 0:
            text += "\n" + item
        rows.append((i, text, lang if i % 13 else None, "s", len(text)))
    rows += [(100 + i, rows[i * 3][1], "en", "s", 1) for i in range(6)]
    rows += [(120 + i, rows[i * 3][1] + " one", "en", "s", 1) for i in range(6)]
    rows += [(150, None, "en", "s", 0), (151, "", "en", "s", 0), (152, "12 ..", "en", "s", 5), (153, passage, "en", "s", 1), (154, item.upper(), "en", None, 1)]
    german = " ".join(rng.choice(vocabulary["de"]) for _ in range(90))
    rows += [(160, german, "en", "s", 1), (161, german + " und wasser nicht", None, "s", 1)]
    return rows, [(1, item), (2, "ab cd")]


def by_hand(spark, rows, items):
    p = langid.train(spark.createDataFrame([(r[2], r[1]) for r in rows], "lang string, text string"))
    judged = [(r, *p.predict(r[1])) for r in rows]
    docs = {r[0]: r[1] for r, lang, score in judged if lang != "und" and not (r[2] is not None and lang != r[2] and score >= 0.9)}
    assert 160 not in docs and 161 in docs
    kept = {d for d, _, _, k in test_minhash.brute(list(docs.items()), 5, 80) if k}
    docs = {d: t for d, t in docs.items() if d in kept}
    split = {d: re.findall(r"[^\x20\x09-\x0D]+", t) for d, t in docs.items()}
    seen = Counter(tuple(w[i : i + 35]) for w in split.values() for i in range(len(w) - 34))
    after = {}
    for d, w in split.items():
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        if not gone:
            after[d] = docs[d]
        elif len(gone) < len(w):
            after[d] = " ".join(x for i, x in enumerate(w) if i not in gone)
    out = {}
    hits = {d: (n, h) for d, n, h, _ in test_fmindex.brute(list(after.items()), items, 10)}
    for d, t in after.items():
        n, h = hits[d]
        if h == 0 or h < n:
            out[d] = (n - h, t if h == 0 else None)
    return out


def test_pipeline(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = by_hand(spark, rows, items)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.staged(stage(spark, docs, str(tmp_path)), "test")
        assert docs.columns == columns
    got = {r.doc_id: r for r in docs.collect()}
    assert got.keys() == want.keys()
    for d, (n, text) in want.items():
        assert len(test_fmindex.split(got[d].text)) == n and got[d].n_chars == len(got[d].text)
        if text is not None:
            assert got[d].text == text
    pieces = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert pieces.keys() == got.keys()
    for d, r in got.items():
        ids = [*tok.encode(r.text, add_special_tokens=False).ids, 0]
        for p in pieces[d]:
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) and p.doc_tokens == len(ids)


def test_stages_with_odd_columns_and_repeated_rows(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    schema = "doc_id long, text string, lang string, score double, lang_pred string, kept string, spans int, key int, n_words int"
    docs = spark.createDataFrame([(r[0], r[1], r[2], 0.5, "x", "y", 1, 2, 3) for r in [*rows[:9], *rows[:3], (None, rows[5][1] + " null id", None)]], schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.staged(stage(spark, docs, str(tmp_path)), "odd")
        assert docs.dtypes == spark.createDataFrame([], schema).dtypes
    rows_left = [(r.doc_id, r.text) for r in docs.collect()]
    assert len(rows_left) == len(set(rows_left)) and None in {d for d, _ in rows_left}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []


def test_language_without_labels_or_with_und(spark):
    texts = [(1, "the house"), (2, "Straße am Fluss"), (3, "12 .."), (4, ""), (5, None)]
    for label in (None, "und"):
        docs = spark.createDataFrame([(d, t, label) for d, t in texts], "doc_id long, text string, lang string")
        assert sorted(r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()) == [1, 2]


def test_different_texts_under_one_id_all_stay(spark):
    x, z = (" ".join(f"{c}{i}" for i in range(30)) for c in "xz")
    docs = spark.createDataFrame([(3, x, "en"), (5, x, "en"), (5, z, "en"), (None, z + " end", "en"), (None, "other words here", "en")], "doc_id long, text string, lang string")
    left = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()), key=str)
    assert left == [(3, x), (5, z), (None, "other words here")]
