"""Decontamination (2) against a scan of every window."""

import hashlib
import random
import re

import numpy as np
import pytest

from garimpo.llm import fmindex

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(rows, items, window):
    phrases = {}
    for name, t in items:
        w = split(t)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            phrases.setdefault(tuple(w[i : i + window]), set()).add(name)
    out = []
    for d, t in rows:
        w, hit, names = split(t), set(), set()
        for p, owners in phrases.items():
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i : i + len(p)]) == p:
                    hit.update(range(i, i + len(p)))
                    names |= {str(x) for x in owners if x is not None}
        out.append((d, len(w), len(hit), sorted(names)))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"W{i}" if i % 2 else f"é{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary[:30]) for _ in range(rng.choice((1, 2, 4, 12, 25))))) for i in range(20)]
    rows = []
    for i in range(70):
        parts = []
        for _ in range(rng.randrange(5)):
            parts.append(rng.choice(items)[1].upper() if rng.random() < 0.5 else " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(15))))
        rows.append((i, rng.choice((" ", ", ", "\n-")).join(parts)))
    items += [(20, items[5][1]), (21, None), (22, " .,"), (None, "w59 w57"), (20, "solo")]
    return rows + [(90, None), (91, ""), (92, "w1 " * 3000), (90, "w59 W57 w59"), (None, "solo")], items


def frames(spark, rows, items):
    return spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, item_id string"), spark.createDataFrame([(a, b, "x") for a, b in items], "item_id long, text string, spans string")


@pytest.mark.parametrize("window,block,shard", [(10, 2_000_000, 3_000_000), (3, 2_000_000, 50), (3, 20, 200)])
def test_equals_every_window(spark, window, block, shard):
    rows, items = corpus(window)
    docs, bench = frames(spark, rows, items)
    got = fmindex.contamination(docs.repartition(3), bench, window, "whole", block, shard)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in got.collect()), key=str) == sorted(((d, n, h, sorted(i)) for d, n, h, i in brute(rows, items, window)), key=str)
    for r in got.collect():
        assert len(split(fmindex.without_spans(r.text.encode(), r.spans).decode())) == r.n_words - r.n_hit
    for r in fmindex.contamination(docs, bench, window, "clean").collect():
        assert len(split(r.text)) == r.n_words - r.n_hit


def test_nothing(spark):
    docs, bench = frames(spark, [], [(1, "a b")])
    assert fmindex.contamination(docs, bench).collect() == []
    docs, bench = frames(spark, [(1, "a b")], [])
    assert [tuple(r) for r in fmindex.contamination(docs, bench).collect()] == [(1, "a b", 2, 0, [], [])]


def test_index_finds_all_occurrences():
    rng = np.random.default_rng(0)
    for size in (2, 3, 9):
        text = rng.integers(0, size, 300)
        index = fmindex.FMIndex(text, size)
        patterns = np.zeros((40, 4), np.int64)
        lengths = rng.integers(1, 5, 40)
        for i, n in enumerate(lengths):
            patterns[i, 4 - n :] = rng.integers(1, size, n)
        lo, hi = index.ranges(patterns, lengths)
        for i, n in enumerate(lengths):
            want = [j for j in range(301 - n) if (text[j : j + n] == patterns[i, 4 - n :]).all()]
            assert sorted(index.locate(np.arange(lo[i], max(lo[i], hi[i]))).tolist()) == want


def test_query_digest(spark, tmp_path):
    rows, items = corpus(1)
    docs, bench = frames(spark, rows, items)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((tuple(r) for r in fmindex.op2_fm_index_decontamination(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(((d, n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0) for d, n, h, i in brute(rows, items, 10)), key=str)
