"""Ranked search (12) against scores of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from garimpo.llm import impact

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(t):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, k):
    counts = [(d, Counter(split(t))) for d, t in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    n_docs, length = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    terms = {}
    for name, t in items:
        terms.setdefault(name, set()).update(split(t))
    out = []
    for name, mine in terms.items():
        found = []
        for d, c, n in counts:
            m = 50 + 50 * n * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in mine if t in c)
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(name, r, None if e else d, -s) for r, (s, e, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def corpus(seed, n=400):
    rng = random.Random(seed)
    words = [f"W{i}" if i % 3 else f"é{i}" for i in range(200)]
    pick = lambda: words[min(199, int(rng.paretovariate(0.4)))]
    docs = [(i, rng.choice((" ", "\n", ", ", "-")).join(pick() for _ in range(rng.randrange(60)))) for i in range(n)]
    docs += [(n + i, docs[5][1]) for i in range(30)] + [(3, "w5 w5"), (None, "w7 É9 w7"), (None, "w7 É9 w7"), (900, None), (901, ""), (902, " ... "), (903, "w1 " * 5000)]
    items = [(i, " ".join(pick() for _ in range(rng.choice((1, 2, 8, 40))))) for i in range(25)] + [(30, None), (31, "?!"), (None, "w7 w9"), (2, "w11 again"), (32, "nowhere"), (33, "w1 w2 w1 W2"), (34, docs[5][1])]
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame([(a, b, 1, "x", 0.5) for a, b in docs], "doc_id long, text string, item_id int, rank string, score double").repartition(5), spark.createDataFrame([(a, b, 7) for a, b in items], "item_id long, text string, doc_id int")


@pytest.mark.parametrize("k,postings,most_docs,block", [(50, 10**6, 10**5, 10**6), (3, 500, 10**5, 10**6), (1, 10**6, 30, 10**6), (10, 2000, 100, 200)])
def test_equals_brute_force(spark, k, postings, most_docs, block):
    docs, items = corpus(k)
    got = impact.search(*frames(spark, docs, items), k, block, postings, most_docs)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, k)


def test_empty_tables(spark):
    docs, items = corpus(1)
    d, i = frames(spark, docs, items)
    assert impact.search(d.limit(0), i).collect() == []
    assert impact.search(d, i.limit(0)).collect() == []
    assert impact.search(d.where("text is null"), i).collect() == []


def test_low_impacts_are_left_unread():
    """A rare and a common term: the search stops before the common term's postings, and is right."""
    rng = np.random.default_rng(3)
    n = 20_000
    common, rare = np.arange(n), np.sort(rng.choice(n, 100, replace=False))
    docs = np.concatenate([common, rare])
    terms = np.concatenate([np.zeros(n, np.int64), np.ones(100, np.int64)])
    impacts = np.concatenate([rng.integers(1, 50, n), rng.integers(1000, 2000, 100)])
    order = np.argsort(docs, kind="stable")
    shard = impact.Shard(docs[order], terms[order], impacts[order], n)
    total = np.bincount(docs, impacts, n).astype(np.int64)
    sums = np.zeros(n, np.int64)
    found, scores = shard.search(np.array([0, 1]), np.ones(2, np.int64), 10, 0, sums)
    best = np.lexsort((found, -scores))[:10]
    want = np.lexsort((np.arange(n), -total))[:10]
    assert found[best].tolist() == want.tolist() and scores[best].tolist() == total[want].tolist()
    assert shard.read <= 100 < shard.held == n + 100 and not sums.any()
    # A bound from shards before ends it at once.
    shard.read = 0
    assert len(shard.search(np.array([0, 1]), np.ones(2, np.int64), 10, 10**6, sums)[0]) == 0 and shard.read == 0


def test_ties_at_the_last_rank(spark):
    docs = [(i, "same words here") for i in range(100, 0, -1)] + [(200, "other")]
    got = impact.search(*frames(spark, docs, [(1, "same words")]), 5).orderBy("rank").collect()
    assert [(r["rank"], r.doc_id) for r in got] == [(i, i) for i in range(1, 6)]
