"""Periodic runs (11) against a scan of every period."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from garimpo.llm import periodic


def split(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]


def brute(w, least=6, times=4):
    """All maximal stretches of every period; a stretch counts with the least period alone."""
    best = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                best.setdefault((i, j + q), q)
            i = j
    return sorted((a, b - a, q) for (a, b), q in best.items())


def collapsed(w, runs):
    gone = {i for a, size, q in runs for i in range(a + q, a + size)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def corpus(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randrange(5)):
            block = [rng.choice("ab") if rng.random() < 0.5 else f"w{rng.randrange(9)}É" for _ in range(rng.randrange(1, 9))]
            words += block * rng.randrange(1, 9) + block[: rng.randrange(len(block))]
        rows.append((i, rng.choice((" ", "\n", "\t ", " \x0b")).join(words)))
    return rows + [(500, None), (501, ""), (502, " \n "), (503, "a " * 6), (504, "a " * 5), (505, "a b " * 4), (506, "a b " * 3 + "a"), (None, "x y z " * 5), (505, "other"), (507, "A a " * 9)]


@pytest.mark.parametrize("least,times", [(6, 4), (2, 2), (9, 3)])
def test_equals_brute_force(spark, least, times):
    rows = corpus(least)
    rows += rows[3:6]  # repeated rows
    df = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "doc_id long, text string, runs int, n_words string").repartition(3)
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.periodic_runs(df, least, times).collect()]
    want = []
    for d, t in rows:
        w = split(t)
        found = brute(w, least, times)
        want.append((d, len(w), found, collapsed(w, found)))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_query_on_planted_texts(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice("abcdefgh") + rng.choice(("", "x")) for _ in range(rng.randrange(120)))) for i in range(300)] + [(None, "a " * 20), (900, None), (7, " b\tb " * 9)]
    spark.createDataFrame([(a, b, "src") for a, b in rows], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for d, t in rows:
        w = split(t)
        h = zlib.crc32(str(d).encode())
        g = h // 10
        if d is not None and h % 10 == 0 and w:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        runs = brute(w)
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((d, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, sha("".join(f"{a},{b},{q}\n" for a, b, q in runs)), sha(collapsed(w, runs))))
    got = periodic.op11_harmonic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert sum(w[1] > 0 for w in want) > 10


def test_empty_table_and_bad_parameters(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert periodic.periodic_runs(df).collect() == []
    with pytest.raises(ValueError):
        periodic.periodic_runs(df, times=1)


def test_long_texts_and_blocks(monkeypatch):
    """Long sequences, pairs taken in small blocks: one word throughout, a planted run, no run at all."""
    rng = np.random.default_rng(1)
    assert periodic.runs_of(np.zeros(200_000, np.int64)).tolist() == [[0, 200_000, 1]]
    x = rng.integers(0, 10**9, 300_000)
    assert periodic.runs_of(x).tolist() == []
    x[1000:101_000] = np.tile(x[1000:11_000], 10)
    assert periodic.runs_of(x).tolist() == [[1000, 101_000, 10_000]]
    y = np.concatenate([rng.integers(0, 2, 400), np.tile([1, 2, 3], 5), rng.integers(0, 3, 400)])
    whole = periodic.runs_of(y)
    monkeypatch.setattr(periodic, "PAIRS", 7)
    assert periodic.runs_of(y).tolist() == whole.tolist() == [[a, a + size, q] for a, size, q in brute(y.tolist())]


def test_hash_clashes_are_seen_and_done_again(monkeypatch):
    """A first base under which everything is equal: verification notices and another base is taken."""
    real, salts = periodic.Prefixes, []

    class Weak(real):
        def __init__(self, ids, salt):
            salts.append(salt)
            super().__init__(ids if salt else np.zeros_like(ids), salt)

    monkeypatch.setattr(periodic, "Prefixes", Weak)
    x = np.array([1, 2, 3, 1, 2, 4, 5, 5, 5, 5, 5, 5, 6, 1, 2, 1, 2, 1, 2, 1, 2])
    assert periodic.runs_of(x).tolist() == [[a, a + size, q] for a, size, q in brute(x.tolist())]
    assert salts == [0, 1]
