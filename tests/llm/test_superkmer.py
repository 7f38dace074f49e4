"""Substring dedup (5) against a dictionary of all windows."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from garimpo.llm import common, superkmer


def brute(rows, k):
    texts = [(d, [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t or "") if w]) for d, t in rows]
    seen = Counter(tuple(w[i : i + k]) for _, w in texts for i in range(len(w) - k + 1))
    out = []
    for d, w in texts:
        gone = set()
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i : i + k])] > 1:
                gone.update(range(i, i + k))
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=80):
    rng = random.Random(seed)
    vocabulary = [f"w{i}É" for i in range(300)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.choice((4, 5, 9, 40)))] for _ in range(8)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randrange(6)):
            words += rng.choice(passages) if rng.random() < 0.4 else [rng.choice(vocabulary) for _ in range(rng.randrange(30))]
        rows.append((i, rng.choice((" ", "\n", "\t ")).join(words)))
    return rows + [(500, None), (501, ""), (502, "x " * 90), (503, "ab " * 60 + "cd"), (504, "a b a b a b a b a b a"), (None, "solo " * 3), (505, "Case a b c d e f"), (506, "case a b c d e f")]


def frame(spark, rows):
    return spark.createDataFrame([(a, b, 1, "y") for a, b in rows], "doc_id long, text string, bucket int, name string")


@pytest.mark.parametrize("k,m,held", [(5, 2, 10**7), (5, 2, 2000), (5, 5, 1), (1, 1, 500), (35, 6, 5000)])
def test_equals_brute_force(spark, k, m, held):
    rows = corpus(k + held)
    rows += rows[3:6]  # repeated rows
    got = superkmer.remove_repeats(frame(spark, rows).repartition(3), k, m, held)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str) == brute(rows, k)
    for r in got.collect():
        kept = r.kept.split() if r.n_removed == 0 else r.kept.split(" ") if r.kept else []
        assert len(kept) == r.n_words - r.n_removed


def test_nothing_and_one_hot_text(spark):
    assert superkmer.remove_repeats(frame(spark, [])).collect() == []
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(i, text if i % 3 else f"{text} own{i}") for i in range(200)]
    got = superkmer.remove_repeats(frame(spark, rows).repartition(9), 35, 6, 3000).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, 35)


def test_texts_with_one_checksum_under_one_id(spark):
    """Different texts with equal crc32 and equal or no ids are told apart; rows equal in both repeat all over."""
    passage = " ".join(f"p{i}" for i in range(8))
    seen, twins = {}, []
    i = 0
    while len(twins) < 2:  # a birthday search: two texts, one with the passage, with one crc32
        for text in (f"{passage} a{i} b{i} c{i}", f"x{i} y{i} z{i}"):
            other = seen.setdefault(zlib.crc32(text.encode()), text)
            if other != text and len(other.split()) != len(text.split()):
                twins.append((other, text))
        i += 1
    for name in (None, 7):
        rows = [(name, t) for pair in twins for t in pair] + [(1, passage + " end"), (name, twins[0][1])]
        got = superkmer.remove_repeats(frame(spark, rows).repartition(3), 5, 2, 10**6)
        assert sorted((tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str) == brute(rows, 5)
    rows = [(None, f"{passage} tail{i % 2}") for i in range(200)] + [(4, "q " * 3 + passage)]
    for held in (10**6, 1):
        got = superkmer.remove_repeats(frame(spark, rows).repartition(3), 5, 2, held)
        assert sorted((tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str) == brute(rows, 5)


@pytest.mark.parametrize("slices", [1, 7])
def test_windows_by_hash_equal_windows_as_strings(monkeypatch, slices):
    """Large groups: sorted by hash, some at a time, with and without clashes of hashes; as the strings themselves say."""
    rng = random.Random(slices)
    words = [b"a", b"b", b"cc", "é".encode()]
    entries = []
    for _ in range(300):
        n = rng.randrange(1, 9)
        entries.append((b" ".join(rng.choice(words) for _ in range(n + 4)), n, int(rng.random() < 0.1)))
    want = superkmer.repeated_windows(entries[:20], 5), None
    monkeypatch.setattr(superkmer, "FEW_WINDOWS", 10**9)
    plain = superkmer.repeated_windows(entries, 5)
    assert superkmer.repeated_windows(entries[:20], 5) == want[0]
    monkeypatch.setattr(superkmer, "FEW_WINDOWS", 0)
    monkeypatch.setattr(superkmer, "HASHED_BYTES", 100)
    monkeypatch.setattr(superkmer, "MOST_WINDOWS", -(-sum(e[1] for e in entries) // slices))
    assert superkmer.repeated_windows(entries, 5) == plain
    real = common.rolling
    monkeypatch.setattr(superkmer.common, "rolling", lambda h, n: real(h, n) % np.uint64(3))  # nearly all hashes clash
    assert superkmer.repeated_windows(entries, 5) == plain


def test_spans_unite():
    rng = random.Random(2)
    for _ in range(200):
        flat = [x for _ in range(rng.randrange(1, 9)) for a in [rng.randrange(50)] for x in (a, a + rng.randrange(1, 9))]
        want = sorted({y for a, b in zip(flat[::2], flat[1::2], strict=True) for y in range(a, b)})
        pairs = np.frombuffer(superkmer._united(flat), "<u4").reshape(-1, 2).tolist()
        assert [y for a, b in pairs for y in range(a, b)] == want and all(p[1] < q[0] for p, q in zip(pairs, pairs[1:], strict=False))


def test_leftmost_minima():
    x = np.random.default_rng(0).integers(0, 9, 200).astype(np.uint64)
    for w in (1, 2, 5, 30):
        assert superkmer.leftmost_minima(x, w).tolist() == [i + int(np.argmin(x[i : i + w])) for i in range(len(x) - w + 1)]


def test_hot_minimisers_rank_last(spark, monkeypatch):
    """A common line in ever other surroundings doesn't gather its windows, and the result stays exact."""
    rng = random.Random(3)
    line = "the very common line of all documents here"
    rows = [(i, " ".join([f"a{rng.randrange(10**6)}" for _ in range(30)] + line.split() + [f"b{rng.randrange(10**6)}" for _ in range(30)])) for i in range(300)]
    rows += [(900 + i, rows[i][1]) for i in range(5)]
    df = frame(spark, rows).selectExpr("doc_id", "text")
    hot = superkmer.hot_minimisers(df, 35, 6, 100)
    assert 1 <= len(hot) <= 3
    grams = [superkmer.super_kmers(common.hash_words(t.encode())[0], 35, 6, hot)[2] for _, t in rows]
    assert not any((g & superkmer.HOT_BIT).any() for g in grams)
    got = superkmer.remove_repeats(df, 35, 6).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, 35)


def test_word_hashes_depend_on_the_word_alone():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randrange(1, 40))).encode() for _ in range(3000)] + [b"x" * 500, b"x" * 256, b"x" * 257, b"\0", b"\0\0", b"a", b"a\0"]
    want = {w: int(common.hash_words(w)[0][0]) for w in words}
    assert len(set(want.values())) == len(want)
    text = b" ".join(words)
    hashes, starts, ends = common.hash_words(text)
    assert [text[a:b] for a, b in zip(starts, ends, strict=True)] == words and hashes.tolist() == [want[w] for w in words]


def test_word_hashes_have_no_built_in_clash():
    """Thue-Morse words and their complements, which any sum of byte values times powers modulo 2^64 confuses."""
    for n in (8, 64, 256, 1024, 4096):
        bits = [bin(i).count("1") % 2 for i in range(n)]
        both = [bytes(97 + b for b in bits), bytes(98 - b for b in bits)]
        assert len(set(common.hash_words(b" ".join(both))[0].tolist())) == 2
    assert len(set(common.hash_words(b" ".join(bytes([97 + a, 97 + b]) * 512 for a in range(20) for b in range(20)))[0].tolist())) == 400
