"""Near duplicates (10) against all pairs."""

import random
import re

import numpy as np
import pytest

from garimpo.llm import common, minhash


def brute(rows, k, percent):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    sets = {d: shingles(t) for d, t in rows}  # the rows' ids are distinct
    names = sorted(sets)
    root = {d: d for d in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return sorted((d, len(sets[d]), find(d), find(d) == d) for d in names)


def corpus(seed, n=150, edits=(0, 1, 2, 4, 8, 20)):
    rng = random.Random(seed)
    vocabulary = [f"W{i}é" for i in range(800)]
    rows, bases = [], [[rng.choice(vocabulary) for _ in range(rng.choice((3, 20, 60, 150)))] for _ in range(6)]
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice(edits)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i, rng.choice((" ", "\t", " \n")).join(w)))
    return rows + [(1000, None), (1001, ""), (1002, " \n"), (1003, "One"), (1004, "one"), (1005, "a b"), (1006, "A\x0bB"), (1007, "a\x1cb"), (1008, "long " * 5000)]


def frame(spark, rows):
    return spark.createDataFrame([(a, b, "s", 1) for a, b in rows], "doc_id long, text string, twin string, n int")


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_components_equal_all_pairs(spark, monkeypatch, k, percent):
    monkeypatch.setattr(minhash, "TILE_DOCS", 7)  # several tiles for each family
    rows = corpus(k)
    got = sorted(tuple(r) for r in minhash.near_duplicates(frame(spark, rows).repartition(3), k, percent).collect())
    assert got == brute(rows, k, percent)


def test_null_ids_repeats_and_nothing(spark):
    rows = [(None, "x y z"), (None, "x y z"), (5, "x y z"), (5, "x y z"), (2, "x y z")]
    got = sorted((tuple(r) for r in minhash.near_duplicates(frame(spark, rows), 3, 85).collect()), key=str)
    assert got == sorted([(None, 1, None, True)] * 2 + [(5, 1, 2, False)] * 2 + [(2, 1, 2, True)], key=str)
    assert minhash.near_duplicates(frame(spark, []), 3, 85).collect() == []


def test_sketch_estimates_similarity_and_is_full():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 50, 4000):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        assert (minhash.sketch(a, 352) != np.uint64(2**64 - 1)).all()
    a = rng.integers(0, 2**63, 1000).astype(np.uint64)
    b = np.concatenate([a[:850], rng.integers(0, 2**63, 150).astype(np.uint64)])
    assert abs((minhash.sketch(a, 4000) == minhash.sketch(b, 4000)).mean() - 850 / 1150) < 0.03


def test_components_of_paths_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 201), (201, 202), (202, 200), (9, 9), (None, 3)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(40)}, 200: 200, 201: 200, 202: 200}


def test_long_words_that_power_sums_confuse(spark):
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    rows = [(1, "".join("ab"[b] for b in bits)), (2, "".join("ba"[b] for b in bits))]
    assert sorted(tuple(r) for r in minhash.near_duplicates(frame(spark, rows), 3, 85).collect()) == [(1, 1, 1, True), (2, 1, 2, True)]


def brute_rows(rows, k, percent):
    """Components of documents where rows that share a doc_id are one node; null ids apart."""
    single = [(i, t) for i, (d, t) in enumerate(rows) if d is not None]
    by_row = {i: (n, c) for i, n, c, _ in brute(single, k, percent)}
    links = [(rows[i][0], rows[c][0]) for i, (_, c) in by_row.items()]
    component = {d: d for d, _ in rows if d is not None}
    for _ in rows:
        for a, b in links:
            component[a] = component[b] = min(component[a], component[b])
    sizes = brute([(i, t) for i, (_, t) in enumerate(rows)], k, percent)
    return sorted(((d, sizes[i][1], component.get(d), d is None or component[d] == d) for i, (d, _) in enumerate(rows)), key=str)


def test_different_texts_under_one_id(spark):
    x, z, q = (" ".join(f"{c}{i}" for i in range(30)) for c in "xzq")
    rows = [(3, x), (5, x), (5, z), (4, z)]
    got = sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(frame(spark, rows), 3, 85).collect())
    assert got == [(3, 3), (4, 3), (5, 3), (5, 3)]
    rng = random.Random(4)
    bases = [[f"{c}{i}" for i in range(40)] for c in "abcdef"]
    rows = [(rng.choice([None, *range(20)]), " ".join(rng.choice(bases) + [f"n{rng.randrange(3)}"])) for _ in range(24)]
    rows += [(6, ""), (6, q), (2, q), (30, None), (30, q), (31, None), (31, ""), (None, ""), (None, q), (8, z), (8, z)]
    got = sorted((tuple(r) for r in minhash.near_duplicates(frame(spark, rows).repartition(3), 3, 85).collect()), key=str)
    assert got == brute_rows(rows, 3, 85)


def test_one_of_each_goes_by_text(spark):
    x, z, q = (" ".join(f"{c}{i}" for i in range(30)) for c in "xzq")
    kept = lambda rows: sorted(((r.doc_id, r.text) for r in minhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, mark int, best int"), 5, 80).collect()), key=str)
    assert kept([(3, x, 1, 1), (5, x, 1, 1), (5, z, 1, 1)]) == [(3, x), (5, z)]
    assert kept([(3, x, 1, 1), (5, x, 1, 1), (5, z, 1, 1), (4, z, 1, 1)]) == [(3, x), (4, z)]
    rows = [(None, q, 1, 1), (None, q + " end", 1, 1), (None, x, 1, 1), (7, x, 1, 2), (7, x, 1, 3), (7, x.upper(), 1, 1), (1, None, 1, 1), (None, "", 1, 1), (2, "", 1, 1)]
    assert kept(rows) in ([(1, None), (2, ""), (7, t), (None, ""), (None, u)] for t in (x, x.upper()) for u in (q, q + " end"))
    assert len(kept(rows * 40)) == 3 * 40 + 2
