"""Embedding near-dedup (9) against all pairs in double precision."""

import numpy as np
import pytest

from garimpo.llm import embeddings


def brute(rows, threshold=0.9):
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {k: 0 for k in range(len(good))}
    root = list(range(len(good)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for p in range(len(good)):
        for q in range(p + 1, len(good)):
            a, b = np.array(good[p][1], float), np.array(good[q][1], float)
            same = good[p][0] == good[q][0]
            linked = len(a) == len(b) and ((a == b).all() or a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold)
            if linked:
                links[p] += 1
                links[q] += 1
            if linked or same:
                root[max(find(p), find(q))] = min(find(p), find(q))
    least = {}
    for k, (i, _) in enumerate(good):
        least[find(k)] = min(i, least.get(find(k), i))
    used = {id(v) for _, v in good}
    out = [(i, links[k], least[find(k)], i == least[find(k)]) for k, (i, _) in enumerate(good)]
    return sorted(out + [(i, 0, i, True) for i, v in rows if v is None or id(v) not in used or i is None], key=str)


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 1) for i, v in rows], f"vec_id long, embedding array<{kind}>, n int")


@pytest.mark.parametrize("seed,tile,kind", [(0, 4096, "float"), (1, 40, "float"), (2, 25, "double")])
def test_equals_all_pairs(spark, seed, tile, kind, monkeypatch):
    monkeypatch.setattr(embeddings, "STRIP", 16)
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 24))
    monkeypatch.setattr(embeddings, "CHUNK", 40)
    rows = [(i, np.float32(centres[rng.integers(12)] + rng.normal(size=24) * rng.choice([0.05, 0.25, 0.4, 2])).tolist()) for i in range(260)]
    rows += [(300 + i, list(rows[5][1])) for i in range(30)]
    rows += [(400, None), (401, []), (402, [0.0] * 24), (409, [0.0, 1.0] * 12), (410, [-0.0, 1.0] * 12), (403, [None] + [1.0] * 23), (404, [float("nan")] * 24), (405, [float("inf")] * 24), (406, [1.0, 2.0]), (407, [2.0, 4.0]), (407, list(rows[9][1])), (None, list(rows[5][1])), (408, (np.array(rows[7][1]) * 1e30).tolist() if kind == "double" else list(rows[7][1]))]
    got = embeddings.near_vectors(frame(spark, rows, kind).repartition(3), tile=tile)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_nothing(spark):
    assert embeddings.near_vectors(frame(spark, [])).collect() == []
    assert [tuple(r) for r in embeddings.near_vectors(frame(spark, [(1, None)])).collect()] == [(1, 0, 1, True)]


def test_tile_pair_loses_nothing():
    rng = np.random.default_rng(0)
    for scale in (0.02, 0.2, 1.0):
        a = embeddings.unit(rng.normal(size=(80, 64)) * np.linspace(1, scale, 64))
        b = embeddings.unit(a[:60] + rng.normal(size=(60, 64)) * 0.05)
        found = set(zip(*(v.tolist() for v in embeddings.tile_pair(a, b, 0.9)), strict=True))
        assert set(zip(*(v.tolist() for v in np.nonzero(a @ b.T >= 0.9)), strict=True)) <= found


def test_clustered_vectors_travel_less_than_to_all_tiles(spark):
    """Cells that can't reach each other are never sent to meet; nothing is lost by that."""
    rng = np.random.default_rng(3)
    centres = np.eye(16)[:10]
    rows = [(i, (centres[i % 10] + rng.normal(size=16) * 0.02).tolist()) for i in range(400)]
    df = frame(spark, rows, "double")
    got = embeddings.near_vectors(df, tile=40)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)
    basis = embeddings.Basis(embeddings.unit(np.array([v for _, v in rows])), 64)
    near = basis.turn(embeddings.unit(np.array([v for _, v in rows]))) @ basis.centres.T
    radius = np.array([np.arccos(np.clip(near[near.argmax(1) == k].max(1).min(), -1, 1)) if (near.argmax(1) == k).any() else 0 for k in range(len(basis.centres))])
    assert embeddings.reachable(basis.centres, radius, 0.9).mean() < 0.2


def test_tiles_hold_cells():
    counts = {0: 5, 1: 3, 2: 100, 3: 4, 4: 7}
    dealt = embeddings.tiles_of(counts, 10)
    assert [(c, first, parts) for c, first, parts, _ in dealt] == [(0, 0, 1), (1, 0, 1), (2, 1, 10), (3, 11, 1), (4, 12, 1)]
