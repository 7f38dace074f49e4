"""Mixing (13): exact quotas, distribution of the draws, every word's count, and the mix read back."""

import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from garimpo.llm import mixing


def corpus(seed, n=300):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = "big" if rng.random() < 0.4 else rng.choice(["a", "b", "é", "Z", "", None, "tiny"] if i % 40 == 0 else ["a", "b", "é", "Z"])
        words = [f"{i}.{j}" for j in range(rng.choice((0, 1, 7, 30, 200)))]
        rows.append((i, rng.choice((" ", "\n\t")).join(words), source))
    rows += [(7, "x y z", "a")] * 5 + [(None, "u v", "b"), (None, "u v", "b"), (None, "w", None), (7, "other text", "a"), (900, None, "a"), (901, "", "none"), (902, " \n ", "none")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(a, b, c, 5, "k") for a, b, c in rows], "doc_id long, text string, source string, size int, rank string")


def brute_targets(sizes, weights=(1, 2, 3), ceiling=3):
    """Word shares by weight; what is over a ceiling is shared anew, in exact fractions."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    done, words = {}, Fraction(sum(sizes.values()))
    while True:
        free = [s for s in order if s not in done]
        share = (words - sum(done.values())) / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if share * weight[s] > ceiling * sizes[s]]
        if not over:
            return done | {s: share * weight[s] for s in free}
        done |= {s: Fraction(ceiling * sizes[s]) for s in over}


def size_of(rows):
    out = Counter()
    for _, t, s in rows:
        out[s] += len((t or "").split())
    return out


@pytest.fixture(scope="module")
def made(spark):
    rows = corpus(4)
    mixed = mixing.mix(frame(spark, rows).repartition(5), shard_words=1500)
    return rows, mixed, [r.asDict() for r in mixing.taken(mixed).collect()]


def test_targets_and_words_taken(made):
    rows, mixed, got = made
    want = brute_targets(size_of(rows))
    found = {r.source: r for r in mixed.sources.collect()}
    assert {s: r.source_size for s, r in found.items()} == dict(size_of(rows))
    assert all(math.isclose(found[s].target, t, rel_tol=1e-12) for s, t in want.items()) and any(t == 3 * size_of(rows)[s] > 0 for s, t in want.items())
    assert sorted((r["doc_id"], r["size"]) for r in got if r["doc_id"] is not None) == sorted((d, len((t or "").split())) for d, t, _ in rows if d is not None) and len(got) == len(rows)
    by_target = Counter()
    for r in got:
        by_target[r["target"]] += r["taken"]
        assert r["taken"] <= 3 * r["size"]
    words = Counter()
    for r in found.values():
        words[r.target] += round(r.target)
    assert by_target == words


def test_every_word_is_taken_as_often_give_or_take_once(made):
    rows, mixed, _ = made
    sources = {r["rank"]: r for r in mixed.sources.collect()}
    counts = defaultdict(Counter)
    shards = defaultdict(set)
    for p in mixed.pieces.collect():
        for i in range(p.at + p.first, p.at + p.first + p.length):
            counts[p["rank"]][i] += 1
            assert (p.times, i) not in shards[p["rank"]]
            shards[p["rank"]].add((p.times, i))
    for rank, s in sources.items():
        assert sum(counts[rank].values()) == s.words
        assert all(s.rounds <= counts[rank][i] <= s.rounds + 1 for i in range(s.source_size))
        assert all(0 <= i < s.source_size for i in counts[rank])


def test_shards_are_even_and_their_order_is_whole(made):
    _, mixed, _ = made
    placed = mixed.pieces.select("shard", "place").distinct().groupBy("shard").agg(F.count("*").alias("n"), F.min("place").alias("lo"), F.max("place").alias("hi")).collect()
    total = sum(s.words for s in mixed.sources.collect())
    blocks = sum(s.draws for s in mixed.sources.collect())
    assert len(placed) == -(-total // 1500) and sum(r.n for r in placed) == blocks
    assert all((r.lo, r.hi) == (0, r.n - 1) for r in placed) and max(r.n for r in placed) - min(r.n for r in placed) <= 4


def test_texts_are_the_words_of_the_pieces(spark, made):
    rows, mixed, got = made
    out = mixing.texts(frame(spark, rows), mixed).collect()
    words = Counter()
    for r in out:
        key = r.doc_id, r.source
        text = next(t for d, t, s in rows if (d, s) == key and r.text.split(" ")[0] in t.split())
        assert text.split()[r.first : r.first + len(r.text.split(" "))] == r.text.split(" ")
        words[r.doc_id] += len(r.text.split(" "))
    want = Counter()
    for r in got:
        want[r["doc_id"]] += r["taken"]
    assert words == +want


def test_reruns_agree_whatever_the_partitions(spark, made):
    rows, _, got = made
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    again = mixing.taken(mixing.mix(frame(spark, shuffled).repartition(2), shard_words=1500)).collect()
    key = lambda r: str(sorted(r.items()))
    assert sorted(got, key=key) == sorted((r.asDict() for r in again), key=key)
    other = mixing.taken(mixing.mix(frame(spark, rows), shard_words=1500, seed=1)).collect()
    assert sorted(got, key=key) != sorted((r.asDict() for r in other), key=key)


def test_empty_tables_and_tables_without_words(spark):
    assert mixing.taken(mixing.mix(frame(spark, []))).collect() == []
    got = mixing.taken(mixing.mix(frame(spark, [(1, None, "a"), (1, None, "a"), (None, "", None)]))).collect()
    assert sorted((r.doc_id is None, r.taken, r.target) for r in got) == [(False, 0, 0.0), (False, 0, 0.0), (True, 0, 0.0)]
    got = mixing.taken(mixing.mix(frame(spark, [(1, "one", "a")]))).collect()
    assert [(r["size"], r.taken, r.target) for r in got] == [(1, 1, 1.0)]


@pytest.mark.parametrize("total,marked,drawn", [(10, 4, 5), (60, 1, 7), (40, 39, 20), (500, 120, 250), (3000, 1000, 30)])
def test_draws_follow_the_hypergeometric_distribution(spark, total, marked, drawn):
    steps = 4000
    u = (F.col("id") + 0.5) / steps
    got = Counter({r.x: r.n for r in spark.range(steps).select(mixing.hypergeometric(*[F.lit(v).cast("long") for v in (total, marked, drawn)], u).alias("x")).groupBy("x").agg(F.count("*").alias("n")).collect()})
    for x in range(max(0, drawn + marked - total), min(marked, drawn) + 1):
        p = math.comb(marked, x) * math.comb(total - marked, drawn - x) / math.comb(total, drawn)
        assert abs(got[x] - p * steps) <= 1.001, x
    assert sum(got.values()) == steps


def test_large_draws_are_right_to_a_few_deviations(spark):
    n, k, d = 10**10, 3 * 10**9, 5 * 10**9
    got = [r.x for r in spark.range(1, 6).select(mixing.hypergeometric(F.lit(n), F.lit(k), F.lit(d), F.col("id") / 6).alias("x")).collect()]
    sd = math.sqrt(d * k / n * (n - k) / n * (n - d) / (n - 1))
    assert sorted(got) != got or len(set(got)) == 5
    assert all(abs(x - k // 2) < 8 * sd for x in got)


def test_quotas_add_up_at_every_leaf(spark):
    root = spark.sql("select array(7L, 0L, 100L, 13L, 1L) as quotas")
    got = sorted(mixing.leaves(root, 9, 5).collect())
    assert [r.shard for r in got] == list(range(9))
    at = [0] * 5
    for r in got:
        assert r.froms == at and min(r.quotas) >= 0
        at = [a + b for a, b in zip(at, r.quotas, strict=True)]
    assert at == [7, 0, 100, 13, 1] and {sum(r.quotas) for r in got} <= {12, 13, 14, 15}


def test_permutations_are_bijections(spark):
    for n in (1, 2, 3, 7, 64, 1000):
        got = [r.x for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3)).alias("x")).collect()]
        assert sorted(got) == list(range(n)) and (n < 64 or got != sorted(got))


def test_main_path_is_native(spark):
    mixed = mixing.mix(frame(spark, corpus(2)))
    for df in (mixing.taken(mixed), mixed.sources, mixed.documents, mixed.pieces):
        plan = df._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoop", "ExistingRDD"))


def test_draws_are_never_broadcast(spark):
    pieces = mixing.mix(frame(spark, corpus(2))).pieces
    plan = pieces._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [rank" in plan


def test_bad_parameters(spark):
    for bad in ({"weights": ()}, {"weights": (1, 0)}, {"ceiling": 0}):
        with pytest.raises(ValueError):
            mixing.mix(frame(spark, []), **bad)
