"""Language ID (7) and quality (4): held-out accuracy, brute force and odd rows."""

import random
from collections import Counter

import numpy as np
import pytest
import zstandard

from garimpo.llm import langid, quality

TESTDATA = "/root/testdata/sf0.01"


def test_ngrams_equal_counter():
    x = langid.letters("Ab, cA-É1É")
    words = ["ab", "ca", "é", "é"]
    want = Counter("".join(words))
    padded = " " + " ".join(words) + " "
    want.update(padded[i : i + 2] for i in range(len(padded) - 1))
    want.update(padded[i : i + 3] for i in range(len(padded) - 2))
    grams, counts = langid.counted(langid.ngrams(x))
    name = lambda g: "".join(chr(c).replace("\x01", " ") for c in (g >> 42, g >> 21 & 0x1FFFFF, g & 0x1FFFFF) if c)
    assert {name(g): n for g, n in zip(grams.tolist(), counts.tolist(), strict=True)} == want


def test_profiles_equal_out_of_place_by_hand(spark):
    rows = [("x", "abab abc"), ("y", "zz zq"), (None, "nope"), ("x", None)]
    p = langid.train(spark.createDataFrame(rows, "lang string, text string"), 50)
    for text in ("ab", "zzz", "abz", "Q"):
        mine = langid.order(*langid.counted(langid.ngrams(langid.letters(text))), 50).tolist()
        cost = {}
        for lang, texts in (("x", ["abab abc"]), ("y", ["zz zq"])):
            own = langid.order(*langid.counted(np.concatenate([langid.ngrams(langid.letters(t)) for t in texts])), 50).tolist()
            cost[lang] = sum(abs(own.index(g) - i) if g in own else 50 for i, g in enumerate(mine))
        assert p.predict(text)[0] == min(sorted(cost), key=cost.get)


def test_language_of_odd_rows(spark):
    p = langid.train(spark.createDataFrame([("x", "ab")], "lang string, text string"))
    docs = spark.createDataFrame([(1, None, "q"), (2, "", "q"), (3, "12 .", "q"), (4, "ab", "q"), (None, "ab", "q"), (4, "ab", "q"), (5, "ab " * 40000, "q")], "doc_id long, text string, score string")
    got = sorted(((r.doc_id, r.lang_pred) for r in langid.predict(docs, p).collect()), key=str)
    assert got == sorted([(1, "und"), (2, "und"), (3, "und"), (4, "x"), (None, "x"), (4, "x"), (5, "x")], key=str)
    assert langid.predict(docs.limit(0), p).collect() == []
    nothing = langid.train(docs.limit(0).selectExpr("score as lang", "text"))
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}


def test_language_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{TESTDATA}/documents.parquet").collect()}
    got = [r for r in langid.op7_rank_order_language(spark, TESTDATA).collect() if r.held_out]
    assert all(0 <= r.score <= 1 for r in got)
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in got]) > 0.97


def test_quality_accuracy(spark):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{TESTDATA}/labels.parquet").collect()}
    rows = quality.op4_compression_quality(spark, TESTDATA).collect()
    assert len(rows) == spark.read.parquet(f"{TESTDATA}/documents.parquet").count()
    got = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([truth[r.doc_id] == r.predicted for r in got]) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


@pytest.mark.parametrize("kinds", [(), (1,), (0,), (0, 1)])
def test_quality_of_few_labels(spark, kinds):
    rng = random.Random(0)
    docs = spark.createDataFrame([(i, " ".join(rng.choice("abcdefg") * 3 for _ in range(30)), "x") for i in range(10)] + [(50, None, "x"), (51, "", "x"), (None, "z", "x"), (52, "long " * 50000, "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, k, 0) for k in kinds for i in range(k * 5, k * 5 + 5)] + [(3, None, 1), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == 14 and all(0 <= r.score <= 1 for r in got)
    assert quality.score(docs.limit(0), model).collect() == []


def test_quality_equals_scores_by_hand(spark):
    """Dictionaries, sizes, weights and the fitted curve recomputed with zstandard alone; texts of any length take part."""
    rng = random.Random(3)
    words = {1: [f"good{i}" for i in range(60)], 0: [f"bad{i}" for i in range(60)]}
    rows = [(i, " ".join(rng.choice(words[i % 2] + ["and", "the"]) for _ in range(9000 if i < 2 else rng.choice((3, 40, 200)))), i % 2) for i in range(160)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    model = quality.train(docs, labels)

    def parts(data):
        return [data[i : i + 512] for i in range(0, len(data), 512)]

    def compressor(texts):
        trained = zstandard.train_dictionary(32_768, [p for t in texts for p in parts(t)]).as_bytes()
        return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(trained), level=3, write_content_size=False)

    def measure(some, pair):
        good, bad = (sum(len(c.compress(p)) for p in some) for c in pair)
        return (bad - good) / (bad + good)

    texts = {y: [t.encode() for i, t, z in sorted(rows) if z == y] for y in (1, 0)}
    assert max(map(len, texts[1] + texts[0])) > 40_000
    halves = [[compressor(texts[y][k::2]) for y in (1, 0)] for k in (0, 1)]
    x, y = zip(*[(measure(parts(t), halves[1 - k]), label) for k in (0, 1) for label in (1, 0) for t in texts[label][k::2]], strict=True)
    x, y = np.array(x), np.array(y)
    w = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())  # half of all labels are good
    z = (x - (w * x).sum()) / x.std()

    def loss(a, b):
        return (w * np.logaddexp(0, np.where(y == 1, -1, 1) * (a * z + b))).sum() + 1e-3 / 2 * (a * a)

    slope, intercept = model.slope * x.std(), model.intercept + model.slope * (w * x).sum()
    best = loss(slope, intercept)
    assert all(loss(slope + da, intercept + db) >= best - 1e-9 for da in (-0.05, 0, 0.05) for db in (-0.05, 0, 0.05))
    final = [compressor(texts[k]) for k in (1, 0)]
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    for i, t, _ in rows:
        assert abs(got[i] - 1 / (1 + np.exp(-(model.slope * measure(parts(t.encode()), final) + model.intercept)))) < 1e-12


def test_rounds_of_dictionaries_agree_with_one(spark):
    """Buckets of a few pieces: several rounds, whole texts, the same rows whatever the partitions, and as good a model."""
    rng = random.Random(5)
    words = {1: [f"good{i}" for i in range(60)], 0: [f"bad{i}" for i in range(60)]}
    rows = [(i, " ".join(rng.choice(words[i % 2] + ["and", "the"]) for _ in range(4000 if i < 2 else 60))) for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    models = [quality.train(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), labels, bucket=bucket) for n, bucket in ((3, 4096), (7, 4096), (2, quality.BUCKET))]
    assert (models[0].good, models[0].bad, models[0].slope) == (models[1].good, models[1].bad, models[1].slope)
    for m in models:
        assert all((m.score(t.encode()) > 0.5) == (i % 2 == 1) for i, t in rows)


def test_repeated_ids_stay_within_the_bound(spark):
    """An id in a thousand rows of either table is one row of the sample, with the text of the least hash."""
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "two"), (3, None)], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(1, 1)] * 300 + [(1, 0), (2, 0), (3, 1)], "doc_id long, quality int")
    sample, share = quality.sampled(docs, labels, 10)
    got = sorted((r.doc_id, r.quality) for r in sample.collect())
    assert got == [(1, 0), (1, 1), (2, 0)] and abs(share - 301 / 303) < 1e-12
    assert len({r.text for r in sample.where("doc_id = 1").collect()}) == 1
    assert quality.sampled(docs, labels, 1)[0].count() <= 2


def test_language_by_an_independent_count(spark):
    """Profiles, ranks and distances recomputed from strings and counters."""
    rng = random.Random(8)
    rows = [(lang, " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))) for _ in range(40)) + ", 7É!") for lang, letters in (("a", "abcdeé"), ("b", "cdefgß"), ("c", "XYZabc")) for _ in range(8)]
    p = langid.train(spark.createDataFrame(rows, "lang string, text string").repartition(3), 30)

    def grams(texts):
        c = Counter()
        for t in texts:
            line = " " + " ".join("".join(x.lower() if x.isalpha() else " " for x in t).split()) + " "
            if line.strip():
                c.update(line[i : i + n] for n in (1, 2, 3) for i in range(len(line) - n + 1) if line[i : i + n] != " ")
        return c

    def ranking(c):  # by count, then shorter ones first, then by characters (a blank before any letter)
        return sorted(c, key=lambda g: (-c[g], len(g), [0 if x == " " else ord(x) for x in g]))[:30]

    profiles = {lang: ranking(grams([t for k, t in rows if k == lang])) for lang in "abc"}
    for text in [t for _, t in rows] + ["abc", "zzz", "É", "ß d", "a-b-c 12", "cde cde cde"]:
        mine = ranking(grams([text]))
        cost = {lang: sum(abs(own.index(g) - i) if g in own else 30 for i, g in enumerate(mine)) for lang, own in profiles.items()}
        assert p.predict(text)[0] == min("abc", key=cost.get)
