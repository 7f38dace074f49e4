"""Licence scans (8): Spark against the classifier by hand, held-out notices, odd rows."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from garimpo.llm import license as lic


@pytest.fixture(scope="module")
def model():
    return lic.train()


@pytest.mark.parametrize(
    "text,family",
    [
        ("Released under the MIT License.", "MIT"),
        ("Licensed under the Apache License, Version 2.0.", "Apache"),
        ("This work is licensed under the GNU General Public License, version 3.", "GPL"),
        ("Licensed under CC BY-NC 4.0.", "CC-BY-NC"),
        ("All rights reserved.", "Proprietary"),
        # not among the templates
        ("This package is licensed under the MIT license.", "MIT"),
        ("The code is released under the Apache License, Version 2.0", "Apache"),
        ("Distributed under the terms of the GNU General Public License, version 2.", "GPL"),
        ("Licensed under the GNU Affero General Public License", "AGPL"),
        ("This text is licensed under CC BY-SA 3.0.", "CC-BY-SA"),
        ("Apache-2.0", "Apache"),
        ("This program is licensed under the\nterms of the GNU General Public License as\npublished by the Free Software Foundation", "GPL"),
    ],
)
def test_notices(model, text, family):
    assert lic.classify(text, model)[0] == family


@pytest.mark.parametrize("text", ["He lost his driving licence in the snow.", "The license of the bar was not renewed this year.", "Ererhe thnd onor.", "", "Permission to speak was given to the second guest of the evening."])
def test_no_notices(model, text):
    assert lic.classify(text, model)[0] in (lic.NONE, "unknown")


@pytest.mark.parametrize(
    "text,family",
    [
        ("Available under CC-BY-SA 4.0.", "CC-BY-SA"),
        ("Available under CC-BY 4.0.", "CC-BY"),
        ("Dataset published under CC-BY-NC 4.0.", "CC-BY-NC"),
        ("Distributed under Apache 2.0.", "Apache"),
        ("Released under MIT.", "MIT"),
    ],
)
def test_notices_by_name_alone(spark, model, text, family):
    assert lic.classify(text, model)[0] == family
    assert [r.families for r in lic.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).collect()] == [[family]]


@pytest.mark.parametrize(
    "text",
    [
        "Eclipse Public License v 2.0", "ISC License", "Licensed under the OpenSSL license.", "Licensed under the Python Software Foundation License", "Released under the PostgreSQL License.", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND",
        "Ce programme est un logiciel libre ; vous pouvez le redistribuer suivant les termes de la Licence Publique Générale GNU", "Diese Datei steht unter der MIT-Lizenz", "La biblioteca está bajo la licencia Mozilla", "Die Bibliothek ist unter der BSD-Lizenz veröffentlicht", "Ce code est distribué sous licence BSD", "Licensed under the Universal Permissive License v 1.0",
    ],
)
def test_other_licences_and_languages_are_unknown(spark, model, text):
    assert lic.classify(text, model)[0] == "unknown"
    assert [(r.n_notices, r.n_unknown) for r in lic.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).collect()] == [(0, 1)]


def test_left_out_families_rarely_pass(model):
    """The calibration by itself: a model that has never seen a family takes few of its notices for another's."""
    assert lic.LEAST <= model.sure <= lic.MOST
    examples, passed, total = lic._examples(), 0, 0
    x = lic._features([t for _, t, _ in examples], model.vocabulary)
    y = [model.classes.index(c) for c, _, _ in examples]
    for family in ("MPL", "AGPL", "BSD", "CC0"):
        out = lic.np.array([c == family for c, _, _ in examples])
        w, b = lic._fit(x[~out], lic.np.array(y)[~out], len(model.classes), 80)
        for (_, text, _), row in zip([e for e, o in zip(examples, out, strict=True) if o], x[out], strict=True):
            z = (row @ w + b) / model.temperature
            z[model.classes.index(family)] = -lic.np.inf
            p = lic.np.exp(z - z.max())
            p /= p.sum()
            best = model.classes[int(p.argmax())]
            passed += best not in (lic.NONE, lic.OTHER) and p.max() >= model.sure and lic.likeness(lic.ngrams(text), best) >= lic.SHARED
            total += 1
    assert passed <= 0.15 * total


def test_texts_without_markers_are_none(model):
    """Every feature holds a marker, so leaving out texts without one changes nothing."""
    held = set(model.markers)
    assert all(held & set(g.split(" ")) for g in model.vocabulary) and not held & lic.COMMON
    rng = random.Random(5)
    pool = sorted({w for t in lic.NEGATIVES for w in lic.words(t)} | lic.COMMON | {"3", "2", "0", "1"})
    plain = [w for w in pool if w not in held]
    for _ in range(300):
        text = " ".join(rng.choice(plain) for _ in range(rng.randrange(0, 30)))
        assert lic.judge(text, model) == ({}, False, lic.score("", model)[1])


def by_hand(rows, model):
    out = []
    for d, t in rows:
        judged = [lic.judge(p.strip(), model) for p in re.split(lic.ENDS, t or "")]
        found = [(round(p, 9), f) for notices, _, _ in judged for f, p in notices.items()]
        best = max(found, default=(None, None))
        out.append((d, len(found), sorted({f for _, f in found}), sum(u for _, u, _ in judged), best[1], best[0]))
    return sorted(out, key=str)


def spark_rows(df):
    return sorted(((r.doc_id, r.n_notices, r.families, r.n_unknown, r.best_family, r.best_probability and round(r.best_probability, 9)) for r in df.collect()), key=str)


def test_scan_equals_hand(spark, model):
    rows = [(i, t) for i, t in enumerate([*[t for ts in lic.TEMPLATES.values() for t in ts], *lic.NEGATIVES, *lic.OTHERS])]
    rows += [(100, None), (101, ""), (102, "x\n\n Released under the MIT License. \nAll rights reserved.\nlicense"), (102, "x"), (None, "Licensed under CC BY-NC 4.0."), (103, "All rights reserved.\n" * 30), (104, "pad " * 50000 + "\nReleased under the MIT License.")]
    rows += [(999, "This work is licensed under\nthe GNU General Public\nLicense, version 3.\n\nMozilla Public License,\nversion 2.0\n \t\nEclipse Public License\nv 2.0")]
    rows += rows[:3]
    df = spark.createDataFrame([(a, b, 1.0) for a, b in rows], "doc_id long, text string, probability double")
    got = spark_rows(lic.scan(df.repartition(4), model))
    assert got == by_hand(rows, model)
    assert [(r[1], r[2], r[3]) for r in got if r[0] == 999] == [(2, ["GPL", "MPL"], 1)]
    assert lic.scan(df.limit(0), model).collect() == []


def test_whole_table(spark, model):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = spark_rows(lic.op8_license_paragraphs(spark, "/root/testdata/sf0.01"))
    assert got == by_hand(rows, model)
    planted = {d for d, t in rows if re.search(r"(?m)^(Released under the MIT|Licensed under|This work is licensed under|All rights reserved)", t or "")}
    assert {r[0] for r in got if r[1]} == planted


def apart(paragraph, model):
    """What a paragraph holds, from the model's numbers alone: (probability of each family, unknown)."""
    w = re.findall(r"[^\W_]+", paragraph.lower())
    grams = lambda x: {" ".join(x[i : i + n]) for n in (1, 2, 3) for i in range(len(x) - n + 1)}
    templates = {f: [grams(re.findall(r"[^\W_]+", v.lower())) for t in ts for v in [t, *([f"{o} {t.split(' under ', 1)[1]}" for o in lic.OPENINGS] if t.startswith(("Licensed under", "Released under")) else [])]] for f, ts in lic.TEMPLATES.items()}

    def look(words):
        own = grams(words)
        rows = [model.weights[model.vocabulary[g]] for g in own if g in model.vocabulary]
        z = [(b + sum(r[k] for r in rows) / math.sqrt(max(1, len(rows)))) / model.temperature for k, b in enumerate(model.bias)]
        e = [math.exp(v - max(z)) for v in z]
        family = model.classes[z.index(max(z))]
        alike = max((2 * len(own & t) / (len(own) + len(t)) for t in templates.get(family, ())), default=0)
        return family, max(e) / sum(e), alike, 1 - e[-1] / sum(e)

    family, p, alike, notice = look(w)
    good = lambda f, p, alike: f in lic.TEMPLATES and p >= model.sure and alike >= lic.SHARED
    if good(family, p, alike) and len(w) <= lic.LONGEST:
        return {family: round(p, 9)}, False
    found, unknown = [((-alike, -len(w), 0, family), p)] if good(family, p, alike) else [], notice >= model.wary
    for size, step in lic.WINDOWS:
        for i in {*range(0, len(w) - size + 1, step), len(w) - size} if len(w) > size else ():
            f, q, a, notice = look(w[i : i + size])
            if good(f, q, a):
                found.append(((-a, -size, i, f), q))
            elif notice >= model.wary and size >= 16 and len(w) > lic.LONGEST:
                unknown = True
    best = {}
    for key, _ in found:  # the best window at each word
        for at in range(key[2], key[2] - key[1]):
            best[at] = min(best.get(at, key), key)
    out = {}
    for key, q in found:
        if all(best[at] == key for at in range(key[2], key[2] - key[1])):
            out[key[3]] = max(out.get(key[3], 0), round(q, 9))
    return out, unknown and not out


def test_long_paragraphs_equal_a_plain_count(spark, model):
    """Paragraphs without a sentence end, with markers and notices all over, against a count written apart from the module."""
    rng = random.Random(11)
    prose = lambda n: ["".join(rng.choice("abdefilmnorstu") for _ in range(rng.randrange(2, 9))) if i % 10 else "license" for i in range(n)]
    rows = [(1, prose(700)), (2, prose(300) + "released under the mit license".split() + prose(200) + "licensed under cc by nc 4 0".split() + prose(100)), (3, "mit license".split() * 60), (4, "all rights reserved licensed under the apache license version 2 0".split() * 9)]
    got = {r.doc_id: r for r in lic.scan(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string"), model).collect()}
    for i, w in rows:
        families, unknown = apart(" ".join(w), model)
        assert (got[i].families, got[i].n_unknown) == (sorted(families), int(unknown)), i
        assert got[i].best_probability is None or round(got[i].best_probability, 9) == max(families.values())
    assert got[2].families == ["CC-BY-NC", "MIT"]


def test_bytes_of_windows_are_linear(spark, model):
    text = lambda n: " ".join("license" if i % 10 == 0 else f"w{i % 997}" for i in range(n))
    df = spark.createDataFrame([(n, text(n)) for n in (2000, 20_000, 200_000)], "n long, t string")
    held = {r.n: r.b for r in df.select("n", F.explode(lic._windows(F.col("t"), model)).alias("s")).groupBy("n").agg(F.sum(F.length("s.window")).alias("b")).collect()}
    assert held[20_000] < 11 * held[2000] and held[200_000] < 11 * held[20_000]


@pytest.mark.parametrize("text", ["The open source meeting grew quickly.", "The fee of the license was paid by the firm.", "They run an Apache server.", "He reserved all seats of the film.", "The software company provided the food.", "A hearing about the license was held."])
def test_prose_with_markers_is_no_notice(model, text):
    assert lic.classify(text, model)[0] == lic.NONE


@pytest.mark.parametrize("text,family", [("Available under MIT.", "MIT"), ("Published under MIT.", "MIT"), ("Licensed under the GNU GPL v2", "GPL"), ("Distributed under the terms of the BSD license.", "BSD")])
def test_other_openings_are_confirmed(model, text, family):
    assert lic.classify(text, model)[0] == family


def test_native_plan(spark):
    plan = lic.op8_license_paragraphs(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert "documents.parquet" not in plan  # the text was read once, into a staged table


def test_notices_inside_long_lines(spark, model):
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choice("abdefilmnorstu") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    notices = {"MIT": "Released under the MIT License", "Apache": "Licensed under the Apache License, Version 2.0", "GPL": "This work is licensed under the GNU General Public License, version 3", "CC-BY-NC": "Licensed under CC BY-NC 4.0", "CC-BY-SA": "Text is available under CC-BY-SA 4.0", "LGPL": "Licensed under the GNU Lesser General Public License, version 3", "Proprietary": "All rights reserved"}
    rows = [(i, f"{prose(before)} {text}{end} {prose(after)}", {family}) for i, (family, text, before, after, end) in enumerate((f, t, b, a, e) for f, t in notices.items() for b, a in ((20, 0), (300, 0), (200, 300), (0, 100)) for e in ("", "."))]
    rows += [
        (900, "c 2019 Example Media Group Ltd, registered in England and Wales under company number 12345678 with its office in the old town of London. All rights reserved.", {"Proprietary"}),
        (901, f"{prose(100)} Released under the MIT License. {prose(150)} Licensed under CC BY-NC 4.0 {prose(90)}", {"MIT", "CC-BY-NC"}),
        (902, " ".join(lic.NEGATIVES), set()),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r.doc_id: r for r in lic.scan(df, model).collect()}
    assert {d: set(r.families) for d, r in got.items()} == {d: f for d, _, f in rows}
    assert all(r.n_notices == len(r.families) for r in got.values())
    for d, text, _ in rows:
        judged = [lic.judge(t.strip(), model) for t in re.split(lic.ENDS, text)]
        assert got[d].n_unknown == sum(j[1] for j in judged)
        assert got[d].best_probability == pytest.approx(max((p for j in judged for p in j[0].values()), default=None))
