"""Licence scans: a trained paragraph classifier, native Spark on the main path.

A multinomial logistic regression over sparse word n-grams (one to three words)
tells licence families apart, with a class for other licences and one for text
that is none.  Paragraphs are sentences, across line breaks, up to blank lines.
Where the whole doesn't settle a paragraph, or it is longer than any template,
overlapping windows of its words are scored too.

Only n-grams that hold a ``marker`` are features: any word of a known notice that
isn't a common one.  A text without markers has no feature, and its class is
``none`` by the biases alone; leaving such texts out of the scan changes nothing.

A predicted family is confirmed when the n-grams of the text and of one of the
family's templates agree, counted on both sides.  The least probability of a
family is calibrated on families left out of training: notices of a family that
the model has never seen must not pass for another one.  What is a notice of any
kind with a probability that tells left-out notices and left-out prose about
software and law apart, but is unsure, unconfirmed or of another licence, is ``unknown``.

The model is trained on the notices below, on the driver: a bounded set that
doesn't depend on the data.  Its weights and the templates' n-grams are small
tables (bounded by the templates) that are broadcast.  The scan itself is
DataFrame expressions only, reads the text once, and scores each distinct
paragraph or window once.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

# Notices of each family as licence authors publish them, in short forms that documents carry.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Released under MIT.",
        "MIT License",
        "The MIT License (MIT)",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "Apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License 2.0.",
        "Licensed under Apache 2.0.",
        "Apache License, Version 2.0",
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "This project is licensed under the Apache 2.0 license.",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GNU General Public License, version 2 or later.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Licensed under the GPL, version 3.",
        "Released under the GPLv2 license.",
        "Released under GPL 3.",
        "GNU General Public License, version 3",
        "GPL-3.0",
        "Licensed under the GNU GPL v2.",
        "Licensed under the GNU GPL, version 3.",
    ),
    "LGPL": (
        "Licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software under the terms of the GNU Lesser General Public License.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "Released under the LGPL, version 2.1.",
        "GNU Lesser General Public License, version 3",
        "LGPL-3.0",
    ),
    "AGPL": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is distributed under the terms of the GNU Affero General Public License.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "Released under the AGPL, version 3.",
        "GNU Affero General Public License, version 3",
        "AGPL-3.0",
    ),
    "BSD": (
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD license.",
        "BSD 3-Clause License",
        "BSD-2-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Use of this source code is governed by a BSD-style license.",
    ),
    "MPL": (
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "Mozilla Public License, version 2.0",
        "Released under MPL 2.0.",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Released under the Creative Commons Attribution license, CC BY 3.0.",
        "CC BY 4.0",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
        "CC BY-SA 4.0",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Released under CC BY-NC-ND 3.0, for non-commercial use only.",
        "CC BY-NC 4.0",
    ),
    "CC0": (
        "Released under CC0 1.0.",
        "CC0 1.0 Universal",
        "Creative Commons Zero 1.0 Universal",
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0.",
        "This work is dedicated to the public domain under the CC0 1.0 Universal license.",
        "This is free and unencumbered software released into the public domain.",
    ),
    "Proprietary": (
        "All rights reserved.",
        "Copyright. All rights reserved.",
        "No part of this publication may be reproduced without prior written permission of the copyright holder.",
        "Unauthorised copying of this file is strictly prohibited; proprietary and confidential, all rights reserved.",
    ),
}
NONE, OTHER = "none", "other"
# Notices of other licences, and in other languages; no family's templates.
OTHERS = (
    "Licensed under the Eclipse Public License, version 2.0.",
    "This program is made available under the terms of the Eclipse Public License 2.0.",
    "Released under the ISC License.",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "Distributed under the Boost Software License, Version 1.0.",
    "Licensed under the zlib license.",
    "This library is licensed under the Artistic License 2.0.",
    "Licensed under the EUPL, version 1.2.",
    "Available under the Common Development and Distribution License.",
    "This font is licensed under the SIL Open Font License, Version 1.1.",
    "Released under the WTFPL.",
    "Licensed under the Microsoft Public License.",
    "Use of this data is subject to the Open Database License.",
    "SPDX-License-Identifier: ISC",
    "SPDX-License-Identifier: EPL-2.0",
    "This software is provided as is, without warranty of any kind, express or implied.",
    "The software is provided as is, without any express or implied warranty.",
    "This software is licensed under its own terms; see the file LICENSE for details.",
    "Use is subject to license terms.",
    "You may obtain a copy of the license at the following address.",
    "Licensed material; see the license agreement for the conditions of use.",
    "ISC License",
    "Eclipse Public License, version 2.0",
    "Boost Software License 1.0",
    "Diese Datei steht unter der Lizenz, die in der Datei beschrieben ist.",
    "Der Quelltext steht unter der MIT-Lizenz.",
    "Dieses Projekt steht unter der MIT-Lizenz.",
    "Die Software steht unter der BSD-Lizenz.",
    "Der Code ist lizenziert unter der GPL.",
    "Diese Bibliothek steht unter der GPL.",
    "Lizenziert unter der Apache-Lizenz, Version 2.0.",
    "Dieses Werk ist lizenziert unter einer freien Lizenz.",
    "Veröffentlicht unter der GNU General Public Lizenz, Version 3.",
    "Diese Software steht unter der Apache-Lizenz.",
    "Alle Rechte vorbehalten.",
    "Ce programme est distribué sous licence libre.",
    "Ce logiciel est un logiciel libre ; vous pouvez le redistribuer suivant les termes de la Licence Publique Générale GNU.",
    "Cette œuvre est mise à disposition selon les termes de la licence Creative Commons.",
    "Sous licence MIT.",
    "Distribué sous licence Apache 2.0.",
    "Tous droits réservés.",
    "Este programa se distribuye bajo la licencia Apache.",
    "Esta obra está bajo una licencia de Creative Commons.",
    "Publicado bajo la licencia MIT.",
    "Esta biblioteca está licenciada bajo la licencia GPL.",
    "El código se publica bajo la licencia BSD.",
    "Este programa está bajo la licencia Apache.",
    "Todos los derechos reservados.",
    "Este software está licenciado sob a licença MIT.",
    "Todos os direitos reservados.",
    "Das Paket wurde unter der Apache-Lizenz veröffentlicht.",
    "Das Werk ist unter einer BSD-Lizenz verfügbar.",
    "Alle Rechte bleiben vorbehalten.",
    "Copyright. Alle Rechte vorbehalten.",
    "Alle Rechte vorbehalten, Nachdruck verboten.",
    "Ce programme est distribué sous licence GPL.",
    "Le code source est publié sous licence BSD.",
    "Este paquete se publica bajo una licencia BSD.",
)
# Paragraphs that hold anchor words but grant nothing.
NEGATIVES = (
    "The driver showed a license at the gate.",
    "A fishing license costs ten coins a year in the village.",
    "His driving licence was revoked by the court in May.",
    "The apache helicopter landed near the license office.",
    "Students at MIT published a paper about the mit of heat.",
    "They reserved a table under the name of Smith.",
    "All seats were reserved for the guests.",
    "The city licensed three new taxi companies this spring.",
    "Public opinion about copyright changed in the last version of the law.",
    "She asked for permission to leave the room.",
    "The permission of the owner is needed to enter the garden.",
    "The general public may visit the gardens on Sunday, version or no version.",
    "Creative people met in the commons to talk about attribution.",
    "The warranty covers two years of repair.",
    "Human rights are reserved to nobody.",
    "The copyright of songs is a long story.",
    "A licence to kill was the title of the film.",
    "Rights of way cross the public domain north of the river.",
    "The foundation gave free software courses to teachers.",
    "Redistribution of wealth was the subject of the debate.",
    "Which license should I choose, the lawyer asked.",
    "The license plate was found in the forest.",
    "The license of the old bar was not renewed.",
    "The software company hired ten people.",
    "She wrote software for the weather office.",
    "Food was provided without a fee.",
    "The newspaper published its last edition in June.",
    "The prisoner was released in May, the film in June.",
    "The notice on the door was written by hand.",
    "The bank is licensed by the state.",
    "MIT is a university; Apache is a town.",
    "The creative commons of the village lie by the river.",
    "Copyright law was changed by parliament.",
    "The gnu is an antelope.",
    "Dogs are prohibited in the garden.",
    "Her open source software project grew quickly.",
    "The license fee of the software was paid by the company.",
    "They use the Apache web server at work.",
    "A public license hearing was held in the town hall.",
    "She reserved all rights to the film of the book.",
    "He distributed the copies to the members of the choir.",
    "The Mozilla foundation hired a new director.",
    "Many programs are written in a free language.",
    "The software foundation met in Berlin last year.",
    "The agency granted the permission after two weeks.",
    "The license agreement between the two firms ended in May.",
    "A general license for boats is valid on all lakes.",
    "The copyright holder of the picture lives in Rome.",
    "The terms of the contract were discussed under the tree.",
    "He studied the source code of the old program for months.",
    "The project was released under great pressure.",
    "The players were released under the terms of the transfer.",
    "The creative attribution of the painting is unknown.",
    "Commercial use of the road is charged by weight.",
    "The affected persons were granted a pension.",
    "The mail was distributed under the supervision of the chief.",
    "All material is kept in the library under the roof.",
    "The warranty of the car is void without service.",
    "The proprietary recipe of the bakery is confidential.",
    "The universal language of music needs no license.",
    "Students redistribute the notes of the lecture.",
    "The GNU tools were installed on the server.",
    "The BSD conference took place in Ottawa.",
    "The Apache server was restarted at night.",
    "The Apache people lived in the desert.",
    "The kernel and its modules are software.",
    "Their software is provided by a small company.",
)
# Words that say nothing of licences by themselves, in one language or another ("mit" is German for with,
# "sa" French for its; "nc" and "nd" stand for much); names like "under mit" or "cc by nc" hold another marker.
COMMON = frozenset(
    "a above alle an and any all are as available at bajo beschrieben ce cette commercial common deal development diese dieses disposition except express fee forms granted included later law met mit nc nd non obra only open package portions possible pouvez prior programa programme provided publication related sa se sob strictly style substantial suivant todos tous una universal use v à œuvre be by can da das de der des die du e ein einer el en er es est est esta está este et for form free from has have in into is ist it its kind la le les los may must no not o of of on one or os os out own part par "
    "selon sein shall should so sous steht sur that the their these they this those to un und une unter upon und vous which who will with without work works works you your "
    "address author code copies copy conditions data date details die file files following for general green international library made mise name new other own person persons program project public purpose section see source subject text version where written wird".split()
)
#: The least share of n-grams that a text and a template must have in common, of those of both.
SHARED = 0.55
#: Of the notices of left-out families, the share that may pass for another family; bounds of the calibrated probabilities.
PASS, LEAST, MOST = 0.05, 0.5, 0.95
#: How much worse than best notices and prose may be told apart where that finds more notices.
NEARLY = 0.03
GRAMS = 3
#: What a training text of a single known n-gram (a marker alone) weighs.
SINGLE = 0.2
#: Where paragraphs end: blank lines, and sentence ends before white space.
ENDS = r"\n[ \t\r]*\n\s*|(?<=[.!?])\s+"
#: Windows as (words, words from one to the next): some window holds any run of words and few more.
WINDOWS = tuple((n, max(1, n // 4)) for n in (4, 6, 8, 12, 16, 24, 32))
#: Windows of so many words that are unsure or unconfirmed make a long paragraph ``unknown``.
UNSURE_WORDS = 16

_word = r"[\p{L}\p{N}]+"


def words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


#: Words of the longest template; a confirmed paragraph of no more words is one notice.
LONGEST = max(len(words(t)) for ts in TEMPLATES.values() for t in ts)


def ngrams(text: str) -> set[str]:
    w = words(text)
    return {" ".join(w[i : i + n]) for n in range(1, GRAMS + 1) for i in range(len(w) - n + 1)}


class Model:
    """Weights by n-gram, a bias for each class, the calibrated temperature and least probability, and the markers."""

    def __init__(self, classes: list[str], vocabulary: dict[str, int], weights: np.ndarray, bias: np.ndarray, temperature: float, markers: list[str], sure: float = 1.0, wary: float = 0.5):
        self.classes, self.vocabulary, self.weights, self.bias, self.temperature, self.markers, self.sure, self.wary = classes, vocabulary, weights, bias, temperature, markers, sure, wary


# Ways to open a short notice.
OPENINGS = ("Licensed under", "Released under", "Distributed under", "Available under", "Published under", "This work is licensed under", "This package is released under", "The code is distributed under the terms of")


def _variants(text: str) -> list[str]:
    """A notice, and a short one with all other openings: what confirms is its verb and name."""
    return [text, *([f"{o} {text.split(' under ', 1)[1]}" for o in OPENINGS] if text.startswith(OPENINGS[:2]) else [])]


def _examples() -> list[tuple[str, str, int]]:
    """(class, paragraph, its notice's number): each notice, short ones with other openings, halves of long ones; each negative."""
    out, number = [], 0
    for family, texts in [*TEMPLATES.items(), (OTHER, OTHERS)]:
        for t in texts:
            number += 1
            out += [(family, v, number) for v in _variants(t)]
            w = t.split()
            if len(w) > 12:
                out += [(family, " ".join(w[: len(w) // 2 + 2]), number), (family, " ".join(w[len(w) // 2 - 2 :]), number)]
    return out + [(NONE, t, number + 1 + i) for i, t in enumerate(NEGATIVES)]


def _marked(examples) -> list[str]:
    return sorted({w for c, t, _ in examples if c != NONE for w in words(t)} - COMMON - {w for c, t, _ in examples if c != NONE for w in words(t) if w.isdigit()})


def _fit(x: np.ndarray, y: np.ndarray, k: int, rounds: int = 150, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of a softmax regression (gradient descent with momentum; classes weigh alike, texts of one n-gram less)."""
    w, b = np.zeros((x.shape[1], k), np.float32), np.zeros(k, np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    hot = np.eye(k, dtype=np.float32)[y]
    share = np.where((x > 0).sum(1) <= 1, np.float32(SINGLE), np.float32(1))
    weight = (share / np.maximum(1, (hot * share[:, None]).sum(0))[y])[:, None] / np.float32(k)
    for _ in range(rounds):
        z = x @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = weight * (p - hot)
        vw, vb = 0.9 * vw - 2.0 * (x.T @ g + ridge * w / k), 0.9 * vb - 2.0 * g.sum(0)
        w, b = w + vw, b + vb
    return w.astype(np.float64), b.astype(np.float64)


def _features(texts: list[str], vocabulary: dict[str, int]) -> np.ndarray:
    """Known n-grams of each text as rows of length one."""
    x = np.zeros((len(texts), len(vocabulary)), np.float32)
    for i, t in enumerate(texts):
        for g in ngrams(t):
            if g in vocabulary:
                x[i, vocabulary[g]] = 1
    return x / np.sqrt(np.maximum(1, x.sum(1, keepdims=True)))


def train(folds: int = 3) -> Model:
    """Fit on the notices; temperature and least probability come from notices and families left out.

    A word by itself is no notice: every marker is a negative, alone.  Folds are
    dealt by notice, so that no variant of one is on both sides.  The
    temperature has the best likelihood there; the least probability is the
    smallest with which at most ``PASS`` of the notices of left-out families
    pass as another family, confirmed by its templates.
    """
    examples = _examples()
    markers = _marked(examples)
    held = set(markers)
    last = examples[-1][2]
    examples += [(NONE, m, last + 1 + i) for i, m in enumerate(markers)] + [(NONE, "", 0)]
    classes = [*TEMPLATES, OTHER, NONE]
    vocabulary = {g: i for i, g in enumerate(sorted({g for _, t, _ in examples for g in ngrams(t) if not held.isdisjoint(g.split(" "))}))}
    x = _features([t for _, t, _ in examples], vocabulary)
    y = np.array([classes.index(c) for c, _, _ in examples])
    group = np.array([g for _, _, g in examples])
    logits = np.zeros((len(examples), len(classes)))
    for f in range(folds):
        out = group % folds == f
        w, b = _fit(x[~out], y[~out], len(classes))
        logits[out] = x[out] @ w + b

    def loss(t: float) -> float:
        z = logits / t
        return float(-(z[np.arange(len(y)), y] - z.max(1) - np.log(np.exp(z - z.max(1, keepdims=True)).sum(1))).mean())

    temperature = min((t / 10 for t in range(3, 41)), key=loss)
    passing, unseen = [], []
    for k, family in enumerate(classes[:-2]):
        out = y == k
        w, b = _fit(x[~out], y[~out], len(classes), 80)
        z = (x[out] @ w + b) / temperature
        z[:, k] = -np.inf  # the family doesn't exist for this model
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        unseen += (1 - p[:, -1]).tolist()
        for (_, text, _), q in zip([e for e, o in zip(examples, out, strict=True) if o], p, strict=True):
            best = int(q.argmax())
            taken = best < len(classes) - 2 and likeness(ngrams(text), classes[best]) >= SHARED
            passing.append(float(q[best]) if taken else 0.0)
    passing.sort()
    sure = min(MOST, max(LEAST, passing[min(len(passing) - 1, math.ceil(len(passing) * (1 - PASS)))] + 1e-6))
    # How likely left-out notices, and left-out prose that holds markers, are taken for a notice of any kind:
    # the least probability that tells them apart nearly as well as the best one.
    z = logits / temperature
    notice = 1 - np.exp(z[:, -1] - z.max(1)) / np.exp(z - z.max(1, keepdims=True)).sum(1)
    prose = np.array([c == NONE and " " in t for c, t, _ in examples])
    wanted = np.concatenate([notice[y < len(classes) - 1], unseen])
    gap = lambda t: float((wanted >= t).mean() - (notice[prose] >= t).mean())
    steps = [t / 100 for t in range(int(100 * LEAST), int(100 * MOST) + 1)]
    wary = min(t for t in steps if gap(t) >= max(map(gap, steps)) - NEARLY)
    w, b = _fit(x, y, len(classes))
    return Model(classes, vocabulary, np.round(w, 6), np.round(b, 6), temperature, markers, round(sure, 6), wary)


_template_grams: dict[str, list[set[str]]] = {}


def likeness(grams: set[str], family: str) -> float:
    """The greatest share of n-grams, of a text's and a template's together, that a template of the family has in common with it."""
    if family not in _template_grams:
        _template_grams[family] = [ngrams(v) for t in TEMPLATES.get(family, ()) for v in _variants(t)]
    return max((2 * len(grams & t) / (len(grams) + len(t)) for t in _template_grams[family]), default=0.0)


def score(text: str, model: Model) -> tuple[str, float, float, float]:
    """(class, probability, likeness, probability of any notice) by hand: see ``score_texts``."""
    grams = ngrams(text)
    known = [model.weights[model.vocabulary[g]] for g in grams if g in model.vocabulary]
    z = model.bias + sum(known, np.zeros(len(model.bias))) / math.sqrt(max(1, len(known)))
    p = np.exp((z - z.max()) / model.temperature)
    p /= p.sum()
    k = int(np.argmax(p))
    return model.classes[k], float(p[k]), likeness(grams, model.classes[k]), float(1 - p[-1])


def judge(paragraph: str, model: Model) -> tuple[dict[str, float], bool, float]:
    """(probability of each confirmed family, whether the paragraph is unknown, the whole's probability) by hand."""
    w = words(paragraph)
    family, p, alike, notice = score(paragraph, model)
    known = lambda f: f not in (NONE, OTHER)
    sure = known(family) and p >= model.sure and alike >= SHARED
    if sure and len(w) <= LONGEST:
        return {family: p}, False, p
    found, unsure = [(-alike, -len(w), 0, family, p)] if sure else [], notice >= model.wary
    for size, step in WINDOWS:
        for i in sorted({*range(0, len(w) - size + 1, step), len(w) - size}) if size < len(w) else ():
            f, q, alike, notice = score(" ".join(w[i : i + size]), model)
            if known(f) and q >= model.sure and alike >= SHARED:
                found.append((-alike, -size, i, f, q))
            elif notice >= model.wary and size >= UNSURE_WORDS and len(w) > LONGEST:
                unsure = True
    out = {}
    for x in found:
        if all(x[:4] <= y[:4] or x[2] >= y[2] - y[1] or y[2] >= x[2] - x[1] for y in found):
            out[x[3]] = max(x[4], out.get(x[3], 0.0))
    return out, unsure and not out, p


def classify(text: str, model: Model) -> tuple[str, float]:
    """(the most probable family of a text, probability) by hand, for tests; ``scan`` computes the same in Spark."""
    judged = [judge(t.strip(), model) for t in re.split(ENDS, text)]
    best = max(((p, f) for found, _, _ in judged for f, p in found.items()), default=None)
    if best:
        return best[1], best[0]
    return next((("unknown", p) for _, unknown, p in judged if unknown), (NONE, min(p for *_, p in judged)))


_models: list[Model] = []


def _model() -> Model:
    if not _models:
        _models.append(train())
    return _models[0]


def _words(text):
    """Lower-case words of a column."""
    return F.regexp_extract_all(F.lower(text), F.lit(_word), F.lit(0))


def _gram_array(text):
    """Distinct word n-grams of a column, as arrays of strings."""

    def grams(w):
        def runs(n: int):
            spot = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))
            return F.transform(spot, lambda i: F.array_join(F.slice(w, i, n), " "))

        return F.array_distinct(F.concat(*[runs(n) for n in range(1, GRAMS + 1)]))

    return F.element_at(F.transform(F.array(_words(text)), grams), 1)


def _tables(spark: SparkSession, m: Model) -> tuple[DataFrame, DataFrame]:
    """(n-gram, weights) and (n-gram, template, family, template's n-grams): bounded by the templates above."""
    weights = [(g, [float(v) for v in m.weights[i]]) for g, i in m.vocabulary.items()]
    templates = [(g, n, family, len(grams)) for n, (family, grams) in enumerate((f, ngrams(v)) for f, ts in TEMPLATES.items() for t in ts for v in _variants(t)) for g in grams]
    return spark.createDataFrame(weights, "gram string, weights array<double>"), spark.createDataFrame(templates, "gram string, template int, family string, template_grams int")


def score_texts(texts: DataFrame, model: Model, key: str = "key") -> DataFrame:
    """``texts(key, text)`` -> ``(key, family, probability, alike, notice)``; keys are distinct.

    ``alike`` is the greatest share of n-grams, of those of the text and of a
    template of the family together, that both have; ``notice`` is the probability
    of any class but none.  Texts are cut into n-grams
    where they are; only their keys travel.
    """
    weights, templates = (F.broadcast(t) for t in _tables(texts.sparkSession, model))
    grams = texts.select(key, _gram_array(F.col("text")).alias("grams")).withColumn("n", F.size("grams"))
    each = grams.select(key, "n", F.explode_outer("grams").alias("gram"))
    k = len(model.classes)
    sums = each.join(weights, "gram", "left").groupBy(key).agg(F.count("weights").alias("known"), *[F.coalesce(F.sum(F.col("weights")[i]), F.lit(0.0)).alias(f"z{i}") for i in range(k)])
    z = F.array(*[(F.col(f"z{i}") / F.sqrt(F.greatest("known", F.lit(1)).cast("double")) + F.lit(float(model.bias[i]))) / F.lit(model.temperature) for i in range(k)])
    p = sums.select(key, z.alias("z")).withColumn("top", F.array_max("z"))
    p = p.select(key, F.element_at(F.array(*map(F.lit, model.classes)), F.array_position("z", F.col("top")).cast("int")).alias("family"), (1 / F.aggregate("z", F.lit(0.0), lambda a, v: a + F.exp(v - F.col("top")))).alias("probability"), (F.col("z")[k - 1] - F.col("top")).alias("_none"))
    p = p.withColumn("notice", 1 - F.exp("_none") * F.col("probability")).drop("_none")
    both = each.join(templates, "gram").groupBy(key, "n", "template", "family", "template_grams").agg(F.count("*").alias("c"))
    alike = both.groupBy(key, "family").agg(F.max(2 * F.col("c") / (F.col("n") + F.col("template_grams"))).alias("alike"))
    return p.join(alike, [key, "family"], "left").select(key, "family", "probability", F.coalesce("alike", F.lit(0.0)).alias("alike"), "notice")


def _holds_marker(w, model: Model):
    return F.arrays_overlap(w, F.array(*map(F.lit, model.markers)))


def _windows(text, model: Model):
    """(start, size, window) of a paragraph's windows that hold a marker, cut around the markers: their bytes are linear in the markers."""
    markers = F.array(*map(F.lit, model.markers))

    def around(s):
        w, n, at = s["w"], F.size(s["w"]), s["at"]

        def of(size: int, step: int):
            def starts(m):
                lo = F.greatest(F.lit(0), F.ceil((m - size + 1) / step).cast("int") * step)
                hi = F.least(m, n - size)
                return F.concat(F.when(lo <= hi, F.sequence(lo, hi, F.lit(step))).otherwise(F.array().cast("array<int>")), F.when(m >= n - size, F.array(n - size)).otherwise(F.array().cast("array<int>")))

            some = F.array_distinct(F.flatten(F.transform(at, starts)))
            return F.when(n > size, F.transform(some, lambda i: F.struct(i.alias("start"), F.lit(size).alias("size"), F.array_join(F.slice(w, i + 1, size), " ").alias("window")))).otherwise(F.array().cast("array<struct<start:int,size:int,window:string>>"))

        return F.concat(*[of(*x) for x in WINDOWS])

    def placed(w):
        spots = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.size(w) - 1)).otherwise(F.array().cast("array<int>"))
        return F.struct(w.alias("w"), F.filter(spots, lambda i: F.array_contains(markers, F.get(w, i))).alias("at"))

    return F.get(F.transform(F.transform(F.array(_words(text)), placed), around), F.lit(0))


def judge_paragraphs(paragraphs: DataFrame, model: Model) -> DataFrame:
    """Distinct ``paragraphs(paragraph)`` -> ``(paragraph, notices, unknown)``; notices are ``(probability, family)``, one of each family.

    Of confirmed windows that overlap, only the one most like a template is a
    notice; the others are parts of it.  Paragraphs go by a number: neither
    n-grams nor windows carry the text that they are from.
    """
    sure = ~F.col("family").isin(NONE, OTHER) & (F.col("probability") >= model.sure) & (F.col("alike") >= SHARED)
    numbers = common.staged(paragraphs.distinct().withColumn("key", F.monotonically_increasing_id()).withColumn("n", F.size(_words(F.col("paragraph")))), "licence-paragraphs")
    whole = common.staged(score_texts(numbers.select("key", F.col("paragraph").alias("text")), model).join(numbers.select("key", "n"), "key").withColumn("sure", sure), "licence-whole")
    settled = F.col("sure") & (F.col("n") <= LONGEST)
    spans = numbers.join(whole.where(~settled).select("key"), "key").select("key", "n", F.explode(_windows(F.col("paragraph"), model)).alias("s")).select("key", "n", "s.*")
    spans = common.staged(spans, "licence-windows")
    scored = score_texts(spans.select("window", F.col("window").alias("text")).distinct(), model, "window")
    judged = spans.join(scored, "window").withColumn("sure", sure).where(F.col("sure") | (F.col("notice") >= model.wary))
    judged = judged.select("key", "n", "start", "size", "family", "probability", "alike", "sure")
    judged = common.staged(judged.unionByName(whole.where(F.col("sure") & ~settled).select("key", "n", F.lit(0).alias("start"), F.col("n").alias("size"), "family", "probability", "alike", "sure")), "licence-judged-windows")
    # A confirmed window is a notice if at each of its words no other one that holds the word is more like a template.
    item = F.struct((-F.col("alike")).alias("a"), (-F.col("size")).alias("b"), "start", "family")
    held = judged.where("sure").select("key", "probability", item.alias("item"), F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("word"))
    held = held.withColumn("best", F.min("item").over(W.partitionBy("key", "word")) == F.col("item"))
    parts = held.groupBy("key", "item").agg(F.bool_and("best").alias("best"), F.max("probability").alias("probability")).where("best").select("key", "item.family", "probability")
    parts = parts.unionByName(whole.where(settled).select("key", "family", "probability"))
    notices = parts.groupBy("key", "family").agg(F.max("probability").alias("probability")).groupBy("key").agg(F.collect_list(F.struct("probability", "family")).alias("notices"))
    unsure = judged.where(~F.col("sure") & (F.col("size") >= UNSURE_WORDS) & (F.col("n") > LONGEST)).select("key")
    unsure = unsure.unionByName(whole.where(F.col("notice") >= model.wary).select("key")).distinct().withColumn("unsure", F.lit(True))
    found = notices.join(unsure, "key", "full").select("key", "notices", F.col("notices").isNull().alias("unknown"))
    return numbers.select("key", "paragraph").join(found, "key").select("paragraph", "notices", "unknown")


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Licence notices of every row of ``docs(doc_id, text)``.

    ``-> (doc_id, n_notices, families, n_unknown, best_family, best_probability)``:
    confirmed families of each paragraph (a sentence, over line breaks), the
    sorted distinct families, paragraphs without one that look like a notice but
    are unsure, unconfirmed or of another licence, and the most probable
    confirmed family (ties: the greatest name; null if none).  Null texts have no
    paragraphs; rows that share a doc_id, or lack one, are separate rows.  Other
    columns are ignored; an empty table gives no rows.
    """
    m = model or _model()
    text = F.col("text")
    paragraphs = F.filter(F.transform(F.split(text, ENDS), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: _holds_marker(_words(p), m))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("string").alias("text"))
    rows = rows.select("doc_id", F.when(_holds_marker(_words(text), m), paragraphs).alias("paragraphs"))
    rows = common.staged(rows.withColumn("row", F.monotonically_increasing_id()), "licence-rows")  # the only scan of the text
    each = rows.where("size(paragraphs) > 0").select("row", F.explode("paragraphs").alias("paragraph"))
    judged = common.staged(judge_paragraphs(each.select("paragraph"), m), "licence-judged")
    judged = each.join(judged, "paragraph").select("row", "unknown", F.explode_outer("notices").alias("notice"))
    found = judged.groupBy("row").agg(F.count("notice").alias("n_notices"), F.array_sort(F.collect_set("notice.family")).alias("families"), F.count(F.when(F.col("unknown"), 1)).alias("n_unknown"), F.max("notice").alias("best"))
    zero, none = F.lit(0).cast("long"), F.array().cast("array<string>")
    return rows.select("doc_id", "row").join(found, "row", "left").select(
        "doc_id", F.coalesce("n_notices", zero).alias("n_notices"), F.coalesce("families", none).alias("families"), F.coalesce("n_unknown", zero).alias("n_unknown"), F.col("best.family").alias("best_family"), F.col("best.probability").alias("best_probability")
    )


def op8_license_paragraphs(spark, sf_dir: str) -> DataFrame:
    """Licence notices of all documents."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
