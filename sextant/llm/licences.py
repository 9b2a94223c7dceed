"""Licence scans: a trained sparse n-gram classifier names the family of a paragraph, and templates confirm it.

Paragraphs (lines, cut into sentences) with a cue word go through a multinomial logistic regression on hashed words
and word pairs; one class is `unknown`, a temperature calibrates the probabilities, and a prediction stands only if
enough word pairs of one of the family's templates occur, and more than of any other family's. Notices are usually wrapped, so a sentence of several lines
(up to a line without a letter or digit) is also judged whole and by windows of its words, each longer than a template
by at least the step to the next. SPDX identifiers are looked up. The regression is fitted on the driver, on a bounded set
made from the templates below by a seeded generator; its weights are literals of the plan. On the executors there are
only DataFrame functions, row by row and without a shuffle."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import let, table

#: Notices by licence family in their usual wording, sentence by sentence, and the family's usual names.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.", "you may not use this file except in compliance with the License", "distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
        "See the License for the specific language governing permissions and limitations under the License", "Apache License 2.0", "Apache 2.0 license", "Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License.", "Licensed under the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "MIT License", "MIT licensed", "MIT licence",
    ),
    "bsd": (
        "Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
        "BSD license", "BSD licence", "BSD-style license", "BSD 3-Clause", "BSD 2-Clause",
    ),
    "gpl-2": (
        "This work is licensed under the GNU General Public License, version 2.", "GNU General Public License as published by the Free Software Foundation; either version 2 of the License", "GNU GPL version 2", "GPL version 2", "GPL v2", "GPL 2.0",
        "General Public License version 2", "General Public License v2",
    ),
    "gpl-3": (
        "This work is licensed under the GNU General Public License, version 3.", "GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "GNU GPL version 3", "GPL version 3", "GPL v3", "GPL 3.0",
        "General Public License version 3", "General Public License v3",
    ),
    "lgpl": ("Licensed under the GNU Lesser General Public License, version 2.1.", "terms of the GNU Lesser General Public License as published by the Free Software Foundation", "GNU Lesser General Public License", "GNU LGPL", "LGPL version 2.1", "LGPL v3", "LGPL license"),
    "agpl-3": ("Licensed under the GNU Affero General Public License, version 3.", "terms of the GNU Affero General Public License as published by the Free Software Foundation", "GNU Affero General Public License", "GNU AGPL", "AGPL version 3", "AGPL v3", "AGPL license"),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/", "Mozilla Public License", "MPL 2.0"),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "ISC License", "ISC licence", "ISC licensed"),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Creative Commons Attribution License", "Creative Commons Attribution 3.0", "Creative Commons Attribution 4.0"),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Creative Commons Attribution-ShareAlike", "Creative Commons Attribution Share Alike", "CC BY-SA"),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Creative Commons Attribution-NonCommercial", "Creative Commons Attribution Non Commercial", "CC BY-NC"),
    "public-domain": (
        "This is free and unencumbered software released into the public domain.", "To the extent possible under law, the author has waived all copyright and related rights to this work", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
        "released into the public domain", "placed in the public domain", "dedicated to the public domain", "CC0 1.0 Universal",
    ),
    "proprietary": ("All rights reserved.", "No part of this publication may be reproduced without the prior written permission of the publisher", "Unauthorized copying of this file, via any medium, is strictly prohibited", "proprietary and confidential"),
}
#: Sentences that hold a cue and are no licence of these families; the last ones are of other licences.
LOOK_ALIKES = (
    "his driving licence was taken by the police", "the license plate of the car was lost", "copyright law was debated in the parliament", "the machine came without a warranty",
    "she gave permission to enter the house", "the public domain is a matter of debate", "version 2 of the plan was released", "the rights of the people were reserved by the king",
    "a creative group of common people", "the apache tribe lived in the plains", "the university of mit is known", "redistribution of wealth in modern states", "they applied for a fishing license",
    "the foundation published a general report", "licensed doctors work under the law", "all rights and duties", "free software is a movement",
    "This software is provided as-is, without any express or implied warranty", "Licensed under the Eclipse Public License, version 1.0", "Distributed under the Boost Software License, Version 1.0", "Licensed under the Artistic License 2.0",
    "Common Development and Distribution License", "the SIL Open Font License, Version 1.1", "licensed under the zlib license", "Microsoft Public License", "the Open Database License", "Academic Free License version 3.0",
)
FAMILIES = (*TEMPLATES, "unknown")
CUE = r"(?i)licen[cs]|copyright|permission|warrant|rights[\s#*/;]+reserved|public[\s#*/;]+domain|creative[\s#*/;]+commons|redistribution|unencumbered|\bCC[\s#*/;]+BY|\bA?L?GPL|\bCC0\b|unauthorized[\s#*/;]+copying|proprietary"
CUT = r"\n|(?<=[A-Za-z0-9)]{2}[.!?])[ ]"
#: Ends of sentences that may go over several lines: white space after a full stop, or a line without letter or digit.
SENTENCE = r"(?<=[A-Za-z0-9)]{2}[.!?])[ \r\n]|\n[^A-Za-z0-9\n]*(?=\n)"
SPDX = r"(?i)SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+() -]+)"
#: SPDX identifiers in lower case, without -only, -or-later and +.
SPDX_IDS = {
    "apache-2.0": "apache-2.0", "mit": "mit", "mit-0": "mit", "bsd-2-clause": "bsd", "bsd-3-clause": "bsd", "bsd-4-clause": "bsd", "gpl-2.0": "gpl-2", "gpl-3.0": "gpl-3", "lgpl-2.0": "lgpl", "lgpl-2.1": "lgpl", "lgpl-3.0": "lgpl", "agpl-3.0": "agpl-3",
    "mpl-2.0": "mpl-2.0", "isc": "isc", "unlicense": "public-domain", "cc0-1.0": "public-domain",
} | {f"{f}-{v}": f for f in ("cc-by", "cc-by-sa", "cc-by-nc") for v in ("1.0", "2.0", "2.5", "3.0", "4.0")}


@dataclass(frozen=True)
class LicenceRules:
    """Parameters: hashed features, made-up examples a template, training steps, least probability and pair overlap,
    and (words, step) of the windows of a sentence over several lines."""

    features: int = 1024
    examples: int = 24
    steps: int = 150
    rate: float = 2.0
    probability: float = 0.5
    overlap: float = 0.6
    seed: int = 5
    windows: tuple = ((16, 4), (32, 8))


def grams_of(text: str) -> list[str]:
    """Different words and word pairs of a text, as the plan's `grams`."""
    w = re.findall("[a-z0-9]+", text.lower())
    return list(dict.fromkeys([*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]))


def _slot(gram: str, n: int) -> int:
    h = xxhash.xxh64_intdigest(gram.encode(), seed=42)
    return (h - (1 << 64) if h >> 63 else h) % n


def vector(text: str, n: int) -> np.ndarray:
    """A text's hashed grams, each counted once a gram, scaled to unit length of the gram count."""
    out, grams = np.zeros(n), grams_of(text)
    for g in grams:
        out[_slot(g, n)] += 1
    return out / np.sqrt(max(1, len(grams)))


def examples(rules: LicenceRules) -> tuple[np.ndarray, np.ndarray]:
    """Made-up paragraphs as vectors, and their classes."""
    rng = np.random.default_rng(rules.seed)
    filler = lambda n: " ".join("".join(rng.choice(list("abcdefghilmnoprstuv"), int(rng.integers(2, 9)))) for _ in range(n))
    x, y = [], []
    for k, family in enumerate(FAMILIES):
        for base in TEMPLATES.get(family, LOOK_ALIKES):
            for _ in range(rules.examples):
                w = base.split()
                w = [t for t in w if len(w) < 6 or rng.random() > 0.12]
                before, after = (int(rng.integers(0, 6)) if rng.random() < 0.5 else 0 for _ in range(2))
                x.append(vector(f"{filler(before)} {' '.join(w)} {filler(after)}", rules.features))
                y.append(k)
    for _ in range(rules.examples * 6):
        cue = ("licence", "license", "copyright", "permission", "warranty", "licensed", "redistribution")[int(rng.integers(7))]
        x.append(vector(f"{filler(int(rng.integers(1, 8)))} {cue} {filler(int(rng.integers(1, 8)))}", rules.features))
        y.append(len(FAMILIES) - 1)
    return np.array(x), np.array(y)


@lru_cache(maxsize=4)
def fit(rules: LicenceRules = LicenceRules()) -> tuple[np.ndarray, np.ndarray]:
    """(weights by class and feature, intercepts), divided by the temperature that held-out examples ask for."""
    x, y = examples(rules)
    held = np.random.default_rng(rules.seed + 1).random(len(y)) < 0.25
    a, k = x[~held], len(FAMILIES)
    t = np.eye(k)[y[~held]]
    w, b = np.zeros((k, rules.features)), np.zeros(k)
    for _ in range(rules.steps):
        z = a @ w.T + b
        q = np.exp(z - z.max(1, keepdims=True))
        g = (q / q.sum(1, keepdims=True) - t) / len(a)
        w -= rules.rate * k * (g.T @ a + 1e-6 * w)
        b -= rules.rate * g.sum(0)
    z, best = x[held] @ w.T + b, (np.inf, 1.0)
    for heat in np.linspace(0.3, 3.0, 28):
        s = z / heat
        s = s - s.max(1, keepdims=True)
        loss = -(s[np.arange(len(s)), y[held]] - np.log(np.exp(s).sum(1))).mean()
        best = min(best, (loss, heat))
    return w / best[1], b / best[1]


def _literal(value, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def scanned(text: Column, rules: LicenceRules = LicenceRules()) -> Column:
    """Paragraphs with a cue, in order: array of (paragraph, family, probability, overlap, confirmed)."""
    w, b = fit(rules)
    n, k = rules.features, len(FAMILIES)
    weights, intercepts = _literal(np.round(w, 6).ravel().tolist(), "array<double>"), _literal(np.round(b, 6).tolist(), "array<double>")
    pairs = lambda t: [g for g in grams_of(t) if " " in g]
    templates = _literal([[pairs(t) for t in TEMPLATES.get(f, ())] for f in FAMILIES], "array<array<array<string>>>")
    names = F.array(*[F.lit(f) for f in FAMILIES])

    def judged(paragraph: Column) -> Column:
        words = F.regexp_extract_all(F.lower(paragraph), F.lit("[a-z0-9]+"), F.lit(0))
        two = lambda v: F.transform(F.slice(v, 1, F.greatest(F.size(v) - 1, F.lit(0))), lambda a, i: F.concat_ws(" ", a, F.get(v, i + 1)))
        grams = let(words, lambda v: F.array_distinct(F.concat(v, two(v))))
        return let(grams, lambda g: let(probabilities(g), lambda q: verdict(paragraph, g, q)))

    def probabilities(grams: Column) -> Column:
        at = F.transform(grams, lambda g: F.pmod(F.xxhash64(g), F.lit(n)).cast("int"))
        root = F.sqrt(F.greatest(F.size(grams), F.lit(1)).cast("double"))
        logits = let(at, lambda i: F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda c: F.get(intercepts, c) + F.aggregate(i, F.lit(0.0), lambda s, j: s + F.get(weights, c * n + j)) / root))
        raised = let(logits, lambda z: let(F.array_max(z), lambda m: F.transform(z, lambda v: F.exp(v - m))))
        return let(raised, lambda e: let(F.aggregate(e, F.lit(0.0), lambda s, v: s + v), lambda total: F.transform(e, lambda v: v / total)))

    def verdict(paragraph: Column, grams: Column, q: Column) -> Column:
        best = let(F.array_max(q), lambda m: F.array_position(q, m).cast("int") - 1)

        def overlap(c: Column) -> Column:
            return F.coalesce(F.array_max(F.transform(F.get(templates, c), lambda t: F.when(F.size(t) > 0, F.size(F.array_intersect(t, grams)) / F.size(t)).otherwise(0.0))), F.lit(0.0))

        def found(c: Column) -> Column:
            # words that two families' notices share tell neither, unless a template is there as a whole
            rival = lambda: F.array_max(F.transform(F.sequence(F.lit(0), F.lit(k - 2)), lambda d: F.when(d == c, 0.0).otherwise(overlap(d))))
            return let(overlap(c), lambda s: let((c < k - 1) & (F.get(q, c) >= rules.probability) & (s >= rules.overlap) & ((s >= 1.0) | (s > rival())), lambda ok: F.struct(
                paragraph.alias("paragraph"), F.when(ok, F.get(names, c)).otherwise(F.lit("unknown")).alias("family"), F.get(q, c).alias("probability"), s.alias("overlap"), ok.alias("confirmed"),
            )))

        return let(best, found)

    def identified(paragraph: Column) -> Column:
        """By SPDX identifier, each family of the expression, or else by the model."""
        ids = F.transform(F.regexp_extract_all(F.regexp_extract(paragraph, SPDX, 1), F.lit("[A-Za-z0-9.+-]+"), F.lit(0)), lambda t: F.element_at(spdx, F.regexp_replace(F.lower(t), r"(-only|-or-later|\+)$", "")))
        told = F.array_distinct(F.filter(ids, lambda f: f.isNotNull()))
        given = lambda f: F.struct(paragraph.alias("paragraph"), f.alias("family"), F.lit(1.0).alias("probability"), F.lit(1.0).alias("overlap"), F.lit(True).alias("confirmed"))
        return F.when(paragraph.rlike(SPDX), let(told, lambda v: F.when(F.size(v) > 0, F.transform(v, given)).otherwise(F.array(judged(paragraph))))).otherwise(F.array(judged(paragraph)))

    def windows(sentence: Column) -> Column:
        """The sentence and its windows of words, those with a cue."""
        def cut(w: Column) -> Column:
            starts = lambda n, step: F.when(F.size(w) > n, F.sequence(F.lit(0), F.size(w) - n + step - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
            parts = [F.transform(starts(n, step), lambda i, n=n: F.concat_ws(" ", F.slice(w, i + 1, n))) for n, step in rules.windows]
            return F.filter(F.concat(F.array(sentence), *parts), lambda x: x.rlike(CUE))

        return let(F.split(sentence, r"\s+", -1), cut)

    def lines(sentence: Column) -> Column:
        return F.flatten(F.transform(F.filter(F.split(sentence, CUT, -1), lambda p: p.rlike(CUE)), identified))

    def wrapped(sentence: Column) -> Column:
        """What the lines hold by themselves, and the families that only the joined lines confirm (the first window of each)."""
        def merged(own: Column, found: Column) -> Column:
            has = lambda f: F.exists(own, lambda x: x["confirmed"] & (x["family"] == f))
            more = F.filter(found, lambda x, i: ~has(x["family"]) & (F.array_position(F.transform(found, lambda y: y["family"]), x["family"]) == i + 1))
            return let(more, lambda m: F.when(F.size(m) > 0, F.concat(F.filter(own, lambda x: x["confirmed"]), m)).otherwise(own))

        judged_all = F.filter(F.transform(windows(sentence), judged), lambda x: x["confirmed"])
        return let(lines(sentence), lambda own: let(judged_all, lambda found: merged(own, found)))

    spdx = _literal(SPDX_IDS, "map<string,string>")
    none = F.from_json(F.lit("[]"), "array<struct<paragraph:string,family:string,probability:double,overlap:double,confirmed:boolean>>")
    sentences = F.filter(F.split(text, SENTENCE, -1), lambda s: s.rlike(CUE))
    return F.when(text.rlike(CUE), F.flatten(F.transform(sentences, lambda s: F.when(F.trim(s).contains("\n"), wrapped(s)).otherwise(lines(s))))).otherwise(none)


def scan(docs: DataFrame, rules: LicenceRules = LicenceRules()) -> DataFrame:
    """docs with `licences`: array of (paragraph, family, probability, overlap, confirmed), in the text's order.

    Null and empty texts, and texts without a cue, have none. Rows are independent, texts are read whole; a column
    `licences` is replaced and all others stay."""
    return docs.withColumn("licences", scanned(F.coalesce(F.col("text"), F.lit("")), rules))


def op6_licence_scan(spark, sf_dir: str) -> DataFrame:
    """Confirmed families (sorted), paragraphs with a cue and those left unknown, of every document."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sure = F.filter("licences", lambda p: p["confirmed"])
    return found.select(
        "doc_id", F.array_join(F.sort_array(F.array_distinct(F.transform(sure, lambda p: p["family"]))), ",").alias("families"),
        F.size("licences").cast("long").alias("n_paragraphs"), (F.size("licences") - F.size(sure)).cast("long").alias("n_unknown"),
        F.coalesce(F.array_max(F.transform(sure, lambda p: p["probability"])), F.lit(0.0)).alias("probability"),
    )
