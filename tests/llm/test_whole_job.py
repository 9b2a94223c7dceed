"""Places where an operator once did less than the whole job."""

from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sextant.llm import compression, language_mix, lattice, licences, similarity, tiling


def joined(n, edges):
    """The components of nodes 0 to n - 1, as a set of node sets."""
    parts = {i: {i} for i in range(n)}
    for u, v in edges:
        both = parts[u] | parts[v]
        parts.update(dict.fromkeys(both, both))
    return {frozenset(x) for x in parts.values()}


def all_links(sets, percent):
    return [(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(np.intersect1d(sets[i], sets[j])) >= percent * len(np.union1d(sets[i], sets[j]))]


def test_block_links_in_all_row_orders():
    """Two clusters whose only link is a bridge pair: whichever is the largest component first, the bridge is found."""
    chain = [np.arange(5 * i, 5 * i + 10, dtype=np.uint64) for i in range(5)]
    left, right = ([np.concatenate([np.arange(a, a + 20), [a + 900 + i]]).astype(np.uint64) for i in range(n)] for a, n in ((1000, 2), (5000, 3)))
    bridge = [np.concatenate([np.arange(1000, 1020), np.arange(7000, 7020)]).astype(np.uint64), np.concatenate([np.arange(5000, 5020), np.arange(7000, 7020)]).astype(np.uint64)]
    for sets, percent in ((chain, 30), (left[:1] + bridge + right, 33), (left + bridge + right[:2], 33)):
        assert len(joined(len(sets), all_links(sets, percent))) == 1
        for order in permutations(range(len(sets))):
            rows = [sets[i] for i in order]
            assert len(joined(len(rows), similarity.block_links(rows, percent))) == 1, order


def test_null_doc_ids_take_no_links_from_others(spark):
    """Texts with and without an id, near copies of each other, by short lists (pairs) and by long ones (blocks)."""
    base = [f"w{i}" for i in range(80)]
    text, near = " ".join(base), " ".join([*base[:-1], "other"])
    for copies in (1, 50):
        more = [(10 + i, " ".join([f"x{i}", *base])) for i in range(copies)]
        rows = [(1, text), (None, text), (2, near), (None, near), (None, "no one else has these words"), (None, None), *more]
        got = similarity.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == [(1, 1), (2, 1), *((i, 1) for i, _ in more)]
        assert sorted((r.n_shingles, r.component_id) for r in got if r.doc_id is None) == [(0, None), (4, None), (78, None), (78, None)]


def test_lattice_of_a_table_held_twice(spark):
    """Partitions with the same ids and token counts, with equal or with other texts, are scored as one partition is."""
    rows = [(1, "the quick fox"), (2, "a slow dog"), (None, None), (None, "")]
    other = [(1, "ran to home"), (2, "the end came"), *rows[2:]]
    parts = spark.createDataFrame(spark.sparkContext.parallelize([*rows, *rows, *other], 3), "doc_id long, text string")
    assert [len(x) for x in parts.rdd.glom().collect()] == [4, 4, 4]
    got, want = (sorted(((r.doc_id or 0, r.n_tokens, r.n_known, r.base_score, r.score) for r in lattice.score(x, F.col("text") != "").collect()), key=lambda r: (r[0], round(r[3], 6), round(r[4], 6))) for x in (parts, parts.coalesce(1)))
    assert len(got) == 12
    for g, w in zip(got, want, strict=True):
        assert g[:3] == w[:3] and g[3:] == pytest.approx(w[3:])


WRAPPED = {
    "bsd": "Copyright (c) 2020, A. Person\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:",
    "gpl-2": " * This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation; either version 2 of the License, or\n * (at your option) any later version.\n *\n * More.",
    "gpl-3": "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.",
    "lgpl": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:",
}


def test_wrapped_licences(spark):
    """Headers in their usual wrapping, a heading and SPDX identifiers; a blank line or other text joins nothing."""
    given = [({f}, f"Some words before.\n\n{t}\n\nand words after") for f, t in WRAPPED.items()]
    given += [({"mit"}, "MIT License"), ({"mit", "apache-2.0"}, "// SPDX-License-Identifier: (MIT OR Apache-2.0)"), ({"gpl-2"}, "x\n/* SPDX-License-Identifier: GPL-2.0-or-later */\ny"), (set(), "SPDX-License-Identifier: Zlib")]
    given += [({"proprietary"}, "# All rights\n# reserved."), ({"public-domain"}, "This is free and unencumbered software released into the public\ndomain.")]
    given += [(set(), "Redistribution and use in source\n\nand binary forms, with or without"), (set(), "she lost the license\nplate of her car and\ngave permission to look for it")]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(given)], "doc_id long, text string")
    got = [{p.family for p in r.licences if p.confirmed} for r in licences.scan(df).orderBy("doc_id").collect()]
    assert got == [f for f, _ in given]


def test_tiling_splits_items_and_documents_alike(spark):
    """An exact copy of an item covers it whole, whatever white space stands between its words, on either side."""
    w = [f"word{i}" for i in range(12)]
    spaces = [" ", "\u00a0", "\u3000", "\u2009", "\x1c", "\x1f", "\x85", "\u2028", "\u202f", "\u1680"]
    texts = [(i, s.join(w)) for i, s in enumerate(spaces)] + [(90, "\u00a0".join(w[:4]) + " " + " ".join(w[4:]))]
    assert all(t.split() == w for _, t in texts)
    docs, items = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(texts, "item_id long, text string")
    got = tiling.tilings(docs, items).collect()
    assert [[(h.item_id, h.coverage) for h in r.bench_hits] for r in got] == [[(i, 1.0) for i, _ in texts]] * len(texts)


def test_language_stage_without_any_lang(spark):
    """A table with null lang only: texts with a letter stay, as with a model, and the others go."""
    rows = [(1, "plain text"), (2, None), (3, ""), (4, "12 !?"), (5, "\u4e2d\u6587"), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    kept = language_mix.keep_identified(docs, language_mix.fit(docs))
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [1, 5, None]


def test_dictionaries_learn_from_whole_texts():
    """What stands only after the first blocks of long texts reaches the dictionary of their class."""
    rng = np.random.default_rng(1)
    said = lambda words, n: " ".join(rng.choice(words, n))
    rules = compression.CompressionRules()
    start = [f"early{i}" for i in range(300)]
    rows = [{"doc_id": i, "label": i % 2, "text": said(start, 1500) + " " + said([f"later{i % 2}x{j}" for j in range(300)], 6000)} for i in range(60)]
    model = compression.fit(rows, rules)
    assert b"later1x" in model.good and b"later0x" in model.bad and b"later0x" not in model.good


def test_calibration_judges_rows_that_trained_nothing():
    """Labels that say nothing: the dictionaries know their own rows by heart, and still no text gets a sure score."""
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(4000)]
    rows = [{"doc_id": i, "label": int(rng.integers(0, 2)), "text": " ".join(rng.choice(words, 200))} for i in range(300)]
    model = compression.fit(rows)
    c = model.compressors()
    x = (compression._second_order(np.array([compression.sizes(r["text"], c, model.rules.block) for r in rows[:200]])) - model.mean) / model.scale
    score = 1 / (1 + np.exp(-(np.c_[x, np.ones(len(x))] @ model.weights)))
    judge = (np.random.default_rng(7).permutation(len(rows)) % model.rules.calibrates == 0)[:200]
    gap = score[judge][[r["label"] == 1 for r, j in zip(rows[:200], judge) if j]].mean() - score[judge][[r["label"] == 0 for r, j in zip(rows[:200], judge) if j]].mean()
    assert gap < 0.6


def test_language_stage_keeps_wanted_languages(spark):
    """A language outside the wanted ones goes; a null lang is filled in; the columns stay."""
    en, de = "the cat sat on the mat and looked at the moon", "der hund lief durch den wald und bellte den mond an"
    rows = [(i, en if i % 2 else de, "en" if i % 2 else "de", i) for i in range(40)] + [(100, en, None, 1), (101, de, None, 2), (102, None, "en", 3), (103, "12", "en", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    model = language_mix.fit(docs)
    everything = {r.doc_id: r.lang for r in language_mix.keep_identified(docs, model).collect()}
    assert set(everything) == {*range(40), 100, 101} and everything[100] == "en" and everything[101] == "de"
    some = language_mix.keep_identified(docs, model, ("en",))
    assert some.columns == docs.columns and {r.doc_id for r in some.collect()} == {*range(1, 40, 2), 100}


def test_short_items_prove_nothing(spark):
    """Items of one to four words are in clean texts too: they remove none, and are told."""
    items = spark.createDataFrame([(1, "Paris"), (2, "Yes!"), (3, None), (4, "..."), (5, "one two three four five")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "I went to Paris last summer and it rained."), (2, "yes"), (3, "ONE two, three four five")], "doc_id long, text string")
    assert sorted(r.doc_id for r in tiling.clean(docs, items).collect()) == [1, 2]
    assert sorted((r.item_id, r.words) for r in tiling.short_items(items).collect()) == [(1, 1), (2, 1), (3, 0), (4, 0)]
    assert sorted(r.doc_id for r in tiling.clean(docs, items.filter("item_id < 5")).collect()) == [1, 2, 3]
