"""The corpus operators: brute force, round trips, held-out accuracy, and rows that are null, empty, long, equal or strange."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sextant.llm import catalog, common, compression, graph, language_mix, lattice, licences, line_rules, pii, similarity, temperature, tiling, weak_labels
from tests.compare import difference

LONG = "word " * 60_000 + "\n" + "9" * 5000 + " a@b.co " + "x" * 40_000
ODD = [(1, "Plain text of a few words, and more.", "en", "s1"), (1, "Plain text of a few words, and more.", "en", "s1"), (2, None, None, None), (3, "", "fr", "s1"), (4, " \n\t ", None, "s2"), (5, "!!! ??? 123", "de", "s2"), (None, "An orphan row without an id", "en", None), (6, LONG, "en", "s1"), (7, "Ünïcödé 😀 text\x00with\x1codd bytes", "de", "s3"), (8, "one", "en", "s1")]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows with columns that clash with what operators make."""
    df = spark.createDataFrame(ODD, SCHEMA)
    clash = {c: F.lit(0) for c in ("score", "n", "at", "prefix", "digest", "kept", "bench_hits", "licences", "pii_base", "pii_added", "epoch", "block", "n_tokens", "word", "key", "rep", "node", "component_id")}
    return df.withColumns(clash)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return common.table(spark, sf_dir, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ---- line rules

def line_counts(t):
    w = words(t)
    runs = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if runs[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, again = set(), 0
    for line in (t or "").split("\n"):
        if words(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), again, len(covered)


def test_line_rules(spark, sf_dir, texts, odd, none):
    for r in line_rules.op3_line_rules(spark, sf_dir).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == line_counts(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept)
    got = sorted(((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in line_rules.clean_lines(odd).collect()))
    assert got == sorted(line_counts(t) for _, t, _, _ in ODD) and line_rules.clean_lines(none).count() == 0
    keep = "A good sentence of enough plain words stands here.\n" * 1
    bad = spark.createDataFrame([(1, "\n".join([keep.strip() + f" number {i} of them." for i in range(9)] + ["Home"]))], "doc_id long, text string")
    assert line_rules.clean_lines(bad).first().cleaned.count("\n") == 8


# ---- language mixture

def test_language(spark, sf_dir, docs, odd, none):
    got = language_mix.op10_language_mixture(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got) and sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    model = language_mix.fit(docs)
    mixed = " ".join(next(r.text for r in docs.filter(f"lang = '{x}' AND length(text) BETWEEN 300 AND 900").orderBy("doc_id").limit(1).collect()) for x in ("en", "fr"))
    assert set(language_mix.mixture(model, mixed)[0]) >= {"en", "fr"}
    out = {(r.doc_id, r.lang_pred) for r in language_mix.identify(odd, model).collect()}
    assert {(2, "und"), (3, "und"), (4, "und"), (5, "und")} <= out
    assert language_mix.keep_identified(odd, model).columns == odd.columns and language_mix.keep_identified(odd, model).count() == 6
    empty = language_mix.fit(none)
    assert empty.langs == [] and {r.lang_pred for r in language_mix.identify(odd, empty).collect()} == {"und"}


# ---- the two classifiers

@pytest.mark.parametrize(("module", "name", "label", "n", "rest"), [(compression, "op9_quality_compression", "quality", 5, 0), (weak_labels, "op1_toxicity_weak", "toxic", 3, 1)])
def test_classifier(spark, odd, none, module, name, label, n, rest):
    sf = "/root/testdata/sf0.01"
    got = catalog.QUERIES[name](spark, sf).join(common.table(spark, sf, "labels"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == rest) and 0 <= r.score <= 1 for r in got)
    assert sum(r.predicted == r[label] for r in held) >= 0.93 * len(held)
    rows = common.labelled(common.table(spark, sf, "documents"), common.table(spark, sf, "labels"), label, lambda i: common.fold(i, n) != rest, 200)
    model = module.fit(rows)
    scored = module.score(odd, model).collect()
    assert len(scored) == len(ODD) and all(r.score == 0 for r in scored if r.doc_id in (2, 3)) and module.score(none, model).count() == 0
    assert {r.score for r in module.score(odd, module.fit([])).collect()} <= {0.0, 0.5}


def test_label_model_trusts_the_better_voter():
    rng = np.random.default_rng(0)
    y = (rng.random(800) < 0.4).astype(float)
    good, bad = np.where(rng.random(800) < 0.95, y, 1 - y), (rng.random(800) < 0.5).astype(float)
    v = np.column_stack([good, bad, bad]) * 2 - 1
    q, right, corr = weak_labels.label_model(v, np.where(rng.random(800) < 0.9, y, 1 - y), weak_labels.ToxicityRules())
    assert right[0] > 0.85 > right[1] and right[-1] > 0.8 and corr[1, 2] > 0.8 and ((q > 0.5) == (y == 1)).mean() > 0.95


# ---- lattice

def test_lattice_base(spark, sf_dir, texts):
    bag, train = {}, Counter()
    for i, t in texts.items():
        bag[i] = [*words(low(t)), None]
        if zlib.crc32(str(i).encode()) % 5 != 1:
            train.update(bag[i])
    n, v = sum(train.values()), len(train)
    for r in lattice.op2_lattice_likelihood(spark, sf_dir).collect():
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(bag[r.doc_id]), sum(train[w] > 0 for w in bag[r.doc_id]), n)
        assert r.base_score == pytest.approx(sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in bag[r.doc_id]), rel=1e-9) and r.score < 0


def test_lattice_is_the_sum_over_segmentations():
    rules = lattice.LatticeRules()
    names, q = lattice.pieces(rules.vocabulary)
    prob, index = dict(zip(names, q, strict=False)), lattice.Index(names)
    assert index.longest == max(map(len, names)) > 20

    def total(data):
        return 1.0 if not data else sum(prob.get(data[:k], 0.0) * total(data[k:]) for k in range(1, len(data) + 1))

    some = [b"the", b"a", "été".encode(), b"zzq", b"thing"]
    got = lattice.marginals(some, np.log(np.maximum(q, 1e-300)), index)
    assert got == pytest.approx([math.log(total(b" " + w)) for w in some])
    uses = lattice.expected([b"the"], np.array([3]), np.log(np.maximum(q, 1e-300)), index)
    assert sum(u * len(x) for u, x in zip(uses, names, strict=False)) == pytest.approx(3 * 4)


def sums(prob, word, n):
    """Sums over the segmentations of the first i and of the last n - i bytes."""
    fore, back = [1.0] + [0.0] * n, [0.0] * n + [1.0]
    for i in range(1, n + 1):
        fore[i] = sum(fore[j] * prob.get(word[j:i], 0.0) for j in range(i))
        back[n - i] = sum(back[n - i + k] * prob.get(word[n - i : n - i + k], 0.0) for k in range(1, i + 1))
    return fore, back


@pytest.mark.parametrize("held", [2, 64])
def test_lattice_scores_by_brute_force(spark, held):
    """The fitted model and all scores, with equal ids, repeated rows and null ids, over partitions and small batches."""
    rng = np.random.default_rng(2)
    base = ["the", "Cat", "sat", "communications", "été", "x" * 30, "naïve", "on", "😀"]
    rows = [(i % 7, " ".join(rng.choice(base, int(rng.integers(0, 9))))) for i in range(40)]
    rows = rows + rows[:20] + [(None, "the cat"), (None, "the cat"), (None, None), (1, ""), (1, "the cat"), (1, "zebra dog")]
    rules = lattice.LatticeRules(batch=3, em_rounds=2, held_batches=held, batch_bytes=60)
    train = F.coalesce(F.col("doc_id"), F.lit(0)) % 3 != 1
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    learn = [t for i, t in rows if (i or 0) % 3 != 1]
    count = Counter(w for t in learn for w in words(low(t)))
    names, start = lattice.pieces(rules.vocabulary)
    q = start
    for _ in range(rules.em_rounds):
        prob, uses = dict(zip(names, q, strict=False)), rules.prior_weight * start
        uses[-1] += len(learn)
        at = {x: i for i, x in enumerate(names)}
        for w, c in count.items():
            data = b" " + w.encode()
            fore, back = sums(prob, data, len(data))
            for i in range(len(data)):
                for j in range(i + 1, len(data) + 1):
                    if data[i:j] in at:
                        uses[at[data[i:j]]] += c * fore[i] * prob[data[i:j]] * back[j] / fore[-1]
        q = uses / uses.sum()
    prob, end = dict(zip(names, q, strict=False)), math.log10(q[-1])
    total = sum(count.values()) + len(learn)

    def want(i, t):
        w = words(low(t))
        plain = [count[x] for x in w] + [len(learn)]
        mine = [math.log10(sums(prob, b" " + x.encode(), len(x.encode()) + 1)[0][-1]) for x in w]
        return i, len(w) + 1, sum(c > 0 for c in plain), total, sum(math.log10((c + 0.5) / (total + 0.5 * (len(count) + 2))) for c in plain), sum(mine) + end

    key = lambda r: (r[0] is None, r[0] or 0, *(round(x, 6) for x in r[1:]))
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lattice.score(df, train, rules).collect()), key=key)
    for g, w in zip(got, sorted((want(*r) for r in rows), key=key), strict=True):
        assert g[:4] == w[:4] and g[4:] == pytest.approx(w[4:])


def test_lattice_odd_rows(odd, none):
    got = lattice.score(odd, F.lit(True)).collect()
    assert len(got) == len(ODD) and {r.n_tokens for r in got if r.doc_id in (2, 3, 4)} == {1} and lattice.score(none, F.lit(True)).count() == 0


# ---- similarity

def brute_components(rows, k, percent):
    sets = []
    for i, t in rows:
        w = words(low(t))
        sets.append((i, frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])))
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, u in sets[:a]:
            if s and u and 100 * len(s & u) >= percent * len(s | u):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(s), root(i)) for i, s in sets)


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_similarity(docs, texts, k, percent):
    got = similarity.linked(docs, similarity.JaccardRules(words=k, percent=percent))
    assert sorted(tuple(r) for r in got.collect()) == brute_components(texts.items(), k, percent)


def test_similarity_blocks(spark):
    """Long lists: near copies of one text, most of which only link by way of it, beside texts that share a passage."""
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 90):
        w = list(base)
        for j in rng.choice(120, int(rng.integers(1, 4)), replace=False):
            w[j] = f"x{i}y{j}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(base[:30] + [f"q{i}z{j}" for j in range(40)])) for i in range(60)]
    want = brute_components(rows, 3, 90)
    for rules in (similarity.JaccardRules(), similarity.JaccardRules(pair_list=3, tile=2000, frequent=1)):
        assert sorted(tuple(r) for r in similarity.linked(spark.createDataFrame(rows, "doc_id long, text string"), rules).collect()) == want


def test_similarity_odd_rows(spark, odd, none):
    got = {(r.doc_id, r.component_id) for r in similarity.linked(odd.filter("doc_id IS NOT NULL")).collect()}
    assert {(2, 2), (3, 3), (4, 4), (1, 1)} <= got and similarity.linked(none).count() == 0
    twice = spark.createDataFrame([(1, "a b c"), (1, "x y z q"), (2, "x y z q")], "doc_id long, text string")
    assert {r.component_id for r in similarity.linked(twice).collect()} == {1}


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 50 + 60), (110, 120), (7, 7)], "u long, v long").repartition(7)
    got = {r.node: r.component for r in graph.components(e).collect()}
    assert all(got[i] == 1 for i in range(2, 41)) and got[110] == got[120] == 100 and 7 in got


# ---- mixture

def test_mix_sql(spark, con, sf_dir, odd, none):
    assert difference(spark, con, sf_dir, temperature.op5_temperature_mix, temperature.ORACLE) == ""
    assert temperature.mix(none).count() == 0
    assert {r.doc_id for r in temperature.mix(odd).collect()} <= {1, 5, 6, 7, 8, None}


def test_mix_of_a_hot_source(spark, con):
    rows = [(i, "w " * (5 + i % 7), "hot" if i % 10 < 7 else f"s{i % 10}") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = temperature.mix(df)
    con.register("mix_docs", df.toPandas())
    want = con.execute(temperature.SQL.replace("{docs}", "mix_docs")).fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    share = {r.source: r.s for r in got.groupBy("source").agg(F.sum("n_tokens").alias("s")).collect()}
    p = np.array(list(share.values()), float) / sum(share.values())
    assert share["hot"] / sum(share.values()) < 0.6 and -(p * np.log(p)).sum() == pytest.approx(0.97 * math.log(4), abs=0.01)
    assert got.agg(F.max("epoch")).first()[0] <= 3
    per = got.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.max("place").alias("m")).collect()
    assert all(r.n == r.m for r in per)


# ---- licences

def test_licences(spark, texts, docs, odd, none):
    phrases = {"Apache License, Version 2.0": "apache-2.0", "MIT License": "mit", "CC BY-NC": "cc-by-nc", "General Public License, version 3": "gpl-3", "All rights reserved": "proprietary"}
    for r in licences.scan(docs.select("doc_id", "text")).collect():
        assert {p.family for p in r.licences if p.confirmed} == {f for t, f in phrases.items() if t in texts[r.doc_id]}
    given = spark.createDataFrame([(1, "The license plate was lost on the road."), (2, "This work is licensed under the GNU General Public License, version 2.")], "doc_id long, text string")
    assert [[p.family for p in r.licences] for r in licences.scan(given).orderBy("doc_id").collect()] == [["unknown"], ["gpl-2"]]
    assert licences.scan(odd).count() == len(ODD) and licences.scan(none).count() == 0
    grams = ["under the", "licence", "4 0"]
    assert [r.h for r in spark.createDataFrame([(g,) for g in grams], "g string").select(F.pmod(F.xxhash64("g"), F.lit(1024)).alias("h")).collect()] == [licences._slot(g, 1024) for g in grams]


# ---- personal data

def base_spans(t):
    t, out = t or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_pii(spark, sf_dir, texts, odd, none):
    for r in pii.op7_pii_boosted(spark, sf_dir).collect():
        want = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want).encode()).hexdigest()
        assert set(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want) <= set(r.spans.split(","))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == j for _, k, _ in want) for j in range(4))
    hard = ["a..b@c.d.e..f x@y. a@b.c_x@d.e +1 (234) 555-1234 1-2 3 4111 1111 1111 1111  4111-1111-1111-1111- 300.1.1.1 1.2.3.4.5.6.7.8 00255.1.2.3", "😀 a@b.co 12 34--4111111111111111 5", "9" * 9000 + " " + "1 2 " * 9000 + "a.b@" + "c." * 9000 + "d", None, ""]
    df = spark.createDataFrame(list(enumerate(hard)), "doc_id long, text string")
    for r in pii.find(df).collect():
        assert [tuple((s.start, s.rank, s.end)) for s in r.pii_base] == base_spans(r.text)
    secret = spark.createDataFrame([(1, 'x token = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B" y a@b.co z'), (2, "nothing here 2024"), (3, None)], "doc_id long, text string")
    assert [r.text for r in pii.redact(secret).orderBy("doc_id").collect()] == ['x token = "[SECRET]" y [EMAIL] z', "nothing here 2024", None]
    assert pii.redact(odd).columns == odd.columns and pii.redact(odd).count() == len(ODD) and pii.redact(none).count() == 0


def test_pii_features_agree(spark):
    rules = pii.PiiRules(examples_a_kind=2)
    given = [("secret", "9233A8ECF7C5B09FE594", 'token = "', '"'), ("secret", "abcdefghijklmnopqrstu", "part ", " "), ("local_phone", "555-123-4567", "call ", " ")]
    for kind, value, before, after in given:
        row = spark.range(1).select(F.array(*pii.features(kind, F.lit(value), F.lit(before), F.lit(after))).alias("x")).first().x
        assert row == pytest.approx(pii._measure(kind, value, before, after))
    assert len(pii.examples(rules)[0]) == len(pii.examples(rules)[1])


# ---- tiling

def test_tiling(spark, docs, sf_dir, odd, none):
    bench = common.table(spark, sf_dir, "benchmark")
    items = {r.item_id: r.text for r in bench.collect()}
    long = [i for i, t in items.items() if len(t.split()) >= 30]
    w = items[long[0]].split()
    rows = [(1, " ".join(w[15:] + ["and", "then"] + w[:15])), (2, "hello world " * 50 + items[long[1]].upper()), (3, " ".join(w[:7])), (4, "clean words only " * 20)]
    got = {r.doc_id: r.bench_hits for r in tiling.tilings(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got[1][0].item_id == long[0] and got[1][0].coverage >= 0.9 and len(got[1][0].tiles) == 2
    assert got[2][0].item_id == long[1] and got[2][0].coverage == 1.0 and got[3][0].coverage < 0.5 and got[4] == []
    whole, small = (tiling.tilings(docs.select("doc_id", "text"), bench, r).orderBy("doc_id").collect() for r in (tiling.TilingRules(), tiling.TilingRules(table_bits=6)))
    assert whole == small  # a full bit table lets every place through, and the join finds the same
    assert tiling.clean(odd, bench).columns == odd.columns and tiling.clean(none, bench).count() == 0 and tiling.clean(odd, bench.limit(0)).count() == len(ODD)


# ---- the pipeline

def test_pipeline(spark, sf_dir, docs, texts, odd):
    pipeline = pytest.importorskip("corpus_pipeline")
    out = pipeline.run(spark, sf_dir).collect()
    model = language_mix.fit(docs.filter(common.fold(F.col("doc_id"), 5) != 0))
    rows = {i: t for i, t in texts.items() if language_mix.mixture(model, t)[0]}
    rows = {i: t for i, t in rows.items() if any(i == c for d, _, c in brute_components(rows.items(), 5, 80) if d == i)}
    bench = [[w for w in tiling.plain_words((r.text or '').split()) if w] for r in common.table(spark, sf_dir, "benchmark").collect()]

    def leaks(t):
        w = [x for x in tiling.plain_words(t.encode().lower().decode().split()) if x]
        grams = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        best = 0.0
        for b in bench:
            k = min(5, len(b))
            hit = {j for i in range(len(b) - k + 1) if tuple(b[i : i + k]) in (grams if k == 5 else {tuple(w[x : x + k]) for x in range(len(w) - k + 1)}) for j in range(i, i + k)}
            best = max(best, len(hit) / len(b) if b else 0)
        return best >= 0.5

    clean = {i for i, t in rows.items() if not leaks(t)}
    assert {r.doc_id for r in out} == clean
    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, odd, sf_dir).columns == odd.columns, name
    assert temperature.mix(odd).columns == temperature.mix(docs).columns


def test_catalog():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES) == list(range(1, 14)) and set(catalog.ORACLES) <= set(catalog.QUERIES)
