"""Exact search, the Merkle manifest and the alignment of tokenizers: SQL, brute force, and odd rows."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sextant.llm import alignment, catalog, merkle, topk
from tests.compare import difference

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", ["op11_exact_topk", "op12_merkle_manifest"])
def test_sql(spark, con, sf_dir, name):
    assert difference(spark, con, sf_dir, catalog.QUERIES[name], catalog.ORACLES[name]) == ""


# ---- top k

def best(vectors, k, is_query=lambda i: i is not None and i % 20 == 0):
    """Rows of all queries, by comparing each with every other row."""
    rows = [(i, [math.floor(64 * x) for x in v]) for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, v) in enumerate(rows):
        if is_query(i):
            found = sorted((-sum(a * b for a, b in zip(v, w)), j is None, j or 0, j) for m, (j, w) in enumerate(rows) if m != n)[:k]
            out += [(i, r + 1, j, -s) for r, (s, _, _, j) in enumerate(found)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("rules", [topk.TopKRules(), topk.TopKRules(k=3, candidates=7, queries=2)])
def test_top_k_of_odd_vectors(spark, rules):
    """Nulls, gaps, NaN, infinities, ties, repeated rows and ids, empty and short vectors, one vector in a third of the rows."""
    rng = np.random.default_rng(3)
    draw = lambda: [float(x) for x in rng.normal(0, 0.3, 8) * (rng.random(8) < 0.4)]
    rows = [(i, draw()) for i in range(60)] + [(100 + i, [0.5] * 8) for i in range(40)] + [(40, [0.5] * 8), (40, [0.5] * 8), (None, [0.5] * 8), (None, draw())]
    rows += [(200, None), (220, [0.1, None]), (240, [math.nan, 1.0]), (260, [math.inf]), (280, []), (300, [1.0, -2.0]), (320, [0.0] * 8), (340, [-9.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5).withColumns({"row": F.lit(1), "score": F.lit(2), "stripe": F.lit(0)})
    got = sorted((tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, rules).collect()), key=repr)
    assert got == best(rows, rules.k)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert topk.top_k(df.filter("vec_id = 20"), F.col("vec_id") % 20 == 0).count() == 0  # no other row


def test_top_k_of_large_weights(spark):
    """Sums beyond 32 and 64 bits: exact order, scores that end at a long's range."""
    rows = [(0, [1e6, 1.0]), (1, [1e6, 0.5]), (2, [1e6, 0.25]), (20, [1e15, 3.0]), (3, [-1e15, 0.0]), (4, [1e300, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") == 0, topk.TopKRules(k=4)).orderBy("rank").collect()]
    assert [r[2] for r in got] == [4, 20, 1, 2] and got[0][3] == (1 << 63) - 1
    assert got[2][3] == (64 * 10**6) ** 2 + 64 * 32
    small = df.filter("vec_id < 3")
    assert sorted((tuple(r) for r in topk.top_k(small, F.col("vec_id") == 0).collect())) == best(rows[:3], 20)


# ---- Merkle manifest

def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves, fanout=8):
    """The root of some digests, and each one's (before, after) on its way to it."""
    ways, at, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        for i, p in enumerate(at):
            run = nodes[p // fanout * fanout : p // fanout * fanout + fanout]
            ways[i].append(("".join(run[: p % fanout]), "".join(run[p % fanout + 1 :])))
        at, nodes = [p // fanout for p in at], [sha(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
    return nodes[0], ways


def manifest_of(rows):
    put = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    low = lambda t: t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    leaf = lambda d, t, g, s, n: sha(*map(put, (d, s, g, n, t)))
    groups = defaultdict(list)
    for d, t, g, s, n in rows:
        other = d is not None and zlib.crc32(str(d).encode()) % 3 == 0
        groups[g].append((d is not None, d or 0, leaf(d, t, g, s, n), leaf(d, low(t) if other else t, g, s, n), d))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g])]) for g in names}
    root, tops = tree([trees[g][0] for g in names])
    out = []
    for g, top in zip(names, tops, strict=True):
        for (_, _, own, changed, d), way in zip(sorted(groups[g]), trees[g][1], strict=True):
            node = changed
            for a, b in way + top:
                node = sha(a, node, b)
            out.append((d, own, trees[g][0], root, sha(*[a + b for a, b in way + top]), node, node == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [(1,), (8,), (9,), (0, 1, 8, 64, 65), (3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 513)])
def test_manifest_by_trees(spark, sizes):
    """Lone leaves, full and part-filled runs, one and several languages; null language and id, repeated rows, clashing columns."""
    rows, at = [], 0
    for g, n in enumerate(sizes):
        lang = None if g == 0 else f"l{g}" if g % 2 else f"Ü{g}"
        for _ in range(n):
            rows.append((at, f"Text {at} é" if at % 5 else (None if at % 2 else ""), lang, None if at % 3 else "s", None if at % 4 else at))
            at += 1
    rows += [rows[-1], (None, "No Id", "l1", None, 3), (None, "No Id too", "l1", None, 3), (at, "WORD " * 50_000, "l1", "s", 1)] if len(sizes) > 1 else []
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit(1) for c in ("g", "at", "n", "digest", "key", "name", "root", "steps", "c", "leaf")})
    own = df.select("doc_id", "text", "lang", "source", "n_chars", *[c for c in df.columns if c not in SCHEMA])
    got = merkle.manifest(own, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == manifest_of(rows)


def test_manifest_of_nothing(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0


def test_manifest_tells_any_change(spark):
    """A change of any covered column of a row shows in its check, and only there."""
    rows = [(i, f"text {i}", "en", "s", i) for i in range(20)]
    found = {r.doc_id: r for r in merkle.manifest(spark.createDataFrame(rows, SCHEMA), F.lit(False)).collect()}
    assert all(r.verified and r.folded_root == r.root for r in found.values()) and len({r.leaf for r in found.values()}) == 20
    other = {r.doc_id: r for r in merkle.manifest(spark.createDataFrame([(*rows[7][:4], 99)] + rows[:7] + rows[8:], SCHEMA), F.lit(False)).collect()}
    assert other[7].leaf != found[7].leaf and other[3].leaf == found[3].leaf and other[3].root != found[3].root


# ---- alignment of tokenizers

def pair_of(rules=alignment.AlignmentRules()):
    return alignment.Pair(open(rules.byte_level, "rb").read(), open(rules.pieces, "rb").read())


def linked_by_hand(pair, text):
    """(A ids, B ids, groups, links) of a text encoded as one string, by comparing the byte ranges of all neighbours."""
    if not text:
        return [], [], "", []
    whole, sides = (" " + text).encode(), []
    for which, ids in ((0, pair.a.encode(" " + text, add_special_tokens=False).ids), (1, pair.b.encode(text))):
        size, start, data = pair.tables[which]
        said = [data[start[i] : start[i] + size[i]].tobytes() for i in ids]
        if b"".join(said) != whole:
            return [], [], "", []
        ends = np.cumsum([len(x) for x in said]).tolist()
        sides.append(list(zip(ids, [0, *ends[:-1]], ends, strict=True)))
    links, groups, a, b = [], [], [], []
    x, y = iter(sides[0]), iter(sides[1])
    p, q = next(x), next(y)
    a.append(p[0]), b.append(q[0])
    while True:
        links.append((p[0], q[0]))
        if p[2] == q[2]:
            groups.append(f"{','.join(map(str, a))}|{','.join(map(str, b))}")
            a, b = [], []
        stop = min(p[2], q[2])
        moved = [s for s, t in ((0, p), (1, q)) if t[2] == stop]
        if stop == len(whole):
            break
        if 0 in moved:
            p = next(x)
            a.append(p[0])
        if 1 in moved:
            q = next(y)
            b.append(q[0])
    return [t[0] for t in sides[0]], [t[0] for t in sides[1]], ";".join(groups), links


def scores_by_hand(pair, rows):
    found = [(d, linked_by_hand(pair, t)) for d, t in rows]
    count = Counter(link for _, (_, _, _, links) in found for link in set(links))
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    out = []
    for d, (a, b, groups, links) in found:
        digest = hashlib.sha256(groups.encode()).hexdigest() if a else ""
        out.append((d, len(a), len(b), len(groups.split(";")) if a else 0, len(links), sum(count[x] == most[x[0]] for x in links), sum(count[x] for x in links), digest))
    return sorted(out, key=repr)


STRANGE = [
    None, "", " ", "  ", "a", " a", "a ", "a  ", "a  b", "a\n b", "a \n  b\n\n c ", "\n", "\t\tx", "x  y", "y　 z   w", "<s> </s> <unk> <0x41> <|endoftext|> x", "a▁b c", "▁", "plain words ▁ here", "naïve café über ß Ünïcödé", "日本語 の テキスト です", "😀 👩‍👩‍👧 emoji", "don't can't 'll we're",
    "x" * 5000, "ab " * 4000, "\x00 \x01 \x7f \x1c y", "\u0085 next", "1 22 333 4444 55555", "!!! ??? ...", "é combining", "ﬁ ligature Ω Ａ", "x  " * 300, "same words", "same words", "same words same words",
]


@pytest.mark.parametrize("rules", [alignment.AlignmentRules(), alignment.AlignmentRules(block_bytes=200, block_docs=9, slice_bytes=50), alignment.AlignmentRules(block_docs=1)])
def test_alignment_of_strange_texts(spark, rules):
    rows = [(i if i % 7 else None, t) for i, t in enumerate(STRANGE)] + [(2, "twice"), (2, "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({c: F.lit(1) for c in ("block", "place", "pair", "docs", "seen", "n_a")})
    got = sorted((tuple(r) for r in alignment.aligned(df, rules).collect()), key=repr)
    assert got == scores_by_hand(pair_of(rules), rows)
    assert alignment.aligned(df.limit(0), rules).count() == 0


def test_op13_by_hand(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted((tuple(r) for r in alignment.op13_cross_alignment(spark, sf_dir).collect()), key=repr)
    assert got == scores_by_hand(pair_of(), [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_pair_counts_and_links(spark):
    """Documents and links of each pair, through bitmaps with a few places and with many, and multiplicities of many planes."""
    rows = [(i, "the " * (1 + i % 37) + ("rare" if i == 5 else "")) for i in range(200)]
    file = alignment.inverted(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    pair = pair_of()
    found = [linked_by_hand(pair, t)[3] for _, t in rows]
    got = {(r.a_id, r.b_id): (r.documents, r.links) for r in alignment.pair_counts(file).collect()}
    documents, links = Counter(x for f in found for x in set(f)), Counter(x for f in found for x in f)
    assert got == {x: (documents[x], links[x]) for x in links}


def test_bitmaps_round_trip():
    rng = np.random.default_rng(1)
    for docs in (1, 15, 16, 17, 1000, 30_000):
        key, place = np.divmod(np.unique(rng.integers(0, 40, 3000) ** 2 // 40 * docs + rng.integers(0, docs, 3000)), docs)
        own, maps = alignment.pack_bitmaps(key, place, docs)
        row, at = alignment.places(maps, docs)
        assert sorted(zip(own[row].tolist(), at.tolist())) == list(zip(key.tolist(), place.tolist()))
