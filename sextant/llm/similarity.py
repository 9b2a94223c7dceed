"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence, exact at any group size.

1. Documents with one set of n-grams become one row of the incidence.
2. A set's prefix - its first n - ceil(s n) + 1 n-grams in an order common to all - holds an n-gram of every set that
   reaches the similarity. The order puts the n-grams that are frequent anywhere last; it decides how many candidates
   there are and never which links are found.
3. Short lists of an n-gram give pairs, whose overlaps within the prefixes are accumulated; pairs whose sizes and
   overlap exclude the similarity are discarded, and the overlap of the rest is counted over their whole sets.
4. Long lists become blocks, by n-gram, band of sizes and tile; in a block, rows of the product are computed whole,
   starting with the row nearest to the block's common n-grams, and only for rows outside the largest component found
   so far; when another component becomes the largest, the rows left out of the former one are taken up again: no link
   between components can be missed, and a group of thousands of near copies costs no square of pairs.
5. Components are joined by stars."""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant.llm.common import batched, kept, swept, table, tokens
from sextant.llm.graph import components


@dataclass(frozen=True)
class JaccardRules:
    """Parameters: words a shingle, similarity in percent, cells of the count table that frequent n-grams may mark,
    longest list that becomes pairs, n-grams of a tile, documents of a slice,
    and the base-2 logarithm of the count table's size (a task holds that many bytes, an eighth goes to every task)."""

    words: int = 3
    percent: int = 90
    frequent: int = 2_000_000
    pair_list: int = 32
    tile: int = 1_000_000
    slice: int = 1000
    cells: int = 25


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts, k: int) -> list[np.ndarray]:
    """Each text's different shingles of k words as sorted 64-bit hashes; a shorter text is one shingle, an empty none."""
    row, code, words = tokens(texts)
    own = np.fromiter((xxhash.xxh64_intdigest(w) for w in words.cast(pa.binary()).to_pylist()), np.uint64, len(words))
    h = own[code]
    bounds = np.searchsorted(row, np.arange(len(texts) + 1))
    joined = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k):
        joined = _mixed(joined * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(joined)] + np.uint64(1))
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(joined[a : b - k + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            short = np.full(1, b - a, np.uint64)
            for j in range(a, b):
                short = _mixed(short * np.uint64(0x9E3779B97F4A7C15) + h[j] + np.uint64(7))
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _sliced(batches, size: int):
    for b in batches:
        for i in range(0, b.num_rows, size):
            yield b.slice(i, size)
            pa.default_memory_pool().release_unused()


def _is_marked(marks: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each shingle's cell is marked in a table of `frequent_shingles`."""
    cell = h >> np.uint64(64 - 3 - (len(marks).bit_length() - 1))
    return (marks[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def frequent_shingles(docs: DataFrame, rules: JaccardRules) -> np.ndarray:
    """A bit table of 2**cells bits that marks the cells of shingles which recur among different sets.

    A task counts all its shingles by cell (a stretch of their hashes); the tasks' counts are added up section by section,
    so that a shingle is found however thinly it is spread. A cell is marked if it holds more than a cell of rare shingles
    may by chance; where too many would be, those with the most. A rare shingle in a marked cell costs nothing but its place."""
    section = min(16, rules.cells)
    sections, most = 1 << rules.cells - section, max(1, rules.frequent >> rules.cells - section)

    def count(batches):
        cells, seen = np.zeros(1 << rules.cells, np.uint8), set()
        for b in _sliced(batches, rules.slice):
            new = {}
            for s in shingle_sets(b.column(0), rules.words):
                new.setdefault(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), s)
            flat = np.concatenate([np.zeros(0, np.uint64), *[s for d, s in new.items() if d not in seen]])
            seen.update(new)
            at, n = np.unique(flat >> np.uint64(64 - rules.cells), return_counts=True)
            cells[at] = np.minimum(cells[at] + n, 255)
        for i, part in enumerate(cells.reshape(sections, -1)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([pa.compress(part.tobytes(), "zstd", asbytes=True)], pa.binary())], names=["section", "counts"])

    def mark(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        n = np.zeros(1 << section, np.int64)
        for x in rows.column("counts"):
            n += np.frombuffer(pa.decompress(x.as_py(), 1 << section, "zstd"), np.uint8)
        rare = float(np.median(n)) if len(n) else 0.0
        over = np.flatnonzero(n >= max(3.0, rare + 4 * math.sqrt(rare)))
        marked = np.zeros(1 << section, bool)
        marked[over[np.argsort(-n[over], kind="stable")[:most]]] = True
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(marked, bitorder="little").tobytes()], pa.binary())], names=["section", "marks"])

    with swept(docs.sparkSession):
        found = batched(docs).select("text").mapInArrow(count, "section int, counts binary").groupBy("section").applyInArrow(mark, "section int, marks binary").toArrow()
    out = np.zeros((sections, 1 << section - 3), np.uint8)
    for i, x in zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True):
        out[i] = np.frombuffer(x, np.uint8)
    return out.reshape(-1)


def prefix_length(n: int, percent: int) -> int:
    """How many first elements of an n-set hold one of every set with the similarity."""
    return n - (percent * n + 99) // 100 + 1 if n else 0


def incidence(docs: DataFrame, rules: JaccardRules) -> DataFrame:
    """doc_id, n, digest of the set, prefix and place of the prefix's end in the order of each row of docs (doc_id, text)."""
    last = frequent_shingles(docs, rules)

    def rows(batches):
        for b in _sliced(batches, rules.slice):
            sets = shingle_sets(b.column(1), rules.words)
            flat = np.concatenate([np.zeros(0, np.uint64), *sets])
            late = _is_marked(last, flat)
            prefix, ends, start = [], [], 0
            for s in sets:
                part = late[start : start + len(s)]
                start += len(s)
                p = prefix_length(len(s), rules.percent)
                first = s[~part][:p]
                more = s[part][: p - len(first)]
                prefix.append(np.concatenate([first, more]).view(np.int64))
                end = more if len(more) else first
                ends.append((len(more) > 0, int(end[-1] >> np.uint64(1)) if len(end) else 0))
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(prefix, pa.list_(pa.int64())), pa.array([e[0] for e in ends], pa.bool_()), pa.array([e[1] for e in ends], pa.int64())], names=["doc_id", "n", "digest", "prefix", "end_late", "end_at"])

    return batched(docs).mapInArrow(rows, "doc_id long, n long, digest binary, prefix array<long>, end_late boolean, end_at long")


def id_marks(ids: DataFrame, cells: int) -> np.ndarray:
    """A bit table of 2**cells bits that marks the hashes of the doc_ids: 4 MB for 2**25, however many ids there are."""
    at = _id_cell(cells) + 1
    with swept(ids.sparkSession):
        found = ids.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).toArrow()
    out = np.zeros((max(1, 1 << cells >> 15), 4096), np.uint8)
    for bucket, bits in zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True):
        out[bucket - 1] = np.frombuffer(bits, np.uint8)
    return out.reshape(-1)


def _id_cell(cells: int):
    return F.pmod(F.xxhash64("doc_id"), F.lit(1 << cells))


def full_sets(docs: DataFrame, wanted: DataFrame, rules: JaccardRules) -> DataFrame:
    """digest and whole set of each row of docs whose doc_id is in wanted, equal sets once, and of some other rows.

    Texts stay where they are read: a bit table of the wanted ids goes to them, which lets a few others pass."""
    marks = id_marks(wanted, rules.cells)

    def rows(batches):
        for b in _sliced(batches, rules.slice):
            cell = b.column(1).to_numpy()
            texts = b.column(0).filter(pa.array((marks[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1))
            seen = {}
            for s in shingle_sets(texts, rules.words) if len(texts) else []:
                seen.setdefault(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), s)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array([s.view(np.int64) for s in seen.values()], pa.list_(pa.int64()))], names=["digest", "grams"])

    return batched(docs).select("text", _id_cell(rules.cells).alias("cell")).mapInArrow(rows, "digest binary, grams array<long>").dropDuplicates(["digest"])


def block_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join the same components as all links among the sets do, by whole rows of the sparse product."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    grams, code, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    starts = np.concatenate(([0], sizes.cumsum()[:-1]))
    common = df * 2 > n
    inside = np.add.reduceat(common[code].astype(np.int64), starts)
    far = common.sum() + sizes - 2 * inside
    parent = np.arange(n)

    def root(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = int(parent[v])
        return v

    out, done, mark = [], np.zeros(n, bool), np.zeros(len(grams), np.int64)
    order = list(np.argsort(far, kind="stable"))[::-1]
    weight = np.ones(n, int)
    main, skipped = int(order[-1]), []
    while order:
        x = int(order.pop())
        if done[x]:
            continue
        if weight[root(main)] > 1 and root(x) == root(main):
            skipped.append(x)
            continue
        done[x] = True
        mine = code[starts[x] : starts[x] + sizes[x]]
        mark[mine] = 1
        both = np.add.reduceat(mark[code], starts)
        mark[mine] = 0
        # sizes bound the overlap before it is compared
        linked = np.nonzero((100 * np.minimum(sizes, sizes[x]) >= percent * np.maximum(sizes, sizes[x])) & (100 * both >= percent * (sizes + sizes[x] - both)))[0]
        for y in linked.tolist():
            a, b = root(x), root(y)
            if a != b:
                out.append((x, y))
                parent[b] = a
                weight[a] += weight[b]
        if weight[root(x)] > weight[root(main)]:
            # rows left out of the former largest component may link to the new one; last, as both may be joined by then
            main, order, skipped = x, skipped[::-1] + order, []
    return out


def links(docs: DataFrame, rows: DataFrame, rules: JaccardRules) -> DataFrame:
    """Edges (u, v) between representatives whose components are those of all links between different sets.

    A set's node is half its digest; should two sets ever share one, both are looked at, as digests decide. Rows
    without a doc_id are no nodes: sets are found again by a representative's doc_id."""
    p = rules.percent
    some = rows.filter("n > 0 AND doc_id IS NOT NULL").withColumn("node", F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long"))
    once = F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min(F.struct("end_late", "end_at")).alias("end"), F.count(F.lit(1)).alias("held")
    info = kept(some.groupBy("digest", "node").agg(*once), "jaccard-sets")
    # only rows that share their set with others are dealt by it; the rest keep their prefixes where they are
    several = kept(info.filter("held > 1").select("digest"), "jaccard-copies")
    alone = some.join(several, "digest", "left_anti").select("node", "n", "prefix")
    shared = some.join(several, "digest", "left_semi").groupBy("digest", "node").agg(F.min(F.struct("n", "prefix")).alias("w")).select("node", "w.n", "w.prefix")
    posted = alone.unionByName(shared).select("node", "n", F.posexplode("prefix").alias("at", "key"))
    # n-grams are dealt once: their lists are counted where they lie
    listed = kept(posted.withColumn("list", F.count(F.lit(1)).over(Window.partitionBy("key"))).filter("list > 1"), "jaccard-lists")
    lengthy = listed.filter(F.col("list") > rules.pair_list)
    hot = lengthy.groupBy("node").agg(F.count(F.lit(1)).alias("hot"))
    about = kept(info.drop("held").join(hot, "node", "left").withColumn("hot", F.coalesce("hot", F.lit(0))), "jaccard-about")

    # A pair needs sizes within the similarity, and a common n-gram at like places: what lies before it in both and
    # what is left after it bound the whole overlap. Pairs that fail either are never made.
    least = lambda n, m: p * (n + m) / (100 + p)
    short = listed.filter(F.col("list") <= rules.pair_list)
    a, b = (short.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "at")]) for s in "ab")
    sized = 100 * F.least("n_a", "n_b") >= p * F.greatest("n_a", "n_b")
    placed_ok = F.least("at_a", "at_b") + F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) >= least(F.col("n_a"), F.col("n_b"))
    joined = a.join(b, (a["key"] == b["key"]) & (F.col("node_a") < F.col("node_b")) & sized & placed_ok)
    counted = joined.groupBy("node_a", "node_b").agg(F.count(F.lit(1)).alias("c"), (F.max("at_a") + 1).alias("at_a"), (F.max("at_b") + 1).alias("at_b"))
    # Overlaps within prefixes. Up to the last common n-gram nothing else is common; and all of the prefix that ends
    # first in the order is either common or lost. N-grams of long lists are not in these counts and are added whole.
    ends = [about.select(*[F.col(c).alias(f"{c}_{s}") for c in about.columns]) for s in "ab"]
    rest = lambda n: F.floor((p * n + 99) / 100) - 1
    common = F.col("c") + F.least("hot_a", "hot_b")
    upto = common + F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) + F.greatest("hot_a", "hot_b")
    first = common + F.when(F.col("end_a") < F.col("end_b"), rest(F.col("n_a"))).when(F.col("end_a") > F.col("end_b"), rest(F.col("n_b"))).otherwise(F.greatest(rest(F.col("n_a")), rest(F.col("n_b"))))
    fits = F.least(upto, first) >= least(F.col("n_a"), F.col("n_b"))
    pairs = kept(counted.join(ends[0], "node_a").join(ends[1], "node_b").filter(fits).select("rep_a", "rep_b", "digest_a", "digest_b", "n_a", "n_b"), "jaccard-pairs")

    dense = lengthy.drop("n").join(about, "node").select("key", "list", "rep", "n", "digest")
    wanted = pairs.select(F.col("rep_a").alias("doc_id")).unionByName(pairs.select(F.col("rep_b").alias("doc_id"))).unionByName(dense.select(F.col("rep").alias("doc_id"))).distinct()
    needed = pairs.select(F.col("digest_a").alias("digest")).unionByName(pairs.select(F.col("digest_b").alias("digest"))).unionByName(dense.select("digest")).distinct()
    sets = kept(full_sets(docs, wanted, rules).join(needed, "digest", "left_semi"), "jaccard-grams")

    both = pairs.join(sets.select(F.col("digest").alias("digest_a"), F.col("grams").alias("grams_a")), "digest_a").join(sets.select(F.col("digest").alias("digest_b"), F.col("grams").alias("grams_b")), "digest_b")
    overlap = both.select(F.col("rep_a").alias("u"), F.col("rep_b").alias("v"), "n_a", "n_b", F.size(F.array_intersect("grams_a", "grams_b")).alias("both"))
    near = overlap.filter(100 * F.col("both") >= p * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("u", "v")

    # a set meets the sets of its own band of sizes and of the next lower one; tiles bound what a task holds
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / p) + 1e-9).cast("long")
    long = dense.select("key", "list", "rep", "digest", F.explode(F.array(band, band + 1)).alias("band"))
    tiles = F.ceil(F.col("list") * F.pow(F.lit(100 / p), F.col("band")) / rules.tile).cast("int")
    tiled = long.select("key", "band", "rep", "digest", F.greatest(tiles, F.lit(1)).alias("tiles"))
    placed = tiled.select("key", "band", "rep", "digest", F.pmod(F.xxhash64("digest"), "tiles").cast("int").alias("tile"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    placed = placed.select("key", "band", F.least("tile", "other").alias("t"), F.greatest("tile", "other").alias("s"), "rep", "digest").join(sets, "digest").drop("digest")

    def in_block(found: pa.Table) -> pa.Table:
        reps_here = found.column("rep").to_pylist()
        grams = [x.values.to_numpy().view(np.uint64) for x in found.column("grams")]
        edges = block_links(grams, p) if len(grams) > 1 else []
        return pa.table([pa.array([reps_here[x] for x, _ in edges], pa.int64()), pa.array([reps_here[y] for _, y in edges], pa.int64())], names=["u", "v"])

    return near.unionByName(placed.groupBy("key", "band", "t", "s").applyInArrow(in_block, "u long, v long"))


def linked(docs: DataFrame, rules: JaccardRules = JaccardRules()) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) of each row of docs.

    Null, empty and wordless texts have no shingle and are their own component. Equal sets always link. Rows with one
    doc_id stand for one document: they share what either links to. A row with a null doc_id has no name to link by:
    it is a component of its own with a null component_id, and doesn't change the result of any other row. Other columns of docs are not read, texts are
    read whole, and an empty table gives an empty result."""
    few = docs.select(F.col("doc_id").cast("long"), "text")
    rows = kept(incidence(few, rules), "jaccard-rows")
    named = rows.filter("n > 0 AND doc_id IS NOT NULL")
    reps = named.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    edges = links(few, rows, rules)
    same = named.join(reps, "digest").select("doc_id", "rep").filter("doc_id <> rep").distinct()
    found = components(edges.unionByName(same.select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))))
    return rows.select("doc_id", "n").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


#: All links between different sets by counting common shingles, and what they reach; for the default parameters.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM w
), sets AS (SELECT min(doc_id) AS rep, s, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
g AS (SELECT rep, n, unnest(s) AS g FROM sets),
links AS (SELECT a.rep AS u, b.rep AS v FROM g a JOIN g b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
both_ AS (SELECT u, v FROM links UNION SELECT v, u FROM links), reach(u, v) AS (SELECT u, v FROM both_ UNION SELECT r.u, b.v FROM reach r JOIN both_ b ON b.u = r.v),
comp AS (SELECT u, least(u, min(v)) AS c FROM reach GROUP BY u)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(comp.c, sets.rep, s.doc_id) AS component_id FROM s LEFT JOIN sets ON sets.s = s.s LEFT JOIN comp ON comp.u = sets.rep
"""


def op4_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Set size and component of every document."""
    return linked(table(spark, sf_dir, "documents"))
