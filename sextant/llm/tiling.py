"""Benchmark decontamination by greedy string tiling, so that passages count in any order.

1. Benchmark items become hashes of their runs of words (Karp-Rabin), the seeds. A bit table of bounded size says which
   hashes may be a seed; it goes to every task, the seeds themselves don't.
2. One pass over the documents keeps the places whose hash passes the table; equal texts are one text from here on.
3. A join by hash finds the seeds that texts and items really share, and gives one row for each text and item with the
   shared places; so neither side is ever held whole, and a frequent seed is dealt like any other join.
4. In such a row the longest common run of unmarked words is searched by rolling hashes and marked, again and again
   until none is left. Coverage is the marked share of the item's words.
5. Documents take the hits of their text by its digest."""

from __future__ import annotations

import math
import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import batched, kept, table, tokens

NOISE = re.compile(r"[\W_]+")
#: All Unicode white space, as str.split takes it; a pattern for Arrow.
SPACES = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
POWER = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
HITS = "array<struct<item_id:bigint,coverage:double,tiles:array<struct<doc_word:int,item_word:int,words:int>>>>"


@dataclass(frozen=True)
class TilingRules:
    """Parameters: shortest tile in words (an item of fewer words has no tile: such a word or phrase is in clean texts too,
    and proves nothing; `short_items` tells how many they are), coverage that counts as a leak, and the base-2 logarithm of the bit table's size at most (16 MB): beyond some millions of seeds more places pass it,
    which costs time and changes no result."""

    least: int = 5
    coverage: float = 0.5
    table_bits: int = 27


def plain_words(words: list[str]) -> list[str]:
    """Words in lower case without anything but letters and digits."""
    return [NOISE.sub("", w.lower()) for w in words]


def spaced(texts: pa.Array) -> pa.Array:
    """texts with each run of white space as one plain space, so that items and documents have the same words."""
    return pc.replace_substring_regex(texts, SPACES, " ")


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the words with a letter or digit of all texts, in order."""
    row, code, words = tokens(spaced(texts))
    plain = plain_words(words.to_pylist())
    own = np.fromiter((xxhash.xxh64_intdigest(w) for w in plain), np.uint64, len(plain))
    full = np.fromiter((bool(w) for w in plain), bool, len(plain))[code]
    return row[full], own[code][full]


def _rolled(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k word hashes: a sum of powers, stirred at the end. Shorter input has none."""
    n = max(0, len(h) - k + 1)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = out * POWER + h[j : n + j]
    return (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)


def _second(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Another hash of the runs of k words that start at these places; both must be equal for a seed."""
    out = np.full(len(at), k, np.uint64)
    for j in range(k):
        out = (out ^ h[at + j]) * np.uint64(0xC2B2AE3D27D4EB4F)
        out ^= out >> np.uint64(29)
    return out


def _longs(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def item_seeds(benchmark: DataFrame, rules: TilingRules) -> DataFrame:
    """number, item_id, n (words), k (words of a seed) and the seeds' hashes h and g of each item of `least` words or more.

    Numbers tell rows apart, whatever their ids; the frame is to be written once before it is used."""

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        for b in batches:
            row, h = hashed_words(b.column(1))
            bounds = np.searchsorted(row, np.arange(b.num_rows + 1))
            out = []
            for i, item in enumerate(b.column(0).to_pylist()):
                w = h[bounds[i] : bounds[i + 1]]
                if len(w) >= rules.least:
                    k, number = rules.least, number + 1
                    out.append((number, item, len(w), k, _longs(_rolled(w, k)), _longs(_second(w, np.arange(len(w) - k + 1), k))))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(kinds)], names=["number", "item_id", "n", "k", "h", "g"])

    few = benchmark.select(F.col("item_id").cast("long"), "text").filter(F.col("text").isNotNull())
    return batched(few).mapInArrow(run, "number long, item_id long, n int, k int, h array<long>, g array<long>")


def bit_table(seeds: DataFrame, bits: int) -> np.ndarray:
    """A table of 2**bits bits with those of both hashes of every seed set; at most 2**(bits - 6) longs are collected."""
    slot = F.explode(F.array(*[F.shiftrightunsigned(c, 64 - bits) for c in ("h", "g")])).alias("slot")
    found = seeds.select(slot).groupBy(F.shiftright("slot", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, CAST(slot & 63 AS INT)))").alias("mask")).toArrow()
    out = np.zeros(1 << bits - 6, np.uint64)
    out[found.column("at").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)
    return out


def _passing(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    slot = h >> np.uint64(64 - 6 - (len(table).bit_length() - 1))
    return (table[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def candidate_places(texts: DataFrame, bits: np.ndarray, sizes: list[int]) -> DataFrame:
    """digest, and the places (word numbers) at which a run of words may be a seed with both hashes, of each different
    text of (digest, text) that has any."""

    def run(batches):
        for b in batches:
            row, h = hashed_words(b.column(1))
            bounds = np.searchsorted(row, np.arange(b.num_rows + 1))
            parts = []
            for k in sizes:
                first = _rolled(h, k)
                at = np.flatnonzero(_passing(first, bits) & (row[: len(first)] == row[k - 1 :])) if len(first) else np.zeros(0, np.int64)
                second = _second(h, at, k)
                keep = _passing(second, bits)
                parts.append((at[keep], first[at[keep]], second[keep]))
            at, first, second = (np.concatenate([p[j] for p in parts]) for j in range(3))
            order = np.argsort(row[at], kind="stable")
            at, first, second = at[order], first[order], second[order]
            cuts = np.searchsorted(row[at], np.arange(b.num_rows + 1))
            digests, seen, out = b.column(0).to_pylist(), set(), []
            for i in np.flatnonzero(np.diff(cuts)).tolist():
                if digests[i] not in seen:
                    seen.add(digests[i])
                    x = slice(cuts[i], cuts[i + 1])
                    out.append((digests[i], (at[x] - bounds[i]).astype(np.int32), _longs(first[x]), _longs(second[x])))
            kinds = (pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(kinds)], names=["digest", "at", "h", "g"])

    return batched(texts).mapInArrow(run, "digest string, at array<int>, h array<long>, g array<long>").dropDuplicates(["digest"])


def _powers(x: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, x, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _windows(g: np.ndarray, n: int) -> np.ndarray:
    """Rolling hashes of all windows of n hashes: differences of prefix sums of powers, each brought to power zero."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(g * _powers(POWER, len(g)))])
    return (sums[n:] - sums[:-n]) * _powers(INVERSE, len(g) - n + 1)


def tile(at: np.ndarray, grams: np.ndarray, item: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Tiles (start in the text, start in the item, words) in the order in which they are marked.

    `at` are ascending places of a text and `grams` the hashes of the k words from there; `item` has those of all places
    of the item. Each time the longest run of words common to both and unmarked in both is marked; of runs as long the
    first in the text counts, then the first in the item. n consecutive equal hashes are n + k - 1 equal words."""
    out, spots = [], np.arange(len(item))

    def match(n: int):
        """The first match of n consecutive hashes: (index in at, index in spots), or None."""
        if n > min(len(at), len(spots)):
            return None
        mine = np.flatnonzero(at[n - 1 :] - at[: len(at) - n + 1] == n - 1)
        theirs = np.flatnonzero(spots[n - 1 :] - spots[: len(spots) - n + 1] == n - 1)
        if not len(mine) or not len(theirs):
            return None
        known, first = np.unique(_windows(item[spots], n)[theirs], return_index=True)
        h = _windows(grams, n)[mine]
        found = np.searchsorted(known, h)
        for m in np.flatnonzero(known[np.minimum(found, len(known) - 1)] == h).tolist():
            a, b = int(mine[m]), int(theirs[first[found[m]]])
            if np.array_equal(grams[a : a + n], item[spots[b : b + n]]):
                return a, b
        return None

    most = len(item)
    while len(at) and len(spots):
        best, low, high = match(most), 0, most - 1
        n = most
        while best is None and low < high:  # no match of more than `high`; the longest is at least `low`
            half = (low + high + 1) // 2
            if match(half):
                low = half
            else:
                high = half - 1
        if best is None:
            if not high:
                break
            n, best = high, match(high)
            if best is None:
                break
        p, i, words, most = int(at[best[0]]), int(spots[best[1]]), n + k - 1, n
        out.append((p, i, words))
        free = (at <= p - k) | (at >= p + words)
        at, grams, spots = at[free], grams[free], spots[(spots <= i - k) | (spots >= i + words)]
    return out


def tiled(pairs: DataFrame) -> DataFrame:
    """digest and hit (coverage, item_id, number, tiles) of rows (digest, number, item_id, n, k, item, places)."""

    def run(batches):
        for b in batches:
            out = []
            column = {c: b.column(c) for c in b.schema.names}
            for i in range(b.num_rows):
                places, k, n = column["places"][i].values, column["k"][i].as_py(), column["n"][i].as_py()
                tiles = tile(places.field("at").to_numpy(), places.field("h").to_numpy().view(np.uint64), column["item"][i].values.to_numpy().view(np.uint64), k)
                if tiles:
                    out.append({"digest": column["digest"][i].as_py(), "coverage": sum(w for _, _, w in tiles) / n, "item_id": column["item_id"][i].as_py(), "number": column["number"][i].as_py(), "tiles": [{"doc_word": p, "item_word": q, "words": w} for p, q, w in sorted(tiles)]})
            three = pa.struct([("doc_word", pa.int32()), ("item_word", pa.int32()), ("words", pa.int32())])
            yield pa.RecordBatch.from_pylist(out, pa.schema([("digest", pa.string()), ("coverage", pa.float64()), ("item_id", pa.int64()), ("number", pa.int64()), ("tiles", pa.list_(three))]))

    return pairs.mapInArrow(run, "digest string, coverage double, item_id long, number long, tiles array<struct<doc_word:int,item_word:int,words:int>>")


def short_items(benchmark: DataFrame, rules: TilingRules = TilingRules()) -> DataFrame:
    """item_id and words of the items that are too short to be searched for, those without a word and null ones too."""

    def run(batches):
        for b in batches:
            row, _ = hashed_words(b.column(1).fill_null(""))
            n = np.bincount(row, minlength=b.num_rows)
            few = np.flatnonzero(n < rules.least)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(few)), pa.array(n[few].astype(np.int32))], names=["item_id", "words"])

    return batched(benchmark.select(F.col("item_id").cast("long"), "text")).mapInArrow(run, "item_id long, words int")


def text_hits(docs: DataFrame, benchmark: DataFrame, rules: TilingRules = TilingRules()) -> DataFrame | None:
    """digest, coverage, item_id, number and tiles for each different text of docs and each item that share a tile.

    None if no item is long enough. Written to the shared folder, so that its size is known to what joins it."""
    items = kept(item_seeds(benchmark, rules), "tiling-items")
    about = items.agg(F.sum(F.size("h")).alias("seeds"), F.sort_array(F.collect_set("k")).alias("sizes")).first()
    if not about["seeds"]:
        return None
    seeds = items.select("number", F.explode(F.arrays_zip("h", "g")).alias("x")).select("number", "x.h", "x.g").distinct()
    bits = bit_table(seeds, max(12, min(rules.table_bits, math.ceil(math.log2(64 * about["seeds"])))))
    texts = docs.select(F.md5(F.col("text").cast("binary")).alias("digest"), "text").filter(F.col("text").isNotNull())
    places = kept(candidate_places(texts, bits, about["sizes"]), "tiling-places")
    spots = places.select("digest", F.explode(F.arrays_zip("at", "h", "g")).alias("x")).select("digest", "x.*")
    shared = spots.join(seeds, ["h", "g"]).groupBy("digest", "number").agg(F.array_sort(F.collect_list(F.struct("at", "h"))).alias("places"))
    pairs = shared.join(items.select("number", "item_id", "n", "k", F.col("h").alias("item")), "number")
    return kept(tiled(pairs), "tiling-hits")


def tilings(docs: DataFrame, benchmark: DataFrame, rules: TilingRules = TilingRules()) -> DataFrame:
    """docs with `bench_hits`: items that share a tile with the text, with coverage and tiles, the best covered first.

    Null and empty texts, and texts without a letter or digit, have no hits, and items of fewer words than a tile give
    none; so has every text if the benchmark is empty. A text of any length is read whole. Items of equal text are all listed, ties by item_id. Repeated rows get equal hits. A column `bench_hits` is
    replaced; other columns pass through. Tiles count words with a letter or digit."""
    found, out, key = text_hits(docs, benchmark, rules), docs.drop("bench_hits"), f"_digest_{uuid.uuid4().hex}"
    empty = F.from_json(F.lit("[]"), HITS)
    if found is None:
        return out.withColumn("bench_hits", empty)
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("coverage")).alias("o"), "item_id", "number", "coverage", "tiles")))
    each = found.groupBy(F.col("digest").alias(key)).agg(F.transform(ranked, lambda x: F.struct(x["item_id"].alias("item_id"), x["coverage"].alias("coverage"), x["tiles"].alias("tiles"))).alias("bench_hits"))
    joined = out.withColumn(key, F.md5(F.col("text").cast("binary"))).join(kept(each, "tiling-texts"), key, "left").drop(key)
    return joined.withColumn("bench_hits", F.coalesce("bench_hits", empty))


def leaked(rules: TilingRules = TilingRules()):
    """Whether the best hit covers enough of its item to count as a leak."""
    return F.coalesce(F.try_element_at("bench_hits", F.lit(1))["coverage"] >= rules.coverage, F.lit(False))


def clean(docs: DataFrame, benchmark: DataFrame, rules: TilingRules = TilingRules()) -> DataFrame:
    """docs without the rows that hold a benchmark passage; columns as they were, and nulls and ties as in `tilings`."""
    found, key = text_hits(docs, benchmark, rules), f"_digest_{uuid.uuid4().hex}"
    if found is None:
        return docs
    bad = kept(found.filter(F.col("coverage") >= rules.coverage).select(F.col("digest").alias(key)).distinct(), "tiling-leaks")
    return docs.withColumn(key, F.md5(F.col("text").cast("binary"))).join(bad, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_benchmark_tiling(spark, sf_dir: str) -> DataFrame:
    """Best covered item, coverage and verdict of every document, with all items over the limit."""
    rules = TilingRules()
    found = tilings(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), rules)
    best = F.try_element_at("bench_hits", F.lit(1))
    over = F.filter("bench_hits", lambda x: x["coverage"] >= rules.coverage)
    return found.select(
        "doc_id", leaked(rules).alias("contaminated"), F.coalesce(best["coverage"], F.lit(0.0)).alias("coverage"), best["item_id"].alias("item_id"),
        F.transform(over, lambda x: x["item_id"]).alias("item_ids"), F.size(over).cast("long").alias("n_items"),
    )
