"""Alignment of two tokenizers' tokens: inverted bitmaps of documents for each pair of ids, and each document's scores."""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant.llm.common import batched, kept, table


@dataclass(frozen=True)
class AlignmentRules:
    """Files of the byte-level BPE (A) and of the sentence-piece model (B), and what a block of documents holds.

    A block is closed by the batch that takes it to `block_bytes` of text or to `block_docs` texts (whichever is first; a
    text is never cut). `slice_bytes` bounds the strings of ids that are in memory at a time."""

    byte_level: str = "/opt/tokenizers/byte_bpe_50k.json"
    pieces: str = "/opt/tokenizers/piece_bpe_32k.model"
    block_bytes: int = 8 << 20
    block_docs: int = 30_000
    slice_bytes: int = 1 << 20


def _byte_of() -> dict[str, int]:
    """The byte that a character of a byte-level vocabulary stands for: printable ones for themselves, others from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers with the bytes of each of their ids, made once in a process from the files' contents."""

    def __init__(self, byte_level: bytes, pieces: bytes):
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_str(byte_level.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        self.space = self.b.piece_to_id("▁")
        byte_of, said = _byte_of(), json.loads(byte_level)
        vocab = said["model"]["vocab"]
        size = 1 + max([*vocab.values(), *(t["id"] for t in said["added_tokens"])])
        own = [b""] * size
        for token, i in vocab.items():
            own[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        other = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.vocab_size()))]
        self.tables = [(np.array([len(x) for x in t]), np.r_[0, np.cumsum([len(x) for x in t])[:-1]], np.frombuffer(b"".join(t), np.uint8)) for t in (own, other)]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For A and B: ids of all texts, and how many each text has. Each text starts with the space that both put first."""
        found = [[e.ids for e in self.a.encode_batch(texts, add_special_tokens=False)]]
        found.append([x or [self.space] for x in self.b.encode([t[1:] for t in texts], num_threads=1)] if texts else [])
        return [(np.fromiter((i for x in ids for i in x), np.int64), np.array([len(x) for x in ids], np.int64)) for ids in found]

    def spelled(self, which: int, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids, joined."""
        size, start, data = self.tables[which]
        return data[spread(start[ids], size[ids])]


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each pair of a start and a size, one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


_PAIRS: dict[int, Pair] = {}


def _pair(files) -> Pair:
    """The tokenizers of a broadcast pair of files; a task uses one thread."""
    if (key := hash(files.value)) not in _PAIRS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _PAIRS[key] = Pair(*files.value)
    return _PAIRS[key]


def chunks(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(code, different chunks): texts, a space before each, cut before spaces; codes are in order.

    A cut lies between a visible ASCII character and a space, where neither tokenizer has a token that goes over it nor a
    rule that looks over it: byte-level words begin at such a space, and pieces hold spaces at their beginning only. So a
    text's tokens are its chunks' tokens, and each different chunk is worked on once. Also gives each text's chunks."""
    whole = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts.cast(pa.large_string()), pa.scalar(" ", pa.large_string()))
    ends = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = np.frombuffer(whole.buffers()[2], np.uint8)[: ends[-1]] if ends[-1] else np.zeros(0, np.uint8)
    inner = np.flatnonzero((data[1:] == 32) & (data[:-1] > 32) & (data[:-1] < 127)) + 1
    starts = np.union1d(inner, ends[:-1])
    cut = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.r_[starts, ends[-1]].astype(np.int64)), whole.buffers()[2])
    coded = cut.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), np.searchsorted(starts, ends), coded.dictionary


@dataclass
class Linked:
    """What is known of each of some chunks: token counts, groups (as text), linked ids; `good`: both spell the chunk."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    good: np.ndarray
    groups: pa.Array
    starts: np.ndarray  # of each chunk's links in `links`, and the end
    links: np.ndarray  # A id << 32 | B id


def joined(values: pa.Array, ends: np.ndarray, between: str) -> pa.Array:
    """Texts joined from one end (a position in values) to the next, the first from 0 on."""
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), values.cast(pa.large_string()))
    return pc.binary_join(lists, pa.scalar(between, pa.large_string()))


def align(pair: Pair, different: pa.Array) -> Linked:
    """Tokens of each chunk, and which of them overlap.

    Between two neighbouring ends of tokens of either kind there is one A and one B token, and each overlapping pair has
    one such stretch: links are counted by stretches, and groups by ends that both have."""
    texts = different.to_pylist()
    size = pc.binary_length(different).to_numpy().astype(np.int64)
    # chunks that end in a visible ASCII character are encoded together, a few thousand characters at a time
    packs, pack, pack_of, filled = [], [], np.empty(len(texts), np.int64), 0
    for i, t in enumerate(texts):
        alone = not "!" <= t[-1] <= "~" or "▁" in t
        if pack and (alone or filled >= 4096):
            packs.append("".join(pack))
            pack, filled = [], 0
        pack.append(t)
        pack_of[i] = len(packs)
        filled += 4096 if alone else len(t)
    if pack:
        packs.append("".join(pack))
    encoded = pair.encode(packs)
    wrong = misspelled(pair, packs, encoded)
    if wrong[np.bincount(pack_of, minlength=len(packs)) > 1].any():  # never seen: encode each chunk alone
        packs, pack_of, encoded = texts, np.arange(len(texts)), pair.encode(texts)
        wrong = misspelled(pair, packs, encoded)
    good, found = ~wrong[pack_of], []
    for which, (ids, counts) in enumerate(encoded):
        ids = ids[np.repeat(~wrong, counts)]
        found.append((ids, np.cumsum(pair.tables[which][0][ids])))
    return _joined(found, np.cumsum(np.where(good, size, 0)), good)


def misspelled(pair: Pair, texts: list[str], encoded) -> np.ndarray:
    """Whether the joined bytes of a text's tokens of either kind differ from the text."""
    size, wrong = np.array([len(t.encode()) for t in texts], np.int64), np.zeros(len(texts), bool)
    for which, (ids, counts) in enumerate(encoded):
        told = np.bincount(np.repeat(np.arange(len(texts)), counts), pair.tables[which][0][ids], len(texts)).astype(np.int64)
        wrong |= told != size
    right = np.flatnonzero(~wrong)
    data, ends = np.frombuffer("".join(texts[i] for i in right).encode(), np.uint8), np.cumsum(size[right])
    fits = np.repeat(~wrong, encoded[0][1]), np.repeat(~wrong, encoded[1][1])
    for which, (ids, _) in enumerate(encoded):
        wrong[right[np.searchsorted(ends, np.flatnonzero(pair.spelled(which, ids[fits[which]]) != data), "right")]] = True
    return wrong


def _joined(found, chunk_ends: np.ndarray, good: np.ndarray) -> Linked:
    (a, a_ends), (b, b_ends) = found
    ends = np.union1d(a_ends, b_ends)
    at_a, at_b = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
    both = np.intersect1d(a_ends, b_ends, assume_unique=True)
    to_a, to_b = np.searchsorted(a_ends, both) + 1, np.searchsorted(b_ends, both) + 1
    texts = pc.binary_join_element_wise(joined(pa.array(a), to_a, ","), joined(pa.array(b), to_b, ","), pa.scalar("|", pa.large_string()))
    n_groups = np.searchsorted(both, chunk_ends, "right")
    groups = joined(texts, n_groups, ";")
    each = lambda x: np.diff(np.searchsorted(x, chunk_ends, "right"), prepend=0)
    return Linked(each(a_ends), each(b_ends), np.diff(n_groups, prepend=0), good, groups, np.r_[0, np.searchsorted(ends, chunk_ends, "right")], (a[at_a] << 32) | b[at_b])


def pack_bitmaps(key: np.ndarray, place: np.ndarray, docs: int) -> tuple[np.ndarray, pa.Array]:
    """(different keys, bitmaps): for each key the set of its places among `docs`, compressed; key and place are in order.

    A few places are kept as they are, in two bytes each; many as one bit a document."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.r_[starts, len(key)])
    full = (docs + 15) // 16
    dense = count >= full
    size = np.where(dense, full, count)
    first = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint16)
    of = np.repeat(np.arange(len(starts)), count)
    wide = dense[of]
    thin = ~wide
    rank = np.arange(len(key)) - np.repeat(starts, count)
    out[(first[of] + rank)[thin]] = place[thin]
    np.bitwise_or.at(out, first[of[wide]] + (place[wide] >> 4), np.left_shift(1, place[wide] & 15).astype(np.uint16))
    return key[starts], pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(2 * np.r_[first, size.sum()].astype(np.int64)), pa.py_buffer(out)])


def places(bitmaps: pa.Array, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(bitmap, place) of all documents in bitmaps."""
    bitmaps = bitmaps.cast(pa.large_binary())
    ends = np.frombuffer(bitmaps.buffers()[1], np.int64)[bitmaps.offset : bitmaps.offset + len(bitmaps) + 1] // 2
    if not len(bitmaps) or ends[-1] == ends[0]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = np.frombuffer(bitmaps.buffers()[2], np.uint16, int(ends[-1]))
    size, full = np.diff(ends), (docs + 15) // 16
    dense = np.flatnonzero(size == full)
    thin = np.flatnonzero(size != full)
    at = words[spread(ends[thin], size[thin])].astype(np.int64)
    row = np.repeat(thin, size[thin])
    bits = np.unpackbits(words[spread(ends[dense], size[dense])].view(np.uint8), bitorder="little").reshape(len(dense), 16 * full)
    r, p = np.nonzero(bits)
    return np.r_[row, dense[r]], np.r_[at, p]


BLOCK = "block long, docs int, doc_id long, place int, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pair long, seen long, links long, bitmap binary, planes array<binary>"


def _block(pair: Pair, ids: list, texts: list, rules: AlignmentRules) -> tuple[dict, dict]:
    """Columns of a block: of its documents, and of the pairs of ids with the bitmaps of the documents that link them.

    Bit k of how often a document links a pair beyond once is in plane k of the pair's bitmaps."""
    doc_id, text = pa.concat_arrays(ids), pa.concat_arrays(texts)
    n = len(doc_id)
    there = np.flatnonzero(pc.greater(pc.fill_null(pc.binary_length(text), 0), 0).to_numpy(zero_copy_only=False))
    code, ends, different = chunks(text.take(pa.array(there)))
    known = align(pair, different)
    doc = np.repeat(np.arange(len(there)), np.diff(ends))
    whole = np.bincount(doc, ~known.good[code], len(there)) == 0
    sums = {}
    for c in ("n_a", "n_b", "n_groups"):
        sums[c] = np.zeros(n, np.int64)
        sums[c][there] = np.where(whole, np.add.reduceat(getattr(known, c)[code], ends[:-1]) if len(there) else 0, 0)
    sums["n_links"] = sums["n_a"] + sums["n_b"] - sums["n_groups"]
    sha, bytes_to = np.full(n, "", object), np.cumsum(pc.binary_length(text.take(pa.array(there))).to_numpy())
    for some in np.split(np.arange(len(there)), np.flatnonzero(np.diff(bytes_to // rules.slice_bytes)) + 1):
        if len(some):
            a, b = ends[some[0]], ends[some[-1] + 1]
            said = joined(known.groups.take(pa.array(code[a:b])), ends[some[0] + 1 : some[-1] + 2] - a, ";")
            for i, s in zip(some.tolist(), said, strict=True):
                if whole[i]:
                    sha[there[i]] = hashlib.sha256(s.as_buffer()).hexdigest()
    head = {"doc_id": doc_id, "place": pa.array(np.arange(n), pa.int32()), **{c: pa.array(x) for c, x in sums.items()}, "groups_sha256": pa.array(sha, pa.string())}

    # (pair, place) of all links, counted: chunks that a document repeats are counted before their links are spread out
    taken = whole[doc]
    both, times = np.unique(code[taken] * n + there[doc[taken]], return_counts=True)
    code, place = both // n, both % n
    size = np.diff(known.starts)[code]
    kinds, number = np.unique(known.links, return_inverse=True)
    key = number[spread(known.starts[code], size)] * n + np.repeat(place, size)
    order = np.argsort(key, kind="stable")
    key, times = key[order], np.repeat(times, size)[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    times = np.add.reduceat(times, first) if len(first) else times[:0]
    key, place = key[first] // n, key[first] % n
    own, bitmaps = pack_bitmaps(key, place, n)
    planes, plane_of = [], []
    for k in range(int(times.max(initial=1) - 1).bit_length()):
        bit = ((times - 1) >> k & 1).astype(bool)
        some, maps = pack_bitmaps(key[bit], place[bit], n)
        planes.append(maps)
        plane_of.append(np.searchsorted(own, some))
    # planes of a pair, lowest first; a plane without a document is empty, and planes above the highest used are left out
    used = np.zeros(len(own), np.int64)
    for k, at in enumerate(plane_of):
        used[at] = k + 1
    flat_to = np.r_[0, np.cumsum(used)]
    source, base = np.zeros(flat_to[-1], np.int64), 1
    for k, (at, maps) in enumerate(zip(plane_of, planes, strict=True)):
        source[flat_to[at] + k] = base + np.arange(len(at))
        base += len(maps)
    flat = pa.concat_arrays([pa.array([b""], pa.large_binary()), *planes]).take(pa.array(source)).cast(pa.binary())
    seen = np.diff(np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)]) if len(key) else np.zeros(0, np.int64)
    linked = np.bincount(np.searchsorted(own, key), times, len(own)).astype(np.int64) if len(key) else np.zeros(0, np.int64)
    tail = {"pair": pa.array(kinds[own]), "seen": pa.array(seen), "links": pa.array(linked), "bitmap": bitmaps.cast(pa.binary()), "planes": pa.ListArray.from_arrays(pa.array(flat_to, pa.int32()), flat)}
    return head, tail


def _blocks(files, rules: AlignmentRules):
    """Rows of the inverted file of a task's documents, block by block."""

    def run(batches):
        from pyspark import TaskContext

        names = [f.split()[0] for f in BLOCK.split(", ")]
        kinds = {"docs": pa.int32(), "doc_id": pa.int64(), "place": pa.int32(), "groups_sha256": pa.string(), "bitmap": pa.binary(), "planes": pa.list_(pa.binary())}
        schema = pa.schema([(c, kinds.get(c, pa.int64())) for c in names])
        first, made, ids, texts, held, rows = TaskContext.get().partitionId() << 32, 0, [], [], 0, 0

        def closed():
            n = sum(map(len, ids))
            for part in _block(_pair(files), ids, texts, rules):
                size = len(next(iter(part.values())))
                part = part | {"block": pa.array(np.full(size, first + made)), "docs": pa.array(np.full(size, n, np.int32))}
                columns = [part[f.name] if f.name in part else pa.nulls(size, f.type) for f in schema]
                yield from pa.Table.from_arrays(columns, schema=schema).to_batches(max_chunksize=10_000)

        for batch in batches:
            ids.append(batch.column(0))
            texts.append(batch.column(1))
            rows += len(batch)
            held += pc.sum(pc.binary_length(batch.column(1))).as_py() or 0
            if held >= rules.block_bytes or rows >= rules.block_docs:
                yield from closed()
                made, ids, texts, held, rows = made + 1, [], [], 0, 0
        if rows:
            yield from closed()

    return run


def inverted(docs: DataFrame, rules: AlignmentRules = AlignmentRules()) -> DataFrame:
    """The inverted file of docs, a written table: rows of documents (place not null) and of pairs of ids, by block.

    A block is some neighbouring documents of one task. A pair's row has the compressed bitmap of the block's documents
    that link it, how many they are, their links, and the planes of how often each does."""
    with open(rules.byte_level, "rb") as a, open(rules.pieces, "rb") as b:
        files = docs.sparkSession.sparkContext.broadcast((a.read(), b.read()))
    few = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return kept(batched(few).mapInArrow(_blocks(files, rules), BLOCK), "alignment-inverted")


def pair_counts(file: DataFrame) -> DataFrame:
    """(pair, a_id, b_id, documents, links, best) of each pair of ids: how many documents link it and how often, over all
    blocks, and whether no other pair of its A id is in more documents.

    A document is in one block, so the bitmaps of a pair over all blocks have no document in common, and the size of
    their union is the sum of theirs. An A id has as many pairs as B has ids at the most."""
    sums = file.filter("place IS NULL").groupBy("pair").agg(F.sum("seen").alias("documents"), F.sum("links").alias("links"))
    sums = sums.select("pair", F.shiftright("pair", 32).cast("int").alias("a_id"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("b_id"), "documents", "links")
    return kept(sums.withColumn("best", F.col("documents") == F.max("documents").over(Window.partitionBy("a_id"))), "alignment-pairs")


SCORED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _scored(rows: pa.Table, told: pa.Table) -> pa.Table:
    """Each document of a block with the sums over its links, from the bitmaps and planes of the block's pairs.

    `told` has the corpus-wide count of each of these pairs."""
    is_doc = pc.is_valid(rows.column("place"))
    heads, postings = rows.filter(is_doc), rows.filter(pc.invert(is_doc))
    n = heads.column("docs")[0].as_py() if len(heads) else 0
    order = np.argsort(told.column("key").to_numpy())
    at = order[np.searchsorted(told.column("key").to_numpy()[order], postings.column("pair").to_numpy())]
    count, best = told.column("documents").to_numpy()[at], told.column("best").to_numpy()[at].astype(np.int64)
    sums = {"count_sum": np.zeros(n, np.int64), "n_best": np.zeros(n, np.int64)}

    def add(row, place, times):
        np.add.at(sums["count_sum"], place, count[row] * times)
        np.add.at(sums["n_best"], place, best[row] * times)

    if len(postings):
        add(*places(postings.column("bitmap").combine_chunks(), n), 1)
        planes = postings.column("planes").combine_chunks()
        sizes = planes.value_lengths().to_numpy()
        row, level = np.repeat(np.arange(len(planes)), sizes), spread(np.zeros(len(sizes), np.int64), sizes)
        at, place = places(planes.flatten(), n)
        add(row[at], place, np.left_shift(1, level[at]))
    place = heads.column("place").to_numpy()
    own = {c: pa.array(x[place]) for c, x in sums.items()}
    names = [f.split()[0] for f in SCORED.split(", ")]
    return pa.table([own[c] if c in own else heads.column(c) for c in names], names=names)


def aligned(docs: DataFrame, rules: AlignmentRules = AlignmentRules()) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row of docs.

    A's and B's tokens of a space and the text are linked where their bytes overlap, and cut into groups where both have
    an end. n_best counts the links whose pair is in as many documents as any of its A id's, count_sum adds up the number
    of documents of each link's pair. Every row is a document, rows that share a doc_id too. Null and empty texts, and
    texts that the tokens of either kind don't spell, have no tokens: zeros and an empty groups_sha256. Texts are read
    whole, however long; an empty table gives an empty result; other columns aren't read.

    The bitmaps are shuffled once, to their block; pairs are counted and told to the blocks that have them as plain ids."""
    file = inverted(docs, rules)
    pairs = pair_counts(file)
    asked = file.filter("place IS NULL").select(F.col("block").alias("of"), F.col("pair").alias("key"))
    told = asked.join(pairs.select(F.col("pair").alias("key"), "documents", "best").hint("merge"), "key")
    rows = file.select("block", "docs", "doc_id", "place", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pair", "bitmap", "planes")
    return rows.groupBy("block").cogroup(told.groupBy("of")).applyInArrow(_scored, SCORED)


def op13_cross_alignment(spark, sf_dir: str) -> DataFrame:
    """Tokens, groups, links and corpus-wide counts of every document."""
    return aligned(table(spark, sf_dir, "documents"))
