"""Document likelihood under a subword lattice: every segmentation of a text counts, weighted by its pieces' scores.

The pieces are those of an existing vocabulary file; their log probabilities start from the file's order and are
re-estimated on the training words by expectation-maximisation (the inventory is never trained). No piece spans two
words, so the forward recursion of a text falls into its words: the marginal of each different word is computed
once, in log space, and a text's score is the sum over its words and its end.

Counts of all words come from all training rows. They meet the documents by a join on the word: a batch of documents
sends one row for each different word with the packed positions and counts of the documents that have it, so neither
the vocabulary nor the documents are ever held in one place."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import batched, fold, kept, table, tokens

#: The mark before a word in the vocabulary file, and the byte that stands for it here.
MARK, SPACE_BYTE = "▁".encode(), b" "


@dataclass(frozen=True)
class LatticeRules:
    """Parameters: the vocabulary file, EM rounds, weight of the file's order, documents (at most 32767) and bytes of
    text of a batch, words that are worked on together, and batches whose sums a task holds."""

    vocabulary: str = "/opt/tokenizers/piece_bpe_32k.model"
    em_rounds: int = 3
    prior_weight: float = 1000.0
    batch: int = 4000
    batch_bytes: int = 1 << 27
    words: int = 20_000
    held_batches: int = 256


@lru_cache(maxsize=2)
def pieces(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces that a lower-cased word can use, and their starting probabilities (the last entry is the end).

    All pieces of the file count, whatever their length, but for those that cannot occur: pieces with capitals, or with the word mark anywhere but in front, can never be used; every single byte is a
    piece, as in the file's byte fallback, so that any text has a segmentation."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rank: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i):
            continue
        if model.is_byte(i):
            rank.setdefault(bytes([int(model.id_to_piece(i)[3:5], 16)]), 32_000.0)
            continue
        data = model.id_to_piece(i).encode()
        body = data[len(MARK) :] if data.startswith(MARK) else data
        if MARK in body or body != body.lower() or b" " in body:
            continue
        rank[(SPACE_BYTE if data.startswith(MARK) else b"") + body] = -model.get_score(i)
    rank.setdefault(SPACE_BYTE, 32_000.0)
    for b in range(256):
        rank.setdefault(bytes([b]), 32_000.0)
    names = sorted(rank)
    weight = np.array([1.0 / (rank[x] + 50.0) for x in names] + [0.0])
    weight[-1] = weight.sum() * 1e-3
    return names, weight / weight.sum()


class Index:
    """Pieces by a rolling hash of their bytes, in an open table: finds many substrings at a time."""

    MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)

    def __init__(self, names: list[bytes]):
        self.names, size = names, 1 << 18
        self.lengths = {len(x) for x in names}
        self.longest = max(self.lengths)
        self.shift = np.uint64(64 - 18)
        key = np.array([self._hash(x) for x in names], np.uint64)
        if len(set(key.tolist())) < len(key):
            raise ValueError("two pieces have one hash")
        self.keys, self.ids = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        for i, k in enumerate(key.tolist()):
            at = (k * 0xD6E8FEB86659FD93 & (1 << 64) - 1) >> int(self.shift)
            while self.ids[at] >= 0:
                at = (at + 1) & (size - 1)
            self.keys[at], self.ids[at] = k, i
        self.mask = size - 1

    def _hash(self, data: bytes) -> int:
        h = 0
        for b in data:
            h = (h * int(self.MULTIPLIER) + b + 1) & (1 << 64) - 1
        return h

    def find(self, h: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes, -1 where there is none. Only what meets another piece's slot looks on."""
        at = ((h * np.uint64(0xD6E8FEB86659FD93)) >> self.shift).astype(np.int64)
        out = self.ids[at]
        going = np.nonzero((out >= 0) & (self.keys[at] != h))
        while len(going[0]):
            at[going] = (at[going] + 1) & self.mask
            out[going] = self.ids[at[going]]
            further = (out[going] >= 0) & (self.keys[at[going]] != h[going])
            going = tuple(x[further] for x in going)
        return out


_INDEX: dict[str, Index] = {}


def _index(rules: LatticeRules) -> Index:
    if rules.vocabulary not in _INDEX:
        _INDEX[rules.vocabulary] = Index(pieces(rules.vocabulary)[0])
    return _INDEX[rules.vocabulary]


def _by_length(words: list[bytes], least: int):
    """Groups of word numbers of one length at most `least` bytes wide, and the longer words one by one."""
    length = np.array([len(w) for w in words])
    for n in np.unique(length):
        which = np.nonzero(length == n)[0]
        for i in range(0, len(which), 20_000 if n <= least else max(1, 200_000 // int(n))):
            yield which[i : i + (20_000 if n <= least else max(1, 200_000 // int(n)))]


def _arcs(block: np.ndarray, index: Index) -> dict[int, np.ndarray]:
    """Piece ids of the substrings of equal-length byte rows: by length an array (rows, starts), where there are any."""
    n, out, h = block.shape[1], {}, np.zeros(block.shape, np.uint64)
    for k in range(1, min(index.longest, n) + 1):
        h = h[:, : n - k + 1] * Index.MULTIPLIER + block[:, k - 1 :] + np.uint64(1)
        if k in index.lengths and ((found := index.find(h)) >= 0).any():
            out[k] = found
    return out


def marginals(words: list[bytes], log_q: np.ndarray, index: Index) -> np.ndarray:
    """Natural-log marginal probability of each word (mark in front) over all its segmentations."""
    out = np.zeros(len(words))
    floor = np.append(log_q, -np.inf)
    for which in _by_length(words, 64):
        block = np.frombuffer(b"".join(SPACE_BYTE + words[i] for i in which), np.uint8).reshape(len(which), -1).astype(np.uint64)
        arcs, n = _arcs(block, index), block.shape[1]
        alpha = np.full((n + 1, len(which)), -np.inf)
        alpha[0] = 0.0
        for end in range(1, n + 1):
            terms = np.stack([alpha[end - k] + floor[a[:, end - k]] for k, a in arcs.items() if k <= end])
            top = terms.max(0)
            safe = np.where(np.isfinite(top), top, 0.0)
            alpha[end] = safe + np.log(np.exp(terms - safe).sum(0))
        out[which] = alpha[n]
    return out


def expected(words: list[bytes], counts: np.ndarray, log_q: np.ndarray, index: Index) -> np.ndarray:
    """Expected uses of each piece over all segmentations of the words, by forward and backward sums."""
    total = np.zeros(len(log_q))
    floor = np.append(log_q, -np.inf)
    for which in _by_length(words, 64):
        block = np.frombuffer(b"".join(SPACE_BYTE + words[i] for i in which), np.uint8).reshape(len(which), -1).astype(np.uint64)
        arcs, n = _arcs(block, index), block.shape[1]
        score = {k: floor[a] for k, a in arcs.items()}
        alpha, beta = np.full((n + 1, len(which)), -np.inf), np.full((n + 1, len(which)), -np.inf)
        alpha[0] = beta[n] = 0.0
        for end in range(1, n + 1):
            terms = np.stack([alpha[end - k] + v[:, end - k] for k, v in score.items() if k <= end])
            safe = np.where(np.isfinite(top := terms.max(0)), top, 0.0)
            alpha[end] = safe + np.log(np.exp(terms - safe).sum(0))
        for start in range(n - 1, -1, -1):
            terms = np.stack([beta[start + k] + v[:, start] for k, v in score.items() if k <= n - start])
            safe = np.where(np.isfinite(top := terms.max(0)), top, 0.0)
            beta[start] = safe + np.log(np.exp(terms - safe).sum(0))
        c = counts[which].astype(float)
        for k, a in arcs.items():
            wide = a.shape[1]
            uses = np.exp(alpha[:wide].T + score[k] + beta[k : k + wide].T - alpha[n][:, None]) * c[:, None]
            good = a >= 0
            total += np.bincount(a[good], weights=uses[good], minlength=len(log_q))
    return total


def _gathered(batches, rules: LatticeRules):
    """Batches of at most rules.batch rows and, but for single rows, rules.batch_bytes of text, whatever came in.

    A batch's packed uses take at most four times its bytes, so their 32-bit offsets hold."""
    held, rows, size = [], 0, 0

    def whole():
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for b in batches:
        ends = np.cumsum(pc.binary_length(b.column(2).fill_null("")).to_numpy().astype(np.int64))
        start = 0
        while start < b.num_rows:
            before = int(ends[start - 1]) if start else 0
            fits = int(np.searchsorted(ends, before + rules.batch_bytes - size, "right")) - start
            n = min(b.num_rows - start, rules.batch - rows, fits)
            if n <= 0 and rows:
                yield whole()
                held, rows, size = [], 0, 0
                continue
            n = max(1, n)
            held.append(b.slice(start, n))
            rows, size, start = rows + n, size + int(ends[start + n - 1]) - before, start + n
    if rows:
        yield whole()


def _joined(batches, rows: int, size: int = 1 << 26):
    """Batches put together to about so many rows or bytes: words are worked on by length, and few at a time cost most."""
    held, n, b = [], 0, 0
    for x in batches:
        held, n, b = [*held, x], n + x.num_rows, b + x.nbytes
        if n >= rows or b >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n, b = [], 0, 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def packed(docs: DataFrame, rules: LatticeRules) -> DataFrame:
    """For each batch of documents a head row (no word) and a row for each word with the documents that have it.

    `batch` is the partition and the batch's number in it, so no two batches share a name whatever they hold; the rows
    are to be written once (`kept`) before they are used, which fixes the names. uses are positions within a batch."""

    def pack(batches):
        from pyspark import TaskContext

        name = TaskContext.get().partitionId() << 32
        for b in _gathered(batches, rules):
            doc, code, words = tokens(b.column(2))
            lengths = np.bincount(doc, minlength=b.num_rows) + 1
            train = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            n, name = len(words), name + 1
            key, times = np.unique(code.astype(np.int64) * b.num_rows + doc, return_counts=True)
            code, doc = key // b.num_rows, key % b.num_rows
            seen = np.bincount(code[train[doc]], weights=times[train[doc]], minlength=n)[:n]
            # the head row, with what the documents need back; then the words
            flat = np.column_stack([doc, times]).astype(np.int32).ravel()
            ends = np.concatenate([[0, 0], 8 * np.cumsum(np.bincount(code, minlength=n)[:n])]).astype(np.int32)
            uses = pa.BinaryArray.from_buffers(pa.binary(), n + 1, [None, pa.py_buffer(ends), pa.py_buffer(flat)])
            ids, none = b.column(0), pa.nulls(n, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n + 1, name, np.int64)), pa.concat_arrays([pa.nulls(1, pa.binary()), words.cast(pa.binary())]), uses,
                    pa.array(np.concatenate([[0], seen]).astype(np.int64)),
                    pa.concat_arrays([pa.array([ids.to_pylist()], pa.list_(pa.int64())), none]), pa.concat_arrays([pa.array([lengths], pa.list_(pa.int64())), none]),
                    pa.concat_arrays([pa.array([train], pa.list_(pa.bool_())), none.cast(pa.list_(pa.bool_()))]),
                ],
                names=["batch", "word", "uses", "seen", "ids", "lengths", "train"],
            )

    return batched(docs).mapInArrow(pack, "batch long, word binary, uses binary, seen long, ids array<long>, lengths array<long>, train array<boolean>")


@dataclass
class LatticeModel:
    """Log probabilities of the pieces and of the end, and the training counts: `words` (word, c), N and V."""

    log_q: np.ndarray
    words: DataFrame
    train_tokens: int
    kinds: int
    rules: LatticeRules


def fit(rows: DataFrame, ends: int, rules: LatticeRules = LatticeRules()) -> LatticeModel:
    """The model from packed rows (`packed`) and the number of training documents."""
    words = kept(rows.filter(F.col("word").isNotNull() & (F.col("seen") > 0)).groupBy("word").agg(F.sum("seen").alias("c")), "lattice-words")
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    names, start = pieces(rules.vocabulary)
    q = start

    def counted(log_q):
        def run(batches):
            index, sums = _index(rules), np.zeros(len(log_q))
            for b in _joined(batches, rules.words):
                sums += expected(b.column(0).to_pylist(), b.column(1).to_numpy(), log_q, index)
            at = np.nonzero(sums)[0]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["piece", "uses"])

        return run

    for _ in range(rules.em_rounds if total["n"] else 0):
        found = words.mapInArrow(counted(np.log(np.maximum(q, 1e-300))), "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()
        uses = rules.prior_weight * start
        uses[-1] += ends
        for r in found:
            uses[r["piece"]] += r["uses"]
        q = uses / uses.sum()
    return LatticeModel(np.log(np.maximum(q, 1e-300)), words, total["n"] + ends, total["v"] + (1 if ends else 0), rules)


def score_packed(rows: DataFrame, model: LatticeModel, ends: int) -> DataFrame:
    """doc_id, train, n_tokens, n_known, base_score and score of each document of the packed rows."""
    rules, log_q = model.rules, model.log_q
    base = np.log10(model.train_tokens + 0.5 * (model.kinds + 1))

    def flushed(sums: dict[int, np.ndarray]):
        for x, v in sums.items():
            at = np.nonzero(v[3])[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], pa.int64()), *(pa.array([v[j][at]], pa.list_(pa.float64())) for j in (0, 1)), pa.array([v[2][at].astype(np.int32)], pa.list_(pa.int32())), pa.array([at.astype(np.int16)], pa.list_(pa.int16()))],
                names=["batch", "own", "plain", "known", "at"],
            )

    def spread(names, key, values):
        """One row for each batch of documents, with sums for those of its documents that occur."""
        found, place = np.unique(key, return_inverse=True)
        offsets = pa.array(np.searchsorted(found, np.arange(len(names) + 1) * rules.batch).astype(np.int32))
        sums = [np.bincount(place, weights=w, minlength=len(found)) for w in values]
        flat = (pa.array(sums[0]), pa.array(sums[1]), pa.array(sums[2].astype(np.int32)), pa.array((found % rules.batch).astype(np.int16)))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), *(pa.ListArray.from_arrays(offsets, x) for x in flat)], names=["batch", "own", "plain", "known", "at"])

    def partial(batches):
        index, sums = _index(rules), {}
        for b in _joined(batches, rules.words):
            word, uses, c, name = b.column(0).to_pylist(), b.column(1), b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy()
            different = {w: i for i, w in enumerate(dict.fromkeys(word))}
            own = marginals(list(different), log_q, index)[[different[w] for w in word]] / np.log(10)
            known = np.nan_to_num(c.astype(float))
            plain = np.log10(known + 0.5) - base
            buffers = uses.buffers()
            offsets = np.frombuffer(buffers[1], np.int32)[uses.offset : uses.offset + len(uses) + 1]
            flat = np.frombuffer(buffers[2], np.int32, offset=int(offsets[0]), count=(int(offsets[-1]) - int(offsets[0])) // 4) if offsets[-1] > offsets[0] else np.zeros(0, np.int32)
            doc, times = flat[0::2], flat[1::2].astype(float)
            row = np.repeat(np.arange(len(word)), np.diff(offsets) // 8)
            names, slot = np.unique(name, return_inverse=True)
            key, values = slot[row] * rules.batch + doc, (times * own[row], times * plain[row], times * (known > 0)[row])
            if len(names) > rules.held_batches:  # words of so many batches of documents add up to nothing here
                yield spread(names, key, values)
                continue
            size = len(names) * rules.batch
            parts = [np.bincount(key, weights=w, minlength=size).reshape(-1, rules.batch) for w in (*values, np.ones(len(key)))]
            for i, x in enumerate(names.tolist()):
                if x not in sums:
                    sums[x] = np.zeros((4, rules.batch))
                for j in range(4):
                    sums[x][j] += parts[j][i]
            if len(sums) > rules.held_batches:
                yield from flushed(sums)
                sums = {}
        yield from flushed(sums)

    joined = rows.filter(F.col("word").isNotNull()).select("batch", "word", "uses").join(model.words, "word", "left").select("word", "uses", F.col("c").cast("double"), "batch")
    parts = joined.mapInArrow(partial, "batch long, own array<double>, plain array<double>, known array<int>, at array<short>")
    heads = rows.filter(F.col("word").isNull()).select("batch", "ids", "lengths", "train")
    last_own, last_plain = float(log_q[-1]) / np.log(10), float(np.log10(ends + 0.5) - base)

    def merged(found: pa.Table) -> pa.Table:
        # one batch of documents: at most rules.batch of them, whatever the size of the input
        ids, lengths, train = [], [], []
        sums = np.zeros((3, rules.batch))
        for b in found.to_batches():
            for i in range(b.num_rows):  # rows: a head, and the sums that the tasks give for this batch of documents
                if b.column("ids")[i].is_valid:
                    ids, lengths, train = (b.column(k)[i].as_py() for k in ("ids", "lengths", "train"))
                else:
                    where = b.column("at")[i].values.to_numpy()
                    for s, k in zip(sums, ("own", "plain", "known"), strict=True):
                        s[where] += b.column(k)[i].values.to_numpy()
        n = len(ids)
        return pa.table(
            [pa.array(ids, pa.int64()), pa.array(train, pa.bool_()), pa.array(lengths, pa.int64()), pa.array(np.rint(sums[2][:n]).astype(np.int64) + (ends > 0)), pa.array(sums[1][:n] + last_plain), pa.array(sums[0][:n] + last_own)],
            names=["doc_id", "train", "n_tokens", "n_known", "base_score", "score"],
        )

    both = heads.unionByName(parts, allowMissingColumns=True)
    return both.groupBy("batch").applyInArrow(merged, "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double")


def score(docs: DataFrame, training, rules: LatticeRules = LatticeRules()) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score and score of each row of docs.

    `training` is the condition of the rows to learn from. Null and empty texts have the end as their only token.
    Rows with one id are scored one by one. Other columns of docs are not read; texts are read whole."""
    few = docs.select(F.col("doc_id").cast("long"), training.alias("train"), "text")
    ends = few.filter("train").count()
    rows = kept(packed(few, rules), "lattice-rows")
    model = fit(rows, ends, rules)
    return score_packed(rows, model, ends).withColumn("train_tokens", F.lit(int(model.train_tokens)).cast("long"))


def op2_lattice_likelihood(spark, sf_dir: str) -> DataFrame:
    """Token counts, base score and lattice score of every document."""
    out = score(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 5) != 1)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
