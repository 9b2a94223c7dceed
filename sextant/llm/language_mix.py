"""Language identification as a mixture: expectation-maximisation gives each text's language proportions.

Letter n-grams of the labelled rows give every language a distribution over a fixed number of hashed n-grams. A
text's n-grams are then draws from a mixture of these; EM finds the proportions, starting from all languages and
from each single one, and a penalised likelihood (a fixed cost for each further language) selects the set."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import batched, fold, table


@dataclass(frozen=True)
class MixtureRules:
    """Parameters: the sample bound (different texts of a language), the hashed n-gram table and the EM."""

    texts_per_language: int = 1500
    bits: int = 16
    rounds: int = 8
    smooth: float = 0.5
    #: cost in nats of a further language in a text, a fixed part and a part for each log of the text's n-grams
    cost_fixed: float = 8.0
    cost_log: float = 2.0
    #: a language with less than this share of a text is not counted as one of its languages
    least_share: float = 0.03


_FOLD = None


def _folded() -> np.ndarray:
    """Code points below 0x3000 in lower case; those that are no letters become 0 (a boundary)."""
    global _FOLD
    if _FOLD is None:
        out = np.zeros(0x3000, np.uint32)
        for c in range(0x3000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _FOLD = out
    return _FOLD


def grams(text: str, bits: int) -> np.ndarray:
    """Hashed 3-grams of a text's letters, runs of other characters being one boundary; none without a letter."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = _folded()
    wide = code >= low.size
    got = low[np.where(wide, 0, code)]
    if wide.any():
        far = code[wide]
        got[wide] = [ord(chr(c).lower()[0]) if chr(c).isalpha() else 0 for c in far.tolist()]
    keep = (got != 0) | np.concatenate(([True], got[:-1] != 0))
    got = got[keep]
    if not got.any():
        return np.empty(0, np.int64)
    got = np.concatenate((got[:1] * 0, got, got[:1] * 0)).astype(np.uint64)
    h = (got[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (got[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (got[2:] * np.uint64(0x165667B19E3779F9))
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _counted(batches, bits: int):
    """For each batch the n-gram counts by language, as packed rows: bounded by languages times table size."""
    for batch in batches:
        sums: dict[str, np.ndarray] = {}
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            g = grams(text, bits)
            if g.size:
                sums.setdefault(lang, np.zeros(1 << bits, np.int64))
                sums[lang] += np.bincount(g, minlength=1 << bits)
        for lang, n in sums.items():
            at = np.nonzero(n)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * at.size), pa.array(at), pa.array(n[at])], names=["lang", "gram", "n"])


@dataclass
class MixtureModel:
    """Languages, and log-free probabilities of each hashed n-gram: an array of table size by languages."""

    langs: list[str]
    prob: np.ndarray
    rules: MixtureRules


def _sample(docs: DataFrame, most: int) -> DataFrame:
    """(text, lang): about `most` different texts of each language at the most, the same ones in every run.

    A language's different texts are counted by sketches, so copies neither crowd others out of the sample nor take a
    language out of it; copies of a drawn text fall together before the shuffle."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", F.col("lang").cast("string").alias("lang"))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("text", 0.02).alias("n")).collect()
    drawn, keep = F.pmod(F.xxhash64("text"), F.lit(1 << 30)), F.lit(False)
    for row in counts:
        keep = keep | ((F.col("lang") == row["lang"]) & (drawn < int(min(1.0, most / max(1, row["n"])) * (1 << 30))))
    return rows.filter(keep).dropDuplicates(["lang", "text"])


def fit(docs: DataFrame, rules: MixtureRules = MixtureRules()) -> MixtureModel:
    """The model from rows with text and lang; about rules.texts_per_language different texts of a language at the most
    are learned from, each once.

    Without such rows the model has no language and every prediction is `und`."""
    bits = rules.bits
    counts = batched(_sample(docs, rules.texts_per_language)).mapInArrow(lambda it: _counted(it, bits), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    coded = counts.column("lang").combine_chunks().dictionary_encode() if counts.num_rows else pa.array([], pa.string()).dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    names = coded.dictionary.to_pylist()
    langs = sorted(names)
    n, place = np.zeros((1 << bits, len(langs))), np.array([langs.index(x) for x in names], np.int64)
    n[counts.column("gram").to_numpy(), place[coded.indices.to_numpy()]] = counts.column("n").to_numpy()
    share = (n + rules.smooth) / (n.sum(0, keepdims=True) + rules.smooth * n.shape[0]) if langs else n
    return MixtureModel(langs, share.astype(np.float32), rules)


def mixture(model: MixtureModel, text: str | None) -> tuple[list[str], np.ndarray]:
    """Languages of a text, the largest share first, and all languages' shares; empty for a text without letters."""
    g = grams(text or "", model.rules.bits)
    if not g.size or not model.langs:
        return [], np.zeros(len(model.langs))
    rules, k = model.rules, len(model.langs)
    at, n = np.unique(g, return_counts=True)
    p, n, total = model.prob[at].astype(np.float64), n.astype(np.float64), float(g.size)

    def em(active: list[int]) -> tuple[float, np.ndarray]:
        q, w = p[:, active], np.full(len(active), 1.0 / len(active))
        for _ in range(rules.rounds if len(active) > 1 else 0):
            joint = q * w
            w = (joint * (n / joint.sum(1))[:, None]).sum(0) / total
        full = np.zeros(k)
        full[active] = w
        return float(n @ np.log(q @ w)), full

    cost = rules.cost_fixed + rules.cost_log * np.log(total)
    alone = n @ np.log(p)
    best = int(np.argmax(alone))
    chosen, score, share = [best], float(alone[best]), np.eye(k)[best]
    _, spread = em(list(range(k)))
    for i in sorted(range(k), key=lambda i: -spread[i]):
        if i not in chosen and spread[i] >= rules.least_share:
            like, w = em([*chosen, i])
            if like - cost > score:
                chosen, score, share = [*chosen, i], like - cost, w
    order = sorted(chosen, key=lambda i: -share[i])
    return [model.langs[i] for i in order], share


def identify(docs: DataFrame, model: MixtureModel) -> DataFrame:
    """doc_id, lang_pred, score and the languages with their shares, for each row of docs.

    score is the share of the first language. Null, empty and letterless texts: `und`, score 0, no languages. Rows
    are independent; whole texts are read; other columns of docs are not."""
    names = model.langs

    def predict(batches):
        for batch in batches:
            out = [mixture(model, t) for t in batch.column(1).to_pylist()]
            shares = [[float(w[names.index(x)]) for x in found] for found, w in out]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] if f else "und" for f, _ in out], pa.string()), pa.array([min(1.0, s[0]) if s else 0.0 for s in shares], pa.float64()), pa.array([f for f, _ in out], pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))],
                names=["doc_id", "lang_pred", "score", "langs", "shares"],
            )

    return batched(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(predict, "doc_id long, lang_pred string, score double, langs array<string>, shares array<double>")


def keep_identified(docs: DataFrame, model: MixtureModel, wanted: tuple[str, ...] | None = None) -> DataFrame:
    """The rows of docs whose text has a language, and one of `wanted` if these are given, with all their columns; the
    others go. A null `lang`, if there is that column, becomes the language found.

    `wanted` judges by the language with the largest share. A model without a language (no labelled row to learn from)
    keeps every text with a letter and finds no language. Works on the rows themselves, so no join by doc_id and no
    shuffle; columns of any name pass through, texts of any length are read whole."""
    names = docs.columns

    def run(batches):
        for batch in batches:
            texts = batch.column(names.index("text")).to_pylist()
            if model.langs:
                found = [(mixture(model, t)[0] or [None])[0] for t in texts]
                keep = [x is not None and (wanted is None or x in wanted) for x in found]
            else:
                found, keep = [None] * len(texts), [bool(grams(t or "", model.rules.bits).size) for t in texts]
            columns = list(batch.columns)
            if "lang" in names and pa.types.is_string(batch.schema.field("lang").type):
                at = names.index("lang")
                columns[at] = pc.coalesce(columns[at], pa.array(found, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(keep, pa.bool_()))

    return batched(docs).mapInArrow(run, docs.schema)


def op10_language_mixture(spark, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows outside the fold."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(fold(F.col("doc_id"), 5) != 0))
    held = fold(F.col("doc_id"), 5) == 0
    return identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "langs", "shares")
