"""Quality by compression: dictionaries of good and of bad text, and the normalised difference of compressed sizes.

A text that the good dictionary shortens more than the bad one is good. Texts are compressed in fixed blocks, so a
dictionary counts all through a long text and not only at its start. The difference, with the sizes it is made of,
goes through a logistic calibration fitted on labelled rows that no dictionary was trained on."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import batched, fold, labelled, newton_logistic, table


@dataclass(frozen=True)
class CompressionRules:
    """Parameters: rows a class that are learned from, dictionary and block size in bytes, level, one of how many rows
    calibrates (all blocks of the others train the dictionaries), cut of `predicted`."""

    rows_per_class: int = 3000
    dictionary: int = 112_640
    block: int = 2048
    level: int = 3
    calibrates: int = 3
    cut: float = 0.3
    ridge: float = 0.3


@dataclass
class CompressionModel:
    """The dictionaries' bytes, scaling and weights of the calibration; without both classes `prior` is the score."""

    bad: bytes
    good: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None
    prior: float
    rules: CompressionRules

    def compressors(self):
        """Compressors with the bad, the good and no dictionary; made once in each process."""
        plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        out = []
        for content in (self.bad, self.good):
            d = zstandard.ZstdCompressionDict(content)
            d.precompute_compress(level=self.rules.level)
            out.append(zstandard.ZstdCompressor(dict_data=d, **plain))
        return [*out, zstandard.ZstdCompressor(level=self.rules.level, write_content_size=False)]


def _blocks(text: str, size: int) -> list[bytes]:
    data = text.encode("utf-8", "surrogatepass")
    return [data[i : i + size] for i in range(0, len(data), size)]


def sizes(text: str, compressors, block: int) -> list[float]:
    """Normalised compressed sizes of a non-empty text and their differences, over all its blocks."""
    parts = _blocks(text, block)
    n = np.array([len(x) + 1 for x in parts], float)
    s = np.array([[len(c.compress(x)) for x in parts] for c in compressors], float)
    gain, total = s[0] - s[1], n.sum()
    by_block = gain / s[2]
    return [gain.sum() / total, gain.sum() / s[2].sum(), s[0].sum() / total, s[1].sum() / total, s[2].sum() / total, by_block.min(), by_block.max(), (s[1] / n).min(), np.log(total) / 10]


def _second_order(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, x**2] + [x[:, i : i + 1] * x[:, i + 1 :] for i in range(x.shape[1] - 1)], axis=1)


def fit(rows, rules: CompressionRules = CompressionRules()) -> CompressionModel:
    """The model from (doc_id, text, label) rows; with less than two classes every text gets the share of label 1.

    Rows are dealt at random; where a class has none among those that calibrate, all rows do both."""
    rows = [r for r in rows if r["text"]]
    y = np.array([r["label"] for r in rows], float)
    prior = float(y.mean()) if len(y) else 0.5
    model = CompressionModel(b"", b"", np.zeros(0), np.ones(0), None, prior, rules)
    if len(set(y.tolist())) < 2:
        return model
    judge = np.random.default_rng(7).permutation(len(rows)) % rules.calibrates == 0
    learn = ~judge
    if len(set(y[judge].tolist())) < 2 or len(set(y[learn].tolist())) < 2:
        judge = learn = np.ones(len(rows), bool)

    def dictionary(label: int) -> bytes:
        parts = [b for r, l in zip(rows, learn, strict=True) if l and r["label"] == label for b in _blocks(r["text"], rules.block)]
        try:
            return zstandard.train_dictionary(rules.dictionary, parts).as_bytes()
        except zstandard.ZstdError:  # too few samples to train on: the samples, up to a dictionary's size, are the dictionary
            return b"".join(parts)[-rules.dictionary :] or b"\n" * 64

    model.bad, model.good = dictionary(0), dictionary(1)
    c = model.compressors()
    x = _second_order(np.array([sizes(r["text"], c, rules.block) for r, j in zip(rows, judge, strict=True) if j]))
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-9
    model.weights = newton_logistic((x - model.mean) / model.scale, y[judge], ridge=rules.ridge)
    return model


def score(docs: DataFrame, model: CompressionModel) -> DataFrame:
    """doc_id, score (0 to 1, higher: better text), predicted and the raw gain of each row of docs.

    Null and empty texts have nothing to compress: score 0. Rows are independent and other columns of docs are not
    read; a text of any length is compressed whole, block by block."""
    rules = model.rules

    def run(batches):
        c = model.compressors() if model.weights is not None else None
        for batch in batches:
            texts = batch.column(1).to_pylist()
            out, gain = np.full(len(texts), model.prior), np.zeros(len(texts))
            full = [i for i, t in enumerate(texts) if t]
            if c and full:
                raw = np.array([sizes(texts[i], c, rules.block) for i in full])
                x = (_second_order(raw) - model.mean) / model.scale
                out[full] = 1 / (1 + np.exp(-np.clip(np.c_[x, np.ones(len(x))] @ model.weights, -30, 30)))
                gain[full] = raw[:, 1]
            out[[i for i, t in enumerate(texts) if not t]] = 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out), pa.array((out >= rules.cut).astype(np.int32)), pa.array(gain)], names=["doc_id", "score", "predicted", "gain"])

    return batched(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, predicted int, gain double")


def op9_quality_compression(spark, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from labelled rows outside the fold."""
    docs = table(spark, sf_dir, "documents")
    model = fit(labelled(docs, table(spark, sf_dir, "labels"), "quality", lambda i: fold(i, 5) != 0, CompressionRules().rows_per_class))
    return score(docs, model).select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted", "gain")
