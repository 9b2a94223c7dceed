"""Toxicity by weak supervision: many voters, a generative label model, and a linear classifier on its posteriors.

Voters are lexicons (a fixed list, and words and word beginnings that are telling on the other parts of the
training rows, so that no lexicon votes on rows it was chosen by), patterns of form, and the rows' own labels as one more voter
that may err. The label model estimates each class's mean votes, the voters' shared covariance, so voters that repeat
each other don't count twice, and how often the labels are right in each class; it is fitted by EM. A ridge logistic
classifier is then trained on the posteriors and is all that scores a text."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import batched, fold, labelled, newton_logistic, table

#: A seed list of insults, in English.
SEED_WORDS = ("idiot", "moron", "stupid", "scum", "trash", "loser", "pathetic", "worthless", "disgusting", "clown", "dumb", "imbecile", "filth", "vermin", "hate", "ugly", "garbage", "jerk", "freak", "fool")

WORD = re.compile(r"[^\W\d_]+")
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
LEAST, MOST = 3, 8


@dataclass(frozen=True)
class ToxicityRules:
    """Parameters: rows a class that are learned from, features and lexicon voters at most, parts of the rows for choosing
    lexicons, EM rounds, the label voter's accuracy before it is estimated and the rows that this guess counts for, cut."""

    rows_per_class: int = 3000
    features: int = 400
    lexicons: int = 12
    least_rows: int = 4
    parts: int = 10
    em_rounds: int = 8
    label_trust: float = 0.93
    trust_rows: float = 50.0
    ridge: float = 3.0
    cut: float = 0.7


@dataclass
class ToxicityModel:
    """Features (words as `w`, beginnings as `w*`), the lexicon of each, scaling and weights; None: one class only."""

    index: dict[str, int]
    lexicon: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None
    prior: float
    accuracies: np.ndarray
    correlations: np.ndarray
    rules: ToxicityRules
    memo: dict = field(default_factory=dict)

    def ids(self, word: str) -> tuple[int, ...]:
        got = self.memo.get(word)
        if got is None:
            if len(self.memo) > 500_000:
                self.memo.clear()
            index = self.index
            got = tuple(index[k] for k in [word, *(word[:n] + "*" for n in range(LEAST, min(MOST, len(word)) + 1))] if k in index)
            self.memo[word] = got
        return got


def _words(text: str) -> Counter:
    return Counter(WORD.findall(text.lower()))


def _keys(words: Counter) -> set[str]:
    out = set(words)
    for w in words:
        out.update(w[:n] + "*" for n in range(LEAST, min(MOST, len(w)) + 1))
    return out


def _counts(bags: list[Counter], y: np.ndarray) -> tuple[Counter, Counter]:
    """Rows of class 0 and of class 1 that each word and beginning occurs in; the key None counts all rows."""
    out = (Counter(), Counter())
    for bag, label in zip(bags, y, strict=True):
        out[int(label)].update({None, *_keys(bag)})
    return out


def _telling(counts: tuple[Counter, Counter], rules: ToxicityRules) -> list[str]:
    """Words and beginnings over-represented in class 1, the most significant first."""
    neg, pos = counts
    n, p, out = max(1, neg[None]), max(1, pos[None]), []
    for k, a in pos.items():
        b = neg.get(k, 0)
        if k is not None and a >= rules.least_rows:
            pooled = (a + b) / (p + n)
            z = (a / p - b / n) / np.sqrt(pooled * (1 - pooled) * (1 / p + 1 / n) + 1e-12)
            if z > 3.5 and a / p > 2 * b / n:
                out.append((-z, k))
    return [k for _, k in sorted(out)[: rules.features]]


def measures(model: ToxicityModel, text: str) -> np.ndarray:
    """Inputs of voters and classifier: hits of each feature, then of each lexicon (count, share), then form."""
    bag = _words(text)
    total = sum(bag.values()) + 1
    hits = np.zeros(len(model.index))
    for w, c in bag.items():
        for i in model.ids(w):
            hits[i] += c
    by = np.bincount(model.lexicon, weights=hits, minlength=model.rules.lexicons + 1)[: model.rules.lexicons + 1] if len(hits) else np.zeros(model.rules.lexicons + 1)
    kinds = (hits > 0).sum()
    n = len(text) + 1
    form = [text.count("!") / n, len(UPPER.findall(text)) / n, np.log(total) / 8, np.log1p(kinds), kinds / np.log(total + 2)]
    return np.concatenate([np.log1p(hits), np.log1p(by), 100 * by / total, form])


def votes(model: ToxicityModel, x: np.ndarray) -> np.ndarray:
    """Votes of the lexicon and pattern voters on rows of measures: 1, 0 (abstains) or -1."""
    m, k = len(model.index), model.rules.lexicons + 1
    by, share, form = x[:, m : m + k], x[:, m + k : m + 2 * k], x[:, m + 2 * k :]
    lexicons = np.where(share > 0.15, 1, 0) + np.where((by == 0) & (form[:, 2:3] > 0.5), -1, 0)
    patterns = [np.where(form[:, 0] > 0.02, 1, 0), np.where(form[:, 1] > 0.5, 1, 0), np.where(form[:, 3] == 0, -1, 0), np.where(form[:, 4] > 0.8, 1, np.where(form[:, 4] < 0.2, -1, 0))]
    return np.column_stack([lexicons, *patterns]).astype(float)


def label_model(v: np.ndarray, y: np.ndarray, rules: ToxicityRules) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors of the rows, accuracies of the voters (the labels last) and correlations of their errors, by EM.

    Each class has mean votes; the covariance of votes about them is shared. Log odds are those of two Gaussians, so
    correlated voters share their weight. The label is a voter of its own, right in each class as often as the posteriors
    say, beside a guess that counts for `trust_rows` rows."""
    trust, cov = np.full(2, rules.label_trust), np.eye(v.shape[1])
    q = np.where(y == 1, trust[1], 1 - trust[0])
    for _ in range(rules.em_rounds):
        p1, p0 = q.sum() + 1e-9, (1 - q).sum() + 1e-9
        m1, m0 = (q @ v) / p1, ((1 - q) @ v) / p0
        r1, r0 = v - m1, v - m0
        cov = ((r1 * q[:, None]).T @ r1 + (r0 * (1 - q)[:, None]).T @ r0) / len(v) + 0.05 * np.eye(v.shape[1])
        w = np.linalg.solve(cov, m1 - m0)
        odds = v @ w - 0.5 * (m1 + m0) @ w + np.log(p1 / p0)
        label_odds = np.where(y == 1, np.log(trust[1] / (1 - trust[0])), np.log((1 - trust[1]) / trust[0]))
        q = 1 / (1 + np.exp(-np.clip(odds + label_odds, -12, 12)))
        guess = rules.label_trust * rules.trust_rows
        right = np.array([((1 - q) * (1 - y)).sum() + guess, (q * y).sum() + guess]) / (np.array([(1 - q).sum(), q.sum()]) + rules.trust_rows)
        trust = np.clip(right, 0.5, 0.999)
    spread = np.sqrt(np.diag(cov))
    voted = np.abs(v).sum(0) + 1e-9
    right = ((v > 0) * q[:, None] + (v < 0) * (1 - q)[:, None]).sum(0) / voted
    return q, np.append(right, (q * y + (1 - q) * (1 - y)).mean()), cov / np.outer(spread, spread)


def _with_features(model: ToxicityModel, counts: tuple[Counter, Counter]) -> ToxicityModel:
    """model with the fixed list and the features that are telling by these counts, dealt over the lexicons by rank."""
    keys, seeds = list(dict.fromkeys([*SEED_WORDS, *_telling(counts, model.rules)])), len(SEED_WORDS)
    return replace(model, index={k: i for i, k in enumerate(keys)}, lexicon=np.array([0 if i < seeds else 1 + (i - seeds) % model.rules.lexicons for i in range(len(keys))]), memo={})


def fit(rows, rules: ToxicityRules = ToxicityRules(), share: float | None = None) -> ToxicityModel:
    """The model from (doc_id, text, label) rows; `share` is class 1's share of all labelled rows, where it is known.

    With less than two classes every text gets the share of label 1."""
    rows = [r for r in rows if r["text"]]
    y = np.array([r["label"] for r in rows], float)
    prior = float(y.mean()) if len(y) else 0.0
    model = ToxicityModel({}, np.zeros(0, int), np.zeros(0), np.ones(0), None, prior, np.zeros(0), np.zeros((0, 0)), rules)
    if len(set(y.tolist())) < 2:
        return model
    bags = [_words(r["text"]) for r in rows]
    part, votes_of, total = np.random.default_rng(3).permutation(len(rows)) % rules.parts, np.zeros((len(rows), rules.lexicons + 5)), _counts(bags, y)
    for own in (np.flatnonzero(part == k) for k in range(rules.parts)):
        if len(own):
            mine = _counts([bags[i] for i in own], y[own])
            chosen = _with_features(model, tuple(a - b for a, b in zip(total, mine, strict=True)))
            votes_of[own] = votes(chosen, np.array([measures(chosen, rows[i]["text"]) for i in own]))
    model = _with_features(model, total)
    x = np.array([measures(model, r["text"]) for r in rows])
    posterior, model.accuracies, model.correlations = label_model(votes_of, y, rules)
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-3
    weight = None
    if share is not None and 0 < share < 1:
        weight = np.where(y == 1, share / prior, (1 - share) / (1 - prior))
    model.weights = newton_logistic((x - model.mean) / model.scale, posterior, weight, ridge=rules.ridge)
    return model


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score (0 to 1, higher: toxic likelier) and predicted of each row of docs.

    Null and empty texts are scored as texts without a word: 0. Rows are independent, whole texts are read, and
    other columns of docs are not."""
    rules = model.rules

    def run(batches):
        for batch in batches:
            out = []
            for t in batch.column(1).to_pylist():
                if not t or model.weights is None:
                    out.append(model.prior if t else 0.0)
                    continue
                z = ((measures(model, t) - model.mean) / model.scale) @ model.weights[:-1] + model.weights[-1]
                out.append(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))
            s = np.array(out, float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= rules.cut).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return batched(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def op1_toxicity_weak(spark, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned from labelled rows outside the fold."""
    docs, labels, rules = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ToxicityRules()
    share = labels.filter(fold(F.col("doc_id"), 3) != 1).agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    model = fit(labelled(docs, labels, "toxic", lambda i: fold(i, 3) != 1, rules.rows_per_class), rules, share)
    return score(docs, model).select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
