"""Exact top-k by inner product: term-at-a-time accumulation into dense score arrays, then selection and merge."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.llm.common import kept, table

#: The largest values that 32 and 64 bit sums may reach.
WORDS = ((np.int32, 1 << 31), (np.int64, 1 << 63))


@dataclass(frozen=True)
class TopKRules:
    """k results a query; a component x becomes floor(scale * x). A cell of work holds about `candidates` rows (a stripe)
    and `queries` query rows (a panel): both bound a task's memory, neither bounds what is compared."""

    k: int = 20
    scale: int = 64
    candidates: int = 8192
    queries: int = 1024


def sparse(vectors: DataFrame, rules: TopKRules = TopKRules()) -> DataFrame:
    """(row, vec_id, terms, weights): the components of a vector that aren't zero, with their places.

    Vectors that are null or hold a null, NaN or infinite component go; an empty vector stays and scores 0. `row` numbers
    the rows of the input, so rows that share a vec_id stay apart. Products beyond a long's range end at its ends."""
    x = F.col("embedding")
    fits = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    part = F.transform(x, lambda v, i: F.struct(i.cast("int").alias("term"), F.floor(v.cast("double") * rules.scale).cast("long").alias("weight")))
    rows = vectors.filter(F.coalesce(fits, F.lit(False))).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.filter(part, lambda p: p["weight"] != 0).alias("parts"))
    return rows.select("row", "vec_id", F.col("parts.term").alias("terms"), F.col("parts.weight").alias("weights"))


def _coordinates(found: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of all components of a table of sparse vectors."""
    terms, weights = (found.column(c).combine_chunks() for c in ("terms", "weights"))
    sizes = terms.value_lengths().to_numpy()
    return np.repeat(np.arange(len(terms)), sizes), terms.flatten().to_numpy(), weights.flatten().to_numpy()


def _most(term: np.ndarray, weight: np.ndarray) -> dict[int, int]:
    """The largest absolute weight of each term."""
    size, out = [abs(int(w)) for w in (weight.min(initial=0), weight.max(initial=0))], {}
    if max(size) < 1 << 31:
        most = np.zeros(int(term.max(initial=-1)) + 1, np.int64)
        np.maximum.at(most, term, np.abs(weight))
        return dict(enumerate(most.tolist()))
    for t, w in zip(term.tolist(), weight.tolist(), strict=True):
        out[t] = max(out.get(t, 0), abs(w))
    return out


def accumulate(queries: pa.Table, candidates: pa.Table, most_rows: int):
    """(query's place, candidates' places, scores) of each query: its `most_rows` best candidates of this stripe.

    Candidates are taken in the order of their ids, so that of equal scores the first ones are the smallest ids. A term
    that at least half the candidates have is a dense column, any other a posting list that is scattered."""
    ids = candidates.column("vec_id").to_pandas()
    order = np.lexsort((ids.fillna(0).to_numpy(), ids.isna().to_numpy()))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    row, term, weight = _coordinates(candidates)
    _, q_term, q_weight = _coordinates(queries)
    high, q_high = _most(term, weight), _most(q_term, q_weight)
    bound = sum(v * q_high.get(t, 0) for t, v in high.items())
    kind = next((w for w, end in WORDS if max(bound, *high.values(), *q_high.values(), 0) < end), object)
    by = np.argsort(term, kind="stable")
    row, term, weight = place[row[by]], term[by], weight[by].astype(kind)
    starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
    postings = {}
    for t, a, b in zip(term[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(term)], strict=False):
        if 2 * (b - a) >= len(order):
            column = np.zeros(len(order), kind)
            column[row[a:b]] = weight[a:b]
            postings[t] = (None, column)
        else:
            postings[t] = (row[a:b], weight[a:b])
    ends = np.cumsum(queries.column("terms").combine_chunks().value_lengths().to_numpy()).tolist()
    score, product = np.zeros(len(order), kind), np.empty(len(order), kind)
    terms, weights, start = q_term.tolist(), q_weight.tolist(), 0
    for q, end in enumerate(ends):
        score[:] = 0
        for t, w in zip(terms[start:end], weights[start:end], strict=True):
            if t not in postings:
                continue
            at, values = postings[t]
            if at is None:
                np.multiply(values, kind(w) if kind is not object else w, out=product)
                score += product
            else:
                score[at] += values * (kind(w) if kind is not object else w)
        start = end
        if len(score) > most_rows:
            least = np.partition(score, len(score) - most_rows)[len(score) - most_rows]
            over = np.flatnonzero(score > least)
            best = np.r_[over, np.flatnonzero(score == least)[: most_rows - len(over)]]
        else:
            best = np.arange(len(score))
        yield q, order[best], score[best]


def _cell(rules: TopKRules):
    """The best candidates of a cell for each of its queries."""
    low, high = -(1 << 63), (1 << 63) - 1

    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        names, ids = queries.column("row").to_numpy(), candidates.column("vec_id").combine_chunks()
        rows, at, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(queries) and len(candidates):
            for q, best, score in accumulate(queries, candidates, rules.k + 1):
                rows.append(np.full(len(best), names[q]))
                at.append(best)
                scores.append(score.astype(np.int64) if score.dtype != object else np.array([min(max(s, low), high) for s in score], np.int64))
        return pa.table([pa.array(np.concatenate(rows)), ids.take(pa.array(np.concatenate(at))), pa.array(np.concatenate(scores))], names=["row", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, rules: TopKRules = TopKRules()) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows of all others for each row of `vectors` (vec_id, embedding) that
    `is_query`, a condition on vec_id, names: the highest inner products, ties to the smaller vec_id, null ids last.

    The grid of panels of queries and stripes of candidates is worked off cell by cell; a cell holds a bounded number of
    both, dealt by row numbers, so neither equal vectors nor equal ids meet in one place. A cell gives k + 1 rows a query,
    and the best of them over all stripes are the result. A query's own row is no candidate: it is the row with its id
    and its own score, of which one is left out. Rows that share a vec_id are queries of their own and candidates of each
    other. Vectors of different lengths are compared over the places that both have. Null vectors and vectors with null,
    NaN or infinite components take no part; an empty table gives an empty result; other columns aren't read."""
    rows = kept(sparse(vectors.select("vec_id", "embedding"), rules), "topk-vectors")
    asked = rows.filter(is_query)
    n, n_asked = rows.count(), asked.count()
    stripes, panels = max(1, math.ceil(n / rules.candidates)), max(1, math.ceil(n_asked / rules.queries))
    deal = lambda count, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(count)).cast("int")
    left = asked.withColumn("panel", deal(panels, 1)).withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))
    right = rows.withColumn("stripe", deal(stripes, 2)).withColumn("panel", F.explode(F.sequence(F.lit(0), F.lit(panels - 1))))
    cells = left.groupBy("panel", "stripe").cogroup(right.groupBy("panel", "stripe")).applyInArrow(_cell(rules), "row long, vec_id long, score long")
    own = asked.select("row", F.col("vec_id").alias("query_id"), F.aggregate("weights", F.lit(0).cast("decimal(38,0)"), lambda s, w: (s + w.cast("decimal(19,0)") * w.cast("decimal(19,0)")).cast("decimal(38,0)")).alias("_own"))
    best = Window.partitionBy("row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    found = cells.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= rules.k + 1).join(own, "row")
    is_own = F.col("vec_id").eqNullSafe(F.col("query_id")) & (F.col("score") == F.least(F.col("_own"), F.lit((1 << 63) - 1).cast("decimal(38,0)")))
    first_own = F.min(F.when(is_own, F.col("rank"))).over(Window.partitionBy("row"))
    left_in = found.withColumn("_at", first_own).filter(F.col("_at").isNull() | (F.col("rank") != F.col("_at")))
    return left_in.withColumn("rank", F.col("rank") - F.when(F.col("rank") > F.col("_at"), 1).otherwise(0)).filter(F.col("rank") <= rules.k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


#: All pairs of a query and a candidate, in the test tables' size; vec_id is a key there.
ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
), placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM placed WHERE rank <= 20
"""


def op11_exact_topk(spark, sf_dir: str) -> DataFrame:
    """The 20 best of all other rows for every row whose vec_id is divisible by 20."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
