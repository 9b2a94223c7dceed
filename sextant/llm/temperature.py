"""Mixing sources by temperature: shares to a power, the power found by interval search, realised as block permutations.

A source with share p of the tokens gets the weight p^t / sum p^t. The largest t in [0, 1] whose entropy reaches the
target is taken, but never one that repeats a source more often than the limit. Each source's documents follow a
pseudo-random permutation, another one for each pass over the source, until the source's budget of tokens is used;
the mixture is cut into blocks that all hold the sources at their weights, and a block is permuted in itself.

Running totals go by buckets of the permutation, so a source with a third of all rows is no single task, and only
ids, sources and token counts are shuffled."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant.llm.common import SPACE, kept, table

NO_SOURCE = "(none)"


@dataclass(frozen=True)
class MixRules:
    """Parameters: target entropy as a share of the largest, passes over a source at most, tokens of the mixture as a
    share of all tokens, tokens of a block, documents of a bucket, points and rounds of the search."""

    entropy: float = 0.97
    passes: float = 4.0
    budget: float = 1.0
    block_tokens: int = 200_000
    bucket_rows: int = 2000
    points: int = 32
    rounds: int = 9


def exponent(shares: DataFrame, rules: MixRules) -> tuple[float, float]:
    """(exponent, sum of shares to that power) for a frame with a positive column p that sums to 1.

    Each round cuts the interval by equal steps and evaluates all of them in one aggregation, so the driver sees a
    row of numbers however many sources there are. Both conditions are monotone in the exponent."""
    p = F.col("p")

    def at(ts: list[float]) -> list[tuple[float, bool, bool]]:
        sums = [x for k, t in enumerate(ts) for x in (F.sum(F.pow(p, F.lit(t))).alias(f"z{k}"), F.sum(F.pow(p, F.lit(t)) * F.log(p)).alias(f"l{k}"))]
        row = shares.agg(F.log(F.count(F.lit(1)).cast("double")).alias("most"), F.min("p").alias("least"), *sums).first()
        out = []
        for k, t in enumerate(ts):
            z, logs = row[f"z{k}"], row[f"l{k}"]
            out.append((z, math.log(z) - t * logs / z >= rules.entropy * row["most"] - 1e-12, rules.budget * row["least"] ** (t - 1) / z <= rules.passes + 1e-12))
        return out

    def search(which: int, want: bool) -> float:
        """The end of the interval where condition `which` turns from `want` on the left to its opposite."""
        low, high = 0.0, 1.0
        for _ in range(rules.rounds):
            ts = [low + (high - low) * k / rules.points for k in range(1, rules.points)]
            held = [x[which] == want for x in at(ts)]
            n = held.index(False) if False in held else len(held)
            low, high = (ts[n - 1] if n else low), (ts[n] if n < len(ts) else high)
        return low if want else high

    ends = at([0.0, 1.0])
    t = 1.0 if ends[1][1] else search(1, True)
    if not ends[0][2] and ends[1][2]:
        t = max(t, search(2, False))
    elif not ends[1][2]:
        t = 1.0
    return t, at([t])[0][0]


def mix(docs: DataFrame, rules: MixRules = MixRules()) -> DataFrame:
    """doc_id, source, n_tokens, epoch, block and place for each time that the mixture takes a row of docs.

    Texts without a word (null, empty) bring no token and are never taken; a null source is the source "(none)". One
    source alone keeps its documents at their budget. A source's last document may pass its budget. Ties of the
    permutation go by doc_id, then token count; repeated rows are taken like any others. Empty tables give no row."""
    tokens = F.size(F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), SPACE), lambda w: w != "")).cast("long")
    rows = kept(docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit(NO_SOURCE)).alias("source"), tokens.alias("n_tokens")).filter("n_tokens > 0"), "mix-rows")
    sources = rows.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    total = sources.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()["t"]
    out = ["doc_id", "source", "n_tokens", "epoch", "block", "place"]
    if not total:
        return rows.select("doc_id", "source", "n_tokens", *[F.lit(0).cast("long").alias(c) for c in out[3:]])
    shares = kept(sources.withColumn("p", F.col("t") / F.lit(total)), "mix-shares")
    power, z = exponent(shares, rules)
    wanted = F.least(F.lit(rules.budget * total) * F.pow("p", F.lit(power)) / F.lit(z), F.lit(rules.passes) * F.col("t"))
    plan = shares.select("source", "t", F.greatest(F.ceil(F.col("n") / rules.bucket_rows), F.lit(1)).cast("long").alias("buckets"), F.greatest(F.round(wanted, 3), F.lit(1.0)).alias("quota"))

    every = rows.join(plan, "source").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("quota") / F.col("t")) - 1)))
    order = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("epoch").cast("string"), F.col("n_tokens").cast("string")).cast("binary"))
    placed = every.withColumn("order", order).withColumn("bucket", F.floor(F.conv(F.substring("order", 1, 8), 16, 10).cast("double") * F.col("buckets") / F.lit(float(1 << 32))).cast("long"))
    sums = placed.groupBy("source", "epoch", "bucket").agg(F.sum("n_tokens").alias("s"))
    upto = Window.partitionBy("source", "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("s").over(upto), F.lit(0))).drop("s")
    inside = Window.partitionBy("source", "epoch", "bucket").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    at = placed.join(starts, ["source", "epoch", "bucket"]).withColumn("at", F.col("epoch") * F.col("t") + F.col("start") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    taken = at.filter(F.col("at") < F.col("quota"))
    blocks = max(1, math.ceil(rules.budget * total / rules.block_tokens))
    dealt = taken.withColumn("block", F.floor(F.col("at") * F.lit(blocks) / F.col("quota")).cast("long"))
    shuffled = Window.partitionBy("block").orderBy("order", "doc_id", "source", "epoch")
    return dealt.withColumn("place", F.row_number().over(shuffled).cast("long")).select(*out)


def op5_temperature_mix(spark, sf_dir: str) -> DataFrame:
    """The mixture of all documents at the default target."""
    return mix(table(spark, sf_dir, "documents"))


#: The mixture by plain running totals and halving of the interval, for the default parameters.
SQL = r"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, coalesce(source, '(none)') AS source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS BIGINT) AS n_tokens FROM {docs}
), full_ AS (SELECT * FROM rows_ WHERE n_tokens > 0),
sources_ AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS t FROM full_ GROUP BY source),
total_ AS (SELECT CAST(sum(t) AS BIGINT) AS total, ln(CAST(count(*) AS DOUBLE)) AS most FROM sources_),
shares_ AS (SELECT source, t, CAST(t AS DOUBLE) / total AS p, total, most FROM sources_, total_),
list_ AS (SELECT list(p ORDER BY p) AS ps, any_value(most) AS most, min(p) AS least FROM shares_),
halves_ AS (
  SELECT 0 AS k, 0.0::DOUBLE AS elo, 1.0::DOUBLE AS ehi, 0.0::DOUBLE AS rlo, 1.0::DOUBLE AS rhi FROM list_
  UNION ALL
  SELECT k + 1,
    CASE WHEN ln(ze) - (elo + ehi) / 2 * le / ze >= 0.97::DOUBLE * most - 1e-12 THEN (elo + ehi) / 2 ELSE elo END,
    CASE WHEN ln(ze) - (elo + ehi) / 2 * le / ze >= 0.97::DOUBLE * most - 1e-12 THEN ehi ELSE (elo + ehi) / 2 END,
    CASE WHEN pow(least, (rlo + rhi) / 2 - 1) / zr <= 4.0::DOUBLE + 1e-12 THEN rlo ELSE (rlo + rhi) / 2 END,
    CASE WHEN pow(least, (rlo + rhi) / 2 - 1) / zr <= 4.0::DOUBLE + 1e-12 THEN (rlo + rhi) / 2 ELSE rhi END
  FROM (SELECT h.*, most, least,
      list_sum(list_transform(ps, lambda x: pow(x, (elo + ehi) / 2))) AS ze, list_sum(list_transform(ps, lambda x: pow(x, (elo + ehi) / 2) * ln(x))) AS le,
      list_sum(list_transform(ps, lambda x: pow(x, (rlo + rhi) / 2))) AS zr FROM halves_ h, list_ WHERE k < 48)
), found_ AS (
  SELECT CASE WHEN -list_sum(list_transform(ps, lambda x: x * ln(x))) >= 0.97::DOUBLE * most - 1e-12 THEN 1.0::DOUBLE
    ELSE greatest(elo, CASE WHEN pow(least, -1) / len(ps) > 4.0::DOUBLE + 1e-12 THEN rhi ELSE 0 END) END AS power, ps
  FROM halves_, list_ WHERE k = 48
), plan_ AS (
  SELECT source, t, greatest(round(least(1.0::DOUBLE * total * pow(p, power) / list_sum(list_transform(ps, lambda x: pow(x, power))), 4.0::DOUBLE * t), 3), 1.0) AS quota, total
  FROM shares_, found_
), every_ AS (
  SELECT f.*, t, quota, total, epoch, md5(concat_ws(':', doc_id, epoch, n_tokens)) AS ord
  FROM full_ f JOIN plan_ USING (source), LATERAL (SELECT unnest(range(0, CAST(ceil(quota / t) AS BIGINT))) AS epoch)
), at_ AS (
  SELECT *, epoch * t + coalesce(sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY ord, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM every_
), dealt_ AS (
  SELECT *, CAST(floor(pos * greatest(1, ceil(total / 200000.0::DOUBLE)) / quota) AS BIGINT) AS block FROM at_ WHERE pos < quota
)
SELECT doc_id, source, n_tokens, CAST(epoch AS BIGINT) AS epoch, block,
  CAST(row_number() OVER (PARTITION BY block ORDER BY ord, doc_id, source, epoch) AS BIGINT) AS place FROM dealt_
"""
ORACLE = SQL.replace("{docs}", "documents")
