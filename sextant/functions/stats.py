"""Statistics as expressions: guarded correlation, overlap-adjusted t, Student's tail, false-discovery rate."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant import config as C


def moment_corr(x: Column, y: Column) -> Column:
    """Pearson correlation of the pairs without a NULL, from moments; NULL where a side is constant.

    Sums of products of the deviations from a shift would be safer for large means; ranks and returns are small."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    cov = F.covar_pop(a, b)
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(spread > 1e-15, cov / spread)


def overlap_t(mean: Column, std: Column, days: Column, horizon: Column) -> Column:
    """t on the number of observations that don't overlap."""
    return F.when(std > 0, mean / (std / F.sqrt(F.greatest(F.lit(1.0), days / horizon))))


def detectable(std: Column, days: Column, horizon: Column) -> Column:
    """The smallest effect that this many independent observations would show."""
    return C.POWER_Z * std / F.sqrt(F.greatest(F.lit(1.0), days / horizon))


def average_rank(x: str, *keys: str) -> Column:
    """Rank with ties averaged, within keys."""
    by = Window.partitionBy(*keys)
    return F.rank().over(by.orderBy(F.col(x))) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, x)) - 1) / 2


def spearman(df: DataFrame, x: str, y: str, *keys: str, least: int = 5) -> DataFrame:
    """(keys, n, pearson_ic, spearman_ic): complete pairs, ranked again among themselves with ties averaged."""
    full = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumns({"_rx": average_rank(x, *keys), "_ry": average_rank(y, *keys)})
    found = full.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), moment_corr(F.col(x), F.col(y)).alias("pearson_ic"), moment_corr(F.col("_rx"), F.col("_ry")).alias("spearman_ic"))
    return found.filter(F.col("n") >= least)


def pooled_counts(df: DataFrame, x: str, *keys: str) -> DataFrame:
    """(keys, x, n, below): how often each different value of a key occurs, and how many rows of the key lie below it.

    Values are counted, dealt by range over tasks and added up there; what lies in the tasks before is added. No task
    holds a whole key. The dealt counts are written once, so that both sums see the same tasks."""
    from sextant.sources.store import written

    counts = df.groupBy(*keys, x).agg(F.count(F.lit(1)).alias("n"))
    dealt = written(counts.repartitionByRange(*keys, x).withColumn("_part", F.spark_partition_id()), "ranks")
    parts = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    start = dealt.groupBy(*keys, "_part").agg(F.sum("n").alias("_s")).withColumn("_start", F.coalesce(F.sum("_s").over(parts), F.lit(0))).drop("_s")
    inside = Window.partitionBy(*keys, "_part").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("_before", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(start, [*keys, "_part"])
    return placed.select(*keys, x, "n", (F.col("_start") + F.col("_before")).alias("below"))


def pooled_ranks(df: DataFrame, x: str, *keys: str) -> DataFrame:
    """(keys, x, rank): the rank with ties averaged of each different value within its key, however many rows a key has."""
    return pooled_counts(df, x, *keys).select(*keys, x, (F.col("below") + (F.col("n") + 1) / 2).alias("rank"))


def pooled_median(df: DataFrame, x: str, out: str, *keys: str) -> DataFrame:
    """(keys, out): the exact median of the values that are there, for few keys with many rows each."""
    placed = pooled_counts(df.filter(F.col(x).isNotNull()).select(*keys, x), x, *keys)
    total = placed.groupBy(*keys).agg(F.sum("n").alias("_all"))
    holds = lambda p: F.max(F.when((F.col("below") < p) & (p <= F.col("below") + F.col("n")), F.col(x)))
    return placed.join(total, list(keys)).groupBy(*keys).agg(((holds(F.floor((F.col("_all") + 1) / 2)) + holds(F.ceil((F.col("_all") + 1) / 2))) / 2).alias(out))


def pooled_spearman(df: DataFrame, x: str, y: str, *keys: str, least: int = 5) -> DataFrame:
    """As `spearman`, for few keys with many rows each."""
    full = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    for c, name in ((x, "_rx"), (y, "_ry")):
        full = full.join(pooled_ranks(full.select(*keys, c), c, *keys).withColumnRenamed("rank", name), [*keys, c])
    found = full.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), moment_corr(F.col(x), F.col(y)).alias("pearson_ic"), moment_corr(F.col("_rx"), F.col("_ry")).alias("spearman_ic"))
    return found.filter(F.col("n") >= least)


def _incomplete_beta(a: np.ndarray, b: float, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta by a continued fraction (modified Lentz), for a > 0, b > 0, 0 <= x <= 1."""
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    tiny = 1e-300
    c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * c * d
        if np.all(np.abs(c * d - 1) < 1e-14):
            break
    log_front = np.array([math.lgamma(u + v) - math.lgamma(u) - math.lgamma(v) for u, v in zip(p, q, strict=True)])
    with np.errstate(divide="ignore"):
        front = np.exp(log_front + p * np.log(z) + q * np.log1p(-z)) / p
    value = np.where(z <= 0, 0.0, np.where(z >= 1, 1.0, front * h))
    return np.where(swap, 1 - value, value)


def two_sided_p(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided tail of Student's t."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    return _incomplete_beta(df / 2, 0.5, df / (df + t * t))


def _tail(t: pd.Series, df: pd.Series) -> pd.Series:
    ok = t.notna() & (df > 0)
    out = pd.Series(np.nan, index=t.index)
    if ok.any():
        out[ok] = two_sided_p(t[ok].to_numpy(), df[ok].to_numpy())
    return out


def t_tail(t: Column, df: Column) -> Column:
    """Two-sided p-value; NULL without t or degrees of freedom. Spark has no incomplete beta, hence Arrow batches."""
    return F.pandas_udf(_tail, "double")(t, df)


def discoveries(df: DataFrame, p: str, q: float, *family: str) -> DataFrame:
    """df with `bh_rank` and `bh_pass`: Benjamini-Hochberg within a family; NULL p-values don't count."""
    keys = list(family) or [F.lit(0)]
    by = Window.partitionBy(*keys)
    m = F.count(F.col(p)).over(by)
    out = df.withColumn("bh_rank", F.when(F.col(p).isNotNull(), F.row_number().over(by.orderBy(F.col(p).asc_nulls_last()))))
    out = out.withColumn("_cut", F.max(F.when(F.col(p) <= F.col("bh_rank") / m * q, F.col("bh_rank"))).over(by))
    return out.withColumn("bh_pass", F.coalesce(F.col("bh_rank") <= F.col("_cut"), F.lit(False))).drop("_cut")


def spaced(indices: Column, gap: int) -> Column:
    """How many of an ascending array of indices a greedy scan keeps when each must lie `gap` after the last kept."""
    start = F.struct(F.lit(0).alias("n"), F.lit(-(10**9)).cast("long").alias("last"))
    return F.aggregate(indices, start, lambda a, i: F.when(i - a["last"] >= gap, F.struct((a["n"] + 1).alias("n"), i.cast("long").alias("last"))).otherwise(a))["n"]
