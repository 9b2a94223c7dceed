"""Conditions on an entity's past, tests of what followed, and the family-wise null."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant import config as C
from sextant.functions.stats import discoveries, spaced, t_tail
from sextant.functions.windows import by_entity, trailing


def densified(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """Every entity on every session, with NULL where it has no bar: nothing is carried forward.

    Entities times sessions is the panel itself, not a join of its rows; sessions are broadcast, being one calendar."""
    names = bars.select("entity").distinct()
    return names.join(F.broadcast(sessions), F.lit(True)).join(bars, ["entity", "d"], "left")


def streaks(df: DataFrame, n: int, up: bool = True) -> DataFrame:
    """df with `streak`: n changes in a row of one sign; a missing change ends it."""
    change = F.col("close") - F.lag("close").over(by_entity())
    out = df.withColumn("_hit", F.when(change.isNotNull(), ((change > 0) if up else (change < 0)).cast("int")))
    return out.withColumn("streak", F.coalesce((F.min("_hit").over(trailing(n)) == 1) & (F.count("_hit").over(trailing(n)) == n), F.lit(False))).drop("_hit")


def above_sma(n: int) -> Column:
    """Close above the mean of n closes, all of them there."""
    return F.coalesce((F.count("close").over(trailing(n)) == n) & (F.col("close") > F.avg("close").over(trailing(n))), F.lit(False))


def turn_of_month(sessions: DataFrame, k: int = 3) -> DataFrame:
    """(d, turn): the first k sessions of a month and the last k, but for the last month, whose end is not known."""
    month = F.trunc("d", "month")
    by = Window.partitionBy("m")
    out = sessions.withColumn("m", month).withColumns({"a": F.row_number().over(by.orderBy("d")), "b": F.row_number().over(by.orderBy(F.desc("d")))})
    last = sessions.agg(F.max(month).alias("last_m"))
    return out.join(F.broadcast(last), F.lit(True)).select("d", ((F.col("a") <= k) | ((F.col("b") <= k) & (F.col("m") < F.col("last_m")))).alias("turn"))


def on_weekday(day: int) -> Column:
    """Sessions of one weekday, Monday being 0."""
    return F.weekday("d") == day


def in_month(month: int) -> Column:
    """Sessions of one month of the year."""
    return F.month("d") == month


def all_of(*conditions: Column) -> Column:
    """Where every condition holds; a NULL one does not."""
    return reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(False)) for c in conditions])


def not_of(condition: Column) -> Column:
    """Where a condition does not hold; a NULL one does not hold either."""
    return ~F.coalesce(condition, F.lit(False))


def peer_rank(df: DataFrame, lookback: int, top: int) -> DataFrame:
    """df with `in_top`: among the best `top` by return over the lookback; needs max(3, top + 1) peers; ties by entity, descending."""
    out = df.withColumn("_r", F.try_divide(F.col("close"), F.lag("close", lookback).over(by_entity())) - 1)
    day = Window.partitionBy("d")
    place = F.row_number().over(day.orderBy(F.col("_r").desc_nulls_last(), F.desc("entity")))
    return out.withColumn("in_top", F.col("_r").isNotNull() & (F.count("_r").over(day) >= max(3, top + 1)) & (place <= top)).drop("_r")


def forward_by_session(df: DataFrame, horizon: int) -> DataFrame:
    """df with `fwd` (close to close) and `tradable` (next open to close), counted in sessions of the dense panel."""
    end, entry = F.lead("close", horizon).over(by_entity()), F.lead("open", 1).over(by_entity())
    return df.withColumns({"fwd": F.try_divide(end, F.col("close")) - 1, "tradable": F.try_divide(end, entry) - 1})


def outcomes(df: DataFrame, horizons, benchmark: int) -> DataFrame:
    """(target, horizon, excess, session, fwd, tradable): what followed each session of the dense panel by each horizon,
    plain and (but for the benchmark itself) in excess of the benchmark over the same sessions."""
    by, steps = by_entity(), {}
    for h in horizons:
        end = F.lead("close", h).over(by)
        steps[h] = F.struct(F.lit(h).alias("horizon"), (F.try_divide(end, F.col("close")) - 1).alias("fwd"), (F.try_divide(end, F.lead("open", 1).over(by)) - 1).alias("tradable"))
    long = df.select("entity", "session", *[s.alias(f"_h{h}") for h, s in steps.items()]).select("entity", "session", F.explode(F.array(*[f"_h{h}" for h in steps])).alias("x")).select("entity", "session", "x.*")
    index = long.filter(F.col("entity") == benchmark).select("session", "horizon", F.col("fwd").alias("_f"), F.col("tradable").alias("_t"))
    both = long.join(F.broadcast(index), ["session", "horizon"])
    cases = F.array(F.struct(F.lit(False).alias("excess"), F.col("fwd"), F.col("tradable")), F.struct(F.lit(True).alias("excess"), (F.col("fwd") - F.col("_f")).alias("fwd"), (F.col("tradable") - F.col("_t")).alias("tradable")))
    return both.select(F.col("entity").alias("target"), "horizon", "session", F.explode(cases).alias("c")).filter(~F.col("c.excess") | (F.col("target") != benchmark)).select("target", "horizon", "c.excess", "session", "c.fwd", "c.tradable")


def cell_test(df: DataFrame, condition: str, horizon, *keys: str) -> DataFrame:
    """By key (entity unless given): what followed the condition against what followed any day, on triggers that don't overlap.

    Needs session, fwd, tradable and the condition. Below the least number of independent triggers there is no t."""
    gap = F.lit(horizon) if isinstance(horizon, int) else F.first(horizon)
    ok, hit = F.col("fwd").isNotNull(), F.col(condition) & F.col("fwd").isNotNull()
    on = lambda x: F.when(hit, x)
    out = df.groupBy(*(keys or ("entity",))).agg(
        F.sum(hit.cast("int")).alias("n_triggers"), F.sum(ok.cast("int")).alias("n_baseline"), F.array_sort(F.collect_list(on(F.col("session").cast("long")))).alias("_at"), F.avg(on(F.col("fwd"))).alias("mean"), F.avg("fwd").alias("baseline"),
        F.stddev_samp(on(F.col("fwd"))).alias("std"), F.avg(on((F.col("fwd") > 0).cast("double"))).alias("hit_rate"), F.avg(F.when(ok, (F.col("fwd") > 0).cast("double"))).alias("baseline_hit_rate"), F.avg(on(F.col("tradable"))).alias("mean_tradable"), gap.alias("_gap"),
    )
    out = out.withColumn("effective_n", spaced(F.col("_at"), F.col("_gap"))).withColumn("lift", F.col("mean") - F.col("baseline"))
    enough = F.col("effective_n") >= C.PATTERN_MIN_EFFECTIVE
    t = F.when(enough & (F.col("std") > 0), F.col("lift") / (F.col("std") / F.sqrt(F.col("effective_n").cast("double"))))
    return out.withColumns({"t_stat": t, "below_floor": ~enough, "underpowered": (F.col("n_triggers") < C.PATTERN_MIN_TRIGGERS) | (F.col("effective_n") < 2), "detectable": F.when(F.col("effective_n") >= 2, C.POWER_Z * F.col("std") / F.sqrt(F.col("effective_n").cast("double")))}).drop("_at", "_gap")


def family_cells(specs: DataFrame, hits: DataFrame, found: DataFrame) -> DataFrame:
    """One row for each session of each cell: specs (family, spec, condition, on, target, horizon, excess) with whether
    their condition (condition, on, session, hit) holds and what followed (see `outcomes`)."""
    met = specs.join(hits, ["condition", "on"])
    return met.join(found, ["target", "horizon", "excess", "session"])


def family_tests(cells: DataFrame, split: float = C.PATTERN_SPLIT) -> DataFrame:
    """Each cell tested over all sessions, with its lift in the first and in the last part of them, and whether the sign
    held; with Bonferroni and false-discovery verdicts among the family's testable cells."""
    keys = ("family", "spec", "condition", "on", "target", "horizon", "excess")
    last = cells.agg((F.max("session") + 1).alias("n"))
    part = F.when(F.col("session") < F.floor(F.col("n") * split), "early").otherwise("late")
    parted = cells.join(F.broadcast(last), F.lit(True)).withColumn("part", F.explode(F.array(F.lit("full"), part))).drop("n")
    tested = cell_test(parted, "hit", "horizon", *keys, "part")
    full = tested.filter("part = 'full'").drop("part")
    other = tested.filter("part <> 'full'").groupBy("family", "spec").agg(F.max(F.when(F.col("part") == "early", F.col("lift"))).alias("early_lift"), F.max(F.when(F.col("part") == "late", F.col("lift"))).alias("late_lift"), F.max(F.when(F.col("part") == "late", F.col("n_triggers"))).alias("late_triggers"))
    out = full.join(other, ["family", "spec"], "left").withColumn("sign_held", F.signum("lift") == F.signum("late_lift"))
    out = out.withColumn("p_value", t_tail(F.col("t_stat"), (F.col("effective_n") - 1).cast("double")))
    m = F.count("p_value").over(Window.partitionBy("family"))
    out = out.withColumn("family_size", m).withColumn("survives_bonferroni", F.coalesce(F.col("p_value") <= C.PATTERN_ALPHA / F.col("family_size"), F.lit(False)))
    return discoveries(out, "p_value", C.FDR_Q, "family")


def _rotated(mask: np.ndarray, fwd: np.ndarray, horizon: int, offsets: np.ndarray) -> np.ndarray:
    """|t| of a cell with its mask rotated by each offset; 0 where there is none."""
    good, out = ~np.isnan(fwd), np.zeros(len(offsets))
    if not good.any():
        return out
    baseline = fwd[good].mean()
    for k, offset in enumerate(offsets.tolist()):
        at = np.flatnonzero(np.roll(mask, offset) & good)
        n, last = 0, -(10**9)
        for i in at.tolist():
            if i - last >= horizon:
                n, last = n + 1, i
        if n >= C.PATTERN_MIN_EFFECTIVE and len(at) > 1 and (sd := fwd[at].std(ddof=1)) > 0:
            out[k] = abs((fwd[at].mean() - baseline) / (sd / np.sqrt(n)))
    return out


def family_null(cells: DataFrame, sessions: int, draws: int = C.PATTERN_DRAWS, seed: int = C.PATTERN_SEED, block: int = 25) -> DataFrame:
    """(family, observed, family_p, null_p95): the family's largest |t| against that of `draws` rotations of all its
    conditions by one shared offset each; p counts the observed family as one draw.

    A cell is one row with its mask and outcomes; the draws are dealt over tasks by cell and block of offsets, and the
    largest |t| of a draw is an aggregate. Only the offsets, drawn from the seed, come from the driver."""
    rng = np.random.default_rng(seed)
    offsets = np.array([0] + [int(rng.integers(1, max(2, sessions))) for _ in range(draws)])
    packed = cells.groupBy("family", "spec").agg(F.first("horizon").alias("horizon"), F.array_sort(F.collect_list(F.struct("session", "hit", "fwd"))).alias("x"))
    rows = packed.select("family", "horizon", F.transform("x", lambda r: r["session"].cast("int")).alias("at"), F.transform("x", lambda r: F.coalesce(r["hit"], F.lit(False))).alias("hit"), F.transform("x", lambda r: r["fwd"]).alias("fwd"), F.explode(F.sequence(F.lit(0), F.lit(draws // block))).alias("block"))

    def run(batches):
        for b in batches:
            for family, horizon, at, hit, fwd, k in zip(*(b.column(i) for i in range(6)), strict=True):
                mask, value = np.zeros(sessions, bool), np.full(sessions, np.nan)
                place = at.values.to_numpy()
                mask[place] = hit.values.to_numpy(zero_copy_only=False)
                value[place] = fwd.values.to_numpy(zero_copy_only=False)
                first = k.as_py() * block
                found = _rotated(mask, value, horizon.as_py(), offsets[first : first + block])
                yield pa.RecordBatch.from_arrays([pa.array([family.as_py()] * len(found), pa.string()), pa.array(np.arange(first, first + len(found))), pa.array(found)], names=["family", "draw", "abs_t"])

    best = rows.repartition("family", "block", "horizon").mapInArrow(run, "family string, draw long, abs_t double").groupBy("family", "draw").agg(F.max("abs_t").alias("t"))
    seen = best.filter("draw = 0").select("family", F.col("t").alias("observed"))
    joined = best.filter("draw > 0").join(F.broadcast(seen), "family")
    return joined.groupBy("family", "observed").agg(((F.sum((F.col("t") >= F.col("observed")).cast("int")) + 1) / (F.count(F.lit(1)) + 1)).alias("family_p"), F.percentile("t", F.lit(0.95)).alias("null_p95"))
