"""Grades of scores: buckets, deciles, selections, information coefficients; days count alike in two-stage means."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sextant import config as C
from sextant.functions.scalar import label
from sextant.functions.stats import overlap_t, pooled_median, spearman
from sextant.operators import pooled
from sextant.operators.ranking import deciles
from sextant.sources.store import written


def long_form(df: DataFrame, horizons) -> DataFrame:
    """(entity, d, horizon, score, excess, fall, stale): one row a horizon, from one scan."""
    cases = [F.struct(F.lit(h).alias("horizon"), F.col(f"score_{h}d").alias("score"), F.col(f"future_excess_return_{h}d").alias("excess"), (F.col(f"max_drawdown_after_{h}d") if f"max_drawdown_after_{h}d" in df.columns else F.lit(None).cast("double")).alias("fall")) for h in horizons]
    stale = F.col("stale") if "stale" in df.columns else F.lit(False)
    return df.select("entity", "d", stale.alias("stale"), F.explode(F.array(*cases)).alias("x")).select("entity", "d", "stale", "x.*")


def buckets(long: DataFrame) -> DataFrame:
    """Outcomes by horizon and label of the score. Labels are few and their rows many: medians come from counted values."""
    named = long.filter("excess IS NOT NULL AND score IS NOT NULL").select("horizon", label(F.col("score")).alias("label"), "excess", "fall").filter("label IS NOT NULL")
    rows = written(named, "labelled")
    found = rows.groupBy("horizon", "label").agg(F.count(F.lit(1)).alias("n"), F.avg("excess").alias("avg_excess"), (F.avg((F.col("excess") > 0).cast("double")) * 100).alias("hit_rate_pct"), F.avg("fall").alias("avg_drawdown_after"))
    return found.join(pooled_median(rows, "excess", "median_excess", "horizon", "label"), ["horizon", "label"])


def cross_sections(long: DataFrame, least: int) -> DataFrame:
    """Matured rows without stale fundamentals, of the days with `least` names or more of them, with the day's lowest and
    highest score."""
    by = Window.partitionBy("horizon", "d")
    full = long.filter("excess IS NOT NULL AND score IS NOT NULL AND NOT stale")
    return full.withColumns({"names": F.count(F.lit(1)).over(by), "lowest": F.min("score").over(by), "highest": F.max("score").over(by)}).filter(F.col("names") >= least)


def decile_days(days: DataFrame, n: int = C.DECILES) -> DataFrame:
    """(horizon, d, decile, mean, median, hit, names) of the days whose scores differ."""
    graded = days.filter("lowest < highest").withColumn("decile", deciles("score", n, "horizon", "d"))
    return graded.groupBy("horizon", "d", "decile").agg(F.avg("excess").alias("mean"), F.median("excess").alias("median"), (F.avg((F.col("excess") > 0).cast("double")) * 100).alias("hit"), F.count(F.lit(1)).alias("names"))


def decile_report(days: DataFrame, n: int = C.DECILES) -> DataFrame:
    """Mean over days of each decile's daily figures; an empty decile adds no day."""
    return decile_days(days, n).groupBy("horizon", "decile").agg(F.count(F.lit(1)).alias("n_days"), F.avg("names").alias("avg_names"), F.avg("mean").alias("avg_excess"), F.avg("median").alias("median_excess"), F.avg("hit").alias("hit_rate_pct"))


def decile_spread(days: DataFrame, n: int = C.DECILES) -> DataFrame:
    """First decile less last, day by day, then over days, with the overlap-adjusted t and the degenerate days."""
    seen = days.groupBy("horizon", "d").agg((F.min("lowest") >= F.max("highest")).cast("int").alias("flat")).groupBy("horizon").agg(F.count(F.lit(1)).alias("days_considered"), F.sum("flat").alias("days_flat"))
    daily = decile_days(days, n).groupBy("horizon", "d").agg((F.max(F.when(F.col("decile") == 1, F.col("mean"))) - F.max(F.when(F.col("decile") == n, F.col("mean")))).alias("spread"))
    out = daily.filter("spread IS NOT NULL").groupBy("horizon").agg(
        F.count(F.lit(1)).alias("n_days"), F.avg("spread").alias("spread_avg"), F.median("spread").alias("spread_median"), F.stddev_samp("spread").alias("spread_std"), (F.avg((F.round("spread", 9) > 0).cast("double")) * 100).alias("pct_days_positive")
    )
    return out.withColumn("spread_t", overlap_t(F.col("spread_avg"), F.col("spread_std"), F.col("n_days"), F.col("horizon"))).join(seen, "horizon")


def selections(days: DataFrame, sizes=(3, 10, 25)) -> DataFrame:
    """The best N of a day with all that tie at the cut, against the day's mean; then over days."""
    ranked = days.filter("lowest < highest").withColumn("place", F.rank().over(Window.partitionBy("horizon", "d").orderBy(F.desc("score")))).withColumn("day_mean", F.avg("excess").over(Window.partitionBy("horizon", "d")))
    each = ranked.select("*", F.explode(F.array(*[F.lit(k) for k in sizes])).alias("size")).filter("place <= size")
    daily = each.groupBy("horizon", "size", "d").agg(F.avg("excess").alias("mean"), F.count(F.lit(1)).alias("names"), (F.avg((F.col("excess") > 0).cast("double")) * 100).alias("hit"), (F.avg("excess") - F.first("day_mean")).alias("over"))
    return daily.groupBy("horizon", "size").agg(F.count(F.lit(1)).alias("n_days"), F.avg("names").alias("avg_names"), F.avg("mean").alias("avg_excess"), F.avg("hit").alias("hit_rate_pct"), F.avg("over").alias("avg_over_universe"))


def pooled_ic(df: DataFrame, names, horizons, least: int = 5) -> DataFrame:
    """Correlation of each component with each horizon's excess, over all dates together; pairs ranked among themselves."""
    return pooled.correlations(_pooled_blocks(df, names, horizons), tuple(names), _excesses(horizons), least)


def pooled_ics(df: DataFrame, names, horizons, days: int, live: str, least: int = 5) -> tuple[DataFrame, DataFrame]:
    """`pooled_ic` of all rows, and of those of the newest `days` dates with a row that is `live`: df is made once, and
    what the first takes on disk is gone before the second."""
    blocks = _pooled_blocks(df, names, horizons, live)
    full, recent = (pooled.correlations(b, tuple(names), _excesses(horizons), least) for b in (blocks, pooled.newest(blocks, days)))
    return written(full, "pooled"), recent


def _excesses(horizons) -> dict[int, str]:
    return {h: f"future_excess_return_{h}d" for h in horizons}


def _pooled_blocks(df: DataFrame, names, horizons, live: str | None = None) -> DataFrame:
    """What pooled ICs are made of as blocks; of one date each if those with a `live` row are to be told apart."""
    cube = _cube(df if live is None else df.withColumn("_live", F.expr(live)), names, horizons, *(() if live is None else ("_live",)))
    return pooled.packed(cube, [*names, *_excesses(horizons).values()], *(() if live is None else (F.col("d"), F.col("_live"))))


def _corr(a: np.ndarray, b: np.ndarray) -> float | None:
    """Pearson correlation; None where a side is constant. Shifted first: equal values then deviate by exactly nothing."""
    if not len(a):
        return None
    a, b = a - a[0], b - b[0]
    a, b = a - a.mean(), b - b.mean()
    spread = np.sqrt(a @ a / len(a)) * np.sqrt(b @ b / len(b))
    return None if spread <= 1e-15 else float(a @ b / len(a) / spread)


def _average_ranks(x: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Ranks with ties averaged of the rows that `order` lists by ascending x, at these rows' places; 0 elsewhere."""
    v, out = x[order], np.zeros(len(x))
    differ = (v[1:] != v[:-1]) & ~(np.isnan(v[1:]) & np.isnan(v[:-1]))
    starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(v)), bool), differ)))
    n = np.diff(np.append(starts, len(v)))
    out[order] = np.repeat(starts + (n + 1) / 2, n)
    return out


def _cube(df: DataFrame, names, horizons, *more: str) -> DataFrame:
    """(d, more, entity, names, excesses): what ICs are made of, one row an entity and date; components of fundamentals
    have no value where these are stale."""
    old = F.col("stale") if "stale" in df.columns else F.lit(False)
    value = {n: F.when(~old, F.col(n)) if n in C.SITOUT else F.col(n) for n in names}
    return df.select("d", *more, "entity", *[v.cast("double").alias(n) for n, v in value.items()], *[F.col(f"future_excess_return_{h}d").cast("double").alias(f"future_excess_return_{h}d") for h in horizons])


def _columns(rows: pa.Table, columns) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Values of each column, and whether they are there."""
    return {c: (rows.column(c).fill_null(0.0).to_numpy(), rows.column(c).is_valid().to_numpy()) for c in columns}


def daily_ic(df: DataFrame, names, horizons, least: int = C.DECILE_MIN_NAMES, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, series, horizon, d, n, pearson_ic, spearman_ic): the long form of an IC cube, with average ties and complete pairs.

    Rows are dealt once, by date (and `by`), with a column for each component and excess: the cube of series by horizon
    is never rows. A date's columns are each sorted once; a pair's complete rows are ranked along these orders."""
    ahead, keys = {h: f"future_excess_return_{h}d" for h in horizons}, (*by, "d")
    wide = _cube(df, names, horizons, *by)
    schema = T.StructType([*[wide.schema[k] for k in keys], *T.StructType.fromDDL("series string, horizon int, n long, pearson_ic double, spearman_ic double").fields])

    def day(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        at = _columns(rows, [*names, *ahead.values()])
        order = {c: (lambda i: i[np.argsort(x[i], kind="stable")])(np.flatnonzero(has)) for c, (x, has) in at.items()}
        whole = {c: _average_ranks(x, order[c]) for c, (x, _) in at.items()}
        found = []
        for name in names:
            for h, c in ahead.items():
                both = at[name][1] & at[c][1]
                n = int(both.sum())
                if n >= max(least, 1):
                    rank = {k: whole[k] if n == len(order[k]) else _average_ranks(at[k][0], order[k][both[order[k]]]) for k in (name, c)}
                    found.append((name, h, n, _corr(at[name][0][both], at[c][0][both]), _corr(rank[name][both], rank[c][both])))
        head = {f.name: pa.array([k.as_py()] * len(found), k.type) for f, k in zip(schema.fields, key, strict=False)}
        types = (pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.float64())
        return pa.table(head | {f.name: pa.array([r[i] for r in found], t) for i, (f, t) in enumerate(zip(schema.fields[len(keys) :], types, strict=True))})

    return wide.groupBy(*keys).applyInArrow(day, schema)


def ordinal_daily_ic(df: DataFrame, names, horizons) -> DataFrame:
    """By day with ordinal ranks: each column ranked over its own non-nulls, ties by entity, then correlated where both
    are there. Dealt once by date, as `daily_ic` is."""
    ahead = {h: f"future_excess_return_{h}d" for h in horizons}

    def day(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        at, entity, rank, found = _columns(rows, [*names, *ahead.values()]), rows.column("entity").to_numpy(), {}, []
        for c, (x, has) in at.items():
            i = np.flatnonzero(has)
            rank[c] = np.zeros(len(x))
            rank[c][i[np.lexsort((entity[i], x[i]))]] = np.arange(1.0, len(i) + 1)
        for name in names:
            for h, c in ahead.items():
                both = at[name][1] & at[c][1]
                ic = _corr(rank[name][both], rank[c][both])
                if ic is not None and both.sum() >= 3:
                    found.append((name, h, key[0].as_py(), ic, int(both.sum())))
        types = {"series": pa.string(), "horizon": pa.int32(), "d": key[0].type, "ic": pa.float64(), "n": pa.int64()}
        return pa.table({c: pa.array([r[i] for r in found], t) for i, (c, t) in enumerate(types.items())})

    return _cube(df, names, horizons).groupBy("d").applyInArrow(day, "series string, horizon int, d date, ic double, n long")


def decay(ics: DataFrame, least_days: int = 60) -> DataFrame:
    """Mean, deviation and t of daily ICs by series and horizon, and whether there are days enough."""
    out = ics.filter("spearman_ic IS NOT NULL").groupBy("series", "horizon").agg(
        F.count(F.lit(1)).alias("n_days"), F.avg("spearman_ic").alias("mean_ic"), F.stddev_samp("spearman_ic").alias("std_ic"), (F.avg((F.round("spearman_ic", 9) > 0).cast("double")) * 100).alias("pct_positive"), F.min("d").alias("first_day"), F.max("d").alias("last_day")
    )
    return out.withColumns({"t_stat": overlap_t(F.col("mean_ic"), F.col("std_ic"), F.col("n_days"), F.col("horizon")), "adequate": F.col("n_days") >= least_days})


def cohorts(long: DataFrame, top: int = 10) -> DataFrame:
    """Each day's strong and weak calls and its top names, graded: hits of strong are gains, of weak are losses."""
    named = long.filter("score IS NOT NULL AND excess IS NOT NULL").withColumns({"label": label(F.col("score")), "place": F.row_number().over(Window.partitionBy("horizon", "d").orderBy(F.desc(F.round("score", 6)), "entity"))})
    when = lambda c, x: F.sum(F.when(c, x).otherwise(0))
    strong, weak, best = F.col("label") == "strong", F.col("label") == "weak", F.col("place") <= top
    return named.groupBy("d", "horizon").agg(
        when(strong, 1).alias("n_strong"), when(strong & (F.col("excess") > 0), 1).alias("strong_hits"), when(weak, 1).alias("n_weak"), when(weak & (F.col("excess") < 0), 1).alias("weak_hits"),
        when(best, 1).alias("n_top"), when(best & (F.col("excess") > 0), 1).alias("top_hits"), F.avg(F.when(best, F.col("excess"))).alias("top_avg_excess"),
    )


def scoreboard(graded: DataFrame, least: int = 20) -> DataFrame:
    """Sums of all cohorts; a hit rate needs `least` calls."""
    sums = graded.groupBy("horizon").agg(F.count(F.lit(1)).alias("n_cohorts"), *[F.sum(c).alias(c) for c in ("n_strong", "strong_hits", "n_weak", "weak_hits", "n_top", "top_hits")])
    rate = lambda hits, n: F.when(F.col(n) >= least, F.col(hits) / F.col(n) * 100)
    return sums.withColumns({"strong_hit_pct": rate("strong_hits", "n_strong"), "weak_hit_pct": rate("weak_hits", "n_weak"), "top_hit_pct": rate("top_hits", "n_top")})


def ic_drift(full: DataFrame, recent: DataFrame) -> DataFrame:
    """Pooled ICs of all rows against those of the recent ones, by series and horizon, and whether they have drifted apart."""
    both = full.select("series", "horizon", F.col("spearman_ic").alias("full_ic")).join(recent.select("series", "horizon", F.col("spearman_ic").alias("recent_ic")), ["series", "horizon"], "left")
    return both.withColumn("drifted", F.abs(F.round(F.col("recent_ic") - F.col("full_ic"), 9)) >= C.FACTOR_IC_DRIFT)


def common_days(ics: DataFrame, horizon: int) -> DataFrame:
    """ICs of the days on which every series that ever has one has an IC at the given horizon."""
    there = ics.filter((F.col("horizon") == horizon) & F.col("spearman_ic").isNotNull())
    n = there.agg(F.count_distinct("series").alias("n"))
    days = there.groupBy("d").agg(F.count_distinct("series").alias("k")).join(F.broadcast(n), F.col("k") == F.col("n")).select("d")
    return ics.join(F.broadcast(days), "d", "left_semi")


def series_correlation(ics: DataFrame, pairs: list[tuple[str, str]], least: int = 10) -> DataFrame:
    """(a, b, horizon, n, pearson_ic, spearman_ic) of two series' daily ICs, over the days that both have one.

    ICs are rounded to 9 digits first, so that equal ones tie whatever the order of their sums."""
    table = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])).alias("p")
    side = lambda c: ics.filter("spearman_ic IS NOT NULL").select(F.col("series").alias(c), "horizon", "d", F.round("spearman_ic", 9).alias(f"ic_{c}"))
    wanted = ics.sparkSession.range(1).select(table).select("p.*")
    both = side("a").join(F.broadcast(wanted), "a").join(side("b"), ["b", "horizon", "d"])
    return spearman(both, "ic_a", "ic_b", "a", "b", "horizon", least=least)


def _grades(score: np.ndarray, excess: np.ndarray) -> tuple[float | None, float | None, float | None]:
    """First decile less last, mean of the best ten with all that tie, and rank correlation of one day's scores with what
    followed; without different scores there is only the last, and that is none."""
    order = np.argsort(score, kind="stable")
    rank, s, n = _average_ranks(score, order), score[order], len(score)
    ic = _corr(rank, _average_ranks(excess, np.argsort(excess, kind="stable")))
    if s[0] == s[-1] or np.isnan(s[0]):
        return None, None, ic
    decile = np.clip(np.ceil(np.round((n + 1 - rank) / n * C.DECILES, 9)), 1, C.DECILES)
    first, last, best = (excess[k] for k in (decile == 1, decile == C.DECILES, n - np.searchsorted(s, score, "right") < 10))
    return float(first.mean() - last.mean()) if len(first) and len(last) else None, float(best.mean()), ic


def compared_days(df: DataFrame, names, fits: list, weights: dict[str, dict], mandatory, targets: dict[int, str], least: int = C.DECILE_MIN_NAMES) -> DataFrame:
    """(horizon, variant, d, spread, top10, ic) of each out-of-sample date and set of weights, and of the configured scores.

    `fits` are (horizon, fit, oos_start, oos_end), and `weights` of a variant one vector a (horizon, fit) in the order of
    `names` (see `walkforward.composite` for what a score is). Rows are dealt by date, once for all variants and horizons,
    whose scores are columns of a date and never rows: df that is stored by date (`store.dealt`) needs no exchange."""
    names, configured = list(names), {h: f"score_{h}d" for h in targets}
    read = [*names, *configured.values(), *targets.values()]

    def day(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        d, found = key[0].as_py(), []
        now = [(h, fit) for h, fit, start, end in fits if start <= d <= end]
        at = _columns(rows, read) if now else {}
        x, has = (np.stack([at[n][i] for n in names]) for i in (0, 1)) if now else (None, None)
        for h, fit in now:
            excess, there = at[targets[h]]
            for variant in (*weights, "config"):
                if variant == "config":
                    score, known = at[configured[h]]
                else:
                    w = np.maximum(weights[variant].get((h, fit), np.zeros(len(names))), 0.0)
                    whole = w @ has
                    known = (whole > 0) & np.logical_and.reduce([has[names.index(n)] | (w[names.index(n)] == 0) for n in mandatory])
                    score = (w @ x) / np.where(whole > 0, whole, 1.0)
                both = known & there
                if both.sum() >= max(least, 1):
                    found.append((h, variant, d, *_grades(np.round(score[both], 9), excess[both])))
        types = {"horizon": pa.int32(), "variant": pa.string(), "d": key[0].type, **dict.fromkeys(("spread", "top10", "ic"), pa.float64())}
        return pa.table({c: pa.array([r[i] for r in found], t) for i, (c, t) in enumerate(types.items())})

    return df.select("d", *[F.col(c).cast("double").alias(c) for c in read]).groupBy("d").applyInArrow(day, "horizon int, variant string, d date, spread double, top10 double, ic double")


def compared(days: DataFrame, adequate: int = 60) -> DataFrame:
    """By horizon and variant: mean daily IC and its t, decile spread and the mean of the best ten, of `compared_days`."""
    out = days.groupBy("horizon", "variant").agg(F.count(F.lit(1)).alias("n_days"), F.avg("ic").alias("mean_daily_ic"), F.stddev_samp("ic").alias("_s"), F.count("ic").alias("_k"), F.avg("spread").alias("spread_avg"), F.avg("top10").alias("top_10_avg_excess"))
    return out.withColumns({"ic_t_stat": overlap_t(F.col("mean_daily_ic"), F.col("_s"), F.col("_k"), F.col("horizon")), "adequate": F.col("n_days") >= adequate}).drop("_s", "_k")


def hit_rates(long: DataFrame) -> DataFrame:
    """One row a horizon: hit rates and counts of the strong and of the weak label, side by side."""
    named = long.filter("excess IS NOT NULL AND score IS NOT NULL").withColumn("label", label(F.col("score")))
    on = lambda name, hit: [F.sum((F.col("label") == name).cast("int")).alias(f"n_{name}"), (F.avg(F.when(F.col("label") == name, hit.cast("double"))) * 100).alias(f"{name}_hit_pct")]
    return named.groupBy("horizon").agg(*on("strong", F.col("excess") > 0), *on("weak", F.col("excess") < 0))


def ic_ranking(ics: DataFrame, horizon: int) -> DataFrame:
    """Series by IC at a horizon, the best first, those without one last; ties by name."""
    by = Window.partitionBy(F.lit(0)).orderBy(F.col("spearman_ic").desc_nulls_last(), "series")
    return ics.filter(F.col("horizon") == horizon).select(F.row_number().over(by).alias("place"), "series", "spearman_ic")


def ic_health(ics: DataFrame, horizon: int, leading: tuple[str, ...], brief: tuple[str, ...]) -> DataFrame:
    """(leading_mean, leading_max, brief_mean, brief_max, verdict) of a horizon's pooled ICs.

    Series that should carry the signal against those that should hardly: `expected` if the first have the higher mean
    and no lower maximum, `suspect` if not (dates may be joined wrongly), `unavailable` without an IC on either side."""
    side = lambda names: F.when(F.col("series").isin(list(names)), F.col("spearman_ic"))
    found = ics.filter(F.col("horizon") == horizon).agg(F.avg(side(leading)).alias("leading_mean"), F.max(side(leading)).alias("leading_max"), F.avg(side(brief)).alias("brief_mean"), F.max(side(brief)).alias("brief_max"))
    as_told = (F.round("leading_mean", 9) > F.round("brief_mean", 9)) & (F.round("leading_max", 9) >= F.round("brief_max", 9))
    return found.withColumn("verdict", F.when(F.col("leading_mean").isNull() | F.col("brief_mean").isNull(), "unavailable").when(as_told, "expected").otherwise("suspect"))
