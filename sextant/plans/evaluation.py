"""Queries of the evaluation pass: outcomes of scores, and their grades."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant import config as C
from sextant.functions.scalar import rounded, stale_fundamentals
from sextant.functions.stats import detectable, overlap_t
from sextant.operators import asof, forward, ranking, reports
from sextant.plans import core
from sextant.plans import oracle as O
from sextant.sources.bars import bars, levels, read, watchlist
from sextant.sources.store import written

QUERIES, ORACLES = {}, {}
HORIZONS = forward.HORIZONS
NAMES = O.COMPONENT_NAMES


def query(name: str, sql: str | None = None):
    """Registers a query, and the SQL that gives its rows."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def outcomes(spark, sf_dir) -> DataFrame:
    """Forward outcomes of every supplier and week."""
    b = levels(spark, sf_dir)
    return forward.outcomes(b["supplier"], watchlist(spark, sf_dir), b["region"], b["all"])


def marked(df: DataFrame) -> DataFrame:
    """df with `recovered` days, rows with fundamentals of their time, and `stale`: recovered without these."""
    late, own = (F.weekofyear("d") % 9 == 0).cast("int"), F.when(F.col("entity") % 2 == 0, 1)
    return df.withColumns({"recovered": late, "stale": stale_fundamentals(late, own)})


def graded(spark, sf_dir) -> DataFrame:
    """Scores joined with what followed, from bars that are made once."""
    return marked(core.scored_outcomes(spark, sf_dir))


def _lead(h: int, table: str, prefix: str) -> str:
    return f"lead(close, {h}) OVER (PARTITION BY entity ORDER BY d) / close - 1 AS {prefix}_{h}d"


def _fall(n: int) -> str:
    return f"CASE WHEN len(ys{n}) = {n + 1} THEN list_max(list_transform(range(1, {n + 2}), lambda i: (list_max(ys{n}[1:i]) - ys{n}[i]) / list_max(ys{n}[1:i]) * 100)) END AS max_drawdown_after_{n}d"


_H = forward.HORIZONS
OUT = f"""own_f AS (SELECT *, {", ".join(_lead(h, "bars", "future_return") for h in _H)}, {", ".join(f"list(close) OVER (PARTITION BY entity ORDER BY d ROWS BETWEEN CURRENT ROW AND {n} FOLLOWING) AS ys{n}" for n in forward.DRAWDOWN_HORIZONS)} FROM bars
), bench_f AS (SELECT entity AS benchmark, d, {", ".join(_lead(h, "region_bars", "future_benchmark_return") for h in _H)} FROM region_bars
), index_f AS (SELECT d, {", ".join(_lead(h, "market", "future_index_return") for h in _H)} FROM market
), outcome AS (SELECT own_f.entity, own_f.d, sector, {", ".join(f"future_return_{h}d, future_benchmark_return_{h}d, future_index_return_{h}d, future_return_{h}d - future_benchmark_return_{h}d AS future_excess_return_{h}d" for h in _H)}, {", ".join(_fall(n) for n in forward.DRAWDOWN_HORIZONS)}
  FROM own_f JOIN watch USING (entity) LEFT JOIN bench_f ON bench_f.benchmark = watch.benchmark AND bench_f.d = own_f.d LEFT JOIN index_f ON index_f.d = own_f.d)"""
ONLY_OUT = f"WITH {O.WATCH}, {O.BARS}, {O.REGION}, {O.MARKET}, {OUT}"
_STALE = "weekofyear(s.d) % 9 = 0 AND s.entity % 2 <> 0 AS stale"
GRADED = f"WITH {O.SCORES}, {O.MARKET}, {OUT}, graded AS (SELECT s.entity, s.d, {', '.join(f's.{n}' for n in (*NAMES, *C.SCORE_WEIGHTS))}, CAST(weekofyear(s.d) % 9 = 0 AS INTEGER) AS recovered, {_STALE}, o.* EXCLUDE (entity, d) FROM scored s JOIN outcome o ON s.entity = o.entity AND s.d = o.d)"
LONG = f"{GRADED}, long_ AS (" + " UNION ALL ".join(f"SELECT entity, d, stale, {h} AS horizon, score_{h}d AS score, future_excess_return_{h}d AS excess, {f'max_drawdown_after_{h}d' if h in forward.DRAWDOWN_HORIZONS else 'CAST(NULL AS DOUBLE)'} AS fall FROM graded" for h in HORIZONS) + "), full_ AS (SELECT * FROM long_ WHERE excess IS NOT NULL AND score IS NOT NULL)"
MIN_NAMES = C.DECILE_MIN_NAMES
DAYS = f"{LONG}, days AS (SELECT *, count(*) OVER (PARTITION BY horizon, d) AS names, min(score) OVER (PARTITION BY horizon, d) AS lowest, max(score) OVER (PARTITION BY horizon, d) AS highest FROM full_ WHERE NOT stale QUALIFY count(*) OVER (PARTITION BY horizon, d) >= {MIN_NAMES})"
_DEC = O.rank("score", "horizon, d", "DESC")
DEC = f"{DAYS}, dec AS (SELECT *, CAST(least(10, greatest(1, ceil(round({_DEC} / 100 * 10, 9)))) AS INTEGER) AS decile FROM days WHERE lowest < highest), dd AS (SELECT horizon, d, decile, avg(excess) AS mean, median(excess) AS median, avg(CASE WHEN excess > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100 AS hit, count(*) AS names FROM dec GROUP BY 1, 2, 3)"


def pairs_sql(source: str, names, horizons, excess: str = "future_excess_return_{h}d", more: str = "") -> str:
    """CTE `pairs` (d, entity, more, series, horizon, value, excess) from a frame with components and outcomes."""
    value = lambda n: f"CASE WHEN NOT stale THEN {n} END" if n in C.SITOUT else n
    series = ", ".join(f"{{'series': '{n}', 'value': {value(n)}}}" for n in names)
    ahead = ", ".join(f"{{'horizon': {h}, 'excess': {excess.format(h=h)}}}" for h in horizons)
    return f"pairs0 AS (SELECT d, entity{more}, unnest([{series}]) AS s, [{ahead}] AS hs FROM {source}), pairs1 AS (SELECT d, entity{more}, s, unnest(hs) AS h FROM pairs0), pairs AS (SELECT d, entity{more}, s.series AS series, s.value AS value, h.horizon AS horizon, h.excess AS excess FROM pairs1)"


def ic_sql(keys: str, least: int, source: str = "pairs", out: str = "ic") -> str:
    """CTE `out`: correlations of value and excess by keys over complete pairs."""
    avg_rank = lambda x: f"rank() OVER (PARTITION BY {keys} ORDER BY {x}) + (count(*) OVER (PARTITION BY {keys}, {x}) - 1) / 2.0::DOUBLE"
    corr = lambda a, b: f"CASE WHEN stddev_pop({a}) * stddev_pop({b}) > 1e-15 THEN covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) END"
    return f"{out}_r AS (SELECT *, {avg_rank('value')} AS rx, {avg_rank('excess')} AS ry FROM {source} WHERE value IS NOT NULL AND excess IS NOT NULL), {out} AS (SELECT {keys}, count(*) AS n, {corr('value', 'excess')} AS pearson_ic, {corr('rx', 'ry')} AS spearman_ic FROM {out}_r GROUP BY {keys} HAVING count(*) >= {least})"


PAIRS = f"{GRADED}, {pairs_sql('graded', NAMES, HORIZONS)}"


def _ic(keys: str, least: int, names=NAMES, horizons=HORIZONS) -> str:
    return f"{GRADED}, {pairs_sql('graded', names, horizons)}, {ic_sql(keys, least)}"


_FR = tuple(f"future_{k}_{h}d" for h in _H for k in ("return", "benchmark_return", "index_return", "excess_return"))


@query("forward_returns", f"{ONLY_OUT} SELECT entity, d, {O.r6(*_FR)} FROM outcome")
def forward_returns(spark, sf_dir):
    return core.picked(outcomes(spark, sf_dir), *_FR)


@query("forward_drawdown", f"{ONLY_OUT} SELECT entity, d, {O.r6('max_drawdown_after_20d', 'max_drawdown_after_60d')} FROM outcome")
def forward_drawdown(spark, sf_dir):
    return core.picked(outcomes(spark, sf_dir), "max_drawdown_after_20d", "max_drawdown_after_60d")


@query("maturity_dates", f"WITH {O.MARKET} SELECT d, row_number() OVER (ORDER BY d) - 1 AS session, lead(d, 20) OVER (ORDER BY d) AS matures FROM market")
def maturity_dates(spark, sf_dir):
    return forward.maturities(forward.calendar(bars(spark, sf_dir, "all")), 20).withColumn("session", F.col("session").cast("long"))


@query("bucket_report", f"{LONG} SELECT horizon, {O.label('score')} AS label, count(*) AS n, round(avg(excess), 6) AS avg_excess, round(median(excess), 6) AS median_excess, round(avg(CASE WHEN excess > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100, 6) AS hit_rate_pct, round(avg(fall), 6) AS avg_drawdown_after FROM full_ GROUP BY 1, 2")
def bucket_report(spark, sf_dir):
    return rounded(reports.buckets(reports.long_form(graded(spark, sf_dir), HORIZONS)))


@query("decile_assignment", f"{DEC} SELECT horizon, d, entity, decile FROM dec")
def decile_assignment(spark, sf_dir):
    days = reports.cross_sections(reports.long_form(graded(spark, sf_dir), HORIZONS), MIN_NAMES)
    return days.filter("lowest < highest").select("horizon", "d", "entity", ranking.deciles("score", C.DECILES, "horizon", "d").alias("decile"))


@query("decile_report", f"{DEC} SELECT horizon, decile, count(*) AS n_days, round(avg(names), 6) AS avg_names, round(avg(mean), 6) AS avg_excess, round(avg(median), 6) AS median_excess, round(avg(hit), 6) AS hit_rate_pct FROM dd GROUP BY 1, 2")
def decile_report(spark, sf_dir):
    return rounded(reports.decile_report(reports.cross_sections(reports.long_form(graded(spark, sf_dir), HORIZONS), MIN_NAMES)))


@query("decile_spread", f"{DEC}, sp AS (SELECT horizon, d, max(CASE WHEN decile = 1 THEN mean END) - max(CASE WHEN decile = 10 THEN mean END) AS spread FROM dd GROUP BY 1, 2), fl AS (SELECT horizon, count(*) AS days_considered, CAST(sum(flat) AS BIGINT) AS days_flat FROM (SELECT horizon, d, CASE WHEN min(lowest) >= max(highest) THEN 1 ELSE 0 END AS flat FROM days GROUP BY 1, 2) GROUP BY 1), ag AS (SELECT horizon, count(*) AS n_days, avg(spread) AS a, median(spread) AS m, stddev_samp(spread) AS s, avg(CASE WHEN round(spread, 9) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100 AS pos FROM sp WHERE spread IS NOT NULL GROUP BY 1) SELECT horizon, n_days, round(a, 6) AS spread_avg, round(m, 6) AS spread_median, round(s, 6) AS spread_std, round(pos, 6) AS pct_days_positive, round(CASE WHEN s > 0 THEN a / (s / sqrt(greatest(1.0::DOUBLE, n_days / CAST(horizon AS DOUBLE)))) END, 6) AS spread_t, days_considered, days_flat FROM ag JOIN fl USING (horizon)")
def decile_spread(spark, sf_dir):
    return rounded(reports.decile_spread(reports.cross_sections(reports.long_form(graded(spark, sf_dir), HORIZONS), MIN_NAMES)))


@query("selection_report", f"{DAYS}, rk AS (SELECT *, rank() OVER (PARTITION BY horizon, d ORDER BY score DESC) AS place, avg(excess) OVER (PARTITION BY horizon, d) AS day_mean FROM days WHERE lowest < highest), ev AS (SELECT horizon, size, d, avg(excess) AS mean, count(*) AS names, avg(CASE WHEN excess > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100 AS hit, avg(excess) - first(day_mean) AS over_ FROM rk, (VALUES (3), (10), (25)) t(size) WHERE place <= size GROUP BY 1, 2, 3) SELECT horizon, size, count(*) AS n_days, round(avg(names), 6) AS avg_names, round(avg(mean), 6) AS avg_excess, round(avg(hit), 6) AS hit_rate_pct, round(avg(over_), 6) AS avg_over_universe FROM ev GROUP BY 1, 2")
def selection_report(spark, sf_dir):
    return rounded(reports.selections(reports.cross_sections(reports.long_form(graded(spark, sf_dir), HORIZONS), MIN_NAMES)))


_RECENT = "recent AS (SELECT * FROM pairs WHERE d IN (SELECT d FROM (SELECT DISTINCT d FROM graded WHERE recovered = 0) ORDER BY d DESC LIMIT 60))"
_BOTH = f"{_ic('series, horizon', 5)}, {_RECENT}, {ic_sql('series, horizon', 5, 'recent', 'ric')}"


def _pooled(spark, sf_dir):
    """Pooled ICs of all rows, and of those of the newest 60 days that ran live."""
    return reports.pooled_ics(graded(spark, sf_dir), NAMES, HORIZONS, 60, "recovered = 0")


@query("component_ic", f"{_BOTH} SELECT 'all' AS span, series, horizon, n, round(pearson_ic, 6) AS pearson_ic, round(spearman_ic, 6) AS spearman_ic FROM ic UNION ALL SELECT 'recent', series, horizon, n, round(pearson_ic, 6), round(spearman_ic, 6) FROM ric")
def component_ic(spark, sf_dir):
    full, recent = _pooled(spark, sf_dir)
    return rounded(full.withColumn("span", F.lit("all")).unionByName(recent.withColumn("span", F.lit("recent"))))


@query("daily_ic", f"{_ic('series, horizon, d', MIN_NAMES)} SELECT series, horizon, d, n, round(pearson_ic, 6) AS pearson_ic, round(spearman_ic, 6) AS spearman_ic FROM ic")
def daily_ic(spark, sf_dir):
    return rounded(reports.daily_ic(graded(spark, sf_dir), NAMES, HORIZONS, MIN_NAMES))


_ORD = "CASE WHEN {x} IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY series, horizon, d ORDER BY {x} NULLS LAST, entity) AS DOUBLE) END"


@query("ordinal_daily_ic", f"{PAIRS}, o1 AS (SELECT *, {_ORD.format(x='value')} AS rv, {_ORD.format(x='excess')} AS re FROM pairs), o2 AS (SELECT series, horizon, d, CASE WHEN stddev_pop(rv) * stddev_pop(re) > 1e-15 THEN covar_pop(rv, re) / (stddev_pop(rv) * stddev_pop(re)) END AS ic, count(*) AS n FROM o1 WHERE rv IS NOT NULL AND re IS NOT NULL GROUP BY 1, 2, 3) SELECT series, horizon, d, round(ic, 6) AS ic, n FROM o2 WHERE n >= 3 AND ic IS NOT NULL")
def ordinal_daily_ic(spark, sf_dir):
    return rounded(reports.ordinal_daily_ic(graded(spark, sf_dir), NAMES, HORIZONS))


@query("ic_decay", f"{_ic('series, horizon, d', MIN_NAMES)}, ag AS (SELECT series, horizon, count(*) AS n_days, avg(spearman_ic) AS m, stddev_samp(spearman_ic) AS s, avg(CASE WHEN round(spearman_ic, 9) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100 AS pos, min(d) AS first_day, max(d) AS last_day FROM ic WHERE spearman_ic IS NOT NULL GROUP BY 1, 2) SELECT series, horizon, n_days, round(m, 6) AS mean_ic, round(s, 6) AS std_ic, round(pos, 6) AS pct_positive, first_day, last_day, round(CASE WHEN s > 0 THEN m / (s / sqrt(greatest(1.0::DOUBLE, n_days / CAST(horizon AS DOUBLE)))) END, 6) AS t_stat, n_days >= 60 AS adequate FROM ag")
def ic_decay(spark, sf_dir):
    return rounded(reports.decay(reports.daily_ic(graded(spark, sf_dir), NAMES, HORIZONS, MIN_NAMES)))


@query("ic_decay_common", f"{_ic('series, horizon, d', MIN_NAMES)}, th AS (SELECT d, count(DISTINCT series) AS k FROM ic WHERE horizon = 120 AND spearman_ic IS NOT NULL GROUP BY 1), cd AS (SELECT d FROM th WHERE k = (SELECT count(DISTINCT series) FROM ic WHERE horizon = 120 AND spearman_ic IS NOT NULL)) SELECT series, horizon, count(*) AS n_days, round(avg(spearman_ic), 6) AS mean_ic, min(d) AS first_day, max(d) AS last_day FROM ic WHERE spearman_ic IS NOT NULL AND d IN (SELECT d FROM cd) GROUP BY 1, 2")
def ic_decay_common(spark, sf_dir):
    """Decay over the days on which every component has an IC at the longest horizon."""
    ics = written(reports.daily_ic(graded(spark, sf_dir), NAMES, HORIZONS, MIN_NAMES), "ics")
    return rounded(reports.decay(reports.common_days(ics, 120)).select("series", "horizon", "n_days", "mean_ic", "first_day", "last_day"))


@query("sector_ic_decay", f"{GRADED}, {pairs_sql('graded', NAMES, HORIZONS, more=', sector')}, {ic_sql('sector, series, horizon, d', 5)} SELECT sector, series, horizon, count(*) AS n_days, round(avg(spearman_ic), 6) AS mean_ic FROM ic WHERE spearman_ic IS NOT NULL GROUP BY 1, 2, 3")
def sector_ic_decay(spark, sf_dir):
    """Daily ICs within each sector."""
    ics = reports.daily_ic(graded(spark, sf_dir), NAMES, HORIZONS, 5, ("sector",))
    return rounded(ics.filter("spearman_ic IS NOT NULL").groupBy("sector", "series", "horizon").agg(F.count(F.lit(1)).alias("n_days"), F.avg("spearman_ic").alias("mean_ic")))


_BUCKET = "CASE WHEN s_acctbal < 2500 THEN 'small' WHEN s_acctbal < 6000 THEN 'mid' ELSE 'large' END"
_OVER = ", ".join(f"future_return_{h}d - future_index_return_{h}d AS over_{h}" for h in HORIZONS)


@query("size_bucket_decay", f"{GRADED}, sized AS (SELECT graded.*, {_BUCKET} AS bucket, {_OVER} FROM graded JOIN supplier ON s_suppkey = entity), {pairs_sql('sized', NAMES, HORIZONS, 'over_{h}', ', bucket')}, {ic_sql('bucket, series, horizon, d', 10)}, ag AS (SELECT bucket, series, horizon, count(*) AS n_days, avg(spearman_ic) AS m, stddev_samp(spearman_ic) AS s FROM ic WHERE spearman_ic IS NOT NULL GROUP BY 1, 2, 3) SELECT bucket, series, horizon, n_days, round(m, 6) AS mean_ic, round(CASE WHEN s > 0 THEN m / (s / sqrt(greatest(1.0::DOUBLE, n_days / CAST(horizon AS DOUBLE)))) END, 6) AS t_stat FROM ag")
def size_bucket_decay(spark, sf_dir):
    """Daily ICs within each size bucket, all against one benchmark: the market."""
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity"), F.when(F.col("s_acctbal") < 2500, "small").when(F.col("s_acctbal") < 6000, "mid").otherwise("large").alias("bucket"))
    df = graded(spark, sf_dir).withColumns({f"future_excess_return_{h}d": F.col(f"future_return_{h}d") - F.col(f"future_index_return_{h}d") for h in HORIZONS})
    ics = reports.daily_ic(df.join(s, "entity"), NAMES, HORIZONS, 10, ("bucket",))
    out = ics.filter("spearman_ic IS NOT NULL").groupBy("bucket", "series", "horizon").agg(F.count(F.lit(1)).alias("n_days"), F.avg("spearman_ic").alias("mean_ic"), F.stddev_samp("spearman_ic").alias("s"))
    return rounded(out.withColumn("t_stat", overlap_t(F.col("mean_ic"), F.col("s"), F.col("n_days"), F.col("horizon"))).drop("s"))


_LEGS = {"profit_margin": 1, "operating_margin": 1, "return_on_equity": 1, "debt_to_equity": -1}
_LEG_SQL = f"WITH {O.WATCH}, {O.BARS}, {O.REGION}, {O.MARKET}, {OUT}, {O.REPORTED}, qd AS (SELECT o.entity, o.d, FALSE AS stale, {', '.join(f'p.{f} * {sign} AS {f}' for f, sign in _LEGS.items())}, future_excess_return_20d FROM outcome o ASOF LEFT JOIN reported p ON o.entity = p.entity AND o.d >= p.filed_date), {pairs_sql('qd', tuple(_LEGS), (20,))}, {ic_sql('series, horizon, d', MIN_NAMES)}"


def _leg_ics(spark, sf_dir):
    """Daily ICs of the quality figures, each with the sign that makes more better."""
    df = asof.backward(outcomes(spark, sf_dir), core.reported(spark, sf_dir), "entity", "d", "filed_date", list(_LEGS)).withColumns({f: F.col(f) * F.lit(float(s)) for f, s in _LEGS.items()})
    return reports.daily_ic(df, tuple(_LEGS), (20,), MIN_NAMES)


@query("quality_decomposition", f"{_LEG_SQL}, ag AS (SELECT series, count(*) AS n_days, avg(spearman_ic) AS m, stddev_samp(spearman_ic) AS s FROM ic WHERE spearman_ic IS NOT NULL GROUP BY 1) SELECT series, n_days, round(m, 6) AS mean_ic, round(CASE WHEN s > 0 THEN m / (s / sqrt(greatest(1.0::DOUBLE, n_days / 20.0::DOUBLE))) END, 6) AS t_stat FROM ag")
def quality_decomposition(spark, sf_dir):
    """What each leg of the quality composite is worth by itself."""
    return rounded(reports.decay(_leg_ics(spark, sf_dir)).select("series", "n_days", "mean_ic", "t_stat"))


_LEG_PAIRS = [(a, b) for i, a in enumerate(_LEGS) for b in list(_LEGS)[i + 1 :]]


@query("ic_correlation", f"{_LEG_SQL}, bp AS (SELECT a.series AS a, b.series AS b, round(a.spearman_ic, 9) AS value, round(b.spearman_ic, 9) AS excess FROM ic a JOIN ic b USING (horizon, d) JOIN (VALUES {', '.join(str(p) for p in _LEG_PAIRS)}) p(x, y) ON a.series = x AND b.series = y), {ic_sql('a, b', 10, 'bp', 'cc')} SELECT a, b, n, round(pearson_ic, 6) AS pearson_ic, round(spearman_ic, 6) AS spearman_ic FROM cc")
def ic_correlation(spark, sf_dir):
    """How the daily ICs of two legs go together."""
    return rounded(reports.series_correlation(_leg_ics(spark, sf_dir), _LEG_PAIRS).select("a", "b", "n", "pearson_ic", "spearman_ic"))


_COH = f"{LONG}, nm AS (SELECT *, {O.label('score')} AS label, row_number() OVER (PARTITION BY horizon, d ORDER BY round(score, 6) DESC, entity) AS place FROM full_), coh AS (SELECT d, horizon, count(*) FILTER (label = 'strong') AS n_strong, count(*) FILTER (label = 'strong' AND excess > 0) AS strong_hits, count(*) FILTER (label = 'weak') AS n_weak, count(*) FILTER (label = 'weak' AND excess < 0) AS weak_hits, count(*) FILTER (place <= 10) AS n_top, count(*) FILTER (place <= 10 AND excess > 0) AS top_hits, avg(excess) FILTER (place <= 10) AS top_avg_excess FROM nm GROUP BY 1, 2)"


@query("cohort_grades", f"{_COH} SELECT * REPLACE (round(top_avg_excess, 6) AS top_avg_excess) FROM coh")
def cohort_grades(spark, sf_dir):
    return rounded(reports.cohorts(reports.long_form(graded(spark, sf_dir), HORIZONS)))


@query("scoreboard", f"{_COH}, sb AS (SELECT horizon, count(*) AS n_cohorts, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in ('n_strong', 'strong_hits', 'n_weak', 'weak_hits', 'n_top', 'top_hits'))} FROM coh GROUP BY 1) SELECT *, {', '.join(f'round(CASE WHEN n_{k} >= 20 THEN {k}_hits / CAST(n_{k} AS DOUBLE) * 100 END, 6) AS {k}_hit_pct' for k in ('strong', 'weak', 'top'))} FROM sb")
def scoreboard(spark, sf_dir):
    return rounded(reports.scoreboard(reports.cohorts(reports.long_form(graded(spark, sf_dir), HORIZONS))))


@query("ic_drift", f"{_BOTH} SELECT series, horizon, round(ic.spearman_ic, 6) AS full_ic, round(ric.spearman_ic, 6) AS recent_ic, abs(round(ric.spearman_ic - ic.spearman_ic, 9)) >= 0.05::DOUBLE AS drifted FROM ic LEFT JOIN ric USING (series, horizon)")
def ic_drift(spark, sf_dir):
    return rounded(reports.ic_drift(*_pooled(spark, sf_dir)))


@query("ic_ranking", f"{_ic('series, horizon', 5)} SELECT row_number() OVER (ORDER BY spearman_ic DESC NULLS LAST, series) AS place, series, round(spearman_ic, 6) AS spearman_ic FROM ic WHERE horizon = 20")
def ic_ranking(spark, sf_dir):
    return rounded(reports.ic_ranking(reports.pooled_ic(graded(spark, sf_dir), NAMES, (20,)), 20).withColumn("place", F.col("place").cast("long")))


_BRIEF = ("short_momentum_component", "setup_component")
_LEADING = tuple(n for n in NAMES if n == "trend_component" or ("momentum" in n and n not in _BRIEF) or n.startswith("relative_strength"))
_SIDES = ", ".join(f"{f}(spearman_ic) FILTER (series IN {names}) AS {n}" for n, f, names in (("leading_mean", "avg", _LEADING), ("leading_max", "max", _LEADING), ("brief_mean", "avg", _BRIEF), ("brief_max", "max", _BRIEF)))


@query("ic_health", f"{_ic('series, horizon', 5)}, hh AS (SELECT {_SIDES} FROM ic WHERE horizon = 20) SELECT {O.r6('leading_mean', 'leading_max', 'brief_mean', 'brief_max')}, CASE WHEN leading_mean IS NULL OR brief_mean IS NULL THEN 'unavailable' WHEN round(leading_mean, 9) > round(brief_mean, 9) AND round(leading_max, 9) >= round(brief_max, 9) THEN 'expected' ELSE 'suspect' END AS verdict FROM hh")
def ic_health(spark, sf_dir):
    """Whether the components that should carry the signal do so at 20 sessions."""
    return rounded(reports.ic_health(reports.pooled_ic(graded(spark, sf_dir), NAMES, (20,)), 20, _LEADING, _BRIEF))


@query("weight_notes", f"{_ic('series, horizon', 5)} SELECT series, horizon, CASE WHEN round(spearman_ic, 6) > 0.1::DOUBLE THEN 'IC ' || printf('%.3f', round(spearman_ic, 6)) || ': consider raising its weight' WHEN round(spearman_ic, 6) < -0.05::DOUBLE THEN 'IC ' || printf('%.3f', round(spearman_ic, 6)) || ': consider lowering its weight' WHEN spearman_ic IS NOT NULL THEN 'IC ' || printf('%.3f', round(spearman_ic, 6)) || ': keep its weight' END AS note FROM ic")
def weight_notes(spark, sf_dir):
    """What each component's IC suggests, in words."""
    from sextant.functions.scalar import weight_sentence

    ics = reports.pooled_ic(graded(spark, sf_dir), NAMES, HORIZONS)
    return ics.select("series", "horizon", weight_sentence(F.round("spearman_ic", 6)).alias("note"))


_LAB = O.label("score")
_N = lambda name: f"count(*) FILTER ({_LAB} = '{name}')"


@query("hit_rate_table", f"{LONG} SELECT horizon, {_N('strong')} AS n_strong, round(avg(CASE WHEN excess > 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER ({_LAB} = 'strong'), 6) AS strong_hit_pct, {_N('weak')} AS n_weak, round(avg(CASE WHEN excess < 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER ({_LAB} = 'weak'), 6) AS weak_hit_pct FROM full_ GROUP BY 1")
def hit_rate_table(spark, sf_dir):
    return rounded(reports.hit_rates(reports.long_form(graded(spark, sf_dir), HORIZONS)))


_MOVE = f"{O.SCORES}, ranked_ AS (SELECT d, entity, score_20d, row_number() OVER (PARTITION BY d ORDER BY round(score_20d, 6) DESC, entity) AS place FROM scored WHERE score_20d IS NOT NULL), last_ AS (SELECT d, row_number() OVER (ORDER BY d DESC) AS k FROM (SELECT DISTINCT d FROM ranked_)), now_ AS (SELECT r.* FROM ranked_ r JOIN last_ USING (d) WHERE k = 1), then_ AS (SELECT r.* FROM ranked_ r JOIN last_ USING (d) WHERE k = 2)"


def _last_two(spark, sf_dir):
    """Ranked rows of the last two dates with scores; only these are ranked."""
    place = F.row_number().over(Window.partitionBy("d").orderBy(F.desc(F.round("score_20d", 6)), "entity"))
    found = written(core.scored(spark, sf_dir).filter("score_20d IS NOT NULL").select("d", "entity", "score_20d"), "scores")
    days = found.select("d").distinct().orderBy(F.desc("d")).limit(2)
    both = found.join(F.broadcast(days), "d").select("d", "entity", "score_20d", place.alias("place")).withColumn("k", F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("d"))))
    return both.filter("k = 1"), both.filter("k = 2")


@query("rank_movement", f"WITH {_MOVE} SELECT coalesce(n.entity, t.entity) AS entity, CAST(n.place AS INTEGER) AS place, CAST(t.place AS INTEGER) AS place_before, round(n.score_20d - t.score_20d, 1) + 0.0 AS moved FROM now_ n FULL JOIN then_ t ON n.entity = t.entity")
def rank_movement(spark, sf_dir):
    now, then = _last_two(spark, sf_dir)
    both = now.select("entity", "place", "score_20d").join(then.select("entity", F.col("place").alias("place_before"), F.col("score_20d").alias("before")), "entity", "full_outer")
    return both.select("entity", "place", "place_before", (F.round(F.col("score_20d") - F.col("before"), 1) + F.lit(0.0)).alias("moved"))


@query("entered_exited", f"WITH {_MOVE} SELECT entity, 'entered' AS what FROM (SELECT entity FROM now_ WHERE place <= 10 EXCEPT SELECT entity FROM then_ WHERE place <= 10) UNION ALL SELECT entity, 'exited' FROM (SELECT entity FROM then_ WHERE place <= 10 EXCEPT SELECT entity FROM now_ WHERE place <= 10)")
def entered_exited(spark, sf_dir):
    now, then = (x.filter("place <= 10").select("entity") for x in _last_two(spark, sf_dir))
    return now.subtract(then).withColumn("what", F.lit("entered")).unionByName(then.subtract(now).withColumn("what", F.lit("exited")))


@query("biggest_movers", f"WITH {_MOVE}, mv AS (SELECT n.entity, round(n.score_20d - t.score_20d, 1) + 0.0 AS moved FROM now_ n JOIN then_ t ON n.entity = t.entity), up AS (SELECT *, row_number() OVER (ORDER BY moved DESC, entity) AS k FROM mv WHERE moved > 0), dn AS (SELECT *, row_number() OVER (ORDER BY moved, entity) AS k FROM mv WHERE moved < 0) SELECT 'up' AS side, k AS place, entity, moved FROM up WHERE k <= 5 UNION ALL SELECT 'down', k, entity, moved FROM dn WHERE k <= 5")
def biggest_movers(spark, sf_dir):
    """The five names that rose and that fell most between the last two dates."""
    now, then = _last_two(spark, sf_dir)
    moved = now.select("entity", "score_20d").join(then.select("entity", F.col("score_20d").alias("before")), "entity").select("entity", (F.round(F.col("score_20d") - F.col("before"), 1) + F.lit(0.0)).alias("moved"))
    return ranking.movers(moved, "moved", 5)


@query("selection_power", f"{DAYS}, dm AS (SELECT horizon, d, avg(excess) AS m FROM days GROUP BY 1, 2), ag AS (SELECT horizon, count(*) AS n_days, avg(m) AS mean, stddev_samp(m) AS std FROM dm GROUP BY 1) SELECT horizon, n_days, round(mean, 6) AS mean, round(CASE WHEN std > 0 THEN mean / (std / sqrt(greatest(1.0::DOUBLE, n_days / CAST(horizon AS DOUBLE)))) END, 6) AS t_stat, round(2.8::DOUBLE * std / sqrt(greatest(1.0::DOUBLE, n_days / CAST(horizon AS DOUBLE))), 6) AS detectable FROM ag")
def selection_power(spark, sf_dir):
    daily = reports.cross_sections(reports.long_form(graded(spark, sf_dir), HORIZONS), MIN_NAMES).groupBy("horizon", "d").agg(F.avg("excess").alias("m"))
    ag = daily.groupBy("horizon").agg(F.count(F.lit(1)).alias("n_days"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("std"))
    args = (F.col("n_days"), F.col("horizon"))
    return rounded(ag.select("horizon", "n_days", "mean", overlap_t(F.col("mean"), F.col("std"), *args).alias("t_stat"), detectable(F.col("std"), *args).alias("detectable")))


_FUND = f"{O.WATCH}, {O.REPORTED}, fr AS (SELECT p.* EXCLUDE (filed_date), filed_date AS d, CASE WHEN p.entity % 11 = 0 THEN NULL WHEN p.entity % 13 = 0 THEN '{C.INDEX_SECTOR}' ELSE sector END AS sector FROM reported p JOIN watch USING (entity))"


def _fundamentals(spark, sf_dir):
    """Yearly figures of suppliers, some of them missing, with a few that are an index and a few without a sector."""
    out = core.reported(spark, sf_dir).withColumnRenamed("filed_date", "d").join(watchlist(spark, sf_dir), "entity")
    return out.withColumn("sector", F.when(F.col("entity") % 11 == 0, None).when(F.col("entity") % 13 == 0, C.INDEX_SECTOR).otherwise(F.col("sector")))


def _comp_sql(neutral: bool) -> str:
    return f"WITH {_FUND}, {O.composites('fr', 'composed', neutral)} SELECT entity, d, {O.r6(*C.COMPOSITES)}, sector_rank_fallback FROM composed"


@query("composite_percentile", _comp_sql(False))
def composite_percentile(spark, sf_dir):
    return core.picked(ranking.composites(written(_fundamentals(spark, sf_dir), "figures"), C.COMPOSITES), *C.COMPOSITES, "sector_rank_fallback")


@query("sector_neutral_rank", _comp_sql(True))
def sector_neutral_rank(spark, sf_dir):
    return core.picked(ranking.composites(written(_fundamentals(spark, sf_dir), "figures"), C.COMPOSITES, core.NEUTRAL), *C.COMPOSITES, "sector_rank_fallback")
