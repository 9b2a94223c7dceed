"""Queries of the research analyses: pattern tests, walk-forward fits, event and sector studies, backtests, streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sextant import config as C
from sextant.functions import stats
from sextant.functions.scalar import rounded
from sextant.functions.windows import by_entity
from sextant.operators import events, expanding, forward, patterns, reports, walkforward
from sextant.plans import core, evaluation
from sextant.plans import oracle as O
from sextant.sources.bars import bars, read, watchlist
from sextant.sources.store import dealt, written
from sextant.streaming import windows as streams

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    """Registers a query, and the SQL that gives its rows."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


ALL = f"{O.REGION}, {O.MARKET}, ss AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS session FROM market), dense AS (SELECT n.entity, ss.d, ss.session, b.open, b.high, b.low, b.close, b.volume FROM (SELECT DISTINCT entity FROM region_bars) n CROSS JOIN ss LEFT JOIN region_bars b ON b.entity = n.entity AND b.d = ss.d)"
_W = "OVER (PARTITION BY entity ORDER BY d)"


def _dense(spark, sf_dir):
    """The regions' bars on every session."""
    return patterns.densified(bars(spark, sf_dir, "region"), forward.calendar(bars(spark, sf_dir, "all")))


@query("densified_panel", f"WITH {ALL} SELECT entity, d, session, round(close, 6) AS close FROM dense")
def densified_panel(spark, sf_dir):
    return rounded(_dense(spark, sf_dir).select("entity", "d", F.col("session").cast("long").alias("session"), "close"))


_STREAK = f"st AS (SELECT *, CASE WHEN lag(close) {_W} IS NOT NULL AND close IS NOT NULL THEN CASE WHEN close > lag(close) {_W} THEN 1 ELSE 0 END END AS hit FROM dense), sk AS (SELECT *, coalesce(min(hit) {O.rows(2)} = 1 AND count(hit) {O.rows(2)} = 2, FALSE) AS streak FROM st)"


@query("streak_condition", f"WITH {ALL}, {_STREAK} SELECT entity, d, streak FROM sk")
def streak_condition(spark, sf_dir):
    return patterns.streaks(_dense(spark, sf_dir), 2).select("entity", "d", "streak")


@query("above_sma_condition", f"WITH {ALL} SELECT entity, d, coalesce(count(close) {O.rows(50)} = 50 AND close > avg(close) {O.rows(50)}, FALSE) AS above FROM dense")
def above_sma_condition(spark, sf_dir):
    return _dense(spark, sf_dir).select("entity", "d", patterns.above_sma(50).alias("above"))


@query("expanding_quantile", f"WITH {ALL}, r AS (SELECT *, close / lag(close, 5) {_W} - 1 AS r FROM dense) SELECT entity, d, coalesce(CASE WHEN count(r) {_W} >= 60 THEN round(r, 9) >= round(quantile_cont(r, 0.9) {_W}, 9) END, FALSE) AS extreme FROM r")
def expanding_quantile(spark, sf_dir):
    df = _dense(spark, sf_dir).withColumn("r", F.try_divide(F.col("close"), F.lag("close", 5).over(by_entity())) - 1)
    bound = expanding.quantile_so_far(df.select("entity", "d", "r"), "r", 0.9, 60, "bound")
    return bound.select("entity", "d", F.coalesce(F.round("r", 9) >= F.round("bound", 9), F.lit(False)).alias("extreme"))


@query("turn_of_period", f"WITH {O.MARKET}, t AS (SELECT d, date_trunc('month', d) AS m, row_number() OVER (PARTITION BY date_trunc('month', d) ORDER BY d) AS a, row_number() OVER (PARTITION BY date_trunc('month', d) ORDER BY d DESC) AS b FROM market) SELECT d, a <= 1 OR (b <= 1 AND m < (SELECT max(m) FROM t)) AS turn FROM t")
def turn_of_period(spark, sf_dir):
    return patterns.turn_of_month(bars(spark, sf_dir, "all").select("d"), 1)


@query("peer_rank", f"WITH {ALL}, r AS (SELECT *, close / lag(close, 10) {_W} - 1 AS r FROM dense) SELECT entity, d, r IS NOT NULL AND count(r) OVER (PARTITION BY d) >= 3 AND row_number() OVER (PARTITION BY d ORDER BY r DESC NULLS LAST, entity DESC) <= 2 AS in_top FROM r")
def peer_rank(spark, sf_dir):
    return patterns.peer_rank(_dense(spark, sf_dir), 10, 2).select("entity", "d", "in_top")


_CELL = f"{_STREAK}, fw AS (SELECT *, lead(close, 5) {_W} / close - 1 AS fwd, lead(close, 5) {_W} / lead(open, 1) {_W} - 1 AS tradable FROM sk)"


def _cells(spark, sf_dir):
    return patterns.forward_by_session(patterns.streaks(_dense(spark, sf_dir), 2), 5)


@query("pattern_cell_test", f"""WITH RECURSIVE {ALL}, {_CELL}, tr AS (SELECT entity, session FROM fw WHERE streak AND fwd IS NOT NULL), gr(entity, pos, n) AS (SELECT entity, min(session), 1 FROM tr GROUP BY entity UNION ALL SELECT g.entity, (SELECT min(session) FROM tr WHERE tr.entity = g.entity AND tr.session >= g.pos + 5), g.n + 1 FROM gr g WHERE (SELECT min(session) FROM tr WHERE tr.entity = g.entity AND tr.session >= g.pos + 5) IS NOT NULL),
ef AS (SELECT entity, max(n) AS effective_n FROM gr GROUP BY 1), ag AS (SELECT entity, count(*) FILTER (streak AND fwd IS NOT NULL) AS n_triggers, count(fwd) AS n_baseline, avg(fwd) FILTER (streak) AS mean, avg(fwd) AS baseline, stddev_samp(fwd) FILTER (streak) AS std, avg(CASE WHEN fwd > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (streak AND fwd IS NOT NULL) AS hit_rate, avg(tradable) FILTER (streak AND fwd IS NOT NULL) AS mean_tradable FROM fw GROUP BY 1)
SELECT entity, n_triggers, n_baseline, effective_n, round(mean, 6) AS mean, round(baseline, 6) AS baseline, round(mean - baseline, 6) AS lift, round(hit_rate, 6) AS hit_rate, round(mean_tradable, 6) AS mean_tradable, round(CASE WHEN effective_n >= 5 AND std > 0 THEN (mean - baseline) / (std / sqrt(effective_n)) END, 6) AS t_stat FROM ag JOIN ef USING (entity)""")
def pattern_cell_test(spark, sf_dir):
    return rounded(patterns.cell_test(_cells(spark, sf_dir), "streak", 5).select("entity", "n_triggers", "n_baseline", "effective_n", "mean", "baseline", "lift", "hit_rate", "mean_tradable", "t_stat"))


def tail_sql(t: str, n: str) -> str:
    """Two-sided tail of Student's t for whole degrees of freedom n, by the finite sums of sines and cosines."""
    angle = f"atan(abs({t}) / sqrt({n}))"
    even = f"sin({angle}) * list_sum(list_transform(range(0, greatest(CAST({n} // 2 AS BIGINT), 1)), lambda k: exp(lgamma(k + 0.5::DOUBLE) - lgamma(k + 1.0::DOUBLE)) / sqrt(pi()) * pow(cos({angle}), 2 * k)))"
    odd = f"2 / pi() * ({angle} + coalesce(CASE WHEN {n} > 1 THEN sin({angle}) * list_sum(list_transform(range(0, greatest(CAST(({n} - 1) // 2 AS BIGINT), 1)), lambda k: sqrt(pi()) / 2 * exp(lgamma(k + 1.0::DOUBLE) - lgamma(k + 1.5::DOUBLE)) * pow(cos({angle}), 2 * k + 1))) END, 0))"
    return f"CASE WHEN {t} IS NOT NULL AND {n} > 0 THEN 1 - CASE WHEN {n} % 2 = 0 THEN {even} ELSE {odd} END END"


@query("student_t_tail", f"WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, (l_orderkey % 700) / 100.0::DOUBLE - 3.5::DOUBLE AS t, 1 + l_partkey % 60 AS n FROM lineitem) SELECT t, n, count(*) AS rows, round({tail_sql('t', 'n')}, 9) AS p_value FROM p GROUP BY t, n")
def student_t_tail(spark, sf_dir):
    """The tail for many values and degrees of freedom."""
    li = read(spark, sf_dir, "lineitem").select(((F.col("l_orderkey") % 700) / 100 - 3.5).alias("t"), (1 + F.col("l_partkey") % 60).alias("n"))
    found = li.groupBy("t", "n").agg(F.count(F.lit(1)).alias("rows"))
    return found.withColumn("p_value", F.round(stats.t_tail(F.col("t"), F.col("n").cast("double")), 9))


@query("bh_fdr", "WITH p AS (SELECT s_suppkey AS k, s_nationkey AS family, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE (s_suppkey % 40) / 400.0::DOUBLE END AS p FROM supplier), r AS (SELECT *, CASE WHEN p IS NOT NULL THEN row_number() OVER (PARTITION BY family ORDER BY p NULLS LAST, k) END AS rk, count(p) OVER (PARTITION BY family) AS m FROM p), c AS (SELECT *, max(CASE WHEN p <= rk / CAST(m AS DOUBLE) * 0.1::DOUBLE THEN rk END) OVER (PARTITION BY family) AS cut FROM r) SELECT k, coalesce(p <= (SELECT max(p) FROM c d WHERE d.family = c.family AND d.rk <= d.cut), FALSE) AS bh_pass FROM c")
def bh_fdr(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("family"), F.when(F.col("s_suppkey") % 7 != 0, (F.col("s_suppkey") % 40) / 400).alias("p"))
    return stats.discoveries(s, "p", C.FDR_Q, "family").select("k", "bh_pass")


def _fits(spark, sf_dir, window: int | None = None, horizons=(20,)):
    """Fits of each horizon, every 21 sessions; the runs are the market's sessions."""
    sessions = written(forward.calendar(bars(spark, sf_dir, "all")), "sessions")
    return written(walkforward.of_horizons({h: walkforward.schedule(sessions.select("d"), sessions, h, 60, 21, window) for h in horizons}), "fits")


def _schedule_sql(window: int | None) -> str:
    first = f"greatest(0, f.i - 20 - {window} + 1)" if window else "0"
    n = f"least(f.i - 19, {window})" if window else "f.i - 19"
    return f"""WITH RECURSIVE {O.MARKET}, ss AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i FROM market), n AS (SELECT max(i) AS last FROM ss),
f AS (SELECT 1 AS fit, CAST(79 AS BIGINT) AS i FROM n WHERE 79 < last UNION ALL SELECT fit + 1, i + 21 FROM f, n WHERE i + 21 < last)
SELECT fit, a.d AS train_end, b.d AS cutoff, CAST({n} AS INTEGER) AS n_train, z.d AS first_train, b.d AS last_train, c.d AS oos_start, e.d AS oos_end FROM f JOIN ss a ON a.i = f.i JOIN ss b ON b.i = f.i - 20 JOIN ss z ON z.i = {first} JOIN ss c ON c.i = f.i + 1 JOIN n ON TRUE JOIN ss e ON e.i = CASE WHEN f.i + 21 <= last THEN f.i + 20 ELSE last END"""


@query("walk_forward_schedule", _schedule_sql(None))
def walk_forward_schedule(spark, sf_dir):
    return _fits(spark, sf_dir).drop("horizon")


@query("walk_forward_rolling", _schedule_sql(126))
def walk_forward_rolling(spark, sf_dir):
    """The same with the newest 126 matured dates only."""
    return _fits(spark, sf_dir, 126).drop("horizon")


NAMES, HORIZONS = evaluation.NAMES, evaluation.HORIZONS
SPEC = {"ic_mean": False, "ic_ratio": True}
LEAST_ROWS = 500
_SCHED = f"""ss AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i FROM market), nn AS (SELECT max(i) AS last FROM ss),
fz(horizon, fit, i) AS (SELECT h, 1, CAST(59 + h AS BIGINT) FROM nn, (VALUES {', '.join(f'({h})' for h in HORIZONS)}) t(h) WHERE 59 + h < last UNION ALL SELECT horizon, fit + 1, i + 21 FROM fz, nn WHERE i + 21 < last),
fits AS (SELECT horizon, fit, b.d AS last_train, c.d AS oos_start, e.d AS oos_end FROM fz JOIN ss b ON b.i = fz.i - horizon JOIN ss c ON c.i = fz.i + 1 JOIN nn ON TRUE JOIN ss e ON e.i = CASE WHEN fz.i + 21 <= last THEN fz.i + 20 ELSE last END)"""
_ALL_FITS = f"fits AS (SELECT h AS horizon, 1 AS fit, (SELECT max(d) FROM graded) AS last_train FROM (VALUES {', '.join(f'({h})' for h in HORIZONS)}) t(h))"
_TARGETS = {h: f"future_excess_return_{h}d" for h in HORIZONS}


def weights_sql(ratio: bool, out: str) -> str:
    """CTE `out` (horizon, fit, series, n_days, mean_ic, weight) from `ic` and `fits`."""
    value = "coalesce(m / nullif(s, 0), 0)" if ratio else "m"
    total, n = "sum(raw) OVER (PARTITION BY horizon, fit)", "sum(CAST(known AS INTEGER)) OVER (PARTITION BY horizon, fit)"
    return f"""{out}_s AS (SELECT fits.horizon, fit, series, count(*) AS n_days, avg(spearman_ic) AS m, stddev_samp(spearman_ic) AS s FROM fits JOIN ic ON ic.d <= last_train AND ic.horizon = fits.horizon WHERE spearman_ic IS NOT NULL GROUP BY 1, 2, 3),
{out}_r AS (SELECT *, n_days >= 20 AS known, CASE WHEN n_days >= 20 THEN greatest({value}, 0) ELSE 0 END AS raw FROM {out}_s),
{out} AS (SELECT horizon, fit, series, n_days, m AS mean_ic, CASE WHEN {total} > 0 THEN raw / {total} WHEN {n} > 0 THEN CASE WHEN known THEN 1.0::DOUBLE / {n} ELSE 0 END ELSE 1.0::DOUBLE / count(*) OVER (PARTITION BY horizon, fit) END AS weight FROM {out}_r)"""


_ICS = evaluation._ic("series, horizon, d", 5).replace("WITH ", "WITH RECURSIVE ", 1)


@query("walk_forward_weights", f"{_ICS}, {_SCHED}, {weights_sql(False, 'w')} SELECT horizon, fit, series, n_days, round(mean_ic, 6) AS mean_ic, round(weight, 6) AS weight FROM w")
def walk_forward_weights(spark, sf_dir):
    ics = reports.daily_ic(evaluation.graded(spark, sf_dir), NAMES, HORIZONS, 5)
    return rounded(walkforward.ic_weights(_fits(spark, sf_dir, None, HORIZONS), ics))


_CAN = {n: f"f_{n} <= last_train" for n in NAMES}
_ZERO = {n: f"CASE WHEN stddev_pop({n}) OVER w > 0 THEN stddev_pop({n}) OVER w ELSE 1 END" for n in NAMES}
_Z = ", ".join(f"coalesce(({n} - avg({n}) OVER w) / {_ZERO[n]}, 0) AS {n}" for n in NAMES)
_T = "CASE horizon " + " ".join(f"WHEN {h} THEN {t}" for h, t in _TARGETS.items()) + " END"
DESIGN_CTES = f"fd AS (SELECT {', '.join(f'min(d) FILTER ({n} IS NOT NULL) AS f_{n}' for n in NAMES)} FROM graded), cc AS (SELECT horizon, fit, d, entity, {', '.join(f'CASE WHEN {_CAN[n]} THEN {n} END AS {n}' for n in NAMES)}, {_T} AS t FROM graded JOIN fits ON d <= last_train CROSS JOIN fd WHERE {' AND '.join(f'({n} IS NOT NULL OR ({_CAN[n]}) IS NOT TRUE)' for n in NAMES)} AND {_T} IS NOT NULL QUALIFY count(*) OVER (PARTITION BY horizon, fit, d) >= 5), z AS (SELECT horizon, fit, d, entity, {_Z}, t - avg(t) OVER w AS y FROM cc WINDOW w AS (PARTITION BY horizon, fit, d))"
DESIGN = f"{evaluation.GRADED}, {_ALL_FITS}, {DESIGN_CTES}"
_PAIRS = [(i, j) for i in range(len(NAMES)) for j in range(i, len(NAMES))]


def solve_sql(moments: str, out: str, keys: str, alpha: float, floor: bool, rounds: int = 2000) -> str:
    """CTEs up to `out` (keys, w0...): weights by coordinate descent on the moments, which finds ridge's as well."""
    k, state = len(NAMES), []
    at = lambda i, j: f"m{min(i, j)}_{max(i, j)}"
    source = f"(SELECT s.*, {', '.join(f'm.{at(i, j)}' for i, j in _PAIRS)}, {', '.join(f'm.y{i}' for i in range(k))} FROM {out}_s s JOIN {moments} m USING ({keys}) WHERE step < {rounds})"
    for i in range(k):
        rest = " - ".join(f"{at(i, j)} * w{j}" for j in range(k) if j != i)
        new = f"(y{i} - {rest}) / nullif({at(i, i)} + {alpha}::DOUBLE, 0)"
        new = f"greatest(0.0::DOUBLE, coalesce({new}, 0))" if floor else f"coalesce({new}, 0)"
        source = f"(SELECT * REPLACE ({new} AS w{i}) FROM {source})"
        state.append(f"w{i}")
    return f"{out}_s({keys}, step, {', '.join(state)}) AS (SELECT {keys}, 0, {', '.join('0.0::DOUBLE' for _ in state)} FROM {moments} UNION ALL SELECT {keys}, step + 1, {', '.join(state)} FROM {source}), {out} AS (SELECT {keys}, {', '.join(state)} FROM {out}_s WHERE step = {rounds})"


_SUMS = ", ".join([f"coalesce(sum({NAMES[i]} * {NAMES[j]}), 0) AS m{i}_{j}" for i, j in _PAIRS] + [f"coalesce(sum({n} * y), 0) AS y{i}" for i, n in enumerate(NAMES)] + ["count(*) AS n_rows"])
_BY_FIT = f"mf AS (SELECT horizon, fit, {_SUMS} FROM z GROUP BY horizon, fit), mm AS (SELECT * FROM mf WHERE n_rows >= {LEAST_ROWS})"
_FIT = "WITH RECURSIVE " + DESIGN.removeprefix("WITH ") + f", {_BY_FIT}"
_LONG_W = " UNION ALL ".join(f"SELECT horizon, '{n}' AS series, round(coalesce(w{i}, 0), 6) + 0.0 AS weight, n_rows FROM mf LEFT JOIN solved USING (horizon, fit)" for i, n in enumerate(NAMES))


def _all_dates(spark, df):
    """One fit a horizon over all dates."""
    one = df.agg(F.min("d").alias("first_train"), F.max("d").alias("last_train")).withColumn("fit", F.lit(1))
    return one.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in HORIZONS])))


def _moments(spark, df, fits):
    """Sums of each fit's training rows, and the sets of components that fits can use."""
    dealt, sets = walkforward.designs(df, fits, list(NAMES))
    return written(walkforward.moments_by_fit(walkforward.daily_moments(df, list(NAMES), _TARGETS, sets), dealt), "moments"), sets


@query("standardised_design", f"{DESIGN} SELECT horizon, d, entity, {O.r6(*NAMES, 'y')} FROM z")
def standardised_design(spark, sf_dir):
    """The regressions' rows over all dates: every component as a z-score of its day, for each horizon's outcome."""
    df = written(evaluation.graded(spark, sf_dir), "graded")
    dealt, sets = walkforward.designs(df, _all_dates(spark, df), list(NAMES))
    wanted = {(r["horizon"], r["design"]) for r in dealt.select("horizon", "design").collect()}
    return rounded(walkforward.standardised(df, list(NAMES), _TARGETS, sets, wanted=wanted).drop("design"))


def _weights(spark, sf_dir, solve):
    df = written(evaluation.graded(spark, sf_dir), "graded")
    sums, sets = _moments(spark, df, _all_dates(spark, df))
    return rounded(walkforward.solved(spark, sums, list(NAMES), sets, solve, LEAST_ROWS).select("horizon", "series", "weight", "n_rows"))


@query("ridge_fit", f"{_FIT}, {solve_sql('mm', 'solved', 'horizon, fit', 50.0, False)} {_LONG_W}")
def ridge_fit(spark, sf_dir):
    return _weights(spark, sf_dir, walkforward.ridge)


@query("nnls_fit", f"{_FIT}, {solve_sql('mm', 'solved', 'horizon, fit', 0.0, True)} {_LONG_W}")
def nnls_fit(spark, sf_dir):
    return _weights(spark, sf_dir, walkforward.nonnegative)


def composite_sql(weights: str, out: str) -> str:
    """CTE `out` (horizon, fit, d, entity, score): each out-of-sample row scored by its own fit's weights."""
    long = " UNION ALL ".join(f"SELECT horizon, fit, g.d, entity, '{n}' AS series, {n} AS value FROM graded g JOIN fits ON g.d BETWEEN oos_start AND oos_end" for n in NAMES)
    return f"{out}_l AS ({long}), {out} AS (SELECT l.horizon, l.fit, d, entity, CASE WHEN NOT bool_or(series = 'trend_component' AND value IS NULL) THEN sum(weight * value) / nullif(sum(weight) FILTER (value IS NOT NULL), 0) END AS score FROM {out}_l l JOIN {weights} w USING (horizon, fit, series) WHERE weight > 0 GROUP BY 1, 2, 3, 4)"


def _by_date(spark, sf_dir, *more):
    """What fits and their scores read of the graded rows, stored by date. The scoring run has dealt dates last, so writing
    takes no exchange, nor does what works by date after that."""
    return dealt(evaluation.graded(spark, sf_dir).select("d", "entity", "stale", *NAMES, *_TARGETS.values(), *more), "graded", "d")


def _ahead(df, fits):
    return df.join(F.broadcast(fits.select("horizon", "fit", "oos_start", "oos_end")), F.col("d").between(F.col("oos_start"), F.col("oos_end")))


@query("walk_forward_composite", f"{_ICS}, {_SCHED}, {weights_sql(False, 'w')}, {composite_sql('w', 'co')} SELECT horizon, fit, d, entity, round(score, 6) AS score FROM co")
def walk_forward_composite(spark, sf_dir):
    """Out-of-sample scores of each horizon: each date scored by the fit that was made before it."""
    df, fits = _by_date(spark, sf_dir), _fits(spark, sf_dir, None, HORIZONS)
    weights = walkforward.ic_weights(fits, reports.daily_ic(df, NAMES, HORIZONS, 5))
    return rounded(walkforward.composite(_ahead(df, fits), weights, list(NAMES), ["trend_component"]))


_REG = lambda v: " UNION ALL ".join(f"SELECT horizon, fit, '{n}' AS series, w{i} AS weight, f_{n} <= last_train IS TRUE AS usable FROM {v} JOIN fits USING (horizon, fit) CROSS JOIN fd" for i, n in enumerate(NAMES))
_CLIP = lambda v: f"{v} AS (SELECT horizon, fit, series, CASE WHEN sum(greatest(weight, 0)) OVER p > 0 THEN greatest(weight, 0) / sum(greatest(weight, 0)) OVER p WHEN usable THEN 1.0::DOUBLE / sum(CAST(usable AS INTEGER)) OVER p ELSE 0 END AS weight FROM {v}0 WINDOW p AS (PARTITION BY horizon, fit))"
_VARIANTS = ("ic_mean", "ic_ratio", "ridge", "nnls")
_CONFIG = "CASE fits.horizon " + " ".join(f"WHEN {h} THEN score_{h}d" for h in HORIZONS) + " END"
_EXCESS = "CASE sc.horizon " + " ".join(f"WHEN {h} THEN g.{t}" for h, t in _TARGETS.items()) + " END"
_COMPARE = f"""{_ICS}, {_SCHED}, {DESIGN_CTES}, {_BY_FIT}, {weights_sql(False, 'ic_mean')}, {weights_sql(True, 'ic_ratio')}, {solve_sql('mm', 'rs', 'horizon, fit', 50.0, False)}, {solve_sql('mm', 'ns', 'horizon, fit', 0.0, True)}, ridge0 AS ({_REG('rs')}), {_CLIP('ridge')}, nnls0 AS ({_REG('ns')}), {_CLIP('nnls')},
{', '.join(composite_sql(v, f'co_{v}') for v in _VARIANTS)}, sc AS ({' UNION ALL '.join(f"SELECT horizon, '{v}' AS variant, d, entity, score FROM co_{v}" for v in _VARIANTS)} UNION ALL SELECT horizon, 'config', g.d, entity, {_CONFIG} FROM graded g JOIN fits ON g.d BETWEEN oos_start AND oos_end),
jn AS (SELECT sc.horizon, variant, sc.d, sc.entity, round(score, 9) AS score, {_EXCESS} AS excess FROM sc JOIN graded g ON g.d = sc.d AND g.entity = sc.entity WHERE score IS NOT NULL AND {_EXCESS} IS NOT NULL),
dy AS (SELECT * FROM jn QUALIFY count(*) OVER (PARTITION BY horizon, variant, d) >= 30), rk AS (SELECT *, {O.rank('score', 'horizon, variant, d', 'DESC')} AS pct, rank() OVER (PARTITION BY horizon, variant, d ORDER BY score DESC) AS place, min(score) OVER (PARTITION BY horizon, variant, d) AS lo, max(score) OVER (PARTITION BY horizon, variant, d) AS hi, rank() OVER (PARTITION BY horizon, variant, d ORDER BY score) + (count(*) OVER (PARTITION BY horizon, variant, d, score) - 1) / 2.0::DOUBLE AS ra, rank() OVER (PARTITION BY horizon, variant, d ORDER BY excess) + (count(*) OVER (PARTITION BY horizon, variant, d, excess) - 1) / 2.0::DOUBLE AS rb FROM dy),
da AS (SELECT horizon, variant, d, avg(excess) FILTER (lo < hi AND least(10, greatest(1, ceil(round(pct / 100 * 10, 9)))) = 1) - avg(excess) FILTER (lo < hi AND least(10, greatest(1, ceil(round(pct / 100 * 10, 9)))) = 10) AS spread, avg(excess) FILTER (lo < hi AND place <= 10) AS top10, CASE WHEN stddev_pop(ra) * stddev_pop(rb) > 1e-15 THEN covar_pop(ra, rb) / (stddev_pop(ra) * stddev_pop(rb)) END AS ic FROM rk GROUP BY 1, 2, 3)"""


@query("walk_forward_comparison", f"{_COMPARE} SELECT horizon, variant, count(*) AS n_days, round(avg(ic), 6) AS mean_daily_ic, round(CASE WHEN stddev_samp(ic) > 0 THEN avg(ic) / (stddev_samp(ic) / sqrt(greatest(1.0::DOUBLE, count(ic) / CAST(horizon AS DOUBLE)))) END, 6) AS ic_t_stat, round(avg(spread), 6) AS spread_avg, round(avg(top10), 6) AS top_10_avg_excess, count(*) >= 60 AS adequate FROM da GROUP BY horizon, variant")
def walk_forward_comparison(spark, sf_dir):
    """Weights by mean IC, by IC ratio, by ridge and by non-negative regression, and the configured score, for each
    horizon on the same out-of-sample dates, from one scoring run."""
    df, fits = _by_date(spark, sf_dir, *[f"score_{h}d" for h in HORIZONS]), _fits(spark, sf_dir, None, HORIZONS)
    ics = written(reports.daily_ic(df, NAMES, HORIZONS, 5), "ics")
    sums, sets = _moments(spark, df, fits)
    found = {v: walkforward.ic_weights(fits, ics, ratio) for v, ratio in SPEC.items()}
    found |= {v: walkforward.clipped(walkforward.solved(spark, sums, list(NAMES), sets, solve, LEAST_ROWS), LEAST_ROWS) for v, solve in (("ridge", walkforward.ridge), ("nnls", walkforward.nonnegative))}
    ahead = [tuple(r) for r in fits.select("horizon", "fit", "oos_start", "oos_end").collect()]
    weights = {v: walkforward.vectors(w, list(NAMES)) for v, w in found.items()}
    return rounded(reports.compared(reports.compared_days(df, NAMES, ahead, weights, ["trend_component"], _TARGETS)))


_FLAG = "ef AS (SELECT DISTINCT l_suppkey AS entity, CAST(date_trunc('week', l_shipdate) AS DATE) AS d FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber = 1)"


@query("event_day_spread", f"{evaluation.ONLY_OUT}, {_FLAG}, j AS (SELECT o.*, CASE WHEN ef.entity IS NULL THEN 0 ELSE 1 END AS flag FROM outcome o LEFT JOIN ef ON ef.entity = o.entity AND ef.d = o.d) SELECT d, count(*) FILTER (flag > 0) AS n_events, count(*) FILTER (flag = 0) AS n_controls, round(avg(future_excess_return_20d) FILTER (flag > 0) - avg(future_excess_return_20d) FILTER (flag = 0), 6) AS spread, round(avg(CASE WHEN future_excess_return_20d > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (flag > 0) * 100, 6) AS hit_pct FROM j WHERE future_excess_return_20d IS NOT NULL GROUP BY 1 HAVING count(*) FILTER (flag > 0) >= 3 AND count(*) FILTER (flag = 0) >= 5")
def event_day_spread(spark, sf_dir):
    flagged = read(spark, sf_dir, "lineitem").filter("l_returnflag = 'A' AND l_linenumber = 1").select(F.col("l_suppkey").cast("long").alias("entity"), F.to_date(F.date_trunc("week", "l_shipdate")).alias("d"), F.lit(1).alias("hit")).distinct()
    df = evaluation.outcomes(spark, sf_dir).join(flagged, ["entity", "d"], "left").withColumn("flag", F.coalesce("hit", F.lit(0)))
    return rounded(events.day_spread(df, "flag", "future_excess_return_20d", 3, 5))


@query("sector_breadth", f"WITH {O.FEATURES}, {O.WATCH} SELECT d, sector, CASE WHEN count(close_vs_SMA20_pct) >= 8 THEN round(avg(CASE WHEN close_vs_SMA20_pct > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) END AS breadth FROM own JOIN watch USING (entity) WHERE close_vs_SMA20_pct IS NOT NULL GROUP BY 1, 2")
def sector_breadth(spark, sf_dir):
    from sextant.operators import features

    f = features.trend(bars(spark, sf_dir)).join(watchlist(spark, sf_dir), "entity").filter("close_vs_SMA20_pct IS NOT NULL")
    return rounded(f.groupBy("d", "sector").agg(F.when(F.count(F.lit(1)) >= C.SECTOR_MIN_MEMBERS, F.avg((F.col("close_vs_SMA20_pct") > 0).cast("double"))).alias("breadth")))


_TIMING = f"{ALL}, mk AS (SELECT d, close / lag(close, 20) OVER (ORDER BY d) AS m, lead(close, 5) OVER (ORDER BY d) / close - 1 AS mf FROM market), sc AS (SELECT x.entity, x.d, x.session, x.close / lag(x.close, 20) OVER (PARTITION BY x.entity ORDER BY x.d) - m AS mom, lead(x.close, 5) OVER (PARTITION BY x.entity ORDER BY x.d) / x.close - 1 - mf AS fwd FROM dense x JOIN mk USING (d))"


def _timing(spark, sf_dir):
    """Regions' trailing and forward excess over the market."""
    from sextant.functions.windows import by_entity

    m = bars(spark, sf_dir, "all").select("d", F.try_divide(F.col("close"), F.lag("close", 20).over(by_entity())).alias("m"), forward.lead_return(5).alias("mf"))
    df = _dense(spark, sf_dir).join(F.broadcast(m), "d")
    return df.select("entity", "d", "session", (F.try_divide(F.col("close"), F.lag("close", 20).over(by_entity())) - F.col("m")).alias("mom"), (forward.lead_return(5) - F.col("mf")).alias("fwd"))


_R = "rank() OVER (PARTITION BY d ORDER BY {x}) + (count(*) OVER (PARTITION BY d, {x}) - 1) / 2.0::DOUBLE"


@query("sector_timing", f"WITH {_TIMING}, r AS (SELECT d, {_R.format(x='mom')} AS a, {_R.format(x='fwd')} AS b FROM sc WHERE mom IS NOT NULL AND fwd IS NOT NULL) SELECT d, count(*) AS n, round(CASE WHEN stddev_pop(a) * stddev_pop(b) > 1e-15 THEN covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) END, 6) AS spearman_ic FROM r GROUP BY 1 HAVING count(*) >= 4")
def sector_timing(spark, sf_dir):
    return rounded(stats.spearman(_timing(spark, sf_dir), "mom", "fwd", "d", least=4).select("d", "n", "spearman_ic"))


@query("non_overlapping_holds", f"WITH RECURSIVE {_TIMING}, ok AS (SELECT session, any_value(d) AS d FROM sc WHERE mom IS NOT NULL AND fwd IS NOT NULL GROUP BY 1 HAVING count(*) >= 4), pk(pos) AS (SELECT min(session) FROM ok UNION ALL SELECT (SELECT min(session) FROM ok WHERE session >= pk.pos + 5) FROM pk WHERE (SELECT min(session) FROM ok WHERE session >= pk.pos + 5) IS NOT NULL), rk AS (SELECT sc.*, row_number() OVER (PARTITION BY session ORDER BY mom DESC, entity) AS a, row_number() OVER (PARTITION BY session ORDER BY mom, entity DESC) AS b FROM sc WHERE mom IS NOT NULL AND fwd IS NOT NULL) SELECT d, round(avg(fwd) FILTER (a <= 2), 6) AS top, round(avg(fwd) FILTER (b <= 2), 6) AS bottom FROM rk JOIN pk ON rk.session = pk.pos GROUP BY 1")
def non_overlapping_holds(spark, sf_dir):
    """Windows that don't overlap: the mean of the best and of the worst sectors in each."""
    return rounded(_holds(spark, sf_dir))


def _holds(spark, sf_dir):
    """(d, top, bottom): a greedy scan of the sessions with enough sectors picks the windows."""
    full = _timing(spark, sf_dir).filter("mom IS NOT NULL AND fwd IS NOT NULL")
    days = full.groupBy("session").agg(F.count(F.lit(1)).alias("n")).filter("n >= 4").agg(F.array_sort(F.collect_list(F.col("session").cast("long"))).alias("at"))
    start = F.struct(F.array().cast("array<bigint>").alias("kept"), F.lit(-(10**9)).cast("long").alias("last"))
    step = lambda a, i: F.when(i - a["last"] >= 5, F.struct(F.concat(a["kept"], F.array(i)).alias("kept"), i.alias("last"))).otherwise(a)
    picked = days.select(F.explode(F.aggregate("at", start, step)["kept"]).alias("session"))
    by = Window.partitionBy("session")
    ranked = full.join(F.broadcast(picked), "session").withColumns({"a": F.row_number().over(by.orderBy(F.desc("mom"), "entity")), "b": F.row_number().over(by.orderBy("mom", F.desc("entity")))})
    return ranked.groupBy("d").agg(F.avg(F.when(F.col("a") <= 2, F.col("fwd"))).alias("top"), F.avg(F.when(F.col("b") <= 2, F.col("fwd"))).alias("bottom"))


_BACK, _AHEAD = (5, 20, 60), (5, 20)
_GRID = f"""{ALL}, mk AS (SELECT d, {', '.join(f'close / lag(close, {b}) OVER (ORDER BY d) AS m{b}' for b in _BACK)}, {', '.join(f'lead(close, {h}) OVER (ORDER BY d) / close - 1 AS f{h}' for h in _AHEAD)} FROM market),
gw AS (SELECT x.entity, x.d, x.session, {', '.join(f'x.close / lag(x.close, {b}) OVER w - m{b} AS p{b}' for b in _BACK)}, {', '.join(f'lead(x.close, {h}) OVER w / x.close - 1 - f{h} AS e{h}' for h in _AHEAD)} FROM dense x JOIN mk USING (d) WINDOW w AS (PARTITION BY x.entity ORDER BY x.d)),
gl AS (SELECT entity, d, session, p.predictor AS predictor, p.value AS value, h.horizon AS horizon, h.excess AS excess FROM (SELECT *, unnest([{', '.join(f"{{'horizon': {h}, 'excess': e{h}}}" for h in _AHEAD)}]) AS h FROM (SELECT *, unnest([{', '.join(f"{{'predictor': 'momentum_{b}', 'value': p{b}}}" for b in _BACK)}]) AS p FROM gw)))"""


def _grid(spark, sf_dir):
    """(entity, d, session, predictor, value, horizon, excess): regions' momentum over the market by lookback, and what followed."""
    from sextant.functions.windows import by_entity

    m = bars(spark, sf_dir, "all").select("d", *[F.try_divide(F.col("close"), F.lag("close", b).over(by_entity())).alias(f"m{b}") for b in _BACK], *[forward.lead_return(h).alias(f"f{h}") for h in _AHEAD])
    df = _dense(spark, sf_dir).join(F.broadcast(m), "d")
    back = [F.struct(F.lit(f"momentum_{b}").alias("predictor"), (F.try_divide(F.col("close"), F.lag("close", b).over(by_entity())) - F.col(f"m{b}")).alias("value")) for b in _BACK]
    ahead = [F.struct(F.lit(h).alias("horizon"), (forward.lead_return(h) - F.col(f"f{h}")).alias("excess")) for h in _AHEAD]
    wide = df.select("entity", "d", "session", *[b.alias(f"_p{i}") for i, b in enumerate(back)], *[a.alias(f"_a{i}") for i, a in enumerate(ahead)])
    each = wide.select("entity", "d", "session", F.explode(F.array(*[f"_p{i}" for i in range(len(back))])).alias("p"), *[f"_a{i}" for i in range(len(ahead))])
    return each.select("entity", "d", "session", "p.*", F.explode(F.array(*[f"_a{i}" for i in range(len(ahead))])).alias("h")).select("entity", "d", "session", "predictor", "value", "h.*")


_GT = lambda m, s, n: f"CASE WHEN {s} > 0 THEN {m} / ({s} / sqrt(greatest(1.0::DOUBLE, {n} / CAST(horizon AS DOUBLE)))) END"


@query("sector_timing_grid", f"""WITH {_GRID}, {evaluation.ic_sql('predictor, horizon, d', 4, 'gl', 'gi')}, gj AS (SELECT gi.*, session < (SELECT (max(session) + 1) // 2 FROM ss) AS early FROM gi JOIN ss USING (d) WHERE spearman_ic IS NOT NULL),
ga AS (SELECT predictor, horizon, count(*) AS n_days, avg(spearman_ic) AS m, stddev_samp(spearman_ic) AS s, avg(spearman_ic) FILTER (early) AS m1, avg(spearman_ic) FILTER (NOT early) AS m2 FROM gj GROUP BY 1, 2), gt AS (SELECT *, {_GT('m', 's', 'n_days')} AS t, n_days // horizon AS eff FROM ga), gp AS (SELECT *, CASE WHEN eff >= 5 THEN {tail_sql('t', '(eff - 1)')} END AS p FROM gt),
gk AS (SELECT *, count(p) OVER () AS fam, CASE WHEN p IS NOT NULL THEN row_number() OVER (ORDER BY p NULLS LAST) END AS rk FROM gp), gc AS (SELECT *, max(CASE WHEN p <= rk / CAST(fam AS DOUBLE) * 0.1::DOUBLE THEN rk END) OVER () AS cut FROM gk) SELECT predictor, horizon, n_days, round(m, 6) AS mean_ic, round(t, 6) AS t_stat, round(m1, 6) AS first_half_ic, round(m2, 6) AS second_half_ic, sign(m1) = sign(m2) AND sign(m1) <> 0 AS sign_held, round(p, 6) AS p_value, fam AS family_size, coalesce(rk <= cut, FALSE) AS bh_pass FROM gc""")
def sector_timing_grid(spark, sf_dir):
    """Momentum by lookback and horizon: ICs over the sectors of a day, both halves of the history, corrected as one family."""
    g = _grid(spark, sf_dir)
    ics = stats.spearman(g, "value", "excess", "predictor", "horizon", "d", least=4).filter("spearman_ic IS NOT NULL")
    sessions = forward.calendar(bars(spark, sf_dir, "all"))
    half = sessions.agg(F.floor((F.max("session") + 1) / 2).alias("half"))
    placed = ics.join(F.broadcast(sessions), "d").join(F.broadcast(half), F.lit(True)).withColumn("early", F.col("session") < F.col("half"))
    out = placed.groupBy("predictor", "horizon").agg(F.count(F.lit(1)).alias("n_days"), F.avg("spearman_ic").alias("mean_ic"), F.stddev_samp("spearman_ic").alias("_s"), F.avg(F.when(F.col("early"), F.col("spearman_ic"))).alias("first_half_ic"), F.avg(F.when(~F.col("early"), F.col("spearman_ic"))).alias("second_half_ic"))
    out = out.withColumns({"t_stat": stats.overlap_t(F.col("mean_ic"), F.col("_s"), F.col("n_days"), F.col("horizon")), "_eff": F.floor(F.col("n_days") / F.col("horizon"))})
    out = out.withColumn("p_value", stats.t_tail(F.when(F.col("_eff") >= C.PATTERN_MIN_EFFECTIVE, F.col("t_stat")), (F.col("_eff") - 1).cast("double")))
    out = out.withColumn("family_size", F.count("p_value").over(Window.partitionBy(F.lit(0))))
    held = (F.signum("first_half_ic") == F.signum("second_half_ic")) & (F.signum("first_half_ic") != 0)
    return rounded(stats.discoveries(out, "p_value", C.FDR_Q).withColumn("sign_held", held).select("predictor", "horizon", "n_days", "mean_ic", "t_stat", "first_half_ic", "second_half_ic", "sign_held", "p_value", "family_size", "bh_pass"))


@query("holds_summary", ORACLES["non_overlapping_holds"].replace("SELECT d, round(avg(fwd) FILTER (a <= 2), 6) AS top, round(avg(fwd) FILTER (b <= 2), 6) AS bottom FROM rk JOIN pk ON rk.session = pk.pos GROUP BY 1", ", hd AS (SELECT avg(fwd) FILTER (a <= 2) - avg(fwd) FILTER (b <= 2) AS x FROM rk JOIN pk ON rk.session = pk.pos GROUP BY rk.session) SELECT count(*) AS n_windows, round(avg(x), 6) AS mean, round(median(x), 6) AS median, round(avg(CASE WHEN x > 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS pct_positive, round(CASE WHEN count(*) > 2 AND stddev_samp(x) > 0 THEN avg(x) / (stddev_samp(x) / sqrt(count(*))) END, 6) AS t_stat FROM hd").replace(" , hd AS", ", hd AS"))
def holds_summary(spark, sf_dir):
    """The windows that don't overlap in one row: how many, best less worst on average and at the median, and its t."""
    x = _holds(spark, sf_dir).select((F.col("top") - F.col("bottom")).alias("x"))
    t = F.when((F.count(F.lit(1)) > 2) & (F.stddev_samp("x") > 0), F.avg("x") / (F.stddev_samp("x") / F.sqrt(F.count(F.lit(1)).cast("double"))))
    return rounded(x.agg(F.count(F.lit(1)).alias("n_windows"), F.avg("x").alias("mean"), F.median("x").alias("median"), (F.avg((F.col("x") > 0).cast("double")) * 100).alias("pct_positive"), t.alias("t_stat")))


@query("regime_conditions", f"WITH {O.MARKET}, x AS (SELECT d, close, close - lag(close, 20) OVER (ORDER BY d) AS slope, list(close) OVER (ORDER BY d) AS past FROM market), p AS (SELECT d, slope, CASE WHEN len(past) >= {C.MACRO_MIN_HISTORY} THEN len(list_filter(past, lambda v: v < close)) / CAST(len(past) AS DOUBLE) * 100 END AS pct FROM x) SELECT d, coalesce(pct >= 66.7::DOUBLE, FALSE) AS high, coalesce(pct <= 33.3::DOUBLE, FALSE) AS low, coalesce(slope < 0, FALSE) AS inverted FROM p")
def regime_conditions(spark, sf_dir):
    """Terciles of the history so far, and a regime that is a level and no rank: a slope below zero."""
    slope = F.col("close") - F.lag("close", 20).over(by_entity())
    p = expanding.share_below_so_far(bars(spark, sf_dir, "all").select("entity", "d", "close", slope.alias("slope")), "close", C.MACRO_MIN_HISTORY, "pct")
    return p.select("d", F.coalesce(F.col("pct") >= 66.7, F.lit(False)).alias("high"), F.coalesce(F.col("pct") <= 33.3, F.lit(False)).alias("low"), F.coalesce(F.col("slope") < 0, F.lit(False)).alias("inverted"))


@query("stream_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    return rounded(streams.tumbling(read(spark, sf_dir, "events")))


@query("stream_sliding", "SELECT start, count(*) AS n FROM (SELECT time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE * i AS start FROM events, range(0, 2) r(i)) GROUP BY 1")
def stream_sliding(spark, sf_dir):
    return streams.sliding(read(spark, sf_dir, "events"))


@query("stream_sessions", "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM s GROUP BY user_id, k")
def stream_sessions(spark, sf_dir):
    return streams.sessions(read(spark, sf_dir, "events"))
