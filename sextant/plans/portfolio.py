"""Queries of portfolio simulations: the sweep over names and holding times, costs, cash, benchmark, long against short."""

from __future__ import annotations

from pyspark.sql import functions as F

from sextant import config as C
from sextant.functions import scalar
from sextant.functions.scalar import rounded
from sextant.operators import backtest, forward
from sextant.plans import core
from sextant.plans import oracle as O
from sextant.sources.bars import bars, watchlist
from sextant.sources.store import written

QUERIES, ORACLES = {}, {}
SCORE = C.BACKTEST_SCORE
LONG = [(f"n{n}_h{h}", n, h, False) for h in C.BACKTEST_HOLDS for n in C.BACKTEST_NAMES]
SHORT = [(f"short_n{n}_h{h}", n, h, True) for h in C.BACKTEST_HOLDS for n in C.BACKTEST_NAMES]


def query(name: str, sql: str | None = None):
    """Registers a query, and the SQL that gives its rows."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_SS = "ss AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS session FROM market)"


def _bps(trade: str, adv: str) -> str:
    return f"(CASE WHEN {adv} > 0 THEN greatest(1.0::DOUBLE, least(80.0::DOUBLE, 1 + 12 / sqrt({adv} / 1000000))) ELSE 80 END / 2 + CASE WHEN {adv} > 0 AND {trade} > 0 THEN 10 * sqrt(least({trade} / {adv}, 0.1::DOUBLE)) ELSE 80 END)"


def picks_sql(configs) -> str:
    """CTEs with the periods (fl), the legs of each period (lg) and their numbers (nm), before any capital."""
    rows = ", ".join(f"('{c}', {n}, {h}, {'TRUE' if w else 'FALSE'})" for c, n, h, w in configs)
    return f"""{O.SCORES}, {O.MARKET}, {_SS}, cfg AS (SELECT * FROM (VALUES {rows}) t(config, n, hold, worst)), dd AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS turn FROM (SELECT DISTINCT d FROM scored)),
adv_ AS (SELECT entity, d, nullif(avg(close * volume) {O.rows(20)}, 0) AS adv FROM bars), px AS (SELECT b.entity, session, coalesce(open, close) AS open, close, adv FROM bars b JOIN adv_ USING (entity, d) JOIN ss USING (d)),
pk AS (SELECT config, session + 1 AS fill, entity FROM (SELECT config, cfg.n, d, s.entity, row_number() OVER (PARTITION BY config, d ORDER BY CASE WHEN worst THEN {SCORE} ELSE -{SCORE} END, s.entity) AS k FROM scored s JOIN dd USING (d) JOIN adv_ USING (entity, d), cfg WHERE {SCORE} IS NOT NULL AND adv >= {C.BACKTEST_MIN_ADV} AND turn % hold = 0) JOIN ss USING (d) WHERE k <= n),
en AS (SELECT max(session) AS e FROM ss), fl AS (SELECT config, fill, e, row_number() OVER w AS period, lead(fill) OVER w AS until FROM (SELECT DISTINCT config, fill FROM pk), en WHERE fill <= e WINDOW w AS (PARTITION BY config ORDER BY fill)),
lg0 AS (SELECT fl.*, p.entity, b.open AS bought, b.adv FROM fl JOIN pk p USING (config, fill) JOIN px b ON b.entity = p.entity AND b.session = fl.fill),
lg AS MATERIALIZED (SELECT l.*, CASE WHEN until IS NOT NULL THEN coalesce(x.open, y.close) END AS sold_px, x.adv AS adv_then, until IS NOT NULL AND x.open IS NULL AS gone FROM (SELECT * FROM lg0 l ASOF LEFT JOIN (SELECT entity AS ye, session AS ys, close FROM px) y ON l.entity = ye AND coalesce(l.until, l.e) >= ys) l LEFT JOIN px x ON x.entity = l.entity AND x.session = l.until CROSS JOIN LATERAL (SELECT l.close) y(close)),
nm AS MATERIALIZED (SELECT config, period, count(*) AS names FROM lg GROUP BY 1, 2)"""


def curve_sql(charge: bool, p: str = "") -> str:
    """CTEs `{p}curve` (config, d, equity), `{p}flow` and `{p}leg`, from those of picks_sql; needs WITH RECURSIVE."""
    fee = lambda trade, adv: f"{trade} * {_bps(trade, adv)} / 10000" if charge else "0.0::DOUBLE"
    start = C.INITIAL_EQUITY
    each = "(c.start / names)"
    got = f"(({each} - {fee(each, 'adv')}) / bought * sold_px)"
    return f"""{p}cap(config, period, start) AS (SELECT DISTINCT config, CAST(1 AS BIGINT), {start}::DOUBLE FROM fl UNION ALL
  SELECT c.config, c.period + 1, coalesce((SELECT sum({got} - {fee(got, 'adv_then')}) FROM lg JOIN nm USING (config, period) WHERE lg.config = c.config AND lg.period = c.period), c.start) FROM {p}cap c JOIN fl f ON f.config = c.config AND f.period = c.period WHERE f.until IS NOT NULL),
{p}leg AS (SELECT lg.*, c.start, {each} AS each, ({each} - {fee(each, 'adv')}) / bought AS shares, {fee(each, 'adv')} AS paid FROM lg JOIN nm USING (config, period) JOIN {p}cap c USING (config, period)),
{p}flow AS (SELECT f.config, f.period, f.fill, f.until, f.e, c.start, coalesce(sum(paid), 0) AS paid, coalesce(sum(shares * sold_px), 0) AS sold, coalesce(sum({fee('(shares * sold_px)', 'adv_then')}), 0) AS fees, count(l.entity) AS names FROM fl f JOIN {p}cap c USING (config, period) LEFT JOIN {p}leg l ON l.config = f.config AND l.period = f.period GROUP BY ALL),
{p}mark AS (SELECT l.config, s.session, sum(shares * y.close) AS marked FROM (SELECT l.config, l.entity, l.shares, s.session FROM {p}leg l JOIN ss s ON s.session BETWEEN l.fill AND coalesce(l.until - 1, l.e)) s ASOF JOIN px y ON s.entity = y.entity AND s.session >= y.session, LATERAL (SELECT s.config) l(config) GROUP BY 1, 2),
{p}idle AS (SELECT config, session, start AS idle FROM {p}flow f JOIN ss ON session BETWEEN fill AND coalesce(until - 1, e) WHERE names = 0),
{p}curve AS (SELECT g.config, g.d, g.session, coalesce(marked, idle, {start}::DOUBLE) AS equity FROM (SELECT * FROM (SELECT DISTINCT config FROM fl), ss) g LEFT JOIN {p}mark m ON m.config = g.config AND m.session = g.session LEFT JOIN {p}idle i ON i.config = g.config AND i.session = g.session)"""


def metrics_sql(source: str, out: str, key: str = "config") -> str:
    return f"""{out}_r AS (SELECT {key} AS config, d, equity, equity / nullif(lag(equity) OVER w, 0) - 1 AS ret, max(equity) OVER w AS peak FROM {source} WINDOW w AS (PARTITION BY {key} ORDER BY d)),
{out}_a AS (SELECT config, count(*) AS n, first(equity ORDER BY d) AS a, last(equity ORDER BY d) AS b, avg(ret) AS m, stddev_samp(ret) AS s, min(equity / peak - 1) * 100 AS dd FROM {out}_r GROUP BY 1),
{out} AS (SELECT config, n AS n_sessions, b / a - 1 AS total_return, pow(b / a, 252.0::DOUBLE / n) - 1 AS cagr, CASE WHEN s > 1e-12::DOUBLE THEN m / s * sqrt(252.0::DOUBLE) END AS sharpe, s * sqrt(252.0::DOUBLE) AS volatility_annual, dd AS max_drawdown_pct FROM {out}_a)"""


_M = ("total_return", "cagr", "sharpe", "volatility_annual", "max_drawdown_pct")


def _run(spark, sf_dir, configs):
    """(picks, bars, sessions), each written once: a simulation reads them in several branches."""
    b, market = written(bars(spark, sf_dir), "bars"), bars(spark, sf_dir, "all")
    sessions = written(forward.calendar(market).withColumn("session", F.col("session").cast("int")), "sessions")
    scores = written(core.scored(spark, sf_dir, b).select("entity", "d", SCORE), "scores")
    picks = backtest.targets(scores, sessions, SCORE, configs, b, C.BACKTEST_MIN_ADV, watchlist(spark, sf_dir).select(F.col("benchmark").alias("entity")))
    return written(picks, "picks"), b, sessions


_DIAG = """odd AS (SELECT config, count(*) FILTER (abs(close / before - 1) * 100 > 50) AS n_suspicious FROM (SELECT h.config, y.close, lag(y.close) OVER (PARTITION BY h.config, h.entity ORDER BY h.session) AS before FROM (SELECT l.config, l.entity, s.session FROM leg l JOIN ss s ON s.session BETWEEN l.fill AND coalesce(l.until - 1, l.e)) h JOIN px y ON y.entity = h.entity AND y.session = h.session) GROUP BY 1),
gone_ AS (SELECT config, count(*) FILTER (gone) AS n_liquidated FROM leg GROUP BY 1), mean_ AS (SELECT config, avg(equity) AS mean, count(*) AS n FROM curve GROUP BY 1),
money AS (SELECT config, count(*) AS n_rebalances, sum(CASE WHEN names > 0 THEN start + CASE WHEN until IS NOT NULL THEN sold ELSE 0 END ELSE 0 END) AS traded, sum(paid + CASE WHEN until IS NOT NULL THEN fees ELSE 0 END) AS total_cost FROM flow GROUP BY 1)"""


@query("portfolio_backtest", f"WITH RECURSIVE {picks_sql(LONG)}, {curve_sql(True)}, {metrics_sql('curve', 'mt')}, {_DIAG} SELECT config, n_sessions, {O.r6(*_M)}, n_rebalances, round(traded / mean / (n / 252.0::DOUBLE), 6) AS turnover_annual, round(total_cost, 2) AS total_cost, round(total_cost / mean * 100, 6) AS cost_drag_pct, coalesce(n_liquidated, 0) AS n_liquidated, coalesce(n_suspicious, 0) AS n_suspicious FROM mt JOIN money USING (config) JOIN mean_ USING (config) LEFT JOIN odd USING (config) LEFT JOIN gone_ USING (config)")
def portfolio_backtest(spark, sf_dir):
    """Every long config with costs: its curve's figures, and what it traded, paid, sold blindly and should not believe."""
    picks, b, sessions = _run(spark, sf_dir, LONG)
    curve, summary = backtest.simulate(picks, b, sessions)
    out = backtest.metrics(curve, "config").join(summary, "config")
    return rounded(out.withColumn("total_cost", F.round("total_cost", 2)))


@query("portfolio_curves", f"WITH RECURSIVE {picks_sql(LONG)}, {curve_sql(True)} SELECT config, d, round(equity, 2) AS equity FROM curve")
def portfolio_curves(spark, sf_dir):
    picks, b, sessions = _run(spark, sf_dir, LONG)
    return backtest.simulate(picks, b, sessions)[0].select("config", "d", F.round("equity", 2).alias("equity"))


@query("backtest_invested", f"WITH RECURSIVE {picks_sql(LONG)}, {curve_sql(True)}, at_ AS (SELECT *, row_number() OVER w - 1 AS pos, abs(equity - lag(equity) OVER w) > 1e-9 AS moved FROM curve WINDOW w AS (PARTITION BY config ORDER BY d)), iv AS (SELECT *, min(pos) FILTER (WHERE moved) OVER (PARTITION BY config) AS first FROM at_), inv AS (SELECT * FROM iv WHERE pos >= first), {metrics_sql('inv', 'mt')}, c AS (SELECT config, min(first) AS n_in_cash FROM inv GROUP BY 1), bh AS (SELECT inv.config, inv.d, 100000.0::DOUBLE * m.close / (SELECT first(close ORDER BY d) FROM market) AS equity FROM inv JOIN market m USING (d)), {metrics_sql('bh', 'bm')} SELECT mt.config, mt.n_sessions, n_in_cash, {', '.join(f'round(mt.{x}, 6) AS {x}' for x in _M)}, round(bm.sharpe, 6) AS benchmark_sharpe, round(bm.max_drawdown_pct, 6) AS benchmark_max_drawdown_pct FROM mt JOIN c USING (config) JOIN bm USING (config)")
def backtest_invested(spark, sf_dir):
    """Figures of the time in which a config held something, beside those of the market bought and held over that time."""
    picks, b, sessions = _run(spark, sf_dir, LONG)
    held = written(backtest.invested(backtest.simulate(picks, b, sessions)[0], "config"), "invested")
    market = bars(spark, sf_dir, "all")
    benchmark = held.select("config", "d").join(F.broadcast(backtest.buy_and_hold(market, market)), "d")
    bm = backtest.metrics(benchmark, "config").select("config", F.col("sharpe").alias("benchmark_sharpe"), F.col("max_drawdown_pct").alias("benchmark_max_drawdown_pct"))
    return rounded(backtest.metrics(held, "config").join(held.groupBy("config").agg(F.min("n_in_cash").cast("long").alias("n_in_cash")), "config").join(bm, "config"))


_PAIRS = ", ".join(f"('{a[0]}', '{b[0]}')" for a, b in zip(LONG, SHORT, strict=True))
_LS = f"pr AS (SELECT * FROM (VALUES {_PAIRS}) t(long, short)), rr AS (SELECT config, d, equity / nullif(lag(equity) OVER (PARTITION BY config ORDER BY d), 0) - 1 AS r FROM curve), lg2 AS (SELECT long AS config, a.d, 1 + coalesce(a.r * 0.5::DOUBLE - b.r * 0.5::DOUBLE, 0) AS g FROM pr JOIN rr a ON a.config = long JOIN rr b ON b.config = short AND b.d = a.d), ls AS (SELECT config, d, CASE WHEN min(g) OVER w > 0 THEN 100000.0::DOUBLE * exp(sum(ln(CASE WHEN g > 0 THEN g END)) OVER w) ELSE 0 END AS equity FROM lg2 WINDOW w AS (PARTITION BY config ORDER BY d))"


@query("long_short", f"WITH RECURSIVE {picks_sql(LONG + SHORT)}, {curve_sql(True)}, {_LS} SELECT config AS pair, d, round(equity, 2) AS equity FROM ls")
def long_short(spark, sf_dir):
    """Half long the best and half short the worst, compounded day by day."""
    picks, b, sessions = _run(spark, sf_dir, LONG + SHORT)
    pairs = spark.createDataFrame([(a[0], a[0], s[0]) for a, s in zip(LONG, SHORT, strict=True)], "pair string, long string, short string")
    return backtest.long_short(backtest.simulate(picks, b, sessions)[0], pairs).select("pair", "d", F.round("equity", 2).alias("equity"))


@query("portfolio_sweep", f"WITH RECURSIVE {picks_sql(LONG + SHORT)}, {curve_sql(True)}, {curve_sql(False, 'free_')}, {_LS}, {metrics_sql('curve', 'm1')}, {metrics_sql('free_curve', 'm2')}, {metrics_sql('ls', 'm3')} SELECT strategy, config, n_sessions, {O.r6(*_M)} FROM (SELECT 'long' AS strategy, * FROM m1 WHERE config IN (SELECT long FROM pr) UNION ALL SELECT 'long_free', * FROM m2 WHERE config IN (SELECT long FROM pr) UNION ALL SELECT 'long_short', * FROM m3)")
def portfolio_sweep(spark, sf_dir):
    """All configs long with costs, long without, and long against short: from one scoring run and one set of picks."""
    picks, b, sessions = _run(spark, sf_dir, LONG + SHORT)
    curve = backtest.simulate(picks, b, sessions)[0]
    free = backtest.simulate(picks.filter(~F.col("config").startswith("short")), b, sessions, False)[0]
    pairs = spark.createDataFrame([(a[0], a[0], s[0]) for a, s in zip(LONG, SHORT, strict=True)], "pair string, long string, short string")
    both = backtest.long_short(curve, pairs).withColumnRenamed("pair", "config")
    parts = (("long", curve.filter(~F.col("config").startswith("short"))), ("long_free", free), ("long_short", both))
    out = None
    for name, part in parts:
        found = backtest.metrics(part, "config").withColumn("strategy", F.lit(name))
        out = found if out is None else out.unionByName(found)
    return rounded(out)


@query("cost_model", f"WITH {O.BARS}, a AS (SELECT entity, d, nullif(avg(close * volume) {O.rows(20)}, 0) AS adv FROM bars) SELECT entity, d, round({_bps('10000', 'adv')}, 6) AS bps FROM a")
def cost_model(spark, sf_dir):
    from sextant.operators.features import dollar_adv

    b = bars(spark, sf_dir).select("entity", "d", dollar_adv().alias("adv"))
    return rounded(b.select("entity", "d", scalar.one_way_bps(F.lit(10000.0), F.col("adv")).alias("bps")))


@query("rebalance_schedule", f"WITH {O.MARKET}, s AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS session FROM market) SELECT d, session FROM s WHERE session % 20 = 0")
def rebalance_schedule(spark, sf_dir):
    return backtest.every_kth(forward.calendar(bars(spark, sf_dir, "all")), 20).select("d", F.col("session").cast("long").alias("session"))


@query("equity_metrics", f"WITH {O.REGION}, c AS (SELECT entity AS config, d, close AS equity FROM region_bars), {metrics_sql('c', 'mt')} SELECT config AS entity, n_sessions, {O.r6(*_M)} FROM mt")
def equity_metrics(spark, sf_dir):
    return rounded(backtest.metrics(bars(spark, sf_dir, "region").select("entity", "d", F.col("close").alias("equity")), "entity"))
