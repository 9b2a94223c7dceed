"""Queries of pattern families: specifications, their tests with corrections, and the family-wise null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant import config as C
from sextant.functions.scalar import rounded
from sextant.functions.windows import by_entity
from sextant.operators import expanding, forward, patterns
from sextant.plans import oracle as O
from sextant.plans.research import tail_sql
from sextant.sources.bars import read
from sextant.sources.store import written

QUERIES, ORACLES = {}, {}
INDEX = 0
HORIZONS = (1, 5, 10, 20)
WEEKDAYS, MONTHS = range(5), range(1, 13)


def query(name: str, sql: str | None = None):
    """Registers a query, and the SQL that gives its rows."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def daily(spark, sf_dir) -> DataFrame:
    """(entity, d, open, close): daily prices of the regions' orders (entity 1 to 5), and of all of them (0), on weekdays."""
    o, c, n = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select((F.col("n_regionkey") + 1).cast("long").alias("region"), F.to_date("o_orderdate").alias("d"), "o_orderkey", F.col("o_totalprice").alias("p")).filter(F.weekday("d") < 5)
    both = rows.select(F.explode(F.array(F.lit(INDEX).cast("long"), F.col("region"))).alias("entity"), "d", "o_orderkey", "p")
    return both.groupBy("entity", "d").agg(F.min_by("p", "o_orderkey").alias("open"), F.avg("p").alias("close"))


def panel(spark, sf_dir) -> DataFrame:
    """The daily prices on every session of the index: (entity, d, session, open, close)."""
    b = written(daily(spark, sf_dir), "daily")
    sessions = forward.calendar(b.filter(F.col("entity") == INDEX)).withColumn("session", F.col("session").cast("int"))
    return written(patterns.densified(b, sessions), "panel")


PANEL = f"""dr AS (SELECT CAST(n_regionkey + 1 AS BIGINT) AS region, CAST(o_orderdate AS DATE) AS d, o_orderkey, o_totalprice AS p FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE isodow(o_orderdate) <= 5),
db AS (SELECT entity, d, min_by(p, o_orderkey) AS open, avg(p) AS close FROM (SELECT region AS entity, d, o_orderkey, p FROM dr UNION ALL SELECT {INDEX}, d, o_orderkey, p FROM dr) GROUP BY 1, 2),
ss AS (SELECT d, CAST(row_number() OVER (ORDER BY d) - 1 AS INTEGER) AS session FROM db WHERE entity = {INDEX}), dense AS (SELECT e.entity, ss.d, ss.session, db.open, db.close FROM (SELECT DISTINCT entity FROM db) e CROSS JOIN ss LEFT JOIN db ON db.entity = e.entity AND db.d = ss.d)"""
_W = "OVER (PARTITION BY entity ORDER BY d)"


def _streak_sql(n: int, sign: str) -> str:
    return f"coalesce(min(CASE WHEN up IS NULL THEN NULL WHEN up {sign} 0 THEN 1 ELSE 0 END) {O.rows(n)} = 1 AND count(up) {O.rows(n)} = {n}, FALSE)"


#: Conditions of an entity's past by name: (Spark, SQL over `cx`, which adds what they need to `dense`).
def _conditions(df: DataFrame) -> DataFrame:
    """(condition, on, session, hit) of all conditions; those of the calendar stand under the index."""
    out = df
    for n in (2, 3, 4, 5):
        for up in (True, False):
            out = patterns.streaks(out, n, up).withColumnRenamed("streak", f"{'up' if up else 'down'}_{n}")
    out = out.withColumns({f"above_{w}": patterns.above_sma(w) for w in (50, 200)})
    out = out.withColumns({f"below_{w}": patterns.not_of(F.col(f"above_{w}")) for w in (50, 200)})
    out = out.withColumn("r5", F.round(F.try_divide(F.col("close"), F.lag("close", 5).over(by_entity())) - 1, 9))
    out = expanding.extreme_so_far(out, "r5", 0.10, C.PATTERN_LEAST_HISTORY, "own_high")
    peers = patterns.peer_rank(df.filter(F.col("entity") != INDEX), 5, 1).select("entity", "session", F.col("in_top").alias("peer_top"))
    out = out.join(peers, ["entity", "session"], "left").withColumn("peer_top", F.coalesce("peer_top", F.lit(False)))
    out = out.withColumn("own_high_thursday", patterns.all_of(F.col("own_high"), patterns.on_weekday(3)))
    turns = {k: patterns.turn_of_month(df.filter(F.col("entity") == INDEX).select("d"), k).withColumnRenamed("turn", f"turn_{k}") for k in (1, 3)}
    for t in turns.values():
        out = out.join(F.broadcast(t), "d", "left")
    dated = {f"weekday_{i}": patterns.on_weekday(i) for i in WEEKDAYS} | {f"month_{m}": patterns.in_month(m) for m in MONTHS}
    out = out.withColumns(dated)
    calendar = [*dated, "turn_1", "turn_3"]
    own = [*(f"{w}_{n}" for w in ("up", "down") for n in (2, 3, 4, 5)), "above_50", "above_200", "below_50", "below_200", "own_high", "peer_top", "own_high_thursday"]
    listed = F.explode(F.array(*[F.struct(F.lit(c).alias("condition"), F.coalesce(F.col(c), F.lit(False)).alias("hit")) for c in own + calendar])).alias("c")
    return out.select(F.col("entity").alias("on"), "session", listed).select("c.condition", "on", "session", "c.hit").filter(~F.col("condition").isin(calendar) | (F.col("on") == INDEX))


_OWN_SQL = {f"{w}_{n}": _streak_sql(n, s) for w, s in (("up", ">"), ("down", "<")) for n in (2, 3, 4, 5)}
_OWN_SQL |= {f"above_{w}": f"coalesce(count(close) {O.rows(w)} = {w} AND close > avg(close) {O.rows(w)}, FALSE)" for w in (50, 200)}
_OWN_SQL |= {f"below_{w}": f"NOT {_OWN_SQL[f'above_{w}']}" for w in (50, 200)}
_HIGH = f"coalesce(CASE WHEN count(r5) {_W} >= {C.PATTERN_LEAST_HISTORY} THEN r5 >= quantile_cont(r5, 0.9) {_W} END, FALSE)"
_OWN_SQL |= {"own_high": _HIGH, "own_high_thursday": f"{_HIGH} AND isodow(d) = 4", "peer_top": "coalesce(top, FALSE)"}
_CAL_SQL = {f"weekday_{i}": f"isodow(d) = {i + 1}" for i in WEEKDAYS} | {f"month_{m}": f"month(d) = {m}" for m in MONTHS} | {f"turn_{k}": f"a <= {k} OR (b <= {k} AND m < (SELECT max(m) FROM cal))" for k in (1, 3)}
CONDITIONS = f"""cx0 AS (SELECT *, close - lag(close) {_W} AS up, round(close / lag(close, 5) {_W} - 1, 9) AS r5, close / lag(close, 5) {_W} - 1 AS r5x FROM dense),
pt AS (SELECT entity, session, r5x IS NOT NULL AND count(r5x) OVER (PARTITION BY session) >= 3 AND row_number() OVER (PARTITION BY session ORDER BY r5x DESC NULLS LAST, entity DESC) <= 1 AS top FROM cx0 WHERE entity <> {INDEX}),
cx AS (SELECT cx0.*, top FROM cx0 LEFT JOIN pt USING (entity, session)), cal AS (SELECT d, session, date_trunc('month', d) AS m, row_number() OVER (PARTITION BY date_trunc('month', d) ORDER BY d) AS a, row_number() OVER (PARTITION BY date_trunc('month', d) ORDER BY d DESC) AS b FROM ss),
hits0 AS (SELECT entity AS "on", session, unnest([{', '.join(f"{{'c': '{n}', 'h': {x}}}" for n, x in _OWN_SQL.items())}]) AS u FROM cx UNION ALL SELECT {INDEX}, session, unnest([{', '.join(f"{{'c': '{n}', 'h': {x}}}" for n, x in _CAL_SQL.items())}]) FROM cal), hits AS (SELECT u.c AS condition, "on", session, u.h AS hit FROM hits0)"""


def specs() -> list[tuple]:
    """(family, condition, on, target, horizon, excess) of the six families, over the regions and the index."""
    sectors = range(1, 6)
    out = [("day_of_week", f"weekday_{i}", INDEX, INDEX, h, False) for i in WEEKDAYS for h in (1, 5)]
    out += [("sector_day_of_week", f"weekday_{i}", INDEX, s, 1, True) for s in sectors for i in WEEKDAYS]
    out += [("calendar_seasonality", f"turn_{k}", INDEX, INDEX, h, False) for k in (1, 3) for h in (1, 5)] + [("calendar_seasonality", f"month_{m}", INDEX, INDEX, 5, False) for m in MONTHS]
    out += [("streaks", f"{w}_{n}", INDEX, INDEX, h, False) for n in (2, 3, 4, 5) for h in (1, 5, 10) for w in ("up", "down")]
    for s in sectors:
        out += [("strong_week_reversal", c, s, s, h, True) for h in (1, 5) for c in ("own_high", "peer_top")] + [("strong_week_reversal", "own_high_thursday", s, s, 1, True)]
    return out + [("regime", f"{w}_{n}", INDEX, INDEX, h, False) for n in (50, 200) for h in (5, 20) for w in ("above", "below")]


def _specs(spark) -> DataFrame:
    cases = [F.struct(F.lit(f).alias("family"), F.lit(k).alias("spec"), F.lit(c).alias("condition"), F.lit(o).cast("long").alias("on"), F.lit(t).cast("long").alias("target"), F.lit(h).alias("horizon"), F.lit(e).alias("excess")) for k, (f, c, o, t, h, e) in enumerate(specs())]
    return spark.range(1).select(F.explode(F.array(*cases)).alias("s")).select("s.*")


def cells(spark, sf_dir) -> DataFrame:
    """Every cell of all families on every session."""
    df = panel(spark, sf_dir)
    return written(patterns.family_cells(F.broadcast(_specs(spark)), _conditions(df), patterns.outcomes(df, HORIZONS, INDEX)), "cells")


_LEADS = ", ".join(f"{{'h': {h}, 'fwd': lead(close, {h}) {_W} / close - 1, 'tr': lead(close, {h}) {_W} / lead(open, 1) {_W} - 1}}" for h in HORIZONS)
_SPEC_ROWS = ", ".join(f"('{f}', {k}, '{c}', {o}, {t}, {h}, {'TRUE' if e else 'FALSE'})" for k, (f, c, o, t, h, e) in enumerate(specs()))
CELLS = f"""{PANEL}, {CONDITIONS}, fo0 AS (SELECT entity, session, unnest([{_LEADS}]) AS u FROM dense), fo AS (SELECT entity, session, u.h AS horizon, u.fwd AS fwd, u.tr AS tr FROM fo0),
fx AS (SELECT a.entity AS target, a.session, a.horizon, FALSE AS excess, a.fwd, a.tr FROM fo a UNION ALL SELECT a.entity, a.session, a.horizon, TRUE, a.fwd - b.fwd, a.tr - b.tr FROM fo a JOIN fo b ON b.entity = {INDEX} AND b.session = a.session AND b.horizon = a.horizon WHERE a.entity <> {INDEX}),
sp AS (SELECT * FROM (VALUES {_SPEC_ROWS}) t(family, spec, condition, "on", target, horizon, excess)), cells AS (SELECT sp.*, h.session, h.hit, fx.fwd, fx.tr FROM sp JOIN hits h USING (condition, "on") JOIN fx USING (target, horizon, excess, session))"""
TESTS = f"""{CELLS}, nn AS (SELECT max(session) + 1 AS n FROM cells), pc AS (SELECT *, 'full' AS part FROM cells UNION ALL SELECT cells.*, CASE WHEN session < floor(n * {C.PATTERN_SPLIT}::DOUBLE) THEN 'early' ELSE 'late' END FROM cells, nn),
tr AS (SELECT spec, part, horizon, session FROM pc WHERE hit AND fwd IS NOT NULL), nx AS MATERIALIZED (SELECT a.spec, a.part, a.session, b.session AS next FROM tr a ASOF LEFT JOIN tr b ON a.spec = b.spec AND a.part = b.part AND a.session + a.horizon <= b.session),
gr(spec, part, session, n) AS (SELECT spec, part, min(session), 1 FROM tr GROUP BY spec, part UNION ALL SELECT g.spec, g.part, nx.next, g.n + 1 FROM gr g JOIN nx ON nx.spec = g.spec AND nx.part = g.part AND nx.session = g.session WHERE nx.next IS NOT NULL), ef AS (SELECT spec, part, max(n) AS effective_n FROM gr GROUP BY 1, 2),
ag AS (SELECT family, spec, condition, "on", target, horizon, excess, part, count(*) FILTER (hit AND fwd IS NOT NULL) AS n_triggers, count(fwd) AS n_baseline, avg(fwd) FILTER (hit) AS mean, avg(fwd) AS baseline, stddev_samp(fwd) FILTER (hit) AS std, avg(CASE WHEN fwd > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (hit AND fwd IS NOT NULL) AS hit_rate, avg(tr) FILTER (hit AND fwd IS NOT NULL) AS mean_tradable FROM pc GROUP BY ALL),
te AS (SELECT ag.*, coalesce(effective_n, 0) AS effective_n, mean - baseline AS lift, CASE WHEN effective_n >= 5 AND std > 0 THEN (mean - baseline) / (std / sqrt(effective_n)) END AS t_stat FROM ag LEFT JOIN ef USING (spec, part)),
fu AS (SELECT f.*, e.lift AS early_lift, l.lift AS late_lift, {tail_sql('f.t_stat', '(f.effective_n - 1)')} AS p FROM te f LEFT JOIN te e ON e.spec = f.spec AND e.part = 'early' LEFT JOIN te l ON l.spec = f.spec AND l.part = 'late' WHERE f.part = 'full'),
rk AS (SELECT *, count(p) OVER (PARTITION BY family) AS m, CASE WHEN p IS NOT NULL THEN row_number() OVER (PARTITION BY family ORDER BY p NULLS LAST) END AS rk FROM fu), ct AS (SELECT *, max(CASE WHEN p <= rk / CAST(m AS DOUBLE) * {C.FDR_Q}::DOUBLE THEN rk END) OVER (PARTITION BY family) AS cut FROM rk)"""


@query("pattern_family", f"WITH RECURSIVE {TESTS} SELECT family, spec, condition, target, horizon, excess, n_triggers, n_baseline, effective_n, {O.r6('mean', 'baseline', 'lift', 'hit_rate', 'mean_tradable', 't_stat')}, round(p, 6) AS p_value, round(early_lift, 6) AS early_lift, round(late_lift, 6) AS late_lift, sign(lift) = sign(late_lift) AS sign_held, m AS family_size, coalesce(p <= {C.PATTERN_ALPHA}::DOUBLE / m, FALSE) AS survives_bonferroni, coalesce(rk <= cut, FALSE) AS bh_pass, n_triggers < {C.PATTERN_MIN_TRIGGERS} OR effective_n < 2 AS underpowered FROM ct")
def pattern_family(spark, sf_dir):
    """All six families, each cell tested over all sessions and over both parts of them, and corrected within its family."""
    found = patterns.family_tests(cells(spark, sf_dir))
    return rounded(found.select("family", "spec", "condition", "target", "horizon", "excess", "n_triggers", "n_baseline", "effective_n", "mean", "baseline", "lift", "hit_rate", "mean_tradable", "t_stat", "p_value", "early_lift", "late_lift", "sign_held", "family_size", "survives_bonferroni", "bh_pass", "underpowered"))


@query("pattern_conditions", f"WITH {PANEL}, {CONDITIONS} SELECT condition, \"on\", session, hit FROM hits")
def pattern_conditions(spark, sf_dir):
    return _conditions(panel(spark, sf_dir))


@query("pattern_outcomes", f"WITH {CELLS} SELECT target, horizon, excess, session, round(fwd, 6) AS fwd, round(tr, 6) AS tradable FROM fx")
def pattern_outcomes(spark, sf_dir):
    return rounded(patterns.outcomes(panel(spark, sf_dir), HORIZONS, INDEX))


@query("circular_shift_null")
def circular_shift_null(spark, sf_dir):
    """Each family's largest |t| among its testable cells against 500 shared rotations, and its p."""
    found = cells(spark, sf_dir)
    tested = written(patterns.family_tests(found).filter("p_value IS NOT NULL").select("spec"), "testable")
    n = found.agg(F.max("session") + 1).first()[0] or 0
    return patterns.family_null(found.join(F.broadcast(tested), "spec", "left_semi"), n)
