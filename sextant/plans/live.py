"""The live day: one session scored from what earlier days have left, without reading or ranking history again.

A day's state is, of each entity, the bars that its windows look back on and its newest figures, in a keyed table whose
versions are days. A day reads that, the one new session's lines and the figures filed since, and commits the next state
after its scores are stored: a day that is done again, or was broken off, starts from the state before it."""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sextant import config as C
from sextant.functions.scalar import rounded
from sextant.operators import features, forward, scoring
from sextant.plans import core
from sextant.plans import oracle as O
from sextant.sources import checks
from sextant.sources.bars import bars, watchlist
from sextant.sources.store import laid_out, shared_dir, written
from sextant.sources.tables import Table

QUERIES, ORACLES = {}, {}
LEVELS = ("supplier", "region", "all")
#: Earlier bars that a new one's features look back on: the longest return; for a benchmark the volatilities that the
#: newest one is placed among, each of which has its own window.
LOOK_BACK = {"supplier": C.SESSIONS_A_YEAR, "region": C.SESSIONS_A_YEAR + C.VOLATILITY_WINDOWS[0], "all": 1}
BAR = ("open", "high", "low", "close", "volume")


def query(name: str, sql: str | None = None):
    """Registers a query, and the SQL that gives its rows."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def newest(df: DataFrame, at: str, n: int) -> DataFrame:
    """The n newest rows of each entity. Only these go through the shuffle's sort: ranks are limited before it."""
    place = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc(at)))
    return df.withColumn("_k", place).filter(F.col("_k") <= n).drop("_k")


def state_table(spark: SparkSession, path: str) -> Table:
    """Bars and figures that a next day needs; a part for each level and one for the figures."""
    return Table(spark, path, ("kind", "entity", "d"), "kind")


def _state(tails: dict[str, DataFrame], figures: DataFrame) -> DataFrame:
    """Rows of the state table from bars by level and newest figures."""
    parts = [df.select(F.lit(level).alias("kind"), "entity", "d", *BAR) for level, df in tails.items()]
    parts.append(figures.select(F.lit("figures").alias("kind"), "entity", F.col("filed_date").alias("d"), *core.FIELDS))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def begin(spark: SparkSession, sf_dir: str, path: str, until: date) -> int:
    """The state after the session `until`, from the history up to it: what a first day needs, and only that one."""
    tails = {level: newest(bars(spark, sf_dir, level, until=until), "d", n) for level, n in LOOK_BACK.items()}
    known = newest(core.reported(spark, sf_dir, (None, until.year)), "filed_date", 1)
    return state_table(spark, path).replace(_state(tails, known), note={"until": str(until)})


def before(table: Table, d: date) -> tuple[int, dict]:
    """Number and manifest of the newest state that knows nothing of the session d or later ones."""
    for v in reversed(table.versions()):
        state = table.manifest(v)
        if state["note"]["until"] < str(d):
            return v, state
    raise ValueError(f"no state of a day before {d}")


def new_bars(spark: SparkSession, sf_dir: str, after: date, d: date) -> dict[str, DataFrame]:
    """Bars of all levels of the sessions (weeks) after one and up to d. That condition reaches the files."""
    return {level: bars(spark, sf_dir, level, after + timedelta(days=7), d) for level in LEVELS}


def new_figures(spark: SparkSession, sf_dir: str, after: date, d: date) -> DataFrame:
    """Figures filed after a date and up to d. They are filed at the start of a year; without one nothing is read."""
    years = [y for y in range(after.year, d.year + 1) if after < date(y, 1, 1) <= d]
    if not years:
        return core.reported(spark, sf_dir).limit(0)
    return core.reported(spark, sf_dir, (years[0] - 1, years[-1]))


def day_panel(watch: DataFrame, own: DataFrame, region: DataFrame, figures: DataFrame, d: date) -> DataFrame:
    """All features and figures of one session, from tails of bars that end with it.

    Entities without a bar of their own or of their benchmark on that session aren't in it: their data is stale."""
    fresh = own.filter(F.col("d") == F.lit(d)).select("entity")
    tails = own.join(fresh, "entity", "left_semi")
    found = features.all_features(tails, watch, written(features.regime(region).filter(F.col("d") == F.lit(d)), "regime"))
    return found.filter(F.col("d") == F.lit(d)).join(figures.select("entity", "filed_date", *core.FIELDS), "entity", "left")


def live_day(spark: SparkSession, sf_dir: str, path: str, d: date, store=None, version: str | None = None, live: bool = False) -> DataFrame:
    """Components and scores of the session d, and the state after it. Sessions missed before d enter the state with it.

    Names, scored rows, values out of range and the verdict on them come from the run's own writes and are committed with
    the state; figures filed after the session stop the run.

    `store`, if given, is called with the rows before the state is committed: what it does may be done again. The state
    holds at most LOOK_BACK rows an entity, so a day costs the same whatever came before."""
    table = state_table(spark, path)
    base, state = before(table, d)
    after = date.fromisoformat(state["note"]["until"])
    old = {level: table.read(base, [level]) for level in (*LEVELS, "figures")}
    new = new_bars(spark, sf_dir, after, d)
    tails = {level: old[level].select("entity", "d", *BAR).unionByName(new[level].select("entity", "d", *BAR)) for level in LEVELS}
    tails["supplier"], seen = checks.observed(tails["supplier"], now=checks.counted(F.col("d") == F.lit(d)), before=checks.counted(F.col("d") == F.lit(after)))
    tails = {level: written(df, f"tail-{level}") for level, df in tails.items()}
    filed = old["figures"].select("entity", F.col("d").alias("filed_date"), *core.FIELDS).unionByName(new_figures(spark, sf_dir, after, d).select("entity", "filed_date", *core.FIELDS))
    known = written(newest(filed, "filed_date", 1), "figures")
    panel = day_panel(watchlist(spark, sf_dir), tails["supplier"], tails["region"], known, d)
    scored = scoring.components(core.ranked_panel(panel, "filed_date")).withColumn("days_until_earnings", F.lit(None).cast("int"))
    rows = checks.ruled(scoring.scores(scored, version, live), {"figures were filed by their session": F.col("filed_date") <= F.col("d"), "rows are of one session": F.col("d") == F.lit(d)})
    odd = reduce(lambda a, b: a | b, [~F.col(h).between(0, 100) for h in C.SCORE_WEIGHTS])
    rows, told = checks.observed(rows, rows=F.count(F.lit(1)), scored=checks.counted(F.col("score_120d").isNotNull()), odd=checks.counted(odd))
    rows = written(rows, "live")
    figures = {**seen.get, **told.get}
    figures["verdict"] = checks.verdict(figures["now"], figures["before"], figures["odd"])
    if store is not None:
        store(rows)
    kept = {level: newest(df, "d", LOOK_BACK[level]) for level, df in tails.items()}
    table.replace(_state(kept, known), base if base == table.versions()[-1] else None, {"until": str(d), "figures": figures})
    return rows


def last_sessions(spark: SparkSession, sf_dir: str, n: int) -> list[date]:
    """The n newest sessions of the calendar, oldest first."""
    return sorted(r.d for r in bars(spark, sf_dir, "all").select("d").orderBy(F.desc("d")).limit(n).collect())


@query("live_days", f"WITH {O.SCORES}, days AS (SELECT DISTINCT d FROM scored ORDER BY d DESC LIMIT 2) SELECT entity, d, {O.r6(*O.COMPONENT_NAMES, *C.SCORE_WEIGHTS)}, {O.label('score_120d')} AS score_label FROM scored WHERE d IN (SELECT d FROM days)")
def live_days(spark, sf_dir):
    """The last two sessions, each scored from the state of the day before: the same rows as the whole history's."""
    path = f"{shared_dir(spark)}/live-{spark.sparkContext.applicationId}-{spark.range(1).select(F.uuid()).first()[0]}"
    first, *days = last_sessions(spark, sf_dir, 3)
    begin(spark, sf_dir, path, first)
    return reduce(DataFrame.unionByName, [rounded(core.picked(live_day(spark, sf_dir, path, d), *O.COMPONENT_NAMES, *C.SCORE_WEIGHTS, "score_label")) for d in days])


_LAID = ("SMA200", "return_20d", "volume_ratio_20d", "ATR14", "volatility_60d", "distance_from_52w_high_pct")
_AHEAD = tuple(f"lead(close, {h}) OVER (PARTITION BY entity ORDER BY d) / close - 1 AS future_return_{h}d" for h in forward.HORIZONS)


@query("laid_out_features", f"WITH {O.FEATURES}, ahead AS (SELECT entity, d, {', '.join(_AHEAD)} FROM bars) SELECT entity, d, {O.r6(*_LAID, *(f'future_return_{h}d' for h in forward.HORIZONS))}, near_60d_high FROM own JOIN ahead USING (entity, d)")
def laid_out_features(spark, sf_dir):
    """Features and what followed, from bars that are stored by entity: no window moves a row."""
    b = laid_out(bars(spark, sf_dir), "bars", "entity", "d")
    own = features.setup(features.risk(features.volume(features.returns(features.trend(b)))))
    ahead = {f"future_return_{h}d": forward.lead_return(h) for h in forward.HORIZONS}
    return rounded(own.withColumns(ahead).select("entity", "d", *_LAID, *ahead, "near_60d_high"))
