"""Queries of the scoring run: bars, features, percentiles, components, scores."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant import config as C
from sextant.functions.scalar import label, rounded
from sextant.operators import asof, features, figures, forward, ranking, scoring
from sextant.plans import oracle as O
from sextant.sources.bars import bars, levels, read, watchlist
from sextant.sources.store import written

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    """Registers a query, and the SQL that gives its rows."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def panel(spark: SparkSession, sf_dir: str, own: DataFrame | None = None, region: DataFrame | None = None) -> DataFrame:
    """All features of all suppliers and weeks, from bars that are there already if given."""
    if own is None:
        found = levels(spark, sf_dir)
        own, region = found["supplier"], found["region"]
    elif region is None:
        region = bars(spark, sf_dir, "region")
    return features.all_features(own, watchlist(spark, sf_dir), written(features.regime(region), "regime"))


NEUTRAL = ("value_percentile", "quality_percentile")
FIELDS = tuple(f for g in C.COMPOSITES.values() for f in g["fields"])


def reported(spark: SparkSession, sf_dir: str, years: tuple | None = None) -> DataFrame:
    """(entity, filed_date, fields): a supplier's figures of a year, known from the next year on, some of them missing.

    With `years` only the figures of years from the first and before the second of these are read; None is no bound."""
    drop = lambda n, x: F.when(F.first("l_suppkey") % n != 0, x)
    li = read(spark, sf_dir, "lineitem")
    for year, fits in zip(years or (None, None), (lambda c, x: c >= x, lambda c, x: c < x), strict=True):
        if year is not None:
            li = li.filter(fits(F.col("l_shipdate"), F.lit(date(year, 1, 1)).cast("timestamp_ntz")))
    li = li.withColumn("filed_date", F.add_months(F.to_date(F.date_trunc("year", "l_shipdate")), 12))
    found = li.groupBy(F.col("l_suppkey").cast("long").alias("entity"), "filed_date").agg(
        F.try_divide(F.sum("l_extendedprice"), F.sum(F.col("l_tax") * 100)).alias("trailing_pe"), F.avg("l_extendedprice").alias("price_to_sales"), drop(3, F.max("l_quantity")).alias("ev_to_ebitda"), F.avg(F.col("l_discount") - 0.04).alias("price_to_book"),
        F.avg("l_discount").alias("profit_margin"), F.avg("l_tax").alias("operating_margin"), drop(4, F.avg(F.col("l_discount") - F.col("l_tax"))).alias("return_on_equity"), F.sum("l_quantity").alias("debt_to_equity"), drop(5, F.avg("l_quantity")).alias("short_percent_of_float"),
    )
    return found.withColumns({f: F.round(f, 9) for f in FIELDS})


def full_panel(spark: SparkSession, sf_dir: str, own: DataFrame | None = None, region: DataFrame | None = None, ahead: bool = False) -> DataFrame:
    """The panel with the figures known at each date, and if asked with what followed in the entity's own closes."""
    if own is None:
        found = levels(spark, sf_dir)
        own, region = found["supplier"], found["region"]
    known = asof.backward(own, reported(spark, sf_dir), "entity", "d", "filed_date", list(FIELDS)).drop("filed_date_asof")
    return panel(spark, sf_dir, forward.own_outcomes(known) if ahead else known, region)


def ranked(spark: SparkSession, sf_dir: str, own: DataFrame | None = None, region: DataFrame | None = None) -> DataFrame:
    """The panel with its percentiles and the composites of the fundamentals."""
    return ranked_panel(full_panel(spark, sf_dir, own, region))


def for_ranks(found: DataFrame, *more: str) -> DataFrame:
    """What ranks, components and scores need of a panel with figures, and `more` columns of it."""
    df = scoring.own_components(figures.cleaned(found))
    return df.select("entity", "d", "sector", *ranking.RANKED, *FIELDS, *scoring.OWN, *scoring.NEEDED, *more)


def ranked_panel(found: DataFrame, *more: str) -> DataFrame:
    """Percentiles and composites of a panel with figures, each date by itself, and what components need beside them.

    Whatever a row's own columns give is worked out before, so few columns are dealt by date; `more` go along."""
    return ranking.cross_section(for_ranks(found, *more), C.COMPOSITES, NEUTRAL)


def scored(spark: SparkSession, sf_dir: str, own: DataFrame | None = None, region: DataFrame | None = None) -> DataFrame:
    """The whole scoring run for every date. A live day is one date of it."""
    return scoring.scores(scoring.components(ranked(spark, sf_dir, own, region)))


def scored_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole scoring run with what followed, from bars that are made once: outcomes go along with the features."""
    b, ahead = levels(spark, sf_dir), forward.ahead()
    found = scoring.scores(scoring.components(ranked_panel(full_panel(spark, sf_dir, b["supplier"], b["region"], True), "benchmark", *ahead)))
    return forward.beside(found.select("entity", "d", "sector", "benchmark", *O.COMPONENT_NAMES, *C.SCORE_WEIGHTS, *ahead), b["region"], b["all"])


def picked(df: DataFrame, *names: str) -> DataFrame:
    """Key and columns, doubles rounded."""
    return rounded(df.select("entity", "d", *names))


def _sql(ctes: str, source: str, doubles: tuple[str, ...], others: tuple[str, ...] = (), where: str = "") -> str:
    cols = ", ".join(["entity", "d", *([O.r6(*doubles)] if doubles else []), *others])
    return f"WITH {ctes} SELECT {cols} FROM {source} {where}"


_BAR = ("open", "high", "low", "close", "volume")


@query("bars_weekly", _sql(O.BARS, "bars", _BAR))
def bars_weekly(spark, sf_dir):
    return picked(bars(spark, sf_dir), *_BAR)


_TREND = (*(f"SMA{w}" for w in C.SMA_WINDOWS), *(f"close_vs_SMA{w}_pct" for w in C.SMA_WINDOWS), "SMA20_vs_SMA50_pct", "SMA50_vs_SMA200_pct")


@query("trend_sma", _sql(O.FEATURES, "own", _TREND))
def trend_sma(spark, sf_dir):
    return picked(features.trend(bars(spark, sf_dir)), *_TREND)


_RETURNS = tuple(f"return_{w}d" for w in C.RETURN_WINDOWS)


@query("returns_multi_window", _sql(O.FEATURES, "own", _RETURNS, ("return_252d_missing",)))
def returns_multi_window(spark, sf_dir):
    return picked(features.returns(bars(spark, sf_dir)), *_RETURNS, "return_252d_missing")


_STRENGTH = tuple(f"relative_strength_{w}d" for w in C.STRENGTH_WINDOWS)


@query("relative_strength", _sql(O.PANEL, "panel", _STRENGTH))
def relative_strength(spark, sf_dir):
    return picked(panel(spark, sf_dir), *_STRENGTH)


_VOLUME = ("volume_ratio_20d", "volume_ratio_60d", "dollar_volume_20d", "up_volume_vs_down_volume_20d", "close_position")
_VFLAGS = ("illiquid_flag", "high_volume_up_days_20d", "high_volume_down_days_20d", "weak_close_flag", "strong_close_flag")


@query("volume_behavior_features", _sql(O.FEATURES, "own", _VOLUME, _VFLAGS))
def volume_behavior_features(spark, sf_dir):
    return picked(features.volume(bars(spark, sf_dir)), *_VOLUME, *_VFLAGS)


_VOL = ("ATR14", "ATR_pct", "volatility_20d", "volatility_60d", "downside_volatility_20d")


@query("atr_volatility", _sql(O.FEATURES, "own", _VOL))
def atr_volatility(spark, sf_dir):
    return picked(features.risk(bars(spark, sf_dir)), *_VOL)


@query("rolling_max_drawdown", _sql(O.FEATURES, "own", ("max_drawdown_20d", "max_drawdown_60d")))
def rolling_max_drawdown(spark, sf_dir):
    return picked(features.risk(bars(spark, sf_dir)), "max_drawdown_20d", "max_drawdown_60d")


@query("range_52w", _sql(O.FEATURES, "own", ("distance_from_52w_high_pct", "distance_from_52w_low_pct")))
def range_52w(spark, sf_dir):
    return picked(features.risk(bars(spark, sf_dir)), "distance_from_52w_high_pct", "distance_from_52w_low_pct")


_SETUP = ("near_20d_high", "near_60d_high", "pullback_above_SMA50", "failed_breakout_flag", "extended_flag", "not_extended_flag")


@query("setup_flags", _sql(O.FEATURES, "own", (), _SETUP))
def setup_flags(spark, sf_dir):
    return picked(features.setup(features.trend(bars(spark, sf_dir))), *_SETUP)


_REGIME = (*(f"benchmark_above_SMA{w}" for w in C.SMA_WINDOWS), "benchmark_vol_high_flag")


@query("benchmark_regime", f"WITH {O.REGIME} SELECT benchmark, d, {O.r6('benchmark_volatility_20d', 'benchmark_return_20d', 'benchmark_return_60d')}, {', '.join(_REGIME)} FROM regime")
def benchmark_regime(spark, sf_dir):
    return rounded(features.regime(bars(spark, sf_dir, "region")).select("benchmark", "d", "benchmark_volatility_20d", "benchmark_return_20d", "benchmark_return_60d", *_REGIME))


_PCT = (*(f"{f}_percentile" for f in (*C.NORMAL_PERCENTILES, *C.INVERTED_PERCENTILES)), "distance_from_52w_high_adjusted_percentile")


@query("cross_section_percentiles", _sql(O.PERCENTILES, "ranked", _PCT))
def cross_section_percentiles(spark, sf_dir):
    return picked(ranking.percentiles(panel(spark, sf_dir).select("entity", "d", "extended_flag", *ranking.RANKED)), *_PCT)


@query("component_scores", _sql(O.COMPONENTS, "comp", O.COMPONENT_NAMES, ("sector_rank_fallback",)))
def component_scores(spark, sf_dir):
    return picked(scoring.components(ranked(spark, sf_dir)), *O.COMPONENT_NAMES, "sector_rank_fallback")


_DUE = "CASE WHEN entity % 7 <> 0 THEN CAST((entity * 11 + 365 - dayofyear(d)) % 91 AS INTEGER) END"


@query("live_scores", f"WITH {O.COMPONENTS}, due AS (SELECT *, {_DUE} AS days_until_earnings FROM comp) SELECT entity, d, {', '.join(f'round({O.score(w, C.EARNINGS_PENALTIES[h])}, 6) AS {h}' for h, w in C.SCORE_WEIGHTS.items())} FROM due")
def live_scores(spark, sf_dir):
    """Scores of a live run of a version whose near earnings cost points; entities without a known date pay nothing."""
    due = F.when(F.col("entity") % 7 != 0, (F.col("entity") * 11 + 365 - F.dayofyear("d")) % 91)
    df = scoring.components(ranked(spark, sf_dir)).withColumn("days_until_earnings", due)
    return picked(scoring.scores(df, C.LIVE_EARNINGS_VERSIONS[0], True), *C.SCORE_WEIGHTS)


@query("unlisted_version_scores", f"WITH {O.SCORES} SELECT entity, d, {O.r6(*C.SCORE_WEIGHTS)} FROM scored")
def unlisted_version_scores(spark, sf_dir):
    """A live run of a version that isn't listed scores as a backfill does, though earnings are near."""
    df = scoring.components(ranked(spark, sf_dir)).withColumn("days_until_earnings", F.lit(1))
    return picked(scoring.scores(df, "another", True), *C.SCORE_WEIGHTS)


@query("horizon_scores", _sql(O.SCORES, "scored", tuple(C.SCORE_WEIGHTS), (f"{O.label('score_120d')} AS score_label",)))
def horizon_scores(spark, sf_dir):
    return picked(scored(spark, sf_dir), *C.SCORE_WEIGHTS, "score_label")


@query("score_labels", f"WITH {O.SCORES} SELECT d, {O.label('score_20d')} AS score_label, count(*) AS n FROM scored GROUP BY 1, 2")
def score_labels(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("d", label(F.col("score_20d")).alias("score_label")).agg(F.count(F.lit(1)).alias("n"))


@query("top_n_with_ties", f"WITH {O.SCORES}, t AS (SELECT d, entity, score_20d, rank() OVER (PARTITION BY d ORDER BY round(score_20d, 6) DESC) AS place FROM scored WHERE score_20d IS NOT NULL) SELECT entity, d, {O.r6('score_20d')}, CAST(place AS INTEGER) AS place FROM t WHERE place <= 10")
def top_n_with_ties(spark, sf_dir):
    return picked(ranking.top_with_ties(scored(spark, sf_dir).withColumn("score_20d", F.round("score_20d", 6)), "score_20d", 10), "score_20d", "place")


@query("top_n_exact", f"WITH {O.SCORES}, t AS (SELECT d, entity, score_20d, row_number() OVER (PARTITION BY d ORDER BY round(score_20d, 6) DESC, entity) AS place FROM scored WHERE score_20d IS NOT NULL) SELECT entity, d, {O.r6('score_20d')}, CAST(place AS INTEGER) AS place FROM t WHERE place <= 10")
def top_n_exact(spark, sf_dir):
    return picked(ranking.top_exact(scored(spark, sf_dir).withColumn("score_20d", F.round("score_20d", 6)), "score_20d", 10), "score_20d", "place")


@query("trend_top_setups", f"WITH {O.SCORES}, t AS (SELECT entity, d, trend_component, return_20d_percentile, row_number() OVER (PARTITION BY d ORDER BY trend_component DESC, round(return_20d_percentile, 6) DESC, entity) AS place FROM scored WHERE trend_component IS NOT NULL AND return_20d_percentile IS NOT NULL AND d = (SELECT max(d) FROM scored)) SELECT entity, d, {O.r6('trend_component', 'return_20d_percentile')}, CAST(place AS INTEGER) AS place FROM t WHERE place <= 25")
def trend_top_setups(spark, sf_dir):
    """Trend score and return percentile of the best entities on the latest session: the smallest whole run."""
    df = panel(spark, sf_dir)
    last = df.agg(F.max("d").alias("d"))
    found = scoring.own_components(df.join(F.broadcast(last), "d")).select("entity", "d", "extended_flag", *ranking.RANKED, "trend_component")
    found = ranking.percentiles(found)
    found = found.filter("trend_component IS NOT NULL AND return_20d_percentile IS NOT NULL")
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("d").orderBy(F.desc("trend_component"), F.desc(F.round("return_20d_percentile", 6)), "entity"))
    return picked(found.withColumn("place", place).filter("place <= 25"), "trend_component", "return_20d_percentile", "place")
