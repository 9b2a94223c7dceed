"""What happened after a date: forward and excess returns, drawdown, maturity. Leads count an entity's own rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions.windows import by_entity, spans
from sextant.sources.store import written

HORIZONS, DRAWDOWN_HORIZONS = (5, 20, 60, 120), (20, 60)


def lead_return(n: int) -> Column:
    """Return from this close to the close n own rows ahead; NULL before that has happened."""
    return F.try_divide(F.lead("close", n).over(by_entity()), F.col("close")) - 1


def drawdown_after(n: int) -> Column:
    """Deepest fall in percent from a peak within this and the next n closes; NULL without all of them. Needs `_closes`,
    the closes so far, and the `spans` of n closes: those that end one row before the last, which is then added."""
    ahead = lambda c, k: F.lead(c, k).over(by_entity())
    top, there = ahead(f"_top{n}", n - 1), F.col("close").isNotNull().cast("long")
    fall = F.greatest(ahead(f"_fall{n}", n - 1), F.try_divide(top - ahead("close", n), top) * 100)
    return F.when(ahead("_closes", n) - F.col("_closes") + there == n + 1, fall)


def ahead(horizons=HORIZONS) -> tuple[str, ...]:
    """The columns that `own_outcomes` adds."""
    return (*(f"future_return_{h}d" for h in horizons), *(f"max_drawdown_after_{h}d" for h in DRAWDOWN_HORIZONS))


def own_outcomes(bars: DataFrame, horizons=HORIZONS) -> DataFrame:
    """bars with what followed in the entity's own closes: forward returns and drawdowns."""
    spanned = spans(bars, "close").withColumn("_closes", F.count("close").over(by_entity().rowsBetween(Window.unboundedPreceding, 0)))
    return spanned.select(*bars.columns, *[lead_return(h).alias(f"future_return_{h}d") for h in horizons], *[drawdown_after(h).alias(f"max_drawdown_after_{h}d") for h in DRAWDOWN_HORIZONS])


def beside(own: DataFrame, benchmarks: DataFrame, market: DataFrame, horizons=HORIZONS) -> DataFrame:
    """own, rows with a `benchmark` and forward returns, with those of the benchmark and the market, and the excesses.

    A benchmark without a bar on the date leaves its return NULL. Benchmarks and market have as many rows as sessions:
    written before, their size is known to the joins."""
    bench = written(benchmarks.select(F.col("entity").alias("benchmark"), "d", *[lead_return(h).alias(f"future_benchmark_return_{h}d") for h in horizons]), "benchmarks")
    index = written(market.select("d", *[lead_return(h).alias(f"future_index_return_{h}d") for h in horizons]), "market")
    out = own.join(bench, ["benchmark", "d"], "left").join(index, "d", "left")
    return out.withColumns({f"future_excess_return_{h}d": F.col(f"future_return_{h}d") - F.col(f"future_benchmark_return_{h}d") for h in horizons})


def outcomes(bars: DataFrame, watch: DataFrame, benchmarks: DataFrame, market: DataFrame, horizons=HORIZONS) -> DataFrame:
    """(entity, d, sector) with forward returns of the entity, its benchmark and the market, and the excesses.

    A benchmark without any history drops the entity. One exchange by entity gives all horizons."""
    own = own_outcomes(bars.select("entity", "d", "close"), horizons).drop("close")
    known = watch.join(benchmarks.select(F.col("entity").alias("benchmark")).distinct(), "benchmark", "left_semi")
    return beside(own.join(known, "entity"), benchmarks, market, horizons)


def calendar(market: DataFrame) -> DataFrame:
    """(d, session): the sessions of the calendar entity, numbered from 0."""
    return market.select("d", (F.row_number().over(Window.partitionBy("entity").orderBy("d")) - 1).alias("session"))


def maturities(sessions: DataFrame, horizon: int) -> DataFrame:
    """(d, session, matures): when an outcome of the horizon is known; NULL past the calendar's end. Fails on lookahead."""
    ahead = F.lead("d", horizon).over(Window.partitionBy(F.lit(0)).orderBy("session"))
    out = sessions.withColumn("matures", ahead)
    return out.withColumn("matures", F.when(F.col("matures").isNull() | (F.col("matures") > F.col("d")), F.col("matures")).otherwise(F.raise_error(F.lit("a maturity is not after its date")).cast("date")))
