"""Upkeep of the universe and of what is reported: watchlists, carried rows, coverage checks, cutoffs, guards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant import config as C
from sextant.functions.scalar import benchmark_of


def grown_watchlist(existing: DataFrame, listed: DataFrame) -> DataFrame:
    """(ticker, sector, benchmark, size_bucket, notes): all existing rows as they are, listed symbols that are not there
    yet, and a row for each benchmark without one. Applied to its own result it adds nothing.

    `listed` has symbol, sector, industry, size_bucket and source; of a symbol listed twice the first by source counts."""
    ticker = F.replace("symbol", F.lit("."), F.lit("-"))
    once = listed.withColumn("ticker", ticker).withColumn("_k", F.row_number().over(Window.partitionBy("ticker").orderBy("source"))).filter("_k = 1")
    new = once.join(existing.select("ticker"), "ticker", "left_anti").select("ticker", "sector", benchmark_of(F.col("sector"), F.col("size_bucket"), F.col("industry")).alias("benchmark"), "size_bucket", F.concat("source", F.lit("_auto")).alias("notes"))
    held = existing.select("ticker", "sector", "benchmark", F.coalesce("size_bucket", F.lit("large")).alias("size_bucket"), "notes").unionByName(new)
    market = existing.sparkSession.range(1).select(F.lit(C.MARKET).alias("ticker"))
    wanted = held.select(F.col("benchmark").alias("ticker")).unionByName(market).distinct().join(held.select("ticker"), "ticker", "left_anti")
    return held.unionByName(wanted.select("ticker", F.lit(C.INDEX_SECTOR).alias("sector"), F.lit(C.MARKET).alias("benchmark"), F.lit("").alias("size_bucket"), F.lit("benchmark").alias("notes")))


def ever_members(history: DataFrame) -> DataFrame:
    """Everything that any listing ever held, once."""
    return history.select("member").distinct()


def still_tracked(history: DataFrame, tracked: DataFrame) -> DataFrame:
    """Ever-members that are tracked today."""
    return ever_members(history).intersect(tracked.select("member"))


def carried(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """New report rows, and the old ones of the keys that were not reported anew."""
    return new.unionByName(old.join(new.select(key).distinct(), key, "left_anti").select(*new.columns))


def without_benchmark(bars: DataFrame, watch: DataFrame) -> DataFrame:
    """(benchmark, n): benchmarks of the watchlist that have no bar at all, and the entities that need them."""
    return watch.join(bars.select(F.col("entity").alias("benchmark")).distinct(), "benchmark", "left_anti").groupBy("benchmark").agg(F.count(F.lit(1)).alias("n"))


def short_histories(bars: DataFrame, watch: DataFrame, least: int) -> DataFrame:
    """(entity, n): watched entities with fewer bars than `least`, those with none included."""
    counts = bars.groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    return watch.select("entity").distinct().join(counts, "entity", "left").select("entity", F.coalesce("n", F.lit(0)).alias("n")).filter(F.col("n") < least)


def by_cutoff(df: DataFrame, at: str, cutoff: Column) -> DataFrame:
    """df with `side`: before, for rows up to the cutoff, which a model may have seen, else after; undated rows go."""
    return df.filter(F.col(at).isNotNull()).withColumn("side", F.when(F.col(at) <= cutoff, "before").otherwise("after"))


def cutoff_coverage(df: DataFrame, at: str, cutoff: Column, chars: Column, least_after: int = 200) -> DataFrame:
    """(side, n, tokens, enough): rows and a token estimate (four characters each) of either side of a cutoff, and whether
    there are rows enough to tell the sides apart."""
    found = by_cutoff(df, at, cutoff).groupBy("side").agg(F.count(F.lit(1)).alias("n"), (F.sum(chars) / 4).alias("tokens"))
    return found.withColumn("enough", (F.col("side") == "before") | (F.col("n") >= least_after))


def market_priced(series: DataFrame, allowed: list[str]) -> DataFrame:
    """series as it is; a row of a series that is not in the list of those that markets price fails the job."""
    known = F.col("series_id").isin(allowed)
    return series.withColumn("series_id", F.when(known, F.col("series_id")).otherwise(F.raise_error(F.concat(F.lit("not priced by a market: "), F.coalesce("series_id", F.lit("NULL")))).cast("string")))


def sessions_back(sessions: DataFrame, n: int) -> DataFrame:
    """(d, back): each session with the one n sessions before it, or the first there is."""
    by = Window.partitionBy(F.lit(0)).orderBy("d")
    return sessions.select("d", F.coalesce(F.lag("d", n).over(by), F.first("d").over(by)).alias("back"))


def labelled_rows(df: DataFrame, names: DataFrame, on: str, label: str) -> DataFrame:
    """Rows for display with a name from another table; rows without one show their key."""
    return df.join(names.select(on, F.col(label).alias("_label")), on, "left").withColumn("label", F.coalesce("_label", F.col(on).cast("string"))).drop("_label")


def markdown(df: DataFrame, columns: list[str], most: int = 50) -> str:
    """A small report as a Markdown table, at most `most` rows in df's order; a missing value shows as n/a."""
    shown = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("n/a")).alias(c) for c in columns]).limit(most).collect()
    line = lambda cells: "| " + " | ".join(x.replace("|", "\\|").replace("\n", " ") for x in cells) + " |"
    return "\n".join([line(columns), line(["-"] * len(columns)), *(line(list(r)) for r in shown)])


def entry_json(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, entry): all other columns of a row as one JSON text, NULLs included, read back by `entries`."""
    rest = [c for c in df.columns if c not in keys]
    return df.select(*keys, F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("entry"))


def entries(df: DataFrame, ddl: str) -> DataFrame:
    """The columns that `entry_json` packed."""
    return df.withColumn("_e", F.from_json("entry", ddl)).select(*[c for c in df.columns if c != "entry"], "_e.*")


def combined(sources: list[DataFrame]) -> DataFrame:
    """Union of reports whose columns differ; missing ones are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)
