"""Checks and repair plans of ingested data, universe upkeep, and keyed writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant import config as C


def interior_gaps(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """(entity, d): sessions inside an entity's own first and last bar that it has no bar of.

    Sessions get numbers, so an entity's are a run of numbers from its first to its last, and all joins are by equality."""
    numbered = sessions.select("d", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("d")).alias("_s"))
    placed = bars.select("entity", "d").join(F.broadcast(numbered), "d")
    spans = placed.groupBy("entity").agg(F.sequence(F.min("_s"), F.max("_s")).alias("x"))
    missing = spans.select("entity", F.explode("x").alias("_s")).join(placed.select("entity", "_s"), ["entity", "_s"], "left_anti")
    return missing.join(F.broadcast(numbered), "_s").select("entity", "d")


def repair_groups(gaps: DataFrame, apart: int = 4, longest: int = 30) -> DataFrame:
    """(entity, start, end, n): gaps at most `apart` days after each other join; a span over `longest` days is cut."""
    time = Window.partitionBy("entity").orderBy("d")
    new = (F.datediff("d", F.lag("d").over(time)) > apart).cast("int")
    runs = gaps.withColumn("run", F.sum(F.coalesce(new, F.lit(0))).over(time)).withColumn("lead_in", F.min("d").over(Window.partitionBy("entity", "run")))
    cut = runs.withColumn("piece", F.floor(F.datediff("d", "lead_in") / longest))
    return cut.groupBy("entity", "run", "piece").agg(F.min("d").alias("start"), F.max("d").alias("end"), F.count(F.lit(1)).alias("n")).drop("run", "piece")


def thin_sessions(bars: DataFrame) -> DataFrame:
    """(d, n, usual): days with fewer than the fraction of the upper median of the counts before them."""
    counts = bars.groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    past = F.array_sort(F.collect_list("n").over(Window.partitionBy(F.lit(0)).orderBy("d").rowsBetween(-C.THIN_LOOKBACK, -1)))
    usual = F.when(F.size(past) >= C.THIN_MIN_PRIORS, F.get(past, (F.size(past) / 2).cast("int")))
    return counts.withColumn("usual", usual).filter(F.col("n") < C.THIN_FRACTION * F.col("usual"))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def refresh_queue(df: DataFrame, key: str, age: str, refresh_days: int) -> DataFrame:
    """The share of keys due in one run, oldest first, never seen before all; ties by key."""
    n = df.count()
    return df.orderBy(F.col(age).desc_nulls_first(), key).limit(-(-n // refresh_days)).select(key, age)


def tail_plan(have: DataFrame, wanted: DataFrame, last_session) -> DataFrame:
    """(start, keys): from where each key must be fetched; NULL means from the beginning; up-to-date keys are left out."""
    seen = have.groupBy("entity").agg(F.max("d").alias("last"))
    plan = wanted.select("entity").join(seen, "entity", "left").filter(F.col("last").isNull() | (F.col("last") < last_session))
    return plan.groupBy(F.date_add("last", 1).alias("start")).agg(F.count(F.lit(1)).alias("n_keys"), F.min("entity").alias("first_key"))


def sparse_fields(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, null_share, sparse) of each field, in one aggregation."""
    row = df.agg(*[F.avg(F.col(f).isNull().cast("double")).alias(f) for f in fields])
    out = row.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("null_share")) for f in fields])).alias("x")).select("x.*")
    return out.withColumn("sparse", F.col("null_share") > C.SPARSE_SHARE)


def members_as_of(history: DataFrame, as_of: DataFrame) -> DataFrame:
    """(d, index_name, member) of each index's newest listing dated at or before each date.

    Listings of different indices are dated apart: each index counts its own. A listing holds from its date until its
    index's next one, so each wanted date is one row an index; listing dates are few, and join by index and month."""
    time = Window.partitionBy("index_name").orderBy("as_of_date")
    spans = history.select("index_name", "as_of_date").distinct().withColumn("until", F.lead("as_of_date").over(time))
    last = as_of.agg(F.max("d").alias("_last"))
    month = lambda c: F.trunc(c, "month")
    spread = spans.join(F.broadcast(last), F.lit(True)).filter(F.col("as_of_date") <= F.col("_last")).withColumn("m", F.explode(F.sequence(month("as_of_date"), month(F.coalesce(F.least("until", "_last"), F.col("_last"))), F.expr("INTERVAL 1 MONTH"))))
    when = as_of.select("d", month("d").alias("m")).distinct().join(spread, "m").filter((F.col("d") >= F.col("as_of_date")) & (F.col("until").isNull() | (F.col("d") < F.col("until"))))
    return when.select("d", "index_name", "as_of_date").join(history, ["index_name", "as_of_date"]).select("d", "index_name", "member").distinct()


def survivorship(history: DataFrame, tracked: DataFrame) -> DataFrame:
    """By listing date: members, and the share of them that is not tracked today."""
    known = tracked.select(F.col("member").alias("m"))
    both = history.distinct().join(known.distinct(), F.col("member") == F.col("m"), "left")
    return both.groupBy("as_of_date").agg(F.count(F.lit(1)).alias("members"), F.sum(F.col("m").isNull().cast("int")).alias("missing")).withColumn("missing_pct", F.col("missing") / F.col("members") * 100)


def matched_ids(wanted: DataFrame, directory: DataFrame) -> DataFrame:
    """(ticker, cik): by the exact symbol, else by its letters and digits if only one id has those; else NULL."""
    from sextant.functions.scalar import symbol

    exact = directory.groupBy(F.col("symbol").alias("ticker")).agg(F.min("cik").alias("exact"))
    loose = directory.groupBy(symbol(F.col("symbol")).alias("norm")).agg(F.min("cik").alias("loose"), F.count_distinct("cik").alias("ids")).filter("ids = 1")
    out = wanted.join(exact, "ticker", "left").withColumn("norm", symbol(F.col("ticker"))).join(loose, "norm", "left")
    return out.select("ticker", F.coalesce("exact", "loose").alias("cik"))


def last_of(df: DataFrame, order, *keys: str) -> DataFrame:
    """One row a key, the last by an order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_k = 1").drop("_k")


def upsert(old: DataFrame, new: DataFrame, *keys: str, order=None) -> DataFrame:
    """old with new's rows in place of those with their keys; of new rows with one key the first by `order` counts.

    Without an order the one with the largest hash of all its columns does: the same in every run."""
    one = last_of(new, F.desc(F.xxhash64(*new.columns)) if order is None else order, *keys)
    return one.unionByName(old.join(new.select(*keys).distinct(), list(keys), "left_anti"))


def upsert_keeping(old: DataFrame, new: DataFrame, keep: str, *keys: str, order=None) -> DataFrame:
    """As upsert, but where new has no value of `keep` the old one stays."""
    one = last_of(new, F.desc(F.xxhash64(*new.columns)) if order is None else order, *keys)
    joined = one.join(old.select(*keys, F.col(keep).alias("_old")), list(keys), "left").withColumn(keep, F.coalesce(keep, "_old")).select(*new.columns)
    return joined.unionByName(old.join(new.select(*keys).distinct(), list(keys), "left_anti"))


def first_listing(*sources: DataFrame) -> DataFrame:
    """Union of listings in order of priority: of an entity's rows the first source's stays."""
    from functools import reduce

    marked = [s.withColumn("_p", F.lit(i)) for i, s in enumerate(sources)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)
    return both.withColumn("_k", F.row_number().over(Window.partitionBy("entity").orderBy("_p"))).filter("_k = 1").drop("_k", "_p")
