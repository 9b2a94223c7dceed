"""Aggregates of filings and trades as known on a date: past a source's coverage they are unknown, not zero."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant import config as C
from sextant.functions.scalar import is_material, items


def event_features(probes: DataFrame, events: DataFrame, first, last) -> DataFrame:
    """(entity, d) with counts of each item group in each window of days, and the days since the last material and
    earnings event. Outside [first, last] of the coverage all of it is NULL and `coverage_missing` says so."""
    flagged = events.withColumns({"_material": is_material(F.col("items")).cast("int"), **{f"_{g}": F.arrays_overlap(items(F.col("items")), F.array(*[F.lit(c) for c in codes])).cast("int") for g, codes in C.EVENT_GROUPS.items()}})
    groups = ["material", *C.EVENT_GROUPS]
    left = probes.select("entity", "d").withColumn("_side", F.lit(1))
    right = flagged.select("entity", F.col("effective").alias("d"), *[f"_{g}" for g in groups]).withColumn("_side", F.lit(0))
    both = left.unionByName(right, allowMissingColumns=True)
    day = Window.partitionBy("entity").orderBy(F.unix_date("d"))
    cols = {f"{g}_{w}d": F.coalesce(F.sum(f"_{g}").over(day.rangeBetween(-w, 0)), F.lit(0)) for g in groups for w in C.EVENT_WINDOWS}
    since = {f"days_since_{g}": F.datediff("d", F.max(F.when(F.col(f"_{g}") == 1, F.col("d"))).over(day.rangeBetween(Window.unboundedPreceding, 0))) for g in ("material", "earnings")}
    covered = F.col("d").between(first, last)
    out = both.withColumns(cols | since).filter("_side = 1")
    return out.select("entity", "d", *[F.when(covered, F.col(c)).alias(c) for c in (*cols, *since)], (~covered).alias("coverage_missing"))


def trade_features(probes: DataFrame, trades: DataFrame, days: int = 90) -> DataFrame:
    """(entity, d) with counts and values of the distinct trades filed within the window up to d.

    A trade is its entity, date, code, shares and price, NULLs being equal: filed twice it counts once, after the
    window is applied, as its first filing. Values that are NULL count as 0 in sums. Only direct trades count.

    Time is cut into stretches as long as the window, so a probe meets the trades of two stretches and no others. A filing
    counts for the probes up to the window's end that the filing before it, of the same trade, doesn't reach; so trades
    are ordered once, and what they have in common with probes is only summed up."""
    stretch = lambda c: F.floor(F.unix_date(c) / (days + 1))
    direct = trades.filter("table_kind = 'nonderiv'").withColumn("_stretch", stretch(F.col("filed_date")))
    asked = probes.select("entity", "d", F.explode(F.array(stretch(F.col("d")), stretch(F.col("d")) - 1)).alias("_stretch"))
    filings = Window.partitionBy("entity", "trans_date", "trans_code", "shares", "price_per_share").orderBy("filed_date", "accession")
    since = F.greatest("filed_date", F.date_add(F.lag("filed_date").over(filings), days + 1))
    counted = direct.filter("filed_date IS NOT NULL").withColumn("_since", since)
    once = asked.join(counted, ["entity", "_stretch"]).filter(F.col("d").between(F.col("_since"), F.date_add("filed_date", days)))
    buy, sell = F.col("trans_code") == "P", F.col("trans_code") == "S"
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    value = lambda c: F.coalesce(F.sum(F.when(c, F.coalesce("value_usd", F.lit(0.0)))), F.lit(0.0))
    found = once.groupBy("entity", "d").agg(
        n(buy).alias("buy_count"), n(sell).alias("sell_count"), value(buy).alias("buy_value"), (value(buy) - value(sell)).alias("net_buy_value"),
        F.count_distinct(F.when(buy, F.coalesce(F.col("owner").cast("string"), F.lit("")))).alias("buyer_count"), n(buy & F.col("is_officer")).alias("officer_buy_count"), F.max(F.when(buy, F.col("filed_date"))).alias("_last"),
    )
    out = probes.select("entity", "d").join(found, ["entity", "d"], "left")
    filled = {c: F.coalesce(c, F.lit(0)) for c in ("buy_count", "sell_count", "buyer_count", "officer_buy_count")} | {c: F.coalesce(c, F.lit(0.0)) for c in ("buy_value", "net_buy_value")}
    return out.withColumns(filled).withColumn("days_since_buy", F.datediff("d", "_last")).drop("_last")


def owners(rows: DataFrame, order: str = "owner") -> DataFrame:
    """One row an accession, whose owners' shares are counted once: flags of all owners together, their ids joined by
    commas, names and titles by bars, in order, cut at 300 and 200 characters, and their different relationships.

    An owner that is listed twice stands there twice. Owners without a title leave no gap."""
    have = [c for c in ("is_officer", "is_director", "is_ten_pct_owner") if c in rows.columns]
    title = F.nullif(F.trim("owner_title"), F.lit("")) if "owner_title" in rows.columns else F.lit(None).cast("string")
    each = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col("owner").cast("string").alias("owner"), "owner_name", title.alias("title"))))
    found = rows.groupBy("accession").agg(*[F.max(c).alias(c) for c in have], each.alias("o"), F.array_sort(F.collect_set("relationship")).alias("relationships"))
    join = lambda f, by: F.array_join(F.transform("o", lambda x: x[f]), by)
    return found.select("accession", *have, join("owner", ",").alias("owner_ids"), F.substring(join("owner_name", " | "), 1, 300).alias("owner_names"), F.substring(join("title", " | "), 1, 200).alias("owner_titles"), F.array_join("relationships", ",").alias("relationships"))


def signal_ic(df: DataFrame, signal: str, excess: str, least: int = C.DECILE_MIN_NAMES, kinds: int = 2) -> DataFrame:
    """By day: rank correlation of a signal with the excess that followed, where `least` names have both and the signal
    takes `kinds` different values."""
    from sextant.functions.stats import spearman

    full = df.filter(F.col(signal).isNotNull() & F.col(excess).isNotNull())
    varied = full.groupBy("d").agg(F.count_distinct(signal).alias("_kinds")).filter(F.col("_kinds") >= kinds).select("d")
    return spearman(full.join(varied, "d", "left_semi"), signal, excess, "d", least=least)


def day_spread(df: DataFrame, flag: str, excess: str, min_events: int = 3, min_controls: int = C.DECILE_MIN_NAMES) -> DataFrame:
    """By day: mean excess with the event less mean without, where there are enough of both."""
    has = F.col(flag) > 0
    daily = df.filter(F.col(excess).isNotNull() & F.col(flag).isNotNull()).groupBy("d").agg(
        F.sum(has.cast("int")).alias("n_events"), F.sum((~has).cast("int")).alias("n_controls"), (F.avg(F.when(has, F.col(excess))) - F.avg(F.when(~has, F.col(excess)))).alias("spread"), (F.avg(F.when(has, (F.col(excess) > 0).cast("double"))) * 100).alias("hit_pct")
    )
    return daily.filter((F.col("n_events") >= min_events) & (F.col("n_controls") >= min_controls))
