"""Point-in-time joins: the newest row up to a date, with staleness limits; rolls to sessions; events in a window.

A backward as-of join is a union of both sides and a last-non-null over each entity's time order: linear after one
exchange, where a range join would compare every pair of an entity's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def backward(probes: DataFrame, facts: DataFrame, key: str, at: str, fact_at: str, values: list[str], tie: list[str] | None = None, bucket: str | None = None) -> DataFrame:
    """probes with, from the newest fact of the key dated at or before the probe, `values` and the fact's date.

    Facts of one date: the last by `tie`. Without such a fact the values are NULL. With a `bucket` ("year", "month") a
    key's time is cut into these: each is one task's work, and the last fact before it is handed on, so few keys with
    long histories still fill many tasks."""
    payload = F.struct(F.col(fact_at).alias("_fact_at"), *values)
    order = F.concat_ws("|", *[F.lpad(F.col(c).cast("string"), 24, "0") for c in tie]) if tie else F.lit("")
    cut = (lambda c: F.trunc(c, bucket)) if bucket else (lambda c: F.lit(None).cast("date"))
    left = probes.withColumn("_when", F.col(at)).withColumn("_side", F.lit(1)).withColumn("_fact", F.lit(None).cast(facts.select(payload.alias("x")).schema["x"].dataType)).withColumn("_tie", F.lit(None).cast("string"))
    right = facts.select(F.col(key), F.col(fact_at).alias("_when"), F.lit(0).alias("_side"), payload.alias("_fact"), order.alias("_tie"))
    by = Window.partitionBy(key, *(["_cut"] if bucket else [])).orderBy("_when", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right, allowMissingColumns=True).withColumn("_cut", cut(F.col("_when"))).withColumn("_last", F.last("_fact", ignorenulls=True).over(by)).filter("_side = 1")
    if bucket:
        ends = right.groupBy(key, cut(F.col("_when")).alias("_cut")).agg(F.max_by("_fact", F.struct("_when", "_tie")).alias("_end"))
        wanted = probes.select(key, cut(F.col(at)).alias("_cut")).distinct()
        before = Window.partitionBy(key).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
        handed = wanted.join(ends, [key, "_cut"], "full_outer").withColumn("_before", F.last("_end", ignorenulls=True).over(before)).select(key, "_cut", "_before")
        both = both.join(handed, [key, "_cut"], "left").withColumn("_last", F.coalesce("_last", "_before"))
    return both.select(*probes.columns, *[F.col(f"_last.{v}").alias(v) for v in values], F.col("_last._fact_at").alias(f"{fact_at}_asof"))


def fresh(value: Column, at: Column, found_at: Column, days: int) -> Column:
    """value unless it is older than `days`: it is not carried further."""
    return F.when(F.datediff(at, found_at) <= days, value)


def forward_roll(events: DataFrame, sessions: DataFrame, target: str, keep_early: bool = False) -> DataFrame:
    """events with `effective`: the first session on or after the target date; those past the last session go.

    Targets before the first session go too, unless keep_early, which rolls them onto it. Each date from one session to
    the next belongs to the next: the calendar, a few rows a session, is a table by date, and events join it by equality."""
    before = F.lag("d").over(Window.partitionBy(F.lit(0)).orderBy("d"))
    steps = sessions.select(F.col("d").alias("effective"), before.alias("_before"))
    dates = steps.select("effective", F.explode(F.sequence(F.coalesce(F.date_add("_before", 1), F.col("effective")), F.col("effective"))).alias("_date"))
    out = events.join(F.broadcast(dates), F.col(target) == F.col("_date"), "left")
    if keep_early:
        first = sessions.agg(F.min("d").alias("_first"))
        out = out.join(F.broadcast(first), F.lit(True)).withColumn("effective", F.when(F.col(target) < F.col("_first"), F.col("_first")).otherwise(F.col("effective")))
    return out.filter(F.col("effective").isNotNull()).select(*events.columns, "effective")


def after_close(stamp: Column, close_hour: int = 16) -> Column:
    """The date that a stamp counts for: its own, or the next from the closing hour on. No time zone is applied."""
    day = F.to_date(F.substring(stamp.cast("string"), 1, 10))
    return F.when(F.substring(stamp.cast("string"), 12, 2).cast("int") >= close_hour, F.date_add(day, 1)).otherwise(day)


def in_window(probes: DataFrame, events: DataFrame, key: str, at: str, event_at: str, days: int, aggregates: dict[str, Column]) -> DataFrame:
    """probes with aggregates over the key's events dated within `days` days up to the probe, both ends included.

    One union and one range frame for each entity; `aggregates` name columns of events, NULL on probe rows."""
    left = probes.withColumn("_when", F.col(at)).withColumn("_side", F.lit(1))
    right = events.withColumn("_when", F.col(event_at)).withColumn("_side", F.lit(0)).drop(at)
    by = Window.partitionBy(key).orderBy(F.unix_date("_when")).rangeBetween(-days, 0)
    both = left.unionByName(right, allowMissingColumns=True).withColumns({n: a.over(by) for n, a in aggregates.items()})
    return both.filter("_side = 1").select(*probes.columns, *aggregates)
