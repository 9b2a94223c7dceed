"""Ingest of bars by micro-batches: exactly once, late rows set aside, holes repaired, and a marker of what is complete."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.operators.quality import last_of
from sextant.sources.tables import Table


def store_of(spark: SparkSession, path: str) -> Table:
    """The ingested rows: one an entity and day, in parts by year."""
    return Table(spark, f"{path}/rows", ("entity", "d"), "year")


def aside_of(spark: SparkSession, path: str) -> Table:
    """Rows that came after their days were closed, waiting for a repair."""
    return Table(spark, f"{path}/late", ("entity", "d"), "year")


def _note(table: Table) -> dict:
    state = table.manifest()
    return state["note"] if state else {}


def covered_until(spark: SparkSession, path: str) -> date | None:
    """The marker: up to this day everything that came in time is stored. None before the first batch."""
    told = _note(store_of(spark, path)).get("until")
    return date.fromisoformat(told) if told else None


def covered(spark: SparkSession, path: str) -> DataFrame:
    """The rows up to the marker: what readers may count on."""
    return store_of(spark, path).read().filter(F.col("d") <= F.lit(covered_until(spark, path)))


def take(spark: SparkSession, path: str, batch: DataFrame, number: int, late: int) -> None:
    """Stores one micro-batch. The batch's number is committed with its rows, so a batch that comes again does nothing.

    A row dated more than `late` days before the newest day seen so far is late: it goes aside and doesn't touch what
    readers see. Rows that repeat a key replace it."""
    main, aside = store_of(spark, path), aside_of(spark, path)
    seen = _note(main)
    if seen.get("batch", -1) >= number:
        return
    rows = batch.withColumn("year", F.year("d").cast("string"))
    newest = rows.agg(F.max("d")).first()[0]
    if newest is None:
        return
    closed = date.fromisoformat(seen["until"]) if seen else date.min
    if seen:
        behind = rows.filter(F.col("d") <= F.lit(closed))
        if behind.limit(1).count() and _note(aside).get("batch", -1) < number:
            aside.upsert(behind, note={"batch": number})
        rows = rows.filter(F.col("d") > F.lit(closed))
    until = max(closed, newest - timedelta(days=late))
    main.upsert(rows, note={"batch": number, "until": str(until)})


def ingest(stream: DataFrame, path: str, late: int = 7):
    """Runs `take` for all that the stream has now, and gives the query; the checkpoint is beside the rows."""
    spark = stream.sparkSession
    writer = stream.writeStream.foreachBatch(lambda batch, number: take(spark, path, batch, number, late))
    return writer.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()


def repair(spark: SparkSession, path: str) -> int:
    """Puts late rows where there is no row of their entity and day, empties what was set aside, and gives how many they
    were. Stored rows are not replaced, and parts without a hole are not written."""
    main, aside = store_of(spark, path), aside_of(spark, path)
    waiting = aside.read()
    if waiting is None:
        return 0
    years = [r[0] for r in waiting.select("year").distinct().collect()]
    if not years:
        return 0
    holes = last_of(waiting, F.col("d"), "entity", "d").join(main.read(parts=years).select("entity", "d"), ["entity", "d"], "left_anti")
    n = holes.count()
    if n:
        main.upsert(holes, note=_note(main))
    aside.replace(waiting.limit(0), note=_note(aside), drop=years)
    return n
