"""Queries of runs and streams: a backfill by its ledger, outcomes that mature on a stream, late files and their repair."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions.scalar import rounded
from sextant.operators import features, forward
from sextant.plans import oracle as O
from sextant.plans import runs
from sextant.sources.bars import bars
from sextant.sources.store import shared_dir, written
from sextant.streaming import ingest, maturity

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    """Registers a query, and the SQL that gives its rows."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("backfill_ledger", f"WITH {O.SCORES}, {O.MARKET}, n AS (SELECT d, count(*) AS n FROM scored GROUP BY 1) SELECT market.d, 'done' AS state, coalesce(n, 0) AS rows FROM market LEFT JOIN n USING (d)")
def backfill_ledger(spark, sf_dir):
    """A backfill of the whole history in groups of sessions, as its ledger tells it."""
    path = _place(spark, "backfill")
    runs.run_backfill(spark, sf_dir, path, "v1", group=200)
    return runs.ledger(spark, f"{path}-ledger").read().select("d", "state", "rows")


def slices(df: DataFrame, n: int) -> list[DataFrame]:
    """df cut into n stretches of time, each with about as many days as the others."""
    first, last = df.agg(F.min("d"), F.max("d")).first()
    days = F.datediff("d", F.lit(first)) * n / ((last - first).days + 1)
    return [df.filter(F.floor(days) == i) for i in range(n)]


def fed(parts: list[DataFrame], path: str, run) -> None:
    """Writes parts to a folder one after the other, and calls run(stream of the folder) after each: one micro-batch a part."""
    spark, schema = parts[0].sparkSession, parts[0].schema
    for n, part in enumerate(parts):
        part.write.parquet(f"{path}/{n:04d}")
        run(spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(path)).awaitTermination()


_HS = forward.HORIZONS
_STREAM = " UNION ALL ".join(f"SELECT entity, d, {h} AS horizon, return_20d AS score, lead(close, {h}) OVER w / close - 1 AS future_return, lead(d, {h}) OVER w AS matured_on FROM own WINDOW w AS (PARTITION BY entity ORDER BY d)" for h in _HS)


@query("matured_stream", f"WITH {O.FEATURES}, m AS ({_STREAM}) SELECT entity, d, horizon, round(score, 6) AS score, round(future_return, 6) AS future_return, matured_on FROM m WHERE matured_on IS NOT NULL")
def matured_stream(spark, sf_dir):
    """Scores that wait on a stream for their outcomes, over four micro-batches: the rows of a batch with leads."""
    own = written(features.returns(bars(spark, sf_dir)).select("entity", "d", "close", F.col("return_20d").alias("score")), "scored-bars")
    path = _place(spark, "matured")

    def run(stream):
        found = maturity.matured(stream, _HS)
        return found.writeStream.foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{path}/out/batch={n}")).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()

    fed(slices(own, 4), f"{path}/in", run)
    return rounded(spark.read.schema(maturity.MATURED).option("recursiveFileLookup", True).parquet(f"{path}/out"))


@query("late_rows_repaired", f"WITH {O.BARS} SELECT entity, d, {O.r6('open', 'high', 'low', 'close', 'volume')} FROM bars")
def late_rows_repaired(spark, sf_dir):
    """Bars that come in four files, with rows missing from the first that come last, and a file that comes twice: after
    the repair, the rows of the batch."""
    own = written(bars(spark, sf_dir), "bars")
    path = _place(spark, "ingest")
    late = (F.col("entity") + F.weekofyear("d")) % 7 == 0
    first, second, third = slices(own, 3)
    fed([first.filter(~late), second, second, third, first.filter(late)], f"{path}/in", lambda stream: ingest.ingest(stream, path))
    ingest.repair(spark, path)
    return rounded(ingest.store_of(spark, path).read().select(*own.columns))
