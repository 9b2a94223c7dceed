"""Weekly bars from the order lines: price of a line is its extended price over its quantity."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.sources.store import written

#: The order of lines within a bar; line numbers alone are not unique.
LINE_ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


_SCHEMAS: dict = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a data folder. Its schema is asked for once a process: that is a job of its own each time."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, sector, benchmark): a supplier, its region, and the region's index."""
    s, n, r = (read(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    joined = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.select(F.col("s_suppkey").cast("long").alias("entity"), F.col("r_name").alias("sector"), (-1 - F.col("r_regionkey")).cast("long").alias("benchmark"))


def lines(spark: SparkSession, sf_dir: str, since=None, until=None) -> DataFrame:
    """Order lines with price and week, of the weeks from `since` to `until` if given: a condition that reaches the files."""
    found = read(spark, sf_dir, "lineitem").filter("l_quantity > 0")
    if since is not None:
        found = found.filter(F.col("l_shipdate") >= F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        found = found.filter(F.col("l_shipdate") < F.lit(until + timedelta(days=7)).cast("timestamp_ntz"))
    return found.select(
        "l_suppkey", "l_quantity", F.to_date(F.date_trunc("week", "l_shipdate")).alias("d"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.struct(*LINE_ORDER).alias("place")
    )


def _ends():
    """What makes a bar of its lines: a line's place and price go together, so places are compared once for each end."""
    line = F.struct("place", "price")
    return F.min(line).alias("_a"), F.max(line).alias("_b"), F.max("price").alias("high"), F.min("price").alias("low"), F.sum("l_quantity").alias("volume")


def _opened(found: DataFrame, *more) -> DataFrame:
    return found.select("entity", "d", F.col("_a.price").alias("open"), "high", "low", F.col("_b.price").alias("close"), "volume", *more)


def bars(spark: SparkSession, sf_dir: str, level: str = "supplier", since=None, until=None) -> DataFrame:
    """(entity, d, open, high, low, close, volume): one row for each entity and week with a line, of some weeks if asked.

    Levels: supplier, region (entity -1 - key, the benchmarks) and all (entity 0, the market and its calendar). One
    shuffle by (entity, d), after partial aggregation."""
    found = lines(spark, sf_dir, since, until)
    if level == "supplier":
        found = found.withColumn("entity", F.col("l_suppkey").cast("long"))
    elif level == "region":
        found = found.join(watchlist(spark, sf_dir).select(F.col("entity").alias("l_suppkey"), "benchmark"), "l_suppkey").withColumn("entity", F.col("benchmark"))
    else:
        found = found.withColumn("entity", F.lit(0).cast("long"))
    return _opened(found.groupBy("entity", "d").agg(*_ends()))


def levels(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The bars of all levels by name, from one pass over the lines: a supplier's bars keep where their first and last
    line stand in the order, and the bars of its region and of the market are made of them. A bar has a line or two, so
    lines are dealt as they are: partial aggregates are as many rows, and wider."""
    found = lines(spark, sf_dir).withColumn("entity", F.col("l_suppkey").cast("long"))
    own = written(_opened(found.repartition("entity").groupBy("entity", "d").agg(*_ends()), F.col("_a.place").alias("_first"), F.col("_b.place").alias("_last")), "bars")
    merged = [F.min_by("open", "_first").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "_last").alias("close"), F.sum("volume").alias("volume")]
    region = own.join(watchlist(spark, sf_dir).select("entity", "benchmark"), "entity").groupBy(F.col("benchmark").alias("entity"), "d").agg(*merged)
    market = own.groupBy(F.lit(0).cast("long").alias("entity"), "d").agg(*merged)
    return {"supplier": own.drop("_first", "_last"), "region": region, "all": market}
