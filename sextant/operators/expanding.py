"""Order statistics of an entity's history so far, in n log n: counts over halves of time, and descents by rank.

An expanding list would hold the history once for every row of it. Here a row meets, at each doubling of its block of
time, the rows of the half before its own, and a quantile is found by halving the range of ranks; only `block` values
are ever put into an array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.sources.store import written

BLOCK = 64


def _numbered(df: DataFrame, x: str) -> DataFrame:
    """(entity, d, _x, _seq): the values that are there, numbered from 0 in each entity's order of time."""
    time = Window.partitionBy("entity").orderBy("d")
    return df.filter(F.col(x).isNotNull()).select("entity", "d", F.col(x).cast("double").alias("_x")).withColumn("_seq", (F.row_number().over(time) - 1).cast("long"))


def below_so_far(df: DataFrame, x: str, block: int = BLOCK) -> DataFrame:
    """(entity, d, n, below): of the entity's values up to this one, how many there are and how many are smaller.

    Rows whose x is NULL have no row here. Time is cut into blocks. Within its own a row is compared one by one; and at
    each level, blocks being paired, then pairs, and so on, a row of the right half counts the smaller ones of the left:
    together these halves are all blocks before its own. Each level is one entry a row, sorted by value."""
    rows = written(_numbered(df, x).withColumn("_block", F.expr(f"_seq div {block}")), "expanding")
    near = Window.partitionBy("entity", "_block").orderBy("_seq").rowsBetween(Window.unboundedPreceding, 0)
    here = rows.select("entity", "d", (F.col("_seq") + 1).alias("n"), F.size(F.filter(F.collect_list("_x").over(near), lambda v: v < F.col("_x"))).cast("long").alias("below"))
    last = rows.groupBy("entity").agg(F.max("_block").alias("_last")).filter("_last > 0")
    levels = F.sequence(F.lit(0), F.ceil(F.log2(F.col("_last") + 1)).cast("int") - 1)
    spread = rows.join(last, "entity").select("entity", "d", "_x", "_block", F.explode(levels).alias("_level"))
    half = F.expr("shiftright(_block, _level)")
    spread = spread.select("entity", "d", "_x", "_level", F.shiftright(half, 1).alias("_pair"), (half % 2 == 1).alias("_right"))
    by = Window.partitionBy("entity", "_level", "_pair").orderBy("_x", F.desc("_right")).rowsBetween(Window.unboundedPreceding, 0)
    before = spread.withColumn("below", F.sum((~F.col("_right")).cast("long")).over(by)).filter("_right").select("entity", "d", F.lit(None).cast("long").alias("n"), "below")
    return here.unionByName(before).groupBy("entity", "d").agg(F.max("n").alias("n"), F.sum("below").alias("below"))


def share_below_so_far(df: DataFrame, x: str, least: int, out: str, block: int = BLOCK) -> DataFrame:
    """df with `out`: the percentage of the values so far that are smaller; NULL with fewer than `least` of them."""
    found = below_so_far(df, x, block).select("entity", "d", F.when(F.col("n") >= least, F.col("below") / F.col("n") * 100).alias(out))
    return df.join(found, ["entity", "d"], "left")


def quantile_so_far(df: DataFrame, x: str, q: float, least: int, out: str, block: int = BLOCK) -> DataFrame:
    """df with `out`: the q-quantile, interpolated, of the values so far; NULL with fewer than `least` of them.

    A row whose x is NULL has that of the row before it. Values are ranked over the whole history; a row looks for the
    k-th of those that came up to it: at each level its range of ranks is halved, and the values up to then in the lower
    half are counted, until the range has `block` ranks, which are looked through."""
    rows = _numbered(df, x)
    rows = written(rows.withColumn("_rank", (F.row_number().over(Window.partitionBy("entity").orderBy("_x", "_seq")) - 1).cast("long")), "ranked")
    top, low = rows.agg(F.max("_rank")).first()[0] or 0, (block - 1).bit_length()
    at = F.col("_seq") * q
    asks = rows.filter(F.col("_seq") + 1 >= least).select("entity", "_seq", F.explode(F.array_distinct(F.array(F.floor(at), F.ceil(at)))).alias("_k"))
    asks = asks.withColumns({"_want": F.col("_k"), "_node": F.lit(0).cast("long")})
    for level in range(int(top).bit_length() - 1, low - 1, -1):
        data = rows.select("entity", "_seq", F.shiftright("_rank", level + 1).alias("_node"), (F.shiftright("_rank", level) % 2 == 0).cast("long").alias("_lower"))
        by = Window.partitionBy("entity", "_node").orderBy("_seq", F.col("_k").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
        both = asks.unionByName(data, allowMissingColumns=True).withColumn("_count", F.sum(F.coalesce("_lower", F.lit(0))).over(by)).filter("_k IS NOT NULL")
        left = F.col("_want") < F.col("_count")
        asks = both.select("entity", "_seq", "_k", F.when(left, F.col("_want")).otherwise(F.col("_want") - F.col("_count")).alias("_want"), (F.col("_node") * 2 + F.when(left, 0).otherwise(1)).alias("_node"))
    bits = max(min(low, int(top).bit_length()), 0)
    ranges = rows.groupBy("entity", F.shiftright("_rank", bits).alias("_node")).agg(F.array_sort(F.collect_list(F.struct("_rank", "_seq", "_x"))).alias("_values"))
    upto = F.filter("_values", lambda v: v["_seq"] <= F.col("_seq"))
    found = asks.join(ranges, ["entity", "_node"]).select("entity", "_seq", "_k", F.get(upto, F.col("_want").cast("int"))["_x"].alias("_v"))
    share = F.when(F.floor(at) == F.ceil(at), F.lit(1.0)).when(F.col("_k") == F.floor(at), F.ceil(at) - at).otherwise(at - F.floor(at))
    bound = found.groupBy("entity", "_seq").agg(F.when(F.min("_v") == F.max("_v"), F.min("_v")).otherwise(F.sum(share * F.col("_v"))).alias(out))
    told = rows.join(bound, ["entity", "_seq"], "left").select("entity", "d", out)
    time = Window.partitionBy("entity").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    return df.join(told, ["entity", "d"], "left").withColumn(out, F.last(out, ignorenulls=True).over(time))


def extreme_so_far(df: DataFrame, x: str, q: float, least: int, out: str, high: bool = True) -> DataFrame:
    """df with `out`: whether x is at or beyond its own quantile so far; false before there is history enough."""
    bound = quantile_so_far(df, x, 1 - q if high else q, least, "_bound")
    value: Column = F.col(x)
    return bound.withColumn(out, F.coalesce((value >= F.col("_bound")) if high else (value <= F.col("_bound")), F.lit(False))).drop("_bound")
