"""What pooled ICs put on disk, and those of the newest days."""

import time

from pyspark.sql import functions as F


def _cube(spark, n):
    mixed = lambda k: (F.xxhash64("id", F.lit(k)) % 1_000_003) / 1_000_003.0
    there = lambda x, k: F.when(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(10)) > 0, x)
    day = F.expr("DATE'2020-01-01' + CAST(id DIV 100 AS INT)")
    return spark.range(n).select(F.col("id").alias("entity"), day.alias("d"), mixed(1).alias("a"), there(mixed(2), 3).alias("b"), there(mixed(4), 5).alias("future_excess_return_5d"), there(mixed(6), 7).alias("future_excess_return_20d"), (F.col("id") % 700 < 300).cast("int").alias("old"))


def _dealt(spark):
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def test_a_cell_is_dealt_in_a_few_bytes(spark):
    """No more goes through shuffles than the values themselves and as much again for places and ranks."""
    from sextant.operators import reports

    n = 200_000
    cube = _cube(spark, n).coalesce(2)
    before = _dealt(spark)
    assert reports.pooled_ic(cube, ("a", "b"), (5, 20)).count() == 4
    assert _dealt(spark) - before < 16 * 4 * n


def test_shuffle_files_go_when_a_table_is_written(spark):
    from sextant.sources.store import written

    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        names = disk.getAllFiles()
        return {names.apply(i).getName() for i in range(names.size())}

    before = files()
    found = written(spark.range(100_000).repartition(3, "id"), "swept")
    for _ in range(50):
        left = {f for f in files() - before if f.startswith("shuffle_")}
        if not left:
            break
        time.sleep(0.2)
    assert not left and found.count() == 100_000


def test_newest_live_days_are_brute_force(spark):
    """A day counts as live if any of its rows is, and then with all of them."""
    from sextant.operators import reports

    cube = _cube(spark, 3000).repartition(3, "d")
    days = sorted({r.d for r in cube.filter("old = 0").select("d").distinct().collect()})[-6:]
    only = cube.filter(F.col("d").isin(days))
    full, recent = reports.pooled_ics(cube, ("a", "b"), (5, 20), 6, "old = 0")
    told = lambda df: sorted((r.series, r.horizon, r.n, round(r.pearson_ic, 9), round(r.spearman_ic, 9)) for r in df.collect())
    assert told(recent) == told(reports.pooled_ic(only, ("a", "b"), (5, 20))) and len(told(recent)) == 4
    assert told(full) == told(reports.pooled_ic(cube, ("a", "b"), (5, 20)))
