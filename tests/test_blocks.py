"""Means, tops and deviations of trailing rows from blocks, beside frames that hold each row."""

import math

from pyspark.sql import functions as F

from sextant.functions.windows import mean_of, means, spread60, tops, trailing
from sextant.operators import features


def test_blocks_as_frames(spark):
    rows = [(e, i, None if (i * 7 + e) % 11 == 0 or (e == 3 and i < 70) else 50 + 20 * math.sin(i * 1.7 + e) + i % 5) for e in range(4) for i in range(230 if e else 3)]
    df = spark.createDataFrame(rows, "entity long, d int, x double")
    found = spread60(tops(means(df, "x"), "x"), "x")
    pairs = {f"_mean{w}": mean_of(F.col("x"), w) for w in (20, 50, 200)} | {f"_most{w}": F.max("x").over(trailing(w)) for w in (20, 60)}
    pairs |= {"_before20": F.max("x").over(trailing(20, -1)), "_spread60": F.stddev_samp("x").over(trailing(60))}
    assert set(found.columns) == {*df.columns, *pairs}
    got = found.withColumns({f"is{n}": c for n, c in pairs.items()}).collect()
    assert len(got) == len(rows)
    for r in got:
        for n in pairs:
            a, b = r[n], r[f"is{n}"]
            assert (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12)), (r.entity, r.d, n)


def test_scores_use_no_wide_frames(spark):
    """What scores need of an entity's rows holds no frame of more than 20 rows: each would add a row again for each later one."""
    df = spark.createDataFrame([(1, 1, 1.0, 1.0, 1.0, 1.0, 1.0)], "entity long, d int, open double, high double, low double, close double, volume double")
    out = features.setup(features.risk(features.trend(df))).select("SMA20", "SMA50", "SMA200", "volatility_60d", "ATR_pct", "near_60d_high", "failed_breakout_flag")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(f"RowFrame, -{n}, " in plan for n in (49, 59, 199))


def test_ends_of_a_bar(spark):
    """Open and close are the prices of the first and the last line; lines that stand at one place go by price."""
    from sextant.sources import bars

    lines = [(1, 5, 2.0, 9.0), (1, 5, 1.0, 3.0), (1, 6, 4.0, 5.0), (2, 1, 1.0, None)]
    df = spark.createDataFrame(lines, "entity long, at int, l_quantity double, price double").select("entity", F.lit(1).alias("d"), F.struct("at").alias("place"), "l_quantity", "price")
    found = bars._opened(df.groupBy("entity", "d").agg(*bars._ends())).orderBy("entity").collect()
    assert [tuple(r) for r in found] == [(1, 1, 3.0, 9.0, 3.0, 5.0, 7.0), (2, 1, None, None, None, None, 1.0)]
