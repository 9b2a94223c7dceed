"""Extremes and falls of long spans from those of short blocks."""

from __future__ import annotations

import random
from datetime import date, timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from sextant.functions.windows import far, spans
from sextant.operators import forward


def fall(xs) -> float:
    peak, out = float("-inf"), 0.0
    for x in xs:
        peak = max(peak, x)
        out = max(out, (peak - x) / peak * 100)
    return out


def test_spans_equal_brute_force_and_need_no_long_frame(spark):
    rng, rows, closes = random.Random(3), [], {}
    for e, n in ((1, 400), (2, 61), (3, 7), (4, 200)):
        closes[e] = [1.0 + (rng.randrange(8) if e == 4 else 50 * rng.random()) for _ in range(n)]
        rows += [(e, date(2020, 1, 1) + timedelta(days=i), x) for i, x in enumerate(closes[e])]
    bars = spark.createDataFrame(rows, "entity long, d date, close double")
    long = spans(bars, "close").withColumns({"top252": far("_top60", 252, 60, F.greatest), "low252": far("_low60", 252, 60, F.least)})
    long = long.withColumn("_closes", F.count("close").over(Window.partitionBy("entity").orderBy("d")))
    found = long.withColumns({f"after{n}": forward.drawdown_after(n) for n in (20, 60)})
    told = found._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in told and not any(f"ROWS, -{n}, currentrow" in told or f"RowFrame, -{n}, currentrow" in told for n in (19, 59, 251))
    for r in found.collect():
        xs, i = closes[r["entity"]], (r["d"] - date(2020, 1, 1)).days
        past = lambda n: xs[max(0, i - n + 1) : i + 1]  # noqa: E731,B023
        for n in (20, 60):
            assert (r[f"_top{n}"], r[f"_low{n}"], r[f"_fall{n}"]) == (max(past(n)), min(past(n)), fall(past(n)))
            ahead = xs[i : i + n + 1]
            assert r[f"after{n}"] == (fall(ahead) if len(ahead) == n + 1 else None)
        assert (r["top252"], r["low252"]) == (max(past(252)), min(past(252)))
