"""Order statistics of the history so far against plain lists."""

import datetime as dt

import numpy as np
import pytest

from sextant.operators import expanding


@pytest.fixture(scope="module")
def history(spark):
    """Histories of many lengths, with gaps, ties, and one entity that has most rows; entity 7 has no value at all."""
    rng = np.random.default_rng(4)
    rows = []
    for entity, n in ((1, 1), (2, 2), (3, 63), (4, 64), (5, 65), (6, 700), (7, 5)):
        for i in range(n):
            x = None if entity == 7 or (entity > 2 and rng.random() < 0.1) else float(rng.integers(0, 40) if entity != 4 else rng.normal())
            rows.append((entity, dt.date(2020, 1, 1) + dt.timedelta(i), x))
    return rows, spark.createDataFrame(rows, "entity long, d date, x double").repartition(3)


@pytest.mark.parametrize("block", [1, 4, 64])
def test_shares_and_quantiles(history, block):
    rows, df = history
    shares = {(r.entity, r.d): r.share for r in expanding.share_below_so_far(df, "x", 3, "share", block).collect()}
    bounds = {(r.entity, r.d): r.bound for r in expanding.quantile_so_far(df, "x", 0.9, 5, "bound", block).collect()}
    assert len(shares) == len(bounds) == len(rows)
    past = {}
    for entity, d, x in rows:
        seen = past.setdefault(entity, [])
        if x is not None:
            seen.append(x)
        want = None if x is None or len(seen) < 3 else sum(v < x for v in seen) / len(seen) * 100
        assert shares[entity, d] == (want if want is None else pytest.approx(want)), (entity, d)
        want = None if len(seen) < 5 else np.quantile(seen, 0.9)
        assert bounds[entity, d] == (want if want is None else pytest.approx(want)), (entity, d)


def test_no_array_holds_a_history(history):
    """Lists are made of a block at the most: what is collected is grouped by block or by range of ranks."""
    _, df = history
    for found in (expanding.below_so_far(df, "x"), expanding.quantile_so_far(df, "x", 0.5, 1, "q")):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        lists = [line for line in plan.split("\n") if "collect_list" in line]
        assert lists and all("_block" in line or "_node" in line for line in lists)


def test_extremes_and_nothing(spark, history):
    _, df = history
    low = expanding.extreme_so_far(df.filter("entity = 6"), "x", 0.1, 10, "low", high=False).orderBy("d").collect()
    assert not any(r.low for r in low[:9]) and any(r.low for r in low) and all(not r.low for r in low if r.x is None)
    none = df.limit(0)
    assert expanding.share_below_so_far(none, "x", 1, "s").count() == 0 and expanding.quantile_so_far(none, "x", 0.5, 1, "q").count() == 0
