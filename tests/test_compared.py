"""Out-of-sample comparison by date against brute force, and tables that are stored as they were dealt."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sextant.operators import reports, walkforward
from sextant.sources.store import dealt

NAMES, TARGETS = ("a", "b"), {5: "future_excess_return_5d", 20: "future_excess_return_20d"}
FITS = [(5, 1, dt.date(2024, 1, 1), dt.date(2024, 1, 2)), (5, 2, dt.date(2024, 1, 3), dt.date(2024, 1, 3)), (20, 1, dt.date(2024, 1, 2), dt.date(2024, 1, 4))]
WEIGHTS = {"one": {(5, 1): [0.25, 0.75], (5, 2): [0.0, 1.0], (20, 1): [1.0, -1.0]}, "none": {(5, 1): [0.0, 0.0]}}


@pytest.fixture(scope="module")
def rows(spark):
    rng, out = random.Random(5), []
    some = lambda p, x: None if rng.random() < p else x
    for k in range(5):
        for e in range(20 if k == 3 else 60):
            out.append((dt.date(2024, 1, 1 + k), e, some(0.1, float(rng.randrange(4))), some(0.2, rng.random()), 50.0 if k == 1 else some(0.1, rng.random()), some(0.1, rng.random()), some(0.1, rng.random()), some(0.3, float(rng.randrange(3)))))
    return spark.createDataFrame(out, "d date, entity long, a double, b double, score_5d double, score_20d double, future_excess_return_5d double, future_excess_return_20d double")


def graded(day):
    """spread, top10 and IC of a day's score and excess."""
    n, desc = len(day), day.score.rank(ascending=False)
    decile = np.clip(np.ceil((desc / n * 10).round(9)), 1, 10)
    differ = day.score.nunique() > 1
    ic = np.corrcoef(day.score.rank(), day.excess.rank())[0, 1] if differ else None
    spread = day.excess[decile == 1].mean() - day.excess[decile == 10].mean()
    return None if not differ or np.isnan(spread) else spread, day.excess[day.score.rank(ascending=False, method="min") <= 10].mean() if differ else None, ic


def test_compared_days_are_brute_force(rows):
    vectors = {v: {k: np.array(w) for k, w in by.items()} for v, by in WEIGHTS.items()}
    got = {(r.horizon, r.variant, r.d): r for r in reports.compared_days(rows, NAMES, FITS, vectors, ["a"], TARGETS, 30).collect()}
    df, want = rows.toPandas(), {}
    for h, fit, start, end in FITS:
        for d in sorted(df.d.unique()):
            day = df[df.d == d]
            for v in (*WEIGHTS, "config"):
                score = day[f"score_{h}d"]
                if v != "config":
                    w = dict(zip(NAMES, np.maximum(WEIGHTS[v].get((h, fit), [0, 0]), 0), strict=True))
                    whole = sum(w[n] * day[n].notna() for n in NAMES)
                    score = (sum(w[n] * day[n].fillna(0) for n in NAMES) / whole.where(whole > 0)).where(day.a.notna() | (w["a"] == 0))
                found = pd.DataFrame({"score": score.astype(float).round(9), "excess": day[TARGETS[h]].astype(float)}).dropna()
                if start <= d <= end and len(found) >= 30:
                    want[h, v, d] = graded(found)
    assert set(got) == set(want) and len({k[2] for k in want}) == 3 and (20, "none", dt.date(2024, 1, 2)) not in want
    for k, told in want.items():
        for x, y in zip(told, (got[k].spread, got[k].top10, got[k].ic), strict=True):
            assert (x is None and y is None) or y == pytest.approx(x, abs=1e-9)
    assert got[5, "config", dt.date(2024, 1, 2)].ic is None and got[5, "config", dt.date(2024, 1, 2)].top10 is None


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_table_stored_as_dealt_needs_no_exchange(spark, rows):
    """Neither its write after an exchange by date nor daily ICs, moments and comparisons of it, and nothing is lost."""
    stored = dealt(rows.repartition("d"), "dates", "d")
    assert sorted(map(tuple, stored.collect()), key=repr) == sorted(map(tuple, rows.collect()), key=repr)
    sets, ics = [["a"], ["a", "b"]], reports.daily_ic(stored, NAMES, (5, 20), 5)
    for df in (ics, walkforward.daily_moments(stored, list(NAMES), TARGETS, sets), reports.compared_days(stored, NAMES, FITS, {}, ["a"], TARGETS)):
        assert "Exchange" not in _plan(df) and df.count() > 0
    key = ["series", "horizon", "d"]
    plain = reports.daily_ic(rows, NAMES, (5, 20), 5)
    assert ics.select(*key, F.round("spearman_ic", 9)).exceptAll(plain.select(*key, F.round("spearman_ic", 9))).count() == 0


def test_vectors_follow_the_names(spark):
    weights = spark.createDataFrame([(5, 1, "b", 0.75), (5, 2, "a", 0.25)], "horizon int, fit int, series string, weight double")
    assert {k: v.tolist() for k, v in walkforward.vectors(weights, list(NAMES)).items()} == {(5, 1): [0.0, 0.75], (5, 2): [0.25, 0.0]}


def test_composites_read_a_table_stored_by_date(spark, sf_dir, monkeypatch):
    """The query's ICs take no exchange, and its table has no columns that it doesn't read."""
    from sextant.plans import research

    seen, real = [], reports.daily_ic
    monkeypatch.setattr(research.reports, "daily_ic", lambda df, *more: (seen.append((df, real(df, *more))), seen[0][1])[1])
    research.walk_forward_composite(spark, sf_dir)
    df, ics = seen[0]
    assert "Exchange" not in _plan(ics)
    assert set(df.columns) == {"d", "entity", "stale", *research.NAMES, *research._TARGETS.values()}
