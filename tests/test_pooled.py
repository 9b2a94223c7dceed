"""Pooled ICs against brute force, and what they deal."""

import numpy as np
import pandas as pd


def _rows(n):
    rng = np.random.default_rng(3)
    x = {"a": rng.normal(size=n), "b": np.round(rng.normal(size=n)), "c": np.full(n, 2.0), "future_excess_return_5d": rng.normal(size=n), "future_excess_return_20d": np.round(rng.normal(size=n), 1)}
    x["future_excess_return_5d"] += x["a"]
    there = {c: rng.random(n) < 0.9 for c in x}
    return x, there


def _frame(spark, x, there, n):
    rows = [(i, *[float(x[c][i]) if there[c][i] else None for c in x]) for i in range(n)]
    return spark.createDataFrame(rows, "entity long, " + ", ".join(f"{c} double" for c in x)).selectExpr("*", "DATE'2020-01-01' + CAST(entity % 50 AS INT) AS d").repartition(7, "entity")


def test_pooled_ic_is_brute_force(spark, monkeypatch):
    from sextant.operators import pooled, reports

    monkeypatch.setattr(pooled, "_STRIPE", 100)
    x, there = _rows(3000)
    got = {(r.series, r.horizon): r for r in reports.pooled_ic(_frame(spark, x, there, 3000), ("a", "b", "c"), (5, 20)).collect()}
    assert len(got) == 6
    for name in "abc":
        for h in (5, 20):
            y = f"future_excess_return_{h}d"
            both, r = there[name] & there[y], got[name, h]
            assert r.n == both.sum()
            if name == "c":
                assert r.pearson_ic is None and r.spearman_ic is None
                continue
            v, w = x[name][both], x[y][both]
            assert abs(r.pearson_ic - np.corrcoef(v, w)[0, 1]) < 1e-9
            assert abs(r.spearman_ic - np.corrcoef(pd.Series(v).rank(), pd.Series(w).rank())[0, 1]) < 1e-9


def test_pooled_ic_makes_no_row_a_pair(spark):
    """No step deals a row for each name, date, component and horizon."""
    from sextant.operators import reports

    x, there = _rows(200)
    plan = reports.pooled_ic(_frame(spark, x, there, 200), ("a", "b", "c"), (5, 20))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan


def test_pooled_ic_of_nothing(spark):
    from sextant.operators import reports

    x, there = _rows(4)
    assert reports.pooled_ic(_frame(spark, x, there, 4), ("a",), (5,)).count() == 0
    assert reports.pooled_ic(_frame(spark, x, there, 4).filter("entity < 0"), ("a",), (5,)).count() == 0
