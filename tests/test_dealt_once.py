"""Cross-sections of a date are dealt once: coefficients, regression rows and scores by columns, not by exploded rows."""

from __future__ import annotations

import random
from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sextant.operators import ranking, reports, walkforward
from sextant.plans import core, dated
from tests import compare


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def panel(spark):
    rng, rows = random.Random(5), []
    some = lambda p, x: None if rng.random() < p else x
    for k in range(3):
        for e in range(40):
            rows.append((date(2024, 1, 1 + k), e, "north" if e % 2 else "south", some(0.2, float(rng.randrange(5))), some(0.1, rng.random()), 7.1, some(0.3, rng.random()), some(0.1, float(rng.randrange(3))), e % 4 == 0))
    return spark.createDataFrame(rows, "d date, entity long, sector string, a double, value_component double, c double, future_excess_return_5d double, future_excess_return_20d double, stale boolean")


@pytest.mark.parametrize("by", [(), ("sector",)])
def test_daily_ic_is_dealt_once_and_equals_brute_force(panel, by):
    found = reports.daily_ic(panel, ("a", "value_component", "c"), (5, 20), 5, by)
    assert "Generate" not in plan(found) and plan(found).count("Exchange hashpartitioning") == 1
    got = {tuple(r[k] for k in (*by, "series", "horizon", "d")): r for r in found.collect()}
    rows, seen = panel.toPandas(), 0
    rows.loc[rows["stale"], "value_component"] = np.nan
    for key, day in rows.groupby([*by, "d"]):
        for s in ("a", "value_component", "c"):
            for h in (5, 20):
                both = day[[s, f"future_excess_return_{h}d"]].dropna()
                at = (*key[:-1], s, h, key[-1])
                if len(both) < 5:
                    assert at not in got
                    continue
                seen += 1
                assert got[at]["n"] == len(both)
                for c, x in (("pearson_ic", both), ("spearman_ic", both.rank())):
                    want = None if s == "c" else float(np.corrcoef(x.T)[0, 1])
                    assert got[at][c] == (want if want is None else pytest.approx(want, abs=1e-9))
    assert seen == len(got)


def test_ordinal_daily_ic_is_dealt_once(panel):
    found = reports.ordinal_daily_ic(panel, ("a",), (20,))
    assert "Generate" not in plan(found) and "Window" not in plan(found)
    got = {r["d"]: r for r in found.collect()}
    for d, day in panel.toPandas().groupby("d"):
        day = day.sort_values("entity")
        ranks = day[["a", "future_excess_return_20d"]].rank(method="first")
        both = ranks.dropna()
        assert got[d]["n"] == len(both) and got[d]["ic"] == pytest.approx(np.corrcoef(both.T)[0, 1], abs=1e-9)


def test_moments_leave_a_date_as_sums(panel):
    names, targets, sets = ["a", "value_component", "c"], {5: "future_excess_return_5d", 20: "future_excess_return_20d"}, [["a"], ["a", "value_component", "c"]]
    rows = walkforward.standardised(panel, names, targets, sets)
    sums = walkforward.daily_moments(panel, names, targets, sets)
    for df in (rows, sums):
        assert "Generate" not in plan(df) and "Window" not in plan(df)
    long = rows.toPandas()
    for r in sums.toPandas().to_dict("records"):
        z = long[(long.horizon == r["horizon"]) & (long.design == r["design"]) & (long.d == r["d"])]
        day = panel.filter(F.col("d") == F.lit(r["d"])).toPandas().dropna(subset=[*sets[r["design"]], targets[r["horizon"]]])
        assert r["n_rows"] == len(z) == len(day)
        a = (day["a"] - day["a"].mean()) / day["a"].std(ddof=0)
        assert np.allclose(sorted(z["a"]), sorted(a)) and (z["c"] == 0).all() and z["y"].mean() == pytest.approx(0, abs=1e-12)
        assert r["m0"] == pytest.approx((z["a"] ** 2).sum()) and r["m1"] == pytest.approx((z["a"] * z["value_component"]).sum()) and r["m6"] == pytest.approx((z["a"] * z["y"]).sum())
    assert set(walkforward.standardised(panel, names, targets, sets, wanted={(5, 1)}).toPandas()[["horizon", "design"]].itertuples(index=False, name=None)) == {(5, 1)}


def test_composite_makes_no_row_a_component(spark):
    rows = spark.createDataFrame([(5, 1, date(2024, 1, 1), 1, 2.0, 4.0), (5, 1, date(2024, 1, 1), 2, None, 4.0), (5, 1, date(2024, 1, 1), 3, 2.0, None), (5, 2, date(2024, 1, 1), 1, None, None), (20, 1, date(2024, 1, 1), 1, 2.0, 4.0)], "horizon int, fit int, d date, entity long, a double, b double")
    weights = spark.createDataFrame([(5, 1, "a", 0.25), (5, 1, "b", 0.75), (5, 2, "a", 0.0), (5, 2, "b", 1.0), (20, 1, "a", 0.0)], "horizon int, fit int, series string, weight double")
    out = walkforward.composite(rows, weights, ["a", "b"], ["a"])
    assert "Generate" not in plan(out)
    assert sorted((r["horizon"], r["fit"], r["entity"], r["score"]) for r in out.collect()) == [(5, 1, 1, 3.5), (5, 1, 2, None), (5, 1, 3, 2.0), (5, 2, 1, None)]


def test_refresh_queue_rounds_halves_as_its_sql_does(spark, tmp_path):
    import duckdb

    pd.DataFrame({"s_suppkey": range(1, 11), "s_acctbal": [2.5, 3.5, 2.0, 0.5, 1.5, -0.5, -1.5, -2.5, 4.5, 4.0]}).to_parquet(tmp_path / "supplier.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet'")
    assert compare.difference(spark, con, str(tmp_path), dated.rolling_refresh_queue, dated.ORACLES["rolling_refresh_queue"]) == ""


def test_ranks_of_a_date_are_dealt_once_and_equal_brute_force(spark):
    rng, rows = random.Random(6), []
    some = lambda p, x: None if rng.random() < p else x
    for k in range(3):
        for e in range(60):
            sector = ("north", "small", "Index", None)[0 if e < 40 else 1 if e < 45 else 2 if e < 50 else 3]
            rows.append((date(2024, 1, 1 + k), e, sector, some(0.1, float(rng.randrange(7))), float("nan") if e % 9 == 0 else some(0.2, rng.random()), some(0.3, float(rng.randrange(4)))))
    df = spark.createDataFrame(rows, "d date, entity long, sector string, a double, b double, c double")
    groups = {"both": {"fields": ("a", "c"), "inverted": ("c",)}, "plain": {"fields": ("a",), "inverted": ()}}
    found = ranking.day_ranks(df, {"a": 1, "b": -1}, groups, ("both",), 8)
    assert "Generate" not in plan(found) and plan(found).count("Exchange hashpartitioning") == 1
    got = {(r.d, r.entity): r for r in found.collect()}
    assert len(got) == len(rows)
    as_key = lambda x: 1e9 if x != x else x

    def rank(x, among):
        return None if x is None else (sum(v < x for v in among) + (sum(v == x for v in among) + 1) / 2) / len(among) * 100

    for d in sorted({r[0] for r in rows}):
        day = [r for r in rows if r[0] == d]
        for r in day:
            g = got[d, r[1]]
            col = lambda i, sign=1, keep=lambda q: True: [as_key(q[i] * sign) for q in day if q[i] is not None and keep(q)]  # noqa: B023, E731
            assert g.a_percentile == rank(r[3], col(3)) and g.b_percentile == rank(None if r[4] is None else as_key(-r[4]), col(4, -1)) and g.plain == g.a_percentile
            big = r[2] != "Index" and sum(q[2] == r[2] and (q[3] is not None or q[5] is not None) for q in day) >= 8
            assert g._big_both == big
            peers = lambda q: q[2] != "Index" and (q[2] == r[2] if big else True)  # noqa: B023, E731
            each = [x for x in (rank(r[3], col(3, 1, peers)), rank(None if r[5] is None else -r[5], col(5, -1, peers))) if x is not None]
            out = r[2] == "Index" or (big and r[2] is None) or not each
            assert g.both == (None if out else pytest.approx(sum(each) / len(each), abs=1e-9))


def test_a_scoring_run_joins_no_ranks_back(spark, sf_dir):
    found = plan(core.scored_outcomes(spark, sf_dir))
    assert found.count("FlatMapGroupsInArrow") == 2 and "SortMergeJoin" not in found  # in the optimized and in the executed plan
