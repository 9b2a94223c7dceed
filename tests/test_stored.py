"""Stored tables, upkeep, figures on a small fixture, pattern nulls by brute force, streams, and runs from end to end."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from sextant import config as C
from sextant.functions import scalar, stats
from sextant.operators import figures, patterns, pit, quality, ranking, upkeep
from sextant.plans import core, evaluation, families, portfolio, runs
from sextant.sources import files, reads, store
from sextant.sources.bars import bars


def day(i):
    return dt.date(2024, 1, 1) + dt.timedelta(days=i)


FACT = "entity string, tag string, period_start date, period_end date, fiscal_year int, fiscal_period string, value double, filed_date date, accession string"
FACTS = [
    ("A", "2022-01-01", "2022-12-31", 2022, "FY", 100.0, "2023-02-01", "a1"), ("A", "2022-01-01", "2022-12-31", 2022, "FY", 999.0, "2024-02-01", "a9"), ("A", "2022-01-01", "2022-06-30", 2022, "Q2", 45.0, "2022-08-01", "a0"),
    ("A", "2023-01-01", "2023-06-30", 2023, "Q2", 60.0, "2023-08-01", "a2"), ("A", "2023-04-01", "2023-06-30", 2023, "Q2", 31.0, "2023-08-01", "a2"),
    ("B", "2022-04-01", "2022-06-30", 2022, "Q2", 10.0, "2022-08-01", "b1"), ("B", "2022-07-01", "2022-09-30", 2022, "Q3", 11.0, "2022-11-01", "b2"), ("B", "2022-10-01", "2022-12-31", 2022, "Q4", 12.0, "2023-02-01", "b3"), ("B", "2023-01-01", "2023-03-31", 2023, "Q1", 13.0, "2023-05-01", "b4"),
    ("C", "2021-01-01", "2021-12-31", 2021, "FY", 70.0, "2022-02-01", "c1"), ("C", "2022-01-01", "2022-03-31", 2022, "Q1", 20.0, "2022-05-01", "c2"), ("D", "2023-01-01", "2023-12-31", 2023, "FY", 55.0, "2024-02-01", "d1"), ("E", "2023-01-01", "2023-03-31", 2023, "Q1", 5.0, "2023-05-01", "e1"),
]


def frame(spark, rows, tag="Revenues"):
    date = dt.date.fromisoformat
    return spark.createDataFrame([(e, tag, date(a) if a else None, date(b), y, p, v, date(f), n) for e, a, b, y, p, v, f, n in rows], FACT)


def test_trailing_years(spark):
    got = {r.entity: (r.value, r.period_end.isoformat(), r.method) for r in pit.trailing_year(frame(spark, FACTS), "entity").collect()}
    assert got == {"A": (115.0, "2023-06-30", "ttm_annual_plus_ytd"), "B": (46.0, "2023-03-31", "ttm_4q"), "C": (70.0, "2021-12-31", "annual_fallback"), "D": (55.0, "2023-12-31", "annual")}


def test_figures_know_only_what_was_filed(spark):
    """On each date the value first filed by then; a year too old, or nothing filed yet, gives none."""
    facts = frame(spark, FACTS).unionByName(frame(spark, [("A", None, "2022-12-31", 2022, "FY", 50.0, "2023-02-01", "a1"), ("A", None, "2022-12-31", 2022, "FY", 77.0, "2024-02-01", "a9")], "StockholdersEquity"))
    probes = spark.createDataFrame([("A", dt.date.fromisoformat(d), 2.0, "Energy") for d in ("2022-12-31", "2023-02-01", "2023-08-01", "2024-06-01", "2026-01-01")], "entity string, as_of date, price double, sector string")
    got = {r.as_of.isoformat(): (r.revenue, r.equity) for r in figures.fundamentals_as_of(probes, facts).collect()}
    assert got == {"2022-12-31": (None, None), "2023-02-01": (100.0, 50.0), "2023-08-01": (115.0, 50.0), "2024-06-01": (115.0, 50.0), "2026-01-01": (None, None)}


def test_a_restated_year_changes_nothing(spark):
    first = figures.resolved(figures.states(frame(spark, FACTS), ["Revenues"]), {"revenue": ("Revenues",)}).filter("entity = 'A'").orderBy("known_at").collect()
    assert [r.value for r in first if r.known_at >= dt.date(2023, 8, 1)] == [115.0, 115.0]


def test_valuations_and_flags(spark):
    df = spark.createDataFrame([(-3.0, None, float("inf"), 2.0)], "trailing_pe double, price_to_sales double, ev_to_ebitda double, price_to_book double")
    full = df.withColumns({f: F.lit(None).cast("double") for f in ("profit_margin", "operating_margin", "return_on_equity", "debt_to_equity", "short_percent_of_float")})
    r = figures.missing_flags(figures.cleaned(full)).first()
    assert (r.trailing_pe, r.ev_to_ebitda, r.price_to_book) == (None, None, 2.0) and (r.value_missing, r.quality_missing, r.fundamentals_missing) == (False, True, False)
    assert figures.missing_flags(figures.cleaned(full.withColumn("price_to_book", F.lit(0.0)))).first().fundamentals_missing


def test_index_rows_sit_out_of_neutral_ranks(spark):
    rows = [(i, 1, "Tech" if i < 8 else "Index" if i < 10 else "Small", float(i + 1)) for i in range(12)]
    df = spark.createDataFrame(rows, "entity long, d int, sector string, x double")
    groups = {"c": {"fields": ("x",), "inverted": ()}}
    got = {r.entity: (r.c, r.sector_rank_fallback) for r in ranking.composites(df, groups, ("c",), 8).collect()}
    assert got[7] == (100.0, False) and got[0] == (12.5, False) and got[8] == got[9] == (None, False) and got[11] == (100.0, True) and got[10] == (90.0, True)
    assert {r.entity: r.c for r in ranking.composites(df, groups).collect()}[8] == pytest.approx(75.0)


def test_each_index_keeps_its_newest_listing(spark):
    """An index listed longer ago than another stays a member, until its own next listing."""
    h = spark.createDataFrame([("big", day(0), 1), ("big", day(100), 2), ("small", day(50), 3)], "index_name string, as_of_date date, member long")
    got = {(r.d, r.index_name, r.member) for r in quality.members_as_of(h, spark.createDataFrame([(day(-1),), (day(60),), (day(100),), (day(500),)], "d date")).collect()}
    assert got == {(day(60), "big", 1), (day(60), "small", 3), (day(100), "big", 2), (day(100), "small", 3), (day(500), "big", 2), (day(500), "small", 3)}


def test_reads(spark, tmp_path):
    df = spark.createDataFrame([(1, day(0), None), (1, day(2), 5.0), (2, day(1), 7.0)], "entity long, d date, score_20d double")
    assert [r.d for r in reads.one_series(df, 1, day(1)).collect()] == [day(0)] and reads.scan(df, {"entity": None}, {"entity": [2]}).count() == 1
    snap = df.select(F.lit("v").alias("model_version"), F.col("d").alias("run_date"), "entity", "score_20d")
    assert [r.score for r in reads.score_map(snap, "score_20d", "v", day(2)).collect()] == [5.0]
    with pytest.raises(ValueError):
        reads.score_map(snap, "entity", "v", day(2))
    wide = reads.evolved(df, "entity string, new_column double")
    assert wide.columns == ["entity", "new_column", "d", "score_20d"] and wide.first().new_column is None
    df.withColumns({"model_version": F.lit("v"), "backfilled": F.when(F.col("entity") == 1, 1).otherwise(0), "run_date": F.col("d")}).write.parquet(str(tmp_path / "s"))
    table = spark.read.parquet(str(tmp_path / "s"))
    store.export_csv(table, str(tmp_path / "out"), "v", latest_only=True)
    assert [r.entity for r in spark.read.csv(str(tmp_path / "out"), header=True).collect()] == ["2"]
    assert "PushedFilters: [IsNotNull(entity), EqualTo(entity,1)]" in reads.scan(table, {"entity": 1})._jdf.queryExecution().toString()
    got = store.upsert_table(table.limit(1).withColumn("score_20d", F.lit(9.0)), str(tmp_path / "s"), str(tmp_path / "staged"), "entity", "d")
    assert got.count() == 3 and got.filter("score_20d = 9").count() == 1
    r = store.coverage(table, "d", "entity").first()
    assert (r["first"], r["last"], r["rows"], r["entities"]) == (day(0), day(2), 3, 2)


def test_upkeep(spark):
    s = spark.createDataFrame([("DGS10",), ("GDP",)], "series_id string")
    assert upkeep.market_priced(s.limit(1), ["DGS10"]).count() == 1
    with pytest.raises(Exception, match="not priced by a market: GDP"):
        upkeep.market_priced(s, ["DGS10"]).collect()
    text = upkeep.markdown(spark.createDataFrame([(1, "a|b"), (2, None)], "k int, v string").orderBy("k"), ["k", "v"])
    assert text.split("\n") == ["| k | v |", "| - | - |", "| 1 | a\\|b |", "| 2 | n/a |"]
    sessions = spark.createDataFrame([(day(i),) for i in range(5)], "d date")
    assert [r.back for r in upkeep.sessions_back(sessions, 3).orderBy("d").collect()] == [day(0)] * 4 + [day(1)]
    both = upkeep.by_cutoff(spark.createDataFrame([(day(0),), (day(1),), (None,)], "at date"), "at", F.lit(day(0)))
    assert sorted(r.side for r in both.collect()) == ["after", "before"]
    assert upkeep.combined([s, s.withColumn("x", F.lit(1))]).count() == 4
    one = spark.range(1)
    pick = lambda c: one.select(c.alias("x")).first().x
    assert pick(scalar.days_until(F.lit("2024-01-05"), F.lit(day(0)))) == 4 and pick(scalar.days_until(F.lit("2023-12-31"), F.lit(day(0)))) is None
    assert pick(scalar.weight_sentence(F.lit(0.123456))) == "IC 0.123: consider raising its weight" and pick(scalar.out_of_range(F.lit(161.0)))
    assert pick(scalar.one_json(F.lit('x {"b": [1, 2], "a": "q", "c": 3} y'), ["a", "b"])) == '{"a":"q","b":[1,2]}' and pick(scalar.one_json(F.lit('{"a": 1}'), ["a", "b"])) is None


def test_wide_prices(spark):
    df = spark.createDataFrame([(day(0), 1.0, 2.0), (day(1), None, 3.0)], "d date, `X Y|close` double, `Z|close` double")
    assert sorted((r.ticker, r.d, r.close, r.open) for r in files.wide_prices(df).collect()) == [("X Y", day(0), 1.0, None), ("Z", day(0), 2.0, None), ("Z", day(1), 3.0, None)]


# ---- patterns

def test_circular_shift_null_by_brute_force(spark, sf_dir):
    """The registered query against plain rotations of each family's masks, with the same offsets."""
    cells = families.cells(spark, sf_dir)
    tested = patterns.family_tests(cells).filter("p_value IS NOT NULL").select("family", "spec", "horizon", "t_stat").collect()
    rows, n = cells.collect(), cells.agg(F.max("session") + 1).first()[0]
    mask, value = {}, {}
    for r in rows:
        mask.setdefault(r.spec, np.zeros(n, bool))[r.session] = r.hit
        value.setdefault(r.spec, np.full(n, np.nan))[r.session] = np.nan if r.fwd is None else r.fwd
    rng = np.random.default_rng(C.PATTERN_SEED)
    offsets = [int(rng.integers(1, n)) for _ in range(500)]
    got = {r.family: r for r in families.circular_shift_null(spark, sf_dir).collect()}
    assert set(got) == {r.family for r in tested} and len(got) >= 4

    def t(spec, horizon, offset):
        m, f = np.roll(mask[spec], offset), value[spec]
        at = [i for i in range(n) if m[i] and not np.isnan(f[i])]
        kept = []
        for i in at:
            if not kept or i - kept[-1] >= horizon:
                kept.append(i)
        if len(kept) < 5 or len(at) < 2 or not np.std(f[at], ddof=1) > 0:
            return 0.0
        return abs((f[at].mean() - np.nanmean(f)) / (np.std(f[at], ddof=1) / np.sqrt(len(kept))))

    for family in ("regime", "day_of_week"):
        cells_of = [(r.spec, r.horizon) for r in tested if r.family == family]
        seen = max(t(s, h, 0) for s, h in cells_of)
        null = [max(t(s, h, o) for s, h in cells_of) for o in offsets]
        assert got[family].observed == pytest.approx(seen) == pytest.approx(max(abs(r.t_stat) for r in tested if r.family == family))
        assert got[family].family_p == pytest.approx((sum(x >= seen - 1e-12 for x in null) + 1) / 501, abs=0.005) and got[family].null_p95 == pytest.approx(np.percentile(null, 95))


def test_pooled_ranks_are_ranks(spark):
    """Ranks from counted values over many tasks against pandas, with ties and a hot value."""
    import pandas as pd

    rng = np.random.default_rng(5)
    x = np.where(rng.random(3000) < 0.3, 7.0, rng.integers(0, 400, 3000) / 8)
    key = rng.integers(0, 2, 3000)
    got = stats.pooled_ranks(spark.createDataFrame(list(zip(key.tolist(), x.tolist(), strict=True)), "k long, x double").repartition(5), "x", "k")
    want = {(k, v): r for k in (0, 1) for v, r in zip(x[key == k], pd.Series(x[key == k]).rank(), strict=True)}
    assert {(r.k, r.x): r["rank"] for r in got.collect()} == pytest.approx(want)
    rows = list(zip(key.tolist(), x.tolist(), strict=True)) + [(5, 3.0), (6, 1.0), (6, 2.0), (7, None)]
    medians = {r.k: r.m for r in stats.pooled_median(spark.createDataFrame(rows, "k long, x double").repartition(5), "x", "m", "k").collect()}
    assert medians == {0: np.median(x[key == 0]), 1: np.median(x[key == 1]), 5: 3.0, 6: 1.5}


# ---- plans

def count(df, what):
    return df._jdf.queryExecution().executedPlan().toString().count(what)


def test_a_simulation_holds_no_scoring_run(spark, sf_dir):
    """Scores, picks, holdings and flows are tables by the time that the curve is read: nothing is computed twice."""
    df = portfolio.portfolio_backtest(spark, sf_dir)
    assert count(df, "lineitem.parquet") == 0 and count(df, "Window") < 20 and count(df, "ArrowEval") + count(df, "InPandas") == 0


def test_one_scoring_run_in_reports(spark, sf_dir):
    """The panel is ranked as a narrow table of fields; wide rows are never sorted by date."""
    plan = core.horizon_scores(spark, sf_dir)
    assert count(plan, "lineitem.parquet") == 0 and count(plan, "Sort [") <= 16
    assert count(evaluation.decile_report(spark, sf_dir), "rank(") <= 12


# ---- streams and runs

def test_streams_remember_and_upsert(spark, tmp_path):
    from sextant.streaming import windows

    rows = [(i % 5, dt.datetime(2024, 1, 1, 0, i), 1, "a", float(i)) for i in range(10)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").repartition(1).write.parquet(str(tmp_path / "in"))
    target = str(tmp_path / "out")

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    for _ in range(2):  # a second run finds the checkpoint and adds nothing
        q = windows.upsert_each(windows.first_seen(windows.stream(spark, str(tmp_path / "in"))), write, str(tmp_path / "cp"))
        q.awaitTermination(120)
    assert sorted(r.event_id for r in spark.read.parquet(target).collect()) == [0, 1, 2, 3, 4]


def test_runs_from_end_to_end(spark, sf_dir, tmp_path):
    """A backfill, done again without doing anything twice, a live day, a hole that is recovered, reports and a journal."""
    path, version = str(tmp_path / "snap"), "v9"
    days = sorted(r.d for r in bars(spark, sf_dir, "all").select("d").collect())
    first, last = days[-20], days[-10]
    n = runs.run_backfill(spark, sf_dir, path, version, first, last).select("run_date").distinct().count()
    again = runs.run_backfill(spark, sf_dir, path, version, first, last)
    assert n == 11 and again.select("run_date").distinct().count() == 11 and {r.backfilled for r in again.select("backfilled").distinct().collect()} == {1}
    live = runs.run_live(spark, sf_dir, path, version)
    assert live.filter("backfilled = 0").select("run_date").distinct().count() == 1
    runs.store.write_snapshots(runs.score_dates(spark, sf_dir, spark.createDataFrame([(days[-4],)], "d date"), version, True), path)
    recovered = runs.recover_missing(spark, sf_dir, path, version).filter("recovered = 1").select("run_date").distinct()
    assert sorted(str(r.run_date) for r in recovered.collect()) == [str(d) for d in days[-3:-1]]
    found = runs.run_evaluation(spark, sf_dir, path, version)
    assert set(found) == {"graded", "buckets", "deciles", "spread", "cohorts", "scoreboard"} and found["buckets"].count() >= 0
    text = runs.journal(spark, path, version)
    assert text.startswith("## v9") and "| place | entity | score | score_label |" in text
    entry = runs.journal_day(spark, sf_dir, path, version)
    assert entry == runs.journal_day(spark, sf_dir, path, version) and [x for x in entry.split("\n") if x.startswith("##")] == ["## v9", "### Matured", "### Scoreboard", "### Scores against outcomes"]
    other = spark.createDataFrame([("v8", day(0), "2024-01", "an older day")], "model_version string, d date, month string, text string")
    runs.log_book(spark, f"{path}-log").upsert(other)
    log = runs.daily_log(spark, f"{path}-log")
    assert log.count("# 2024-01-01") == 1 and log.count("## v9") == 1 and runs.log_book(spark, f"{path}-log").read().count() == 2
    assert runs.daily_log(spark, f"{path}-log", 1).startswith(f"# {max(days[-1], day(0))}")
    about = runs.status(spark, sf_dir, path)
    assert about["versions"].first().live_dates == 2 + 2 and about["gaps"].columns == ["entity", "n"]
    versions = spark.createDataFrame([("a",), ("b",), ("c",)], "model_version string")
    assert [r.model_version for r in runs.refresh_frozen(versions, spark.createDataFrame([("a", day(1)), ("b", day(0))], "model_version string, evaluated_at date"), 2).collect()] == ["c", "b"]
    assert runs.exhausted(spark.createDataFrame([("a", str(day(0)))], "model_version string, run_date string"), spark.createDataFrame([(day(i),) for i in range(121)], "d date")).first().done


def test_figures_as_they_stood_in_one_pass(spark, sf_dir):
    """All concepts of all filing dates: the facts are written once, read for both sides of one join, and dealt once more."""
    from sextant.plans import filings

    plan = filings.concept_resolve(spark, sf_dir)
    assert count(plan, "FileScan") <= 4 and count(plan, "Exchange ") <= 12 and count(plan, "Window [") <= 6
