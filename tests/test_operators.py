"""Hand-computed values, no-lookahead properties, edge cases and plans."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sextant.functions import scalar, stats
from sextant.operators import asof, backtest, features, patterns, pit, quality, ranking, walkforward
from sextant.sources import archives, files, store


def day(i):
    return dt.date(2024, 1, 1) + dt.timedelta(days=i)


@pytest.fixture(scope="module")
def series(spark):
    rows = [(e, day(i), c, c * 1.01, c * 0.99, c, 1e6 + (i % 7) * 5e4) for e in (1, 2) for i in range(300) for c in [100 + e + 0.1 * i + 5 * math.sin(i / 10 + e)]]
    return spark.createDataFrame(rows, "entity long, d date, open double, high double, low double, close double, volume double").cache()


def test_sma_and_guard(spark):
    df = spark.createDataFrame([(1, day(i), float(i), float(i), float(i), float(i), 1.0) for i in range(30)], "entity long, d date, open double, high double, low double, close double, volume double")
    got = {r.d: r.SMA20 for r in features.trend(df).collect()}
    assert got[day(29)] == 19.5 and got[day(18)] is None and got[day(19)] == 9.5


def test_atr(spark):
    df = spark.createDataFrame([(1, day(i), 10.0, 11.0, 9.0, 10.0, 1.0) for i in range(15)], "entity long, d date, open double, high double, low double, close double, volume double")
    assert features.risk(df).orderBy("d").collect()[-1].ATR14 == 2.0


def test_no_lookahead(series):
    all_ = lambda df: features.setup(features.risk(features.volume(features.returns(features.trend(df)))))
    cut = day(250)
    changed = series.withColumns({c: F.when(F.col("d") > cut, F.col(c) * 3).otherwise(F.col(c)) for c in ("open", "high", "low", "close", "volume")})
    a, b, c = (all_(df).filter(F.col("d") <= cut).orderBy("entity", "d").collect() for df in (series, changed, series.filter(F.col("d") <= cut)))
    assert a == b == c


def test_one_exchange_for_features(series):
    plan = features.setup(features.risk(features.trend(series)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(entity") == 1


def test_percent_rank_matches_pandas(spark):
    rng = np.random.default_rng(1)
    x = pd.Series(rng.integers(0, 20, 200).astype(float)).where(rng.random(200) > 0.2)
    df = spark.createDataFrame([(i, 1, None if math.isnan(v) else v) for i, v in enumerate(x)], "entity long, d int, x double")
    got = [r.p for r in df.withColumn("p", ranking.percent_rank("x", "d")).orderBy("entity").collect()]
    want = (x.rank(pct=True) * 100).tolist()
    assert all((g is None and math.isnan(w)) or g == pytest.approx(w) for g, w in zip(got, want, strict=True))


def test_percentiles_of_three(spark):
    df = spark.createDataFrame([(1, 1, 0.01), (2, 1, 0.05), (3, 1, 0.10)], "entity long, d int, x double")
    assert [round(r.p, 1) for r in df.withColumn("p", ranking.percent_rank("x", "d")).orderBy("entity").collect()] == [33.3, 66.7, 100.0]


def test_ties_share_a_decile_and_the_cut(spark):
    df = spark.createDataFrame([(i, 1, 1.0 if i < 5 else 0.0) for i in range(10)], "entity long, d int, s double")
    assert {r.k for r in df.withColumn("k", ranking.deciles("s")).filter("s = 1").collect()} == {3}
    assert ranking.top_with_ties(df, "s", 2).count() == 5 and ranking.top_exact(df, "s", 2).count() == 2


def test_scalars(spark):
    one = spark.range(1)
    pick = lambda c: one.select(c.alias("x")).first().x
    assert pick(scalar.pct(F.lit(1.0), F.lit(0.0))) is None and pick(scalar.signed_change(F.lit(1.0), F.lit(-2.0))) == 1.5
    assert pick(scalar.clamp(F.lit(None).cast("double"))) is None and pick(scalar.clamp(F.lit(120.0))) == 100.0
    assert pick(scalar.label(F.lit(79.2))) == "decent" and pick(scalar.label(F.lit(-1.0))) is None
    assert pick(scalar.items(F.lit("2.02, 9.01,"))) == ["2.02", "9.01"] and pick(scalar.is_material(F.lit("9.01,5.07"))) is False
    assert pick(scalar.html_text(F.lit("<p>a<script>x<y</script>&amp;b &copy;</p>"))) == "a &b"
    assert pick(scalar.spread_bps(F.lit(None).cast("double"))) == 80.0 and pick(scalar.close_position(F.lit(1.0), F.lit(1.0), F.lit(1.0))) == 0.5
    assert pick(scalar.weekdays_between(F.to_date(F.lit("2024-01-05")), F.to_date(F.lit("2024-01-09")))) == 1


def test_constant_side_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert df.agg(stats.moment_corr(F.col("x"), F.col("y")).alias("r")).first().r is None


def test_student_tail():
    assert stats.two_sided_p(np.array([2.0, 0.0, 12.706]), np.array([10.0, 5.0, 1.0])) == pytest.approx([0.07338803, 1.0, 0.05], abs=2e-5)


def test_asof_includes_the_day_and_ignores_later(spark):
    facts = spark.createDataFrame([(1, day(0), 1.0), (1, day(5), 2.0)], "entity long, filed date, v double")
    probes = spark.createDataFrame([(1, day(5)), (1, day(4)), (1, day(-1)), (2, day(9))], "entity long, d date")
    got = {(r.entity, r.d): r.v for r in asof.backward(probes, facts, "entity", "d", "filed", ["v"]).collect()}
    assert got == {(1, day(5)): 2.0, (1, day(4)): 1.0, (1, day(-1)): None, (2, day(9)): None}


def test_roll_past_the_end_goes(spark):
    sessions = spark.createDataFrame([(day(0),), (day(3),), (day(40),)], "d date")
    ev = spark.createDataFrame([(1, day(1)), (2, day(41)), (3, day(-5)), (4, day(3)), (5, day(4))], "k long, t date")
    assert {(r.k, r.effective) for r in asof.forward_roll(ev, sessions, "t").collect()} == {(1, day(3)), (4, day(3)), (5, day(40))}
    assert {r.k for r in asof.forward_roll(ev, sessions, "t", keep_early=True).collect()} == {1, 3, 4, 5}


def test_greedy_spacing(spark):
    df = spark.createDataFrame([([1, 2, 6, 7, 11],), ([],)], "x array<bigint>")
    assert [r.n for r in df.select(stats.spaced(F.col("x"), 5).alias("n")).collect()] == [3, 0]


@pytest.mark.parametrize("window", [None, 40])
def test_schedule_by_brute_force(spark, window):
    """A walk over lists of dates against the relation; some run dates are no sessions, some sessions no run dates."""
    days = [day(i) for i in range(260) if i % 7 < 5]
    runs = [d for i, d in enumerate(days) if i % 3] + [day(5), day(12)]
    sessions = spark.createDataFrame(list(zip(days, range(len(days)), strict=True)), "d date, session int")
    got = walkforward.schedule(spark.createDataFrame([(d,) for d in runs], "d date"), sessions, 20, 30, 15, window).orderBy("fit").collect()
    runs, last, want = sorted(set(runs)), None, []
    for d in [d for d in runs if d in days]:
        at = days.index(d)
        known = [r for r in runs if at >= 20 and r <= days[at - 20]]
        later = [r for r in runs if r > d][:14]
        if len(known) >= 30 and later and (last is None or at - last >= 15):
            used = known[-window:] if window else known
            want.append((len(want) + 1, d, days[at - 20], len(used), used[0], used[-1], later[0], later[-1]))
            last = at
    assert [tuple(r) for r in got] == want and len(want) > 2
    assert all(r.last_train <= r.cutoff < r.train_end < r.oos_start for r in got)


def test_regressions_recover_weights():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 3))
    y = x @ np.array([1.0, 0.0, 2.0]) + rng.normal(size=2000) * 0.01
    assert walkforward.ridge(x.T @ x, x.T @ y, 1.0) == pytest.approx([1, 0, 2], abs=0.02)
    w = walkforward.nonnegative(x.T @ x, -(x.T @ y))
    assert (w >= 0).all() and w == pytest.approx([0, 0, 0], abs=0.02)


BAR = "entity long, d date, open double, high double, low double, close double, volume double"


def test_fill_at_the_next_open_and_costs(spark):
    b = spark.createDataFrame([(1, day(i), 10.0 + i, 10.0 + i, 10.0 + i, 10.0 + i, 1e6) for i in range(5)], BAR)
    sessions = spark.createDataFrame([(day(i), i) for i in range(5)], "d date, session int")
    picks = spark.createDataFrame([("a", day(0), 0, 1)], "config string, d date, session int, entity long")
    free = [r.equity for r in backtest.simulate(picks, b, sessions, charge=False)[0].orderBy("d").collect()]
    assert free == pytest.approx([100000.0, 100000.0, 100000 * 12 / 11, 100000 * 13 / 11, 100000 * 14 / 11])
    curve, summary = backtest.simulate(picks, b, sessions)
    paid = curve.orderBy("d").collect()
    assert paid[-1].equity < free[-1] and sum(r.cost for r in paid) == pytest.approx(summary.first().total_cost) and summary.first().total_cost > 0


def test_simulation_by_a_ledger(spark):
    """Three configs against a plain ledger: gaps in the bars, names that vanish, a rebalance without a fill, jumps."""
    rng = np.random.default_rng(8)
    rows, price = [], {}
    for e in range(1, 7):
        p = 20.0 + e
        for i in range(60):
            p *= float(1 + rng.normal(0, 0.02) + (0.9 if (e, i) == (2, 33) else 0))
            if rng.random() > 0.15 and not (e == 3 and i > 40) and i != 31:
                o = p * float(1 + rng.normal(0, 0.01))
                rows.append((e, day(i), o, p, p, p, 2000.0 * e))
                price[e, i] = (o, p)
    adv = {}
    for e in range(1, 7):
        seen = []
        for i in range(60):
            if (e, i) in price:
                seen.append(price[e, i][1] * 2000.0 * e)
                adv[e, i] = float(np.mean(seen[-20:]))
    picks = [(c, day(i), i, int(e)) for c, k in (("a", 10), ("b", 15), ("c", 30)) for i in range(0, 60, k) for e in sorted(rng.choice(range(1, 7), 3, replace=False))]
    sessions = spark.createDataFrame([(day(i), i) for i in range(60)], "d date, session int")
    df = spark.createDataFrame(picks, "config string, d date, session int, entity long")
    curve, summary = backtest.simulate(df, spark.createDataFrame(rows, BAR), sessions)
    got = {(r.config, r.session): r.equity for r in curve.collect()}
    about = {r.config: r for r in summary.collect()}

    def bps(trade, v):
        if not v or trade <= 0:
            return 40.0 + 80.0
        return min(80.0, max(1.0, 1 + 12 / math.sqrt(v / 1e6))) / 2 + 10 * math.sqrt(min(trade / v, 0.1))

    for c in ("a", "b", "c"):
        chosen = {}
        for _, _, i, e in [p for p in picks if p[0] == c]:
            chosen.setdefault(i, []).append(e)
        cash, held, cost, traded, gone, odd, seen = 100_000.0, {}, 0.0, 0.0, 0, 0, {}
        last = lambda e, i: next((price[e, j][1] for j in range(i, -1, -1) if (e, j) in price), None)
        for i in range(60):
            if i - 1 in chosen:
                money = cash
                for e, n in held.items():
                    own = (e, i) in price
                    value = n * (price[e, i][0] if own else last(e, i))
                    fee = value * bps(value, adv.get((e, i)) if own else None) / 1e4
                    money, cost, traded, gone = money + value - fee, cost + fee, traded + value, gone + (not own)
                names = [e for e in chosen[i - 1] if (e, i) in price]
                held, cash = {}, 0.0 if names else money
                for e in names:
                    each = money / len(names)
                    fee = each * bps(each, adv[e, i]) / 1e4
                    held[e], cost, traded = (each - fee) / price[e, i][0], cost + fee, traded + each
            assert got[c, i] == pytest.approx(cash + sum(n * last(e, i) for e, n in held.items())), (c, i)
            for e in held:
                if (e, i) in price:
                    odd += e in seen and abs(price[e, i][1] / seen[e] - 1) > 0.5
                    seen[e] = price[e, i][1]
        r = about[c]
        mean = np.mean([got[c, i] for i in range(60)])
        assert r.total_cost == pytest.approx(cost) and r.turnover_annual == pytest.approx(traded / mean / (60 / 252)) and (r.n_liquidated, r.n_suspicious, r.n_rebalances) == (gone, odd, len([i for i in chosen if i + 1 < 60]))


def test_a_lost_book_stays_lost(spark):
    """Half short a name that trebles loses everything; what follows brings nothing back."""
    curve = spark.createDataFrame([(c, day(i), v) for c, vs in (("l", (100.0, 110.0, 110.0, 121.0)), ("s", (100.0, 100.0, 310.0, 100.0))) for i, v in enumerate(vs)], "config string, d date, equity double")
    pairs = spark.createDataFrame([("p", "l", "s")], "pair string, long string, short string")
    got = [r.equity for r in backtest.long_short(curve, pairs).orderBy("d").collect()]
    assert got == pytest.approx([100_000.0, 105_000.0, 0.0, 0.0])


def test_invested_part_and_benchmark(spark):
    curve = spark.createDataFrame([("a", day(i), 100.0 if i < 3 else 100.0 + i) for i in range(6)], "config string, d date, equity double")
    got = backtest.invested(curve, "config").orderBy("d").collect()
    assert [r.d for r in got] == [day(3), day(4), day(5)] and {r.n_in_cash for r in got} == {3}
    held = backtest.buy_and_hold(spark.createDataFrame([(day(1), 10.0), (day(3), 15.0)], "d date, close double"), curve)
    assert [r.equity for r in held.orderBy("d").collect()] == [100_000.0, 100_000.0, 100_000.0, 150_000.0, 150_000.0, 150_000.0]


def test_planted_pattern_is_found(spark, series):
    sessions = series.select("d").distinct().withColumn("session", F.datediff("d", F.lit(day(0))))
    df = patterns.forward_by_session(patterns.densified(series, sessions), 1).withColumn("hit", F.col("session") % 10 == 0)
    df = df.withColumn("fwd", F.when(F.col("hit"), F.col("fwd") + 0.05).otherwise(F.col("fwd")))
    assert all(r.t_stat > 5 for r in patterns.cell_test(df, "hit", 1).collect())


def test_upserts_and_snapshots(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, None), (3, "d")], "k long, v string")
    assert {tuple(r) for r in quality.upsert(old, new, "k").collect()} == {(1, "a"), (2, None), (3, "d")}
    assert {tuple(r) for r in quality.upsert_keeping(old, new, "v", "k").collect()} == {(1, "a"), (2, "b"), (3, "d")}
    path = str(tmp_path / "snap")
    rows = spark.createDataFrame([("v1", "2024-01-01", 1), ("v1", "2024-01-02", 2)], "model_version string, run_date string, x int")
    store.write_snapshots(rows, path)
    store.write_snapshots(rows.filter("run_date = '2024-01-02'").withColumn("x", F.lit(9)), path)
    assert sorted(r.x for r in store.read_snapshots(spark, path).collect()) == [1, 9]
    assert store.verified_copy(spark, path, str(tmp_path / "copy"))["verdict"] == "match"
    pairs = [spark.createDataFrame(x, "k long") for x in ([(1,), (1,), (2,)], [(3,), (3,), (2,)])]
    assert store.fingerprint(pairs[0]) != store.fingerprint(pairs[1])
    twice = spark.createDataFrame([(2, "x", 1), (2, "y", 2)], "k long, v string, at int")
    assert {r.v for r in quality.upsert(old.withColumn("at", F.lit(0)), twice, "k", order=F.desc("at")).collect()} == {"a", "y"}


def test_trade_quarter(spark, tmp_path):
    (tmp_path / "SUBMISSION.tsv").write_text("ACCESSION_NUMBER\tFILING_DATE\tISSUERCIK\tISSUERTRADINGSYMBOL\nx1\t05-JAN-2024\t123\tabc\nx2\t\t124\tdef\n")
    (tmp_path / "REPORTINGOWNER.tsv").write_text("ACCESSION_NUMBER\tRPTOWNERCIK\tRPTOWNERNAME\tRPTOWNER_RELATIONSHIP\tRPTOWNER_TITLE\nx1\t9\tA\tOfficer\tChief\nx1\t8\tB\tDirector,TenPercentOwner\t\n")
    (tmp_path / "NONDERIV_TRANS.tsv").write_text("ACCESSION_NUMBER\tNONDERIV_TRANS_SK\tTRANS_DATE\tTRANS_CODE\tTRANS_SHARES\tTRANS_PRICEPERSHARE\nx1\t1\t03-JAN-2024\tp\t10\t2.5\nx2\t2\t03-JAN-2024\tP\t10\t2.5\n")
    (tmp_path / "DERIV_TRANS.tsv").write_text("ACCESSION_NUMBER\tDERIV_TRANS_SK\tTRANS_DATE\tTRANS_CODE\tTRANS_SHARES\tTRANS_PRICEPERSHARE\nx1\t7\t03-JAN-2024\tM\t10\t\n")
    a, b = files.trade_quarter(spark, str(tmp_path)).orderBy("trans_sk").collect()
    assert (a.cik, a.filed_date, a.value_usd, a.is_officer, a.is_director, a.is_ten_pct_owner, a.owner_ids, a.owner_titles, a.trans_code, a.sec_symbol) == ("0000000123", dt.date(2024, 1, 5), 25.0, True, True, True, "9,8", "Chief", "P", "ABC")
    assert (b.table_kind, b.value_usd) == ("deriv", None)
    assert files.trade_quarter(spark, str(tmp_path), spark.createDataFrame([("0000000999",)], "cik string")).count() == 0
    with pytest.raises(ValueError, match="empty"):
        files.trade_quarter(spark, str(tmp_path), spark.createDataFrame([], "cik string"))


def test_zipped_quarters(spark, tmp_path):
    """Archives give the rows of the unpacked folders; only wanted columns and issuers are taken; a missing member is no row."""
    import zipfile

    tables = {"SUBMISSION.tsv": ["ACCESSION_NUMBER\tFILING_DATE\tISSUERCIK\tISSUERTRADINGSYMBOL\tDOCUMENT_TYPE\tAFF10B5ONE", "{0}1\t05-JAN-2024\t123\t (abc) \t4\ttrue", "{0}2\t2024-01-05\t124\tdef\t4\t0", "{0}3\t31-FEB-2024\t125\t\t4\t"],
              "REPORTINGOWNER.tsv": ["ACCESSION_NUMBER\tRPTOWNERCIK\tRPTOWNERNAME\tRPTOWNER_RELATIONSHIP\tRPTOWNER_TITLE", "{0}1\t9\tZed é\tOfficer\tChief", "{0}1\t8\tAnn\tDirector,Other\t ", "{0}1\t9\tZed é\tDirector\tChief"],
              "NONDERIV_TRANS.tsv": ["ACCESSION_NUMBER\tNONDERIV_TRANS_SK\tTRANS_DATE\tTRANS_CODE\tTRANS_ACQUIRED_DISP_CD\tTRANS_SHARES\tTRANS_PRICEPERSHARE\tSHRS_OWND_FOLWNG_TRANS\tDIRECT_INDIRECT_OWNERSHIP", "{0}1\t1\t03-JAN-2024\tp\ta\t10\t2.5\t110\tD", "{0}1\t2\t\tS\td\tmany\t2.5\t\t", "{0}2\t3\t03-JAN-2024\tP\tA\t1\t1\t1\tI"],
              "DERIV_TRANS.tsv": ["ACCESSION_NUMBER\tDERIV_TRANS_SK\tTRANS_DATE\tTRANS_CODE\tTRANS_SHARES\tTRANS_PRICEPERSHARE", "{0}1\t7\t03-JAN-2024\tM\t10\t"]}
    (tmp_path / "zips").mkdir()
    for q in ("q1", "q2"):
        (tmp_path / q).mkdir()
        with zipfile.ZipFile(tmp_path / "zips" / f"{q}.zip", "w") as box:
            for name, lines in tables.items():
                text = "\n".join(lines).replace("{0}", q) + "\n"
                (tmp_path / q / name).write_text(text)
                box.writestr(name, text)
    with zipfile.ZipFile(tmp_path / "zips" / "other.zip", "w") as box:
        box.writestr("README.txt", "nothing")
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    one = files.trade_quarter(spark, str(tmp_path / "q1"))
    assert rows(one) == rows(files.trade_quarter(spark, str(tmp_path / "zips" / "q1.zip"))) and len(rows(one)) == 3
    both = files.trade_quarter(spark, f"{tmp_path}/zips/*.zip")
    assert rows(both) == sorted(rows(one) + rows(files.trade_quarter(spark, str(tmp_path / "q2"))), key=repr)
    r = both.filter("accession = 'q11' AND trans_sk = '1'").first()
    assert (r.owner_ids, r.owner_names, r.owner_titles, r.relationships, r.sec_symbol, r.is_10b5_1, r.is_ten_pct_owner, r.shares_owned_after, r.direct_indirect) == ("9,8,9", "Zed é | Ann | Zed é", "Chief | Chief", "Director,Director,Other,Officer", "(ABC)", True, False, 110.0, "D")
    assert {(r.trans_sk, r.table_kind, r.value_usd, r.is_10b5_1) for r in one.collect()} == {("1", "nonderiv", 25.0, True), ("2", "nonderiv", None, True), ("7", "deriv", None, True)}
    raw = archives.zipped(spark, str(tmp_path / "zips"), "SUBMISSION.tsv", ["ISSUERCIK", "NONE"])
    assert raw.columns == ["ISSUERCIK", "NONE", "_line"] and raw.rdd.getNumPartitions() == 3
    assert rows(raw.filter("ISSUERCIK = '124'").select("ISSUERCIK", "NONE", "_line")) == [("124", None, 1)] * 2
    assert spark.read.format("zipped_tables").option("member", "DERIV_TRANS.tsv").load(str(tmp_path / "zips")).columns[1] == "DERIV_TRANS_SK"


def test_html_table_and_series(spark, tmp_path):
    html = "<table><tr><th>A</th></tr></table><table><tr><th>Symbol</th><th>Sector</th></tr><tr><td>X</td><td>Tech &amp; Co</td></tr></table>"
    df = spark.createDataFrame([(1, html)], "k long, html string")
    assert [r.cells for r in files.html_tables(df, "k", "html", ["Symbol", "Sector"]).orderBy("row").collect()] == [["Symbol", "Sector"], ["X", "Tech & Co"]]
    (tmp_path / "s.csv").write_text("series_id,date,value\na,2024-01-01,1.5\na,2024-01-02,.\n")
    assert files.series(spark, str(tmp_path / "s.csv")).count() == 1


def test_debt_counts_leases_once(spark):
    df = spark.createDataFrame([(10.0, None, 2.0, 3.0, True), (10.0, 1.0, 2.0, 3.0, False), (None, 1.0, None, None, False)], "a double, b double, c double, d double, e boolean")
    assert [r.x for r in df.select(pit.debt(*[F.col(c) for c in "abcde"]).alias("x")).collect()] == [13.0, 16.0, None]


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    from sextant.streaming import windows

    src = tmp_path / "in"
    batch = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.repartition(1).write.parquet(str(src))
    q = windows.tumbling(windows.stream(spark, str(src))).writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda rows: sorted((r.start, r.event_type, r.n) for r in rows)
    assert key(spark.table("tumbled").collect()) == key(windows.tumbling(batch).collect())
