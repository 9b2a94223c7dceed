"""Queries of dated facts and events: as-of joins, rolls, windows, resolution of figures, data checks, sources."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from sextant import config as C
from sextant.functions import scalar
from sextant.functions.scalar import rounded
from sextant.operators import asof, events, expanding, features, pit, quality
from sextant.plans import oracle as O
from sextant.sources import files
from sextant.sources.bars import bars, read, watchlist

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    """Registers a query, and the SQL that gives its rows."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _facts(spark, sf_dir):
    """Orders as dated facts of a nation."""
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(F.col("c_nationkey").cast("long").alias("entity"), F.to_date("o_orderdate").alias("filed_date"), "o_orderkey", F.col("o_orderstatus").alias("code"), F.col("o_totalprice").alias("value"), "o_orderpriority", "o_custkey")


FACTS = "facts AS (SELECT CAST(c_nationkey AS BIGINT) AS entity, CAST(o_orderdate AS DATE) AS filed_date, o_orderkey, o_orderstatus AS code, o_totalprice AS value, o_orderpriority, o_custkey FROM orders JOIN customer ON o_custkey = c_custkey)"
NATIONS = "nb AS (SELECT DISTINCT CAST(s_nationkey AS BIGINT) AS entity, CAST(date_trunc('week', l_shipdate) AS DATE) AS d FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"


def _nation_weeks(spark, sf_dir):
    li, s = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "supplier")
    return li.join(s, li.l_suppkey == s.s_suppkey).select(F.col("s_nationkey").cast("long").alias("entity"), F.to_date(F.date_trunc("week", "l_shipdate")).alias("d")).distinct()


_LATEST = "lf AS (SELECT entity, filed_date, max_by(value, o_orderkey) AS value, max(o_orderkey) AS o_orderkey FROM facts GROUP BY 1, 2)"


@query("asof_latest_fact", f"WITH {FACTS}, {NATIONS}, {_LATEST} SELECT nb.entity, nb.d, lf.value, lf.o_orderkey, lf.filed_date AS filed_date_asof FROM nb ASOF LEFT JOIN lf ON nb.entity = lf.entity AND nb.d >= lf.filed_date")
def asof_latest_fact(spark, sf_dir):
    return asof.backward(_nation_weeks(spark, sf_dir), _facts(spark, sf_dir), "entity", "d", "filed_date", ["value", "o_orderkey"], ["o_orderkey"], "year")


@query("asof_with_staleness", f"WITH {FACTS}, {NATIONS}, {_LATEST} SELECT nb.entity, nb.d, CASE WHEN date_diff('day', lf.filed_date, nb.d) <= {C.STALENESS_DAYS} THEN lf.value END AS value FROM nb ASOF LEFT JOIN lf ON nb.entity = lf.entity AND nb.d >= lf.filed_date")
def asof_with_staleness(spark, sf_dir):
    found = asof.backward(_nation_weeks(spark, sf_dir), _facts(spark, sf_dir), "entity", "d", "filed_date", ["value", "o_orderkey"], ["o_orderkey"])
    return found.select("entity", "d", asof.fresh(F.col("value"), F.col("d"), F.col("filed_date_asof"), C.STALENESS_DAYS).alias("value"))


@query("estimates_asof", f"WITH {FACTS}, {NATIONS}, lf AS (SELECT entity, code, filed_date, max_by(value, o_orderkey) AS value FROM facts GROUP BY 1, 2, 3), p AS (SELECT DISTINCT entity, d, code FROM nb, (VALUES ('F'), ('O'), ('P')) t(code)) SELECT p.entity, p.d, p.code, lf.value FROM p ASOF LEFT JOIN lf ON p.entity = lf.entity AND p.code = lf.code AND p.d >= lf.filed_date")
def estimates_asof(spark, sf_dir):
    """The newest observation of each period as of a date."""
    probes = _nation_weeks(spark, sf_dir).withColumn("code", F.explode(F.array(*[F.lit(x) for x in "FOP"]))).withColumn("k", F.concat_ws("|", "entity", "code"))
    facts = _facts(spark, sf_dir).withColumn("k", F.concat_ws("|", "entity", "code"))
    return asof.backward(probes, facts, "k", "d", "filed_date", ["value"], ["o_orderkey"]).select("entity", "d", "code", "value")


_ROLL = "ev AS (SELECT event_id, user_id, event_type, ts, CASE WHEN hour(ts) >= 16 THEN CAST(ts AS DATE) + 1 ELSE CAST(ts AS DATE) END AS target FROM events), ss AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events WHERE isodow(ts) <= 5), rolled AS (SELECT ev.*, (SELECT min(d) FROM ss WHERE d >= target) AS effective FROM ev WHERE target >= (SELECT min(d) FROM ss))"


def _rolled(spark, sf_dir):
    ev = read(spark, sf_dir, "events")
    sessions = ev.select(F.to_date("ts").alias("d")).filter(F.weekday("d") < 5).distinct()
    return asof.forward_roll(ev.withColumn("target", asof.after_close(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))), sessions, "target")


@query("calendar_roll", f"WITH {_ROLL} SELECT event_id, effective FROM rolled WHERE effective IS NOT NULL")
def calendar_roll(spark, sf_dir):
    return _rolled(spark, sf_dir).select("event_id", "effective")


@query("trailing_event_counts", f"WITH {_ROLL}, pr AS (SELECT DISTINCT user_id, effective AS d FROM rolled WHERE effective IS NOT NULL) SELECT user_id, d, (SELECT count(*) FROM rolled r WHERE r.user_id = pr.user_id AND r.effective BETWEEN pr.d - 5 AND pr.d) AS n, (SELECT count(*) FROM rolled r WHERE r.user_id = pr.user_id AND r.event_type = 'click' AND r.effective BETWEEN pr.d - 5 AND pr.d) AS clicks FROM pr")
def trailing_event_counts(spark, sf_dir):
    r = _rolled(spark, sf_dir).select("user_id", "effective", F.lit(1).alias("one"), (F.col("event_type") == "click").cast("int").alias("click"))
    probes = r.select("user_id", F.col("effective").alias("d")).distinct()
    return asof.in_window(probes, r, "user_id", "d", "effective", 5, {"n": F.count("one"), "clicks": F.count(F.when(F.col("click") == 1, 1))})


_ITEMS = "CASE event_id % 5 WHEN 0 THEN '2.02,9.01' WHEN 1 THEN '5.02' WHEN 2 THEN '9.01' WHEN 3 THEN '1.01, 7.01' ELSE '4.02,5.07' END"
_GROUPS = {"material": "len(list_filter(codes, lambda c: c NOT IN ('9.01', '5.07'))) > 0"} | {g: f"list_has_any(codes, [{', '.join(repr(c) for c in cs)}])" for g, cs in C.EVENT_GROUPS.items()}


@query("item_event_features", f"WITH {_ROLL}, it AS (SELECT user_id AS entity, effective, list_transform(string_split({_ITEMS}, ','), lambda c: trim(c)) AS codes FROM rolled WHERE effective IS NOT NULL), pr AS (SELECT DISTINCT entity, effective AS d FROM it), cov AS (SELECT min(effective) AS a, max(effective) - 2 AS b FROM it) SELECT pr.entity, pr.d, {', '.join(f'CASE WHEN pr.d BETWEEN a AND b THEN count(*) FILTER (({c}) AND effective >= pr.d - {w}) END AS {g}_{w}d' for g, c in _GROUPS.items() for w in C.EVENT_WINDOWS)}, {', '.join(f'CASE WHEN pr.d BETWEEN a AND b THEN CAST(date_diff({chr(39)}day{chr(39)}, max(effective) FILTER ({_GROUPS[g]}), pr.d) AS INTEGER) END AS days_since_{g}' for g in ('material', 'earnings'))}, NOT pr.d BETWEEN a AND b AS coverage_missing FROM pr JOIN it ON it.entity = pr.entity AND it.effective <= pr.d, cov GROUP BY pr.entity, pr.d, a, b")
def item_event_features(spark, sf_dir):
    k = F.col("event_id") % 5
    codes = F.when(k == 0, "2.02,9.01").when(k == 1, "5.02").when(k == 2, "9.01").when(k == 3, "1.01, 7.01").otherwise("4.02,5.07")
    ev = _rolled(spark, sf_dir).select(F.col("user_id").alias("entity"), "effective", codes.alias("items"))
    span = ev.agg(F.min("effective"), F.date_sub(F.max("effective"), 2)).first()
    return events.event_features(ev.select("entity", F.col("effective").alias("d")).distinct(), ev, F.lit(span[0]), F.lit(span[1]))


def _trades(spark, sf_dir):
    """Orders as trades: code by status, shares by customer, each third one filed twice."""
    f = _facts(spark, sf_dir)
    base = f.select("entity", "filed_date", F.date_sub("filed_date", 2).alias("trans_date"), F.when(F.col("code") == "O", "P").when(F.col("code") == "F", "S").otherwise("A").alias("trans_code"), (F.col("o_custkey") % 50).cast("double").alias("shares"), F.when(F.col("o_orderkey") % 9 != 0, F.round("value", 2)).alias("price_per_share"), F.when(F.col("o_orderkey") % 11 != 0, F.col("value")).alias("value_usd"), F.col("o_custkey").alias("owner"), (F.col("o_orderpriority") == "1-URGENT").alias("is_officer"), F.col("o_orderkey").cast("string").alias("accession"), F.when(F.col("o_orderkey") % 13 == 0, "deriv").otherwise("nonderiv").alias("table_kind"))
    return base.unionByName(base.filter("CAST(accession AS BIGINT) % 3 = 0").withColumns({"accession": F.concat("accession", F.lit("b")), "filed_date": F.date_add("filed_date", 1)}))


_TRADES = f"{FACTS}, tb AS (SELECT entity, filed_date, filed_date - 2 AS trans_date, CASE code WHEN 'O' THEN 'P' WHEN 'F' THEN 'S' ELSE 'A' END AS trans_code, CAST(o_custkey % 50 AS DOUBLE) AS shares, CASE WHEN o_orderkey % 9 <> 0 THEN round(value, 2) END AS price_per_share, CASE WHEN o_orderkey % 11 <> 0 THEN value END AS value_usd, o_custkey AS owner, o_orderpriority = '1-URGENT' AS is_officer, CAST(o_orderkey AS VARCHAR) AS accession, CASE WHEN o_orderkey % 13 = 0 THEN 'deriv' ELSE 'nonderiv' END AS table_kind FROM facts), trades AS (SELECT * FROM tb UNION ALL SELECT * REPLACE (accession || 'b' AS accession, filed_date + 1 AS filed_date) FROM tb WHERE CAST(accession AS BIGINT) % 3 = 0)"


@query("trade_dedup_window", f"WITH {_TRADES}, pr AS (SELECT DISTINCT entity, CAST(date_trunc('month', filed_date) AS DATE) AS d FROM facts), nt AS (SELECT pr.d, t.*, row_number() OVER (PARTITION BY t.entity, pr.d, trans_date, trans_code, shares, price_per_share ORDER BY filed_date, accession) AS k FROM pr JOIN trades t ON t.entity = pr.entity AND filed_date BETWEEN pr.d - 90 AND pr.d WHERE table_kind = 'nonderiv'), ag AS (SELECT entity, d, count(*) FILTER (trans_code = 'P') AS buy_count, count(*) FILTER (trans_code = 'S') AS sell_count, coalesce(sum(value_usd) FILTER (trans_code = 'P'), 0) AS bv, coalesce(sum(value_usd) FILTER (trans_code = 'S'), 0) AS sv, count(DISTINCT owner) FILTER (trans_code = 'P') AS buyer_count, count(*) FILTER (trans_code = 'P' AND is_officer) AS officer_buy_count, max(filed_date) FILTER (trans_code = 'P') AS l FROM nt WHERE k = 1 GROUP BY 1, 2) SELECT pr.entity, pr.d, coalesce(buy_count, 0) AS buy_count, coalesce(sell_count, 0) AS sell_count, round(coalesce(bv, 0), 2) AS buy_value, round(coalesce(bv - sv, 0), 2) AS net_buy_value, coalesce(buyer_count, 0) AS buyer_count, coalesce(officer_buy_count, 0) AS officer_buy_count, CAST(date_diff('day', l, pr.d) AS INTEGER) AS days_since_buy FROM pr LEFT JOIN ag ON ag.entity = pr.entity AND ag.d = pr.d")
def trade_dedup_window(spark, sf_dir):
    probes = _facts(spark, sf_dir).select("entity", F.to_date(F.date_trunc("month", "filed_date")).alias("d")).distinct()
    return events.trade_features(probes, _trades(spark, sf_dir)).withColumns({c: F.round(c, 2) for c in ("buy_value", "net_buy_value")})


@query("owner_collapse", "SELECT CAST(o_custkey AS VARCHAR) AS accession, bool_or(o_orderpriority = '1-URGENT') AS is_officer, bool_or(o_orderstatus = 'P') AS is_director, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS owner_ids, substring(string_agg('n' || o_orderkey, ' | ' ORDER BY o_orderkey), 1, 300) AS owner_names, substring(coalesce(string_agg('the ' || o_orderpriority, ' | ' ORDER BY o_orderkey) FILTER (o_orderpriority < '4'), ''), 1, 200) AS owner_titles, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS relationships FROM orders GROUP BY 1")
def owner_collapse(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    rows = o.select(F.col("o_custkey").cast("string").alias("accession"), F.col("o_orderkey").alias("owner"), F.concat(F.lit("n"), "o_orderkey").alias("owner_name"), F.when(F.col("o_orderpriority") < "4", F.concat(F.lit(" the "), "o_orderpriority")).otherwise(" ").alias("owner_title"), F.col("o_orderstatus").alias("relationship"), (F.col("o_orderpriority") == "1-URGENT").alias("is_officer"), (F.col("o_orderstatus") == "P").alias("is_director"))
    return events.owners(rows)


_EPS = "eps AS (SELECT CAST(c_nationkey AS BIGINT) AS entity, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period_end, avg(o_totalprice) / 1000 AS eps FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"


@query("sue_surprise", f"WITH {_EPS}, nb AS (SELECT a.entity, a.period_end, a.eps, b.eps AS then_eps FROM eps a JOIN eps b ON a.entity = b.entity AND b.period_end < a.period_end AND date_diff('day', b.period_end, a.period_end) BETWEEN 320 AND 410 QUALIFY row_number() OVER (PARTITION BY a.entity, a.period_end ORDER BY abs(date_diff('day', b.period_end, a.period_end) - 365), b.period_end) = 1), dr AS (SELECT *, then_eps + coalesce(avg(eps - then_eps) OVER (PARTITION BY entity ORDER BY period_end ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 0) AS expected FROM nb), su AS (SELECT *, eps - expected AS surprise FROM dr), sp AS (SELECT *, CASE WHEN count(surprise) OVER w >= 5 THEN stddev_samp(surprise) OVER w END AS s FROM su WINDOW w AS (PARTITION BY entity ORDER BY period_end ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)) SELECT entity, period_end, round(expected, 6) AS expected, round(surprise, 6) AS surprise, round(CASE WHEN s > 0 THEN surprise / s END, 6) AS sue FROM sp")
def sue_surprise(spark, sf_dir):
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    eps = o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").cast("long").alias("entity"), F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("period_end")).agg((F.avg("o_totalprice") / 1000).alias("eps")).withColumn("filed_date", F.date_add("period_end", 40))
    return rounded(pit.surprises(eps).drop("filed_date"))


@query("filing_cadence", f"WITH {FACTS}, fd AS (SELECT DISTINCT entity, filed_date FROM facts WHERE code = 'P'), g AS (SELECT *, date_diff('day', lag(filed_date) OVER (PARTITION BY entity ORDER BY filed_date), filed_date) AS gap FROM fd) SELECT entity, filed_date, CAST(gap AS INTEGER) AS gap, median(gap) OVER (PARTITION BY entity ORDER BY filed_date ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS cadence FROM g")
def filing_cadence(spark, sf_dir):
    return pit.cadence(_facts(spark, sf_dir).filter("code = 'P'").select("entity", "filed_date").distinct())


@query("earnings_timing", f"WITH {FACTS}, {NATIONS}, fd AS (SELECT DISTINCT entity, filed_date FROM facts WHERE code = 'P'), g AS (SELECT *, date_diff('day', lag(filed_date) OVER (PARTITION BY entity ORDER BY filed_date), filed_date) AS gap FROM fd), c AS (SELECT *, median(gap) OVER (PARTITION BY entity ORDER BY filed_date ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS cadence FROM g) SELECT nb.entity, nb.d, CAST(date_diff('day', c.filed_date, nb.d) AS INTEGER) AS days_since, cadence - date_diff('day', c.filed_date, nb.d) AS expected_until FROM nb ASOF LEFT JOIN c ON nb.entity = c.entity AND nb.d >= c.filed_date")
def earnings_timing(spark, sf_dir):
    """Days since the last filing, and until the next as the filer's own past gaps suggest it."""
    filings = pit.cadence(_facts(spark, sf_dir).filter("code = 'P'").select("entity", "filed_date").distinct())
    return pit.timing(asof.backward(_nation_weeks(spark, sf_dir), filings, "entity", "d", "filed_date", ["cadence"]), "d", "filed_date_asof")


@query("revision_breadth", "SELECT o_custkey AS entity, round((o_totalprice - prev) / nullif(abs(prev), 0), 6) AS eps_revision_1m, CASE WHEN up + down > 0 THEN round((up - down) / CAST(up + down AS DOUBLE), 6) END AS eps_revision_breadth_30d FROM (SELECT o_custkey, o_totalprice, lag(o_totalprice) OVER w AS prev, o_orderkey % 4 AS up, o_orderkey % 3 AS down FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))")
def revision_breadth(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity"), F.col("o_totalprice").alias("eps_current"), F.lag("o_totalprice").over(w).alias("eps_30d_ago"), F.lit(None).cast("double").alias("eps_90d_ago"), (F.col("o_orderkey") % 4).alias("up_last_30d"), (F.col("o_orderkey") % 3).alias("down_last_30d"))
    return rounded(pit.revisions(o).select("entity", "eps_revision_1m", "eps_revision_breadth_30d"))


@query("validation_gate", "WITH p AS (SELECT l_returnflag AS concept, l_extendedprice AS ours, CASE WHEN l_orderkey % 10 <> 0 THEN l_quantity * 1000 END AS theirs, l_orderkey, l_partkey, l_suppkey FROM lineitem), f AS (SELECT *, abs(ours - theirs) / abs(nullif(theirs, 0)) * 100 AS diff, rank() OVER (PARTITION BY concept ORDER BY ours) + (count(*) OVER (PARTITION BY concept, ours) - 1) / 2.0::DOUBLE AS ra, rank() OVER (PARTITION BY concept ORDER BY theirs) + (count(*) OVER (PARTITION BY concept, theirs) - 1) / 2.0::DOUBLE AS rb FROM p WHERE theirs IS NOT NULL) SELECT concept, (SELECT count(*) FROM p q WHERE q.concept = f.concept AND q.theirs IS NULL) AS theirs_missing, round(median(diff), 6) AS median_pct_diff, round(avg(CASE WHEN diff > 100 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS share_over_100, round(covar_pop(ra, rb) / (stddev_pop(ra) * stddev_pop(rb)), 6) AS spearman_ic, median(diff) <= 10 AND covar_pop(ra, rb) / (stddev_pop(ra) * stddev_pop(rb)) >= 0.9::DOUBLE AS passes FROM f GROUP BY concept")
def validation_gate(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("concept"), F.col("l_extendedprice").alias("ours"), F.when(F.col("l_orderkey") % 10 != 0, F.col("l_quantity") * 1000).alias("theirs"))
    return rounded(pit.validation(li).select("concept", "theirs_missing", "median_pct_diff", "share_over_100", "spearman_ic", "passes"))


@query("interior_gaps", f"WITH {O.BARS}, sp AS (SELECT entity, min(d) AS a, max(d) AS b FROM bars GROUP BY 1) SELECT sp.entity, s.d FROM sp JOIN (SELECT DISTINCT d FROM bars) s ON s.d BETWEEN a AND b WHERE NOT EXISTS (SELECT 1 FROM bars x WHERE x.entity = sp.entity AND x.d = s.d)")
def interior_gaps(spark, sf_dir):
    return quality.interior_gaps(bars(spark, sf_dir), bars(spark, sf_dir, "all").select("d"))


@query("gap_repair_groups", f"WITH {O.BARS}, sp AS (SELECT entity, min(d) AS a, max(d) AS b FROM bars GROUP BY 1), g AS (SELECT sp.entity, s.d FROM sp JOIN (SELECT DISTINCT d FROM bars) s ON s.d BETWEEN a AND b WHERE NOT EXISTS (SELECT 1 FROM bars x WHERE x.entity = sp.entity AND x.d = s.d)), r AS (SELECT *, CASE WHEN date_diff('day', lag(d) OVER (PARTITION BY entity ORDER BY d), d) > 10 THEN 1 ELSE 0 END AS new FROM g), u AS (SELECT *, sum(new) OVER (PARTITION BY entity ORDER BY d) AS run FROM r), v AS (SELECT *, min(d) OVER (PARTITION BY entity, run) AS f FROM u) SELECT entity, min(d) AS start, max(d) AS \"end\", count(*) AS n FROM v GROUP BY entity, run, CAST(floor(date_diff('day', f, d) / 30) AS INTEGER)")
def gap_repair_groups(spark, sf_dir):
    return quality.repair_groups(quality.interior_gaps(bars(spark, sf_dir), bars(spark, sf_dir, "all").select("d")), 10, 30)


@query("thin_sessions", f"WITH {O.BARS}, c AS (SELECT d, count(*) AS n FROM bars GROUP BY 1), p AS (SELECT *, list_sort(list(n) OVER (ORDER BY d ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)) AS past FROM c) SELECT d, n, past[len(past) // 2 + 1] AS usual FROM p WHERE len(past) >= 5 AND n < 0.9::DOUBLE * past[len(past) // 2 + 1]")
def thin_sessions(spark, sf_dir):
    return quality.thin_sessions(bars(spark, sf_dir))


@query("duplicate_rows", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_rows(spark, sf_dir):
    return quality.duplicates(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("rolling_refresh_queue", "SELECT s_suppkey, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE CAST(s_acctbal AS BIGINT) END AS age FROM supplier ORDER BY age DESC NULLS FIRST, s_suppkey LIMIT (SELECT CAST(ceil(count(*) / 5.0::DOUBLE) AS BIGINT) FROM supplier)")
def rolling_refresh_queue(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 9 != 0, F.bround(F.col("s_acctbal"), 0).cast("long")).alias("age"))
    return quality.refresh_queue(s, "s_suppkey", "age", 5)


@query("incremental_tail_plan", f"WITH {O.BARS}, l AS (SELECT entity, max(d) AS last FROM bars WHERE entity % 6 <> 0 GROUP BY 1), w AS (SELECT s_suppkey AS entity, last FROM supplier LEFT JOIN l ON l.entity = s_suppkey) SELECT last + 1 AS start, count(*) AS n_keys, min(entity) AS first_key FROM w WHERE last IS NULL OR last < (SELECT max(d) FROM bars) GROUP BY 1")
def incremental_tail_plan(spark, sf_dir):
    b = bars(spark, sf_dir)
    last = b.agg(F.max("d")).first()[0]
    return quality.tail_plan(b.filter("entity % 6 <> 0"), watchlist(spark, sf_dir), F.lit(last))


@query("sparse_fields", "SELECT 'a' AS field, avg(CASE WHEN l_orderkey % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS null_share, avg(CASE WHEN l_orderkey % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) > 0.4::DOUBLE AS sparse FROM lineitem UNION ALL SELECT 'b', avg(CASE WHEN l_orderkey % 5 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), avg(CASE WHEN l_orderkey % 5 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) > 0.4::DOUBLE FROM lineitem")
def sparse_fields(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select(F.when(F.col("l_orderkey") % 2 != 0, 1).alias("a"), F.when(F.col("l_orderkey") % 5 != 0, 1).alias("b"))
    return quality.sparse_fields(li, ["a", "b"])


@query("symbol_match", "WITH w AS (SELECT DISTINCT p_brand AS ticker FROM part), dir AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN lower(replace(p_brand, '#', '-')) ELSE p_brand END AS symbol, CAST(hash_ AS BIGINT) AS cik FROM (SELECT *, CAST(substring(p_brand, 7) AS BIGINT) AS hash_ FROM part WHERE p_brand <> 'Brand#11')), ex AS (SELECT symbol AS ticker, min(cik) AS exact FROM dir GROUP BY 1), lo AS (SELECT regexp_replace(upper(symbol), '[^A-Z0-9]', '', 'g') AS norm, min(cik) AS loose FROM dir GROUP BY 1 HAVING count(DISTINCT cik) = 1) SELECT w.ticker, coalesce(exact, loose) AS cik FROM w LEFT JOIN ex USING (ticker) LEFT JOIN lo ON lo.norm = regexp_replace(upper(w.ticker), '[^A-Z0-9]', '', 'g')")
def symbol_match(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    names = p.filter("p_brand <> 'Brand#11'").select(F.when(F.col("p_partkey") % 2 == 0, F.lower(F.replace("p_brand", F.lit("#"), F.lit("-")))).otherwise(F.col("p_brand")).alias("symbol"), F.substring("p_brand", 7, 10).cast("long").alias("cik"))
    return quality.matched_ids(p.select(F.col("p_brand").alias("ticker")).distinct(), names)


_SPLIT = "old AS (SELECT o_custkey AS k, count(*) AS n, CASE WHEN o_custkey % 2 = 0 THEN 'kept' END AS brief FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1, 3), new AS (SELECT o_custkey AS k, count(*) AS n, CASE WHEN o_custkey % 3 = 0 THEN 'new' END AS brief FROM orders WHERE o_orderkey % 5 = 0 GROUP BY 1, 3)"


def _old_new(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    part = lambda c, m, w: o.filter(c).groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n")).withColumn("brief", F.when(F.col("k") % m == 0, w))
    return part("o_orderkey % 2 = 0", 2, "kept"), part("o_orderkey % 5 = 0", 3, "new")


@query("upsert_merge", f"WITH {_SPLIT} SELECT * FROM new UNION ALL SELECT * FROM old WHERE k NOT IN (SELECT k FROM new)")
def upsert_merge(spark, sf_dir):
    return quality.upsert(*_old_new(spark, sf_dir), "k")


@query("coalesce_upsert", f"WITH {_SPLIT} SELECT coalesce(new.k, old.k) AS k, coalesce(new.n, old.n) AS n, coalesce(new.brief, old.brief) AS brief FROM new FULL JOIN old ON new.k = old.k")
def coalesce_upsert(spark, sf_dir):
    old, new = _old_new(spark, sf_dir)
    return quality.upsert_keeping(old, new, "brief", "k")


_CLEAN = "html"
for _rx, _to in ((r"(?is)<script[^>]*>.*?</script>", " "), (r"(?is)<style[^>]*>.*?</style>", " "), (r"(?s)<[^>]+>", " ")):
    _CLEAN = f"regexp_replace({_CLEAN}, '{_rx}', '{_to}', 'g')"
_CLEAN = f"replace(replace(replace({_CLEAN}, '&nbsp;', ' '), '&amp;', '&'), '&#8217;', '''')"
_CLEAN = f"trim(regexp_replace(regexp_replace({_CLEAN}, '&[a-zA-Z#0-9]+;', ' ', 'g'), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))"


@query("html_to_text", f"SELECT page_id, {_CLEAN} AS text FROM pages")
def html_to_text(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", scalar.html_text(F.col("html")).alias("text"))


@query("item_codes", f"SELECT event_id, len(list_filter(list_transform(string_split({_ITEMS}, ','), lambda c: trim(c)), lambda c: c NOT IN ('9.01', '5.07'))) > 0 AS material FROM events")
def item_codes(spark, sf_dir):
    k = F.col("event_id") % 5
    codes = F.when(k == 0, "2.02,9.01").when(k == 1, "5.02").when(k == 2, "9.01").when(k == 3, "1.01, 7.01").otherwise("4.02,5.07")
    return read(spark, sf_dir, "events").select("event_id", scalar.is_material(codes).alias("material"))


@query("json_contract", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE '{\"k\":' || CAST(json_extract(props, '$.k') AS VARCHAR) || ',\"s\":\"x\"}' END AS facts FROM events")
def json_contract(spark, sf_dir):
    """An answer with a key missing, one that is no JSON, one with the keys asked for, and one with more."""
    k, inner = F.col("event_id") % 4, F.regexp_extract("props", r"\{(.*)\}", 1)
    text = F.when(k == 0, F.concat(F.lit("Answer: {"), inner, F.lit("} done"))).when(k == 1, F.lit("{not json}")).when(k == 2, F.concat(F.lit("{"), inner, F.lit(', "s": "x"}'))).otherwise(F.concat(F.lit('Sure: {"s": "x", '), inner, F.lit(', "more": [1]} .')))
    return read(spark, sf_dir, "events").select("event_id", scalar.one_json(text, ["k", "s"]).alias("facts"))


@query("weekday_distance", "SELECT event_id, CAST((SELECT count(*) FROM range(1, 9) r(i) WHERE isodow(CAST(ts AS DATE) + CAST(i AS INTEGER)) <= 5) AS INTEGER) AS n FROM events")
def weekday_distance(spark, sf_dir):
    day = F.to_date("ts")
    return read(spark, sf_dir, "events").select("event_id", scalar.weekdays_between(day, F.date_add(day, 9)).alias("n"))


_SECTORS = [*C.SECTOR_NORMALIZE, *C.SECTOR_BENCHMARKS, "Other"]
_OF_MAP = lambda pairs, x: "CASE " + x + " " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in pairs.items())


@query("sector_benchmark", f"WITH p AS (SELECT p_partkey, [{', '.join(repr(x) for x in _SECTORS)}][1 + CAST(p_partkey % {len(_SECTORS)} AS INTEGER)] AS sector, CASE p_partkey % 5 WHEN 0 THEN 'mid' WHEN 1 THEN 'small' ELSE 'large' END AS bucket, CASE WHEN p_partkey % 7 = 0 THEN 'Semiconductor Equipment' ELSE 'other' END AS industry FROM part), n AS (SELECT *, {_OF_MAP(C.SECTOR_NORMALIZE, 'sector')} ELSE sector END AS normal FROM p) SELECT p_partkey, sector, normal, CASE WHEN industry LIKE 'Semi%' THEN 'SMH' WHEN bucket = 'mid' THEN 'MDY' WHEN bucket = 'small' THEN 'IWM' ELSE {_OF_MAP(C.SECTOR_BENCHMARKS, 'normal')} ELSE 'SPY' END END AS benchmark FROM n")
def sector_benchmark(spark, sf_dir):
    """Names of sectors made alike, and the benchmark by industry, size and sector, for every name there is."""
    k = F.col("p_partkey")
    p = read(spark, sf_dir, "part").select("p_partkey", F.get(F.array(*[F.lit(x) for x in _SECTORS]), (k % len(_SECTORS)).cast("int")).alias("sector"), F.when(k % 5 == 0, "mid").when(k % 5 == 1, "small").otherwise("large").alias("bucket"), F.when(k % 7 == 0, "Semiconductor Equipment").otherwise("other").alias("industry"))
    n = p.withColumn("normal", scalar.mapped(F.col("sector"), C.SECTOR_NORMALIZE))
    return n.select("p_partkey", "sector", "normal", scalar.benchmark_of(F.col("normal"), F.col("bucket"), F.col("industry")).alias("benchmark"))


@query("stale_and_notes", "SELECT event_id, event_id % 2 = 1 AND NOT event_id % 3 = 1 AS stale, CASE WHEN value / 1000 > 0.1::DOUBLE THEN 'consider raising' WHEN value / 1000 < -0.05::DOUBLE THEN 'consider lowering' ELSE 'keep' END AS note FROM events WHERE value IS NOT NULL")
def stale_and_notes(spark, sf_dir):
    e = read(spark, sf_dir, "events").filter("value IS NOT NULL")
    return e.select("event_id", scalar.stale_fundamentals((F.col("event_id") % 2).cast("int"), F.when(F.col("event_id") % 3 == 1, 1)).alias("stale"), scalar.weight_note(F.col("value") / 1000).alias("note"))


@query("nested_facts", "SELECT CAST(o_custkey AS VARCHAR) AS cik, CASE o_orderstatus WHEN 'F' THEN 'Revenues' ELSE 'Assets' END AS tag, CAST(o_orderkey AS VARCHAR) AS accession, o_totalprice AS value FROM orders WHERE o_orderkey % 10 <> 0")
def nested_facts(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    fact = F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("end"), F.lit("").alias("start"), F.col("o_totalprice").alias("val"), F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderkey").cast("string")).alias("accn"), F.year("o_orderdate").alias("fy"), F.lit("FY").alias("fp"), F.lit("10-K").alias("form"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("filed"))
    tags = o.withColumn("tag", F.when(F.col("o_orderstatus") == "F", "Revenues").otherwise("Assets")).groupBy("o_custkey", "tag").agg(F.collect_list(fact).alias("rows"))
    per = tags.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("tag", F.struct(F.create_map(F.lit("USD"), F.col("rows")).alias("units"))))).alias("m"))
    raw = per.select(F.col("o_custkey").cast("string").alias("cik"), F.to_json(F.struct(F.create_map(F.lit("us-gaap"), F.col("m")).alias("facts"))).alias("json"))
    return files.company_facts(raw).select("cik", "tag", "accession", "value")


@query("filing_blocks", "SELECT CAST(o_custkey AS VARCHAR) AS cik, CAST(o_orderkey AS VARCHAR) AS accession, CAST(o_orderdate AS DATE) AS filed_date FROM orders WHERE o_orderstatus = 'F' AND CAST(o_orderdate AS DATE) >= DATE '1996-01-01'")
def filing_blocks(spark, sf_dir):
    o = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("cik")).agg(F.collect_list(F.struct("o_orderkey", "o_orderstatus", "o_orderdate")).alias("x"))
    get = lambda f: F.transform("x", lambda r: f(r))
    day = lambda r: F.date_format(r["o_orderdate"], "yyyy-MM-dd")
    block = F.struct(get(lambda r: r["o_orderkey"].cast("string")).alias("accessionNumber"), get(lambda r: r["o_orderstatus"]).alias("form"), get(day).alias("filingDate"), get(day).alias("acceptanceDateTime"), get(lambda r: F.lit("2.02")).alias("items"))
    return files.filing_blocks(o.select("cik", F.to_json(block).alias("json")), ["F"], "1996-01-01").select("cik", "accession", "filed_date")


@query("trailing_dollar_adv", f"WITH {O.BARS} SELECT entity, d, round(nullif(greatest(avg(close * volume) {O.rows(20)}, 0), 0), 6) AS adv FROM bars")
def trailing_dollar_adv(spark, sf_dir):
    return rounded(bars(spark, sf_dir).select("entity", "d", features.dollar_adv().alias("adv")))


@query("expanding_percentile", f"WITH {O.MARKET}, x AS (SELECT entity, d, close, list(close) OVER (ORDER BY d) AS past FROM market) SELECT entity, d, CASE WHEN len(past) >= {C.MACRO_MIN_HISTORY} THEN round(len(list_filter(past, lambda v: v < close)) / CAST(len(past) AS DOUBLE) * 100, 6) END AS pct FROM x")
def expanding_percentile(spark, sf_dir):
    found = expanding.share_below_so_far(bars(spark, sf_dir, "all").select("entity", "d", "close"), "close", C.MACRO_MIN_HISTORY, "pct")
    return rounded(found.select("entity", "d", "pct"))
