"""Queries of stored tables, of the universe's upkeep, and of what is shown and checked around a run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant import config as C
from sextant.functions import scalar
from sextant.functions.scalar import rounded
from sextant.operators import events, quality, upkeep
from sextant.plans import evaluation
from sextant.plans import oracle as O
from sextant.sources import files, reads
from sextant.sources.bars import bars, read, watchlist
from sextant.sources.store import written

QUERIES, ORACLES = {}, {}
SNAPSHOT = "model_version string, run_date date, entity long, score_20d double, backfilled int, recovered int, later_column string"


def query(name: str, sql: str | None = None):
    """Registers a query, and the SQL that gives its rows."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def snapshots(spark, sf_dir):
    """Closes as stored scores: two versions, the older years backfilled, some rows without a score."""
    b = bars(spark, sf_dir).select(
        F.when(F.col("entity") % 3 == 0, "v2").otherwise("v1").alias("model_version"), F.col("d").alias("run_date"), "entity", F.when(F.col("entity") % 10 != 1, F.round("close", 6)).alias("score_20d"), (F.year("d") < 1999).alias("backfilled"), (F.weekofyear("d") % 9 == 0).alias("recovered"), F.lit(1).alias("unknown"),
    )
    return reads.snapshot_rows(b, SNAPSHOT)


_SNAP = f"{O.BARS}, snap AS (SELECT CASE WHEN entity % 3 = 0 THEN 'v2' ELSE 'v1' END AS model_version, d AS run_date, entity, CASE WHEN entity % 10 <> 1 THEN round(close, 6) END AS score_20d, CAST(year(d) < 1999 AS INTEGER) AS backfilled, CAST(weekofyear(d) % 9 = 0 AS INTEGER) AS recovered, CAST(NULL AS VARCHAR) AS later_column FROM bars)"


@query("snapshot_rows", f"WITH {_SNAP} SELECT * FROM snap")
def snapshot_rows(spark, sf_dir):
    return snapshots(spark, sf_dir)


@query("series_scan", f"WITH {O.BARS} SELECT d, {O.r6('open', 'high', 'low', 'close', 'volume')} FROM bars WHERE entity = 7 AND d <= DATE '1999-12-31'")
def series_scan(spark, sf_dir):
    from datetime import date

    return rounded(reads.one_series(bars(spark, sf_dir), 7, date(1999, 12, 31)).drop("entity"))


@query("cached_dates", f"WITH {O.BARS} SELECT d, count(*) AS n FROM bars GROUP BY 1")
def cached_dates(spark, sf_dir):
    """The dates that are there, with their bars."""
    return bars(spark, sf_dir).groupBy("d").agg(F.count(F.lit(1)).alias("n"))


@query("latest_session", f"WITH {O.MARKET} SELECT max(d) AS d FROM market")
def latest_session(spark, sf_dir):
    return bars(spark, sf_dir, "all").agg(F.max("d").alias("d"))


@query("score_map", f"WITH {_SNAP} SELECT entity, score_20d AS score FROM snap WHERE model_version = 'v1' AND run_date = DATE '1999-03-01' AND score_20d IS NOT NULL")
def score_map(spark, sf_dir):
    from datetime import date

    return reads.score_map(snapshots(spark, sf_dir), "score_20d", "v1", date(1999, 3, 1))


@query("version_dates", f"WITH {_SNAP} SELECT model_version, count(DISTINCT run_date) FILTER (backfilled = 0) AS live_dates, count(DISTINCT run_date) FILTER (backfilled = 1) AS backfilled_dates, min(run_date) AS first_date, max(run_date) AS latest_date FROM snap GROUP BY 1")
def version_dates(spark, sf_dir):
    return reads.version_dates(snapshots(spark, sf_dir))


@query("live_counts", f"WITH {_SNAP} SELECT model_version, run_date, count(*) AS n FROM snap WHERE backfilled = 0 GROUP BY 1, 2")
def live_counts(spark, sf_dir):
    return reads.live_counts(snapshots(spark, sf_dir))


@query("backfill_dates", f"WITH {_SNAP}, {O.MARKET} SELECT d AS run_date FROM market WHERE d NOT IN (SELECT run_date FROM snap WHERE model_version = 'v2')")
def backfill_dates(spark, sf_dir):
    """Sessions that a backfill of a version still has to do."""
    from sextant.sources.store import missing_dates

    wanted = bars(spark, sf_dir, "all").select(F.col("d").alias("run_date"))
    return missing_dates(wanted, reads.scan(snapshots(spark, sf_dir), {"model_version": "v2"}))


_TRADES = "tr AS (SELECT o_orderkey, CAST(c_nationkey AS BIGINT) AS entity, CAST(o_orderdate AS DATE) AS filed_date, CASE o_orderstatus WHEN 'O' THEN 'P' WHEN 'F' THEN 'S' ELSE 'A' END AS trans_code, o_totalprice AS value_usd FROM orders JOIN customer ON o_custkey = c_custkey)"


def _trades(spark, sf_dir):
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    code = F.when(F.col("o_orderstatus") == "O", "P").when(F.col("o_orderstatus") == "F", "S").otherwise("A")
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", F.col("c_nationkey").cast("long").alias("entity"), F.to_date("o_orderdate").alias("filed_date"), code.alias("trans_code"), F.col("o_totalprice").alias("value_usd"))


@query("trade_scan", f"WITH {_TRADES} SELECT * FROM tr WHERE entity = 3 AND trans_code IN ('P', 'S') AND filed_date >= DATE '1996-02-01' AND filed_date <= DATE '1998-07-31'")
def trade_scan(spark, sf_dir):
    """Trades by whichever conditions are given; a further one is left open here."""
    from datetime import date

    return reads.scan(_trades(spark, sf_dir), {"entity": 3, "o_orderkey": None}, {"trans_code": ["P", "S"]}, {"filed_date": date(1996, 2, 1)}, {"filed_date": date(1998, 7, 31)})


@query("coverage_summary", f"WITH {_TRADES} SELECT min(filed_date) AS first, least(DATE '2000-06-30', max(filed_date)) AS last, count(*) AS rows, count(DISTINCT entity) AS entities FROM tr")
def coverage_summary(spark, sf_dir):
    from sextant.sources.store import coverage

    return coverage(_trades(spark, sf_dir), "filed_date", "entity", F.to_date(F.lit("2000-06-30")))


@query("point_lookup", "SELECT k.s_suppkey, s_name, s_acctbal FROM (SELECT DISTINCT l_suppkey * 3 AS s_suppkey FROM lineitem) k LEFT JOIN supplier USING (s_suppkey)")
def point_lookup(spark, sf_dir):
    """Wanted keys, a third of them stored, with what is stored of them."""
    keys = read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") * 3).alias("s_suppkey"))
    return reads.lookup(read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal"), keys, "s_suppkey")


_WIDE = ("A", "N", "R")


@query("wide_to_long", "SELECT l_returnflag AS ticker, CAST(l_shipdate AS DATE) AS d, CAST(NULL AS DOUBLE) AS open, max(l_extendedprice) AS high, min(l_extendedprice) AS low, min(l_extendedprice) FILTER (l_linenumber < 3) AS close, CAST(NULL AS DOUBLE) AS volume FROM lineitem GROUP BY 1, 2 HAVING min(l_extendedprice) FILTER (l_linenumber < 3) IS NOT NULL")
def wide_to_long(spark, sf_dir):
    """A table by date with columns by ticker and field, taken apart; open and volume are in none of its columns."""
    li = read(spark, sf_dir, "lineitem").withColumn("d", F.to_date("l_shipdate"))
    on = lambda t, c=F.lit(True): F.when((F.col("l_returnflag") == t) & c, F.col("l_extendedprice"))
    wide = li.groupBy("d").agg(*[x for t in _WIDE for x in (F.max(on(t)).alias(f"{t}|high"), F.min(on(t)).alias(f"{t}|low"), F.min(on(t, F.col("l_linenumber") < 3)).alias(f"{t}|close"))])
    return files.wide_prices(wide)


@query("info_extraction", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id % 100 AS DOUBLE) END AS trailing_pe, CAST(value AS DOUBLE) AS price FROM events")
def info_extraction(spark, sf_dir):
    """Numbers of a JSON text under one of two spellings; infinite ones and words are none."""
    e = read(spark, sf_dir, "events")
    pe = F.when(F.col("event_id") % 10 == 0, '"Infinity"').when(F.col("event_id") % 5 == 0, '"n/a"').otherwise((F.col("event_id") % 100).cast("string"))
    key = F.when(F.col("event_id") % 2 == 0, "trailingPE").otherwise("trailing_pe")
    text = F.concat(F.lit('{"'), key, F.lit('": '), pe, F.lit("}"))
    return files.info_fields(e.select("event_id", text.alias("text"), F.col("value").cast("double").alias("price")), F.col("text"), {"trailing_pe": ("trailingPE", "trailing_pe")}).select("event_id", "trailing_pe", "price")


@query("estimate_rows", "SELECT coalesce(a.ticker, b.ticker) AS ticker, coalesce(a.period, b.period) AS period, eps, up FROM (SELECT o_custkey AS ticker, o_orderstatus AS period, round(avg(o_totalprice), 6) AS eps FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1, 2) a FULL JOIN (SELECT o_custkey AS ticker, o_orderstatus AS period, count(*) AS up FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1, 2) b ON a.ticker = b.ticker AND a.period = b.period")
def estimate_rows(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ticker"), F.col("o_orderstatus").alias("period"), "o_orderkey", "o_totalprice")
    trend = o.filter("o_orderkey % 2 = 0").groupBy("ticker", "period").agg(F.round(F.avg("o_totalprice"), 6).alias("eps"))
    return files.estimate_rows(trend, o.filter("o_orderkey % 3 = 0").groupBy("ticker", "period").agg(F.count(F.lit(1)).alias("up")))


@query("document_urls", "SELECT o_orderkey, 'https://www.sec.gov/Archives/edgar/data/' || o_custkey || '/' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') || '95000001/main.htm' AS url FROM orders")
def document_urls(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    accession = F.concat(F.lpad(F.col("o_orderkey").cast("string"), 10, "0"), F.lit("-95-000001"))
    return o.select("o_orderkey", files.document_url(F.lpad(F.col("o_custkey").cast("string"), 10, "0"), accession, F.lit("main.htm")).alias("url"))


@query("filing_text_head")
def filing_text_head(spark, sf_dir):
    """The head of each page's plain text: the cut is the feature, as only so much is sent on."""
    return read(spark, sf_dir, "pages").select("page_id", files.filing_text(F.col("html"), 200).alias("head"))


from sextant.plans.dated import _CLEAN  # noqa: E402  the SQL of html_to_text

ORACLES["filing_text_head"] = f"SELECT page_id, substring({_CLEAN}, 1, 200) AS head FROM pages"


@query("range_warnings", "SELECT event_type, count(*) AS n, count(*) FILTER (value * 2 - 40 < -60 OR value * 2 - 40 > 160) AS outside FROM events GROUP BY 1")
def range_warnings(spark, sf_dir):
    """How many values of each kind lie outside the range that a component can reach."""
    e = read(spark, sf_dir, "events").withColumn("x", F.col("value") * 2 - 40)
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(scalar.out_of_range(F.col("x")).cast("int")).alias("outside"))


@query("days_until", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 50 AS INTEGER) END AS days FROM orders")
def days_until(spark, sf_dir):
    """Days to a date given as text; past dates and what is no date give none."""
    o, at = read(spark, sf_dir, "orders"), F.to_date("o_orderdate")
    text = F.when(F.col("o_orderkey") % 4 == 0, "soon").when(F.col("o_orderkey") % 3 == 0, F.date_add(at, (F.col("o_orderkey") % 50).cast("int")).cast("string")).otherwise(F.date_sub(at, 1).cast("string"))
    return o.select("o_orderkey", scalar.days_until(text, at).alias("days"))


@query("market_priced", f"SELECT series_id, count(*) AS n FROM (SELECT CASE event_id % 2 WHEN 0 THEN '{C.MACRO_SERIES[0]}' ELSE '{C.MACRO_SERIES[1]}' END AS series_id FROM events) GROUP BY 1")
def market_priced(spark, sf_dir):
    """Series that pass the guard; tests show one that does not."""
    s = read(spark, sf_dir, "events").select(F.when(F.col("event_id") % 2 == 0, C.MACRO_SERIES[0]).otherwise(C.MACRO_SERIES[1]).alias("series_id"))
    return upkeep.market_priced(s, list(C.MACRO_SERIES)).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))


@query("cutoff_coverage", "SELECT side, count(*) AS n, round(sum(len(text)) / 4.0::DOUBLE, 6) AS tokens, side = 'before' OR count(*) >= 200 AS enough FROM (SELECT CASE WHEN DATE '2024-01-01' + CAST(turn AS INTEGER) <= DATE '2024-01-03' THEN 'before' ELSE 'after' END AS side, text FROM conversations) GROUP BY 1")
def cutoff_coverage(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("turn").cast("int")).alias("at"), "text")
    return rounded(upkeep.cutoff_coverage(c, "at", F.lit("2024-01-03").cast("date"), F.length("text")))


@query("benchmark_coverage", f"WITH {O.REGION}, {O.WATCH} SELECT CASE WHEN entity % 4 = 0 THEN -99 ELSE benchmark END AS benchmark, count(*) AS n FROM watch WHERE CASE WHEN entity % 4 = 0 THEN -99 ELSE benchmark END NOT IN (SELECT entity FROM region_bars) GROUP BY 1")
def benchmark_coverage(spark, sf_dir):
    watch = watchlist(spark, sf_dir).withColumn("benchmark", F.when(F.col("entity") % 4 == 0, -99).otherwise(F.col("benchmark")))
    return upkeep.without_benchmark(bars(spark, sf_dir, "region"), watch)


@query("short_histories", f"WITH {O.BARS}, {O.WATCH} SELECT w.entity, count(b.d) AS n FROM watch w LEFT JOIN (SELECT * FROM bars WHERE entity % 5 <> 0) b USING (entity) GROUP BY 1 HAVING count(b.d) < 252")
def short_histories(spark, sf_dir):
    return upkeep.short_histories(bars(spark, sf_dir).filter("entity % 5 <> 0"), watchlist(spark, sf_dir), 252)


@query("first_listing", "SELECT entity, min(source) AS source FROM (SELECT s_suppkey AS entity, 'a' AS source FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, 'b' FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_suppkey, 'c' FROM supplier) GROUP BY 1")
def first_listing(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity"))
    return quality.first_listing(*[s.filter(c).withColumn("source", F.lit(n)) for n, c in (("a", "entity % 2 = 0"), ("b", "entity % 3 = 0"), ("c", "TRUE"))])


_HIST = "h AS (SELECT DISTINCT CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' ELSE 'other' END AS index_name, CAST(date_trunc('month', o_orderdate) AS DATE) AS as_of_date, o_custkey AS member FROM orders WHERE o_orderpriority = '1-URGENT' OR month(o_orderdate) % 2 = 1)"


def history(spark, sf_dir):
    """Monthly listings of two indices; one of them is listed every other month."""
    o = read(spark, sf_dir, "orders").filter((F.col("o_orderpriority") == "1-URGENT") | (F.month("o_orderdate") % 2 == 1))
    return o.select(F.when(F.col("o_orderpriority") == "1-URGENT", "urgent").otherwise("other").alias("index_name"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("as_of_date"), F.col("o_custkey").alias("member")).distinct()


@query("membership_asof", f"WITH {_HIST}, p AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders WHERE day(o_orderdate) = 15), w AS (SELECT d, index_name, max(as_of_date) AS as_of_date FROM p JOIN (SELECT DISTINCT index_name, as_of_date FROM h) ON as_of_date <= d GROUP BY 1, 2) SELECT DISTINCT d, index_name, member FROM w JOIN h USING (index_name, as_of_date)")
def membership_asof(spark, sf_dir):
    days = read(spark, sf_dir, "orders").filter(F.dayofmonth("o_orderdate") == 15).select(F.to_date("o_orderdate").alias("d")).distinct()
    return quality.members_as_of(history(spark, sf_dir), days)


@query("survivorship", f"WITH {_HIST}, t AS (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0), m AS (SELECT DISTINCT as_of_date, member FROM h) SELECT as_of_date, count(*) AS members, count(*) FILTER (c_custkey IS NULL) AS missing, round(count(*) FILTER (c_custkey IS NULL) / CAST(count(*) AS DOUBLE) * 100, 6) AS missing_pct FROM m LEFT JOIN t ON member = c_custkey GROUP BY 1")
def survivorship(spark, sf_dir):
    tracked = read(spark, sf_dir, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("member"))
    return rounded(quality.survivorship(history(spark, sf_dir).select("as_of_date", "member"), tracked))


@query("ever_members", f"WITH {_HIST} SELECT DISTINCT member FROM h")
def ever_members(spark, sf_dir):
    return upkeep.ever_members(history(spark, sf_dir))


@query("still_tracked", f"WITH {_HIST} SELECT member FROM h INTERSECT SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0")
def still_tracked(spark, sf_dir):
    return upkeep.still_tracked(history(spark, sf_dir), read(spark, sf_dir, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("member")))


_BENCH = "CASE WHEN contains(lower(industry), 'semiconductor') THEN 'SMH' WHEN size_bucket = 'mid' THEN 'MDY' WHEN size_bucket = 'small' THEN 'IWM' WHEN sector = 'Energy' THEN 'XLE' ELSE 'SPY' END"
_LISTED = f"ex AS (SELECT replace(s_name, '#', '-') AS ticker, 'Energy' AS sector, 'XLE' AS benchmark, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 'mid' END AS size_bucket, 'kept' AS notes FROM supplier WHERE s_suppkey % 2 = 0), li AS (SELECT replace(s_name, '#', '.') AS symbol, CASE WHEN s_nationkey % 2 = 0 THEN 'Energy' ELSE 'Other' END AS sector, CASE WHEN s_nationkey % 5 = 0 THEN 'Semiconductors' ELSE 'Oil' END AS industry, CASE s_suppkey % 3 WHEN 0 THEN 'large' WHEN 1 THEN 'mid' ELSE 'small' END AS size_bucket, src AS source FROM supplier, (VALUES ('a'), ('b')) v(src))"


@query("grown_watchlist", f"WITH {_LISTED}, nw AS (SELECT replace(symbol, '.', '-') AS ticker, sector, {_BENCH} AS benchmark, size_bucket, source || '_auto' AS notes FROM li WHERE source = 'a' AND replace(symbol, '.', '-') NOT IN (SELECT ticker FROM ex)), held AS (SELECT ticker, sector, benchmark, coalesce(size_bucket, 'large') AS size_bucket, notes FROM ex UNION ALL SELECT * FROM nw) SELECT * FROM held UNION ALL SELECT ticker, 'Index', 'SPY', '', 'benchmark' FROM (SELECT benchmark AS ticker FROM held UNION SELECT 'SPY') WHERE ticker NOT IN (SELECT ticker FROM held)")
def grown_watchlist(spark, sf_dir):
    """A watchlist grown by two listings, and grown once more from its own result, which changes nothing."""
    s = read(spark, sf_dir, "supplier")
    name = lambda c: F.replace("s_name", F.lit("#"), F.lit(c))
    existing = s.filter("s_suppkey % 2 = 0").select(name("-").alias("ticker"), F.lit("Energy").alias("sector"), F.lit("XLE").alias("benchmark"), F.when(F.col("s_suppkey") % 4 != 0, "mid").alias("size_bucket"), F.lit("kept").alias("notes"))
    bucket = F.when(F.col("s_suppkey") % 3 == 0, "large").when(F.col("s_suppkey") % 3 == 1, "mid").otherwise("small")
    listed = s.select(name(".").alias("symbol"), F.when(F.col("s_nationkey") % 2 == 0, "Energy").otherwise("Other").alias("sector"), F.when(F.col("s_nationkey") % 5 == 0, "Semiconductors").otherwise("Oil").alias("industry"), bucket.alias("size_bucket"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("source"))
    return upkeep.grown_watchlist(upkeep.grown_watchlist(existing, listed), listed)


@query("carried_reports", "SELECT o_orderpriority AS version, 'new' AS kind, count(*) AS n FROM orders WHERE o_orderpriority < '3' GROUP BY 1 UNION ALL SELECT o_orderpriority, 'old', count(*) FROM orders WHERE NOT o_orderpriority < '3' AND o_orderkey % 2 = 0 GROUP BY 1")
def carried_reports(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    report = lambda df, kind: df.groupBy(F.col("o_orderpriority").alias("version")).agg(F.count(F.lit(1)).alias("n")).select("version", F.lit(kind).alias("kind"), "n")
    return upkeep.carried(report(o.filter("o_orderpriority < '3'"), "new"), report(o.filter("o_orderkey % 2 = 0"), "old"), "version")


@query("sessions_back", f"WITH {O.MARKET} SELECT d, coalesce(lag(d, 20) OVER (ORDER BY d), (SELECT min(d) FROM market)) AS back FROM market")
def sessions_back(spark, sf_dir):
    return upkeep.sessions_back(bars(spark, sf_dir, "all").select("d"), 20)


@query("labelled_rows", "SELECT l_suppkey, count(*) AS n, coalesce(any_value(s_name), CAST(l_suppkey AS VARCHAR)) AS label FROM (SELECT l_suppkey + CAST(l_linenumber = 1 AS BIGINT) * 100000 AS l_suppkey FROM lineitem) LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1")
def labelled_rows(spark, sf_dir):
    """Rows shown with names; those of unknown keys show the key."""
    counts = read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") + F.when(F.col("l_linenumber") == 1, 100000).otherwise(0)).alias("l_suppkey")).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return upkeep.labelled_rows(counts, read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey", "s_name")


@query("entry_json", "SELECT o_orderkey, '{\"o_custkey\":' || o_custkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\",\"gone\":null}' AS entry FROM orders")
def entry_json(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.lit(None).cast("string").alias("gone"))
    return upkeep.entry_json(o, "o_orderkey")


@query("entry_round_trip", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def entry_round_trip(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return upkeep.entries(upkeep.entry_json(o, "o_orderkey"), "o_custkey long, o_orderstatus string")


_SIG = "sg0 AS (SELECT l_suppkey AS entity, CAST(date_trunc('week', l_shipdate) AS DATE) AS d, sum(CASE l_returnflag WHEN 'A' THEN l_extendedprice WHEN 'R' THEN -l_extendedprice ELSE 0 END) AS net FROM lineitem GROUP BY 1, 2), sg AS (SELECT entity, d, round(sum(net) OVER (PARTITION BY entity ORDER BY d RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND CURRENT ROW), 2) AS value FROM sg0)"


@query("trade_signal_ic", f"{evaluation.ONLY_OUT}, {_SIG}, pr AS (SELECT o.d, value, future_excess_return_20d AS excess FROM outcome o JOIN sg ON sg.entity = o.entity AND sg.d = o.d WHERE value IS NOT NULL AND future_excess_return_20d IS NOT NULL), pv AS (SELECT * FROM pr WHERE d IN (SELECT d FROM pr GROUP BY 1 HAVING count(DISTINCT value) >= 2)), {evaluation.ic_sql('d', C.DECILE_MIN_NAMES, 'pv')} SELECT d, n, round(pearson_ic, 6) AS pearson_ic, round(spearman_ic, 6) AS spearman_ic FROM ic")
def trade_signal_ic(spark, sf_dir):
    """Net value of an entity's trades over 90 days against the excess that followed, by day."""
    from pyspark.sql import Window

    li = read(spark, sf_dir, "lineitem")
    net = F.when(F.col("l_returnflag") == "A", F.col("l_extendedprice")).when(F.col("l_returnflag") == "R", -F.col("l_extendedprice")).otherwise(0.0)
    weekly = li.groupBy(F.col("l_suppkey").cast("long").alias("entity"), F.to_date(F.date_trunc("week", "l_shipdate")).alias("d")).agg(F.sum(net).alias("net"))
    near = Window.partitionBy("entity").orderBy(F.unix_date("d")).rangeBetween(-90, 0)
    signal = weekly.select("entity", "d", F.round(F.sum("net").over(near), 2).alias("value"))
    return rounded(events.signal_ic(evaluation.outcomes(spark, sf_dir).join(signal, ["entity", "d"]), "value", "future_excess_return_20d"))


_LINE_TRADES = "tl AS (SELECT CAST(l_suppkey AS BIGINT) AS entity, CAST(l_shipdate AS DATE) AS filed_date, CAST(l_shipdate AS DATE) - 2 AS trans_date, CASE l_returnflag WHEN 'A' THEN 'P' WHEN 'R' THEN 'S' ELSE 'A' END AS trans_code, l_quantity AS shares, round(l_extendedprice / l_quantity, 2) AS price_per_share, o_orderpriority = '1-URGENT' AS is_officer, l_orderkey || '-' || l_linenumber AS accession FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 0)"
_NEAR = "tn AS (SELECT o.entity, o.d, trans_code, is_officer, row_number() OVER (PARTITION BY o.entity, o.d, trans_date, trans_code, shares, price_per_share ORDER BY filed_date, accession) AS k FROM outcome o JOIN tl ON tl.entity = o.entity AND filed_date BETWEEN o.d - 90 AND o.d), tf AS (SELECT entity, d, count(*) FILTER (trans_code = 'P' AND is_officer) AS officers FROM tn WHERE k = 1 GROUP BY 1, 2)"
_STUDY = " UNION ALL ".join(f"SELECT {h} AS horizon, d, count(*) FILTER (flag > 0) AS n_events, count(*) FILTER (flag = 0) AS n_controls, round(avg(x) FILTER (flag > 0) - avg(x) FILTER (flag = 0), 6) AS spread, round(avg(CASE WHEN x > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (flag > 0) * 100, 6) AS hit_pct FROM (SELECT o.d, coalesce(officers, 0) AS flag, future_excess_return_{h}d AS x FROM outcome o LEFT JOIN tf ON tf.entity = o.entity AND tf.d = o.d) WHERE x IS NOT NULL GROUP BY 2 HAVING count(*) FILTER (flag > 0) >= 3 AND count(*) FILTER (flag = 0) >= 3" for h in evaluation.HORIZONS)


@query("trade_event_study", f"{evaluation.ONLY_OUT}, {_LINE_TRADES}, {_NEAR} {_STUDY}")
def trade_event_study(spark, sf_dir):
    """By day and horizon: the excess that followed where an officer had bought within 90 days, against the other names;
    from the features of the trades as they were filed, repeated reports counted once."""
    li, o = read(spark, sf_dir, "lineitem").filter("l_quantity > 0"), read(spark, sf_dir, "orders")
    filed = F.to_date("l_shipdate")
    code = F.when(F.col("l_returnflag") == "A", "P").when(F.col("l_returnflag") == "R", "S").otherwise("A")
    trades = li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("l_suppkey").cast("long").alias("entity"), filed.alias("filed_date"), F.date_sub(filed, 2).alias("trans_date"), code.alias("trans_code"), F.col("l_quantity").alias("shares"), F.round(F.col("l_extendedprice") / F.col("l_quantity"), 2).alias("price_per_share"),
        F.col("l_extendedprice").alias("value_usd"), F.col("o_custkey").alias("owner"), (F.col("o_orderpriority") == "1-URGENT").alias("is_officer"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("accession"), F.lit("nonderiv").alias("table_kind"),
    )
    out = written(evaluation.outcomes(spark, sf_dir), "outcomes")
    bought = events.trade_features(out.select("entity", "d"), trades).select("entity", "d", "officer_buy_count")
    df = written(out.join(bought, ["entity", "d"]), "trade-features")
    each = [events.day_spread(df, "officer_buy_count", f"future_excess_return_{h}d", 3, 3).withColumn("horizon", F.lit(h)) for h in evaluation.HORIZONS]
    return rounded(reduce(DataFrame.unionByName, each))
