"""Queries of figures as they stood: facts filed by a date, balances, trailing years, debt, ratios, quarterly earnings.

The facts are made from the orders: each nation files its quarters, parts of years and years some weeks after they end,
under tags that change, and files all of it once more, restated, a year later."""

from __future__ import annotations

from pyspark.sql import functions as F

from sextant import config as C
from sextant.functions.scalar import rounded
from sextant.operators import asof, figures, pit
from sextant.sources.bars import read

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    """Registers a query, and the SQL that gives its rows."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


#: (tag, value, condition) of balances at a quarter's end, and of flows (tag, value of the quarter, of the year so far, condition);
#: expressions that both engines read alike.
BALANCES = (
    ("'StockholdersEquity'", "CASE WHEN entity % 5 = 0 THEN -bal ELSE bal END", "TRUE"), ("CASE WHEN entity % 3 = 1 THEN 'dei:EntityCommonStockSharesOutstanding' ELSE 'CommonStockSharesOutstanding' END", "n", "TRUE"),
    ("CASE WHEN entity % 4 = 3 THEN 'LongTermDebtAndCapitalLeaseObligations' ELSE 'LongTermDebtNoncurrent' END", "rev / 4", "entity % 6 <> 5"), ("'LongTermDebtCurrent'", "rev / 20", "entity % 2 = 0"),
    ("'FinanceLeaseLiability'", "rev / 50", "TRUE"), ("'OperatingLeaseLiabilityNoncurrent'", "rev / 80", "entity % 3 <> 2"), ("'OperatingLeaseLiabilityCurrent'", "rev / 160", "entity % 3 = 0"), ("'OperatingLeaseLiability'", "rev / 70", "TRUE"),
    ("'AssetsCurrent'", "rev / 2", "fy < 1999 OR entity % 7 <> 0"), ("'LiabilitiesCurrent'", "rev / 3", "TRUE"),
)
FLOWS = (
    ("CASE WHEN entity % 4 = 1 AND fy >= 1999 THEN 'SalesRevenueNet' ELSE 'Revenues' END", "rev", "ytd_rev", "TRUE"), ("'NetIncomeLoss'", "inc", "ytd_inc", "TRUE"), ("'OperatingIncomeLoss'", "inc - rev / 10", "ytd_inc - ytd_rev / 10", "i % 2 = 0"),
    ("'EarningsPerShareBasic'", "inc / n", "ytd_inc / n", "entity % 2 = 0"), ("'EarningsPerShareDiluted'", "inc / n / 2", "ytd_inc / n / 2", "entity % 3 = 0 AND fy >= 1997"),
)
#: (start, which value, fiscal period, days until filed, condition) of the periods that are filed for a quarter i of a year.
PERIODS = (("qs", 0, "concat('Q', i)", 40, "(i < 4 OR entity % 3 = 0)"), ("ys", 1, "concat('Q', i)", 40, "(i IN (2, 3) AND entity % 3 <> 0)"), ("ys", 1, "'FY'", 60, "(i = 4 AND entity % 3 <> 0)"))


def _each():
    """(tag, start, value, fiscal period, days until filed, condition) of everything that is filed for a quarter."""
    for tag, value, condition in BALANCES:
        yield tag, None, value, "concat('Q', i)", 40, condition
    for tag, value, so_far, condition in FLOWS:
        for start, which, period, days, when in PERIODS:
            yield tag, start, (value, so_far)[which], period, days, f"({condition}) AND {when}"


def facts(spark, sf_dir):
    """(entity, tag, period_start, period_end, fiscal_year, fiscal_period, value, filed_date, accession)."""
    from pyspark.sql import Window

    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    q = o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").cast("long").alias("entity"), F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("qs")).agg(
        F.sum("o_totalprice").alias("rev"), F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(F.col("o_totalprice") * -0.5)).alias("inc"), F.sum("c_acctbal").alias("bal"), F.count(F.lit(1)).cast("double").alias("n")
    )
    q = q.withColumns({"fy": F.year("qs"), "i": F.quarter("qs"), "ys": F.to_date(F.date_trunc("year", "qs")), "qe": F.date_sub(F.add_months("qs", 3), 1)})
    so_far = Window.partitionBy("entity", "fy").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    q = q.withColumns({"ytd_rev": F.sum("rev").over(so_far), "ytd_inc": F.sum("inc").over(so_far)})
    rows = [F.when(F.expr(when), F.struct(F.expr(tag).alias("tag"), (F.col(start) if start else F.lit(None).cast("date")).alias("period_start"), F.expr(value).cast("double").alias("value"), F.expr(period).alias("fiscal_period"), F.lit(days).alias("days"))) for tag, start, value, period, days, when in _each()]
    first = q.withColumn("x", F.explode(F.filter(F.array(*rows), lambda r: r.isNotNull())))
    first = first.select("entity", "x.tag", "x.period_start", F.col("qe").alias("period_end"), F.col("fy").alias("fiscal_year"), "x.fiscal_period", "x.value", F.date_add("qe", F.col("x.days")).alias("filed_date"), F.concat_ws("-", "entity", "fy", "i").alias("accession"))
    return first.unionByName(first.withColumns({"value": F.col("value") * 1.25, "filed_date": F.date_add("filed_date", 365), "accession": F.concat("accession", F.lit("r"))}))


_ONE = " UNION ALL ".join(f"SELECT entity, {tag} AS tag, {start or 'CAST(NULL AS DATE)'} AS period_start, qe AS period_end, fy AS fiscal_year, {period} AS fiscal_period, CAST({value} AS DOUBLE) AS value, qe + {days} AS filed_date, concat(entity, '-', fy, '-', i) AS accession FROM fq WHERE {when}" for tag, start, value, period, days, when in _each())
FACTS = f"""fq0 AS (SELECT CAST(c_nationkey AS BIGINT) AS entity, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS qs, sum(o_totalprice) AS rev, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE o_totalprice * -0.5 END) AS inc, sum(c_acctbal) AS bal, CAST(count(*) AS DOUBLE) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
fq1 AS (SELECT *, CAST(year(qs) AS INTEGER) AS fy, CAST(quarter(qs) AS INTEGER) AS i, CAST(date_trunc('year', qs) AS DATE) AS ys, CAST(qs + INTERVAL 3 MONTH AS DATE) - 1 AS qe FROM fq0),
fq AS (SELECT *, sum(rev) OVER w AS ytd_rev, sum(inc) OVER w AS ytd_inc FROM fq1 WINDOW w AS (PARTITION BY entity, fy ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
fct1 AS ({_ONE}), fct AS (SELECT * FROM fct1 UNION ALL SELECT * REPLACE (value * 1.25 AS value, filed_date + 365 AS filed_date, accession || 'r' AS accession) FROM fct1)"""


def trailing_sql(source: str, out: str, keys: str) -> str:
    """CTEs up to `out`: the trailing year of each key from the facts in `source`."""
    k = f"USING ({keys})"
    on = lambda a, b: " AND ".join(f"{a}.{x} = {b}.{x}" for x in keys.split(", "))
    mine = ", ".join(f"c.{x}" for x in keys.split(", "))
    return f"""{out}_o AS (SELECT *, date_diff('day', period_start, period_end) AS span FROM {source} WHERE period_start IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {keys}, period_start, period_end ORDER BY filed_date, accession) = 1),
{out}_k AS (SELECT *, CASE WHEN span BETWEEN 350 AND 380 THEN 'annual' WHEN span BETWEEN 80 AND 100 THEN 'quarter' WHEN span > 100 AND span < 350 THEN 'ytd' END AS kind FROM {out}_o),
{out}_c AS (SELECT * FROM {out}_k WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY period_end DESC, CASE kind WHEN 'annual' THEN 0 WHEN 'ytd' THEN 1 ELSE 2 END) = 1),
{out}_py AS (SELECT {mine}, max_by(o.value, o.period_end) AS py FROM {out}_c c JOIN {out}_k o ON {on('o', 'c')} AND o.kind = 'annual' AND o.fiscal_year = c.fiscal_year - 1 AND abs(date_diff('day', o.period_end, c.period_start)) <= 20 GROUP BY {mine}),
{out}_pp AS (SELECT {mine}, max_by(o.value, o.period_end) AS pp FROM {out}_c c JOIN {out}_k o ON {on('o', 'c')} AND o.kind IN ('ytd', 'quarter') AND o.fiscal_year = c.fiscal_year - 1 AND o.fiscal_period = c.fiscal_period AND abs(o.span - c.span) <= 20 AND abs(date_diff('day', o.period_end, c.period_end) - 365) <= 20 GROUP BY {mine}),
{out}_q AS (SELECT {keys}, count(*) AS qn, sum(value) AS qs4, min(period_start) AS qa, max(period_end) AS qb FROM (SELECT * FROM {out}_k WHERE kind = 'quarter' QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY period_end DESC) <= 4) GROUP BY {keys}),
{out}_y AS (SELECT {keys}, max_by(value, period_end) AS yv, max(period_end) AS ye FROM {out}_k WHERE kind = 'annual' GROUP BY {keys}),
{out}_r AS (SELECT {keys}, kind, value, period_end, py + value - pp AS rolled, qn = 4 AND date_diff('day', qa, qb) BETWEEN 350 AND 380 AS four, qs4, qb, yv, ye FROM {out}_c LEFT JOIN {out}_py {k} LEFT JOIN {out}_pp {k} LEFT JOIN {out}_q {k} LEFT JOIN {out}_y {k}),
{out}_m AS (SELECT *, CASE WHEN kind = 'annual' THEN 'annual' WHEN rolled IS NOT NULL THEN 'ttm_annual_plus_ytd' WHEN four THEN 'ttm_4q' WHEN yv IS NOT NULL THEN 'annual_fallback' END AS method FROM {out}_r),
{out} AS (SELECT {keys}, CASE method WHEN 'annual' THEN value WHEN 'ttm_annual_plus_ytd' THEN rolled WHEN 'ttm_4q' THEN qs4 ELSE yv END AS value, CASE WHEN method IN ('annual', 'ttm_annual_plus_ytd') THEN period_end WHEN method = 'ttm_4q' THEN qb ELSE ye END AS period_end, method FROM {out}_m WHERE method IS NOT NULL)"""


_BALANCES = "(" + ", ".join(f"'{t}'" for c, ts in C.CONCEPT_TAGS.items() if c not in C.FLOW_CONCEPTS for t in ts) + ")"
_FLOWS = "(" + ", ".join(f"'{t}'" for c in C.FLOW_CONCEPTS for t in C.CONCEPT_TAGS[c]) + ")"


def instant_sql(source: str, out: str, keys: str) -> str:
    """CTE `out`: the newest balance of each key as first filed."""
    return f"{out}_o AS (SELECT * FROM {source} WHERE period_start IS NULL QUALIFY row_number() OVER (PARTITION BY {keys}, period_end ORDER BY filed_date, accession) = 1), {out} AS (SELECT {keys}, max_by(value, period_end) AS value, max(period_end) AS period_end FROM {out}_o GROUP BY {keys})"


@query("facts_asof", f"WITH {FACTS} SELECT entity, tag, period_end, fiscal_period, round(value, 6) AS value, filed_date, accession FROM fct WHERE filed_date <= DATE '1999-06-30' AND tag IN ('Revenues', 'StockholdersEquity')")
def facts_asof(spark, sf_dir):
    found = figures.facts_as_of(facts(spark, sf_dir), F.to_date(F.lit("1999-06-30")), ["Revenues", "StockholdersEquity"])
    return rounded(found.select("entity", "tag", "period_end", "fiscal_period", "value", "filed_date", "accession"))


@query("ttm_rollforward", f"WITH {FACTS}, {trailing_sql('fct', 'ttm', 'entity, tag')} SELECT entity, tag, round(value, 6) AS value, period_end, method FROM ttm")
def ttm_rollforward(spark, sf_dir):
    return rounded(pit.trailing_year(facts(spark, sf_dir), "entity", "tag"))


@query("newest_balances", f"WITH {FACTS}, bal AS (SELECT * FROM fct WHERE tag IN {_BALANCES}), {instant_sql('bal', 'ins', 'entity, tag')} SELECT entity, tag, round(value, 6) AS value, period_end FROM ins")
def newest_balances(spark, sf_dir):
    tags = [t for c, ts in C.CONCEPT_TAGS.items() if c not in C.FLOW_CONCEPTS for t in ts]
    return rounded(pit.instants(facts(spark, sf_dir).filter(F.col("tag").isin(tags)), "entity", "tag"))


_CHAIN = ", ".join(f"('{c}', '{t}', {i})" for c, ts in C.CONCEPT_TAGS.items() for i, t in enumerate(ts))
STATES = f"""{FACTS}, pts AS (SELECT DISTINCT entity, filed_date AS known_at FROM fct WHERE tag IN {_BALANCES} OR tag IN {_FLOWS}), st AS (SELECT f.*, known_at FROM fct f JOIN pts p ON f.entity = p.entity AND f.filed_date <= known_at),
stf AS (SELECT * FROM st WHERE tag IN {_FLOWS}), stb AS (SELECT * FROM st WHERE tag IN {_BALANCES}), {trailing_sql('stf', 'tt', 'entity, known_at, tag')}, {instant_sql('stb', 'ib', 'entity, known_at, tag')},
chain AS (SELECT * FROM (VALUES {_CHAIN}) x(concept, tag, place)), fig AS (SELECT entity, known_at, concept, value, period_end, tag, method FROM (SELECT *, 'instant' AS method FROM ib UNION ALL SELECT entity, known_at, tag, value, period_end, method FROM tt) JOIN chain USING (tag) WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entity, known_at, concept ORDER BY period_end DESC, place) = 1)"""


@query("concept_resolve", f"WITH {STATES} SELECT entity, known_at, concept, round(value, 6) AS value, period_end, tag, method FROM fig")
def concept_resolve(spark, sf_dir):
    """Every concept of every nation on each date that something was filed."""
    tags = sorted({t for ts in C.CONCEPT_TAGS.values() for t in ts})
    return rounded(figures.resolved(figures.states(facts(spark, sf_dir), tags), C.CONCEPT_TAGS))


_NATIONS = "nw AS (SELECT CAST(s_nationkey AS BIGINT) AS entity, CAST(date_trunc('week', l_shipdate) AS DATE) AS as_of, avg(l_extendedprice / l_quantity) AS price, CASE WHEN s_nationkey % 6 = 0 THEN 'Financials' ELSE 'Energy' END AS sector FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity > 0 GROUP BY 1, 2, 4)"
_OF = lambda c, x: f"max({x}) FILTER (concept = '{c}')"
_OLD = lambda c, x: f"CASE WHEN date_diff('day', {c}_end, as_of) <= {C.DATA_AGE_DAYS} THEN {x} END AS {x}"
_LEASE = lambda k: f"CASE WHEN coalesce({k}_lease_noncurrent, {k}_lease_current) IS NOT NULL THEN coalesce({k}_lease_noncurrent, 0) + coalesce({k}_lease_current, 0) ELSE {k}_lease END"
_RATIO = {
    "trailing_pe": "cap / nullif(net_income, 0)", "price_to_sales": "cap / nullif(revenue, 0)", "price_to_book": "cap / nullif(equity, 0)", "profit_margin": "CASE WHEN abs(date_diff('day', net_income_end, revenue_end)) <= 20 THEN net_income / nullif(revenue, 0) END",
    "operating_margin": "CASE WHEN abs(date_diff('day', operating_income_end, revenue_end)) <= 20 AND sector <> 'Financials' THEN operating_income / nullif(revenue, 0) END", "return_on_equity": "CASE WHEN equity > 0 THEN net_income / equity END",
    "debt_to_equity": "CASE WHEN equity > 0 THEN total_debt / equity * 100 END", "current_ratio": "current_assets / nullif(current_liabilities, 0)",
}
STATEMENT = f"""{STATES}, {_NATIONS}, stm AS (SELECT entity, known_at, {', '.join(f'{_OF(c, "value")} AS {c}, {_OF(c, "period_end")} AS {c}_end' for c in C.CONCEPT_TAGS)}, {_OF('long_term_debt', 'tag')} AS long_term_tag FROM fig GROUP BY 1, 2),
pr AS (SELECT nw.entity, nw.as_of, nw.price, nw.sector, long_term_tag, {', '.join(f'{_OLD(c, c)}, {_OLD(c, c + "_end")}' for c in C.CONCEPT_TAGS)} FROM nw ASOF LEFT JOIN stm ON nw.entity = stm.entity AND nw.as_of >= stm.known_at),
fu AS (SELECT *, CASE WHEN shares <> 0 THEN price * shares END AS cap, CASE WHEN long_term_debt IS NOT NULL THEN long_term_debt + coalesce(current_debt, 0) + CASE WHEN long_term_tag = 'LongTermDebtAndCapitalLeaseObligations' THEN 0 ELSE coalesce({_LEASE('finance')}, 0) END + coalesce({_LEASE('operating')}, 0) END AS total_debt FROM pr),
ra AS (SELECT *, {', '.join(f'{x} AS {n}' for n, x in _RATIO.items())} FROM fu)"""


def _probes(spark, sf_dir):
    """Nations with the mean price of each week."""
    li, s = read(spark, sf_dir, "lineitem").filter("l_quantity > 0"), read(spark, sf_dir, "supplier")
    sector = F.when(F.col("s_nationkey") % 6 == 0, "Financials").otherwise("Energy")
    return li.join(s, li.l_suppkey == s.s_suppkey).groupBy(F.col("s_nationkey").cast("long").alias("entity"), F.to_date(F.date_trunc("week", "l_shipdate")).alias("as_of"), sector.alias("sector")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))


def known(spark, sf_dir):
    """Statements and ratios of every nation and week."""
    return figures.fundamentals_as_of(_probes(spark, sf_dir), facts(spark, sf_dir))


@query("fundamentals_asof", f"WITH {STATEMENT} SELECT entity, as_of, {', '.join(f'round({n}, 6) AS {n}' for n in ('revenue', 'net_income', 'equity', 'shares', *_RATIO))} FROM ra")
def fundamentals_asof(spark, sf_dir):
    return rounded(known(spark, sf_dir).select("entity", "as_of", "revenue", "net_income", "equity", "shares", *_RATIO))


@query("debt_assembly", f"WITH {STATEMENT} SELECT entity, as_of, long_term_tag, round(long_term_debt, 6) AS long_term_debt, round(total_debt, 6) AS total_debt, current_debt IS NULL AND long_term_debt IS NOT NULL AS partial FROM ra")
def debt_assembly(spark, sf_dir):
    found = known(spark, sf_dir)
    return rounded(found.select("entity", "as_of", "long_term_tag", "long_term_debt", "total_debt", (F.col("current_debt").isNull() & F.col("long_term_debt").isNotNull()).alias("partial")))


_CLEAN = ("trailing_pe", "price_to_sales", "price_to_book")
_LOST = {"value_missing": " AND ".join(f"NOT coalesce({c} > 0, FALSE)" for c in _CLEAN), "quality_missing": "profit_margin IS NULL AND return_on_equity IS NULL AND debt_to_equity IS NULL", "short_interest_missing": "TRUE"}


@query("fundamental_flags", f"WITH {STATEMENT} SELECT entity, as_of, {', '.join(f'round(CASE WHEN {c} > 0 THEN {c} END, 6) AS {c}' for c in _CLEAN)}, {', '.join(f'({x}) AS {n}' for n, x in _LOST.items())}, ({' AND '.join(f'({x})' for x in _LOST.values())}) AS fundamentals_missing FROM ra")
def fundamental_flags(spark, sf_dir):
    """Ratios fit for ranking: withheld ones and valuations at or below zero are NULL; flags tell families without any value."""
    found = figures.withheld(known(spark, sf_dir)).withColumns({f: F.lit(None).cast("double") for f in ("ev_to_ebitda", "short_percent_of_float")})
    return rounded(figures.missing_flags(figures.cleaned(found)).select("entity", "as_of", *_CLEAN, *_LOST, "fundamentals_missing"))


@query("quarterly_eps", f"WITH {FACTS}, qe0 AS (SELECT * FROM fct WHERE tag IN ({', '.join(repr(t) for t in C.EPS_TAGS)}) AND date_diff('day', period_start, period_end) BETWEEN 80 AND 100 QUALIFY row_number() OVER (PARTITION BY entity, tag, period_start, period_end ORDER BY filed_date, accession) = 1), qe1 AS (SELECT *, CASE tag WHEN '{C.EPS_TAGS[0]}' THEN 1 WHEN '{C.EPS_TAGS[1]}' THEN 2 ELSE 3 END AS place FROM qe0 QUALIFY count(*) OVER (PARTITION BY entity, tag) >= 5) SELECT entity, period_end, filed_date, round(value, 6) AS eps FROM qe1 QUALIFY place = min(place) OVER (PARTITION BY entity)")
def quarterly_eps(spark, sf_dir):
    return rounded(figures.quarterly_eps(facts(spark, sf_dir)))


_EPS_BY = f"qe0 AS (SELECT * FROM fct WHERE tag IN ({', '.join(repr(t) for t in C.EPS_TAGS)}) AND date_diff('day', period_start, period_end) BETWEEN 80 AND 100 QUALIFY row_number() OVER (PARTITION BY entity, tag, period_start, period_end ORDER BY filed_date, accession) = 1), qe1 AS (SELECT *, CASE tag WHEN '{C.EPS_TAGS[0]}' THEN 1 WHEN '{C.EPS_TAGS[1]}' THEN 2 ELSE 3 END AS place FROM qe0 QUALIFY count(*) OVER (PARTITION BY entity, tag) >= 5), eps AS (SELECT entity, period_end, filed_date, value AS eps FROM qe1 QUALIFY place = min(place) OVER (PARTITION BY entity))"
_SUE = "nb AS (SELECT a.entity, a.period_end, a.filed_date, a.eps, b.eps AS then_eps FROM eps a JOIN eps b ON a.entity = b.entity AND b.period_end < a.period_end AND date_diff('day', b.period_end, a.period_end) BETWEEN 320 AND 410 QUALIFY row_number() OVER (PARTITION BY a.entity, a.period_end ORDER BY abs(date_diff('day', b.period_end, a.period_end) - 365), b.period_end) = 1), dr AS (SELECT *, then_eps + coalesce(avg(eps - then_eps) OVER (PARTITION BY entity ORDER BY period_end ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 0) AS expected FROM nb), su AS (SELECT *, eps - expected AS surprise FROM dr), sp AS (SELECT *, CASE WHEN count(surprise) OVER w >= 5 THEN stddev_samp(surprise) OVER w END AS s FROM su WINDOW w AS (PARTITION BY entity ORDER BY period_end ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)), sue AS (SELECT entity, period_end, filed_date, surprise, CASE WHEN s > 0 THEN surprise / s END AS sue FROM sp)"


@query("filed_surprises", f"WITH {FACTS}, {_EPS_BY}, {_SUE}, {_NATIONS} SELECT nw.entity, nw.as_of, round(s.surprise, 6) AS surprise, round(s.sue, 6) AS sue, s.period_end, s.filed_date, CAST(date_diff('day', s.filed_date, nw.as_of) AS INTEGER) AS days_since FROM nw ASOF LEFT JOIN (SELECT * FROM sue QUALIFY row_number() OVER (PARTITION BY entity, filed_date ORDER BY period_end DESC) = 1) s ON nw.entity = s.entity AND nw.as_of >= s.filed_date")
def filed_surprises(spark, sf_dir):
    """The newest earnings surprise that each week's probe could know: quarterly earnings as first filed, standardised by
    what the filer's own past led to expect, by the date of filing."""
    found = pit.surprises(figures.quarterly_eps(facts(spark, sf_dir)))
    out = asof.backward(_probes(spark, sf_dir).select("entity", "as_of"), found, "entity", "as_of", "filed_date", ["surprise", "sue", "period_end", "filed_date"], ["period_end"])
    return rounded(out.withColumn("days_since", F.datediff("as_of", "filed_date")).select("entity", "as_of", "surprise", "sue", "period_end", "filed_date", "days_since"))
