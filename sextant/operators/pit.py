"""Figures from dated facts as they stood: originally filed values, trailing twelve months, tag chains, ratios."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant import config as C


def originally_filed(facts: DataFrame, *keys: str) -> DataFrame:
    """One fact a period: the first filed; later restatements don't count. Ties go to the smaller accession."""
    by = Window.partitionBy(*keys, "period_start", "period_end").orderBy("filed_date", "accession")
    return facts.withColumn("_k", F.row_number().over(by)).filter("_k = 1").drop("_k")


def newest(facts: DataFrame, is_flow: Column, *keys: str, deal: tuple[str, ...] | None = None) -> DataFrame:
    """(keys, value, period_end, method): the newest figure of each key, in one pass over facts dealt by `deal` (some of
    the keys; all of them by default), which all steps share.

    A balance (method instant) is the newest among facts without a start, or among all if there are none. A flow is the
    freshest full year, else last year plus this year's part less last year's like part, else four quarters that span a
    year, else the last full year; without any of these there is no row. Periods count as first filed. Of periods with
    one end the longest counts, then the first filed. A part that lacks a match is never scaled up."""
    tol, end, flow = C.TTM_TOLERANCE, F.col("period_end"), F.col("_flow")
    span = F.datediff("period_end", "period_start")
    kind = F.when(span.between(350, 380), "annual").when(span.between(80, 100), "quarter").when((span > 100) & (span < 350), "ytd")
    rows = originally_filed(facts.repartition(*(deal or keys)).withColumn("_flow", is_flow), *keys)
    rows = rows.withColumns({"_span": F.when(flow, span), "_kind": F.when(flow, kind)}).filter("NOT _flow OR _kind IS NOT NULL")
    longest = Window.partitionBy(*keys, "_kind", "period_end").orderBy(F.desc("_span"), "filed_date", "accession")
    rows = rows.withColumn("_k", F.row_number().over(longest)).filter("NOT _flow OR _k = 1")
    whole, back = Window.partitionBy(*keys), Window.partitionBy(*keys, "_kind").orderBy(F.desc("period_end"))
    place = F.expr("CASE _kind WHEN 'annual' THEN 0 WHEN 'ytd' THEN -1 ELSE -2 END").alias("o")
    rows = rows.withColumns({
        "_used": ~flow & ((F.max(F.col("period_start").isNull().cast("int")).over(whole) == 0) | F.col("period_start").isNull()), "_back": F.row_number().over(back),
        "c": F.max(F.when(flow, F.struct("period_end", place, "_kind", "value", "period_start", "fiscal_year", "fiscal_period", "_span"))).over(whole),
    })
    before = flow & (F.col("fiscal_year") == F.col("c.fiscal_year") - 1)
    abuts = before & (F.col("_kind") == "annual") & (F.abs(F.datediff("period_end", "c.period_start")) <= tol)
    like = before & F.col("_kind").isin("ytd", "quarter") & (F.col("fiscal_period") == F.col("c.fiscal_period")) & (F.abs(F.col("_span") - F.col("c._span")) <= tol) & (F.abs(F.abs(F.datediff("c.period_end", "period_end")) - 365) <= tol)
    recent, year = flow & (F.col("_kind") == "quarter") & (F.col("_back") <= 4), flow & (F.col("_kind") == "annual")
    newest_of = lambda c, order=end: F.max_by(F.when(c, F.col("value")), F.when(c, order))
    found = rows.groupBy(*keys).agg(
        F.max("_flow").alias("flow"), newest_of(F.col("_used"), F.struct("period_end", "period_start")).alias("balance"), F.max(F.when(F.col("_used"), end)).alias("balance_end"), F.first("c").alias("c"),
        newest_of(abuts).alias("prior_year"), newest_of(like).alias("prior_part"), newest_of(year).alias("year"), F.max(F.when(year, end)).alias("year_end"),
        F.count(F.when(recent, F.col("value"))).alias("nq"), F.sum(F.when(recent, F.col("value"))).alias("sum4"), F.min_by(F.when(recent, F.col("period_start")), F.when(recent, end)).alias("from4"), F.max(F.when(recent, end)).alias("to4"),
    )
    rolled = F.col("prior_year") + F.col("c.value") - F.col("prior_part")
    four = (F.col("nq") == 4) & F.datediff("to4", "from4").between(350, 380)
    of_flow = F.when(F.col("c._kind") == "annual", "annual").when(rolled.isNotNull(), "ttm_annual_plus_ytd").when(four, "ttm_4q").when(F.col("year").isNotNull(), "annual_fallback")
    found = found.withColumn("method", F.when(~F.col("flow"), "instant").otherwise(of_flow)).filter("method IS NOT NULL")
    cases = {"instant": ("balance", "balance_end"), "annual": ("c.value", "c.period_end"), "ttm_annual_plus_ytd": (rolled, "c.period_end"), "ttm_4q": ("sum4", "to4"), "annual_fallback": ("year", "year_end")}
    pick = lambda i: reduce(lambda x, m: F.when(F.col("method") == m, cases[m][i] if isinstance(cases[m][i], Column) else F.col(cases[m][i])).otherwise(x), cases, F.lit(None))
    return found.select(*keys, pick(0).alias("value"), pick(1).alias("period_end"), "method")


def instants(facts: DataFrame, *keys: str) -> DataFrame:
    """The newest balance of each key; see `newest`."""
    return newest(facts, F.lit(False), *keys).drop("method")


def trailing_year(facts: DataFrame, *keys: str) -> DataFrame:
    """(keys, value, period_end, method) of a flow; see `newest`."""
    return newest(facts.filter("period_start IS NOT NULL"), F.lit(True), *keys)


def concept(resolved: DataFrame, chain: list[str], as_of: Column, *keys: str) -> DataFrame:
    """The freshest value along a chain of tags, the earlier tag on a tie; too old a value is NULL."""
    place = F.array_position(F.array(*[F.lit(t) for t in chain]), F.col("tag"))
    found = resolved.filter(F.col("tag").isin(chain)).groupBy(*keys).agg(F.max_by(F.struct("value", "period_end", "tag"), F.struct(F.col("period_end"), -place)).alias("x"))
    return found.select(*keys, F.when(F.datediff(as_of, F.col("x.period_end")) <= C.DATA_AGE_DAYS, F.col("x.value")).alias("value"), F.col("x.period_end").alias("period_end"), F.col("x.tag").alias("tag"))


def debt(long_term: Column, current: Column, finance: Column, operating: Column, bundles_leases: Column) -> Column:
    """Interest-bearing debt: the long-term leg is required; a current leg and leases add where known, leases once."""
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return F.when(long_term.isNotNull(), long_term + zero(current) + F.when(bundles_leases, 0.0).otherwise(zero(finance)) + zero(operating))


def ratios(df: DataFrame) -> DataFrame:
    """Ratios of a row of figures: margins need one period, equity ratios a positive equity; the rest is NULL."""
    aligned = lambda a: F.abs(F.datediff(f"{a}_end", "revenue_end")) <= C.RATIO_PERIOD_TOLERANCE
    cap = F.when(F.col("shares") != 0, F.col("price") * F.col("shares"))
    sound = F.col("equity") > 0
    return df.withColumns({
        "trailing_pe": F.try_divide(cap, "net_income"), "price_to_sales": F.try_divide(cap, "revenue"), "price_to_book": F.try_divide(cap, "equity"),
        "profit_margin": F.when(aligned("net_income"), F.try_divide("net_income", "revenue")), "operating_margin": F.when(aligned("operating_income") & ~F.col("financial"), F.try_divide("operating_income", "revenue")),
        "return_on_equity": F.when(sound, F.try_divide("net_income", "equity")), "debt_to_equity": F.when(sound, F.try_divide("total_debt", "equity") * 100), "current_ratio": F.try_divide("current_assets", "current_liabilities"),
    })


def validation(pairs: DataFrame) -> DataFrame:
    """Own figures against a second source, by concept (ours, theirs): coverage, rank correlation, differences, gate."""
    from sextant.functions.stats import pooled_median, pooled_spearman

    full = pairs.filter("ours IS NOT NULL AND theirs IS NOT NULL").withColumn("diff", F.try_divide(F.abs(F.col("ours") - F.col("theirs")), F.abs("theirs")) * 100)
    found = full.groupBy("concept").agg(F.avg((F.col("diff") > 100).cast("double")).alias("share_over_100")).join(pooled_median(full, "diff", "median_pct_diff", "concept"), "concept", "left")
    missing = pairs.groupBy("concept").agg(F.sum(F.col("ours").isNull().cast("int")).alias("ours_missing"), F.sum(F.col("theirs").isNull().cast("int")).alias("theirs_missing"))
    out = missing.join(found, "concept", "left").join(pooled_spearman(full, "ours", "theirs", "concept"), "concept", "left")
    return out.withColumn("passes", F.coalesce((F.col("median_pct_diff") <= 10.0) & (F.col("spearman_ic") >= 0.90) & (F.col("share_over_100") <= 0.05), F.lit(False)))


def surprises(eps: DataFrame, least: int = 5, window: int = 8) -> DataFrame:
    """Standardised earnings surprises of (entity, period_end, filed_date, eps): the like quarter a year before plus the
    mean of the last four yearly changes, over the deviation of the last `window` surprises; NULL with fewer than `least`.

    The like quarter is the one nearest a year before, within 45 days; of two as near, the earlier. Frames hold earlier
    quarters only, so nothing filed later is used."""
    a = eps.select("entity", "period_end", "filed_date", "eps")
    b = eps.select(F.col("entity").alias("e2"), F.col("period_end").alias("then"), F.col("eps").alias("eps_then"))
    gap = F.abs(F.datediff("period_end", "then") - 365)
    near = a.join(b, (F.col("entity") == F.col("e2")) & (F.col("then") < F.col("period_end")) & F.col("then").between(F.date_sub("period_end", 410), F.date_sub("period_end", 320)))
    best = near.withColumn("_k", F.row_number().over(Window.partitionBy("entity", "period_end").orderBy(gap, "then"))).filter("_k = 1")
    time = Window.partitionBy("entity").orderBy("period_end")
    drifted = best.withColumn("change", F.col("eps") - F.col("eps_then")).withColumn("drift", F.coalesce(F.avg("change").over(time.rowsBetween(-4, -1)), F.lit(0.0)))
    found = drifted.withColumn("expected", F.col("eps_then") + F.col("drift")).withColumn("surprise", F.col("eps") - F.col("expected"))
    before = time.rowsBetween(-window, -1)
    spread = F.when(F.count("surprise").over(before) >= least, F.stddev_samp("surprise").over(before))
    return found.withColumn("sue", F.when(spread > 0, F.col("surprise") / spread)).select("entity", "period_end", "filed_date", "expected", "surprise", "sue")


def cadence(filings: DataFrame) -> DataFrame:
    """(entity, filed_date) with the median of the last eight gaps: the wait that a filer's own past suggests."""
    time = Window.partitionBy("entity").orderBy("filed_date")
    gaps = filings.withColumn("gap", F.datediff("filed_date", F.lag("filed_date").over(time)))
    return gaps.withColumn("cadence", F.percentile("gap", F.lit(0.5)).over(time.rowsBetween(-7, 0)))


def timing(df: DataFrame, at: str, filed: str) -> DataFrame:
    """(entity, date, days_since, expected_until): days since the last filing, and what its cadence leaves until the next.

    The next filing's real date is not used: nobody knew it."""
    since = F.datediff(at, filed)
    return df.select("entity", at, since.alias("days_since"), (F.col("cadence") - since).alias("expected_until"))


def revisions(df: DataFrame) -> DataFrame:
    """Changes of an estimate over one and three months, and the breadth of its revisions."""
    from sextant.functions.scalar import signed_change

    up, down = F.col("up_last_30d"), F.col("down_last_30d")
    out = df.withColumns({"eps_revision_1m": signed_change(F.col("eps_current"), F.col("eps_30d_ago")), "eps_revision_3m": signed_change(F.col("eps_current"), F.col("eps_90d_ago")), "eps_revision_breadth_30d": F.when(up + down > 0, (up - down) / (up + down))})
    return out.withColumn("estimates_missing", F.coalesce("eps_revision_1m", "eps_revision_3m", "eps_revision_breadth_30d").isNull())
