"""Portfolio simulation on relations: targets, legs and marks are joins and windows; the recursion over capital is one
fold over each config's periods.

Every rebalance sells the whole book and buys the new one at equal weights, so what a period does to capital depends on
nothing but the capital it starts with and its legs: the price and liquidity at which each name is bought and sold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant import config as C
from sextant.functions.scalar import one_way_bps
from sextant.operators.features import dollar_adv
from sextant.sources.store import written


def every_kth(sessions: DataFrame, k: int) -> DataFrame:
    """Every k-th session, the first included."""
    return sessions.filter(F.col("session") % k == 0)


def targets(scores: DataFrame, sessions: DataFrame, score: str, configs: list[tuple[str, int, int, bool]], bars: DataFrame | None = None, min_adv: float | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """(config, d, session, entity): the names that each config (name, names held, sessions held, worst first) picks on its
    rebalance sessions, counted among the sessions with scores; ties by entity. One pass over the scores for all configs.

    A liquidity floor needs bars; entities of `exclude` (benchmarks) are never held."""
    found = scores.filter(F.col(score).isNotNull())
    if exclude is not None:
        found = found.join(exclude.select("entity").distinct(), "entity", "left_anti")
    if min_adv is not None:
        found = found.join(bars.select("entity", "d", dollar_adv().alias("_adv")).filter(F.col("_adv") >= min_adv).select("entity", "d"), ["entity", "d"], "left_semi")
    days = scores.select("d").distinct().join(sessions, "d").withColumn("_turn", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("session")) - 1)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("config"), F.lit(n).alias("n"), F.lit(h).alias("hold"), F.lit(w).alias("worst")) for c, n, h, w in configs])).alias("c")
    dealt = found.join(days, "d").select("d", "session", "_turn", "entity", F.col(score).alias("_score"), each).select("d", "session", "_turn", "entity", "_score", "c.*").filter("_turn % hold = 0")
    order = F.when(F.col("worst"), F.col("_score")).otherwise(-F.col("_score"))
    return dealt.withColumn("_k", F.row_number().over(Window.partitionBy("config", "d").orderBy(order, "entity"))).filter("_k <= n").select("config", "d", "session", "entity")


def positions(picks: DataFrame, bars: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(config, period, fill, until) of the periods, and (config, period, entity, session, open, close, adv, last) of each
    held name on the sessions from its fill to the next one, `last` being its last close so far.

    Picks are filled on the session after they were made, if the calendar has one; a name without a bar then is left out."""
    end = sessions.agg(F.max("session").alias("end"))
    fills = picks.select("config", (F.col("session") + 1).alias("fill")).distinct().join(F.broadcast(end), F.col("fill") <= F.col("end"))
    by = Window.partitionBy("config").orderBy("fill")
    periods = fills.withColumns({"period": F.row_number().over(by), "until": F.lead("fill").over(by)}).select("config", "period", "fill", "until", "end")
    prices = bars.select("entity", "d", F.coalesce("open", "close").alias("open"), "close", dollar_adv().alias("adv")).join(F.broadcast(sessions), "d").drop("d")
    held = picks.select("config", "entity", (F.col("session") + 1).alias("fill")).join(periods, ["config", "fill"])
    bought = held.join(prices.select("entity", F.col("session").alias("fill")), ["entity", "fill"], "left_semi")
    days = bought.withColumn("session", F.explode(F.sequence("fill", F.coalesce("until", "end"))))
    seen = days.join(prices, ["entity", "session"], "left")
    last = F.last("close", ignorenulls=True).over(Window.partitionBy("config", "period", "entity").orderBy("session"))
    return periods.drop("end"), seen.withColumn("last", last).select("config", "period", "entity", "fill", "until", "session", "open", "close", "adv", "last")


def _fold(legs: Column, charge: bool) -> Column:
    """(start, fees of the fill, sold, fees of the sale) of each period, from its legs (bought, adv, sold, adv then).

    A period without a leg keeps its capital as cash; the last one is never sold."""
    rate = lambda trade, adv: one_way_bps(trade, adv) / 1e4 if charge else F.lit(0.0)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)

    def step(a: Column, p: Column) -> Column:
        cash = a["capital"]

        def through(each: Column) -> Column:
            fee = lambda x: each * rate(each, x["adv"])
            sold = F.transform(p["legs"], lambda x: (each - fee(x)) / x["bought"] * x["sold"])
            fees = F.zip_with(p["legs"], sold, lambda x, s: F.coalesce(s * rate(s, x["adv_then"]), F.lit(0.0)))
            return F.struct(total(F.transform(p["legs"], fee)).alias("paid"), total(F.transform(sold, lambda s: F.coalesce(s, F.lit(0.0)))).alias("sold"), total(fees).alias("fees"))

        none = F.struct(F.lit(0.0).alias("paid"), cash.alias("sold"), F.lit(0.0).alias("fees"))
        size = F.size(p["legs"])
        moved = F.transform(F.array(F.when(size > 0, through(cash / F.greatest(size, F.lit(1)))).otherwise(none)), lambda m: m)
        return F.transform(moved, lambda m: F.struct((m["sold"] - m["fees"]).alias("capital"), F.concat(a["out"], F.array(F.struct(p["period"].alias("period"), cash.alias("start"), size.alias("names"), m["paid"].alias("paid"), m["sold"].alias("sold"), m["fees"].alias("fees")))).alias("out")))[0]

    start = F.struct(F.lit(C.INITIAL_EQUITY).alias("capital"), F.from_json(F.lit("[]"), "array<struct<period:int,start:double,names:int,paid:double,sold:double,fees:double>>").alias("out"))
    return F.aggregate(legs, start, step)["out"]


def simulate(picks: DataFrame, bars: DataFrame, sessions: DataFrame, charge: bool = True) -> tuple[DataFrame, DataFrame]:
    """(config, d, session, equity, cost) of every session, and a summary of each config: rebalances, turnover, costs,
    names sold without a price of their own that day, and moves too large to be true.

    A name without a price on the day of the sale goes at its last close; both sides cost. A fill takes effect on the day
    it happens, so a rebalance day is marked with the shares held over it. Before the first fill there is cash."""
    periods, days = positions(picks, bars, sessions)
    days = written(days, "held")
    buys = days.filter("session = fill").select("config", "period", "entity", F.col("open").alias("bought"), "adv")
    sells = days.filter("session = until").select("config", "period", "entity", F.coalesce("open", "last").alias("sold"), F.when(F.col("open").isNotNull(), F.col("adv")).alias("adv_then"), F.col("open").isNull().alias("gone"))
    legs = buys.join(sells, ["config", "period", "entity"], "left")
    each = periods.join(legs.groupBy("config", "period").agg(F.array_sort(F.collect_list(F.struct("entity", "bought", "adv", "sold", "adv_then"))).alias("legs")), ["config", "period"], "left")
    empty = F.from_json(F.lit("[]"), "array<struct<entity:bigint,bought:double,adv:double,sold:double,adv_then:double>>")
    listed = each.groupBy("config").agg(F.array_sort(F.collect_list(F.struct("period", F.coalesce("legs", empty).alias("legs")))).alias("x"))
    flows = written(listed.select("config", F.explode(_fold(F.col("x"), charge)).alias("f")).select("config", "f.*").join(periods, ["config", "period"]), "flows")

    fee = (one_way_bps(F.col("each"), F.col("adv")) / 1e4 * F.col("each")) if charge else F.lit(0.0)
    shares = buys.join(flows.select("config", "period", F.try_divide("start", "names").alias("each")), ["config", "period"]).select("config", "period", "entity", ((F.col("each") - fee) / F.col("bought")).alias("shares"))
    marks = days.filter("until IS NULL OR session < until").join(shares, ["config", "period", "entity"]).groupBy("config", "session").agg(F.sum(F.col("shares") * F.col("last")).alias("marked"))
    last = F.coalesce(F.col("until") - 1, F.col("end"))
    cash = flows.filter("names = 0").join(F.broadcast(sessions.agg(F.max("session").alias("end"))), F.lit(True)).select("config", F.explode(F.sequence("fill", last)).alias("session"), F.col("start").alias("idle"))
    paid = flows.select("config", F.explode(F.array(F.struct(F.col("fill").alias("session"), F.col("paid").alias("cost")), F.struct(F.col("until").alias("session"), F.when(F.col("until").isNotNull(), F.col("fees")).alias("cost")))).alias("c")).select("config", "c.*").filter("session IS NOT NULL").groupBy("config", "session").agg(F.sum("cost").alias("cost"))
    grid = periods.select("config").distinct().join(F.broadcast(sessions), F.lit(True))
    for part in (marks, cash, paid):
        grid = grid.join(part, ["config", "session"], "left")
    curve = written(grid.select("config", "d", "session", F.coalesce("marked", "idle", F.lit(C.INITIAL_EQUITY)).alias("equity"), F.coalesce("cost", F.lit(0.0)).alias("cost")), "curve")

    kept = days.filter("until IS NULL OR session < until").filter("close IS NOT NULL")
    before = F.lag("close").over(Window.partitionBy("config", "entity").orderBy("session"))
    odd = kept.withColumn("_m", F.abs(F.try_divide("close", before) - 1) * 100).groupBy("config").agg(F.sum((F.col("_m") > C.SUSPICIOUS_MOVE).cast("int")).alias("n_suspicious"))
    gone = sells.groupBy("config").agg(F.sum(F.col("gone").cast("int")).alias("n_liquidated"))
    year = F.lit(float(C.SESSIONS_A_YEAR))
    mean = curve.groupBy("config").agg(F.avg("equity").alias("mean"), F.count(F.lit(1)).alias("n"))
    sold = F.when(F.col("until").isNotNull() & (F.col("names") > 0), F.col("sold")).otherwise(0.0)
    money = flows.groupBy("config").agg(F.count(F.lit(1)).alias("n_rebalances"), F.sum(sold + F.when(F.col("names") > 0, F.col("start")).otherwise(0.0)).alias("traded"), F.sum(F.col("paid") + F.when(F.col("until").isNotNull(), F.col("fees")).otherwise(0.0)).alias("total_cost"))
    summary = money.join(mean, "config").join(odd, "config", "left").join(gone, "config", "left").select(
        "config", "n_rebalances", (F.col("traded") / F.col("mean") / (F.col("n") / year)).alias("turnover_annual"), "total_cost", (F.col("total_cost") / F.col("mean") * 100).alias("cost_drag_pct"),
        F.coalesce("n_liquidated", F.lit(0)).alias("n_liquidated"), F.coalesce("n_suspicious", F.lit(0)).alias("n_suspicious"),
    )
    return curve, summary


def invested(curve: DataFrame, *keys: str) -> DataFrame:
    """The part of each curve from the first session on which it moves, and `n_in_cash`, the sessions before it."""
    time = Window.partitionBy(*keys).orderBy("d")
    moved = curve.withColumn("_at", F.row_number().over(time) - 1).withColumn("_moved", F.abs(F.col("equity") - F.lag("equity").over(time)) > 1e-9)
    first = F.min(F.when(F.col("_moved"), F.col("_at"))).over(Window.partitionBy(*keys))
    return moved.withColumn("n_in_cash", first).filter("_at >= n_in_cash").drop("_at", "_moved")


def buy_and_hold(bars: DataFrame, days: DataFrame) -> DataFrame:
    """(d, equity) of one entity bought at its first close and held, on the given days; days without a bar repeat the last."""
    time = Window.partitionBy(F.lit(0)).orderBy("d")
    seen = days.select("d").join(bars.select("d", "close"), "d", "left").withColumn("_c", F.last("close", ignorenulls=True).over(time))
    return seen.select("d", F.coalesce(F.lit(C.INITIAL_EQUITY) * F.col("_c") / F.first("_c", ignorenulls=True).over(time.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(C.INITIAL_EQUITY)).alias("equity"))


def metrics(curve: DataFrame, *keys: str) -> DataFrame:
    """Growth, Sharpe ratio, deepest fall and volatility of equity curves (keys, d, equity).

    A deviation up to 1e-12 is the rounding of returns that don't vary, and gives no ratio."""
    time = Window.partitionBy(*keys).orderBy("d")
    r = curve.withColumns({"ret": F.try_divide(F.col("equity"), F.lag("equity").over(time)) - 1, "peak": F.max("equity").over(time.rowsBetween(Window.unboundedPreceding, 0))})
    year = float(C.SESSIONS_A_YEAR)
    out = r.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_sessions"), F.min_by("equity", "d").alias("a"), F.max_by("equity", "d").alias("b"), F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"), (F.min(F.col("equity") / F.col("peak") - 1) * 100).alias("max_drawdown_pct"))
    return out.select(*keys, "n_sessions", (F.col("b") / F.col("a") - 1).alias("total_return"), (F.pow(F.col("b") / F.col("a"), year / F.col("n_sessions")) - 1).alias("cagr"), F.when(F.col("s") > 1e-12, F.col("m") / F.col("s") * F.sqrt(F.lit(year))).alias("sharpe"), (F.col("s") * F.sqrt(F.lit(year))).alias("volatility_annual"), "max_drawdown_pct")


def long_short(curve: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair, d, equity): half long one config and half short another, day by day; pairs has (pair, long, short).

    A day that loses all there is ends a book: it stays at zero."""
    time, pair = Window.partitionBy("config").orderBy("d"), Window.partitionBy("pair").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    r = curve.select("config", "d", (F.try_divide("equity", F.lag("equity").over(time)) - 1).alias("r"))
    a = r.join(F.broadcast(pairs), F.col("config") == F.col("long")).select("pair", "d", F.col("r").alias("a"))
    b = r.join(F.broadcast(pairs), F.col("config") == F.col("short")).select("pair", "d", F.col("r").alias("b"))
    both = a.join(b, ["pair", "d"]).withColumn("_g", 1 + F.coalesce(F.col("a") * 0.5 - F.col("b") * 0.5, F.lit(0.0)))
    growth = F.exp(F.sum(F.when(F.col("_g") > 0, F.log("_g"))).over(pair))
    return both.select("pair", "d", F.when(F.min("_g").over(pair) > 0, F.lit(C.INITIAL_EQUITY) * growth).otherwise(0.0).alias("equity"))
