"""Trailing-window features of an entity's bars, for all dates at once: one exchange by entity serves them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant import config as C
from sextant.functions.scalar import close_position, pct
from sextant.functions.windows import bars_so_far, by_entity, far, guarded, mean_of, means, share_at_or_below, spans, spread60, tops, trailing


def trend(df: DataFrame) -> DataFrame:
    """SMAs, and how far the close and the SMAs lie from each other in percent."""
    out = means(df, "close").withColumnsRenamed({f"_mean{w}": f"SMA{w}" for w in C.SMA_WINDOWS})
    far = {f"close_vs_SMA{w}_pct": pct(F.col("close"), F.col(f"SMA{w}")) for w in C.SMA_WINDOWS}
    return out.withColumns(far | {"SMA20_vs_SMA50_pct": pct(F.col("SMA20"), F.col("SMA50")), "SMA50_vs_SMA200_pct": pct(F.col("SMA50"), F.col("SMA200"))})


def returns(df: DataFrame) -> DataFrame:
    """Returns over each window of own rows, and whether the longest is missing."""
    back = {w: F.try_divide(F.col("close"), F.lag("close", w).over(by_entity())) - 1 for w in C.RETURN_WINDOWS}
    return df.withColumns({f"return_{w}d": r for w, r in back.items()} | {"return_252d_missing": back[252].isNull()})


def volume(df: DataFrame) -> DataFrame:
    """Volume ratios, dollar volume, high-volume days, up against down volume, and where the close lies."""
    last = trailing(20)
    out = df.withColumn("ret", F.try_divide(F.col("close"), F.lag("close", 1).over(by_entity())) - 1)
    out = out.withColumns({
        **{f"volume_ratio_{w}d": F.try_divide(F.col("volume"), mean_of(F.col("volume"), w)) for w in C.VOLUME_WINDOWS},
        "dollar_volume_20d": mean_of(F.col("close") * F.col("volume"), 20), "avg20": mean_of(F.col("volume"), 20),
        "days": F.collect_list(F.struct("ret", "volume")).over(last),
        "up_volume": F.sum(F.when(F.col("ret") > 0, F.col("volume")).otherwise(0.0)).over(last), "down_volume": F.sum(F.when(F.col("ret") < 0, F.col("volume")).otherwise(0.0)).over(last),
        "close_position": close_position(F.col("high"), F.col("low"), F.col("close")),
    })
    # the threshold is the average at the end of the frame, so the days of the frame are judged together
    busy = lambda sign: F.size(F.filter("days", lambda x: (x["ret"] * sign > 0) & (x["volume"] > C.HIGH_VOLUME_RATIO * F.col("avg20"))))
    ratio = F.when(F.col("down_volume") == 0, C.UP_DOWN_VOLUME_CAP).otherwise(F.least(F.col("up_volume") / F.col("down_volume"), F.lit(C.UP_DOWN_VOLUME_CAP)))
    out = out.withColumns({
        "illiquid_flag": F.col("dollar_volume_20d") < C.MIN_DOLLAR_VOLUME,
        "high_volume_up_days_20d": guarded(busy(1), 20), "high_volume_down_days_20d": guarded(busy(-1), 20),
        "up_volume_vs_down_volume_20d": guarded(ratio, 21),
        "weak_close_flag": F.col("close_position") < C.CLOSE_WEAK, "strong_close_flag": F.col("close_position") > C.CLOSE_STRONG,
    })
    return out.drop("avg20", "days", "up_volume", "down_volume", "ret")


def risk(df: DataFrame) -> DataFrame:
    """True range, volatility, drawdown and the distance from the extremes of the last year of closes."""
    before = F.lag("close", 1).over(by_entity())
    year = F.sqrt(F.lit(float(C.SESSIONS_A_YEAR)))
    out = spans(df, "close").withColumns({"tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)), "ret": F.try_divide(F.col("close"), before) - 1})
    top, bottom = far("_top60", C.SESSIONS_A_YEAR, 60, F.greatest), far("_low60", C.SESSIONS_A_YEAR, 60, F.least)
    out = out.withColumns({"_top": top, "_bottom": bottom})
    top, bottom = F.col("_top"), F.col("_bottom")
    out = spread60(out, "ret")
    spread = lambda x, w: F.stddev_samp(x).over(trailing(w)) * year
    out = out.withColumns({
        "ATR14": mean_of(F.col("tr"), C.ATR_WINDOW), "volatility_20d": guarded(spread(F.col("ret"), 20), 21), "volatility_60d": guarded(F.col("_spread60") * year, 61),
        "downside_volatility_20d": guarded(spread(F.when(F.col("ret") < 0, F.col("ret")), 20), 21), **{f"max_drawdown_{w}d": guarded(F.col(f"_fall{w}"), w) for w in C.DRAWDOWN_WINDOWS},
        "distance_from_52w_high_pct": F.try_divide(top - F.col("close"), top) * 100, "distance_from_52w_low_pct": pct(F.col("close"), bottom),
    })
    return out.withColumn("ATR_pct", F.try_divide("ATR14", F.col("close"))).drop("tr", "ret", "_spread60", "_top", "_bottom", *[f"_{c}{w}" for c in ("top", "low", "fall") for w in (20, 60)])


def setup(df: DataFrame) -> DataFrame:
    """Nearness to highs, pullback, failed breakout and extension. Needs the SMAs of `trend`."""
    out = tops(df, "high").withColumns({f"top{w}": guarded(F.col(f"_most{w}"), w) for w in C.NEAR_HIGH})
    out = out.withColumn("broke", F.when((bars_so_far() > 20) & (F.col("high") > F.col("_before20")), F.col("high"))).withColumn("broke5", F.max("broke").over(trailing(C.BREAKOUT_LOOKBACK)))
    below = (F.col("top20") - F.col("close")) / F.col("top20") * 100
    failed = F.coalesce(-pct(F.col("close"), F.col("broke5")) >= C.BREAKOUT_DROP, F.lit(False))
    far = F.col("close_vs_SMA20_pct") > C.EXTENDED
    out = out.withColumns({
        "near_20d_high": F.col("close") >= C.NEAR_HIGH[20] * F.col("top20"), "near_60d_high": F.col("close") >= C.NEAR_HIGH[60] * F.col("top60"),
        "pullback_above_SMA50": (F.col("close") > F.col("SMA50")) & below.between(*C.PULLBACK),
        "failed_breakout_flag": guarded(failed, 25), "extended_flag": far, "not_extended_flag": ~far,
    })
    return out.drop("top20", "top60", "_most20", "_most60", "_before20", "broke", "broke5")


def regime(df: DataFrame) -> DataFrame:
    """(benchmark, d) and the regime features of benchmarks' own bars: only those that a regime is made of."""
    back = lambda w: F.try_divide(F.col("close"), F.lag("close", w).over(by_entity())) - 1
    out = df.select("entity", "d", "close", *[mean_of(F.col("close"), w).alias(f"SMA{w}") for w in C.SMA_WINDOWS], *[back(w).alias(f"benchmark_return_{w}d") for w in C.RETURN_WINDOWS])
    swing = guarded(F.stddev_samp("benchmark_return_1d").over(trailing(20)) * F.sqrt(F.lit(float(C.SESSIONS_A_YEAR))), 21)
    out = out.withColumn("benchmark_volatility_20d", swing)
    return out.select(
        F.col("entity").alias("benchmark"), "d", *[(F.col("close") > F.col(f"SMA{w}")).alias(f"benchmark_above_SMA{w}") for w in C.SMA_WINDOWS], *[f"benchmark_return_{w}d" for w in C.RETURN_WINDOWS], "benchmark_volatility_20d",
        (share_at_or_below(F.col("benchmark_volatility_20d"), C.SESSIONS_A_YEAR, C.VOL_HIGH_LEAST) > C.VOL_HIGH_PERCENTILE).alias("benchmark_vol_high_flag"),
    )


def all_features(df: DataFrame, watch: DataFrame, regimes: DataFrame) -> DataFrame:
    """Every feature of every entity and date with a bar of its own and of its benchmark; with relative strengths.

    `regimes` (see `regime`) are as many rows as benchmarks have sessions: written before, their size is known to the join."""
    own = setup(risk(volume(returns(trend(df)))))
    out = own.join(watch, "entity").join(regimes, ["benchmark", "d"])
    return out.withColumns({f"relative_strength_{w}d": F.col(f"return_{w}d") - F.col(f"benchmark_return_{w}d") for w in C.STRENGTH_WINDOWS})


def dollar_adv(window: int = 20) -> Column:
    """Mean dollar volume of up to `window` rows, without a minimum; NULL if it is not above zero."""
    v = F.avg(F.col("close") * F.col("volume")).over(trailing(window))
    return F.when(v > 0, v)
