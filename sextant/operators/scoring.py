"""Components from features and percentiles, and horizon scores from components: expressions generated from data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant import config as C
from sextant.functions.scalar import clamp, label


def _points(condition: Column, points: float) -> Column:
    """points where the condition holds, 0 elsewhere (also where it is NULL)."""
    return F.when(condition, float(points)).otherwise(0.0)


def _all_known(value: Column, *needed: str) -> Column:
    return F.when(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in needed]), value)


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def blend(name: str) -> Column:
    """A momentum or strength component: weighted percentiles less points for negative values."""
    weights, penalties = C.BLENDS[name]
    parts = []
    for f, w in weights:
        p = F.col(f"{f}_percentile")
        if f == "return_252d":
            p = F.coalesce(p, F.col("return_120d_percentile"))
        parts.append(p * w)
    return clamp(_sum(parts) - _sum([_points(F.col(f) < 0, n) for f, n in penalties]))


def trend_component() -> Column:
    """20 points for each of five strict comparisons."""
    pairs = (("close", "SMA20"), ("close", "SMA50"), ("close", "SMA200"), ("SMA20", "SMA50"), ("SMA50", "SMA200"))
    return _all_known(clamp(_sum([_points(F.col(a) > F.col(b), 20) for a, b in pairs])), "close", "SMA20", "SMA50", "SMA200")


def volume_component() -> Column:
    """Base 50, more for rising and less for falling on volume, the balance of busy days, and the close's place."""
    v, r = F.col("volume_ratio_20d"), F.col("return_1d")
    up, down, busy = r > 0, r < 0, v > 1.2
    parts = [
        F.lit(50.0), _points(up & (v > 1.2), 10), _points(up & (v > 1.5), 15), _points(up & (v > 2.0), 10), _points(down & (v > 1.5), -25), _points(down & (v > 2.0), -15),
        (F.col("high_volume_up_days_20d") - F.col("high_volume_down_days_20d")) * 5.0, _points(F.col("weak_close_flag") & busy, -10), _points(F.col("strong_close_flag") & busy, 10),
    ]
    return _all_known(clamp(_sum(parts)), "volume_ratio_20d", "return_1d", "high_volume_up_days_20d", "high_volume_down_days_20d", "weak_close_flag", "strong_close_flag")


def risk_component() -> Column:
    """Weighted risk percentiles, less points if extended or below the 50-row mean."""
    parts = [F.col(f) * w for f, w in C.RISK_WEIGHTS]
    return _all_known(clamp(_sum(parts) - _points(F.col("extended_flag"), 20) - _points(F.col("close") < F.col("SMA50"), 15)), "extended_flag", "close", "SMA50")


def setup_component() -> Column:
    """Points of the setup flags; a failed breakout costs 30."""
    flags = (("not_extended_flag", 20), ("near_20d_high", 15), ("near_60d_high", 15), ("pullback_above_SMA50", 10), ("failed_breakout_flag", -30))
    parts = [_points(F.col("close") > F.col("SMA20"), 20), _points(F.col("close") > F.col("SMA50"), 20), *(_points(F.col(c), n) for c, n in flags)]
    return _all_known(clamp(_sum(parts)), "close", "SMA20", "SMA50", *(c for c, _ in flags))


def regime_component() -> Column:
    """Points of the benchmark's trend and returns; high volatility costs 10."""
    flags = {"benchmark_above_SMA20": 25, "benchmark_above_SMA50": 25, "benchmark_above_SMA200": 20, "benchmark_vol_high_flag": -10}
    parts = [_points(F.col(c), n) for c, n in flags.items()] + [_points(F.col(f"benchmark_return_{w}d") > 0, 15) for w in C.BENCHMARK_RETURN_WINDOWS]
    return _all_known(clamp(_sum(parts)), *flags, "benchmark_return_20d", "benchmark_return_60d")


#: Components that need an entity's own features and its benchmark's, and no percentile.
OWN = {"trend_component": trend_component, "volume_behavior_component": volume_component, "setup_component": setup_component, "market_regime_component": regime_component}
#: What `components` needs of a panel besides its percentiles, the fields that are ranked and the OWN components.
NEEDED = ("extended_flag", "close", "SMA50")


def own_components(df: DataFrame) -> DataFrame:
    """df with the OWN components that it doesn't have yet."""
    return df.withColumns({n: f() for n, f in OWN.items() if n not in df.columns})


def components(df: DataFrame) -> DataFrame:
    """All components of a frame with features and percentiles; composites that are not there sit out as NULL."""
    passed = {f"{n}_component": clamp(F.col(f"{n}_percentile")) if f"{n}_percentile" in df.columns else F.lit(None).cast("double") for n in ("value", "quality", "short_interest")}
    return own_components(df).withColumns({**{n: blend(n) for n in C.BLENDS}, "risk_component": risk_component(), **passed})


def horizon_score(weights: dict[str, float], penalty: float = 0.0, near_earnings: Column | None = None) -> Column:
    """Weighted mean of the components: NULL without a mandatory one; those that may sit out give up their weight."""
    mandatory = [F.col(c).isNotNull() for c in weights if c not in C.SITOUT]
    total = _sum([F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in weights.items()])
    value = _sum([F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in weights.items()]) / total
    if near_earnings is not None and penalty:
        value = value - _points(near_earnings, penalty)
    return F.when(reduce(lambda a, b: a & b, mandatory), clamp(value))


def penalties(version: str | None, live: bool) -> dict[str, float]:
    """Points that near earnings cost by score: none for a backfill, nor for a version that isn't listed."""
    return C.EARNINGS_PENALTIES if live and version in C.LIVE_EARNINGS_VERSIONS else dict.fromkeys(C.EARNINGS_PENALTIES, 0)


def scores(df: DataFrame, version: str | None = None, live: bool = False) -> DataFrame:
    """Horizon scores and the label of the longest; a live run of a listed version pays where days_until_earnings is near."""
    costs = penalties(version, live)
    near = F.col("days_until_earnings").between(0, C.EARNINGS_WINDOW_DAYS) if any(costs.values()) else None
    out = df.withColumns({h: horizon_score(w, costs[h], near) for h, w in C.SCORE_WEIGHTS.items()})
    return out.withColumn("score_label", label(F.col("score_120d")))
