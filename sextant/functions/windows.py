"""Trailing and expanding windows with minimum-history guards: too little history gives NULL, not a partial value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def by_entity():
    """The time order of an entity's rows; made on use, since a window needs a session and workers import this too."""
    return Window.partitionBy("entity").orderBy("d")


def trailing(n: int, end: int = 0):
    """The last n rows of the entity, up to `end` rows from the current one."""
    return by_entity().rowsBetween(-(n - 1) + end, end)


def bars_so_far() -> Column:
    """Rows of the entity up to the current one: the history guard."""
    return F.row_number().over(by_entity())


def guarded(value: Column, least: int) -> Column:
    """value where the entity has `least` rows or more."""
    return F.when(bars_so_far() >= least, value)


def mean_of(x: Column, n: int) -> Column:
    """Mean of the last n rows, NULL before there are n."""
    return guarded(F.avg(x).over(trailing(n)), n)


def joined_blocks(df: DataFrame, size: int, count: int, top: str, low: str, fall: str, out: int) -> DataFrame:
    """df with `_top`, `_low` and `_fall` of `out` = size * count rows, from those of `count` blocks of `size` rows.

    The deepest fall of joined blocks lies within one, or goes from an earlier one's top to a later one's low: where the
    peak between them is higher, a deeper fall is counted anyway. So for values above zero nothing is approximate."""
    back = {(c, k): F.lag(c, k * size).over(by_entity()) for c in {top, low, fall} for k in range(1, count)}
    got = df.withColumns({f"_{c}_{k}_back": x for (c, k), x in back.items()})
    at = lambda c, k: F.col(f"_{c}_{k}_back") if k else F.col(c)
    falls = [F.try_divide(at(top, i) - at(low, j), at(top, i)) * 100 for i in range(count) for j in range(i)]
    return got.withColumns({
        f"_top{out}": F.greatest(*[at(top, k) for k in range(count)]), f"_low{out}": F.least(*[at(low, k) for k in range(count)]), f"_fall{out}": F.greatest(*[at(fall, k) for k in range(count)], *falls),
    }).drop(*[f"_{c}_{k}_back" for c, k in back])


def spans(df: DataFrame, x: str) -> DataFrame:
    """df with `_top`, `_low` and `_fall` of x, a column above zero, over the last 20 and 60 rows (fewer where there are
    fewer). A row takes part in some lags of a few blocks, and not in a frame of 60 rows again for each row."""
    one = df.withColumn("_none", F.when(F.col(x).isNotNull(), 0.0))
    five = joined_blocks(one, 1, 5, x, x, "_none", 5)
    return joined_blocks(joined_blocks(five, 5, 4, "_top5", "_low5", "_fall5", 20), 20, 3, "_top20", "_low20", "_fall20", 60).drop("_none", "_top5", "_low5", "_fall5")


def added(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def means(df: DataFrame, x: str) -> DataFrame:
    """df with `_mean20`, `_mean50` and `_mean200` of x over the last rows, NULL before there are as many. Sums of ten rows
    are added up by lags, so that a row isn't added again for each of the 200 rows after it."""
    back = lambda c, k: F.lag(c, k, 0).over(by_entity()) if k else F.col(c)
    one = df.withColumns({"_x": F.coalesce(F.col(x).cast("double"), F.lit(0.0)), "_there": F.count(x).over(by_entity().rowsBetween(Window.unboundedPreceding, 0))})
    ten = one.withColumn("_sum10", added([back("_x", k) for k in range(10)]))
    out = ten.withColumns({f"_sum{n}": added([back("_sum10", k) for k in range(0, n, 10)]) for n in (20, 50)})
    out = out.withColumn("_sum200", added([back("_sum50", k) for k in range(0, 200, 50)]))
    n = {w: F.col("_there") - back("_there", w) for w in (20, 50, 200)}
    return out.withColumns({f"_mean{w}": guarded(F.try_divide(F.col(f"_sum{w}"), n[w]), w) for w in n}).drop("_x", "_there", "_sum10", *[f"_sum{w}" for w in n])


def tops(df: DataFrame, x: str) -> DataFrame:
    """df with `_most20`, `_most60` and `_before20`, the largest x of the last rows and of the 20 before the current one."""
    back = lambda c, k: F.lag(c, k).over(by_entity()) if k else F.col(c)
    ten = df.withColumn("_most10", F.greatest(*[back(x, k) for k in range(10)]))
    found = {"_most20": (0, 10), "_most60": range(0, 60, 10), "_before20": (1, 11)}
    return ten.withColumns({n: F.greatest(*[back("_most10", k) for k in places]) for n, places in found.items()}).drop("_most10")


def spread60(df: DataFrame, x: str) -> DataFrame:
    """df with `_spread60`, the sample deviation of x over the last 60 rows: means and squares of ten rows, joined by lags."""
    back = lambda c, k: F.lag(c, k).over(by_entity()) if k else F.col(c)
    ten = df.withColumns({f"_x{k}": back(x, k) for k in range(10)})
    xs = [F.col(f"_x{k}") for k in range(10)]
    ten = ten.withColumn("_n10", added([x.isNotNull().cast("double") for x in xs]))
    ten = ten.withColumn("_mean10", F.try_divide(added([F.coalesce(x, F.lit(0.0)) for x in xs]), F.col("_n10")))
    ten = ten.withColumn("_square10", added([F.coalesce((x - F.col("_mean10")) * (x - F.col("_mean10")), F.lit(0.0)) for x in xs])).drop(*[f"_x{k}" for k in range(10)])
    six = ten.withColumns({f"{c}_{k}": back(c, k) for c in ("_n10", "_mean10", "_square10") for k in range(0, 60, 10)})
    at = lambda c: [F.coalesce(F.col(f"{c}_{k}"), F.lit(0.0)) for k in range(0, 60, 10)]
    six = six.withColumn("_n60", added(at("_n10")))
    six = six.withColumn("_mean60", F.try_divide(added([n * m for n, m in zip(at("_n10"), at("_mean10"), strict=True)]), F.col("_n60")))
    off = [n * (m - F.col("_mean60")) * (m - F.col("_mean60")) for n, m in zip(at("_n10"), at("_mean10"), strict=True)]
    out = six.withColumn("_spread60", F.when(F.col("_n60") > 1, F.sqrt(added([*at("_square10"), *off]) / (F.col("_n60") - 1))))
    return out.drop("_n60", "_mean60", *[f"{c}{k}" for c in ("_n10", "_mean10", "_square10") for k in ("", *[f"_{k}" for k in range(0, 60, 10)])])


def far(of: str, n: int, block: int, pick) -> Column:
    """The extreme (pick: F.greatest or F.least) of the last n rows, from the extremes `of` of the last `block` rows."""
    places = [*range(0, n - block, block), n - block]
    return pick(*[F.lag(of, k).over(by_entity()) if k else F.col(of) for k in places])


def share_at_or_below(x: Column, n: int, least: int) -> Column:
    """Percent of the non-null values of the last n rows that are at most the current one; NULL with fewer than `least`."""
    past = F.collect_list(x).over(trailing(n))
    return F.when(x.isNotNull() & (F.size(past) >= least), F.size(F.filter(past, lambda v: v <= x)) / F.size(past) * 100)
