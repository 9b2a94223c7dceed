"""Cross-sectional ranks of a date: average-tie percent rank, within groups with a fallback, deciles, top-N."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sextant import config as C


def percent_rank(field: str, *keys: str, descending: bool = False) -> Column:
    """Average rank of ties over the non-null count, times 100; NULL stays NULL.

    Nulls sort last, so they leave ranks alone, and the count of equal values adds the field to the same keys: every
    window here is served by one exchange on the keys."""
    x, by = F.col(field), Window.partitionBy(*keys)
    order = x.desc_nulls_last() if descending else x.asc_nulls_last()
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, field))
    return F.when(x.isNotNull(), (F.rank().over(by.orderBy(order)) + (ties - 1) / 2) / F.count(x).over(by) * 100)


def percent_ranks(x: np.ndarray, has: np.ndarray, part: np.ndarray | None = None) -> pa.Array:
    """What `percent_rank` gives for a column of values, some of which are there (has), within equal `part` if given."""
    i = np.flatnonzero(has)
    order = i[np.argsort(x[i], kind="stable") if part is None else np.lexsort((x[i], part[i]))]
    v, first = x[order], np.zeros(len(order), bool)
    first[:1] = True
    if part is not None:
        first[1:] |= part[order][1:] != part[order][:-1]
    starts = first.copy()
    starts[1:] |= (v[1:] != v[:-1]) & ~(np.isnan(v[1:]) & np.isnan(v[:-1]))
    (begins, n), (firsts, m) = ((k, np.diff(np.append(k, len(order)))) for k in (np.flatnonzero(starts), np.flatnonzero(first)))
    out = np.zeros(len(x))
    out[order] = (np.repeat(begins + (n + 1) / 2, n) - np.repeat(firsts, m)) / np.repeat(m, m) * 100
    return pa.array(out, mask=~has)


def day_ranks(df: DataFrame, fields: dict[str, int], groups: dict | None = None, neutral: tuple[str, ...] = (), least: int = C.SECTOR_MIN_MEMBERS) -> DataFrame:
    """df with `<field>_percentile` of each field (-1 ranks downwards), and of each of `groups` (see `composites`) the mean
    rank of its fields and, if it is neutral, `_big_<group>`: whether a row's sector ranks within itself.

    Rows are dealt once, by date, with a column for each field; a date's columns are each sorted by themselves. So a row
    is never one row a field, but a date has to fit a task: give only the columns that are needed after."""
    groups = groups or {}
    double = [*(f"{f}_percentile" for f in fields), *groups]
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.DoubleType()) for n in double), *(T.StructField(f"_big_{n}", T.BooleanType()) for n in neutral)])

    columns_before = len(df.columns)

    def day(rows: pa.Table) -> pa.Table:
        def values(field: str, sign: int) -> tuple[np.ndarray, np.ndarray]:
            c = rows.column(field)
            return c.cast(pa.float64()).fill_null(0.0).to_numpy() * sign, c.is_valid().to_numpy()

        found = {f"{f}_percentile": percent_ranks(*values(f, sign)) for f, sign in fields.items()}
        if groups:
            told = rows.column("sector").combine_chunks().dictionary_encode()
            sector = told.indices.fill_null(-1).to_numpy(zero_copy_only=False) + 1
            index = np.isin(sector, [k + 1 for k, s in enumerate(told.dictionary.to_pylist()) if s == C.INDEX_SECTOR])
        for name, g in groups.items():
            columns = [values(f, -1 if f in g["inverted"] else 1) for f in g["fields"]]
            if name in neutral:
                members = np.bincount(sector, weights=np.logical_or.reduce([has for _, has in columns]) & ~index)
                big = members[sector] >= least
                found[f"_big_{name}"] = pa.array(big)
            total, n = np.zeros(rows.num_rows), np.zeros(rows.num_rows, int)
            for x, has in columns:
                sides = [(percent_ranks(x, has), has)]
                if name in neutral:
                    has = has & ~index
                    sides = [(percent_ranks(x, has, sector), has & big & (sector > 0)), (percent_ranks(x, has), has & ~big)]
                for rank, here in sides:
                    total += np.where(here, rank.fill_null(0.0).to_numpy(), 0.0)
                    n += here
            found[name] = pa.array(total / np.maximum(n, 1), mask=n == 0)
        for f in schema.fields[columns_before:]:
            rows = rows.append_column(f.name, found[f.name])
        return rows

    return df.groupBy("d").applyInArrow(day, schema)


#: Fields that are ranked over a date, and whether upwards (1) or downwards (-1).
RANKED = dict.fromkeys(C.NORMAL_PERCENTILES, 1) | dict.fromkeys((*C.INVERTED_PERCENTILES, "distance_from_52w_high_pct"), -1)


def _capped(ranked: DataFrame) -> DataFrame:
    high = F.col("distance_from_52w_high_pct_percentile")
    return ranked.withColumn("distance_from_52w_high_adjusted_percentile", F.when(F.col("extended_flag"), F.least(high, F.lit(50.0))).otherwise(high)).drop("distance_from_52w_high_pct_percentile")


def _composed(ranked: DataFrame, groups: dict, neutral: tuple[str, ...]) -> DataFrame:
    out, fall = ranked.withColumns({n: F.round(n, 9) for n in groups}), F.lit(False)  # equal means stay equal, whatever the order of the sum
    for n in neutral:
        fall = fall | (F.col(n).isNotNull() & ~F.col(f"_big_{n}"))
    return out.withColumn("sector_rank_fallback", fall).drop(*[f"_big_{n}" for n in neutral])


def percentiles(df: DataFrame) -> DataFrame:
    """Percentiles of a date: returns and strengths upwards, risks downwards, the distance from the high capped if extended."""
    return _capped(day_ranks(df, RANKED))


def composites(df: DataFrame, groups: dict, neutral: tuple[str, ...] = (), least: int = C.SECTOR_MIN_MEMBERS) -> DataFrame:
    """Composite percentiles: the mean of the fields' ranks that are present.

    Composites named in `neutral` leave index rows out. They rank within (d, sector) where `least` members or more have
    any field, and over all of the date elsewhere, which `sector_rank_fallback` tells. A NULL sector never ranks within
    itself."""
    return _composed(day_ranks(df, {}, groups, neutral, least), groups, neutral)


def cross_section(df: DataFrame, groups: dict, neutral: tuple[str, ...]) -> DataFrame:
    """`percentiles` and `composites` of df, its dates dealt once for both."""
    return _composed(_capped(day_ranks(df, RANKED, groups, neutral)), groups, neutral)


def deciles(score: str, n: int = C.DECILES, *keys: str) -> Column:
    """Decile of a score within the keys, 1 the best; ties share one, so some can be empty."""
    share = percent_rank(score, *(keys or ("d",)), descending=True) / 100
    return F.least(F.lit(n), F.greatest(F.lit(1), F.ceil(F.round(share * n, 9)))).cast("int")


def top_with_ties(df: DataFrame, score: str, n: int) -> DataFrame:
    """The best n of each date, and all that tie with the last."""
    found = df.filter(F.col(score).isNotNull()).withColumn("place", F.rank().over(Window.partitionBy("d").orderBy(F.desc(score))))
    return found.filter(F.col("place") <= n)


def top_exact(df: DataFrame, score: str, n: int) -> DataFrame:
    """Exactly the best n of each date; ties go to the smaller entity."""
    found = df.filter(F.col(score).isNotNull()).withColumn("place", F.row_number().over(Window.partitionBy("d").orderBy(F.desc(score), "entity")))
    return found.filter(F.col("place") <= n)


def ordinal_rank(field: str, *keys: str) -> Column:
    """Zero-based rank, ties by entity; NULL with fewer than three values."""
    x, by = F.col(field), Window.partitionBy(*keys)
    return F.when(x.isNotNull() & (F.count(x).over(by) >= 3), F.row_number().over(by.orderBy(x.asc_nulls_last(), "entity")) - 1)


def movers(df: DataFrame, change: str, n: int) -> DataFrame:
    """(side, place, entity, change): the n largest rises and the n largest falls; ties by entity, no change is neither."""
    x, by = F.col(change), Window.partitionBy("side").orderBy(F.desc(F.abs(F.col(change))), "entity")
    sided = df.filter(x != 0).withColumn("side", F.when(x > 0, "up").otherwise("down"))
    return sided.withColumn("place", F.row_number().over(by).cast("long")).filter(F.col("place") <= n).select("side", "place", "entity", change)
