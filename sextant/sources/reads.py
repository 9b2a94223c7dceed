"""Reads of stored tables: composed conditions that reach the scan, point lookups, dates and versions, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scan(df: DataFrame, equal: dict | None = None, among: dict | None = None, since: dict | None = None, until: dict | None = None) -> DataFrame:
    """Rows that fit all conditions that are given: equal to a value, among values, not before and not after a value.

    A condition on None is no condition. Each is a plain comparison, so that it reaches the files."""
    for given, test in ((equal, lambda c, v: c == F.lit(v)), (among, lambda c, v: c.isin(list(v))), (since, lambda c, v: c >= F.lit(v)), (until, lambda c, v: c <= F.lit(v))):
        for name, value in (given or {}).items():
            if value is not None:
                df = df.filter(test(F.col(name), value))
    return df


def one_series(df: DataFrame, entity, as_of=None) -> DataFrame:
    """One entity's rows in the order of time, up to a date if one is given."""
    return scan(df, {"entity": entity}, until={"d": as_of}).orderBy("d")


def score_map(snapshots: DataFrame, score: str, version: str, run_date) -> DataFrame:
    """(entity, score) of a version and date, without the rows that have none; `score` must be a score column."""
    if not score.startswith("score_"):
        raise ValueError(f"{score} is no score")
    return scan(snapshots, {"model_version": version, "run_date": run_date}).filter(F.col(score).isNotNull()).select("entity", F.col(score).alias("score"))


def version_dates(snapshots: DataFrame) -> DataFrame:
    """By version: live and backfilled dates, and the first and the latest date."""
    back = F.coalesce("backfilled", F.lit(0)) == 1
    return snapshots.groupBy("model_version").agg(F.count_distinct(F.when(~back, F.col("run_date"))).alias("live_dates"), F.count_distinct(F.when(back, F.col("run_date"))).alias("backfilled_dates"), F.min("run_date").alias("first_date"), F.max("run_date").alias("latest_date"))


def live_counts(snapshots: DataFrame) -> DataFrame:
    """(model_version, run_date, n) of the rows that ran live."""
    return snapshots.filter(F.coalesce("backfilled", F.lit(0)) == 0).groupBy("model_version", "run_date").agg(F.count(F.lit(1)).alias("n"))


def lookup(df: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    """Each wanted key with its stored row, or NULLs where there is none."""
    return keys.select(*on).distinct().join(df, list(on), "left")


def evolved(df: DataFrame, ddl: str) -> DataFrame:
    """df with the columns of a wider schema: those that it lacks are NULL, its own are cast, others stay behind them."""
    wanted = StructType.fromDDL(ddl).fields
    names = {f.name for f in wanted}
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted], *[c for c in df.columns if c not in names])


def snapshot_rows(df: DataFrame, ddl: str) -> DataFrame:
    """df as snapshot rows: exactly the columns of the schema, flags as 0 or 1."""
    flags = {f.name for f in StructType.fromDDL(ddl).fields if f.dataType.typeName() == "integer"}
    fixed = df.withColumns({c: F.col(c).cast("int") for c, t in df.dtypes if t == "boolean" and c in flags})
    return evolved(fixed, ddl).select(*[f.name for f in StructType.fromDDL(ddl).fields])
