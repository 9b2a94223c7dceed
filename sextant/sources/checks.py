"""Checks of a run's rows in the pass that writes them: figures that come with the rows, and rules that stop the run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sextant import config as C


def ruled(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df, whose first row that breaks a rule fails the job with the rule's name. NULL breaks no rule."""
    for name, holds in rules.items():
        df = df.filter(F.when(F.coalesce(holds, F.lit(True)), True).otherwise(F.raise_error(F.lit(f"broken rule: {name}")).cast("boolean")))
    return df


def observed(df: DataFrame, **figures: Column) -> tuple[DataFrame, Observation]:
    """df and what will be known of it once it has been written: `get` of the second gives the figures by name."""
    told = Observation()
    return df.observe(told, *[v.alias(k) for k, v in figures.items()]), told


def counted(condition: Column) -> Column:
    """How many rows a condition holds for."""
    return F.coalesce(F.sum(F.coalesce(condition, F.lit(False)).cast("long")), F.lit(0))


def verdict(now: int, before: int, odd: int = 0) -> str:
    """What a day's numbers say: `thin` with too few names against the day before, `odd` with values out of range."""
    if now < C.THIN_FRACTION * before:
        return "thin"
    return "odd" if odd else "ok"


def health_line(day, figures: dict) -> str:
    """A run's figures in one line, the verdict first."""
    return f"{figures['verdict']}: {day}, {figures['now']} names ({figures['before']} before), {figures['scored']} of {figures['rows']} rows scored, {figures['odd']} out of range"
