"""The engine's scalars as SQL functions, and a place where users name their own figures and conditions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant import config as C

_BANDS = " ".join(f"WHEN score >= {low} THEN '{name}'" for name, low in C.LABEL_BANDS)
#: name(parameters), result, and body in SQL: what the functions of `scalar` of the same names compute.
SCALARS = (
    ("pct(a DOUBLE, b DOUBLE)", "DOUBLE", "try_divide(a - b, b) * 100"),
    ("signed_change(now DOUBLE, then_ DOUBLE)", "DOUBLE", "try_divide(now - then_, abs(then_))"),
    ("clamp(x DOUBLE, low DOUBLE DEFAULT 0.0, high DOUBLE DEFAULT 100.0)", "DOUBLE", "CASE WHEN x IS NOT NULL THEN greatest(low, least(high, x)) END"),
    ("finite(x DOUBLE)", "DOUBLE", "CASE WHEN isnan(x) OR abs(x) = double('inf') THEN NULL ELSE x END"),
    ("score_label(score DOUBLE)", "STRING", f"CASE {_BANDS} END"),
    ("close_position(high DOUBLE, low DOUBLE, close DOUBLE)", "DOUBLE", "CASE WHEN high = low THEN 0.5 ELSE (close - low) / (high - low) END"),
    ("out_of_range(x DOUBLE, low DOUBLE DEFAULT -60.0, high DOUBLE DEFAULT 160.0)", "BOOLEAN", "coalesce(x < low OR x > high, false)"),
    ("days_until(target DATE, at DATE)", "INT", "CASE WHEN datediff(target, at) >= 0 THEN datediff(target, at) END"),
    ("symbol(s STRING)", "STRING", "regexp_replace(upper(s), '[^A-Z0-9]', '')"),
)


def register(spark: SparkSession) -> list[str]:
    """Makes the scalars functions of the session's SQL, and gives their names. They are SQL too: plans see through them."""
    for head, result, body in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {result} RETURN {body}")
    return [head.split("(")[0] for head, _, _ in SCALARS]


@dataclass
class Registry:
    """Named makers of columns or rows, each with the input columns that it declares."""

    kind: str
    made: dict[str, tuple[tuple[str, ...], Callable]] = field(default_factory=dict)

    def add(self, name: str, needs: tuple[str, ...] = ()):
        """Registers the decorated function under a name that isn't taken."""

        def named(f: Callable) -> Callable:
            if name in self.made:
                raise ValueError(f"there is a {self.kind} {name} already")
            self.made[name] = (needs, f)
            return f

        return named

    def get(self, name: str, df: DataFrame) -> Callable:
        """The function of a name, after a look at df's columns for what it needs."""
        if name not in self.made:
            raise KeyError(f"no {self.kind} {name}; there are {sorted(self.made)}")
        needs, f = self.made[name]
        if missing := [c for c in needs if c not in df.columns]:
            raise ValueError(f"the {self.kind} {name} needs columns {missing}")
        return f


#: Providers of figures: provider(probes with entity, d and what it declares) gives (entity, d, figures), known by d.
PROVIDERS = Registry("provider")
#: Conditions of a pattern study: condition(df with entity, d and what it declares) gives a boolean column.
CONDITIONS = Registry("condition")


def provided(probes: DataFrame, name: str) -> DataFrame:
    """probes with the figures of a provider; one row a probe, NULLs where it has none.

    The provider gets the probes, each with its date, so that it can't but answer as of that date; an answer dated
    otherwise finds no probe."""
    found = PROVIDERS.get(name, probes)(probes)
    extra = [c for c in found.columns if c not in probes.columns]
    one = found.groupBy("entity", "d").agg(*[F.first(c).alias(c) for c in extra])
    return probes.join(one, ["entity", "d"], "left")


def condition(df: DataFrame, name: str) -> Column:
    """A registered condition over df: false where it is NULL."""
    return F.coalesce(CONDITIONS.get(name, df)(df), F.lit(False))
