"""Figures of a company as they stood on a date: which facts were filed by then, tag chains, debt, ratios, clean-up.

Everything works over (entity, as-of date) pairs at once: probes are relations, never one date at a time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant import config as C
from sextant.functions.scalar import finite, positive
from sextant.operators import asof, pit
from sextant.sources.store import written

KEYS = ("entity", "known_at")


def cleaned(df: DataFrame) -> DataFrame:
    """df with fundamentals that are finite, and valuations only where they are above zero: no other value ranks."""
    fields = dict.fromkeys([*(f for g in C.COMPOSITES.values() for f in g["fields"]), *C.NON_NEGATIVE_VALUATIONS])
    return df.withColumns({f: positive(finite(F.col(f))) if f in C.NON_NEGATIVE_VALUATIONS else finite(F.col(f)) for f in fields if f in df.columns})


def missing_flags(df: DataFrame) -> DataFrame:
    """df with a flag for each family of fundamentals without any value, and one for all of them together."""
    none = lambda fields: reduce(lambda a, b: a & b, [F.col(f).isNull() for f in fields])
    flags = {f"{n.removesuffix('_percentile')}_missing": none(g["fields"]) for n, g in C.COMPOSITES.items()}
    return df.withColumns(flags | {"fundamentals_missing": none([f for g in C.COMPOSITES.values() for f in g["fields"]])})


def facts_as_of(facts: DataFrame, as_of: Column, tags: list[str] | None = None) -> DataFrame:
    """Facts that had been filed by a date, of the wanted tags only if given; both conditions reach the scan."""
    out = facts.filter(F.col("filed_date") <= as_of)
    return out if tags is None else out.filter(F.col("tag").isin(tags))


def states(facts: DataFrame, tags: list[str]) -> DataFrame:
    """Facts of the wanted tags with each date (known_at) on which their entity filed something, from their own on.

    Figures change only when something is filed, so they are worked out once for each such date and not for each probe;
    the rows made are those of one entity's filings times its facts. The facts of these tags are written once."""
    wanted = written(facts.filter(F.col("tag").isin(tags)), "facts")
    points = wanted.select(F.col("entity").alias("_e"), F.col("filed_date").alias("known_at")).distinct()
    return wanted.join(points, (F.col("entity") == F.col("_e")) & (F.col("filed_date") <= F.col("known_at"))).drop("_e")


def resolved(known: DataFrame, chains: dict[str, tuple[str, ...]]) -> DataFrame:
    """(entity, known_at, concept, value, period_end, tag, method): the freshest figure along each concept's tags, the
    earlier tag on a tie. A concept of period changes is a trailing year, any other the newest balance.

    Everything is worked out by (entity, known_at), so the facts are dealt by these once."""
    by = (*KEYS, "tag")
    flows = [t for c, ts in chains.items() if c in C.FLOW_CONCEPTS for t in ts]
    pairs = [F.struct(F.lit(c).alias("concept"), F.lit(t).alias("tag"), F.lit(i).alias("place")) for c, ts in chains.items() for i, t in enumerate(ts)]
    both = pit.newest(known, F.col("tag").isin(flows), *by, deal=KEYS)
    each = both.withColumn("c", F.explode(F.filter(F.array(*pairs), lambda p: p["tag"] == F.col("tag")))).filter("value IS NOT NULL")
    best = each.groupBy(*KEYS, "c.concept").agg(F.max_by(F.struct("value", "period_end", "tag", "method"), F.struct("period_end", -F.col("c.place"))).alias("x"))
    return best.select(*KEYS, "concept", "x.*")


def statements(found: DataFrame, concepts) -> DataFrame:
    """One row for each (entity, known_at): every concept's value as `<concept>` and `<concept>_end`, and the long-term tag."""
    of = lambda c, x: F.max(F.when(F.col("concept") == c, F.col(x)))
    return found.groupBy(*KEYS).agg(*[of(c, "value").alias(c) for c in concepts], *[of(c, "period_end").alias(f"{c}_end") for c in concepts], of("long_term_debt", "tag").alias("long_term_tag"))


def total_debt(lease_tags: tuple[str, ...] = C.DEBT_TAGS_WITH_LEASES) -> Column:
    """Debt of a statement: the long-term leg is required; leases by their two parts, else by the combined tag; finance
    leases not again where the long-term tag holds them already."""

    def lease(kind: str) -> Column:
        parts = [F.col(f"{kind}_lease_noncurrent"), F.col(f"{kind}_lease_current")]
        return F.when(F.coalesce(*parts).isNotNull(), sum(F.coalesce(p, F.lit(0.0)) for p in parts)).otherwise(F.col(f"{kind}_lease"))

    return pit.debt(F.col("long_term_debt"), F.col("current_debt"), lease("finance"), lease("operating"), F.col("long_term_tag").isin(list(lease_tags)))


def fundamentals_as_of(probes: DataFrame, facts: DataFrame, chains: dict[str, tuple[str, ...]] = C.CONCEPT_TAGS) -> DataFrame:
    """Statement and ratios of each probe (entity, as_of, price, sector) from the facts filed by then.

    A figure whose period ended too long before the probe is NULL, and so is what needs it. Operating margins of
    financial sectors, and equity ratios without a positive equity, are NULL; probes before any filing have only NULLs."""
    rows = statements(resolved(states(facts, sorted({t for ts in chains.values() for t in ts})), chains), tuple(chains))
    held = [c for c in rows.columns if c not in KEYS]
    full = asof.backward(probes, rows, "entity", "as_of", "known_at", held)
    old = lambda c: F.datediff("as_of", f"{c}_end") > C.DATA_AGE_DAYS
    full = full.withColumns({c: F.when(~old(c), F.col(c)) for c in chains}).withColumns({f"{c}_end": F.when(~old(c), F.col(f"{c}_end")) for c in chains})
    full = full.withColumns({"total_debt": total_debt(), "financial": F.coalesce(F.col("sector").isin(list(C.FINANCIAL_SECTORS)), F.lit(False))})
    return pit.ratios(full)


def withheld(df: DataFrame, fields: tuple[str, ...] = C.WITHHELD_RATIOS) -> DataFrame:
    """df with the ratios that are held back as NULL."""
    return df.withColumns({f: F.lit(None).cast("double") for f in fields})


def quarterly_eps(facts: DataFrame, tags: tuple[str, ...] = C.EPS_TAGS, least: int = 5) -> DataFrame:
    """(entity, period_end, filed_date, eps): quarters of 80 to 100 days as first filed, by the first tag that has `least`
    of them. Longer spans are left out, not differenced."""
    place = F.array_position(F.array(*[F.lit(t) for t in tags]), F.col("tag"))
    quarters = facts.filter(F.col("tag").isin(list(tags)) & F.col("value").isNotNull() & F.datediff("period_end", "period_start").between(80, 100))
    first = pit.originally_filed(quarters, "entity", "tag").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("entity", "tag"))).filter(F.col("_n") >= least)
    chosen = first.withColumn("_place", place).withColumn("_best", F.min("_place").over(Window.partitionBy("entity"))).filter("_place = _best")
    return chosen.select("entity", "period_end", "filed_date", F.col("value").alias("eps"))
