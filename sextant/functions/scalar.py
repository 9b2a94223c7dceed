"""Safe scalar expressions. Missing input gives NULL, never zero; division by zero gives NULL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sextant import config as C


def finite(x: Column) -> Column:
    """x as a double, NULL where it is not a number or infinite."""
    v = x.cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), None).otherwise(v)


def pct(a: Column, b: Column) -> Column:
    """(a - b) / b in percent."""
    return F.try_divide(a - b, b) * 100


def signed_change(now: Column, then: Column) -> Column:
    """(now - then) / |then|, right across a change of sign."""
    return F.try_divide(now - then, F.abs(then))


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """x held within [low, high]; NULL stays NULL."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def label(score: Column) -> Column:
    """The highest band that the score reaches; NULL below zero or without a score."""
    out = F.lit(None).cast("string")
    for name, low in reversed(C.LABEL_BANDS):
        out = F.when(score >= low, name).otherwise(out)
    return out


def close_position(high: Column, low: Column, close: Column) -> Column:
    """Where the close lies between low (0) and high (1); 0.5 where they are one."""
    return F.when(high == low, 0.5).otherwise((close - low) / (high - low))


def positive(x: Column) -> Column:
    """x where it is above zero; a valuation at or below zero means nothing."""
    return F.when(x > 0, x)


def present_mean(columns: list[Column]) -> Column:
    """Mean of those that are not NULL."""
    n = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in columns])
    return F.try_divide(reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in columns]), n)


def stale_fundamentals(recovered: Column, point_in_time: Column) -> Column:
    """Recovered later, and not with point-in-time fundamentals."""
    return (F.coalesce(recovered, F.lit(0)) == 1) & (F.coalesce(point_in_time, F.lit(0)) != 1)


def weight_note(ic: Column) -> Column:
    """What an information coefficient suggests for a component's weight."""
    return F.when(ic > 0.10, "consider raising").when(ic < -0.05, "consider lowering").when(ic.isNotNull(), "keep")


def weight_sentence(ic: Column) -> Column:
    """The same as a sentence with the coefficient in it."""
    say = lambda what: F.format_string(f"IC %.3f: {what} its weight", ic)
    return F.when(ic > 0.10, say("consider raising")).when(ic < -0.05, say("consider lowering")).when(ic.isNotNull(), say("keep"))


def out_of_range(x: Column, low: float = -60.0, high: float = 160.0) -> Column:
    """Whether a value lies outside the range that any component can plausibly reach before it is clamped."""
    return F.coalesce((x < low) | (x > high), F.lit(False))


def days_until(target: Column, at: Column) -> Column:
    """Days from a date to a target that is a date or its text; NULL for a target that is past or no date."""
    days = F.datediff(target.try_cast("date"), at)
    return F.when(days >= 0, days)


def items(codes: Column) -> Column:
    """Codes of a comma-separated string: trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(codes, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def is_material(codes: Column) -> Column:
    """Whether any code is left without the routine ones."""
    return F.size(F.array_except(items(codes), F.array(*[F.lit(x) for x in C.ROUTINE_ITEMS]))) > 0


def html_text(html: Column) -> Column:
    """Plain text of HTML: scripts and styles, tags, entities and runs of white space go, in this order."""
    t = F.coalesce(html, F.lit(""))
    for name in ("script", "style"):
        t = F.regexp_replace(t, rf"(?is)<{name}[^>]*>.*?</{name}>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&#8217;", "'")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    t = F.regexp_replace(t, r"&[a-zA-Z#0-9]+;", " ")
    return F.trim(F.regexp_replace(t, r"[ \t\n\r\f\x0B]+", " "))


def symbol(s: Column) -> Column:
    """Upper case, letters and digits only: the key of a second, looser match."""
    return F.regexp_replace(F.upper(s), "[^A-Z0-9]", "")


def mapped(s: Column, pairs: dict[str, str]) -> Column:
    """The mapped value, or the value itself."""
    m = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.coalesce(F.try_element_at(m, s), s)


def benchmark_of(sector: Column, size_bucket: Column, industry: Column) -> Column:
    """Benchmark of an entity: semiconductors first, then size, then sector, else the market."""
    m = F.create_map(*[F.lit(x) for kv in C.SECTOR_BENCHMARKS.items() for x in kv])
    return (
        F.when(F.lower(industry).contains("semiconductor"), "SMH").when(size_bucket == "mid", "MDY").when(size_bucket == "small", "IWM")
        .otherwise(F.coalesce(F.try_element_at(m, sector), F.lit("SPY")))
    )


def weekdays_between(start: Column, end: Column) -> Column:
    """Weekdays strictly between two dates."""
    days = F.when(end > F.date_add(start, 1), F.sequence(F.date_add(start, 1), F.date_sub(end, 1))).otherwise(F.array().cast("array<date>"))
    return F.size(F.filter(days, lambda d: F.weekday(d) < 5))


def one_json(text: Column, keys: list[str]) -> Column:
    """The first {...} of a text as JSON with the keys asked for only; NULL if it is no JSON or one of them is missing."""
    body = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    value = F.try_parse_json(F.when(body != "", body))
    found = F.json_object_keys(F.when(value.isNotNull(), body))
    whole = F.size(F.array_except(F.array(*[F.lit(k) for k in keys]), found)) == 0
    return F.when(whole, F.to_json(F.struct(*[F.variant_get(value, f'$["{k}"]', "variant").alias(k) for k in keys]), {"ignoreNullFields": "false"}))


def spread_bps(adv: Column) -> Column:
    """Spread in basis points from dollar volume; unknown volume costs the most."""
    bps = C.SPREAD_BASE + C.SPREAD_COEF / F.sqrt(adv / 1e6)
    return F.when(adv > 0, clamp(bps, C.SPREAD_MIN, C.SPREAD_MAX)).otherwise(C.SPREAD_MAX)


def impact_bps(trade: Column, adv: Column) -> Column:
    """Impact in basis points: square root of participation, which is capped; unknown volume costs the most."""
    share = F.least(trade / adv, F.lit(C.PARTICIPATION_CAP))
    return F.when((adv > 0) & (trade > 0), C.IMPACT_COEF * F.sqrt(share)).otherwise(C.SPREAD_MAX)


def one_way_bps(trade: Column, adv: Column) -> Column:
    """Half the spread and the impact."""
    return spread_bps(adv) / 2 + impact_bps(trade, adv)


def rounded(df, skip: tuple[str, ...] = ()):
    """Doubles of a frame to 6 digits, negative zero as zero; for results that two engines compare."""
    return df.select(*[(F.round(F.col(f"`{c}`"), 6) + F.lit(0.0)).alias(c) if t == "double" and c not in skip else F.col(f"`{c}`") for c, t in df.dtypes])
