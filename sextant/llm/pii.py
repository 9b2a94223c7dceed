"""Personal data: generators propose spans with high recall, boosted trees on format and context decide.

Spans that pass the plain rules of e-mail, ip, card and phone always stay. Further generators propose secrets,
national ids, account numbers and phones without a country code; gradient-boosted trees score these, and the cut of
each kind is the one that reaches a set precision on held-out examples. The trees are fitted on the driver from a
fixed, seeded set of made-up examples (there are no labels for this), and become conditions of the plan: on the
executors there is nothing but DataFrame functions, row by row and without a shuffle."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm import boosting
from sextant.llm.common import let, table

#: Kinds in the order that breaks ties; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "secret", "national_id", "account", "local_phone")

# Loops over single characters only: a group that repeats costs a stack frame each time and long texts would overflow.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-][A-Za-z0-9.-]*?(?=\.(?![A-Za-z0-9-])|[^A-Za-z0-9.-]|\z)"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
DIGIT_RUN = r"[0-9][0-9 -]*+"
GAP = r"[ -]{2,}+|[ -]\z"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

#: Generators beyond the base kinds: kind, and a pattern whose matches are candidates.
GENERATORS = (
    ("secret", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"),
    ("national_id", r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
    ("account", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}+(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"),
    ("local_phone", r"(?<![0-9A-Za-z+(.-])\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])"),
)
CONTEXT = {
    "secret": r"(?i)(?:token|secret|passw(?:or)?d|api[_ -]?key|access[_ -]?key|private[_ -]?key|bearer|auth)\W{1,6}$",
    "national_id": r"(?i)(?:ssn|social|security|national|id|no)\W{1,6}$",
    "account": r"(?i)(?:iban|account|acct|bank|konto|compte|cuenta)\W{1,6}$",
    "local_phone": r"(?i)(?:phone|tel|call|mobile|cell|fax|contact|dial)\W{1,6}$",
}
BEFORE = 24
N_FEATURES = 11


@dataclass(frozen=True)
class PiiRules:
    """Parameters of the boosted trees and the precision that a kind's cut must reach on held-out examples."""

    trees: int = 24
    depth: int = 3
    precision: float = 0.98
    examples_a_kind: int = 600
    seed: int = 11


def _measure(kind: str, value: str, before: str, after: str) -> list[float]:
    """Inputs of the trees for one example; `features` is the same as columns."""
    n = len(value)
    digits, upper, lower = (len(re.findall(c, value, re.ASCII)) for c in ("[0-9]", "[A-Z]", "[a-z]"))
    return [
        float(KINDS.index(kind)), float(n), digits / n, upper / n, lower / n, float(len(set(value))),
        float(len(re.findall("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])", value))),
        float(bool(re.search(CONTEXT[kind], before))), float(bool(re.search(r"[=:]\s?[\"']?$", before))), float(after[:1] in ("\"", "'")),
        float(bool(re.search(r"[0-9A-Za-z$€£#/=]$", before))),
    ]


def features(kind: str, value: Column, before: Column, after: Column) -> list[Column]:
    """Inputs of the trees for one candidate of a kind."""
    n = F.length(value)
    count = lambda c: n - F.length(F.regexp_replace(value, c, ""))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return [
        F.lit(float(KINDS.index(kind))), n.cast("double"), count("[0-9]") / n, count("[A-Z]") / n, count("[a-z]") / n,
        F.size(F.array_distinct(F.split(value, ""))).cast("double"),
        F.size(F.regexp_extract_all(value, F.lit("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])"), F.lit(0))).cast("double"),
        flag(before.rlike(CONTEXT[kind])), flag(before.rlike(r"[=:]\s?[\"']?$")), flag(F.substring(after, 1, 1).isin("\"", "'")),
        flag(before.rlike(r"[0-9A-Za-z$€£#/=]$")),
    ]


def examples(rules: PiiRules) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Made-up candidates with their inputs, labels and kinds: real formats in telling places, and look-alikes."""
    rng = np.random.default_rng(rules.seed)
    pick = lambda chars, n: "".join(rng.choice(list(chars), n))
    hexa, digit, letter, mixed = "0123456789abcdef", "0123456789", "abcdefghijklmnopqrstuvwxyz", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    plain = lambda: pick(letter, int(rng.integers(3, 12))) + " "
    cues = {
        "secret": ('token = "', "secret: ", "password=", 'api_key = "', "Bearer: ", 'ACCESS_KEY = "'),
        "national_id": ("SSN: ", "social security no. ", "id: "),
        "account": ("IBAN: ", "account: ", "Konto: "),
        "local_phone": ("phone: ", "call ", "tel. ", "fax: "),
    }
    noise = ("part ", "$", "item-", "v", "sum = ", "https://x/", "isbn ", "row ", "")
    rows, y, kinds = [], [], []

    def add(kind, value, before, after, label):
        rows.append(_measure(kind, value, before[-BEFORE:], after))
        y.append(label)
        kinds.append(KINDS.index(kind))

    for _ in range(rules.examples_a_kind):
        for kind in cues:
            cue = cues[kind][int(rng.integers(len(cues[kind])))]
            cue = cue.upper() if rng.random() < 0.3 else cue
            near = noise[int(rng.integers(len(noise)))]
            quote = '"' if cue.endswith('"') else " "
            if kind == "secret":
                v = pick(hexa if rng.random() < 0.6 else mixed, int(rng.choice([20, 24, 32, 40, 48, 64])))
                v = v.upper() if rng.random() < 0.3 else v
                add(kind, v, plain() + cue, quote, 1)
                add(kind, v, plain() + '= "', '"', 1)
                add(kind, pick(letter, int(rng.integers(20, 60))), plain() + near, " ", 0)
                add(kind, pick(letter.upper(), int(rng.integers(20, 40))), plain(), "!", 0)
                add(kind, pick(digit, int(rng.integers(20, 40))), plain() + near, " ", 0)
                add(kind, "-" * int(rng.integers(20, 60)), plain(), "\n", 0)
                add(kind, "/".join(pick(letter, 7) for _ in range(4)), plain() + near, " ", 0)
                add(kind, pick(letter, int(rng.integers(20, 40))), plain() + cue, quote, 0)
            elif kind == "national_id":
                v = f"{pick(digit, 3)}-{pick(digit, 2)}-{pick(digit, 4)}"
                add(kind, v, plain() + cue, " ", 1)
                add(kind, v, plain(), " ", 1)
                add(kind, v, plain() + near.strip() + "#", " ", 0)
            elif kind == "account":
                v = pick("ABCDEFGHIKLMNPRST", 2) + pick(digit, 2) + "".join(" " * (rng.random() < 0.5) + pick(digit, 4) for _ in range(4))
                add(kind, v, plain() + cue, " ", 1)
                add(kind, v, plain(), " ", 1)
                add(kind, pick(letter.upper(), 2) + pick(digit, 2) + pick(letter.upper(), 8), plain() + near, " ", 0)
            else:
                v = f"{pick(digit, 3)}-{pick(digit, 3)}-{pick(digit, 4)}" if rng.random() < 0.5 else f"({pick(digit, 3)}) {pick(digit, 3)}-{pick(digit, 4)}"
                add(kind, v, plain() + cue, " ", 1)
                add(kind, v, plain(), " ", int(rng.random() < 0.9))
                add(kind, v.replace("-", "."), plain() + "= ", " ", 0)
    return np.array(rows), np.array(y, float), np.array(kinds)


@lru_cache(maxsize=4)
def fit(rules: PiiRules = PiiRules()):
    """(bias, trees, cut of each kind in log odds): trained on two thirds of the examples, cuts set on the rest."""
    x, y, kinds = examples(rules)
    held = np.random.default_rng(rules.seed + 1).random(len(y)) < 1 / 3
    bias, trees = boosting.boost(x[~held], y[~held], rules.trees, rules.depth)
    f, cuts = bias + sum(boosting.value(t, x[held]) for t in trees), {}
    for k in np.unique(kinds):
        s, t = f[kinds[held] == k], y[held][kinds[held] == k]
        order = np.argsort(-s)
        right = t[order].cumsum() / np.arange(1, len(t) + 1)
        good = np.nonzero(right >= rules.precision)[0]
        cuts[KINDS[k]] = float(max(0.0, s[order][good[-1]] - 1e-9)) if len(good) else float("inf")
    return bias, trees, cuts


def running(lengths: Column) -> Column:
    """Running sums of an array of longs, by blocks: no step is quadratic in its size."""
    block = 128

    def whole(v: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), ((F.size(v) - 1) / block).cast("int")), lambda b: F.aggregate(F.slice(v, b * block + 1, block), F.lit(0).cast("long"), lambda a, e: a + e))
        starts = F.aggregate(sums, F.array(F.lit(0).cast("long")), lambda a, s: F.concat(a, F.array(F.element_at(a, -1) + s)))
        return let(starts, lambda s: F.transform(v, lambda e, i: F.get(s, (i / block).cast("int")) + F.aggregate(F.slice(v, (i / block).cast("int") * block + 1, i % block + 1), F.lit(0).cast("long"), lambda a, x: a + x)))

    return F.when(F.size(lengths) == 0, lengths).otherwise(let(lengths, whole))


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches in order: array of (start, end, value) in code points, end exclusive."""

    def placed(found: Column, gaps: Column) -> Column:
        steps = F.transform(found, lambda v, i: (F.length(F.get(gaps, i)) + F.length(v)).cast("long"))
        return let(running(steps), lambda ends: F.transform(found, lambda v, i: F.struct((F.get(ends, i) - F.length(v)).alias("start"), F.get(ends, i).alias("end"), v.alias("value"))))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) == 0, _none()).otherwise(let(F.split(text, pattern, -1), lambda gaps: placed(found, gaps))))


def _none() -> Column:
    return F.from_json(F.lit("[]"), "array<struct<start:bigint,end:bigint,value:string>>")


def digits_of(value: Column) -> Column:
    """The digits of a string."""
    return F.regexp_replace(value, "[^0-9]+", "")


def luhn(digits: Column) -> Column:
    """Whether a string of at most 19 digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: let(d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1), lambda n: F.when(n > 9, n - 9).otherwise(n)))
    return F.aggregate(each, F.lit(0), lambda a, n: a + F.coalesce(n, F.lit(0))) % 10 == 0


def base_spans(text: Column) -> Column:
    """Spans of the four base kinds: array of (start, rank of the kind, end), in order."""
    emails = F.when(text.contains("@"), matches(text, EMAIL)).otherwise(_none())
    ips = F.filter(matches(text, IP), lambda m: m["value"].rlike(rf"\A{PART}(?:\.{PART}){{3}}\z"))
    runs = F.filter(matches(text, DIGIT_RUN), lambda m: F.length(m["value"]) >= 14)

    def pieces(run: Column) -> Column:
        # what lies between gaps of two separators or more; a separator at the end belongs to no piece
        cut = F.split(run["value"], GAP, -1)
        ends = let(cut, lambda c: running(F.transform(c, lambda p, i: (F.length(p) + F.coalesce(F.length(F.get(F.regexp_extract_all(run["value"], F.lit(GAP), F.lit(0)), i - 1)), F.lit(0))).cast("long"))))
        return let(ends, lambda e: F.transform(cut, lambda p, i: F.struct((run["start"] + F.get(e, i) - F.length(p)).alias("start"), (run["start"] + F.get(e, i)).alias("end"), p.alias("value"))))

    cards = F.filter(
        F.filter(F.flatten(F.transform(runs, pieces)), lambda m: F.length(m["value"]) >= 14),
        lambda m: let(digits_of(m["value"]), lambda d: F.length(d).between(14, 19) & luhn(d)),
    )
    phones = F.filter(F.when(text.contains("+"), matches(text, PHONE)).otherwise(_none()), lambda m: F.length(digits_of(m["value"])).between(10, 15))

    def ranked(k: int, found: Column) -> Column:
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("rank"), m["end"].alias("end")))

    some = text.rlike("[0-9@]")
    return F.when(some, F.sort_array(F.concat(*[ranked(k, found) for k, found in enumerate((emails, ips, cards, phones))]))).otherwise(F.from_json(F.lit("[]"), "array<struct<start:bigint,rank:int,end:bigint>>"))


def added_spans(text: Column, base: Column, rules: PiiRules = PiiRules()) -> Column:
    """Spans that the boosted trees accept and that touch no base span: array of (start, rank, end), in order."""
    bias, trees, cuts = fit(rules)

    def accepted(kind: str, m: Column) -> Column:
        before = F.substring(text, F.greatest(m["start"] - BEFORE + 1, F.lit(1)).cast("int"), F.least(m["start"], F.lit(BEFORE)).cast("int"))
        after = F.substring(text, (m["end"] + 1).cast("int"), F.lit(1))

        def above(f: Column) -> Column:
            total = F.lit(bias)
            for t in trees:
                total = total + boosting.column(t, [F.get(f, j) for j in range(N_FEATURES)])
            return total >= cuts[kind]

        return let(F.array(*features(kind, m["value"], before, after)), above)

    def proposed(kind: str, pattern: str) -> Column:
        free = lambda m: ~F.exists(base, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))
        spans = F.filter(matches(text, pattern), lambda m: free(m) & accepted(kind, m))
        return F.transform(spans, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), m["end"].alias("end")))

    found = [proposed(kind, pattern) for kind, pattern in GENERATORS if cuts.get(kind, float("inf")) < float("inf")]
    none = F.from_json(F.lit("[]"), "array<struct<start:bigint,rank:int,end:bigint>>")
    return F.when(text.rlike("[0-9]"), F.sort_array(F.concat(*found, none))).otherwise(none)





def find(docs: DataFrame, rules: PiiRules = PiiRules()) -> DataFrame:
    """docs with `pii_base` and `pii_added`: arrays of (start, rank in KINDS, end), by start, then kind.

    Null and empty texts have no spans. Rows are independent: repeated rows give equal spans. The two columns replace
    columns of the same names; all others stay as they are."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn("pii_base", base_spans(text)).withColumn("pii_added", added_spans(text, F.col("pii_base"), rules))


def redact(docs: DataFrame, rules: PiiRules = PiiRules()) -> DataFrame:
    """docs with each span of the text replaced by its kind in brackets; overlapping spans become one, of the first kind.

    A null text stays null; columns are those of docs, and only `text` changes."""
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    spans = F.sort_array(F.concat("pii_base", "pii_added"))
    empty = F.from_json(F.lit("[]"), "array<struct<start:bigint,rank:int,end:bigint>>")

    def joined(a: Column, s: Column) -> Column:
        last = F.element_at(a, -1)
        grown = F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last["start"].alias("start"), last["rank"].alias("rank"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["end"] > s["start"]), grown).otherwise(F.concat(a, F.array(s)))

    def cut(text: Column, s: Column) -> Column:
        upto = lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))
        parts = F.transform(s, lambda m, i: F.concat(upto(F.coalesce(F.get(s, i - 1)["end"], F.lit(0)), m["start"]), F.get(tags, m["rank"])))
        return F.concat(F.array_join(parts, ""), upto(F.element_at(s, -1)["end"], F.length(text).cast("long")))

    found = find(docs.select("*"), rules)
    merged = F.aggregate(spans, empty, joined)
    out = found.withColumn("text", F.when(F.size("pii_base") + F.size("pii_added") == 0, F.col("text")).otherwise(let(merged, lambda s: cut(F.col("text"), s))))
    return out.select(*docs.columns)


def named(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", F.get(names, m["rank"]), m["start"].cast("string"), m["end"].cast("string"))), ",")


def op7_pii_boosted(spark, sf_dir: str) -> DataFrame:
    """Counts, digest of the base spans and all spans of every document."""
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda k: F.size(F.filter("pii_base", lambda m: m["rank"] == k)).cast("long")
    return found.select(
        "doc_id", *[n(k).alias(f"n_{KINDS[k]}") for k in range(4)],
        F.sha2(named(F.col("pii_base")), 256).alias("base_sha256"),
        named(F.sort_array(F.concat("pii_base", "pii_added"))).alias("spans"),
    )
