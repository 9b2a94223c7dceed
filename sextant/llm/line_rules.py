"""Line-first cleaning: rules judge each line, failing lines go, and a document that loses too much text is rejected.

All of it is row-local: one pass over the documents, no shuffle, no Python on the executors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import SPACE, let, words

#: Words of navigation and of page furniture in the order of the rules, by language.
NAVIGATION = (
    "home", "menu", "login", "sign in", "sign up", "next page", "previous page", "back to top", "read more", "click here", "site map", "search",
    "startseite", "anmelden", "weiterlesen", "nach oben", "suche", "kontakt", "accueil", "connexion", "lire la suite", "haut de page", "recherche", "inicio", "iniciar sesi\u00f3n", "leer m\u00e1s", "volver arriba", "buscar",
)
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "lorem ipsum", "javascript", "subscribe to our newsletter", "powered by",
    "alle rechte vorbehalten", "datenschutzerkl\u00e4rung", "nutzungsbedingungen", "impressum", "tous droits r\u00e9serv\u00e9s", "mentions l\u00e9gales", "politique de confidentialit\u00e9", "todos los derechos reservados", "pol\u00edtica de privacidad", "aviso legal",
)
#: Marks that may end a line of prose.
END_MARKS = ".!?:;\u2026\"'\u201d\u2019\u00bb)\u3002\uff01\uff1f\u061f\u0964]"


@dataclass(frozen=True)
class LineRules:
    """Parameters of the cleaning; the window of 8 words and the two base limits are those of the base verdict."""

    max_symbol_share: float = 0.05
    max_upper_share: float = 0.7
    min_upper_letters: int = 12
    min_bar_fields: int = 3
    max_word_run: int = 4
    navigation_words: int = 6
    open_words: int = 3
    max_lost_share: float = 0.3
    min_words: int = 20
    max_repeat_percent: int = 30


def n_symbols(text: Column) -> Column:
    """Characters of `[#*$%&|<>]` in a text. The search comes first: most texts have none, and counting is dearer."""
    return F.when(text.rlike("[#*$%&|<>]"), F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]+", ""))).otherwise(0)


def repeated_words(w: Column) -> Column:
    """Words that lie in a window of 8 words found twice or more in the array w, the first time included.

    Windows are compared by 64-bit hashes, joined from those of 1, 2 and 4 words. Texts without a repeat end after one
    hash set; only the others sort their windows. No step is worse than n log n in the words of one text."""

    window = 8

    def joined(h: Column, step: int) -> Column:
        return F.transform(h, lambda v, i: F.xxhash64(v, F.get(h, i + step)))

    def of_hashes(h: Column) -> Column:
        whole = let(joined(h, 1), lambda a: let(joined(a, 2), lambda b: joined(b, 4)))
        return let(
            F.slice(whole, 1, F.size(h) - (window - 1)),
            lambda x: F.when(F.size(F.array_distinct(x)) == F.size(x), F.lit(0)).otherwise(covered(x)),
        )

    def covered(x: Column) -> Column:
        pairs = F.sort_array(F.transform(x, lambda v, i: F.struct(v.alias("h"), i.alias("p"))))
        twice = let(
            pairs,
            lambda s: F.sort_array(
                F.transform(
                    F.filter(s, lambda v, i: (F.get(s, i - 1)["h"] == v["h"]).eqNullSafe(True) | (F.get(s, i + 1)["h"] == v["h"]).eqNullSafe(True)),
                    lambda v: v["p"],
                )
            ),
        )
        return let(twice, lambda p: F.aggregate(F.transform(p, lambda v, i: F.least(F.coalesce(F.get(p, i + 1) - v, F.lit(window)), F.lit(window))), F.lit(0), lambda a, v: a + v))

    return F.when(F.size(w) < window + 1, F.lit(0)).otherwise(let(F.transform(w, lambda v: F.xxhash64(v)), of_hashes)).cast("long")


def duplicate_lines(lines: Column) -> Column:
    """Lines with a word that equal an earlier line of the text."""
    full = F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def _class(chars: str) -> str:
    """chars as the inside of a character class of a pattern."""
    return "".join("\\" + c if c in "]\\^-[" else c for c in chars)


def bad_line(line: Column, rules: LineRules) -> Column:
    """Whether a line fails a rule: punctuation (symbols, or `open_words` or more words without a mark at the end),
    shouting, table bars, runs of one word, navigation, boilerplate."""
    low = F.lower(line)
    few = F.size(F.split(F.trim(line), SPACE)) <= rules.navigation_words
    shouted = line.rlike(r"\p{Lu}{2,}+.*\p{Lu}{2,}")
    letters = F.length(F.regexp_replace(line, r"[^\p{L}]+", ""))
    upper = F.length(F.regexp_replace(line, r"[^\p{Lu}]+", ""))
    furniture = F.lit(False)
    for phrase in BOILERPLATE:
        furniture = furniture | low.contains(phrase)
    return (
        (line.rlike("[#*$%&|<>]") & ((n_symbols(line) > rules.max_symbol_share * F.length(line)) | line.rlike(r"\|(?:[^|]*+\|){%d}" % (rules.min_bar_fields - 1))))
        | (line.contains("!!") & line.rlike(r"!![\x20\x09-\x0D].*!!"))
        | (shouted & (letters >= rules.min_upper_letters) & (upper > rules.max_upper_share * letters))
        | line.rlike(rf"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++)(?:[\x20\x09-\x0D]++\1(?![^\x20\x09-\x0D])){{{rules.max_word_run - 1},}}+")
        | (few & low.rlike("^[^a-z]*(?:" + "|".join(NAVIGATION) + ")[^a-z]*$"))
        | furniture
        | (~line.rlike(rf"[{_class(END_MARKS)}][\x20\x09-\x0D]*\z") & line.rlike(r"[^\x20\x09-\x0D]") & (F.size(words(line)) >= rules.open_words))
    )


def clean_lines(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """doc_id, base counts, the cleaned text (failing lines removed) and the verdict of each row of docs.

    Null and empty texts: no words, base_failed, not kept, cleaned text empty. Rows are independent, so repeated
    rows and ties need no rule; other columns of docs are not read. Texts are read whole at any length."""
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = docs.select(F.col("doc_id"), text.alias("text"))
    split = parts.select("doc_id", "text", words(F.col("text")).alias("w"), F.split(F.col("text"), "\n").alias("lines"))
    flagged = split.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        n_symbols(F.col("text")).cast("long").alias("n_symbols"),
        duplicate_lines(F.col("lines")).alias("n_dup_lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
        F.length("text").alias("chars"),
        F.filter("lines", lambda x: ~bad_line(x, rules)).alias("good"),
    )
    judged = flagged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))).alias("base_failed"),
        "chars", F.array_join("good", "\n").alias("cleaned"),
    )
    lost = (F.col("chars") - F.length("cleaned")) > rules.max_lost_share * F.col("chars")
    return judged.withColumn("kept", ~F.col("base_failed") & ~lost)


def _sql() -> str:
    """The same by DuckDB, for the default parameters; runs of a word and repeated windows go by lists of words."""
    r, space, end = LineRules(), r"[\x20\x09-\x0D]", r"\n\r\x{85}\x{2028}\x{2029}"
    quoted = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)
    symbols = lambda x: f"len(regexp_replace({x}, '[^#*$%&|<>]+', '', 'g'))"
    split = lambda x: f"list_filter(regexp_split_to_array({x}, '{space}+'), lambda w: w <> '')"
    letters = lambda kind: f"len(regexp_replace(line, '[^\\p{{{kind}}}]+', '', 'g'))"
    rules = (
        f"({symbols('line')} > {r.max_symbol_share}::DOUBLE * len(line))", f"(len(regexp_replace(line, '[^|]+', '', 'g')) >= {r.min_bar_fields})", f"regexp_matches(line, '!!{space}[^{end}]*!!')",
        f"(regexp_matches(line, '\\p{{Lu}}{{2}}[^\\p{{Lu}}{end}][^{end}]*\\p{{Lu}}{{2}}') AND {letters('L')} >= {r.min_upper_letters} AND {letters('Lu')} > {r.max_upper_share}::DOUBLE * {letters('L')})",
        f"(len(lw) >= {r.max_word_run} AND len(list_filter(range(1, len(lw) - {r.max_word_run - 2}), lambda i: {' AND '.join(f'lw[i] = lw[i + {j}]' for j in range(1, r.max_word_run))})) > 0)",
        f"(len(regexp_split_to_array(trim(line, ' '), '{space}+')) <= {r.navigation_words} AND regexp_matches(lower(line), '^[^a-z]*(?:{'|'.join(NAVIGATION)})[^a-z]*$'))",
        f"(len(list_filter([{quoted(BOILERPLATE)}], lambda b: contains(lower(line), b))) > 0)", f"(len(lw) >= {r.open_words} AND NOT contains({quoted([END_MARKS])}, right(regexp_replace(line, '{space}+$', ''), 1)))",
    )
    return f"""WITH t AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text, {split("coalesce(text, '')")} AS w FROM documents),
l AS (SELECT k, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM t),
lw AS (SELECT *, {split('line')} AS lw FROM l), j AS (SELECT *, {' OR '.join(rules)} AS bad FROM lw),
li AS (SELECT k, count(*) FILTER (len(lw) > 0) - count(DISTINCT line) FILTER (len(lw) > 0) AS n_dup_lines, coalesce(sum(len(line) + 1) FILTER (NOT bad) - 1, 0) AS cleaned FROM j GROUP BY k),
g AS (SELECT k, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT k, w, unnest(range(1, len(w) - 6)) AS i FROM t WHERE len(w) > 8)), tw AS (SELECT k, i FROM g QUALIFY count(*) OVER (PARTITION BY k, g) > 1),
rp AS (SELECT k, count(DISTINCT i + o) AS n FROM tw, range(0, 8) r(o) GROUP BY k),
d AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: len(x))), 0) AS BIGINT) AS word_chars, CAST({symbols('text')} AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(coalesce(rp.n, 0) AS BIGINT) AS n_repeat_words, len(text) AS chars, cleaned FROM t JOIN li USING (k) LEFT JOIN rp USING (k))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {r.min_words} OR 100 * n_repeat_words > {r.max_repeat_percent} * n_words AS base_failed,
  NOT (n_words < {r.min_words} OR 100 * n_repeat_words > {r.max_repeat_percent} * n_words) AND NOT chars - cleaned > {r.max_lost_share}::DOUBLE * chars AS kept FROM d"""


ORACLE = _sql()


def op3_line_rules(spark, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    from sextant.llm.common import table

    return clean_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
