"""File sources: nested company facts, filing blocks, zipped-table quarters, HTML tables, delimited series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sextant.operators.events import owners
from sextant.sources.archives import LINE, zipped

FACT = "struct<`end`:string,start:string,val:double,accn:string,fy:int,fp:string,form:string,filed:string>"


def company_facts(raw: DataFrame) -> DataFrame:
    """Rows of (cik, json): `facts[taxonomy][tag].units[unit][]` flattened; facts without accession, filing or end go."""
    schema = f"struct<facts:map<string,map<string,struct<units:map<string,array<{FACT}>>>>>>"
    t = raw.select("cik", F.explode(F.from_json("json", schema)["facts"]).alias("taxonomy", "tags"))
    t = t.select("cik", "taxonomy", F.explode("tags").alias("tag", "x")).select("cik", "taxonomy", "tag", F.explode("x.units").alias("unit", "rows")).select("cik", "taxonomy", "tag", "unit", F.explode("rows").alias("r"))
    out = t.select("cik", "taxonomy", "tag", "unit", F.to_date("r.start").alias("period_start"), F.to_date("r.end").alias("period_end"), F.col("r.fy").alias("fiscal_year"), F.col("r.fp").alias("fiscal_period"), F.col("r.val").alias("value"), F.col("r.form").alias("form"), F.to_date("r.filed").alias("filed_date"), F.col("r.accn").alias("accession"))
    return out.filter("accession IS NOT NULL AND filed_date IS NOT NULL AND period_end IS NOT NULL")


def filing_blocks(raw: DataFrame, forms: list[str], since: str) -> DataFrame:
    """Rows of (cik, json) with parallel arrays, one filing an index; only the forms asked for, filed since a date."""
    names = ("accessionNumber", "form", "filingDate", "acceptanceDateTime", "items")
    block = F.from_json("json", "struct<" + ",".join(f"{n}:array<string>" for n in names) + ">")
    out = raw.select("cik", block.alias("b")).select("cik", F.explode(F.arrays_zip(*[F.col(f"b.{n}").alias(n) for n in names])).alias("r")).select("cik", "r.*")
    return out.filter(F.col("form").isin(forms) & (F.col("filingDate") >= since)).select("cik", F.col("accessionNumber").alias("accession"), "form", F.to_date("filingDate").alias("filed_date"), "acceptanceDateTime", "items")


def tab_separated(spark: SparkSession, path: str, member: str, schema: str) -> DataFrame:
    """A tab-separated table with a header; the given columns by name, all read as text first, NULL where there is none,
    and `_line`, which grows in the order of the lines. `path` is the table's folder, or zip archives that hold it."""
    fields = StructType.fromDDL(schema).fields
    if not path.endswith(".zip") and not path.endswith("/*.zip"):
        rows = spark.read.csv(f"{path}/{member}", sep="\t", header=True)
        rows = rows.withColumn(LINE, F.monotonically_increasing_id())
    else:
        rows = zipped(spark, path.removesuffix("/*.zip"), member, [f.name for f in fields])
    return rows.select(*[(F.nullif(F.col(f.name), F.lit("")) if f.name in rows.columns else F.lit(None)).try_cast(f.dataType).alias(f.name) for f in fields], LINE)


def filed_day(text) -> Column:
    """A date such as 05-JAN-2024; NULL for any other form, which is not guessed at."""
    return F.when(F.trim(text).rlike("^[0-9]{2}-[A-Za-z]{3}-[0-9]{4}$"), F.try_to_timestamp(F.initcap(F.trim(text)), F.lit("dd-MMM-yyyy")).cast("date"))


def roles(text) -> Column:
    """The parts of a comma-separated list of roles, in lower case."""
    return F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), ","), lambda r: F.trim(r))


TRADES = "ACCESSION_NUMBER string, {0}_TRANS_SK string, TRANS_DATE string, TRANS_CODE string, TRANS_ACQUIRED_DISP_CD string, TRANS_SHARES double, TRANS_PRICEPERSHARE double, SHRS_OWND_FOLWNG_TRANS double, DIRECT_INDIRECT_OWNERSHIP string"


def trade_quarter(spark: SparkSession, path: str, ciks: DataFrame | None = None) -> DataFrame:
    """Trades of a quarter's four tables: submissions, owners (an accession's together), direct and derivative trades.

    `path` is the folder of the tables, a zip archive of them, or `folder/*.zip` for all archives of a folder. Submissions
    without a filing date go, as their trades could never be dated; a trade without shares or price has no value, which
    is not the same as a value of zero. `ciks` limits issuers; an empty one is an error, not the absence of a limit."""
    if ciks is not None and not ciks.limit(1).count():
        raise ValueError("the list of issuers is empty")
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    sub = tab_separated(spark, path, "SUBMISSION.tsv", "ACCESSION_NUMBER string, FILING_DATE string, ISSUERCIK string, ISSUERTRADINGSYMBOL string, DOCUMENT_TYPE string, AFF10B5ONE string")
    sub = sub.select(F.col("ACCESSION_NUMBER").alias("accession"), filed_day("FILING_DATE").alias("filed_date"), F.lpad(F.coalesce(F.trim("ISSUERCIK"), F.lit("")), 10, "0").alias("cik"), F.upper(text("ISSUERTRADINGSYMBOL")).alias("sec_symbol"), F.trim("DOCUMENT_TYPE").alias("doc_type"), F.coalesce(F.lower(F.trim("AFF10B5ONE")).isin("1", "true"), F.lit(False)).alias("is_10b5_1")).filter("filed_date IS NOT NULL")
    if ciks is not None:
        sub = sub.join(ciks, "cik", "left_semi")
    who = tab_separated(spark, path, "REPORTINGOWNER.tsv", "ACCESSION_NUMBER string, RPTOWNERCIK string, RPTOWNERNAME string, RPTOWNER_RELATIONSHIP string, RPTOWNER_TITLE string")
    is_a = lambda role: F.array_contains(roles(F.col("RPTOWNER_RELATIONSHIP")), role)
    who = owners(who.select(F.col("ACCESSION_NUMBER").alias("accession"), F.trim("RPTOWNERCIK").alias("owner"), F.trim("RPTOWNERNAME").alias("owner_name"), text("RPTOWNER_RELATIONSHIP").alias("relationship"), F.col("RPTOWNER_TITLE").alias("owner_title"), is_a("officer").alias("is_officer"), is_a("director").alias("is_director"), is_a("tenpercentowner").alias("is_ten_pct_owner"), F.col(LINE).alias("place")), "place")
    parts = []
    for kind, prefix in (("nonderiv", "NONDERIV"), ("deriv", "DERIV")):
        rows = tab_separated(spark, path, f"{prefix}_TRANS.tsv", TRADES.format(prefix))
        parts.append(rows.select(F.col("ACCESSION_NUMBER").alias("accession"), F.lit(kind).alias("table_kind"), F.trim(f"{prefix}_TRANS_SK").alias("trans_sk"), filed_day("TRANS_DATE").alias("trans_date"), F.upper(text("TRANS_CODE")).alias("trans_code"), F.upper(text("TRANS_ACQUIRED_DISP_CD")).alias("acquired_disposed"), F.col("TRANS_SHARES").alias("shares"), F.col("TRANS_PRICEPERSHARE").alias("price_per_share"), F.col("SHRS_OWND_FOLWNG_TRANS").alias("shares_owned_after"), text("DIRECT_INDIRECT_OWNERSHIP").alias("direct_indirect")))
    out = parts[0].unionByName(parts[1]).join(sub, "accession").join(who, "accession", "left")
    flags = {c: F.coalesce(c, F.lit(False)) for c in ("is_officer", "is_director", "is_ten_pct_owner")}
    return out.withColumns({**flags, "value_usd": F.col("shares") * F.col("price_per_share")})


def wide_prices(df: DataFrame, fields: tuple[str, ...] = ("open", "high", "low", "close", "volume")) -> DataFrame:
    """(ticker, d, fields) from a table by date with a column `<ticker>|<field>` for each; rows without a close go."""
    tickers = list(dict.fromkeys(c.rsplit("|", 1)[0] for c in df.columns if "|" in c))
    one = lambda t: F.struct(F.lit(t).alias("ticker"), *[(F.col(f"`{t}|{f}`") if f"{t}|{f}" in df.columns else F.lit(None)).cast("double").alias(f) for f in fields])
    return df.select("d", F.explode(F.array(*[one(t) for t in tickers])).alias("r")).select("r.ticker", "d", *[f"r.{f}" for f in fields]).filter("close IS NOT NULL")


def info_fields(df: DataFrame, text: str, fields: dict[str, tuple[str, ...]]) -> DataFrame:
    """df with numbers from a JSON text: each field by the first of its spellings that holds a finite number."""
    from sextant.functions.scalar import finite

    told = F.from_json(text, "map<string,string>")
    return df.withColumns({f: F.coalesce(*[finite(F.try_element_at(told, F.lit(k)).try_cast("double")) for k in keys]) for f, keys in fields.items()})


def estimate_rows(trend: DataFrame, revisions: DataFrame) -> DataFrame:
    """One row a (ticker, period) that either table has; what only one of them holds is kept with NULLs for the other."""
    return trend.join(revisions, ["ticker", "period"], "full_outer")


def document_url(cik, accession, document, root: str = "https://www.sec.gov/Archives/edgar/data"):
    """Address of a filing's document: the id without leading zeros, the accession without dashes."""
    return F.concat_ws("/", F.lit(root), cik.cast("long").cast("string"), F.replace(accession, F.lit("-"), F.lit("")), document)


def filing_text(html, most: int = 60_000):
    """A filing's plain text, its first `most` characters: the part that is sent on."""
    from sextant.functions.scalar import html_text

    return F.substring(html_text(html), 1, most)


def html_tables(df: DataFrame, key: str, html: str, wanted: list[str]) -> DataFrame:
    """(key, row number, cells) of the first table of each page whose header holds all wanted names; plain text cells."""
    from sextant.functions.scalar import html_text

    tables = F.regexp_extract_all(html, F.lit(r"(?is)<table[^>]*>(.*?)</table>"), F.lit(1))
    rows = lambda t: F.regexp_extract_all(t, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[hd][^>]*>(.*?)</t[hd]>"), F.lit(1)), html_text)
    fits = lambda t: F.size(F.array_intersect(cells(F.get(rows(t), 0)), F.array(*[F.lit(w) for w in wanted]))) == len(wanted)
    first = df.select(key, F.get(F.filter(tables, fits), 0).alias("t")).filter("t IS NOT NULL")
    return first.select(key, F.posexplode(rows(F.col("t"))).alias("row", "r")).select(key, "row", cells(F.col("r")).alias("cells"))


def series(spark: SparkSession, path: str) -> DataFrame:
    """(series_id, date, value) of a delimited file; values that are no number (such as ".") are left out."""
    rows = spark.read.csv(path, header=True)
    return rows.select("series_id", F.to_date("date").alias("date"), F.col("value").try_cast("double").alias("value")).filter("value IS NOT NULL")
