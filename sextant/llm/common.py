"""What the corpus operators share: tokens, folds, tables, bounded samples and the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
_OWN_DIR: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` below `sf_dir`, by Spark's reader (any store that Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row: a lambda parameter is bound, an alias may be inlined."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text, in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); a temporary one where it is unset in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="sextant-"))
    return f"file://{_OWN_DIR[0]}"


def batched(df: DataFrame) -> DataFrame:
    """df, after bounding the rows that go to a Python task at a time: texts are long, and Spark's own bound is 10,000.

    This is a setting of the session, the same for all operators here, so their order does not matter."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return df


@contextmanager
def swept(spark: SparkSession):
    """Shuffle files of what is made and run within go when it has run, not when the driver's memory is next cleaned:
    nothing is run again that was run here."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read again: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    with swept(spark):
        df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def sampled(df: DataFrame, by: Column, most: int, key: Column) -> DataFrame:
    """About `most` rows of each value of `by` at the most, the same ones in every run.

    The rows are those with the smallest hashes of `key`. Counts come from all rows, so the sample's size does
    not grow with the input; its expected size is `most` a value."""
    hashed = F.pmod(F.xxhash64(key), F.lit(1 << 30))
    counts = df.groupBy(by.alias("by")).agg(F.count(F.lit(1)).alias("n")).collect()
    keep = F.lit(False)
    for row in counts:
        share = min(1.0, most / row["n"])
        keep = keep | (by.eqNullSafe(F.lit(row["by"])) & (hashed < int(share * (1 << 30))))
    return df.filter(keep)


def labelled(docs: DataFrame, labels: DataFrame, label: str, training, most: int) -> list:
    """(doc_id, text, label) rows for fitting, on the driver: about `most` labelled rows of each class at the most.

    `training` maps the doc_id column to the condition of the rows that may be learned from. The ids are drawn from
    the narrow labels table first; only their texts are then read, through a join with that bounded list. Rows that
    repeat one of these count once."""
    key = F.col("doc_id").cast("long")
    rows = labels.select(key.alias("doc_id"), F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & training(F.col("doc_id")))
    few = sampled(rows, F.col("label"), most, F.col("doc_id"))
    found = docs.select(key.alias("doc_id"), "text").filter(F.col("text").isNotNull()).join(F.broadcast(few), "doc_id").distinct().collect()
    return sorted(found, key=lambda r: (r["doc_id"], r["label"], r["text"]))


def newton_logistic(x, y, weight=None, ridge: float = 0.3, rounds: int = 40):
    """Weights (the last one the intercept) of a ridge logistic regression, by damped Newton steps; y may be soft."""
    import numpy as np

    a = np.c_[x, np.ones(len(x))]
    w, s = np.zeros(a.shape[1]), np.ones(len(a)) if weight is None else np.asarray(weight, float)
    hold = np.full(a.shape[1], ridge)
    hold[-1] = 1e-3
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (s * q * (1 - q))[:, None]).T @ a + np.diag(hold), a.T @ (s * (q - y)) + hold * w)
        w = w - step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def tokens(texts):
    """(row, code, words) of an Arrow array of texts: each word's row and its number in `words`, in order.

    Words are those of `[^\\x20\\x09-\\x0D]+` with A-Z in lower case; a null text has none."""
    import numpy as np
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    flat = lists.flatten()
    full = pc.binary_length(flat).to_numpy() > 0
    if not full.all():
        flat, row = flat.filter(full), row[full]
    coded = flat.dictionary_encode()
    return row, coded.indices.to_numpy(), coded.dictionary
