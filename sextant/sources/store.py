"""Tables of the engine on shared storage: snapshots by version and date, keyed upserts, verified copies."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.operators.quality import upsert


_OWN_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); a temporary one where it is unset in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="sextant-"))
        atexit.register(shutil.rmtree, _OWN_DIR[0], ignore_errors=True)
    return f"file://{_OWN_DIR[0]}"


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


def written(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """df written once and read again, for what several branches of a plan use: they then scan it, each its columns. The
    shuffle files that it took go with the write."""
    spark, path, schema = df.sparkSession, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}", df.schema
    with swept(spark):
        df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(schema).parquet(path)


def laid_out(df: DataFrame, name: str, key: str, *order: str, buckets: int | None = None) -> DataFrame:
    """df as a stored table dealt into buckets by `key` and sorted within them: what works by key then needs no exchange.

    Each bucket is one file, written by the task that has its rows, so windows of a key in the given order need no sort
    either (see `use_layout`). Two tables with the same key and number of buckets (by default the
    session's shuffle partitions) lie alike: joins of them by key stay where the rows are. The table is
    in the session's catalog under a name of its own; its files are in the shared folder."""
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    told = f"{name}_{uuid.uuid4().hex}"
    dealt = df.repartition(n, key).sortWithinPartitions(key, *order)
    dealt.write.bucketBy(n, key).sortBy(key, *order).option("path", f"{shared_dir(spark)}/{told}").saveAsTable(told)
    return spark.table(told)


def dealt(df: DataFrame, name: str, key: str) -> DataFrame:
    """df as a stored table in buckets by `key`, written where its rows are: what groups it by key then needs no exchange.

    Made for rows that an exchange by key has brought together already, which each hold whole buckets then, as there are
    as many as shuffle partitions; others only make more files. The table is in the session's catalog, its files are in
    the shared folder."""
    spark = df.sparkSession
    told = f"{name}_{uuid.uuid4().hex}"
    with swept(spark):
        df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).sortBy(key).option("path", f"{shared_dir(spark)}/{told}").saveAsTable(told)
    return spark.table(told)


#: Settings of a session that works on laid-out tables: a bucket that is one file counts as sorted, and tables that lie
#: alike by one of a join's keys are joined where they are.
LAID_OUT = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.requireAllClusterKeysForCoPartition": "false"}


def use_layout(spark: SparkSession) -> None:
    """Lets this session's plans use the order and the buckets of laid-out tables throughout."""
    for k, v in LAID_OUT.items():
        spark.conf.set(k, v)


def write_snapshots(df: DataFrame, path: str) -> None:
    """Replaces the (model_version, run_date) partitions that df holds and leaves all others alone."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model_version", "run_date").parquet(path)


def read_snapshots(spark: SparkSession, path: str, version: str | None = None, run_date=None) -> DataFrame:
    """Snapshots, pruned to a version and a date; files that lack newer columns give NULL for them."""
    df = spark.read.option("mergeSchema", "true").parquet(path)
    for column, value in (("model_version", version), ("run_date", run_date)):
        if value is not None:
            df = df.filter(F.col(column) == F.lit(value))
    return df


def there(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, in whichever store it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def existing(spark: SparkSession, path: str, version: str | None = None) -> DataFrame | None:
    """Snapshots of a path, or None where nothing has been stored yet."""
    from pyspark.errors import AnalysisException

    if not there(spark, path):
        return None
    try:
        return read_snapshots(spark, path, version)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def missing_dates(wanted: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Dates that a backfill still has to do."""
    return wanted.join(snapshots.select("run_date").distinct(), "run_date", "left_anti")


def upsert_table(new: DataFrame, path: str, staging: str, *keys: str) -> DataFrame:
    """Upserts into a table: the whole result is written to `staging`, to be swapped in by the caller.

    The old table stays readable until then, and a failed write leaves it as it was."""
    out = upsert(new.sparkSession.read.parquet(path), new, *keys)
    out.write.mode("overwrite").parquet(staging)
    return new.sparkSession.read.parquet(staging)


def fingerprint(df: DataFrame) -> tuple[int, int]:
    """Rows and an order-free digest of them: a sum of hashes, in which repeated rows count each time."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return row["n"], int(row["h"])


def verified_copy(spark: SparkSession, source: str, target: str) -> dict:
    """Copies a table and compares both before and after: `changed` if the source moved meanwhile, else match or not."""
    before = fingerprint(spark.read.parquet(source))
    spark.read.parquet(source).write.mode("overwrite").parquet(target)
    after, copy = fingerprint(spark.read.parquet(source)), fingerprint(spark.read.parquet(target))
    return {"rows": copy[0], "verdict": "inconclusive" if before != after else "match" if copy == before else "mismatch"}


BACKUP = "name string, source string, place string, rows long, digest string, verdict string"


def _readable(spark: SparkSession, path: str) -> DataFrame | None:
    """The table of a path, or None where there is none."""
    from pyspark.errors import AnalysisException

    if not there(spark, path):
        return None
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _stamps(spark: SparkSession, root: str) -> list[str]:
    """Stamps of all backups of a folder, oldest first."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(f"{root}/stamps")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName().removeprefix("stamp=") for s in fs.listStatus(at)) if fs.exists(at) else []


def backup(spark: SparkSession, tables: dict[str, str], root: str, stamp: str) -> DataFrame:
    """Backs up a set of tables under a stamp, and gives a row for each: its copy, rows, digest and how it went.

    A table that is as in the newest backup is not copied again (`unchanged`): its row names that copy. Others are copied
    to a folder of this stamp and compared: `copied`, `inconclusive` if the source moved meanwhile, else `mismatch`; a
    source that isn't there is `missing`. The rows are written last, so a stamp is there whole or not at all; a stamp
    that exists is refused. Tables are few: they are gone through one by one, each by Spark."""
    known = _stamps(spark, root)
    if stamp in known:
        raise FileExistsError(f"there is a backup {stamp} in {root}")
    last = {r["name"]: r for r in spark.read.schema(BACKUP).json(f"{root}/stamps/stamp={known[-1]}").collect()} if known else {}
    out, folder = [], f"{root}/tables/{stamp}-{uuid.uuid4().hex}"
    for name, source in tables.items():
        df = _readable(spark, source)
        if df is None:
            out.append((name, source, None, None, None, "missing"))
            continue
        rows, digest = fingerprint(df)
        if name in last and (last[name]["rows"], last[name]["digest"]) == (rows, str(digest)):
            out.append((name, source, last[name]["place"], rows, str(digest), "unchanged"))
            continue
        df.write.parquet(f"{folder}/{name}")
        after, copy = fingerprint(spark.read.parquet(source)), fingerprint(spark.read.parquet(f"{folder}/{name}"))
        out.append((name, source, f"{folder}/{name}", copy[0], str(copy[1]), "inconclusive" if after != (rows, digest) else "copied" if copy == after else "mismatch"))
    spark.createDataFrame(out, BACKUP).coalesce(1).write.mode("errorifexists").json(f"{root}/stamps/stamp={stamp}")
    return spark.read.schema(BACKUP).json(f"{root}/stamps/stamp={stamp}")


def verified(spark: SparkSession, root: str, stamp: str) -> DataFrame:
    """(name, rows, verdict) of a backup's copies as they are now, against what was noted: match, mismatch or missing."""
    out = []
    for r in spark.read.schema(BACKUP).json(f"{root}/stamps/stamp={stamp}").collect():
        df = _readable(spark, r["place"]) if r["place"] else None
        rows, digest = fingerprint(df) if df is not None else (None, None)
        out.append((r["name"], rows, "missing" if df is None else "match" if (rows, str(digest)) == (r["rows"], r["digest"]) else "mismatch"))
    return spark.createDataFrame(out, "name string, rows long, verdict string")


def coverage(df: DataFrame, at: str, entity: str, marker=None) -> DataFrame:
    """(first, last, rows, entities) of a source; a completed-ingest marker, where there is one, ends the coverage."""
    last = F.max(at) if marker is None else F.least(F.lit(marker), F.max(at))
    return df.agg(F.min(at).alias("first"), last.alias("last"), F.count(F.lit(1)).alias("rows"), F.count_distinct(entity).alias("entities"))


def export_csv(df: DataFrame, path: str, version: str, latest_only: bool = False) -> None:
    """Rows of a version, live ones if there are any, of the latest date only if asked, as CSV."""
    own = df.filter(F.col("model_version") == version)
    live = own.filter(F.coalesce("backfilled", F.lit(0)) == 0)
    own = live if live.limit(1).count() else own
    if latest_only:
        own = own.join(F.broadcast(own.agg(F.max("run_date").alias("run_date"))), "run_date", "left_semi")
    own.write.mode("overwrite").option("header", True).csv(path)
