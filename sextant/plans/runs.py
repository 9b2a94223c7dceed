"""The runs of the engine as thin functions over relations: a live day, a backfill, recovery, evaluation, journal, status.

A run scores all wanted dates in one plan and writes whole (version, date) partitions, so it can be done again at any
time: what it has written is replaced, and everything else stays."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant import config as C
from sextant.operators import quality, ranking, reports, scoring, upkeep
from sextant.plans import core, evaluation, live
from sextant.sources import checks, reads, store
from sextant.sources.bars import bars
from sextant.sources.tables import Conflict, Table

KEPT = ("entity", "d", *C.SCORE_WEIGHTS, "score_label", "sector_rank_fallback")


def snapshot(scored: DataFrame, version: str, live: bool, recovered: bool = False) -> DataFrame:
    """Scored rows as rows of a snapshot (model_version, run_date, ...), with how they came about."""
    flags = {"backfilled": F.lit(0 if live else 1), "recovered": F.lit(int(recovered)), "model_version": F.lit(version), "run_date": F.col("d").cast("string")}
    return scored.select(*KEPT).withColumns(flags).drop("d")


def score_dates(spark: SparkSession, sf_dir: str, dates: DataFrame, version: str, live: bool, recovered: bool = False, panel: DataFrame | None = None) -> DataFrame:
    """Snapshot rows of the wanted dates (d): only these are ranked. A panel that is there already serves many calls."""
    found = core.full_panel(spark, sf_dir) if panel is None else panel
    df = scoring.components(core.ranked_panel(found.join(F.broadcast(dates.select("d").distinct()), "d", "left_semi")))
    return snapshot(scoring.scores(df.withColumn("days_until_earnings", F.lit(None).cast("int")), version, live), version, live, recovered)


LEDGER = "model_version string, d date, state string, owner string, at timestamp, rows long, why string"


def ledger(spark: SparkSession, path: str) -> Table:
    """What runs have done: a row for each version and date with its state (claimed, done or failed)."""
    return Table(spark, path, ("model_version", "d"), "model_version")


def _entries(spark: SparkSession, version: str, state: str, owner: str, counts: dict, why: str | None = None) -> DataFrame:
    """Ledger rows of some dates and their numbers of rows, stamped now."""
    rows = [(version, d, state, owner, datetime.now(UTC).replace(tzinfo=None), n, why) for d, n in counts.items()]
    return spark.createDataFrame(rows, LEDGER.replace("at timestamp", "at timestamp_ntz")).withColumn("at", F.col("at").cast("timestamp"))


def open_dates(wanted: DataFrame, book: Table, version: str, owner: str, stale: timedelta) -> DataFrame:
    """Wanted dates (d) that are not done and that no other run holds; a claim older than `stale` has been given up."""
    entries = book.read(parts=[version])
    if entries is None:
        return wanted
    since = F.lit(datetime.now(UTC).replace(tzinfo=None) - stale).cast("timestamp")
    held = entries.filter((F.col("state") == "done") | ((F.col("state") == "claimed") & (F.col("owner") != owner) & (F.col("at") >= since)))
    return wanted.join(held.select("d"), "d", "left_anti")


def claim(wanted: DataFrame, book: Table, version: str, owner: str, n: int, stale: timedelta) -> list:
    """Takes the first n open dates for this run, and gives them. Of two runs that want the same dates the second's commit
    is refused, and it looks again."""
    while True:
        known = book.versions()
        dates = sorted(r.d for r in open_dates(wanted, book, version, owner, stale).orderBy("d").limit(n).collect())
        if not dates:
            return []
        old, new = book.read(parts=[version]), _entries(wanted.sparkSession, version, "claimed", owner, dict.fromkeys(dates))
        try:
            book.replace(new if old is None else quality.upsert(old, new, "model_version", "d"), known[-1] if known else -1)
            return dates
        except Conflict:
            continue


def run_live(spark: SparkSession, sf_dir: str, path: str, version: str, state: str | None = None) -> DataFrame:
    """Scores and stores the newest session from the state that earlier days have left (beside the snapshots if no other
    place is given). The first day makes that state from the history before it."""
    before, d = live.last_sessions(spark, sf_dir, 2)
    state = state or f"{path}-state"
    kept = live.state_table(spark, state)
    if not any(kept.manifest(v)["note"]["until"] < str(d) for v in kept.versions()):
        live.begin(spark, sf_dir, state, before)
    live.live_day(spark, sf_dir, state, d, lambda rows: store.write_snapshots(snapshot(rows, version, True), path), version, True)
    told = kept.manifest()["note"]["figures"]
    ledger(spark, f"{path}-ledger").upsert(_entries(spark, version, "done", uuid.uuid4().hex, {d: told["rows"]}, checks.health_line(d, told)))
    return store.read_snapshots(spark, path, version)


def run_backfill(spark: SparkSession, sf_dir: str, path: str, version: str, first=None, last=None, group: int = 250, book: str | None = None, stale: timedelta = timedelta(hours=6)) -> DataFrame:
    """Scores and stores the sessions of a range that the version does not have yet, `group` sessions at a time.

    The panel is made once; a group of sessions is claimed in the ledger (beside the snapshots if no other place is given),
    scored in one plan, stored and marked as done. A run that was broken off goes on with what is not done; runs beside
    each other share the sessions. Sessions stored by other means count as done."""
    wanted = reads.scan(bars(spark, sf_dir, "all").select("d"), since={"d": first}, until={"d": last})
    have = store.existing(spark, path, version)
    if have is not None:
        wanted = store.missing_dates(wanted.withColumn("run_date", F.col("d").cast("string")), have.select(F.col("run_date").cast("string").alias("run_date"))).select("d")
    wanted = store.written(wanted, "wanted")
    owner, entries, panel = uuid.uuid4().hex, ledger(spark, book or f"{path}-ledger"), None
    while dates := claim(wanted, entries, version, owner, group, stale):
        panel = store.written(core.full_panel(spark, sf_dir), "backfill") if panel is None else panel
        few = spark.createDataFrame([(d,) for d in dates], "d date")
        try:
            rows = store.written(score_dates(spark, sf_dir, few, version, False, panel=panel), "scored")
            store.write_snapshots(rows, path)
        except Exception as e:
            entries.upsert(_entries(spark, version, "failed", owner, dict.fromkeys(dates), str(e)[:500]))
            raise
        counts = dict.fromkeys(dates, 0) | {r.d: r["count"] for r in rows.groupBy(F.to_date("run_date").alias("d")).count().collect()}
        entries.upsert(_entries(spark, version, "done", owner, counts))
    return store.read_snapshots(spark, path, version)


def recover_missing(spark: SparkSession, sf_dir: str, path: str, version: str) -> DataFrame:
    """Scores sessions between the version's first and last live date that have no row; they are marked as recovered."""
    live = store.read_snapshots(spark, path, version).filter("backfilled = 0").select(F.to_date("run_date").alias("d")).distinct()
    span = live.agg(F.min("d").alias("a"), F.max("d").alias("b"))
    holes = bars(spark, sf_dir, "all").select("d").join(F.broadcast(span), F.col("d").between(F.col("a"), F.col("b"))).join(live, "d", "left_anti").select("d")
    store.write_snapshots(score_dates(spark, sf_dir, holes, version, True, True), path)
    return store.read_snapshots(spark, path, version)


def run_evaluation(spark: SparkSession, sf_dir: str, path: str, version: str) -> dict[str, DataFrame]:
    """Reports over a version's stored scores, and their rows with what followed: buckets, deciles, spread, cohorts and
    their sums."""
    snap = store.read_snapshots(spark, path, version).withColumn("d", F.to_date("run_date")).select("entity", "d", *C.SCORE_WEIGHTS, F.col("recovered").alias("_late"))
    df = store.written(evaluation.outcomes(spark, sf_dir).join(snap, ["entity", "d"]).withColumn("stale", F.col("_late") == 1), "outcomes")
    long = store.written(reports.long_form(df, evaluation.HORIZONS), "graded")
    days = reports.cross_sections(long, C.DECILE_MIN_NAMES)
    cohorts = reports.cohorts(long)
    return {"graded": df, "buckets": reports.buckets(long), "deciles": reports.decile_report(days), "spread": reports.decile_spread(days), "cohorts": cohorts, "scoreboard": reports.scoreboard(cohorts)}


def refresh_frozen(versions: DataFrame, evaluated: DataFrame, n: int) -> DataFrame:
    """The n versions whose evaluation is the oldest, never evaluated ones first; ties by name."""
    return versions.join(evaluated, "model_version", "left").orderBy(F.col("evaluated_at").asc_nulls_first(), "model_version").limit(n).select("model_version")


def exhausted(snapshots: DataFrame, sessions: DataFrame, horizon: int = 120) -> DataFrame:
    """(model_version, done): whether every outcome of a version's rows is known by now."""
    known = sessions.orderBy(F.desc("d")).limit(horizon + 1).agg(F.min("d").alias("known"))
    last = snapshots.groupBy("model_version").agg(F.to_date(F.max("run_date")).alias("last"))
    return last.join(F.broadcast(known), F.lit(True)).select("model_version", (F.col("last") <= F.col("known")).alias("done"))


def journal(spark: SparkSession, path: str, version: str, score: str = "score_20d", n: int = 10) -> str:
    """A day's entry in Markdown: the best names of the newest stored date and the largest moves since the one before."""
    snap = store.read_snapshots(spark, path, version).withColumn("d", F.to_date("run_date"))
    days = snap.select("d").distinct().orderBy(F.desc("d")).limit(2)
    two = store.written(snap.join(F.broadcast(days), "d").select("d", "entity", F.round(score, 1).alias("score"), "score_label"), "journal")
    newest = two.join(F.broadcast(two.agg(F.max("d").alias("d"))), "d")
    before = two.join(newest.select("d").distinct(), "d", "left_anti").select("entity", F.col("score").alias("_before"))
    moved = newest.join(before, "entity").select("entity", (F.round(F.col("score") - F.col("_before"), 1) + F.lit(0.0)).alias("moved")).filter("moved IS NOT NULL")
    top = ranking.top_exact(newest, "score", n).orderBy("place")
    return "\n\n".join([f"## {version}", upkeep.markdown(top, ["place", "entity", "score", "score_label"], n), upkeep.markdown(ranking.movers(moved, "moved", 5).orderBy("side", "place"), ["side", "place", "entity", "moved"])])


def status(spark: SparkSession, sf_dir: str, path: str) -> dict[str, DataFrame]:
    """What is stored: dates of each version, thin days, and sessions missing inside the entities' own spans."""
    b = store.written(bars(spark, sf_dir), "bars")
    gaps = quality.interior_gaps(b, bars(spark, sf_dir, "all").select("d"))
    return {"versions": reads.version_dates(store.read_snapshots(spark, path)), "thin": quality.thin_sessions(b), "gaps": gaps.groupBy("entity").agg(F.count(F.lit(1)).alias("n"))}


def log_book(spark: SparkSession, path: str) -> Table:
    """The daily log: one text for each version and date, in parts by month."""
    return Table(spark, path, ("model_version", "d"), "month")


def journal_day(spark: SparkSession, sf_dir: str, path: str, version: str, score: str = "score_20d", book: str | None = None) -> str:
    """A day's entry in four sections, put into the log (beside the snapshots if no other place is given) under the newest
    stored date; done again, it replaces that day's entry.

    1. the best names and the largest moves; 2. the newest cohorts whose outcome is known; 3. the sums of all cohorts;
    4. whether components carry the signal that they should, over the stored rows."""
    found = run_evaluation(spark, sf_dir, path, version)
    horizon = int(score.removeprefix("score_").removesuffix("d"))
    matured = found["cohorts"].filter(F.col("horizon") == horizon).orderBy(F.desc("d"))
    ics = reports.pooled_ic(found["graded"], C.SCORE_WEIGHTS, (horizon,))
    sections = [
        journal(spark, path, version, score), "### Matured", upkeep.markdown(matured, ["d", "n_strong", "strong_hits", "n_weak", "weak_hits", "n_top", "top_hits"], 5),
        "### Scoreboard", upkeep.markdown(found["scoreboard"].orderBy("horizon"), ["horizon", "n_cohorts", "strong_hit_pct", "weak_hit_pct", "top_hit_pct"]),
        "### Scores against outcomes", upkeep.markdown(reports.ic_ranking(ics, horizon).withColumn("spearman_ic", F.round("spearman_ic", 3)).orderBy("place"), ["place", "series", "spearman_ic"]),
    ]
    text, d = "\n\n".join(sections), store.read_snapshots(spark, path, version).agg(F.max(F.to_date("run_date"))).first()[0]
    row = spark.createDataFrame([(version, d, f"{d:%Y-%m}", text)], "model_version string, d date, month string, text string")
    log_book(spark, book or f"{path}-log").upsert(row)
    return text


def daily_log(spark: SparkSession, book: str, most: int = 250) -> str:
    """The log as one Markdown text, the newest entries first, at most `most` of them."""
    entries = log_book(spark, book).read()
    shown = [] if entries is None else entries.orderBy(F.desc("d"), "model_version").limit(most).collect()
    return "\n\n---\n\n".join(f"# {r.d}\n\n{r.text}" for r in shown)
