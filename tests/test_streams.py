"""Streams that end in the rows of a batch: outcomes held as state, late and repeated files, and runs that go on."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sextant.plans import live, runs
from sextant.sources.bars import bars
from sextant.streaming import ingest, maturity


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def day(i):
    return dt.date(2024, 1, 1) + dt.timedelta(i)


SCORED = "entity long, d date, close double, score double"


def streamed(spark, tmp_path, files, horizons, late):
    """The stream's rows after one micro-batch a file."""
    for n, f in enumerate(files):
        spark.createDataFrame(f, SCORED).coalesce(1).write.parquet(f"{tmp_path}/in/{n:03d}")
    source = spark.readStream.schema(SCORED).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    out = f"{tmp_path}/out"
    q = maturity.matured(source, horizons, late).writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}")).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    return rows(spark.read.parquet(out).drop("batch"))


def expected(found, horizons):
    by = {}
    for e, d, c, s in found:
        by.setdefault(e, {}).setdefault(d, (c, s))
    out = []
    for e, at in by.items():
        days = sorted(at)
        for i, d in enumerate(days):
            for h in horizons:
                if i + h < len(days) and at[d][0] and at[days[i + h]][0] is not None:
                    out.append((e, d, h, at[d][1], at[days[i + h]][0] / at[d][0] - 1, days[i + h]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("cut", [1, 3, 7])
def test_outcomes_mature_at_any_split(spark, tmp_path, cut):
    """Gaps in an entity's own days, missing closes and scores, days out of order within the bound."""
    found = [(e, day(i), None if (e, i) == (2, 9) else 10.0 + (e * 7 + i * 3) % 11, None if i % 5 == 0 else float(i)) for i in range(21) for e in (1, 2, 3) if (e + i) % 4 or e == 1]
    size = -(-len(found) // cut)
    files = [found[i : i + size] for i in range(0, len(found), size)]
    if cut == 7:
        files = [files[1], files[0], *files[2:]]  # a week late at the most
    assert streamed(spark, tmp_path, files, (1, 4), "7 days" if cut == 7 else "0 days") == [x for x in expected(found, (1, 4)) if cut != 7 or x[5] <= day(20 - 7)]


def bar_files(spark, sf_dir):
    return bars(spark, sf_dir).filter("entity <= 6")


def test_late_and_repeated_files_end_in_the_batch_table(spark, sf_dir, tmp_path):
    """Rows of a closed day wait aside, readers see what is complete, and a repair fills holes only."""
    own = bar_files(spark, sf_dir).cache()
    days = sorted(r.d for r in own.select("d").distinct().collect())
    a, b = days[len(days) // 3], days[2 * len(days) // 3]
    lost = own.filter((F.col("d") < F.lit(a)) & (F.col("entity") == 3))
    wrong = own.filter((F.col("d") < F.lit(a)) & (F.col("entity") == 2)).withColumn("close", F.lit(-1.0))
    first = own.filter(F.col("d") < F.lit(a)).join(lost.select("entity", "d"), ["entity", "d"], "left_anti").select(own.columns)
    second, third = own.filter((F.col("d") >= F.lit(a)) & (F.col("d") < F.lit(b))), own.filter(F.col("d") >= F.lit(b))
    path = f"file://{tmp_path}/t"
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(own.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")

    def arrive(n, df):
        df.coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        q = ingest.ingest(source, path)
        assert q.awaitTermination(300)

    arrive(0, first)
    assert ingest.covered_until(spark, path) == max(d for d in days if d < a) - dt.timedelta(7)
    arrive(1, second)
    arrive(2, second)  # the same rows again
    arrive(3, lost.unionByName(wrong))  # days that are closed
    again = second.filter(F.col("d") <= F.lit(max(d for d in days if d < b) - dt.timedelta(7))).count()
    assert ingest.aside_of(spark, path).read().count() == lost.count() + wrong.count() + again
    seen = ingest.covered(spark, path)
    assert seen.agg(F.max("d")).first()[0] <= ingest.covered_until(spark, path) and seen.filter("close = -1").count() == 0
    arrive(4, third)
    assert ingest.repair(spark, path) == lost.count() and ingest.repair(spark, path) == 0
    assert rows(ingest.store_of(spark, path).read().select(own.columns)) == rows(own)
    before = ingest.store_of(spark, path).versions()
    ingest.take(spark, path, third.withColumn("close", F.lit(0.0)), 2, 7)  # a batch that was taken before
    assert ingest.store_of(spark, path).versions() == before


def test_a_backfill_goes_on_where_it_stopped(spark, sf_dir, tmp_path, monkeypatch):
    """Killed between groups it repeats none; a failed group is noted; another run's claims are left alone until stale."""
    path, days = str(tmp_path / "snap"), live.last_sessions(spark, sf_dir, 6)
    written, real = [], runs.store.write_snapshots

    def write(df, to):
        dates = sorted({r.run_date for r in df.select("run_date").distinct().collect()})
        if len(written) == 1:
            written.append("broken")
            raise KeyboardInterrupt
        written.append(dates)
        real(df, to)

    monkeypatch.setattr(runs.store, "write_snapshots", write)
    with pytest.raises(KeyboardInterrupt):
        runs.run_backfill(spark, sf_dir, path, "v1", days[0], days[-1], group=2)
    book = runs.ledger(spark, f"{path}-ledger")
    state = lambda: {r.d: r.state for r in book.read().collect()}
    assert state() == {**dict.fromkeys(days[:2], "done"), **dict.fromkeys(days[2:4], "claimed")}
    other = spark.createDataFrame([(d,) for d in days], "d date")
    assert runs.claim(other, book, "v1", "other", 9, dt.timedelta(hours=1)) == days[4:]  # what is held is left alone
    got = runs.run_backfill(spark, sf_dir, path, "v1", days[0], days[-1], group=2, stale=dt.timedelta(0))
    assert set(state().values()) == {"done"} and got.select("run_date").distinct().count() == 6
    done = [d for w in written if w != "broken" for d in w]
    assert sorted(done) == sorted(map(str, days)) and len(done) == len(set(done))
    counts = {str(r.d): r.rows for r in book.read().collect()}
    assert counts == {str(r.run_date): r["count"] for r in got.groupBy("run_date").count().collect()}

    def fail(df, to):
        raise ValueError("no space left")

    monkeypatch.setattr(runs.store, "write_snapshots", fail)
    with pytest.raises(ValueError):
        runs.run_backfill(spark, sf_dir, path, "v2", days[-1], days[-1])
    assert [(r.state, r.why) for r in book.read(parts=["v2"]).collect()] == [("failed", "no space left")]
    monkeypatch.setattr(runs.store, "write_snapshots", real)
    assert runs.run_backfill(spark, sf_dir, path, "v2", days[-1], days[-1]).count() > 0 and {r.state for r in book.read(parts=["v2"]).collect()} == {"done"}
