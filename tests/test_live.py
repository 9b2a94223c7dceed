"""Keyed tables with commits, laid-out tables, and the live day that starts from kept state."""

import datetime as dt
import threading

import pytest
from pyspark.sql import functions as F

from sextant.functions.windows import by_entity
from sextant.operators import features
from sextant.plans import live, runs
from sextant.sources import store
from sextant.sources.bars import bars
from sextant.sources.tables import Conflict, Table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---- keyed tables

@pytest.fixture
def table(spark, tmp_path):
    return Table(spark, f"file://{tmp_path}/t", ("k",), "p")


def frame(spark, *found, schema="k int, p string, v int"):
    return spark.createDataFrame(list(found), schema)


def test_commits_replace_parts_and_readers_stay(spark, table):
    assert table.read() is None and table.versions() == [] and table.manifest() is None
    assert table.replace(frame(spark, (1, "a", 10), (2, "b", 20), (3, None, 30), (4, "x/y z", 40))) == 0
    before = table.read()
    assert table.replace(frame(spark, (1, "a", 11), (9, "a", 90)), note={"why": "test"}) == 1
    assert rows(before) == [(1, "a", 10), (2, "b", 20), (3, None, 30), (4, "x/y z", 40)]  # a reader's version doesn't move
    assert rows(table.read()) == [(1, "a", 11), (2, "b", 20), (3, None, 30), (4, "x/y z", 40), (9, "a", 90)]
    assert rows(table.read(0)) == rows(before) and table.manifest()["note"] == {"why": "test"}
    assert rows(table.read(parts=[None, "x/y z"])) == [(3, None, 30), (4, "x/y z", 40)]
    assert table.read(parts=["none such"]).count() == 0


def test_upserts_touch_their_parts_only(spark, table):
    table.replace(frame(spark, (1, "a", 10), (2, "a", None), (3, "b", 30)))
    kept = table.manifest()["parts"]["b"]
    table.upsert(frame(spark, (2, "a", 21), (2, "a", 22), (4, "a", 40)), order=F.desc("v"))
    assert rows(table.read()) == [(1, "a", 10), (2, "a", 22), (3, "b", 30), (4, "a", 40)] and table.manifest()["parts"]["b"] == kept
    table.upsert(frame(spark, (1, "a", None), (4, "a", 41)), keep="v")
    assert rows(table.read(parts=["a"])) == [(1, "a", 10), (2, "a", 22), (4, "a", 41)]
    table.upsert(frame(spark, (3, "b", 31)))
    table.upsert(frame(spark, (3, "b", 31)))  # once more changes nothing
    assert rows(table.read(parts=["b"])) == [(3, "b", 31)]


def test_columns_are_added(spark, table):
    """Stored files stay as they are; a wider schema gives NULL for them. Another type of a column is refused."""
    table.replace(frame(spark, (1, "a", 10)))
    table.upsert(frame(spark, (2, "b", 20, "new"), schema="k int, p string, v int, w string"))
    assert rows(table.read()) == [(1, "a", 10, None), (2, "b", 20, "new")]
    table.upsert(frame(spark, (1, "a"), schema="k int, p string"))
    assert rows(table.read(parts=["a"])) == [(1, "a", None, None)]
    with pytest.raises(ValueError, match="another type"):
        table.replace(frame(spark, (1, "a", "x"), schema="k int, p string, v string"))


def test_a_failed_write_leaves_the_table(spark, table):
    table.replace(frame(spark, (1, "a", 10)))
    bad = frame(spark, (1, "a", 11)).withColumn("v", F.raise_error(F.lit("broken off")).cast("int"))
    with pytest.raises(Exception, match="broken off"):
        table.replace(bad)
    assert table.versions() == [0] and rows(table.read()) == [(1, "a", 10)]


def test_two_writers(spark, table):
    """The second of two writers of a part is told; of different parts both stay; an upsert merges once more."""
    table.replace(frame(spark, (1, "a", 10), (2, "b", 20)))
    table.replace(frame(spark, (1, "a", 11)), base=0)
    with pytest.raises(Conflict):
        table.replace(frame(spark, (1, "a", 12)), base=0)
    table.replace(frame(spark, (2, "b", 21)), base=0)
    assert rows(table.read()) == [(1, "a", 11), (2, "b", 21)]
    told = []

    def add(k):
        try:
            table.upsert(frame(spark, (k, "c", k)), tries=8)
        except Exception as e:
            told.append(e)

    writers = [threading.Thread(target=add, args=(k,)) for k in range(3, 7)]
    for w in writers:
        w.start()
    for w in writers:
        w.join(180)
    assert told == [] and rows(table.read(parts=["c"])) == [(k, "c", k) for k in range(3, 7)]


def test_vacuum_keeps_what_versions_hold(spark, table):
    table.replace(frame(spark, (1, "a", 10), (2, "b", 20)))
    table.replace(frame(spark, (1, "a", 11)))
    table.replace(frame(spark, (1, "a", 12)))
    assert table.vacuum(keep=2) == 1 and table.versions() == [1, 2]
    assert rows(table.read(1)) == [(1, "a", 11), (2, "b", 20)] and rows(table.read()) == [(1, "a", 12), (2, "b", 20)]


# ---- laid-out tables

def test_features_of_stored_bars_move_nothing(spark, sf_dir):
    """All trailing features and the forward returns of bars stored by entity, and their join: no exchange; no sort either
    where the order of buckets is used."""
    b = store.laid_out(bars(spark, sf_dir), "bars", "entity", "d")
    own = features.setup(features.risk(features.volume(features.returns(features.trend(b)))))
    assert "Exchange" not in plan(own) and "Bucketed: true" in plan(own)
    assert "Exchange" not in plan(live.laid_out_features(spark, sf_dir))
    other = store.laid_out(bars(spark, sf_dir).select("entity", "d", F.col("close").alias("other")), "other", "entity", "d")
    ahead = other.select("entity", "d", F.lead("other", 20).over(by_entity()).alias("later")).hint("merge")
    assert plan(own.join(ahead, ["entity", "d"])).count("Exchange") > 0
    old = {k: spark.conf.get(k) for k in store.LAID_OUT}
    try:
        store.use_layout(spark)
        both = features.trend(b).join(ahead, ["entity", "d"])
        assert "Exchange" not in plan(both) and "Sort [" not in plan(both)
        assert rows(both.select("entity", "d", "close", "later")) == rows(bars(spark, sf_dir).select("entity", "d", "close", F.lead("close", 20).over(by_entity()).alias("later")))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


# ---- the live day

@pytest.fixture(scope="module")
def begun(spark, sf_dir, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('live')}/state"
    days = live.last_sessions(spark, sf_dir, 4)
    live.begin(spark, sf_dir, path, days[0])
    return path, days


def test_a_day_reads_its_own_lines(spark, sf_dir, begun):
    """One session's lines, by a condition that the files see; and a state of bounded size."""
    path, days = begun
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    for df in live.new_bars(spark, sf_dir, days[0], days[1]).values():
        assert "GreaterThanOrEqual(l_shipdate" in plan(df) and "LessThan(l_shipdate" in plan(df)
        assert {r.d for r in df.select("d").distinct().collect()} <= {days[1]}
    state = live.state_table(spark, path).read()
    sizes = state.groupBy("kind", "entity").count().groupBy("kind").agg(F.max("count").alias("n")).collect()
    assert {r.kind: r.n for r in sizes}.keys() == {*live.LEVELS, "figures"} and all(r.n <= live.LOOK_BACK.get(r.kind, 1) for r in sizes)
    assert live.new_figures(spark, sf_dir, dt.date(1995, 3, 1), dt.date(1995, 3, 8)).count() == 0
    filed = live.new_figures(spark, sf_dir, dt.date(1994, 12, 28), dt.date(1995, 1, 4))
    assert {r.filed_date for r in filed.select("filed_date").distinct().collect()} <= {dt.date(1995, 1, 1)} and "GreaterThanOrEqual(l_shipdate" in plan(filed)
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_a_day_done_again_and_one_broken_off(spark, sf_dir, begun):
    """A failure while storing leaves the state before the day; the same day twice gives the same rows; a missed session
    enters with the next day, whose scores are those of a run without a gap."""
    path, (_, first, second, _) = begun
    table = live.state_table(spark, path)

    def fail(_):
        raise RuntimeError("disk full")

    with pytest.raises(RuntimeError):
        live.live_day(spark, sf_dir, path, first, fail)
    assert table.manifest()["note"]["until"] < str(first)
    wanted = ["entity", "d", "score_20d", "score_120d", "score_label"]
    skipped = rows(live.live_day(spark, sf_dir, path, second).select(wanted))  # from the state before `first`
    assert table.manifest()["note"]["until"] == str(second)
    one = rows(live.live_day(spark, sf_dir, path, first).select(wanted))
    assert one == rows(live.live_day(spark, sf_dir, path, first).select(wanted)) and one
    assert rows(live.live_day(spark, sf_dir, path, second).select(wanted)) == skipped


def test_run_live_stores_the_newest_session(spark, sf_dir, tmp_path):
    path = str(tmp_path / "snap")
    for _ in range(2):
        got = runs.run_live(spark, sf_dir, path, "v9").select(F.to_date("run_date").alias("d"), "entity", "backfilled")
        assert {r.d for r in got.collect()} == {live.last_sessions(spark, sf_dir, 1)[0]} and got.filter("backfilled <> 0").count() == 0
        assert got.count() == got.select("entity").distinct().count()
