"""Scalars in SQL, named providers and conditions, checks in the pass that writes, and the backup of a set of tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sextant.functions import names, scalar
from sextant.sources import checks, store


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_scalars_in_sql(spark):
    """The functions of SQL and the expressions of Python give the same, and plans hold no Python."""
    told = names.register(spark)
    df = spark.createDataFrame([(float(a), float(b), s) for a in (-90, -1, 0, 2, 64.9, 65, 80, 170) for b in (-4, 0, 3) for s in ("Br-k.b", "")] + [(None, 1.0, None), (float("nan"), 1.0, "x"), (float("inf"), 1.0, "x")], "a double, b double, s string")
    df.createOrReplaceTempView("seam_rows")
    sql = spark.sql("SELECT pct(a, b) p, signed_change(a, b) c, clamp(a) k, clamp(a, 1.0, 2.0) k2, finite(a) f, score_label(finite(a)) l, close_position(a, b, 1.0) q, out_of_range(a) o, symbol(s) s, days_until(DATE'2024-01-05', DATE'2024-01-01') d FROM seam_rows")
    a, b = F.col("a"), F.col("b")
    python = df.select(scalar.pct(a, b).alias("p"), scalar.signed_change(a, b).alias("c"), scalar.clamp(a).alias("k"), scalar.clamp(a, 1.0, 2.0).alias("k2"), scalar.finite(a).alias("f"), scalar.label(scalar.finite(a)).alias("l"), scalar.close_position(a, b, F.lit(1.0)).alias("q"), scalar.out_of_range(a).alias("o"), scalar.symbol(F.col("s")).alias("s"), F.lit(4).alias("d"))
    assert repr(rows(sql)) == repr(rows(python)) and len(told) == len(set(told)) == len(names.SCALARS)
    assert "Python" not in sql._jdf.queryExecution().executedPlan().toString()


def test_providers_and_conditions(spark):
    probes = spark.createDataFrame([(1, dt.date(2024, 1, 2), 5.0), (2, dt.date(2024, 1, 2), 7.0)], "entity long, d date, close double")
    own = names.Registry("provider")
    names.PROVIDERS, kept = own, names.PROVIDERS
    try:

        @own.add("doubled", ("close",))
        def doubled(p):
            late = p.limit(1).select("entity", F.date_add("d", 1).alias("d"), F.lit(9.0).alias("twice"))
            return p.filter("entity = 1").select("entity", "d", (F.col("close") * 2).alias("twice")).unionByName(late)

        assert rows(names.provided(probes, "doubled").select("entity", "twice")) == [(1, 10.0), (2, None)]  # an answer of another date finds no probe
        with pytest.raises(ValueError, match="already"):
            own.add("doubled")(doubled)
        with pytest.raises(ValueError, match="needs columns"):
            names.provided(probes.drop("close"), "doubled")
        with pytest.raises(KeyError, match="no provider other"):
            names.provided(probes, "other")
    finally:
        names.PROVIDERS = kept

    @names.CONDITIONS.add("dear", ("close",))
    def dear(df):
        return F.when(F.col("entity") < 3, F.col("close") > 6)

    assert rows(probes.select("entity", names.condition(probes, "dear"))) == [(1, False), (2, True)]
    del names.CONDITIONS.made["dear"]


def test_checks_in_the_pass_that_writes(spark, tmp_path):
    df = spark.range(10).withColumn("x", F.when(F.col("id") < 8, F.col("id").cast("double")))
    out, told = checks.observed(checks.ruled(df, {"x is small": F.col("x") < 8}), rows=F.count(F.lit(1)), odd=checks.counted(F.col("x") > 5))
    out.write.parquet(str(tmp_path / "a"))
    assert told.get == {"rows": 10, "odd": 2}
    with pytest.raises(Exception, match="broken rule: x is tiny"):
        checks.ruled(df, {"x is tiny": F.col("x") < 7}).write.parquet(str(tmp_path / "b"))
    assert [checks.verdict(*x) for x in ((90, 100), (89, 100), (100, 100, 1))] == ["ok", "thin", "odd"]
    line = checks.health_line("2024-01-02", {"verdict": "ok", "now": 9, "before": 10, "scored": 8, "rows": 9, "odd": 0})
    assert line.startswith("ok: 2024-01-02, 9 names (10 before)")


def test_backup_of_a_set(spark, tmp_path):
    """Changed tables are copied and verified, others point to the copy there is; no stamp is written twice; a copy that
    was altered, and a source that is gone, are told."""
    at = lambda n: f"file://{tmp_path}/{n}"
    spark.range(5).write.parquet(at("a"))
    spark.range(7).withColumn("x", F.lit("y")).write.parquet(at("b"))
    tables = {"a": at("a"), "b": at("b")}
    first = {r.name: r for r in store.backup(spark, tables, at("copies"), "2024-01-01").collect()}
    assert {n: (r.rows, r.verdict) for n, r in first.items()} == {"a": (5, "copied"), "b": (7, "copied")}
    spark.range(6).write.mode("overwrite").parquet(at("a"))
    second = {r.name: r for r in store.backup(spark, {**tables, "c": at("none")}, at("copies"), "2024-01-02").collect()}
    assert {n: r.verdict for n, r in second.items()} == {"a": "copied", "b": "unchanged", "c": "missing"} and second["b"].place == first["b"].place
    with pytest.raises(FileExistsError):
        store.backup(spark, tables, at("copies"), "2024-01-02")
    assert {r.name: r.verdict for r in store.verified(spark, at("copies"), "2024-01-02").collect()} == {"a": "match", "b": "match", "c": "missing"}
    spark.range(1).write.mode("append").parquet(second["a"].place)
    assert {r.name: r.verdict for r in store.verified(spark, at("copies"), "2024-01-02").collect()}["a"] == "mismatch"
    assert spark.read.parquet(first["a"].place).count() == 5  # an older stamp keeps its rows
