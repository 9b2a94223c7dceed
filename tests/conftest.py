"""One Spark session for all tests, and the test tables."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def con(sf_dir):
    from tests.compare import connection

    return connection(sf_dir)


@pytest.fixture(scope="session", autouse=True)
def one_run(spark):
    """Queries share one ranked panel, one graded table and one set of statements in the tests: each is made once by the
    function that makes it for every query otherwise, and is then read."""
    from sextant.plans import core, evaluation, filings
    from sextant.sources.store import written

    made, places = {}, [(core, "ranked"), (evaluation, "graded"), (filings, "known")]

    def shared(module, name):
        real = getattr(module, name)

        def found(spark, sf_dir, *more):
            if (name, sf_dir) not in made:
                made[name, sf_dir] = written(real(spark, sf_dir), name)
            return made[name, sf_dir]

        setattr(module, name, found)
        return real

    real = [shared(m, n) for m, n in places]
    yield
    for (m, n), f in zip(places, real, strict=True):
        setattr(m, n, f)
