"""What the near duplicates put on disk."""

import re
import time

from sextant.llm import similarity
from sextant.llm.common import kept


def _exchanged(df):
    """The columns of each exchange of a plan."""
    told = df.sparkSession._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return [set(re.findall(r"(\w+)#", x)) for x in re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]", told)]


def test_texts_stay_and_grams_are_dealt_once(spark, monkeypatch):
    """No text goes through a shuffle, an n-gram goes once, and a prefix only where rows share a set."""
    plans = {}
    monkeypatch.setattr(similarity, "kept", lambda df, name: (plans.setdefault(name, _exchanged(df)), kept(df, name))[1])
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base), " ".join(base), " ".join([*base, "end"]), "", None, " ".join(f"v{i}" for i in range(60)), "a b"]
    rows = [(i + 1, t) for i, t in enumerate(texts)] + [(3, " ".join([*base, "end"])), (None, " ".join(base)), (9, "A  b")]
    found = similarity.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in found) == [(0, 58, 0), (1, 58, 1), (2, 58, 1), (3, 59, 1), (3, 59, 1), (4, 0, 4), (5, 0, 5), (6, 58, 6), (7, 1, 7), (9, 1, 7)]
    assert not any("text" in x for p in plans.values() for x in p)
    assert sum("key" in x for x in plans["jaccard-lists"]) == 1


def test_shuffle_files_go_when_a_table_is_kept(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        names = disk.getAllFiles()
        return {names.apply(i).getName() for i in range(names.size())}

    before = files()
    found = kept(spark.range(100_000).repartition(3, "id"), "kept")
    for _ in range(50):
        left = {f for f in files() - before if f.startswith("shuffle_")}
        if not left:
            break
        time.sleep(0.2)
    assert not left and found.count() == 100_000
