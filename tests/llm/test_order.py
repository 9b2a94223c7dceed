"""The order of n-grams that prefixes are taken by."""

import numpy as np
import pyarrow as pa
import pytest

from sextant.llm import similarity


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80)])
def test_thinly_spread_grams_come_last(spark, words, percent):
    """N-grams of sixty documents, no task having more than two of these, are in no prefix that has others to take."""
    common = " ".join(f"common{i}" for i in range(40))
    rows = [(i, common + " " + " ".join(f"w{i}x{j}" for j in range(160))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(30, "doc_id")
    rules = similarity.JaccardRules(words=words, percent=percent)
    found = similarity.incidence(docs, rules).collect()
    shared = set(similarity.shingle_sets(pa.array([common]), words)[0].view(np.int64).tolist())
    assert len(found) == 60 and len(shared) == 41 - words
    assert all(len(r.prefix) == similarity.prefix_length(r.n, percent) and not shared & set(r.prefix) for r in found)
    assert {(r.doc_id, r.component_id) for r in similarity.linked(docs, rules).collect()} == {(i, i) for i in range(60)}
