"""Every query of the engine against its SQL; the one without is run."""

import pytest

from sextant.plans import registry
from tests.compare import connection, difference


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, sf_dir, name):
    if name in registry.ORACLES:
        assert difference(spark, con, sf_dir, registry.QUERIES[name], registry.ORACLES[name]) == ""
    else:
        assert registry.QUERIES[name](spark, sf_dir).count() > 0  # its rows are checked by brute force in test_stored.py


#: Queries that group rows by few or by odd keys, whose faults a very small table doesn't show.
LARGER = ("owner_collapse", "concept_resolve", "filed_surprises", "trade_dedup_window", "newest_balances", "survivorship", "expanding_percentile", "bh_fdr")


@pytest.mark.parametrize("name", LARGER)
def test_query_on_larger_tables(spark, name):
    sf = "/root/testdata/sf0.01"
    assert difference(spark, connection(sf), sf, registry.QUERIES[name], registry.ORACLES[name]) == ""


def test_entry_and_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
