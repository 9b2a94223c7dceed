"""Features of trades that are filed again and again."""

from datetime import date, timedelta


def test_repeated_filings_count_once_and_are_ordered_once(spark):
    """Filings of one trade whose windows overlap, against brute force; no sort of what probes and trades have in common."""
    from sextant.operators import events

    day = lambda n: date(2020, 1, 1) + timedelta(n)
    filed = {1: [0, 0, 30, 95, 140, 400], 2: [10, 101, 102, 300], 3: [50]}
    trades = [(e, day(n), day(0), "P", 5.0 if e < 3 else None, 2.0, 10.0 * (i + 1), i, i % 2 == 0, f"{e}-{i}", "nonderiv") for e, at in filed.items() for i, n in enumerate(at)]
    trades += [(1, day(7), day(1), "S", 1.0, 1.0, 3.0, 9, False, "s", "nonderiv"), (1, None, day(0), "P", 5.0, 2.0, 99.0, 9, True, "null", "nonderiv")]
    columns = "entity long, filed_date date, trans_date date, trans_code string, shares double, price_per_share double, value_usd double, owner long, is_officer boolean, accession string, table_kind string"
    probes = [(e, day(n)) for e in (1, 2, 3, 4) for n in range(0, 520, 3)]
    found = events.trade_features(spark.createDataFrame(probes, "entity long, d date"), spark.createDataFrame(trades, columns))
    got = {(r.entity, r.d): (r.buy_count, r.officer_buy_count, r.buy_value, r.net_buy_value, r.days_since_buy) for r in found.collect()}
    assert len(got) == len(probes)
    for e, d in probes:
        first = {}
        for t in sorted((t for t in trades if t[0] == e and t[1] is not None and timedelta(0) <= d - t[1] <= timedelta(90)), key=lambda t: (t[1], t[9])):
            first.setdefault(t[2:6], t)
        buys, sold = [t for t in first.values() if t[3] == "P"], sum(t[6] for t in first.values() if t[3] == "S")
        value = sum(t[6] for t in buys)
        assert got[e, d] == (len(buys), sum(t[8] for t in buys), value, value - sold, min(((d - t[1]).days for t in buys), default=None)), (e, d)
    assert "row_number" not in found._jdf.queryExecution().optimizedPlan().toString()
