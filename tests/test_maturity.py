"""Rows that mature by groups of entities, against brute force."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest

from sextant.streaming import maturity
from tests.test_streams import expected, streamed


class State:
    """What a stream keeps of one group."""

    def __init__(self):
        self.get, self.exists, self.watermark, self.due = None, False, 0, None

    def getCurrentWatermarkMs(self):  # noqa: N802
        return self.watermark

    def update(self, told):
        self.get, self.exists = told, True

    def setTimeoutTimestamp(self, at):  # noqa: N802
        assert at > self.watermark
        self.due = at


def frame(found):
    at = pd.DataFrame(found, columns=["entity", "d", "close", "score"])
    return pd.DataFrame({"nobody": at.entity.isna(), "entity": at.entity.fillna(0).astype("int64"), "day": [(d - dt.date(1970, 1, 1)).days for d in at.d], "close": at.close.astype(float), "score": at.score.astype(float)})


def test_a_call_moves_all_entities_of_a_group_on():
    """In one call, though its entities are many; days out of order and repeated, missing closes, zeros and entities."""
    rng, day = random.Random(4), dt.date(2024, 1, 1)
    found = [(None if e == 5 else e, day + dt.timedelta(k), rng.choice([None, 0.0, 1.0, 2.0, 3.5]), rng.choice([None, 1.0, 2.0])) for k in range(40) for e in range(30) if rng.random() < 0.8]
    found += [(e, d, 9.0, 9.0) for e, d, *_ in found[::9]]
    run, state, out = maturity._advance((1, 4, 7)), State(), []
    for start in range(0, 40, 10):
        some = [r for r in found if start <= (r[1] - day).days < start + 10]
        first = {(r[0], r[1]): r for r in reversed(some)}
        rng.shuffle(some)
        some.sort(key=lambda r: r is not first[r[0], r[1]])
        for batches, upto in (((frame(some[:50]), frame(some[50:])), state.watermark), ((), (day - dt.date(1970, 1, 1) + dt.timedelta(start + 9)).days * 86_400_000)):
            state.watermark = upto
            out += list(run((0,), iter(batches), state))
    got = pd.concat([x for x in out if len(x)])
    told = [(None if pd.isna(e) else int(e), d.date(), int(h), None if np.isnan(s) else s, r, m.date()) for e, d, h, s, r, m in got.itertuples(index=False)]
    assert sorted(told, key=repr) == expected(found, (1, 4, 7)) and len(told) > 1000
    assert len(maturity._restored(state.get[0])["day"]) == 0 and len(maturity._restored(state.get[1])["day"]) <= 30 * 7


@pytest.mark.parametrize("shards", [1, 1024])
def test_entities_share_a_group(spark, tmp_path, monkeypatch, shards):
    """However many groups there are, the rows are those of each entity by itself; some have no entity."""
    monkeypatch.setattr(maturity, "SHARDS", shards)
    day = dt.date(2024, 1, 1)
    found = [(None if e == 4 else e, day + dt.timedelta(k), 10.0 + (e * 7 + k * 3) % 11, float(k)) for k in range(12) for e in range(1, 6) if (e + k) % 4]
    files = [[r for r in found if (r[1] - day).days // 4 == n] for n in range(3)]
    assert streamed(spark, tmp_path, files, (1, 4), "0 days") == expected(found, (1, 4))


def test_a_state_is_small_however_many_entities_share_it():
    """A row of the state takes less than its numbers, and a group is one call for any number of entities."""
    n = 60_000
    kept = {"nobody": np.zeros(n, bool), "entity": np.repeat(np.arange(500), 120), "day": np.tile(np.arange(120, dtype=np.int32), 500), "close": np.round(np.linspace(1, 9, n), 2), "score": np.zeros(n)}
    told = maturity._stored(kept)
    assert len(told) < 29 * n / 2 and all((maturity._restored(told)[c] == x).all() for c, x in kept.items())
