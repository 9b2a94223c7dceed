"""Scores that wait for their outcome: a stateful stream that holds a row until its horizon has passed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MATURED = "entity long, d date, horizon int, score double, future_return double, matured_on date"

#: Groups of entities that share one state: a call works on all rows of a group at once, not on one entity's.
SHARDS = 1024
#: A row of the state; a missing close or score is not a number, a missing entity is told by `nobody`.
_ROW = {"nobody": np.bool_, "entity": np.int64, "day": np.int32, "close": np.float64, "score": np.float64}
_DAY_MS = 86_400_000


def _stored(rows: dict[str, np.ndarray]) -> bytes:
    """Rows as bytes, one column after the other, compressed; their number first."""
    import pyarrow as pa

    return len(rows["day"]).to_bytes(8, "little") + pa.compress(b"".join(np.ascontiguousarray(rows[c]).tobytes() for c in _ROW), codec="zstd", asbytes=True)


def _restored(told: bytes) -> dict[str, np.ndarray]:
    import pyarrow as pa

    n, at, out = int.from_bytes(told[:8], "little"), 0, {}
    flat = pa.decompress(told[8:], decompressed_size=n * sum(np.dtype(t).itemsize for t in _ROW.values()), codec="zstd", asbytes=True) if n else b""
    for c, t in _ROW.items():
        out[c] = np.frombuffer(flat, t, n, at)
        at += n * np.dtype(t).itemsize
    return out


def _joined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {c: np.concatenate([np.zeros(0, t), *[p[c] for p in parts]]) for c, t in _ROW.items()}


def _taken(rows: dict[str, np.ndarray], which) -> dict[str, np.ndarray]:
    return {c: x[which] for c, x in rows.items()}


def _moved_on(past: dict[str, np.ndarray], ready: dict[str, np.ndarray], horizons: tuple[int, ...]):
    """What matures when `ready` rows follow an entity's `past` ones in the order of time, as (places of the scores, places
    of the closes, horizon) in all rows, these rows, and the last of each entity. A row of a day is taken once."""
    rows, new = _joined([past, ready]), np.repeat([False, True], [len(past["day"]), len(ready["day"])])
    order = np.lexsort((rows["day"], new, rows["entity"], rows["nobody"]))
    rows, new = _taken(rows, order), new[order]
    same = lambda c, k: rows[c][k:] == rows[c][:-k]
    again = np.zeros(len(new), bool)
    again[1:] = same("entity", 1) & same("nobody", 1) & same("day", 1) & new[1:]
    rows, new = _taken(rows, ~again), new[~again]
    found = []
    for h in horizons:
        if h < len(new):
            at = np.flatnonzero(same("entity", h) & same("nobody", h) & new[h:])
            then, now = rows["close"][at], rows["close"][at + h]
            at = at[~(np.isnan(then) | (then == 0) | np.isnan(now))]
            found.append((at, at + h, h))
    ends = np.ones(len(new), bool)
    ends[:-1] = ~(same("entity", 1) & same("nobody", 1))
    last = np.flatnonzero(ends)
    left = np.repeat(last, np.diff(last, prepend=-1)) - np.arange(len(new)) if len(new) else np.zeros(0, int)
    return found, rows, _taken(rows, left < max(horizons))


def _advance(horizons: tuple[int, ...]):
    """Takes up a group's new rows, and moves on to the watermark in the order of time.

    The state is what is still ahead of the watermark, and each entity's last rows behind it, as many as the longest
    horizon."""
    import pandas as pd

    def run(key, batches, state):
        waiting, past = (_restored(x) for x in state.get) if state.exists else (_joined([]), _joined([]))
        waiting = _joined([waiting, *[{c: rows[c].astype(t).to_numpy() for c, t in _ROW.items()} for rows in batches if len(rows)]])
        reached = max(state.getCurrentWatermarkMs(), 0) // _DAY_MS
        ready = waiting["day"] <= reached
        found, rows, past = _moved_on(past, _taken(waiting, ready), horizons)
        waiting = _taken(waiting, ~ready)
        state.update((_stored(waiting), _stored(past)))
        if len(waiting["day"]):
            due = int(waiting["day"].min()) * _DAY_MS - 1  # goes off once the watermark is beyond it
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        for then, now, h in found:
            days = {c: rows["day"][at].astype("datetime64[D]").astype("datetime64[ns]") for c, at in (("d", then), ("matured_on", now))}
            entity = pd.Series(rows["entity"][then]).astype("Int64").mask(rows["nobody"][then])
            yield pd.DataFrame({"entity": entity, "d": days["d"], "horizon": np.full(len(then), h, np.int32), "score": rows["score"][then], "future_return": rows["close"][now] / rows["close"][then] - 1, "matured_on": days["matured_on"]})

    return run


def matured(stream: DataFrame, horizons: tuple[int, ...] = (5, 20, 60, 120), late: str = "0 days") -> DataFrame:
    """(entity, d, horizon, score, future_return, matured_on) of a stream of (entity, d, close, score).

    A row's return is known with the entity's own h-th row after it, as in `forward.lead_return`; it goes out once, when
    the watermark has reached that row. Rows may arrive in any order that stays within `late`, and in any split into
    micro-batches: rows behind the watermark are worked off in the order of time. Of rows of one entity and day the first
    counts. State: an entity's last max(horizons) rows, and those that are ahead of the watermark; entities are dealt into
    SHARDS groups by hash, whose rows are worked on as columns."""
    told = (F.col("entity").isNull().alias("nobody"), F.coalesce(F.col("entity").cast("long"), F.lit(0)).alias("entity"), F.unix_date("d").alias("day"), F.col("close").cast("double").alias("close"), F.col("score").cast("double").alias("score"))
    timed = stream.select(*told, F.col("d").cast("timestamp").alias("ts"), F.pmod(F.xxhash64("entity"), F.lit(SHARDS)).alias("shard")).withWatermark("ts", late)
    return timed.groupBy("shard").applyInPandasWithState(_advance(horizons), MATURED, "waiting binary, past binary", "append", "EventTimeTimeout")
