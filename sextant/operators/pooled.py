"""Pooled ICs: correlations over all dates together, of many components with many outcomes, without a row a pair.

1. The rows' columns are packed into blocks, which stay where they are: each column's values in ascending order, and the
   rows that they lie in.
2. A column's range is cut by some of its own values, taken from at most 200 blocks; where the cuts are decides how the
   work is dealt and never a rank. A value that is a cut is a bin by itself, what lies between two cuts another one.
   Rows are counted by column, bin and partner column that is there. So the ranks of a frequent value need counts only.
3. The cells between two cuts meet in one task, once for all partners, and their ranks among these go back to their
   blocks, in the order in which these sent them; what lies in the bins before is added there. A bin is a million rows,
   so that blocks and bins are few and what a block sends to a bin is many cells; it is sent as differences, compressed."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.sources.store import written

#: A block's rows are numbered by 16 bits.
_BLOCK, _STRIPE, _QUANTILES, _SAMPLED, _CUTS = 1 << 15, 1_000_000, 64, 200, 2000
_SUMS = ("sx", "sy", "sxx", "syy", "sxy", "rxx", "ryy", "rxy")
_PACKED = "block long, day int, live boolean, n int, some array<array<double>>, size array<int>, x array<binary>, at array<binary>"
#: Blocks are some megabytes each, so a file's size is looked at after every few of them.
_FEW = {"parquet.page.size.row.check.min": "2", "parquet.block.size.row.check.min": "2"}


def _squeezed(x: np.ndarray) -> bytes:
    """Whole numbers along the last axis as differences, their bytes of equal weight side by side, compressed."""
    steps = np.diff(x, prepend=x.dtype.type(0), axis=-1).reshape(-1)
    return pa.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), codec="zstd", asbytes=True) if len(steps) else b""


def _spread(told: bytes, dtype, *shape: int) -> np.ndarray:
    """The numbers of `_squeezed`."""
    n, size = math.prod(shape), np.dtype(dtype).itemsize
    flat = np.frombuffer(pa.decompress(told, decompressed_size=n * size, codec="zstd", asbytes=True) if n else b"", np.uint8)
    return np.cumsum(np.ascontiguousarray(flat.reshape(size, n).T).view(dtype).reshape(shape), axis=-1, dtype=dtype)


def _block(block: int, pieces: list) -> pa.RecordBatch:
    """One packed row of consecutive rows."""
    x = [np.concatenate([b.column(c).fill_null(0.0).to_numpy(zero_copy_only=False) for _, _, b in pieces]) for c in range(2, pieces[0][2].num_columns)]
    has = [np.concatenate([b.column(c).is_valid().to_numpy(zero_copy_only=False) for _, _, b in pieces]) for c in range(2, pieces[0][2].num_columns)]
    values, places, some = [], [], []
    for v, h in zip(x, has, strict=True):
        at = np.flatnonzero(h)
        at = at[np.argsort(v[at], kind="stable")]
        values.append(v[at])
        places.append(at.astype(np.uint16))
        plain = values[-1][~np.isnan(values[-1])]
        some.append(plain[np.linspace(0, len(plain) - 1, min(len(plain), _QUANTILES)).astype(int)].tolist() if len(plain) else [])
    row = {"block": block, "day": pieces[0][0], "live": any(live for _, live, _ in pieces), "n": len(x[0]), "some": some, "size": [len(v) for v in values], "x": [_squeezed(v.view(np.int64)) for v in values], "at": [_squeezed(p) for p in places]}
    types = (pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.list_(pa.list_(pa.float64())), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types, strict=True)], names=list(row))


def _pieces(batches):
    """(day, whether a row of it is live, rows) of consecutive rows of one day, a block at the most."""
    for batch in batches:
        day, live = batch.column(0).fill_null(-1 << 31).to_numpy(zero_copy_only=False), batch.column(1).fill_null(False).to_numpy(zero_copy_only=False)
        ends = [0, *(np.flatnonzero(np.diff(day)) + 1), len(day)]
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            for start in range(a, b, _BLOCK):
                end = min(start + _BLOCK, b)
                yield int(day[start]), bool(live[start:end].any()), batch.slice(start, end - start)


def _packing(batches):
    """A block ends with its day, or when it is full."""
    base, made, held = TaskContext.get().partitionId() << 32, 0, []
    for piece in _pieces(batches):
        if held and (piece[0] != held[0][0] or sum(b.num_rows for _, _, b in held) + piece[2].num_rows > _BLOCK):
            yield _block(base | made, held)
            made, held = made + 1, []
        held.append(piece)
    if held:
        yield _block(base | made, held)


def packed(cube: DataFrame, columns: list[str], day: Column | None = None, live: Column | None = None) -> DataFrame:
    """The rows of cube as blocks, written. With `day` a block is of one date, and tells whether a row of it is `live`."""
    told = [F.unix_date(day) if day is not None else F.lit(0), F.coalesce(live, F.lit(False)) if live is not None else F.lit(True)]
    return written(cube.select(told[0].alias("_day"), told[1].alias("_live"), *[F.col(c).cast("double") for c in columns]).mapInArrow(_packing, _PACKED), "packed", _FEW)


def newest(blocks: DataFrame, n: int) -> DataFrame:
    """The blocks of the newest n of the dates that have a live row."""
    days = blocks.filter("live AND day IS NOT NULL").select("day").distinct().orderBy(F.desc("day")).limit(n)
    return blocks.join(F.broadcast(days), "day", "left_semi")


def _unpacked(rows, columns: int):
    """(block, rows, each column's values in ascending order, the rows that they lie in) of packed rows."""
    for block, n, size, x, at in zip(*(rows.column(c).to_pylist() for c in ("block", "n", "size", "x", "at")), strict=True):
        yield block, n, [_spread(x[c], np.int64, size[c]).view(np.float64) for c in range(columns)], [_spread(at[c], np.uint16, size[c]).astype(np.intp) for c in range(columns)]


def _cuts(blocks: DataFrame, columns: int) -> list[np.ndarray]:
    """Each column's cuts."""
    rows = blocks.agg(F.sum("n")).first()[0] or 0
    parts, some = min(_CUTS, math.ceil(rows / _STRIPE)), blocks.select("block", "some").orderBy(F.xxhash64("block"), "block").limit(_SAMPLED).select("some").collect()
    out = []
    for c in range(columns):
        v = np.sort(np.array([y for r in some for y in r.some[c]], float))
        out.append(np.unique(v[np.linspace(0, len(v) - 1, parts + 1).astype(int)]) if len(v) else v)
    return out


def _edges(cuts: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Where each bin of ascending values begins, and their number: bins are odd for a cut, even for what lies between."""
    return np.concatenate(([0], np.stack([np.searchsorted(v, cuts), np.searchsorted(v, cuts, "right")], axis=1).reshape(-1), [len(v)])).astype(np.int64)


def _local_ranks(order: np.ndarray, new: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Twice the rank with ties averaged of each cell among those that are there, as the cells lie; order sorts them, new
    tells where another value begins in that order."""
    n = np.add.reduceat(there[order].astype(np.int64), np.flatnonzero(new))
    out = np.empty(len(order), np.int64)
    out[order] = (2 * (np.cumsum(n) - n) + n + 1)[np.cumsum(new) - 1]
    return out


def _plain_sums(a: np.ndarray, b: np.ndarray, has_a: np.ndarray, has_b: np.ndarray) -> np.ndarray:
    """n, sx, sy, sxx, syy and sxy of each of the rows of a with each of b, where both are there."""
    if not (np.isfinite(a).all() and np.isfinite(b).all()):
        out = np.zeros((6, len(a), len(b)))
        for i in range(len(a)):
            for j in range(len(b)):
                both = has_a[i] & has_b[j]
                x, y = a[i][both], b[j][both]
                out[:, i, j] = both.sum(), x.sum(), y.sum(), x @ x, y @ y, x @ y
        return out
    p, q = has_a.astype(float), has_b.astype(float)
    return np.stack([p @ q.T, a @ q.T, p @ b.T, (a * a) @ q.T, p @ (b * b).T, a @ b.T])


def correlations(blocks: DataFrame, names: tuple[str, ...], ahead: dict[int, str], least: int) -> DataFrame:
    """(series, horizon, n, pearson_ic, spearman_ic) of the columns `names` with those of `ahead` (by horizon) over all rows
    that have both, where these are `least`; ranks are those among these rows, ties averaged. `blocks` are those columns,
    in this order, `packed`."""
    columns, k = len(names) + len(ahead), len(names)
    partners = [list(range(k, columns)) if c < k else list(range(k)) for c in range(columns)]
    cuts = _cuts(blocks, columns)
    width = max(k, len(ahead))
    starts = np.cumsum([0, *[(2 * len(c) + 1) * width for c in cuts]])
    shift = [float(c[len(c) // 2]) if len(c) else 0.0 for c in cuts]

    def cells_of(n: int, values: list, at: list):
        """(column, values in ascending order, their rows, which partners are there, edges of the bins) of a block's cells
        that have a partner."""
        has = np.zeros((columns, n), bool)
        for c in range(columns):
            has[c, at[c]] = True
        for c in range(columns):
            there = has[partners[c]][:, at[c]]
            some = there.any(axis=0)
            yield c, values[c][some], at[c][some], there[:, some], _edges(cuts[c], values[c][some])

    def counted(batches):
        total = np.zeros(starts[-1], np.int64)
        for b in batches:
            for _, n, values, at in _unpacked(b, columns):
                for c, _, _, there, edges in cells_of(n, values, at):
                    before = np.concatenate((np.zeros((len(there), 1), np.int64), np.cumsum(there, axis=1)), axis=1)
                    total[starts[c] : starts[c + 1]].reshape(-1, width)[:, : len(there)] += np.diff(before[:, edges], axis=1).T
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["at", "n"])

    found = blocks.select("block", "n", "size", "x", "at").mapInArrow(counted, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(starts[-1], np.int64)
    counts[found.column(0).to_numpy()] = found.column(1).to_numpy()
    counts = [counts[a:b].reshape(-1, width) for a, b in zip(starts[:-1], starts[1:], strict=True)]
    below = [np.cumsum(n, axis=0) - n for n in counts]

    def cells(batches):
        for b in batches:
            for block, n, values, at in _unpacked(b, columns):
                out = []
                for c, v, _, there, edges in cells_of(n, values, at):
                    for i in range(0, len(edges) - 1, 2):
                        if edges[i] < edges[i + 1]:
                            part = slice(edges[i], edges[i + 1])
                            out.append((c, i, block, len(v[part]), _squeezed(v[part].view(np.int64)), pa.compress(np.packbits(there[:, part]).tobytes(), codec="zstd", asbytes=True)))
                types = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["c", "bin", "block", "n", "x", "there"])

    def placed(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        c, sizes = key[0].as_py(), rows.column("n").to_pylist()
        v = np.concatenate([_spread(x, np.int64, n) for x, n in zip(rows.column("x").to_pylist(), sizes, strict=True)]).view(np.float64)
        there = []
        for t, n in zip(rows.column("there").to_pylist(), sizes, strict=True):
            bits = np.frombuffer(pa.decompress(t, decompressed_size=-(-n * len(partners[c]) // 8), codec="zstd", asbytes=True), np.uint8)
            there.append(np.unpackbits(bits, count=n * len(partners[c])).reshape(-1, n).astype(bool))
        there = np.concatenate(there, axis=1)
        order = np.argsort(v, kind="stable")
        s = v[order]
        new = np.concatenate(([True], (s[1:] != s[:-1]) & ~(np.isnan(s[1:]) & np.isnan(s[:-1]))))
        kinds: dict[bytes, int] = {}
        kind = bytes([kinds.setdefault(t.tobytes(), len(kinds)) for t in there])
        ranks = np.stack([_local_ranks(order, new, there[kind.index(i)]) for i in range(len(kinds))]).astype(np.int32 if len(v) < 1 << 29 else np.int64)
        ranks[1:] -= ranks[:1]  # partners that are hardly ever missing leave next to nothing
        parts = [_squeezed(p) for p in np.split(ranks, np.cumsum(sizes)[:-1], axis=1)]
        told = {"block": rows.column("block"), "c": pa.array([c] * len(sizes), pa.int32()), "bin": rows.column("bin"), "kind": pa.array([kind] * len(sizes), pa.binary()), "size": pa.array([ranks.itemsize] * len(sizes), pa.int32()), "ranks": pa.array(parts, pa.binary())}
        return pa.table(told)

    def places(batches):
        for b in batches:
            for block, n, values, at in _unpacked(b, columns):
                x, has = np.zeros((columns, n)), np.zeros((columns, n), bool)
                for c in range(columns):
                    x[c, at[c]], has[c, at[c]] = values[c] - shift[c], True
                rows, bounds = [], []
                for _, _, some, _, edges in cells_of(n, values, at):
                    rows.append(_squeezed(some.astype(np.uint16)))
                    bounds.append(_squeezed(edges))
                types = (pa.int64(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.binary())
                told = (block, n, rows, bounds, _plain_sums(x[:k], x[k:], has[:k], has[k:]).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(told, types, strict=True)], names=["block", "n", "at", "edges", "sums"])

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        block = left.to_pylist()[0]
        n, rank, has = block["n"], [], np.zeros((columns, block["n"]), bool)
        own, at = [], []
        for c in range(columns):
            edges = _spread(block["edges"][c], np.int64, 2 * len(cuts[c]) + 2)
            at.append(_spread(block["at"][c], np.uint16, int(edges[-1])).astype(np.intp))
            own.append((edges, np.zeros((len(partners[c]), len(at[c])))))
        for r in right.to_pylist():
            edges, local = own[r["c"]]
            part = slice(edges[r["bin"]], edges[r["bin"] + 1])
            each = _spread(r["ranks"], np.int32 if r["size"] == 4 else np.int64, max(r["kind"]) + 1, part.stop - part.start)
            each[1:] += each[:1]
            local[:, part] = each[np.frombuffer(r["kind"], np.uint8)] / 2
        for c in range(columns):
            edges, local = own[c]
            # a cut's rows are all alike; for others this is what lies in the bins before
            base = below[c] + np.where(np.arange(len(below[c]))[:, None] % 2 == 1, (counts[c] + 1) / 2, 0)
            rank.append(np.zeros((len(partners[c]), n)))
            rank[c][:, at[c]] = local + np.repeat(base[:, : len(partners[c])], np.diff(edges), axis=0).T
            has[c, at[c]] = True
        plain = np.frombuffer(block["sums"]).reshape(6, k, len(ahead))
        found = []
        for i, name in enumerate(names):
            for j, h in enumerate(ahead):
                both = has[i] & has[k + j]
                if both.any():
                    middle = (counts[i][:, j].sum() + 1) / 2
                    r, q = rank[i][j][both] - middle, rank[k + j][i][both] - middle
                    found.append((name, h, int(plain[0, i, j]), *plain[1:, i, j].tolist(), r @ r, q @ q, r @ q))
        types = (pa.string(), pa.int32(), pa.int64(), *[pa.float64()] * len(_SUMS))
        return pa.table([pa.array([f[i] for f in found], t) for i, t in enumerate(types)], names=["series", "horizon", "n", *_SUMS])

    read = blocks.select("block", "n", "size", "x", "at")
    dealt = read.mapInArrow(cells, "c int, bin int, block long, n int, x binary, there binary")
    back = dealt.groupBy("c", "bin").applyInArrow(placed, "block long, c int, bin int, kind binary, size int, ranks binary")
    stayed = read.mapInArrow(places, "block long, n int, at array<binary>, edges array<binary>, sums binary")
    parts = stayed.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(summed, f"series string, horizon int, n long, {', '.join(f'{s} double' for s in _SUMS)}")
    total = parts.groupBy("series", "horizon").agg(*[F.sum(c).alias(c) for c in ("n", *_SUMS)]).filter(F.col("n") >= least)
    corr = lambda a, b, ab: F.when(F.sqrt(a) * F.sqrt(b) > 1e-15, ab / (F.sqrt(a) * F.sqrt(b)))
    central = lambda p, q, pq: F.col(pq) / F.col("n") - F.col(p) / F.col("n") * (F.col(q) / F.col("n"))
    flat = lambda c: F.greatest(c, F.lit(0.0))
    return total.select("series", "horizon", "n", corr(flat(central("sx", "sx", "sxx")), flat(central("sy", "sy", "syy")), central("sx", "sy", "sxy")).alias("pearson_ic"), corr(*[F.col(c) / F.col("n") for c in ("rxx", "ryy", "rxy")]).alias("spearman_ic"))
