"""Connected components of an edge list, without bringing it to one place."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import kept


def _local(batches):
    """Within one partition, each node's edge to the smallest node that it reaches there."""
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while (p := parent.setdefault(v, v)) != v:
            parent[v] = v = parent[p]
        return v

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            a, c = root(u), root(v)
            if a != c:
                parent[max(a, c)] = min(a, c)
    found = [(v, r) for v in list(parent) if (r := root(v)) != v]
    for i in range(0, len(found), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found[i : i + 50_000], strict=True)], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of edges (u, v), but for the smallest of each component, which names it.

    Each partition first joins what it can; then large-star and small-star steps alternate until the edges stand
    still. A node of any degree is handled by a partial minimum and a join, never as one list."""
    found = kept(edges.select("u", "v").filter("u <> v").mapInArrow(_local, "u long, v long").distinct(), "edges")
    before = None
    while True:
        now = found.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if not now["n"] or before == (now["n"], now["h"]):
            return found.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = (now["n"], now["h"])
        found = kept(_small_star(_large_star(found)), "edges")


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node goes to the smallest of its neighbours and itself."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, go to the smallest of them."""
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    rest = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
