"""Connected components by alternating large and small stars, as joins and aggregations.

Each round points nodes at the least node near them; a node with many neighbours is aggregated
before the shuffle and its join can be split. Up to ONE_TASK edges, a few megabytes, are joined
up in one task instead, which saves the rounds; more are never gathered in one place.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows, stored

#: Edges that one task may hold.
ONE_TASK = 100_000


def _joined_up(batches):
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = parent[x]
        return x

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            u, v = top(u), top(v)
            parent[max(u, v)] = min(u, v)
    found = [(x, r) for x in parent if (r := top(x)) != x]
    yield rows(pa.schema([("node", pa.int64()), ("root", pa.int64())]), {"node": [x for x, _ in found], "root": [r for _, r in found]})


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for the nodes of edges (u, v) but the roots themselves."""
    now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    if now.count() <= ONE_TASK:
        return stored(now.coalesce(1).mapInArrow(_joined_up, "node long, root long"), "components")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: u > v here; each u and its lesser neighbours meet at the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = stored(small.filter("u <> v").distinct(), "edges")
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
