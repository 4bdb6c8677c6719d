"""Connected components of an edge table by alternating large-star and small-star steps.

All of it is joins and min-aggregations with map-side combine, so a hub with
many neighbours is never gathered in one task; lineage is cut after each round.
At most ``FEW`` edges, which are counted first, are one executor task's work.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Edges that one task joins by union-find, at most.
FEW = 20_000


def _joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, root) of all the edges of one task."""
    up: dict[bytes, bytes] = {}

    def top(x: bytes) -> bytes:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for frame in frames:
        for u, v in zip(frame["u"], frame["v"]):
            a, b = top(bytes(u)), top(bytes(v))
            up[max(a, b)] = min(a, b)
    nodes = list(up)
    yield pd.DataFrame({"node": nodes, "root": [top(x) for x in nodes]}, dtype=object)


def _stars(edges: DataFrame) -> DataFrame:
    """One round over edges (u, v) with v < u."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # Large star: every larger neighbour of u goes to the least of u and its neighbours.
    large = edges.select(F.col("v").alias("u"), F.col("u").alias("far")).join(least, "u").select(F.col("far").alias("u"), F.col("m").alias("v"))
    large = large.where("v < u").distinct()
    # Small star: u and its smaller neighbours go to the least of them.
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("v < u")
    return small.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (u, v), which are binary; root is the least node of its component."""
    if edges.limit(FEW + 1).count() <= FEW:
        return edges.select("u", "v").coalesce(1).mapInPandas(_joined, "node binary, root binary")
    now = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("v < u").distinct(), "edges")
    mark = None
    while True:
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == mark:
            break
        mark = state
        now = materialize(_stars(now), "edges")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
