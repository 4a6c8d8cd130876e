"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import checkpoint


def spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the links, taken in order, join two parts that were apart."""
    parent: dict[int, int] = {}

    def top(k: int) -> int:
        while parent.setdefault(k, k) != k:
            parent[k] = k = parent[parent[k]]
        return k

    keep = np.zeros(len(a), bool)
    for k, (u, v) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        u, v = top(u), top(v)
        if u != v:
            parent[u], keep[k] = v, True
    return keep


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Rows (node, component) for every node that has an edge to another; component is the smallest node reachable.

    Each round links a node's larger neighbours to its smallest neighbour, then its smaller ones, until nothing
    changes; the rounds needed grow with the logarithm of the graph. A hub's neighbours are never gathered: the
    smallest one is a partial aggregate, and the join that follows can be split by adaptive execution.
    Self-loops, repeated edges and nulls are ignored; no edges give no rows.
    """
    a, b = F.col(src), F.col(dst)
    e = checkpoint(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = _signature(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpoint(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        after = _signature(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
