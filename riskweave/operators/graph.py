"""Connected components of a graph that is a table of edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.sources.files import checkpointed


#: Edges that a task puts together at a time before the rounds, some 500 bytes each.
EDGES = 200_000


def _stars(batches):
    """Edges (u, v) from each node to the smallest one that the edges of its stretch reach, its own included."""
    parent: dict[int, int] = {}

    def top(k: int) -> int:
        while parent.setdefault(k, k) != k:
            parent[k] = k = parent[parent[k]]
        return k

    def hung():
        nodes = np.fromiter(parent, np.int64, len(parent))
        ends = np.fromiter(map(top, nodes.tolist()), np.int64, len(nodes))
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(ends)], ["u", "v"])

    size = 0
    for batch in batches:
        for u, v in zip(batch["u"].to_pylist(), batch["v"].to_pylist(), strict=True):
            u, v = top(u), top(v)
            parent[max(u, v)] = min(u, v)
        size += batch.num_rows
        if size >= EDGES:
            yield hung()
            size = 0
    if parent:
        yield hung()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (u, v) of longs; component is the smallest node that can be reached.

    Nodes hang on smaller ones. In a round every node hangs its larger neighbours on the smallest node it knows, and then itself on
    it as well, which halves distances; rounds grow with the logarithm of the longest path. Before, each task hangs what a stretch of
    its edges puts together on its smallest node, so paths are only those between stretches. A hub's neighbours are never
    gathered. Lineage is cut by a reliable checkpoint each round.
    """
    known = edges.select(F.coalesce("u", "v").alias("u"), F.coalesce("v", "u").alias("v")).where("u is not null")
    edges = checkpointed(known.mapInArrow(_stars, "u long, v long"))
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    hangs = checkpointed(edges.where("u <> v").select(F.greatest("u", "v").alias("child"), F.least("u", "v").alias("top")).distinct())
    seen: tuple | None = None
    while True:
        now = tuple(hangs.agg(F.count("*"), F.sum(F.xxhash64("child", "top").cast("decimal(38,0)"))).first())
        if now == seen or not now[0]:
            break
        seen = now
        ends = hangs.select(F.explode(F.array(F.struct(F.col("child").alias("at"), F.col("top").alias("to")), F.struct(F.col("top").alias("at"), F.col("child").alias("to")))).alias("e")).select("e.*")
        least = ends.groupBy("at").agg(F.least(F.min("to"), F.first("at")).alias("least"))
        larger = ends.join(least, "at").where("to > at").select(F.col("to").alias("child"), F.col("least").alias("top")).distinct()
        lowest = larger.groupBy("child").agg(F.min("top").alias("least"))
        chained = larger.join(lowest, "child").where("top <> least").select(F.col("top").alias("child"), F.col("least").alias("top"))
        hangs = checkpointed(chained.unionByName(lowest.select("child", F.col("least").alias("top"))).distinct())
    return nodes.join(hangs, F.col("node") == F.col("child"), "left").select("node", F.coalesce("top", "node").alias("component"))
