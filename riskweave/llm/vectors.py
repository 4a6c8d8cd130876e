"""Embedding near-duplicates by an epsilon grid order join."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import materialise, shuffle_partitions
from riskweave.llm.components import connected_components, spanning

COSINE = 0.93
#: Rows that principal axes are fitted on, at most, those of the smallest hashes. Any orthonormal axes give right results;
#: these only make cells and boxes tell vectors apart.
FIT_ROWS = 4096
#: Leading axes whose cells order the vectors, and vectors in an interval.
AXES = 6
INTERVAL = 512
#: Vectors below which an interval of the recursion is compared directly.
LEAF = 64
_SLACK = 1e-6
#: From here on numbers stand for vectors none of whose rows has an id.
_UNNAMED = 2**61


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """(label, embedding, rep, n): a row for each distinct valid vector of a label; rep is its smallest id."""
    return rows.where("ok").groupBy("label", "embedding").agg(F.min("id").alias("rep"), F.count("*").alias("n"))


def _with_validity(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    v = F.col("embedding")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("embedding"), F.col(label_col).alias("label"))
    return rows.withColumn("ok", F.coalesce(v.isNotNull() & F.col("label").isNotNull() & good, F.lit(False)))


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """{dimension: orthonormal columns, leading first} from at most FIT_ROWS vectors; other dimensions keep their own axes."""
    chosen = vectors.select("embedding").orderBy(F.xxhash64("embedding"), "rep").limit(FIT_ROWS).toPandas()["embedding"]
    by_size: dict[int, list] = {}
    for v in chosen:
        by_size.setdefault(len(v), []).append(_unit(np.asarray(v, float)[None, :])[0])
    return {n: np.linalg.eigh(np.cov(np.array(vs).T).reshape(n, n))[1][:, ::-1] for n, vs in by_size.items() if len(vs) > 1}


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # first, so that no square under- or overflows
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _packed(x: np.ndarray) -> bytes:
    """Rows as 32-bit floats where that loses nothing, else as 64-bit ones."""
    with np.errstate(over="ignore"):
        short = x.astype("<f4")
    return (short if (short == x).all() else x.astype("<f8")).tobytes()


def _unpacked(raw: bytes, rows: int, size: int) -> np.ndarray:
    return _unit(np.frombuffer(raw, "<f4" if len(raw) == 4 * rows * size else "<f8").reshape(rows, size).astype(float))


def _in_axes(x: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    return x @ axes[x.shape[1]] if x.shape[1] in axes else x


def _intervals(vectors: DataFrame, axes: dict[int, np.ndarray], width: float) -> DataFrame:
    """Blocks of at most INTERVAL vectors of a label and dimension that follow each other in grid order, with their box."""

    def order(batches):
        for pdf in batches:
            cells = np.zeros((len(pdf), AXES), np.int32)
            sizes = pdf["embedding"].map(len).to_numpy()
            for n in np.unique(sizes):
                at = np.flatnonzero(sizes == n)
                y = _in_axes(_unit(np.array(pdf["embedding"].iloc[at].tolist(), float)), axes)[:, :AXES]
                cells[at, : y.shape[1]] = np.floor(y / width)
            yield pdf.assign(size=sizes.astype(np.int32), cell=list(cells))

    schema = "label {}, embedding array<double>, rep long, n long, size int, cell array<int>".format(vectors.schema["label"].dataType.simpleString())
    keyed = vectors.mapInPandas(order, schema)
    parts = shuffle_partitions(vectors.sparkSession)
    # ids break ties, so that one full cell is dealt to several tasks
    dealt = keyed.repartitionByRange(parts, "label", "size", "cell", "rep").sortWithinPartitions("label", "size", "cell", "rep")

    def blocks(batches):
        def made(held: pd.DataFrame):
            x = np.array(held["embedding"].tolist(), float)
            y = _in_axes(_unit(x), axes)
            first = held.iloc[0]
            return {
                "label": first["label"], "size": int(first["size"]), "block": int(first["rep"]), "low": y.min(0).tolist(), "high": y.max(0).tolist(),
                "reps": held["rep"].tolist(), "copies": held["n"].tolist(), "vectors": _packed(x),
            }

        held = None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            out = []
            while len(held):
                same = ((held["label"] == held["label"].iloc[0]) & (held["size"] == held["size"].iloc[0])).to_numpy()
                run = int(same.argmin()) if not same.all() else len(held)
                if run == len(held) and run < INTERVAL:
                    break
                take = min(run, INTERVAL)
                out.append(made(held.iloc[:take]))
                held = held.iloc[take:].reset_index(drop=True)
            if out:
                yield pd.DataFrame(out)
        if held is not None and len(held):
            yield pd.DataFrame([made(held)])

    kind = vectors.schema["label"].dataType.simpleString()
    return dealt.mapInPandas(blocks, f"label {kind}, size int, block long, low array<double>, high array<double>, reps array<long>, copies array<long>, vectors binary")


def _near_pairs(boxes: DataFrame, width: float) -> DataFrame:
    """Pairs of blocks (a <= b) of a label whose boxes come within the radius on all axes together.

    Boxes meet in strips of the two leading axes, one radius wide: each goes to the strips it spans, and on one side to
    the next; so only neighbours in grid order become pairs, without a product of all blocks.
    """
    radius = F.lit(width)

    def strips(axis: int, reach: float):
        low, high = F.element_at("low", axis), F.element_at("high", axis)
        return F.sequence(F.floor((low - reach) / radius), F.floor((high + reach) / radius))

    def spread(reach: float):
        second = F.when(F.size("low") > 1, strips(2, reach)).otherwise(F.array(F.lit(0).cast("long")))
        out = boxes.select("label", "size", "block", "low", "high", F.explode(strips(1, reach)).alias("s1"), second.alias("s2"))
        return out.withColumn("s2", F.explode("s2"))

    a = spread(0.0).select("label", "size", "s1", "s2", F.col("block").alias("a"), F.col("low").alias("la"), F.col("high").alias("ha"))
    b = spread(width).select("label", "size", "s1", "s2", F.col("block").alias("b"), F.col("low").alias("lb"), F.col("high").alias("hb"))
    gap = F.transform(F.arrays_zip("la", "ha", "lb", "hb"), lambda x: F.greatest(x["la"] - x["hb"], x["lb"] - x["ha"], F.lit(0.0)))
    apart = F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g)
    met = a.join(b, ["label", "size", "s1", "s2"]).where((F.col("a") <= F.col("b")) & (apart <= (width + _SLACK) ** 2))
    return met.select("label", "size", "a", "b").distinct()


def _compare(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, axes_x: np.ndarray, axes_y: np.ndarray, width: float, least: float):
    """Index pairs of linked rows, by recursion on halves of two intervals; halves with distant boxes are skipped."""
    gap = np.maximum(0, np.maximum(axes_x[i].min(0) - axes_y[j].max(0), axes_y[j].min(0) - axes_x[i].max(0)))
    if gap @ gap > (width + _SLACK) ** 2:
        return
    if max(len(i), len(j)) <= LEAF:
        p, q = np.nonzero(x[i] @ y[j].T >= least)
        if len(p):
            yield i[p], j[q]
        return
    for u in np.array_split(i, 2) if len(i) > LEAF else [i]:
        for v in np.array_split(j, 2) if len(j) > LEAF else [j]:
            yield from _compare(x, y, u, v, axes_x, axes_y, width, least)


def _matches(blocks: DataFrame, pairs: DataFrame, axes: dict[int, np.ndarray], width: float, least: float) -> DataFrame:
    """(kind, node, other, n): kind 0 counts the rows linked to each vector of a block pair; kind 1 is a link of its forest."""
    left = blocks.select("label", "size", F.col("block").alias("a"), F.col("reps").alias("ra"), F.col("copies").alias("ca"), F.col("vectors").alias("va"))
    right = blocks.select("label", "size", F.col("block").alias("b"), F.col("reps").alias("rb"), F.col("copies").alias("cb"), F.col("vectors").alias("vb"))
    both = pairs.join(left, ["label", "size", "a"]).join(right, ["label", "size", "b"]).select(F.col("size").alias("dim"), "a", "b", "ra", "ca", "va", "rb", "cb", "vb")

    def run(batches):
        for pdf in batches:
            kinds, nodes, others, counts = [], [], [], []
            for row in pdf.itertuples(index=False):
                x, y = _unpacked(row.va, len(row.ra), row.dim), _unpacked(row.vb, len(row.rb), row.dim)
                ra, rb, ca, cb = (np.asarray(v, np.int64) for v in (row.ra, row.rb, row.ca, row.cb))
                found = list(_compare(x, y, np.arange(len(x)), np.arange(len(y)), _in_axes(x, axes), _in_axes(y, axes), width, least))
                if not found:
                    continue
                p, q = (np.concatenate([f[k] for f in found]) for k in (0, 1))
                if row.a == row.b:
                    p, q = p[p != q], q[p != q]  # each link stands in both orders
                    sides = [(ra, np.bincount(p, cb[q], len(ra)))]
                else:
                    sides = [(ra, np.bincount(p, cb[q], len(ra))), (rb, np.bincount(q, ca[p], len(rb)))]
                for rep, n in sides:
                    some = np.flatnonzero(n)
                    kinds.append(np.zeros(len(some), np.int32)), nodes.append(rep[some]), others.append(rep[some]), counts.append(n[some].astype(np.int64))
                tree = spanning(ra[p], rb[q])
                kinds.append(np.ones(tree.sum(), np.int32)), nodes.append(ra[p][tree]), others.append(rb[q][tree]), counts.append(np.zeros(tree.sum(), np.int64))
            names = ("kind", "node", "other", "n")
            yield pd.DataFrame({k: np.concatenate(v) if v else np.array([], np.int64) for k, v in zip(names, (kinds, nodes, others, counts), strict=True)})

    return both.mapInPandas(run, "kind int, node long, other long, n long")


def near_vectors(vectors: DataFrame, least: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per input row.

    Rows link if their labels are equal and not null, their vectors have the same length and the cosine in double
    precision is at least `least`. n_links counts the other rows linked directly; component_id is the smallest id
    reachable, kept says whether it is the row's own. Null and zero vectors, and those with null or non-finite parts, link
    with nothing. Equal vectors are joined once and counted as often as they occur; a repeated id counts as rows. Rows
    without an id link and are counted; their component_id is their class's (null if no member has an id), kept is false.

    Distinct unit vectors are ordered by grid cells, one radius wide, on the leading principal axes and cut into blocks;
    pairs of blocks whose boxes are provably further apart than the radius are skipped, and so are halves of blocks.
    """
    width = max(1e-6, math.sqrt(max(0.0, 2 - 2 * least)))
    rows = _with_validity(vectors, id_col, vector_col, label_col)
    classes = materialise(distinct_vectors(rows).withColumn("rep", F.coalesce("rep", _UNNAMED + F.abs(F.xxhash64("label", "embedding") % _UNNAMED))))
    axes = principal_axes(classes)
    blocks = materialise(_intervals(classes, axes, width))
    found = materialise(_matches(blocks, _near_pairs(blocks.select("label", "size", "block", "low", "high"), width), axes, width, least))
    counted = found.where("kind = 0").groupBy("node").agg(F.sum("n").alias("near"))
    edges = found.where("kind = 1").select(F.col("node").alias("src"), F.col("other").alias("dst"))
    linked = connected_components(edges).select(F.col("node").alias("member"), "component")
    state = classes.join(counted, F.col("rep") == F.col("node"), "left").join(linked, F.col("rep") == F.col("member"), "left")
    component = F.coalesce("component", "rep")
    state = state.select(F.col("label").alias("l"), F.col("embedding").alias("e"), (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("links"), component.alias("c"))
    valid = rows.where("ok").join(state, (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e")))
    valid = valid.select("id", "links", F.when(F.col("c") < _UNNAMED, F.col("c")).alias("c"))
    other = rows.where("not ok").select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("c"))
    return valid.unionByName(other).select(
        F.col("id").alias("vec_id"), F.col("links").alias("n_links"), F.col("c").alias("component_id"), F.coalesce(F.col("id") == F.col("c"), F.lit(False)).alias("kept")
    )
