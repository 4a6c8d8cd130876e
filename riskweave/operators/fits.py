"""Fits from sums over all rows: logistic curves by Newton steps, rising curves by pooling blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions.scalars import unit_clip
from riskweave.sources.files import checkpointed

#: Blocks of a rising curve that may go to all tasks, at 24 bytes each.
MOST_BLOCKS = 1_000_000


def _both_classes(rows: DataFrame, label: str) -> None:
    if rows.select(label).where(F.col(label).isNotNull()).distinct().count() < 2:
        raise ValueError("a fit needs both classes")


def newton_steps(rows: DataFrame, inputs: list[str], ridges: list[float], label: str = "label", weight: str | None = None, steps: int = 12, start: np.ndarray | None = None) -> np.ndarray:
    """Intercept and coefficients of logistic regressions, a row per ridge, after so many Newton steps from `start`, or zero.

    A step is one pass for all of them: each task sums the gradients and the curvatures of its rows, d and d x d numbers for each
    ridge, and only their totals reach the driver. A ridge is added to the curvature of all but the intercept, as a penalty of
    half its square sum. Rows with a null label or input are left out; a weight that is null is 0.
    """
    d, m = len(inputs) + 1, len(ridges)
    own = rows.select(*[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(inputs)], F.col(label).cast("double").alias("y"), (F.coalesce(F.col(weight), F.lit(0.0)) if weight else F.lit(1.0)).cast("double").alias("w")).dropna()
    betas = np.zeros((m, d)) if start is None else np.array(start, float)
    for _ in range(steps):

        def sums(batches, betas=betas):
            total = np.zeros((m, d, d + 1))
            for batch in batches:
                x = np.column_stack([np.ones(batch.num_rows), *(batch[f"x{k}"].to_numpy() for k in range(d - 1))])
                y, w = batch["y"].to_numpy(), batch["w"].to_numpy()
                for k, beta in enumerate(betas):
                    p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
                    total[k, :, :d] += x.T @ (x * (w * p * (1 - p))[:, None])
                    total[k, :, d] += x.T @ (w * (y - p))
            yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], ["place", "value"])

        found = own.mapInArrow(sums, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
        total = np.zeros(m * d * (d + 1))
        for place, value in found:
            total[place] = value
        total = total.reshape(m, d, d + 1)
        penalty = np.array(ridges, float)[:, None] * (np.arange(d) > 0)
        curvature = total[:, :, :d] + penalty[:, :, None] * np.eye(d)
        betas = betas + np.linalg.solve(curvature, (total[:, :, d] - penalty * betas)[:, :, None])[:, :, 0]
    return betas


def newton_logistic(rows: DataFrame, inputs: list[str], label: str = "label", weight: str | None = None, steps: int = 12, ridge: float = 0.0) -> list[float]:
    """Intercept and coefficients of one logistic regression, by newton_steps. Separable classes need a ridge."""
    _both_classes(rows, label)
    return [float(b) for b in newton_steps(rows, inputs, [ridge], label, weight, steps)[0]]


def logistic(beta: list[float], inputs: list[str]):
    """The probability column of a fit."""
    return 1 / (1 + F.exp(-sum((F.lit(b) * F.col(c) for b, c in zip(beta[1:], inputs, strict=True)), F.lit(beta[0]))))


class NewtonPlatt:
    """A logistic curve over scores, by Newton steps."""

    def __init__(self, scores: DataFrame, score: str = "score", label: str = "label", steps: int = 12):
        self.intercept, self.slope = newton_logistic(scores, [score], label, steps=steps)
        self.score = score

    def apply(self, rows: DataFrame, out: str = "calibrated") -> DataFrame:
        return rows.withColumn(out, logistic([self.intercept, self.slope], [self.score]))


def _pooled(batches):
    """Blocks (low, high, total, n) in order of a task, of which neighbours that do not rise are pooled."""
    low, high, total, n = [], [], [], []
    for batch in batches:
        for a, b, t, k in zip(*(batch[c].to_pylist() for c in ("low", "high", "total", "n")), strict=True):
            low.append(a), high.append(b), total.append(t), n.append(k)
            while len(n) > 1 and total[-2] * n[-1] >= total[-1] * n[-2]:
                high[-2], total[-2], n[-2] = high[-1], total[-2] + total[-1], n[-2] + n[-1]
                low.pop(), high.pop(), total.pop(), n.pop()
    yield pa.RecordBatch.from_arrays([pa.array(low, pa.float64()), pa.array(high, pa.float64()), pa.array(total, pa.float64()), pa.array(n, pa.float64())], ["low", "high", "total", "n"])


def isotonic_blocks(scores: DataFrame, score: str = "score", label: str = "label", weight: str | None = None, partitions: int | None = None) -> DataFrame:
    """(low, high, value, n): stretches of scores with one value each, rising, that fit the labels best by least squares.

    Scores are dealt into ranges and each is pooled by itself; whatever is pooled stays together in the end, as neighbours that
    do not rise always do. As long as the ends of two ranges do not rise, half as many ranges are pooled again. Rows with a
    null score or label are left out.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = scores.select(F.col(score).cast("double").alias("low"), F.col(label).cast("double").alias("y"), w.alias("w")).dropna()
    blocks = rows.groupBy("low").agg(F.sum(F.col("y") * F.col("w")).alias("total"), F.sum("w").alias("n")).withColumn("high", F.col("low"))
    n = partitions or int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        dealt = blocks.repartitionByRange(n, "low").sortWithinPartitions("low").select("low", "high", "total", "n")
        blocks = checkpointed(dealt.mapInArrow(_pooled, "low double, high double, total double, n double").withColumn("part", F.spark_partition_id()))
        value = F.struct("low", (F.col("total") / F.col("n")).alias("value"))
        ends = sorted(blocks.groupBy("part").agg(F.min(value).alias("first"), F.max(value).alias("last")).collect(), key=lambda r: r["first"]["low"])
        if n == 1 or all(a["last"]["value"] < b["first"]["value"] for a, b in zip(ends, ends[1:], strict=False)):
            return blocks.select("low", "high", (F.col("total") / F.col("n")).alias("value"), "n")
        n = max(1, n // 2)


class IsotonicBlocks:
    """A rising curve over scores, cut to [0, 1]: straight between blocks, level beyond them."""

    def __init__(self, scores: DataFrame, score: str = "score", label: str = "label"):
        _both_classes(scores, label)
        self.blocks, self.score = isotonic_blocks(scores, score, label), score
        if self.blocks.count() > MOST_BLOCKS:
            raise ValueError(f"the curve has over {MOST_BLOCKS} blocks; round the scores first")

    def apply(self, rows: DataFrame, out: str = "calibrated") -> DataFrame:
        found = np.array([tuple(r) for r in self.blocks.orderBy("low").select("low", "high", "value").collect()], float).reshape(-1, 3)
        shared = rows.sparkSession.sparkContext.broadcast((found[:, :2].ravel(), np.repeat(found[:, 2], 2)))

        @F.pandas_udf("double")
        def value(x):
            import pandas as pd

            return pd.Series(np.where(x.isna(), np.nan, np.interp(x.to_numpy(float), *shared.value)))

        return rows.withColumn(out, unit_clip(value(F.col(self.score).cast("double"))))
