"""Fits from sums against Spark ML and plain pooling; the cut of anomaly scores against numpy."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from riskweave.operators import evaluation as E
from riskweave.operators import fits, ml


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(1500):
        a, b = rng.gauss(0, 1), rng.random()
        rows.append((a, b, float(rng.random() < 1 / (1 + np.exp(-(0.7 * a - 2 * b + 0.3)))), rng.choice([0.5, 1.0, 2.0])))
    return spark.createDataFrame([*rows, (None, 0.1, 1.0, 1.0), (0.1, 0.1, None, 1.0)], "a double, b double, label double, weight double").repartition(5).persist()


@pytest.mark.parametrize("weight", [None, "weight"])
def test_newton_steps_find_the_fit_of_spark_ml(labelled, weight):
    beta = fits.newton_logistic(labelled, ["a", "b"], weight=weight)
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="x").transform(labelled.dropna())
    other = LogisticRegression(featuresCol="x", maxIter=500, tol=1e-14, standardization=False, **({"weightCol": weight} if weight else {})).fit(rows)
    assert beta == pytest.approx([other.intercept, *other.coefficients], abs=1e-6)
    assert beta == pytest.approx(fits.newton_logistic(labelled, ["a", "b"], weight=weight, steps=25), abs=1e-10)
    p = labelled.dropna().select(fits.logistic(beta, ["a", "b"]).alias("p"), "label").agg(F.avg("p"), F.avg("label")).first()
    assert weight or p[0] == pytest.approx(p[1], abs=1e-9)


def test_separable_classes_need_a_ridge(spark):
    rows = spark.createDataFrame([(float(k), float(k > 4)) for k in range(10)], "a double, label double")
    assert fits.newton_logistic(rows, ["a"], ridge=0.1)[1] > 0
    with pytest.raises(ValueError):
        fits.newton_logistic(rows.where("label = 1"), ["a"])


def pooled(points):
    out = []
    for s, y, n in points:
        out.append([s, s, y, n])
        while len(out) > 1 and out[-2][2] / out[-2][3] >= out[-1][2] / out[-1][3]:
            _, high, y, n = out.pop()
            out[-1][1:] = [high, out[-1][2] + y, out[-1][3] + n]
    return [(a, b, t / n, n) for a, b, t, n in out]


@pytest.mark.parametrize("shape", ["noise", "rising", "falling", "steps"])
@pytest.mark.parametrize("partitions", [1, 7])
def test_blocks_equal_plain_pooling(spark, shape, partitions):
    rng = random.Random(shape)
    level = {"noise": lambda k: 0.5, "rising": lambda k: k / 300, "falling": lambda k: 1 - k / 300, "steps": lambda k: (k // 60) / 5}[shape]
    rows = [(float(k // 2), float(rng.random() < level(k)) if shape != "falling" else level(k)) for k in range(300)]
    out = fits.isotonic_blocks(spark.createDataFrame(rows, "score double, label double").repartition(4), partitions=partitions).orderBy("low").collect()
    points: dict = {}
    for s, y in rows:
        t, n = points.get(s, (0.0, 0))
        points[s] = (t + y, n + 1)
    expected = pooled([(s, *points[s]) for s in sorted(points)])
    assert [(r["low"], r["high"], r["n"]) for r in out] == [(a, b, n) for a, b, _, n in expected]
    assert [r["value"] for r in out] == pytest.approx([v for _, _, v, _ in expected])


def test_rising_curve_between_and_beyond_blocks(spark):
    rows = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (2.0, 1.0), (3.0, 1.0)], "score double, label double")
    curve = fits.IsotonicBlocks(rows)
    out = curve.apply(spark.createDataFrame([(x,) for x in (-1.0, 0.5, 1.25, 1.5, 2.5, 9.0, None)], "score double")).collect()
    assert [r["calibrated"] for r in out] == [0.0, 0.0, 0.25, 0.5, 1.0, 1.0, None]


@pytest.mark.parametrize("share", [0.0, 0.03, 0.25, 0.9])
def test_contamination_cut(spark, share):
    rng = random.Random(8)
    scores = [rng.random() for _ in range(333)]
    df = spark.createDataFrame([(k, x, 0.0) for k, x in enumerate(scores)], "k long, anomaly double, label double").repartition(4)
    cut = ml.contamination_cut(df, share)
    assert cut == pytest.approx(np.quantile(scores, 1 - min(max(share, 0.001), 0.5)))
    flagged = ml.with_anomaly_flags(df, df.withColumn("label", (F.col("k") < 333 * share).cast("double"))).where("is_anomaly").count()
    assert abs(flagged - 333 * min(max(share, 0.001), 0.5)) <= 1


@pytest.mark.parametrize("model", ["logistic_regression", "random_forest"])
def test_search_halves_its_trials(spark, labelled, model, monkeypatch):
    """Rungs of 5, 3 and 2 trials; the values of the last are those of single fits with the same parameters."""
    df = labelled.dropna().withColumn("event_id", F.monotonically_increasing_id())
    if model == "random_forest":
        monkeypatch.setitem(ml.SPACES, model, (("numTrees", 4, 6, "int"), ("maxDepth", 2, 3, "int"), ("minInstancesPerNode", 1, 5, "int")))
    best, table = ml.search(df.drop("weight"), ["a", "b"], model, trials=5)
    rows = table.orderBy("rung", "trial").collect()
    assert [sum(r["rung"] == k for r in rows) for k in range(3)] == [5, 3, 2] and [sum(r["kept"] for r in rows if r["rung"] == k) for k in range(3)] == [3, 2, 1]
    assert ml.draw_trials(model, 5) == [*ml.draw_trials(model, 3), *ml.draw_trials(model, 5)[3:]]
    last = [r for r in rows if r["rung"] == 2]
    winner = next(r for r in last if r["kept"])
    assert best == ml.draw_trials(model, 5)[winner["trial"]] and winner["average_precision"] == max(r["average_precision"] for r in last)
    if model == "logistic_regression":
        u = F.pmod(F.xxhash64("event_id", "label", F.lit(42)), F.lit(1 << 53)) / float(1 << 53)
        rows = df.drop("weight").withColumn("u", u)
        train = ml.with_class_weights(rows.where("u >= 0.25"))
        beta = fits.newton_logistic(train, ["a", "b"], weight="weight", ridge=1 / best["C"])
        value = E.average_precision(rows.where("u < 0.25").withColumn("score", fits.logistic(beta, ["a", "b"]))).first()[0]
        assert winner["average_precision"] == pytest.approx(value)
    with pytest.raises(ValueError):
        ml.search(df, ["a"], "svm")
    with pytest.raises(ValueError):
        ml.draw_trials(model, 0)
