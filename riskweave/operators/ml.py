"""Models on Spark ML: baselines, calibration, anomaly scores, explanations by removal, tuning, contracts."""

from __future__ import annotations

import json
import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions.scalars import unit_clip
from riskweave.operators import evaluation as E
from riskweave.operators import fits
from riskweave.operators.decisions import combination_scores
from riskweave.operators.features import FEATURES
from riskweave.sources.files import checkpointed

#: What models may see: features only, never ids, labels, times or places.
MODEL_INPUTS = tuple(FEATURES)


def model_inputs(df: DataFrame, inputs: list[str], key: str = "event_id") -> DataFrame:
    """The key and what a model may see; anything else is an error, as are inputs that df lacks."""
    if refused := sorted(set(inputs) - set(MODEL_INPUTS)):
        raise ValueError(f"models may not see: {', '.join(refused)}")
    if missing := sorted(set(inputs) - set(df.columns)):
        raise ValueError(f"missing inputs: {', '.join(missing)}")
    return df.select(key, *[F.col(c).cast("double").alias(c) for c in inputs])


def one_hot(df: DataFrame, vocabulary: dict[str, list[str]]) -> DataFrame:
    """df with a 0/1 column per known category; unseen and null ones are all zeros."""
    cols = {f"{c}_{v.lower()}": F.coalesce((F.col(c) == v).cast("double"), F.lit(0.0)) for c, vs in vocabulary.items() for v in vs}
    return df.withColumns(cols)


def vocabulary(train: DataFrame, columns: list[str], most: int = 1000) -> dict[str, list[str]]:
    """Distinct values of the training part; more than `most` in a column is an error, as each becomes a column."""
    out = {}
    for c in columns:
        values = [r[0] for r in train.select(c).where(F.col(c).isNotNull()).distinct().limit(most + 1).collect()]
        if len(values) > most:
            raise ValueError(f"{c} has more than {most} values")
        out[c] = sorted(map(str, values))
    return out


def with_class_weights(train: DataFrame, label: str = "label") -> DataFrame:
    """train with `weight`, so that both classes weigh the same."""
    rate = train.agg(F.avg(label).alias("__r"))
    weight = F.when(F.col(label) == 1, 0.5 / F.col("__r")).otherwise(0.5 / (1 - F.col("__r")))
    return train.crossJoin(F.broadcast(rate)).withColumn("weight", F.coalesce(weight, F.lit(1.0))).drop("__r")


def pipeline(name: str, inputs: list[str], seed: int = 42, label: str = "label", trees: int = 150) -> Pipeline:
    """logistic_regression (standardised), random_forest or boosted_trees, on weighted rows. trees: of a forest, or rounds."""
    assemble = VectorAssembler(inputCols=inputs, outputCol="raw_inputs", handleInvalid="keep")
    common = {"labelCol": label, "weightCol": "weight", "featuresCol": "raw_inputs"}
    if name == "logistic_regression":
        scale = StandardScaler(inputCol="raw_inputs", outputCol="inputs", withMean=True, withStd=True)
        return Pipeline(stages=[assemble, scale, LogisticRegression(**common | {"featuresCol": "inputs"}, maxIter=100)])
    if name == "random_forest":
        return Pipeline(stages=[assemble, RandomForestClassifier(**common, numTrees=trees, seed=seed)])
    if name == "boosted_trees":
        return Pipeline(stages=[assemble, GBTClassifier(**common, maxIter=trees, maxDepth=4, stepSize=0.05, subsamplingRate=0.85, seed=seed)])
    raise ValueError(f"unknown model: {name}")


def scored_by(model: PipelineModel | Column, rows: DataFrame, out: str = "score") -> DataFrame:
    """rows with the model's probability of the positive class; a model may be a column over the inputs."""
    if isinstance(model, Column):
        return rows.withColumn(out, model)
    kept = rows.columns
    return model.transform(rows).withColumn(out, vector_to_array("probability")[1]).select(*kept, out)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def train_baselines(df: DataFrame, inputs: list[str], names: tuple[str, ...] = ("logistic_regression", "random_forest"), time: str = "us", tie: str = "event_id", threshold: float = 0.5, trees: int = 150) -> tuple[dict[str, PipelineModel], DataFrame, dict[str, str]]:
    """Models fitted on the earliest part, metrics on the later ones by model and split, and why models were skipped."""
    parts = E.chronological_split(df, time, tie).persist()
    train = with_class_weights(parts.where("split = 'train'"))
    rest = parts.where("split <> 'train'")
    models, skipped, tables = {}, {}, []
    for name in names:
        try:
            stages = pipeline(name, inputs, trees=trees)
        except ValueError as why:
            skipped[name] = str(why)
            continue
        models[name] = stages.fit(train)
        tables.append(scored_by(models[name], rest).withColumn("model", F.lit(name)))
    scores = tables[0]
    for t in tables[1:]:
        scores = scores.unionByName(t)
    scores = checkpointed(scores.select("model", "split", "label", "transaction_amount", "score"))  # each row is scored once for all metrics
    metrics = E.threshold_metrics(scores, threshold, ["model", "split"], amount="transaction_amount")
    area = E.average_precision(scores, ["model", "split"])
    return models, metrics.join(area, ["model", "split"]), skipped


class Platt:
    """A logistic curve over scores."""

    def __init__(self, scores: DataFrame, score: str = "score", label: str = "label"):
        if scores.select(label).distinct().count() < 2:
            raise ValueError("calibration needs both classes")
        rows = VectorAssembler(inputCols=[score], outputCol="x").transform(scores)
        fitted = LogisticRegression(featuresCol="x", labelCol=label).fit(rows)
        self.slope, self.intercept, self.score = float(fitted.coefficients[0]), float(fitted.intercept), score

    def apply(self, rows: DataFrame, out: str = "calibrated") -> DataFrame:
        return rows.withColumn(out, 1 / (1 + F.exp(-(self.slope * F.col(self.score) + self.intercept))))


class Isotonic:
    """A rising step curve over scores, cut to [0, 1]; scores out of range take the ends."""

    def __init__(self, scores: DataFrame, score: str = "score", label: str = "label"):
        if scores.select(label).distinct().count() < 2:
            raise ValueError("calibration needs both classes")
        fitted = IsotonicRegression(featuresCol=score, labelCol=label).fit(scores.select(F.col(score).cast("double").alias(score), F.col(label).cast("double").alias(label)))
        self.model, self.score = fitted, score

    def apply(self, rows: DataFrame, out: str = "calibrated") -> DataFrame:
        kept = rows.columns
        return self.model.setPredictionCol("__iso").transform(rows).withColumn(out, unit_clip(F.col("__iso"))).select(*kept, out)


# --- isolation forest: a tree is a group of at most SAMPLE rows -----------------------------------------------------

SAMPLE = 256


def _grow(x: np.ndarray, rng: np.random.Generator, depth: int, limit: int, nodes: list) -> int:
    at = len(nodes)
    nodes.append(None)
    spread = np.flatnonzero(x.max(0) > x.min(0)) if len(x) > 1 else []
    if depth >= limit or len(x) <= 1 or not len(spread):
        nodes[at] = (-1, 0.0, len(x), depth, 0)
        return at
    f = int(rng.choice(spread))
    cut = float(rng.uniform(x[:, f].min(), x[:, f].max()))
    left = _grow(x[x[:, f] < cut], rng, depth + 1, limit, nodes)
    right = _grow(x[x[:, f] >= cut], rng, depth + 1, limit, nodes)
    nodes[at] = (f, cut, left, right, depth)
    return at


def _expected(n: int) -> float:
    return 0.0 if n <= 1 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def isolation_trees(train: DataFrame, inputs: list[str], key: str, trees: int = 150, seed: int = 42) -> list[list[tuple]]:
    """Trees over bounded samples, each grown in a task of its own; what returns is trees times at most 2 * SAMPLE nodes."""
    n = train.count()
    share = min(1.0, 2.0 * SAMPLE / max(1, n))

    def draw(tree: Column) -> Column:
        return F.pmod(F.xxhash64(F.col(key), tree, F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)

    # a row is multiplied only by the trees that drew it
    drawn = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: draw(t) < share)
    rows = train.select(key, *inputs, F.explode(drawn).alias("tree")).withColumn("__u", draw(F.col("tree")))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = pdf.sort_values("__u")[inputs].head(SAMPLE).to_numpy(float)
        nodes: list = []
        _grow(np.nan_to_num(x), np.random.default_rng([seed, tree]), 0, math.ceil(math.log2(max(2, len(x)))), nodes)
        return pd.DataFrame([(tree, k, len(x), *map(float, node)) for k, node in enumerate(nodes)], columns=["tree", "k", "n", "a", "b", "c", "d", "e"])

    found = rows.groupBy("tree").applyInPandas(grow, "tree int, k int, n int, a double, b double, c double, d double, e double").orderBy("tree", "k").collect()
    out: dict[int, list] = {}
    for r in found:
        out.setdefault(r["tree"], []).append((r["n"], int(r["a"]), r["b"], int(r["c"]), int(r["d"]), int(r["e"])))
    return [out[k] for k in sorted(out)]


def isolation_scores(rows: DataFrame, trees: list[list[tuple]], inputs: list[str], out: str = "anomaly") -> DataFrame:
    """rows with an anomaly score in (0, 1), near 1 where few cuts isolate a row. Trees go to all tasks: their size is fixed."""
    shared = rows.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        x = np.nan_to_num(np.column_stack([c.to_numpy(float) for c in columns]))
        total, scale = np.zeros(len(x)), 0.0
        for nodes in shared.value:
            scale += _expected(nodes[0][0]) or 1.0
            stack = [(0, np.arange(len(x)))]
            while stack:
                k, at = stack.pop()
                _, f, cut, left, right, _ = nodes[k]
                if not len(at):
                    continue
                if f < 0:
                    total[at] += right + _expected(left)  # a leaf holds its size and depth
                    continue
                below = x[at, f] < cut
                stack += [(left, at[below]), (right, at[~below])]
        return pd.Series(2.0 ** -(total / scale))

    return rows.withColumn(out, score(*[F.col(c).cast("double") for c in inputs]))


def contamination_cut(train_scores: DataFrame, fraud_share: float, score: str = "anomaly") -> float:
    """The anomaly score that a share of the training rows exceed: that of the labelled frauds, from 0.001 to 0.5."""
    share = min(max(float(fraud_share), 0.001), 0.5)
    kept = train_scores.where(F.col(score).isNotNull())
    n = kept.count()
    if not n:
        raise ValueError("no scores to take a cut from")
    place = (1 - share) * (n - 1)
    ranked = E.ranked_by(kept.select(F.col(score).alias("value")), [F.col("value")], "rank")
    found = {r["rank"] - 1: r["value"] for r in ranked.where(F.col("rank").isin(int(place) + 1, int(place) + 2)).collect()}
    low = found[int(place)]
    high = found.get(int(place) + 1, low)
    return low + (high - low) * (place - int(place))


def with_anomaly_flags(scored: DataFrame, train_scores: DataFrame, label: str = "label", score: str = "anomaly", out: str = "is_anomaly") -> DataFrame:
    """scored with whether the score is over the cut of the training rows, whose labels say how many are expected to be."""
    share = train_scores.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0
    return scored.withColumn(out, F.col(score) > contamination_cut(train_scores, share, score))


# --- explanations ----------------------------------------------------------------------------------------------------


def removal_contributions(model: PipelineModel | Column, rows: DataFrame, background: DataFrame, key: str, inputs: list[str]) -> DataFrame:
    """(key, feature, value, contribution, resulting_score, score): what each feature adds, by setting it to its mean.

    Rows times features are scored in one pass and stay in place: no shuffle but the join back on the key.
    """
    means = background.agg(*[F.avg(c).alias(f"__mean_{c}") for c in inputs])
    base = scored_by(model, rows.select(key, *inputs), "score").crossJoin(F.broadcast(means))
    spread = base.withColumn("feature", F.explode(F.array(*map(F.lit, inputs))))
    value: Column = F.coalesce(*[F.when(F.col("feature") == c, F.col(c).cast("double")) for c in inputs])
    changed = spread.withColumn("value", value).withColumns({c: F.when(F.col("feature") == c, F.col(f"__mean_{c}")).otherwise(F.col(c)) for c in inputs})
    again = scored_by(model, changed.select(key, "feature", "value", "score", *inputs), "resulting_score")
    return again.select(key, "feature", "value", (F.col("score") - F.col("resulting_score")).alias("contribution"), "resulting_score", "score")


def counterfactuals(contributions: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Single changes that take a row from the threshold to below it."""
    return contributions.where((F.col("score") >= threshold) & (F.col("resulting_score") < threshold))


def permutation_importance(model: PipelineModel | Column, rows: DataFrame, key: str, inputs: list[str], repeats: int = 5, seed: int = 42, label: str = "label") -> DataFrame:
    """(feature, importance, deviation): how much average precision falls when a feature is shuffled, over repeats.

    Over all rows. One seeded order of the keys per repeat serves all features: a row gets the value of the row that has
    its place there. The table is ordered once, its inputs once per repeat; features are spread only after the join.
    """
    whole = rows.select(F.col(key).alias("__key"), label, *inputs)

    def drawn(*parts: Column) -> Column:
        return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts, F.col("__key").cast("string")))

    again = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))
    there = E.ranked_by(whole, [drawn(F.lit("to")), F.col("__key")], "__place")
    dealt = whole.select("__key", *[F.col(c).cast("double").alias(f"__moved_{c}") for c in inputs]).withColumn("repeat", again)
    n = whole.count()
    other = E.ranked_by(dealt, [F.col("repeat"), drawn(F.col("repeat").cast("string")), F.col("__key")], "__place").drop("__key")
    placed = other.withColumn("__place", F.col("__place") - F.col("repeat") * F.lit(n))
    met = there.join(placed, "__place").withColumn("feature", F.explode(F.array(*map(F.lit, inputs))))
    moved = met.withColumns({c: F.when(F.col("feature") == c, F.col(f"__moved_{c}")).otherwise(F.col(c)) for c in inputs})
    everything = moved.select(label, *inputs, "feature", "repeat").unionByName(whole.drop("__key").withColumns({"feature": F.lit(""), "repeat": F.lit(0)}))
    area = E.average_precision(scored_by(model, everything), ["feature", "repeat"], label=label)
    base = area.where("feature = ''").select(F.col("average_precision").alias("base"))
    drop = area.where("feature <> ''").crossJoin(base).withColumn("drop", F.col("base") - F.col("average_precision"))
    return drop.groupBy("feature").agg(F.avg("drop").alias("importance"), F.stddev_pop("drop").alias("deviation"))


def tune(df: DataFrame, inputs: list[str], grid: list[dict], seed: int = 42, label: str = "label", key: str = "event_id") -> tuple[dict, list[tuple[dict, float]]]:
    """The parameters of a logistic regression with the best average precision on a stratified quarter, and all trials."""
    u = F.pmod(F.xxhash64(key, label, F.lit(seed)), F.lit(1000)) / 1000.0
    rows = df.withColumn("__u", u).persist()
    train, held = with_class_weights(rows.where("__u >= 0.25"), label), rows.where("__u < 0.25")
    trials = []
    for params in grid:
        stages = pipeline("logistic_regression", inputs, seed, label)
        stages.getStages()[-1].setParams(**params)
        value = E.average_precision(scored_by(stages.fit(train), held), label=label).first()[0]
        trials.append((params, float(value)))
    rows.unpersist()
    return max(trials, key=lambda t: t[1])[0], trials


#: What a search draws, by model: name, lowest, highest, and how.
SPACES = {
    "logistic_regression": (("C", 1e-3, 10.0, "log"),),
    "random_forest": (("numTrees", 25, 100, "int"), ("maxDepth", 2, 10, "int"), ("minInstancesPerNode", 1, 5, "int")),
}
#: Share of a trial's whole effort, Newton steps or trees, by rung; after each but the last, half of the trials go on.
RUNGS = (0.25, 0.5, 1.0)


def draw_trials(model: str, trials: int, seed: int = 42) -> list[dict]:
    """Parameters drawn within the model's space; the same for the same seed, and the first ones for fewer trials."""
    if model not in SPACES:
        raise ValueError(f"no search over {model}")
    if trials < 1:
        raise ValueError("a search needs a trial at least")
    rng = np.random.default_rng(seed)
    value = {"log": lambda a, b: float(np.exp(rng.uniform(np.log(a), np.log(b)))), "int": lambda a, b: int(rng.integers(a, b + 1))}
    return [{name: value[how](low, high) for name, low, high, how in SPACES[model]} for _ in range(trials)]


def search(df: DataFrame, inputs: list[str], model: str = "logistic_regression", trials: int = 10, seed: int = 42, steps: int = 12, label: str = "label", key: str = "event_id") -> tuple[dict, DataFrame]:
    """The drawn parameters with the best average precision on a stratified quarter, and a row per trial and rung: trial, params,
    rung, effort, average_precision, kept.

    Successive halving: all trials get a quarter of their effort, the better half a half, the best quarter all of it. Logistic
    regressions of a rung take their Newton steps together, each step in one pass over the rows, and go on where they were;
    the scores of a rung are judged together. Ties go to the trial drawn first.
    """
    drawn = draw_trials(model, trials, seed)
    u = F.pmod(F.xxhash64(key, label, F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
    rows = df.withColumn("__u", u).persist()
    train, held = with_class_weights(rows.where("__u >= 0.25"), label), rows.where("__u < 0.25").drop("__u")
    alive, betas, done, log = list(range(trials)), None, 0, []
    for rung, share in enumerate(RUNGS):
        if model == "logistic_regression":
            goal = max(1, round(steps * share))
            betas = fits.newton_steps(train, inputs, [1 / drawn[t]["C"] for t in alive], label, "weight", goal - done, betas)
            efforts, done = dict.fromkeys(alive, goal), goal
            found = F.array(*[F.struct(F.lit(t).alias("trial"), fits.logistic(b.tolist(), inputs).alias("score")) for t, b in zip(alive, betas, strict=True)])
            scores = held.select(label, F.explode(found).alias("f")).select(label, "f.trial", "f.score")
        else:
            efforts = {t: max(1, round(drawn[t]["numTrees"] * share)) for t in alive}
            tables = []
            for t in alive:
                stages = pipeline(model, inputs, seed, label, efforts[t])
                stages.getStages()[-1].setParams(**{k: v for k, v in drawn[t].items() if k != "numTrees"})
                tables.append(scored_by(stages.fit(train), held).select(label, F.lit(t).alias("trial"), "score"))
            scores = reduce(DataFrame.unionByName, tables)
        value = {r["trial"]: float(r["average_precision"]) for r in E.average_precision(scores, ["trial"], label=label).collect()}
        best = sorted(alive, key=lambda t: (-value[t], t))
        kept = sorted(best[: 1 if rung + 1 == len(RUNGS) else -(-len(best) // 2)])
        log += [(t, json.dumps(drawn[t], sort_keys=True), rung, efforts[t], value[t], t in kept) for t in alive]
        if betas is not None:
            betas = betas[[alive.index(t) for t in kept]]
        alive = kept
    rows.unpersist()
    table = df.sparkSession.createDataFrame(log, "trial int, params string, rung int, effort int, average_precision double, kept boolean")
    return drawn[alive[0]], table


def input_names(model: PipelineModel) -> list[str]:
    return list(next(s for s in model.stages if isinstance(s, VectorAssembler)).getInputCols())


def compatibility(model: PipelineModel, expected: list[str]) -> list[str]:
    """What keeps a model from serving these inputs in this order; empty if nothing does."""
    own = input_names(model)
    out = [f"missing: {c}" for c in expected if c not in own] + [f"unexpected: {c}" for c in own if c not in expected]
    return out or ([] if own == list(expected) else ["inputs are in another order"])


def metadata(df: DataFrame, seed: int, version: str) -> DataFrame:
    """One row on how a run can be repeated: versions, seed and the data's manifest."""
    from pyspark import __version__

    from riskweave.operators.drift import manifest

    return manifest(df, version, "run", "features-1").withColumns({"spark_version": F.lit(__version__), "numpy_version": F.lit(np.__version__), "seed": F.lit(seed)})


def research_run(df: DataFrame, inputs: list[str], thresholds: list[float] | None = None, names: tuple[str, ...] = ("logistic_regression", "random_forest"), resamples: int = 200, trees: int = 150) -> dict[str, DataFrame]:
    """Result tables of models on the test part: metrics with intervals of precision and recall, thresholds, reliability,
    errors, segments, and ablation over combinations of the models and the rules; each over all models at once."""
    grid = thresholds or [0.3, 0.4, 0.5, 0.6, 0.7]
    middle = grid[len(grid) // 2]
    models, metrics, skipped = train_baselines(df, inputs, names, threshold=middle, trees=trees)
    test = E.chronological_split(df, "us", "event_id").where("split = 'test'")
    scores = None
    for name, m in models.items():
        one = scored_by(m, test).withColumn("model", F.lit(name))
        scores = one if scores is None else scores.unionByName(one)
    scores = scores.persist()
    bounds = [E.bootstrap_metric(scores, "event_id", m, middle, resamples, by=["model"]) for m in ("precision", "recall")]
    first = next(iter(models))
    sources = scores.where(F.col("model") == first).withColumn("supervised", F.col("score"))
    available = ("supervised", "rules") if "rule_score" in df.columns else ("supervised",)
    if "rules" in available:
        sources = sources.withColumn("rules", F.col("rule_score"))
    combined, unmade = combination_scores(sources, "event_id", available)
    truth = sources.select(F.col("event_id").alias("__id"), "label", "transaction_amount")
    combined = combined.join(truth, F.col("event_id") == F.col("__id")).drop("__id")
    why = [(k, v) for k, v in (skipped | unmade).items()]
    return {
        "metrics": metrics,
        "intervals": bounds[0].unionByName(bounds[1]),
        "thresholds": E.threshold_metrics(scores, grid, ["model"], amount="transaction_amount"),
        "reliability": E.reliability(scores, by=["model"]),
        "errors": E.errors(scores, "event_id"),
        "segments": E.threshold_metrics(scores, middle, ["model", "country"], amount="transaction_amount"),
        "ablation": E.threshold_metrics(combined, middle, ["combination"], amount="transaction_amount").join(E.average_precision(combined, ["combination"]), "combination"),
        "skipped": df.sparkSession.createDataFrame(why, "name string, reason string"),
    }
