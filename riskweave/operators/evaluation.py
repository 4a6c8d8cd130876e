"""Evaluation of scores against labels: metrics, curves, thresholds, costs, segments, intervals, errors."""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions.scalars import mask, ratio, unit_clip


@dataclass(frozen=True)
class Costs:
    false_positive: float = 3.0
    missed_per_amount: float = 1.0
    friction: float = 0.25
    blocking: float = 0.50
    recovered: float = 0.0

    def __post_init__(self):
        if min(self.false_positive, self.missed_per_amount, self.friction, self.blocking) < 0 or not 0 <= self.recovered <= 1:
            raise ValueError("costs must not be negative and the recovered share must be in [0, 1]")


def _cells(p: Column, y: Column, amount: Column, threshold: Column) -> dict[str, Column]:
    hit, fraud = p >= threshold, y == 1
    count = lambda c: F.count(F.when(c, 1))
    return {
        "tp": count(hit & fraud), "fp": count(hit & ~fraud), "fn": count(~hit & fraud), "tn": count(~hit & ~fraud),
        "detected_amount": F.coalesce(F.sum(F.when(hit & fraud, amount)), F.lit(0.0)), "missed_amount": F.coalesce(F.sum(F.when(~hit & fraud, amount)), F.lit(0.0)),
        "brier_score": F.avg(F.pow(unit_clip(p) - y, F.lit(2))),
    }


def _derived(df: DataFrame, costs: Costs) -> DataFrame:
    """Rates and costs from the cells of a confusion matrix; a rate over nothing is 0."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    beta = lambda b: ratio((1 + b * b) * tp, (1 + b * b) * tp + b * b * fn + fp)
    mcc = ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    alerts = tp + fp
    return df.withColumns(
        {
            "precision": ratio(tp, alerts), "recall": ratio(tp, tp + fn), "f1": beta(1.0), "f2": beta(2.0), "mcc": mcc,
            "specificity": ratio(tn, tn + fp), "false_positive_rate": ratio(fp, tn + fp), "false_negative_rate": ratio(fn, fn + tp),
            "alert_volume": F.col("tp") + F.col("fp"), "alert_rate": ratio(alerts, tp + fp + fn + tn),
            "expected_cost": fp * costs.false_positive + F.col("missed_amount") * costs.missed_per_amount * (1 - costs.recovered) + alerts * (costs.friction + costs.blocking),
        }
    )


def threshold_metrics(df: DataFrame, thresholds: list[float] | float, by: list[str] | None = None, score: str = "score", label: str = "label", amount: str = "transaction_amount", costs: Costs = Costs()) -> DataFrame:
    """A row per threshold (and group): confusion cells, precision, recall, F1, F2, MCC, rates, Brier score, amounts, cost.

    A row is an alert if its score reaches the threshold. All thresholds, a short list, are applied in one pass.
    """
    grid = [float(t) for t in (thresholds if isinstance(thresholds, list) else [thresholds])]
    # one set of partial aggregates per threshold beats a row per threshold: nothing is multiplied before the shuffle
    p, y, a = F.col(score), F.col(label), F.col(amount)
    per = [F.struct(F.lit(t).alias("threshold"), *[c.alias(n) for n, c in _cells(p, y, a, F.lit(t)).items()]) for t in grid]
    grouped = df.groupBy(*(by or [])).agg(F.array(*per).alias("__rows"))
    rows = grouped.select(*(by or []), F.explode("__rows").alias("r")).select(*(by or []), "r.*")
    return _derived(rows, costs)


def _curve(df: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """Per distinct score: positives and rows at it, and at or above it. Groups are windows over distinct scores, partially
    aggregated first."""
    points = df.groupBy(*by, F.col(score).alias("s")).agg(F.sum(label).alias("pos"), F.count("*").alias("n"))
    if by:
        down = Window.partitionBy(*by).orderBy(F.col("s").desc())
        return points.withColumns({"cum_pos": F.sum("pos").over(down), "cum_n": F.sum("n").over(down), "all_pos": F.sum("pos").over(Window.partitionBy(*by)), "all_n": F.sum("n").over(Window.partitionBy(*by))})
    return with_running_totals(points, F.col("s").desc(), {"cum_pos": "pos", "cum_n": "n"}, {"all_pos": "pos", "all_n": "n"})


def with_running_totals(df: DataFrame, order: Column, running: dict[str, str], totals: dict[str, str] | None = None) -> DataFrame:
    """Running sums over a global order without a window of one partition: rows are dealt by range, summed within each
    range, and shifted by the totals of the ranges before, of which there are as many as partitions."""
    from riskweave.sources.files import checkpointed

    # the split must not move between the two uses
    dealt = checkpointed(df.repartitionByRange(order).withColumn("__part", F.spark_partition_id()))
    sums = dealt.groupBy("__part").agg(*[F.sum(c).alias(f"__{k}") for k, c in running.items()])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sums.select(F.col("__part").alias("__p"), *[F.coalesce(F.sum(f"__{k}").over(before), F.lit(0)).alias(f"__{k}") for k in running])
    inside = Window.partitionBy("__part").orderBy(order)
    out = dealt.join(F.broadcast(shift), F.col("__part") == F.col("__p"))
    out = out.withColumns({k: F.sum(c).over(inside) + F.col(f"__{k}") for k, c in running.items()})
    if totals:
        whole = dealt.agg(*[F.sum(c).alias(k) for k, c in totals.items()])
        out = out.crossJoin(F.broadcast(whole))  # one row
    return out.drop("__part", "__p", *[f"__{k}" for k in running])


def with_running_maximum(df: DataFrame, order: Column, value: str, name: str) -> DataFrame:
    """df with the largest value so far in a global order, the row's own included; by ranges, as with_running_totals."""
    from riskweave.sources.files import checkpointed

    dealt = checkpointed(df.repartitionByRange(order).withColumn("__part", F.spark_partition_id()))
    tops = dealt.groupBy("__part").agg(F.max(value).alias("__top"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = tops.select(F.col("__part").alias("__p"), F.max("__top").over(before).alias("__before"))
    out = dealt.join(F.broadcast(shift), F.col("__part") == F.col("__p"))  # a row per partition
    inside = Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn(name, F.greatest(F.max(value).over(inside), F.col("__before"))).drop("__part", "__p", "__before")


def average_precision(df: DataFrame, by: list[str] | None = None, score: str = "score", label: str = "label") -> DataFrame:
    """Step-wise area under precision and recall over the distinct scores; 0 without positives."""
    c = _curve(df, by or [], score, label)
    area = F.sum(ratio(F.col("pos"), F.col("all_pos")) * F.col("cum_pos") / F.col("cum_n"))
    return c.groupBy(*(by or [])).agg(area.alias("average_precision"))


def roc_auc(df: DataFrame, by: list[str] | None = None, score: str = "score", label: str = "label") -> DataFrame:
    """Chance that a positive outscores a negative, ties half; null with a single class."""
    c = _curve(df, by or [], score, label)
    neg, above = F.col("n") - F.col("pos"), F.col("cum_pos") - F.col("pos")
    pairs = F.sum(neg * (above + F.col("pos") / 2))
    both = F.first("all_pos") * (F.first("all_n") - F.first("all_pos"))
    return c.groupBy(*(by or [])).agg(F.try_divide(pairs, both.cast("double")).alias("roc_auc"))


def recall_at_precision(df: DataFrame, least: float = 0.80, score: str = "score", label: str = "label") -> DataFrame:
    """The best recall among thresholds at distinct scores whose precision reaches `least`; 0 if none does."""
    c = _curve(df, [], score, label)
    good = F.when(F.col("cum_pos") / F.col("cum_n") >= least, ratio(F.col("cum_pos"), F.col("all_pos")))
    return c.agg(F.coalesce(F.max(good), F.lit(0.0)).alias("recall_at_precision"))


def top_k_metrics(df: DataFrame, key: str, share: float = 0.01, score: str = "score", label: str = "label") -> DataFrame:
    """Precision and recall among the k best scores; k is the share of rows, half-even, 1 at least; ties go by key."""
    n, positives = df.agg(F.count("*"), F.sum(label)).first()
    k = max(1, round((n or 0) * share))
    top = df.orderBy(F.col(score).desc(), key).limit(k)
    hits = F.coalesce(F.sum(label), F.lit(0))
    return top.agg(F.lit(k).cast("long").alias("k"), (hits / k).cast("double").alias("precision_at_k"), ratio(hits, F.lit(positives or 0)).alias("recall_at_k"))


def reliability(df: DataFrame, bins: int = 10, by: list[str] | None = None, score: str = "score", label: str = "label") -> DataFrame:
    """Per equal-width bin of probabilities that has rows: its edges, count, mean probability and observed rate."""
    p = unit_clip(F.col(score))
    edges = F.array(*[F.lit(i / bins) for i in range(bins + 1)])
    # the edges themselves are compared, as rounding may put p * bins on the wrong side of one
    at = F.least(F.size(F.filter(edges, lambda e: e <= p)) - 1, F.lit(bins - 1))
    binned = df.withColumn("__p", p).withColumn("bin", at.cast("int"))
    out = binned.groupBy(*(by or []), "bin").agg(F.count("*").alias("count"), F.avg("__p").alias("mean_probability"), F.avg(label).alias("observed_rate"))
    return out.select(*(by or []), "bin", (F.col("bin") / bins).alias("lower"), ((F.col("bin") + 1) / bins).alias("upper"), "count", "mean_probability", "observed_rate")


def calibration_report(df: DataFrame, bins: int = 10, max_brier: float = 0.25, max_error: float = 0.10, score: str = "score", label: str = "label") -> DataFrame:
    """One row: Brier score, expected calibration error (null with a single class), and whether both are within limits."""
    r = reliability(df, bins, None, score, label)
    whole = r.agg(
        F.sum("count").alias("n"), F.sum(F.col("count") * F.abs(F.col("mean_probability") - F.col("observed_rate"))).alias("gap"), F.sum(F.col("count") * F.col("observed_rate")).alias("pos")
    )
    error = F.when((F.col("pos") > 0) & (F.col("pos") < F.col("n")), F.col("gap") / F.col("n"))
    brier = df.agg(F.avg(F.pow(unit_clip(F.col(score)) - F.col(label), F.lit(2))).alias("brier_score"))
    out = brier.crossJoin(whole).select("n", "brier_score", error.alias("expected_calibration_error"))
    return out.withColumn("passed", F.coalesce((F.col("brier_score") <= max_brier) & (F.col("expected_calibration_error") <= max_error), F.lit(False)))


def intervention_cost(df: DataFrame, chosen: str, label: str = "label", amount: str = "transaction_amount", costs: Costs = Costs()) -> DataFrame:
    """Expected cost of a yes-or-no intervention column."""
    hit, fraud = F.col(chosen).cast("boolean"), F.col(label) == 1
    cost = (
        F.count(F.when(hit & ~fraud, 1)) * costs.false_positive
        + F.coalesce(F.sum(F.when(~hit & fraud, F.col(amount))), F.lit(0.0)) * costs.missed_per_amount * (1 - costs.recovered)
        + F.count(F.when(hit, 1)) * (costs.friction + costs.blocking)
    )
    return df.agg(cost.cast("double").alias("expected_cost"))


def best_threshold(df: DataFrame, costs: Costs = Costs(), max_alerts: int | None = None, candidates: list[float] | None = None, score: str = "score", label: str = "label", amount: str = "transaction_amount") -> DataFrame:
    """The threshold with the least cost, then the fewest alerts, then the lowest: one row, none if no threshold keeps
    within max_alerts.

    Candidates are 201 even steps, every distinct score and those given. Rows are summed per score; running totals from
    above then price every candidate at once.
    """
    p = unit_clip(F.col(score))
    spark = df.sparkSession
    grid = spark.createDataFrame([(i / 200,) for i in range(201)] + [(float(c),) for c in candidates or []], "s double")
    points = df.groupBy(p.alias("s")).agg(F.sum(label).alias("pos"), F.count("*").alias("n"), F.sum(F.when(F.col(label) == 1, F.col(amount)).otherwise(0.0)).alias("fraud_amount"))
    none = [F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("fraud_amount")]
    every = points.unionByName(grid.select("s", *none)).groupBy("s").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"), F.sum("fraud_amount").alias("fraud_amount"))
    run = with_running_totals(every, F.col("s").desc(), {"cum_pos": "pos", "cum_n": "n", "detected": "fraud_amount"}, {"all_amount": "fraud_amount"})
    alerts, missed = F.col("cum_n"), F.col("all_amount") - F.col("detected")
    cost = (alerts - F.col("cum_pos")) * costs.false_positive + missed * costs.missed_per_amount * (1 - costs.recovered) + alerts * (costs.friction + costs.blocking)
    # costs that differ by rounding only are equal
    rows = run.select(F.round(cost, 6).alias("expected_cost"), alerts.alias("alert_count"), F.col("s").alias("threshold"), F.col("detected").alias("fraud_detected_amount"), missed.alias("fraud_missed_amount"))
    kept = rows if max_alerts is None else rows.where(F.col("alert_count") <= max_alerts)
    best = kept.agg(F.min(F.struct("expected_cost", "alert_count", "threshold", "fraud_detected_amount", "fraud_missed_amount")).alias("b")).where("b is not null")
    return best.select("b.threshold", "b.expected_cost", "b.alert_count", "b.fraud_detected_amount", "b.fraud_missed_amount")


def segment_metrics(df: DataFrame, segment: str, threshold: float = 0.5, least_rows: int = 30, costs: Costs = Costs(), **columns: str) -> DataFrame:
    """Threshold metrics per value of a column, null included, for values with enough rows; identifiers are masked."""
    out = threshold_metrics(df, threshold, [segment], costs=costs, **columns).where(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn") >= least_rows)
    shown = mask(segment) if segment.endswith("_id") else F.col(segment).cast("string")
    return out.withColumn("segment_column", F.lit(segment)).withColumn("segment", shown).drop(*({segment} - {"segment"}))


def errors(df: DataFrame, key: str, threshold: float = 0.5, n: int = 25, score: str = "score", label: str = "label", masked: tuple[str, ...] = ("transaction_id", "customer_id", "merchant_id", "device_id")) -> DataFrame:
    """The n wrong predictions furthest from a half; ties go by key; identifiers are masked."""
    p = F.col(score)
    wrong = df.where((p >= threshold).cast("int") != F.col(label)).orderBy(F.abs(p - 0.5).desc(), key).limit(n)
    kind = F.when(p >= threshold, "false_positive").otherwise("false_negative")
    own = [F.col(key)] if key not in masked else []
    return wrong.select(*own, kind.alias("error_type"), p.alias("probability"), F.col(label).alias("fraud_label"), "transaction_amount", *[mask(c).alias(c) for c in masked if c in df.columns])


#: Numbers below this prime stand for keys and replicates.
PRIME = 2_147_483_647


def small_hash(text: Column) -> Column:
    """A number below PRIME from the first 13 digits of a text's MD5, which other engines have too."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") % PRIME


def replicates(resamples: int, seed: int = 42) -> Column:
    """An array of (b, factor): the replicates from 1 and the numbers that stand for them."""
    return F.transform(F.sequence(F.lit(1), F.lit(resamples)), lambda b: F.struct(b.alias("b"), (small_hash(F.concat_ws("|", b.cast("string"), F.lit(str(seed)))) + 1).alias("factor")))


def poisson_weight(key: Column, factor: Column) -> Column:
    """How often a row is in a bootstrap replicate: a Poisson(1) count, fixed by the key's small_hash and the replicate's factor."""
    u = ((key * factor % PRIME).cast("double") + 0.5) / float(PRIME)
    out = F.lit(0)
    for total in poisson_steps():
        out = out + F.when(u > total, 1).otherwise(0)
    return out


def poisson_steps() -> list[float]:
    """The chances of at most 0, 1, ..., 11 under Poisson(1); a weight is how many of them a uniform number exceeds."""
    total, term, out = 0.0, 1.0, []
    for k in range(12):
        total += term * math.exp(-1)
        out.append(total)
        term /= k + 1
    return out


def _replicated(df: DataFrame, key: str, resamples: int, seed: int, *columns: Column) -> DataFrame:
    """columns with `b` and the weight `w` of each row in each replicate; rows of weight 0 go. Rows multiply within a task, and
    what follows sums them there: nothing but a row per replicate and task is shuffled."""
    hashed = df.select(*columns, small_hash(F.col(key).cast("string")).alias("__key"))
    spread = hashed.select("*", F.explode(replicates(resamples, seed)).alias("__r")).withColumns({"b": F.col("__r.b"), "w": poisson_weight(F.col("__key"), F.col("__r.factor"))})
    return spread.where("w > 0").drop("__key", "__r")


def _replicate_sums(df: DataFrame, key: str, resamples: int, seed: int, values: dict[str, Column]) -> DataFrame:
    """(b, values...): per replicate the sums of columns of numbers, none null, each row as often as its weight says. The weights
    are those of _replicated, but no row is multiplied: a task adds up its rows for all replicates, batch by batch."""
    factors = [int(hashlib.md5(f"{b}|{seed}".encode()).hexdigest()[:13], 16) % PRIME + 1 for b in range(1, resamples + 1)]
    steps = poisson_steps()
    rows = df.select(small_hash(F.col(key).cast("string")).alias("__key"), *[v.cast("double").alias(k) for k, v in values.items()])
    names = list(values)

    def sums(batches):
        total = np.zeros((len(names), len(factors)))
        for batch in batches:
            keys, columns = batch["__key"].to_numpy(), np.stack([batch[c].to_numpy() for c in names])
            for b, factor in enumerate(factors):
                weights = np.searchsorted(steps, (keys * factor % PRIME + 0.5) / float(PRIME))
                total[:, b] += columns @ weights.astype(float)
        yield pa.RecordBatch.from_arrays([pa.array(range(1, len(factors) + 1), pa.int32()), *map(pa.array, total)], ["b", *names])

    parts = rows.where("__key is not null").mapInArrow(sums, "b int, " + ", ".join(f"{c} double" for c in names))
    return parts.groupBy("b").agg(*[F.sum(c).alias(c) for c in names])


def bootstrap_mean(df: DataFrame, key: str, value: str, resamples: int = 200, level: float = 0.95, seed: int = 42) -> DataFrame:
    """Percentile interval of a mean. Each task weighs its rows for all replicates and sends one sum for each."""
    estimate = df.agg(F.avg(value).alias("estimate"))
    if resamples < 1:
        return estimate.select("estimate", F.col("estimate").alias("low"), F.col("estimate").alias("high"))
    sums = _replicate_sums(df, key, resamples, seed, {"v": F.coalesce(F.col(value).cast("double"), F.lit(0.0)), "n": F.lit(1.0)})
    stats = sums.select(ratio(F.col("v"), F.col("n")).alias("stat"))
    return _interval(stats, level).crossJoin(estimate).select("estimate", "low", "high")


def bootstrap_metric(df: DataFrame, key: str, metric: str = "recall", threshold: float = 0.5, resamples: int = 200, level: float = 0.95, seed: int = 42, score: str = "score", label: str = "label", by: list[str] | None = None) -> DataFrame:
    """Percentile interval of a rate of the confusion matrix over replicates of whole rows, per group if asked: any of RATES."""
    if metric not in RATES:
        raise ValueError(f"metric must be one of {sorted(RATES)}")
    hit, fraud = F.col(score) >= threshold, F.col(label) == 1
    by = by or []
    cells = {"tp": hit & fraud, "fp": hit & ~fraud, "fn": ~hit & fraud, "tn": ~hit & ~fraud}
    if not by:
        sums = _replicate_sums(df, key, resamples, seed, {k: F.when(c, 1.0).otherwise(0.0) for k, c in cells.items()})
        return _interval(sums.select(RATES[metric](*(F.col(c) for c in cells)).alias("stat")), level).select(F.lit(metric).alias("metric"), "low", "high")
    reps = _replicated(df, key, resamples, seed, hit.alias("hit"), fraud.alias("fraud"), *map(F.col, by))
    cell = lambda c: F.coalesce(F.sum(F.when(c, F.col("w"))), F.lit(0))
    h, f = F.col("hit"), F.col("fraud")
    sums = reps.groupBy(*by, "b").agg(cell(h & f).alias("tp"), cell(h & ~f).alias("fp"), cell(~h & f).alias("fn"), cell(~h & ~f).alias("tn"))
    stat = RATES[metric](*(F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn")))
    return _interval(sums.select(*by, stat.alias("stat")), level, by).select(*by, F.lit(metric).alias("metric"), "low", "high")


#: Rates of a confusion matrix; over nothing they are 0.
RATES = {
    "recall": lambda tp, fp, fn, tn: ratio(tp, tp + fn),
    "precision": lambda tp, fp, fn, tn: ratio(tp, tp + fp),
    "alert_rate": lambda tp, fp, fn, tn: ratio(tp + fp, tp + fp + fn + tn),
    "f1": lambda tp, fp, fn, tn: ratio(2 * tp, 2 * tp + fn + fp),
    "f2": lambda tp, fp, fn, tn: ratio(5 * tp, 5 * tp + 4 * fn + fp),
    "specificity": lambda tp, fp, fn, tn: ratio(tn, tn + fp),
    "false_positive_rate": lambda tp, fp, fn, tn: ratio(fp, tn + fp),
    "false_negative_rate": lambda tp, fp, fn, tn: ratio(fn, fn + tp),
    "accuracy": lambda tp, fp, fn, tn: ratio(tp + tn, tp + fp + fn + tn),
    "mcc": lambda tp, fp, fn, tn: ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
}


def _interval(stats: DataFrame, level: float, by: list[str] | None = None) -> DataFrame:
    alpha = (1 - level) / 2
    return stats.groupBy(*(by or [])).agg(F.percentile("stat", alpha).alias("low"), F.percentile("stat", 1 - alpha).alias("high"))


def positive_rate(df: DataFrame, label: str = "label") -> DataFrame:
    return df.agg(F.avg(label).alias("positive_rate"))


def prior_scores(train: DataFrame, rows: DataFrame, label: str = "label") -> DataFrame:
    """rows with the training share of positives as their constant score."""
    return rows.crossJoin(F.broadcast(train.agg(F.avg(label).alias("score"))))


def min_max(rows: DataFrame, reference: DataFrame, value: str, out: str) -> DataFrame:
    """rows with a value scaled by the reference's range and cut to [0, 1]; a constant reference gives a half."""
    r = reference.agg(F.min(value).alias("__low"), F.max(value).alias("__high"))
    scaled = unit_clip(F.try_divide(F.col(value) - F.col("__low"), F.col("__high") - F.col("__low")))
    return rows.crossJoin(F.broadcast(r)).withColumn(out, F.coalesce(scaled, F.lit(0.5))).drop("__low", "__high")


def latency_summary(samples: DataFrame, value: str, wall_seconds: float | None = None) -> DataFrame:
    """Count, minimum, mean, median, nearest-rank p95 and p99, and throughput of latencies in seconds."""
    n = samples.agg(F.count(value).alias("n")).first()["n"]
    if not n:
        raise ValueError("no samples")
    ranks = {"p95": round((n - 1) * 0.95), "p99": round((n - 1) * 0.99)}
    run = with_running_totals(samples.select(F.col(value).alias("v")).groupBy("v").agg(F.count("*").alias("n")), F.col("v"), {"upto": "n"})
    ranks |= {"__low": (n - 1) // 2, "__high": n // 2}
    at = {k: F.min(F.when(F.col("upto") > r, F.col("v"))).alias(k) for k, r in ranks.items()}
    quick = samples.agg(F.count(value).alias("samples"), F.min(value).alias("minimum"), F.avg(value).alias("mean"), F.sum(value).alias("__sum"))
    wall = F.lit(wall_seconds) if wall_seconds else F.col("__sum")
    out = quick.crossJoin(run.agg(*at.values())).withColumns({"median": (F.col("__low") + F.col("__high")) / 2, "throughput": F.try_divide(F.col("samples").cast("double"), wall)})
    return out.select("samples", "minimum", "mean", "median", "p95", "p99", "throughput")


def chronological_split(df: DataFrame, time: str, tie: str, train: float = 0.70, validation: float = 0.15) -> DataFrame:
    """df with `split`, by rank in time: train, then validation, then test; train and test have a row at least.

    Ranks are global but no task sees all rows: they are counted within ranges of time and shifted. Fewer than three rows
    and null times are errors.
    """
    n, nulls = df.agg(F.count("*"), F.count(F.when(F.col(time).isNull(), 1))).first()
    if n < 3 or nulls:
        raise ValueError("a split needs three rows at least and a time in each")
    first = max(1, int(n * train))
    second = min(max(first + 1, int(n * (train + validation))), n - 1)
    ranked = ranked_by(df, [F.col(time), F.col(tie)], "__rank")
    return ranked.withColumn("split", F.when(F.col("__rank") <= first, "train").when(F.col("__rank") <= second, "validation").otherwise("test")).drop("__rank")


def ranked_by(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with its place in a global order, from 1."""
    from riskweave.sources.files import checkpointed

    dealt = checkpointed(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    out = dealt.join(F.broadcast(shift), F.col("__part") == F.col("__p"))
    return out.withColumn(name, F.row_number().over(Window.partitionBy("__part").orderBy(*order)) + F.col("__shift")).drop("__part", "__p", "__shift")


def split_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("rows"))
