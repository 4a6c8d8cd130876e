"""Promotion gates and comparisons of model versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def promotion_checks(metrics: DataFrame, criteria: DataFrame) -> DataFrame:
    """(metric, observed, required, kind, passed) for criteria (metric, kind min or max, required); a missing metric fails."""
    m = metrics.select(F.col("metric").alias("__m"), F.col("value").alias("observed"))
    out = criteria.join(m, F.col("metric") == F.col("__m"), "left").drop("__m")
    fits = F.when(F.col("kind") == "min", F.col("observed") >= F.col("required")).otherwise(F.col("observed") <= F.col("required"))
    return out.select("metric", "observed", "required", "kind", F.coalesce(fits, F.lit(False)).alias("passed"))


def promotion_verdict(checks: DataFrame) -> DataFrame:
    """Approved if all checks passed, and so without any."""
    return checks.agg(F.coalesce(F.bool_and("passed"), F.lit(True)).alias("approved"), F.count("*").alias("checks"))


def metric_differences(candidate: DataFrame, current: DataFrame) -> DataFrame:
    """Candidate less current, for metrics that both have."""
    c = current.select("metric", F.col("value").alias("__current"))
    return candidate.join(c, "metric").select("metric", (F.col("value") - F.col("__current")).alias("difference"))
