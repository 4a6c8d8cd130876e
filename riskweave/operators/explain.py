"""Reasons and explanations from feature contributions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

#: What a contribution says, as (features, least value, greatest value, code, message).
REASONS = [
    (("amount_z_score",), 3.0, None, "unusually_high_transaction_amount", "Unusually high transaction amount"),
    (("transaction_amount",), 2000.0, None, "unusually_high_transaction_amount", "Unusually high transaction amount"),
    (("amount_log1p",), math.log1p(2000), None, "unusually_high_transaction_amount", "Unusually high transaction amount"),
    (("device_novelty",), 1.0, None, "first_transaction_from_device", "First transaction from this device"),
    (("impossible_travel",), None, None, "geographically_impossible_travel", "Geographically impossible travel"),
    (("geographic_velocity_kmh",), 900.0, None, "geographically_impossible_travel", "Geographically impossible travel"),
    (("recent_transaction_count_10m", "recent_transaction_count_1h", "recent_transaction_count_24h"), 5.0, None, "excessive_recent_transaction_velocity", "Excessive recent transaction velocity"),
    (("merchant_novelty",), 1.0, None, "new_merchant_for_customer", "New merchant for this customer"),
    (("country_novelty",), 1.0, None, "new_country_for_customer", "New country for this customer"),
    (("merchant_category_novelty",), 1.0, None, "new_merchant_category", "New merchant category for this customer"),
    (("decline_rate_prior", "failed_transaction_rate_prior"), 0.5, None, "prior_payment_failures", "High prior payment-failure rate"),
    (("is_cash_withdrawal",), 1.0, None, "cash_withdrawal_risk", "Cash withdrawal requires additional review"),
    (("customer_seconds_since_previous",), 0.0, 60.0, "rapid_repeat_transaction", "Rapid repeat transaction"),
]


def _reason(which: int) -> Column:
    """Code (3) or message (4) of a contribution that raises the risk; null if it says nothing."""
    out = F.lit(None).cast("string")
    f, v = F.lower("feature"), F.col("value")
    for names, low, high, *texts in reversed(REASONS):
        fits = f.isin(*names)
        fits = fits & (v >= low) if low is not None else fits
        fits = fits & (v <= high) if high is not None else fits
        out = F.when(fits, texts[which - 3]).otherwise(out)
    return F.when(F.col("contribution") > 0, out)


def with_reasons(contributions: DataFrame) -> DataFrame:
    return contributions.withColumns({"code": _reason(3), "message": _reason(4)})


def top_reasons(contributions: DataFrame, key: str, n: int = 3) -> DataFrame:
    """The n distinct codes of each row with the largest contributions: (key, rank, code, message, feature, contribution)."""
    named = with_reasons(contributions).where("code is not null")
    best = named.groupBy(key, "code").agg(F.max(F.struct("contribution", F.struct((-F.xxhash64("feature")).alias("h"), "feature", "message").alias("f"))).alias("b"))
    rows = best.select(key, "code", F.col("b.f.message").alias("message"), F.col("b.f.feature").alias("feature"), F.col("b.contribution").alias("contribution"))
    order = Window.partitionBy(key).orderBy(F.col("contribution").desc(), "code")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def top_contributions(contributions: DataFrame, key: str, n: int = 8) -> DataFrame:
    """Each row's n contributions of largest size, in order."""
    order = Window.partitionBy(key).orderBy(F.abs("contribution").desc(), "feature")
    return contributions.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def importance_ranks(importances: DataFrame) -> DataFrame:
    """(feature, importance, rank) by size; a row per feature, so one task holds them."""
    return importances.withColumn("rank", F.row_number().over(Window.orderBy(F.abs("importance").desc(), "feature")))


def lowest_counterfactuals(candidates: DataFrame, key: str, n: int = 3) -> DataFrame:
    order = Window.partitionBy(key).orderBy("resulting_score", "feature")
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def agreement(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Per key, the share of features, of either explanation, on whose sign both agree."""
    a = first.select(key, "feature", F.signum("contribution").alias("a"))
    b = second.select(key, "feature", F.signum("contribution").alias("b"))
    both = a.join(b, [key, "feature"], "full")
    return both.groupBy(key).agg((F.count(F.when(F.col("a") == F.col("b"), 1)) / F.count("*")).alias("agreement"))


def summary_sentence(probability: Column, messages: Column) -> Column:
    return F.format_string("Risk probability %.3f. Key indicators: %s.", probability, F.array_join(messages, "; "))


def background_means(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the mean of each numeric column, which stands for "not known" in explanations by removal."""
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)}
    return df.agg(*[F.avg(c).alias(c) for c in columns if c in numeric])


def against_background(rows: DataFrame, background: DataFrame, column: str) -> DataFrame:
    """rows with one column set to its background mean; a column without one keeps its values."""
    if column not in background.columns:
        return rows
    mean = background.select(F.col(column).alias("__mean"))
    return rows.crossJoin(F.broadcast(mean)).withColumn(column, F.col("__mean")).drop("__mean")  # one row
