"""Entity risk profiles: enrichment, upserts, and the batch prediction job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.operators.decisions import Policy, fuse, merged_reasons
from riskweave.operators.features import rule_features
from riskweave.operators.messages import derived_id, prediction_id

KINDS = ("customer", "merchant", "device")


def build_profiles(history: DataFrame, label: str = "fraud_label", full: int = 100) -> DataFrame:
    """(entity_type, entity_id, risk_score, confidence, observations): fraud share per entity, surer with more rows.

    A row counts for three entities; partial sums come before the shuffle.
    """
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("entity_type"), F.col(f"{k}_id").alias("entity_id")) for k in KINDS])).alias("e")
    rows = history.select(kinds, F.col(label).alias("y")).select("e.*", "y")
    out = rows.groupBy("entity_type", "entity_id").agg(F.avg("y").alias("risk_score"), F.count("*").alias("observations"))
    return out.withColumn("confidence", F.least(F.lit(1.0), F.col("observations") / full))


def enrich(events: DataFrame, profiles: DataFrame) -> DataFrame:
    """events with score and confidence of each profile kind; a missing profile stays null, which is not zero."""
    out = events
    for k in KINDS:
        p = profiles.where(F.col("entity_type") == k).select(F.col("entity_id").alias(f"__{k}"), F.col("risk_score").alias(f"{k}_profile"), F.col("confidence").alias(f"{k}_profile_confidence"))
        out = out.join(p, F.col(f"{k}_id") == F.col(f"__{k}"), "left").drop(f"__{k}")
    return out


def new_events(events: DataFrame, scored: DataFrame, key: str = "event_id") -> tuple[DataFrame, DataFrame]:
    """Events without a prediction, and the predictions that stand for the others."""
    return events.join(scored.select(key), key, "left_anti"), scored.join(events.select(key), key, "left_semi")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], time: str = "updated_us") -> DataFrame:
    """Per key, for each column the latest value that isn't null; keys that are new come in."""
    values = [c for c in old.columns if c not in (*keys, time)]
    both = old.unionByName(new, allowMissingColumns=True)
    latest = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(time))).alias(c) for c in values]
    return both.groupBy(*keys).agg(*latest, F.max(time).alias(time))


def predict_batch(events: DataFrame, profiles: DataFrame, scored: DataFrame | None = None, weights: dict[str, float] | None = None, policy: Policy = Policy(), model_version: str = "rules-1") -> dict[str, DataFrame]:
    """Rows for the tables transactions, predictions, alerts and audits of events not scored before.

    Features look at all events, so a prediction is made with its customer's history.
    """
    rows = enrich(rule_features(events), profiles)
    if scored is not None:
        rows = rows.join(scored.select("event_id"), "event_id", "left_anti")
    rows = rows.withColumns({"supervised": F.lit(None).cast("double"), "anomaly": F.lit(None).cast("double"), "rules": F.col("rule_score")})
    done = fuse(rows, weights, policy).withColumn("model_version", F.lit(model_version))
    done = done.withColumn("prediction_id", prediction_id(F.col("event_id"), F.col("model_version")))
    done = done.withColumn("reason_codes", merged_reasons(F.col("reason_codes")))
    alerts = done.where(F.col("action").isin("review", "block"))
    return {
        "transactions": done.select(*events.columns),
        "predictions": done.select("prediction_id", "event_id", "transaction_id", "final_score", "confidence", "action", "risk_tier", "abstained", "reason_codes", "alert_priority", "model_version"),
        "alerts": alerts.select(derived_id(F.col("prediction_id"), "alert").alias("alert_id"), "prediction_id", "event_id", "transaction_id", "customer_id", "risk_tier", "action", "alert_priority", F.lit("open").alias("status")),
        "audits": done.select(derived_id(F.col("prediction_id"), "audit").alias("message_id"), "event_id", F.lit("predicted").alias("event_type"), F.col("action").alias("status")),
    }
