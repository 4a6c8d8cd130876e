"""Messages of the log: topics, keys, ids, envelopes, contracts, dead letters, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions.scalars import uuid5
from riskweave.operators.decisions import Policy

#: Versions that messages carry.
SCHEMA_VERSION = "phase6-v1"
VALIDATION_VERSION = "phase2-validation-v1"
#: Topics and what keys their messages.
TOPICS = {
    "transactions": "customer_id", "validated_transactions": "customer_id", "predictions": "customer_id", "alerts": "customer_id", "feedback": "transaction_id",
    "audit": "event_id_or_message_id", "dead_letter": "original_key_or_message_id",
}
PAYLOAD_LIMIT, ERROR_LIMIT = 1_000_000, 2_000

#: Fields of the transaction contract and their types.
EVENT = {
    **dict.fromkeys(("transaction_id", "event_id", "customer_id", "account_id", "card_id", "merchant_id", "merchant_category"), "string"), "transaction_amount": "double",
    **dict.fromkeys(("currency", "transaction_type", "channel", "timestamp", "ingestion_timestamp", "country", "city"), "string"), "latitude": "double", "longitude": "double",
    **dict.fromkeys(("device_id", "ip_address"), "string"), "card_present": "boolean", **dict.fromkeys(("authentication_method", "transaction_status"), "string"), "event_version": "bigint",
}
_EVENT = "struct<" + ",".join(f"{n}:{t}" for n, t in EVENT.items()) + ">"
_BASE = dict.fromkeys(("message_id", "schema_version", "produced_at", "correlation_id"), "string")
_IDS = dict.fromkeys(("event_id", "transaction_id"), "string")
_DECISION = "struct<calibrated_probability:double,confidence:double,abstained:boolean,risk_tier:string,action:string,review_threshold:double,block_threshold:double,policy_version:string,model_version:string,calibration_version:string,reason_codes:array<string>>"
#: Per topic, the fields of its messages and their types.
CONTRACTS = {
    "transactions": {**_BASE, "event": _EVENT},
    "validated_transactions": {**_BASE, "validation_version": "string", "event": _EVENT},
    "predictions": {
        **_BASE, **_IDS, "customer_id": "string", "features": "map<string,double>", **dict.fromkeys(("model_probability", "calibrated_probability", "anomaly_score", "rule_score", "confidence"), "double"),
        **dict.fromkeys(("model_version", "calibration_version", "feature_version"), "string"), "explanation": "map<string,string>",
    },
    "alerts": {**_BASE, **_IDS, "customer_id": "string", "decision": _DECISION, "prediction_message_id": "string", "reason_codes": "array<string>", "explanation": "map<string,string>"},
    "feedback": {**_BASE, **_IDS, **dict.fromkeys(("analyst_id", "outcome", "note"), "string")},
    "audit": {**_BASE, **dict.fromkeys(("event_type", "status", "source_topic"), "string"), **_IDS, "details": "map<string,string>"},
    "dead_letter": {
        **_BASE, "original_topic": "string", "original_partition": "int", "original_offset": "bigint", **dict.fromkeys(("original_key", "raw_payload", "error_type", "error_message"), "string"), "attempts": "int", "failed_at": "string",
    },
}
OUTCOMES = ("confirmed_fraud", "not_fraud", "escalated", "no_action")
_JSON = {"ignoreNullFields": "false"}


def schema_of(topic: str) -> str:
    """The schema of a topic's messages, as DDL."""
    return ", ".join(f"{n} {t}" for n, t in CONTRACTS[check_topic(topic)].items())


def check_topic(topic: str) -> str:
    if topic not in TOPICS:
        raise ValueError(f"unknown topic: {topic}")
    return topic


def topic_catalog(spark: SparkSession, partitions: int = 6, replication: int = 1) -> DataFrame:
    return spark.createDataFrame([(t, partitions, replication, k) for t, k in TOPICS.items()], "topic string, partitions int, replication_factor int, key_strategy string")


def message_key(topic: Column | str, customer_id: Column, transaction_id: Column, event_id: Column, original_key: Column, message_id: Column) -> Column:
    """The business key of a message on a topic; its id where the key is missing or empty."""
    t = F.lit(topic) if isinstance(topic, str) else topic
    by = {"feedback": transaction_id, "audit": event_id, "dead_letter": original_key}
    own = F.when(t.isin("transactions", "validated_transactions", "predictions", "alerts"), customer_id)
    for name, c in by.items():
        own = own.when(t == name, c)
    return F.coalesce(F.nullif(own, F.lit("")), message_id)


def partition_for(key: Column, partitions: int) -> Column:
    """A stable partition of a key; null for an empty one."""
    if partitions < 1:
        raise ValueError("there must be a partition")
    return F.when(key != "", F.pmod(F.crc32(F.encode(key, "UTF-8")), F.lit(partitions)).cast("int"))


def encode_message(struct: Column, topic: str) -> Column:
    """A message as JSON with its fields by name and nulls kept."""
    names = sorted(CONTRACTS[check_topic(topic)])
    return F.to_json(F.struct(*[struct[n].alias(n) for n in names]), _JSON)


def decode_message(value: Column, topic: str) -> Column:
    """A message of a topic from JSON; null if it isn't an object, or its version is another."""
    read = F.from_json(value, schema_of(topic))
    return F.when(value.rlike(r"^\s*\{") & (read["schema_version"] == SCHEMA_VERSION), read)


def sink_frame(df: DataFrame, topic: str) -> DataFrame:
    return df.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), F.lit(check_topic(topic)).alias("topic"))


def envelope(df: DataFrame, message_id: Column, produced_at: Column, correlation_id: Column | None = None, version: str | None = None) -> DataFrame:
    """(key, value) of transactions wrapped for the log; with a version, as validated ones."""
    event = F.struct(*[F.col(n).cast(t).alias(n) for n, t in EVENT.items()])
    fields = [message_id.alias("message_id"), F.lit(SCHEMA_VERSION).alias("schema_version"), produced_at.alias("produced_at"), (correlation_id if correlation_id is not None else F.lit(None).cast("string")).alias("correlation_id")]
    if version:
        fields.append(F.lit(version).alias("validation_version"))
    return df.select(F.col("customer_id").alias("key"), F.to_json(F.struct(*fields, event.alias("event")), _JSON).alias("value"))


def parsed(log: DataFrame) -> DataFrame:
    """The log's records flattened: envelope, event fields, source position, and `validation_error`, null for valid rows.

    One pass of native predicates; currency and country come out in upper case, times as timestamps.
    """
    from riskweave.operators.contracts import contract_violations, normalised, unknown_fields

    text = F.col("value").cast("string")
    rows = log.select(F.col("key").cast("string").alias("source_key"), text.alias("raw"), F.col("topic").alias("source_topic"), F.col("partition").alias("source_partition"), F.col("offset").alias("source_offset"))
    read = F.struct(F.from_json("raw", schema_of("validated_transactions")).alias("m"), F.get_json_object("raw", "$.event").alias("event_json"))
    # in tables a generator of one row keeps what it makes: as plain columns, each use of a field would parse the text again.
    # Streams keep the plain columns: with the generator their plans took minutes
    rows = rows.select("*", read.alias("read") if log.isStreaming else F.explode(F.array(read)).alias("read")).select("*", "read.m", "read.event_json").drop("read")
    flat = rows.select("*", "m.message_id", "m.schema_version", "m.produced_at", "m.correlation_id", "m.event.*").drop("m")
    flat = flat.withColumn("event_time", F.try_to_timestamp("timestamp")).withColumn("ingestion_time", F.try_to_timestamp("ingestion_timestamp"))
    zoned = r"(Z|[+-]\d{2}:?\d{2})$"
    flat = flat.withColumn("violations", contract_violations([*EVENT, "event_time", "ingestion_time"])).withColumn("unknown", unknown_fields(F.col("event_json"), list(EVENT)))
    error = F.coalesce(
        F.when(F.col("raw").isNull() | (F.trim("raw") == ""), "empty payload"),
        F.when(F.col("event_json").isNull(), "malformed envelope"),
        F.when(F.col("schema_version").isNull() | (F.col("schema_version") != SCHEMA_VERSION), "unsupported schema version"),
        F.when(F.col("produced_at").isNull() | ~F.col("produced_at").rlike(zoned), "produced_at needs a zone"),
        F.when(~F.coalesce(F.col("timestamp").rlike(zoned) & F.col("ingestion_timestamp").rlike(zoned), F.lit(False)), "times need a zone"),
        F.when(F.size("unknown") > 0, F.concat(F.lit("unknown fields: "), F.array_join("unknown", ","))),
        F.when(F.size("violations") > 0, F.array_join("violations", ",")),
    )
    out = flat.withColumn("validation_error", error).drop("violations", "unknown")
    return normalised(out.drop("timestamp", "ingestion_timestamp"))


def split_valid(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.where("validation_error is null"), rows.where("validation_error is not null")


def dead_letters(malformed: DataFrame, failed_at: Column, attempts: Column | int = 1) -> DataFrame:
    """(key, value) of dead letters; ids follow from the source position, so a replay sends the same ones."""
    spot = F.concat_ws(":", F.lit("riskweave:dead-letter"), "source_topic", F.col("source_partition").cast("string"), F.col("source_offset").cast("string"))
    key = F.coalesce(F.nullif(F.col("source_key"), F.lit("")), uuid5(spot))
    message = F.struct(
        uuid5(spot).alias("message_id"), F.lit(SCHEMA_VERSION).alias("schema_version"), failed_at.alias("produced_at"), F.lit(None).cast("string").alias("correlation_id"),
        F.col("source_topic").alias("original_topic"), F.col("source_partition").alias("original_partition"), F.col("source_offset").alias("original_offset"), F.col("source_key").alias("original_key"),
        F.substring(F.coalesce("raw", F.lit("")), 1, PAYLOAD_LIMIT).alias("raw_payload"), F.lit("ValidationError").alias("error_type"), F.substring("validation_error", 1, ERROR_LIMIT).alias("error_message"),
        (attempts if isinstance(attempts, Column) else F.lit(attempts)).cast("int").alias("attempts"), failed_at.alias("failed_at"),
    )
    return malformed.select(key.alias("key"), F.to_json(message, _JSON).alias("value"))


def derived_id(source: Column, kind: str) -> Column:
    return uuid5(F.concat(F.lit("riskweave:"), source, F.lit(f":{kind}")))


def prediction_id(event_id: Column, model_version: Column) -> Column:
    return uuid5(F.concat(F.lit("riskweave:prediction:"), event_id, F.lit(":"), model_version))


def _head(message_id: Column) -> list[Column]:
    return [message_id.alias("message_id"), F.lit(SCHEMA_VERSION).alias("schema_version"), F.col("produced_at"), F.col("correlation_id"), F.col("event_id"), F.col("transaction_id")]


def _versions() -> list[Column]:
    return [F.col("model_version"), F.col("calibration_version")]


def prediction_messages(accepted: DataFrame, features: Column) -> DataFrame:
    nothing = F.lit(None).cast("map<string,string>").alias("explanation")
    message = F.struct(*_head(F.col("prediction_id")), "customer_id", features.alias("features"), "model_probability", "calibrated_probability", "anomaly_score", "rule_score", "confidence", *_versions(), "feature_version", nothing)
    return accepted.select(F.col("customer_id").alias("key"), F.to_json(message, _JSON).alias("value"))


def alert_messages(accepted: DataFrame, policy: Policy = Policy()) -> DataFrame:
    decision = F.struct("calibrated_probability", "confidence", "abstained", "risk_tier", "action", "review_threshold", "block_threshold", F.lit(policy.version).alias("policy_version"), *_versions(), "reason_codes")
    nothing = F.lit(None).cast("map<string,string>").alias("explanation")
    message = F.struct(*_head(derived_id(F.col("prediction_id"), "alert")), "customer_id", decision.alias("decision"), F.col("prediction_id").alias("prediction_message_id"), "reason_codes", nothing)
    return accepted.where(F.col("action").isin("review", "block")).select(F.col("customer_id").alias("key"), F.to_json(message, _JSON).alias("value"))


def audit_details() -> Column:
    return F.create_map(F.lit("action"), F.col("action"), F.lit("risk_tier"), F.col("risk_tier"), F.lit("final_risk_score"), F.format_string("%.6f", F.col("calibrated_probability")))


def audit_messages(accepted: DataFrame) -> DataFrame:
    """One audit per accepted row, and one more per alert, from a single scan."""

    def audit(kind: str, message_id: Column, topic: str) -> Column:
        return F.struct(*_head(message_id), F.lit(kind).alias("event_type"), F.col("action").alias("status"), F.lit(topic).alias("source_topic"), audit_details().alias("details"))

    predicted = audit("predicted", F.col("prediction_id"), "predictions")
    alerted = F.when(F.col("action").isin("review", "block"), audit("alerted", derived_id(F.col("prediction_id"), "audit-alert"), "alerts"))
    both = accepted.select("customer_id", F.explode(F.array_compact(F.array(predicted, alerted))).alias("m"))
    return both.select(F.col("customer_id").alias("key"), F.to_json("m", _JSON).alias("value"))


def _stated(df: DataFrame, name: str) -> Column:
    """A field of the envelope where the rows have it."""
    return (F.col(name) if name in df.columns else F.lit(None).cast("string")).alias(name)


def _audit_of(df: DataFrame, source: str, kind: str, event_type: str, status: Column, topic: str, details: Column) -> DataFrame:
    """(key, value) of an audit per row, with all fields of its contract; its id follows from the source column."""
    m = F.struct(
        derived_id(F.col(source), kind).alias("message_id"), F.lit(SCHEMA_VERSION).alias("schema_version"), _stated(df, "produced_at"), _stated(df, "correlation_id"), F.lit(event_type).alias("event_type"),
        status.alias("status"), F.lit(topic).alias("source_topic"), F.col("event_id"), F.col("transaction_id"), details.alias("details"),
    )
    return df.select(F.col("event_id").alias("key"), F.to_json(m, _JSON).alias("value"))


def validated_audits(valid: DataFrame) -> DataFrame:
    """(key, value) of the audits of a relay that found rows valid."""
    return _audit_of(valid, "message_id", "audit-validated", "validated", F.lit("accepted"), "transactions", F.create_map(F.lit("validation_version"), F.lit(VALIDATION_VERSION)))


def ignored_audits(rejected: DataFrame) -> DataFrame:
    """Audits of events that a stream set aside, with the reason."""
    return _audit_of(rejected, "event_id", "audit-ignored", "ignored", F.col("reason"), "validated_transactions", F.create_map(F.lit("reason"), F.col("reason")))


def feedback_audits(feedback: DataFrame) -> DataFrame:
    """Audits of analysts' feedback; unknown outcomes are left out."""
    known = feedback.where(F.col("outcome").isin(*OUTCOMES))
    return _audit_of(known, "message_id", "audit-feedback", "feedback_received", F.col("outcome"), "feedback", F.create_map(F.lit("analyst_id"), F.col("analyst_id")))


def failure_outcomes(records: DataFrame, failures: Column, most: int = 3) -> DataFrame:
    """records with `outcome` and `attempts`. Those with a validation_error are dead letters at the first attempt; others are
    tried until they pass, `most` times at most. failures: how often handling a record fails, null for never."""
    if most < 1:
        raise ValueError("a record is tried once at least")
    bad, fails = F.col("validation_error").isNotNull(), F.coalesce(failures, F.lit(0))
    lost = bad | (fails >= most)
    return records.withColumns({"outcome": F.when(lost, "dead_letter").otherwise("processed"), "attempts": F.when(bad, 1).otherwise(F.least(fails + 1, F.lit(most))).cast("int")})


def serving_events(records: DataFrame, fields: list[str]) -> DataFrame:
    """Valid labelled records as serving events: no label leaves."""
    return records.select(*[f for f in fields if f not in ("fraud_label", "fraud_type")])
