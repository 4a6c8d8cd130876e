"""Streaming jobs: validated and dead-letter branches, window metrics, predictions, each with its own checkpoint."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskweave.operators import messages as M
from riskweave.operators.decisions import Policy, decide
from riskweave.operators.features import rule_score
from riskweave.operators.views import accepted_rows, outcome_counters
from riskweave.operators.windows import window_metrics
from riskweave.sources.commits import CommitLog, Part
from riskweave.sources.logs import write_log_files
from riskweave.streaming.state import stateful_features


def _started(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None] | None = None, path: str | None = None, interval: str | None = "5 seconds") -> StreamingQuery:
    """A query with its own checkpoint; interval None takes all that is there and stops."""
    w = stream.writeStream.option("checkpointLocation", checkpoint).outputMode("append")
    w = w.trigger(availableNow=True) if interval is None else w.trigger(processingTime=interval)
    return w.foreachBatch(write).start() if write else w.format("parquet").start(path)


def state_input(parsed: DataFrame) -> DataFrame:
    return parsed.select(
        "event_id", "transaction_id", "customer_id", "merchant_id", "device_id", "country", "merchant_category", "transaction_amount", "transaction_type", "transaction_status", "card_present", "latitude", "longitude", "correlation_id",
        F.unix_micros("event_time").alias("us"),
    )


def scored(features: DataFrame, policy: Policy = Policy(), model_version: str = "rules-1") -> DataFrame:
    """Accepted rows scored and decided; rejected ones keep null scores, as their features would say nothing true."""
    df = features.withColumn("rule_score", F.when(F.col("accepted"), rule_score()))
    df = df.withColumns({"calibrated_probability": F.col("rule_score"), "model_probability": F.lit(None).cast("double"), "anomaly_score": F.lit(None).cast("double")})
    df = decide(df, policy, rules="rule_score")
    kept = {c: F.when(F.col("accepted"), F.col(c)) for c in ("action", "risk_tier", "abstained", "confidence")}
    return df.withColumns({**kept, "model_version": F.lit(model_version), "calibration_version": F.lit("none"), "feature_version": F.lit("features-1"), "prediction_id": M.prediction_id(F.col("event_id"), F.lit(model_version))})


def write_predictions(out: str, policy: Policy = Policy(), features: tuple[str, ...] = ("amount_z_score", "device_novelty")) -> Callable[[DataFrame, int], None]:
    """Per micro-batch, persisted once: rows, messages of accepted rows and audits of ignored ones, and one row of counters, all
    under one commit, so that a batch that is tried or replayed again counts once in each. Read them with committed()."""

    def write(batch: DataFrame, batch_id: int) -> None:
        log = CommitLog(batch.sparkSession, out)
        if log.is_done(batch_id):
            return
        rows = batch.withColumn("produced_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")).persist()
        try:
            good = accepted_rows(rows)
            names = F.map_from_arrays(F.array(*map(F.lit, features)), F.array(*features))
            sent = M.sink_frame(M.prediction_messages(good, names), "predictions").unionByName(M.sink_frame(M.alert_messages(good, policy), "alerts"))
            sent = sent.unionByName(M.sink_frame(M.audit_messages(good), "audit")).unionByName(M.sink_frame(M.ignored_audits(rows.where("not accepted")), "audit"))
            log.write(batch_id, {"predictions": Part(rows), "messages": Part(sent, by=("topic",)), "counters": Part(outcome_counters(rows), "json")})
        finally:
            rows.unpersist()

    return write


#: Columns of the counters that batches leave.
COUNTERS = "total bigint, processed bigint, dropped bigint, duplicates bigint, late bigint, mean_latency_seconds double"


def committed(spark: SparkSession, out: str, table: str) -> DataFrame:
    """What write_predictions left in `predictions`, `messages` or `counters`, of committed batches only."""
    return CommitLog(spark, out).read(table, *(("json", COUNTERS) if table == "counters" else ()))


def retried(write: Callable[[DataFrame, int], None], dead: Callable[[DataFrame, int, int, Exception], None], most: int = 3, pause: float = 0.5) -> Callable[[DataFrame, int], None]:
    """A batch writer that is tried again after a pause that doubles, and gives the batch to dead(batch, id, attempts, why) when
    it fails for the last time. If that fails too the error is raised, so a batch is done only when it is written somewhere."""
    if most < 1:
        raise ValueError("a batch is tried once at least")

    def run(batch: DataFrame, batch_id: int) -> None:
        for attempt in range(1, most + 1):
            try:
                return write(batch, batch_id)
            except Exception as why:  # noqa: BLE001  whatever a sink raises
                if attempt == most:
                    return dead(batch, batch_id, attempt, why)
                time.sleep(pause * 2 ** (attempt - 1))

    return run


def write_branch(out: str, topic: str, shape: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    return lambda batch, batch_id: write_log_files(M.sink_frame(shape(batch), topic), batch_id, out)


def dead_letter_rows(malformed: DataFrame) -> DataFrame:
    return M.dead_letters(malformed, F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def validated_rows(valid: DataFrame) -> DataFrame:
    """Valid rows wrapped again with the validation's version, normalised values included."""
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
    rows = valid.withColumns({"timestamp": F.date_format("event_time", iso), "ingestion_timestamp": F.date_format("ingestion_time", iso)})
    return M.envelope(rows, F.col("message_id"), F.col("produced_at"), F.col("correlation_id"), M.VALIDATION_VERSION)


def start_all(log: DataFrame, out: str, interval: str | None = "5 seconds", watermark: str = "15 minutes", lateness_seconds: float = 900, policy: Policy = Policy()) -> dict[str, StreamingQuery]:
    """Four queries over a log: dead_letter, validated, windows, predictions, with independent checkpoints under out."""
    valid, bad = M.split_valid(M.parsed(log))
    rows = scored(stateful_features(state_input(valid), lateness_seconds, expire_idle=interval is not None), policy)
    place = f"{out}/checkpoints"
    return {
        "dead_letter": _started(bad, f"{place}/dead_letter", write_branch(f"{out}/dead_letter", "dead_letter", dead_letter_rows), interval=interval),
        "validated": _started(valid, f"{place}/validated", write_branch(f"{out}/validated", "validated_transactions", validated_rows), interval=interval),
        "windows": _started(window_metrics(valid, watermark), f"{place}/windows", path=f"{out}/windows", interval=interval),
        "predictions": _started(rows, f"{place}/predictions", write_predictions(out, policy), interval=interval),
    }


def stop_all(queries: dict[str, StreamingQuery]) -> None:
    for q in queries.values():
        q.stop()


def wait_all(queries: dict[str, StreamingQuery], seconds: int | None = None) -> None:
    for q in queries.values():
        q.awaitTermination(seconds) if seconds else q.awaitTermination()


def running_metrics(counters: DataFrame) -> DataFrame:
    """Totals over the counters that batches left, as committed() reads them."""
    from riskweave.operators.views import running_totals

    batch_id = F.col("_batch_id" if "_batch_id" in counters.columns else "batch_id").alias("batch_id")
    return running_totals(counters.select(batch_id, "processed", "dropped", "duplicates", "late", F.lit(0).alias("duration_ms")))
