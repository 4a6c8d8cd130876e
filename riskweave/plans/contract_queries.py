"""Queries over field rules, messages, routing, replay and manifests, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions import scalars as S
from riskweave.operators import contracts as C
from riskweave.operators import decisions as D
from riskweave.operators import drift as R
from riskweave.operators import evaluation as E
from riskweave.operators import explain as X
from riskweave.operators import features as B
from riskweave.operators import messages as M
from riskweave.operators import ml
from riskweave.operators import privacy as P
from riskweave.operators import profiles as O
from riskweave.operators import views as V
from riskweave.plans.fixtures import txn, with_txn
from riskweave.plans.queries import _CAT, _DECIDED, _HYBRID, _NUM, _NUMQ, _halves, _messages, decided, evidence, log_records, profiles_of, query, rounded, scored, with_scores
from riskweave.streaming.state import replayed_globally

# --- field rules -----------------------------------------------------------------------------------------------------


@query("b06_truth_violations", with_txn(" SELECT event_id, coalesce(CASE WHEN k % 10 <> 3 THEN fraud_label = 1 END, false) <> (k % 4 = 0) AS violated FROM txn"))
def truth(spark, sf_dir):
    """Labels missing on some rows, types on others."""
    rows = txn(spark, sf_dir).select("event_id", F.when(F.col("k") % 10 != 3, F.col("fraud_label") == 1).alias("fraud_label"), F.when(F.col("k") % 4 == 0, "card").alias("fraud_type"))
    return rows.select("event_id", C.truth_violation().alias("violated"))


@query("b07_payload_and_label", with_txn(" SELECT event_id, CASE WHEN k % 2 = 0 THEN transaction_amount ELSE -1.0 END AS amount, CASE WHEN k % 3 = 0 THEN 1 ELSE fraud_label END AS label FROM txn"))
def payload(spark, sf_dir):
    """Nested where there is an event, else flat; the nested label first."""
    rows = txn(spark, sf_dir)
    nested = F.when(F.col("k") % 2 == 0, F.struct(F.col("transaction_amount").alias("amount")))
    flat = F.struct(F.lit(-1.0).alias("amount"))
    return rows.select("event_id", C.payload_of(nested, flat)["amount"].alias("amount"), C.label_of(F.when(F.col("k") % 3 == 0, 1), F.col("fraud_label")).alias("label"))


@query("b08_without_simulation", with_txn(" SELECT event_id, customer_id FROM txn"))
def unsimulated(spark, sf_dir):
    rows = txn(spark, sf_dir).select("event_id", "customer_id", F.lit("valid").alias("record_kind"), F.col("fraud_label").alias("simulation_fraud_label"), F.lit(None).cast("string").alias("raw_record"))
    return C.without_simulation(rows)


@query("b12_accepted_and_alerting", with_scores(" SELECT event_id, action, risk_tier FROM actions WHERE k % 7 <> 0 AND action IN ('review', 'block')", _DECIDED))
def alerting(spark, sf_dir):
    rows = decided(spark, sf_dir).withColumn("accepted", F.col("k") % 7 != 0)
    return V.alerting_rows(V.accepted_rows(rows)).select("event_id", "action", "risk_tier")


@query("b17_model_inputs", with_scores(" SELECT event_id, round(amount_z_score + 1e-9, 6) + 0.0 AS amount_z_score, device_novelty, country_novelty FROM scores"))
def inputs(spark, sf_dir):
    return rounded(ml.model_inputs(scored(spark, sf_dir), ["amount_z_score", "device_novelty", "country_novelty"]), nudge=1e-9)


@query("b18_visible_identifiers", with_txn(" SELECT event_id, 'shown' AS who, customer_id, merchant_id FROM txn UNION ALL SELECT event_id, 'masked', 'id_' || left(sha256('riskweave:' || customer_id), 12), 'id_' || left(sha256('riskweave:' || merchant_id), 12) FROM txn"))
def identifiers(spark, sf_dir):
    rows = txn(spark, sf_dir).select("event_id", "customer_id", "merchant_id")
    both = [P.visible_identifiers(rows, ["customer_id", "merchant_id"], masked).withColumn("who", F.lit(who)) for who, masked in (("shown", False), ("masked", True))]
    return both[0].unionByName(both[1])


@query("b19_records_frame", with_txn(" SELECT event_id, CASE WHEN k % 3 <> 0 THEN us // 1000000 * 1000000 END AS event_us FROM txn"))
def records(spark, sf_dir):
    rows = txn(spark, sf_dir).select("event_id", F.when(F.col("k") % 3 == 0, "no time").otherwise(F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("event_time"))
    return V.records_frame(rows).select("event_id", S.micros("event_time").alias("event_us"))


@query("h12_metric_or", with_txn(" SELECT event_id, coalesce(CASE WHEN k % 2 = 0 THEN CAST(k AS VARCHAR) END, '—') AS shown FROM txn"))
def metric(spark, sf_dir):
    return txn(spark, sf_dir).select("event_id", S.metric_or(F.when(F.col("k") % 2 == 0, F.col("k"))).alias("shown"))


@query("h16_bounded_errors", with_txn(" SELECT event_id, left(CASE WHEN k % 3 = 1 THEN trim('  bad ' || merchant_id || '  ') ELSE 'ValueError' END, 9) AS error FROM txn"))
def bounded(spark, sf_dir):
    text = F.when(F.col("k") % 3 == 0, "   ").when(F.col("k") % 3 == 1, F.concat(F.lit("  bad "), F.col("merchant_id"), F.lit("  ")))
    return txn(spark, sf_dir).select("event_id", S.bounded_error(text, F.lit("ValueError"), 9).alias("error"))


@query("h17_latency_seconds", with_txn(" SELECT event_id, round((epoch_us(TIMESTAMP '2024-03-01 00:00:00') - us) / 1e6, 6) AS latency FROM txn"))
def latency(spark, sf_dir):
    return rounded(txn(spark, sf_dir).select("event_id", S.latency_seconds("event_time", F.lit("2024-03-01 00:00:00")).alias("latency")))


@query("i02_rule_predictions", with_scores(" SELECT event_id, round(score, 6) AS probability, round(2 * abs(score - 0.5), 6) AS confidence FROM scores"))
def rule_predictions(spark, sf_dir):
    return rounded(B.rule_prediction(B.rule_features(txn(spark, sf_dir))).select("event_id", F.col("calibrated_probability").alias("probability"), "confidence"))


# --- messages and routing --------------------------------------------------------------------------------------------


@query("a11_sink_frames", with_scores(" SELECT customer_id AS key, 'predictions' AS topic, event_id FROM scores UNION ALL SELECT customer_id, 'alerts', event_id FROM actions WHERE action <> 'allow'", _DECIDED))
def sink_frames(spark, sf_dir):
    """What a writer to topics gets: keys and values as text, and the topic."""
    rows = _messages(spark, sf_dir)
    sent = M.sink_frame(M.prediction_messages(rows, F.create_map(F.lit("k"), F.col("k").cast("double"))), "predictions").unionByName(M.sink_frame(M.alert_messages(rows), "alerts"))
    return sent.select("key", "topic", F.get_json_object("value", "$.event_id").alias("event_id"))


#: The CRC-32 of text by its table, which is made from the polynomial: 256 steps of eight shifts.
_CRC = """tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda v, j: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END) AS v FROM range(256) r(i))),
crc AS (SELECT event_id, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(customer_id, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda v, b: xor(v // 256, t[CAST(xor(v % 256, b) AS BIGINT) + 1])) AS v FROM txn, tab)"""


@query("a24_partition_index", with_txn(" SELECT event_id, CAST(xor(v, 4294967295) % 6 AS INT) AS partition FROM crc", _CRC))
def partition_index(spark, sf_dir):
    return txn(spark, sf_dir).select("event_id", M.partition_for(F.col("customer_id"), 6).alias("partition"))


def _handled(spark, sf_dir) -> DataFrame:
    """Parsed records with how often handling each fails. Neither side may be broadcast: sizes are guessed from columns, and
    texts of a log are many times as long as the guess."""
    k = txn(spark, sf_dir).select(F.col("n").alias("id"), (F.col("k") % 5).alias("fails"))
    return M.parsed(log_records(spark, sf_dir)).join(k.hint("merge"), F.col("source_offset") == F.col("id"))


@query("a26_failed_records", with_txn(" SELECT n AS source_offset, CASE WHEN bad OR k % 5 >= 3 THEN 'dead_letter' ELSE 'processed' END AS outcome, CASE WHEN bad THEN 1 ELSE CAST(least(k % 5 + 1, 3) AS INT) END AS attempts FROM (SELECT *, n % 97 = 0 OR n % 89 = 0 OR n % 83 = 0 AS bad FROM txn)"))
def failed(spark, sf_dir):
    """Handling a record fails as often as the last digit of its k, by five, says."""
    rows = _handled(spark, sf_dir)
    return M.failure_outcomes(rows, F.col("fails")).select("source_offset", "outcome", "attempts")


@query("a26_dead_letters_with_attempts", with_txn(" SELECT n AS original_offset, CASE WHEN bad THEN 1 ELSE 3 END AS attempts FROM (SELECT *, n % 97 = 0 OR n % 89 = 0 OR n % 83 = 0 AS bad FROM txn) WHERE bad OR k % 5 >= 3"))
def failed_letters(spark, sf_dir):
    rows = _handled(spark, sf_dir)
    lost = M.failure_outcomes(rows, F.col("fails")).where("outcome = 'dead_letter'")
    lost = lost.withColumn("validation_error", F.coalesce("validation_error", F.lit("handler failed")))
    read = M.dead_letters(lost, F.lit("2024-02-01T00:00:00Z"), F.col("attempts")).select(M.decode_message(F.col("value"), "dead_letter").alias("m"))
    return read.select("m.original_offset", "m.attempts")


@query("j11_validated_audits", with_txn(" SELECT event_id, 'validated' AS event_type, 'accepted' AS status, '2024-02-01T00:00:00Z' AS produced_at FROM txn WHERE n % 97 <> 0 AND n % 89 <> 0 AND n % 83 <> 0"))
def validated_audits(spark, sf_dir):
    good, _ = M.split_valid(M.parsed(log_records(spark, sf_dir)))
    read = M.validated_audits(good).select(F.from_json("value", M.schema_of("audit")).alias("m"))
    return read.select("m.event_id", "m.event_type", "m.status", "m.produced_at")


@query("j12_ignored_audits", with_txn(" SELECT event_id, 'ignored' AS event_type, 'duplicate_event' AS status, 'duplicate_event' AS reason, 'corr-' || event_id AS correlation_id FROM txn WHERE k % 14 = 0"))
def ignored_audits(spark, sf_dir):
    rows = txn(spark, sf_dir).where("k % 14 = 0").withColumns({"reason": F.lit("duplicate_event"), "produced_at": F.lit("2024-02-01T00:00:00Z"), "correlation_id": F.concat(F.lit("corr-"), "event_id")})
    read = M.ignored_audits(rows).select(M.decode_message(F.col("value"), "audit").alias("m"))
    return read.select("m.event_id", "m.event_type", "m.status", F.col("m.details")["reason"].alias("reason"), "m.correlation_id")


# --- predictions -----------------------------------------------------------------------------------------------------

_JOB = "CAST(right(event_id, 8) AS BIGINT) % 3 <> 0"


def _job(spark, sf_dir) -> dict[str, DataFrame]:
    events = txn(spark, sf_dir)
    return O.predict_batch(events, profiles_of(spark, sf_dir), events.where(F.col("n") % 3 == 0).select("event_id"))


@query("i13_job_transactions", with_txn(f" SELECT event_id, transaction_amount, country FROM txn WHERE {_JOB}"))
def job_transactions(spark, sf_dir):
    return _job(spark, sf_dir)["transactions"].select("event_id", "transaction_amount", "country")


@query("i13_job_alerts", with_scores(f" SELECT event_id, customer_id, action, 'open' AS status FROM ha WHERE {_JOB} AND action <> 'allow'", *_HYBRID[:-1], _HYBRID[-1].replace("hy AS (SELECT e.event_id, e.score,", "hy AS (SELECT e.event_id, e.customer_id, e.score,")))
def job_alerts(spark, sf_dir):
    return _job(spark, sf_dir)["alerts"].select("event_id", "customer_id", "action", "status")


@query("i13_job_audits", with_scores(f" SELECT event_id, 'predicted' AS event_type, action AS status FROM ha WHERE {_JOB}", *_HYBRID))
def job_audits(spark, sf_dir):
    return _job(spark, sf_dir)["audits"].select("event_id", "event_type", "status")


@query(
    "i06_scored_rows",
    with_scores(
        """ SELECT event_id, round(score, 6) AS calibrated_probability, round(score, 6) AS final_risk_score, round(score, 6) AS rule_score, round(confidence, 6) AS confidence, action, risk_tier, stop AS abstained,
  CASE WHEN reasons = '' THEN '[]' ELSE '["' || replace(reasons, ',', '","') || '"]' END AS reason_codes_json, '{"country_novelty":' || CAST(country_novelty AS VARCHAR) || ',"device_novelty":' || CAST(device_novelty AS VARCHAR) || '}' AS features_json, 'rules-1' AS model_version, 'none' AS calibration_version, 'features-1' AS feature_version FROM actions""",
        _DECIDED,
    ),
)
def scored_rows(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("rule_score", F.col("score"))
    out = D.scored_rows(rows, ["device_novelty", "country_novelty"], F.lit("2024-02-01T00:00:00Z").cast("timestamp"))
    return rounded(out.select("event_id", "calibrated_probability", "final_risk_score", "rule_score", "confidence", "action", "risk_tier", "abstained", "reason_codes_json", "features_json", "model_version", "calibration_version", "feature_version"))


_SETS = {
    "supervised_only": "s", "anomaly_only": "a", "rules_only": "r", "supervised_anomaly": "(s + a) / 2", "supervised_rules": "(s + r) / 2", "full_hybrid": "(s + a + r + c + m + d + b) / 7", "without_customer_risk": "(s + a + r + m + d + b) / 6",
    "without_merchant_risk": "(s + a + r + c + d + b) / 6", "without_device_risk": "(s + a + r + c + m + b) / 6", "without_behavioural_window_features": "(s + a + r + c + m + d) / 6",
}


@query(
    "i12_all_combinations",
    with_scores(
        " SELECT event_id, combination, round(least(1.0, greatest(0.0, v)) + 1e-9, 6) AS score FROM (" + " UNION ALL ".join(f"SELECT event_id, '{n}' AS combination, {v} AS v FROM parts" for n, v in _SETS.items()) + ")",
        "parts AS (SELECT event_id, k / 100.0 AS s, 1 - k / 100.0 AS a, score AS r, 0.5 AS c, 0.25 AS m, k % 4 / 4.0 AS d, k % 3 / 3.0 AS b FROM scores)",
    ),
)
def all_combinations(spark, sf_dir):
    k = F.col("k")
    df = scored(spark, sf_dir).select(
        "event_id", (k / 100.0).alias("supervised"), (1 - k / 100.0).alias("anomaly"), F.col("score").alias("rules"), F.lit(0.5).alias("customer_profile"), F.lit(0.25).alias("merchant_profile"), (k % 4 / 4.0).alias("device_profile"), (k % 3 / 3.0).alias("behavioural_window"),
    )
    out, skipped = D.combination_scores(df, "event_id", tuple(df.columns[1:]))
    assert not skipped
    return rounded(out, nudge=1e-9)


# --- drift, labels, manifests ----------------------------------------------------------------------------------------


@query("g04_common_columns", with_txn(" SELECT *, score >= 0.2 AS drifted FROM (" + _NUMQ.format(c="k") + " UNION ALL " + _CAT.format(c="country") + ")", _NUM.format(c="k")))
def common(spark, sf_dir):
    """Columns of both tables; each has one that the other lacks."""
    a, b = _halves(spark, sf_dir)
    return rounded(R.drift_report(a.select("country", "k", "currency"), b.select("k", "merchant_category", "country")).select("column", "kind", "score", "drifted"))


@query("d27_drifted_count", with_txn(" SELECT count(*) AS columns, count(*) FILTER (score >= 0.2) AS drifted FROM (" + _NUMQ.format(c="k") + " UNION ALL " + _CAT.format(c="country") + ")", _NUM.format(c="k")))
def drifted(spark, sf_dir):
    a, b = _halves(spark, sf_dir)
    return R.drifted_count(R.drift_report(a, b, ["country", "k"]))


@query("d28_duplicate_rows", with_txn(" SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT customer_id, merchant_id, k FROM txn)) AS duplicate_rows FROM txn"))
def duplicates(spark, sf_dir):
    return R.duplicate_rows(txn(spark, sf_dir).select("customer_id", "merchant_id", "k"))


@query("d31_positive_rate", with_txn(" SELECT round(avg(fraud_label), 6) AS positive_rate FROM txn"))
def rate(spark, sf_dir):
    return rounded(E.positive_rate(txn(spark, sf_dir), "fraud_label"))


@query("d33_background_replacement", with_txn(" SELECT event_id, round((SELECT avg(transaction_amount) FROM txn WHERE k < 50), 6) AS transaction_amount, country FROM txn"))
def replaced(spark, sf_dir):
    """A numeric column takes the mean of a background; a text column keeps its values."""
    rows = txn(spark, sf_dir)
    means = X.background_means(rows.where("k < 50"), ["transaction_amount", "country"])
    out = X.against_background(X.against_background(rows, means, "transaction_amount"), means, "country")
    return rounded(out.select("event_id", "transaction_amount", "country"))


@query("k07_vocabulary", with_txn(" SELECT DISTINCT 'country' AS \"column\", country AS value FROM txn WHERE k < 50 UNION ALL SELECT DISTINCT 'merchant_category', merchant_category FROM txn WHERE k < 50"))
def words(spark, sf_dir):
    found = ml.vocabulary(txn(spark, sf_dir).where("k < 50"), ["country", "merchant_category"])
    return spark.createDataFrame([(c, v) for c, values in found.items() for v in values], "column string, value string")


def _manifest_sql(schema: str, columns: str, fields: dict[str, str], tail: str, *more: str) -> str:
    row = " || chr(31) || ".join(f"coalesce({fields[n]}, '<null>')" for n in sorted(fields))
    body = f"SELECT count(*) AS row_count, '{schema}' AS schema, coalesce(sum(CAST('0x' || left(md5({row}), 13) AS BIGINT)), 0) AS total FROM {columns}"
    return with_txn(f" SELECT {tail} row_count, schema, md5(schema || '|' || row_count || '|' || total) AS checksum FROM ({body})", *more)


_TXN_FIELDS = {c: c for c in ("event_id", "transaction_id", "customer_id", "merchant_id", "merchant_category", "device_id", "currency", "transaction_type", "transaction_status", "country")}
_TXN_FIELDS |= {c: f"printf('%.6f', {c})" for c in ("transaction_amount", "latitude", "longitude")} | {"card_present": "CAST(CAST(card_present AS INT) AS VARCHAR)", "event_time": "CAST(us AS VARCHAR)"} | {c: f"CAST({c} AS VARCHAR)" for c in ("k", "n", "fraud_label")}
_TXN_KINDS = dict.fromkeys(_TXN_FIELDS, "string") | dict.fromkeys(("transaction_amount", "latitude", "longitude"), "double") | {"card_present": "boolean", "event_time": "timestamp_ntz", "k": "int", "n": "bigint", "fraud_label": "int"}
_TXN_SCHEMA = ",".join(f"{n}:{_TXN_KINDS[n]}" for n in sorted(_TXN_KINDS))


@query("d30_dataset_manifest", _manifest_sql(_TXN_SCHEMA, "txn", _TXN_FIELDS, "'v1' AS version, 'events' AS source, 'features-1' AS feature_version,"))
def manifest(spark, sf_dir):
    return R.manifest(txn(spark, sf_dir), "v1", "events", "features-1")


@query("k17_run_metadata", _manifest_sql(_TXN_SCHEMA, "txn", _TXN_FIELDS, "'v1' AS version, 'run' AS source, 'features-1' AS feature_version, CAST(42 AS INT) AS seed,"))
def run_metadata(spark, sf_dir):
    """Without the versions of the libraries, which the SQL can't know."""
    return ml.metadata(txn(spark, sf_dir), 42, "v1").drop("spark_version", "numpy_version")


# --- replay with one watermark ---------------------------------------------------------------------------------------

_ARRIVALS = """arr AS (SELECT event_id, transaction_id, customer_id, us, transaction_amount, us + ((n * 7919) % 3600) * 1000000 AS arrival, n * 2 AS tie FROM txn UNION ALL SELECT event_id, transaction_id, customer_id, us, transaction_amount, us + 3700000000, n * 2 + 1 FROM txn WHERE n % 50 = 0),
wm AS (SELECT *, max(us) OVER (ORDER BY arrival, tie ROWS UNBOUNDED PRECEDING) - 900000000 AS watermark FROM arr),
ver AS (SELECT *, us < watermark AS late, row_number() OVER (PARTITION BY event_id, us < watermark ORDER BY arrival, tie) AS nth FROM wm),
out1 AS (SELECT *, CASE WHEN late AND NOT EXISTS (SELECT 1 FROM ver v WHERE v.event_id = ver.event_id AND NOT v.late AND (v.arrival, v.tie) < (ver.arrival, ver.tie)) THEN 'event_beyond_watermark' WHEN late OR nth > 1 THEN 'duplicate_event' END AS reason FROM ver),
acc AS (SELECT * FROM out1 WHERE reason IS NULL)"""


@query(
    "j07_global_replay",
    with_txn(
        """ SELECT o.event_id, o.tie, o.reason IS NULL AS accepted, o.reason, CASE WHEN o.reason IS NULL THEN CAST((SELECT count(*) FROM acc a WHERE a.customer_id = o.customer_id AND (a.arrival, a.tie) < (o.arrival, o.tie) AND a.us < o.us AND a.us >= o.us - 2592000000000) AS DOUBLE) END AS customer_prior_transaction_count,
  round(CASE WHEN o.reason IS NULL THEN coalesce((SELECT sum(a.transaction_amount) FROM acc a WHERE a.customer_id = o.customer_id AND (a.arrival, a.tie) < (o.arrival, o.tie) AND a.us < o.us AND a.us >= o.us - 2592000000000), 0) END, 4) AS customer_prior_amount_sum FROM out1 o""",
        _ARRIVALS,
    ),
)
def global_replay(spark, sf_dir):
    """Arrivals up to an hour late, some sent twice: one watermark over all customers, 30 days of history."""
    t = txn(spark, sf_dir).withColumns({"us": S.micros("event_time"), "correlation_id": F.lit(None).cast("string")})
    first = t.withColumns({"arrival": F.col("us") + (F.col("n") * 7919) % 3600 * 1_000_000, "tie": F.col("n") * 2})
    again = t.where("n % 50 = 0").withColumns({"arrival": F.col("us") + 3_700_000_000, "tie": F.col("n") * 2 + 1})
    out = replayed_globally(first.unionByName(again), ["arrival", "tie"])
    return out.select("event_id", "tie", "accepted", "reason", "customer_prior_transaction_count", F.round("customer_prior_amount_sum", 4).alias("customer_prior_amount_sum"))
