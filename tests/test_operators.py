"""Known values and edge cases of the batch operators, sources and sinks."""

import zlib

import pytest
from pyspark.sql import functions as F

from riskweave.functions import scalars as S
from riskweave.operators import contracts as C
from riskweave.operators import decisions as D
from riskweave.operators import evaluation as E
from riskweave.operators import explain as X
from riskweave.operators import features as B
from riskweave.operators import governance as G
from riskweave.operators import messages as M
from riskweave.operators import views as V
from riskweave.plans.fixtures import txn
from riskweave.sources import files


def one(spark, **values):
    return spark.createDataFrame([tuple(values.values())], list(values))


def decision(spark, p, rule=None, confidence=None, **policy):
    df = spark.createDataFrame([(p, rule, confidence)], "calibrated_probability double, rule double, sure double")
    return D.decide(df, D.Policy(**policy), rules="rule", confidence="sure" if confidence is not None else None).first()


def test_decision_bands(spark):
    assert [(decision(spark, p)["action"], decision(spark, p)["risk_tier"]) for p in (0.1, 0.3, 0.9)] == [("allow", "low"), ("allow", "medium"), ("block", "critical")]
    r = decision(spark, 0.65, confidence=0.9)
    assert (r["action"], r["risk_tier"], r["abstained"]) == ("review", "high", False)
    r = decision(spark, 0.2, rule=0.95)
    assert r["action"] == "review" and r["reason_codes"] == ["rule_model_disagreement"] and r["risk_tier"] == "medium"
    r = decision(spark, 0.55)
    assert r["abstained"] and r["reason_codes"] == ["low_confidence"]
    with pytest.raises(ValueError):
        D.Policy(review=0.9, block=0.5)


def test_segment_needs_observations(spark):
    df = spark.createDataFrame([("mobile", 49), ("mobile", 50), ("other", 99)], "segment_key string, segment_observations int")
    own = spark.createDataFrame([("mobile", 0.7)], "segment_key string, review_threshold double")
    out = D.with_segment_thresholds(df, own, D.Policy(min_segment_observations=50)).orderBy("segment_observations").collect()
    assert [r["review_threshold"] for r in out] == [0.5, 0.7, 0.5]


def evidence(spark, *rows):
    cols = ", ".join(f"{s} double" for s in D.SOURCES) + ", " + ", ".join(f"{p}_confidence double" for p in D.PROFILES) + ", event_id string"
    return spark.createDataFrame([(*r, *[None] * (6 - len(r)), None, None, None, f"e{k}") for k, r in enumerate(rows)], cols)


def test_fusion_renormalises(spark):
    out = D.fuse(evidence(spark, (0.8, None, 0.2), (0.8,), (None,)), {"supervised": 0.5, "rules": 0.5}).orderBy("event_id").collect()
    assert out[0]["final_score"] == pytest.approx(0.5) and out[0]["action"] == "review"
    assert out[1]["final_score"] == pytest.approx(0.8) and out[1]["active_sources"] == ["supervised"] and "rules" in out[1]["missing_sources"]
    assert out[2]["final_score"] is None and out[2]["action"] is None


def test_thresholds_and_costs(spark):
    df = spark.createDataFrame([(0, 0.1, 10.0), (1, 0.8, 20.0), (0, 0.7, 30.0), (1, 0.9, 40.0)], "label int, score double, transaction_amount double")
    m = E.threshold_metrics(df, 0.75).first()
    assert (m["tp"], m["fp"], m["fn"], m["tn"], m["precision"], m["recall"]) == (2, 0, 0, 2, 1.0, 1.0)
    assert E.roc_auc(df).first()[0] == 1.0 and E.average_precision(df).first()[0] == pytest.approx(1.0)
    assert E.roc_auc(df.where("label = 1")).first()[0] is None
    missed = spark.createDataFrame([(1, False, 100.0)], "label int, chosen boolean, amount double")
    assert E.intervention_cost(missed, "chosen", amount="amount", costs=E.Costs(recovered=0.5)).first()[0] == 50.0
    assert E.best_threshold(df, max_alerts=-1).count() == 0
    best = E.best_threshold(df).first()
    assert best["alert_count"] == 2 and 0.7 < best["threshold"] <= 0.8
    with pytest.raises(ValueError):
        E.Costs(recovered=2)


def test_latency_summary(spark):
    df = spark.createDataFrame([(0.001,), (0.002,), (0.003,)], "v double")
    r = E.latency_summary(df, "v", wall_seconds=0.006).first()
    assert r["median"] == 0.002 and r["throughput"] == pytest.approx(500) and r["p99"] == 0.003
    with pytest.raises(ValueError):
        E.latency_summary(df.where("v > 1"), "v")


def test_constant_reference_gives_a_half(spark):
    df = spark.createDataFrame([(5.0,), (None,)], "v double")
    assert [r["s"] for r in E.min_max(df, df.where("v = 5"), "v", "s").collect()] == [0.5, 0.5]
    lonely = spark.createDataFrame([event(1, 0)]).withColumn("event_time", F.col("event_time").cast("timestamp"))
    assert B.behavioural_features(lonely).first()["geographic_distance_km"] == 0.0


def test_split_needs_rows_and_times(spark):
    df = spark.range(4).select(F.col("id").alias("us"), "id")
    assert sorted(r["split"] for r in E.chronological_split(df, "us", "id").collect()) == ["test", "train", "train", "validation"]
    with pytest.raises(ValueError):
        E.chronological_split(df.limit(2), "us", "id")


def test_features_look_back_only(spark, sf):
    events = txn(spark, sf).where("customer_id < 'customer-000004'")
    cut = F.lit("2024-01-20").cast("timestamp_ntz")
    names = ["event_id", *B.FEATURES]
    whole = B.behavioural_features(events).where(F.col("event_time") < cut).select(*names)
    part = B.behavioural_features(events.where(F.col("event_time") < cut)).select(*names)
    assert whole.exceptAll(part).count() == 0
    with pytest.raises(ValueError, match="merchant_id"):
        B.behavioural_features(events.drop("merchant_id"))


def event(k, minutes, **changes):
    row = dict(
        event_id=f"e{k}", transaction_id=f"t{k}", customer_id="c", merchant_id="m", device_id="d", country="US", merchant_category="x", transaction_amount=25.0, transaction_type="purchase", transaction_status="approved",
        card_present=True, latitude=1.0, longitude=1.0, event_time=f"2024-01-01 {minutes // 60:02d}:{minutes % 60:02d}:00",
    )
    return {**row, **changes}


def test_merchant_velocity(spark):
    df = spark.createDataFrame([event(1, 0), event(2, 30), event(3, 31)]).withColumn("event_time", F.col("event_time").cast("timestamp"))
    out = {r["event_id"]: r for r in B.behavioural_features(df).collect()}
    assert out["e3"]["merchant_transaction_velocity_1h"] == pytest.approx(120.0)
    assert out["e2"]["customer_prior_transaction_count"] == 1 and out["e2"]["rolling_transaction_amount_1h"] == 25.0
    assert out["e1"]["customer_seconds_since_previous"] == -1 and B.behavioural_features(df.limit(0)).count() == 0


def test_first_wins_chains(spark):
    """A(e1,t1) taken, B(e1,t2) rejected and so blocks nobody, C(e3,t2) taken; longer chains alternate."""
    rows = [(0, "e1", "t1"), (1, "e1", "t2"), (2, "e3", "t2"), (3, "e3", "t4"), (4, "e5", "t4"), (5, None, None), (6, None, None)]
    out = C.first_wins(spark.createDataFrame(rows, "o int, event_id string, transaction_id string"), "o").orderBy("o").collect()
    assert [r["duplicate"] for r in out] == [False, True, False, True, False, False, False]


def test_first_wins_against_a_loop(spark):
    import random

    rng = random.Random(1)
    rows = [(k, f"e{rng.randint(0, 40)}", f"t{rng.randint(0, 40)}") for k in range(120)]
    seen, want = (set(), set()), []
    for _, a, b in rows:
        bad = a in seen[0] or b in seen[1]
        want.append(bad)
        if not bad:
            seen[0].add(a), seen[1].add(b)
    out = C.first_wins(spark.createDataFrame(rows, "o int, event_id string, transaction_id string"), "o").orderBy("o").collect()
    assert [r["duplicate"] for r in out] == want


def test_durations():
    assert S.duration_seconds("1.5 Hours") == 5400 and S.duration_seconds("15 minutes") == 900
    with pytest.raises(ValueError):
        S.duration_seconds("soon")


def test_scalars(spark):
    import uuid

    df = spark.createDataFrame([(None, "x"), ("a", " ")], "a string, b string")
    out = df.select(S.mask("a").alias("m"), S.bounded_error("b", F.lit("Kind")).alias("e"), S.format_probability(F.lit(None).cast("double")).alias("p"), S.health_label("a").alias("h"), S.uuid5(F.lit("name")).alias("u")).collect()
    assert out[0]["m"] is None and out[1]["m"].startswith("id_") and out[1]["e"] == "Kind" and out[0]["p"] == S.DASH and out[0]["h"] == "Unknown"
    assert out[0]["u"] == str(uuid.uuid5(uuid.NAMESPACE_URL, "name"))
    assert one(spark, x=1).select(S.ewm(F.array(F.lit(10.0), F.lit(20.0)))).first()[0] == pytest.approx(12.0)
    r = one(spark, t="Authorization: Bearer abc.def https://u:p@h/ api_key=zzz ok").select(S.redact_text("t")).first()[0]
    assert "abc" not in r and "u:p" not in r and "zzz" not in r and r.endswith("ok")


def test_message_partition_and_topics(spark):
    df = spark.createDataFrame([("customer-1",), ("",)], "k string")
    out = [r[0] for r in df.select(M.partition_for(F.col("k"), 6)).collect()]
    assert out == [zlib.crc32(b"customer-1") % 6, None]
    assert M.topic_catalog(spark).count() == 7
    with pytest.raises(ValueError):
        M.sink_frame(df, "nowhere")


def test_top_reasons_and_agreement(spark):
    df = spark.createDataFrame([("a", "device_novelty", 1.0, 0.3), ("a", "amount_z_score", 4.0, 0.5), ("a", "amount_log1p", 9.0, 0.4), ("a", "country_novelty", 0.0, 0.9)], "k string, feature string, value double, contribution double")
    assert [r["code"] for r in X.top_reasons(df, "k").orderBy("rank").collect()] == ["unusually_high_transaction_amount", "first_transaction_from_device"]
    assert X.agreement(df, df, "k").first()["agreement"] == 1.0


def test_promotion(spark):
    metrics = spark.createDataFrame([("recall", 0.8)], "metric string, value double")
    criteria = spark.createDataFrame([("recall", "min", 0.7), ("ece", "max", 0.1)], "metric string, kind string, required double")
    assert not G.promotion_verdict(G.promotion_checks(metrics, criteria)).first()["approved"]
    assert G.promotion_verdict(G.promotion_checks(metrics, criteria.limit(0))).first()["approved"]


def test_pages_are_bounded(spark):
    with pytest.raises(ValueError):
        V.page(spark.range(3), [F.col("id")], 1, 201)


def test_json_lines_keep_bad_lines(spark, tmp_path):
    from pyspark.sql.types import StructType

    (tmp_path / "a.jsonl").write_text('{"a": 1, "b": "x"}\n{not-json}\n\n{"a": "wrong", "b": "y"}\n')
    out = files.read_records(spark, str(tmp_path / "a.jsonl"), StructType.fromDDL("a int, b string")).orderBy("line_id").collect()
    assert [r["parse_ok"] for r in out] == [True, False, False] and out[1]["raw_line"] == "{not-json}"
    with pytest.raises(ValueError):
        files.read_records(spark, "x.csv")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "bad", "v")], "record_index int, issue string, x string")
    files.write_quarantine(df, f"{tmp_path}/q")
    assert '"code":"bad"' in spark.read.text(f"{tmp_path}/q").first()[0]
    for _ in range(2):  # a retry replaces its own batch
        files.write_batch(df, 7, f"{tmp_path}/b")
    files.write_batch(df, 8, f"{tmp_path}/b")
    assert spark.read.parquet(f"{tmp_path}/b").count() == 2
    files.append_log(df, f"{tmp_path}/log")
    files.append_log(df.withColumn("record_index", F.lit(5)), f"{tmp_path}/log")
    log = files.read_log(spark, f"{tmp_path}/log", df.schema)
    assert files.latest(log, "record_index").first()["record_index"] == 5 and files.read_log(spark, f"{tmp_path}/none", df.schema).count() == 0
    assert files.file_hashes(spark, f"{tmp_path}/q/*.txt").count() == 1
    files.write_results({"t": df}, f"{tmp_path}/r")
    files.write_report(df, f"{tmp_path}/one")
    nested = files.nested(spark.createDataFrame([("e", True, "t")], "event_id string, fraud_label boolean, fraud_type string"), ["event_id"])
    assert nested.first()["event"]["event_id"] == "e"


def test_quality_profile_compares_whole_documents(spark, tmp_path):
    from riskweave.plans import queries

    long = "the same start " * 200
    rows = [(1, long + "a", "en", "x", 3001), (1, long + "a", "en", "x", 3001), (2, long + "b", "en", "x", 3001), (3, "the end", "en", "x", 7), (4, "the ear", "en", "x", 7)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert tuple(queries.QUERIES["d28_g05_quality_profile"](spark, str(tmp_path)).first()) == (5, 5, 1)


def test_permutation_importance_moves_all_rows(spark, monkeypatch):
    from riskweave.operators import ml

    seen = []

    def scored(model, rows, out="score"):
        seen.append(rows.toPandas())
        return rows.withColumn("score", F.col("a").cast("double"))

    monkeypatch.setattr(ml, "scored_by", scored)
    df = spark.range(1300).select(F.col("id").alias("k"), (F.col("id") >= 900).cast("int").alias("label"), F.col("id").cast("double").alias("a"), (F.col("id") * 2.0).alias("b"))
    out = {r["feature"]: r for r in ml.permutation_importance(None, df, "k", ["a", "b"], repeats=3).collect()}
    assert out["a"]["importance"] > 0.5 and abs(out["b"]["importance"]) < 1e-9
    one = seen[0].groupby(["feature", "repeat"])
    assert set(one.size()) == {1300} and len(one) == 7 and (one["a"].sum() == 1299 * 650).all() and (one["b"].sum() == 1299 * 1300).all()
    assert all((g["b"] == 2 * g["a"]).mean() < 0.05 for k, g in one if k[0])


def test_first_wins_loses_no_rows_at_its_limit(spark):
    chain = spark.createDataFrame([(i, f"e{i // 2}", f"t{(i + 1) // 2}") for i in range(8)], "o int, event_id string, transaction_id string")
    with pytest.raises(RuntimeError):
        C.first_wins(chain, "o", max_rounds=1)
    assert C.first_wins(chain, "o", max_rounds=8).count() == 8
    with pytest.raises(RuntimeError):  # components that are too large for a task go on in rounds
        C.first_wins(chain.unionByName(chain.selectExpr("o + 8 as o", "concat('x', event_id) as event_id", "concat('x', transaction_id) as transaction_id")), "o", max_rounds=4, component_rows=1)


def test_first_wins_decides_long_chains_by_component(spark):
    """Chains, a hub, and null keys that lead from one part to another, with fewer rounds than a chain has rows."""
    rows = [(i, f"e{i // 2}", f"t{(i + 1) // 2}") for i in range(400)] + [(400 + i, None, f"h{i % 3}") for i in range(20)] + [(430 + i, "hub", f"u{i // 2}") for i in range(30)]
    rows += [(500 + i, f"v{i // 2}", f"w{(i + 1) // 2}") for i in range(60)] + [(600, "v3", "e-alone"), (601, None, None), (602, None, None)]
    seen, want = set(), {}
    for o, a, b in rows:
        own = {("a", a), ("b", b)} - {("a", None), ("b", None)}
        want[o] = not seen.isdisjoint(own)
        if not want[o]:
            seen |= own
    df = spark.createDataFrame(rows, "o int, event_id string, transaction_id string").repartition(3)
    for component_rows in (C.COMPONENT_ROWS, 100):
        kept = df if component_rows > 400 else df.where("o >= 400")
        out = {r["o"]: r["duplicate"] for r in C.first_wins(kept, "o", max_rounds=8 if component_rows > 400 else 40, component_rows=component_rows).collect()}
        assert out == {o: d for o, d in want.items() if o in out} and len(out) == kept.count()


def test_components(spark):
    from riskweave.operators.graph import components

    edges = [(k, k + 1) for k in range(100, 160)] + [(5, 900 + k) for k in range(30)] + [(7, 7), (3, 5)]
    out = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert out == {**dict.fromkeys(range(100, 161), 100), **dict.fromkeys([5, 3, *range(900, 930)], 3), 7: 7}


def test_moving_average_sees_all_ties(spark):
    """300 events at one instant after one of 100.0: each sees that one; the event after them sees all."""
    rows = [("e000", 0, 100.0)] + [(f"e{k:03d}", 1, 50.0 + k) for k in range(1, 301)] + [("f", 2, 1.0)]
    df = spark.createDataFrame(rows, "event_id string, day int, transaction_amount double").selectExpr(
        "event_id", "'c' as customer_id", "'m' as merchant_id", "'d' as device_id", "'US' as country", "'x' as merchant_category", "transaction_amount", "'purchase' as transaction_type",
        "'approved' as transaction_status", "true as card_present", "0D as latitude", "0D as longitude", "timestamp_seconds(day * 86400) as event_time",
    )
    out = {r["event_id"]: r["customer_ewm_amount"] for r in B.behavioural_features(df).collect()}
    average = 100.0
    for k in range(1, 301):
        assert out[f"e{k:03d}"] == pytest.approx(100.0)
        average = 0.2 * (50.0 + k) + 0.8 * average
    assert out["e000"] == 0.0 and out["f"] == pytest.approx(average)


def test_rows_with_keys_of_their_own_enter_no_round(spark):
    rows = [(k, f"e{k}", f"t{k}") for k in range(20)] + [(20, "e3", "t99"), (21, None, None), (22, None, "t5")]
    df = spark.createDataFrame(rows, "o int, event_id string, transaction_id string")
    out = {r["o"]: r["duplicate"] for r in C.first_wins(df, "o", max_rounds=1).collect()}
    assert out == {k: k in (20, 22) for k in range(23)}


def test_quality_profile_tells_nulls_apart(spark):
    from riskweave.operators import drift as R

    df = spark.createDataFrame([(None, "a"), ("a", None), ("a", None), (None, None)], "x string, y string")
    assert R.duplicate_rows(df).first()[0] == 1 and R.quality_profile(df).first()["row_count"] == 4
    assert R.quality_profile(df.limit(0)).select("row_count", "duplicate_rows").first() == (0, 0)


def test_exact_windows_count_as_repeated_rows_do(spark, sf):
    """Panes give what grouping each event once per window gives."""
    from riskweave.operators import windows as W

    df = txn(spark, sf)
    got = W.customer_windows(df, "30 minutes", "10 minutes", exact=True)
    want = df.groupBy(F.window("event_time", "30 minutes", "10 minutes").alias("w"), F.col("customer_id").alias("entity_id")).agg(
        F.count("*").alias("transaction_count"), F.count_distinct("merchant_id").alias("unique_merchants"), F.count_distinct("device_id").alias("unique_devices")
    )
    names = ("entity_id", "transaction_count", "unique_merchants", "unique_devices")
    want = want.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *names)
    assert got.select("window_start", "window_end", *names).exceptAll(want).count() == 0 and got.count() == want.count()


def test_stores_keep_history_and_give_the_latest(spark, sf, tmp_path):
    from riskweave.operators import drift as R
    from riskweave.sources import stores

    df = txn(spark, sf)
    kept = stores.manifests(spark, f"{tmp_path}/manifests")
    assert kept.all().count() == 0 and kept.latest().count() == 0
    for t, rows in ((1, df), (2, df.where("k > 0")), (3, df)):
        kept.record(R.manifest(rows, f"v{t}", "events", "features-1"), "events", t)
    kept.record(R.manifest(df, "v1", "events", "features-1"), "other", 1)
    one = {r["name"]: r for r in kept.latest().collect()}
    assert one["events"]["version"] == "v3" and one["other"]["row_count"] == df.count() and [r["version"] for r in kept.history("events").collect()] == ["v1", "v2", "v3"]
    assert one["events"]["checksum"] == kept.history("events").first()["checksum"]
    reports = stores.drift_reports(spark, f"{tmp_path}/drift")
    reports.record(R.drift_report(df.where("k < 50"), df.where("k >= 50"), ["k", "country"]), "halves")
    assert {r["column"]: r["drifted"] for r in reports.latest("column").collect()}["k"]
    metrics = stores.run_metrics(spark, f"{tmp_path}/metrics")
    for t, v in ((1, 0.5), (2, 0.75)):
        metrics.record(spark.createDataFrame([("recall", v)], "metric string, value double"), "run-1", t)
    assert metrics.latest("metric").first()["value"] == 0.75


def test_ingestion_options(spark, tmp_path):
    import json

    from pyspark.sql.types import StructType

    good = dict(event_id="e1", transaction_id="t1", customer_id="ccc", account_id="aaa", card_id="ddd", merchant_id="mmm", merchant_category="food", transaction_amount=1.0, currency="usd", transaction_type="purchase", channel="pos", country="us", city="Town",
                latitude=1.0, longitude=1.0, device_id="ddd", ip_address="192.0.2.1", card_present=True, authentication_method="pin", transaction_status="approved", event_version=1, event_time="2024-01-01T00:00:00Z", ingestion_time="2024-01-01T00:00:01Z", fraud_label=True)
    rows = [good, good, {**good, "event_id": "e2", "transaction_id": "t2", "fraud_label": None}, {**good, "event_id": "e3", "transaction_id": "t3", "merchant_category": "toys"}, {**good, "event_id": "e4", "transaction_id": "t4", "transaction_amount": -1.0}]
    path = f"{tmp_path}/in.jsonl"
    with open(path, "w") as f:
        f.write("\n".join([*map(json.dumps, rows), "{not json"]))
    kinds = {"transaction_amount": "double", "latitude": "double", "longitude": "double", "card_present": "boolean", "event_version": "bigint", "fraud_label": "boolean", "event_time": "timestamp", "ingestion_time": "timestamp"}
    schema = StructType.fromDDL(", ".join(f"{k} {kinds.get(k, 'string')}" for k in good))
    out = [r["issue"] for r in files.ingested(spark, path, schema).orderBy("record_index").collect()]
    assert out == [None, "duplicate_event", None, None, "schema_error", "invalid_record"]
    out = [r["issue"] for r in files.ingested(spark, path, schema, require_labels=True, allowed_categories=("food",)).orderBy("record_index").collect()]
    assert out == [None, "duplicate_event", "missing_label", "invalid_category", "schema_error", "invalid_record"]


def test_results_come_with_config_and_metadata(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0)], "k int, v double")
    files.write_results({"one": df}, str(tmp_path), {"seed": 42, "names": ["a"]}, df.select("k"))
    assert spark.read.option("header", True).csv(f"{tmp_path}/one").count() == 1
    assert {r["name"]: r["value"] for r in spark.read.json(f"{tmp_path}/config").collect()} == {"seed": "42", "names": '["a"]'} and spark.read.json(f"{tmp_path}/metadata").first()["k"] == 1


def test_scored_rows_have_sixteen_columns(spark):
    rows = spark.createDataFrame([("e1", 0.9, 1.0, 0.4), ("e2", 0.0, None, None)], "event_id string, rule_score double, device_novelty double, p double")
    out = D.scored_rows(rows, ["device_novelty"], F.lit("2024-01-01").cast("timestamp"), calibrated_probability=F.col("p"))
    assert len(out.columns) == 16 + 3 and out.columns[3:6] == ["prediction_message_id", "prediction_produced_at", "model_probability"]
    r = {x["event_id"]: x for x in out.collect()}
    assert r["e1"]["final_risk_score"] == pytest.approx((0.7 * 0.4 + 0.2 * 0.9) / 0.9) and r["e1"]["features_json"] == '{"device_novelty":1.0}' and r["e2"]["features_json"] == "{}"
    assert r["e2"]["final_risk_score"] == 0.0 and r["e2"]["action"] == "allow"
    with pytest.raises(TypeError):
        D.scored_rows(rows, [], F.lit(None), probability=F.col("p"))


def test_deciles_by_brackets_are_exact(spark, monkeypatch):
    """Ties, gaps, a constant, few values and nulls; and all columns are ranked where a bracket misses."""
    import random

    import numpy as np

    from riskweave.operators import drift as D

    rng = random.Random(6)
    rows = [(rng.gauss(0, 1), float(rng.randrange(4)), 7.0, rng.choice([None, -1e9, 1e9, rng.random()]), None if k else 2.5) for k in range(3000)]
    names = list("abcde")
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).repartition(5)
    for missed in (False, True):
        if missed:
            monkeypatch.setattr(D, "AROUND", -0.2)
        out = {r["column"]: r for r in D._deciles(df, names).collect()}
        for k, c in enumerate(names):
            values = [r[k] for r in rows if r[k] is not None]
            assert out[c]["n"] == len(values) and out[c]["mean"] == pytest.approx(np.mean(values), abs=1e-4)
            assert list(out[c]["edges"]) == pytest.approx(np.unique(np.quantile(values, [i / 10 for i in range(11)])).tolist())
    assert D._deciles(df.limit(0), names).count() == 0
