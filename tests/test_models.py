"""Models, tuning, compatibility, research runs and the feature registry, on few rows and trees."""

import pytest
from pyspark.sql import functions as F

from riskweave.operators import features as B
from riskweave.operators import ml
from riskweave.plans.ml_queries import rows

INPUTS = ["amount_z_score", "device_novelty", "transaction_amount"]


@pytest.fixture(scope="module")
def events(spark, sf):
    """Labels follow the amount, so that there is something to learn."""
    df = rows(spark, sf).withColumn("label", (F.col("transaction_amount") + 20 * (F.col("k") % 7) > 900).cast("double"))
    return df.select("event_id", "us", "country", "customer_id", "merchant_id", "device_id", "transaction_id", "label", "rule_score", *INPUTS).persist()


def test_models_learn_and_come_back_from_disk(spark, events, tmp_path):
    models, metrics, skipped = ml.train_baselines(events, INPUTS, ("logistic_regression", "boosted_trees", "svm"), trees=3)
    assert set(models) == {"logistic_regression", "boosted_trees"} and "svm" in skipped
    area = {(r["model"], r["split"]): r["average_precision"] for r in metrics.collect()}
    share = events.agg(F.avg("label")).first()[0]
    assert len(area) == 4 and all(a > share for a in area.values())
    path = f"{tmp_path}/model"
    ml.save_model(models["logistic_regression"], path)
    again = ml.load_model(path)
    a, b = (ml.scored_by(m, events.limit(50)).select("event_id", "score") for m in (models["logistic_regression"], again))
    assert a.exceptAll(b).count() == 0
    assert ml.compatibility(again, INPUTS) == [] and ml.compatibility(again, INPUTS[::-1]) == ["inputs are in another order"]
    assert ml.compatibility(again, [*INPUTS[:2], "k"]) == ["missing: k", f"unexpected: {INPUTS[2]}"]


def test_tuning_picks_the_best_trial(events):
    best, trials = ml.tune(events, INPUTS, [{"regParam": 0.0}, {"regParam": 100.0}])
    assert len(trials) == 2 and dict(best) == max(trials, key=lambda t: t[1])[0]


def test_research_run_has_all_tables(events):
    out = ml.research_run(events, INPUTS, names=("logistic_regression",), resamples=20, trees=3)
    assert set(out) == {"metrics", "intervals", "thresholds", "reliability", "errors", "segments", "ablation", "skipped"}
    for r in out["intervals"].collect():
        assert 0 <= r["low"] <= r["high"] <= 1
    assert {r["metric"] for r in out["intervals"].collect()} == {"precision", "recall"}
    assert {r["combination"] for r in out["ablation"].collect()} == {"supervised_only", "rules_only", "supervised_rules", "full_hybrid"}
    assert "without_device_risk" in {r["name"] for r in out["skipped"].collect()}
    assert out["thresholds"].count() == 5 and out["reliability"].count() > 1


def test_models_see_features_only(events):
    with pytest.raises(ValueError, match="customer_id"):
        ml.model_inputs(events, ["customer_id"])
    with pytest.raises(ValueError, match="is_night"):
        ml.model_inputs(events, ["is_night"])


def test_feature_registry(spark):
    r = B.feature_registry(spark)
    assert r.count() == len(B.FEATURES) == 56 and r.where("not point_in_time_safe").count() == 0 and r.where("source = 'event'").count() == 8
    df = spark.createDataFrame([("features-1",), ("features-0",)], "feature_version string")
    assert B.require_version(df.limit(1)).count() == 1
    with pytest.raises(ValueError, match="features-0"):
        B.require_version(df)
