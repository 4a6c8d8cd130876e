"""What larger tables than the given ones brought up."""

import duckdb
import pytest
from pyspark.sql import functions as F

from riskweave.plans import queries


def of_sql(name, folder):
    """Sorted rows of a query's SQL over a folder's events, by names of columns."""
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    found = con.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    return names, sorted(found.fetchall())


@pytest.fixture
def events_with_zero_amounts(spark, sf, tmp_path):
    """The events, of which some are worth nothing, as at sf0.1 but not in the smaller tables."""
    rows = spark.read.parquet(f"{sf}/events.parquet").limit(60)
    rows.withColumn("value", F.when(F.col("event_id") % 5 == 1, 0.0).otherwise(F.col("value"))).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_events_worth_nothing_are_valid_records_of_the_log(spark, events_with_zero_amounts):
    """Only planted records are bad, whatever the amounts of the table."""
    bad = lambda n: n % 97 == 0 or n % 89 == 0 or n % 83 == 0
    found = queries.QUERIES["b01_b02_b04_b05_parsed_log"](spark, events_with_zero_amounts).collect()
    assert len(found) == 60 and all((r["verdict"] != "valid") == bad(r["source_offset"]) for r in found)
    letters = queries.QUERIES["a16_dead_letters"](spark, events_with_zero_amounts).collect()
    assert {r["original_offset"] for r in letters} == {r["source_offset"] for r in found if bad(r["source_offset"])}


@pytest.mark.parametrize("name", ["a26_dead_letters_with_attempts", "a26_failed_records"])
def test_records_of_a_log_are_not_broadcast(spark, sf, name):
    """Their texts are many times as long as Spark guesses."""
    assert "Broadcast" not in queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_a_dense_day_is_cut_into_cells(spark):
    """Slices of a customer with very many events a day hold less of their own than a day, and each has all it looks back on."""
    from riskweave.operators import slices as S

    day, n = 86_400 * S.SECOND, 1600
    events = spark.range(n).select(F.lit("a").alias("c"), (F.col("id") * (2 * day // n)).alias("us"), "id")
    rows, _ = S.sliced(events, 50, day)
    sizes = rows.groupBy("slice").agg(F.count(F.when(F.col("own"), 1)).alias("own"), F.min(F.when(F.col("own"), F.col("us"))).alias("first"), F.collect_set("us").alias("us")).collect()
    assert sum(r["own"] for r in sizes) == n and max(r["own"] for r in sizes) <= 50 + n // 2 // S.CELLS
    every = [r["us"] for r in events.select("us").collect()]
    assert all({t for t in every if r["first"] - day <= t <= r["first"]} <= set(r["us"]) and len(r["us"]) <= n // 2 + 3 * n // 2 // S.CELLS for r in sizes)


@pytest.mark.parametrize("name", ["d21_bootstrap_mean", "d22_bootstrap_metric"])
def test_bootstraps_multiply_no_rows(spark, sf, name):
    assert "Generate" not in queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_long_paths_take_few_rounds(spark, monkeypatch):
    """Each task puts its stretch of a path together before the rounds, which are for what tasks share."""
    from riskweave.operators import graph

    calls = []
    monkeypatch.setattr(graph, "checkpointed", lambda df, cut=graph.checkpointed: calls.append(1) or cut(df))
    edges = spark.range(3000).repartitionByRange(2, "id").selectExpr("id as u", "id + 1 as v")
    assert {tuple(r) for r in graph.components(edges).collect()} == {(k, 0) for k in range(3001)}
    assert len(calls) <= 6


def test_anomaly_flags_make_inputs_and_scores_once(spark, sf):
    """What flags are read from has no windows over events and no trees left in it."""
    from riskweave.plans import ml_queries

    plan = ml_queries.QUERIES["k05_anomaly_flags"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Python" not in plan


@pytest.mark.parametrize("name", ["i01_rule_scores", "a22_prediction_round_trip", "b12_accepted_and_alerting", "d38_label_counts"])
def test_amounts_exactly_three_deviations_off_are_judged_as_by_sql(spark, tmp_path, name):
    """The third amount of each customer is as far beyond the first as that is beyond the second: rounding decides."""
    u, k = F.floor(F.col("id") / 3), F.col("id") % 3
    cents = F.pmod(F.hash(u), F.lit(20_000)) + F.element_at(F.array(F.lit(1), F.lit(0), F.lit(2)), (k + 1).cast("int")) * (F.pmod(F.hash(u, F.lit(1)), F.lit(20_000)) + 1)
    time = F.timestamp_micros((1_704_067_200 + u + k * 86_400) * 1_000_000).cast("timestamp_ntz")
    rows = spark.range(1800).select(F.col("id").alias("event_id"), time.alias("ts"), u.alias("user_id"), F.lit("purchase").alias("event_type"), F.round(cents / 100.0, 2).alias("value"), F.lit('{"k": 10}').alias("props"))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    names, want = of_sql(name, tmp_path)
    assert sorted(tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).select(*names).collect()) == want
