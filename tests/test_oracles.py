"""Every batch query against its SQL on the smallest tables."""

import glob
import os
from decimal import Decimal

import duckdb
import pytest

from riskweave.plans import ml_queries, queries


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def shown(v):
    """Values of both engines as text: missing ones alike, numbers to six places whatever their type."""
    if v is None or v != v:
        return "null"
    if isinstance(v, (list, tuple)):
        return str([shown(x) for x in v])
    if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool):
        return f"{v}.000000" if isinstance(v, int) else f"{v:.6f}"
    return str(v)


def rows(names, found):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(shown(r[k]) for k in order) for r in found)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, sf, duck, name):
    got, want = queries.QUERIES[name](spark, sf), duck.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(ml_queries.ORACLES))
def test_fits_take_the_steps_of_their_sql(spark, sf, duck, name):
    got, want = ml_queries.QUERIES[name](spark, sf), duck.execute(ml_queries.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_queries_without_sql_run(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0


def test_models(spark, sf):
    """Invariants of what SQL can't express."""
    q = {n: f(spark, sf).toPandas() for n, f in ml_queries.QUERIES.items() if n not in ml_queries.ORACLES and n not in ("k13_permutation_importance", "k01_k02_k03_baselines", "k14_counterfactuals")}
    assert q["k08_distributed_scores"]["score"].between(0, 1).all()
    iso = q["k05_isolation_scores"]
    assert iso["anomaly"].between(0, 1).all() and iso["scaled"].min() == 0 and iso["scaled"].max() == 1
    flags = q["k05_anomaly_flags"]
    assert flags[flags["is_anomaly"]]["anomaly"].min() > flags[~flags["is_anomaly"]]["anomaly"].max() and 0 < flags["is_anomaly"].mean() < 0.6
    curve = q["k10_isotonic_calibration"].sort_values("score")
    assert curve["calibrated"].is_monotonic_increasing and curve["calibrated"].between(0, 1).all()
    platt = q["k09_platt_calibration"].sort_values("score")["calibrated"]
    assert platt.is_monotonic_increasing or platt.is_monotonic_decreasing
    con = q["k12_removal_contributions"]
    assert ((con["score"] - con["resulting_score"]) - con["contribution"]).abs().max() < 1e-12 and con.groupby("event_id").size().nunique() == 1


def test_bootstrap_covers_the_estimate(spark, sf):
    r = queries.QUERIES["d21_bootstrap_mean"](spark, sf).first()
    assert r["low"] < r["estimate"] < r["high"]


def test_manifest_ignores_row_order(spark, sf):
    from riskweave.operators.drift import manifest
    from riskweave.plans.fixtures import txn

    df = txn(spark, sf)
    one = manifest(df, "v", "s", "f").first()["checksum"]
    assert manifest(df.orderBy("k"), "v", "s", "f").first()["checksum"] == one
    assert manifest(df.where("k > 0"), "v", "s", "f").first()["checksum"] != one
