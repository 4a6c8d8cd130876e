"""Sliced histories give the features of whole ones; blocks and distinct counts against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.operators import features as B
from riskweave.operators import slices as S
from riskweave.plans.fixtures import txn

SCHEMA = "event_id string, customer_id string, merchant_id string, device_id string, country string, merchant_category string, transaction_amount double, transaction_type string, transaction_status string, card_present boolean, latitude double, longitude double, seconds long"


def history(seed, n, span):
    """Ties, gaps of days, nulls in attributes and amounts, and a customer without an id."""
    rng, rows = random.Random(seed), []
    for k in range(n):
        pick = lambda *x: rng.choice(x)
        rows.append((f"e{k:05d}", pick("a", "a", "a", "b", None), pick("m1", "m2", "m3", None), pick("d1", "d2"), pick("US", "DE", None), pick("x", "y"), pick(10.0, 10.0, 7.25, 1e4, 0.1, None), pick("purchase", "refund"),
                     pick("approved", "declined", None), pick(True, False, None), float(rng.randrange(50)), float(rng.randrange(50)), rng.randrange(span) // 3 * 3))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("event_time", F.timestamp_seconds(F.col("seconds") + 1_704_067_200)).withColumns({c: F.lit("clash") for c in ("row", "c", "slice", "own", "us", "key", "kind", "amount")})


def found(df):
    pdf = df.select("event_id", *B.FEATURES).toPandas().set_index("event_id").sort_index()
    assert pdf.index.is_unique
    return pdf


@pytest.mark.parametrize("history_seconds", [None, 3600, 5 * 86_400])
def test_slices_equal_whole_histories(spark, history_seconds):
    events = frame(spark, history(1, 700, 40 * 86_400) + [("late", "a", "m1", "d1", "US", "x", 5.0, "purchase", "approved", True, 1.0, 1.0, 400 * 86_400)])
    whole = found(B.behavioural_features(events, history_seconds))
    cut = found(B.behavioural_features(events, history_seconds, slice_events=25))
    assert len(whole) == len(cut) == 701
    np.testing.assert_allclose(whole.to_numpy(float), cut.to_numpy(float), rtol=1e-9, atol=1e-9)
    rows, days = S.sliced(events.selectExpr("customer_id as c", "unix_micros(event_time) as us", "event_id as id"), 25, 86_400 * S.SECOND)
    most = rows.where("own").groupBy("c", "slice").count().agg(F.max("count")).first()[0]
    assert days.select("c").distinct().count() == 3 and most < 60 and rows.where("own").count() == 701


def test_a_slice_by_a_loop(spark):
    """Features of one dense customer against their definitions, event by event."""
    rng = random.Random(5)
    rows = [(f"e{k:03d}", "a", rng.choice(["m1", "m2", "m3"]), rng.choice(["d1", "d2"]), "US", "x", round(rng.random() * 100, 2), "purchase", "approved", True, 0.0, 0.0, rng.randrange(3 * 86_400) // 60 * 60) for k in range(300)]
    out = found(B.behavioural_features(frame(spark, rows), slice_events=90))
    for row in rows:
        t = row[-1]
        prior = sorted((r for r in rows if r[-1] < t), key=lambda r: (r[-1], r[0]))
        day, hour = ([r for r in prior if r[-1] >= t - s] for s in (86_400, 3600))
        got = out.loc[row[0]]
        average = 0.0
        for k, r in enumerate(prior):
            average = r[6] if not k else 0.2 * r[6] + 0.8 * average
        same = [r for r in hour if r[2] == row[2]]
        expected = {
            "customer_prior_transaction_count": len(prior), "customer_prior_amount_max": max((r[6] for r in prior), default=0), "customer_prior_amount_std": np.std([r[6] for r in prior]) if prior else 0, "customer_ewm_amount": average,
            "recent_amount_sum_24h": sum(r[6] for r in day), "recent_amount_std_1h": np.std([r[6] for r in hour]) if hour else 0, "rolling_transaction_min_1h": min((r[6] for r in hour), default=0),
            "unique_merchants_24h": len({r[2] for r in day}), "unique_devices_24h": len({r[3] for r in day}), "merchant_popularity": sum(r[2] == row[2] for r in day), "merchant_novelty": float(all(r[2] != row[2] for r in prior)),
            "customer_seconds_since_previous": t - prior[-1][-1] if prior else -1, "merchant_transaction_velocity_1h": len(same) / max((t - same[-1][-1]) / 3600, 1 / 60) if same else 0,
        }
        for name, value in expected.items():
            assert got[name] == pytest.approx(value, abs=1e-9), (row[0], name)


def test_equal_amounts_have_no_spread(spark):
    """No rounding from sums of squares, however long the history and wherever it is cut."""
    rows = [(f"e{k:05d}", "a", "m", "d", "US", "x", 12.34 if k > 50 else 9e5 + k, "purchase", "approved", True, 0.0, 0.0, k * 600) for k in range(800)]
    out = found(B.behavioural_features(frame(spark, rows), slice_events=100))
    assert (out["recent_amount_std_24h"].iloc[250:] == 0).all() and (out["recent_amount_mean_1h"].iloc[250:] == 12.34).all()


def test_odd_times_and_tables(spark):
    rows = history(2, 60, 86_400)
    events = frame(spark, rows).withColumn("event_time", F.when(F.col("event_id") != "e00003", F.col("event_time")))
    whole, cut = found(B.behavioural_features(events)), found(B.behavioural_features(events, slice_events=5))
    np.testing.assert_allclose(whole.drop(index="e00003").to_numpy(float), cut.drop(index="e00003").to_numpy(float), rtol=1e-9, atol=1e-9)
    assert whole.loc["e00003", "customer_prior_transaction_count"] == 0 and B.behavioural_features(events.limit(0)).count() == 0
    out = B.behavioural_features(events)
    assert out.columns == [*events.columns, *B.FEATURES] and out.where("own = 'clash' and row = 'clash'").count() == 60


def test_blocks_and_distinct_counts():
    rng = np.random.default_rng(3)
    sizes = np.array([1, 7, 0, 64, 33])
    x = rng.random(sizes.sum()) * 100
    leaves = S.nothing(len(x))
    leaves[S.COUNT], leaves[S.N], leaves[S.MEAN], leaves[S.SUM], leaves[S.HIGH], leaves[S.LOW], leaves[S.AVERAGE] = 1, 1, x, x, x, x, S.EWM_ALPHA * x
    blocks, starts = S.Blocks(leaves, sizes), np.cumsum(sizes) - sizes
    group = rng.choice([0, 1, 3, 4], 400)
    a, b = (starts[group] + rng.integers(0, sizes[group] + 1) for _ in range(2))
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    out = blocks.over(group, lo, hi)
    for k in range(400):
        part = x[lo[k] : hi[k]]
        assert out[S.COUNT, k] == len(part)
        if len(part):
            average = sum(S.EWM_ALPHA * v * S.KEEP**j for j, v in enumerate(part[::-1]))
            assert np.allclose(out[[S.MEAN, S.M2, S.HIGH, S.LOW, S.SUM, S.AVERAGE], k], [part.mean(), part.var() * len(part), part.max(), part.min(), part.sum(), average])
    codes, known = rng.integers(0, 6, 200), rng.random(200) < 0.8
    lo, hi = (np.sort(rng.integers(0, 201, 90)) for _ in range(2))
    hi = np.maximum(lo, hi)
    known = np.isin(codes, codes[known])  # a code is known or not
    assert (S.distinct(codes, known, lo, hi) == [len(set(codes[i:j][known[i:j]])) for i, j in zip(lo, hi, strict=True)]).all()


def test_a_slice_holds_little_of_each_row_it_looks_back_on():
    """Rows that are not a slice's own come without the event, without room for a state, and are not copied to tell kinds apart."""
    import pyarrow as pa

    n = 1000
    kind = np.repeat([0, 2], [1, n])
    table = pa.table({"x": np.arange(n + 1.0)})
    part = S._stretches(table, kind == 2)
    assert part["x"].chunk(0).buffers()[1].address == table["x"].chunk(0).buffers()[1].address and part.num_rows == n
    assert S._stretches(table, kind == 1) is None and S._stretches(table, kind == 0)["x"].to_pylist() == [0.0]


def made_slices(sizes, step=1000):
    """Rows as a task gets them, in batches: slices of these sizes, some with a state and what was seen before."""
    import pyarrow as pa

    rng, rows = np.random.default_rng(7), []
    for k, n in enumerate(sizes):
        if k % 2:
            rows.append({"key": k, "kind": 0, "state": rng.random(17).round(3).tolist()})
            rows.append({"key": k, "kind": 1, "attribute": 0, "value": "a"})
        for us in np.sort(rng.integers(0, 3 * n, n)) * 7_200 * S.SECOND:
            own = bool(rng.random() < 0.8)
            rows.append({"key": k, "kind": 2, "own": own, "us": int(us), "amount": float(rng.random()), "latitude": 1.0, "longitude": float(rng.random()), **{a: rng.choice(["a", "b", "c"]) for a in S.ATTRIBUTES}, **dict.fromkeys(S.FLAGS, int(us) // 7_200 // S.SECOND % 2), "row": [len(rows)] if own else None})
    kinds = {"key": pa.int64(), "kind": pa.int32(), "row": pa.list_(pa.int64()), "own": pa.bool_(), "us": pa.int64(), "amount": pa.float64(), "latitude": pa.float64(), "longitude": pa.float64(), **dict.fromkeys(S.ATTRIBUTES, pa.string()), **dict.fromkeys(S.FLAGS, pa.int32()), "attribute": pa.int32(), "value": pa.string(), "state": pa.list_(pa.float64())}
    return pa.Table.from_pylist(rows, pa.schema(list(kinds.items()))).to_batches(step)


@pytest.mark.parametrize("look_back", [None, 86_400 * S.SECOND])
def test_a_task_works_out_few_rows_at_a_time(monkeypatch, look_back):
    """Parts of a slice are those of the slice worked out whole, and a large slice isn't held together with those before it."""
    import pyarrow as pa

    batches, folds = made_slices([3, 40, 1, 300, 90, 2, 150, 30, 30], 13), []
    whole = pa.Table.from_batches(list(S._whole_slices(iter(batches), look_back)))
    monkeypatch.setattr(S, "PART_ROWS", 16, raising=False)
    monkeypatch.setattr(S, "ROWS", 100)
    monkeypatch.setattr(S, "_let_go", lambda held, go=S._let_go: folds.append(sum(b.num_rows for b in held)) or go(held))
    parts = list(S._whole_slices(iter(batches), look_back))
    assert max(p.num_rows for p in parts) <= 16
    assert max(folds) <= 302 and sum(folds) == sum(b.num_rows for b in batches) and min(folds[:-1]) > 30
    assert pa.Table.from_batches(parts).combine_chunks().equals(whole.combine_chunks())


def test_folding_takes_little_for_a_row_of_a_large_slice():
    import tracemalloc

    batches = made_slices([40_000])
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in S._whole_slices(iter(batches), None))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert 30_000 < rows < 40_000 and peak < 550 * 40_000, peak / 40_000
