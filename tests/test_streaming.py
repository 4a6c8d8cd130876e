"""Streams on files: lateness, duplicates, restarts, replay, and parity with the batch features."""

import pytest
from pyspark.sql import functions as F

from riskweave.operators import features as B
from riskweave.operators import messages as M
from riskweave.plans.fixtures import txn
from riskweave.plans.queries import log_records
from riskweave.sources.logs import read_log_files
from riskweave.streaming import jobs
from riskweave.streaming.state import INPUT, replayed, stateful_features

SCHEMA = "event_id string, transaction_id string, correlation_id string, customer_id string, merchant_id string, device_id string, country string, merchant_category string, transaction_amount double, transaction_type string, transaction_status string, card_present boolean, latitude double, longitude double, us bigint"


def event(k, minutes, **changes):
    row = dict(
        event_id=f"e{k}", transaction_id=f"t{k}", correlation_id=f"r{k}", customer_id="c", merchant_id="m", device_id="d", country="US", merchant_category="x", transaction_amount=25.0, transaction_type="purchase",
        transaction_status="approved", card_present=True, latitude=1.0, longitude=1.0, us=minutes * 60_000_000 + 1_704_067_200_000_000,
    )
    return tuple({**row, **changes}.values())


ARRIVALS = [(1, 0), (2, 5), (2, 5), (3, 3), (4, 60), (5, 10)]


def test_replay_of_late_and_duplicate_events(spark):
    df = spark.createDataFrame([(*event(k, m), n) for n, (k, m) in enumerate(ARRIVALS)], SCHEMA + ", n int")
    out = replayed(df, "n").collect()
    assert [r["accepted"] for r in out] == [True, True, False, True, True, False]
    assert [r["reason"] for r in out if not r["accepted"]] == ["duplicate_event", "event_beyond_watermark"]
    assert out[3]["customer_prior_transaction_count"] == 1 and out[2]["customer_prior_transaction_count"] is None


def run(spark, folder, out, name):
    stream = spark.readStream.schema(SCHEMA).parquet(folder)
    q = stateful_features(stream).writeStream.option("checkpointLocation", f"{out}/cp").outputMode("append").trigger(availableNow=True).format("parquet").start(f"{out}/{name}")
    q.awaitTermination(240)
    q.stop()


def test_stream_tells_late_events_and_survives_a_restart(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path)
    spark.createDataFrame([event(1, 0), event(2, 60)], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    run(spark, folder, out, "rows")
    spark.createDataFrame([event(3, 61), event(2, 60), event(4, 10), event(5, 20)], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    run(spark, folder, out, "rows")
    got = {(r["event_id"], r["accepted"]): r for r in spark.read.parquet(f"{out}/rows").collect()}
    assert got["e3", True]["customer_prior_transaction_count"] == 2 and got["e2", False]["reason"] == "duplicate_event"
    assert got["e4", False]["reason"] == got["e5", False]["reason"] == "event_beyond_watermark"


def test_in_order_replay_equals_batch(spark, sf):
    events = txn(spark, sf).withColumn("correlation_id", F.lit("r")).withColumn("us", F.unix_micros(F.col("event_time").cast("timestamp")))
    events = events.where("customer_id < 'customer-000003'")
    held = replayed(events, "us", retention_seconds=86_400)
    batch = B.behavioural_features(events, history_seconds=86_400)
    assert set(INPUT) <= set(events.columns) | {"event_time"}
    for c in B.FEATURES:
        gap = held.select("event_id", F.col(c).alias("a")).join(batch.select("event_id", F.col(c).alias("b")), "event_id").agg(F.max(F.abs(F.col("a") - F.col("b")))).first()[0]
        assert gap == pytest.approx(0, abs=1e-6), c


def test_jobs_end_to_end_and_replay(spark, sf, tmp_path):
    folder = str(tmp_path / "log")
    log = log_records(spark, sf).persist()
    log.coalesce(2).write.parquet(folder)
    for name in ("a", "b"):  # the second run replays from the start, with checkpoints of its own
        out = f"{tmp_path}/{name}"
        queries = jobs.start_all(read_log_files(spark, folder), out, interval=None)
        jobs.wait_all(queries, 240)
        jobs.stop_all(queries)
    valid, bad = M.split_valid(M.parsed(log))
    read = {n: spark.read.parquet(f"{tmp_path}/a/{n}") for n in ("dead_letter", "validated", "predictions", "messages")}
    assert read["dead_letter"].count() == bad.count() and read["validated"].count() == valid.count() == read["predictions"].count()
    again = spark.read.parquet(f"{tmp_path}/b/predictions")
    names = ["event_id", "accepted", "reason", "calibrated_probability", "action"]
    assert again.select(*names).exceptAll(read["predictions"].select(*names)).count() == 0
    accepted = read["predictions"].where("accepted")
    assert read["messages"].where("topic = 'predictions'").count() == accepted.count()
    alerts = accepted.where("action <> 'allow'").count()
    assert read["messages"].where("topic = 'alerts'").count() == alerts
    assert read["predictions"].where("not accepted and calibrated_probability is not null").count() == 0
    m = read["messages"].where("topic = 'alerts'").select(M.decode_message(F.col("value"), "alerts").alias("m")).first()["m"]
    assert m["correlation_id"] is None or m["decision"]["action"] in ("review", "block")
    totals = jobs.running_metrics(jobs.committed(spark, f"{tmp_path}/a", "counters")).first()
    assert jobs.committed(spark, f"{tmp_path}/a", "predictions").count() == read["predictions"].count()
    assert totals["processed"] == accepted.count()
    assert spark.read.parquet(f"{tmp_path}/a/windows").count() >= 0


def test_windows_drop_late_rows_and_come_out_when_they_are_over(spark, tmp_path):
    """Three files, one a batch: the second moves the watermark over the first's windows; the third is late for them."""
    from riskweave.operators.windows import merchant_windows

    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for rows in ([event(1, 0), event(2, 5, customer_id="d")], [event(3, 240)], [event(4, 10), event(5, 241)]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(SCHEMA).parquet(folder).withColumn("event_time", F.timestamp_micros("us"))
        q = merchant_windows(stream, watermark="15 minutes").writeStream.option("checkpointLocation", f"{out}/cp").outputMode("append").trigger(availableNow=True).format("parquet").start(f"{out}/rows")
        q.awaitTermination(240)
        q.stop()
    got = spark.read.parquet(f"{out}/rows").selectExpr("unix_micros(window_start) as start", "transaction_count", "unique_customers").collect()
    start = event(0, 0)[-1]
    assert [(r["start"], r["transaction_count"], r["unique_customers"]) for r in got] == [(start, 2, 2)]  # the hour of the third is still open


def test_sketched_windows_of_streams_and_tables(spark, tmp_path):
    """Panes with sketches give the exact windows, but for distinct counts within 3 standard errors; a stream gives the table's
    rows for every window that is over."""
    import random

    from riskweave.operators import windows as W

    rng = random.Random(2)
    rows = [event(k, rng.randrange(600), customer_id=rng.choice("ab"), merchant_id=f"m{rng.randrange(900)}", device_id=rng.choice("xyz"), country=rng.choice(["US", None])) for k in range(6000)]
    rows.sort(key=lambda r: r[-1])
    df = spark.createDataFrame(rows, SCHEMA).withColumn("event_time", F.timestamp_micros("us"))
    keys = ["window_start", "entity_id"]
    exact = {tuple(r[k] for k in keys): r for r in W.customer_windows(df, exact=True).collect()}
    table = {tuple(r[k] for k in keys): r for r in W.customer_windows(df).collect()}
    assert exact.keys() == table.keys()
    for k, r in table.items():
        e = exact[k]
        assert (r["transaction_count"], r["unique_devices"], r["unique_countries"], r["window_end"]) == (e["transaction_count"], e["unique_devices"], e["unique_countries"], e["window_end"])
        assert r["transaction_amount"] == pytest.approx(e["transaction_amount"]) and abs(r["unique_merchants"] - e["unique_merchants"]) <= max(1, 3 * 1.04 / 2 ** (W.SKETCH / 2) * e["unique_merchants"])
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for part in (rows[:2500], rows[2500:], [event(9999, 3000)]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(SCHEMA).parquet(folder).withColumn("event_time", F.timestamp_micros("us"))
        q = W.customer_windows(stream, watermark="15 minutes").writeStream.option("checkpointLocation", f"{out}/cp").outputMode("append").trigger(availableNow=True).format("parquet").start(f"{out}/rows")
        q.awaitTermination(240)
        q.stop()
    names = [*keys, "transaction_count", "unique_merchants", "unique_devices", "unique_countries"]
    streamed = {tuple(r[k] for k in keys): r for r in spark.read.parquet(f"{out}/rows").select(*names).collect()}
    assert {k: tuple(r[n] for n in names) for k, r in streamed.items()} == {k: tuple(r[n] for n in names) for k, r in table.items()}


def test_idle_customers_expire_by_event_time(spark, tmp_path):
    """A stream that stands still forgets nothing; once the watermark is the retention past a customer's latest event its state
    is gone, and what was forgotten is beyond the watermark, not new."""
    import time

    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"

    def batch(*rows):
        spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(SCHEMA).parquet(folder)
        df = stateful_features(stream, retention_seconds=4, lateness_seconds=60, expire_idle=True)
        q = df.writeStream.option("checkpointLocation", f"{out}/cp").outputMode("append").trigger(availableNow=True).format("parquet").start(f"{out}/rows")
        q.awaitTermination(240)
        q.stop()

    batch(event(1, 0))
    time.sleep(6)  # longer than the retention, in processing time
    batch(event(1, 0), event(2, 0, us=event(0, 0)[-1] + 1_000_000))
    batch(event(3, 24 * 60, customer_id="other"))
    batch(event(1, 0), event(4, 24 * 60 + 1), event(5, 24 * 60 + 1, us=event(0, 24 * 60 + 1)[-1] + 2_000_000))
    got = sorted((r["event_id"], r["accepted"], r["reason"] or "", r["customer_prior_transaction_count"]) for r in spark.read.parquet(f"{out}/rows").collect())
    assert got == [("e1", False, "duplicate_event", None), ("e1", False, "event_beyond_watermark", None), ("e1", True, "", 0), ("e2", True, "", 1), ("e3", True, "", 0), ("e4", True, "", 0), ("e5", True, "", 1)]


class Fake:
    """Spark's state of one customer, and what was written to it."""

    def __init__(self):
        self.map, self.value, self.written, self.read = {}, None, [], 0

    def getMapState(self, *_):
        return self

    getValueState = getMapState

    def iterator(self):
        self.read += len(self.map)
        return iter(list(self.map.items()))

    def updateValue(self, key, value):
        self.map[key] = value
        self.written.append(key)

    def removeKey(self, key):
        del self.map[key]

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def frame(rows):
    import pandas as pd

    return pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")])


def test_state_writes_only_the_panes_it_adds_to():
    from riskweave.streaming.state import FeatureProcessor

    state, processor = Fake(), FeatureProcessor(900_000_000, 24 * 3_600_000_000, False)
    processor.init(state)
    for rows, written in (([event(1, 0), event(2, 5), event(3, 70)], 2), ([event(4, 75)], 1), ([event(4, 75)], 0), ([event(5, 26 * 60)], 1)):
        state.written.clear()
        list(processor.handleInputRows(("c",), iter([frame(rows)]), None))
        assert len(state.written) == written
    assert len(state.map) == 1  # the hours of the first day are over


def test_many_events_of_a_customer_take_time_in_proportion():
    """What was 0.6, 1.8 and 6.2 seconds for 500, 1,000 and 2,000 events."""
    import time

    from riskweave.streaming.state import FeatureProcessor

    seconds = []
    for n in (2_000, 16_000):
        state, processor = Fake(), FeatureProcessor(900_000_000, 24 * 3_600_000_000, False)
        processor.init(state)
        rows = [event(k, 0, us=event(0, 0)[-1] + k * 4_000_000, merchant_id=f"m{k % 7}") for k in range(n)]
        began = time.time()
        out = [list(processor.handleInputRows(("c",), iter([frame(rows[k : k + 1000])]), None))[0] for k in range(0, n, 1000)]
        seconds.append(time.time() - began)
        assert out[-1]["prior_count"].iloc[-1] == n - 1 and out[-1]["unique_merchants"].iloc[-1] == 7
    assert seconds[1] < 60 * max(seconds[0], 0.05) and seconds[1] < 30


def arrivals(n=120):
    """Out of order by up to 20 minutes, some sent twice, ties in time."""
    import random

    rng, rows = random.Random(9), []
    for k in range(n):
        rows.append((*event(k, 0, us=event(0, 0)[-1] + k // 2 * 400_000_000 + rng.choice([0, 0, -1_100_000_000, -300_000_000]), merchant_id=rng.choice("mn"), country=rng.choice(["US", "DE"]), transaction_amount=float(rng.randrange(1, 90))), 2 * k))
        if k % 10 == 0:
            rows.append((*rows[-1][:-1], 2 * k + 1))
    return rows


def test_replay_equals_a_loop_over_arrivals(spark):
    rows = arrivals()
    out = {r["n"]: r for r in replayed(spark.createDataFrame(rows, SCHEMA + ", n int").withColumn("n2", F.col("n")), "n").join(spark.createDataFrame(rows, SCHEMA + ", n int").select("event_id", "n"), "event_id").collect() if r["accepted"]}
    names, held, latest, seen = [x.split()[0] for x in SCHEMA.split(", ")], [], None, 0
    for row in rows:
        e = dict(zip(names, row, strict=False))
        if any(h["event_id"] == e["event_id"] for h in held) or (latest is not None and e["us"] < latest - 900_000_000):
            continue
        prior = [h for h in held if h["us"] < e["us"]]
        hour = [h for h in prior if h["us"] >= e["us"] - 3_600_000_000]
        got = out[row[-1]]
        assert got["customer_prior_transaction_count"] == len(prior) and got["customer_prior_amount_sum"] == pytest.approx(sum(h["transaction_amount"] for h in prior))
        assert got["recent_amount_max_1h"] == max((h["transaction_amount"] for h in hour), default=0) and got["unique_merchants_24h"] == len({h["merchant_id"] for h in prior if h["us"] >= e["us"] - 86_400_000_000})
        assert got["country_novelty"] == float(all(h["country"] != e["country"] for h in prior))
        average = 0.0
        for k, h in enumerate(sorted(prior, key=lambda h: (h["us"], h["event_id"]))):
            average = h["transaction_amount"] if not k else 0.2 * h["transaction_amount"] + 0.8 * average
        assert got["customer_ewm_amount"] == pytest.approx(average)
        latest, seen = max(latest or 0, e["us"]), seen + 1
        held = [h for h in [*held, e] if h["us"] >= latest - 86_400_000_000]
    assert seen > 60


def test_global_replay_in_slices(spark):
    """Slices of 15 events, each with the retention before and the lateness after it, give the rows of whole customers."""
    from riskweave.streaming.state import replayed_globally

    rows = [(*r[:-1], r[-1] + 1000 * j) for j in range(3) for r in ((*x[:-2], x[-2] + j * 40_000_000_000, x[-1]) for x in ((f"{j}{y[0]}", f"{j}{y[1]}", *y[2:]) for y in arrivals(60)))]
    df = spark.createDataFrame(rows, SCHEMA + ", n int")
    whole, cut = (sorted(map(tuple, replayed_globally(df, ["n"], retention_seconds=3600, slice_events=k).collect()), key=str) for k in (10**6, 15))
    assert len(whole) == len(rows) and sum(r[7] for r in whole) > 60
    assert [tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in whole] == [tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in cut]


def test_batches_are_tried_again_and_then_set_aside():
    calls, lost = [], []

    def write(batch, batch_id):
        calls.append(batch_id)
        if batch_id == 7 or len(calls) < 2:
            raise OSError("down")

    run = jobs.retried(write, lambda b, i, attempts, why: lost.append((i, attempts, str(why))), most=3, pause=0.0)
    run(None, 1)
    assert calls == [1, 1] and not lost
    run(None, 7)
    assert calls == [1, 1, 7, 7, 7] and lost == [(7, 3, "down")]
    with pytest.raises(ValueError):
        jobs.retried(write, None, most=0)


def test_a_batch_that_is_tried_again_counts_once(spark, sf, tmp_path, monkeypatch):
    """The last write fails, then the claim; then another attempt wins in the meantime; then Spark replays the batch."""
    from riskweave.sources.commits import CommitLog, Part

    out = str(tmp_path)
    events = txn(spark, sf).limit(50).selectExpr("*", "'r' as correlation_id", "unix_micros(cast(event_time as timestamp)) as us")
    batch = jobs.scored(replayed(events, "us")).persist()
    write, claim, broken = jobs.write_predictions(out), CommitLog._claim, []

    def failing(self, batch_id, attempt):
        if len(broken) < 2:
            broken.append(attempt)
            raise OSError("down")
        return claim(self, batch_id, attempt)

    monkeypatch.setattr(CommitLog, "_claim", failing)
    jobs.retried(write, lambda *_: pytest.fail("given up"), most=3, pause=0.0)(batch, 0)
    write(batch, 0)
    write(batch, 1)
    assert len(broken) == 2
    accepted = batch.where("accepted").count()
    for name, n in (("predictions", 2 * batch.count()), ("counters", 2)):
        assert jobs.committed(spark, out, name).count() == n
    assert jobs.committed(spark, out, "messages").where("topic = 'predictions'").count() == 2 * accepted
    totals = jobs.running_metrics(jobs.committed(spark, out, "counters")).first()
    assert totals["batches"] == 2 and totals["processed"] == 2 * accepted
    log = CommitLog(spark, out)
    lost = spark.range(3).selectExpr("id", "'x' as topic")
    lost.selectExpr("*", "1 as _batch_id", "'killed' as _attempt").write.mode("append").partitionBy("_batch_id", "_attempt").parquet(f"{out}/extra")
    lost.selectExpr("*", "9 as _batch_id", "'at work' as _attempt").write.mode("append").partitionBy("_batch_id", "_attempt").parquet(f"{out}/extra")
    assert log.read("extra").count() == 0 and log.vacuum(["extra", "predictions"]) == 1 and spark.read.parquet(f"{out}/extra").count() == 3
    calls, done = [], CommitLog.is_done

    def late(self, batch_id):  # the first look is too early
        calls.append(batch_id)
        return len(calls) > 1 and done(self, batch_id)

    monkeypatch.setattr(CommitLog, "is_done", late)
    assert not log.write(1, {"more": Part(lost)})  # claimed by another while it wrote
    assert log.read("more", schema="id bigint, topic string").count() == 0


def test_customers_and_overtaken_runs_are_folded_together(monkeypatch):
    """Forty customers with late rows in two folds, as each would be alone."""
    import numpy as np
    import pandas as pd

    from riskweave.operators.slices import ATTRIBUTES
    from riskweave.streaming import state

    rng = np.random.default_rng(5)
    n = 400
    fixed = {"transaction_status": "approved", "card_present": True, "latitude": 1.0, "longitude": 2.0}
    pdf = pd.DataFrame({"event_id": [f"e{k:03}" for k in range(n)], "us": rng.integers(0, 50, n) * state.SECOND, "transaction_amount": rng.random(n)} | {c: rng.choice(list("abc"), n) for c in ATTRIBUTES}).assign(transaction_id=None, **fixed)
    key, own, since = np.repeat(np.arange(40), 10), rng.random(n) < 0.8, pdf["us"].to_numpy() - 30 * state.SECOND
    alone = []
    for k in range(40):
        at = np.flatnonzero(key == k)
        alone.append(state.as_of_arrival(state._held(pdf.iloc[at]), own[at], since[at]).set_index(at[own[at]]))
    calls = []
    monkeypatch.setattr(state, "folded", lambda *x, fold=state.folded: calls.append(1) or fold(*x))
    found = state.as_of_arrival(state._held(pdf), own, since, key)
    assert len(calls) == 2
    pd.testing.assert_frame_equal(found.astype(float), pd.concat(alone).astype(float), check_names=False)
