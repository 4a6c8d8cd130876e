"""Behavioural features on a stream: a customer's events in panes of time, with duplicates and late events told apart.

A batch of a customer is judged row by row against the ids that are held, which takes a look-up each, and what it knows of the past
is folded for all its rows at once, by the same blocks of rows that serve tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from riskweave.operators.contracts import first_wins
from riskweave.operators.evaluation import with_running_maximum
from riskweave.operators.features import FEATURES, REQUIRED, named_features
from riskweave.operators.slices import ATTRIBUTES, ROLLED, ROWS, SLICE_EVENTS, folded, sliced
from riskweave.sources.files import checkpointed

SECOND = 1_000_000
INPUT = (*REQUIRED, "transaction_id", "correlation_id")
#: Panes of a retention. A batch writes those that it adds to; those that are over are dropped whole.
PANES = 24
#: What is held of an event.
_HELD = {
    "event_id": pa.string(), "transaction_id": pa.string(), "us": pa.int64(), "transaction_amount": pa.float64(), **dict.fromkeys(ATTRIBUTES, pa.string()), "transaction_status": pa.string(), "card_present": pa.bool_(),
    "latitude": pa.float64(), "longitude": pa.float64(),
}
_SHOWN = {"event_id": "string", "transaction_id": "string", "correlation_id": "string", "us": "bigint", "transaction_amount": "double", "transaction_type": "string", "card_present": "boolean", "latitude": "double", "longitude": "double"}
_WHOLE = ("previous_us", "merchant_last")
_PAST = "customer_id string, " + ", ".join(f"{c} {t}" for c, t in _SHOWN.items()) + ", accepted boolean, reason string, " + ", ".join(f"{c} {'bigint' if c in _WHOLE else 'double'}" for c in ROLLED)
COLUMNS = ("customer_id", "event_id", "transaction_id", "correlation_id", "us", "transaction_amount", "transaction_type", "accepted", "reason", *FEATURES)


def _held(pdf: pd.DataFrame) -> pa.Table:
    return pa.table({c: pa.array(pdf[c], t, from_pandas=True) for c, t in _HELD.items()})


def _folded(rows: pa.Table, own: np.ndarray, since: np.ndarray, key: np.ndarray) -> pa.Table:
    """ROLLED of own rows, and `row`, where each stands; all rows of its key count that are earlier in time, back to `since`."""
    if not rows.num_rows:
        return pa.table({"row": key})
    order = pc.sort_indices(rows.append_column("key", pa.array(key)), [("key", "ascending"), ("us", "ascending"), ("event_id", "ascending")]).to_numpy()
    at, status = rows.take(pa.array(order)), rows["transaction_status"].take(pa.array(order))
    columns = {
        "key": key[order], "kind": np.full(rows.num_rows, 2), "row": order.astype(np.int64), "own": own[order], "since": since[order], "us": at["us"], "amount": at["transaction_amount"], "latitude": at["latitude"], "longitude": at["longitude"],
        **{c: at[c] for c in ATTRIBUTES}, "failed": pc.cast(pc.not_equal(status, "approved"), pa.int32()), "declined": pc.cast(pc.equal(status, "declined"), pa.int32()), "present": pc.cast(at["card_present"], pa.int32()),
    }
    return folded(pa.table(columns), None)


def _keyed(us: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(places, instants, width): rising keys and times as one number, key * width + rank of the time among the instants."""
    instants, rank = np.unique(us, return_inverse=True)
    width = len(instants) + 1
    return key * width + rank, instants, width


def as_of_arrival(rows: pa.Table, own: np.ndarray, since: np.ndarray, key: np.ndarray | None = None) -> pd.DataFrame:
    """ROLLED of own rows, by place. Rows come in order of arrival; each sees those that are earlier in time and came before it,
    of its key only, where there are keys, which rise.

    A row that something earlier in time still follows would see too much; such rows are folded run by run, a run being rows
    in order of time, over what had come until then. The others are folded together, and so are runs, as keys of their own.
    """
    us = rows["us"].to_numpy()
    key = np.zeros(len(us), np.int64) if key is None else key
    place, _, _ = _keyed(us, key)
    overtaken = np.zeros(len(us), bool)
    if len(us):
        overtaken[:-1] = np.minimum.accumulate(place[::-1])[::-1][1:] < place[:-1]
    parts = [_folded(rows, own & ~overtaken, since, key)]
    runs = np.cumsum(np.concatenate([[0], (place[1:] < place[:-1]) | (key[1:] != key[:-1])])) if len(us) else key
    late = np.flatnonzero(own & overtaken)
    cuts = np.flatnonzero(np.diff(runs[late])) + 1
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def fold() -> None:
        kept, mine = (np.concatenate(x) for x in zip(*held, strict=True))
        part = _folded(rows.take(pa.array(kept)), mine, since[kept], np.repeat(np.arange(len(held)), [len(k) for k, _ in held]))
        parts.append(part.set_column(0, "row", pa.array(kept[part["row"].to_numpy()])))
        held.clear()

    size = 0
    for at in np.split(late, cuts) if len(late) else []:
        start, end = int(np.searchsorted(key, key[at[0]])), int(np.searchsorted(runs, runs[at[0]], "right"))
        mine = np.zeros(end - start, bool)
        mine[at - start] = True
        seen = mine | (us[start:end] >= since[at].min())
        held.append((start + np.flatnonzero(seen), mine[seen]))
        size += len(held[-1][0])
        if size >= ROWS:
            fold()
            size = 0
    if held:
        fold()
    parts = [p for p in parts if p.num_rows]
    if not parts:
        return pd.DataFrame({c: np.zeros(0) for c in ROLLED})
    return pa.concat_tables(parts).to_pandas(integer_object_nulls=True).set_index("row").sort_index()


class Arrivals:
    """The policy for one customer's events in order of arrival.

    An event whose id or transaction is held is a duplicate; one earlier than the latest accepted event less the lateness, or
    than a watermark for all customers, is beyond. Both are rejected, and neither moves the latest time. Accepted events are held
    until they are older than the retention, reckoned from the latest. Ids that are null match nothing.
    """

    def __init__(self, lateness_us: int, retention_us: int, latest: int | None = None, watermark: int | None = None):
        self.lateness, self.retention, self.latest, self.watermark = lateness_us, retention_us, latest, watermark
        self.times: dict[tuple[int, str], int] = {}

    def hold(self, events, transactions, us) -> None:
        for kind, ids in enumerate((events, transactions)):
            self.times.update(((kind, k), t) for k, t in zip(ids, us, strict=True) if k is not None)

    def _is_held(self, kind: int, k: str | None) -> bool:
        t = self.times.get((kind, k)) if k is not None else None
        return t is not None and (self.latest is None or t >= self.latest - self.retention)

    def take(self, event: str | None, transaction: str | None, us: int) -> tuple[str | None, int]:
        """Why it is rejected, if it is, and how far back its features look."""
        since = max(us, us if self.latest is None else self.latest) - self.retention
        if self._is_held(0, event) or self._is_held(1, transaction):
            return "duplicate_event", since
        if (self.latest is not None and us < self.latest - self.lateness) or (self.watermark is not None and us < self.watermark):
            return "event_beyond_watermark", since
        self.hold([event], [transaction], [us])
        self.latest = us if self.latest is None else max(self.latest, us)
        return None, since


def judged(customer: str | None, policy: Arrivals, held: pa.Table, batch: pd.DataFrame) -> tuple[pd.DataFrame, pa.Table]:
    """(rows of _PAST for a batch in order of arrival, accepted events), given what is held of the customer."""
    plain = lambda c: [None if pd.isna(x) else x for x in batch[c]]
    found = [policy.take(*x) for x in zip(plain("event_id"), plain("transaction_id"), batch["us"].tolist(), strict=True)]
    good = np.array([reason is None for reason, _ in found], bool)
    accepted = _held(batch[good])
    rows = pa.concat_tables([held, accepted])
    own = np.arange(rows.num_rows) >= held.num_rows
    since = np.concatenate([np.zeros(held.num_rows, np.int64), np.array([s for _, s in found], np.int64)[good]])
    past = as_of_arrival(rows, own, since)
    out = batch.reset_index(drop=True)[[c for c in _SHOWN if c in batch]].reindex(columns=list(_SHOWN))
    out.insert(0, "customer_id", customer)
    out["accepted"], out["reason"] = good, [reason for reason, _ in found]
    return out.join(past.set_index(np.flatnonzero(good)), how="left").reindex(columns=[x.split(" ")[0] for x in _PAST.split(", ")]).astype(dict.fromkeys(_WHOLE, "Int64")), accepted


def _packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def _unpacked(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all()


class FeatureProcessor(StatefulProcessor):
    """Arrivals over Spark's state: events in a map by pane of time, of which a batch writes the panes that it adds to and drops those
    that are over, and the latest time. If `expire`, a timer drops a customer once the watermark is the retention past its
    latest event, and events before the watermark are beyond it."""

    def __init__(self, lateness_us: int, retention_us: int, expire: bool):
        self.lateness, self.retention, self.expire = lateness_us, retention_us, expire
        self.pane = max(1, retention_us // PANES)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.panes = handle.getMapState("panes", "pane bigint", "events binary")
        self.latest = handle.getValueState("latest", "us bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["us", "event_id"], kind="stable")
        latest = self.latest.get()[0] if self.latest.exists() else None
        watermark = timerValues.getCurrentWatermarkInMs() * 1000 if self.expire else None
        panes = {k[0]: _unpacked(bytes(v[0])) for k, v in self.panes.iterator()}
        held = pa.concat_tables([pa.table({c: pa.array([], t) for c, t in _HELD.items()}), *panes.values()])
        if latest is not None:
            held = held.filter(pc.greater_equal(held["us"], latest - self.retention))
        policy = Arrivals(self.lateness, self.retention, latest, watermark)
        policy.hold(held["event_id"].to_pylist(), held["transaction_id"].to_pylist(), held["us"].to_pylist())
        out, accepted = judged(key[0], policy, held, batch)
        if policy.latest is not None:
            self._write(policy.latest, panes, accepted)
            self.latest.update((int(policy.latest),))
            if self.expire:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer((policy.latest + self.retention) // 1000 + 1)
        yield out

    def _write(self, latest: int, panes: dict[int, pa.Table], accepted: pa.Table) -> None:
        first = (latest - self.retention) // self.pane
        new = accepted["us"].to_numpy() // self.pane
        for pane in np.unique(new[new >= first]).tolist():
            own = accepted.filter(pa.array(new == pane))
            self.panes.updateValue((pane,), (_packed(pa.concat_tables([panes[pane], own]) if pane in panes else own),))
        for pane in panes:
            if pane < first:
                self.panes.removeKey((pane,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.panes.clear()
        self.latest.clear()
        return iter(())

    def close(self) -> None:
        pass


def _features(past: DataFrame, *more: str) -> DataFrame:
    """Past columns as features: those of accepted rows; none of the others, as they would say nothing true."""
    df = named_features(past, F.col, F.col("us"))
    kept = [F.when(F.col("accepted"), F.col(f)).alias(f) for f in FEATURES]
    return df.select(*COLUMNS[: -len(FEATURES)], *kept, *more)


def stateful_features(events: DataFrame, lateness_seconds: float = 900, retention_seconds: float = 86_400, expire_idle: bool = False) -> DataFrame:
    """A stream of events with features, accepted flags and reasons. Each micro-batch goes by time, then id.

    Each customer has its own lateness. expire_idle drops customers whose latest event is the retention behind the watermark, by
    event time: as long as the stream stands still, nothing is forgotten. The watermark of all events less the lateness then
    holds for every customer, so that what was forgotten can't be taken for new. Rows do not carry the watermark's mark, or
    Spark would drop late ones before they could be told apart.
    """
    processor = FeatureProcessor(int(lateness_seconds * SECOND), int(retention_seconds * SECOND), expire_idle)
    if expire_idle:
        timed = events.withColumn("__clock", F.timestamp_micros("us")).withWatermark("__clock", f"{int(lateness_seconds * 1000)} milliseconds")
        events = timed.drop("__clock")
    past = events.groupBy("customer_id").transformWithStateInPandas(statefulProcessor=processor, outputStructType=_PAST, outputMode="Append", timeMode="EventTime" if expire_idle else "None")
    return _features(past)


def _whole_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches put together and cut again, so that each has whole keys, about ROWS rows of them if no key has more."""
    held: list[pd.DataFrame] = []
    size = 0
    for batch in batches:
        if not len(batch):
            continue
        if size >= ROWS:
            key = np.concatenate([held[-1]["key"].to_numpy()[-1:], batch["key"].to_numpy()])
            cut = np.flatnonzero(key[1:] != key[:-1])
            if len(cut):
                yield pd.concat([*held, batch.iloc[: cut[0]]], ignore_index=True)
                held, size, batch = [], 0, batch.iloc[cut[0] :]
        held.append(batch)
        size += len(batch)
    if held:
        yield pd.concat(held, ignore_index=True)


def replayed_globally(events: DataFrame, arrival: list[str], lateness_seconds: float = 900, retention_seconds: float = 30 * 86_400, slice_events: int = SLICE_EVENTS) -> DataFrame:
    """A bounded table replayed in order of arrival under one watermark for all customers, with 30 days of history.

    The watermark is the latest event time so far less the lateness; events before it are beyond it, unless their id was
    accepted earlier, which makes them duplicates. A repeated id must carry its first event's time. `arrival` must be a
    total order. The running maximum is taken over ranges of arrivals and shifted, so no task sees all rows; features see
    what had arrived of the customer. Customers of over slice_events events are replayed in slices of time, each with the
    retention before it, and the lateness after it, which may have arrived earlier.
    """
    order = F.struct(*arrival)
    lateness, retention = int(lateness_seconds * SECOND), int(retention_seconds * SECOND)
    marked = with_running_maximum(events, order, "us", "__latest").withColumn("__late", F.col("us") < F.col("__latest") - lateness)
    fine = checkpointed(first_wins(marked.where("not __late").withColumn("__order", order), "__order").drop("__order"))
    good = fine.where("not duplicate").drop("duplicate")
    keys = [F.col(k) for k in ("event_id", "transaction_id")]
    taken = [good.where(k.isNotNull()).groupBy(k.alias("__k")).agg(F.min(order).alias("__first")) for k in keys]
    late = marked.where("__late")
    for n, (k, t) in enumerate(zip(keys, taken, strict=True)):
        late = late.join(t.select("__k", F.col("__first").alias(f"__first{n}")), k == F.col("__k"), "left").drop("__k")
    seen = F.coalesce(F.col("__first0") < order, F.lit(False)) | F.coalesce(F.col("__first1") < order, F.lit(False))
    late = late.withColumn("reason", F.when(seen, "duplicate_event").otherwise("event_beyond_watermark"))
    rejected = fine.where("duplicate").withColumn("reason", F.lit("duplicate_event")).select(*events.columns, "reason").unionByName(late.select(*events.columns, "reason"))
    none = [F.lit(None).cast("double").alias(f) for f in FEATURES]
    refused = rejected.select(*COLUMNS[: -len(FEATURES) - 2], F.lit(False).alias("accepted"), "reason", *none, *arrival)
    kinds = dict(events.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _whole_keys(batches):
            us, own, key = pdf["us"].to_numpy(np.int64), pdf["own"].to_numpy(bool), pdf["key"].to_numpy()
            group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
            place, instants, width = _keyed(us, group)
            since = instants[np.maximum.accumulate(place) - group * width] - retention
            past = as_of_arrival(_held(pdf), own, since, group)
            out = pdf.loc[own, ["c", *_SHOWN, *arrival]].rename(columns={"c": "customer_id"}).join(past, how="left").assign(accepted=True, reason=None)
            yield out.reindex(columns=[*(x.split(" ")[0] for x in _PAST.split(", ")), *arrival]).astype(dict.fromkeys(_WHOLE, "Int64"))

    rows = good.drop("__latest", "__late").withColumnRenamed("customer_id", "c")
    rows, _ = sliced(rows, slice_events, retention, lateness)
    dealt = rows.withColumn("key", F.xxhash64("c", "slice")).repartition("c", "slice").sortWithinPartitions("c", "slice", *arrival)
    past = dealt.mapInPandas(run, _PAST + "".join(f", {c} {kinds[c]}" for c in arrival))
    return _features(past, *arrival).unionByName(refused)


def replayed(events: DataFrame, arrival: str, lateness_seconds: float = 900, retention_seconds: float = 86_400) -> DataFrame:
    """The same policy over a table, each customer's events in order of arrival; which of them are accepted follows from all
    before them, so a customer is judged in one task."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        policy = Arrivals(int(lateness_seconds * SECOND), int(retention_seconds * SECOND))
        return judged(key[0], policy, _held(pdf.iloc[:0]), pdf.sort_values([arrival, "event_id"], kind="stable"))[0]

    return _features(events.groupBy("customer_id").applyInPandas(run, _PAST))
