"""Event-time window metrics; the same definitions run on tables and on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions.scalars import duration_seconds


def _metrics(grouped, kind: str, key: str, exact: bool, distinct: dict[str, str]) -> DataFrame:
    count = F.count_distinct if exact else F.approx_count_distinct
    out = grouped.agg(F.count("event_id").alias("transaction_count"), F.sum("transaction_amount").alias("transaction_amount"), *[count(c).alias(n) for n, c in distinct.items()])
    return _shaped(out, kind, key, [n for n in ("unique_customers", "unique_merchants") if n not in distinct])


def _shaped(out: DataFrame, kind: str, key: str, of_one: list[str]) -> DataFrame:
    ones = [F.lit(1).cast("long").alias(n) for n in of_one]
    cols = ["window_start", "window_end", "window_type", "entity_id", "transaction_count", "transaction_amount", "unique_customers", "unique_merchants", "unique_devices", "unique_countries"]
    return out.select("*", *ones).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), F.lit(kind).alias("window_type"), F.col(key).alias("entity_id"), *cols[4:])


def _sliding_by_panes(events: DataFrame, key: str, distinct: dict[str, str], window: str, slide: str) -> DataFrame:
    """Exact sliding windows of a table: events are summed per pane of one slide, with the sets of what is counted, before each
    pane goes to the windows it is in; so no event is multiplied."""
    steps = duration_seconds(window) / duration_seconds(slide)
    if steps != int(steps):
        raise ValueError("the window must be a multiple of its slide")
    pane = F.col("pane")
    sets = [F.collect_set(c).alias(n) for n, c in distinct.items()]
    panes = events.groupBy(F.window("event_time", slide).alias("pane"), key).agg(F.count("event_id").alias("transaction_count"), F.sum("transaction_amount").alias("transaction_amount"), *sets)
    starts = F.transform(F.sequence(F.lit(0), F.lit(int(steps) - 1)), lambda k: pane["start"] - F.make_dt_interval(secs=k.cast("double") * duration_seconds(slide)))
    spread = panes.withColumn("start", F.explode(starts))
    span = F.make_dt_interval(secs=F.lit(duration_seconds(window)))
    unions = [F.size(F.array_distinct(F.flatten(F.collect_list(n)))).cast("long").alias(n) for n in distinct]
    out = spread.groupBy("start", key).agg(F.sum("transaction_count").alias("transaction_count"), F.sum("transaction_amount").alias("transaction_amount"), *unions)
    return out.withColumn("window", F.struct("start", (F.col("start") + span).alias("end")))


#: Base-two logarithm of a sketch's registers: its relative standard error is 1.04 / sqrt(2 ** SKETCH), 1.6 %.
SKETCH = 12


def _sliding_by_sketches(events: DataFrame, key: str, distinct: dict[str, str], window: str, slide: str) -> DataFrame:
    """Sliding windows of tables and streams: each event goes to one pane, of a slide's length, that keeps counts, sums and sketches
    of a fixed size; windows add up the panes they cover and unite the sketches."""
    if duration_seconds(window) % duration_seconds(slide):
        raise ValueError("the window must be a multiple of its slide")
    sketches = [F.hll_sketch_agg(c, SKETCH).alias(n) for n, c in distinct.items()]
    panes = events.groupBy(F.window("event_time", slide).alias("pane"), key).agg(F.count("event_id").alias("transaction_count"), F.sum("transaction_amount").alias("transaction_amount"), *sketches)
    united = [F.hll_sketch_estimate(F.hll_union_agg(n)).alias(n) for n in distinct]
    return panes.groupBy(F.window(F.window_time("pane"), window, slide), key).agg(F.sum("transaction_count").alias("transaction_count"), F.sum("transaction_amount").alias("transaction_amount"), *united)


def customer_windows(events: DataFrame, window: str = "1 hour", slide: str = "10 minutes", watermark: str | None = None, exact: bool = False) -> DataFrame:
    """Sliding windows per customer: counts, amounts, and distinct merchants, devices and countries.

    Exact distinct counts are for tables; streams take those of sketches. Either way an event goes to one pane only."""
    of = {"unique_merchants": "merchant_id", "unique_devices": "device_id", "unique_countries": "country"}
    if exact and not events.isStreaming:
        out = _sliding_by_panes(events, "customer_id", of, window, slide)
    else:
        rows = events.withWatermark("event_time", watermark) if watermark else events
        out = _sliding_by_sketches(rows, "customer_id", of, window, slide)
    return _shaped(out, "sliding_customer", "customer_id", ["unique_customers"])


def merchant_windows(events: DataFrame, window: str = "1 hour", watermark: str | None = None, exact: bool = False) -> DataFrame:
    """Tumbling windows per merchant; a merchant's row counts one merchant."""
    rows = events.withWatermark("event_time", watermark) if watermark else events
    grouped = rows.groupBy(F.window("event_time", window), "merchant_id")
    return _metrics(grouped, "tumbling_merchant", "merchant_id", exact, {"unique_customers": "customer_id", "unique_devices": "device_id", "unique_countries": "country"})


def window_metrics(events: DataFrame, watermark: str | None = None, exact: bool = False) -> DataFrame:
    """Both kinds of windows in one table or stream."""
    return customer_windows(events, watermark=watermark, exact=exact).unionByName(merchant_windows(events, watermark=watermark, exact=exact))
