"""Field contracts as predicates, issue codes, first-wins deduplication, quality reports."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Allowed codes of the transaction contract.
CURRENCIES = ("AUD", "BRL", "CAD", "EUR", "GBP", "INR", "JPY", "SGD", "USD")
TYPES = ("purchase", "cash_withdrawal", "transfer", "refund")
CHANNELS = ("ecommerce", "pos", "atm", "mobile", "bank_transfer", "qr")
AUTHENTICATION = ("3ds", "pin", "biometric", "otp", "none")
STATUSES = ("approved", "declined", "reversed")
SIMULATION_FIELDS = ("record_kind", "simulation_fraud_label", "simulation_fraud_type", "raw_record", "malformed_reason")


def normalised(df: DataFrame) -> DataFrame:
    """Currency and country in upper case, texts of times as timestamps; unreadable times become null."""
    out = {c: F.upper(c) for c in ("currency", "country") if c in df.columns}
    out |= {c: F.try_to_timestamp(c) for c, kind in df.dtypes if c in ("timestamp", "ingestion_timestamp", "event_time", "created_at") and kind == "string"}
    return df.withColumns(out)


def _length(name: str, low: int, high: int) -> Column:
    return F.col(name).isNull() | ~F.length(name).between(low, high)


def contract_violations(known: list[str]) -> Column:
    """An array of codes, one per broken field rule, in order; a row is valid if it is empty.

    Rules whose fields are not among `known` are left out, so a table with part of the contract can be checked too.
    """
    amount = F.col("transaction_amount")
    rules: list[tuple[str, tuple[str, ...], Column]] = [
        *((f"{c}_length", (c,), _length(c, 3, 64)) for c in ("customer_id", "account_id", "card_id", "merchant_id")),
        *((f"{c}_missing", (c,), F.col(c).isNull() | (F.col(c) == "")) for c in ("event_id", "transaction_id")),
        ("merchant_category_length", ("merchant_category",), _length("merchant_category", 2, 64)),
        ("transaction_amount_range", ("transaction_amount",), amount.isNull() | F.isnan(amount.cast("double")) | (amount <= 0) | (amount > 1e7)),
        ("currency_unknown", ("currency",), F.col("currency").isNull() | ~F.upper("currency").isin(*CURRENCIES)),
        ("transaction_type_unknown", ("transaction_type",), F.col("transaction_type").isNull() | ~F.col("transaction_type").isin(*TYPES)),
        ("channel_unknown", ("channel",), F.col("channel").isNull() | ~F.col("channel").isin(*CHANNELS)),
        ("country_length", ("country",), _length("country", 2, 2)),
        ("city_length", ("city",), _length("city", 2, 80)),
        ("latitude_range", ("latitude",), F.col("latitude").isNull() | ~F.col("latitude").between(-90, 90)),
        ("longitude_range", ("longitude",), F.col("longitude").isNull() | ~F.col("longitude").between(-180, 180)),
        ("device_id_length", ("device_id",), _length("device_id", 3, 128)),
        ("ip_address_form", ("ip_address",), ~F.coalesce(is_ip("ip_address"), F.lit(False))),
        ("card_present_missing", ("card_present",), F.col("card_present").isNull()),
        ("authentication_method_unknown", ("authentication_method",), F.col("authentication_method").isNull() | ~F.col("authentication_method").isin(*AUTHENTICATION)),
        ("transaction_status_unknown", ("transaction_status",), F.col("transaction_status").isNull() | ~F.col("transaction_status").isin(*STATUSES)),
        ("event_version_range", ("event_version",), F.col("event_version").isNull() | (F.col("event_version") < 1)),
        ("event_time_missing", ("event_time",), F.col("event_time").isNull()),
        ("ingestion_before_event", ("ingestion_time", "event_time"), F.col("ingestion_time").isNull() | (F.col("ingestion_time") < F.col("event_time"))),
    ]
    return F.array_compact(F.array(*[F.when(broken, F.lit(code)) for code, needs, broken in rules if set(needs) <= set(known)]))


def is_ip(name: str) -> Column:
    """IPv4 with octets below 256, or a plausible IPv6 text."""
    c = F.col(name)
    four = c.rlike(r"^(\d{1,3}\.){3}\d{1,3}$") & F.forall(F.split(c, r"\."), lambda o: o.try_cast("int") < 256)
    six = c.contains(":") & c.rlike(r"^[0-9A-Fa-f:.]{2,45}$") & (F.size(F.split(c, "::")) <= 2) & (F.size(F.split(c, ":")) <= 9)
    return four | six


def unknown_fields(payload: Column, known: list[str]) -> Column:
    """Names in a JSON object that the contract doesn't have."""
    return F.array_except(F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>")), F.array(*map(F.lit, known)))


def truth_violation() -> Column:
    """A label is true if and only if it has a type."""
    return F.coalesce(F.col("fraud_label"), F.lit(False)) != F.col("fraud_type").isNotNull()


def payload_of(nested: Column, flat: Column) -> Column:
    """The nested event where there is one, else the flat record."""
    return F.coalesce(nested, flat)


def label_of(nested: Column, prefixed: Column) -> Column:
    return F.coalesce(nested, prefixed)


def without_simulation(df: DataFrame) -> DataFrame:
    return df.drop(*SIMULATION_FIELDS)


#: Rounds, as many as plain copies need, before the rows that are left are told apart by component, and rows of a component that one task decides.
QUICK_ROUNDS, COMPONENT_ROWS = 1, 200_000


def _round(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rejected, undecided) after one more round over rows (o, a, b)."""
    from riskweave.sources.files import checkpointed

    firsts = [left.where(F.col(k).isNotNull()).groupBy(k).agg(F.min("o").alias(f"first_{k}")) for k in ("a", "b")]
    seen = left.join(firsts[0], "a", "left").join(firsts[1], "b", "left")
    fits = [F.coalesce(F.col(f"first_{k}") == F.col("o"), F.lit(True)) for k in ("a", "b")]
    marked = checkpointed(seen.select("o", "a", "b", (fits[0] & fits[1]).alias("ok")))
    taken = marked.where("ok")
    rest = marked.where("not ok")
    for k in ("a", "b"):
        held = taken.where(F.col(k).isNotNull()).select(F.col(k).alias("key")).distinct().withColumn(f"hit_{k}", F.lit(True))
        rest = rest.join(held, F.col(k) == F.col("key"), "left").drop("key")
    rest = checkpointed(rest.select("o", "a", "b", (F.coalesce("hit_a", F.lit(False)) | F.coalesce("hit_b", F.lit(False))).alias("gone")))
    return rest.where("gone").select("o"), rest.where("not gone").select("o", "a", "b")


def _in_order(batches):
    """(o, duplicate) of rows in order within components, from a set of the keys taken so far in each."""
    at, taken = None, set()
    for batch in batches:
        flags = []
        for component, a, b in zip(*(batch[c].to_pylist() for c in ("component", "a", "b")), strict=True):
            if component != at:
                at, taken = component, set()
            own = [(k, v) for k, v in (("a", a), ("b", b)) if v is not None]
            flags.append(not taken.isdisjoint(own))
            if not flags[-1]:
                taken.update(own)
        yield pa.RecordBatch.from_arrays([batch["o"], pa.array(flags, pa.bool_())], ["o", "duplicate"])


def _by_component(left: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(rejected, undecided): rows (o, a, b) of components of up to `most` rows are decided, each component by one task; those of
    larger ones are left. Components are of hashed keys, which may join two but never parts one; rows go there in order, as those
    that hang together are mostly near each other."""
    from riskweave.operators.graph import components
    from riskweave.sources.files import checkpointed

    node = {k: F.when(F.col(k).isNotNull(), F.xxhash64(F.lit(k), F.col(k))) for k in ("a", "b")}
    rows = left.withColumns({"u": F.coalesce(node["a"], node["b"]), "v": F.coalesce(node["b"], node["a"])})
    found = checkpointed(rows.join(components(rows.repartitionByRange("o").sortWithinPartitions("o").select("u", "v")), F.col("u") == F.col("node")).select("o", "a", "b", "component"))
    sizes = found.groupBy("component").agg(F.count("*").alias("n"))
    sized = found.join(sizes, "component")
    small = sized.where(F.col("n") <= most).select("component", "o", "a", "b").repartition("component").sortWithinPartitions("component", "o")
    schema = T.StructType([left.schema["o"], T.StructField("duplicate", T.BooleanType())])
    return checkpointed(small.mapInArrow(_in_order, schema).where("duplicate").select("o")), sized.where(F.col("n") > most).select("o", "a", "b")


def first_wins(df: DataFrame, order: str, keys: tuple[str, str] = ("event_id", "transaction_id"), max_rounds: int = 1000, component_rows: int = COMPONENT_ROWS) -> DataFrame:
    """df with `duplicate`: an earlier accepted row has one of the two keys.

    Greedy in `order` (unique): a rejected row blocks nobody. Rows whose keys occur once are accepted at sight. Of the others, a
    round accepts the rows that come first on both keys among the undecided, then rejects those that share a key with an
    accepted one. What a few rounds leave hangs together in chains: their components, found in rounds that grow with the
    logarithm of a chain, are decided in order, one by a task. Only components of over component_rows go on in rounds, which
    grow with their chains; an error is raised if max_rounds leave rows undecided. Null keys match nothing.
    """
    from riskweave.sources.files import checkpointed

    a, b = keys
    left = checkpointed(df.select(F.col(order).alias("o"), F.col(a).alias("a"), F.col(b).alias("b")))  # df is made once for all rounds
    for k in ("a", "b"):
        shared = left.where(F.col(k).isNotNull()).groupBy(F.col(k).alias("key")).agg(F.count("*").alias("n")).where("n > 1")
        left = left.join(shared.select("key", F.lit(True).alias(f"shares_{k}")), F.col(k) == F.col("key"), "left").drop("key")
    left = checkpointed(left.where("shares_a or shares_b").select("o", "a", "b"))
    rejected = left.select("o").limit(0)
    for done in range(max_rounds + 1):
        if left.isEmpty():
            break
        if done == max_rounds:
            raise RuntimeError(f"rows are still undecided after {max_rounds} rounds")
        if done == QUICK_ROUNDS and component_rows:
            gone, left = _by_component(left, component_rows)
        else:
            gone, left = _round(left)
        rejected = rejected.unionByName(gone)
    out = df.join(rejected.select(F.col("o").alias("__o"), F.lit(True).alias("duplicate")), F.col(order) == F.col("__o"), "left")
    return out.withColumn("duplicate", F.coalesce("duplicate", F.lit(False))).drop("__o")


def classified(df: DataFrame, order: str = "record_index", require_labels: bool = False, allowed_categories: tuple[str, ...] = (), parsed: Column | None = None) -> DataFrame:
    """df with `issue`, the first that applies, or null: invalid_record, schema_error, missing_label, invalid_category,
    duplicate_event. Duplicates count against accepted rows only."""
    broken = F.when(~parsed, "invalid_record") if parsed is not None else F.lit(None).cast("string")
    issue = F.coalesce(
        broken,
        F.when(F.size(contract_violations(df.columns)) > 0, "schema_error"),
        F.when(F.lit(require_labels) & (F.col("fraud_label").isNull() if "fraud_label" in df.columns else F.lit(True)), "missing_label"),
        F.when(~F.col("merchant_category").isin(*allowed_categories), "invalid_category") if allowed_categories else F.lit(None).cast("string"),
    )
    marked = df.withColumn("issue", issue)
    fine = first_wins(marked.where("issue is null"), order).withColumn("issue", F.when(F.col("duplicate"), "duplicate_event")).drop("duplicate")
    return fine.unionByName(marked.where("issue is not null"))


def quality_report(classified_rows: DataFrame) -> DataFrame:
    """One row: counts of input, valid, quarantined and duplicate rows, and a map of issue counts."""
    counts = classified_rows.groupBy("issue").agg(F.count("*").alias("n"))
    there = F.filter(F.collect_list(F.struct("issue", "n")), lambda x: x["issue"].isNotNull())
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("input_count"),
        F.coalesce(F.sum(F.when(F.col("issue").isNull(), F.col("n"))), F.lit(0)).alias("valid_count"),
        F.coalesce(F.sum(F.when(F.col("issue").isNotNull(), F.col("n"))), F.lit(0)).alias("quarantined_count"),
        F.coalesce(F.sum(F.when(F.col("issue") == "duplicate_event", F.col("n"))), F.lit(0)).alias("duplicate_count"),
        F.map_from_entries(F.array_sort(there)).alias("issue_counts"),
    )


def canonical(df: DataFrame, fields: list[str]) -> DataFrame:
    return df.select(*fields, "fraud_label", "fraud_type")


def quota(events: DataFrame, key: str, limit: int, window_seconds: int, time: str = "us", order: str = "event_id") -> DataFrame:
    """events with `allowed` and `remaining`: the first `limit` of a key in each fixed window pass."""
    bucket = F.floor(F.col(time) / (window_seconds * 1_000_000)).cast("long")
    nth = F.row_number().over(Window.partitionBy(key, "bucket").orderBy(time, order))
    out = events.withColumn("bucket", bucket).withColumn("nth", nth)
    return out.withColumns({"allowed": F.col("nth") <= limit, "remaining": F.greatest(F.lit(0), F.lit(limit) - F.col("nth"))})
