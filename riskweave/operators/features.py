"""Behavioural features as of each event: 56 columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.functions.scalars import calendar, haversine_km, micros, ratio, unit_clip
from riskweave.operators.slices import ATTRIBUTES, SLICE_EVENTS, SPANS, UNIQUE, with_past

SECOND = 1_000_000
#: Features of the event alone.
_OF_EVENT = frozenset(("event_hour", "event_day_of_week", "is_weekend", "is_night", "amount_log1p", "is_refund", "is_cash_withdrawal", "is_card_present"))
#: Deviations below this are rounding, not spread.
FLAT = 1e-9
REQUIRED = (
    "event_id", "customer_id", "merchant_id", "device_id", "country", "merchant_category", "transaction_amount", "transaction_type", "transaction_status",
    "card_present", "latitude", "longitude", "event_time",
)

#: Names of the features.
FEATURES = (
    "event_hour", "event_day_of_week", "is_weekend", "is_night", "amount_log1p", "is_refund", "is_cash_withdrawal", "is_card_present",
    "customer_prior_transaction_count", "customer_prior_amount_sum", "customer_prior_amount_mean", "customer_prior_amount_max", "customer_prior_amount_std",
    "amount_z_score", "customer_seconds_since_previous", "merchant_novelty", "device_novelty", "country_novelty", "merchant_category_novelty",
    "failed_transaction_rate_prior", "decline_rate_prior", "card_present_ratio_prior", "customer_ewm_amount",
    *(f"recent_transaction_count_{s}" for s in SPANS), *(f"recent_amount_{a}_{s}" for s in SPANS for a in ("sum", "mean", "max", "std")),
    "geographic_distance_km", "geographic_velocity_kmh", "impossible_travel",
    "customer_transaction_velocity_10m", "customer_transaction_velocity_1h", "merchant_transaction_velocity_1h",
    "unique_merchants_24h", "unique_devices_24h", "unique_countries_24h", "merchant_popularity", "time_since_previous_transaction", "customer_spending_deviation",
    "rolling_transaction_count_1h", "rolling_transaction_amount_1h", "rolling_transaction_mean_1h", "rolling_transaction_stddev_1h", "rolling_transaction_max_1h", "rolling_transaction_min_1h",
)


#: Version of the features' definitions, which scored rows and messages carry.
FEATURE_VERSION = "features-1"


def feature_registry(spark: SparkSession, version: str = FEATURE_VERSION) -> DataFrame:
    """A row per feature: name, version, where it comes from, whether it looks only at earlier events, and whether the stream
    computes it too. Both hold for all of them; tests compare stream and batch feature by feature."""
    rows = [(name, version, "event" if name in _OF_EVENT else "event_and_customer_history", True, True) for name in FEATURES]
    return spark.createDataFrame(rows, "name string, version string, source string, point_in_time_safe boolean, online_supported boolean")


def require_version(rows: DataFrame, version: str = FEATURE_VERSION, column: str = "feature_version") -> DataFrame:
    """rows, if all carry this version of the features; an error names those that don't."""
    others = [r[0] for r in rows.select(column).where(~F.col(column).eqNullSafe(version)).distinct().limit(5).collect()]
    if others:
        raise ValueError(f"features of other versions: {', '.join(map(str, others))}")
    return rows


def require_columns(df: DataFrame, names) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def named_features(past: DataFrame, event: Callable[[str], Column], us: Column) -> DataFrame:
    """past, which has what slices find of the past, with the 56 features; event(name) is a column of the event, us its time in
    microseconds."""
    amount = event("transaction_amount")
    row = {n: event(n) for n in ("latitude", "longitude", "transaction_type", "card_present")}
    mean, std = F.col("prior_mean"), F.col("prior_std")
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    found: dict[str, Column] = {
        **calendar(F.timestamp_micros(us)),
        "amount_log1p": F.log1p(amount),
        "is_refund": (row["transaction_type"] == "refund").cast("double"),
        "is_cash_withdrawal": (row["transaction_type"] == "cash_withdrawal").cast("double"),
        "is_card_present": row["card_present"].cast("double"),
        "customer_prior_transaction_count": F.col("prior_count"),
        "customer_prior_amount_sum": F.col("prior_sum"),
        "customer_prior_amount_mean": mean,
        "customer_prior_amount_max": F.col("prior_high"),
        "customer_prior_amount_std": std,
        "amount_z_score": F.when(std > FLAT, (amount - mean) / std).otherwise(0.0),
        "customer_seconds_since_previous": F.coalesce((us - F.col("previous_us")) / SECOND, F.lit(-1.0)),
        "failed_transaction_rate_prior": F.col("failed_rate"),
        "decline_rate_prior": F.col("declined_rate"),
        "card_present_ratio_prior": F.col("present_rate"),
        "customer_ewm_amount": F.col("prior_average"),
        "geographic_distance_km": zero(haversine_km(F.col("previous_latitude"), F.col("previous_longitude"), row["latitude"], row["longitude"])),
        "merchant_popularity": F.col("merchant_day"),
        "merchant_transaction_velocity_1h": F.when(F.col("merchant_hits") > 0, F.col("merchant_hits") / F.greatest((us - F.col("merchant_last")) / SECOND / 3600, F.lit(1 / 60))).otherwise(0.0),
        "customer_transaction_velocity_10m": F.col("count_10m") * 6,
        "customer_transaction_velocity_1h": F.col("count_1h"),
        "rolling_transaction_count_1h": F.col("count_1h"),
        "rolling_transaction_amount_1h": F.col("sum_1h"),
        "rolling_transaction_mean_1h": F.col("mean_1h"),
        "rolling_transaction_stddev_1h": F.col("std_1h"),
        "rolling_transaction_max_1h": F.col("high_1h"),
        "rolling_transaction_min_1h": F.col("low_1h"),
    }
    for s in SPANS:
        found[f"recent_transaction_count_{s}"] = F.col(f"count_{s}")
        for name, fold in (("sum", "sum"), ("mean", "mean"), ("max", "high"), ("std", "std")):
            found[f"recent_amount_{name}_{s}"] = F.col(f"{fold}_{s}")
    found |= {f"unique_{u}_24h": F.col(f"unique_{u}") for u in UNIQUE}
    found |= {f"{name.removesuffix('_id')}_novelty": F.col(f"new_{name}") for name in ATTRIBUTES}
    df = past.withColumns(found)
    since, km = F.col("customer_seconds_since_previous"), F.col("geographic_distance_km")
    df = df.withColumns({"geographic_velocity_kmh": F.when(since > 0, km / (since / 3600)).otherwise(0.0), "time_since_previous_transaction": since, "customer_spending_deviation": F.col("amount_z_score")})
    df = df.withColumn("impossible_travel", (F.col("geographic_velocity_kmh") > 900).cast("double"))
    return df


def behavioural_features(events: DataFrame, history_seconds: int | None = None, slice_events: int = SLICE_EVENTS) -> DataFrame:
    """events with the 56 features; each looks only at strictly earlier events of the customer.

    Look-backs are closed at their far end and open at the event; events at the same instant don't see each other. Rows of
    `history_seconds` before the event count (all by default). Where there is no earlier event, features are 0 and gaps -1.
    One shuffle by customer and slice of time serves all features; customers of over `slice_events` events have several slices.
    """
    require_columns(events, REQUIRED)
    past = with_past(events, micros("event_time"), history_seconds, slice_events)
    return named_features(past, lambda name: F.col(f"row.{name}"), micros("row.event_time")).select("row.*", *FEATURES)


def rule_score() -> Column:
    """Transparent rules over the features, summed and cut at 1."""
    rules = [  # fixed values: what each rule adds
        (F.col("amount_z_score") >= 3, 0.35),
        (F.col("customer_seconds_since_previous").between(0, 60), 0.25),
        (F.col("device_novelty") == 1, 0.20),
        (F.col("country_novelty") == 1, 0.15),
        (F.col("is_cash_withdrawal") == 1, 0.10),
        (F.col("transaction_amount") >= 2000, 0.15),
    ]
    total = F.lit(0.0)
    for test, weight in rules:
        total = total + F.when(test, weight).otherwise(0.0)
    return F.least(total, F.lit(1.0))


def spread(amount: Column, frame) -> Column:
    """Population deviation of the amounts in a frame. That of two is taken from the mean as it moves, digit by digit as SQL
    does: any third amount may be exactly three deviations off, and rounding decides what rules make of it."""
    x = amount.cast("double")
    first, last = F.first(x, ignorenulls=True).over(frame), F.last(x, ignorenulls=True).over(frame)
    mean = first + (last - first) / 2
    return F.when(F.count(x).over(frame) == 2, F.sqrt((last - mean) * (last - first) / 2)).otherwise(F.stddev_pop(x).over(frame))


#: The least of the features that rules need, for plans that want no others.
def rule_features(events: DataFrame) -> DataFrame:
    """events with the six inputs of rule_score and the score itself; cheaper than all features."""
    amount = F.col("transaction_amount")
    prior = Window.partitionBy("customer_id").orderBy("us").rangeBetween(Window.unboundedPreceding, -1)

    def fresh(name: str) -> Column:
        return (F.count("*").over(Window.partitionBy("customer_id", name).orderBy("us").rangeBetween(Window.unboundedPreceding, -1)) == 0).cast("double")

    df = events.withColumn("us", micros("event_time")).repartition("customer_id")
    df = df.withColumns({"m": F.avg(amount).over(prior), "s": spread(amount, prior), "p": F.max("us").over(prior), "device_novelty": fresh("device_id"), "country_novelty": fresh("country")})
    df = df.withColumns(
        {
            "amount_z_score": F.when(F.col("s") > FLAT, (amount - F.col("m")) / F.col("s")).otherwise(0.0),
            "customer_seconds_since_previous": F.coalesce((F.col("us") - F.col("p")) / SECOND, F.lit(-1.0)),
            "is_cash_withdrawal": (F.col("transaction_type") == "cash_withdrawal").cast("double"),
        }
    )
    inputs = ["amount_z_score", "customer_seconds_since_previous", "device_novelty", "country_novelty", "is_cash_withdrawal"]
    return df.withColumn("rule_score", rule_score()).select(*events.columns, *inputs, "rule_score")


def rule_prediction(scored: DataFrame) -> DataFrame:
    """Rules alone as a predictor: the score is the probability, its distance from a half the confidence."""
    p = unit_clip(F.col("rule_score"))
    return scored.withColumns({"calibrated_probability": p, "confidence": 2 * F.abs(p - 0.5)})


def fused_score(probability: Column | None, rules: Column, anomaly: Column | None, weights: tuple[float, float, float] = (0.70, 0.20, 0.10)) -> Column:
    """Weighted mean of model probability, rules and anomaly score over those that are there."""
    parts = [(c, w) for c, w in zip((probability, rules, anomaly), weights, strict=True) if c is not None]
    top = sum((F.coalesce(c, F.lit(0.0)) * w for c, w in parts), F.lit(0.0))
    bottom = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts), F.lit(0.0))
    return unit_clip(ratio(top, bottom))
