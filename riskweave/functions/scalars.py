"""Scalar column functions: calendar, geography, numbers, identifiers, display."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"
_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(c: Column | str) -> Column:
    """Microseconds since the epoch of a timestamp with or without zone (UTC session)."""
    return F.unix_micros(col(c).cast("timestamp"))


def calendar(c: Column | str) -> dict[str, Column]:
    """Hour, day of the week with Monday 0, weekend and night (0 to 5 h) flags."""
    t = col(c)
    return {
        "event_hour": F.hour(t).cast("double"),
        "event_day_of_week": F.weekday(t).cast("double"),
        "is_weekend": F.weekday(t).isin(5, 6).cast("double"),
        "is_night": F.hour(t).between(0, 5).cast("double"),
    }


def duration_seconds(text: str) -> float:
    """Seconds of "15 minutes", "1.5 hours" and the like, for options; any other text is an error."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*(second|minute|hour|day)s?\s*", text, re.I)
    if not m:
        raise ValueError(f"not a duration: {text!r}")
    return float(m[1]) * _UNITS[m[2].lower()]


def duration_seconds_column(c: Column | str) -> Column:
    """The same for a column; null where the text is no duration."""
    parts = r"^\s*(\d+(?:\.\d+)?)\s*(second|minute|hour|day)s?\s*$"
    text = F.lower(col(c))
    number = F.regexp_extract(text, parts, 1)
    factor = F.create_map(*[F.lit(x) for kv in _UNITS.items() for x in kv])
    return F.when(number != "", number.try_cast("double") * F.element_at(factor, F.regexp_extract(text, parts, 2)))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a1, a2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((a2 - a1) / 2), F.lit(2)) + F.cos(a1) * F.cos(a2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return 2 * EARTH_KM * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))  # least() would pass over a null


def ewm(values: Column, alpha: float = 0.2) -> Column:
    """Exponential moving average of an array, seeded with its first value; 0 for an empty one."""
    rest = F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0)))
    return F.when(F.size(values) > 0, F.aggregate(rest, F.element_at(values, 1), lambda s, x: alpha * x + (1 - alpha) * s)).otherwise(F.lit(0.0))


def unit_clip(c: Column) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))


def logistic(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def ratio(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    """a / b, or another value where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(otherwise))


def mask(c: Column | str, namespace: str = "riskweave") -> Column:
    """A stable display identifier that doesn't reveal the value; null stays null."""
    value = col(c).cast("string")
    return F.concat(F.lit("id_"), F.substring(F.sha2(F.concat(F.lit(f"{namespace}:"), value), 256), 1, 12))


def uuid5(name: Column, namespace: str = NAMESPACE_URL) -> Column:
    """Version 5 UUID of a name, as text."""
    h = F.substring(F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8"))), 1, 32)
    variant = F.element_at(F.array(*map(F.lit, "89ab")), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def redact_text(c: Column | str) -> Column:
    """Bearer tokens, credentials in URLs and key=value secrets, replaced by [REDACTED]."""
    # fixed values: the three patterns decide what logs and displays show
    out = F.regexp_replace(col(c), r"(?i)(bearer\s+)[A-Za-z0-9._~+/=-]+", "$1[REDACTED]")
    out = F.regexp_replace(out, r"(://)([^:/\s]+):([^@\s]+)@", "$1[REDACTED]:[REDACTED]@")
    return F.regexp_replace(out, r"(?i)(\b(?:password|token|secret|api[_-]?key)\s*[=:]\s*)([^\s,;]+)", "$1[REDACTED]")


def bounded_error(c: Column | str, kind: Column | str, limit: int = 2000) -> Column:
    """An error text without outer white space, its kind where it is empty, and no longer than the limit."""
    return F.substring(F.coalesce(F.nullif(F.trim(col(c)), F.lit("")), col(kind)), 1, limit)


def latency_seconds(c: Column | str, now: Column | None = None) -> Column:
    """Seconds from a time to now, or to another time."""
    return (now if now is not None else F.current_timestamp()).cast("timestamp").cast("double") - col(c).cast("timestamp").cast("double")


DASH = "—"


def format_probability(c: Column | str) -> Column:
    return F.when(col(c).isNotNull(), F.format_string("%.1f%%", col(c) * 100)).otherwise(DASH)


def format_amount(c: Column | str, currency: str = "") -> Column:
    return F.coalesce(F.trim(F.concat(F.lit(f"{currency} "), F.format_number(col(c), 2))), F.lit(DASH))


def format_timestamp(c: Column | str) -> Column:
    return F.coalesce(F.date_format(col(c), "yyyy-MM-dd HH:mm:ss 'UTC'"), F.lit(DASH))


#: States of a service and how they are shown.
_HEALTH = {"healthy": "Healthy", "ok": "Healthy", "degraded": "Degraded", "unavailable": "Unavailable", "not_ready": "Not ready"}


def health_label(c: Column | str) -> Column:
    labels = F.create_map(*[F.lit(x) for kv in _HEALTH.items() for x in kv])
    return F.coalesce(F.try_element_at(labels, F.lower(col(c))), F.lit("Unknown"))


def metric_or(c: Column | str, fallback: str = DASH) -> Column:
    return F.coalesce(col(c).cast("string"), F.lit(fallback))


def features_to_json(names: list[str]) -> Column:
    """A JSON object of the features that aren't null, by name; maps keep the given order, so names come sorted."""
    pairs = F.map_from_arrays(F.array(*[F.lit(n) for n in sorted(names)]), F.array(*[F.col(n).cast("double") for n in sorted(names)]))
    return F.to_json(F.map_filter(pairs, lambda k, v: v.isNotNull()))


def features_from_json(c: Column | str) -> Column:
    return F.from_json(col(c), "map<string,double>")
