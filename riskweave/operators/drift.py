"""Drift between two tables, data quality, and manifests."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from riskweave.operators.evaluation import with_running_totals

EDGES = 11


def common_columns(a: DataFrame, b: DataFrame) -> list[str]:
    return sorted(set(a.columns) & set(b.columns))


def numeric_columns(df: DataFrame) -> set[str]:
    return {f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)}


def drift_report(reference: DataFrame, current: DataFrame, columns: list[str] | None = None, threshold: float = 0.20, prediction: str = "final_risk_score") -> DataFrame:
    """A row per common column: kind, score, drifted, missing-rate change, share of current values out of range.

    Numeric columns (numeric on both sides) are cut at the reference's unique deciles; the score is half the sum of share
    differences, current values out of range left out. A constant reference compares means, at most 1; with one side empty
    the score is 1, with both 0. Others compare shares of values, nulls as one of them. All numeric columns go through two
    passes and all others through one, whatever their number.
    """
    names = columns or common_columns(reference, current)
    numeric = [c for c in names if c in numeric_columns(reference) & numeric_columns(current)]
    other = [c for c in names if c not in numeric]
    parts = []
    if numeric:
        parts.append(_numeric_drift(reference, current, numeric))
    if other:
        parts.append(_categorical_drift(reference, current, other))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    gaps = _missing(reference, names, "r").join(_missing(current, names, "c"), "column")
    out = out.join(gaps, "column").withColumn("missing_rate_delta", F.col("missing_c") - F.col("missing_r"))
    return out.select(
        "column", F.when(F.col("column") == prediction, "prediction").otherwise("feature").alias("role"), "kind", "score", (F.col("score") >= threshold).alias("drifted"), "missing_rate_delta", "out_of_range_share"
    )


def drifted_count(report: DataFrame) -> DataFrame:
    return report.agg(F.count("*").alias("columns"), F.count(F.when(F.col("drifted"), 1)).alias("drifted"))


def _missing(df: DataFrame, names: list[str], side: str) -> DataFrame:
    one = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in names])
    return one.unpivot([], names, "column", f"missing_{side}")


def _long(df: DataFrame, names: list[str], kind: str) -> DataFrame:
    return df.select(*[F.col(c).cast(kind).alias(c) for c in names]).unpivot([], names, "column", "value")


#: Accuracy of the sketches that say where deciles lie, and how far around them is looked, in shares of the ranks.
ACCURACY, AROUND = 10_000, 2e-4


def _deciles(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, edges, mean, n): the unique deciles of each numeric column, interpolated between ranks.

    Sketches give a bracket around each decile; values within a bracket are counted exactly, and so is what lies below it. That
    takes three scans and no order of a whole column. Should a bracket miss its ranks, all columns are ranked instead.
    """
    values = _long(df, names, "double").where("value is not null")
    places = [i / (EDGES - 1) for i in range(EDGES)]
    shares = [min(1.0, max(0.0, p)) for at in places for p in (at - AROUND, at + AROUND)]
    stats = values.groupBy("column").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.percentile_approx("value", shares, ACCURACY).alias("q")).collect()
    kind = "column string, edges array<double>, mean double, n bigint"
    if not stats:
        return df.sparkSession.createDataFrame([], kind)
    small = F.broadcast(df.sparkSession.createDataFrame([(r["column"], r["q"][::2], r["q"][1::2]) for r in stats], "column string, low array<double>, high array<double>"))  # a row per column
    near = values.join(small, "column")
    below = {r["column"]: r["below"] for r in near.groupBy("column").agg(F.array(*[F.count(F.when(F.col("value") < F.col("low")[i], 1)) for i in range(EDGES)]).alias("below")).collect()}
    inside = near.select("column", "value", F.explode(F.filter(F.sequence(F.lit(0), F.lit(EDGES - 1)), lambda i: F.col("value").between(F.get("low", i), F.get("high", i)))).alias("i"))
    counted = inside.groupBy("column", "i", "value").agg(F.count("*").alias("times"))
    counted = counted.withColumn("upto", F.sum("times").over(Window.partitionBy("column", "i").orderBy("value")))
    sought = {(r["column"], i): (r["n"] - 1) * at for r in stats for i, at in enumerate(places)}
    ranks = df.sparkSession.createDataFrame([(c, i, math.floor(x) - below[c][i], math.ceil(x) - below[c][i]) for (c, i), x in sought.items()], "column string, i int, lower bigint, upper bigint")
    found = counted.join(F.broadcast(ranks), ["column", "i"]).groupBy("column", "i").agg(*[F.min(F.when(F.col("upto") > F.col(k), F.col("value"))).alias(k) for k in ("lower", "upper")], F.first("lower").alias("at"))
    ends = {(r["column"], r["i"]): (r["lower"], r["upper"], r["at"]) for r in found.collect()}
    if any(k not in ends or None in ends[k] or ends[k][2] < 0 for k in sought):
        return _ranked_deciles(df, names)
    rows = []
    for r in stats:
        edges = [low + (high - low) * (sought[r["column"], i] % 1) for i in range(EDGES) for low, high, _ in (ends[r["column"], i],)]
        rows.append((r["column"], list(dict.fromkeys(edges)), r["mean"], r["n"]))
    return df.sparkSession.createDataFrame(rows, kind)


def _ranked_deciles(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, edges, mean, n): the same by counting all values. They are counted per
    column and ranked by running counts over ranges, so no task holds a column's distinct values."""
    points = _long(df, names, "double").where("value is not null").groupBy("column", "value").agg(F.count("*").alias("times"))
    run = with_running_totals(points, F.struct("column", "value"), {"upto": "times"})
    sizes = run.groupBy("column").agg(F.sum("times").alias("n"), F.max("upto").alias("end"), (F.sum(F.col("value") * F.col("times")) / F.sum("times")).alias("mean"))
    ranked = run.join(F.broadcast(sizes), "column")  # a row per column
    rank = F.col("upto") - (F.col("end") - F.col("n"))  # values up to here in the column
    cuts = []
    for i in range(EDGES):
        place = (F.col("n") - 1) * (i / (EDGES - 1))
        low, high = (F.min(F.when(rank > at, F.col("value"))) for at in (F.floor(place), F.ceil(place)))
        cuts.append((low + (high - low) * F.max(place - F.floor(place))).alias(f"q{i}"))
    edges = F.array_distinct(F.array(*[F.col(f"q{i}") for i in range(EDGES)]))
    return ranked.groupBy("column").agg(*cuts, F.first("mean").alias("mean"), F.first("n").alias("n")).select("column", edges.alias("edges"), "mean", "n")


def _numeric_drift(reference: DataFrame, current: DataFrame, names: list[str]) -> DataFrame:
    found = _deciles(reference, names).select("column", "edges", F.col("mean").alias("mean_r"), F.col("n").alias("n_r"))
    every = reference.sparkSession.createDataFrame([(c,) for c in names], "column string")
    stats = every.join(found, "column", "left").select("column", F.coalesce("edges", F.array().cast("array<double>")).alias("edges"), "mean_r", F.coalesce("n_r", F.lit(0)).alias("n_r"))
    small = F.broadcast(stats)  # a row per column

    def shares(df: DataFrame, side: str) -> DataFrame:
        v, e = F.col("value"), F.col("edges")
        bins = F.size(e) - 1
        at = F.when((v < F.element_at(e, 1)) | (v > F.element_at(e, -1)), -1).otherwise(F.least(F.size(F.filter(e, lambda x: x <= v)), bins) - 1)
        rows = _long(df, names, "double").where("value is not null").join(small, "column").where(F.size("edges") > 1).withColumn("bin", at)
        return rows.groupBy("column", "bin").agg(F.count("*").alias(side))

    both = shares(reference, "r").join(shares(current, "c"), ["column", "bin"], "full").fillna(0, ["r", "c"])
    inside = F.col("bin") >= 0
    sums = both.groupBy("column").agg(F.sum(F.when(inside, F.col("r")).otherwise(0)).alias("sr"), F.sum(F.when(inside, F.col("c")).otherwise(0)).alias("sc"), F.sum(F.when(~inside, F.col("c")).otherwise(0)).alias("out"))
    apart = both.where(inside).join(sums, "column").groupBy("column").agg((F.sum(F.abs(F.col("r") / F.greatest("sr", F.lit(1)) - F.col("c") / F.greatest("sc", F.lit(1)))) / 2).alias("distance"))
    means = current.agg(*[F.struct(F.avg(c).alias("mean"), F.count(c).alias("n")).alias(c) for c in names]).unpivot([], names, "column", "s")
    means = means.select("column", F.col("s.mean").alias("mean_c"), F.col("s.n").alias("n_c"))
    out = stats.join(means, "column").join(apart, "column", "left").join(sums, "column", "left")
    empty = (F.col("n_r") == 0) | (F.col("n_c") == 0)
    flat = F.size("edges") < 2
    score = F.when(empty, F.when(F.col("n_r") != F.col("n_c"), 1.0).otherwise(0.0)).when(flat, F.least(F.abs(F.col("mean_r") - F.col("mean_c")), F.lit(1.0))).otherwise(F.coalesce("distance", F.lit(0.0)))
    share = F.coalesce(F.try_divide(F.col("out").cast("double"), F.col("n_c").cast("double")), F.lit(0.0))
    return out.select("column", F.lit("numeric").alias("kind"), score.alias("score"), share.alias("out_of_range_share"))


def _categorical_drift(reference: DataFrame, current: DataFrame, names: list[str]) -> DataFrame:
    def counts(df: DataFrame, side: str) -> DataFrame:
        return _long(df, names, "string").fillna("<missing>", ["value"]).groupBy("column", "value").agg(F.count("*").alias(side))

    both = counts(reference, "r").join(counts(current, "c"), ["column", "value"], "full").fillna(0, ["r", "c"])
    sums = both.groupBy("column").agg(F.sum("r").alias("sr"), F.sum("c").alias("sc"))
    apart = F.abs(F.coalesce(F.try_divide(F.col("r"), F.col("sr")), F.lit(0.0)) - F.coalesce(F.try_divide(F.col("c"), F.col("sc")), F.lit(0.0)))
    out = both.join(sums, "column").groupBy("column").agg((F.sum(apart) / 2).alias("score"))
    return out.select("column", F.lit("categorical").alias("kind"), "score", F.lit(0.0).alias("out_of_range_share"))


def _repeats(df: DataFrame) -> DataFrame:
    """One row: row_count, and duplicate_rows, all but the first of each. Rows are told apart by 128 bits of hash, which say
    which fields are null, so that only these are shuffled, summed before."""
    names = [F.col(f"`{c}`") for c in df.columns]
    nulls = [c.isNull() for c in names]
    halves = [F.xxhash64(F.lit(k), *names, *nulls).alias(f"__h{k}") for k in (1, 2)]
    groups = df.select(*halves).groupBy("__h1", "__h2").agg(F.count("*").alias("__n"))
    return groups.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("row_count"), F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_rows"))


def quality_profile(df: DataFrame) -> DataFrame:
    """One row: rows, columns, duplicate rows (all but the first of each), and a JSON of missing rates, highest first."""
    names = df.columns
    rates = F.sort_array(F.array(*[F.struct((-F.avg(F.col(f"`{c}`").isNull().cast("double"))).alias("r"), F.lit(c).alias("c")) for c in names]))
    missing = df.agg(F.transform(rates, lambda x: F.struct(x["c"].alias("column"), (-x["r"]).alias("rate"))).alias("missing_rate"))
    return _repeats(df).crossJoin(missing).select("row_count", F.lit(len(names)).alias("column_count"), "duplicate_rows", "missing_rate")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """How many rows repeat an earlier one."""
    return _repeats(df).select("duplicate_rows")


def _as_text(name: str, kind: str) -> Column:
    """A field as text that engines agree on: times in microseconds, numbers with a fraction to six places, flags as 0 and 1."""
    c = F.col(f"`{name}`")
    if kind.startswith("timestamp"):
        c = F.unix_micros(c.cast("timestamp"))
    elif kind in ("double", "float") or kind.startswith("decimal"):
        c = F.format_string("%.6f", c.cast("double"))
    elif kind == "boolean":
        c = c.cast("int")
    return F.coalesce(c.cast("string"), F.lit("<null>"))


def manifest(df: DataFrame, version: str, source: str, feature_version: str) -> DataFrame:
    """One row on a dataset: count, columns, types, and a checksum that its rows' order doesn't change: the MD5 of the schema, the
    count and the sum of the first 52 bits of each row's MD5. Fields enter as _as_text makes them."""
    names = sorted(df.columns)
    kinds = dict(df.dtypes)
    schema = ",".join(f"{n}:{kinds[n]}" for n in names)
    row = F.conv(F.substring(F.md5(F.concat_ws("\x1f", *[_as_text(n, kinds[n]) for n in names])), 1, 13), 16, 10).cast("decimal(38,0)")
    total = F.coalesce(F.sum(row), F.lit(0).cast("decimal(38,0)"))
    return df.agg(F.count("*").alias("row_count"), total.alias("__sum")).select(
        F.lit(version).alias("version"), F.lit(source).alias("source"), F.lit(feature_version).alias("feature_version"), "row_count", F.lit(schema).alias("schema"),
        F.md5(F.concat_ws("|", F.lit(schema), F.col("row_count").cast("string"), F.col("__sum").cast("string"))).alias("checksum"),
    )
