"""Stores of manifests, drift reports and run metrics: logs of JSON rows that only grow, read back by name and time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from riskweave.sources.files import append_log, latest, read_log


class Store:
    """Rows of one shape under a path, each with a name and the time it was recorded (UTC microseconds). Recording appends, so
    writers don't disturb each other and history stays; readers take the latest of a name."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path = spark, path
        self.schema = StructType.fromDDL(f"name string, recorded_us bigint, {schema}")

    def record(self, rows: DataFrame, name: Column | str, recorded_us: Column | int | None = None) -> None:
        """Append rows under a name, which may differ by row; the time is now unless given."""
        when = F.unix_micros(F.current_timestamp()) if recorded_us is None else recorded_us if isinstance(recorded_us, Column) else F.lit(recorded_us)
        own = {"name": F.lit(name) if isinstance(name, str) else name, "recorded_us": when.cast("bigint")}
        append_log(rows.withColumns(own).select(*self.schema.names), self.path)

    def all(self) -> DataFrame:
        """Every row ever recorded; none if nothing was."""
        return read_log(self.spark, self.path, self.schema)

    def history(self, name: str) -> DataFrame:
        return self.all().where(F.col("name") == name).orderBy("recorded_us")

    def latest(self, *keys: str) -> DataFrame:
        """The last row of each name, and of each further key within it."""
        return latest(self.all(), "recorded_us", ["name", *keys])


def manifests(spark: SparkSession, path: str) -> Store:
    """Dataset manifests by dataset name, as drift.manifest makes them."""
    return Store(spark, path, "version string, source string, feature_version string, row_count bigint, schema string, checksum string")


def drift_reports(spark: SparkSession, path: str) -> Store:
    """Rows of drift.drift_report by the name of the comparison; latest("column") gives the last report."""
    return Store(spark, path, "column string, role string, kind string, score double, drifted boolean, missing_rate_delta double, out_of_range_share double")


def run_metrics(spark: SparkSession, path: str) -> Store:
    """Metrics of runs (metric, value) by run name; latest("metric") gives the last value of each."""
    return Store(spark, path, "metric string, value double")
