"""File sources and sinks: JSON lines with bad lines kept, Parquet, tables of results, quarantine, manifests."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut from its lineage in the folder of spark.checkpoint.dir; in local sessions without one, in a fresh folder. On a
    cluster that names none it is an error, as executors would each write to a disk of their own."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        place = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if place is None:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            place = tempfile.mkdtemp(prefix="riskweave-")
            atexit.register(shutil.rmtree, place, ignore_errors=True)
        sc.setCheckpointDir(place)
    return df.checkpoint(eager=True)


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON lines by a fixed schema, with `raw_line`, `parse_ok` and a `line_id` that is unique within a read and rises along each
    file, but moves where files are split otherwise; bad lines stay, with null fields."""
    lines = spark.read.text(path).select(F.col("value").alias("raw_line"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line_id"))
    full = StructType([*schema.fields]).add("_corrupt", "string")  # a list of its own: add() would change the caller's schema
    parsed = lines.where(F.trim("raw_line") != "").withColumn("r", F.from_json("raw_line", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    return parsed.select("line_id", "file", "raw_line", (F.col("r").isNotNull() & F.col("r._corrupt").isNull()).alias("parse_ok"), *[F.col(f"r.{n}").alias(n) for n in schema.names])


def read_records(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Records of a .jsonl, .ndjson or .parquet path; other formats are an error, a missing path is Spark's own."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind in ("jsonl", "ndjson"):
        if schema is None:
            raise ValueError("JSON lines need a schema")
        return read_jsonl(spark, path, schema)
    raise ValueError(f"unsupported format: .{kind}")


def ingested(spark: SparkSession, path: str, schema: StructType, require_labels: bool = False, allowed_categories: tuple[str, ...] = ()) -> DataFrame:
    """Records of JSON lines with `record_index` and `issue`, null for valid ones: unreadable lines, broken fields, missing labels
    and unknown categories where asked for, and repeated ids, as contracts.classified tells them."""
    from riskweave.operators.contracts import classified, normalised

    rows = read_jsonl(spark, path, schema).withColumnRenamed("line_id", "record_index").drop("file")
    # parsed once: the rules ask for every field several times
    return classified(checkpointed(normalised(rows)), "record_index", require_labels, allowed_categories, F.col("parse_ok"))


def quarantine_rows(rejected: DataFrame, index: str = "record_index", code: str = "issue", message: Column | None = None, raw: Column | None = None) -> DataFrame:
    """One JSON object per rejected record, as `value`: record_index, code, message, raw_record."""
    message = message if message is not None else F.concat(F.lit("rejected: "), F.col(code))
    raw = raw if raw is not None else F.to_json(F.struct(*[c for c in rejected.columns if c not in (index, code)]), {"ignoreNullFields": "false"})
    return rejected.select(F.to_json(F.struct(F.col(index).alias("record_index"), F.col(code).alias("code"), message.alias("message"), raw.alias("raw_record"))).alias("value"))


def write_quarantine(rejected: DataFrame, path: str, **kwargs) -> None:
    quarantine_rows(rejected, **kwargs).write.mode("overwrite").text(path)


def write_report(report: DataFrame, path: str) -> None:
    """A one-row report as one JSON file."""
    report.coalesce(1).write.mode("overwrite").json(path)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of every file; each file is read by one task and must fit in it."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def tabular(records: DataFrame, malformed: Column, raw: Column) -> DataFrame:
    """Records for Parquet: their kind, labels under a `simulation_` prefix, and the raw JSON of malformed ones."""
    renamed = {c: f"simulation_{c}" for c in ("fraud_label", "fraud_type") if c in records.columns}
    out = records.withColumn("record_kind", F.when(malformed, "malformed").otherwise("valid")).withColumn("raw_record", F.when(malformed, raw))
    return out.withColumnsRenamed(renamed)


def nested(records: DataFrame, event_fields: list[str]) -> DataFrame:
    """{event, ground_truth} rows for JSON lines."""
    return records.select(F.struct(*event_fields).alias("event"), F.struct("fraud_label", "fraud_type").alias("ground_truth"))


def write_results(tables: dict[str, DataFrame], folder: str, config: dict | None = None, metadata: DataFrame | None = None) -> None:
    """A CSV folder per result table, with headers; beside them, where given, the run's configuration as one row of JSON texts by
    name and its metadata."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")
    if config is not None:
        spark = next(iter(tables.values())).sparkSession
        rows = [(k, json.dumps(v, sort_keys=True)) for k, v in sorted(config.items())]
        write_report(spark.createDataFrame(rows, "name string, value string"), f"{folder}/config")
    if metadata is not None:
        write_report(metadata, f"{folder}/metadata")


def append_log(df: DataFrame, path: str) -> None:
    """Append rows to a JSON log, for explanations, metrics of runs, manifests and drift reports."""
    df.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of a JSON log; a log that isn't there reads as empty."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def latest(log: DataFrame, time: str, by: list[str] | None = None) -> DataFrame:
    """The row with the latest time, per key if there are any."""
    whole = F.struct(*log.columns)
    found = (log.groupBy(*by) if by else log.groupBy()).agg(F.max_by(whole, time).alias("r"))
    return found.select("r.*").where(F.col(time).isNotNull())


def write_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """A micro-batch as the partition of its number; a retry replaces it, so nothing is written twice."""
    out = batch.withColumn("_batch_id", F.lit(batch_id))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_batch_id").parquet(path)


def write_jdbc(df: DataFrame, url: str, table: str, **options: str) -> None:
    """Append to a database table; needs the database's driver on the class path."""
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save()
