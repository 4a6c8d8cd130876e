"""Partitioned logs of keyed messages: a broker's topics, or files of the same columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_SCHEMA = "key binary, value binary, topic string, partition int, offset long, timestamp timestamp"


def read_topic(spark: SparkSession, servers: str, topic: str, starting: str = "latest", per_trigger: int | None = None) -> DataFrame:
    """A topic as a stream; lost data fails the query. Needs Spark's Kafka package."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting, "failOnDataLoss": "true"}
    if per_trigger:
        options["maxOffsetsPerTrigger"] = str(per_trigger)
    return spark.readStream.format("kafka").options(**options).load()


def read_log_files(spark: SparkSession, path: str, per_trigger: int | None = None, fmt: str = "parquet") -> DataFrame:
    """Files of log records as a stream, in the columns that a topic has."""
    reader = spark.readStream.format(fmt).schema(LOG_SCHEMA)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).load(path)


def write_topic(batch: DataFrame, servers: str, topic: str) -> None:
    """A batch of (key, value) to a topic, acknowledged by all replicas; an empty batch sends nothing."""
    if batch.isEmpty():
        return
    out = batch.select(F.col("key").cast("string"), F.col("value").cast("string"))
    out.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("kafka.acks", "all").option("kafka.enable.idempotence", "true").save()


def write_log_files(batch: DataFrame, batch_id: int, path: str) -> None:
    """A batch of (key, value, topic) as files; a retried batch replaces its own."""
    out = batch.withColumn("_batch_id", F.lit(batch_id))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("topic", "_batch_id").parquet(path)
