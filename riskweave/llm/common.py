"""What the corpus operators share: table access, checkpoints, partition counts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a fresh one in local sessions. On a cluster that
    names none it is an error, as executors would each write to a disk of their own."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if found is None:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            found = tempfile.mkdtemp(prefix="riskweave-")
            atexit.register(shutil.rmtree, found, ignore_errors=True)
        sc.setCheckpointDir(found)
    return found or sc.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Write a frame once as Parquet in the shared folder and read it back.

    It cuts lineage, outlives lost executors, and gives later joins real sizes. The table goes when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/riskweave-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def checkpoint(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Stands for a missing id inside tasks, where a null would turn a batch's ids into floats.
NO_ID = -(2**63)


def filled(column):
    return F.coalesce(column.cast("long"), F.lit(NO_ID).cast("long"))


def emptied(column):
    return F.nullif(column, F.lit(NO_ID).cast("long"))


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name in df.columns:
        name += "_"
    return name


def id_bounds(ids: DataFrame, column: str, buckets: int) -> list[int]:
    """Inner bounds that cut the ids into about equal runs: at most `buckets` numbers.

    Approximate quantiles over all rows; they steer only the split, never the result.
    """
    if buckets <= 1:
        return []
    cuts = [i / buckets for i in range(1, buckets)]
    found = ids.agg(F.percentile_approx(column, cuts, max(10_000, 10 * buckets)).alias("q")).first()["q"]
    return sorted(set(found or []))


def bucket_of(column, bounds: list[int]):
    """Number of bounds that are at or below the id; null ids go to run 0."""
    if not bounds:
        return F.lit(0)
    # a sorted literal array is searched once per row, in the JVM
    at = F.array_size(F.filter(F.lit(bounds), lambda b: b <= column)) if len(bounds) <= 64 else None
    if at is None:
        step = max(1, int(len(bounds) ** 0.5))
        coarse = bounds[::step]
        k = F.array_size(F.filter(F.lit(coarse), lambda b: b <= column))
        groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
        fine = F.array_size(F.filter(F.element_at(F.array(*[F.lit(g) for g in groups]), k), lambda b: b <= column))
        at = F.when(k == 0, F.lit(0)).otherwise((k - 1) * step + fine)
    return F.when(column.isNull(), F.lit(0)).otherwise(at).cast("int")
