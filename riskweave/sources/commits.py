"""A commit log for batches: what a batch writes to several tables counts once, whatever fails and is tried again."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH, ATTEMPT = "_batch_id", "_attempt"


@dataclass(frozen=True)
class Part:
    """What a batch writes to one table, and how."""

    rows: DataFrame
    fmt: str = "parquet"
    by: tuple[str, ...] = ()


class CommitLog:
    """Tables under a path, written batch by batch.

    Each attempt at a batch writes to places of its own, under its batch's number and its own id. When all tables are written, the
    attempt claims the batch by creating a file named after it, which only the first can; what others wrote is never read. A
    batch that is claimed is not written again. An attempt that fails takes its files back; those of one that was killed stay
    unread until vacuum(). Creating a file that isn't there has to be atomic, as it is in HDFS and local file systems.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.claims = spark, path.rstrip("/"), f"{path.rstrip('/')}/_commits"

    def _fs(self, path: str) -> tuple[Any, Any]:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def is_done(self, batch_id: int) -> bool:
        fs, place = self._fs(f"{self.claims}/{batch_id}")
        return fs.exists(place)

    def _claim(self, batch_id: int, attempt: str) -> bool:
        fs, place = self._fs(f"{self.claims}/{batch_id}")
        try:
            out = fs.create(place, False)
        except Exception:  # noqa: BLE001  the file system's own kind of error
            if self.is_done(batch_id):
                return False
            raise
        out.write(bytearray(f"{batch_id} {attempt}\n".encode()))
        out.close()
        return True

    def write(self, batch_id: int, parts: dict[str, Part]) -> bool:
        """Write a batch's parts and claim it; False if it was claimed before, now or in the meantime."""
        if self.is_done(batch_id):
            return False
        attempt = uuid.uuid4().hex
        claimed = False
        try:
            for name, part in parts.items():
                rows = part.rows.withColumns({BATCH: F.lit(batch_id), ATTEMPT: F.lit(attempt)})
                rows.write.mode("append").format(part.fmt).partitionBy(*part.by, BATCH, ATTEMPT).save(f"{self.path}/{name}")
            claimed = self._claim(batch_id, attempt)
            return claimed
        finally:
            if not claimed:
                self._remove(parts, lambda b, a: a == attempt)

    def committed(self) -> DataFrame:
        """(_batch_id, _attempt) of the batches that count."""
        fs, place = self._fs(self.claims)
        if not fs.exists(place):
            return self.spark.createDataFrame([], f"{BATCH} bigint, {ATTEMPT} string")
        fields = F.split("value", " ")
        return self.spark.read.text(self.claims).select(fields[0].cast("bigint").alias(BATCH), fields[1].alias(ATTEMPT))

    def read(self, name: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
        """A table's rows of committed batches, with _batch_id. Partitions of other attempts are pruned by the join."""
        reader = self.spark.read.format(fmt)
        rows = (reader.schema(f"{schema}, {BATCH} bigint, {ATTEMPT} string") if schema else reader).load(f"{self.path}/{name}")
        columns = [c for c in rows.columns if c != ATTEMPT]
        return rows.withColumn(BATCH, F.col(BATCH).cast("bigint")).join(F.broadcast(self.committed()), [BATCH, ATTEMPT]).select(*columns)

    def vacuum(self, names: list[str]) -> int:
        """Remove what attempts at claimed batches wrote in vain; how many places that were. Batches in work stay."""
        won = {str(r[BATCH]): r[ATTEMPT] for r in self.committed().toLocalIterator()}
        return self._remove(dict.fromkeys(names), lambda b, a: b in won and won[b] != a)

    def _remove(self, names, lost) -> int:
        removed = 0
        for name in names:
            fs, place = self._fs(f"{self.path}/{name}")
            waiting = [place] if fs.exists(place) else []
            while waiting:
                for status in fs.listStatus(waiting.pop()):
                    kind, _, value = status.getPath().getName().partition("=")
                    if kind == ATTEMPT and lost(status.getPath().getParent().getName().partition("=")[2], value):
                        removed += fs.delete(status.getPath(), True)
                    elif status.isDirectory() and value and kind != ATTEMPT:
                        waiting.append(status.getPath())
        return removed
