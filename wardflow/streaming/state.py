"""Versioned tables between micro-batches.

Every batch reads the table its predecessor wrote and writes its own version, so a
batch that is run again after a failure starts from the same state and overwrites
its own half-written result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import LongType, StructField, StructType


class VersionedTable:
    """One Parquet folder per batch; ``initial`` is the table before the first batch."""

    def __init__(self, initial: DataFrame, folder: str):
        self.initial, self.folder = initial, folder

    def _path(self, batch_id: int) -> str:
        return f"{self.folder}/v{batch_id}"

    def before(self, spark: SparkSession, batch_id: int) -> DataFrame:
        if batch_id == 0:
            return self.initial
        return spark.read.schema(self.initial.schema).parquet(self._path(batch_id - 1))

    def write(self, batch_id: int, table: DataFrame) -> None:
        table.write.mode("overwrite").parquet(self._path(batch_id))

    def after(self, spark: SparkSession, batch_id: int) -> DataFrame:
        return self.before(spark, batch_id + 1)


class AppendedTable:
    """Rows that batches only add to: one Parquet folder with a part per batch.

    A batch writes its own rows, whatever has been written before it; ``initial`` are
    the rows before the first batch.
    """

    def __init__(self, initial: DataFrame, folder: str):
        self.initial, self.folder = initial, folder

    def before(self, spark: SparkSession, batch_id: int) -> DataFrame:
        if batch_id <= 0:
            return self.initial
        schema = StructType([*self.initial.schema.fields, StructField("batch", LongType())])
        written = spark.read.schema(schema).parquet(self.folder)
        return self.initial.unionByName(written.filter(f"batch < {batch_id}").drop("batch"))

    def of(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """The rows a batch has written."""
        return spark.read.schema(self.initial.schema).parquet(f"{self.folder}/batch={batch_id}")

    def write(self, batch_id: int, rows: DataFrame) -> None:
        rows.select(*[F.col(f.name).cast(f.dataType) for f in self.initial.schema]).write.mode("overwrite").parquet(f"{self.folder}/batch={batch_id}")

    def after(self, spark: SparkSession, batch_id: int) -> DataFrame:
        return self.before(spark, batch_id + 1)


def last_batch(spark: SparkSession, checkpoint: str) -> int:
    """The last batch that a stream with this checkpoint has finished (-1: none), in this run or before."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    files = path.getFileSystem(context._jsc.hadoopConfiguration())
    if not files.exists(path):
        return -1
    names = [status.getPath().getName() for status in files.listStatus(path)]
    return max((int(name) for name in names if name.isdigit()), default=-1)


def run_available(writer: DataStreamWriter, checkpoint: str) -> int:
    """Process what is there, batch by batch, and stop; returns the last batch finished (-1: none yet)."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return last_batch(SparkSession.active(), checkpoint)


def each_batch(stream: DataFrame, job: Callable[[DataFrame, int], None], checkpoint: str) -> int:
    """Run ``job(batch, batch_id)`` for every micro-batch of what is there."""
    return run_available(stream.writeStream.foreachBatch(job), checkpoint)


def to_folder(stream: DataFrame, folder: str, checkpoint: str) -> int:
    """Append a stream's rows to a Parquet folder."""
    return run_available(stream.writeStream.outputMode("append").format("parquet").option("path", folder), checkpoint)
