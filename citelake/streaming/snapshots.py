"""Dictionaries that change while a stream runs: a stream joined with the newest version of a table, batch by batch.

A version is a Parquet table of its own; it is there once its folder is whole, and nothing is written over. A batch notes the
version it uses before it does anything, so a batch that is repeated after a failure uses the same one again and writes the
same result over its own; a version that comes in between is the next batch's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from citelake.stages import remove


def _numbers(spark: SparkSession, pattern: str) -> list[int]:
    """Numbers of whole tables whose folders are name=<number>."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{pattern}/_SUCCESS")
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where) or []
    return sorted(int(x.getPath().getParent().getName().rpartition("=")[2]) for x in found)


class Snapshots:
    """Versions of a table in a folder of the shared store. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def publish(self, rows: DataFrame) -> int:
        """The next version."""
        number = max(_numbers(self.spark, f"{self.path}/version=*"), default=-1) + 1
        rows.write.mode("overwrite").parquet(f"{self.path}/version={number}")  # over what a failed writer may have left
        return number

    def newest(self) -> int | None:
        return max(_numbers(self.spark, f"{self.path}/version=*"), default=None)

    def read(self, number: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/version={number}")

    def drop_before(self, number: int) -> None:
        """Removes versions that no batch can ask for again."""
        for old in _numbers(self.spark, f"{self.path}/version=*"):
            if old < number:
                remove(self.spark, f"{self.path}/version={old}")


def batch_with_snapshot(known: Snapshots, join: Callable[[DataFrame, DataFrame], DataFrame], path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: join(batch, snapshot) of each batch goes to path/results/batch=<number>, the version it used to
    path/used. A batch that comes before any version is an error, and is tried again by the next run."""

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number not in _numbers(spark, f"{path}/used/batch=*"):
            if (newest := known.newest()) is None:
                raise ValueError(f"no version in {known.path}")
            spark.createDataFrame([(newest,)], "version int").coalesce(1).write.mode("overwrite").parquet(f"{path}/used/batch={number}")
        version = spark.read.parquet(f"{path}/used/batch={number}").first()[0]
        join(batch, known.read(version)).write.mode("overwrite").parquet(f"{path}/results/batch={number}")

    return sink


def run_joined(stream: DataFrame, known: Snapshots, join: Callable[[DataFrame, DataFrame], DataFrame], path: str) -> StreamingQuery:
    """Processes what is there now, then stops; the next run goes on."""
    return stream.writeStream.foreachBatch(batch_with_snapshot(known, join, path)).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()


def results(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all batches, with the batch's number."""
    return spark.read.option("basePath", f"{path}/results").parquet(*[f"{path}/results/batch={n}" for n in _numbers(spark, f"{path}/results/batch=*")])
