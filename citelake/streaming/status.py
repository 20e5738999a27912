"""Incremental ingest and status by Structured Streaming. Each micro-batch replaces what it touches, so a batch that is
processed again after a failure changes nothing."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from citelake.stages import remove

#: Batches after which what is known is written as one table.
COMPACT_EVERY = 16


def _newest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("r")).select("r.*")


def _folders(spark: SparkSession, path: str) -> list[tuple[int, bool, str]]:
    """(batch, whether a whole table, folder) of what is written out."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    pattern = fs.Path(f"{path}/*=*/_SUCCESS")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern) or []
    names = [x.getPath().getParent().toString() for x in found]
    return [(int(n.rpartition("=")[2]), n.rpartition("/")[2].startswith("whole"), n) for n in names]


def _parts(spark: SparkSession, path: str, before: int | None = None) -> list[str]:
    """Folders that hold the state: the last whole table and the batches after it (before: up to that batch only)."""
    numbered = [x for x in _folders(spark, path) if before is None or x[0] < before]
    base = max((n for n, whole, _ in numbered if whole), default=-1)
    return [path for n, whole, path in sorted(numbered) if (whole and n == base) or (not whole and n > base)]


def fold_latest(spark: SparkSession, path: str, keys: list[str], order: list[str], every: int = COMPACT_EVERY) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps, under path, the newest row of each key. A batch writes only its own newest rows, to a
    folder of its own that a repeated batch writes again; each `every` batches what is known is written as one table, and what
    came before the last such table, which no repeated batch can ask for, is removed."""

    def sink(batch: DataFrame, number: int) -> None:
        if (number + 1) % every:
            _newest(batch, keys, order).write.mode("overwrite").parquet(f"{path}/batch={number}")
            return
        known = [spark.read.schema(batch.schema).parquet(p) for p in _parts(spark, path, number)]
        _newest(reduce(DataFrame.unionByName, [*known, batch]), keys, order).write.mode("overwrite").parquet(f"{path}/whole={number}")
        last = max((n for n, whole, _ in _folders(spark, path) if whole and n < number), default=-1)
        for n, _, folder in _folders(spark, path):
            if n < last:
                remove(spark, folder)

    return sink


def run_latest(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str]) -> StreamingQuery:
    """Process what is there now, then stop."""
    return stream.writeStream.foreachBatch(fold_latest(stream.sparkSession, path, keys, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest(spark: SparkSession, path: str, schema: str, keys: list[str], order: list[str]) -> DataFrame:
    """The state under path; without rows where no batch has come yet."""
    known = [spark.read.schema(schema).parquet(p) for p in _parts(spark, path)]
    return _newest(reduce(DataFrame.unionByName, known), keys, order) if known else spark.createDataFrame([], schema)


def due(now: float, last: float | None, every: float) -> bool:
    """Whether an interval job is due."""
    return last is None or now - last >= every


def breaker_open(calls: DataFrame, now: str, failures: int = 5, seconds: int = 300) -> DataFrame:
    """Providers whose last `failures` calls all failed, the last of them less than `seconds` ago. calls: (provider, ts, ok)."""
    last = Window.partitionBy("provider").orderBy(F.desc("ts"))
    recent = calls.withColumn("n", F.row_number().over(last)).where(F.col("n") <= failures).groupBy("provider").agg(F.count("*").alias("calls"), F.max("ok").alias("any_ok"), F.max("ts").alias("ts"))
    hot = (F.col("calls") == failures) & ~F.col("any_ok") & (F.col("ts") > F.to_timestamp(F.lit(now)) - F.expr(f"INTERVAL {seconds} SECONDS"))
    return recent.select("provider", hot.alias("open"))
