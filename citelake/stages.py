"""Stage tables: lineage is cut by Parquet in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Bounded Arrow batches: a Python worker and its task hold a few of them at a time, whatever the texts' lengths.
ARROW = {"spark.sql.execution.arrow.maxBytesPerBatch": "8m", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches for the session, where its owner has not set them. The registered queries call it, since their
    last step runs after they return; operators leave the session as it is."""
    for key, value in ARROW.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Unset, a local session (tests) gets a temporary folder and a cluster an error."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="citelake-")
        shared_dir.own = root
    return root.rstrip("/")


def stage_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/citelake/{label}-{uuid.uuid4().hex}"


#: A table in one file of at most this size is dealt out to all cores as it is read: its one row group would be one task.
ONE_FILE_BYTES = 256 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of a folder."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    df, found = spark.read.parquet(path), spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    status = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(found)
    return df.repartition(spark.sparkContext.defaultParallelism) if status.isFile() and status.getLen() <= ONE_FILE_BYTES else df


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table of its own: written once, read by all that follows."""
    path = stage_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, on whatever file system it lies."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
