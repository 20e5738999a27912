"""Keyed rows that are upserted without rewriting what is there: base and delta runs, met when they are read.

A batch becomes a run: a Parquet table, bucketed and sorted by the key like all others, of the batch's own rows (and of
markers for deleted keys). Reading unites the runs and keeps the newest row of each key; the runs' buckets coincide, so that
takes no exchange. Runs of one size class are merged when there are FAN of them side by side, so a row is written about
log(rows) / log(FAN) times and there are about FAN runs of each size. A run exists when its line in the manifest does; files
of replaced runs go by vacuum(). One writer at a time.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citelake.stages import remove

#: Runs of one size class that are merged, and the ratio of classes.
FAN = 4
_RUN, _GONE = "_run", "_gone"
_MANIFEST = "number long, name string, n long, replaced array<string>"


def bucketed_write(df: DataFrame, path: str, keys: tuple[str, ...], buckets: int) -> None:
    """df in a folder, hash-bucketed and sorted by keys; the catalog's name for it is dropped again."""
    spark, name = df.sparkSession, f"citelake_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).option("compression", "zstd").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")


def bucketed_table(spark: SparkSession, path: str, schema: T.StructType, keys: tuple[str, ...], buckets: int) -> DataFrame:
    """What bucketed_write() wrote, with its buckets known. The catalog is told for a moment only: the plan keeps what it said."""
    name, by = f"citelake_{uuid.uuid4().hex}", ", ".join(f"`{k}`" for k in keys)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'")
    rows = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return rows


class MergeStore:
    """Rows by key in a folder of the shared store. Keys may hold nulls, which are a value of their own."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: tuple[str, ...], buckets: int = 32):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self.schema = T.StructType.fromDDL(schema)
        self.run_schema = T.StructType([*self.schema.fields, T.StructField(_GONE, T.BooleanType()), T.StructField(_RUN, T.LongType())])

    # runs

    def runs(self) -> list:
        """Manifest lines of living runs, oldest first."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return []
        lines = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/*").collect()  # a line a run
        gone = {name for line in lines for name in line["replaced"]}
        return sorted((line for line in lines if line["name"] not in gone), key=lambda line: (line["number"], line["name"]))

    def _run(self, name: str) -> DataFrame:
        return bucketed_table(self.spark, f"{self.path}/runs/{name}", self.run_schema, self.keys, self.buckets)

    def _write(self, rows: DataFrame, number: int, replaced: list[str]) -> None:
        name = f"run-{uuid.uuid4().hex}"
        bucketed_write(rows.select(*self.run_schema.names), f"{self.path}/runs/{name}", self.keys, self.buckets)
        n = self._run(name).count()
        self.spark.createDataFrame([(number, name, n, replaced)], _MANIFEST).coalesce(1).write.parquet(f"{self.path}/manifest/{name}")

    def _newest(self, rows: DataFrame) -> DataFrame:
        """The row of the latest run of each key, markers included."""
        rest = [c for c in self.run_schema.names if c not in self.keys]
        found = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), _RUN).alias("_r"))
        return found.select(*self.keys, *[F.col("_r")[c].alias(c) for c in rest]).select(*self.run_schema.names)

    def _united(self, runs: list) -> DataFrame:
        """All rows of the runs. Every row passes the filter; it turns the scans' column batches into rows, since Spark's union
        of column batches says that buckets coincide but sets them one after the other, so that keys would not meet."""
        return reduce(DataFrame.unionByName, [self._run(run["name"]).where(F.col(_RUN) >= 0) for run in runs])

    # writing

    def _append(self, rows: DataFrame, gone: bool) -> None:
        known = self.runs()
        number = known[-1]["number"] + 1 if known else 0
        dealt = rows.repartition(self.buckets, *self.keys)  # a task and a file a bucket
        self._write(dealt.withColumns({_GONE: F.lit(gone), _RUN: F.lit(number).cast("long")}), number, [])
        self._merge_sizes()

    def upsert(self, rows: DataFrame, *order: Column) -> None:
        """Rows replace rows of their keys. Of several rows of one key in a batch the last by `order` stays, and of equal ones
        the last by all columns."""
        rest = [F.col(c) for c in self.schema.names if c not in self.keys]
        one = rows.groupBy(*self.keys).agg(F.max(F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)], *rest)).alias("_r")) if rest else rows.select(*self.keys).distinct()
        self._append(one.select(*[F.col(c) if c in self.keys else F.col("_r")[c].alias(c) for c in self.schema.names]), False)

    def delete(self, keys: DataFrame) -> None:
        """Rows of these keys go, if there are any."""
        marks = keys.select(*self.keys).distinct()
        self._append(marks.select(*[F.col(f.name) if f.name in self.keys else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema]), True)

    @staticmethod
    def _size_class(n: int) -> int:
        size = 0
        while n >= FAN ** (size + 1) * 1024:
            size += 1
        return size

    def _merge_sizes(self) -> None:
        """Merges the newest runs while FAN or more of them, side by side, are of one size class or smaller."""
        while True:
            runs, tail = self.runs(), 0
            if not runs:
                return
            top = self._size_class(runs[-1]["n"])
            while tail < len(runs) and self._size_class(runs[-1 - tail]["n"]) <= top:
                tail += 1
            if tail < FAN:
                return
            self._merge(runs[-tail:], whole=tail == len(runs))

    def _merge(self, some: list, whole: bool) -> None:
        rows = self._newest(self._united(some))
        self._write(rows.where(f"not {_GONE}") if whole else rows, some[-1]["number"], [r["name"] for r in some])

    def compact(self) -> None:
        """One run of all."""
        if len(runs := self.runs()) > 1:
            self._merge(runs, whole=True)

    def vacuum(self) -> list[str]:
        """Removes the files of replaced runs and of batches that failed before their line was written; names them."""
        kept = {r["name"] for r in self.runs()}
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/runs/*")
        found = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where) or []
        gone = [name for x in found if (name := x.getPath().getName()) not in kept]
        for name in gone:
            remove(self.spark, f"{self.path}/runs/{name}")
        return gone

    # reading

    def read(self) -> DataFrame:
        """The living rows. A run alone is read as it is; several meet in their buckets. Map columns cannot be ordered and are not
        for this store."""
        runs = self.runs()
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        rows = self._united(runs) if len(runs) == 1 else self._newest(self._united(runs))
        return rows.where(f"not {_GONE}").select(*self.schema.names)
