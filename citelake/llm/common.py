"""Shared helpers: table access, the shared scratch folder, stage tables, word hashing."""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
from contextlib import contextmanager

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citelake import stages
from citelake.stages import ARROW, small_batches, stage_path

#: White space that separates words and is stripped from line ends (fixed by the contracts).
BLANKS = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@contextmanager
def bounded_batches(spark: SparkSession):
    """The same bounds for the time of one action."""
    before = {key: spark.conf.get(key, None) for key in ARROW}
    small_batches(spark)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return stages.table(spark, sf_dir, name)


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back."""
    spark, path = df.sparkSession, stage_path(df.sparkSession, label)
    with bounded_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Remove the files of tables that written() made and nothing reads any more."""
    for df in tables:
        for parent in {name.rpartition("/")[0] for name in df.inputFiles()}:
            remove(df.sparkSession, parent)


def run_table(df: DataFrame, path: str, keys: tuple[str, ...], buckets: int) -> None:
    """Write df as an immutable run: hash-bucketed by keys and sorted in each bucket, so that later joins and aggregations
    on them need no exchange. The catalog's name for it is dropped again; the files stay."""
    spark, name = df.sparkSession, f"citelake_{uuid.uuid4().hex}"
    with bounded_batches(spark):
        df.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).option("compression", "zstd").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")


def open_run(spark: SparkSession, path: str, columns: str, keys: tuple[str, ...], buckets: int) -> DataFrame:
    """A run's rows, with its buckets known. The catalog is told for a moment only: the plan keeps what it said."""
    name, by = f"citelake_{uuid.uuid4().hex}", ", ".join(keys)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'")
    rows = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return rows


def give_back() -> None:
    """At a task's end: memory that Python has freed goes back to the system, since idle workers keep what they hold."""
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def buckets_of(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, A_TO_Z, A_TO_Z.lower())


def text_key(text: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes that stand for a whole text; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    return F.xxhash64(t), F.xxhash64(F.lit(7), t)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash, so that every bit depends on all of x."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[ord(c) for c in BLANKS]] = True
#: The first n of eight bytes.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Longer words are hashed one at a time.
_WORD_BYTES = 64
_CHAINS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)), (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))


class Words:
    """The words of UTF-8 bytes as WORD finds them: first and end are their places, hashes() their 64-bit hashes."""

    def __init__(self, data: np.ndarray):
        edge = np.flatnonzero(np.diff(_BLANK[data], prepend=True, append=True))
        self.data, self.first, self.end = data, edge[::2], edge[1::2]

    def hashes(self, chain: int = 0) -> np.ndarray:
        """Eight bytes at a time, all words at once, go through an invertible mix, so words of one length up to eight bytes
        never share a hash. The two chains are independent; both together make 128 bits."""
        start, step = _CHAINS[chain]
        first, size = self.first, self.end - self.first
        padded = np.zeros(len(self.data) + 8, np.uint8)
        padded[: len(self.data)] = self.data
        eight = np.ndarray(len(self.data) + 1, "<u8", padded, strides=(1,))
        with np.errstate(over="ignore"):
            out = mix(size.astype(np.uint64) * step + start)
            who, at = np.flatnonzero(size <= _WORD_BYTES), 0
            while len(who):
                some = eight[first[who] + at] & _FIRST[np.minimum(size[who] - at, 8)]
                out[who] = mix((out[who] ^ some) * step)
                at += 8
                who = who[size[who] > at]
            for i in np.flatnonzero(size > _WORD_BYTES).tolist():
                out[i] = xxhash.xxh3_64_intdigest(self.data[first[i] : self.end[i]], int(start))
        return out


def ascii_lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def text_slices(batch, column: int, most: int = 1 << 20):
    """Slices of an Arrow batch whose texts hold at most `most` bytes (or one text), each with its texts' bytes joined by
    line feeds and the first byte of every text."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    start = 0
    while start < batch.num_rows:
        total = np.cumsum(sizes[start:])
        n = max(1, int(np.searchsorted(total, most, side="right")))
        part = batch.slice(start, n)
        joined = "\n".join(t or "" for t in part.column(column).to_pylist()).encode("utf-8", "surrogatepass")
        yield part, np.frombuffer(joined, np.uint8), np.concatenate([[0], total[: n - 1]])
        start += n
