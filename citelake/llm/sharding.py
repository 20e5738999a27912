"""Sharding (operator 7): a two-pass external shuffle, with DataFrame operations only.

Pass 1 scatters whole records uniformly into memory-sized buckets by a seeded hash (one exchange, spilled to disk by
Spark; one task a bucket). Pass 2 collects one bucket at a time and permutes it with Spark's shuffle(), a seeded
Fisher-Yates shuffle, which starts anew in each task, so the order follows from the rows, the seed and the number of
buckets. The buckets in order are then one random order of all rows; row p of it goes to shard p mod n at slot p div n, so
the shards' counts are at most one apart (law `rows`) and slots have no gaps. The number of buckets comes from the total
size of the rows, whatever it is, and offsets from a count per bucket, taken in a scan before.

The hash takes the id and the whole text, so that neither copies of a text nor rows without id gather anywhere (rows that
repeat both are told apart by their other columns; rows equal in all columns share a bucket). Defined results: null
texts have size 1 and CRC 0; repeated rows, null ids and ties are rows like any other; an empty table gives no rows; other
columns pass through, whatever their names, unless these are the names of results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

RESULTS = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def row_bytes(docs: DataFrame) -> Column:
    """About the bytes of a row: texts as they are, 16 for any other column."""
    parts = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) + 16 if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.lit(16) for f in docs.schema.fields]
    return sum(parts, F.lit(16)).cast("long")


def _labels(spark: SparkSession, buckets: int) -> DataFrame:
    """(bucket, label): a number that Spark's hash partitioning sends to the partition of the bucket's number, so that each
    task has one bucket. Of 32 numbers tried a bucket one fits but for a chance of e^-32."""
    return spark.range(32 * buckets).groupBy(F.pmod(F.hash("id"), F.lit(buckets)).cast("long").alias("bucket")).agg(F.min("id").alias("label"))


def shuffle_into_shards(docs: DataFrame, shards: int = 8, seed: int = 17, bucket_bytes: int = 32 << 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of docs with the result columns."""
    docs = docs.drop(*RESULTS)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    total = docs.agg(F.sum(row_bytes(docs))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if isinstance(f.dataType, T.AtomicType)]
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text), *plain), F.lit(buckets))
    counts = common.written(docs.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("count")), "shard-buckets")
    running = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = counts.select("bucket", (F.sum("count").over(running) - F.col("count")).alias("first"))  # one short row per bucket
    places = common.written(offsets.join(_labels(docs.sparkSession, buckets), "bucket", "left").select("bucket", "first", F.coalesce("label", -1 - F.col("bucket")).alias("label")), "shard-places")
    rows = docs.select(bucket.alias("bucket"), F.struct(*columns).alias("row"), F.col(doc_id).alias("id"), F.xxhash64(F.col(text), *plain).alias("hash"))
    labelled = rows.join(F.broadcast(places), "bucket").drop("bucket")  # 24 bytes for each bucket_bytes of rows
    # sorted first, so that a bucket's order before the draw does not depend on how blocks arrived
    ordered = labelled.repartition(buckets, "label").sortWithinPartitions("label", "id", "hash")
    drawn = ordered.groupBy("label").agg(F.min("first").alias("first"), F.collect_list("row").alias("rows")).select("first", F.posexplode(F.shuffle("rows", F.lit(seed))).alias("at", "row"))
    placed = drawn.select("row", (F.col("first") + F.col("at")).alias("place"))
    body = F.col(f"row.`{text}`")
    result = F.struct(
        (F.coalesce(F.octet_length(body), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(body, F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"), (F.col("place") % shards).cast("int").alias("shard"), F.floor(F.col("place") / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
    return placed.select("row", result.alias("result")).select("row.*", "result.*")


def write_shards(sharded: DataFrame, path: str, file_rows: int = 1_000_000) -> None:
    """One folder a shard, its rows by slot, in files of at most file_rows rows, each written by a task of its own."""
    part = F.floor(F.col("slot") / file_rows)
    sharded.repartition("shard", part).sortWithinPartitions("shard", "slot").write.option("maxRecordsPerFile", file_rows).partitionBy("shard").parquet(path)
