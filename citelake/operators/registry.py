"""Registry tables: upserts, anti-joins, latest states and rollups over plain Parquet rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citelake.functions import text

#: Fixed values.
CATEGORIES = ("规范规程", "投标文件", "公司资质", "公司业绩", "公司资产", "人员资质", "人员业绩", "优秀标书")
REUSABLE = ("uploaded", "processing", "processed", "retry_queued")


def upsert(base: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """new rows replace base rows of their keys."""
    return base.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def insert_absent(base: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """new rows whose keys base does not hold (to be appended)."""
    return new.join(base.select(*keys).distinct(), list(keys), "left_anti")


def latest(rows: DataFrame, *keys: str, order: list[Column]) -> DataFrame:
    """The newest row of each key. order: newest first."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def without_version(rows: DataFrame, version: str) -> DataFrame:
    """Delete by version; a rebuild inserts afterwards."""
    return rows.where(F.coalesce(F.col("version_id") != version, F.lit(True)))


def delete_version(documents: DataFrame, versions: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """Without a version, and without documents that then have none."""
    touched = versions.where(F.col("id") == version).select(F.col("doc_id").alias("id")).distinct()
    left = versions.where(F.col("id") != version)
    orphans = touched.join(left.select(F.col("doc_id").alias("id")), "id", "left_anti")
    return documents.join(orphans, "id", "left_anti"), left


def list_versions(versions: DataFrame, documents: DataFrame, statuses: list[str] | None = None, doc_type: str | None = None, limit: int = 100) -> DataFrame:
    """Newest first, with their documents' names and types where known."""
    joined = versions.join(documents.select(F.col("id").alias("doc_id"), F.col("name").alias("doc_name"), "doc_type"), "doc_id", "left")
    if statuses:
        joined = joined.where(F.col("status").isin(*statuses))
    if doc_type:
        joined = joined.where(F.col("doc_type") == doc_type)
    return joined.orderBy(F.desc("created_at"), "id").limit(limit)


def content_duplicates(new: DataFrame, versions: DataFrame) -> DataFrame:
    """Uploads whose content is registered in a usable state, with the first such version."""
    usable = versions.where(F.col("status").isin(*REUSABLE) & F.col("content_hash").isNotNull()).groupBy("content_hash").agg(F.min(F.struct("created_at", "id")).alias("_v"))
    hashed = new.withColumn("content_hash", F.sha2("content", 256))
    return hashed.join(usable, "content_hash", "left").withColumn("existing_version_id", F.col("_v.id")).drop("_v")


def category(c: Column) -> Column:
    return F.when(c.isin(*CATEGORIES), c).otherwise(CATEGORIES[0])


def reject_code(name: Column, mime: Column, content: Column, most_bytes: int = 50 << 20) -> Column:
    """Why an upload is refused, else null: extension, type, size, executables, scripts, PDF frame."""
    head = F.hex(F.substring(content, 1, 1024))
    decoded = F.lower(F.substring(content, 1, 1024).cast("string"))
    executable = F.startswith(head, F.lit("4D5A")) | F.startswith(head, F.lit("7F454C46")) | F.substring(head, 1, 8).isin("FEEDFACE", "FEEDFACF", "CEFAEDFE", "CFFAEDFE", "CAFEBABE")
    script = F.startswith(head, F.lit("2321")) | text.contains_any(decoded, ("<script", "powershell", "cmd.exe"))
    tail = F.hex(F.substring(content, F.greatest(F.octet_length(content) - 4095, F.lit(1)), F.lit(4096)))
    return (
        F.when(~F.lower(name).endswith(".pdf"), "extension")
        .when(~F.coalesce(F.lower(mime), F.lit("")).isin("application/pdf", "application/octet-stream", ""), "mime")
        .when((F.octet_length(content) == 0) | (F.octet_length(content) > most_bytes), "size")
        .when(executable, "executable")
        .when(script, "script")
        .when(~F.contains(head, F.lit("255044462D")), "no_header")
        .when(~F.contains(tail, F.lit("2525454F46")), "no_trailer")
    )


def storage_keys(*columns: str) -> Column:
    """Distinct non-empty keys in order."""
    return F.array_distinct(F.filter(F.array(*columns), lambda k: F.coalesce(text.strip(k), F.lit("")) != ""))


def assets_with_count(versions: DataFrame, assets: DataFrame) -> DataFrame:
    n = assets.groupBy("version_id").agg(F.count("*").alias("asset_count"))
    return versions.join(n, versions["id"] == n["version_id"], "left").drop("version_id").na.fill(0, ["asset_count"])
