"""Readers and writers of pages, page text files, JSON lines and parsed documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citelake.functions import text

PARSED = "pages array<struct<page_no:int,blocks:array<struct<type:string,text:string>>,tables:array<struct<raw_text:string,image_url:string>>,images:array<struct<url:string,caption:string>>>>"


def text_to_pages(docs: DataFrame, lines_per_page: int = 120, most_lines: int | None = None, body: str = "text") -> DataFrame:
    """Plain texts (doc_id, version_id, text) as pages of stripped lines; a first line of up to 70 characters is a title.
    most_lines cuts a text after so many lines (the reference's default is 4,000)."""
    rows = text.lines(F.col(body))
    rows = rows if most_lines is None else F.slice(rows, 1, most_lines)
    each = docs.select("doc_id", "version_id", F.posexplode(rows).alias("i", "line"))
    kind = F.when((F.col("i") == 0) & (F.length("line") <= 70), "title").otherwise("paragraph")
    paged = each.select("doc_id", "version_id", (F.floor(F.col("i") / lines_per_page) + 1).cast("int").alias("page_no"), F.struct("i", F.struct(kind.alias("type"), F.col("line").alias("text")).alias("b")).alias("x"))
    out = paged.groupBy("doc_id", "version_id", "page_no").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["b"]).alias("blocks"))
    return out.withColumn("tables", F.array().cast("array<struct<raw_text:string,image_url:string>>"))


def read_parsed(spark: SparkSession, path: str) -> DataFrame:
    """Parsed documents as JSON, a file each: {pages}, {data: {pages}} or {pdf_info}; one row a page."""
    inner = PARSED.split(" ", 1)[1]
    docs = spark.read.schema(f"pages {inner}, pdf_info {inner}, data struct<pages:{inner}>").option("multiLine", True).json(path)
    named = docs.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("version_id"), F.posexplode(F.coalesce("pages", "data.pages", "pdf_info")).alias("i", "p"))
    return named.select("version_id", F.coalesce("p.page_no", F.col("i") + 1).alias("page_no"), "p.blocks", "p.tables", "p.images")


def read_page_files(spark: SparkSession, root: str) -> DataFrame:
    """root/<doc_id>/page_NNN.txt; empty, discarded and very short pages are left out."""
    files = spark.read.text(f"{root}/*/page_*.txt", wholetext=True).select("value", F.col("_metadata.file_path").alias("source_path"))
    named = files.select(F.regexp_extract("source_path", r"([^/]+)/page_\d+\.txt$", 1).alias("doc_id"), F.regexp_extract("source_path", r"page_(\d+)\.txt$", 1).cast("int").alias("page_no"), text.strip(F.col("value")).alias("text"), "source_path")
    return named.where((F.length("text") >= 4) & (F.lower("text") != "discarded"))


def read_json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """strict fails on malformed lines, else they are dropped."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def page_rows(pages: DataFrame) -> DataFrame:
    """Pages as rows for search: block texts, then table texts."""
    none = F.array().cast("array<string>")
    said = lambda c, field: F.coalesce(F.transform(c, lambda x: text.strip(text.printable(x[field]))), none)
    parts = F.concat(said("blocks", "text"), said("tables", "raw_text"))
    body = F.array_join(F.filter(parts, lambda x: x != ""), "\n")
    return pages.select("doc_id", "version_id", "page_no", body.alias("text"), F.format_string("%s/page_%03d.txt", "doc_id", "page_no").alias("source_path")).where("text <> ''")


def to_markdown(pages: DataFrame) -> DataFrame:
    """One Markdown text a document: a heading a page, titles as headings, tables after the blocks."""
    blocks = F.transform("blocks", lambda b: F.when(b["type"] == "title", F.concat(F.lit("## "), b["text"])).otherwise(b["text"]))
    body = F.array_join(F.concat(F.array(F.concat(F.lit("# Page "), F.col("page_no"))), blocks, F.transform("tables", lambda t: t["raw_text"])), "\n\n")
    rows = pages.groupBy("doc_id", "version_id").agg(F.array_sort(F.collect_list(F.struct("page_no", body.alias("t")))).alias("p"))
    return rows.select("doc_id", "version_id", F.array_join(F.transform("p", lambda x: x["t"]), "\n\n").alias("markdown"))


def latest_pages(pages: DataFrame) -> DataFrame:
    """One row a (doc_id, page_no): the page of the last ingest wins, whatever its version."""
    nth = F.row_number().over(Window.partitionBy("doc_id", "page_no").orderBy(F.desc("ingest_seq")))
    return pages.withColumn("_n", nth).where("_n = 1").drop("_n")


def write_versions(rows: DataFrame, path: str) -> None:
    """Rebuild: only the versions in rows are replaced (dynamic partition overwrite)."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version_id").parquet(path)
