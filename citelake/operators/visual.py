"""Visual candidates and their recognised text, offline: what a model would read is the hint that is there."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citelake.functions import fixed, text
from citelake.operators.normalize import header_similarity

DOC = ["doc_id", "version_id"]


def candidates(pages: DataFrame, most: int = 120) -> DataFrame:
    """(doc_id, version_id, visual_type, page_no, source, item_no, text_hint, image_url): tables, image blocks and images,
    each once by (type, page, image, first 120 characters), the first `most` of a document."""
    tables = pages.select(*DOC, "page_no", F.posexplode("tables").alias("i", "x")).withColumn("hint", F.substring(text.squeeze(F.col("x.raw_text")), 1, 800)).where("hint <> ''")
    kind = F.when(text.contains_any(F.lower("hint"), fixed.CONTINUATION_WORDS), "cross_page_table").otherwise("table")
    one = tables.select(*DOC, kind.alias("visual_type"), "page_no", F.lit(1).alias("_s"), F.lit("table").alias("source"), (F.col("i") + 1).alias("item_no"), F.col("hint").alias("text_hint"), F.coalesce("x.image_url", F.lit("")).alias("image_url"))
    blocks = pages.select(*DOC, "page_no", F.posexplode("blocks").alias("i", "x")).where(F.lower("x.type").isin("image", "figure", "chart", "diagram"))
    two = blocks.select(*DOC, F.lit("image").alias("visual_type"), "page_no", F.lit(2).alias("_s"), F.lit("block").alias("source"), (F.col("i") + 1).alias("item_no"), F.substring(text.squeeze(F.col("x.text")), 1, 800).alias("text_hint"), F.lit("").alias("image_url"))
    images = pages.select(*DOC, "page_no", F.posexplode("images").alias("i", "x"))
    three = images.select(*DOC, F.lit("image").alias("visual_type"), "page_no", F.lit(3).alias("_s"), F.lit("images").alias("source"), (F.col("i") + 1).alias("item_no"), F.substring(text.squeeze(F.col("x.caption")), 1, 800).alias("text_hint"), F.coalesce("x.url", F.lit("")).alias("image_url"))
    every = one.unionByName(two).unionByName(three)
    same = Window.partitionBy(*DOC, "visual_type", "page_no", "image_url", F.substring("text_hint", 1, 120)).orderBy("_s", "item_no")
    first = every.withColumn("_n", F.row_number().over(same)).where("_n = 1")
    return first.withColumn("_n", F.row_number().over(Window.partitionBy(*DOC).orderBy("page_no", "_s", "item_no"))).where(F.col("_n") <= most).drop("_n", "_s")


def confidence(task: Column, said: Column, fallback: Column) -> Column:
    rows = text.lines(said)
    repaired = F.when((F.size(rows) >= 2) & F.contains(said, F.lit("|")), 0.85).when(F.size(rows) >= 2, 0.6).otherwise(0.35)
    return F.when((F.coalesce(fallback, F.lit("")) != "") | (F.coalesce(said, F.lit("")) == ""), 0.0).when(task == "table_repair", repaired).otherwise(0.75)


def recognise_offline(items: DataFrame) -> DataFrame:
    """Without a model the hint is the text, at no confidence."""
    return items.withColumns({"recognized_text": F.substring(text.squeeze(F.col("text_hint")), 1, 1600), "confidence": F.lit(0.0), "fallback_reason": F.lit("provider_disabled_or_missing_key")})


def merge_into_pages(pages: DataFrame, items: DataFrame) -> DataFrame:
    """Pages with `[VL-type] text` appended: as a block where no block says so yet, and as a table for tables (each time)."""
    said = F.substring(text.squeeze(F.col("recognized_text")), 1, 1800)
    marks = items.where(said != "").withColumn("_m", F.concat(F.lit("[VL-"), F.coalesce("visual_type", F.lit("visual")), F.lit("] "), said))
    by_page = marks.groupBy(*DOC, "page_no").agg(F.array_sort(F.collect_list(F.struct("source", "item_no", "visual_type", "_m"))).alias("_v"))
    joined = pages.join(by_page, [*DOC, "page_no"], "left")
    new = F.array_except(F.transform("_v", lambda v: v["_m"]), F.transform("blocks", lambda b: text.strip(b["text"])))
    table = F.transform(F.filter("_v", lambda v: v["visual_type"].isin("table", "cross_page_table")), lambda v: F.struct(v["_m"].alias("raw_text"), F.lit(None).cast("string").alias("image_url")))
    blocks = F.concat("blocks", F.transform(new, lambda m: F.struct(F.lit("paragraph").alias("type"), m.alias("text"))))
    return joined.withColumns({"blocks": F.when(F.col("_v").isNull(), F.col("blocks")).otherwise(blocks), "tables": F.when(F.col("_v").isNull(), F.col("tables")).otherwise(F.concat("tables", table))}).drop("_v")


def wants_model(table_confidence: Column, stitched: Column, is_image: Column) -> Column:
    return F.coalesce(is_image, F.lit(False)) | F.coalesce(table_confidence < 0.5, F.lit(False)) | ~F.coalesce(stitched, F.lit(True))


def repair_candidates(pages: DataFrame, doc_types: tuple[str, ...], most: int = 20) -> DataFrame:
    """Tables for repair, the first `most` of each document of some types (pages carry doc_type)."""
    each = pages.where(F.col("doc_type").isin(*doc_types)).select(*DOC, "page_no", F.posexplode("tables").alias("i", "x")).where(text.strip(F.col("x.raw_text")) != "")
    nth = F.row_number().over(Window.partitionBy(*DOC).orderBy("page_no", "i"))
    return each.withColumn("_n", nth).where(F.col("_n") <= most).select(*DOC, F.format_string("t_%d_%d", "page_no", F.col("i") + 1).alias("table_id"), "page_no", F.substring(F.col("x.raw_text"), 1, 800).alias("text_hint"), F.coalesce("x.image_url", F.lit("")).alias("image_url"))


@F.pandas_udf(T.StringType())
def html_header(s: pd.Series) -> pd.Series:
    """The first row's text, up to 200 characters (entities need Python)."""

    def head(source: str | None) -> str:
        m = re.search(r"(?is)<tr[^>]*>(.*?)</tr\s*>", source or "")
        return " ".join(html.unescape(re.sub(r"<[^>]+>", " ", m.group(1))).split())[:200] if m else ""

    return s.map(head)


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([header_similarity(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


def stitched(tables: DataFrame, least: float = 0.7, gap: int = 1) -> DataFrame:
    """(doc_id, page_no, table_title, table_html) -> tables that go on over pages as one: neighbours at most `gap` pages
    apart with a similar header or the same title. Runs are found by lag and a running sum."""
    order = Window.partitionBy("doc_id").orderBy("page_no", "table_title")
    t = tables.withColumn("_h", html_header("table_html")).withColumns({"_ph": F.lag("_h").over(order), "_pp": F.lag("page_no").over(order), "_pt": F.lag("table_title").over(order)})
    close = F.coalesce(F.col("page_no") - F.col("_pp") <= gap, F.lit(False))
    same = (F.coalesce(similarity("_h", "_ph"), F.lit(0.0)) >= least) | F.coalesce((F.col("table_title") != "") & (F.col("table_title") == F.col("_pt")), F.lit(False))
    t = t.withColumn("_new", F.when(close & same, 0).otherwise(1)).withColumn("_g", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = t.groupBy("doc_id", "_g").agg(F.array_sort(F.collect_list(F.struct("page_no", "table_title", "table_html", "_h"))).alias("r"))
    first = F.element_at("r", 1)
    return rows.select("doc_id", first["page_no"].alias("page_no"), F.element_at("r", -1)["page_no"].alias("page_end"), first["table_title"].alias("table_title"), F.array_join(F.transform("r", lambda x: x["table_html"]), "\n<!-- continued -->\n").alias("table_html"), first["_h"].alias("header_sig"))
