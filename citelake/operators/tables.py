"""Chunks made from tables, chapters, explanations and facts: one row becomes many, all by expressions."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citelake.functions import clauses, fixed, text

DOC = ["doc_id", "version_id"]


def _chunk(tables: DataFrame, prefix: str, suffix: Column, kind: Column, body: Column, repr_: str, row: Column | None = None) -> DataFrame:
    page = F.coalesce("page_start", "page_no")
    own = F.coalesce(F.nullif(F.col("table_id"), F.lit("")), page.cast("string"))
    return tables.select(
        *DOC, F.concat(F.lit(prefix), own, suffix).alias("chunk_id"), F.concat(F.lit("table_p"), page).alias("chapter_id"), page.alias("page_start"),
        F.coalesce("page_end", page).alias("page_end"), body.alias("text"), F.array().cast("array<string>").alias("block_ids"), kind.alias("source_type"), F.lit("table").alias("page_type"),
        F.lit(repr_).alias("table_repr"), F.coalesce(F.nullif(F.col("table_id"), F.lit("")), F.concat(F.lit("t_"), page, F.lit("_1"))).alias("table_id"),
        (row if row is not None else F.lit(None)).cast("int").alias("row_index"),
    )


def _usable(tables: DataFrame) -> DataFrame:
    return tables.where((text.strip(F.col("raw_text")) != "") & (F.coalesce("page_start", "page_no") > 0)).withColumn("_lines", text.lines(F.col("raw_text")))


def row_chunks(tables: DataFrame) -> DataFrame:
    """`header | row` for every row below the header."""
    rows = _usable(tables).where(F.size("_lines") >= 2).withColumn("_head", F.element_at("_lines", 1))
    rows = rows.select("*", F.posexplode(F.slice("_lines", 2, F.size("_lines") - 1)).alias("_i", "_row"))
    page = F.coalesce("page_start", "page_no")
    kind = F.when(F.coalesce("page_end", page) > page, "cross_page_table_row").otherwise("table_row")
    return _chunk(rows, "tbl_", F.concat(F.lit("_"), F.col("_i") + 1), kind, F.concat_ws(" | ", "_head", "_row"), "row", F.col("_i") + 1)


def summary_text(lines: Column, sample: int = 3) -> Column:
    """The header and the first rows."""
    rows = F.slice(lines, 2, sample)
    head = F.concat(F.lit("表头: "), F.element_at(lines, 1))
    return F.when(F.size(rows) > 0, F.concat(head, F.lit("；样例行: "), F.array_join(rows, "；"))).otherwise(head)


def raw_and_summary_chunks(tables: DataFrame) -> DataFrame:
    rows, none = _usable(tables), F.lit("")
    raw = _chunk(rows, "tblraw_", none, F.lit("table_raw"), text.strip(F.col("raw_text")), "raw")
    return raw.unionByName(_chunk(rows, "tblsum_", none, F.lit("table_summary"), summary_text(F.col("_lines")), "summary"))


def raw_to_html(raw: Column) -> Column:
    """Bars and tabs as cells; nothing is escaped."""

    def row(line: Column) -> Column:
        cells = F.filter(F.transform(F.split(line, r"[|｜\t]", -1), text.strip), lambda x: x != "")
        cells = F.when(F.size(cells) > 0, cells).otherwise(F.array(line))
        return F.concat(F.lit("<tr><td>"), F.array_join(cells, "</td><td>"), F.lit("</td></tr>"))

    rows = F.transform(text.lines(raw), row)
    return F.when(F.size(rows) > 0, F.concat(F.lit("<table>"), F.array_join(rows, ""), F.lit("</table>"))).otherwise("")


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def html_rows(s: pd.Series) -> pd.Series:
    """Cells of an HTML table by row; empty cells vanish, so that later ones move up (entities need Python)."""

    def rows(source: str | None) -> list[list[str]]:
        out = []
        for part in re.split(r"(?i)</tr\s*>", source or ""):
            cells = re.findall(r"(?is)<td[^>]*>(.*?)(?:</td\s*>|\Z)", part)
            row = [c for c in (html.unescape(re.sub(r"<[^>]+>", "", x)).strip() for x in cells) if c]
            if row:
                out.append(row)
        return out

    return s.map(rows)


def table_title(title: Column) -> tuple[Column, Column]:
    """(number, title) of `表 1.2 标题`; without a number the whole title."""
    t, pattern = text.strip(title), r"(?i)^(?:表|TABLE)\s*(\d+(?:\.\d+)*)\s*(.+)$"
    number = F.nullif(F.regexp_extract(t, pattern, 1), F.lit(""))
    return number, F.nullif(F.when(number.isNotNull(), text.strip(F.regexp_extract(t, pattern, 2))).otherwise(t), F.lit(""))


def row_facts(rows: Column) -> Column:
    """Each row as a map by header; of equal headers the last wins, short rows give what they have."""
    head = F.element_at(rows, 1)

    def fact(row: Column) -> Column:
        n = F.least(F.size(head), F.size(row))
        pairs = F.zip_with(F.slice(head, 1, n), F.slice(row, 1, n), lambda k, v: F.struct(k.alias("k"), v.alias("v")))
        last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
        return F.map_from_entries(last)

    return F.when(F.size(rows) >= 2, F.transform(F.slice(rows, 2, F.size(rows)), fact)).otherwise(F.array())


def three_pack(tables: DataFrame) -> DataFrame:
    """(doc_id, page_no, table_id, table_title, table_html) -> raw, summary and one JSON fact a row."""
    t = tables.withColumn("_rows", html_rows("table_html"))
    lines = F.transform(F.slice("_rows", 2, 5), lambda r: F.array_join(r, " | "))
    head = F.when(F.size("_rows") > 0, F.concat(F.array(F.concat(F.lit("列："), F.array_join(F.element_at("_rows", 1), " / "))), lines)).otherwise(F.array().cast("array<string>"))
    summary = text.strip(F.array_join(F.concat(F.array(text.strip(F.col("table_title"))), head), "\n"))
    key = F.concat_ws("::", "table_id", F.col("page_no").cast("string"))
    packs = F.concat(
        F.array(F.struct(F.concat_ws("::", "doc_id", F.lit("table_raw"), key).alias("chunk_id"), F.lit("raw").alias("table_repr"), F.col("table_html").alias("text"))),
        F.array(F.struct(F.concat_ws("::", "doc_id", F.lit("table_summary"), key).alias("chunk_id"), F.lit("summary").alias("table_repr"), summary.alias("text"))),
        F.transform(F.filter(row_facts(F.col("_rows")), lambda m: F.size(m) > 0), lambda m, i: F.struct(F.concat_ws("::", "doc_id", F.lit("table_row"), key, i.cast("string")).alias("chunk_id"), F.lit("row").alias("table_repr"), F.to_json(m).alias("text"))),
    )
    return t.select("doc_id", "page_no", "table_id", table_title(F.col("table_title"))[0].alias("table_no"), "table_title", F.explode(packs).alias("p")).select("doc_id", "page_no", "table_id", "table_no", "table_title", "p.*")


def section_summaries(chapters: DataFrame, most: int = 420) -> DataFrame:
    """Title and first four lines of each chapter."""
    lead, title = F.array_join(F.slice(text.lines(F.col("text")), 1, 4), "；"), text.strip(F.col("title"))

    def said(lead: Column) -> Column:
        body = F.when(F.length(lead) > most, F.regexp_replace(F.substring(lead, 1, most), "[；。]+$", "")).otherwise(lead)
        parts = F.array(F.when(title != "", F.concat(F.lit("章节："), title)), F.when(body != "", F.concat(F.lit("摘要："), body)))
        return F.array_join(F.filter(parts, lambda x: x.isNotNull()), "\n")

    each = F.explode(F.filter(F.transform(F.array(lead), said), lambda x: x != ""))  # a row or none: so the text is split once, and not for each that reads it
    return chapters.where("chapter_id <> ''").select(*DOC, F.concat("chapter_id", F.lit("_summary")).alias("chunk_id"), "chapter_id", F.col("start_page").alias("page_start"), F.col("end_page").alias("page_end"), each.alias("text"), "block_ids", F.lit("section_summary").alias("source_type"), F.lit("section_summary").alias("page_type"))


def with_explanations(chunks: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Text chunks, and after each that explains a clause its explanation chunk, with nulls for what that has no value for.
    Both come of one reading, so that what makes the chunks runs once."""
    t = text.strip(F.col("text"))
    clause = F.coalesce(F.nullif(text.strip(F.col("clause_id")), F.lit("")), clauses.first_clause(t))
    kinds = {c: k for c, k in chunks.dtypes if c != ordinal} | {"source_type": "string", "doc_type": "string"}
    none = {c: F.lit(None).cast(k) for c, k in kinds.items()}
    same = {c: F.col(c) for c in kinds if c in chunks.columns}
    own = none | same | {"source_type": F.lit("text")}
    more = none | {c: same[c] for c in (*DOC, "chapter_id", "page_start", "page_end", "block_ids")}
    more |= {"chunk_id": F.concat_ws("_", F.lit("exp"), "chapter_id", F.col(ordinal).cast("string")), "text": t, "source_type": F.lit("explanation"), "doc_type": F.lit("explanation"), "clause_id": clause}
    explains = text.contains_any(t, ("条文说明", "说明:", "说明：")) & clause.isNotNull()
    row = lambda of: F.struct(*[v.alias(c) for c, v in of.items()])
    return chunks.select(F.explode(F.array_compact(F.array(row(own), F.when(explains, row(more))))).alias("_c")).select("_c.*")


def explanation_chunks(chunks: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Text chunks that explain a clause."""
    found = with_explanations(chunks, ordinal).where("source_type = 'explanation'")
    return found.select(*DOC, "chunk_id", "chapter_id", "page_start", "page_end", "text", "block_ids", "source_type", "doc_type", "clause_id")


def explanations(pages: DataFrame, start: list[str], clause_pattern: str) -> DataFrame:
    """(doc_id, page_no, text) -> one row per explained clause: a clause line after the start heading opens it, the lines
    up to the next are its body. Groups of clause_pattern: 1 the id, 2 an optional sub-id, 3 the rest of the line.
    page_end is the page on which the next clause opens; the last keeps its own page."""
    each = pages.select("doc_id", "page_no", F.posexplode(text.lines(F.col("text"))).alias("line_no", "line"))
    reading = Window.partitionBy("doc_id").orderBy("page_no", "line_no")
    before = reading.rowsBetween(Window.unboundedPreceding, -1)
    heading = F.lit(False)
    for p in start:
        heading = heading | F.col("line").rlike(f"(?i){p}")
    inside = each.withColumn("_on", F.coalesce(F.max(heading).over(before), F.lit(False))).where("_on")
    opens = F.col("line").rlike(f"^(?:{clause_pattern})")
    marked = inside.withColumn("_opens", opens).withColumn("_node", F.sum(F.col("_opens").cast("int")).over(reading.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("_node > 0")
    base, sub, rest = (text.strip(F.regexp_extract("line", f"^(?:{clause_pattern})", i)) for i in (1, 2, 3))
    titled = (rest != "") & (F.length(rest) <= 60) & ~rest.rlike("[。.；;：:]$")
    line = F.when(~F.col("_opens"), F.col("line")).when((rest != "") & ~titled, rest)
    nodes = marked.groupBy("doc_id", "_node").agg(
        F.max(F.when(F.col("_opens"), F.struct(base.alias("base"), sub.alias("sub"), F.when(titled, rest).alias("title"), F.col("page_no").alias("page")))).alias("n"),
        F.array_sort(F.collect_list(F.when(line.isNotNull(), F.struct("page_no", "line_no", line.alias("t"))))).alias("b"),
    )
    following = F.lead("n.page").over(Window.partitionBy("doc_id").orderBy("_node"))
    return nodes.select("doc_id", F.concat("n.base", F.when(F.col("n.sub") != "", F.concat(F.lit("("), "n.sub", F.lit(")"))).otherwise("")).alias("clause_id"), F.col("n.base").alias("clause_id_base"), F.nullif("n.sub", F.lit("")).alias("clause_sub"), F.col("n.title").alias("title"), F.array_join(F.transform("b", lambda x: x["t"]), "\n").alias("body"), F.col("n.page").alias("page_start"), F.coalesce(following, "n.page").alias("page_end"))


def split_row(line: Column) -> Column:
    """Cells by bar, else by tab, else by white space."""
    cells = F.when(F.contains(line, F.lit("|")), F.split(line, r"\|", -1)).when(F.contains(line, F.lit("\t")), F.split(line, "\t", -1)).otherwise(F.split(line, r"(?U)\s+", -1))
    return F.filter(F.transform(cells, text.strip), lambda x: x != "")


def rows_of_text(c: Column) -> Column:
    """A recognised table's text as struct(header, rows); both empty for fewer than two lines."""
    seen, none = text.lines(c), F.array().cast("array<string>")
    rows = F.filter(F.transform(F.slice(seen, 2, F.greatest(F.size(seen) - 1, F.lit(0))), split_row), lambda r: F.size(r) > 0)
    table = F.size(seen) >= 2
    return F.struct(F.when(table, split_row(F.element_at(seen, 1))).otherwise(none).alias("header"), F.when(table, rows).otherwise(F.array().cast("array<array<string>>")).alias("rows"))


def recognised_pack(title: Column, rows: Column) -> Column:
    """Rows that a vision model gave (array of JSON texts) as struct(table_summary, row_facts, n): title, mark, first six."""
    summary = F.array_join(F.concat(F.array(title, F.lit("（VL 兜底识别）")), F.slice(rows, 1, 6)), "\n")
    return F.struct(summary.alias("table_summary"), rows.alias("row_facts"), F.size(rows).alias("n"))


#: Where explanations begin, and a clause's line.
EXPLANATION_STARTS = (r"^\s*条\s*文\s*说\s*明\s*$", r"^\s*条文说明\s*$")
EXPLAINED_CLAUSE = r"\s*(\d+(?:\.\d+)+)(?:\(([0-9A-Za-z]+)\))?\s*(.*)$"


def configured_explanation_chunks(blocks: DataFrame, start: tuple[str, ...] = EXPLANATION_STARTS, clause_pattern: str = EXPLAINED_CLAUSE) -> DataFrame:
    """Blocks (doc_id, version_id, page_no, order_in_page, text) -> one chunk per explained clause, as explanations() finds
    them by configured patterns."""
    key = F.to_json(F.struct(*DOC))
    lines = blocks.where((F.col("page_no") > 0) & (text.strip(F.col("text")) != "")).groupBy(key.alias("doc_id"), "page_no").agg(F.array_sort(F.collect_list(F.struct("order_in_page", text.strip(F.col("text")).alias("t")))).alias("b"))
    pages = lines.select("doc_id", "page_no", F.array_join(F.transform("b", lambda x: x["t"]), "\n").alias("text"))
    said = explanations(pages, list(start), clause_pattern).withColumn("text", text.strip(F.concat_ws("\n", F.nullif(text.strip(F.col("title")), F.lit("")), F.nullif(text.strip(F.col("body")), F.lit("")))))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_start", "clause_id"))
    doc = F.from_json("doc_id", "doc_id string, version_id string")
    return said.withColumn("n", nth).where("text <> ''").select(
        doc["doc_id"].alias("doc_id"), doc["version_id"].alias("version_id"), F.concat_ws("_", F.lit("expcfg"), "clause_id", F.col("n").cast("string")).alias("chunk_id"), F.lit("explanation").alias("chapter_id"),
        "page_start", "page_end", "text", F.array().cast("array<string>").alias("block_ids"), F.lit("explanation").alias("source_type"), F.lit("explanation").alias("doc_type"), "clause_id",
    )


def table_struct(tables: DataFrame, repairs: DataFrame | None = None, least_confidence: float = 0.45) -> DataFrame:
    """Tables as header and rows by kind (power_param_table, device_inventory_table, qualification_table; a table may be
    of several). Broken tables take the repair's rows where it is confident (repairs: table_id, recognized_text,
    confidence, a row a table), else their text's first 160 characters as one cell."""
    lines = text.lines(F.col("raw_text"))
    t = tables.withColumns({"_head": F.when(F.size(lines) > 0, split_row(F.element_at(lines, 1))).otherwise(F.array().cast("array<string>")), "_rows": F.filter(F.transform(F.slice(lines, 2, F.size(lines) + 1), split_row), lambda r: F.size(r) > 0)})
    if repairs is None:
        t = t.withColumns({"recognized_text": F.lit(None).cast("string"), "confidence": F.lit(0.0)})
    else:
        t = t.join(repairs.select("table_id", "recognized_text", "confidence"), "table_id", "left")
    sizes = F.transform("_rows", lambda r: F.size(r))
    joined = F.array_join(F.transform("_rows", lambda r: F.array_join(r, " | ")), "\n")
    broken = (text.strip(F.col("raw_text")) != "") & ((F.size("_rows") == 0) | (F.array_max(sizes) <= 1) | ((F.size("_head") >= 2) & (F.array_min(sizes) == 1) & (F.array_max(sizes) >= 3)) | (text.readable_ratio(joined, fixed.READABLE_MARKS + "|") < 0.55))
    seen = text.lines(F.col("recognized_text"))
    repaired = F.filter(F.transform(F.slice(seen, 2, F.size(seen) + 1), split_row), lambda r: F.size(r) > 0)
    usable = (F.size(repaired) > 0) & (F.coalesce("confidence", F.lit(0.0)) >= least_confidence)
    t = t.withColumns({"_broken": F.coalesce(broken, F.lit(False)), "_usable": F.coalesce(usable, F.lit(False)), "_new": repaired, "_new_head": F.when(F.size(seen) > 0, split_row(F.element_at(seen, 1)))})
    kinds = F.filter(F.array(
        F.when(text.contains_any(F.col("raw_text"), ("业绩", "电压", "kV", "金额", "线路")), "power_param_table"),
        F.when(text.contains_any(F.col("raw_text"), ("设备", "型号", "数量", "主变", "断路器")), "device_inventory_table"),
        F.when(text.contains_any(F.col("raw_text"), ("资格", "证书", "执业", "人员", "建造师")), "qualification_table"),
    ), lambda x: x.isNotNull())
    strategy = F.when(~F.col("_broken"), "none").when(F.col("_usable"), "vl_fallback").otherwise("stub")
    rows = F.when(~F.col("_broken"), F.col("_rows")).when(F.col("_usable"), F.col("_new")).otherwise(F.array(F.array(F.substring("raw_text", 1, 160))))
    header = F.when(F.col("_broken") & F.col("_usable") & (F.size("_new_head") > 0), F.col("_new_head")).otherwise(F.col("_head"))
    return t.select(F.explode(kinds).alias("kind"), "table_id", "page_no", header.alias("header"), rows.alias("rows"), "raw_text", strategy.alias("repair_strategy"))
