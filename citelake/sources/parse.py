"""Parsed documents in their many shapes to pages, and recognised text to blocks and tables."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citelake.functions import text
from citelake.operators.quality import needs_ocr

PAGE = "page_no int, blocks array<struct<type:string,text:string>>, tables array<struct<raw_text:string,image_url:string>>, images array<struct<url:string,caption:string>>"
# Names under which layouts keep things.
TEXT_KEYS, TABLE_KEYS, URL_KEYS = ("text", "content", "raw_text"), ("raw_text", "text", "markdown"), ("url", "image_url", "src")
SPAN_TEXTS = ("text", "inline_equation", "interline_equation", "table")
IMAGE_TYPES = ("image", "figure", "chart", "diagram")
TITLE_LIKE = (r"^(第[一二三四五六七八九十百千万0-9]+[章节篇部分卷])", r"^[0-9]+(?:\.[0-9]+){0,3}\s+", r"^[一二三四五六七八九十]+、")


def repaired_lines(body: Column) -> Column:
    """Lines of a text; where most of them are single characters, they are joined and split at sentence ends."""
    rows = text.lines(body)
    tiny = F.size(F.filter(rows, lambda x: F.length(x) <= 2))
    whole = text.lines(F.regexp_replace(F.array_join(rows, ""), "([。！？；;])", "$1\n"))
    return F.when((F.size(rows) >= 16) & (tiny >= F.size(rows) * 0.7) & (F.size(whole) > 0), whole).otherwise(rows)


def is_title_line(c: Column) -> Column:
    t = text.strip(c)
    return (t != "") & (F.length(t) <= 80) & (t.rlike(TITLE_LIKE[0]) | t.rlike(TITLE_LIKE[1]) | t.rlike(TITLE_LIKE[2]))


def ocr_pages(rows: DataFrame, keys: tuple[str, ...] = ("doc_id", "version_id", "page_no")) -> DataFrame:
    """(keys, text) -> (keys, blocks, tables): lines in runs of one kind. Lines with two bars or a tab are table lines, a
    title stands alone, other lines form paragraphs, and a blank line ends what is open. A table is a block as well."""
    line = text.strip(F.col("line"))
    each = rows.select(*keys, F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r\n|[\n\r]", -1)).alias("i", "line")).withColumn("line", line)
    kind = F.when(F.col("line") == "", "blank").when((F.length("line") - F.length(F.replace("line", F.lit("|"), F.lit(""))) >= 2) | F.contains("line", F.lit("\t")), "table").when(is_title_line(F.col("line")), "title").otherwise("text")
    reading = Window.partitionBy(*keys).orderBy("i")
    marked = each.withColumn("kind", kind).withColumn("_new", ((F.col("kind") == "title") | (F.coalesce(F.lag("kind").over(reading) != F.col("kind"), F.lit(True)))).cast("int"))
    numbered = marked.withColumn("_run", F.sum("_new").over(reading.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("kind <> 'blank'")
    runs = numbered.groupBy(*keys, "_run", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]).alias("_l"))
    said = F.when(F.col("kind") == "table", F.array_join("_l", "\n")).otherwise(F.array_join("_l", " "))
    ordered = runs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_run", "kind", said.alias("t")))).alias("_r"))
    blocks = F.transform("_r", lambda x: F.struct(F.when(x["kind"] == "title", "title").otherwise("paragraph").alias("type"), x["t"].alias("text")))
    tables = F.transform(F.filter("_r", lambda x: x["kind"] == "table"), lambda x: F.struct(x["t"].alias("raw_text"), F.lit(None).cast("string").alias("image_url")))
    return ordered.select(*keys, blocks.alias("blocks"), tables.alias("tables"))


def merge_repairs(pages: DataFrame, repaired: DataFrame, most: int = 48, keys: tuple[str, ...] = ("doc_id", "version_id")) -> DataFrame:
    """Pages (keys, page_no, text, ...) with the first `most` bad ones of a document taken from repaired where it has them."""
    bad = pages.where(needs_ocr(F.col("text"))).withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("page_no"))).where(F.col("_n") <= most).select(*keys, "page_no")
    better = repaired.join(bad, [*keys, "page_no"], "left_semi").select(*keys, "page_no", F.col("text").alias("_new"))
    return pages.join(better, [*keys, "page_no"], "left").withColumn("text", F.coalesce("_new", "text")).drop("_new")


def first_of(item: dict, keys: tuple[str, ...]) -> str:
    return next((v for k in keys if (v := str(item.get(k) or "").strip())), "")


def leaves(value: Any) -> str:
    """All text in a value, depth first, by lines."""
    if isinstance(value, str):
        return value
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return "\n".join(x for x in map(leaves, inner) if x)


def html_text(value: str) -> str:
    import re

    return " ".join(re.sub(r"<[^>]+>", " ", value).split())


class Layout:
    """What a page's layout tree holds: blocks, tables and images in reading order."""

    def __init__(self) -> None:
        self.blocks: list[dict] = []
        self.tables: list[dict] = []
        self.images: list[dict] = []

    def line(self, line: Any) -> str:
        parts = []
        for span in (line.get("spans") or []) if isinstance(line, dict) else []:
            if not isinstance(span, dict):
                continue
            kind, said = str(span.get("type") or "").strip().lower(), str(span.get("content") or "").strip()
            if kind == "table" and str(span.get("html") or "").strip():
                said = html_text(span["html"])
            if kind in SPAN_TEXTS and said:
                parts.append(said)
            url = first_of(span, ("image_path", "image_url", "url"))
            if url:
                self.images.append({"url": url, "caption": said})
        return " ".join(parts)

    def text(self, node: Any) -> str:
        lines = node.get("lines") if isinstance(node, dict) else None
        return "\n".join(filter(None, map(self.line, lines))) if isinstance(lines, list) else ""

    def walk(self, node: Any) -> None:
        if not isinstance(node, dict):
            return
        kind = str(node.get("type") or "paragraph").strip().lower()
        children = node.get("blocks") if isinstance(node.get("blocks"), list) else []
        if kind == "table":
            caption = self.text(node)
            parts = [caption] if caption else []
            if caption:
                self.blocks.append({"type": "paragraph", "text": caption})
            for child in children:
                parts += [self.text(child), *(self.line(x) for x in (child.get("lines") or []) if isinstance(child, dict))]
            if any(parts):
                self.tables.append({"raw_text": "\n".join(filter(None, parts))})
            return
        if kind == "list":  # items first, the list's own lines after them
            for child in children:
                self.walk(child)
        said = self.text(node)
        if said:
            self.blocks.append({"type": "title" if kind == "title" else "paragraph", "text": said})
        if kind != "list":
            for child in children:
                self.walk(child)


def page_of(page: Any, number: int) -> dict:
    """One page of any shape; number is used where it names none."""
    if not isinstance(page, dict):
        return {"page_no": number, "blocks": [{"type": "paragraph", "text": leaves(page)}], "tables": [], "images": []}
    out = Layout()
    for node in page.get("para_blocks") or []:
        out.walk(node)
    for item in page.get("blocks") or []:
        if isinstance(item, str):
            out.blocks.append({"type": "paragraph", "text": item.strip()})
        elif isinstance(item, dict):
            kind, said = first_of(item, ("type", "block_type")).lower() or "paragraph", first_of(item, TEXT_KEYS) or leaves(item)
            if kind in ("table", "table_cell"):
                out.tables.append({"raw_text": said})
                continue
            if kind in IMAGE_TYPES:
                out.images.append({"url": first_of(item, URL_KEYS), "caption": said})
            out.blocks.append({"type": kind, "text": said})
    for item in page.get("tables") or []:
        if isinstance(item, str):
            out.tables.append({"raw_text": item.strip()})
        elif isinstance(item, dict):
            out.tables.append({"raw_text": first_of(item, TABLE_KEYS) or leaves(item), "image_url": first_of(item, URL_KEYS)})
    for item in page.get("images") or []:
        if isinstance(item, str):
            out.images.append({"url": item.strip(), "caption": ""})
        elif isinstance(item, dict):
            out.images.append({"url": first_of(item, URL_KEYS), "caption": first_of(item, ("caption", "text"))})
    if not out.blocks:
        said = first_of(page, ("text", "md", "markdown")) or leaves(page)
        out.blocks = [{"type": "paragraph", "text": said}] if said else []
    named = next((int(page[k]) for k in ("page_no", "page", "index") if page.get(k)), None)
    if named is None and page.get("page_idx"):
        named = int(page["page_idx"]) + 1
    return {"page_no": named or number, "blocks": out.blocks, "tables": out.tables, "images": out.images}


def pages_of(parsed: Any) -> list[dict] | None:
    """The pages of a parsed document: {pages}, {data: {pages}}, {pdf_info} or a bare list; else None."""
    found = parsed if isinstance(parsed, list) else None
    if isinstance(parsed, dict):
        data = parsed.get("data")
        found = next((x for x in (parsed.get("pages"), data.get("pages") if isinstance(data, dict) else None, parsed.get("pdf_info")) if isinstance(x, list)), None)
    return [page_of(p, i) for i, p in enumerate(found, start=1)] if found else None


def plain_pages(body: str, per_page: int = 120, most: int | None = None) -> list[dict]:
    rows = [x for x in map(str.strip, body.splitlines()) if x][:most]
    kinds = [{"type": "title" if i == 0 and len(x) <= 70 else "paragraph", "text": x} for i, x in enumerate(rows)]
    return [{"page_no": n + 1, "blocks": kinds[at : at + per_page], "tables": [], "images": []} for n, at in enumerate(range(0, len(kinds), per_page))]


def zip_pages(payload: bytes) -> list[dict]:
    """An archive's first readable JSON (by name), else its first Markdown, else the bytes as text."""
    try:
        with zipfile.ZipFile(io.BytesIO(payload)) as z:
            names = sorted(z.namelist())
            for name in (n for n in names if n.lower().endswith(".json")):
                try:
                    parsed = json.loads(z.read(name).decode("utf-8", "ignore"))
                except ValueError:
                    continue
                if (pages := pages_of(parsed)) or leaves(parsed).strip():
                    return pages or plain_pages(leaves(parsed))
            for name in (n for n in names if n.lower().endswith(".md")):
                return plain_pages(z.read(name).decode("utf-8", "ignore"))
    except zipfile.BadZipFile:
        pass
    return plain_pages(payload.decode("utf-8", "ignore"))


def _rows(df: DataFrame, column: str, parse) -> DataFrame:
    keys = [f for f in df.schema.fields if f.name != column]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keys), PAGE])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                for p in parse(r[column]) or []:
                    tables = [{"raw_text": t.get("raw_text"), "image_url": t.get("image_url")} for t in p["tables"]]
                    out.append({**{f.name: r[f.name] for f in keys}, **p, "tables": tables})
            yield pd.DataFrame(out, columns=[*(f.name for f in keys), "page_no", "blocks", "tables", "images"])

    return df.mapInPandas(run, schema)


def parse_json(df: DataFrame, column: str = "json") -> DataFrame:
    """Documents as JSON texts -> a row a page; texts that are no JSON or hold no pages give none."""

    def parse(value):
        try:
            return pages_of(json.loads(value or ""))
        except ValueError:
            return None

    return _rows(df, column, parse)


def parse_archives(df: DataFrame, column: str = "content") -> DataFrame:
    """Archives (a binaryFile source) -> a row a page."""
    return _rows(df, column, lambda v: zip_pages(bytes(v)) if v is not None else None)


def byte_range(header: str | None, size: int) -> tuple[int, int] | None:
    """First and last byte of a single range (`a-b`, `a-`, `-n`); None for the whole. Raises ValueError where it cannot be
    met."""
    if not header:
        return None
    unit, _, spec = header.strip().partition("=")
    first, dash, last = spec.strip().partition("-")
    if unit.strip().lower() != "bytes" or not dash or "," in spec or size <= 0:
        raise ValueError("range not satisfiable")
    if not first.strip():
        start, stop = max(0, size - int(last)), size - 1
        if int(last) <= 0:
            raise ValueError("range not satisfiable")
    else:
        start, stop = int(first), min(size - 1, int(last)) if last.strip() else size - 1
    if start > stop or start >= size:
        raise ValueError("range not satisfiable")
    return start, stop
