"""Pages to clean blocks and tables.

Pages: (doc_id, version_id, page_no, blocks array<struct<type,text>>, tables array<struct<raw_text,...>>), a row a page.
Everything is a projection, a window or a count per document; only the merge of tables across pages reads in order, run by
run, since a table is compared with the merged table before it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citelake.functions import fixed, text

DOC = ["doc_id", "version_id"]
EDGE = 2


def blocks(pages: DataFrame) -> DataFrame:
    """Clean blocks, without contents lines and residue; order_in_page keeps the place before filtering."""
    # cleaned inside the array, so that the filters below read a finished column instead of repeating the cleaning
    clean = F.transform("blocks", lambda b: F.struct(F.coalesce(b["type"], F.lit("paragraph")).alias("block_type"), text.clean_block(b["text"]).alias("text")))
    each = pages.select(*DOC, "page_no", F.posexplode(clean).alias("pos", "b")).select(*DOC, "page_no", (F.col("pos") + 1).alias("order_in_page"), "b.block_type", "b.text")
    return _fit(each)


def blocks_of_texts(docs: DataFrame, lines_per_page: int = 120, body: str = "text") -> DataFrame:
    """The blocks() of text_to_pages() of plain texts (doc_id, version_id, text), whose ids are distinct: a line's number tells its
    page and place, so lines need not move to meet their page."""
    kind = lambda x, i: F.when((i == 0) & (F.length(x) <= 70), "title").otherwise("paragraph")
    clean = F.transform(text.lines(F.col(body)), lambda x, i: F.struct(kind(x, i).alias("block_type"), text.clean_block(x).alias("text")))
    each = docs.select(*DOC, F.posexplode(clean).alias("pos", "b"))
    return _fit(each.select(*DOC, (F.floor(F.col("pos") / lines_per_page) + 1).cast("int").alias("page_no"), (F.col("pos") % lines_per_page + 1).alias("order_in_page"), "b.block_type", "b.text"))


def _fit(each: DataFrame) -> DataFrame:
    kept = each.where(~text.is_toc_like(F.col("text"), True) & ~text.is_low_quality(F.col("text"), True))
    return kept.select(*DOC, F.concat(F.lit("b_"), "page_no", F.lit("_"), "order_in_page").alias("block_id"), "page_no", "block_type", "text", "order_in_page")


def without_repeated_edges(rows: DataFrame, share: float = 0.35, least: int = 3) -> DataFrame:
    """Headers and footers out: lines whose signature stands at the edge of many pages of the document.

    The first and last two blocks of a page are counted (twice where a short page makes them overlap); a signature of 6 to
    80 characters counted max(least, share of pages) times is dropped wherever it stands at an edge. The blocks meet their
    document once, by its id alone (a version that is the same in all rows would be no key), and all is counted where they lie."""
    page = Window.partitionBy(*DOC, "page_no")
    order = page.orderBy("order_in_page")
    rows = rows.repartition("doc_id").withColumns({"_up": F.row_number().over(order), "_n": F.count("*").over(page)})
    top, bottom = F.col("_up") <= EDGE, F.col("_up") > F.col("_n") - EDGE
    at_edge = (F.col("order_in_page") <= EDGE) | (F.col("order_in_page") >= F.greatest(F.lit(1), F.col("_n") - 1))
    rows = rows.withColumns({"_pages": F.sum((F.col("_up") == 1).cast("int")).over(Window.partitionBy(*DOC)), "_edge": top.cast("int") + bottom.cast("int"), "_at_edge": at_edge})
    asked = (F.col("_pages") >= 3) & ((F.col("_edge") > 0) | F.col("_at_edge"))  # all others are neither counted nor dropped
    rows = rows.withColumn("_sig", F.when(asked, text.repeat_signature(F.col("text"), True)))
    rows = rows.withColumn("_sig", F.when(F.length("_sig").between(6, 80), F.col("_sig")))
    rows = rows.withColumn("_votes", F.sum("_edge").over(Window.partitionBy(*DOC, "_sig")))
    repeated = F.col("_sig").isNotNull() & (F.col("_votes") >= F.greatest(F.lit(least), F.floor(F.col("_pages") * share)))
    return rows.where(~(repeated & F.col("_at_edge"))).drop("_sig", "_up", "_n", "_pages", "_edge", "_at_edge", "_votes")


def tables(pages: DataFrame) -> DataFrame:
    raw = F.transform("tables", lambda t: text.clean_table(t["raw_text"]))
    each = pages.select(*DOC, "page_no", F.posexplode(raw).alias("pos", "raw_text")).select(*DOC, "page_no", (F.col("pos") + 1).alias("order_in_page"), "raw_text")
    clean = each.where(~text.is_low_quality(F.col("raw_text"), True))
    return clean.withColumn("table_id", F.format_string("t_%d_%d", "page_no", "order_in_page"))


def bare_first_line(line: str) -> str:
    return re.sub(fixed.CONTINUATION, "", line.strip()).strip()


def header_signature(rows: list[str]) -> str:
    """The header's word characters and bars; the second line where the first was only a continuation mark."""
    head = bare_first_line(rows[0]) or (rows[1] if len(rows) > 1 else "")
    return re.sub(r"[^\w|]+", "", re.sub("[｜|]", "|", head.lower()))


def header_similarity(a: str, b: str) -> float:
    return SequenceMatcher(a=a, b=b).ratio() if a and b else 0.0


def continues(above: list[str], rows: list[str], least: float) -> tuple[bool, bool]:
    """(whether a table goes on with these rows, whether its header is repeated word for word)."""
    one, two = bare_first_line(above[0]).lower(), bare_first_line(rows[0]).lower()
    same = bool(one) and one == two
    marked = any(w in "\n".join(rows).lower() for w in fixed.CONTINUATION_WORDS)
    return marked or same or header_similarity(header_signature(above), header_signature(rows)) >= least, same


MERGED = "doc_id string, version_id string, table_id string, page_no int, page_start int, page_end int, order_in_page int, raw_text string"


def table_runs(rows: DataFrame) -> DataFrame:
    """Tables with text, and the run each is in: tables each on the page after the one before. A table never goes on from one
    run to the next, whatever its header."""
    order = Window.partitionBy(*DOC).orderBy("page_no", "order_in_page")
    there = rows.where((F.col("page_no") > 0) & (text.strip(F.col("raw_text")) != ""))
    after = F.coalesce(F.col("page_no") == F.lag("page_no").over(order) + 1, F.lit(False))
    marked = there.withColumn("_new", F.when(after, 0).otherwise(1))
    return marked.withColumn("run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


class _Merged:
    """A table that later ones may go on from."""

    def __init__(self, r, lines: list[str]):
        self.run, self.lines, self.page_end = (r.doc_id, r.version_id, r.run), lines, r.page_no
        self.fixed = (r.doc_id, r.version_id, r.table_id, r.page_no, r.page_no)
        self.order_in_page = r.order_in_page

    def takes(self, r, lines: list[str], least: float) -> bool:
        """Adds the lines of the next table if it goes on with this one, its repeated header and last line left out."""
        goes_on, same = continues(self.lines, lines, least) if r.page_no == self.page_end + 1 else (False, False)
        if goes_on:
            rest = [bare_first_line(lines[0]), *lines[1:]]
            rest = rest[1:] if same and len(rest) > 1 else rest
            self.lines += rest[1:] if rest and rest[0] == self.lines[-1] else rest
            self.page_end = r.page_no
        return goes_on

    def row(self) -> tuple:
        return (*self.fixed, self.page_end, self.order_in_page, "\n".join(self.lines).strip())


def merged_across_pages(rows: DataFrame, least_similarity: float = 0.78) -> DataFrame:
    """Tables that go on over the next page become one. Runs are found by lag and a running sum and dealt out by themselves, so
    a document's runs are many tasks'. Inside a run a table is compared with the first header of the merged table before it,
    so a run is read in order, one merged table in memory at a time."""
    names = [f.split()[0] for f in MERGED.split(", ")]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: _Merged | None = None
        for batch in batches:
            done = []
            for r in batch.itertuples():
                lines = [x.strip() for x in (r.raw_text or "").splitlines() if x.strip()]
                if not lines:
                    continue
                if open_ and open_.run == (r.doc_id, r.version_id, r.run) and open_.takes(r, lines, least_similarity):
                    continue
                done += [open_.row()] if open_ else []
                open_ = _Merged(r, lines)
            yield pd.DataFrame(done, columns=names)
        if open_:
            yield pd.DataFrame([open_.row()], columns=names)

    dealt = table_runs(rows).repartition(*DOC, "run").sortWithinPartitions(*DOC, "run", "page_no", "order_in_page")
    return dealt.select(*DOC, "run", "table_id", "page_no", "order_in_page", "raw_text").mapInPandas(fold, MERGED)


def normalize(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks, tables) of parsed pages."""
    return without_repeated_edges(blocks(pages)), merged_across_pages(tables(pages))


def denoised_lines(pages: DataFrame, reject: list[str], share: float = 0.2, longest: int = 50, keys: tuple[str, ...] = ("doc_id", "version_id")) -> DataFrame:
    """Lines (keys, page_no, line_no, line) that match no pattern and are not repeated: a line of at most `longest`
    characters found max(1, share of pages) times in a document goes. Below 1 / share pages that is every short line."""
    each = pages.select(*keys, "page_no", F.posexplode(text.lines(F.col("text"))).alias("line_no", "line"))
    for pattern in reject:
        each = each.where(~F.col("line").rlike(f"(?i){pattern}"))
    total = pages.groupBy(*keys).agg(F.count("*").alias("_pages"))
    common = each.where(F.length("line") <= longest).groupBy(*keys, "line").agg(F.count("*").alias("_n")).join(total, list(keys)).where(F.col("_n") >= F.greatest(F.lit(1), F.floor(F.col("_pages") * share)))
    return each.join(common, [*keys, "line"], "left_anti").select(*keys, "page_no", "line_no", "line")


def denoised_blocks(pages: DataFrame, reject: list[str], share: float = 0.2, longest: int = 50, keys: tuple[str, ...] = ("doc_id", "version_id")) -> DataFrame:
    """Pages (keys, page_no, blocks, ...; a row a page) whose blocks' texts are lines that denoised_lines() keeps; blocks without
    text stay, blocks of several lines go."""
    said = F.filter(F.transform("blocks", lambda b: text.strip(b["text"])), lambda t: t != "")
    lines = denoised_lines(pages.select(*keys, "page_no", F.array_join(said, "\n").alias("text")), reject, share, longest, keys)
    kept = lines.groupBy(*keys, "page_no").agg(F.collect_set(text.strip(F.col("line"))).alias("_kept"))
    joined = pages.join(kept, [*keys, "page_no"], "left")
    fine = F.filter("blocks", lambda b: (text.strip(b["text"]) == "") | F.coalesce(F.array_contains("_kept", text.strip(b["text"])), F.lit(False)))
    return joined.withColumn("blocks", fine).drop("_kept")


def in_bands(page_height: Column, top: Column, bottom: Column, header: float = 0.08, footer: float = 0.08) -> Column:
    """Whether a box lies inside the header or footer band; unknown boxes do not."""
    return F.coalesce((bottom <= page_height * header) | (top >= page_height * (1 - footer)), F.lit(False))


def overlaps_any(box: Column, regions: Column) -> Column:
    """Whether a box (x0, y0, x1, y1) and any region strictly intersect."""
    return F.exists(regions, lambda r: (box["x0"] < r["x1"]) & (r["x0"] < box["x1"]) & (box["y0"] < r["y1"]) & (r["y0"] < box["y1"]))
