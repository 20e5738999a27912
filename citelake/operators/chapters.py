"""Blocks to chapters: split at titles, then short chapters run together."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citelake.functions import fixed
from citelake.functions.text import strip

DOC = ["doc_id", "version_id"]


def is_title(c: Column) -> Column:
    t = strip(c)
    shape = reduce(Column.__or__, [t.rlike(p) for p in fixed.TITLE_PATTERNS])
    clause = t.rlike(r"^\d+\.\d+\.\d+") & (F.length(t) > 20)
    sentence = (F.length(t) > 60) & (F.contains(t, F.lit("。")) | F.contains(t, F.lit("；")))
    return (F.length(t) <= 90) & shape & ~clause & ~sentence


SCHEMA = "doc_id string, version_id string, chapter_id string, parent_id string, title string, level int, start_page int, end_page int, block_ids array<string>, blocks array<struct<block_id:string,page_no:int,text:string>>, status string"


class _Open:
    """The chapter that is being gathered, by its document, number, parts and characters."""

    def __init__(self, doc: tuple | None = None, number: int = 0):
        self.doc, self.number, self.parts, self.chars = doc, number, 0, 0

    def takes(self, doc: tuple, chars: int, titled: bool, least: int) -> bool:
        """Adds the next part (or what goes on of the last one) unless it opens a chapter of its own."""
        opens = doc != self.doc or (titled and self.chars >= least)
        if opens:
            return False
        self.parts += titled or not self.parts
        self.chars += chars + (self.chars > 0)
        return True


def _changes(c: pa.Array) -> np.ndarray:
    """Whether a value is another than the one before; the first is."""
    now, before = c.slice(1), c.slice(0, len(c) - 1)
    other = pc.or_(pc.fill_null(pc.not_equal(now, before), False), pc.xor(pc.is_null(now), pc.is_null(before)))
    return np.concatenate([[True], other.to_numpy(zero_copy_only=False)])


def _parts(rows: pa.RecordBatch) -> list[tuple[int, tuple, bool, int]]:
    """(first row, document, whether it opens with a title, characters) of stretches that titles and documents part."""
    titled = rows["_title"].to_numpy(zero_copy_only=False)
    first = np.flatnonzero(_changes(rows[DOC[0]]) | _changes(rows[DOC[1]]) | titled)
    chars = np.add.reduceat(rows["_chars"].to_numpy().astype(np.int64) + 1, first) - 1
    docs = zip(*[rows[c].take(pa.array(first)).to_pylist() for c in DOC], strict=True)
    return list(zip(first.tolist(), docs, titled[first].tolist(), chars.tolist(), strict=True))


def _rows(rows: pa.Table, firsts: list[int], open_: list[_Open]) -> pa.RecordBatch:
    """Chapters of rows that lie together. Texts stay where they are: a chapter is a stretch of them."""
    at, last = pa.array(firsts, pa.int32()), pa.array([*firsts[1:], len(rows)], pa.int32())
    ends = pa.array([*firsts, len(rows)], pa.int32())
    page, block, said = (rows[c].combine_chunks() for c in ("page_no", "block_id", "text"))
    head = [rows[c].take(at).to_pylist() for c in ("page_no", "_title", "text")]
    title = [first if titled else f"临时章节_{no}" for no, titled, first in zip(*head, strict=True)]
    status = ["normal" if titled and o.parts == 1 else "degenerate" for titled, o in zip(head[1], open_, strict=True)]
    blocks = pa.StructArray.from_arrays([block, page, said], ["block_id", "page_no", "text"])
    made = [
        pa.array([o.doc[0] for o in open_], pa.string()), pa.array([o.doc[1] for o in open_], pa.string()), pa.array([f"ch_{o.number}" for o in open_]), pa.nulls(len(open_), pa.string()), pa.array(title, pa.string()), pa.array([1] * len(open_), pa.int32()),
        page.take(at), page.take(pc.subtract(last, 1)), pa.ListArray.from_arrays(ends, block), pa.ListArray.from_arrays(ends, blocks), pa.array(status),
    ]
    return pa.RecordBatch.from_arrays(made, [f.split()[0] for f in SCHEMA.split(", ")])


def chapters(blocks: DataFrame, least_chars: int = 1200) -> DataFrame:
    """(doc_id, version_id, chapter_id, parent_id, title, level, start_page, end_page, block_ids, blocks, status, text) of
    blocks whose texts are stripped and not empty.

    Titles part the blocks; parts run together while what is gathered is shorter than least_chars. What opens next depends on
    all that was gathered, so a document is read in order, one chapter in memory at a time."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, open_ = [], _Open()  # batches of the chapter that is being gathered
        for batch in batches:
            if not batch.num_rows:
                continue
            firsts, done = [0], []
            before = sum(b.num_rows for b in held)
            for first, doc, titled, chars in _parts(batch):
                if open_.takes(doc, chars, titled, least_chars):
                    continue
                if before + first:
                    done.append(open_)
                    firsts.append(before + first)
                open_ = _Open(doc, open_.number + 1 if doc == open_.doc else 1)
                open_.takes(doc, chars, True, least_chars)
            begun = firsts.pop()
            held.append(batch)
            if done:
                rows = pa.Table.from_batches(held)
                yield _rows(rows.slice(0, begun), firsts, done)
                held = rows.slice(begun).to_batches()
        if held:
            rows = pa.Table.from_batches(held)
            yield _rows(rows, [0], [open_])

    numbered = blocks.withColumns({"_title": is_title(F.col("text")), "_chars": F.length("text")})
    read = numbered.repartition("doc_id").sortWithinPartitions(*DOC, "page_no", "order_in_page").select(*DOC, F.col("page_no").cast("int"), "block_id", "text", "_title", "_chars")
    return read.mapInArrow(fold, SCHEMA).withColumn("text", joined(F.col("blocks")))


def joined(blocks: Column) -> Column:
    """The text of blocks."""
    return strip(F.array_join(F.transform(blocks, lambda b: b["text"]), "\n"))
