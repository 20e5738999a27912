"""Chapters to clause-aware chunks: a fold over each chapter's lines (order decides, so it runs in Python, chapter by chapter).

A chapter is read line by line. A `Cursor` knows the clause and sub-clause in force; lines that open a node start a new
segment, other lines go on with the open one. Segments are then packed into chunks of one node each.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame

from citelake.functions import fixed

_CLAUSE = re.compile(fixed.CLAUSE)
_TOP = re.compile(fixed.TOP_CLAUSE_START)
_SUB = re.compile(fixed.SUB_CLAUSE_START)
_ITEM = re.compile(fixed.ITEM_START)
_BARE_ITEM = re.compile(fixed.ITEM_SPACE_START)
_TAIL = re.compile(r"\([0-9A-Za-z]+\)$")
_ITEM_NODE = re.compile(r"^(.+\([0-9A-Za-z]+\))\.\d+$")
_ENDS = re.compile(r"(?<=[。！？；;!?\n])")
_DOTTED = re.compile(r"\d\.\d")  # no clause is without it, and it is found faster


def find_clause(text: str) -> str | None:
    m = _DOTTED.search(text) and _CLAUSE.search(text)
    return m.group(1) if m else None


def base_of(node: str) -> str:
    return _TAIL.sub("", node.strip())


def parent_of(node: str | None) -> str:
    node = (node or "").strip()
    item = _ITEM_NODE.match(node)
    if item:
        return item.group(1)
    if _TAIL.search(node):
        return base_of(node)
    return ".".join([p for p in node.split(".") if p][:-1])


def level_of(node: str | None) -> int:
    node = (node or "").strip()
    item = _ITEM_NODE.match(node)
    if item:
        return level_of(item.group(1)) + 1
    return len([p for p in base_of(node).split(".") if p]) + bool(_TAIL.search(node))


@dataclass
class Node:
    """Where a text stands: the clause it counts for and the exact node."""

    clause: str | None = None
    node: str | None = None

    @property
    def parent(self) -> str:
        return parent_of(self.node)

    @property
    def level(self) -> int:
        return level_of(self.node)


def _may_open(line: str) -> bool:
    """Whether a stripped line begins as numbers of nodes do."""
    return line[:1].isdecimal() or line[:1] in ("(", "（")


@dataclass
class Cursor:
    """The clause in force while reading lines."""

    root: str | None = None
    sub: str | None = None

    def read(self, line: str) -> tuple[Node, bool]:
        """The line's place, and whether it opens it."""
        above = self.sub or self.root
        if _may_open(line):
            if m := _TOP.match(line):
                return self._enter(m.group(1)), True
            if (m := _SUB.match(line)) and self.root:
                self.sub = f"{self.root}({m.group(1)})"
                return Node(self.root, self.sub), True
            if (m := _ITEM.match(line) or _BARE_ITEM.match(line)) and above:
                self.root = base_of(above)
                return Node(above, f"{above}.{m.group(1)}"), True
        if not above and (loose := find_clause(line)):
            return self._enter(loose), True
        if above:
            self.root = base_of(above)
        return Node(above, above), False

    def _enter(self, node: str) -> Node:
        self.root = base_of(node)
        self.sub = node if node != self.root else None
        return Node(node, node)


def segments(text: str) -> list[tuple[Node, str]]:
    """A block's text by clause boundaries."""
    cursor, out = Cursor(), []
    for line in filter(None, map(str.strip, text.splitlines())):
        place, opens = cursor.read(line)
        if opens or not out:
            out.append((place, line))
        else:
            out[-1] = (out[-1][0], f"{out[-1][1]}\n{line}")
    return out


def pack(text: str, most: int, overlap: int) -> list[str]:
    """Sentences packed to at most `most` characters where they fit; pieces open with the end of the one before."""
    text = text.strip()
    if len(text) <= most:
        return [text] if text else []
    out: list[str] = []
    for sentence in [s for s in map(str.strip, _ENDS.split(text)) if s] or [text]:
        if not out:
            out.append(sentence)
        elif len(out[-1]) + len(sentence) <= most:
            out[-1] += sentence
        else:
            out.append((out[-1][-overlap:] if overlap > 0 else "") + sentence)
    return out


@dataclass
class Piece:
    text: str
    pages: list[int]
    blocks: list[str]
    place: Node = field(default_factory=Node)


def pieces(blocks: list[dict], start_page: int, most: int, overlap: int) -> list[Piece]:
    """All segments of a chapter; a block without clause stays under the clause before it, and so does a numbered item
    that only mentions another clause."""
    held, out = Node(), []
    for b in blocks:
        page, block = int(b.get("page_no") or start_page or 0), str(b.get("block_id") or "").strip()
        for place, text in segments(str(b.get("text") or "")):
            if held.clause and place.clause != held.clause:
                numbered = _may_open(text) and (_ITEM.match(text) or _BARE_ITEM.match(text) or _SUB.match(text))
                below = place.clause and place.clause.startswith((f"{held.clause}.", f"{held.clause}("))
                if not place.clause or (not below and not _TOP.match(text) and numbered):
                    place = replace(held)
            if place.clause:
                held = place
            out += [Piece(t, [page], [block] if block else [], place) for t in pack(text, most, overlap)]
    return out


def _agree(a: str | None, b: str | None) -> bool:
    return not a or not b or a == b


def chunks(chapter: dict, least: int, most: int, overlap: int) -> list[Piece]:
    """Chunks of one chapter. A short last chunk joins the one before if both may be of one node."""
    start = int(chapter.get("start_page") or 0)
    found = pieces(chapter.get("blocks") or [], start, most, overlap)
    if not found and str(chapter.get("text") or "").strip():
        clause, ids = find_clause(chapter["text"]), list(chapter.get("block_ids") or [])
        found = [Piece(t, [start], [str(ids[0])] if ids else [], Node(clause, clause)) for t in pack(chapter["text"], most, overlap)]
    out: list[Piece] = []
    for p in found:
        last = out[-1] if out else None
        if last and _agree(last.place.clause, p.place.clause) and _agree(last.place.node, p.place.node) and len(last.text) + 1 + len(p.text) <= most:
            last.text = f"{last.text}\n{p.text}"
            last.pages += p.pages
            last.blocks += p.blocks
            last.place = Node(last.place.clause or p.place.clause, last.place.node or p.place.node)
        else:
            out.append(p)
    for p in out:
        clause = p.place.clause or find_clause(p.text)
        p.place = Node(clause, p.place.node or clause)
    if len(out) > 1 and len(out[-1].text) < least and _agree(out[-1].place.clause, out[-2].place.clause) and _agree(out[-1].place.node, out[-2].place.node):
        tail, before = out.pop(), out[-1]
        before.text = f"{before.text}\n{tail.text}"
        before.pages, before.blocks = before.pages + tail.pages, before.blocks + tail.blocks
        before.place = Node(before.place.clause or tail.place.clause, before.place.node or tail.place.node)
    return out


_KIND = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
SCHEMA = "doc_id string, version_id string, chapter_id string, chunk_id string, chunk_no int, page_start int, page_end int, text string, block_ids array<string>, clause_id string, clause_node_id string, clause_parent_id string, clause_level int"
_ARROW = pa.schema([(f.split()[0], _KIND[f.split()[1]]) for f in SCHEMA.split(", ")])


def chunk_chapters(chapters: DataFrame, least: int = 220, most: int = 420, overlap: int = 80) -> DataFrame:
    """Chunks of all chapters; each chapter is folded on its own, wherever it lies (no shuffle). A chapter's text counts only
    where its blocks hold none; chapters without a column of texts have theirs in blocks."""
    wanted = [c for c in ("doc_id", "version_id", "chapter_id", "start_page", "block_ids", "blocks", "text") if c in chapters.columns]

    def run(batches):
        for batch in batches:
            rows = []
            for ch in batch.to_pylist():
                for i, p in enumerate(chunks(ch, least, most, overlap), start=1):
                    rows.append((ch["doc_id"], ch["version_id"], ch["chapter_id"], f"{ch['chapter_id']}_ck_{i}", i, min(p.pages), max(p.pages), p.text.strip(), list(dict.fromkeys(p.blocks)), p.place.clause, p.place.node, p.place.parent, p.place.level))
            cols = zip(*rows, strict=True) if rows else [()] * len(_ARROW)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW, strict=True)], schema=_ARROW)

    return chapters.select(*wanted).mapInArrow(run, SCHEMA)
