"""A kept full-text index: runs of postings in Parquet, searched without reading the texts again.

A run holds some pages' postings in blocks. A block is one term's postings over one slice of page numbers; slices are powers
of two, chosen for each term by its frequency so that a block holds about BLOCK postings, and a term that few pages hold is
one block. So where a term's postings of a page stand is known from the page number and the term's level, and words meet
candidate pages by an equi-join on (term, slice) that leaves all other blocks out. Blocks are sorted by term and slice and
dealt into files by ranges of both, so that a term on every page is spread over many files; the run's manifest knows each
file's first and last term, and a search opens only files that may hold its words.

A question starts from the rarest word of each of its alternatives and meets the next rarest first. Where even the rarest is
frequent, blocks are taken by their largest count first: once k pages are scored, blocks that cannot beat the k-th are never
read (see most_covers()). New pages are further runs; a page of a later run hides the same page of earlier ones; compact()
makes one run of all. Everything is a plain Parquet table. One writer at a time.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citelake.operators.retrieval import cover_density, query_blocks, top_k, websearch
from citelake.stages import remove, written

#: Postings a block should hold; leading pages that are scored first, a hit wanted, to know what blocks must beat.
BLOCK, PROBE = 128, 8
#: Pages (and characters) whose postings are packed together; pages from which on a word's are cut.
CHUNK, CHUNK_CHARS, CUT = 2048, 4_000_000, 64
#: Files are opened for at most so many words by a filter that Parquet's statistics can use.
FEW_WORDS = 500
#: Level of a term with one block: no page number is left after the shift.
WHOLE = 62
#: Pages among which a hit is looked for in the manifest.
PAGES_APART = 1 << 18
_WORD = re.compile(r"\w+")
_PAGES, _POSTINGS = "page long, doc_id string, page_no int", "page long, term string, at array<int>"
#: Rows of packed postings: the first page and the last, the word, its pages and its most places on one; keys of a page.
_CHUNKS, _KEYS = "page long, last long, term string, n int, most int, packed binary", ", doc_id string, page_no int"


def _page_name(page: int) -> str:
    return f"{page:020d}"


def most_covers(units: Column, count: Column) -> Column:
    """The most that cover_density() can give a page for one alternative of so many units, the rarest of which it holds so
    many times. Covers that hold one and the same occurrence of a unit begin with different units (else the later one would
    not be the only one of its kind in the earlier cover), so there are at most units * count; each gives 0.1 at most."""
    return 0.1 * units * count


def _varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers from 0 as bytes, seven bits each, the least first, and how many bytes each takes."""
    size = 1 + sum((values >= 1 << 7 * k).astype(np.int64) for k in range(1, 5))
    start, out = np.cumsum(size) - size, np.zeros(int(size.sum()), np.uint8)
    for k in range(5):
        some = size > k
        out[start[some] + k] = (values[some] >> 7 * k & 127) | np.where(size[some] > k + 1, 128, 0)
    return out, size


def _numbers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of _varints() and where each ends in the bytes."""
    ends = np.flatnonzero(data < 128) + 1
    start = np.concatenate([[0], ends[:-1]])
    which = np.arange(len(data)) - np.repeat(start, ends - start)
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * which, start) if len(ends) else np.empty(0, np.int64), ends


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... in each of some stretches."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def pack(pages: np.ndarray, sizes: np.ndarray, at: np.ndarray, n: np.ndarray) -> pa.Array:
    """Postings of some rows, n of each: the pages' steps, how many places each has, and the places' steps."""
    first, one = np.cumsum(n) - n, np.cumsum(sizes) - sizes
    steps, moves = np.diff(pages, prepend=0), np.diff(at, prepend=0)
    steps[first], moves[one] = 0, at[one]
    places = np.add.reduceat(sizes, first)
    start = np.cumsum(2 * n + places) - (2 * n + places)
    values = np.empty(2 * len(pages) + len(at), np.int64)
    to = np.repeat(start, n) + _within(n)
    values[to], values[to + np.repeat(n, n)], values[np.repeat(start + 2 * n, places) + _within(places)] = steps, sizes, moves
    data, width = _varints(values)
    ends = np.concatenate([[0], np.cumsum(np.add.reduceat(width, start))]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def unpack(packed: pa.Array, n: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """pack()'s pages, sizes and places; first: each row's first page."""
    ends = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1]
    values, stops = _numbers(np.frombuffer(packed.buffers()[2], np.uint8)[ends[0] : ends[-1]])
    start = np.searchsorted(stops, ends[:-1] - ends[0], side="right")
    to = np.repeat(start, n) + _within(n)
    pages, sizes = np.cumsum(values[to]), values[to + np.repeat(n, n)]
    pages += np.repeat(first - pages[np.cumsum(n) - n], n)
    places = np.add.reduceat(sizes, np.cumsum(n) - n)
    moves = values[np.repeat(start + 2 * n, places) + _within(places)]
    at, one = np.cumsum(moves), np.cumsum(sizes) - sizes
    return pages, sizes, at - np.repeat(at[one] - moves[one], sizes)


def _rows(terms: pa.Array, pages: np.ndarray, sizes: np.ndarray, at: np.ndarray, n: np.ndarray) -> list:
    """Columns of _CHUNKS; terms: one a row."""
    first = np.cumsum(n) - n
    return [pa.array(pages[first]), pa.array(pages[first + n - 1]), terms, pa.array(n, pa.int32()), pa.array(np.maximum.reduceat(sizes, first), pa.int32()), pack(pages, sizes, at, n)]


def _chunk(ids: list[int], words: list[pa.Array]) -> list:
    """Columns of _CHUNKS of some pages: a row a word. A word of more than CUT pages has a row for each CUT of them, so that few
    rows reach into two slices."""
    count = np.array([len(w) for w in words], np.int64)
    coded = pa.concat_arrays(words).dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    order = np.argsort(codes, kind="stable")
    codes, page, at = codes[order], np.repeat(np.arange(len(ids)), count)[order], _within(count)[order]
    post = np.flatnonzero(np.concatenate([[True], (np.diff(codes) != 0) | (np.diff(page) != 0)]))
    codes, page, sizes = codes[post], page[post], np.diff(post, append=len(at))
    piece = np.where(np.bincount(codes)[codes] > CUT, page // CUT, 0)
    first = np.flatnonzero(np.concatenate([[True], (np.diff(codes) != 0) | (np.diff(piece) != 0)]))
    return _rows(coded.dictionary.take(pa.array(codes[first])), np.array(ids, np.int64)[page], sizes, at, np.diff(first, append=len(page)))


def page_words(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, page_no, text) -> pages (page, doc_id, page_no), numbered from 0 without gaps, and their postings (_CHUNKS): a
    task packs a word's postings of up to CHUNK pages into one row. Texts are split once; both are read from one table."""
    numbered = pages.select(F.monotonically_increasing_id().alias("page"), F.col("doc_id").cast("string").alias("doc_id"), F.col("page_no").cast("int").alias("page_no"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in (_CHUNKS + _KEYS).split(", ")]
        empty = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.int32()]
        made = lambda n, columns: pa.RecordBatch.from_arrays([columns[i] if i in columns else pa.nulls(n, t) for i, t in enumerate(empty)], names=names)
        ids, words, chars = [], [], 0
        for batch in batches:
            yield made(batch.num_rows, {0: batch.column(0), 6: batch.column(1), 7: batch.column(2)})
            for start in range(0, batch.num_rows, 64):
                some = batch.slice(start, 64)
                for page, body in zip(some.column(0).to_pylist(), some.column(3).to_pylist(), strict=True):
                    if found := _WORD.findall(body):
                        ids.append(page)
                        words.append(pa.array(found, pa.string()))
                        chars += len(body)
                    if len(ids) >= CHUNK or chars >= CHUNK_CHARS:
                        columns = _chunk(ids, words)
                        yield made(len(columns[0]), dict(enumerate(columns)))
                        ids, words, chars = [], [], 0
        if ids:
            columns = _chunk(ids, words)
            yield made(len(columns[0]), dict(enumerate(columns)))

    got = written(numbered.mapInArrow(split, _CHUNKS + _KEYS), "page-words")
    there, chunks = got.where("term is null"), got.where("term is not null")
    part, within = F.shiftrightunsigned("page", 33), lambda c: F.col(c).bitwiseAND((1 << 33) - 1)
    sizes = there.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(written(sizes.select("part", before.alias("offset")), "page-offsets"))  # a row an input partition
    placed = lambda df: df.join(offsets, part == F.col("part"))
    number = lambda c: (F.col("offset") + within(c)).alias(c)
    return placed(there).select(number("page"), "doc_id", "page_no"), placed(chunks).select(number("page"), number("last"), "term", "n", "most", "packed")


def packed_postings(postings: DataFrame) -> DataFrame:
    """(page, term, at) -> _CHUNKS, a row each."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sizes = batch.column(2).value_lengths().to_numpy().astype(np.int64)
                columns = _rows(batch.column(1), batch.column(0).to_numpy(), sizes, batch.column(2).flatten().to_numpy().astype(np.int64), np.ones(batch.num_rows, np.int64))
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _CHUNKS.split(", ")])

    return postings.select("page", "term", "at").mapInArrow(each, _CHUNKS)


def _blocks(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Blocks of all the rows of some (term, slice), in order of these and of the pages."""
    terms, slices, level, first, n, packed = rows.columns
    starts = _starts(rows)
    slices, level, n = slices.to_numpy(), level.to_numpy().astype(np.int64), n.to_numpy().astype(np.int64)
    pages, sizes, at = unpack(packed, n, first.to_numpy())
    block = np.repeat(np.repeat(np.arange(len(starts)), np.diff(starts, append=len(n))), n)
    here = pages >> np.repeat(level, n) == np.repeat(slices, n)
    if not here.all():  # rows that reach into several slices stand in each
        at = at[np.repeat(here, sizes)]
        pages, sizes, block = pages[here], sizes[here], block[here]
    held, heads = np.unique(block, return_index=True)
    ends = np.append(heads, len(pages)).astype(np.int32)
    nested = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(at.astype(np.int32)))
    most = np.maximum.reduceat(sizes, heads) if len(heads) else sizes
    columns = [terms.take(pa.array(starts[held])), pa.array(slices[starts[held]]), pa.array(np.diff(ends), pa.int32()), pa.array(most, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(pages)), pa.ListArray.from_arrays(pa.array(ends), nested)]
    return pa.RecordBatch.from_arrays(columns, names=["term", "slice", "n", "most", "pages", "at"])


def _starts(rows: pa.RecordBatch) -> np.ndarray:
    """Where another (term, slice) begins."""
    codes, slices = rows.column(0).dictionary_encode().indices.to_numpy(), rows.column(1).to_numpy()
    return np.flatnonzero(np.concatenate([[True], (np.diff(codes) != 0) | (np.diff(slices) != 0)]))


def merge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (term, slice, level, page, n, packed) -> blocks; a block's rows may come in several batches."""
    rest = None
    for batch in batches:
        if batch.num_rows:
            rest = batch if rest is None else pa.concat_batches([rest, batch])
            cut = int(_starts(rest)[-1])
            if cut:
                yield _blocks(rest.slice(0, cut))
                rest = rest.slice(cut)
    if rest is not None:
        yield _blocks(rest)


class Run:
    """One run as its manifest describes it."""

    def __init__(self, index: FullTextIndex, name: str, rows: list):
        self.index, self.name = index, name
        self.files = [r for r in rows if r["kind"] != "run"]
        self.pages = next(r["n"] for r in rows if r["kind"] == "run")

    def table(self, kind: str, words: set[str] | None = None) -> DataFrame | None:
        """Rows of the run's terms, blocks or pages, from the files that may hold one of the words; None if there are none."""
        files = [r for r in self.files if r["kind"] == kind and (words is None or any(r["first"] <= w <= r["last"] for w in words))]
        self.index.opened += [(kind, r["file"], r["n"]) for r in files]
        if not files:
            return None
        rows = self.index.spark.read.parquet(*[f"{self.index.path}/{self.name}/{kind}/{r['file']}" for r in files])
        if words is None:
            return rows
        if len(words) <= FEW_WORDS:
            return rows.where(F.col("term").isin(sorted(words)))
        # the words of one block of questions: other words' rows end here, before any exchange
        return rows.join(F.broadcast(self.index.spark.createDataFrame([(w,) for w in sorted(words)], "term string")), "term", "left_semi")

    def keyed(self, hits: DataFrame, later: list[Run]) -> DataFrame:
        """Hits with doc_id and page_no, without pages that later runs hide. Only files that hold hits' pages are opened: one
        number for each PAGES_APART pages that have a hit is looked at here."""
        near = sorted({r[0] for r in hits.select(F.floor(F.col("page") / PAGES_APART)).distinct().collect()})
        spans = [(_page_name(n * PAGES_APART), _page_name((n + 1) * PAGES_APART - 1)) for n in near]
        files = [r for r in self.files if r["kind"] == "pages" and r["last"] is not None and any(r["first"] <= b and a <= r["last"] for a, b in spans)]
        self.index.opened += [("pages", r["file"], r["n"]) for r in files]
        if not files:
            return hits.select("*", F.lit(None).cast("string").alias("doc_id"), F.lit(None).cast("int").alias("page_no")).limit(0)
        rows = self.index.spark.read.parquet(*[f"{self.index.path}/{self.name}/pages/{r['file']}" for r in files])
        return FullTextIndex._alive(hits.join(rows, "page"), later)


class FullTextIndex:
    """The index in a folder of the shared store."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.opened = spark, path.rstrip("/"), []

    # writing

    def _manifest(self) -> dict[str, list]:
        """Manifest rows of every run in order, replaced ones left out. As many rows as the index has files."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return {}
        by_run: dict[str, list] = {}
        for r in self.spark.read.parquet(f"{self.path}/manifest/*").collect():
            by_run.setdefault(r["run"], []).append(r)
        gone = {r["file"] for rows in by_run.values() for r in rows if r["kind"] == "replaced"}
        return {name: [r for r in by_run[name] if r["kind"] != "replaced"] for name in sorted(by_run) if name not in gone}

    def runs(self) -> list[Run]:
        return [Run(self, name, rows) for name, rows in self._manifest().items()]

    def _write(self, pages: DataFrame, chunks: DataFrame, replaces: list[str], files: int | None) -> str:
        """A run of pages (page, doc_id, page_no) and packed postings (_CHUNKS). It exists when its manifest does."""
        known = sorted(self._manifest())
        name = f"run-{int(known[-1][4:10]) + 1 if known else 0:06d}-{uuid.uuid4().hex[:8]}"
        base, parts = f"{self.path}/{name}", files or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        pages.repartitionByRange(parts, "page").sortWithinPartitions("page").write.parquet(f"{base}/pages")
        n_pages = self.spark.read.parquet(f"{base}/pages").where("page is not null").count()
        rest = F.floor(F.log2(F.lit(float(BLOCK * max(n_pages, 1))) / F.col("df"))).cast("int")
        terms = chunks.groupBy("term").agg(F.sum(F.col("n").cast("long")).alias("df"), F.max("most").alias("most"))
        level = F.when(F.col("df") >= 2 * BLOCK, F.greatest(rest, F.lit(0))).otherwise(WHOLE)
        terms.withColumn("level", level).repartitionByRange(parts, "term").sortWithinPartitions("term").write.parquet(f"{base}/terms")
        # a table of its own: its size tells Spark whether postings must move to meet it
        frequent = written(self.spark.read.parquet(f"{base}/terms").where(F.col("level") < WHOLE).select("term", "level"), "frequent-terms")
        placed = chunks.join(frequent, "term", "left").withColumn("level", F.coalesce("level", F.lit(WHOLE)))
        slices = F.sequence(F.expr("shiftright(page, level)"), F.expr("shiftright(last, level)"))
        placed = placed.select("term", F.explode(slices).alias("slice"), "level", "page", "n", "packed")
        # ranges of the grouping keys: what is dealt out for the files is merged where it lies
        sorted_ = placed.repartitionByRange(parts, "term", "slice").sortWithinPartitions("term", "slice", "page")
        blocks = sorted_.mapInArrow(merge_rows, "term string, slice long, n int, most int, pages array<long>, at array<array<int>>")
        blocks.write.option("compression", "zstd").parquet(f"{base}/blocks")
        found = [self._files(base, kind, key) for kind, key in (("terms", F.col("term")), ("blocks", F.col("term")), ("pages", F.lpad(F.col("page").cast("string"), 20, "0")))]
        notes = [("run", name, None, None, n_pages), *[("replaced", old, None, None, 0) for old in replaces]]
        found.append(self.spark.createDataFrame(notes, "kind string, file string, first string, last string, n long"))
        reduce(DataFrame.unionByName, found).withColumn("run", F.lit(name)).coalesce(1).write.parquet(f"{self.path}/manifest/{name}")
        return name

    def _files(self, base: str, kind: str, key: Column) -> DataFrame:
        rows = self.spark.read.parquet(f"{base}/{kind}")
        each = rows.groupBy(F.input_file_name().alias("f")).agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count("*").alias("n"))
        return each.select(F.lit(kind).alias("kind"), F.element_at(F.split("f", "/"), -1).alias("file"), "first", "last", "n")

    def add(self, pages: DataFrame, files: int | None = None) -> str:
        """A run of new pages (doc_id, page_no, text), which replace pages of the same key in earlier runs. A key should occur
        once in a batch; if it occurs more often, each of its pages can be found. Null texts hold no words."""
        return self._write(*page_words(pages), [], files)

    def delete(self, keys: DataFrame) -> str:
        """A run that hides the pages of some keys (doc_id, page_no)."""
        gone = keys.select(F.lit(None).cast("long").alias("page"), F.col("doc_id").cast("string").alias("doc_id"), F.col("page_no").cast("int").alias("page_no"))
        return self._write(gone, self.spark.createDataFrame([], _CHUNKS), [], 1)

    def compact(self, files: int | None = None) -> str | None:
        """One run of all living pages in place of all runs; texts are not read. vacuum() removes the files of the old ones."""
        runs, offset, pages, postings = self.runs(), 0, [], []
        for i, run in enumerate(runs):
            kept = self._alive(run.table("pages").where("page is not null"), runs[i + 1 :])
            blocks = run.table("blocks")
            if blocks is not None:
                each = blocks.select("term", F.explode(F.arrays_zip("pages", "at")).alias("p")).select(F.col("p.pages").alias("page"), "term", F.col("p.at").alias("at"))
                postings.append(each.join(kept.select("page"), "page", "left_semi").withColumn("page", F.col("page") + offset))
            pages.append(kept.withColumn("page", F.col("page") + offset))
            offset += run.pages
        if not runs:
            return None
        none = self.spark.createDataFrame([], _POSTINGS)
        return self._write(reduce(DataFrame.unionByName, pages), written(packed_postings(reduce(DataFrame.unionByName, postings, none)), "postings"), [r.name for r in runs], files)

    def vacuum(self) -> None:
        """Removes the tables of replaced runs (their manifests stay, being a few rows)."""
        kept = {r.name for r in self.runs()}
        for name in {r["run"] for r in self.spark.read.parquet(f"{self.path}/manifest/*").select("run").distinct().collect()} - kept:
            remove(self.spark, f"{self.path}/{name}")

    # searching

    @staticmethod
    def _alive(rows: DataFrame, later: list[Run]) -> DataFrame:
        for run in later:
            newer = run.table("pages").select("doc_id", "page_no")
            on = rows["doc_id"].eqNullSafe(newer["doc_id"]) & rows["page_no"].eqNullSafe(newer["page_no"])
            rows = rows.join(newer, on, "left_anti")
        return rows

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, query) -> (query_id, doc_id, page_no, score, rank, route) as retrieval.fts_best() gives them, for
        questions in blocks of a bounded number. `opened` then lists the files (kind, name, rows) that the search could read."""
        self.opened, runs, found = [], self.runs(), []
        kind = queries.schema["query_id"].dataType.simpleString()
        empty = self.spark.createDataFrame([], f"query_id {kind}, doc_id string, page_no int, score double")
        for some in query_blocks(queries):
            asked = [(r["query_id"], alternatives) for r in some.select("query_id", "query").collect() if (alternatives := websearch(r["query"]))]
            names = self.spark.createDataFrame([(i, q) for i, (q, _) in enumerate(asked)], f"q int, query_id {kind}")
            for i, run in enumerate(runs):
                hits = self._search_run(run, runs[i + 1 :], [a for _, a in asked], k)
                if hits is not None:
                    found.append(run.keyed(written(hits, "hits"), runs[i + 1 :]).join(names, "q").select("query_id", "doc_id", "page_no", "score"))
        return top_k(reduce(DataFrame.unionByName, found, empty), k, F.desc(F.round("score", 9)), F.col("doc_id"), F.col("page_no")).withColumn("route", F.lit("sparse"))

    def _search_run(self, run: Run, later: list[Run], asked: list, k: int) -> DataFrame | None:
        """(q, page, score) of one run: every page that can be among the k best of a question, and pages that later runs hide."""
        words = {w for alternatives in asked for units in alternatives for u in units for w in u}
        known = run.table("terms", words) if words else None
        stats = {r["term"]: r for r in known.where(F.col("term").isin(sorted(words))).collect()} if known is not None else {}
        leads, follow, every = [], [], []
        for q, alternatives in enumerate(asked):
            for a, units in enumerate(alternatives):
                wanted = sorted({w for u in units for w in u}, key=lambda w: (stats[w]["df"], w) if w in stats else (0, w))
                if all(w in stats for w in wanted):
                    # bounds hold for one alternative; of several, none is passed over
                    leads.append((q, a, wanted[0], len(units) if len(alternatives) == 1 else None, stats[wanted[0]]["df"]))
                    follow += [(q, a, w, stats[w]["level"], min(2, len(wanted) - 1)) for w in wanted[1:3]]
            alive = {w for units in alternatives for u in units for w in u if w in stats}
            every += [(q, w, stats[w]["level"]) for w in alive]
        if not leads:
            return None
        lead = self.spark.createDataFrame(leads, "q int, a int, term string, units int, df long")
        follow = self.spark.createDataFrame(follow, "q int, a int, term string, level int, needs int")
        every = self.spark.createDataFrame(every, "q int, term string, level int")
        first = run.table("blocks", {r[2] for r in leads})
        blocks = run.table("blocks", words)
        bound = F.lit(None).cast("double")
        if any(units and df > PROBE * k for *_, units, df in leads):
            heads = first.select("term", "slice", "n", "most").join(lead.where(F.col("units").isNotNull() & (F.col("df") > PROBE * k)), "term")
            # blocks of the largest counts, until they hold enough pages
            before = F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("most"), "slice").rowsBetween(Window.unboundedPreceding, -1))
            probe = heads.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < PROBE * k).select("q", "a", "term", "slice", "units")
            tried = run.keyed(written(self._scored(self._candidates(first.join(probe, ["term", "slice"])), blocks, follow, every, asked), "tried"), later)
            least = top_k(tried.select("q", "page", "score"), k, F.desc("score"), group="q").groupBy("q").agg(F.min("score").alias("least"), F.count("*").alias("n"))
            least = written(least.where(F.col("n") == k).select("q", "least"), "least-scores")
            lead, bound = lead.join(least, "q", "left"), F.col("least")
        may = F.col("units").isNull() | bound.isNull() | (most_covers(F.col("units"), F.col("most")) >= bound - 1e-9)
        return self._scored(self._candidates(first.join(lead, "term").where(may)), blocks, follow, every, asked)

    @staticmethod
    def _candidates(blocks: DataFrame) -> DataFrame:
        """(q, a, page) of blocks' postings, of those that can reach the least score, where there is one."""
        each = blocks.select("q", "a", "units", *(["least"] if "least" in blocks.columns else []), F.explode(F.arrays_zip("pages", "at")).alias("p"))
        if "least" in blocks.columns:
            each = each.where(F.col("units").isNull() | F.col("least").isNull() | (most_covers(F.col("units"), F.size("p.at")) >= F.col("least") - 1e-9))
        return each.select("q", "a", F.col("p.pages").alias("page"))

    def _scored(self, pages: DataFrame, blocks: DataFrame, follow: DataFrame, every: DataFrame, asked: list) -> DataFrame:
        """Candidates that hold all words of an alternative, scored: first those that hold its next rarest words, then all."""

        def met(wanted: DataFrame) -> DataFrame:
            placed = wanted.withColumn("slice", F.expr("shiftright(page, level)"))
            there = placed.join(blocks, ["term", "slice"]).withColumn("i", F.array_position("pages", F.col("page")).cast("int")).where("i > 0")
            return there.withColumn("at", F.element_at("at", F.col("i")))

        alone = pages.join(follow.select("q", "a").distinct(), ["q", "a"], "left_anti")
        held = met(pages.join(follow, ["q", "a"])).groupBy("q", "a", "page", "needs").agg(F.count("*").alias("held")).where("held = needs")
        pages = written(alone.select("q", "page").unionByName(held.select("q", "page")).distinct(), "candidates")
        found = met(pages.join(every, "q")).groupBy("q", "page").agg(F.collect_list(F.struct("term", "at")).alias("words"))

        @F.pandas_udf("double")
        def cover(q: pd.Series, words: pd.Series) -> pd.Series:
            return pd.Series([cover_density(asked[i], {w["term"]: np.asarray(w["at"], np.int64) for w in x}) for i, x in zip(q, words, strict=True)], dtype="float64")

        return found.select("q", "page", F.round(cover("q", "words"), 9).alias("score")).where("score > 0")
