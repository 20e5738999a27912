"""Vector code compression: product codes whose nearest codebook entries are found by VA-file filtering.

A vector is cut into equal parts, and each part is replaced by the number of the nearest entry of its codebook. The nearest
entry is found as in a VA-file: an entry's coordinates are known by cells of a few bits, each with the least and the largest
coordinate in it. A query's lookup tables hold, for each coordinate and cell, the least and the largest squared distance to
that cell; summed over an entry's cells they bound its distance from both sides. Only entries whose lower bound does not
exceed the least upper bound are compared, in whole numbers.

Codebooks have a fixed size (entries x components), so they may pass through the driver; vectors never do. Each task adds
up its own vectors' parts before anything is shuffled, so a vector that is repeated a billion times is as cheap as others.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Integer components are held to this size, so that squared distances and sums stay within 64 bits.
LARGEST = 1 << 26
#: Queries filtered at a time.
BLOCK = 1024


class Cells:
    """The entries (k, d) of one part's codebook, and their coordinates' cells."""

    def __init__(self, entries: np.ndarray, bits: int = 4):
        k, d = entries.shape
        n = min(1 << bits, k)
        rank = np.argsort(np.argsort(entries, axis=0, kind="stable"), axis=0, kind="stable")
        self.entries, self.cell = entries, rank * n // k
        self.lo, self.hi = np.full((d, n), np.iinfo(np.int64).max), np.full((d, n), np.iinfo(np.int64).min)
        for j in range(d):
            np.minimum.at(self.lo[j], self.cell[:, j], entries[:, j])
            np.maximum.at(self.hi[j], self.cell[:, j], entries[:, j])

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distances of entries (rows) to the parts x (columns)."""
        (k, d), n = self.entries.shape, len(x)
        widest = max(int(self.hi.max(initial=0)), int(x.max(initial=0))) - min(int(self.lo.min(initial=0)), int(x.min(initial=0)))
        kind = np.int32 if d * widest * widest < 1 << 31 else np.int64
        lower, upper = np.zeros((k, n), kind), np.zeros((k, n), kind)
        for j in range(d):
            at, lo, hi = x[None, :, j], self.lo[j][:, None], self.hi[j][:, None]
            least, most = np.maximum(np.maximum(lo - at, at - hi), 0).astype(kind), np.maximum(hi - at, at - lo).astype(kind)
            lower += (least * least)[self.cell[:, j]]
            upper += (most * most)[self.cell[:, j]]
        return lower, upper

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each part (the lower one of equals), and the squared distance to it."""
        code, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        for first in range(0, len(x), BLOCK):
            some = x[first : first + BLOCK]
            lower, upper = self.bounds(some)
            who, entry = np.nonzero((lower <= upper.min(axis=0)).T)
            exact = ((some[who] - self.entries[entry]) ** 2).sum(axis=1)
            least = np.minimum.reduceat(exact, np.searchsorted(who, np.arange(len(some))))
            hit = np.flatnonzero(exact == least[who])
            hit = hit[np.diff(who[hit], prepend=-1) > 0]
            code[first : first + BLOCK], error[first : first + BLOCK] = entry[hit], least
        return code, error


@dataclass
class Codebooks:
    """entries: (parts, entries, components of a part) whole numbers."""

    entries: np.ndarray
    scale: int

    def sha256(self) -> str:
        """Digest of all components in decimal, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def cells(self) -> list[Cells]:
        return [Cells(part) for part in self.entries]


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector is there and has finite components only."""
    fine = F.forall(column, lambda e: F.coalesce(F.abs(e.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(e.cast("double")))
    return vectors.where(F.coalesce(fine, F.lit(False)))


def _whole(column, scale: int, parts: int, width: int) -> np.ndarray:
    """An Arrow list column as (rows, parts, width) whole numbers: floor(scale * x), filled up with zeros at the end."""
    import pyarrow.compute as pc

    size = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(size), parts * width), np.int64)
    out[np.arange(parts * width) < size[:, None]] = np.clip(np.floor(scale * flat), -LARGEST, LARGEST)
    return out.reshape(len(size), parts, width)


def _batches(rows):
    """Arrow batches cut so that one piece's vectors stay small."""
    for batch in rows:
        for first in range(0, batch.num_rows, 4 * BLOCK):
            yield batch.slice(first, 4 * BLOCK)


def _round(vectors: DataFrame, books: Codebooks) -> np.ndarray:
    """One round: every part goes to its nearest entry, then entries become their parts' means (rounded down)."""
    import pyarrow as pa

    parts, n, width = books.entries.shape

    def add_up(rows):
        total, count, cells = np.zeros_like(books.entries), np.zeros((parts, n), np.int64), books.cells()
        for batch in _batches(rows):
            x = _whole(batch.column(0), books.scale, parts, width)
            for p in range(parts):
                code, _ = cells[p].nearest(x[:, p])
                count[p] += np.bincount(code, minlength=n)
                order = np.argsort(code, kind="stable")
                used, start = np.unique(code[order], return_index=True)
                if len(used):
                    total[p, used] += np.add.reduceat(x[order, p], start, axis=0)
        part, entry = np.nonzero(count)
        sums = pa.array(total[part, entry].tolist(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry], pa.int64()), sums], names=["part", "entry", "n", "sums"])

    sums = vectors.mapInArrow(add_up, "part int, entry int, n long, sums array<long>").select("part", "entry", F.posexplode(F.concat(F.array("n"), "sums")).alias("place", "x"))
    after, got = books.entries.copy(), np.zeros((parts, n, width + 1), np.int64)
    for r in sums.groupBy("part", "entry", "place").agg(F.sum("x").alias("x")).collect():  # as many rows as the codebooks have components
        got[r["part"], r["entry"], r["place"]] = r["x"]
    used = got[:, :, 0] > 0
    after[used] = got[used][:, 1:] // got[used][:, :1]
    return after


def fit(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, dims: int | None = None) -> Codebooks | None:
    """Codebooks of all usable rows. They start as the parts of the rows with the smallest ids (null ids come last; rows of
    one id are ordered by their vectors), so with fewer rows than `entries` they have as many entries as there are rows.
    Vectors shorter than the longest (or than `dims`), and lengths that the number of parts does not divide, are filled up
    with zeros at the end. Components beyond 2^26 / scale are held to it. Without usable rows: None."""
    rows = usable(vectors, column).select(id_column, column)
    first = rows.orderBy(F.col(id_column).asc_nulls_last(), column).limit(entries).collect()  # `entries` vectors at most
    if not first:
        return None
    longest = dims or rows.agg(F.max(F.size(column))).first()[0]
    width = -(-longest // parts)
    start = np.zeros((len(first), parts * width), np.int64)
    for i, r in enumerate(first):
        start[i, : len(r[column])] = np.clip(np.floor(scale * np.array(r[column], np.float64)), -LARGEST, LARGEST)
    books = Codebooks(start.reshape(len(first), parts, width).transpose(1, 0, 2).copy(), scale)
    for _ in range(rounds):
        books = Codebooks(_round(rows.select(column), books), scale)
    return books


def encode(vectors: DataFrame, books: Codebooks | None, id_column: str = "vec_id", column: str = "embedding", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each usable row: the id, the columns `keep`, code (for each part, in order, the entry's number in two hex
    digits, more if there are over 256 entries) and error (squared distances summed over the parts). Repeated rows each give
    a row; null ids are kept. Without codebooks (no usable rows) the result is empty."""
    import pyarrow as pa

    rows = usable(vectors, column)
    kept = [id_column, *keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema)
    if books is None:
        return rows.limit(0).select(*kept, F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    parts, n, width = books.entries.shape
    digits = max(2, len(f"{n - 1:x}"))

    def code_rows(batches):
        cells, name = books.cells(), np.array([f"{e:0{digits}x}" for e in range(n)], object)
        for batch in _batches(batches):
            x = _whole(batch.column(len(kept)), books.scale, parts, width)
            code, error = np.full(len(x), "", object), np.zeros(len(x), np.int64)
            for p in range(parts):
                nearest, distance = cells[p].nearest(x[:, p])
                code, error = code + name[nearest], error + distance
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(code.tolist(), pa.string()), pa.array(error)], names=[*kept, "code", "error"])

    return rows.select(*kept, column).mapInArrow(code_rows, f"{schema}, code string, error long")


def decode(coded: DataFrame, books: Codebooks, code: str = "code") -> DataFrame:
    """The rows with `approximation`: the entries that the code names, divided by the scale again (array<double>)."""
    digits = max(2, len(f"{books.entries.shape[1] - 1:x}"))
    found = [F.lit((part / books.scale).tolist())[F.conv(F.substring(code, 1 + p * digits, digits), 16, 10).cast("int")] for p, part in enumerate(books.entries)]
    return coded.withColumn("approximation", F.concat(*found))


def with_label_error(coded: DataFrame, label: str = "label") -> DataFrame:
    """Adds label_error: error summed over equal labels, nulls together. Sums are pre-aggregated in every task and met by a
    join that Spark can broadcast or split, so that a label on a third of all rows never meets in one task."""
    coded = written(coded, "vector-codes")
    sums = written(coded.groupBy(F.col(label).alias("_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    return coded.join(sums, coded[label].eqNullSafe(sums["_label"])).drop("_label")
