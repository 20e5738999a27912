"""Embedding near-dedup by an epsilon grid order join (operator 1).

Unit vectors within cosine c of each other are within eps = sqrt(2 - 2c). Vectors are turned onto their principal axes
(fitted on a bounded sample: an orthonormal turn changes no distance, so the sample affects speed alone), put in grid cells
of width eps on the leading axes, and sorted in the cells' lexicographic order. The sorted sequence is cut into blocks of
bounded size and runs of blocks into groups; each has its bounding box on the leading axes, and groups form a tree of
sequence intervals. The join starts with the whole sequence against itself and goes down the tree level by level, dropping
every pair of intervals whose boxes are further than eps apart. Of the two groups of a remaining pair one owns it: a task
holds the owner's vectors, the blocks of its partners that are in reach stream past, and block by block the same box test
goes on. So a group's vectors move once for each group that owns a pair with them, not once a pair of blocks.

A single-precision product picks the rows and columns that may hold a link, with a margin above its rounding error; these
are compared in double precision. A task adds up the links of its vectors and hands on, for each vector with a link, their
number and the head of its component in the task: rows grow with vectors and groups, never with pairs of vectors. Vectors
with equal components are one class (counted, not expanded), and a hot cell is split over as many blocks as it fills.

Where the leading axes tell little (vectors spread evenly over a sphere of many dimensions), few boxes are far apart and
the work is quadratic, as any exact join's is there; blocks then move (number of groups) / 2 times.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing and stay;
vectors of another length than the most common one are compared among themselves per length; rows with a null id link
with nothing and stay (component null); repeated rows are vectors of their own that share an id; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, graph

AXES, FAN = 16, 8
SAMPLE_ROWS, SAMPLE_BYTES = 4096, 32 << 20
#: Rows of a block; bytes of a group as double precision numbers, which its owner's task holds.
BLOCK_ROWS, BLOCK_BYTES, GROUP_BYTES = 512, 4 << 20, 64 << 20


def _unit(kind: str):
    """(id, vector) -> the vector's bytes as they are (kind: their numpy type) and 128 bits that stand for its direction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 2000):
                b = big.slice(at, 2000)
                ids, dims, k1, k2, vecs = [], [], [], [], []
                for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    ids.append(i)
                    x = None
                    if v and i is not None and None not in v:
                        raw = np.array(v, kind)
                        x = unit_rows(raw[None])[0] if np.isfinite(raw).all() and raw.any() else None
                    if x is None:
                        dims.append(0), k1.append(None), k2.append(None), vecs.append(None)
                    else:
                        d = np.frombuffer(hashlib.blake2b((x + 0.0).tobytes(), digest_size=16).digest(), np.int64)
                        dims.append(len(x)), k1.append(int(d[0])), k2.append(int(d[1])), vecs.append(raw.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(vecs, pa.binary())], names=["id", "dim", "k1", "k2", "vec"])
        common.give_back()

    return run


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows divided by their length, in double precision; by their largest component first, so that squares stay finite."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _cells(axes: np.ndarray, eps: float, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near = unit_rows(np.stack([np.frombuffer(x.as_buffer(), kind) for x in b.column(2)])) @ axes
                cells = np.floor(near / eps).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(cells), pa.list_(pa.int32())), pa.array(list(near), pa.list_(pa.float64()))], names=["rep", "copies", "vec", "cell", "near"])

    return run


def _blocks(size: int):
    """Rows in grid order -> blocks of at most size rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count = 0

        def block() -> pa.RecordBatch:
            nonlocal held, count
            near = np.array([h[3] for h in held])
            row = [
                [TaskContext.get().partitionId()], [count], [near.min(axis=0).tolist()], [near.max(axis=0).tolist()],
                [np.array([h[0] for h in held], np.int64).tobytes()], [np.array([h[1] for h in held], np.int64).tobytes()], [b"".join(h[2] for h in held)],
            ]
            held, count = [], count + 1
            kinds = [pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], names=["part", "at", "lo", "hi", "reps", "copies", "vecs"])

        for b in batches:
            for h in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                held.append(h)
                if len(held) == size:
                    yield block()
        if held:
            yield block()

    return run


class _Block:
    """A block of vectors as a task holds it."""

    def __init__(self, row: tuple, dim: int, kind: str):
        self.seq, self.lo, self.hi = row[0], np.array(row[1]), np.array(row[2])
        self.reps, self.copies = np.frombuffer(row[3], np.int64), np.frombuffer(row[4], np.int64)
        self.unit = unit_rows(np.frombuffer(row[5], kind).reshape(-1, dim))
        self.short = self.unit.astype(np.float32)


class _Owner:
    """The vectors of one group, their links so far and the heads of their components so far."""

    def __init__(self, group: int, cosine: float, eps: float, dim: int):
        self.group, self.cosine, self.eps = group, cosine, eps
        self.margin = 2 * (dim + 8) * float(np.finfo(np.float32).eps)
        self.blocks: list[_Block] = []
        self.boxes: tuple[np.ndarray, np.ndarray] | None = None
        self.joined: set[tuple[int, int]] = set()  # heads that a later link has joined

    def _ready(self) -> None:
        """Once the group is whole: the group against itself."""
        if self.boxes is None:
            self.boxes = np.stack([b.lo for b in self.blocks]), np.stack([b.hi for b in self.blocks])
            self.count = [np.zeros(len(b.reps), np.int64) for b in self.blocks]
            self.head = [b.reps.copy() for b in self.blocks]
            for k, b in enumerate(self.blocks):
                self._meet(b, self.count[k], self.head[k], k)

    def _meet(self, b: _Block, count: np.ndarray, head: np.ndarray, own: int | None) -> None:
        """Block b against the group's blocks (from place own on, where it is one of them): count, head and what is known
        of the group's vectors follow."""
        gap = np.maximum(0, np.maximum(self.boxes[0] - b.hi, b.lo - self.boxes[1]))
        near = np.flatnonzero((gap**2).sum(axis=1) <= self.eps * self.eps)
        for k in near[near >= (own or 0)].tolist():
            a = self.blocks[k]
            may = a.short @ b.short.T >= self.cosine - self.margin
            if k == own:
                np.fill_diagonal(may, False)
            rows, cols = np.flatnonzero(may.any(axis=1)), np.flatnonzero(may.any(axis=0))
            links = a.unit[rows] @ b.unit[cols].T >= self.cosine
            if k == own:
                links &= rows[:, None] != cols[None, :]
            if not links.any():
                continue
            ha, hb = graph.heads(links, self.head[k][rows], head[cols])
            for reps, old, new in ((a.reps[rows], self.head[k][rows], ha), (b.reps[cols], head[cols], hb)):
                moved = (old != new) & (old != reps)  # a vector that leaves itself says so by its head
                self.joined.update(zip(old[moved].tolist(), new[moved].tolist(), strict=True))
            self.count[k][rows] += links @ b.copies[cols]
            if k != own:
                count[cols] += a.copies[rows] @ links
            self.head[k][rows] = ha
            head[cols] = hb

    def links(self, b: _Block) -> tuple[np.ndarray, np.ndarray]:
        self._ready()
        count, head = np.zeros(len(b.reps), np.int64), b.reps.copy()
        self._meet(b, count, head, None)
        return count, head

    def results(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        self._ready()
        yield from ((b.reps, count, head) for b, count, head in zip(self.blocks, self.count, self.head, strict=True))
        joined = np.array(sorted(self.joined), np.int64).reshape(-1, 2)
        yield joined[:, 0], np.zeros(len(joined), np.int64), joined[:, 1]


def _compare(cosine: float, eps: float, dim: int, kind: str):
    """(owner, partner, seq, lo, hi, reps, copies, vecs), an owner's own blocks first -> (rep, links, head)."""

    def rows(ids: np.ndarray, links: np.ndarray, head: np.ndarray) -> pa.RecordBatch:
        some = (links > 0) | (ids != head)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(v[some], np.int64)) for v in (ids, links, head)], names=["rep", "links", "head"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: _Owner | None = None
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
                if held is None or row[0] != held.group:
                    if held is not None:
                        yield from (rows(*x) for x in held.results())
                    held = _Owner(row[0], cosine, eps, dim)
                block = _Block(row[2:], dim, kind)
                if row[1] == row[0]:
                    held.blocks.append(block)
                else:
                    yield rows(block.reps, *held.links(block))
        if held is not None:
            yield from (rows(*x) for x in held.results())
        common.give_back()

    return run


def _gap(lo: tuple[str, str], hi: tuple[str, str], axes: int) -> object:
    """Squared distance of two boxes (a Column), from array columns."""
    one, two = ([F.col(lo[0])[i], F.col(hi[0])[i]] for i in range(axes)), ([F.col(lo[1])[i], F.col(hi[1])[i]] for i in range(axes))
    return sum((F.pow(F.greatest(a[0] - b[1], b[0] - a[1], F.lit(0.0)), 2) for a, b in zip(one, two, strict=True)), F.lit(0.0))


def _boxes(rows: DataFrame, key: object, axes: int) -> DataFrame:
    """The common box of the boxes (lo, hi) with one key."""
    low = F.array(*[F.min(F.col("lo")[i]) for i in range(axes)])
    high = F.array(*[F.max(F.col("hi")[i]) for i in range(axes)])
    return rows.groupBy(key.alias("seq")).agg(low.alias("lo"), high.alias("hi"))


def interval_pairs(groups: DataFrame, eps: float, axes: int) -> DataFrame:
    """groups (seq, lo, hi) -> (a, b), a <= b: pairs whose boxes are within eps."""
    level = common.written(groups.select("seq", "lo", "hi"), "intervals")
    levels, count = [level], level.count()
    while count > 1:
        level = common.written(_boxes(level, F.floor(F.col("seq") / FAN), axes), "intervals")
        levels.append(level)
        count = -(-count // FAN)
    pairs = levels[-1].select(F.col("seq").alias("a"), F.col("seq").alias("b"))
    for level in reversed(levels[:-1]):
        one = level.select(F.floor(F.col("seq") / FAN).alias("a"), F.col("seq").alias("a_"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"))
        two = level.select(F.floor(F.col("seq") / FAN).alias("b"), F.col("seq").alias("b_"), F.col("lo").alias("blo"), F.col("hi").alias("bhi"))
        below = pairs.join(one, "a").join(two, "b").where((F.col("a_") <= F.col("b_")) & (_gap(("alo", "blo"), ("ahi", "bhi"), axes) <= eps * eps))
        pairs = common.written(below.select(F.col("a_").alias("a"), F.col("b_").alias("b")), "interval-pairs")
    return pairs


def _links(classes: DataFrame, dim: int, cosine: float, kind: str) -> DataFrame:
    """Classes of one length -> (rep, links, head), several rows a vector."""
    spark = classes.sparkSession
    eps = float(np.sqrt(max(0.0, 2 - 2 * cosine)) * (1 + 1e-9) + 1e-9)
    k = min(AXES, dim)
    sampled = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dim)))
    sample = classes.orderBy(F.xxhash64("rep"), "rep").limit(sampled).select("vec").toPandas()["vec"]
    fitted = unit_rows(np.stack([np.frombuffer(v, kind) for v in sample]))
    _, turned = np.linalg.eigh(np.cov(fitted.T, bias=True).reshape(dim, dim))
    axes = np.ascontiguousarray(turned[:, ::-1][:, :k])
    celled = classes.select("rep", "copies", "vec").mapInArrow(_cells(axes, eps, kind), "rep long, copies long, vec binary, cell array<int>, near array<double>")
    ordered = celled.repartitionByRange("cell", "rep").sortWithinPartitions("cell", "rep")
    size = max(16, min(BLOCK_ROWS, BLOCK_BYTES // (8 * dim)))
    blocks = common.written(ordered.mapInArrow(_blocks(size), "part int, at long, lo array<double>, hi array<double>, reps binary, copies binary, vecs binary"), "grid-blocks")
    parts = {r["part"]: r["n"] for r in blocks.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one row a partition
    first, at = {}, 0
    for p in sorted(parts):
        first[p], at = at, at + parts[p]
    # groups: as many as keep the cores busy, more where memory asks for it
    width = max(1, min(-(-at // (2 * spark.sparkContext.defaultParallelism)), GROUP_BYTES // (8 * dim * size)))
    groups = -(-at // width)
    starts = spark.createDataFrame([(p, s) for p, s in first.items()], "part int, start long")
    numbered = blocks.join(F.broadcast(starts), "part").withColumn("seq", F.col("start") + F.col("at"))  # one row a partition
    numbered = numbered.withColumn("group", F.floor(F.col("seq") / width))
    boxes = common.written(_boxes(numbered, F.col("group"), k), "group-boxes")
    pairs = interval_pairs(boxes, eps, k)
    # the pair's owner is the one from which the other is less than half way round: all own about the same number
    far = 2 * (F.col("b") - F.col("a")) > groups
    owned = pairs.select(F.when(far, F.col("b")).otherwise(F.col("a")).alias("owner"), F.when(far, F.col("a")).otherwise(F.col("b")).alias("partner"))
    owned = owned.unionByName(boxes.select(F.col("seq").alias("owner"), F.col("seq").alias("partner"))).distinct()
    owners = boxes.select(F.col("seq").alias("owner"), F.col("lo").alias("olo"), F.col("hi").alias("ohi"))
    met = owned.join(owners, "owner").join(numbered.withColumnRenamed("group", "partner"), "partner").where(_gap(("olo", "lo"), ("ohi", "hi"), k) <= eps * eps)
    rows = met.select("owner", "partner", "seq", "lo", "hi", "reps", "copies", "vecs").repartitionByRange(groups, "owner")
    rows = rows.sortWithinPartitions("owner", F.col("partner") != F.col("owner"), "seq")
    return common.written(rows.mapInArrow(_compare(cosine, eps, dim, kind), "rep long, links long, head long"), "vector-links")


def near_vectors(vectors: DataFrame, cosine: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Per row: id, n_links, component_id, kept."""
    single = vectors.schema[embedding].dataType == T.ArrayType(T.FloatType(), vectors.schema[embedding].dataType.containsNull)
    kind = "<f4" if single else "<f8"
    cast = F.col(embedding).cast("array<float>" if single else "array<double>")
    unit = common.written(vectors.select(F.col(vec_id).cast("long").alias("id"), cast.alias("v")).mapInArrow(_unit(kind), "id long, dim int, k1 long, k2 long, vec binary"), "unit-vectors")
    good = unit.where("dim > 0")
    classes = common.written(good.groupBy("dim", "k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("vec").alias("vec")), "vector-classes")
    found = None
    for row in classes.groupBy("dim").count().orderBy("dim").collect():  # lengths of vectors, a handful
        got = _links(classes.where(F.col("dim") == row["dim"]), row["dim"], cosine, kind)
        found = got if found is None else found.unionByName(got)
    if found is None:
        return unit.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    labels = graph.components(found.select(F.col("rep").alias("a"), F.col("head").alias("b")))
    known = classes.join(links, "rep", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("dim", "k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = unit.select("id", "dim", "k1", "k2").join(known, ["dim", "k1", "k2"], "left")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"), F.coalesce(F.coalesce("component_id", "id") == F.col("id"), F.lit(True)).alias("kept"))
