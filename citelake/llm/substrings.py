"""Substring dedup (operator 2): a log-structured index of window fingerprints.

A window is `size` consecutive words. Storing the fingerprint of every window would cost many times the text, so the
index keeps, for each text, the distinct minimizers of its windows: the least hash among a window's `size` - 7 eight-word
grams. Equal windows have equal minimizers, so only windows whose minimizer occurs in two texts (or whose sequence
repeats inside its own text) can be repeated; no other window needs a look.

Each batch of documents becomes immutable runs, hash-bucketed and sorted: minimizer rows and the new texts, each once. A
new batch is merge-joined with itself and with every older run (sort-merge joins over the buckets, no exchange). What
matches is verified: the windows in question are taken from the texts and fingerprinted by 128 bits (two hashes of doubled blocks
over two independent word hashes, each an injective or xxh3 hash of the word's bytes); in each fingerprint the first place by
(batch, doc_id, start) wins and every other place is a repeat. More than `max_runs` runs of a kind are merged into one
(compaction), with more buckets once the texts have outgrown theirs. Runs lie in the index's folder and a manifest names
them, so `FingerprintIndex.open` goes on in another session; a batch that fails leaves the manifest, and so the index, as it
was. Runs that a compaction has replaced stay until `vacuum`, since results of earlier batches may not have been read yet.

Groups of exact copies are one text, known by 128 bits (t, u): a later copy's windows all start earlier in the first, so a
copy of at least `size` words loses all of them.

Defined results: null and empty texts have no words; rows with a null id come before all others; repeated rows (same id,
same text) are one document and get the same result; different texts with one id are separate texts in the order of
their hashes; an empty batch adds nothing; the results have columns of their own and name no other column.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .common import WORD

GRAM = 8
NO_ID = -(1 << 63)
#: Text bytes a bucket of the index is made for, and about how many of them a byte of its files holds.
BUCKET_BYTES, PACKED = 64 << 20, 3
#: Texts that a task remembers on the way to their buckets; beyond them it starts anew.
REMEMBERED = 1_000_000
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def rolled(w: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    """Polynomial hash of every n consecutive words, by doubling."""
    power, part, length, out, done = base, w, 1, None, 0
    while True:
        if n & length:
            if out is None:
                out = part
            else:  # the words before, moved up, and this part after them
                tail = part[done : done + max(0, len(w) - done - length + 1)]
                out = out[: len(tail)] * power + tail
            done += length
        if done == n:
            return out
        part = part[: max(0, len(part) - length)] * power + part[length:]
        power, length = power * power, length * 2


def blocks_hashed(w: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    """Hash of every n consecutive words by doubled blocks: each joint of two blocks goes through an invertible mix, with a
    factor of its own, so words that stand in another order give another hash however regular they are (a polynomial modulo
    2^64 takes some long sequences of two words for each other)."""
    part, length, out, done = w, 1, None, 0
    joint = lambda a, b, k: common.mix(a * (base + np.uint64(2 * k)) + b)
    while True:
        if n & length:
            if out is None:
                out = part
            else:
                tail = part[done : done + max(0, len(w) - done - length + 1)]
                out = joint(out[: len(tail)], tail, n + length)
            done += length
        if done == n:
            return out
        part, length = joint(part[: max(0, len(part) - length)], part[length:], length), length * 2


def with_owner(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Values that also depend on the text they are from."""
    with np.errstate(over="ignore"):
        return common.mix(values ^ common.mix(owner.astype(np.uint64) * _Q + _P))


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    known = np.sort(known)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values if len(known) else np.zeros(len(values), bool)


class Windows:
    """The windows of several texts at once: words of all texts in one array, windows over a text's end left out."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, size: int):
        self.found = common.Words(data)
        self.words = self.found.hashes()
        owner = np.searchsorted(starts, self.found.first, side="right") - 1
        n = max(0, len(owner) - size + 1)
        self.at = np.flatnonzero(owner[:n] == owner[size - 1 :]) if n else np.empty(0, np.int64)
        self.owner = owner[self.at]
        self.pos = self.at - np.searchsorted(owner, self.owner)
        self.size = size

    def minimizers(self) -> np.ndarray:
        """For every window the least gram hash in it."""
        if not len(self.at):
            return np.empty(0, np.uint64)
        with np.errstate(over="ignore"):
            least = common.mix(rolled(self.words, GRAM, _Q))
        span, have = self.size - GRAM + 1, 1
        while have < span:
            step = min(have, span - have)
            least = np.minimum(least[: len(least) - step], least[step:])
            have += step
        return least[self.at]

    def fingerprints(self, second: bool = False) -> np.ndarray:
        if not len(self.at):
            return np.empty(0, np.uint64)
        with np.errstate(over="ignore"):
            w, base = (self.found.hashes(1), _Q) if second else (self.words, _P)
            return common.mix(blocks_hashed(w, self.size, base))[self.at]


def _some_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(t, u, text) without most repeats inside a task: copies meet here before anything moves."""
    seen: set = set()
    for b in batches:
        if len(seen) >= REMEMBERED:
            seen.clear()
        keep = []
        for key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            keep.append(key not in seen)
            seen.add(key)
        yield b.filter(pa.array(keep, pa.bool_()))
    common.give_back()


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(t, u, text) sorted by all three, nulls first -> each text once; none where the first row is null (a known text)."""
    last = None
    for b in batches:
        keep = []
        for key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            keep.append(key != last)
            last = key
        yield b.filter(pc.and_(pa.array(keep, pa.bool_()), pc.is_valid(b.column(2))))
    common.give_back()


def _grams(size: int):
    """(t, u, text) -> (m, t, u, own): distinct minimizers; own: a window of that minimizer repeats inside the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b, data, starts in common.text_slices(big, 2):
                w = Windows(data, starts, size)
                if not len(w.at):
                    continue
                m, t, u = w.minimizers(), b.column(0).to_numpy(), b.column(1).to_numpy()
                own = with_owner(w.fingerprints(), w.owner)
                _, inverse, count = np.unique(own, return_inverse=True, return_counts=True)
                twice = count[inverse] > 1
                key = with_owner(m, w.owner)
                _, some = np.unique(key, return_index=True)
                repeats = among(key[some], key[twice])
                o = w.owner[some]
                yield pa.RecordBatch.from_arrays([pa.array(m[some].view(np.int64)), pa.array(t[o]), pa.array(u[o]), pa.array(repeats)], names=["m", "t", "u", "own"])
        common.give_back()

    return run


def _windows(size: int, newest: int):
    """(t, u, text, marks, batch, cid) -> the windows whose minimizers are marked. Of equal fingerprints in one slice of
    texts only the first place may be the first of all; the others are repeats for certain (`again`) and need not meet
    anywhere: they get keys of their own (those of older batches, whose fate is settled, are left out), so a passage that
    very many documents share sends one row a slice to its fingerprint's task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b, data, starts in common.text_slices(big, 2):
                w, marks = Windows(data, starts, size), b.column(3)
                owner = np.repeat(np.arange(b.num_rows), np.diff(marks.offsets.to_numpy()))
                keep = among(with_owner(w.minimizers(), w.owner), with_owner(marks.flatten().to_numpy().view(np.uint64), owner))
                if keep.any():
                    h, c = w.fingerprints()[keep], w.fingerprints(True)[keep]
                    pos, o = w.pos[keep].astype(np.int32), w.owner[keep]
                    place = [b.column(k).to_numpy()[o] for k in (4, 5, 0, 1)]
                    order = np.lexsort((pos, *place[::-1], c, h))
                    h, c, pos, place = h[order], c[order], pos[order], [v[order] for v in place]
                    again = np.zeros(len(h), bool)
                    again[1:] = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
                    h[again] = common.mix(place[2][again].view(np.uint64) ^ common.mix(pos[again].astype(np.uint64)))
                    stay = ~again | (place[0] == newest)
                    yield pa.RecordBatch.from_arrays([pa.array(v[stay]) for v in (h.view(np.int64), c.view(np.int64), *place, pos, again)], names=["h", "c", "batch", "cid", "t", "u", "pos", "again"])
        common.give_back()

    return run


def _cut(size: int):
    """(t, u, text, starts of repeated windows) -> (t, u, n_words, n_removed, kept_text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 200):
                b = big.slice(at, 200)
                total, gone, kept = [], [], []
                for text, starts in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                    words = WORD.findall(text or "")
                    total.append(len(words))
                    if starts:
                        edge = np.zeros(len(words) + 1, np.int32)
                        s = np.array(starts)
                        np.add.at(edge, s, 1)
                        np.add.at(edge, s + size, -1)
                        stay = np.cumsum(edge[:-1]) == 0
                        words = [x for x, ok in zip(words, stay.tolist(), strict=True) if ok]
                    gone.append(total[-1] - len(words))
                    kept.append(" ".join(words))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["t", "u", "n_words", "n_removed", "kept_text"])
        common.give_back()

    return run


@dataclass
class Run:
    """An immutable run: its folder, under the index's, and its rows."""

    name: str
    rows: DataFrame


#: Kinds of runs: columns, and the columns they are bucketed and sorted by.
KINDS = {
    "grams": ("m long, t long, u long, own boolean", ("m",)),
    "texts": ("t long, u long, text string", ("t", "u")),
    "classes": ("t long, u long, cid long, batch int", ("t", "u")),
}
TEXT = ["t", "u"]


class FingerprintIndex:
    """The index of all batches so far. add() takes the next batch of documents."""

    def __init__(self, spark: SparkSession, size: int = 20, max_runs: int = 4, buckets: int | None = None, path: str | None = None):
        if size < GRAM:
            raise ValueError(f"windows have {GRAM} words at least")
        self.spark, self.size, self.max_runs = spark, size, max_runs
        self.buckets = buckets  # None: from the first batch's size
        self.path = path or common.stage_path(spark, "fingerprint-index")
        self.batches = self.version = 0
        self.runs: dict[str, list[Run]] = {kind: [] for kind in KINDS}

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> FingerprintIndex:
        """The index in a folder, as its newest manifest says."""
        fs = spark.sparkContext._jvm.org.apache.hadoop.fs
        pattern = fs.Path(f"{path}/manifest-*/_SUCCESS")
        found = [x.getPath().getParent().toString() for x in pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)]
        if not found:
            raise FileNotFoundError(f"no fingerprint index in {path}")
        state = json.loads(spark.read.text(max(found)).first()["value"])
        index = cls(spark, state["size"], state["max_runs"], state["buckets"], path)
        index.batches, index.version = state["batches"], state["version"]
        for kind, names in state["runs"].items():
            index.runs[kind] = [index._open(kind, name) for name in names]
        return index

    def _save(self) -> None:
        self.version += 1
        state = {"size": self.size, "max_runs": self.max_runs, "buckets": self.buckets, "batches": self.batches, "version": self.version, "runs": {k: [r.name for r in v] for k, v in self.runs.items()}}
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.text(f"{self.path}/manifest-{self.version:08d}")

    def _open(self, kind: str, name: str) -> Run:
        return Run(name, common.open_run(self.spark, f"{self.path}/runs/{name}", *KINDS[kind], self.buckets))

    def _write(self, kind: str, rows: DataFrame) -> Run:
        name = f"{kind}-{uuid.uuid4().hex}"
        common.run_table(rows, f"{self.path}/runs/{name}", KINDS[kind][1], self.buckets)
        return self._open(kind, name)

    def _known(self, kind: str) -> list[DataFrame]:
        """Rows of all runs of a kind. Keys are never null; the filter makes rows of the scans' column batches, since Spark 4.1's
        union of column batches claims that buckets coincide but sets them one after the other."""
        return [run.rows.where(f"{KINDS[kind][1][0]} is not null") for run in self.runs[kind]]

    def add(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
        """(members, results): members has a row per row of docs (id, t, u, copy: whether the text was there before);
        results has a row per new text (t, u, n_words, n_removed, kept_text)."""
        size, n = self.size, self.batches
        whole = F.coalesce(F.col(text), F.lit(""))
        t, u = common.text_key(F.col(text))
        rows = docs.select(F.col(doc_id).cast("long").alias("id"), t.alias("t"), u.alias("u"), whole.alias("text"))
        if self.buckets is None:
            size_sum = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
            self.buckets = max(2 * self.spark.sparkContext.defaultParallelism, -(-size_sum // BUCKET_BYTES))
        order = F.coalesce("id", F.lit(NO_ID))
        found = rows.groupBy(*TEXT).agg(F.min(order).alias("cid")).withColumn("batch", F.lit(n))
        known = reduce(DataFrame.unionByName, self._known("classes")) if n else None
        if known is not None:
            found = found.join(known.select(*TEXT), TEXT, "left_anti")
        new = self._write("classes", found.repartition(self.buckets, *TEXT))
        firsts = new.rows if known is None else known.unionByName(new.rows)
        members = rows.select("id", *TEXT).join(firsts, TEXT).select("id", *TEXT, ((F.col("batch") < n) | (F.coalesce("id", F.lit(NO_ID)) != F.col("cid"))).alias("copy"))

        whole_texts = rows.select(*TEXT, "text").mapInArrow(_some_copies, KINDS["texts"][0])
        if known is not None:
            whole_texts = whole_texts.unionByName(known.select(*TEXT, F.lit(None).cast("string").alias("text")))
        dealt = whole_texts.repartition(self.buckets, *TEXT).sortWithinPartitions(*TEXT, F.col("text").isNotNull())
        body = self._write("texts", dealt.mapInArrow(_once, KINDS["texts"][0]))
        grams = self._write("grams", body.rows.mapInArrow(_grams(size), KINDS["grams"][0]).repartition(self.buckets, "m"))
        placed = common.written(self._matches(grams.rows).join(firsts, TEXT), "marked-texts")
        schema = "h long, c long, batch int, cid long, t long, u long, pos int, again boolean"
        made = [b.join(placed, TEXT).select(*TEXT, "text", "marks", "batch", "cid").mapInArrow(_windows(size, n), schema) for b in [*self._known("texts"), body.rows]]
        # the first place of a fingerprint is the first row of its sorted stretch: one exchange, no join, no buffer
        nth = F.row_number().over(Window.partitionBy("h", "c").orderBy("again", "batch", "cid", "t", "u", "pos"))
        later = reduce(DataFrame.unionByName, made).withColumn("nth", nth).where((F.col("again") | (F.col("nth") > 1)) & (F.col("batch") == n))
        starts = common.written(later.groupBy(*TEXT).agg(F.collect_list("pos").alias("starts")), "repeats")
        common.discard(placed)
        results = body.rows.join(starts, TEXT, "left").select(*TEXT, "text", "starts").mapInArrow(_cut(size), "t long, u long, n_words long, n_removed long, kept_text string")
        for kind, run in (("classes", new), ("texts", body), ("grams", grams)):
            self.runs[kind].append(run)
        self.batches += 1
        if len(self.runs["grams"]) > self.max_runs:
            self.compact()
        else:
            self._save()
        return members, results

    def _matches(self, grams: DataFrame) -> DataFrame:
        """(t, u, marks) of all texts, new or old, that share a minimizer with a new text, or repeat a window themselves."""
        spread = [f(c).alias(f"{side}_{c}") for c in TEXT for side, f in (("lo", F.min), ("hi", F.max))]
        mine = grams.groupBy("m").agg(*spread, F.max("own").alias("own"))
        hits, marks = [mine.where("lo_t <> hi_t or lo_u <> hi_u or own").select("m")], []
        for run in self._known("grams"):
            both = run.join(mine.select("m"), "m", "left_semi")
            marks.append(both.select(*TEXT, "m"))
            hits.append(both.select("m"))
        all_hits = hits[0] if len(hits) == 1 else reduce(DataFrame.unionByName, hits).distinct()
        marks.append(grams.join(all_hits, "m", "left_semi").select(*TEXT, "m"))
        return reduce(DataFrame.unionByName, marks).groupBy(*TEXT).agg(F.collect_list("m").alias("marks"))

    def _path(self, name: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/runs/{name}")
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def compact(self) -> None:
        """Merge all runs of each kind into one and write the manifest that names them. As many more buckets are made as the
        texts' files have outgrown theirs."""
        old, held = self.buckets, 0
        for run in self.runs["texts"]:
            where, system = self._path(run.name)
            held += system.getContentSummary(where).getLength()
        while self.buckets * BUCKET_BYTES < held * PACKED:
            self.buckets *= 2
        merged = {kind: reduce(DataFrame.unionByName, self._known(kind)).repartition(self.buckets, *keys) for kind, (_, keys) in KINDS.items()}
        try:
            self.runs = {kind: [self._write(kind, rows)] for kind, rows in merged.items()}
        except BaseException:
            self.buckets = old
            raise
        self._save()

    def vacuum(self) -> list[str]:
        """Remove the runs that no manifest names any more: those that compactions have replaced, in whatever session, and
        those of batches that failed. Results of earlier batches must have been read. Names what went."""
        kept = {run.name for runs in self.runs.values() for run in runs}
        where, system = self._path("*")
        gone = sorted(name for x in system.globStatus(where) or [] if (name := x.getPath().getName()) not in kept)
        for name in gone:
            common.remove(self.spark, f"{self.path}/runs/{name}")
        return gone


def remove_repeats(docs: DataFrame, size: int = 20, batches: int = 2, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """All documents through a fresh index, in `batches` batches of ascending ids: members and results as add() gives
    them. Null ids go first."""
    index = FingerprintIndex(docs.sparkSession, size)
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))
    cuts = docs.select(key.alias("k")).agg(F.percentile_approx("k", [i / batches for i in range(1, batches)])).first()[0] if batches > 1 else []
    edges = [None, *sorted(set(cuts or [])), None]
    got = []
    for low, high in zip(edges, edges[1:], strict=False):
        some = docs
        if low is not None:
            some = some.where(key > low)
        if high is not None:
            some = some.where(key <= high)
        got.append(index.add(some, doc_id, text))
    return reduce(DataFrame.unionByName, [m for m, _ in got]), reduce(DataFrame.unionByName, [r for _, r in got])
