"""Toxicity scoring (operator 3): a factorization machine over hashed terms.

score = sigmoid(b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), x_i = 1 if a term of slot i occurs in the text. The
pairwise part lets two terms together (an insult with a group's name) weigh more than both alone.

Training takes a bounded sample of labelled rows (`max_rows`, those of the least hash of their id; 12,000 by default):
their distinct slots are made on the executors and fitted on the driver with Adagrad, for a fixed seed, so that the model
depends on the labelled rows only. Terms enter the model if they tell the classes apart in the sample (chi-square of
presence against the label over `screen`, in `min_rows` sampled rows at least), at most `max_terms` of them: a term in
fewer rows tells nothing that chance does not, so very small sets of labels leave the model with its bias alone. The model is some kilobytes and is
broadcast. Scoring covers every row and whole texts.

Defined results: null and empty texts get the score of a text without terms; labels that are null are not trained on; a
document with several labels is toxic if one says so; of several texts under one id the one of the least hash is trained on;
repeated rows are scored alike; without labelled rows of both classes every score is the smoothed share of toxic rows (0.5
without any); an empty table gives no rows; other columns pass through unless they bear the names of results.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TERM = re.compile(r"\w+")
SLOTS = 1 << 20


def slot(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) % SLOTS


@dataclass
class Machine:
    bias: float
    slots: np.ndarray  # sorted
    weights: np.ndarray
    factors: np.ndarray  # slots x rank

    def score(self, rows: np.ndarray) -> float:
        """rows: places of the text's terms in slots."""
        z = self.bias + self.weights[rows].sum()
        v = self.factors[rows]
        z += 0.5 * float((v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(rows: list[np.ndarray], labels: np.ndarray, rank: int = 4, epochs: int = 60, rate: float = 0.4, decay: float = 5e-5, screen: float = 20.0, min_rows: int = 5, max_terms: int = 4096, seed: int = 3) -> Machine:
    """rows: distinct slots of each labelled text."""
    n, pos = len(rows), int(labels.sum())
    empty = Machine(float(np.log((pos + 0.5) / (n - pos + 0.5))), np.empty(0, np.int64), np.empty(0), np.empty((0, rank)))
    if not pos or pos == n:
        return empty
    flat, owner = np.concatenate(rows), np.repeat(np.arange(n, dtype=np.int32), [len(r) for r in rows])
    slots, place = np.unique(flat, return_inverse=True)
    have = np.bincount(place, minlength=len(slots)).astype(float)
    hit = np.bincount(place, weights=labels[owner].astype(float), minlength=len(slots))
    expected = have * pos / n
    chi = (hit - expected) ** 2 / np.maximum(expected * (1 - pos / n) * (1 - have / n), 1e-9)
    good = np.flatnonzero((chi >= screen) & (have >= min_rows))
    good = np.sort(good[np.argsort(-chi[good], kind="stable")[:max_terms]])
    if not len(good):
        return empty
    new = np.full(len(slots), -1)
    new[good] = np.arange(len(good))
    use = new[place] >= 0
    col, own = new[place][use], owner[use]
    starts = np.searchsorted(own, np.arange(n + 1))
    rng = np.random.default_rng(seed)
    b, w, v = empty.bias, np.zeros(len(good)), rng.normal(0, 0.05, (len(good), rank))
    gb, gw, gv = 1e-8, np.full(len(good), 1e-8), np.full((len(good), rank), 1e-8)
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, 64):
            batch = order[at : at + 64]
            size = starts[batch + 1] - starts[batch]
            cols = np.concatenate([col[starts[i] : starts[i + 1]] for i in batch])
            seg = np.repeat(np.arange(len(batch)), size)
            vs = v[cols]
            total = np.zeros((len(batch), rank))
            np.add.at(total, seg, vs)
            squares = np.bincount(seg, weights=(vs**2).sum(axis=1), minlength=len(batch))
            z = b + np.bincount(seg, weights=w[cols], minlength=len(batch)) + 0.5 * ((total**2).sum(axis=1) - squares)
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[batch]) / len(batch)
            grad_w, grad_v = np.zeros_like(w), np.zeros_like(v)
            np.add.at(grad_w, cols, err[seg])
            np.add.at(grad_v, cols, err[seg][:, None] * (total[seg] - vs))
            seen = np.unique(cols)
            grad_w[seen] += decay * w[seen]
            grad_v[seen] += 20 * decay * v[seen]
            gb, gw, gv = gb + err.sum() ** 2, gw + grad_w**2, gv + grad_v**2
            b -= rate * err.sum() / np.sqrt(gb)
            w -= rate * grad_w / np.sqrt(gw)
            v -= 0.1 * rate * grad_v / np.sqrt(gv)
    return Machine(float(b), slots[good], w, v)


def held_out(doc_id) -> object:
    """The fold that training never sees (a Column)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _slots_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [sorted({slot(x) for x in TERM.findall(t.lower())}) if t else [] for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(got, pa.list_(pa.int32()))], names=["id", "y", "slots"])


def distinct(rows: list[np.ndarray]) -> np.ndarray:
    """Places of rows without the later ones of those that share two minima of their slots: (near) copies of one text
    would otherwise lend their other words weight."""
    pair = [(int((r.astype(np.int64) * 2654435761 % (1 << 32)).min()), int((r.astype(np.int64) * 2246822519 % (1 << 32)).min())) if len(r) else (-1, i) for i, r in enumerate(rows)]
    return np.sort(np.unique(np.array(pair, np.int64).reshape(-1, 2), axis=0, return_index=True)[1])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Machine:
    """Fitted on labelled rows outside the held-out fold."""
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).where("y is not null and id is not null").where(~held_out(F.col("id")))
    sample = known.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64(F.lit(5), "id"), "id").limit(max_rows)
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).join(F.broadcast(sample), "id").select("id", "t", "y")  # max_rows bounds it
    one = texts.groupBy("id").agg(F.min_by("t", F.xxhash64("t")).alias("t"), F.max("y").alias("y"))
    got = one.select("id", "t", "y").mapInArrow(_slots_of, "id long, y int, slots array<int>").toArrow().sort_by("id")
    slots = got["slots"].combine_chunks() if got.num_rows else None
    rows = np.split(slots.flatten().to_numpy(), slots.offsets.to_numpy()[1:-1] - slots.offsets[0].as_py()) if got.num_rows else []
    keep = distinct(rows)
    return fit([rows[i] for i in keep], got["y"].to_numpy().astype(np.int64)[keep]) if got.num_rows else Machine(0.0, np.empty(0, np.int64), np.empty(0), np.empty((0, 1)))


def score(docs: DataFrame, machine: Machine, text: str = "text") -> DataFrame:
    """docs with score."""
    docs = docs.drop("score")
    names, at = [*docs.columns, "score"], docs.columns.index(text)
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        where = {int(s): i for i, s in enumerate(m.slots)}
        known: dict[str, int] = {}

        def place(term: str) -> int:
            got = known.get(term)
            if got is None:
                if len(known) >= 200_000:
                    known.clear()
                got = known[term] = where.get(slot(term), -1)
            return got

        for big in batches:
            for start in range(0, big.num_rows, 1000):
                b = big.slice(start, 1000)
                out = []
                for t in b.column(at).to_pylist():
                    rows = set(map(place, set(TERM.findall(t.lower())))) if t else set()
                    rows.discard(-1)
                    out.append(m.score(np.array(sorted(rows), np.int64)))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], names=names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))
