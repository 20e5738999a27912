"""Benchmark decontamination (operator 10): rare n-gram seeds, then Smith-Waterman alignment.

Test items are read in blocks of bounded size (`block_words`), each broadcast. A first pass counts how often each
three-word gram of the items occurs in the corpus (all documents, summed on the map side; one row a gram). A copy in which
at most every fifth word is changed, left out or put in keeps a stretch of at least seeds.intact() words; of as many
consecutive grams as fit in it, the rarest that occurs becomes a seed, so every such copy holds a seed, and no frequent
phrase is one while a rarer neighbour can stand in. Items under `short` words take all grams that occur, which finds most
copies with more insertions than that; items too short to keep three words use grams of two, or one. The second pass
aligns the item with the text around each seed's diagonal (match +2, mismatch -1, gap -1, local; rows between checkpoints
are made again on the way back, so that memory grows with the square root of an item's length); similarity is the share of
the item's words that the best alignment matches.

Defined results: null and empty texts have no hits, nor do null items or items without words; repeated rows and ties are
each reported (an item once a row, at its first best place); an empty table on either side gives no hits; other columns
pass through, whatever their names, unless they bear the name of the result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .seeds import SeedIndex, terms

GRAM, SHORT, SLACK = 3, 30, 0.25
HIT = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("similarity", T.DoubleType()), T.StructField("score", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType())])
HIT_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("score", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64())]))


def _row(above: np.ndarray, word: int, part: np.ndarray, ramp: np.ndarray) -> np.ndarray:
    """The next row of the alignment's scores."""
    row = np.zeros(len(above), np.int32)
    np.maximum(above[:-1] + np.where(part == word, 2, -1), above[1:] - 1, out=row[1:])
    np.maximum(row, 0, out=row)
    return np.maximum.accumulate(row + ramp) - ramp  # gaps along the row


def smith_waterman(item: np.ndarray, part: np.ndarray) -> tuple[int, int, int, int]:
    """(score, matches, first, last) of the best local alignment; first and last are places in part."""
    n, m = len(item), len(part)
    ramp, step = np.arange(m + 1, dtype=np.int32), max(16, int(n**0.5))
    row, kept = np.zeros(m + 1, np.int32), []
    score, i, j = 0, 0, 0
    for k in range(n):
        if k % step == 0:
            kept.append(row)
        row = _row(row, item[k], part, ramp)
        top = int(row.argmax())
        if row[top] > score:
            score, i, j = int(row[top]), k + 1, top
    last, matches, start, rows = j - 1, 0, n + 1, []
    while i and j:
        if i - 1 < start:  # rows start .. i
            start = (i - 1) // step * step
            rows = [kept[start // step]]
            for k in range(start, i):
                rows.append(_row(rows[-1], item[k], part, ramp))
        here, above = rows[i - start], rows[i - start - 1]
        if here[j] <= 0:
            break
        same = item[i - 1] == part[j - 1]
        if here[j] == above[j - 1] + (2 if same else -1):
            matches += int(same)
            i, j = i - 1, j - 1
        elif here[j] == above[j] - 1:
            i -= 1
        else:
            j -= 1
    return score, matches, j, last


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_words: int) -> Iterator[list[tuple[int, list[str]]]]:
    """The items in blocks of about block_words words each."""
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).where("t is not null and i is not null")
    total = items.agg(F.sum(F.size(F.split("t", r"\s+")))).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).collect()
        yield sorted((r["i"], terms(r["t"])) for r in rows)


def with_hits(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, block_words: int = 1_000_000, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs with hits: array of (item_id, similarity, score, first_word, last_word)."""
    out, found = docs.drop("hits"), None
    at = out.columns.index(text)
    sc = docs.sparkSession.sparkContext
    result, taken = out, {c.lower() for c in out.columns}
    for number, block in enumerate(_blocks(benchmark, item_id, item_text, block_words)):
        items = [(i, w) for i, w in block if w]
        index = SeedIndex([w for _, w in items], GRAM, least)
        sent = sc.broadcast(([i for i, _ in items], index))

        def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            _, index = sent.value
            seen: Counter[int] = Counter()
            for b in batches:
                for t in b.column(0).to_pylist():
                    seen.update(index.occurrences(index.ids(terms(t)), index.codes)[1].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["code", "n"])

        counts = docs.select(text).mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
        rare = index.rare({r["code"]: r["n"] for r in counts.collect()}, SHORT)  # at most one row a gram of this block
        chosen = sc.broadcast(rare)
        name = next(x for x in (f"hits_{number}" + "_" * k for k in range(len(taken) + 1)) if x not in taken)

        def align(batches: Iterator[pa.RecordBatch], sent=sent, chosen=chosen) -> Iterator[pa.RecordBatch]:
            (names, index), among = sent.value, chosen.value
            for big in batches:
                for start in range(0, big.num_rows, 500):
                    b = big.slice(start, 500)
                    hits = []
                    for t in b.column(at).to_pylist():
                        ids, got = index.ids(terms(t)), []
                        for item, parts in sorted(index.windows(ids, among, SLACK).items()):
                            size, best = len(index.coded[item]), None
                            for lo, hi in parts:
                                part = ids[lo:hi]
                                if index.shared(item, part) < least * size:
                                    continue
                                score, matches, first, last = smith_waterman(index.coded[item], part)
                                if matches >= least * size - 1e-9 and (best is None or (matches, score) > (best[1], best[0])):
                                    best = (score, matches, lo + first, lo + last)
                            if best:
                                got.append({"item_id": names[item], "similarity": best[1] / size, "score": best[0], "first_word": best[2], "last_word": best[3]})
                        hits.append(got)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hits, HIT_ARROW)], names=[*b.schema.names, name])

        result = result.mapInArrow(align, T.StructType([*result.schema.fields, T.StructField(name, T.ArrayType(HIT))]))
        found = [*(found or []), name]
    return result.withColumn("hits", F.concat(*found)).drop(*found)
