"""MinHash near-dedup with b-bit signatures (operator 9).

1. One pass over whole texts gives each document's shingle set as sorted 64-bit hashes, 210 minima, 42 band keys of 5
   minima each and the low 4 bits of 208 minima, packed in 13 longs. Documents with equal sets are one class, known by
   its smallest id, so groups of exact copies cost one row each map task.
2. Candidates are classes that share a band key. In each bucket one class leads (the one whose buckets are largest: the
   middle of its group), and each other member is paired with it, so a bucket of n gives n - 1 pairs. A pair goes on if
   the collision-corrected estimate from the packed bits, (m - c) / (1 - c) with c = 1/16, is 0.3 or more.
3. Such pairs are measured on full sets. That gives the links with leaders, and what of the leader's set a member lacks
   and adds. Members too far from the leader to be measured form the bucket's rest, together with measured ones that may
   still be near them (similarity is one minus a metric), and the rest gets a leader of its own. What two leaders leave is compared pair by
   pair on packed bits, in blocks; it is chance company (documents that share a line), of which little passes.
4. Where the members of one leader still form several components, the links between these are found exactly from what
   members lack and add: |X and Y| = |L| - |lacks X or Y| + |adds X and Y|. Pairs inside a component are skipped, since
   they change nothing; large groups are compared in blocks; only a spanning forest of links is handed on.

A pair at similarity 0.8 shares no band with probability (1 - 0.8^5)^42 = 6e-8; more similar pairs far less.

Defined results: null and empty texts have an empty set, link with nothing and stay; rows with a null id link with
nothing and stay (component null); repeated rows get the same result, and each text of an id that stands on several gets its
own; ties do not matter, as the smallest id stays;
an empty table gives no rows; the result has columns of its own and names no other column. Shingles are compared by
64-bit hashes (of word hashes that are injective or xxh3, see common.Words): two sets of a million shingles show a wrong
common one with probability 5e-8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, graph

BANDS, ROWS = 42, 5
#: Least estimate for a measurement; a class estimated below is less similar than AGAIN (five standard deviations more).
NEAR, AGAIN = 0.3, 0.5
#: Leaders tried in a bucket, and how far below the threshold an estimate may be (five standard deviations).
ROUNDS, MARGIN = 2, 0.15
K = BANDS * ROWS
PACKED = K // 16 * 16
_A = np.random.default_rng(20240607).integers(1, 2**63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Members and bytes of a block of a large group; columns of a matrix.
BLOCK, BLOCK_BYTES, COLUMNS = 512, 16 << 20, 4096


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; a text of fewer words is one shingle."""
    w = common.Words(common.ascii_lower(np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8))).hashes()
    if not len(w):
        return w
    n = min(width, len(w))
    out = np.full(len(w) - n + 1, n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = common.mix(out * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - n + 1 + i])
    return np.unique(out)


def minima(s: np.ndarray) -> np.ndarray:
    least = np.full(K, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 2048):
        np.minimum(least, (s[i : i + 2048, None] * _A).min(axis=0), out=least)
    return least


def packed_bits(least: np.ndarray) -> np.ndarray:
    low = (least[:PACKED] >> np.uint64(16)) & np.uint64(15)
    return np.bitwise_or.reduce(low.reshape(-1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=1)


def _signed(values) -> np.ndarray:
    return np.ascontiguousarray(values, dtype=np.uint64).view(np.int64)


def signatures(docs: DataFrame, width: int, doc_id: str, text: str) -> DataFrame:
    """(id, t1, t2, n, s1, s2, bands, bits); t1 and t2 stand for the text, s1 and s2 for the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple] = {}

        def one(t: str | None):
            key = xxhash.xxh3_128_digest((t or "").encode("utf-8", "surrogatepass"))
            if key not in known:
                if len(known) >= 5_000:
                    known.clear()
                s = shingles(t, width)
                if len(s):
                    least = minima(s)
                    rows = least.reshape(BANDS, ROWS)
                    key_of = np.arange(BANDS, dtype=np.uint64)
                    for i in range(ROWS):
                        key_of = common.mix(key_of * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
                    d = _digest(s)
                    known[key] = (len(s), int(d[0]), int(d[1]), _signed(key_of), _signed(packed_bits(least)))
                else:
                    known[key] = (0, 0, 0, None, None)
            return known[key]

        for big in batches:
            for start in range(0, big.num_rows, 1000):
                b = big.slice(start, 1000)
                got = [one(t) for t in b.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[:3], *(pa.array([g[i] for g in got], pa.int64()) for i in range(3)), *(pa.array([g[i] for g in got], pa.list_(pa.int64())) for i in (3, 4))],
                    names=["id", "t1", "t2", "n", "s1", "s2", "bands", "bits"],
                )
        known.clear()
        common.give_back()

    one_, two = common.text_key(F.col(text))
    return docs.select(F.col(doc_id).cast("long").alias("id"), one_.alias("t1"), two.alias("t2"), F.col(text).alias("t")).mapInArrow(run, "id long, t1 long, t2 long, n long, s1 long, s2 long, bands array<long>, bits array<long>")


def estimate(a: Column, b: Column) -> Column:
    """Similarity from packed low bits, corrected for chance collisions of 4 bits."""
    one = F.lit(0x1111111111111111)

    def differing(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2))
        return F.bit_count(z.bitwiseAND(one)).cast("long")

    other = F.aggregate(F.zip_with(a, b, differing), F.lit(0).cast("long"), lambda s, x: s + x)
    same = 1 - other / PACKED
    return (same - 1 / 16) / (1 - 1 / 16)


def _estimated(pairs: DataFrame, cls: DataFrame) -> DataFrame:
    """Pairs (lead, rep) of classes whose packed bits say 0.3 or more."""
    x = cls.select(F.col("rep").alias("lead"), F.col("bits").alias("xa"))
    y = cls.select("rep", F.col("bits").alias("xb"))
    return pairs.join(x, "lead").join(y, "rep").where(estimate(F.col("xa"), F.col("xb")) >= NEAR).select("lead", "rep")


def _digest(s: np.ndarray) -> np.ndarray:
    return np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)


def _sets(docs: DataFrame, reps: DataFrame, width: int, doc_id: str, text: str) -> DataFrame:
    """(id, s) for the classes (rep, s1): full sets, made from the texts once. The join is a merge join at every size, so
    that texts move once and never more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for big in batches:
            for start in range(0, big.num_rows, 256):
                b = big.slice(start, 256)
                ids, sets = [], []
                for i, t, s1 in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                    s = shingles(t, width) if i != last else np.empty(0, np.uint64)
                    if len(s) and int(_digest(s)[0]) == s1:  # repeated rows of a class lie side by side: the first counts
                        last = i
                        ids.append(i), sets.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], names=["id", "s"])

    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t"))
    return texts.join(reps.select(F.col("rep").alias("id"), "s1").hint("merge"), "id").select("id", "t", "s1").mapInArrow(run, "id long, s binary")


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(lead, rep) -> with full sets: sizes, size of the intersection, lacks (bits over the lead's sorted set) and adds."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for start in range(0, big.num_rows, 500):
                b = big.slice(start, 500)
                sizes, own, both, lacks, adds = [], [], [], [], []
                for p, q in zip(b.column(2), b.column(3), strict=True):
                    x, y = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                    there = np.minimum(np.searchsorted(y, x), len(y) - 1)
                    has = y[there] == x
                    extra = np.ones(len(y), bool)
                    extra[there[has]] = False
                    sizes.append(len(x)), own.append(len(y)), both.append(int(has.sum()))
                    lacks.append(np.packbits(~has).tobytes()), adds.append(y[extra].tobytes())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(v, pa.int64()) for v in (sizes, own, both)), *(pa.array(v, pa.binary()) for v in (lacks, adds))], names=["lead", "rep", "size", "n", "both", "lacks", "adds"])

    left = pairs.join(sets.select(F.col("id").alias("lead"), F.col("s").alias("sa")), "lead")
    full = left.join(sets.select(F.col("id").alias("rep"), F.col("s").alias("sb")), "rep").select("lead", "rep", "sa", "sb")
    return full.mapInArrow(compare, "lead long, rep long, size long, n long, both long, lacks binary, adds binary")


def _features(lacks: list[bytes], adds: list[bytes], size: int) -> Iterator[np.ndarray]:
    """0/1 matrices of bounded width, side by side: what each member lacks of the leader's set (where any does), then what
    at least two members add."""
    packed = np.frombuffer(b"".join(lacks), np.uint8).reshape(len(lacks), -1)
    some = np.flatnonzero(np.bitwise_or.reduce(packed, axis=0))
    for at in range(0, len(some), COLUMNS // 8):
        yield np.unpackbits(packed[:, some[at : at + COLUMNS // 8]], axis=1).astype(np.float32)
    owner = np.repeat(np.arange(len(adds)), [len(a) // 8 for a in adds])
    values, column, count = np.unique(np.frombuffer(b"".join(adds), np.uint64), return_inverse=True, return_counts=True)
    new = np.cumsum(count > 1) - 1
    use = (count > 1)[column]
    rows, columns = owner[use], new[column[use]]
    for at in range(0, int((count > 1).sum()), COLUMNS):
        part = (columns >= at) & (columns < at + COLUMNS)
        two = np.zeros((len(adds), COLUMNS), np.float32)
        two[rows[part], columns[part] - at] = 1
        yield two


def _linked(group: dict[str, list], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(rep, head): a spanning forest of the links between different components of block i and block j."""
    rep, comp, n, block, both = (np.array(group[c], np.int64) for c in ("rep", "comp", "n", "block", "both"))
    size = group["size"][0]
    missing = size - both
    kinds, counts = np.unique(comp, return_counts=True)
    usual = comp == kinds[counts.argmax()]
    p, q = block == group["i"][0], block == group["j"][0]
    sides = [(np.flatnonzero(a), np.flatnonzero(b)) for a, b in ((p & ~usual, q), (p & usual, q & ~usual))]
    sides = [(a, b, np.zeros((len(a), len(b)), np.float32)) for a, b in sides if len(a) and len(b)]
    for f in _features(group["lacks"], group["adds"], size) if sides else ():
        for rows, cols, shared in sides:
            shared += f[rows] @ f[cols].T
    out_a, out_b = [], []
    for rows, cols, shared in sides:
        common_size = size - missing[rows][:, None] - missing[cols][None, :] + shared
        links = 100 * common_size >= percent * (n[rows][:, None] + n[cols][None, :] - common_size)
        links &= comp[rows][:, None] != comp[cols][None, :]
        if links.any():
            a, b = graph.heads(links, rep[rows], rep[cols])
            out_a += [rep[rows][links.any(axis=1)], rep[cols][links.any(axis=0)]]
            out_b += [a[links.any(axis=1)], b[links.any(axis=0)]]
    if not out_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(out_a), np.concatenate(out_b)


def _near_pairs(group: dict[str, list], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): pairs between block i and block j whose packed bits and sizes allow a link."""
    rep, n, block = (np.array(group[c], np.int64) for c in ("rep", "n", "block"))
    bits = np.array(group["bits"], np.int64).view(np.uint64)
    rows, cols = np.flatnonzero(block == group["i"][0]), np.flatnonzero(block == group["j"][0])
    out_a, out_b = [], []
    for at in range(0, len(rows), 64):
        r = rows[at : at + 64]
        other = np.zeros((len(r), len(cols)), np.int32)
        for k in range(bits.shape[1]):
            z = bits[r, k, None] ^ bits[None, cols, k]
            z |= z >> np.uint64(1)
            z |= z >> np.uint64(2)
            other += np.bitwise_count(z & np.uint64(0x1111111111111111))
        ok = (1 - other / PACKED - 1 / 16) / (1 - 1 / 16) >= percent / 100 - MARGIN
        ok &= 100 * np.minimum(n[r][:, None], n[cols][None, :]) >= percent * np.maximum(n[r][:, None], n[cols][None, :])
        x, y = np.nonzero(ok)
        x, y = rep[r[x]], rep[cols[y]]
        out_a.append(np.minimum(x, y)[x != y]), out_b.append(np.maximum(x, y)[x != y])
    pairs = np.unique(np.stack([np.concatenate(out_a), np.concatenate(out_b)]), axis=1) if out_a else np.empty((2, 0), np.int64)
    return pairs[0], pairs[1]


def _grouped(names: tuple[str, ...], each):
    """Rows sorted by (first name, i, j): each(group) gives arrays (a, b) for one group at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: dict[str, list] = {x: [] for x in names}

        def done() -> pa.RecordBatch:
            a, b = each(group) if len(group["rep"]) > 1 else (np.empty(0, np.int64),) * 2
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in range(len(names))]
            for row in zip(*cols, strict=True):
                if group["rep"] and row[:3] != (group[names[0]][0], group["i"][0], group["j"][0]):
                    yield done()
                    group = {x: [] for x in names}
                for x, v in zip(names, row, strict=True):
                    group[x].append(v)
        if group["rep"]:
            yield done()

    return run


def _faced(rows: DataFrame, key: str, blocks: Column) -> DataFrame:
    """Each row once for every pair of blocks its own block takes part in."""
    own = rows.withColumn("_blocks", blocks.cast("int")).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("_blocks")).cast("int"))
    faced = own.withColumn("_f", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    faced = faced.withColumns({"i": F.least("_f", "block"), "j": F.greatest("_f", "block")})
    return faced.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j", "rep")


def _linked_pairs(measured: DataFrame, percent: int) -> DataFrame:
    return measured.where(100 * F.col("both") >= percent * (F.col("size") + F.col("n") - F.col("both"))).select(F.col("lead").alias("a"), F.col("rep").alias("b"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id, kept, and t1 and t2 (common.text_key()), since an id may stand on several texts."""
    sig = common.written(signatures(docs, width, doc_id, text), "signatures")
    some = sig.where("n > 0 and id is not null")
    cls = some.groupBy("s1", "s2").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("bands").alias("bands"))
    cls = common.written(cls, "set-classes")
    slim = cls.select("rep", "n", "bits")
    seats = cls.select("rep", F.explode("bands").alias("key"))
    sizes = seats.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    seated = common.written(seats.join(sizes, "key"), "band-buckets")
    weights = seated.groupBy("rep").agg(F.sum("size").alias("weight"))
    seated = common.written(seated.select("rep", "key").join(weights, "rep"), "band-buckets")

    reps = cls.select("rep", "s1").join(seated.select("rep").distinct(), "rep", "left_semi")
    sets = common.written(_sets(docs, reps, width, doc_id, text), "shingle-sets")
    measured = None
    for _ in range(ROUNDS):
        leads = seated.groupBy("key").agg(F.max_by("rep", F.struct("weight", -F.col("rep"))).alias("lead"), F.count("*").alias("size")).where("size > 1")
        met = common.written(seated.join(leads.drop("size"), "key").where("rep <> lead"), "bucket-members")
        pairs = met.select("lead", "rep").distinct()
        if measured is not None:
            pairs = pairs.join(measured.select("lead", "rep"), ["lead", "rep"], "left_anti")
        got = common.written(_measured(common.written(_estimated(pairs, slim), "candidates"), sets), "measured")
        measured = got if measured is None else measured.unionByName(got)
        near = measured.select("lead", "rep", (F.col("both") / (F.col("size") + F.col("n") - F.col("both"))).alias("near"))
        judged = met.join(near, ["lead", "rep"], "left")
        far = judged.where("near is null").select("key").distinct()
        rest = judged.where(F.col("near").isNull() | (F.col("near") < AGAIN + 1 - percent / 100)).join(far, "key", "left_semi")
        seated = common.written(rest.select("rep", "key", "weight"), "band-buckets")

    # what two leaders have not settled is mostly chance company: few of its pairs pass the packed bits
    crowd = seated.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    left = _faced(seated.join(crowd, "key").join(slim, "rep"), "key", F.ceil(F.col("size") / BLOCK))
    names = ("key", "i", "j", "rep", "n", "block", "bits")
    loose = left.select(*names).mapInArrow(_grouped(names, lambda g: _near_pairs(g, percent)), "a long, b long").distinct()
    known = measured.select(F.least("lead", "rep").alias("a"), F.greatest("lead", "rep").alias("b"))
    loose = common.written(loose.join(known, ["a", "b"], "left_anti").select(F.col("a").alias("lead"), F.col("b").alias("rep")), "candidates")
    others = _linked_pairs(_measured(loose, sets), percent)
    labels = common.written(graph.components(_linked_pairs(measured, percent).unionByName(others)), "components")

    named = measured.select("lead", "rep", "size", "n", "both", "lacks", "adds").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
    several = named.groupBy("lead").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("members"), F.sum(F.octet_length("lacks") + F.octet_length("adds")).alias("bytes")).where("lo <> hi").drop("lo", "hi")
    several = common.written(several, "open-leaders")  # apart, so that the join below may split a hot leader
    names = ("lead", "i", "j", "rep", "comp", "size", "n", "block", "both", "lacks", "adds")
    links = _faced(named.join(several, "lead"), "lead", F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES))).select(*names).mapInArrow(_grouped(names, lambda g: _linked(g, percent)), "a long, b long")
    joined = labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links)
    final = graph.components(joined)

    place = cls.select("s1", "s2", "rep").join(final.withColumnRenamed("node", "rep"), "rep", "left").select("s1", "s2", F.coalesce("component", "rep").alias("component_id"))
    out = sig.select("id", "t1", "t2", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("s1")).alias("s1"), "s2").join(place, ["s1", "s2"], "left")
    component = F.coalesce(F.when(F.col("id").isNotNull(), F.col("component_id")), F.col("id"))
    return out.select("id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"), "t1", "t2")
