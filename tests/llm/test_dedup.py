"""Near-duplicate and repeat operators against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from citelake.llm import common, ego, graph, minhash, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def components(nodes, links):
    top = {n: n for n in nodes}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def prose(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed=3):
    """Copies, near copies of many degrees, a shared line, short, empty and null texts, odd spaces, capitals."""
    rng = random.Random(seed)
    texts = [None, "", " \t ", "one", "One", "two words", "two words", "TWO  words\n"]
    line = " ".join(prose(rng, 25))
    for _ in range(12):
        base = prose(rng, rng.randint(30, 120))
        texts.append(" ".join(base))
        for rate in (0.0, 0.01, 0.03, 0.05, 0.08, 0.15):
            texts.append(" ".join(f"x{rng.random()}" if rng.random() < rate else w for w in base))
    texts += [f"{line}\n{' '.join(prose(rng, 30))}" for _ in range(10)]
    texts += ["a b " * 60, "é ü ß " * 30]
    center = prose(rng, 150)
    texts += [" ".join(f"y{rng.random()}" if rng.random() < 0.06 else w for w in center) for _ in range(60)]
    rng.shuffle(texts)
    return list(enumerate(texts))


def shingle_set(text, width):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


@pytest.mark.parametrize("width", [2, 5])
def test_minhash_equals_brute_force(spark, width):
    docs = corpus()
    sets = {i: shingle_set(t, width) for i, t in docs}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(sets, links)
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, kept string")
    got = {r.id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, width).collect()}
    assert got == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


def test_minhash_edges(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.id, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (None, None, True), (2, 1, False), (3, 3, True)], key=str)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_packed_estimate_equals_its_definition():
    rng = np.random.default_rng(1)
    a = minhash.minima(rng.integers(0, 2**63, 300, dtype=np.uint64))
    b = minhash.minima(rng.integers(0, 2**63, 300, dtype=np.uint64))
    b[:100] = a[:100]
    low = lambda x: (x[: minhash.PACKED] >> np.uint64(16)) & np.uint64(15)
    x, y = minhash.packed_bits(a), minhash.packed_bits(b)
    z = x ^ y
    z |= z >> np.uint64(1)
    z |= z >> np.uint64(2)
    assert int(np.bitwise_count(z & np.uint64(0x1111111111111111)).sum()) == int((low(a) != low(b)).sum())


def removed(docs, size):
    seen, out = set(), {}
    for i, t in docs:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            if key in seen:
                gone[k : k + size] = [True] * size
            seen.add(key)
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


def rebuilt(members, results, size, by=None):
    """by: results of earlier batches, which a copy of an old text needs; grows."""
    by = {} if by is None else by
    by.update({(r.t, r.u): r for r in results.collect()})
    for m in members.collect():
        r = by[m.t, m.u]
        lost = m.copy and r.n_words >= size
        yield m.id, (r.n_words, r.n_words if lost else r.n_removed, "" if lost else r.kept_text)


@pytest.mark.parametrize("batches", [1, 2, 4])
def test_repeats_equal_brute_force(spark, batches):
    docs = corpus(7)
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, t string")
    got = dict(rebuilt(*substrings.remove_repeats(df.select("doc_id", "text"), 20, batches), 20))
    assert got == removed(docs, 20)


def test_index_over_batches_with_compaction(spark):
    docs = corpus(9)
    index, got, by = substrings.FingerprintIndex(spark, 10, max_runs=2, buckets=3), {}, {}
    for k in range(5):
        some = spark.createDataFrame(docs[k * 30 : (k + 1) * 30], "doc_id long, text string")
        got |= dict(rebuilt(*index.add(some), 10, by))
    rest = spark.createDataFrame(docs[150:], "doc_id long, text string")
    got |= dict(rebuilt(*index.add(rest), 10, by))
    assert got == removed(docs, 10) and all(len(runs) <= 2 for runs in index.runs.values())


def test_repeats_edges(spark):
    t = " ".join(f"w{i}" for i in range(30))
    rows = [(1, t), (1, t), (None, "a b"), (2, t), (3, None)]
    members, results = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 20, 1)
    got = sorted(rebuilt(members, results, 20), key=str)
    assert got == sorted([(1, (30, 0, t)), (1, (30, 0, t)), (None, (2, 0, "a b")), (2, (30, 30, "")), (3, (0, 0, ""))], key=str)
    members, results = substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string"), 20, 2)
    assert members.count() == 0 and results.count() == 0


def test_word_hashes_follow_the_words():
    rng = random.Random(2)
    texts = ["", " ", "a", " a  b\n", "é x y\x0bz\x1cq", "".join(rng.choice("ab \t\n\réß") for _ in range(5000))]
    known = {}
    for t in texts:
        h = common.Words(np.frombuffer(t.encode(), np.uint8)).hashes()
        words = WORD.findall(t)
        assert len(h) == len(words)
        for w, x in zip(words, h.tolist(), strict=True):
            assert known.setdefault(w, x) == x
    assert len(set(known.values())) == len(known)


def thue_morse(n):
    """Two words that share every polynomial hash modulo a power of two."""
    one = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("letters", [1024, 4096])
def test_words_made_to_collide_are_told_apart(spark, letters):
    a, b = thue_morse(letters)
    one, two = common.Words(np.frombuffer(f"{a} {b}".encode(), np.uint8)).hashes().tolist()
    assert one != two
    texts = [(1, " ".join([a] * 20)), (2, " ".join([b] * 20)), (3, f"x {a}"), (4, f"x {b}"), (5, " ".join([a] * 20) + " end")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = dict(rebuilt(*substrings.remove_repeats(df, 20, 2), 20))
    assert got == removed(texts, 20) and got[2][1] == 0 and got[5][1] == 20
    near = {r.id: r.component_id for r in minhash.near_duplicates(df.where("doc_id in (3, 4)"), 2).collect()}
    assert near == {3: 3, 4: 4}


def test_texts_that_share_half_of_their_key(spark, monkeypatch):
    """Keys of which one half is the same for all texts, and the other for many."""
    monkeypatch.setattr(common, "text_key", lambda text: (F.lit(5).cast("long"), F.xxhash64(F.coalesce(text, F.lit("")))))
    docs = corpus(13)[:60]
    index, got, by = substrings.FingerprintIndex(spark, 10, buckets=2), {}, {}
    for some in (docs[:30], docs[30:]):
        got |= dict(rebuilt(*index.add(spark.createDataFrame(some, "doc_id long, text string")), 10, by))
    assert got == removed(docs, 10)


def test_index_goes_on_after_being_opened_again(spark):
    docs = corpus(17)[:90]
    first = substrings.FingerprintIndex(spark, 10, max_runs=2, buckets=2)
    got, by = {}, {}
    for k in range(3):
        batch = spark.createDataFrame(docs[k * 30 : k * 30 + 30], "doc_id long, text string")
        index = substrings.FingerprintIndex.open(spark, first.path) if k else first
        got |= dict(rebuilt(*index.add(batch), 10, by))
        gone = index.vacuum()
        assert bool(gone) == (k == 2) and spark.catalog.listTables() == []
    assert got == removed(docs, 10) and substrings.FingerprintIndex.open(spark, first.path).batches == 3
    with pytest.raises(FileNotFoundError):
        substrings.FingerprintIndex.open(spark, first.path + "-none")


def test_failed_batches_leave_nothing_and_buckets_grow(spark, tmp_path, monkeypatch):
    docs, by = corpus(18)[:120], {}
    path = str(tmp_path / "index")
    batch = lambda k: spark.createDataFrame(docs[k * 30 : k * 30 + 30], "doc_id long, text string")
    index = substrings.FingerprintIndex(spark, 10, max_runs=3, buckets=2, path=path)
    got = dict(rebuilt(*index.add(batch(0)), 10, by))
    with monkeypatch.context() as m:
        m.setattr(substrings.FingerprintIndex, "_matches", lambda *x: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            substrings.FingerprintIndex.open(spark, path).add(batch(1))
    again = substrings.FingerprintIndex.open(spark, path)
    assert again.batches == 1 and len(again.vacuum()) == 3  # the failed batch's runs lie in the index's folder
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 2000)
    for k in (1, 2, 3):
        again = substrings.FingerprintIndex.open(spark, path)
        got |= dict(rebuilt(*again.add(batch(k)), 10, by))
    assert again.buckets > 2 and len(again.runs["grams"]) == 1 and got == removed(docs, 10)
    assert len(again.vacuum()) == 12 and len(list((tmp_path / "index/runs").iterdir())) == 3


def test_a_text_of_half_a_million_words(spark):
    rng = random.Random(21)
    words = [f"w{rng.randrange(10**6)}" for _ in range(500_000)]
    docs = [(1, " ".join(words)), (2, " ".join(words[100_000:100_040])), (3, " ".join(words + ["end"])), (4, "x " * 30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = dict(rebuilt(*substrings.remove_repeats(df, 20, 1), 20))
    assert [got[i][:2] for i in (1, 2, 3, 4)] == [(500_000, 0), (40, 40), (500_001, 500_000), (30, 10 + 19)] and got[3][2] == "end"
    near = {r.id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, 5).collect()}
    assert near[3] == (near[1][0] + 1, 1) and near[2][1] == 2


def test_large_sets_are_compared_in_parts(monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(minhash, "COLUMNS", 64)
    lead = np.unique(rng.integers(0, 2**63, 900, dtype=np.uint64))
    group = {k: [] for k in ("lead", "i", "j", "rep", "comp", "size", "n", "block", "both", "lacks", "adds")}
    sets = []
    for rep in range(40):
        has = rng.random(len(lead)) > 0.15
        extra = np.sort(rng.choice(np.arange(10**6, 10**6 + 200, dtype=np.uint64), 60, replace=False))
        sets.append(set(lead[has].tolist()) | set(extra.tolist()))
        row = {"lead": 1, "i": 0, "j": 0, "rep": rep, "comp": rep, "size": len(lead), "n": len(sets[-1]), "block": 0, "both": int(has.sum()), "lacks": np.packbits(~has).tobytes(), "adds": extra.tobytes()}
        for k, v in row.items():
            group[k].append(v)
    a, b = minhash._linked(group, 70)
    links = [(x, y) for x in range(40) for y in range(x) if 100 * len(sets[x] & sets[y]) >= 70 * len(sets[x] | sets[y])]
    assert links and components(range(40), zip(a.tolist(), b.tolist(), strict=True)) == components(range(40), links)


def test_hubs_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(graph, "NEIGHBOURS", 20)
    rng = random.Random(4)
    links = [(9000, i) for i in range(300)] + [(0, 2000 + i) for i in range(100)] + [(rng.randrange(5000), rng.randrange(5000)) for _ in range(900)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.component for r in graph.components(df).collect()}
    nodes = {x for pair in links if pair[0] != pair[1] for x in pair}
    assert got == components(nodes, links)


def test_recall_above_the_threshold(spark):
    """Queries (ids divisible by 100) against all rows by brute force: every link at 0.8 or more lies in one class."""
    rng = random.Random(30)
    docs = []
    for i in range(600):
        base = prose(rng, rng.randint(20, 80), 3000) if i % 6 == 0 else base
        docs.append((i * 10, " ".join(f"z{rng.randrange(10**6)}" if rng.random() < 0.02 else w for w in base)))
    sets = {i: shingle_set(t, 5) for i, t in docs}
    got = {r.id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 5).collect()}
    pairs = [(q, i) for q in sets if q % 100 == 0 for i in sets if i != q and 100 * len(sets[q] & sets[i]) >= 80 * len(sets[q] | sets[i])]
    assert len(pairs) > 50 and all(got[q] == got[i] for q, i in pairs)


def vectors(seed=5, n=400, dim=24):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, dim))
    x = centers[rng.integers(0, 12, n)] + rng.normal(size=(n, dim)) * rng.choice([0.02, 0.15, 0.25, 0.4], (n, 1))
    x[5], x[6], x[7] = x[4], x[4] * 3, 0
    return x


def test_grid_join_equals_brute_force(spark):
    x = vectors()
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, []), (902, [float("nan")] * 24), (903, [None] * 24), (904, [float("inf")] + [0.0] * 23)]
    unit = x / np.where(np.linalg.norm(x, axis=1, keepdims=True) > 0, np.linalg.norm(x, axis=1, keepdims=True), 1)
    cos = unit @ unit.T
    link = (cos >= 0.95) & ~np.eye(len(x), dtype=bool)
    ids = [i for i, _ in rows]
    want = components(ids, [(int(a), int(b)) for a, b in np.argwhere(np.triu(link))])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.id: (r.n_links, r.component_id, r.kept) for r in ego.near_vectors(df).collect()}
    assert got == {i: (int(link[i].sum()) if i < len(x) else 0, want[i], want[i] == i) for i in ids}
    assert ego.near_vectors(df.limit(0)).count() == 0


def test_grid_join_of_one_hot_cell_and_two_lengths(spark):
    rng = np.random.default_rng(8)
    hot = rng.normal(size=8) + rng.normal(size=(1500, 8)) * 0.01
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(hot)] + [(5000 + i, [1.0, float(i)]) for i in range(3)] + [(None, [1.0, 0.0])]
    got = {r.id: (r.n_links, r.component_id) for r in ego.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert all(got[i] == (1499, 0) for i in range(1500)) and got[5000] == (0, 5000) and got[None] == (0, None)


def test_grid_join_in_many_groups(spark, monkeypatch):
    """Groups of two small blocks each: owners, partners that stream past, components over several groups."""
    monkeypatch.setattr(ego, "BLOCK_ROWS", 20)
    monkeypatch.setattr(ego, "GROUP_BYTES", 2 * 20 * 8 * 24)
    x = vectors(11, 700).astype(np.float32)
    x[650:] = x[0] + np.random.default_rng(1).normal(size=(50, 24)).astype(np.float32) * 0.01
    unit = x.astype(np.float64) / np.where((n := np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)) > 0, n, 1)
    link = (unit @ unit.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    want = components(range(len(x)), [(int(a), int(b)) for a, b in np.argwhere(np.triu(link))])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.id: (r.n_links, r.component_id) for r in ego.near_vectors(df).collect()}
    assert got == {i: (int(link[i].sum()), want[i]) for i in range(len(x))}


def test_components_of_long_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(50)] + [(7, 7), (5, 6), (6, 5)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.component for r in graph.components(df).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(50)}
    assert graph.components(df.limit(0)).count() == 0


def test_hash_of_kept_text_is_stable():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_regular_windows_of_any_size_are_told_apart(spark):
    """Sequences of two words that polynomials modulo 2^64 take for each other."""
    bits = [0]
    for _ in range(11):
        bits += [1 - b for b in bits]
    one, two = (" ".join("ab"[b ^ k] for b in bits) for k in (0, 1))
    df = spark.createDataFrame([(1, one), (2, two), (3, "x " + two)], "doc_id long, text string")
    _, results = substrings.remove_repeats(df, 2048)
    assert sorted(r.n_removed for r in results.collect()) == [0, 0, 2048]
    w = np.random.default_rng(1).integers(0, 4, 300).astype(np.uint64)
    for n in (1, 2, 3, 8, 13, 20, 64, 299, 300):
        with np.errstate(over="ignore"):
            got = substrings.blocks_hashed(common.mix(w + np.uint64(1)), n, np.uint64(7))
        by = {}
        for i, h in enumerate(got.tolist()):
            by.setdefault(h, set()).add(tuple(w[i : i + n].tolist()))
        assert len(got) == 300 - n + 1 and len(by) == len({tuple(w[i : i + n].tolist()) for i in range(len(got))}) and all(len(x) == 1 for x in by.values())
