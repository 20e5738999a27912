"""Vector codes, token-id files and the prefix trie against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citelake.llm import tokenfiles, trie, vafile
from citelake.llm.eliasfano import EliasFano, encode as elias_fano

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


# vector codes


def whole(v, dims):
    x = [min(max(math.floor(1024 * float(e)), -vafile.LARGEST), vafile.LARGEST) for e in v]
    return x + [0] * (dims - len(x))


def brute_codes(rows, entries, rounds, parts=4):
    """rows: (id, vector); codes, errors and codebooks by comparing everything with everything, in Python's whole numbers."""
    fine = [(i, v) for i, v in rows if v is not None and all(e is not None and math.isfinite(e) for e in v)]
    fine.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dims = -(-max(len(v) for _, v in fine) // parts) * parts
    cut = [[whole(v, dims)[p * dims // parts : (p + 1) * dims // parts] for p in range(parts)] for _, v in fine]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            got = defaultdict(list)
            for c in cut:
                got[nearest(c[p], books[p])[1]].append(c[p])
            books[p] = [[sum(x) // len(x) for x in zip(*got[k], strict=True)] if k in got else e for k, e in enumerate(books[p])]
    out = []
    for (i, _), c in zip(fine, cut, strict=True):
        found = [nearest(c[p], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    return out, books


def vectors(seed, n=120, dims=8):
    rng = random.Random(seed)
    centers = [[rng.gauss(0, 0.3) for _ in range(dims)] for _ in range(5)]
    rows = [(i, [float(np.float32(c + rng.gauss(0, 0.05))) for c in rng.choice(centers)]) for i in range(n)]
    rows += [(500 + i, rows[0][1]) for i in range(40)]  # one vector, often
    rows += [(7, rows[9][1]), (7, rows[9][1]), (None, rows[3][1]), (-5, [0.0] * dims), (900, [0.25, -0.25]), (901, []), (902, None), (903, [0.1, None] + [0.0] * (dims - 2)), (904, [float("nan")] * dims), (905, [float("inf")] + [0.0] * (dims - 1)), (906, [1e30] * dims)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("entries,rounds,dims", [(16, 4, 8), (256, 2, 8), (3, 3, 7)])
def test_codes_equal_brute_force(spark, entries, rounds, dims):
    rows = vectors(entries, dims=dims)
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, code string, part int")
    books = vafile.fit(df, entries=entries, rounds=rounds)
    want, want_books = brute_codes(rows, entries, rounds)
    assert books.entries.tolist() == want_books
    assert books.sha256() == hashlib.sha256(",".join(str(x) for part in want_books for e in part for x in e).encode()).hexdigest()
    got = vafile.encode(df, books)
    assert got.columns == ["vec_id", "code", "error"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_label_errors_and_approximations(spark):
    rows = vectors(5)
    df = spark.createDataFrame([(i, v, None if j % 3 == 0 else j % 2) for j, (i, v) in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    books = vafile.fit(df, entries=20)
    got = vafile.with_label_error(vafile.encode(df, books, keep=("label",))).collect()
    sums = Counter()
    for r in got:
        sums[r.label] += r.error
    assert {r.label: r.label_error for r in got} == dict(sums) and None in sums
    near = {r.vec_id: r.approximation for r in vafile.decode(vafile.encode(df.where("vec_id = -5"), books), books).collect()}
    assert len(near[-5]) == 8 and max(map(abs, near[-5])) < 0.5
    empty = vafile.fit(df.limit(0))
    assert empty is None and vafile.with_label_error(vafile.encode(df.limit(0), empty, keep=("label",))).count() == 0


def test_bounds_hold_and_leave_few_entries():
    rng = np.random.default_rng(2)
    entries = rng.integers(-400, 400, (256, 16))
    cells, x = vafile.Cells(entries), rng.integers(-400, 400, (500, 16))
    exact = ((x[None] - entries[:, None]) ** 2).sum(axis=2)
    lower, upper = cells.bounds(x)
    assert (lower <= exact).all() and (exact <= upper).all()
    assert (lower <= upper.min(axis=0)).mean() < 0.5
    wide = vafile.Cells(entries * (1 << 17))
    lower, upper = wide.bounds(x * (1 << 17))
    assert lower.dtype == np.int64 and (lower <= exact * (1 << 34)).all() and (exact * (1 << 34) <= upper).all()


# Elias-Fano and token-id files


@given(st.lists(st.integers(-(2**63), 2**63 - 1), max_size=700) | st.lists(st.integers(0, 3), max_size=700) | st.lists(st.integers(0, 10**6), max_size=700), st.data())
@settings(deadline=None, max_examples=150)
def test_elias_fano_gives_numbers_back(numbers, data):
    numbers = sorted(numbers)
    coded = EliasFano(elias_fano(np.array(numbers, np.int64)))
    assert len(coded) == len(numbers) and coded.range(0, len(numbers)).tolist() == numbers
    if numbers:
        i = data.draw(st.integers(0, len(numbers) - 1))
        j = data.draw(st.integers(i, len(numbers)))
        assert coded[i] == numbers[i] and coded.range(i, j).tolist() == numbers[i:j]


def test_elias_fano_is_small():
    starts = np.cumsum(np.random.default_rng(1).integers(1, 2000, 100_000))
    assert len(elias_fano(starts)) * 8 < 100_000 * (2 + math.log2(1000) + 1)


@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=40) | st.text("aB.,é́İ|'sK \n\x1c<>中1", max_size=30) | st.just("<|endoftext|>X"), max_size=5))
@settings(deadline=None, max_examples=300)
def test_words_on_their_own_give_the_librarys_ids(texts):
    import pyarrow as pa

    known = test_words_on_their_own_give_the_librarys_ids.__dict__.setdefault("known", tokenfiles.Vocabulary(VOCABULARY, words=300))
    ids, sizes = known.encode(pa.array([*texts, None], pa.string()))
    got = np.split(ids, np.cumsum(sizes)[:-1])
    assert [x.tolist() for x in got] == [known.tokenizer.encode(t, add_special_tokens=False).ids for t in texts] + [[]]
    assert known.by_word and known.folds


def token_docs():
    rng = random.Random(4)
    texts = ["", None, " ", "one", "two words <|endoftext|>", "é ü. A|B |", "x" * 5000, " ".join(f"w{rng.randrange(3000)}" for _ in range(60_000))]
    texts += [" ".join(f"w{rng.randrange(50)}." for _ in range(rng.randrange(40))) for _ in range(200)]
    rows = [(i * 3 - 50, t) for i, t in enumerate(texts)]
    rows += [(None, "without id"), (None, None), (12, "same id, other text"), (12, "same id, other text"), *[(40, "copy")] * 300]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("file_ids", [1 << 26, 500])
def test_files_hold_what_the_library_says(spark, tmp_path, file_ids):
    rows = token_docs()
    known = tokenfiles.Vocabulary(VOCABULARY).tokenizer
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, row int, first string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        manifest = tokenfiles.write(df, VOCABULARY, 2, path=str(tmp_path / "ids"), file_ids=file_ids)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    files = manifest.orderBy("file").collect()
    assert len(files) > (4 if file_ids == 500 else 0)
    got = sorted(tokenfiles.read(tokenfiles.open_files(spark, str(tmp_path / "ids"))).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens

    def digest(t):
        ids = [*known.encode(t or "", add_special_tokens=False).ids, 2]
        return len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())

    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, *digest(t)) for i, t in rows)
    reader, at = tokenfiles.Reader(files[0].path), 0
    for i in (len(reader) - 1, 0, len(reader) // 2):
        assert reader.document(i)[-1] == 2 and zlib.crc32(reader.document(i).astype("<u4").tobytes()) == got[at + i].ids_crc32
    assert tokenfiles.read(tokenfiles.write(df.limit(0), VOCABULARY, 2)).count() == 0


def test_a_cut_file_is_refused(tmp_path):
    out = tokenfiles.Writer(str(tmp_path / "a.bin"), 2)
    out.append([5, 9], np.array([7, 2, 2]), np.array([2, 1]))
    path, n_docs, n_ids = out.close()
    assert (n_docs, n_ids) == (2, 3) and tokenfiles.Reader(path).document(1).tolist() == [2]
    (tmp_path / "b.bin").write_bytes((tmp_path / "a.bin").read_bytes()[3:])
    with pytest.raises(ValueError):
        tokenfiles.Reader(str(tmp_path / "b.bin"))


# prefix trie


def brute_trie(rows, heads=lambda c: zlib.crc32(str(c).encode()) % 6, every=100):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    done = {c: own.get(c - int(math.fmod(c, every)), [])[: heads(c)] + ts[heads(c) :] for c, ts in own.items()}
    members = defaultdict(list)
    for c in sorted(done):
        for d in range(len(done[c]) + 1):
            members[tuple(done[c][:d])].append(c)
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        leaves = [n for n in below if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in below)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n)
        ends = ",".join(str(c) for c in convs if len(done[c]) == len(node))
        out.append((convs[0], len(node), members[node[:-1]][0] if node else None, len(convs), sum(len(m) == len(node) + 1 for m in below), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations():
    rng = random.Random(8)
    rows = []
    for c in [*range(-120, 40), 199, 200, 201, 203, *range(301, 330), 10**12]:
        for t in range(rng.choice([1, 1, 2, 3, 4, 8])):
            rows.append((c, t, ("user", "assistant")[t % 2], rng.choice(["hello", "yes", "no", "a\nb", ""])))
    rows += [(500 + i, t, "user", f"same {t}") for i in range(30) for t in range(4)]
    rows += [(700, t, "user", "deep") for t in range(60)]
    rows += [(800, None, None, None), (800, None, "user", "x"), (800, 1, "user", "tie"), (800, 1, "assistant", "tie"), (800, 1, "user", "tie"), (None, 0, "user", "no id"), (801, 3, None, "é😀")]
    rng.shuffle(rows)
    return rows


def test_trie_equals_brute_force(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, digest string")
    conv = F.col("conv_id")
    got = trie.prefix_trie(trie.grafted(trie.turns(df), conv - conv % 100, F.crc32(conv.cast("string")) % 6, 5)).drop("digest").collect()
    assert sorted(map(tuple, got), key=str) == brute_trie(rows)
    plain = trie.prefix_trie(trie.turns(df)).drop("digest").collect()
    assert sorted(map(tuple, plain), key=str) == brute_trie(rows, heads=lambda c: 0)


def test_trie_of_nothing(spark):
    df = spark.createDataFrame([(None, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    assert trie.prefix_trie(trie.turns(df)).count() == 0 and trie.prefix_trie(trie.turns(df.limit(0))).count() == 0


def test_a_very_long_text_and_role_borders(spark):
    rows = [(1, 0, "a", "b" * 3_000_000), (2, 0, "ab", "b" * 2_999_999), (3, 0, "a", "b" * 3_000_000)]
    got = trie.prefix_trie(trie.turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    assert sorted((r.conv_id, r.depth, r.n_convs, r.saved_tokens) for r in got.collect()) == [(1, 0, 3, 3_000_000), (1, 1, 2, 3_000_000), (2, 1, 1, 0)]


def test_a_worker_keeps_the_vocabulary_for_its_next_task():
    import public_tokenizers
    import pyarrow as pa

    from citelake.llm import tokenfiles

    path = public_tokenizers.path("word_bpe_49k.json")
    known = tokenfiles.kept(path)
    texts = pa.array(["New words, met here. new | words", None, "met again"])
    first = [x.tolist() for x in known.encode(texts)]
    learned = []
    learn, known._learn = known._learn, lambda words: learned.extend(words)
    try:
        again = tokenfiles.kept(path)
        assert again is known and [x.tolist() for x in again.encode(texts)] == first and not learned
    finally:
        known._learn = learn
    assert [x.tolist() for x in tokenfiles.Vocabulary(path).encode(texts)] == first
