"""The corpus pipeline against a brute-force version of its stages."""

import random
import re
import struct
import zlib

import base64

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from citelake.llm import bpe, toxicity

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    rng = random.Random(11)
    prose = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    bench = [(i, prose(20)) for i in range(5)]
    docs, labels = [], []
    for i in range(300):
        text = f"{prose(30)}\n{prose(20)}"
        toxic = i % 5 == 0
        if toxic:
            text += " scum trash"
        if i % 3 == 0:
            text += "\nShared Line of the site"
        labels.append((i, 0, int(toxic)))
        docs.append((i, text))
    docs[31] = (31, f"{prose(20)} {bench[2][1]} {prose(10)}")
    docs[41] = (41, docs[32][1])
    docs[42] = (42, docs[33][1] + " tail")
    docs += [(900, None), (901, ""), (902, "word " * 3000)]
    d = tmp_path_factory.mktemp("sf")
    full = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    full.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), docs, bench


def shingles(t):
    w = WORD.findall((t or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def expected(spark, sf_dir, docs, bench):
    machine = toxicity.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    where = {int(s): i for i, s in enumerate(machine.slots)}

    def score(t):
        import numpy as np

        found = {where.get(zlib.crc32(x.encode()) % toxicity.SLOTS) for x in re.findall(r"\w+", (t or "").lower())} - {None}
        return machine.score(np.array(sorted(found), np.int64))

    rows = [(i, t) for i, t in docs if score(t) < 0.3]
    keys = lambda t: [x.strip(" \t\n\x0b\x0c\r").translate(LOWER) for x in (t or "").split("\n")]
    count: dict = {}
    for _, t in rows:
        for k in set(keys(t)) - {""}:
            count[k] = count.get(k, 0) + 1
    rows = [(i, "\n".join(x for x, k in zip((t or "").split("\n"), keys(t), strict=True) if count.get(k, 0) < 10)) for i, t in rows]
    kept = []
    for i, t in sorted(rows):
        s = shingles(t)
        if not any(s and o and 100 * len(s & o) >= 80 * len(s | o) for _, _, o in kept):
            kept.append((i, t, s))
    words = lambda t: re.findall(r"\w+", t.lower())
    return [(i, t) for i, t, _ in kept if not any(" ".join(words(b)) in " ".join(words(t)) for _, b in bench)]


def test_pipeline_equals_brute_force(spark, data):
    sf_dir, docs, bench = data
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    want = dict(expected(spark, sf_dir, docs, bench))
    assert {i: r.text for i, r in got.items()} == want
    assert 31 not in got and 41 not in got and 42 not in got and 0 not in got and 900 in got
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).splitlines())}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, r in got.items():
        ids = library.encode_ordinary(want[i])
        assert r.round_trip and r.n_tokens == len(ids) and bytes(r.token_ids) == struct.pack(f"<{len(ids)}I", *ids)


def test_stages_keep_the_columns(spark, data):
    sf_dir = data[0]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line dedup", "MinHash near-dedup", "benchmark decontamination", "byte-level BPE"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.schema.simpleString() == docs.schema.simpleString()
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    assert corpus_pipeline.STAGES[0][1](spark, docs, sf_dir).where(F.col("doc_id") == 900).count() == 1


def test_ids_with_several_texts_lose_only_copies(spark):
    rng = random.Random(3)
    a, b = (" ".join(f"w{rng.randrange(400)}" for _ in range(40)) for _ in range(2))
    rows = [(1, b), (5, a), (5, b), (5, None), (None, b), (7, b + " tail"), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, b), (5, a), (5, None), (None, b), (8, "")], key=str)
