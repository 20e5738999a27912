import base64
import random
import struct

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from citelake.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    lines = bpe.read_ranks(PATH)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
    own = bpe.vocabulary(lines, public_tokenizers.PATTERN)
    return own, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(vocabulary, text):
    data = vocabulary.encode(text)
    return list(struct.unpack(f"<{len(data) // 4}I", data))


def test_random_pieces_equal_the_library(both):
    own, library = both
    rng = random.Random(5)
    tokens = [t.decode("utf-8", "ignore") for t in rng.sample(sorted(own.rank), 4000)]
    for _ in range(4000):
        text = "".join(rng.choice(tokens) for _ in range(rng.randint(1, 6)))
        assert ids(own, text) == library.encode_ordinary(text)
    for text in ("", "a" * 5000, "ab" * 3000, "<|endoftext|>", "\u0000\u0001", "日本語のテキスト" * 50, " \t\n \r\n  x", "don't I'LL"):
        assert ids(own, text) == library.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(both, text):
    own, library = both
    assert ids(own, text) == library.encode_ordinary(text)
    assert bpe.tokens(bpe.read_ranks(PATH)).decode(own.encode(text)) == text.encode()


def test_table_with_nulls_repeats_and_other_columns(spark, both):
    rows = [(1, None, "x"), (2, "", "y"), (3, "héllo wörld", None), (3, "héllo wörld", None), (None, "z " * 40_000, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded_sha256 string")
    got = bpe.decode(bpe.encode(df, PATH, public_tokenizers.PATTERN), PATH).collect()
    assert len(got) == 5
    for row in got:
        assert row.decoded == (row.text or "").encode()
        want = both[1].encode_ordinary(row.text or "")
        assert row.n_tokens == len(want) and bytes(row.token_ids) == struct.pack(f"<{len(want)}I", *want)
    assert bpe.encode(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
