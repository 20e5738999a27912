"""Byte-level BPE encoding and decoding (operator 8).

Each pre-token's UTF-8 bytes are read as Latin-1 text, so that an Aho-Corasick automaton over the vocabulary
gives, in one pass, the longest token that starts at every byte. A depth-first search walks from left to right:
it takes the longest token that is compatible with the token before it, else a shorter prefix, else it steps back.
Two tokens are compatible if merging their joined bytes gives just these two; a token sequence is the BPE
encoding exactly if all neighbours are compatible, and compatibility is memoised, so work is linear in the text.

Defined results: null or empty texts give no tokens and decode to nothing; repeated rows are each encoded; all
other columns, whatever their names, pass through (the operator's own three columns replace columns of the
same name).
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

OUT_ROWS = 256


def read_ranks(path: str) -> bytes:
    """A vocabulary file, as it is: lines of a token in base 64 and its rank."""
    with open(path, "rb") as f:
        return f.read()


class Recent(dict):
    """A memory of two generations: when the young one is full it becomes the old one, from which what is used again
    comes back."""

    def __init__(self, size: int):
        super().__init__()
        self.size, self.old = size, {}

    def recall(self, key):
        """The value of a key that the young generation lacks, else None."""
        value = self.old.get(key)
        if value is not None:
            self.keep(key, value)
        return value

    def keep(self, key, value) -> None:
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value

    def forget(self) -> None:
        self.clear()
        self.old = {}


class Vocabulary:
    def __init__(self, lines: bytes, pattern: str, pieces: int = 100_000, pairs: int = 200_000):
        self.rank = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x)}
        self.token = {b: a for a, b in self.rank.items()}
        self.length = {b: len(a) for a, b in self.rank.items()}
        self.split = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.rank.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token) - 1))
        self.automaton.make_automaton()
        self.shorter: dict[int, int | None] = {}
        self.fits, self.pieces = Recent(pairs), Recent(pieces)

    def merge(self, data: bytes) -> list[int]:
        """BPE by its definition; used on the bytes of two tokens only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        rank = self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [rank[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the two tokens' joined bytes gives just these two."""
        key = left << 32 | right
        known = self.fits.recall(key)
        if known is None:
            known = self.merge(self.token[left] + self.token[right]) == [left, right]
            self.fits.keep(key, known)
        return known

    def prefix(self, token: int) -> int | None:
        """The longest token that is a proper prefix of this one."""
        if token not in self.shorter:
            data = self.token[token]
            self.shorter[token] = next((self.rank[data[:n]] for n in range(len(data) - 1, 0, -1) if data[:n] in self.rank), None)
        return self.shorter[token]

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.rank.get(data)
        if whole is not None:
            return [whole]
        size, length, fits = len(data), self.length, self.fits.get
        longest = [-1] * size
        for end, (rank, back) in self.automaton.iter(data.decode("latin-1")):
            longest[end - back] = rank  # a later end beats an earlier one at the same start
        closed: set[int] = set()  # places from which there is no way on
        out: list[int] = []
        at, token, before = 0, longest[0], None
        while at < size:
            while token is not None:
                end = at + length[token]
                if end not in closed:
                    if before is None:
                        break
                    ok = fits(before << 32 | token)
                    if self.compatible(before, token) if ok is None else ok:
                        break
                token = self.prefix(token)
            if token is None:
                if not out:
                    raise ValueError("the vocabulary lacks a single byte")
                closed.add(at)
                last = out.pop()
                at -= length[last]
                before = out[-1] if out else None
                token = self.prefix(last)
            else:
                out.append(token)
                before, at = token, end
                token = longest[at] if at < size else None
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        pieces, out = self.pieces, []
        known, add = pieces.get, out.append
        for piece in self.split(text):
            got = known(piece) or pieces.recall(piece)
            if got is None:
                ids = self.encode_piece(piece.encode("utf-8"))
                got = struct.pack(f"<{len(ids)}I", *ids)
                if len(piece) <= 64:
                    pieces.keep(piece, got)
            add(got)
        return b"".join(out)


class Tokens:
    """What decoding needs: the bytes of each id."""

    def __init__(self, lines: bytes):
        self.token = {int(b): base64.b64decode(a) for a, b in (x.split() for x in lines.splitlines() if x)}

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, memoryview(ids).cast("I")))


@lru_cache(maxsize=2)
def vocabulary(lines: bytes, pattern: str, pieces: int = 100_000, pairs: int = 200_000) -> Vocabulary:
    return Vocabulary(lines, pattern, pieces, pairs)


@lru_cache(maxsize=2)
def tokens(lines: bytes) -> Tokens:
    return Tokens(lines)


def _mapped(df: DataFrame, column: str, make, out: str) -> DataFrame:
    """df with a binary column made from another one in Arrow batches, OUT_ROWS rows at a time."""
    df = df.drop(out) if out != column else df
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each, done = make()
        for big in batches:
            for start in range(0, big.num_rows, OUT_ROWS):
                batch = big.slice(start, OUT_ROWS)
                values = pa.array([each(x) for x in batch.column(names.index(column)).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, values], names=names)
        done()
        common.give_back()

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", pieces: int = 100_000, pairs: int = 200_000) -> DataFrame:
    """df with token_ids (binary, little-endian unsigned 32-bit) and n_tokens. The vocabulary file is read once, on
    the driver; its bytes (under 1 MB for 50,000 tokens, refused over 64 MB) go to the executors by broadcast. pieces and pairs bound a worker's two memories (each holds twice as
    many at most): larger is faster."""
    lines = read_ranks(ranks_path)
    if len(lines) > 64 << 20:
        raise ValueError("vocabulary file over 64 MB")
    sent = df.sparkSession.sparkContext.broadcast(lines)

    def make():
        v = vocabulary(sent.value, pattern, pieces, pairs)
        return (lambda t: v.encode(t) if t else b""), v.pieces.forget

    got = _mapped(df.drop("n_tokens"), text, make, "token_ids")
    return got.withColumn("n_tokens", (F.octet_length("token_ids") / 4).cast("long"))


def decode(df: DataFrame, ranks_path: str, ids: str = "token_ids") -> DataFrame:
    """df with decoded (binary), the bytes that token_ids stand for."""
    sent = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def make():
        v = tokens(sent.value)
        return (lambda x: v.decode(x) if x else b""), list

    return _mapped(df, ids, make, "decoded")
