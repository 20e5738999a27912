"""Token-id files: texts as ids of a public tokenizer, one after the other, with Elias-Fano coded document boundaries.

A file is: a magic word; the ids of its documents, little-endian, two bytes each if the vocabulary allows and four if not;
the starts of its documents and their end, Elias-Fano coded; their ids' column, Elias-Fano coded too, since it ascends; and
a foot of fixed size that says where these are. A reader takes the foot and the two codes and then reads any documents by
their place; no table of 64-bit offsets is kept. A file ends with the batch in which it reaches `file_ids` ids or
`file_docs` documents.

Texts are dealt out by ranges of the document id, sorted, tokenised and appended as they stream by, so a task holds a few
batches and the lengths of one file's documents. A file is written under a name of its own and becomes part of the result
when its row stands in the manifest, a Parquet table; a task that is repeated after a lost executor writes another file
under another name. Both go to the shared folder (or to `path`), through whatever file system its address names.

White space never takes part in a token of such a vocabulary, so words between ASCII blanks are tokenised on their own, and
words met before are looked up; texts of any length are taken whole, word by word.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citelake.stages import stage_path

from .common import bounded_batches, buckets_of, give_back, text_key, written
from .eliasfano import EliasFano, encode as elias_fano

MAGIC = b"TOKENID1"
#: id bytes, null ids, bytes of: ids, starts, column of ids; magic.
_FOOT = struct.Struct("<qqqqq8s")


#: A word of its own between words that are tokenised together, and how many go together.
BAR, TOGETHER = "|", 200


class Vocabulary:
    """A tokenizer of the tokenizers library. If its tokens never span white space, words are tokenised on their own and kept
    for the next time; if it lower-cases and ends a token with a run of letters, words are lower-cased and cut before a full
    stop or comma first, so that fewer are new. Else whole texts go to the library."""

    def __init__(self, path: str, words: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
        from tokenizers import Tokenizer

        self.tokenizer, self.words = Tokenizer.from_file(path), words
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        rules = self.tokenizer.to_str()
        rules = rules[: rules.index('"model"')]
        bar = self._ids([BAR])[0]
        self.by_word = '"Removed","invert":true' in rules and r"^\\s\\p{L}" in rules and len(bar) == 1
        self.folds, self.bar = self.by_word and '"Lowercase"' in rules and r"|[\\p{L}]+|" in rules, bar[0]
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.start, self.size, self.used = np.zeros(1 << 16, np.uint32), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        alone = [w for w in words if BAR in w]
        words = [w for w in words if BAR not in w]
        joined = self._ids([f" {BAR} ".join(words[i : i + TOGETHER]) + f" {BAR}" for i in range(0, len(words), TOGETHER)])
        flat = np.fromiter((i for ids in joined for i in ids), np.uint32, sum(map(len, joined)))
        bars = flat == self.bar
        sizes, flat = np.diff(np.flatnonzero(bars), prepend=-1) - 1, flat[~bars]
        if alone:
            got = self._ids(alone)
            words, sizes, flat = words + alone, np.concatenate([sizes, [len(ids) for ids in got]]), np.concatenate([flat, *(np.array(ids, np.uint32) for ids in got)])
        n = len(self.place)
        self.ids, self.start, self.size = (_room(a, m) for a, m in ((self.ids, self.used + len(flat)), (self.start, n + len(words)), (self.size, n + len(words))))
        self.ids[self.used : self.used + len(flat)] = flat
        self.start[n : n + len(words)], self.size[n : n + len(words)] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used += len(flat)
        self.place.update(zip(words, range(n, n + len(words)), strict=True))

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """An Arrow array of texts (null: empty) -> all their ids, and how many each has."""
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.by_word:
            got = self._ids(texts.to_pylist())
            return np.fromiter((i for ids in got for i in ids), np.uint32, sum(map(len, got))), np.fromiter(map(len, got), np.int64, len(got))
        if self.folds:
            low = pc.ascii_lower(texts)
            # strings of special tokens are looked for before texts are lower-cased, so these stay as they are; U+0130 is the
            # one letter whose lower case ends with a mark
            texts = pc.replace_substring_regex(texts if pc.any(pc.match_substring(low, "<|")).as_py() else low, r"([^\PL\x{130}])([.,])", r"\1 \2")
        lists = pc.ascii_split_whitespace(texts)
        per_text = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        words, which = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        if len(self.place) > self.words or self.used > 8 * self.words:
            self._clear()
        known = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        if len(new := np.flatnonzero(known < 0)):
            new_words = [words[i] for i in new.tolist()]
            self._learn(new_words)
            known[new] = np.fromiter(map(self.place.__getitem__, new_words), np.int64, len(new))
        size, start = self.size[known][which], self.start[known][which]
        ends = np.cumsum(size)
        ids = self.ids[np.repeat(start - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return ids, np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_text)])])


_KEPT: dict[tuple, Vocabulary] = {}


def kept(path: str) -> Vocabulary:
    """The file's vocabulary with the words it has met: a worker keeps the last one for its next task."""
    told = os.stat(path)
    key = path, told.st_mtime_ns, told.st_size
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Vocabulary(path)
    return _KEPT[key]


def _room(a: np.ndarray, n: int) -> np.ndarray:
    if n <= len(a):
        return a
    more = np.zeros(max(n, 2 * len(a)), a.dtype)
    more[: len(a)] = a
    return more


def _at(path: str):
    """File system and path of an address as Spark has it."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)


class Writer:
    """Appends documents to one file."""

    def __init__(self, path: str, width: int):
        system, where = _at(path)
        system.create_dir(where.rpartition("/")[0], recursive=True)
        self.out, self.path, self.kind = system.open_output_stream(where), path, f"<u{width}"
        self.out.write(MAGIC)
        self.sizes, self.docs, self.nulls, self.n, self.n_docs = [], [], 0, 0, 0

    def append(self, docs: list[int | None], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.out.write(ids.astype(self.kind).tobytes())
        there = [d for d in docs if d is not None]
        self.nulls += len(docs) - len(there)
        self.docs.append(np.array(there, np.int64))
        self.sizes.append(np.asarray(sizes, np.int64))
        self.n, self.n_docs = self.n + len(ids), self.n_docs + len(docs)

    def close(self) -> tuple[str, int, int]:
        """Path, documents and ids of the finished file."""
        sizes = np.concatenate(self.sizes)
        starts, docs = elias_fano(np.concatenate([[0], np.cumsum(sizes)])), elias_fano(np.concatenate(self.docs))
        width = int(self.kind[2:])
        self.out.write(starts + docs + _FOOT.pack(width, self.nulls, self.n * width, len(starts), len(docs), MAGIC))
        self.out.close()
        return self.path, self.n_docs, self.n


class Reader:
    """Documents of one file by their place in it."""

    def __init__(self, path: str):
        system, where = _at(path)
        self.file = system.open_input_file(where)
        whole = self.file.size()
        self.width, self.nulls, n_ids, n_starts, n_docs, magic = _FOOT.unpack(self.file.read_at(_FOOT.size, whole - _FOOT.size))
        if magic != MAGIC or whole != len(MAGIC) + n_ids + n_starts + n_docs + _FOOT.size:
            raise ValueError(f"{path} is no whole file of token ids")
        self.starts = EliasFano(self.file.read_at(n_starts, len(MAGIC) + n_ids))
        self.docs = EliasFano(self.file.read_at(n_docs, len(MAGIC) + n_ids + n_starts))

    def __len__(self) -> int:
        return len(self.starts) - 1

    def doc_ids(self, first: int, end: int) -> list[int | None]:
        known = max(first, self.nulls)
        return [None] * (min(end, self.nulls) - first) + self.docs.range(known - self.nulls, end - self.nulls).tolist()

    def document(self, i: int) -> np.ndarray:
        """Ids of document i of the file."""
        start, end = self.starts.range(i, i + 2).tolist()
        return self._ids(start, end)

    def _ids(self, start: int, end: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at((end - start) * self.width, len(MAGIC) + start * self.width), f"<u{self.width}")

    def blocks(self, ids: int = 1 << 20, docs: int = 1 << 14) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
        """All documents in order, a block of about so many ids at a time: document ids, starts (and the last end), ids."""
        first = 0
        while first < len(self):
            starts = self.starts.range(first, min(first + docs, len(self)) + 1)
            n = max(1, int(np.searchsorted(starts, starts[0] + ids, side="right")) - 1)
            yield self.doc_ids(first, first + n), starts[: n + 1], self._ids(int(starts[0]), int(starts[n]))
            first += n


def write(docs: DataFrame, vocabulary: str, end: int, doc_id: str = "doc_id", text: str = "text", path: str | None = None, file_ids: int = 1 << 26, file_docs: int = 1 << 20) -> DataFrame:
    """Writes all documents in ascending order of id (null first; rows of one id by a hash of their text, equal rows side by
    side), each followed by the id `end`. Returns the manifest: file (order of the files), path, n_docs, n_ids and first (ids
    of all files before). Null and empty texts are the end alone; an empty table gives no files.

    Ranges are cut by id, text hash and the row's place in its file, so that one id on a third of all rows, or as many equal
    rows, are cut too; the place decides nothing but where equal rows go. `vocabulary` is a path that every executor has."""
    spark = docs.sparkSession
    folder = (path or stage_path(spark, "token-ids")).rstrip("/")
    one, two = text_key(F.col(text))
    rows = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("text"), one.alias("h1"), two.alias("h2"))
    rows = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(buckets_of(spark), "d", "h1", "h2", "row").sortWithinPartitions("d", "h1", "h2", "row").select("d", "text")

    def write_files(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, known, out, done = TaskContext.get().partitionId(), kept(vocabulary), None, []
        for batch in batches:
            ids, sizes = known.encode(batch.column(1))
            with_ends = np.insert(ids, np.cumsum(sizes), end)
            out = out or Writer(f"{folder}/ids/{part:06d}-{len(done):06d}-{uuid.uuid4().hex}.bin", known.width)
            out.append(batch.column(0).to_pylist(), with_ends, sizes + 1)
            if out.n >= file_ids or out.n_docs >= file_docs:
                done, out = [*done, out.close()], None
        if out:
            done.append(out.close())
        give_back()
        if done:
            paths, n_docs, n_ids = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([part << 32 | i for i in range(len(done))]), pa.array(paths), pa.array(n_docs), pa.array(n_ids)], names=["file", "path", "n_docs", "n_ids"])

    with bounded_batches(spark):
        files = written(rows.mapInArrow(write_files, "file long, path string, n_docs long, n_ids long"), "token-id-files")
    # a row a file: a window over all of them is small
    before = F.sum("n_ids").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    manifest = files.withColumn("first", F.coalesce(before, F.lit(0)).cast("long"))
    manifest.write.parquet(f"{folder}/manifest")
    return open_files(spark, folder)


def open_files(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of files that were written to a path."""
    return spark.read.parquet(f"{path.rstrip('/')}/manifest")


def read(manifest: DataFrame) -> DataFrame:
    """A row for each document of the files, as they are read: doc_id, start (ids of all documents before it), n_tokens (its
    ids, the end included) and ids_crc32 (of its ids as little-endian unsigned 32-bit numbers). A file is one task's."""

    def read_files(batches):
        import pyarrow as pa

        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for doc_ids, starts, ids in Reader(path).blocks():
                    wide, at = ids.astype("<u4").tobytes(), ((starts - starts[0]) * 4).tolist()
                    crcs = [zlib.crc32(wide[a:b]) for a, b in zip(at, at[1:], strict=False)]
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts[:-1] + before), pa.array(np.diff(starts)), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = manifest.select("path", "first").repartition(buckets_of(manifest.sparkSession))
    return files.mapInArrow(read_files, "doc_id long, start long, n_tokens long, ids_crc32 long")
