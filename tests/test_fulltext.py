"""The kept full-text index against the search that reads every text."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from citelake.operators import fulltext, retrieval
from citelake.operators.fulltext import FullTextIndex

PAGES = "doc_id string, page_no int, text string"


def texts(seed, n):
    """Few very frequent words, some of middling frequency, many rare ones."""
    rng = random.Random(seed)
    words = ["the", "of", "and"] * 60 + [f"m{i}" for i in range(20)] * 6 + [f"r{i}" for i in range(400)]
    return [(f"d{i // 3}", i % 3, " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 30, 90])))) for i in range(n)]


QUESTIONS = [
    "the", "of and", "the of and", '"the of"', '"of the and" r1', "m1", "m1 m2", "m3 or m4", '"m5 the" or "m6 of"', "the or of", "r5", "r5 r6 or m7", "absent", "absent or r9", "the absent", "", None, "...", '"m1 m1"', "m8 the m8", "-m9 | r1",
    'the "and of" m10', "or", "m11 or",
]


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(list(enumerate(QUESTIONS)), "query_id long, query string")


def rows(df):
    return sorted(((r.query_id, r.doc_id, r.page_no, r.score, r.rank) for r in df.collect()), key=str)


@pytest.mark.parametrize("k", [1, 7])
def test_index_gives_what_reading_every_text_gives(spark, tmp_path, monkeypatch, asked, k):
    monkeypatch.setattr(fulltext, "BLOCK", 16)
    data = [*texts(1, 900), ("x", None, "the of r5"), (None, 4, "the of r5"), ("y", 1, None)]
    pages = spark.createDataFrame(data, PAGES).repartition(5)
    index = FullTextIndex(spark, str(tmp_path / f"fts{k}"))
    index.add(pages, files=6)
    want = rows(retrieval.fts_best(pages, asked, k))
    assert rows(index.search(asked, k)) == want and len(want) > 10 * k


def test_batches_replace_delete_and_compact(spark, tmp_path, asked):
    first, second = texts(2, 300), texts(3, 120)
    index = FullTextIndex(spark, str(tmp_path / "fts"))
    index.add(spark.createDataFrame(first, PAGES), files=3)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "fts").rglob("*.parquet")}
    index.add(spark.createDataFrame(second, PAGES), files=2)
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())  # nothing is written anew
    index.delete(spark.createDataFrame([("d1", 0), ("d50", 2), ("none", 9)], "doc_id string, page_no int"))
    alive = {(d, p): t for d, p, t in [*first, *second]}
    alive = [(d, p, t) for (d, p), t in alive.items() if (d, p) not in {("d1", 0), ("d50", 2)}]
    want = rows(retrieval.fts_best(spark.createDataFrame(alive, PAGES), asked, 5))
    reopened = FullTextIndex(spark, str(tmp_path / "fts"))
    assert len(reopened.runs()) == 3 and rows(reopened.search(asked, 5)) == want
    reopened.compact(files=4)
    assert len(reopened.runs()) == 1 and reopened.runs()[0].pages == len(alive) and rows(reopened.search(asked, 5)) == want
    reopened.vacuum()
    assert len([p for p in (tmp_path / "fts").iterdir() if p.name.startswith("run-")]) == 1 and rows(reopened.search(asked, 5)) == want


def test_few_files_are_opened_and_blocks_passed_over(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fulltext, "BLOCK", 16)
    monkeypatch.setattr(fulltext, "PROBE", 40)
    pages = spark.createDataFrame([(f"d{i}", 1, " ".join(["the"] * (1 + i % 3) + [f"w{i}"]) if i % 400 else "the " * 50) for i in range(4000)], PAGES).repartition(4)
    index = FullTextIndex(spark, str(tmp_path / "fts"))
    index.add(pages, files=16)
    ask = lambda q: spark.createDataFrame([(1, q)], "query_id long, query string")
    index.search(ask("w17"), 3).collect()
    opened = [n for kind, _, n in index.opened if kind == "blocks"]
    all_blocks = [r["n"] for r in index.runs()[0].files if r["kind"] == "blocks"]
    assert sum(opened) < 0.4 * sum(all_blocks)
    candidates = []
    scored = FullTextIndex._scored
    monkeypatch.setattr(FullTextIndex, "_scored", lambda self, found, *rest: candidates.append(found.count()) or scored(self, found, *rest))
    best = index.search(ask("the"), 5).collect()
    assert [r.score for r in best] == [5.0] * 5 and len(candidates) == 2 and sum(candidates) < 400  # of 4,000 pages that hold it
    assert index.search(ask("the"), 5).select("doc_id").collect() == retrieval.fts_best(pages, ask("the"), 5).select("doc_id").collect()


def test_an_empty_index(spark, tmp_path, asked):
    index = FullTextIndex(spark, str(tmp_path / "fts"))
    assert index.search(asked, 3).count() == 0 and index.compact() is None
    index.add(spark.createDataFrame([], PAGES))
    assert index.search(asked, 3).count() == 0
    index.add(spark.createDataFrame([("a", 1, "the of")], PAGES))
    assert [(r.query_id, r.doc_id) for r in index.search(asked.where("query_id = 1 or query_id = 0"), 3).collect()] == [(0, "a")]


def test_covers_are_at_most_units_times_the_rarest_count():
    rng = random.Random(5)
    for _ in range(300):
        words = [rng.choice("abcd") for _ in range(rng.randrange(1, 40))]
        places = {w: np.flatnonzero(np.array(words) == w) for w in set(words)}
        units = [(w,) for w in sorted(places)]
        if len(words) > 3 and rng.random() < 0.5:
            units.append((words[1], words[2]))
        score, rarest = retrieval.cover_density([units], places), min(len(p) for p in places.values())
        assert score <= fulltext.most_covers(len(units), rarest) + 1e-12


def test_packed_postings_come_back_and_are_few_rows(spark, monkeypatch):
    monkeypatch.setattr(fulltext, "CUT", 16)
    data = [(f"d{i}", 1, t) for i, (_, _, t) in enumerate(texts(7, 400))] + [("long", 1, "x " * 70_000 + "y"), ("none", 1, None)]
    pages, chunks = fulltext.page_words(spark.createDataFrame(data, PAGES).coalesce(2))
    by_page = {r.page: r.doc_id for r in pages.collect()}
    assert sorted(by_page) == list(range(len(data)))
    got = chunks.collect()
    n = np.array([r.n for r in got])
    where, sizes, at = fulltext.unpack(fulltext.pa.array([bytes(r.packed) for r in got], fulltext.pa.binary()), n, np.array([r.page for r in got]))
    said = {d: t for d, _, t in data}
    terms = np.repeat([r.term for r in got], n)
    found = {(t, by_page[p]): a.tolist() for t, p, a in zip(terms, where.tolist(), np.split(at, np.cumsum(sizes)[:-1]), strict=True)}
    want = {}
    for doc, text in said.items():
        for i, w in enumerate((text or "").split()):
            want.setdefault((w, doc), []).append(i)
    assert found == want and len(got) < len(want) / 3  # a row a posting before
    for r, last, most in zip(got, where[np.cumsum(n) - 1], np.maximum.reduceat(sizes, np.cumsum(n) - n), strict=True):
        assert (r.last, r.most) == (last, most)


def test_rows_that_reach_into_several_slices_stand_once_in_each(spark):
    chunk = fulltext._rows(fulltext.pa.array(["a", "b"]), np.array([3, 9, 17, 4]), np.array([1, 2, 1, 1]), np.array([5, 1, 8, 0, 2]), np.array([3, 1]))
    rows = spark.createDataFrame([(t, s, 3, p, n, b) for t, s, p, n, b in [("a", s, 3, 3, chunk[5][0].as_py()) for s in (0, 1, 2)] + [("b", 0, 4, 1, chunk[5][1].as_py())]], "term string, slice long, level int, page long, n int, packed binary")
    got = rows.coalesce(1).sortWithinPartitions("term", "slice", "page").mapInArrow(fulltext.merge_rows, "term string, slice long, n int, most int, pages array<long>, at array<array<int>>").collect()
    assert [tuple(r) for r in got] == [("a", 0, 1, 1, [3], [[5]]), ("a", 1, 1, 2, [9], [[1, 8]]), ("a", 2, 1, 1, [17], [[0]]), ("b", 0, 1, 1, [4], [[2]])]


def test_blocks_of_other_words_are_left_out_for_many_words_too(spark, tmp_path):
    index = FullTextIndex(spark, str(tmp_path / "fts"))
    index.add(spark.createDataFrame([("d", 1, " ".join(f"w{i}" for i in range(2_000)))], PAGES), files=2)
    wanted = {f"w{i}" for i in range(fulltext.FEW_WORDS + 50)}
    assert {r.term for r in index.runs()[0].table("blocks", wanted).collect()} == wanted
