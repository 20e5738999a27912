"""Texts move once to their document and once as chunks; what is counted and gathered there equals plain loops."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from citelake.operators import chapters, chunking, normalize, tables
from citelake.plans import hybrid
from citelake.sources import pages as source_pages

BLOCK = "doc_id string, version_id string, block_id string, page_no int, block_type string, text string, order_in_page int"


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def texts(spark):
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "12.5kV", "接地", "contents", "$x$", "说明: 3.0.6"]
    docs = []
    for d in range(12):
        lines = [rng.choice(["1 Title of it", "第一章 总则", "Running head of this book", " ".join(rng.choices(words, k=rng.randint(1, 14))) + rng.choice(["", ".", "。"])]) for _ in range(rng.choice([0, 3, 40, 500, 900]))]
        lines[::120] = ["Running head of this book"] * len(lines[::120])
        docs.append((d, "\n".join(lines) if d else None))
    return spark.createDataFrame(docs, "doc_id long, text string")


def test_texts_move_once_to_their_document(spark):
    docs = texts(spark).select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("v1").alias("version_id"), "text")
    pages = source_pages.text_to_pages(docs)
    assert exchanges(chapters.chapters(normalize.without_repeated_edges(normalize.blocks(pages)))) - exchanges(pages) <= 1
    assert exchanges(chapters.chapters(normalize.without_repeated_edges(normalize.blocks_of_texts(docs)))) == 1
    assert exchanges(hybrid.ingest_texts(texts(spark))) == 1  # chunks; chapters are written


def test_texts_equal_their_pages(spark):
    docs = texts(spark)
    named = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("v1").alias("version_id"), "text")
    cols = BLOCK.replace(" string", "").replace(" int", "").split(", ")
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(normalize.blocks_of_texts(named).select(cols)) == rows(normalize.blocks(source_pages.text_to_pages(named)).select(cols))
    got = rows(hybrid.ingest_texts(docs))
    assert got == rows(hybrid.ingest(hybrid.document_pages(docs))) and len(got) > 100
    assert any("explanation" in r for r in got)


def blocks_of(seed):
    rng, out = random.Random(seed), []
    for d in range(8):
        for page in range(1, rng.choice([1, 2, 4, 9]) + 1):
            for i in range(1, rng.randint(1, 7) + 1):
                said = rng.choice(["Running head", "Other head 7", "第一章 总则", "2 General", "x" * rng.choice([1, 30, 700, 1300])])
                out.append((f"d{d % 4}", f"v{d // 4}", f"b_{page}_{i}", page, "paragraph", said if i > 1 else rng.choice(["Running head", said]), i))
    return out


@pytest.mark.parametrize("batch", [1, 3, 10_000])
def test_chapters_equal_a_loop(spark, batch):
    rows = blocks_of(batch)
    docs = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[3], r[6])):
        docs[r[:2]].append(r)
    want = {}
    for doc, own in docs.items():
        parts = []
        for r in own:
            titled = r[5] in ("第一章 总则", "2 General")
            parts = [*parts, [r]] if titled or not parts else [*parts[:-1], [*parts[-1], r]]
        made, chars = [], 0
        for p in parts:
            size = len("\n".join(r[5] for r in p))
            if made and chars < 1200:
                made[-1].append(p)
                chars += 1 + size
            else:
                made.append([p])
                chars = size
        for no, ch in enumerate(made, 1):
            every, titled = [r for p in ch for r in p], ch[0][0][5] in ("第一章 总则", "2 General")
            title = every[0][5] if titled else f"临时章节_{every[0][3]}"
            want[(*doc, f"ch_{no}")] = (title, every[0][3], every[-1][3], [r[2] for r in every], "\n".join(r[5] for r in every), "normal" if titled and len(ch) == 1 else "degenerate")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(batch))
    try:
        got = chapters.chapters(spark.createDataFrame(rows, BLOCK)).collect()
    finally:
        spark.conf.set(key, before)
    assert {(g.doc_id, g.version_id, g.chapter_id): (g.title, g.start_page, g.end_page, g.block_ids, g.text, g.status) for g in got} == want
    assert all([b.block_id for b in g.blocks] == g.block_ids and "\n".join(b.text for b in g.blocks) == g.text for g in got)


def test_repeated_edges_equal_a_loop(spark):
    rows = [r for seed in range(3) for r in ((f"{seed}{r[0]}", *r[1:]) for r in blocks_of(seed))]
    sign = lambda t: "".join(c for c in t.lower() if c.isalpha())
    page, doc = defaultdict(list), defaultdict(set)
    for r in sorted(rows, key=lambda r: r[6]):
        page[(*r[:2], r[3])].append(r)
        doc[r[:2]].add(r[3])
    votes = Counter()
    for own in page.values():
        for r in [*own[:2], *own[-2:]]:
            if 6 <= len(sign(r[5])) <= 80:
                votes[(*r[:2], sign(r[5]))] += 1
    gone = lambda r: len(doc[r[:2]]) >= 3 and votes[(*r[:2], sign(r[5]))] >= max(3, int(len(doc[r[:2]]) * 0.35)) and (r[6] <= 2 or r[6] >= max(1, len(page[(*r[:2], r[3])]) - 1))
    got = normalize.without_repeated_edges(spark.createDataFrame(rows, BLOCK)).select(*[c.split()[0] for c in BLOCK.split(", ")]).collect()
    want = [r for r in rows if not gone(r)]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) < len(rows)


def test_explanations_come_with_their_chunks(spark):
    chunk = [("d", "v", "ch_1", f"ch_1_ck_{i}", i, 1, 1, said, ["b"], clause, clause, "", 0) for i, (said, clause) in enumerate([("条文说明 3.0.6 接地", "3.0.6"), ("说明：见 4.1", None), ("说明：无", None), ("3.0.7 别的", "3.0.7")], 1)]
    got = tables.with_explanations(spark.createDataFrame(chunk, chunking.SCHEMA), "chunk_no").collect()
    assert [(g.chunk_id, g.source_type, g.clause_id, g.clause_node_id) for g in got if g.source_type != "text"] == [("exp_ch_1_1", "explanation", "3.0.6", None), ("exp_ch_1_2", "explanation", "4.1", None)]
    assert [g.chunk_id for g in got if g.source_type == "text"] == [f"ch_1_ck_{i}" for i in range(1, 5)]
