import pytest
from pyspark.sql import functions as F

from citelake.operators import evaluate, evidence, registry
from citelake.streaming import status

CITE = {"doc_name": "规范A", "doc_id": "d1", "page_start": 3, "page_end": 3, "excerpt": "3.0.6 外壳必须接地。", "chunk_text": "3.0.6 外壳必须接地。", "route": "dense", "source_type": "text", "page_type": None, "table_id": None, "row_index": None, "clause_id": "3.0.6", "table_repr": None}


def cite(**kw):
    return {**CITE, **kw}


def test_compatible_citations_merge():
    got = evidence.merge_citations([cite(), cite(doc_name="", excerpt="3.0.6 外壳必须接地。电阻应测量。"), cite(page_start=4, page_end=4)])
    assert [c["merged_count"] for c in got] == [2, 1]
    assert got[0]["excerpt"] == "3.0.6 外壳必须接地。电阻应测量。" and got[0]["doc_name"] == "规范A"


def test_names_come_from_the_longest_known():
    got = evidence.merge_citations([cite(doc_name=""), cite(page_start=9, page_end=9, doc_name="规范全称A")])
    assert {c["doc_name"] for c in got} == {"规范全称A"}


def test_sentences_are_said_once():
    assert evidence.once_each("设备外壳必须接地。设备外壳必须接地。短。短。") == "设备外壳必须接地。 短。 短。"


def test_constraints_keep_the_best_of_a_clause_and_drop_what_is_covered():
    rows = [cite(), cite(source_type="section_summary", chunk_text="章节：总则 外壳必须接地。", excerpt="章节：总则 外壳必须接地。"), cite(clause_id="", source_type="", chunk_text="外壳必须接地。", excerpt="外壳必须接地。"), cite(clause_id="4.1.1", page_start=8, page_end=8, chunk_text="4.1.1 宜设围栏并挂标志。", excerpt="4.1.1 宜设围栏并挂标志。")]
    got = evidence.shape_constraints("接地有哪些规定", rows)
    assert [c["clause_id"] for c in got] == ["3.0.6", "4.1.1"]
    items = [evidence.constraint_item(c) for c in got]
    assert [i["risk_level"] for i in items] == ["high", "low"] and items[0]["is_mandatory"] and items[0]["guard_lines"] == ["3.0.6 外壳必须接地。"]
    assert evidence.summary("q", items).startswith("共提取 2 条约束，其中强制性条款 1 条，高风险条款 1 条")


def test_clause_ranking_and_roots():
    rows = [cite(clause_id="4.8.2"), cite(clause_id="3.0.6"), cite(clause_id="3.0.6", page_start=4)]
    assert [c for c, _ in evidence.rank_clauses("接地", rows)] == ["3.0.6", "4.8.2"]
    assert evidence.rank_roots("接地", rows)[0][0] == "3.0"


def test_citations_by_query(spark):
    schema = "query_id long, question string, rank int, doc_name string, doc_id string, page_start int, page_end int, excerpt string, chunk_text string, route string, source_type string, page_type string, table_id string, row_index int, clause_id string, table_repr string"
    rows = [(q, "接地有哪些规定", r, *[c[k] for k in CITE]) for q, r, c in ((1, 1, cite()), (1, 2, cite()), (2, 1, cite(clause_id="9.9")))]
    df = spark.createDataFrame(rows, schema)
    assert {(r.query_id, r.merged_count) for r in evidence.dedupe_citations(df).collect()} == {(1, 2), (2, 1)}
    assert {(r.query_id, r.clause_id) for r in evidence.constraints(df).collect()} == {(1, "3.0.6"), (2, "9.9")}
    assert {(r.query_id, r.clause_id) for r in evidence.clause_ranking(df).collect()} == {(1, "3.0.6"), (2, "9.9")}


SPEC = "struct<doc_id:string,version_id:string,doc_name:string,chapter_id:string,clause_id:string,clause_no:string,article_no:string,constraint_type:string,is_mandatory:boolean,page:int>"
SAMPLE = f"query_id int, expected_doc_id string, expected_version_id string, expected_doc_name string, expected_pages array<int>, expected_clause_id string, expected_clause_ids array<string>, expected_is_mandatory boolean, expected_constraint_type string, relevant_any array<{SPEC}>, constraint_specs array<{SPEC}>"
HIT = "query_id int, rank int, doc_id string, version_id string, doc_name string, chapter_id string, clause_id string, clause_no string, article_no string, constraint_type string, is_mandatory boolean, page_start int, page_end int, excerpt string, chunk_text string"


def sample(q, doc=None, pages=None, clauses=None, must=None, kind=None, any_=None, specs=None):
    return (q, doc, None, None, pages, None, clauses, must, kind, any_, specs)


def hit(q, rank, doc, clause=None, page=1, name="n", must=None, kind=None, said="x"):
    return (q, rank, doc, "v", name, None, clause, None, None, kind, must, page, page, said, said)


def measure(spark, samples, hits, k=10):
    rows = evaluate.per_sample(spark.createDataFrame(samples, SAMPLE), spark.createDataFrame(hits, HIT), k)
    return evaluate.metrics(rows).first()


def test_ranks(spark):
    got = measure(spark, [sample(1, "a"), sample(2, "a"), sample(3, "a")], [hit(1, 1, "a", name=None, said=""), hit(2, 1, "b"), hit(2, 2, "a", said=""), hit(3, 1, "b")])
    assert got.query_count == 3 and got.hit_at_5 == pytest.approx(2 / 3) and got.mrr == 0.5 and got.evidence_hit_rate_at_10 == 0 and got.citation_completeness == 0 and not got.passed


def test_clauses_and_constraints(spark):
    got = measure(spark, [sample(1, "a", clauses=["3.0.6"], must=True, kind="mandatory")], [hit(1, 1, "a", "3.0.6", must=True, kind="mandatory")])
    assert (got.clause_hit_at_k, got.constraint_coverage, got.citation_completeness) == (1.0, 1.0, 1.0)


def test_any_spec_and_pages(spark):
    spec = (None,) * 4 + ("3.0.6",) + (None,) * 5
    got = measure(spark, [sample(1, any_=[spec]), sample(2, "a", pages=[5])], [hit(1, 1, "a", "9.9"), hit(1, 2, "a", "3.0.6"), hit(2, 1, "a", page=4), hit(2, 2, "a", page=5)])
    assert got.mrr == 0.5 and got.clause_samples == 1 and got.clause_hit_at_k == 1.0


def test_nothing_expected_is_never_relevant(spark):
    assert measure(spark, [sample(1)], [hit(1, 1, "a")]).mrr == 0
    assert measure(spark, [sample(1, "a")], [])["mrr"] == 0


def test_scores(spark):
    v = lambda *xs: [F.lit(x) for x in xs]
    got = spark.range(1).select(evaluate.score_ie(*v(0.8, 0.7, 0.9, 1.0, 5.0, 8.0)), evaluate.score_qa(*v(1.0, 0.8, 0.9, 1.0)), evaluate.score_retrieval(*v(0.9, 1.0, 0.8, 0.7)), evaluate.amount_close(F.lit(100.9), F.lit(100.0)), evaluate.length_close(F.lit(1.2), F.lit(1.0))).first()
    assert [round(x, 6) if isinstance(x, float) else x for x in got] == [77, 91, 89, True, False]


def test_registry(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "id int, v string")
    assert {(r.id, r.v) for r in registry.upsert(base, new, "id").collect()} == {(1, "a"), (2, "B"), (3, "C")}
    assert [r.id for r in registry.insert_absent(base, new, "id").collect()] == [3]
    docs = spark.createDataFrame([("d1",), ("d2",)], "id string")
    versions = spark.createDataFrame([("v1", "d1"), ("v2", "d2"), ("v3", "d2")], "id string, doc_id string")
    left, kept = registry.delete_version(docs, versions, "v1")
    assert [r.id for r in left.collect()] == ["d2"] and kept.count() == 2
    left, kept = registry.delete_version(docs, versions, "v2")
    assert left.count() == 2 and kept.count() == 2


def test_upload_checks(spark):
    ok = b"%PDF-1.7 body %%EOF"
    rows = [("a.pdf", "application/pdf", ok), ("a.txt", "text/plain", ok), ("a.pdf", "application/pdf", b""), ("a.pdf", "application/pdf", b"MZ" + ok), ("a.pdf", "application/pdf", b"#!/bin/sh"), ("a.pdf", "application/pdf", b"hello"), ("a.pdf", "application/pdf", b"%PDF-1.7 x")]
    df = spark.createDataFrame(rows, "n string, m string, c binary")
    assert [r[0] for r in df.select(registry.reject_code(F.col("n"), F.col("m"), F.col("c"))).collect()] == [None, "extension", "size", "executable", "script", "no_header", "no_trailer"]


def test_stream_keeps_the_newest(spark, tmp_path):
    schema, state = "user_id int, ts int, s string", str(tmp_path / "state")
    assert status.read_latest(spark, state, schema, ["user_id"], ["ts"]).count() == 0
    for rows in [[(1, 1, "a"), (2, 1, "b")], [(1, 3, "c"), (1, 2, "x")]]:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        status.run_latest(stream, state, str(tmp_path / "ck"), ["user_id"], ["ts"]).awaitTermination()
    got = {(r.user_id, r.s) for r in status.read_latest(spark, state, schema, ["user_id"], ["ts"]).collect()}
    assert got == {(1, "c"), (2, "b")}


def test_state_is_compacted_and_batches_can_be_repeated(spark, tmp_path):
    schema, state = "k int, ts int", str(tmp_path / "state")
    sink = status.fold_latest(spark, state, ["k"], ["ts"], every=3)
    for number in (0, 1, 1, 2, 2, 3):
        sink(spark.createDataFrame([(1, number), (10 + number, number)], schema), number)
    assert {tuple(r) for r in status.read_latest(spark, state, schema, ["k"], ["ts"]).collect()} == {(1, 3), (10, 0), (11, 1), (12, 2), (13, 3)}
    for number in (4, 5, 6, 7, 8, 8):  # the last is repeated once older folders are gone
        sink(spark.createDataFrame([(1, number), (10 + number, number)], schema), number)
    assert {tuple(r) for r in status.read_latest(spark, state, schema, ["k"], ["ts"]).collect()} == {(1, 8), *((10 + n, n) for n in range(9))}
    assert sorted(p.name for p in (tmp_path / "state").iterdir()) == ["batch=6", "batch=7", "whole=5", "whole=8"]


def test_breaker(spark):
    rows = [("a", f"2026-01-01 00:00:{i:02d}", False) for i in range(6)] + [("b", f"2026-01-01 00:00:{i:02d}", i == 3) for i in range(6)] + [("c", "2026-01-01 00:00:00", False)]
    calls = spark.createDataFrame(rows, "provider string, ts string, ok boolean").withColumn("ts", F.to_timestamp("ts"))
    got = {r.provider: r.open for r in status.breaker_open(calls, "2026-01-01 00:01:00").collect()}
    assert got == {"a": True, "b": False, "c": False}
    assert not any(r.open for r in status.breaker_open(calls, "2026-01-01 01:00:00").collect())
