import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from citelake.functions import embedding, text
from citelake.operators import filters, retrieval
from citelake.plans import hybrid

ENTITIES = [("person", "张建国", "p:1001"), ("project", "东城", "j:1")]


def parse(spark, question):
    e = spark.createDataFrame(ENTITIES, "kind string, name string, id string")
    q = spark.createDataFrame([(1, question)], "query_id int, question string")
    return filters.parse_questions(q, e).first()


def test_question_to_filter(spark):
    r = parse(spark, "张建国项目经理110kV且合同金额5000万")
    assert [c["key"] for c in r.must] == ["val_voltage_kv", "val_contract_amount_w", "entity_person_ids", "rel_person_role"]
    assert r.must[0]["gte"] == 110 and r.must[1]["gte"] == 5000 and r.must[2]["any_of"] == ["p:1001"] and r.must[3]["any_of"] == ["p:1001|项目经理"]


@pytest.mark.parametrize(("q", "bounds"), [("不低于110kV", {"gte": 110.0}), ("不超过110kV", {"lte": 110.0}), ("高于110kV", {"gt": 110.0}), ("低于110kV", {"lt": 110.0}), ("电压为110kV", {"gte": 110.0, "lte": 110.0}), ("110kV", {"gte": 110.0})])
def test_comparison_words(spark, q, bounds):
    c = parse(spark, q).must[0]
    assert {k: c[k] for k in ("gte", "lte", "gt", "lt") if c[k] is not None} == bounds


def test_identifiers_in_questions(spark):
    r = parse(spark, "GB 50150-2016 第3.0.6条 必须 证书 AB-12-34")
    spec = filters.spec_of(r.must)
    assert spec["must"] == [
        {"key": "clause_no", "match": {"any": ["3.0.6"]}}, {"key": "is_mandatory", "match": {"value": "true"}},
        {"key": "standard_no", "match": {"any": ["GB 50150-2016", "GB50150-2016"]}}, {"key": "certificate_no", "match": {"value": "AB-12-34"}},
    ]


def holds(row: dict, spec: dict) -> bool:
    """The filter language row by row."""
    for c in spec["must"]:
        v = row.get(c["key"])
        if v is None:
            v = row.get({"clause_no": "clause_id", "clause_id": "clause_no"}.get(c["key"], ""))
        vs = v if isinstance(v, list) else [v]
        m, r = c.get("match", {}), c.get("range", {})
        if m.get("any") is not None and not set(m["any"]) & set(vs) or m.get("value") is not None and m["value"] not in vs:
            return False
        if r:
            if v is None or isinstance(v, list):
                return False
            tests = {"gte": v >= r.get("gte", v), "lte": v <= r.get("lte", v), "gt": v > r["gt"] if "gt" in r else True, "lt": v < r["lt"] if "lt" in r else True}
            if not all(tests.values()):
                return False
    return True


def test_compiled_filters_equal_row_evaluation(spark):
    rows = [
        {"id": 1, "clause_id": "3.0.6", "clause_no": None, "kv": 110, "ids": ["a", "b"], "must": True},
        {"id": 2, "clause_id": None, "clause_no": "3.0.6", "kv": 35, "ids": [], "must": False},
        {"id": 3, "clause_id": "4.1", "clause_no": "4.1", "kv": None, "ids": None, "must": None},
    ]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "id int, clause_id string, clause_no string, kv int, ids array<string>, must boolean")
    specs = [
        [{"key": "clause_no", "match": {"any": ["3.0.6"]}}], [{"key": "clause_id", "match": {"value": "4.1"}}], [{"key": "kv", "range": {"gte": 35, "lt": 110}}], [{"key": "kv", "range": {"gt": 35}}],
        [{"key": "ids", "match": {"any": ["b", "z"]}}], [{"key": "must", "match": {"value": True}}], [{"key": "ids", "match": {"any": []}}], [{"key": "absent", "match": {"value": "x"}}], [{"key": "ids", "range": {"gte": 1}}], [],
    ]
    for must in specs:
        got = {r.id for r in filters.apply_filter(df, {"must": must}).collect()}
        assert got == {r["id"] for r in rows if holds(r, {"must": must})}, must
        pred = filters.compile_filter({"must": must}, df.schema)
        assert df.where(~pred).count() == 3 - len(got)  # never null


def hits(spark, *ids, q=1):
    return spark.createDataFrame([(q, i, str(x), 1.0, "r") for i, x in enumerate(ids, 1)], "query_id int, rank int, id string, score double, route string")


def test_rrf(spark):
    got = [r.id for r in retrieval.fuse_rrf([hits(spark, "a", "b"), hits(spark, "b", "c")], 10).orderBy("rank").collect()]
    assert got == ["b", "a", "c"]
    one, two = hits(spark, "a", "b"), hits(spark, "c", "d")
    sums = [{r.id: round(r.rrf, 9) for r in retrieval.fuse_rrf(x, 10).collect()} for x in ([one, two], [two, one])]
    assert sums[0] == sums[1]


def test_keyword_score(spark):
    df = spark.createDataFrame([("abc abc x", ["abc", "zz"])], "t string, terms array<string>")
    got = df.select(retrieval.keyword_score(F.col("t"), F.col("terms"))).first()[0]
    assert got == pytest.approx((1 + 3 / 12) * math.log(3))


def test_lexical_gate(spark):
    rows = [(1, i, t, ["接地"]) for i, t in enumerate(["接地 接地 接地", "接地", "无关"], 1)] + [(2, i, "无", ["接地"]) for i in range(1, 6)] + [(3, 1, "无", ["接地"])]
    df = spark.createDataFrame(rows, "query_id int, rank int, t string, terms array<string>")
    got = {(r.query_id, r["rank"]) for r in retrieval.lexical_gate(df, F.col("t")).collect()}
    assert got == {(1, 1), (1, 2), (2, 1), (2, 2), (2, 3), (3, 1)}


def test_dense_top_k(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 0.0])], "ordinal int, vector array<double>")
    q = spark.createDataFrame([(7, [0.0, 2.0])], "query_id int, query_vector array<double>")
    got = retrieval.dense_search(rows, q, 2).orderBy("rank").collect()
    assert [(r.ordinal, round(r.score, 6)) for r in got] == [(2, 0.8), (1, 0.0)]


def test_full_text_needs_all_words_and_prefers_close_ones(spark):
    pages = spark.createDataFrame([("a", 1, "red fox runs"), ("b", 1, "red cow and then a fox"), ("c", 1, "red only")], "doc_id string, page_no int, text string")
    q = spark.createDataFrame([(1, ["red", "fox"])], "query_id int, terms array<string>")
    assert [r.doc_id for r in retrieval.fts_search(retrieval.inverted_index(pages), q, 5).orderBy("rank").collect()] == ["a", "b"]


def test_sidecar_and_structured(spark):
    pages = spark.createDataFrame([("a", 1, "电容器 接地"), ("b", 1, "电容器"), ("c", 1, "无")], "doc_id string, page_no int, text string")
    q = spark.createDataFrame([(1, "电容器接地", ["电容器", "接地"])], "query_id int, query string, tokens array<string>")
    got = retrieval.sidecar_search(pages, q, 5).orderBy("rank").collect()
    assert [r.doc_id for r in got] == ["a", "b"] and got[0].score > 28
    assets = spark.createDataFrame([("a", 3, '{"certificate":"AB-12-34"}'), ("b", 0, '{"x":"AB-12-34"}')], "doc_id string, page_no int, data_json string")
    s = spark.createDataFrame([(1, ["AB-12-34"])], "query_id int, tokens array<string>")
    assert [(r.doc_id, r.score) for r in retrieval.structured_search(assets, s, 5).collect()] == [("a", 10.0)]


def plan(spark, question, scoped=False):
    q = spark.createDataFrame([(1, question, [], [], scoped)], "query_id int, question string, clauses array<string>, standards array<string>, doc_scoped boolean")
    from citelake.functions import terms

    q = q.withColumns({"clauses": F.lit(terms.clause_tokens(question)).cast("array<string>"), "standards": F.lit(terms.standard_tokens(question)).cast("array<string>")})
    return retrieval.plan_questions(q).first()


def test_route_plan(spark):
    p = plan(spark, "GB 50150 第3.0.6条")
    assert p.precision and not p.use_sparse and p.reason == "precision_disable_sparse"
    assert plan(spark, "GB 50150 第3.0.6条", scoped=True).use_sparse
    p = plan(spark, "4.3 章有哪些规定")
    assert p.listing_query and p.prefixes == ["4.3"]
    assert plan(spark, "参数表").table_query and plan(spark, "为什么要接地").reason == "default"
    assert plan(spark, "投标文件的商务条款").query_doc_type == "投标文件"


ROWS = [("a", "d1", "3.0.6", "text", "3.0.6 电气设备外壳必须接地。"), ("b", "d1", "3.0.6", "explanation", "3.0.6 条文说明：接地的理由。"), ("c", "d1", "4.3.1", "text", "4.3.1 电容器安装应符合规定。"), ("e", "d2", None, "text", "变压器的运输与保管。")]


def search(spark, question, k=5):
    rows = spark.createDataFrame([(*r, i) for i, r in enumerate(ROWS)], "id string, doc_id string, clause_id string, source_type string, chunk_text string, ordinal int")
    q = spark.createDataFrame([(1, question)], "query_id int, question string")
    return [(r.id, r.route) for r in hybrid.search(hybrid.plain_rows(rows), q, k).orderBy("rank").collect()]


def test_exact_clause_comes_first_and_drops_explanations(spark):
    assert search(spark, "第3.0.6条的内容") == [("a", "clause_exact")]


def test_chapter_prefix(spark):
    assert search(spark, "4.3 章电容器安装有哪些规定") == [("c", "chapter_prefix")]


def test_fused_routes(spark):
    assert search(spark, "变压器运输")[0][0] == "e"


def test_explanations_attach(spark):
    rows = hybrid.plain_rows(spark.createDataFrame([(*r, i) for i, r in enumerate(ROWS)], "id string, doc_id string, clause_id string, source_type string, chunk_text string, ordinal int"))
    anchors = retrieval.citations(rows.where("id = 'a'").withColumns({"query_id": F.lit(1), "rank": F.lit(1), "route": F.lit("dense")}))
    got = retrieval.attach_explanations(anchors, rows).orderBy("source_type").collect()
    assert [r.source_type for r in got] == ["explanation", "text"]


def test_stable_hit_id(spark):
    got = spark.range(1).select(text.stable_hit_id(F.lit("sparse"), F.lit("d"), F.lit(3), F.lit("x"))).first()[0]
    import hashlib

    assert got == "sparse:d:3:" + hashlib.sha256("sparse|d|3|x".encode()).hexdigest()[:12]


FILTERED = [("a", "d1", 110, "GB 50149-2010", "变压器运输保管 变压器运输保管", 0), ("b", "d2", 10, "GB 50149-2010", "变压器运输", 1), ("c", "d3", 220, "GB 50150-2016", "变压器", 2)]


def filtered(spark, question, k=5, **how):
    rows = spark.createDataFrame(FILTERED, "id string, doc_id string, val_voltage_kv int, standard_no string, chunk_text string, ordinal int")
    q = spark.createDataFrame([(1, question), (2, "变压器运输")], "query_id int, question string")
    got = hybrid.search(hybrid.plain_rows(rows), q, k, routes={"keyword": 1, "sparse": 1, "dense": 1}, **how).collect()
    return {(r.query_id, r.id, r.route) for r in got}


def test_a_questions_filter_holds_before_the_keyword_cut(spark):
    got = filtered(spark, "不超过35kV的变压器运输")
    assert {i for q, i, r in got if q == 1 and r != "sparse"} == {"b"}  # "a" has the best score, but 110 kV
    assert "a" in {i for q, i, r in got if q == 2}  # the other question has no bound


def test_a_standard_is_a_filter(spark):
    assert {i for q, i, _ in filtered(spark, "GB 50150-2016 变压器") if q == 1} == {"c"}


def test_a_callers_filter_holds_on_every_route(spark):
    for spec in ({"key": "doc_id", "match": {"value": "d2"}}, {"key": "doc_id", "match": {"any": ["d2", "d9"]}}):
        assert {i for _, i, _ in filtered(spark, "变压器运输保管", search_filter={"must": [spec]})} == {"b"}


def test_filters_as_columns_equal_compiled_filters(spark):
    import json

    rows = [(1, "3.0.6", None, 110, ["a", "b"], True), (2, None, "3.0.6", 35, [], False), (3, "4.1", "4.1", None, None, None)]
    df = spark.createDataFrame(rows, "id int, clause_id string, clause_no string, kv int, ids array<string>, must boolean")
    specs = [
        [{"key": "clause_no", "match": {"any": ["3.0.6"]}}], [{"key": "clause_id", "match": {"value": "4.1"}}], [{"key": "kv", "range": {"gte": 35, "lt": 110}}], [{"key": "kv", "range": {"gt": 35}}, {"key": "ids", "match": {"value": "b"}}],
        [{"key": "must", "match": {"value": True}}], [{"key": "ids", "match": {"any": []}}], [{"key": "absent", "match": {"value": "x"}}], [{"key": "ids", "range": {"gte": 1}}],
    ]
    said = [json.dumps([{k: v for k, v in c.asDict().items() if v is not None} for c in spark.range(1).select(filters.spec_column({"must": s})).first()[0]]) for s in specs]
    got = df.select("id", filters.passes(said, df.schema).alias("ok")).collect()
    for i, s in enumerate(specs):
        assert {r.id for r in got if r.ok[i]} == {r.id for r in filters.apply_filter(df, {"must": s}).collect()}, s


def test_hash_search_equals_dense_search_over_hash_vectors(spark):
    from citelake.functions.embedding import hash_vector

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["3.0.6 Grounding of cables", "接地 cables", "", None, "transport of transformers", "cables 接地", "3.0.6 grounding of cables"])], "ordinal int, t string")
    q = spark.createDataFrame([(7, "grounding 3.0.6"), (8, "接地 cables")], "query_id int, query string")
    want = retrieval.dense_search(rows.withColumn("vector", hash_vector(F.col("t"))), q.withColumn("query_vector", hash_vector(F.col("query"))), 4)
    told = lambda df: {(r.query_id, r["rank"], r.ordinal, round(r.score, 6)) for r in df.collect()}
    assert told(retrieval.hash_search(rows.repartition(3), q, 4, F.col("t"))) == told(want)


def test_full_text_by_one_reading_equals_the_index(spark):
    pages = spark.createDataFrame([("a", 1, "Red fox runs"), ("b", 1, "red cow and then a fox"), ("c", 1, "red only"), ("d", 2, "fox, red fox")], "doc_id string, page_no int, text string")
    q = spark.createDataFrame([(1, "red/fox", ["red", "fox"]), (2, "cow red", ["cow", "red"]), (3, "blue", ["blue"])], "query_id int, query string, terms array<string>")
    told = lambda df: {(r.query_id, r["rank"], r.doc_id, r.score) for r in df.collect()}
    assert told(retrieval.fts_best(pages, q, 5)) == told(retrieval.fts_search(retrieval.inverted_index(pages), q, 5))


def test_dense_and_full_text_hits_are_found(spark):
    texts = ["a grounding electrode of copper", "copper of electrode grounding a", "grounding grounding grounding copper", "unlike"]
    rows = spark.createDataFrame([(f"d{i}", t, i) for i, t in enumerate(texts)], "doc_id string, chunk_text string, ordinal int")
    q = spark.createDataFrame([(1, "a grounding electrode of copper")], "query_id int, question string")
    got = {r.doc_id: r.route for r in hybrid.search(hybrid.plain_rows(rows), q, 10, routes={"keyword": 1}).collect()}
    assert got["d1"] == "dense" and got["d3"] == "dense"  # beyond the keyword cut; d3 shares no term
    full = {r.doc_id: r.route for r in hybrid.search(hybrid.plain_rows(rows), q, 10, routes={"keyword": 1, "dense": 1}).collect()}
    assert full["d1"] == "sparse" and "d2" not in full  # full text wants every word


def test_siblings_follow_their_clause(spark):
    rows = spark.createDataFrame([(*r, i) for i, r in enumerate(ROWS)], "id string, doc_id string, clause_id string, source_type string, chunk_text string, ordinal int")
    q = spark.createDataFrame([(1, "第3.0.6条的内容")], "query_id int, question string")
    got = hybrid.cited(hybrid.plain_rows(rows), q, 5).orderBy("rank").collect()
    assert [(r.source_type, r.route) for r in got] == [("text", "clause_exact"), ("explanation", "explanation_sibling")]
    assert hybrid.cited(hybrid.plain_rows(rows), q, 5, explanations=0).count() == 1
    assert hybrid.cited(hybrid.plain_rows(rows), q, 5, search_filter={"must": [{"key": "source_type", "match": {"value": "text"}}]}).count() == 1


def test_keyword_best_equals_keyword_search(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["aa aaa b", "b aa", "aaaa", "", None, "b b b", "aa b"])], "ordinal int, t string")
    q = spark.createDataFrame([(1, ["aa", "b"]), (2, ["aaa"]), (3, []), (4, ["zz"])], "query_id int, terms array<string>")
    told = lambda df: {(r.query_id, r["rank"], r.ordinal, round(r.score, 6)) for r in df.collect()}
    assert told(retrieval.keyword_best(rows.repartition(3), q, 3, F.col("t"))) == told(retrieval.keyword_search(rows, q, 3, F.col("t")))


def test_listing_questions_and_large_k_go_deeper(spark):
    rows = spark.createDataFrame([(f"d{i}", "copper rod" + " x" * i, i) for i in range(120)], "doc_id string, chunk_text string, ordinal int")
    q = spark.createDataFrame([(1, "list copper"), (2, "copper")], "query_id int, question string")
    routes = lambda k, **r: [(x.query_id, x.route) for x in hybrid.search(hybrid.plain_rows(rows), q, k, routes=r).collect()]
    got = routes(100, dense=1, sparse=1)
    assert got.count((1, "keyword")) >= 63 and got.count((2, "keyword")) in (23, 24)  # one of them may be the dense hit
    assert routes(100).count((2, "dense")) == 100


def test_the_loose_chapter_pass_finds_continuations(spark):
    rows = spark.createDataFrame([("a", "4.3.1", "4.3.1 电容器安装应符合规定。", 0), ("b", "4.3.2", "4.3 续表 4.3", 1), ("c", "4.3.3", "电容器安装", 2)], "doc_id string, clause_id string, chunk_text string, ordinal int")
    q = spark.createDataFrame([(1, "4.3 章电容器安装有哪些规定")], "query_id int, question string")
    got = {r.doc_id for r in hybrid.search(hybrid.plain_rows(rows), q, 5, routes={"chapter": 1}).collect()}
    assert "b" in got and len(got) == 2  # one by each pass


def test_routes_take_questions_in_blocks_and_merge_in_two_steps(spark, tmp_path, monkeypatch):
    """Any number of questions, many files: the same hits as in one block."""
    docs = spark.createDataFrame([(i, 1, f"alpha beta w{i % 7} w{i % 11} été{i % 3}") for i in range(120)], "doc_id long, page_no int, text string")
    docs.repartition(5).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    asked = spark.createDataFrame([(i, f"w{i % 7} été{i % 3}", [f"w{i % 7}", f"été{i % 3}"]) for i in range(23)] + [(90, None, None), (91, "", [])], "query_id long, query string, terms array<string>")
    tokens = asked.withColumn("tokens", F.coalesce("terms", F.array().cast("array<string>")))
    routes = {
        "keyword": lambda: retrieval.keyword_best(docs, asked, 4, F.lower("text"), "doc_id"), "like": lambda: retrieval.like_best(docs, asked, 4), "fts": lambda: retrieval.fts_best(docs, asked, 4),
        "sidecar": lambda: retrieval.sidecar_search(docs, tokens, 4), "hash": lambda: retrieval.hash_search(docs, asked, 4, F.col("text"), "doc_id"),
    }
    got = lambda f: sorted(map(str, f().select("query_id", "doc_id", F.round("score", 6), "rank").collect()))
    one = {name: got(f) for name, f in routes.items()}
    assert all(one.values())
    blocks = retrieval.query_blocks
    monkeypatch.setattr(retrieval, "query_blocks", lambda q, size=5: blocks(q, size))
    monkeypatch.setattr(retrieval, "MANY_FILES", 1)
    assert {name: got(f) for name, f in routes.items()} == one


def test_weights_add_up_like_a_matrix():
    terms = retrieval.Terms(["a", "b", "cc"])
    wanted = [[("a", 1.0), ("cc", 2.0), ("", 9.0)], [], [("b", 0.5), ("b", 0.5)]]
    got = retrieval.Weights(terms, wanted).scores([terms.counts(t) for t in ("aacc", "b", "", None)], lambda n: n)
    assert got.tolist() == [[4.0, 0.0, 0.0], [0.0, 0.0, 1.0], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]]


@pytest.mark.parametrize("most", [0, 3, 1000])
def test_counts_by_words_equal_counts_in_whole_texts(most):
    """Terms that stand over themselves, share words or reach over several words; words kept and words looked through anew."""
    rng = random.Random(most)
    terms = retrieval.Terms(["aa", "aab", "b", "1.2", "中文", "a_b", "b a", "é", ""])
    texts = [None, "", "..."] + ["".join(rng.choice("aaab_ .12中文é") for _ in range(rng.randint(1, 90))) for _ in range(60)]
    found = retrieval.WordTerms(terms, most)
    found.MOST_CELLS = 40  # a few texts at a time
    for some in (texts, texts[::-1], []):
        got = [{} for _ in some]
        for row, term, n in zip(*(x.tolist() for x in found.entries(some)), strict=True):
            got[row][term] = n
        assert got == [terms.counts(t) for t in some]
    assert len(found.held) <= most


def test_hash_vectors_of_texts_by_words_equal_the_expression(spark):
    texts = ["ab1 x.5 1.2.3", "中文ab_c é9 ß", "", "...", None, "10.25", "ab " * 40]
    want = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(embedding.hash_vector(F.col("t"))).collect()]
    hasher = embedding.Hasher(1024)
    for _ in range(2):
        assert hasher.vectors(texts).tolist() == [pytest.approx(w) for w in want]


@pytest.mark.parametrize("seed", range(20))
def test_cover_density_equals_a_count_of_smallest_stretches(seed):
    """A stretch counts where it satisfies the question and neither of its ends can be left out."""
    rng = random.Random(seed)
    words = [rng.choice("abcx") for _ in range(24)]
    asked = [[("a",), ("b",)], [("c",), ("a",)]][: rng.randint(1, 2)]
    places = {w: np.array([i for i, x in enumerate(words) if x == w], np.int64) for w in "abc"}
    fits = lambda i, j: any(all(u[0] in words[i : j + 1] for u in x) for x in asked)
    every = {u[0] for x in asked for u in x}
    want = sum(0.1 / (1 + sum(w not in every for w in words[i : j + 1])) for i in range(24) for j in range(i, 24) if fits(i, j) and not fits(i + 1, j) and not fits(i, j - 1))
    assert retrieval.cover_density(asked, places) == pytest.approx(want)


def test_first_rows_and_structured_rows_equal_all_pairs(spark):
    """Both against every row and question, filters, equal rows and null fields included."""
    rows = spark.createDataFrame([(i, f"t{i % 4}", [i % 2 == 0, i % 3 == 0]) for i in range(60)], "ordinal long, text string, _pass array<boolean>")
    asked = spark.createDataFrame([(1, 0), (2, 1), (3, None)], "query_id long, spec int")
    got = {(r.query_id, r["rank"]): r.ordinal for r in retrieval.first_rows(rows, asked, 4).collect()}
    assert got == {(q, n + 1): o for q, step in ((1, 2), (2, 3), (3, 1)) for n, o in enumerate(range(0, 4 * step, step))}
    data = [("d1", 1, '{"no": "gb-1 x9"}'), ("d1", 1, '{"no": "gb-1 x9"}'), ("d2", 2, '{"no": "GB-1"}'), ("d3", 1, None), (None, 1, "gb-1"), ("d4", 0, "gb-1"), ("d5", 3, "zz")]
    assets = spark.createDataFrame([(*d, "x") for d in data], "doc_id string, page_no int, data_json string, kind string")
    tokens = spark.createDataFrame([(1, ["GB-1", "x9"]), (2, ["zz"]), (3, []), (4, ["none"])], "query_id long, tokens array<string>")
    hits = retrieval.structured_search(assets, tokens, 3)
    assert [(r.query_id, r["rank"], r.doc_id, r.score, r.kind) for r in hits.orderBy("query_id", "rank").collect()] == [(1, 1, "d1", 20.0, "x"), (1, 2, "d1", 20.0, "x"), (1, 3, "d2", 10.0, "x"), (2, 1, "d5", 10.0, "x")]
    for df in (hits, retrieval.first_rows(rows, asked, 4)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_registered_queries_read_texts_in_bounded_batches(spark):
    from citelake import stages
    from citelake.plans import queries as own

    before = {key: spark.conf.get(key, None) for key in stages.ARROW}
    try:
        for key in stages.ARROW:
            spark.conf.unset(key)
        own.docs_of(spark, "/root/testdata/sf0.001")
        assert {key: spark.conf.get(key) for key in stages.ARROW} == stages.ARROW
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "77")  # the owner's own bound stays
        own.docs_of(spark, "/root/testdata/sf0.001")
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "77"
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_an_index_keeps_to_the_words_that_are_asked(spark):
    pages = spark.createDataFrame([("a", 1, "fire door and wall"), ("b", 1, "door fire"), ("c", 1, "door"), ("d", 1, None)], "doc_id string, page_no int, text string")
    asked = spark.createDataFrame([(1, ["fire", "door", "fire"]), (2, ["door", None]), (3, []), (4, None), (5, ["wall"]), (6, ["gate", "door"]), (7, ["and", "door"])], "query_id int, terms array<string>")
    got = retrieval.fts_search(retrieval.inverted_index(pages), asked, 5)
    assert sorted((r.query_id, r.doc_id) for r in got.collect()) == [(1, "a"), (1, "b"), (5, "a"), (7, "a")]
    lines = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    semi, grouped = (next(i for i, x in enumerate(lines) if what in x) for what in ("LeftSemi", "collect_list(pos"))
    assert semi > grouped  # other words' postings end below the index's own grouping, before its exchange
