import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from citelake.functions import settings, terms, text
from citelake.operators import answers, retrieval, stores, tables


def test_appended_rows_get_defaults_and_ids_of_their_content(spark, tmp_path):
    df = spark.createDataFrame([("r", "s1", None, 4.0), ("r", "s2", "openai", None)], "run_id string, sample_id string, provider string, score_total double")
    got = stores.result_rows(df).orderBy("sample_id").collect()
    assert [(r.provider, r.model, r.score_total, r.breakdown_json) for r in got] == [("stub", "stub-mvp", 4.0, "{}"), ("openai", "stub-mvp", 0.0, "{}")]
    assert all(re.fullmatch("res_[0-9a-f]{12}", r.id) for r in got) and got[0].id != got[1].id
    assert [r.id for r in stores.result_rows(df).orderBy("sample_id").collect()] == [r.id for r in got]
    kept = stores.result_rows(df.withColumn("id", F.when(F.col("sample_id") == "s1", "mine")))
    assert "mine" in {r.id for r in kept.collect()}
    path = str(tmp_path / "results")
    stores.append(stores.result_rows(df), path)
    stores.append(stores.result_rows(df), path)
    assert spark.read.parquet(path).count() == 4
    assets = spark.createDataFrame([("d", "v", "person")], "doc_id string, version_id string, asset_type string")
    row = stores.asset_rows(assets).first()
    assert (row.asset_type, row.source_page, row.source_type, row.row_index) == ("person", 0, "chapter_text", None) and row.id.startswith("ast_")
    log = stores.log_rows(spark.createDataFrame([("t", 5)], "task_type string, tokens_in int")).first()
    assert log.id.startswith("llm_") and log.request_id.startswith("req_") and log.tokens_in == 5 and log.provider == "unknown"


def test_runs_and_their_states(spark):
    runs = stores.run_rows(spark.createDataFrame([("v1", "2026-01-01"), ("v2", "2026-01-02")], "dataset_version string, created_at string"))
    first = runs.where("dataset_version = 'v1'").first().id
    events = spark.createDataFrame([(first, "running", 1), (first, "done", 2), ("other", "done", 1)], "id string, status string, at int")
    got = {r.dataset_version: r.status for r in stores.with_run_status(runs, events).collect()}
    assert got == {"v1": "done", "v2": "queued"}
    assert [r.dataset_version for r in stores.newest(runs, 1).collect()] == ["v2"] and stores.by_id(runs, first).count() == 1


def test_samples_are_added_to_a_dataset(spark, tmp_path):
    df = spark.createDataFrame([("d", "v", "q?", "a", None)], "doc_id string, version_id string, question string, answer string, task_type string")
    for _ in range(2):
        added = stores.add_samples(spark, df, str(tmp_path), "v1.0").first()
    paths = stores.dataset_paths(str(tmp_path), "v1.0")
    assert added.task_type == "QA" and re.fullmatch("s_[0-9a-f]{10}", added.sample_id)
    assert spark.read.json(paths["inputs"]).count() == 2 and {r.answer for r in spark.read.json(paths["truths"]).collect()} == {"a"}


def test_entities_keep_known_ids(spark):
    names = spark.createDataFrame([(" Person", "张 "), ("person", "张"), ("", "x"), ("person", " ")], "kind string, name string")
    made = {(r.entity_kind, r.entity_name): r.id for r in stores.entities(names).collect()}
    assert made == {("person", "张"): "person_" + uuid.uuid5(uuid.NAMESPACE_DNS, "person:张").hex[:16], ("unknown", "x"): "unknown_" + uuid.uuid5(uuid.NAMESPACE_DNS, "unknown:x").hex[:16]}
    known = spark.createDataFrame([("p1", "person", "张")], "id string, entity_kind string, entity_name string")
    added, ids = stores.get_or_create(known, names)
    assert [r.entity_name for r in added.collect()] == ["x"] and {r.entity_name: r.id for r in ids.collect()}["张"] == "p1"
    found = stores.entity_lookup(known, spark.createDataFrame([("PERSON", "张"), ("person", "李")], "kind string, name string"))
    assert {r.name: r.id for r in found.collect()} == {"张": "p1", "李": None}


def test_settings():
    assert settings.strict({}, {"APP_ENV": "production"}) and not settings.strict({"embedding_fallback_strict": "0"}, {"APP_ENV": "prod"}) and not settings.strict({}, {})
    assert (settings.stub_dim(None, 4096), settings.stub_dim(8, 4096), settings.stub_dim(None, None)) == (4096, 8, 1024)
    size = lambda vectors: settings.stored_dim({"result": {"config": {"params": {"vectors": vectors}}}})
    assert (size({"text_embedding": {"size": 5}}), size({"size": 7}), size({"other": {"size": 9}}), size({}), settings.stored_dim({})) == (5, 7, 9, None, None)
    bases, models = {"openai": "https://api.example/v1"}, {"openai": "m"}
    assert settings.endpoint("embedding", {}, {}, bases, models).provider == "stub"
    got = settings.endpoint("embedding", {"embedding_api_key": " k "}, {"EMBEDDING_BASE_URL": "http://x/"}, bases, models)
    assert (got.provider, got.api_key, got.base_url, got.model) == ("openai", "k", "http://x", "m")
    policy = {"tiers": {"tier1": "cn_primary"}, "tasks": {"qa": ["tier1", "tier2"]}}
    assert settings.providers("qa", {}, {}, policy) == ["stub"] and settings.providers("qa", {"llm_provider": "Anthropic"}, {}, policy) == ["anthropic"]
    assert settings.providers("qa", {"llm_api_key": "k"}, {"LLM_TIER_PROVIDER_CN_PRIMARY": "anthropic"}, policy) == ["openai", "anthropic", "stub"]
    assert settings.with_defaults({"ocr_provider": " Mineru ", "x": None, "reuse": False}, {"ocr": {"provider": "siliconflow", "model": "m"}, "rerank": {"provider": "siliconflow", "model": "r"}}) == {"ocr_provider": "mineru", "reuse": False, "rerank_provider": "siliconflow", "rerank_model": "r"}
    assert settings.is_vector_mismatch(400, "Wrong vector") and not settings.is_vector_mismatch(500, "vector")
    assert settings.is_recoverable(404, "") and not settings.is_recoverable(400, "dimension") and settings.is_recoverable(400, "dimension", True)
    assert settings.doc_type_allowed("规范规程") and not settings.doc_type_allowed("x") and settings.doc_type_allowed("x", "") and settings.doc_type_allowed("x", "y, x")
    assert settings.keyword_search_on({}) and not settings.keyword_search_on({"HYBRID_KEYWORD_ENABLED": "off"}) and not settings.keyword_search_on({"ENABLE_QDRANT_SCROLL_KEYWORD": "0"}, True)
    assert settings.notes('{"a": 1}') == {"a": 1} and settings.notes("x") == {"raw": "x"} and settings.notes("[1]") == {"raw": [1]} and settings.notes(None) == {}
    assert settings.read_pack('{"a": 1}', "json") == {"a": 1} and settings.repaired_yaml(r'a: "\d+"') == r'a: "\\d+"'
    assert settings.upload_target({"data": {"batchId": 3, "files": [{}, {"putUrl": "u"}]}}) == ("3", "u") and settings.upload_target({"data": {"url": "v"}}) == ("", "v") and settings.upload_target([]) == ("", "")
    assert sum(map(len, settings.PAYLOAD_INDEXES.values())) == 29


def test_configuration_with_patterns_is_read():
    pytest.importorskip("yaml")
    assert settings.read_pack('pattern: "^\\d+(?:\\.\\d+)*"\nname: x', "yaml") == {"pattern": r"^\d+(?:\.\d+)*", "name": "x"}


def brute_cover(alternatives, words):
    """Every smallest stretch, found by trying all."""
    units = {u for x in alternatives for u in x}
    asked = {w for u in units for w in u}

    def ok(i, j):
        part = words[i : j + 1]
        has = {u for u in units if any(tuple(part[k : k + len(u)]) == u for k in range(len(part)))}
        return any(all(u in has for u in x) for x in alternatives)

    found = [(i, j) for i in range(len(words)) for j in range(i, len(words)) if ok(i, j)]
    least = [(i, j) for i, j in found if not any((a, b) != (i, j) and i <= a and b <= j for a, b in found)]
    return sum(0.1 / (1 + (j - i) - (sum(w in asked for w in words[i : j + 1]) - 1)) for i, j in least)


def test_cover_density_equals_brute_force():
    rng = random.Random(5)
    import numpy as np

    for query in ("a b", "a", '"a b" c', "a b or c d", '"a b a"', "a b c d", '"a b" or d'):
        alternatives = retrieval.websearch(query)
        for _ in range(40):
            words = [rng.choice("abcdxy") for _ in range(rng.randint(0, 14))]
            places = {w: np.array([i for i, x in enumerate(words) if x == w]) for w in "abcd"}
            assert retrieval.cover_density(alternatives, places) == pytest.approx(brute_cover(alternatives, words)), (query, words)


def test_full_text_questions():
    assert retrieval.websearch('GB/T-50150 "the Main Power" or x') == [[("gb",), ("t",), ("50150",), ("the", "main", "power")], [("x",)]]
    assert retrieval.websearch("or a or") == [[("or",), ("a",)]] and retrieval.websearch(" :* ") == [] and retrieval.websearch(None) == []


def test_phrases_and_alternatives_find_pages(spark):
    pages = spark.createDataFrame([(1, 1, "main power cable"), (2, 1, "power main"), (3, 1, "earth wire")], "doc_id int, page_no int, text string")
    ask = lambda q: {r.doc_id for r in retrieval.fts_best(pages, spark.createDataFrame([(1, q)], "query_id int, query string"), 10).collect()}
    assert ask("main power") == {1, 2} and ask('"main power"') == {1} and ask('"main power" or earth') == {1, 3} and ask("main earth") == set()


def test_rerank_answers(spark):
    assert retrieval.ranked_indices('{"ranked_indices": [2, "0", 2, 9, "x"]}', 3) == [2, 0] and retrieval.ranked_indices("[1]", 2) == [1] and retrieval.ranked_indices("nope", 2) == []
    body = '{"data": [{"index": 0, "score": 0.1}, {"document_index": 1, "relevance": 0.9}, {"id": "2"}, 5, {"index": 7, "score": 9}]}'
    assert retrieval.reranked_indices(body, 3) == [1, 0, 2] and retrieval.reranked_indices('{"results": 3}', 3) == [] and retrieval.reranked_indices("[]", 3) == []
    hits = spark.createDataFrame([(1, i, f"c{i}") for i in range(1, 5)] + [(2, 1, "z")], "query_id int, rank int, id string")
    said = spark.createDataFrame([(1, '{"results": [{"index": 2, "score": 2}, {"index": 1, "score": 1}]}')], "query_id int, answer string")
    got = sorted((r.query_id, r["rank"], r.id) for r in retrieval.with_ranking(hits, said).collect())
    assert got == [(1, 1, "c3"), (1, 2, "c2"), (1, 3, "c1"), (1, 4, "c4"), (2, 1, "z")]


def test_clauses_and_explanations_are_paired(spark):
    schema = "chunk_id string, clause_id string, doc_type string"
    rows = spark.createDataFrame([("k1", "3.1", "clause"), ("k2", "3.1", "explanation"), ("k3", "3.1", "explanation"), ("k4", "3.2", "clause"), ("k5", "3.2", "explanation")], schema)
    hits = spark.createDataFrame([(1, 1, "k2", "3.1", "explanation"), (1, 2, "k4", "3.2", "clause"), (1, 3, "k9", None, "clause")], f"query_id int, rank int, {schema}")
    got = [r.chunk_id for r in retrieval.pair_explanations(hits, rows).orderBy("rank").collect()]
    assert got == ["k4", "k9", "k1", "k2", "k5"]
    assert retrieval.pair_explanations(hits, rows, 0).count() == 3


CITE = "doc_name string, doc_id string, page_start int, page_end int, excerpt string, chunk_text string, route string, source_type string, table_id string, clause_id string"


def test_rows_of_a_named_clause_join_from_the_whole_index(spark):
    one = lambda clause, said, page, kind="text", doc="d": ("规范A", doc, page, page, said, said, "dense", kind, None, clause)
    index = spark.createDataFrame([one("4.8.1", "4.8.1 附件应检查。", 8), one("4.8.1(2)", "4.8.1(2) 外观完好。", 8), one("4.8.10", "4.8.10 其他。", 9), one("4.8.1", "条文说明：理由。", 40, "explanation"), one("4.8.1", "别的文件。", 1, doc="e"), one("4.8.1", "表格。", 8, "table_row")], CITE)
    cited = spark.createDataFrame([(1, "第4.8.1条的规定", 1, *one("4.8.1", "4.8.1 附件应检查。", 8))], f"query_id long, question string, rank int, {CITE}")
    got = answers.with_family(cited, index).orderBy("rank").collect()
    assert [(r.clause_id, r.page_start, r.source_type) for r in got] == [("4.8.1", 8, "text"), ("4.8.1", 40, "explanation"), ("4.8.1(2)", 8, "text")]
    assert got[0].route == "dense" and got[1].route == "clause_family" and all(r.question == "第4.8.1条的规定" for r in got)
    none = cited.withColumn("question", F.lit("为什么"))
    assert answers.with_family(none, index).count() == 1


def test_listing_without_focus_says_so():
    row = {"doc_name": "规范A", "doc_id": "d", "page_start": 1, "page_end": 1, "excerpt": "9.1.1 电缆敷设应整齐。", "chunk_text": "9.1.1 电缆敷设应整齐。", "route": "dense", "source_type": "text", "table_id": None, "clause_id": "9.1.1"}
    assert answers.clause_answer("隔离开关安装有哪些规定", [row]).startswith("条文规定：\n1. 证据不足")


def test_page_file_helpers(spark):
    assert terms.page_tokens("变压 器安装, GB50150 a") == ["变压", "压器", "器安", "安装", "变压器安装", "gb50150a"]
    df = spark.createDataFrame([("变 压器 绕组 x" + "。" * 300, "压器绕"), ("abc", "zz"), ("", "q"), (None, None)], "t string, q string")
    got = [r[0] for r in df.select(text.excerpt_at(F.col("t"), F.col("q"), 30)).collect()]
    assert got[0].startswith("变压器绕组x。") and len(got[0]) == 30 and got[1:] == ["abc", "", ""]


def test_recognised_tables(spark):
    df = spark.createDataFrame([("名称|值\na|1\nb|2",), ("one line",), (None,)], "t string")
    got = [r[0] for r in df.select(tables.rows_of_text(F.col("t"))).collect()]
    assert (got[0].header, got[0].rows) == (["名称", "值"], [["a", "1"], ["b", "2"]]) and got[1].header == [] and got[2].rows == []
    pack = spark.createDataFrame([("T", [f'{{"n":{i}}}' for i in range(8)])], "t string, r array<string>").select(tables.recognised_pack(F.col("t"), F.col("r")).alias("p")).first().p
    assert pack.n == 8 and pack.table_summary.split("\n")[:2] == ["T", "（VL 兜底识别）"] and len(pack.table_summary.split("\n")) == 8


def test_explanations_by_configuration(spark):
    rows = [("d", "v", 1, 1, "正文"), ("d", "v", 2, 1, "条文说明"), ("d", "v", 2, 2, "3.0.1 检查"), ("d", "v", 2, 3, "理由一。"), ("d", "v", 3, 1, "3.0.2(1) 说明文字。")]
    got = tables.configured_explanation_chunks(spark.createDataFrame(rows, "doc_id string, version_id string, page_no int, order_in_page int, text string")).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.clause_id, r.page_start, r.version_id) for r in got] == [("expcfg_3.0.1_1", "3.0.1", 2, "v"), ("expcfg_3.0.2(1)_2", "3.0.2(1)", 3, "v")]
    assert got[0].text == "检查\n理由一。" and got[0].source_type == "explanation"
