from citelake.operators import answers


def cite(clause, said, page=1, kind="text", **kw):
    return {"doc_name": "规范A", "doc_id": "d", "page_start": page, "page_end": page, "excerpt": said, "chunk_text": said, "route": "dense", "source_type": kind, "table_id": None, "clause_id": clause, **kw}


ROWS = [cite("4.8.2", "4.8.2 变压器本体就位应符合下列规定。", 9), cite("4.8.1", "4.8.1 变压器附件安装前应检查外观。", 8), cite("3.0.6", "3.0.6 设备安装前建筑工程应具备下列条件。", 2), cite("3.0.7", "3.0.7 设备安装完毕投入运行前应验收。", 3), cite("4.8.1", "4.8.1 条文说明：检查外观的理由。", 40, "explanation"), cite("9.1.1", "9.1.1 电缆敷设应整齐。", 30)]


def test_named_clauses_come_first():
    assert answers.target_clauses("第4.8.2(1)条的规定", ROWS) == (["4.8.2"], False)
    assert answers.named_clauses("4.8.2 没查询到") == []


def test_fixed_layout():
    got = answers.clause_answer("第4.8.1条的规定", ROWS)
    assert got.startswith("条文规定：\n1. ") and "（规范A p.8）" in got and "\n\n条文说明：\n1. 4.8.1 条文说明" in got and "9.1.1" not in got


def test_listing_takes_required_clauses_and_one_of_each():
    roots, family = answers.target_clauses("变压器安装有哪些规定", ROWS)
    assert family and roots == ["4.8", "3.0", "4.6"]
    got = answers.clause_answer("变压器安装有哪些规定", ROWS)
    assert all(x in got for x in ("3.0.6", "3.0.7", "4.8.1")) and got.count("4.8.1 变压器附件安装前") == 1


def test_listing_misses_are_said():
    assert "证据不足" in answers.clause_answer("隔离开关安装有哪些规定", [ROWS[-1]])


def test_questions_without_clauses():
    assert answers.clause_answer("为什么", ROWS) is None
    assert answers.answer("为什么", ROWS).startswith("根据检索证据")
    assert answers.answer("为什么", []).startswith("未检索到")


def test_prompt_and_depth():
    p = answers.prompt("q", ROWS)
    assert "[E5] 条文说明 | 规范A p.40" in p and "[E7]" not in p and "4) 若证据含" in p
    assert (answers.search_depth("x"), answers.search_depth("有哪些"), answers.search_depth("x", "constraint", True)) == (16, 48, 48)


def test_by_query(spark):
    schema = "query_id long, question string, rank int, doc_name string, doc_id string, page_start int, page_end int, excerpt string, chunk_text string, route string, source_type string, table_id string, clause_id string"
    rows = [(1, "第4.8.1条的规定", i, *[c[k] for k in ("doc_name", "doc_id", "page_start", "page_end", "excerpt", "chunk_text", "route", "source_type", "table_id", "clause_id")]) for i, c in enumerate(ROWS)]
    got = answers.answers(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 1 and got[0].answer.startswith("条文规定：")
