from pyspark.sql import functions as F

from citelake.operators import chapters, chunking, extract, normalize, payload, quality, tables
from citelake.plans import hybrid

PAGES = "doc_id string, version_id string, page_no int, blocks array<struct<type:string,text:string>>, tables array<struct<raw_text:string,image_url:string>>"


def pages(spark, *rows):
    return spark.createDataFrame([("d", "v", no, [("paragraph", t) for t in texts], [(t, None) for t in tabs]) for no, texts, tabs in rows], PAGES)


def test_table_goes_on_with_a_mark(spark):
    head = "序号|设备电压等级(V)|兆欧表电压等级(V)"
    p = pages(spark, (4, [], [f"{head}\n1|<100|250"]), (5, [], [f"续表3.0.9\n{head}\n2|<500|500"]))
    got = normalize.normalize(p)[1].collect()
    assert len(got) == 1 and (got[0].page_start, got[0].page_end) == (4, 5)
    assert "1|<100|250" in got[0].raw_text and "2|<500|500" in got[0].raw_text


def test_table_goes_on_with_a_similar_header(spark):
    p = pages(spark, (10, [], ["序号|额定电压(kV)|设备名称\n1|10|断路器"]), (11, [], ["序号 | 额定电压kV | 设备名称\n2|35|变压器"]))
    got = normalize.normalize(p)[1].collect()
    assert len(got) == 1 and (got[0].page_start, got[0].page_end) == (10, 11)


def test_tables_apart_stay_apart(spark):
    p = pages(spark, (1, [], ["甲|乙\n1|2"]), (3, [], ["甲|乙\n3|4"]))
    assert normalize.normalize(p)[1].count() == 2


def test_repeated_headers_go(spark):
    rows = [(i, ["某某工程技术规范文件", f"第{i}页的正文内容各不相同{'甲乙丙丁'[i]}", f"再说些别的{'子丑寅卯'[i]}话", f"末尾{'天地玄黄'[i]}句"], []) for i in range(4)]
    got = [r.text for r in normalize.normalize(pages(spark, *rows))[0].collect()]
    assert not any("技术规范文件" in t for t in got) and len(got) == 12


def blocks(spark, *texts, page=1):
    return spark.createDataFrame([("d", "v", f"b_{page}_{i}", page, "paragraph", t, i) for i, t in enumerate(texts, 1)], "doc_id string, version_id string, block_id string, page_no int, block_type string, text string, order_in_page int")


def test_chapters_split_at_titles_and_run_together(spark):
    long = "长" * 1300
    got = chapters.chapters(blocks(spark, "第一章 总则", long, "第二章 术语", "短文", "第三章 规定", long)).orderBy("chapter_id").collect()
    assert [(c.chapter_id, c.title, c.status) for c in got] == [("ch_1", "第一章 总则", "normal"), ("ch_2", "第二章 术语", "degenerate")]
    assert got[1].text == f"第二章 术语\n短文\n第三章 规定\n{long}"
    untitled = chapters.chapters(blocks(spark, "没有标题的文字", page=7)).first()
    assert untitled.title == "临时章节_7" and untitled.status == "degenerate"


def chunk(text="", blocks=(), least=1, most=300, overlap=0):
    return chunking.chunks({"start_page": 1, "text": text, "block_ids": ["b"], "blocks": list(blocks)}, least, most, overlap)


def test_clause_hierarchy():
    got = chunk(blocks=[{"block_id": "b", "page_no": 1, "text": "3.0.6 主条款。\n(3) 子条款。\n1) 第一项。\n2) 第二项。"}])
    assert [c.place.node for c in got] == ["3.0.6", "3.0.6(3)", "3.0.6(3).1", "3.0.6(3).2"]
    item = got[2].place
    assert item.clause == "3.0.6(3)" and item.parent == "3.0.6(3)" and item.level >= 5


def test_clause_with_sub():
    got = chunk(blocks=[{"block_id": "b", "page_no": 1, "text": "4.12.1(3) 试验时应将插件拔出或将其两端短接。"}], most=200)
    assert len(got) == 1 and got[0].place.clause == "4.12.1(3)"


def test_clause_is_carried_over_blocks():
    got = chunk(blocks=[{"block_id": "1", "page_no": 1, "text": "4.3.1 应符合下列规定："}, {"block_id": "2", "page_no": 1, "text": "1 外观完好；"}, {"block_id": "3", "page_no": 2, "text": "2 按第2.1.1.4款执行。"}], most=500)
    assert {c.place.clause for c in got} == {"4.3.1"}


def test_short_tail_joins():
    got = chunk(blocks=[{"block_id": "1", "page_no": 1, "text": "甲" * 200}, {"block_id": "2", "page_no": 2, "text": "乙" * 150}], least=220, most=300)
    assert len(got) == 1 and got[0].pages == [1, 2]


def test_chunks_keep_all_text(spark):
    ch = chapters.chapters(blocks(spark, "第一章 总则", "3.0.6 主条款。", "普通文字。" * 40))
    got = chunking.chunk_chapters(ch, 1, 100, 0).orderBy("chunk_no").collect()
    assert "".join(r.text for r in got).replace("\n", "") == "第一章 总则3.0.6 主条款。" + "普通文字。" * 40


def test_gate(spark):
    clause = "3.0.6 电气设备的金属外壳必须可靠接地，接地电阻应符合设计要求。" * 3
    rows = [(1, "c1", "text", clause), (2, "c2", "text", clause), (3, "c3", "text", "短句"), (4, "c4", "text", "%PDF-1.4 obj<</filter/flatedecode endstream"), (5, "c5", "text", "1.0.2 本标准适用范围"), (6, "c6", "text", "2.0.1 术语和定义。"), (7, "tbl_1", "table_row", "endstream | %PDF-"), (8, "tbl_2", "table_row", "电压 | 220kV")]
    df = spark.createDataFrame([("d", "v", *r) for r in rows], "doc_id string, version_id string, ordinal int, chunk_id string, source_type string, text string")
    got = {r.chunk_id: r.gate for r in quality.chunk_gate(df).collect()}
    assert got == {"c1": "keep", "c2": "dup", "c3": "short", "c4": "noise", "c5": "keep", "c6": "keep", "tbl_1": "noise", "tbl_2": "keep"}
    assert [r.gate for r in quality.chunk_gate(df.where("chunk_id in ('c3', 'c4')")).orderBy("ordinal").collect()] == ["keep", "keep"]


def test_grades_and_classes(spark):
    b = spark.createDataFrame([("d", "v", "字" * 1000)] * 3, "doc_id string, version_id string, text string")
    t = spark.createDataFrame([("d", "v")], "doc_id string, version_id string")
    got = quality.grades(b, t).first()
    assert (got.text_len, got.score, got.grade) == (3000, 75 + 12 + 8, "A")
    kind = spark.createDataFrame([("投标人应提交招标文件要求的报价",), ("",)], "t string").select(quality.classify(F.col("t")).alias("c")).collect()
    assert kind[0].c.doc_type == "投标文件" and kind[0].c.keyword_hits == 4
    assert kind[1].c.doc_type == "规范规程" and kind[1].c.confidence == 0.3


def test_table_chunks(spark):
    t = spark.createDataFrame([("d", "v", "t_1_1", 1, 1, 2, 1, "序号|电压\n1|10kV\n2|35kV")], "doc_id string, version_id string, table_id string, page_no int, page_start int, page_end int, order_in_page int, raw_text string")
    rows = tables.row_chunks(t).orderBy("row_index").collect()
    assert [(r.chunk_id, r.text, r.source_type) for r in rows] == [("tbl_t_1_1_1", "序号|电压 | 1|10kV", "cross_page_table_row"), ("tbl_t_1_1_2", "序号|电压 | 2|35kV", "cross_page_table_row")]
    raw = {r.table_repr: r.text for r in tables.raw_and_summary_chunks(t).collect()}
    assert raw["summary"] == "表头: 序号|电压；样例行: 1|10kV；2|35kV"
    kinds = tables.table_struct(t).collect()
    assert [k.kind for k in kinds] == ["power_param_table"] and kinds[0].rows == [["1", "10kV"], ["2", "35kV"]] and kinds[0].repair_strategy == "none"


def test_three_pack(spark):
    html = "<table><tr><td>名称</td><td>值</td></tr><tr><td>A&amp;B</td><td>1</td></tr><tr><td>C</td></tr></table>"
    t = spark.createDataFrame([("d", 3, "t1", "表 1.2 参数", html)], "doc_id string, page_no int, table_id string, table_title string, table_html string")
    got = tables.three_pack(t).collect()
    assert [g.table_repr for g in got] == ["raw", "summary", "row", "row"] and got[0].table_no == "1.2"
    assert got[1].text == "表 1.2 参数\n列：名称 / 值\nA&B | 1\nC" and got[2].text == '{"名称":"A&B","值":"1"}' and got[3].text == '{"名称":"C"}'


def test_explanations(spark):
    p = spark.createDataFrame([("d", 1, "正文\n条文说明\n3.0.6 接地\n说明甲"), ("d", 2, "说明乙\n3.0.7 这是一句完整的话。\n说明丙")], "doc_id string, page_no int, text string")
    got = tables.explanations(p, ["条文说明"], r"(\d+(?:\.\d+)+)(?:\((\d+)\))?\s*(.*)").orderBy("clause_id").collect()
    assert [(g.clause_id, g.title, g.body, g.page_start, g.page_end) for g in got] == [("3.0.6", "接地", "说明甲\n说明乙", 1, 2), ("3.0.7", None, "这是一句完整的话。\n说明丙", 2, 2)]


LABELLED = "项目名称：东城变电站\n业主单位：某电力公司\n合同金额：5,000万元\n电压等级110kV\n项目经理：张建国\n证书：A-123\n主要设备：断路器"


def test_label_rules(spark):
    p = spark.createDataFrame([("d", "v", 1, LABELLED), ("d", "v", 2, "nothing here")], "doc_id string, version_id string, page_no int, text string")
    got = {r.asset_type: r.data for r in extract.extract(p).collect()}
    assert set(got) == {"project", "person", "qualification", "equipment"}
    assert got["project"].project_name == "东城变电站" and got["project"].contract_amount_rmb == 5e7 and got["project"].voltage_level_kv == 110
    assert got["person"].name == "张建国" and got["person"].role == "项目经理"


def test_hybrid_engine_fills_gaps(spark):
    p = spark.createDataFrame([("d", "v", 1, "张建国任项目经理，按 GB 50150-2016 3.0.6 执行，110kV")], "doc_id string, version_id string, page_no int, text string")
    got = extract.extract(p, "hybrid").collect()
    project = next(r for r in got if r.asset_type == "project")
    assert project.engine == "hybrid" and project.data.standard_no == "GB 50150-2016" and project.data.clause_no == "3.0.6" and project.data.voltage_level_kv == 110
    facts = {r.text for r in extract.fact_chunks(extract.extract(p, "hybrid")).collect()}
    assert "人员 张建国；角色 项目经理" in facts


def test_offsets_to_pages(spark):
    p = spark.createDataFrame([("d", 1, "abc"), ("d", 2, "de")], "doc_id string, page_no int, text string")
    o = spark.createDataFrame([("d", 0), ("d", 3), ("d", 4), ("d", 99)], "doc_id string, offset int")
    assert [r.page_no for r in extract.page_of_offset(o, extract.page_spans(p)).orderBy("offset").collect()] == [1, 1, 2, 2]


def test_payload(spark):
    c = spark.createDataFrame([("d", "v", "c1", "ch", 1, 1, "4.12.1(3) 试验时必须将插件拔出。")], "doc_id string, version_id string, chunk_id string, chapter_id string, page_start int, page_end int, text string")
    r = payload.build(c).first()
    assert (r.clause_id, r.is_mandatory, r.chapter_no, r.section_no, r.article_path, r.constraint_type, r.clause_level) == ("4.12.1(3)", True, "4", "4.12", ["4", "4.12", "4.12.1"], "mandatory", 4)
    assert r.clause_node_id == "4.12.1(3)" and r.clause_parent_id == "4.12.1" and r.id == "d:v:c1"


def test_payload_with_assets_and_relations(spark):
    c = spark.createDataFrame([("d", "v", "c1", "ch", 1, 1, "张建国任项目经理，110kV，合同金额5000万元")], "doc_id string, version_id string, chunk_id string, chapter_id string, page_start int, page_end int, text string")
    assets = extract.extract(spark.createDataFrame([("d", "v", 1, "项目名称：甲\n合同金额：5000万元\n电压 110kV")], "doc_id string, version_id string, page_no int, text string"))
    rel = spark.createDataFrame([("d", "v", "PERSON_TO_PROJECT", "张建国", "东城", "项目经理", 1)], "doc_id string, version_id string, type string, source_name string, target_name string, role string, relation_no int")
    r = payload.build(c, assets, rel).first()
    assert r.val_voltage_kv == 110 and r.val_contract_amount_w == 5000 and r.rel_person_role == [f"{r.entity_person_ids[0]}|项目经理"]


def test_documents_to_rows(spark):
    p = pages(spark, (1, ["第一章 项目概况", "张建国担任项目经理，110kV，合同金额5000万元。"], []))
    rows = hybrid.ingest(p).collect()
    assert any("张建国" in r.chunk_text and r.val_voltage_kv == 110 for r in rows)
