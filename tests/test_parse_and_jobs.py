import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from citelake.operators import jobs, quality, visual
from citelake.sources import pages, parse


def test_shapes_of_parsed_documents(spark):
    tree = [{"type": "title", "lines": [{"spans": [{"type": "text", "content": "标题"}]}]}, {"type": "list", "blocks": [{"type": "text", "lines": [{"spans": [{"type": "text", "content": "项一"}]}]}]}, {"type": "table", "lines": [{"spans": [{"type": "text", "content": "表1"}]}], "blocks": [{"lines": [{"spans": [{"type": "table", "html": "<tr><td>甲</td><td>乙</td></tr>", "image_path": "a.png"}]}]}]}]
    docs = [{"pages": [{"page_no": 3, "blocks": ["x", {"type": "table", "text": "a|b"}, {"type": "image", "text": "cap", "url": "u"}]}]}, {"data": {"pages": [{"text": "y"}]}}, {"pdf_info": [{"page_idx": 4, "para_blocks": tree}]}, ["z"], {"nothing": 1}]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)] + [(9, "no json")], "id int, json string")
    got = {r.id: r for r in parse.parse_json(df).collect()}
    assert set(got) == {0, 1, 2, 3}
    assert got[0].page_no == 3 and [b.text for b in got[0].blocks] == ["x", "cap"] and got[0].tables[0].raw_text == "a|b" and got[0].images[0].url == "u"
    assert got[1].page_no == 1 and got[1].blocks[0].text == "y" and got[3].blocks[0].text == "z"
    assert got[2].page_no == 5 and [(b.type, b.text) for b in got[2].blocks] == [("title", "标题"), ("paragraph", "项一"), ("paragraph", "表1")]
    assert "甲 乙" in got[2].tables[0].raw_text and got[2].images[0].url == "a.png"


def test_archives(spark):
    def packed(**files):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, body in files.items():
                z.writestr(name.replace("_", "."), body)
        return out.getvalue()

    rows = [(1, packed(b_json='{"pages":[{"text":"json"}]}', a_json="broken")), (2, packed(a_md="# md")), (3, b"plain"), (4, None)]
    got = {r.id: r.blocks[0].text for r in parse.parse_archives(spark.createDataFrame(rows, "id int, content binary")).collect()}
    assert got == {1: "json", 2: "# md", 3: "plain"}


def test_recognised_text(spark):
    t = "第一章 总则\n第一行\n第二行\n\n甲|乙|丙\n1|2|3\n结尾"
    r = parse.ocr_pages(spark.createDataFrame([("d", "v", 1, t)], "doc_id string, version_id string, page_no int, text string")).first()
    assert [(b.type, b.text) for b in r.blocks] == [("title", "第一章 总则"), ("paragraph", "第一行 第二行"), ("paragraph", "甲|乙|丙\n1|2|3"), ("paragraph", "结尾")]
    assert [x.raw_text for x in r.tables] == ["甲|乙|丙\n1|2|3"]


def test_single_character_lines_are_repaired(spark):
    t = "\n".join("这是第一句话。这是第二句话。再来一句！")
    got = spark.createDataFrame([(t,), ("a\nb",)], "t string").select(parse.repaired_lines(F.col("t")).alias("x")).collect()
    assert got[0].x == ["这是第一句话。", "这是第二句话。", "再来一句！"] and got[1].x == ["a", "b"]


def test_bad_pages_are_replaced(spark):
    good = "电气设备的金属外壳必须可靠接地，接地电阻应符合设计要求，并应做好记录以备检查。" * 2
    df = spark.createDataFrame([("d", "v", 1, good), ("d", "v", 2, "www.x.com")], "doc_id string, version_id string, page_no int, text string")
    new = spark.createDataFrame([("d", "v", 1, "no"), ("d", "v", 2, "better")], "doc_id string, version_id string, page_no int, text string")
    assert {r.page_no: r.text for r in parse.merge_repairs(df, new).collect()} == {1: good, 2: "better"}
    assert quality.needs_full_ocr(df).first().full


@pytest.mark.parametrize(("header", "want"), [(None, None), ("bytes=0-4", (0, 4)), ("bytes=5-", (5, 9)), ("bytes=-3", (7, 9)), ("bytes=2-99", (2, 9))])
def test_byte_ranges(header, want):
    assert parse.byte_range(header, 10) == want


@pytest.mark.parametrize("header", ["bytes=10-", "bytes=5-2", "bytes=-0", "lines=1-2", "bytes=1-2,3-4", "bytes=x-"])
def test_bad_byte_ranges(header):
    with pytest.raises(ValueError):
        parse.byte_range(header, 10)


PAGES = "doc_id string, version_id string, page_no int, blocks array<struct<type:string,text:string>>, tables array<struct<raw_text:string,image_url:string>>, images array<struct<url:string,caption:string>>"


def test_visual_text_is_merged(spark):
    df = spark.createDataFrame([("d", "v", 1, [("image", "图一"), ("paragraph", "文")], [("续表 a|b", None), ("续表 a|b", None)], [("u", "图二")])], PAGES)
    found = visual.candidates(df).collect()
    assert sorted((r.visual_type, r.source) for r in found) == [("cross_page_table", "table"), ("image", "block"), ("image", "images")]
    merged = visual.merge_into_pages(df, visual.recognise_offline(visual.candidates(df)))
    again = visual.merge_into_pages(merged, visual.recognise_offline(visual.candidates(df))).first()
    assert [b.text for b in again.blocks if b.text.startswith("[VL-")] == ["[VL-image] 图一", "[VL-image] 图二", "[VL-cross_page_table] 续表 a|b"]
    assert len(again.tables) == 4


def test_tables_are_stitched(spark):
    html = "<table><tr><td>序号</td><td>名称</td></tr><tr><td>{}</td></tr></table>"
    df = spark.createDataFrame([("d", 1, "表1", html.format(1)), ("d", 2, "", html.format(2)), ("d", 4, "", html.format(3)), ("e", 5, "表1", html.format(4))], "doc_id string, page_no int, table_title string, table_html string")
    got = sorted((r.doc_id, r.page_no, r.page_end, r.header_sig) for r in visual.stitched(df).collect())
    assert got == [("d", 1, 2, "序号 名称"), ("d", 4, 4, "序号 名称"), ("e", 5, 5, "序号 名称")]


VERSIONS = "id string, doc_id string, storage_key string, doc_type string, status string, notes string, created_at int"


def test_failed_versions(spark):
    v = spark.createDataFrame([("v1", "d1", "k1", "t", "failed", "n", 1), ("v2", "d2", None, "t", "failed", None, 2), ("v3", "d3", "k3", "t", "processed", None, 3)], VERSIONS)
    assert [r.id for r in jobs.failed(v).collect()] == ["v2", "v1"]
    queued, events = jobs.retry_failed(v)
    assert [r.version_id for r in queued.collect()] == ["v1"]
    assert {r.id: r.status for r in jobs.with_events(v, events).collect()} == {"v1": "retry_queued", "v2": "failed", "v3": "processed"}
    assert {r.status for r in jobs.archive_failed(v).collect()} == {"failed_archived"}
    assert json.loads(jobs.reprocess(v, "v3")[1].first().notes)["retry_from"] == "processed"


def test_runs_and_summaries(spark):
    rows = [("r", "s1", "IE_x", {"precision": 0.8, "recall": 0.7, "source_acc": 0.9, "json_valid": 1.0, "hall_penalty": 5.0, "power_bonus": 8.0}), ("r", "s2", "RETR", {"hit5": 0.0, "hit10": 0.0, "mrr": 0.0, "latency_score": 0.0})]
    got = jobs.scored(spark.createDataFrame(rows, "run_id string, sample_id string, task_type string, metrics map<string,double>")).withColumns({"provider": F.lit("p"), "model": F.lit("m")})
    reports = {r.sample_id: json.loads(r.report) for r in jobs.diff_reports(got).collect()}
    assert round(reports["s1"]["score_total"], 6) == 77 and reports["s2"]["suggestions"]["model_switch"] == "consider_tier_upgrade"
    a = spark.createDataFrame([("d", "v")] * 3, "doc_id string, version_id string")
    s = jobs.summary({"blocks": a, "tables": a.limit(1), "chunks": a.limit(0)}).first()
    assert (s.blocks, s.tables, s.chunks) == (3, 1, 0)
    secret = spark.createDataFrame([({"api_key": "x", "model": "m", "TOKEN": ""},)], "c map<string,string>").select(jobs.redacted(F.col("c")).alias("c")).first().c
    assert secret == {"api_key": "***", "model": "m", "TOKEN": ""}


def test_page_rows_and_markdown(spark):
    df = spark.createDataFrame([("d", "v", 2, [("title", "题"), ("paragraph", "文\x01字")], [("a|b", None)]), ("d", "v", 1, [("paragraph", "首")], [])], "doc_id string, version_id string, page_no int, blocks array<struct<type:string,text:string>>, tables array<struct<raw_text:string,image_url:string>>")
    rows = {r.page_no: (r.text, r.source_path) for r in pages.page_rows(df).collect()}
    assert rows == {1: ("首", "d/page_001.txt"), 2: ("题\n文字\na|b", "d/page_002.txt")}
    assert pages.to_markdown(df).first().markdown.startswith("# Page 1\n\n首\n\n# Page 2\n\n## 题")


def test_files(spark, tmp_path):
    (tmp_path / "doc1").mkdir()
    for name, body in (("page_001", "正文内容"), ("page_002", "ab"), ("page_003", "discarded")):
        (tmp_path / "doc1" / f"{name}.txt").write_text(body)
    got = pages.read_page_files(spark, str(tmp_path)).collect()
    assert [(r.doc_id, r.page_no, r.text) for r in got] == [("doc1", 1, "正文内容")]
    (tmp_path / "a.jsonl").write_text('{"q": "x"}\nnot json\n{"q": "y"}\n')
    assert [r.q for r in pages.read_json_lines(spark, str(tmp_path / "a.jsonl"), "q string").collect()] == ["x", "y"]
    with pytest.raises(Exception, match="FAILFAST|MALFORMED|malformed"):
        pages.read_json_lines(spark, str(tmp_path / "a.jsonl"), "q string", strict=True).collect()


def test_a_run_over_stored_answers(spark):
    samples = spark.createDataFrame([(1, "qa", "q", " 42 "), (2, None, "q", "no"), (3, "", "q", ""), (4, "ie", "q", "x")], "sample_id long, task_type string, question string, answer string")
    answers = spark.createDataFrame([(1, "it is 42, 引用 [1]", "p", "m"), (2, "yes", None, None), (3, "证据", "p", "m"), (9, "lone", "p", "m")], "sample_id long, pred string, provider string, model string")
    got = {r.sample_id: r for r in jobs.executed(samples, answers).collect()}
    assert {i: (r.task_type, r.provider, r.model, r.score_total) for i, r in got.items()} == {1: ("QA", "p", "m", 100.0), 2: ("QA", "stub", "stub-mvp", 10.0), 3: ("QA", "p", "m", 20.0), 4: ("IE", "stub", "stub-mvp", 10.0)}
    diff, pred = json.loads(got[1].diff_json), json.loads(got[4].pred_json)
    assert diff["diff"]["qa"] == {"truth": " 42 ", "pred": "it is 42, 引用 [1]", "match": True} and diff["diff"]["ie"] == {} and pred["pred"] == "" and pred["truth"] == "x"
    assert jobs.executed(samples.limit(0), answers).count() == 0
