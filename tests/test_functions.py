import hashlib
import math
import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from citelake.functions import clauses, embedding, fixed, terms, text


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_strip_and_squeeze_know_unicode_space(spark):
    assert one(spark, text.strip(F.col("t")), t="　 a b\t\n ") == "a b"
    assert one(spark, text.squeeze(F.col("t")), t="a　　b\n c ") == "a b c"
    assert one(spark, text.strip(F.lit(None).cast("string"))) == ""


def test_readable_ratio(spark):
    assert one(spark, text.readable_ratio(F.col("t")), t="条文1。ab") == 1.0
    assert one(spark, text.readable_ratio(F.col("t")), t="ab##") == 0.5
    assert one(spark, text.readable_ratio(F.col("t")), t="") == 0.0


def test_quick_patterns_match_what_plain_ones_match(spark):
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x11000), *range(0x1F300, 0x1F700), *range(0x20000, 0x20100)]))
    rng = random.Random(2)
    mixed = "".join(rng.choices(" \t\n\r\x0b\x85\xa0\u2028\u3000ab接", k=5000))
    marks = text.quoted_class(fixed.READABLE_MARKS)
    plain = {
        f"[{text.unreadable()}]": r"[^\p{L}\p{N}" + marks + "]",
        f"[{text.unreadable('#')}]": r"[^\p{L}\p{N}#]",
        f"[{text.SYMBOLS}]": r"[^\p{L}\p{N}\s\x85\xa0\u2000-\u200a\u3000]",
    }
    for quick, slow in plain.items():
        assert one(spark, F.regexp_replace("t", quick, ""), t=every) == one(spark, F.regexp_replace("t", slow, ""), t=every)
    assert one(spark, text.single_spaced(F.col("t")), t=mixed) == one(spark, F.regexp_replace("t", r"(?U)[\s&&[^ ]]\s*| \s+", " "), t=mixed)
    assert one(spark, text.lines(F.col("t")), t="a\r\n\r\nb\rc\n\rd\u2028 \x85e") == list("abcde")


@pytest.mark.parametrize(
    ("raw", "want"),
    [(r"30\mathrm{min}", "30 min"), (r"$220 \mathrm{k V}$", "220 kV"), (r"a\leq b", "a <= b"), (r"\times{}", "x"), (r"plain 3.0.6", "plain 3.0.6"), (r"\foo{两 字}", "两 字")],
)
def test_latex_residue(spark, raw, want):
    assert one(spark, text.clean_block(F.col("t")), t=raw) == want


@pytest.mark.parametrize(("t", "toc"), [("", True), ("Table of Contents", True), ("3 基本规定 (5)", True), ("3.1 总则 (4) 3.2 术语 (6)", True), ("前言 ...... 3", True), ("3.0.6 设备应接地。", False)])
def test_contents_lines(spark, t, toc):
    assert one(spark, text.is_toc_like(F.col("t")), t=t) is toc


def test_noise(spark):
    assert one(spark, text.is_noisy(F.col("t")), t="%PDF-1.7 endstream")
    assert not one(spark, text.is_noisy(F.col("t")), t="电容器安装前应检查外观。")
    assert one(spark, text.is_noisy_row(F.col("t")), t="endstream | %PDF-")
    assert not one(spark, text.is_noisy_row(F.col("t")), t="电压 | 220kV")


def test_clause_algebra(spark):
    node = "3.0.6(3).1"
    got = spark.createDataFrame([(node,)], "n string").select(clauses.parent(F.col("n")), clauses.level(F.col("n"))).first()
    assert got[0] == "3.0.6(3)" and got[1] == 5
    assert one(spark, clauses.parent(F.col("n")), n="3.0.6(3)") == "3.0.6"
    assert one(spark, clauses.parent(F.col("n")), n="3") == ""
    assert one(spark, clauses.article_path(F.col("n")), n="4.12.1(3)") == ["4", "4.12", "4.12.1"]
    assert one(spark, clauses.all_clauses(F.col("n")), n="见 3.0.6 与 4.1.2(3)，又 3.0.6") == ["3.0.6", "4.1.2(3)"]
    assert one(spark, clauses.in_family(F.lit("4.8.10"), F.lit("4.8"))) and not one(spark, clauses.in_family(F.lit("4.80"), F.lit("4.8")))


def test_query_terms():
    assert terms.query_terms("电容器安装有哪些规定")[0] == "电容器安装"
    assert terms.query_terms("foo bar") == ["foobar"]
    assert terms.query_terms("foo bar", "words") == ["foo", "bar"]
    assert "3.0.6" not in " ".join(terms.query_terms("3.0.6 条 110kV"))
    assert terms.standard_tokens("按 gb 50150-2016 执行") == ["GB 50150-2016", "GB50150-2016"]


def test_hash_vector_equals_its_definition(spark):
    t, dim = "3.0.6 Grounding 接地 ab", 64
    low = t.lower()
    want = [0.0] * dim
    for tok in re.findall(r"\d+(?:\.\d+)+", low) + re.findall("[a-z0-9]+", low) + re.findall("[一-鿿]", low):
        d = hashlib.sha256(tok.encode()).digest()
        want[int.from_bytes(d[:4], "big") % dim] += (1 if d[4] % 2 == 0 else -1) * (1 + min(len(tok), 8) / 8)
    norm = math.sqrt(sum(v * v for v in want))
    got = one(spark, embedding.hash_vector(F.col("t"), dim), t=t)
    assert got == pytest.approx([v / norm for v in want])


def test_name_id_is_a_uuid5(spark):
    u = uuid.uuid5(uuid.NAMESPACE_DNS, "person:张建国").hex[:16]
    assert one(spark, text.name_id(F.lit("person"), F.lit("张建国"))) == f"person_{u}"


def test_packed_sentences(spark):
    t = "一二三四五。六七八九十。甲乙丙丁。"
    assert one(spark, text.packed_sentences(F.col("t"), 12, 0), t=t) == ["一二三四五。六七八九十。", "甲乙丙丁。"]
    assert one(spark, text.packed_sentences(F.col("t"), 12, 3), t=t) == ["一二三四五。六七八九十。", "九十。甲乙丙丁。"]
    assert one(spark, text.packed_sentences(F.col("t"), 12, 3), t="") == []


def test_window_around(spark):
    before, after = text.window_around(F.col("t"), F.col("n"), 3)
    got = spark.createDataFrame([("abcdefgh", "de"), ("abc", "zz")], "t string, n string").select(before.alias("b"), after.alias("a")).collect()
    assert [tuple(r) for r in got] == [("abc", "fgh"), ("", "")]


def test_redaction(spark):
    assert one(spark, text.redact(F.col("t")), t="电话13812345678 a.b@c.de 11010519491231002X") == "电话[PHONE] [EMAIL] [IDCARD]"


def test_white_space_goes_without_a_match_for_every_space(spark):
    from pyspark.sql import functions as F

    from citelake.functions import clauses, text

    marks = [chr(i) for i in [*range(1, 0x300), *range(0x1600, 0x3100), 0xFEFF, 0x1F600]]
    rows = spark.createDataFrame([(f"{c}{c} a{c} b  c{c}(1.2) 3{c}",) for c in marks], "x string")
    old = F.regexp_replace("x", r"(?U)\A\s+|\s+\z", "")
    spaced = F.regexp_replace("x", r"(?U)\s+", " ")
    clause = F.nullif(F.regexp_extract("x", text.fixed.CLAUSE, 1), F.lit(""))
    body = r"\p{L}\p{N}" + text.quoted_class(text.fixed.READABLE_MARKS)
    same = (text.strip(F.col("x")) == old) & (text.single_spaced(F.col("x")) == spaced) & clauses.first_clause(F.col("x")).eqNullSafe(clause) & (text.readable_ratio(F.col("x")) == text.char_share(F.col("x"), body))
    assert rows.where(~same).count() == 0
    plan = rows.select(text.strip(F.col("x")))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "trim" in plan
    assert rows.where(F.regexp_count(F.lit("an ordinary text, with single spaces"), F.lit(text._RUN)) > 0).count() == 0
