"""Names in questions and tables across pages against brute force."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from citelake.operators import filters, normalize


def test_names_equal_containment(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("ab张é😀 .\n") for _ in range(n))
    names = {word(rng.randrange(1, 9)) for _ in range(150)} | {"aaaa", "aaaaa", "aaaab", "a", "张建国", "%_", "(.*)", "a\nb"}
    questions = [(i, word(rng.randrange(0, 60))) for i in range(80)] + [(900, None), (901, ""), (902, "aaaaaa" * 2000 + "张建国"), (903, "x%_y(.*)")]
    asked = spark.createDataFrame(questions, "query_id long, question string")
    known = spark.createDataFrame([(n,) for n in names] + [("aaaa",), ("",), (None,)], "name string")
    got = [tuple(r) for r in filters.names_in(asked, known).collect()]
    assert sorted(got) == sorted((i, n) for i, q in questions if q for n in names if n in q)
    assert filters.names_in(asked.limit(0), known).count() == 0 and filters.names_in(asked, known.limit(0)).count() == 0
    plan = filters.names_in(asked, known)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def fold(tables, least):
    """One document's tables in order, as dictionaries, merged one by one."""
    out = []
    for page, order, raw in sorted(tables, key=lambda t: t[:2]):
        lines = [x.strip() for x in (raw or "").splitlines() if x.strip()]
        if page <= 0 or not lines:
            continue
        if out and page == out[-1][1] + 1:
            goes_on, same = normalize.continues(out[-1][2], lines, least)
            if goes_on:
                rest = [normalize.bare_first_line(lines[0]), *lines[1:]]
                rest = rest[1:] if same and len(rest) > 1 else rest
                rest = rest[1:] if rest and rest[0] == out[-1][2][-1] else rest
                out[-1][1], out[-1][2] = page, out[-1][2] + rest
                continue
        out.append([page, page, lines])
    return [(first, last, "\n".join(lines).strip()) for first, last, lines in out]


HEADS = ["name|size|note", "Name | size | note", "name|size|notes", "other|thing", "续表 1", "Continued table: name|size|note", "cont.", "", " ", None]


def test_tables_equal_a_fold_over_whole_documents(spark):
    rng, docs = random.Random(4), {}
    for d in range(40):
        pages = sorted(rng.randrange(0, 12) for _ in range(rng.randrange(0, 12)))
        docs[f"d{d}"] = [(p, n, None if (h := rng.choice(HEADS)) is None else "\n".join([h, *(rng.choice("xyz") for _ in range(rng.randrange(3)))])) for n, p in enumerate(pages)]
    rows = [(d, "v", f"t{n}", p, n, raw) for d, tables in docs.items() for p, n, raw in tables]
    df = spark.createDataFrame(rows, "doc_id string, version_id string, table_id string, page_no int, order_in_page int, raw_text string").repartition(3)
    got = {}
    for r in normalize.merged_across_pages(df).collect():
        assert r.page_no == r.page_start
        got.setdefault(r.doc_id, []).append((r.page_start, r.page_end, r.raw_text, r.order_in_page))
    assert {d: [x[:3] for x in sorted(t, key=lambda x: (x[0], x[3]))] for d, t in got.items()} == {d: f for d, t in docs.items() if (f := fold(t, 0.78))}
    assert normalize.merged_across_pages(df.limit(0)).count() == 0
    assert "applyInPandas" not in open(normalize.__file__).read() and "FlatMapGroups" not in normalize.merged_across_pages(df)._jdf.queryExecution().toString()


@given(st.lists(st.sampled_from("ab|1 "), max_size=12), st.lists(st.sampled_from("ab|1 "), max_size=12))
@settings(deadline=None, max_examples=60)
def test_header_likeness_is_between_0_and_1(a, b):
    x, y = normalize.header_signature(["".join(a)]), normalize.header_signature(["".join(b)])
    assert 0 <= normalize.header_similarity(x, y) <= 1 and (not x or normalize.header_similarity(x, x) == 1)


def test_cut_names_equal_containment_and_no_place_becomes_a_row(spark, monkeypatch):
    rng = random.Random(3)
    names = {"Person#" + "".join(rng.choice("01") for _ in range(rng.randrange(1, 14))) for _ in range(200)} | {"Per", "on#0", "é😀", "x" * 40}
    questions = [(i, "".join(rng.choice(["Person#", "0", "1", "0110", "é😀", " ", "x" * 39]) for _ in range(30))) for i in range(60)]
    asked, known = spark.createDataFrame(questions, "query_id long, question string"), spark.createDataFrame([(n,) for n in names], "name string")
    want = sorted((i, n) for i, q in questions for n in names if n in q)
    for most in (3, 20, 50_000):
        monkeypatch.setattr(filters, "MOST_CUT", most)
        found = filters.names_in(asked, known)
        assert sorted(tuple(r) for r in found.collect()) == want
        assert "posexplode" not in found._jdf.queryExecution().analyzed().toString()
