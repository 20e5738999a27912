"""The laid-out rows against filters over plain rows."""

import random

import pytest

from citelake.operators import filters
from citelake.operators.payload_index import PayloadIndex, pushable

SCHEMA = "id long, kind string, kv int, price double, cost decimal(10,2), must boolean, ids array<string>, clause_id string, clause_no string, day date"


def rows(n=4000):
    rng = random.Random(3)
    maybe = lambda v: None if rng.random() < 0.05 else v
    from datetime import date, timedelta
    from decimal import Decimal

    return [(i, maybe(rng.choice(["a", "b", "hot", "hot", "hot"])), maybe(rng.randrange(1000)), maybe(rng.random() * 100), maybe(Decimal(rng.randrange(100000)) / 100), maybe(rng.random() < 0.5), maybe([f"x{rng.randrange(30)}"]), maybe(f"c{rng.randrange(50)}"), None if rng.random() < 0.5 else f"c{rng.randrange(50)}", maybe(date(2024, 1, 1) + timedelta(rng.randrange(300)))) for i in range(n)]


MUSTS = [
    [{"key": "kv", "range": {"gte": 100, "lt": 120}}], [{"key": "kv", "range": {"gt": 99.5, "lte": 120.5}}, {"key": "price", "range": {"lt": 10.25}}], [{"key": "kind", "match": {"any": ["a", "z"]}}, {"key": "kv", "range": {"gte": 990}}],
    [{"key": "cost", "range": {"gte": 10.005, "lte": 20.994}}], [{"key": "kv", "match": {"any": [7, 500]}}], [{"key": "kv", "match": {"value": "7"}}], [{"key": "must", "match": {"value": True}}, {"key": "kv", "range": {"lte": 5}}],
    [{"key": "ids", "match": {"any": ["x3"]}}], [{"key": "clause_no", "match": {"any": ["c3", "c4"]}}], [{"key": "day", "match": {"value": "2024-02-01"}}], [{"key": "kind", "range": {"gte": 1}}], [{"key": "kv", "match": {"any": []}}], [{"key": "absent", "match": {"value": 1}}],
    [{"key": "kv", "range": {"gte": 1e300}}], [{"key": "price", "match": {"value": 3.5}}], [{"key": "kind", "match": {"value": "hot"}}], [],
]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    made = PayloadIndex(spark, str(tmp_path_factory.mktemp("payload") / "p"))
    data = rows()
    made.write(spark.createDataFrame(data[:3000], SCHEMA), ["kind", "kv", "price", "ids"], bloom=("clause_id",), files=16)
    made.write(spark.createDataFrame(data[3000:], SCHEMA), ["kind", "kv", "price"], files=4)
    return made


@pytest.mark.parametrize("must", MUSTS)
def test_filters_give_the_rows_that_they_give_on_plain_rows(spark, index, must):
    plain = spark.createDataFrame(rows(), SCHEMA)
    for strict in (False, True):
        want = sorted(r.id for r in filters.apply_filter(plain, {"must": must}, strict).select("id").collect())
        assert sorted(r.id for r in index.read({"must": must}, strict).select("id").collect()) == want


def test_few_files_are_read_and_predicates_pushed(spark, index):
    got = index.read({"must": [{"key": "kv", "range": {"gte": 100, "lt": 120}}, {"key": "price", "range": {"lt": 30}}]})
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = got._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan.split("PushedFilters: [")[1]
    assert len(index.files) == 20 and len(index.opened) <= 8 and got.count() > 0
    assert "GreaterThanOrEqual(kv,100)" in pushed and "LessThanOrEqual(price,30.0)" in pushed
    assert pushable({"must": [{"key": "ids", "match": {"any": ["x"]}}]}, got.schema) is None
    hot = index.read({"must": [{"key": "kind", "match": {"value": "hot"}}]}).count()
    assert hot > 2000 and len(index.opened) > 8  # one value on over half of all rows lies in many files


def test_nothing_written(spark, tmp_path):
    made = PayloadIndex(spark, str(tmp_path / "p"))
    made.write(spark.createDataFrame([], SCHEMA), ["kv"])
    assert made.read({"must": [{"key": "kv", "range": {"gte": 1}}]}).count() == 0 and made.read().count() == 0


def test_a_large_run_is_more_files_and_no_task_sorts_it_for_the_manifest(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from citelake.operators import payload_index

    monkeypatch.setattr(payload_index, "MOST_ROWS", 50, raising=False)
    rows = spark.range(1000).select("id", (F.col("id") % 37).cast("string").alias("kind"))
    store = PayloadIndex(spark, str(tmp_path / "many"))
    store.write(rows, ["kind"], files=4)
    got = store.read({"must": [{"key": "kind", "match": {"value": "5"}}]})
    assert sorted(r["id"] for r in got.collect()) == [i for i in range(1000) if i % 37 == 5]
    assert len(store.files) >= 15 and len(store.opened) < len(store.files)
