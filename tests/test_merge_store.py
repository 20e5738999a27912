"""Upserts as runs against a dictionary."""

import random

import pytest
from pyspark.sql import functions as F

from citelake.operators.merge_store import MergeStore

SCHEMA = "id long, kind string, v string, n int"


def state(store):
    return {(r.id, r.kind): (r.v, r.n) for r in store.read().collect()}


def size(folder, since=()):
    return sum(p.stat().st_size for p in folder.rglob("*.parquet") if p not in since)


def test_batches_equal_a_dictionary(spark, tmp_path):
    rng, want = random.Random(6), {}
    store = MergeStore(spark, str(tmp_path / "s"), SCHEMA, ("id", "kind"), 3)
    assert store.read().count() == 0 and store.runs() == []
    for batch in range(9):
        rows = [(rng.choice([None, *range(60)]), rng.choice("ab"), f"b{batch}", rng.randrange(9)) for _ in range(rng.choice([0, 3, 50]))]
        if batch % 4 == 3:
            store.delete(spark.createDataFrame([r[:2] for r in rows], "id long, kind string"))
            for r in rows:
                want.pop(r[:2], None)
        else:
            store.upsert(spark.createDataFrame(rows, SCHEMA), F.col("n"))
            for r in sorted(rows, key=lambda r: (r[3], r[2])):
                want[r[:2]] = r[2:]
        assert state(store) == want
    reopened = MergeStore(spark, str(tmp_path / "s"), SCHEMA, ("id", "kind"), 3)
    assert len(reopened.runs()) < 6 and state(reopened) == want  # small runs have been merged
    reopened.compact()
    gone = reopened.vacuum()
    assert len(gone) >= 9 and len(reopened.runs()) == 1 and state(reopened) == want and len(list((tmp_path / "s/runs").iterdir())) == 1
    assert spark.catalog.listTables() == []


def test_a_batch_writes_its_own_rows_only(spark, tmp_path):
    store = MergeStore(spark, str(tmp_path / "s"), "id long, v string", ("id",), 2)
    rows = spark.range(60_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("v"))
    store.upsert(rows)
    before = {p for p in tmp_path.rglob("*.parquet")}
    whole = size(tmp_path)
    store.upsert(rows.where("id % 100 = 0"))
    first = size(tmp_path, before)
    assert first < 0.03 * whole
    middle = {p for p in tmp_path.rglob("*.parquet")}
    store.upsert(rows.where("id % 10 = 0"))
    assert 5 * first < size(tmp_path, middle) < 0.15 * whole and before <= {p for p in tmp_path.rglob("*.parquet")}


def test_runs_meet_without_an_exchange(spark, tmp_path):
    store = MergeStore(spark, str(tmp_path / "s"), "id long, v string", ("id",), 2)
    rows = spark.range(5000).select("id", F.lit("x").alias("v"))
    for i in range(3):
        store.upsert(rows.where(F.col("id") >= i * 1000))
    plan = store.read()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Bucketed: true") == 3 and "Exchange" not in plan
    assert store.read().count() == 5000
    with pytest.raises(Exception):  # noqa: B017, PT011
        store.upsert(spark.range(3))
    assert store.read().count() == 5000
