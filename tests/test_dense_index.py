"""The cells' index against the exhaustive search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from citelake.operators import dense_index, retrieval
from citelake.operators.dense_index import DenseIndex


def vectors(n, dim=12, groups=9, seed=4):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(groups, dim))
    return [(i, (centers[i % groups] + rng.normal(scale=0.12, size=dim)).tolist()) for i in range(n)]


def same(got, want):
    key = lambda df: sorted((r.query_id, r.rank, r.ordinal, round(r.score, 7)) for r in df.collect())
    assert key(got) == key(want)


@pytest.mark.parametrize(("n", "share"), [(800, 0.6), (5000, 0.35)])
def test_search_equals_exhaustive_search(spark, tmp_path, n, share):
    data = vectors(n)
    data += [(n + i, data[3][1]) for i in range(40)] + [(9000, None), (9001, []), (9002, [0.0] * 12), (9003, [1.0, 2.0]), (9004, [float("nan")] * 12), (9005, [None] + [1.0] * 11)]
    rows = spark.createDataFrame(data, "ordinal long, vector array<double>").repartition(4)
    index = DenseIndex(spark, str(tmp_path / "dense"))
    index.create(rows.where("ordinal % 3 > 0"), 12)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "dense").rglob("*.parquet")}
    index.add(rows.where("ordinal % 3 = 0"))
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())
    asked = rows.where("ordinal % 50 = 0 and ordinal < 9000").select(F.col("ordinal").alias("query_id"), F.col("vector").alias("query_vector"))
    asked = asked.unionByName(spark.createDataFrame([(-1, None), (-2, [0.0] * 12), (-3, [1.0] * 12), (-4, [1.0, 2.0])], asked.schema))
    reopened = DenseIndex(spark, str(tmp_path / "dense"))
    fine = rows.where(F.size("vector") == 12)  # the index has one length
    same(reopened.search(asked, 7), retrieval.dense_best(fine, asked, 7))
    assert reopened.read["cells"] < share * reopened.read["of_cells"] and reopened.read["rows"] < share * reopened.read["of_rows"]


def test_more_answers_than_rows_and_none(spark, tmp_path):
    rows = spark.createDataFrame(vectors(5), "ordinal long, vector array<double>")
    asked = rows.select(F.col("ordinal").alias("query_id"), F.col("vector").alias("query_vector"))
    index = DenseIndex(spark, str(tmp_path / "few"))
    index.create(rows, 12, cells=3)
    same(index.search(asked, 10), retrieval.dense_best(rows, asked, 10))
    assert index.search(asked.limit(0), 10).count() == 0
    empty = DenseIndex(spark, str(tmp_path / "none"))
    empty.create(rows.limit(0), 12)
    assert empty.search(asked, 3).count() == 0


def test_cells_are_pruned_at_planning(spark, tmp_path):
    rows = spark.createDataFrame(vectors(3000, groups=20), "ordinal long, vector array<double>")
    index = DenseIndex(spark, str(tmp_path / "plan"))
    index.create(rows, 12)
    asked = rows.where("ordinal = 17").select(F.col("ordinal").alias("query_id"), F.col("vector").alias("query_vector"))
    plans, best = [], dense_index.best_in_tasks
    try:
        dense_index.best_in_tasks = lambda df, *rest: plans.append(df._jdf.queryExecution().toString()) or best(df, *rest)
        index.search(asked, 3).collect()
    finally:
        dense_index.best_in_tasks = best
    assert plans and all("cell" in p.split("PartitionFilters: [")[-1].split("]")[0] for p in plans) and all("radius" in p.split("PushedFilters: [")[-1] for p in plans[1:])
