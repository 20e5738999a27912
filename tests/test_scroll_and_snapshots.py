"""Paged reading by key, and streams with dictionaries that change."""

import pytest
from pyspark.sql import functions as F

from citelake.operators import filters
from citelake.sources.scroll import ScrollReader, ScrollSource, scrolled
from citelake.streaming import snapshots
from citelake.streaming.snapshots import Snapshots


@pytest.fixture(scope="module")
def scroll(spark):
    spark.dataSource.register(ScrollSource)
    return spark


def payload(spark, path, ids, mode="append"):
    spark.createDataFrame([(i, f"t{(i or 0) % 3}", None if (i or 0) % 5 == 0 else (i or 0) / 2) for i in ids], "id long, kind string, score double").repartition(2).write.mode(mode).parquet(path)


def test_batch_read_with_filters(scroll, tmp_path):
    path = str(tmp_path / "p")
    payload(scroll, path, range(-40, 500))
    payload(scroll, path, [None, 10**12])
    rows = scroll.read.format("scroll").option("path", path).option("key", "id").option("partitions", 5).load()
    plain = scroll.read.parquet(path).where("id is not null")
    assert rows.schema == plain.schema and rows.rdd.getNumPartitions() > 1
    for test in ("true", "id > 17 and id <= 60", "kind = 't1' and id < 90", "id in (3, 4, 1000)", "score is null", "score >= 40 and kind <> 't0'", "id = 7 or id = 8"):
        assert sorted(map(str, rows.where(test).collect())) == sorted(map(str, plain.where(test).collect())), test
    for must in ([{"key": "id", "range": {"gt": 17, "lte": 60.5}}], [{"key": "kind", "match": {"value": "t1"}}, {"key": "id", "range": {"lt": 90}}], [{"key": "id", "match": {"any": [3, 4, 1000]}}], [{"key": "score", "range": {"gte": 40}}], [{"key": "absent", "match": {"value": 1}}]):
        got = scrolled(scroll, path, "id", {"must": must}, partitions="3")
        assert sorted(map(str, got.collect())) == sorted(map(str, filters.apply_filter(plain, {"must": must}).collect())), must
    reader = ScrollReader({"path": path, "key": "id", "filter": '{"must": [{"key": "id", "range": {"gte": 100, "lt": 110}}]}'})
    assert sum(b.num_rows for part in reader.partitions() for b in reader.read(part)) == 11  # what is handed to Spark: the plain test is <=


def test_a_stream_goes_on_after_the_last_key(scroll, tmp_path):
    path, out = str(tmp_path / "p"), str(tmp_path / "out")
    payload(scroll, path, range(0, 40, 2))

    def run():
        stream = scroll.readStream.format("scroll").option("path", path).option("key", "id").option("page", 7).option("partitions", 3).load()
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.id for r in scroll.read.schema("id long, kind string, score double").parquet(out).collect())

    assert run() == list(range(0, 40, 2))
    payload(scroll, path, [3, 5, *range(40, 61)])  # 3 and 5 lie before the last key: a scroll has passed them
    assert run() == [*range(0, 40, 2), *range(40, 61)]
    assert run() == [*range(0, 40, 2), *range(40, 61)]


def test_a_change_shows_in_the_next_batch_only(spark, tmp_path):
    base = str(tmp_path / "s")
    known = Snapshots(spark, f"{base}/names")
    schema = "id long, kind string"
    stream = lambda: spark.readStream.schema(schema).parquet(f"{base}/in")
    join = lambda batch, names: batch.join(names, "kind", "left")
    spark.createDataFrame([(1, "a"), (2, "b")], schema).write.parquet(f"{base}/in")
    with pytest.raises(Exception, match="no version"):
        snapshots.run_joined(stream(), known, join, f"{base}/out").awaitTermination()
    assert known.publish(spark.createDataFrame([("a", "old")], "kind string, name string")) == 0
    snapshots.run_joined(stream(), known, join, f"{base}/out").awaitTermination()
    assert known.publish(spark.createDataFrame([("a", "new"), ("b", "new b")], "kind string, name string")) == 1
    spark.createDataFrame([(3, "a"), (4, "b"), (5, None)], schema).write.mode("append").parquet(f"{base}/in")
    snapshots.run_joined(stream(), known, join, f"{base}/out").awaitTermination()
    want = [(1, "old", 0), (2, None, 0), (3, "new", 1), (4, "new b", 1), (5, None, 1)]
    read = lambda: sorted((r.id, r.name, r.batch) for r in snapshots.results(spark, f"{base}/out").collect())
    assert read() == want
    known.publish(spark.createDataFrame([("a", "newest")], "kind string, name string"))
    sink = snapshots.batch_with_snapshot(known, join, f"{base}/out")  # a batch that is repeated uses its version again
    sink(spark.createDataFrame([(1, "a"), (2, "b")], schema), 0)
    assert read() == want
    known.drop_before(2)
    assert known.newest() == 2 and snapshots._numbers(spark, f"{base}/names/version=*") == [2]
