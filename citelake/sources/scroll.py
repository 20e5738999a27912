"""Paged reading of a payload folder by key, as a data source: spark.read.format("scroll") and spark.readStream.

Rows are read by ranges of the key, each a task's, a page at a time. The place of a stream is the last key it has read, so a
restarted query goes on after it; rows that are put in before that key are passed. The folder holds Parquet files; their
row-group statistics say which groups a range of keys, or a filter, can be in, and only those are read.

Options: path (an address that Python's Arrow can open: a local or shared folder, or a store), key (a column of whole
numbers, each once; rows with null are not scrolled), page (rows a page of a stream, 256), partitions (8), filter (a filter
of the filter language as JSON: its plain tests are applied where rows are read; scrolled() applies the whole of it).
The filter is an option, and Spark's own hand-over of filters is not taken: in Spark 4.1 a Python reader keeps what one query
has handed over for later queries of the same DataFrame, which then lose rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema

from citelake.operators import filters
from citelake.operators.payload_index import plain_tests

PAGE, PARTITIONS = 256, 8


def opened(path: str) -> ds.Dataset:
    """The folder's Parquet files; names that start with _ or . are no rows."""
    if "://" in path:
        from pyarrow import fs

        system, where = fs.FileSystem.from_uri(path)
        return ds.dataset(where, filesystem=system, format="parquet")
    return ds.dataset(path.removeprefix("file:"), format="parquet")


class KeyRange(InputPartition):
    """Keys above `after` up to `last`; None is no bound."""

    def __init__(self, after: int | None, last: int | None):
        self.after, self.last = after, last

    def test(self, key: str) -> ds.Expression:
        test = ds.field(key).is_valid()
        if self.after is not None:
            test &= ds.field(key) > self.after
        return test & (ds.field(key) <= self.last) if self.last is not None else test


def key_span(rows: ds.Dataset, key: str) -> tuple[int, int] | None:
    """Least and largest key, by row-group statistics, and where a file has none by reading its keys."""
    least, most = [], []
    for piece in rows.get_fragments():
        for group in piece.row_groups:
            if group.statistics and key in group.statistics:
                least.append(group.statistics[key]["min"])
                most.append(group.statistics[key]["max"])
            elif group.num_rows and (found := pc.min_max(piece.subset(row_group_ids=[group.id]).to_table(columns=[key]).column(key)).as_py())["min"] is not None:
                least.append(found["min"])
                most.append(found["max"])
    return (min(least), max(most)) if least else None


def ranges(least: int, most: int, parts: int, after: int | None, last: int | None) -> list[KeyRange]:
    """The keys from least to most in about equal ranges, the outer ones as wide as `after` and `last` say."""
    cuts = sorted({least - 1 + (most - least + 1) * i // parts for i in range(1, parts)} - {least - 1, most})
    return [KeyRange(a, b) for a, b in zip([after, *cuts], [*cuts, last], strict=True)]


class ScrollReader(DataSourceReader):
    """Ranges of all keys."""

    def __init__(self, options: dict):
        self.path, self.key, self.parts, self.page = options["path"], options["key"], int(options.get("partitions", PARTITIONS)), int(options.get("page", PAGE))
        self.spec = json.loads(options["filter"]) if options.get("filter") else None

    def partitions(self) -> list[KeyRange]:
        span = key_span(opened(self.path), self.key)
        return ranges(*span, self.parts, None, None) if span else [KeyRange(None, None)]

    def read(self, partition: KeyRange) -> Iterator[pa.RecordBatch]:
        rows, test = opened(self.path), partition.test(self.key)
        for name, op, edge in plain_tests(self.spec, from_arrow_schema(rows.schema)):
            field = ds.field(name)
            test &= field.isin(edge) if op == "in" else field >= pa.scalar(edge) if op == ">=" else field <= pa.scalar(edge)
        yield from rows.to_batches(filter=test, batch_size=self.page)


class ScrollStream(ScrollReader, DataSourceStreamReader):
    """All keys after the last one read; the offset is the last key."""

    def initialOffset(self) -> dict:
        return {"after": None}

    def latestOffset(self) -> dict:
        span = key_span(opened(self.path), self.key)
        return {"after": span[1] if span else None}

    def partitions(self, start: dict, end: dict) -> list[KeyRange]:
        after, last = start["after"], end["after"]
        if last is None or after is not None and after >= last:
            return []
        least = after + 1 if after is not None else key_span(opened(self.path), self.key)[0]
        return ranges(least, last, self.parts, after, last)


class ScrollSource(DataSource):
    """Registered by spark.dataSource.register(ScrollSource), which scrolled() does."""

    @classmethod
    def name(cls) -> str:
        return "scroll"

    def schema(self):
        return from_arrow_schema(opened(self.options["path"]).schema)

    def reader(self, schema) -> ScrollReader:
        return ScrollReader(dict(self.options))

    def streamReader(self, schema) -> ScrollStream:
        return ScrollStream(dict(self.options))


def scrolled(spark: SparkSession, path: str, key: str, spec: dict | None = None, **options: str) -> DataFrame:
    """The rows of a payload folder that pass a filter."""
    spark.dataSource.register(ScrollSource)
    rows = spark.read.format("scroll").options(path=path, key=key, **({"filter": json.dumps(spec)} if spec else {}), **options).load()
    return filters.apply_filter(rows, spec)
