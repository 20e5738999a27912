"""A payload index: index rows laid out so that filters open few files.

Rows are written along a space-filling order of the filtered fields: each field's values are ranked by cut points from a
bounded sample, the ranks' bits are interleaved, and files are ranges of that number, so rows that are near in all fields
lie together. A manifest keeps each file's least and largest value of each field and its nulls; a filter first drops files
by it, and what is left is read with predicates that Parquet's row-group statistics and Bloom filters can use. The exact
filter of the filter language follows, so that the layout never changes a result.
"""

from __future__ import annotations

import math
import uuid
from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citelake.operators import filters

#: Rows that cut points are taken from (those with the smallest hashes), and bits of a field's rank.
SAMPLE, BITS = 20_000, 6
#: Fields of these kinds are ordered, kept in the manifest and pushed down.
ORDERED = (T.StringType, T.IntegralType, T.FractionalType, T.BooleanType, T.DateType, T.TimestampType)
NUMBER = (T.IntegralType, T.DoubleType, T.FloatType, T.DecimalType)
#: Rows a task sorts and writes as one file at most, about.
MOST_ROWS = 1 << 20
#: Beyond this size whole numbers and doubles are no longer told apart one by one.
EXACT = 1 << 53


def _ordered(kind: T.DataType) -> bool:
    return isinstance(kind, ORDERED)


def _values(values: tuple, kind: T.DataType) -> list | None:
    """Values as the field's kind has them, those that it cannot hold left out; None where that is not plain."""
    if isinstance(kind, T.StringType):
        return [str(v) for v in values]
    if isinstance(kind, T.BooleanType):
        return list(values) if all(isinstance(v, bool) for v in values) else None
    if isinstance(kind, T.IntegralType):
        return list(values) if all(isinstance(v, int) and not isinstance(v, bool) and abs(v) < EXACT for v in values) else None
    return None


def _edge(op: str, bound: float, kind: T.DataType) -> Any:
    """The bound as a value of the field's kind, at or outside of it; None where that is not plain."""
    low = op in ("gte", "gt")
    if isinstance(kind, T.IntegralType):
        return (math.floor if low else math.ceil)(bound) if abs(bound) < EXACT else None
    if isinstance(kind, T.DecimalType):
        step = Decimal(1).scaleb(-kind.scale)
        edge = Decimal(bound).quantize(step, ROUND_FLOOR if low else ROUND_CEILING) if abs(bound) < 10 ** min(15, kind.precision - kind.scale) else None
        return edge
    return bound if isinstance(kind, T.DoubleType) else None


def needed(c: filters.Condition, kind: T.DataType, strict: bool = False) -> list[tuple[str, Any]]:
    """Plain tests (in, >=, <=) of one field that every row which passes the condition passes too."""
    out: list[tuple[str, Any]] = []
    for values in (c.any_of, None if c.value is None else (c.value,)):
        if values is not None and (plain := _values(values, kind)) is not None:
            out.append(("in", plain))
    for op, bound in c.bounds.items():
        if strict and op in ("gt", "lt"):  # which the strict language leaves out
            continue
        if isinstance(kind, NUMBER) and (edge := _edge(op, bound, kind)) is not None:
            out.append((">=" if op in ("gte", "gt") else "<=", edge))
    return out


def plain_tests(spec: dict | None, schema: T.StructType, strict: bool = False) -> list[tuple[str, str, Any]]:
    """(field, in | >= | <=, edge) for every plain test that the whole filter implies. Conditions on fields with a stand-in,
    on arrays and on texts as numbers are left to the exact filter."""
    kinds = {f.name: f.dataType for f in schema}
    plain = [c for c in filters.conditions(spec) if c.key in kinds and (strict or filters.STAND_IN.get(c.key) not in kinds)]
    return [(c.key, op, edge) for c in plain for op, edge in needed(c, kinds[c.key], strict)]


def pushable(spec: dict | None, schema: T.StructType, strict: bool = False) -> Column | None:
    """A predicate over bare fields that a scan can push down and that the filter implies."""
    tests = []
    for name, op, edge in plain_tests(spec, schema, strict):
        field, lit = F.col(f"`{name}`"), (lambda v, kind=schema[name].dataType: F.lit(v).cast(kind))
        tests.append(field.isin(*edge) if op == "in" else field >= lit(edge) if op == ">=" else field <= lit(edge))
    return reduce(Column.__and__, tests) if tests else None


def _rank(name: str, cuts: list, kind: T.DataType) -> Column:
    """How many cut points a field's value reaches; 0 for null."""
    field = F.col(f"`{name}`")
    reached = F.size(F.filter(F.array(*[F.lit(c).cast(kind) for c in cuts]), lambda x: x <= field)) if cuts else F.lit(0)
    return F.when(field.isNull(), 0).otherwise(reached).cast("long")


def with_place(rows: DataFrame, fields: list[str], bits: int = BITS) -> DataFrame:
    """Adds _z, the interleaved bits of the fields' ranks among cut points from a sample."""
    sample, ranks = rows.select(*fields).orderBy(F.xxhash64(*fields)).limit(SAMPLE).collect() if fields else [], {}
    for i, name in enumerate(fields):
        known = sorted(r[name] for r in sample if r[name] is not None)
        cuts = dict.fromkeys(known[len(known) * j // (1 << bits)] for j in range(1, 1 << bits)) if known else {}
        ranks[f"_z{i}"] = _rank(name, list(cuts), rows.schema[name].dataType)
    out = F.lit(0).cast("long")
    for bit in range(bits):
        for i in range(len(fields)):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(F.col(f"_z{i}"), bit).bitwiseAND(1), bit * len(fields) + i))
    return rows.withColumns(ranks).withColumn("_z", out).drop(*ranks)


class PayloadIndex:
    """Index rows in a folder of the shared store. After read(), `opened` holds the files that are read, of `files`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.opened, self.files = spark, path.rstrip("/"), [], []

    def write(self, rows: DataFrame, fields: list[str], bloom: tuple[str, ...] = (), files: int | None = None, row_group: int = 16 << 20) -> None:
        """A run of rows, to the others of this index. fields: up to ten that filters ask for most; bloom: fields of many
        values that are asked for by value. Rows of one place in the order are dealt on by their place in the
        input, so that a value on a third of all rows is many tasks' and files'. files is the least number of them: large runs are dealt into files of about MOST_ROWS rows, so
        that what a task holds does not grow with the run."""
        name = f"run-{uuid.uuid4().hex}"
        ordered = [f for f in fields if _ordered(rows.schema[f].dataType)][:10]
        parts = max(files or int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // MOST_ROWS))
        placed = with_place(rows, ordered).withColumn("_row", F.monotonically_increasing_id())
        out = placed.repartitionByRange(parts, "_z", *ordered, "_row").sortWithinPartitions("_z", *ordered).drop("_z", "_row").write
        for field in bloom:
            out = out.option(f"parquet.bloom.filter.enabled#{field}", "true")
        out.option("parquet.block.size", str(row_group)).parquet(f"{self.path}/rows/{name}")
        written_ = self.spark.read.parquet(f"{self.path}/rows/{name}")
        known = [f for f in written_.schema.names if _ordered(written_.schema[f].dataType)]
        bounds = F.map_from_arrays(F.array(*[F.lit(f) for f in known]), F.array(*[F.struct(F.min(f"`{f}`").cast("string").alias("least"), F.max(f"`{f}`").cast("string").alias("most")) for f in known]))
        # least and largest texts alone would have Spark sort all rows of a task by their file; a set among them has it hash
        files_ = written_.groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n"), bounds.alias("bounds"), F.collect_set(F.lit(0)).alias("_hashed")).where("size(_hashed) > 0")
        files_.select(F.concat(F.lit(f"{name}/"), F.element_at(F.split("f", "/"), -1)).alias("file"), "n", "bounds").coalesce(1).write.parquet(f"{self.path}/manifest/{name}")

    @staticmethod
    def _may_hold(bounds: dict, spec: dict | None, schema: T.StructType, strict: bool) -> bool:
        for name, op, edge in plain_tests(spec, schema, strict):
            if name in bounds:
                least, most = (_read(bounds[name][side], schema[name].dataType) for side in ("least", "most"))
                if least is None or (not any(least <= v <= most for v in edge) if op == "in" else most < edge if op == ">=" else least > edge):
                    return False
        return True

    def read(self, spec: dict | None = None, strict: bool = False) -> DataFrame:
        """The rows that pass a filter. The manifest, a row a file, decides on files as the plan is made."""
        lines = self.spark.read.parquet(f"{self.path}/manifest/*").collect()
        schema = self.spark.read.parquet(f"{self.path}/rows/*").schema
        self.files = sorted(line["file"] for line in lines)
        self.opened = sorted(line["file"] for line in lines if self._may_hold(line["bounds"], spec, schema, strict))
        if not self.opened:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/rows/{f}" for f in self.opened])
        plain = pushable(spec, schema, strict)
        return filters.apply_filter(rows if plain is None else rows.where(plain), spec, strict)


def _read(value: str | None, kind: T.DataType) -> Any:
    """A bound of the manifest in the type of the field."""
    if value is None or isinstance(kind, T.StringType):
        return value
    if isinstance(kind, T.BooleanType):
        return value == "true"
    return int(value) if isinstance(kind, T.IntegralType) else Decimal(value) if isinstance(kind, T.DecimalType) else float(value)
