"""The filter language: a conjunction of matches and ranges over index fields, compiled to one Column, and questions
compiled to filters."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citelake.functions import clauses, fixed, text

#: A field that stands in for another where that is null.
STAND_IN = {"clause_no": "clause_id", "clause_id": "clause_no"}
COMPARE = {"gte": Column.__ge__, "lte": Column.__le__, "gt": Column.__gt__, "lt": Column.__lt__}


@dataclass(frozen=True)
class Condition:
    """One condition: the field holds `value`, any of `any_of`, and lies in `bounds` ({gte, lte, gt, lt})."""

    key: str
    value: Any = None
    any_of: tuple | None = None
    bounds: dict = field(default_factory=dict)

    @classmethod
    def of(cls, spec: dict) -> Condition:
        match, bounds = spec.get("match") or {}, spec.get("range") or {}
        return cls(spec["key"], match.get("value"), tuple(match["any"]) if match.get("any") is not None else None, {k: float(v) for k, v in bounds.items() if v is not None})


def conditions(spec: dict | None) -> list[Condition]:
    return [Condition.of(c) for c in (spec or {}).get("must") or []]


def _literal(value: Any, kind: T.DataType) -> Column:
    return F.lit(str(value) if isinstance(kind, T.StringType) else value).try_cast(kind)


def _holds(field_: Column, kind: T.DataType, values: tuple) -> Column:
    if isinstance(kind, T.ArrayType):
        return F.arrays_overlap(field_, F.array(*[_literal(v, kind.elementType) for v in values])) if values else F.lit(False)
    return field_.isin(*[_literal(v, kind) for v in values]) if values else F.lit(False)


def compile_condition(c: Condition, schema: T.StructType, strict: bool = False) -> Column:
    """A definite boolean: an unknown field or value never matches. strict leaves out stand-ins and open bounds."""
    kinds = {f.name: f.dataType for f in schema}
    names = [n for n in (c.key, None if strict else STAND_IN.get(c.key)) if n in kinds]
    if not names:
        return F.lit(False)
    value, kind = F.coalesce(*names), kinds[names[0]]
    tests = []
    if c.any_of is not None:
        tests.append(_holds(value, kind, c.any_of))
    if c.value is not None:
        tests.append(_holds(value, kind, (c.value,)))
    if c.bounds:
        number = F.lit(None).cast("double") if isinstance(kind, T.ArrayType) else value.try_cast("double")
        tests.append(number.isNotNull())
        tests += [COMPARE[op](number, F.lit(v)) for op, v in c.bounds.items() if not (strict and op in ("gt", "lt"))]
    return F.coalesce(reduce(Column.__and__, tests), F.lit(False)) if tests else F.lit(True)


def compile_filter(spec: dict | None, schema: T.StructType, strict: bool = False) -> Column:
    """The whole conjunction; without conditions everything passes."""
    return reduce(Column.__and__, [compile_condition(c, schema, strict) for c in conditions(spec)], F.lit(True))


def apply_filter(df: DataFrame, spec: dict | None, strict: bool = False) -> DataFrame:
    return df.where(compile_filter(spec, df.schema, strict))


def merged(*specs: dict | None) -> dict | None:
    must = [c for s in specs for c in (s or {}).get("must") or []]
    return {"must": must} if must else None


def without_clauses(spec: dict | None) -> dict | None:
    must = [c for c in (spec or {}).get("must") or [] if c.get("key") not in STAND_IN]
    return {"must": must} if must else None


def doc_scope(spec: dict | None) -> tuple[set[str], set[str]]:
    """(doc ids, version ids) that a filter names."""
    found: dict[str, set[str]] = {"doc_id": set(), "version_id": set()}
    for c in conditions(spec):
        if c.key in found:
            found[c.key] |= {str(v).strip() for v in (*(c.any_of or ()), *((c.value,) if c.value else ())) if str(v).strip()}
    return found["doc_id"], found["version_id"]


def _one_holds(c: Column, name: str, schema: T.StructType) -> Column:
    """compile_condition() for a condition that is a column."""
    kinds = {f.name: f.dataType for f in schema}
    names = [n for n in (name, STAND_IN.get(name)) if n in kinds]
    if not names:
        return F.lit(False)
    value, kind = F.coalesce(*names), kinds[names[0]]
    if isinstance(kind, T.ArrayType):
        among, number = lambda xs: F.arrays_overlap(value, F.transform(xs, lambda x: x.try_cast(kind.elementType))), F.lit(None).cast("double")
    else:
        among, number = lambda xs: F.array_contains(F.transform(xs, lambda x: x.try_cast(kind)), value), value.try_cast("double")
    tests = [c["any_of"].isNull() | among(c["any_of"]), c["value"].isNull() | among(F.array(c["value"]))]
    return F.coalesce(reduce(Column.__and__, tests + [c[op].isNull() | test(number, c[op]) for op, test in COMPARE.items()]), F.lit(False))


def passes(specs: list[str], schema: T.StructType) -> Column:
    """array<boolean>: which of the filters (JSON texts of SPEC) a row passes, as compile_filter() has it. One expression
    however many filters there are."""
    every = [json.loads(s) for s in specs]
    keys = sorted({c["key"] for s in every for c in s})
    one = lambda c: reduce(Column.__or__, [(c["key"] == k) & _one_holds(c, k, schema) for k in keys], F.lit(False))
    return F.transform(F.from_json(F.lit(json.dumps(every)), f"array<{SPEC}>"), lambda must: F.forall(must, one))


def spec_column(spec: dict | None) -> Column:
    """A filter as a SPEC column."""
    says = lambda v: str(v).lower() if isinstance(v, bool) else str(v)
    made = [_condition(c.key, None if c.value is None else F.lit(says(c.value)), None if c.any_of is None else F.array(*[F.lit(says(v)) for v in c.any_of]).cast("array<string>"), {op: F.lit(v) for op, v in c.bounds.items()}) for c in conditions(spec)]
    return F.array(*made).cast(SPEC)


TABLES_ONLY = {"must": [{"key": "source_type", "match": {"any": list(fixed.TABLE_ROW_TYPES)}}]}
SPEC = "array<struct<key:string,value:string,any_of:array<string>,gte:double,lte:double,gt:double,lt:double>>"


def _window(q: Column, pattern: str, reach: int = 8) -> Column:
    """The text around a pattern's first match."""
    hit = F.regexp_extract(q, pattern, 0)
    at = F.position(hit, q)
    start = F.greatest(at - reach, F.lit(1))
    return F.substring(q, start, at + F.length(hit) + reach - start)


def _bounds(window: Column, value: Column) -> dict[str, Column]:
    """Comparison words near a number decide its bounds; without any, it is a lower bound."""
    kind = F.lit("gte")
    for name, pattern in reversed(fixed.COMPARISONS):
        kind = F.when(window.rlike(pattern), name).otherwise(kind)
    none = F.lit(None).cast("double")
    return {op: F.when(kind.isin(op, "eq") if op in ("gte", "lte") else kind == op, value).otherwise(none) for op in COMPARE}


def _condition(key: str, value: Column | None = None, any_of: Column | None = None, bounds: dict[str, Column] | None = None) -> Column:
    none = F.lit(None).cast("double")
    parts = {"key": F.lit(key), "value": value if value is not None else F.lit(None).cast("string"), "any_of": any_of if any_of is not None else F.lit(None).cast("array<string>"), **{op: (bounds or {}).get(op, none) for op in COMPARE}}
    return F.struct(*[v.alias(k) for k, v in parts.items()])


def of_type(doc_type: Column) -> Column:
    """The filter for documents of a type."""
    return F.array(_condition("doc_type", value=doc_type)).cast(SPEC)


#: Lengths that names may be cut to, to be looked for in one automaton, and how many such cut names a task may hold.
CUTS, MOST_CUT = (16, 12, 8, 6, 4, 3, 2, 1), 50_000


def names_in(questions: DataFrame, names: DataFrame) -> DataFrame:
    """(query_id, question) and (name, ...) -> (query_id, name), once each: the names that a question holds.

    Names are cut to the greatest length of CUTS that leaves about MOST_CUT distinct beginnings, so that one automaton of
    bounded size, in the tasks that read the questions, finds them however many names there are. A name that was not cut is
    found as it is. Where a cut one begins, the text of each length of the names that begin so meets the names themselves by
    an equi-join. query_id must name a question."""
    known = names.where("name <> ''").select("name").distinct()
    q = questions.where(F.col("question").isNotNull()).select("query_id", "question")
    distinct = known.agg(*[F.approx_count_distinct(F.substring("name", 1, n)) for n in CUTS]).first()
    cut = next((n for n, found in zip(CUTS, distinct, strict=True) if found <= MOST_CUT), CUTS[-1])
    whole = q.sparkSession.sparkContext.broadcast([r[0] for r in known.where(F.length("name") <= cut).collect()])
    begun = known.where(F.length("name") > cut).groupBy(F.substring("name", 1, cut).alias("head")).agg(F.collect_set(F.length("name")).alias("sizes")).collect()
    heads = q.sparkSession.sparkContext.broadcast([(r["head"], sorted(r["sizes"])) for r in begun])

    def held(automaton: ahocorasick.Automaton, body: str) -> set[str]:
        return {name for _, name in automaton.iter(body)}

    def may_hold(automaton: ahocorasick.Automaton, body: str) -> set[str]:
        starts = ((end + 1 - cut, sizes) for end, sizes in automaton.iter(body))
        return {body[at : at + n] for at, sizes in starts for n in sizes if at + n <= len(body)}

    def found(sent: Broadcast, read: Callable[[ahocorasick.Automaton, str], set[str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = ahocorasick.Automaton()
            for x in sent.value:
                automaton.add_word(*((x, x) if isinstance(x, str) else x))
            if not sent.value:
                return
            automaton.make_automaton()
            for batch in batches:
                for first in range(0, batch.num_rows, 64):
                    some = batch.slice(first, 64)
                    got = [(i, name) for i, body in enumerate(some.column(1).to_pylist()) for name in read(automaton, body)]
                    places = pa.array([i for i, _ in got], pa.int64())
                    yield pa.RecordBatch.from_arrays([some.column(0).take(places), pa.array([n for _, n in got], pa.string())], names=["query_id", "name"])

        return q.mapInArrow(run, f"query_id {q.schema['query_id'].dataType.simpleString()}, name string")

    out = found(whole, held)
    return out.unionByName(found(heads, may_hold).join(known, "name").select("query_id", "name")) if begun else out


def parse_questions(questions: DataFrame, entities: DataFrame | None = None, strict_standard: bool = True) -> DataFrame:
    """(query_id, question) with must (SPEC), sparse_query and dense_text.

    entities: (kind, name, id); persons named in a question add their id, and with a role word their role (names_in())."""
    q = text.strip(F.col("question"))
    kv = F.regexp_extract(q, fixed.VOLTAGE, 1).try_cast("int")
    amount = F.regexp_extract(q, fixed.AMOUNT, 1).try_cast("double") * F.when(F.regexp_extract(q, fixed.AMOUNT, 2) == "亿", 10000.0).otherwise(1.0)
    role = F.nullif(F.regexp_extract(q, "(" + "|".join(fixed.ROLES) + ")", 1), F.lit(""))
    found = clauses.all_clauses(q)
    raw = F.array_distinct(F.transform(F.regexp_extract_all(q, F.lit(f"(?i){fixed.STANDARD}"), F.lit(1)), lambda x: F.upper(text.strip(x))))
    standards = F.array_distinct(F.flatten(F.transform(raw, lambda x: F.array(x, text.without_space(x)))))
    certs = F.array_distinct(F.transform(F.regexp_extract_all(q, F.lit(fixed.CERTIFICATE), F.lit(1)), F.upper))
    must = q.rlike(fixed.MANDATORY_QUESTION)
    if entities is None:
        named = questions.select("query_id", F.lit(None).cast("array<struct<name:string,id:string>>").alias("_persons"))
    else:
        persons = entities.where("kind = 'person' and name <> ''").select("name", "id")
        named = names_in(questions, persons).join(persons, "name").groupBy("query_id").agg(F.array_sort(F.collect_set(F.struct("name", "id"))).alias("_persons"))
    rows = questions.join(named, "query_id", "left")
    people = F.coalesce("_persons", F.array().cast("array<struct<name:string,id:string>>"))
    by_person = F.flatten(F.transform(people, lambda p: F.filter(F.array(_condition("entity_person_ids", any_of=F.array(p["id"])), F.when(role.isNotNull(), _condition("rel_person_role", any_of=F.array(F.concat_ws("|", p["id"], role))))), lambda x: x.isNotNull())))
    head = F.filter(F.array(F.when(kv.isNotNull(), _condition("val_voltage_kv", bounds=_bounds(_window(q, fixed.VOLTAGE), kv.cast("double")))), F.when(amount.isNotNull(), _condition("val_contract_amount_w", bounds=_bounds(_window(q, fixed.AMOUNT), amount)))), lambda x: x.isNotNull())
    strict = F.when(F.size(standards) > 0, _condition("standard_no", any_of=standards)) if strict_standard else F.lit(None).cast(SPEC[6:-1])
    tail = F.filter(F.array(F.when(F.size(found) > 0, _condition("clause_no", any_of=found)), F.when(must, _condition("is_mandatory", value=F.lit("true"))), strict), lambda x: x.isNotNull())
    by_cert = F.transform(certs, lambda c: _condition("certificate_no", value=c))
    tokens = F.concat(
        F.array(q), F.filter(F.array(F.concat(kv.cast("string"), F.lit("kV")), amount.cast("string")), lambda x: x.isNotNull()), F.transform(people, lambda p: p["name"]),
        F.when((F.size(people) > 0) & role.isNotNull(), F.array(role)).otherwise(F.array().cast("array<string>")), found, F.when(must, F.array(F.lit("强制性条文"))).otherwise(F.array().cast("array<string>")), raw, certs,
    )
    return rows.select(*questions.columns, F.concat(head, by_person, tail, by_cert).alias("must"), F.array_join(F.array_distinct(tokens), " ").alias("sparse_query"), q.alias("dense_text"))


def spec_of(row_must: list) -> dict | None:
    """A collected SPEC as a filter for apply_filter()."""
    out = []
    for c in row_must or []:
        match = {k: v for k, v in (("value", c["value"]), ("any", list(c["any_of"]) if c["any_of"] is not None else None)) if v is not None}
        bounds = {op: c[op] for op in COMPARE if c[op] is not None}
        out.append({"key": c["key"], **({"match": match} if match else {}), **({"range": bounds} if bounds else {})})
    return {"must": out} if out else None
