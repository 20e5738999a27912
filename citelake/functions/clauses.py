"""Algebra of clause ids: `3.0.6`, its sub-clause `3.0.6(3)`, that one's item `3.0.6(3).1`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import strip

_SUB = r"\([0-9A-Za-z]+\)\z"
_ITEM = r"\A(.+\([0-9A-Za-z]+\))\.\d+\z"


def first_clause(text: Column) -> Column:
    """The first clause id in a text, else null."""
    return F.when(text.rlike(r"\d\.\d"), F.nullif(F.regexp_extract(text, fixed.CLAUSE, 1), F.lit("")))


def all_clauses(text: Column) -> Column:
    """Distinct clause ids in order."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(fixed.CLAUSE), F.lit(1)))


def without_sub(clause: Column) -> Column:
    return F.regexp_replace(strip(clause), _SUB, "")


def _parts(clause: Column) -> Column:
    return F.filter(F.split(clause, r"\.", -1), lambda x: x != "")


def parent(node: Column) -> Column:
    """The node above, "" at the top."""
    v = strip(node)
    item, parts = F.regexp_extract(v, _ITEM, 1), _parts(v)
    above = F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, 1, F.size(parts) - 1), ".")).otherwise("")
    return F.when(item != "", item).when(v.rlike(_SUB), F.regexp_replace(v, _SUB, "")).otherwise(above)


def _plain_level(v: Column) -> Column:
    return F.size(_parts(F.regexp_replace(v, _SUB, ""))) + F.when(v.rlike(_SUB), 1).otherwise(0)


def level(node: Column) -> Column:
    v = strip(node)
    item = F.regexp_extract(v, _ITEM, 1)
    return F.when(v == "", 0).when(item != "", _plain_level(item) + 1).otherwise(_plain_level(v))


def article_path(clause: Column) -> Column:
    """`4.12.1(3)` -> [4, 4.12, 4.12.1]."""
    parts = _parts(without_sub(clause))
    return F.transform(parts, lambda _, i: F.array_join(F.slice(parts, 1, i + 1), "."))


def root(clause: Column) -> Column:
    """The first two parts."""
    return F.array_join(F.slice(_parts(without_sub(clause)), 1, 2), ".")


def in_family(clause: Column, root_: Column) -> Column:
    """Whether a clause is the root itself or stands below it."""
    return (clause == root_) | F.startswith(clause, F.concat(root_, F.lit("."))) | F.startswith(clause, F.concat(root_, F.lit("(")))
