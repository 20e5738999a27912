"""Query-side terms. Questions are few; each function takes one string, and the `*_col` forms are Arrow UDFs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed

_HAN = "\u4e00-\u9fff"
_ASIDE = re.compile(r"(回复|回答|查询到|没查询到|没有查询到|为什么|还是|但是|却)")
_ASKING = re.compile(r"(有哪些规定|有哪(?:些)?规定|有哪些|有哪|哪些|规定|要求|什么|如何|怎么|请问)")
_ASKING_TERM = re.compile(r"(哪些|有哪|规定|要求|什么|如何|怎么|请问)")
_CLAUSE = re.compile(fixed.CLAUSE)
_STANDARD = re.compile(fixed.STANDARD, re.IGNORECASE)
_SHORT = re.compile("[有哪些]")


def distinct(items) -> list[str]:
    return [x for x in dict.fromkeys(items) if x]


def usable(term: str, stop_chars: str = fixed.STOP_CHARS) -> bool:
    """Whether a Chinese term says more than the question's frame."""
    return len(term) >= 2 and term not in fixed.STOP_TERMS and not _ASKING_TERM.search(term) and not (len(term) <= 3 and _SHORT.search(term)) and not set(term) <= set(stop_chars)


def query_terms(question: str | None, mode: str = "compact", stop_chars: str = fixed.STOP_CHARS) -> list[str]:
    """Search terms of a question in order: dotted numbers, Latin words, Chinese segments and their 2- to 4-grams.

    mode `compact` closes up all white space first, as Chinese wants; mode `words` keeps words apart, as Latin text wants."""
    q = _ASKING.sub(" ", _ASIDE.sub(" ", _CLAUSE.sub(" ", (question or "").lower())))
    q = re.sub(r"\s+", "" if mode == "compact" else " ", q)
    found = re.findall(r"\d+(?:\.\d+)+", q) + re.findall(r"[a-z0-9]{2,}" if mode == "compact" else r"[^\W_]{2,}", q)
    if mode == "words":
        found = [x for x in found if not re.fullmatch(f"[{_HAN}]+", x)]
    for run in re.findall(f"[{_HAN}]{{2,36}}", q):
        for part in [p for p in re.split(f"[{stop_chars}]", run) if len(p) >= 2] or [run]:
            whole = [part] if len(part) <= 8 else []
            grams = [part[i : i + n] for n in (2, 3, 4) for i in range(len(part) - n + 1)]
            found += [t for t in whole + grams if usable(t, stop_chars)]
    return distinct(found)


def page_tokens(query: str | None) -> list[str]:
    """Tokens of a query to page files: Latin words and numbers; Chinese runs by eight characters, each as its two-character
    pieces and whole."""
    closed = re.sub(f"(?<=[{_HAN}A-Za-z0-9])\\s+(?=[{_HAN}A-Za-z0-9])", "", query or "").lower()
    found: list[str] = []
    for token in re.findall(f"[0-9a-z]+|[{_HAN}]{{1,8}}", closed):
        if len(token) > 2 and re.match(f"[{_HAN}]", token):
            found += [token[i : i + 2] for i in range(len(token) - 1)]
        found.append(token)
    return distinct(found)


def standard_tokens(question: str | None) -> list[str]:
    """Standard numbers, upper case, each also without white space."""
    raw = [m.group(1).strip().upper() for m in _STANDARD.finditer(question or "")]
    return distinct(y for x in raw for y in (x, re.sub(r"\s+", "", x)))


def clause_tokens(question: str | None) -> list[str]:
    return distinct(m.group(1) for m in _CLAUSE.finditer((question or "").strip()))


def _column(fn, *args):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: fn(x, *args))

    return run


def query_terms_col(question: Column, mode: str = "compact") -> Column:
    return _column(query_terms, mode)(question)


def page_tokens_col(question: Column) -> Column:
    return _column(page_tokens)(question)


def standard_tokens_col(question: Column) -> Column:
    return _column(standard_tokens)(question)
