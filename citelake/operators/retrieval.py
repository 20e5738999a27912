"""Routes, fusion, gates and boosts over (query_id, ...) hits.

Questions are few and stated; each route takes them all against all rows. A route scores in the tasks that read the rows:
a task keeps its k best of every question, so that only those leave it. Questions go out in blocks of a bounded size
(BLOCK_BYTES, MAX_QUERIES), each against one reading of the rows, so that no plan multiplies two large tables and nothing
that is collected or sent grows with their number."""

from __future__ import annotations

import heapq
import json
import math
import re
from collections.abc import Callable, Iterable, Iterator
from functools import reduce, wraps

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citelake.functions import clauses, fixed, text
from citelake.functions.embedding import Hasher
from citelake.functions.runs import Held, is_run, runs

MAX_QUERIES = 1024
#: Bytes of question vectors that are sent out at a time.
BLOCK_BYTES = 64 << 20
#: Files from which on what tasks have found is merged in two steps, and groups of the first.
MANY_FILES, FIRST_STEP = 1000, 256


def query_blocks(queries: DataFrame, size: int = MAX_QUERIES) -> list[DataFrame]:
    """The questions in parts of about `size` rows at most, each fit for a broadcast."""
    parts = max(1, -(-queries.count() // size))
    return [queries if parts == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i) for i in range(parts)]


def top_k(hits: DataFrame, k: int, *order: Column, group: str = "query_id") -> DataFrame:
    """The first k rows of each query by an order, with rank."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def keyword_score(body: Column, terms: Column) -> Column:
    """Sum over terms of (1 + min(length, 12) / 12) * ln(1 + occurrences)."""
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + (1 + F.least(F.length(t), F.lit(12)) / 12.0) * F.log1p(text.occurrences(body, t)))


@F.pandas_udf(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("long_terms", T.IntegerType())]))
def keyword_measure(body: pd.Series, terms: pd.Series) -> pd.DataFrame:
    """keyword_score() of each body and how many of its terms of three letters or more it holds; a text is scanned once a
    term, whatever its length, where an expression would make it anew for each."""

    def one(said: str | None, wanted) -> tuple[float, int]:
        found = [(t, said.count(t)) for t in wanted if t] if said and wanted is not None else []
        return sum((1 + min(len(t), 12) / 12.0) * math.log1p(n) for t, n in found), sum(n > 0 and len(t) >= 3 for t, n in found)

    return pd.DataFrame([one(b, w) for b, w in zip(body, terms, strict=True)], columns=["score", "long_terms"])


@F.pandas_udf(T.IntegerType())
def held_tokens(body: pd.Series, tokens: pd.Series) -> pd.Series:
    """How many of the tokens each body holds."""
    return pd.Series([sum(t in b for t in w) if b and w is not None else 0 for b, w in zip(body, tokens, strict=True)], dtype="int32")


def search_text(*columns: str) -> Column:
    """What keyword routes read: some fields in lower case."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in columns]))


class Terms:
    """One automaton over distinct terms: counts() gives each term's non-overlapping occurrences in a text."""

    def __init__(self, terms: Iterable[str]):
        self.names = sorted({t for t in terms if t})
        self.places = {t: i for i, t in enumerate(self.names)}
        self.automaton = ahocorasick.Automaton()
        for t, i in self.places.items():
            self.automaton.add_word(t, (i, len(t)))
        if self.names:
            self.automaton.make_automaton()

    def counts(self, body: str | None) -> dict[int, int]:
        free: dict[int, int] = {}
        found: dict[int, int] = {}
        for end, (i, size) in self.automaton.iter(body) if self.names and body else ():
            if end - size >= free.get(i, -1):
                free[i] = end
                found[i] = found.get(i, 0) + 1
        return found


class Weights:
    """Questions' weights of their terms, kept by term: scores() adds them up for texts, without a matrix of terms."""

    def __init__(self, terms: Terms, wanted: list[list[tuple[str, float]]]):
        found = [(terms.places[t], j, w) for j, question in enumerate(wanted) for t, w in question if t]
        found.sort(key=lambda x: x[0])
        self.questions, self.weight = np.array([x[1] for x in found], np.int64), np.array([x[2] for x in found], np.float64)
        self.start = np.searchsorted([x[0] for x in found], np.arange(len(terms.names) + 1))
        self.width = len(wanted)

    def scores(self, counts: list[dict[int, int]], worth: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """A row a text (its terms' counts) and a column a question: weights times what a count is worth, summed."""
        sizes = [len(x) for x in counts]
        flat = lambda parts: np.fromiter((x for p in parts for x in p), np.int64, sum(sizes))
        return self.sums(len(counts), np.repeat(np.arange(len(counts)), sizes), flat(counts), flat(x.values() for x in counts), worth)

    def sums(self, rows: int, row: np.ndarray, term: np.ndarray, count: np.ndarray, worth: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """scores() of entries (row, term, count)."""
        size = self.start[term + 1] - self.start[term]
        value = np.repeat(worth(count.astype(np.float64)), size)
        some = np.repeat(self.start[term] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        return np.bincount(np.repeat(row, size) * self.width + self.questions[some], weights=self.weight[some] * value, minlength=rows * self.width).reshape(rows, self.width)


class WordTerms:
    """Terms.counts() of many texts at once. A term of word characters alone never reaches beyond one word of a text, so its
    counts are sums over the text's words, which are looked through once; other terms are counted in the whole text."""

    MOST_CELLS = 1 << 21

    def __init__(self, terms: Terms, most: int = 400_000):
        self.inside, self.across, self.terms = Terms(t for t in terms.names if is_run(t)), Terms(t for t in terms.names if not is_run(t)), terms
        self.places, self.held = [terms.places[t] for t in self.inside.names], Held(self.find, most)

    def find(self, word: str) -> list[int]:
        """The terms of a word, each as often as it stands there."""
        met = [i for _, (i, _) in self.inside.automaton.iter(word)] if self.places else []
        if len(set(met)) < len(met):  # some stand there again, perhaps over themselves
            met = [i for i, n in self.inside.counts(word).items() for _ in range(n)]
        return [self.places[i] for i in met]

    def entries(self, bodies: list[str | None], held: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the text, term, count). held: (place of the text, term) of all its words, where they are at hand."""
        row, term = self.held.of([runs(b) for b in bodies]) if held is None else held
        width = max(1, len(self.terms.names))
        step, parts = max(1, self.MOST_CELLS // width), []
        for first in range(0, len(bodies), step):
            start, stop = np.searchsorted(row, [first, first + step])
            n = np.bincount((row[start:stop] - first) * width + term[start:stop])
            at = np.flatnonzero(n)
            parts.append((at // width + first, at % width, n[at]))
        if self.across.names:
            found = [(i, self.terms.places[self.across.names[t]], n) for i, b in enumerate(bodies) for t, n in self.across.counts(b).items()]
            parts.append(tuple(np.array(found, np.int64).reshape(-1, 3).T))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64),) * 3


def in_blocks(route: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A route (rows, queries, ...) for any number of questions: each block of MAX_QUERIES against one reading of the rows, so
    that what is collected and sent out does not grow with their number."""

    @wraps(route)
    def run(rows: DataFrame, queries: DataFrame, *args, **options) -> DataFrame:
        return reduce(DataFrame.unionByName, [route(rows, some, *args, **options) for some in query_blocks(queries)])

    return run


def _passed(queries: DataFrame) -> tuple[list[str], list[str], Column]:
    """For queries with a column spec (the place of their filter in the rows' array _pass, or null): what to carry of the
    queries and of the rows, and the test that a row passes the query's filter."""
    if "spec" not in queries.columns:
        return [], [], F.lit(True)
    return ["spec"], ["_pass"], F.col("spec").isNull() | F.get("_pass", F.col("spec"))


class Keywords:
    """keyword_score() of texts for questions' terms."""

    def __init__(self, asked: list[list[str]]):
        wanted = [[(t, 1 + min(len(t), 12) / 12.0) for t in q] for q in asked]
        terms = Terms(t for q in wanted for t, _ in q)
        self.weights, self.words = Weights(terms, wanted), WordTerms(terms)

    def scores(self, bodies: list[str], held: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        return positive(self.weights.sums(len(bodies), *self.words.entries(bodies, held), np.log1p))


@in_blocks
def keyword_best(rows: DataFrame, queries: DataFrame, k: int, body: Column, ordinal: str = "ordinal") -> DataFrame:
    """(query_id, ordinal, score, rank) of keyword_search()."""
    asked = queries.select("query_id", *_passed(queries)[0], "terms").collect()
    sent = rows.sparkSession.sparkContext.broadcast([list(r["terms"] or []) for r in asked])

    def scorer() -> Scorer:
        keywords = Keywords(sent.value)
        return lambda bodies: keywords.scores(bodies.to_pylist())

    return best_in_tasks(rows, queries, asked, k, F.coalesce(body, F.lit("")), [ordinal], scorer)


def keyword_search(rows: DataFrame, queries: DataFrame, k: int, body: Column, ordinal: str = "ordinal") -> DataFrame:
    """queries (query_id, terms) -> hits by keyword_score(); ties by ordinal, which names a row."""
    best = keyword_best(rows, queries, k, body, ordinal)
    return rows.drop("query_id", "score", "rank").join(best, ordinal).withColumn("route", F.lit("keyword"))


def filter_keyword_search(rows: DataFrame, queries: DataFrame, k: int, body: Column, ordinal: str = "ordinal") -> DataFrame:
    """Keyword hits inside one document's scope, weighted up; rows are filtered by the caller."""
    hits = keyword_search(rows, queries, k, body, ordinal)
    return hits.withColumns({"score": F.col("score") * 5.0, "route": F.lit("filter_keyword")})


@in_blocks
def like_best(pages: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, page_no, score, rank) of like_search()."""
    spec = _passed(queries)[0]
    terms = F.filter(F.transform("terms", F.lower), lambda t: t != "")
    asked = queries.where(F.size("terms") > 0).select("query_id", *spec, F.lower(text.without_space(F.col("query"))).alias("phrase"), terms.alias("terms")).collect()
    sent = pages.sparkSession.sparkContext.broadcast([(r["phrase"] or "", list(r["terms"])) for r in asked])

    def scorer() -> Scorer:
        wanted = [[(phrase, 6.0)] * (1 <= len(phrase) <= 40) + [(t, round(1 + min(len(t), 8) / 8.0, 3)) for t in q] for phrase, q in sent.value]
        terms = Terms(t for q in wanted for t, _ in q)
        weights = Weights(terms, wanted)
        return lambda bodies: positive(weights.scores([terms.counts(t) for t in bodies.to_pylist()], np.ones_like))

    return best_in_tasks(pages, queries, asked, k, F.lower(text.without_space(F.coalesce("text", F.lit("")))), ["page_no", "doc_id"], scorer)


def like_search(pages: DataFrame, queries: DataFrame, k: int, excerpt_chars: int = 800) -> DataFrame:
    """Containment scores over white-space-free text without regard to case: 6 for the whole query (up to 40
    characters), 1 + min(length, 8) / 8 for each term. queries: (query_id, query, terms); pages: (doc_id, page_no, text)."""
    best = like_best(pages, queries, k)
    shown = pages.select("doc_id", "page_no", F.substring("text", 1, excerpt_chars).alias("excerpt"))
    return best.join(shown, ["doc_id", "page_no"]).select("query_id", "doc_id", "page_no", "excerpt", "score", "rank").withColumn("route", F.lit("sparse"))


def inverted_index(pages: DataFrame, keys: tuple[str, ...] = ("doc_id", "page_no")) -> DataFrame:
    """(term, keys..., positions): where each word stands on each page."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0))
    each = pages.select(*keys, F.posexplode(words).alias("pos", "term"))
    return each.groupBy("term", *keys).agg(F.array_sort(F.collect_list("pos")).alias("positions"))


#: Signs that full-text queries lose before they are read; they part words.
_OPERATORS = re.compile(r"[/\-&|!():*<>]+")
_WORD = re.compile(r"\w+")
_PIECE = re.compile(r'"([^"]*)"?|([^\s"]+)')


def websearch(query: str | None) -> list[list[tuple[str, ...]]]:
    """A full-text question as alternatives, each a list of phrases that must all occur (a word is a phrase of one): text in
    quotation marks is a phrase, `or` between two operands parts alternatives, all else must occur."""
    pieces = [(_WORD.findall(quoted), False) if not bare else (_WORD.findall(bare), bare == "or") for quoted, bare in _PIECE.findall(_OPERATORS.sub(" ", (query or "").lower()))]
    pieces = [p for p in pieces if p[0]]
    out: list[list[tuple[str, ...]]] = [[]]
    quoted = [bool(q) for q, bare in _PIECE.findall(_OPERATORS.sub(" ", (query or "").lower())) if _WORD.findall(q or bare)]
    for i, (words, is_or) in enumerate(pieces):
        if is_or and out[-1] and i + 1 < len(pieces):
            out.append([])
        else:
            out[-1] += [tuple(words)] if quoted[i] else [(w,) for w in words]
    return [list(dict.fromkeys(x)) for x in out if x]


def cover_density(alternatives: list[list[tuple[str, ...]]], places: dict[str, np.ndarray]) -> float:
    """0.1 / (1 + other words inside) for each smallest stretch that satisfies the question, summed; places: the sorted
    positions of the question's words. 0 where nothing satisfies it."""
    units = list(dict.fromkeys(u for x in alternatives for u in x))
    found: list[tuple[int, int, int]] = []  # end, start, unit
    none = np.empty(0, np.int64)
    for i, unit in enumerate(units):
        start = places.get(unit[0], none)
        for k, word in enumerate(unit[1:], 1):
            start = start[np.isin(start + k, places.get(word, none))]
        found += [(int(p) + len(unit) - 1, int(p), i) for p in start]
    found.sort()
    place = {u: i for i, u in enumerate(units)}
    wanted: list[list[int]] = [[] for _ in units]  # the alternatives that a unit is of, and how many units each still lacks
    for n, x in enumerate(alternatives):
        for u in x:
            wanted[place[u]].append(n)
    lacks = [len(x) for x in alternatives]
    every = np.unique(np.concatenate([places.get(w, none) for u in units for w in u])) if units else none
    inside, held, score = [0] * len(units), [], 0.0
    for end, start, unit in found:
        inside[unit] += 1
        if inside[unit] == 1:
            for n in wanted[unit]:
                lacks[n] -= 1
        heapq.heappush(held, (start, unit))
        left = None
        while held and 0 in lacks:
            left, first = heapq.heappop(held)
            inside[first] -= 1
            if not inside[first]:
                for n in wanted[first]:
                    lacks[n] += 1
        if left is not None:
            words = int(np.searchsorted(every, end, side="right") - np.searchsorted(every, left))
            score += 0.1 / (1 + max(0, end - left - (words - 1)))
    return score


def fts_scorer(asked: list[list[list[tuple[str, ...]]]]) -> Callable[[list[list[str]]], np.ndarray]:
    """cover_density() of texts, given as their words, for questions as websearch() reads them."""
    by_word: dict[str, list[tuple[int, set]]] = {}
    for j, question in enumerate(asked):
        for alternative in question:
            words = {w for unit in alternative for w in unit}
            by_word.setdefault(max(words, key=lambda w: (len(w), w)), []).append((j, words))
    every = {w for x in by_word.values() for _, words in x for w in words}

    def score(texts: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(texts), len(asked)))
        for row, words in enumerate(texts):
            held = every.intersection(words)
            met = {j for w in by_word.keys() & held for j, wanted in by_word[w] if held >= wanted}
            if met:
                places: dict[str, list[int]] = {w: [] for j in met for x in asked[j] for u in x for w in u}
                for pos, w in enumerate(words):
                    if w in places:
                        places[w].append(pos)
                arrays = {w: np.array(p, np.int64) for w, p in places.items()}
                for j in met:
                    out[row, j] = cover_density(asked[j], arrays)
        return positive(out)

    return score


@in_blocks
def fts_best(pages: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Full-text search of queries (query_id, query: see websearch()) in pages (doc_id, page_no, text) by cover_density(),
    without an index of every word: one reading of the pages."""
    spec = _passed(queries)[0]
    asked = [r for r in queries.select("query_id", *spec, "query").collect() if websearch(r["query"])]
    sent = pages.sparkSession.sparkContext.broadcast([websearch(r["query"]) for r in asked])

    def scorer() -> Scorer:
        score = fts_scorer(sent.value)
        return lambda bodies: score([_WORD.findall(t) for t in bodies.to_pylist()])

    return best_in_tasks(pages, queries, asked, k, F.lower(F.coalesce("text", F.lit(""))), ["doc_id", "page_no"], scorer).withColumn("route", F.lit("sparse"))


@in_blocks
def fts_search(index: DataFrame, queries: DataFrame, k: int, keys: tuple[str, ...] = ("doc_id", "page_no")) -> DataFrame:
    """Pages that hold all of a query's words by an inverted index, scored by cover_density(). queries: (query_id, terms).

    The index keeps to the words that are asked (a semi-join that Spark carries below the index's own grouping), and a page's
    postings meet once; a query meets only pages that hold its longest word, and is never dealt out over all words it shares."""
    wanted = queries.select("query_id", F.array_distinct("terms").alias("_all")).withColumn("_lead", F.element_at(F.array_sort("_all", lambda a, b: F.coalesce(F.length(b), F.lit(-1)) - F.coalesce(F.length(a), F.lit(-1))), 1)).where("size(_all) > 0 and _lead is not null")
    leads = [r[0] for r in wanted.select("_lead").distinct().collect()]  # one a query of a block at most
    said = F.broadcast(wanted.select(F.explode("_all").alias("term")).distinct())
    pages = index.join(said, "term", "left_semi").groupBy(*keys).agg(F.collect_list(F.struct("term", "positions")).alias("_held"))
    here = F.array_intersect(F.transform("_held", lambda w: w["term"]), F.lit(leads) if leads else F.array().cast("array<string>"))
    met = pages.withColumn("_lead", F.explode(here)).join(F.broadcast(wanted), "_lead")
    met = met.where(F.size(F.array_except("_all", F.transform("_held", lambda w: w["term"]))) == 0)
    page = met.select("query_id", *keys, F.filter("_held", lambda w: F.array_contains("_all", w["term"])).alias("_p"))

    @F.pandas_udf("double")
    def cover(found: pd.Series) -> pd.Series:
        def one(words) -> float:
            return cover_density([[(w["term"],) for w in words]], {w["term"]: np.asarray(w["positions"], np.int64) for w in words})

        return found.map(one).astype("float64")

    return top_k(page.select("query_id", *keys, cover("_p").alias("score")), k, F.desc(F.round("score", 9)), *[F.col(c) for c in keys]).withColumn("route", F.lit("sparse"))


@in_blocks
def sidecar_search(pages: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Phrase and token counts: 20 for the phrase, 28 for it without spaces, each token (plain and without spaces) by
    occurrences times 1 + min(length, 10) / 10. queries: (query_id, query, tokens); pages: (doc_id, page_no, text)."""
    forms = {"squeezed": text.squeeze, "bare": text.without_space}
    asked = queries.select("query_id", *[F.lower(f(F.col("query"))).alias(n) for n, f in forms.items()], F.transform("tokens", F.lower).alias("tokens")).collect()
    sent = pages.sparkSession.sparkContext.broadcast([(r["squeezed"] or "", r["bare"] or "", list(r["tokens"] or [])) for r in asked])
    both = F.concat_ws("\0", *[F.lower(f(F.coalesce("text", F.lit("")))) for f in forms.values()])

    def scorer() -> Scorer:
        tokens = [[(t, 1 + min(len(t), 10) / 10.0) for t in q] for *_, q in sent.value]
        phrases = [[[(x[side], worth)] for x in sent.value] for side, worth in ((0, 20.0), (1, 28.0))]
        terms = Terms(t for group in (tokens, *phrases) for q in group for t, _ in q)
        each, whole = Weights(terms, tokens), [Weights(terms, p) for p in phrases]

        def score(bodies: pa.Array) -> np.ndarray:
            halves = zip(*(b.split("\0", 1) for b in bodies.to_pylist()), strict=True)
            counts = [[terms.counts(t) for t in h] for h in halves]
            return positive(sum(each.scores(c, lambda n: n) + w.scores(c, np.ones_like) for c, w in zip(counts, whole, strict=True)))

        return score

    return best_in_tasks(pages, queries, asked, k, both, ["doc_id", "page_no"], scorer).withColumn("route", F.lit("sirchmunk"))


def structured_search(assets: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Assets whose data hold the query's identifiers: 10 a token. assets: (doc_id, page_no, data_json string, ...). Rows are
    named by a hash of all their columns; rows that are equal in all of them are hits side by side."""
    held = assets.where("doc_id is not null and page_no > 0").withColumn("_row", F.xxhash64(*[F.col(f"`{c}`") for c in assets.columns]))
    keys = ["doc_id", "page_no", "_row"]

    @in_blocks
    def best(rows: DataFrame, some: DataFrame) -> DataFrame:
        asked = some.where(F.size("tokens") > 0).select("query_id", F.transform("tokens", F.upper).alias("tokens")).collect()
        sent = rows.sparkSession.sparkContext.broadcast([list(r["tokens"]) for r in asked])

        def scorer() -> Scorer:
            terms = Terms(t for q in sent.value for t in q)
            weights = Weights(terms, [[(t, 10.0) for t in q] for q in sent.value])
            return lambda bodies: positive(weights.scores([terms.counts(t) for t in bodies.to_pylist()], np.ones_like))

        return best_in_tasks(rows, some.select("query_id"), asked, k, F.upper(F.coalesce("data_json", F.lit(""))), keys, scorer)

    found = best(held, queries.select("query_id", "tokens")).select("query_id", *keys, "score").distinct()
    hits = held.drop("query_id", "score", "rank").join(found, keys).drop("_row")
    return top_k(hits, k, F.desc(F.round("score", 9)), F.col("doc_id"), F.col("page_no")).withColumn("route", F.lit("structured"))


Scorer = Callable[[pa.Array], np.ndarray]


def positive(score: np.ndarray) -> np.ndarray:
    """Scores above 0; all else is no hit."""
    return np.where(score > 0, score, -np.inf)


def best_in_tasks(rows: DataFrame, queries: DataFrame, asked: list, k: int, body: Column, keys: list[str], scorer: Callable[[], Scorer]) -> DataFrame:
    """(query_id, keys, score, rank): the first k rows of each query (asked: collected queries with query_id and perhaps
    spec) by score, then keys, which name a row. A scorer turns an Arrow array of bodies to scores, a column a query in
    order, -inf where a row is no hit; each task keeps its k best of every query, so that no pair of a question and a row
    leaves it that can't be among them."""
    spec, has, _ = _passed(queries)
    places = [r["spec"] if spec else None for r in asked]
    fields = [rows.schema[c] for c in keys]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def order(entry: tuple) -> tuple:
        return (-entry[0], *((x is not None, x) for x in entry[1:]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not places:
            return
        score_of, kept, floor, kind = scorer(), [[] for _ in places], np.full(len(places), -np.inf), None
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                b = whole.slice(start, 512)
                kind = b.schema
                scores = np.round(score_of(b.column(len(keys) + len(has))), 9)
                if has:
                    passed = np.array(b.column(len(keys)).to_pylist(), bool).reshape(b.num_rows, -1)
                    for j, place in enumerate(places):
                        if place is not None:
                            scores[~passed[:, place], j] = -np.inf
                if b.num_rows > k:  # what k rows of these very ones surpass is not among the best
                    floor = np.maximum(floor, np.partition(scores, b.num_rows - k, axis=0)[b.num_rows - k])
                may = np.isfinite(scores) & (scores >= floor)
                names = list(zip(*(b.column(i).to_pylist() for i in range(len(keys))), strict=True)) if may.any() else []
                for j in np.flatnonzero(may.any(axis=0)).tolist():
                    kept[j] = sorted(kept[j] + [(float(scores[i, j]), *names[i]) for i in np.flatnonzero(may[:, j]).tolist()], key=order)[:k]
                    if len(kept[j]) == k:
                        floor[j] = kept[j][-1][0]
        got = [(j, *x) for j, some in enumerate(kept) for x in some]
        for start in range(0, len(got), 10_000):
            columns = list(zip(*got[start : start + 10_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, kind.field(i).type) for i, c in enumerate(columns[2:])), pa.array(columns[1], pa.float64())], names=["_q", *keys, "score"])

    found = rows.select(*keys, *has, body.alias("_body")).mapInArrow(run, f"_q int, {kinds}, score double")
    named = rows.sparkSession.createDataFrame([(i, r["query_id"]) for i, r in enumerate(asked)], f"_q int, query_id {queries.schema['query_id'].dataType.simpleString()}")
    best = [F.desc(F.round("score", 9)), *[F.col(c) for c in keys]]
    if len(rows.inputFiles()) > MANY_FILES:  # many tasks' finds of one question meet in groups first
        found = found.withColumn("_g", F.struct("_q", F.pmod(F.xxhash64(*keys), F.lit(FIRST_STEP)).alias("g")))
        found = top_k(found, k, *best, group="_g").drop("_g", "rank")
    return top_k(found.join(F.broadcast(named), "_q").drop("_q"), k, *best)


def dense_best(rows: DataFrame, queries: DataFrame, k: int, vector: str = "vector", ordinal: str = "ordinal") -> DataFrame:
    """(query_id, ordinal, score, rank): exact cosine top-k by matrix products, for questions in blocks of BLOCK_BYTES of
    vectors, each against one reading of the rows. queries: (query_id, query_vector)."""
    spec = _passed(queries)[0]
    size = queries.agg(F.sum(F.size("query_vector").cast("long") * 8)).first()[0] or 0
    parts = max(1, -(-size // BLOCK_BYTES))

    def unit(vectors: list) -> tuple[np.ndarray, np.ndarray]:
        """Rows of length 1, and which rows are vectors."""
        m = np.array(vectors, np.float64)
        length = np.sqrt(np.einsum("ij,ij->i", m, m))
        return np.divide(m, length[:, None], out=np.zeros_like(m), where=length[:, None] > 0), length > 0

    found = []
    for part in range(parts):
        some = queries if parts == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)
        asked = some.select("query_id", *spec, "query_vector").collect()
        sent = rows.sparkSession.sparkContext.broadcast([r["query_vector"] for r in asked])

        def scorer(sent=sent) -> Scorer:
            by_size: dict[int, list[int]] = {}
            for j, v in enumerate(sent.value):
                if v and None not in v:
                    by_size.setdefault(len(v), []).append(j)
            wanted = {n: (js, *unit([sent.value[j] for j in js])) for n, js in by_size.items()}

            def score(vectors: pa.Array) -> np.ndarray:
                out = np.full((len(vectors), len(sent.value)), -np.inf)
                sizes = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
                for n, (js, matrix, real) in wanted.items():
                    at = [i for i in np.flatnonzero(sizes == n).tolist() if vectors[i].values.null_count == 0]
                    if at:
                        mine, there = unit(vectors.take(pa.array(at)).flatten().to_numpy().reshape(len(at), n))
                        out[np.ix_(at, js)] = np.where(there[:, None] & real[None, :], mine @ matrix.T, -np.inf)
                return out

            return score

        found.append(best_in_tasks(rows, queries, asked, k, F.col(vector), [ordinal], scorer))
    return reduce(DataFrame.unionByName, found)


def dense_search(rows: DataFrame, queries: DataFrame, k: int, vector: str = "vector", ordinal: str = "ordinal") -> DataFrame:
    """Rows of dense_best()."""
    best = dense_best(rows, queries, k, vector, ordinal)
    return rows.drop("query_id", "score", "rank").join(best, ordinal).withColumn("route", F.lit("dense"))


def first_rows(rows: DataFrame, queries: DataFrame, k: int, ordinal: str = "ordinal") -> DataFrame:
    """What a store without vectors answers to dense search: the first k rows in order that pass a query's filter."""

    @in_blocks
    def best(rows: DataFrame, some: DataFrame) -> DataFrame:
        asked = some.select("query_id", *_passed(some)[0]).collect()
        return best_in_tasks(rows, some, asked, k, F.lit(0), [ordinal], lambda n=len(asked): lambda bodies: np.zeros((len(bodies), n)))

    found = best(rows, queries.select("query_id", *_passed(queries)[0]))
    return rows.drop("query_id", "score", "rank").join(found, ordinal).withColumn("route", F.lit("dense"))


@in_blocks
def hash_search(rows: DataFrame, queries: DataFrame, k: int, body: Column, ordinal: str = "ordinal", dim: int = 1024) -> DataFrame:
    """dense_search() over hash vectors of rows' bodies and queries (query_id, query), as (query_id, ordinal, score, rank)."""
    asked = queries.select("query_id", *_passed(queries)[0], F.lower(F.coalesce("query", F.lit(""))).alias("query")).collect()
    sent = rows.sparkSession.sparkContext.broadcast([r["query"] for r in asked])

    def scorer() -> Scorer:
        hasher = Hasher(dim)
        wanted = hasher.vectors(sent.value).T
        return lambda bodies: hasher.vectors(bodies.to_pylist()) @ wanted

    return best_in_tasks(rows, queries, asked, k, F.lower(F.coalesce(body, F.lit(""))), [ordinal], scorer)


def text_routes_best(rows: DataFrame, routes: dict[str, DataFrame], depth: dict[str, int], said: Column, rest: Column, ordinal: str = "ordinal", dim: int = 1024) -> DataFrame:
    """(route, query_id, ordinal, score, rank) by one reading of the rows, whose words are made once for all routes: keyword
    (query_id, terms) by keyword_score() of the text and the rest, sparse (query_id, query) as by fts_best() and, where it is
    asked, dense (query_id, query) as by hash_search() of the text, each to its depth. said, rest: text and rest in lower case;
    the questions are those of one block, and may bear a column spec."""
    asked, sent, frames = [], {}, []
    for route, queries in routes.items():
        spec = _passed(queries)[0]
        body = {"keyword": F.col("terms"), "dense": F.lower(F.coalesce("query", F.lit(""))), "sparse": F.col("query")}[route]
        frames.append(queries.select(F.struct(F.lit(route).alias("route"), "query_id").alias("query_id"), *spec, body.alias("_asked")))
        found = frames[-1].collect()
        if route == "sparse":
            found = [r for r in found if websearch(r["_asked"])]
        sent[route] = [list(r["_asked"] or []) if route == "keyword" else websearch(r["_asked"]) if route == "sparse" else r["_asked"] for r in found]
        asked += found
    sent = rows.sparkSession.sparkContext.broadcast(sent)

    def scorer() -> Scorer:
        keywords, hasher, wanted = Keywords(sent.value["keyword"]), Hasher(dim), sent.value
        terms = len(keywords.words.terms.names)
        asked_of, dense = fts_scorer(wanted["sparse"]), hasher.vectors(wanted["dense"]).T if "dense" in wanted else None
        both = lambda word: keywords.words.find(word) + [terms + c for c in hasher.codes(word)]
        held = Held(keywords.words.find if dense is None else both)

        def score(bodies: pa.Array) -> np.ndarray:
            texts, more = (pc.struct_field(bodies, i).to_pylist() for i in (0, 1))
            words = [runs(t) for t in texts]
            place, found = held.of([w for pair in zip(words, map(runs, more), strict=True) for w in pair])  # a text, its rest
            term, own = found < terms, place % 2 == 0
            got = {"keyword": keywords.scores([f"{t} {m}" for t, m in zip(texts, more, strict=True)], (place[term] // 2, found[term])), "sparse": asked_of(words)}
            if dense is not None:
                code = own & ~term
                got["dense"] = hasher.vectors(texts, (place[code] // 2, found[code] - terms)) @ dense
            return np.concatenate([got[route] for route in wanted], axis=1)

        return score

    best = best_in_tasks(rows, frames[0], asked, max(depth[r] for r in routes), F.struct(said.alias("said"), rest.alias("rest")), [ordinal], scorer)
    most = reduce(lambda c, r: c.when(F.col("query_id.route") == r, depth[r]), routes, F.when(F.lit(False), 0))
    return best.where(F.col("rank") <= most).select("query_id.route", F.col("query_id.query_id").alias("query_id"), ordinal, "score", "rank")


def fuse_rrf(routes: list[DataFrame], k: int, constant: int = 60, key: str = "id") -> DataFrame:
    """Reciprocal rank fusion: each hit's sum of 1 / (constant + rank); the row (and its own score) of the first route
    that has it; order by the sum, then by first appearance."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [r.withColumn("_route", F.lit(i)) for i, r in enumerate(routes)])
    return fuse(every, k, constant, key)


def fuse(every: DataFrame, k: int, constant: int = 60, key: str = "id") -> DataFrame:
    """fuse_rrf() of hits that bear their route's place (_route)."""
    every = every.where(F.col(key).isNotNull())
    rest = [c for c in every.columns if c not in ("query_id", key, "_route", "rank")]
    seen = F.struct("_route", "rank")
    both = every.groupBy("query_id", key).agg(F.sum(1.0 / (constant + F.col("rank"))).alias("rrf"), F.min(seen).alias("_seen"), F.min_by(F.struct(*rest), seen).alias("_hit"))
    return top_k(both, k, F.desc(F.round("rrf", 12)), F.col("_seen")).select("query_id", key, "rank", "rrf", "_hit.*")


def first_of_each(hits: DataFrame, key: str = "id") -> DataFrame:
    """Keep-first dedupe by key in rank order; rows without a key all stay."""
    nth = F.row_number().over(Window.partitionBy("query_id", key).orderBy("rank"))
    return hits.withColumn("_nth", nth).where(F.col(key).isNull() | (F.col(key) == "") | (F.col("_nth") == 1)).drop("_nth")


def lexical_gate(hits: DataFrame, body: Column, terms: str = "terms", ratio: float = 0.25, least: float = 0.3, keep: int = 3, lex: Column | None = None, group: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Hits whose keyword score is at least max(least, ratio of the best); where none is, the first `keep`. Single hits
    and questions without terms pass. lex: the keyword score, where the hits bear it."""
    query = Window.partitionBy(*group)
    scored = hits.withColumn("_lex", keyword_score(body, F.coalesce(terms, F.array().cast("array<string>"))) if lex is None else lex)
    scored = scored.withColumns({"_top": F.max("_lex").over(query), "_n": F.count("*").over(query)})
    good = (F.col("_lex") > 0) & (F.col("_lex") >= F.greatest(F.lit(least), F.col("_top") * ratio))
    scored = scored.withColumn("_good", good).withColumn("_any", F.max("_good").over(query))
    free = (F.col("_n") <= 1) | (F.size(F.coalesce(terms, F.array().cast("array<string>"))) == 0)
    nth = F.row_number().over(query.orderBy("rank"))
    return scored.withColumn("_nth", nth).where(free | F.when(F.col("_any"), F.col("_good")).otherwise(F.col("_nth") <= keep)).drop("_lex", "_top", "_n", "_good", "_any", "_nth")


def matches_precision(standards: Column, wanted: Column) -> Column:
    """Whether a hit bears one of the standards (in its number, document name or text) and is of one of the clauses."""
    fields = [F.upper(text.without_space(F.coalesce(c, F.lit("")))) for c in ("standard_no", "doc_name", "chunk_text")]
    standard = F.exists(standards, lambda t: reduce(Column.__or__, [F.contains(f, F.upper(text.without_space(t))) for f in fields]))
    own = F.coalesce("clause_id", F.lit(""))
    clause = F.exists(wanted, lambda c: F.when(own != "", (own == c) | F.startswith(own, F.concat(c, F.lit("."))) | F.startswith(c, F.concat(own, F.lit(".")))).otherwise(F.contains(F.coalesce("chunk_text", F.lit("")), c)))
    return ((F.size(standards) == 0) | standard) & ((F.size(wanted) == 0) | clause)


def route_gate(hits: DataFrame, body: Column, ok: Column | None = None, lex: Column | None = None, group: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Precision questions keep hits that match (all, where none does); then the lexical gate. hits carry precision,
    standards, clauses and terms of their question. ok, lex: the match and the keyword score, where the hits bear them."""
    query = Window.partitionBy(*group)
    marked = hits.withColumn("_ok", matches_precision(F.col("standards"), F.col("clauses")) if ok is None else ok).withColumns({"_some": F.max("_ok").over(query), "_n": F.count("*").over(query)})
    kept = marked.where(~(F.col("precision") & F.col("_some") & (F.col("_n") > 1)) | F.col("_ok"))
    return lexical_gate(kept.drop("_ok", "_some", "_n"), body, lex=lex, group=group)


def without_low_quality(hits: DataFrame, low: DataFrame) -> DataFrame:
    """Sparse hits of unfit documents out, unless the question names a document (column doc_scoped)."""
    docs = low.select("doc_id").where("doc_id is not null").distinct().withColumn("_low", F.lit(True))
    versions = low.select("version_id").where("version_id is not null").distinct().withColumn("_lowv", F.lit(True))
    marked = hits.join(docs, "doc_id", "left").join(versions, "version_id", "left")
    return marked.where(F.col("doc_scoped") | (F.col("_low").isNull() & F.col("_lowv").isNull())).drop("_low", "_lowv")


def rerank_value(hits: DataFrame, question: str = "question") -> Column:
    """100 for each distinct token of the question found in the hit's text with its metadata, plus its score; null for
    questions without tokens."""
    meta = [F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{c}="), F.col(c))) for c in ("doc_name", "standard_no", "doc_type", "version_id", "source_type", "route", "clause_id") if c in hits.columns]
    line = F.concat_ws(" | ", *meta)
    body = F.coalesce(F.nullif(F.col("chunk_text"), F.lit("")), F.col("excerpt"), F.lit(""))
    seen = F.lower(F.when(line == "", body).when(body == "", F.concat(F.lit("["), line, F.lit("]"))).otherwise(F.concat(F.lit("["), line, F.lit("]\n"), body)))
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(F.col(question)), F.lit("[A-Za-z0-9一-龥]+"), F.lit(0)))
    return F.when(F.size(tokens) > 0, held_tokens(seen, tokens) * 100.0 + F.coalesce("score", F.lit(0.0)))


def by_value(hits: DataFrame, value: Column) -> DataFrame:
    """Hits in the order of a value, ties as they come."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(value), "rank")))


def rerank(hits: DataFrame, question: str = "question") -> DataFrame:
    """Overlap rerank by rerank_value(); stable."""
    return by_value(hits.withColumn("_value", rerank_value(hits, question)), F.col("_value")).drop("_value")


def ranked_indices(answer: str | None, size: int) -> list[int]:
    """Places that a model's answer lists (a JSON list, or one under `indices` or `ranked_indices`), each once."""
    try:
        parsed = json.loads(answer or "")
    except ValueError:
        return []
    if isinstance(parsed, dict):
        parsed = parsed.get("indices") or parsed.get("ranked_indices")
    return _places(parsed if isinstance(parsed, list) else [], size)


def reranked_indices(body: str | None, size: int) -> list[int]:
    """Places in the order of a rerank service's answer: records (under `results`, `data` or `output`) with a place
    (`index`, `document_index` or `id`) and a score (`relevance_score`, `score` or `relevance`; absent or odd: 0), best
    first, ties as they come."""
    try:
        parsed = json.loads(body or "")
    except ValueError:
        return []
    lists = [x for name in ("results", "data", "output") if isinstance(x := parsed.get(name), list)] if isinstance(parsed, dict) else []
    first = lambda item, names: next((item[n] for n in names if item.get(n) is not None), None)
    scored = []
    for item in lists[0] if lists else []:
        if isinstance(item, dict):
            try:
                score = float(first(item, ("relevance_score", "score", "relevance")) or 0.0)
            except (TypeError, ValueError):
                score = 0.0
            scored.append((score, first(item, ("index", "document_index", "id"))))
    return _places([place for _, place in sorted(scored, key=lambda x: -x[0])], size)


def _places(items: list, size: int) -> list[int]:
    out: dict[int, None] = {}
    for item in items:
        try:
            place = int(item)
        except (TypeError, ValueError):
            continue
        if 0 <= place < size:
            out[place] = None
    return list(out)


def with_ranking(hits: DataFrame, answers: DataFrame, parse: Callable[[str | None, int], list[int]] = reranked_indices) -> DataFrame:
    """Hits in the order of a rerank answer (answers: query_id, answer; places count from 0 by rank), those it leaves out
    behind; questions without a usable answer keep their order."""

    @F.pandas_udf("array<int>")
    def places(answer: pd.Series, size: pd.Series) -> pd.Series:
        return pd.Series([parse(a, int(n)) for a, n in zip(answer, size, strict=True)], dtype=object)

    sizes = hits.groupBy("query_id").agg(F.count("*").alias("n"))
    order = sizes.join(answers, "query_id").select("query_id", places("answer", "n").alias("order"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    placed = hits.withColumn("nth", nth).join(order, "query_id", "left").withColumn("place", F.nullif(F.array_position("order", F.col("nth") - 1), F.lit(0)))
    return placed.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("place").asc_nulls_last(), "nth"))).drop("nth", "order", "place")


def boost_value(measure: Column) -> Column:
    """5 * keyword score + exact rules + 0.03 * score, from columns of boost() and keyword_measure() of the hit; null where
    a question has nothing to look for."""
    body = search_text("chunk_text", "excerpt", "doc_name", "chapter_id")
    asked, bare = F.lower(text.without_space(F.col("question"))), text.without_space(body)
    own = F.coalesce("clause_id", F.lit(""))
    standard_no, doc_name = F.upper(F.coalesce("standard_no", F.lit(""))), F.upper(F.coalesce("doc_name", F.lit("")))
    kind, route = F.lower(F.coalesce("source_type", F.lit(""))), F.lower(F.coalesce("route", F.lit("")))
    near = lambda c: (own != "") & (F.startswith(own, F.concat(c, F.lit("."))) | F.startswith(c, F.concat(own, F.lit("."))))
    by_standard = F.aggregate("standards", F.lit(0.0), lambda s, t: s + F.when(standard_no == t, 8.0).when(F.contains(standard_no, t), 5.0).when(F.contains(doc_name, t), 4.0).when(F.contains(body, F.lower(t)), 2.0).otherwise(0.0))
    by_clause = F.aggregate("clauses", F.lit(0.0), lambda s, c: s + F.when(own == c, 6.0).when(near(c), 3.0).when(F.contains(body, c), 1.5).otherwise(0.0))
    rules = [
        (F.length(asked).between(1, 32) & F.contains(bare, asked), 6.0),
        (F.col("table_query") & kind.isin(*fixed.TABLE_ROW_TYPES), 4.0),
        (F.col("table_query") & F.contains(F.lower(F.coalesce("page_type", F.lit(""))), F.lit("table")), 2.0),
        (kind == "structured_fact", 3.0), (route == "structured", 1.5), (route == "keyword", 1.0), (route == "filter_keyword", 1.2), (route == "sparse", 0.8),
        ((route == "sparse") & (doc_name == ""), -2.5),
        (F.col("query_doc_type") == F.col("doc_type"), 2.5),
        (F.col("low_quality"), -6.0),
        (F.col("listing_query") & (kind == "section_summary"), -1.2),
    ]
    exact = reduce(Column.__add__, [F.when(F.coalesce(c, F.lit(False)), v).otherwise(0.0) for c, v in rules])
    exact = exact + measure["long_terms"] * 0.3 + by_standard + by_clause
    value = 5.0 * measure["score"] + exact + 0.03 * F.coalesce("score", F.lit(0.0))
    return F.when((F.size("terms") > 0) | (F.size("standards") > 0) | (F.size("clauses") > 0), value)


def by_boost(hits: DataFrame, value: Column, k: int | None = None) -> DataFrame:
    """Hits by boost_value() - 0.0001 * place; without a value they keep their place."""
    scored = hits.withColumn("boost", F.coalesce(F.round(value - 1e-4 * (F.col("rank") - 1), 9), -F.col("rank").cast("double")))
    ranked = by_value(scored, F.col("boost"))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def boost(hits: DataFrame, k: int | None = None) -> DataFrame:
    """Final order by boost_value(). hits carry question, terms, standards, clauses, table_query, listing_query,
    query_doc_type and low_quality; single hits keep their place."""
    measured = hits.withColumn("_measure", keyword_measure(search_text("chunk_text", "excerpt", "doc_name", "chapter_id"), F.col("terms")))
    valued = measured.withColumn("_value", boost_value(F.col("_measure")))
    return by_boost(valued, F.col("_value"), k).drop("_measure", "_value")


CITATION = ("doc_name", "doc_id", "page_start", "page_end", "excerpt", "chunk_text", "route", "source_type", "page_type", "table_id", "row_index", "clause_id", "table_repr")


def citations(hits: DataFrame) -> DataFrame:
    """The fields a citation shows."""
    return hits.select("query_id", "rank", *[F.coalesce("route", F.lit("dense")).alias("route") if c == "route" else F.col(c) for c in CITATION])


def clause_prefix_hits(hits: DataFrame) -> DataFrame:
    """Hits below one of their question's prefixes: by clause id, or in the text where the hit has none."""
    own = clauses.without_sub(F.coalesce("clause_id", F.lit("")))
    body = search_text("chunk_text", "excerpt", "doc_name", "chapter_id")
    ok = F.exists("prefixes", lambda p: F.when(own != "", (own == p) | F.startswith(own, F.concat(p, F.lit(".")))).otherwise(F.rlike(body, F.concat(F.lit(r"(?<!\d)\Q"), p, F.lit(r"\E(?:\.\d+)*(?:\([0-9A-Za-z]+\))?(?!\d)")))))
    return first_of_each(hits.where(ok))


def attach_explanations(anchors: DataFrame, rows: DataFrame, per_clause: int = 1) -> DataFrame:
    """Anchors with up to per_clause explanation rows of each of their clauses (an equi-join) behind the first anchor of
    the clause, first copies only. Anchors with a column spec take rows that pass their question's filter."""
    spec, has, ok = _passed(anchors)
    named = anchors.where("clause_id is not null and clause_id <> ''")
    told = F.coalesce(F.lower("source_type"), F.lit("")) != "explanation"
    clause = named.groupBy("query_id", *spec, "clause_id").agg(F.min("rank").alias("_after"), F.max(told).alias("_told"))
    notes = rows.where("source_type = 'explanation' and clause_id is not null")
    nth = F.row_number().over(Window.partitionBy("query_id", "clause_id").orderBy("page_start", "chunk_text"))
    added = clause.join(notes.select(*has, *[c for c in CITATION if c in notes.columns and c != "route"]), "clause_id").where(ok).withColumn("_nth", nth).where(F.col("_nth") <= per_clause)
    added = added.withColumns({"rank": F.col("_after"), "route": F.lit("explanation_sibling")}).drop("_after", "_nth", "_told", *has, *spec)
    own = anchors.drop(*spec).join(clause.select("query_id", "clause_id", "_told"), ["query_id", "clause_id"], "left")
    own = own.withColumn("route", F.when(F.col("_told") & (F.lower("source_type") == "explanation"), F.lit("explanation_sibling")).otherwise(F.col("route"))).drop("_told")
    every = own.withColumn("_o", F.lit(0)).unionByName(added.withColumn("_o", F.lit(1)), allowMissingColumns=True)
    same = Window.partitionBy("query_id", "doc_id", "page_start", "page_end", "source_type", "clause_id").orderBy("_o", "rank")
    kept = every.withColumn("_c", F.row_number().over(same)).where("_c = 1 or _o = 0")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "_o", "clause_id", "page_start", "chunk_text"))).drop("_c", "_o")


def pair_explanations(hits: DataFrame, rows: DataFrame, most: int = 5) -> DataFrame:
    """Hits (query_id, rank, chunk_id, clause_id, doc_type, ...) with, for each of the first `most` that are a clause or an
    explanation, the first row of its clause that is of the other kind; clauses come first, each chunk once."""
    other = F.when(F.col("doc_type") == "clause", "explanation").when(F.col("doc_type") == "explanation", "clause")
    asked = hits.where((F.col("rank") <= most) & (F.col("clause_id") != "")).select("query_id", F.col("rank").alias("after"), "clause_id", other.alias("doc_type")).where("doc_type is not null")
    firsts = rows.where("clause_id <> ''").groupBy("clause_id", "doc_type").agg(F.min_by(F.struct(*[c for c in hits.columns if c in rows.columns and c not in ("clause_id", "doc_type")]), "chunk_id").alias("row"))
    added = asked.join(firsts, ["clause_id", "doc_type"]).select("query_id", "after", "clause_id", "doc_type", "row.*").withColumn("added", F.lit(1))
    every = hits.withColumns({"after": F.col("rank"), "added": F.lit(0)}).unionByName(added, allowMissingColumns=True)
    nth = F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy("added", "after"))
    kept = every.withColumn("nth", nth).where((F.col("added") == 0) | ((F.col("nth") == 1) & F.col("chunk_id").isNotNull()))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.when(F.col("doc_type") == "clause", 0).otherwise(1), "added", "after", "chunk_id"))
    return kept.withColumn("rank", place).drop("after", "added", "nth")


def plan_questions(questions: DataFrame, precision_chars: int = 48) -> DataFrame:
    """(query_id, question, clauses, standards, doc_scoped) with the flags that choose routes."""
    q = F.lower(text.strip(F.col("question")))
    listing = text.contains_any(q, fixed.LISTING_HINTS)
    table = text.contains_any(q, fixed.TABLE_HINTS) | q.rlike(fixed.TABLE_UNITS)
    short = F.length(text.without_space(q)) <= max(12, precision_chars)
    precision = (F.size("clauses") > 0) | ((F.size("standards") > 0) & ~listing & short)
    prior = reduce(lambda c, x: c.when(text.contains_any(F.col("question"), x[1]), x[0]), fixed.DOC_TYPE_HINTS[1:], F.when(text.contains_any(F.col("question"), fixed.DOC_TYPE_HINTS[0][1]), fixed.DOC_TYPE_HINTS[0][0]))
    chapter = (text.contains_any(q, ("章", "章节", "chapter")) | listing) & (F.size("clauses") > 0)
    roots = F.array_distinct(F.filter(F.transform("clauses", clauses.root), lambda x: F.contains(x, F.lit("."))))
    sparse = ~precision | F.col("doc_scoped") | table
    reason = F.when(precision & ~F.col("doc_scoped") & ~table, "precision_disable_sparse").when(precision, "precision").otherwise("default")
    return questions.withColumns({"listing_query": listing, "table_query": table, "precision": precision, "query_doc_type": prior, "prefixes": F.when(chapter, roots).otherwise(F.array().cast("array<string>")), "use_sparse": sparse, "use_graph": ~precision, "reason": reason})


def wants_graph(question: Column, hits: Column) -> Column:
    """Whether joined conditions or thin results call for the graph route."""
    joins = reduce(Column.__add__, [F.contains(question, F.lit(w)).cast("int") for w in ("同时", "并且", "且", "分别", "关系", "关联", "and", "or")])
    terms = F.regexp_count(question, F.lit(r"\d{1,2}(?:\.\d+){1,4}")) + F.regexp_count(question, F.lit(r"[A-Z]{1,6}(?:-[A-Z0-9]{1,10}){2,}"))
    return (F.coalesce(question, F.lit("")) != "") & (((joins >= 1) & (terms >= 1)) | (joins >= 2) | (hits < 3))
