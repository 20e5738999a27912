"""License scans (operator 6): patience alignment of whole texts with license templates.

Templates are indexed by their three-word grams (shorter ones for templates so short that a copy with every fifth word
changed may keep no three words together); a text without any such gram is passed in one sweep. Around each
diagonal with a gram the stretch of text is aligned: words that occur once in the text's stretch and once in the template
are anchors, the longest increasing subsequence of anchors is kept, and the gaps between kept anchors are aligned the
same way, down to gaps without anchors, where equal words at both ends are matched. Coverage is the share of the
template's words that are matched.

Notices and headers differ in few words, so coverage alone would take one license for another: of the words that decide
(names, and numbers for versions) every one of the template must be matched somewhere, and none of another license may
stand between matched words. Of stretches that overlap, the one is kept whose matched words exceed its missing and its
foreign ones by most, so a longer license that holds a shorter one's wording is reported alone.

Defined results: null and empty texts hold no license; repeated rows each report; ties go to the first name and stretch; an
empty table gives no rows; other columns pass through unless they bear the name of the result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .license_texts import DECIDING, TEMPLATES
from .seeds import SeedIndex, terms

GRAM, SLACK = 3, 0.5
HIT = T.StructType([T.StructField("license_id", T.StringType()), T.StructField("coverage", T.DoubleType()), T.StructField("matched_words", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType())])
HIT_ARROW = pa.list_(pa.struct([("license_id", pa.string()), ("coverage", pa.float64()), ("matched_words", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64())]))


def longest_increasing(values: list[int]) -> list[int]:
    """Places of a longest increasing subsequence."""
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        if k == len(tails):
            tails.append(v), ends.append(i)
        else:
            tails[k], ends[k] = v, i
        before[i] = ends[k - 1] if k else -1
    out, at = [], ends[-1] if ends else -1
    while at >= 0:
        out.append(at)
        at = before[at]
    return out[::-1]


def patience(template: list[int], text: list[int]) -> list[tuple[int, int]]:
    """Matched places (template, text), increasing in both; words 0 are unknown and never match."""
    matched: list[tuple[int, int]] = []
    todo = [(0, len(template), 0, len(text))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and template[a0] == text[b0]:
            matched.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and template[a1 - 1] == text[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            matched.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        ca, cb = Counter(template[a0:a1]), Counter(text[b0:b1])
        place = {text[j]: j for j in range(b0, b1) if cb[text[j]] == 1}
        pairs = [(i, place[template[i]]) for i in range(a0, a1) if ca[template[i]] == 1 and template[i] in place]
        if not pairs:
            continue
        kept = [pairs[k] for k in longest_increasing([j for _, j in pairs])]
        matched += kept
        edges = [(a0 - 1, b0 - 1), *kept, (a1, b1)]
        todo += [(p[0] + 1, q[0], p[1] + 1, q[1]) for p, q in zip(edges, edges[1:], strict=False) if q[0] - p[0] > 1 and q[1] - p[1] > 1]
    return sorted(matched)


def deciding(name: str, words: list[str]) -> set[str]:
    """Words of a template that must be matched; whole texts are told by their wording."""
    return set() if name.endswith("/text") else {w for w in words if w in DECIDING or w.isdigit()}


def decided(needed: set[str], template: list[str], words: list[str], matched: list[tuple[int, int]]) -> bool:
    """Whether all deciding words are matched, and none of other licenses stand between matched words."""
    if not needed:
        return True
    own, there = set(template), {j for _, j in matched}
    foreign = (words[j] for j in range(matched[0][1], matched[-1][1]) if j not in there)
    return needed <= {template[i] for i, _ in matched} and not any(w in DECIDING and w not in own for w in foreign)


def best_apart(found: list[tuple]) -> list[tuple]:
    """Of (worth, name, coverage, matched, first, last): the best of each overlapping company, then each name's best."""
    kept: list[tuple] = []
    for hit in sorted(found, key=lambda h: (-h[0], h[1], h[4])):
        if all(hit[5] < other[4] or other[5] < hit[4] for other in kept):
            kept.append(hit)
    first: dict[str, tuple] = {}
    for hit in kept:
        first.setdefault(hit[1], hit)
    return [first[name] for name in sorted(first)]


def with_licenses(docs: DataFrame, least: float = 0.8, text: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """docs with licenses: array of (license_id, coverage, matched_words, first_word, last_word)."""
    docs = docs.drop("licenses")
    at = docs.columns.index(text)
    chosen = templates or TEMPLATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = sorted(chosen)
        words_of = [terms(chosen[x]) for x in names]
        needed = [deciding(x, w) for x, w in zip(names, words_of, strict=True)]
        index = SeedIndex(words_of, GRAM, least)
        for big in batches:
            for start in range(0, big.num_rows, 500):
                b = big.slice(start, 500)
                found = []
                for t in b.column(at).to_pylist():
                    words = terms(t)
                    ids, got = index.ids(words), []
                    for item, parts in index.windows(ids, index.codes, SLACK).items():
                        template = index.coded[item].tolist()
                        for lo, hi in parts:
                            part = ids[lo:hi]
                            if index.shared(item, part) < least * len(template):
                                continue
                            m = patience(template, part.tolist())
                            if len(m) >= least * len(template) - 1e-9 and decided(needed[item], words_of[item], words[lo:hi], m):
                                first, last = lo + m[0][1], lo + m[-1][1]
                                worth = len(m) - (len(template) - len(m)) - (last - first + 1 - len(m))
                                got.append((worth, names[item], len(m) / len(template), len(m), first, last))
                    found.append([{"license_id": h[1], "coverage": h[2], "matched_words": h[3], "first_word": h[4], "last_word": h[5]} for h in best_apart(got)])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, HIT_ARROW)], names=[*b.schema.names, "licenses"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("licenses", T.ArrayType(HIT))]))
