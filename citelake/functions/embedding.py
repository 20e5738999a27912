"""A deterministic hash embedding, used where no model is at hand."""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from citelake.functions.runs import Held, runs


def tokens(text: Column) -> Column:
    """Dotted numbers, Latin words and single Chinese characters; a lone marker for empty text."""
    t = F.lower(F.coalesce(text, F.lit("")))
    found = F.concat(*[F.regexp_extract_all(t, F.lit(p), F.lit(0)) for p in (r"\d+(?:\.\d+)+", r"[a-z0-9]+", "[一-鿿]")])
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("__empty__")))


def hash_vector(text: Column, dim: int = 1024) -> Column:
    """Tokens added with a sign at hashed places, scaled to length 1; array<double> of `dim`.

    Place: the digest's first 32 bits modulo dim. Sign: the fifth byte's low bit. Weight: 1 + min(length, 8) / 8."""

    def hit(token: Column) -> Column:
        h = F.sha2(token, 256)
        place = F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % dim
        odd = F.conv(F.substring(h, 10, 1), 16, 10).cast("int") % 2
        weight = 1 + F.least(F.length(token), F.lit(8)) / 8.0
        return F.struct(place.alias("i"), F.when(odd == 0, weight).otherwise(-weight).alias("w"))

    hits = F.transform(tokens(text), hit)
    places = F.array_sort(F.array_distinct(F.transform(hits, lambda x: x["i"])))
    sums = F.transform(places, lambda p: F.struct(p.alias("i"), F.aggregate(F.filter(hits, lambda x: x["i"] == p), F.lit(0.0), lambda a, x: a + x["w"]).alias("w")))
    norm = F.sqrt(F.aggregate(sums, F.lit(0.0), lambda a, x: a + x["w"] * x["w"]))
    by_place = F.map_from_entries(sums)
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.when(norm > 0, F.coalesce(F.try_element_at(by_place, i.cast("long")), F.lit(0.0)) / norm).otherwise(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where lengths differ or a vector is zero."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size)


_FOUND = [re.compile(p) for p in (r"\d+(?:\.\d+)+", r"[a-z0-9]+", "[一-鿿]")]
_DOTTED = re.compile(r"\.\d")  # found fast, and wherever a dotted number is
_WEIGHTS = np.array([s * (1 + n / 8.0) for s in (1.0, -1.0) for n in range(1, 9)])


class Hasher(dict):
    """hash_vector() of many texts in lower case: token -> 16 * place + 8 * (sign is minus) + min(length, 8) - 1."""

    def __init__(self, dim: int = 1024, most: int = 200_000) -> None:
        super().__init__()
        self.dim, self.most, self.held = dim, most, Held(self.codes)

    def __missing__(self, token: str) -> int:
        digest = hashlib.sha256(token.encode("utf-8", "surrogatepass")).digest()
        code = int.from_bytes(digest[:4], "big") % self.dim * 16 + (digest[4] & 1) * 8 + min(len(token), 8) - 1
        if len(self) < self.most:  # a cache, not a limit on tokens
            self[token] = code
        return code

    def codes(self, word: str) -> list[int]:
        """What one of a text's runs() holds: its tokens but for dotted numbers, which reach over several."""
        return [self[word]] if _FOUND[1].fullmatch(word) else [self[x] for p in _FOUND[1:] for x in p.findall(word)]

    def vectors(self, texts: list[str | None], held: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """held: (place of the text, code) of all its words, where they are at hand. Sums of eighths are exact, whatever their
        order."""
        row, code = self.held.of([runs(t) for t in texts]) if held is None else held
        dotted = [(i, self[x]) for i, t in enumerate(texts) if t and _DOTTED.search(t) for x in _FOUND[0].findall(t)]
        bare = np.flatnonzero(np.bincount(np.append(row, [i for i, _ in dotted]).astype(np.int64), minlength=len(texts)) == 0)
        row = np.concatenate([row, np.array([i for i, _ in dotted], np.int64), bare])
        code = np.concatenate([code, np.array([c for _, c in dotted], np.int64), np.full(len(bare), self["__empty__"])])
        out = np.bincount(row * self.dim + (code >> 4), weights=_WEIGHTS[code & 15], minlength=len(texts) * self.dim).reshape(len(texts), self.dim)
        norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, norm, out=out, where=norm > 0)
