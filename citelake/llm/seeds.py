"""Seed search: where word n-grams of a bounded set of items occur in long texts."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np

TERM = re.compile(r"\w+")


def terms(text: str | None) -> list[str]:
    return TERM.findall(text.lower()) if text else []


def intact(words: int, least: float) -> int:
    """Words of the longest stretch that a copy of an item keeps for certain, if at most 1 - least of the item's number of
    words are changed, left out or put in: edits cut it into one stretch more than there are edits."""
    edits = int((1 - least) * words + 1e-9)
    return max(1, -(-(words - edits) // (edits + 1)))


class SeedIndex:
    """items: lists of words. A seed is a gram of an item: `gram` words, or as many as a copy keeps together for certain, if
    that is less. Grams are coded in the items' own vocabulary, so that a text costs one dictionary lookup a word and one
    binary search for each gram made of known words only (word codes start at 1, so codes of different lengths differ)."""

    def __init__(self, items: list[list[str]], gram: int, least: float = 0.8):
        self.items, self.least = items, least
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for x in items for w in x}))}
        self.base = len(self.vocabulary) + 1
        if self.base**gram >= 1 << 63:
            raise ValueError("too many distinct words in one block of items")
        self.coded = [self.ids(x) for x in items]
        self.grams = [min(gram, intact(len(x), least)) for x in items]
        self.sizes = sorted(set(self.grams))
        found: dict[int, list[tuple[int, int]]] = {}
        for i, c in enumerate(self.coded):
            for at, code in enumerate(self._codes(c, self.grams[i])):
                found.setdefault(int(code), []).append((i, at))
        self.places = found
        self.codes = np.array(sorted(found), np.int64)

    def ids(self, words: list[str]) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, 0) for w in words], np.int64)

    def _codes(self, ids: np.ndarray, gram: int) -> np.ndarray:
        n = max(0, len(ids) - gram + 1)
        out = np.zeros(n, np.int64)
        for i in range(gram):
            out = out * self.base + ids[i : i + n]
        return out

    def occurrences(self, ids: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, codes) of grams of ids that are among the sorted codes."""
        places, codes = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for gram in self.sizes if len(among) else ():
            n = len(ids) - gram + 1
            if n <= 0:
                break
            whole = ids[:n] > 0
            for i in range(1, gram):
                whole &= ids[i : i + n] > 0
            at = np.flatnonzero(whole)
            code = np.zeros(len(at), np.int64)
            for i in range(gram):
                code = code * self.base + ids[at + i]
            ok = among[np.minimum(np.searchsorted(among, code), len(among) - 1)] == code
            places.append(at[ok]), codes.append(code[ok])
        return np.concatenate(places), np.concatenate(codes)

    def rare(self, counts: dict[int, int], short: int) -> np.ndarray:
        """Seeds: of as many consecutive grams as every copy keeps together at least the rarest that occurs at all (ties:
        the first); all grams that occur of items under `short` words, whose copies may keep less than that."""
        chosen: set[int] = set()
        for c, gram in zip(self.coded, self.grams, strict=True):
            codes = self._codes(c, gram).tolist()
            stride = 1 if len(c) < short else max(1, intact(len(c), self.least) - gram + 1)
            for at in range(max(1, len(codes) - stride + 1) if codes else 0):
                some = [x for x in codes[at : at + stride] if counts.get(x, 0)]
                if some:
                    chosen.add(min(some, key=counts.__getitem__))
        return np.array(sorted(chosen), np.int64)

    def windows(self, ids: np.ndarray, among: np.ndarray, slack: float) -> dict[int, list[tuple[int, int]]]:
        """For each item that has a seed in ids: stretches of ids in which an alignment through a seed must lie."""
        diagonals: dict[int, set[int]] = {}
        for at, code in zip(*(x.tolist() for x in self.occurrences(ids, among)), strict=True):
            for item, offset in self.places[code]:
                width = int(slack * len(self.coded[item])) + 1
                diagonals.setdefault(item, set()).add((at - offset) // width)
        out = {}
        for item, cells in diagonals.items():
            size = len(self.coded[item])
            width = int(slack * size) + 1
            out[item] = [(max(0, d * width - width), min(len(ids), (d + 1) * width + size + width)) for d in sorted(cells)]
        return out

    def shared(self, item: int, part: np.ndarray) -> int:
        """Upper bound of words that any alignment of the item with part can match."""
        there = Counter(part.tolist())
        return sum(min(n, there.get(w, 0)) for w, n in Counter(self.coded[item].tolist()).items())
