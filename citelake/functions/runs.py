"""What the words of texts hold, found once a word and not once a text."""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable
from itertools import chain

import numpy as np

_RUN = re.compile(r"\w+")
is_run = _RUN.fullmatch


def runs(text: str | None) -> list[str]:
    """A text's words: its longest stretches of word characters, in order."""
    return _RUN.findall(text or "")


class Held(dict):
    """word -> its slot, which names a stretch of ids. find(word) gives a word's ids, one for each time it holds them. The
    first `most` words of at most `longest` letters are kept, all others are looked through wherever they stand."""

    def __init__(self, find: Callable[[str], Iterable[int]], most: int = 400_000, longest: int = 64):
        super().__init__()
        self.find, self.most, self.longest = find, most, longest
        self.kept, self.spare = (array("i"), array("q")), (array("i"), array("q"))  # ids, and where each slot's end

    def __missing__(self, word: str) -> int:
        keep = len(self) < self.most and len(word) <= self.longest
        ids, ends = self.kept if keep else self.spare
        ids.extend(self.find(word))
        ends.append(len(ids))
        if not keep:
            return -len(ends)
        self[word] = slot = len(ends) - 1
        return slot

    def of(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(place of the text, id) of all that the words of some texts hold, in order of the texts."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        slots = np.fromiter(map(self.__getitem__, chain.from_iterable(texts)), np.int64, int(sizes.sum()))
        (ids, ends), (more, more_ends) = self.kept, self.spare
        self.spare = (array("i"), array("q"))
        slots = np.where(slots < 0, len(ends) - 1 - slots, slots)
        ends = np.concatenate([np.array([0]), np.array(ends, np.int64), np.array(more_ends, np.int64) + len(ids)])
        ids = np.concatenate([np.array(ids, np.int64), np.array(more, np.int64)])
        size = ends[slots + 1] - ends[slots]
        at = np.repeat(ends[slots] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        return np.repeat(np.repeat(np.arange(len(texts)), sizes), size), ids[at]
