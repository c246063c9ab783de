"""Pre-tokens of texts, numbered by the process; what is known of a number stays until there are too many."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import regex

#: Fixed value: the pattern that splits text before the merges of the byte-level vocabularies.
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")


class Numbers(dict):
    """Numbers for pre-tokens, in order of appearance."""

    def __missing__(self, token: str) -> int:
        self[token] = n = len(self)
        return n


class Known:
    """A result of variable length (int32) for every pre-token seen, found for new ones all at once.

    find gets new pre-tokens as UTF-8 and returns their results' lengths and all results in a row.
    """

    def __init__(self, find: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], limit: int = 400_000):
        self.find, self.limit = find, limit
        self.clear()

    def clear(self) -> None:
        self.numbers = Numbers()
        self.length = np.zeros(0, np.int64)
        self.start = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def numbered(self, text: str) -> np.ndarray:
        tokens = PATTERN.findall(text)
        return np.fromiter(map(self.numbers.__getitem__, tokens), np.int32, len(tokens))

    def catch_up(self) -> None:
        """Finds the results of the numbers given out since the last time."""
        if len(self.numbers) == len(self.length):
            return
        new = [t.encode() for t in itertools.islice(self.numbers, len(self.length), None)]
        length, flat = self.find(new)
        self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(length) - length))
        self.length = np.concatenate((self.length, length))
        self.flat = np.concatenate((self.flat, flat.astype(np.int32)))

    def tidy(self) -> None:
        """Between batches only: numbers given out before are void afterwards."""
        if len(self.numbers) > self.limit:
            self.clear()
