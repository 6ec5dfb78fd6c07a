"""Encoding by words: Arrow numbers the distinct words of a batch, and their ids are gathered from one array.

What an encoder returns for a word is remembered in rows of a growing array.  A batch then costs a dictionary
lookup for each *distinct* word, and one gather for all its ids.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def gathered(values: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the lists of the given rows one after another, their lengths); row r lies between ends[r] and ends[r + 1]."""
    sizes = ends[rows + 1] - ends[rows]
    place = np.cumsum(sizes)
    return values[np.arange(place[-1] if len(place) else 0) + np.repeat(ends[rows] - place + sizes, sizes)], sizes


class WordRows:
    """Words and their ids, with a mark for each word; above ``limit`` words a new turn begins, which takes over what it needs
    from the turn before.

    ``encode_words`` gives, for new words, (ids one after another, how many each word has, marks).
    """

    def __init__(self, dtype: str, limit: int, encode_words: Callable[[list[str]], tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.dtype, self.limit, self.encode_words = dtype, limit, encode_words
        self._start()
        self.older: dict[str, int] = {}
        self.older_parts = (self.ids, self.ends, self.marks)

    def _start(self) -> None:
        self.row: dict[str, int] = {}
        self.ids, self.ends, self.marks = np.zeros(1 << 16, self.dtype), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.uint8)
        self.rows = self.used = 0

    def add(self, flat: np.ndarray, lengths: np.ndarray, marks: np.ndarray | int = 0) -> np.ndarray:
        """New rows for lists of ids that stand one after another in ``flat``; returns their numbers."""
        n = len(lengths)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.rows + n + 1 > len(self.ends):
            self.ends, self.marks = (np.concatenate([x, np.zeros_like(x)]) for x in (self.ends, self.marks))
        self.ids[self.used : self.used + len(flat)] = flat
        self.ends[self.rows + 1 : self.rows + 1 + n] = self.used + np.cumsum(lengths)
        self.marks[self.rows : self.rows + n] = marks
        self.used += len(flat)
        self.rows += n
        return np.arange(self.rows - n, self.rows)

    def add_lists(self, lists: list[list[int]], marks: np.ndarray | int = 0) -> np.ndarray:
        return self.add(*flattened(lists, self.dtype), marks)

    def _learn(self, words: list[str]) -> None:
        older = self.older
        known = [w for w in words if w in older] if older else []
        if known:
            ids, ends, marks = self.older_parts
            rows = np.fromiter(map(older.__getitem__, known), np.int64, len(known))
            self.row.update(zip(known, self.add(*gathered(ids, ends, rows), marks[rows]).tolist()))
            words = [w for w in words if w not in older]
        for k in range(0, len(words), 16384):
            part = words[k : k + 16384]
            self.row.update(zip(part, self.add(*self.encode_words(part)).tolist()))

    def numbered(self, lists: pa.ListArray, skip_first: bool) -> tuple[np.ndarray, np.ndarray]:
        """(the rows of all words of the lists, where each list begins); all words are learned first.

        With ``skip_first`` the first word of each list isn't looked up: its row is left open.
        """
        if len(self.row) > self.limit:
            self.older, self.older_parts = self.row, (self.ids, self.ends, self.marks)
            self._start()
        begin = lists.offsets.to_numpy()
        begin, words = begin[:-1] - begin[0], lists.flatten()
        coded = words.dictionary_encode()
        number, distinct = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        wanted = np.ones(len(distinct), bool)
        if skip_first:
            used = np.ones(len(number), bool)
            used[begin] = False
            wanted[:] = False
            wanted[number[used]] = True
        row = self.row
        self._learn([distinct[i] for i in np.flatnonzero(wanted).tolist() if distinct[i] not in row])
        return np.fromiter(map(row.get, distinct, repeat(0)), np.int64, len(distinct))[number], begin

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of the rows one after another, how many each has)."""
        return gathered(self.ids, self.ends, rows)

    def forget(self, rows: int, used: int) -> None:
        """Take back rows that were added for one batch alone."""
        self.rows, self.used = rows, used


def flattened(lists: list[list[int]], dtype: str) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), dtype, int(lengths.sum())), lengths


def by_bytes(texts: pa.Array, most: int):
    """(from, to) of runs of texts of at most ``most`` bytes, or of one text."""
    sizes = np.cumsum(pc.binary_length(texts).to_numpy())
    at = 0
    while at < len(texts):
        before = int(sizes[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, before + most, "right")))
        yield at, to
        at = to
