"""Helpers for Arrow streams whose rows are sorted by a group column."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches in pieces, so that the Python objects made of one stay few; at the end, freed memory goes back to the system."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    release_memory()


def release_memory() -> None:
    """Give memory that this process no longer uses back to the system: workers live on while other stages need the room."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def whole_groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Batches cut anew so that no group is spread over two of them; many small groups share a batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(column).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(keys != keys[-1], False)) if keys[0] == keys[-1] else int(np.flatnonzero(keys != keys[-1])[-1]) + 1
        if cut:
            held.append(batch.slice(0, cut))
            yield from _joined(held)
            held = []
        elif held and held[0].column(column)[0].as_py() != keys[0]:
            yield from _joined(held)
            held = []
        held.append(batch.slice(cut))
    yield from _joined(held)
    held.clear()
    release_memory()


def _joined(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if parts:
        yield pa.concat_batches(parts)


def group_edges(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, with the length at the end."""
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether the two were apart."""
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y

    def spanning(self, xs, ys) -> list[tuple[int, int]]:
        """The pairs that joined something."""
        return [(x, y) for x, y in zip(xs, ys) if self.join(x, y)]
