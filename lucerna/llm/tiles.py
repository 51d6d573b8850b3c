"""Splitting rows into bounded tiles, and running over tiles in sorted partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Rows that one side of a tile holds on average at most.
TILE = 2048


def spread(ids: np.ndarray) -> np.ndarray:
    """A well-mixed non-negative hash of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return ((x ^ (x >> np.uint64(29))) >> np.uint64(1)).astype(np.int64)


def fan_out(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of rows repeated by their counts, and the number of each repetition."""
    row = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return row, np.arange(len(row)) - first[row]


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, from batches sorted by the keys; a run that spans batches is joined."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [np.asarray(b.column(k)) for k in keys]
        cut = np.zeros(b.num_rows - 1, bool)
        for c in columns:
            cut |= c[1:] != c[:-1]
        starts = [0, *(np.flatnonzero(cut) + 1).tolist(), b.num_rows]
        for s, e in zip(starts, starts[1:]):
            key = tuple(c[s] for c in columns)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(b.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(key, the other columns) of each run of the first column, from batches sorted by it.

    Columns are sliced, not copied; only a run that spans batches is joined.
    """
    held: list[np.ndarray] | None = None

    def cut(columns: list[np.ndarray]) -> np.ndarray:
        return np.append(0, np.flatnonzero(columns[0][1:] != columns[0][:-1]) + 1)

    for b in batches:
        if not b.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if held is not None:
            columns = [np.concatenate(x) for x in zip(held, columns)]
        starts = cut(columns).tolist()
        for s, e in zip(starts, starts[1:]):
            yield int(columns[0][s]), [c[s:e] for c in columns[1:]]
        held = [c[starts[-1] :] for c in columns]
    if held is not None:
        yield int(held[0][0]), held[1:]
