"""Which 64-bit values occur more than once, when there are too many for a shuffle row each.

Chunks of values ask parts of the value space, a block of values at a time, and
are told by bits.  A chunk sends a value once, however often it holds it, so no
part is swamped by a common value; a part sorts what it was sent.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def places(values: np.ndarray, parts: int) -> dict[int, np.ndarray]:
    """Where a chunk's distinct values lie, by part, for the parts that it meets: never more than it has values."""
    if not len(values):
        return {}
    part = (values % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    here, at = np.unique(part[order], return_index=True)
    return dict(zip(here.tolist(), np.split(order, at[1:])))


def question(chunk: int, values: np.ndarray, counts: np.ndarray, parts: int, kind: type = np.uint64) -> pa.RecordBatch:
    """A row for each part that a chunk's distinct values fall into; ``kind`` uint32 sends the upper halves only."""
    by = places(values, parts)
    sent = values if kind is np.uint64 else (values >> np.uint64(32)).astype(kind)
    columns = [
        pa.array(list(by), pa.int64()),
        pa.array([chunk] * len(by), pa.int64()),
        pa.array([sent[o].tobytes() for o in by.values()], pa.binary()),
        pa.array([np.packbits(counts[o] > 1).tobytes() for o in by.values()], pa.binary()),
    ]
    return pa.record_batch(columns, names=["part", "chunk", "sent", "twice"])


def told(asked: DataFrame, kind: type = np.uint64) -> DataFrame:
    """(_c, told) for each chunk that asked (part, chunk, sent, twice): its parts' answers."""

    def answer(group: pa.Table) -> pa.Table:
        lists = [np.frombuffer(x, kind) for x in group.column("sent").to_pylist()]
        ends = np.cumsum([len(x) for x in lists])
        twice = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8))[: len(r)] for x, r in zip(group.column("twice").to_pylist(), lists)])
        values = np.concatenate(lists)
        # a value repeats if its neighbour is the same once sorted, or if a chunk holds it twice
        order = np.argsort(values, kind="stable")
        ranked = values[order]
        run = np.append(True, ranked[1:] != ranked[:-1]).cumsum() - 1
        again = (np.bincount(run) > 1) | (np.bincount(run, twice[order]) > 0)
        out = np.zeros(len(values), bool)
        out[order] = again[run]
        bits = [np.packbits(out[s:e]).tobytes() for s, e in zip(np.append(0, ends[:-1]), ends)]
        return pa.table([group.column("chunk"), group.column("part"), pa.array(bits, pa.binary())], names=["chunk", "part", "bits"])

    answers = asked.groupBy("part").applyInArrow(answer, "chunk long, part long, bits binary")
    return answers.groupBy(F.col("chunk").alias("_c")).agg(F.collect_list(F.struct("part", "bits")).alias("told"))


def heard(values: np.ndarray, parts: int, answers: list[dict] | None) -> np.ndarray:
    """Which of a chunk's distinct values occur more than once."""
    again, by = np.zeros(len(values), bool), places(values, parts)
    for t in answers or []:
        own = by[t["part"]]
        again[own] = np.unpackbits(np.frombuffer(t["bits"], np.uint8))[: len(own)] > 0
    return again
