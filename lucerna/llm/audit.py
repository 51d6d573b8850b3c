"""Which filters remove what, in every order: counts over all orders of five document filters.

One scan reads each text in its Arrow buffer.  Byte classes and their prefix
sums give words, capitals, code points and symbols; rolling hashes of the words,
sorted within each document and verified byte by byte, give distinct words.  A
document's failures are a mask of five bits.  Counts per part and mask, at most
32 a part, then answer every order and step by one matrix product.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.llm.bpe import slices
from lucerna.llm.common import Scratch

LETTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
SYMBOLS = b"#$%&*|"
SLICE = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Words longer than this are verified one pair at a time.
_LANES = 64
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and those of its inverse, modulo 2^64."""
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _same(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the bytes of two words of one size, given by their beginnings, are equal."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    same = np.ones(len(a), bool)
    todo = np.arange(len(a))
    for k in range(0, _LANES, 8):
        todo = todo[size[todo] > k]
        if not len(todo):
            return same
        rest = np.minimum(size[todo] - k, 8).astype(np.uint64)
        mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * rest)
        same[todo] &= ((lanes[a[todo] + k] ^ lanes[b[todo] + k]) & mask) == 0
    for i in todo[size[todo] > _LANES].tolist():
        same[i] &= bool(np.array_equal(data[a[i] : a[i] + size[i]], data[b[i] : b[i] + size[i]]))
    return same


def distinct(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, doc: np.ndarray, n_docs: int, hash_bits: int = 64) -> np.ndarray:
    """Distinct words of each document, from its words' byte ranges; ``doc`` does not fall.

    Equal hashes are verified; documents with words that share a hash are counted from their words.
    ``hash_bits`` limits the hash (tests).
    """
    if not len(begins):
        return np.zeros(n_docs, np.int64)
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    h = (sums[ends] - sums[begins]) * down[begins]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    bits = max(1, int(n_docs).bit_length())
    h >>= np.uint64(64 - min(64 - bits, hash_bits))
    keys = (doc.astype(np.uint64) << np.uint64(64 - bits)) | h
    order = np.argsort(keys, kind="stable")
    again = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
    a, b = order[again], order[again + 1]
    size = ends - begins
    same = size[a] == size[b]
    even = np.flatnonzero(same)
    same[even] = _same(data, begins[a[even]], begins[b[even]], size[a[even]])
    new = np.ones(len(order), bool)
    new[again + 1] = False
    counts = np.bincount(doc[order[new]], minlength=n_docs)
    for d in np.unique(doc[a[~same]]).tolist():
        own = np.flatnonzero(doc == d)
        counts[d] = len({data[begins[i] : ends[i]].tobytes() for i in own.tolist()})
    return counts


def scan(column: pa.Array) -> dict[str, np.ndarray]:
    """Words, distinct words, capitals, code points and symbols of each text, and its SHA-256; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    n = len(column)
    _, offsets, raw = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, 8 * column.offset)
    data = np.frombuffer(raw, np.uint8, int(at[-1] - at[0]), int(at[0])) if raw is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0]
    starts, ends, m = at[:-1], at[1:], len(data)

    def summed(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(m + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[ends] - sums[starts]

    full = ends > starts
    inside = ~_SPACE[data]
    edge = np.zeros(m + 1, bool)
    edge[starts[full]] = True
    edge[ends[full]] = True
    left, right = edge[:m].copy(), edge[1:].copy()
    left[1:] |= ~inside[:-1]
    right[:-1] |= ~inside[1:]
    begins = np.flatnonzero(inside & left)
    stops = np.flatnonzero(inside & right) + 1
    words = summed(inside & left)
    view = memoryview(data)
    return {
        "words": words,
        "distinct_words": distinct(data, begins, stops, np.repeat(np.arange(n), words), n),
        "capitals": summed((data >= 65) & (data <= 90)),
        "code_points": summed((data & 0xC0) != 0x80),
        "symbols": summed(_SYMBOL[data]),
        "digest": [hashlib.sha256(view[a:b]).digest() for a, b in zip(starts.tolist(), ends.tolist())],
    }


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per row: id, part (null: empty string), words, distinct_words, capitals, code_points, symbols, digest, fails.

    ``fails`` has bit 0 for A (fewer than 200 words), bit 1 for B (distinct words
    below half of the words), bit 2 for C (capitals above 3 in 100 code points),
    bit 3 for D (a symbol of ``#$%&*|``).  A null text counts as empty: it fails A.
    Other columns are ignored; an empty table gives no rows.
    """
    names = ["words", "distinct_words", "capitals", "code_points", "symbols"]
    kinds = {x: df.schema[c].dataType.simpleString() for x, c in (("id", id_col), ("part", part_col))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", SLICE):
                x = scan(b.column("text"))
                fails = (x["words"] < LEAST_WORDS) | ((100 * x["distinct_words"] < LEAST_DISTINCT * x["words"]) << 1) | ((100 * x["capitals"] > MOST_CAPITALS * x["code_points"]) << 2) | ((x["symbols"] > 0) << 3)
                columns = [b.column("id"), b.column("part"), *(pa.array(x[c], pa.int64()) for c in names), pa.array(x["digest"], pa.binary()), pa.array(fails, pa.int32())]
                yield pa.record_batch(columns, names=["id", "part", *names, "digest", "fails"])

    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kinds['id']}, part string, {', '.join(f'{c} long' for c in names)}, digest binary, fails int")


def with_copies(measured: DataFrame, scratch: Scratch) -> DataFrame:
    """``fails`` with bit 4 for E: the text is that of a row of smaller id.

    Texts are told by SHA-256.  Rows that repeat the least id don't fail; rows
    without an id neither fail nor make others fail.  Texts that repeat are saved
    with their least id, so that both sides of the join are dealt for it alone and
    a large group of copies can be split.
    """
    repeated = measured.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = scratch.save(repeated.select("digest", "first"), "firsts")
    later = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    return measured.join(firsts, "digest", "left").withColumn("fails", F.col("fails") + F.when(later, 1 << 4).otherwise(0)).drop("first")


def _orders() -> list[str]:
    return ["".join(p) for p in permutations(LETTERS)]


def matrices() -> dict[str, np.ndarray]:
    """For each order and step (600 rows, orders first) the masks (32 columns) that count, by measure."""
    masks = np.arange(32)
    out = {k: np.zeros((600, 32), np.int64) for k in ("kept", "removed", "redundant", "unique_fails", "shapley")}
    by_letter = np.zeros((5, 32), np.int64)
    at = 0
    for order in _orders():
        before = 0
        for letter in order:
            bit = 1 << LETTERS.index(letter)
            fails, gone = masks & bit != 0, masks & before != 0
            before |= bit
            out["kept"][at] = masks & before == 0
            out["removed"][at] = fails & ~gone
            out["redundant"][at] = fails & gone
            out["unique_fails"][at] = masks == bit
            by_letter[LETTERS.index(letter)] += out["removed"][at]
            at += 1
    out["shapley"] = by_letter[[LETTERS.index(x) for order in _orders() for x in order]]
    return out


def audit(df: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Per part, order of the five filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``labels`` has the id, quality and toxic; several rows of an id count as good
    (toxic) if one of them is.  Documents without a label are counted, but never as
    good or toxic.  Every part of the table has all 600 rows, zeros included; a
    null part and an empty one are one part.  An empty table gives no rows.

    Texts are read once; the narrow measurements are saved, and what is shuffled
    is those.  A group of copies meets its least id through a join that can be
    split, not in one task; a part's counts are at most 32 rows.
    """
    measured = scratch.save(measure(df, id_col, text_col, part_col).select("id", "part", "digest", "fails"), "measured")
    good = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = with_copies(measured, scratch).join(good, "id", "left")
    counts = known.groupBy("part", "fails").agg(*(F.sum(F.coalesce(x, F.lit(0)).cast("long")).alias(name) for x, name in ((F.lit(1), "n"), (F.col("good"), "good"), (F.col("toxic"), "toxic"))))
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("counts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, orders = matrices(), _orders()
        order = pa.array([o for o in orders for _ in LETTERS])
        step = pa.array([i + 1 for _ in orders for i in range(5)], pa.int32())
        for b in batches:
            for part, rows in zip(b.column("part").to_pylist(), b.column("counts").to_pylist()):
                n, good_, toxic = np.zeros((3, 32), np.int64)
                for r in rows:
                    n[r["fails"]], good_[r["fails"]], toxic[r["fails"]] = r["n"], r["good"], r["toxic"]
                found = [m["kept"] @ n, m["removed"] @ n, m["redundant"] @ n, m["unique_fails"] @ n, m["removed"] @ good_, m["removed"] @ toxic, m["shapley"] @ n]
                yield pa.record_batch([pa.array([part] * 600), order, step, *map(pa.array, found)], names=["part", "filter_order", "step", *COUNTS])

    return parts.mapInArrow(run, f"part string, filter_order string, step int, {', '.join(f'{c} long' for c in COUNTS)}")


COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
