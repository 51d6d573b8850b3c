"""Packing token sequences into windows by Karmarkar-Karp multiway differencing.

A document's ids are cut into full windows, which need no partner, and a rest.
The rests, cut into pieces of at most ``PIECE`` ids, are gathered until about
``GROUP`` windows are due.  Multiway differencing then splits the pieces of a
group into near-equal windows: the two partial partitions with the greatest
imbalance are merged, the fullest part of one with the emptiest of the other,
until one partition is left.  If a window exceeds the capacity, the group is
split anew into one window more.

A task packs its own documents while it tokenises them, so nothing is shuffled;
what it holds is bounded by one group.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lucerna.llm.bpe import REMEMBERED, slices, units_of
from lucerna.llm.common import texts_of

CAPACITY, PIECE, GROUP = 1024, 256, 96
#: Ids to spare in a group, over all its windows, at which it is closed.
SPARE = (64, 320)


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_tokenizer(path: str) -> tuple[list[bytes], dict[str, int]]:
    """Tokens in id order, and special strings with their ids, of a byte-level BPE tokenizer file whose ids follow its merges."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    letters, vocab = byte_letters(), spec["model"]["vocab"]
    tokens = [b""] * (max(vocab.values()) + 1)
    for t, i in vocab.items():
        if t not in special:
            tokens[i] = bytes(letters[c] for c in t)
    return tokens, special


class Ids:
    """Text to ids: units that a worker remembers, the others by the tokenizer in one call a batch."""

    def __init__(self, tokens: list[bytes], special: dict[str, int], pattern: str):
        import tiktoken

        self.engine = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(tokens) if t}, special_tokens=special)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.special, self.units = special, {}

    def _learn(self, new: list[str]) -> None:
        ids = np.array(self.engine.encode_ordinary("".join(new)), "<u4")
        ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(u.encode()) for u in new])) + 1
        raw, at = ids.tobytes(), 0
        for u, to in zip(new, (4 * ends).tolist()):
            self.units[u] = raw[at:to]
            at = to

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.units) > REMEMBERED:
            self.units.clear()
        cut = [None if any(s in t for s in self.special) else units_of(t) for t in texts]
        # a text's first unit has no space before it, so it isn't told apart from what would stand before it
        new = [u for u in {u for c in cut if c for u in c[1:]} if u not in self.units]
        if new:
            self._learn(new)
        get, out = self.units.__getitem__, []
        for t, c in zip(texts, cut):
            if c is None:
                out.append(np.array(self.engine.encode(t, allowed_special="all"), "<u4").tobytes())
            else:
                out.append(np.array(self.engine.encode_ordinary(c[0]), "<u4").tobytes() + b"".join(map(get, c[1:])))
        return out


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp: splits items into k parts of near-equal sums; returns each part's items."""
    if k <= 1:
        return [list(range(len(sizes)))]
    # a partial partition: its k sums in falling order less the least, and the tree of items behind each sum
    trees: list[tuple] = [()] + [(i,) for i in range(len(sizes))]
    heap = []
    for i, s in enumerate(sizes):
        sums, at = np.zeros(k, np.int64), np.zeros(k, np.int64)
        sums[0], at[0] = s, i + 1
        heap.append((-s, i, sums, at))
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        _, _, a, ta = heapq.heappop(heap)
        _, _, b, tb = heapq.heappop(heap)
        sums, tb = a + b[::-1], tb[::-1]
        both = np.flatnonzero((ta > 0) & (tb > 0))
        at = ta + tb
        for j in both.tolist():
            trees.append((int(ta[j]), int(tb[j]), None))
            at[j] = len(trees) - 1
        order = np.argsort(-sums, kind="stable")
        sums, at = sums[order], at[order]
        sums -= sums[-1]
        n += 1
        heapq.heappush(heap, (-int(sums[0]), n, sums, at))

    def items(t: int) -> list[int]:
        out, todo = [], [t]
        while todo:
            x = trees[todo.pop()]
            if len(x) == 3:
                todo += x[:2]
            else:
                out += x
        return out

    return [items(t) for t in heap[0][3].tolist()]


def windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Parts of at most ``capacity`` each; their number rises until none exceeds it."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = difference(sizes, k)
        if all(sum(sizes[i] for i in p) <= capacity for p in parts):
            return [p for p in parts if p]
        k += 1


_IDS: dict[int, Ids] = {}


def pack(df: DataFrame, tokenizer: str, pattern: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Tokenises and packs whole texts.

    Returns one row per piece: the id column, start, length, ``ids`` (binary,
    little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.  Each text
    yields its ids and then ``end_id``; a null or empty text yields that id
    alone.  Repeated rows are packed each, an empty table gives no rows, other
    columns are ignored.  Sequence ids are unique and the same in every attempt
    of a task.  The vocabulary, of fixed size, is broadcast.
    """
    tokens, special = read_tokenizer(tokenizer)
    held = df.sparkSession.sparkContext.broadcast((tokens, special))
    key = xxhash.xxh64_intdigest(b"\0".join(tokens))
    names = [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    kind = df.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _IDS:
            _IDS.clear()
            _IDS[key] = Ids(*held.value, pattern)
        ids_of, sequence = _IDS[key], TaskContext.get().partitionId() << 40
        rests, total = [], 0  # (id, start, length, ids, doc_tokens)
        out: list[tuple] = []
        id_type = None

        def close() -> None:
            nonlocal rests, total, sequence
            for part in windows([r[2] for r in rests], capacity):
                at = 0
                for i in sorted(part):
                    out.append((*rests[i], sequence, at))
                    at += rests[i][2]
                sequence += 1
            rests, total = [], 0

        def ready() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [[]] * 7
            kinds = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            out.clear()
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

        for whole in batches:
            id_type = whole.column("id").type
            for b in slices(whole, "text"):
                for i, raw in zip(b.column("id").to_pylist(), ids_of.encode(texts_of(b.column("text")))):
                    raw += end
                    n, at = len(raw) // 4, 0
                    while n - at >= capacity:
                        out.append((i, at, capacity, raw[4 * at : 4 * (at + capacity)], n, sequence, 0))
                        sequence += 1
                        at += capacity
                    while at < n:
                        m = min(PIECE, n - at)
                        rests.append((i, at, m, raw[4 * at : 4 * (at + m)], n))
                        at, total = at + m, total + m
                    if total >= (GROUP - 1) * capacity and SPARE[0] <= -total % capacity <= SPARE[1] or total >= 2 * GROUP * capacity:
                        close()
                if out:
                    yield ready()
        if rests:
            close()
        if out:
            yield ready()

    return df.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInArrow(run, f"`{id_col}` {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
