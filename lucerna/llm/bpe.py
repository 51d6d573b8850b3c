"""Byte-level BPE encoding and decoding in two tiers.

A text is cut into pre-tokens by the tokenizer's pattern.  Tier one is a
minimal perfect hash over the vocabulary: a pre-token that is itself a token
resolves to its rank in one probe.  Tier two, for the rest, merges bytes held in
a doubly linked list, taking the lowest-ranked adjacent pair from a heap.

Encoded units are remembered in a bounded per-worker table, so both tiers run
once per distinct unit rather than once per occurrence.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from lucerna.llm.common import texts_of

#: Entries that a worker remembers at most (about 100 MB); beyond it the table starts anew.
REMEMBERED = 500_000


class PerfectHash:
    """Minimal perfect hash by displacement: n keys, n slots, one probe.

    A key's 64-bit hash picks a bucket; the bucket's displacement re-seeds the
    hash so that all its keys fall on free slots.  Buckets of one key name their
    slot outright.  A probe is exact because the slot's key is compared.
    """

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.nb = max(1, n // 2)
        self.disp = np.zeros(self.nb, np.int64)
        self.slot_of_key = np.zeros(n, np.int64)
        hashes = np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), np.uint64, n)
        buckets: dict[int, list[int]] = {}
        for i, b in enumerate((hashes % np.uint64(self.nb)).tolist()):
            buckets.setdefault(b, []).append(i)
        taken, values = bytearray(n), hashes.tolist()
        free = iter(range(n))
        for b, members in sorted(buckets.items(), key=lambda x: -len(x[1])):
            if len(members) == 1:
                slot = next(s for s in free if not taken[s])
                taken[slot] = 1
                self.slot_of_key[members[0]] = slot
                self.disp[b] = -slot - 1
                continue
            d = 0
            while True:
                slots = [self._mix(values[i], d) % n for i in members]
                if len(set(slots)) == len(slots) and not any(taken[s] for s in slots):
                    break
                d += 1
            for i, s in zip(members, slots):
                taken[s] = 1
                self.slot_of_key[i] = s
            self.disp[b] = d
        self.keys: list[bytes] = [b""] * n
        self.values = np.zeros(n, np.int64)
        for i, s in enumerate(self.slot_of_key.tolist()):
            self.keys[s] = keys[i]
            self.values[s] = i

    @staticmethod
    def _mix(h: int, d: int) -> int:
        h = (h ^ (d * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
        h = (h ^ (h >> 31)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
        return h ^ (h >> 29)

    def find(self, keys: list[bytes]) -> list[int]:
        """For each key its index in the list given at the start, or -1."""
        if not keys or not self.n:
            return [-1] * len(keys)
        h = np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), np.uint64, len(keys))
        d = self.disp[(h % np.uint64(self.nb)).astype(np.int64)]
        with np.errstate(over="ignore"):
            x = h ^ (np.maximum(d, 0).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(29)
        slots = np.where(d < 0, -d - 1, (x % np.uint64(self.n)).astype(np.int64)).tolist()
        own, values = self.keys, self.values.tolist() if len(keys) > 1000 else self.values
        return [int(values[s]) if own[s] == k else -1 for k, s in zip(keys, slots)]


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Lowest-rank-first merging, leftmost on ties: a heap of pairs over linked bytes."""
    n = len(piece)
    part = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    get = ranks.get
    of = [get(piece[i : i + 2], -1) for i in range(n - 1)] + [-1]
    heap = [r << 32 | i for i, r in enumerate(of) if r >= 0]
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        x = pop(heap)
        i = x & 0xFFFFFFFF
        if of[i] != x >> 32:
            continue
        j = after[i]
        part[i] += part[j]
        of[j] = -1
        k = after[i] = after[j]
        of[i] = -1
        if k < n:
            before[k] = i
            r = get(part[i] + part[k], -1)
            if r >= 0:
                of[i] = r
                push(heap, r << 32 | i)
        h = before[i]
        if h >= 0:
            r = of[h] = get(part[h] + part[i], -1)
            if r >= 0:
                push(heap, r << 32 | h)
    out, i = [], 0
    while i < n:
        out.append(ranks[part[i]])
        i = after[i]
    return out


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, in rank order."""
    with open(path, "rb") as lines:
        pairs = [x.split() for x in lines if x.strip()]
    tokens = [b""] * (max(int(r) for _, r in pairs) + 1)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


#: A space with another white space beside it: there the text isn't cut into units.
_WIDE = re.compile(r" (?=\s)")
_WIDE_BEFORE = re.compile(r"\s ")


def units_of(text: str) -> list[str] | None:
    """The text cut before each space, where that is surely a pre-token boundary.

    A single space between two characters that aren't white space always starts
    a pre-token, whatever stands around it.  None where some space has white
    space beside it or stands at an end of the text.
    """
    if not text or text[0] == " " or text[-1] == " " or _WIDE.search(text) or _WIDE_BEFORE.search(text):
        return None
    first, *rest = text.split(" ")
    return [first, *[" " + x for x in rest]]


class Codec:
    """Encoder and decoder over one vocabulary."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.pattern = tokens, regex.compile(pattern)
        self.ranks = {t: i for i, t in enumerate(tokens) if t}
        known = list(self.ranks)
        self.exact, self.id_of = PerfectHash(known), [self.ranks[k] for k in known]
        self.units: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _resolve(self, pieces: list[str]) -> None:
        """Puts distinct pre-tokens into the table of pieces."""
        raw = [p.encode() for p in pieces]
        for p, b, at in zip(pieces, raw, self.exact.find(raw)):
            ids = [self.id_of[at]] if at >= 0 else merge_bytes(b, self.ranks)
            self.pieces[p] = np.array(ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        if len(self.units) > REMEMBERED:
            self.units.clear()
        if len(self.pieces) > REMEMBERED:
            self.pieces.clear()
        cut = [units_of(t) or [t] for t in texts]
        units, pieces, find = self.units, self.pieces, self.pattern.findall
        new = [u for u in {u for c in cut for u in c} if u not in units]
        split = [find(u) for u in new]
        self._resolve([p for p in {p for s in split for p in s} if p not in pieces])
        get = pieces.__getitem__
        for u, s in zip(new, split):
            units[u] = b"".join(map(get, s))
        get = units.__getitem__
        out = [b"".join(map(get, c)) for c in cut]
        for c in cut:
            if len(c) == 1 and len(c[0]) > 200:
                units.pop(c[0], None)
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[tuple, Codec] = {}


def codec(key: tuple, tokens: list[bytes], pattern: str) -> Codec:
    """One codec for each vocabulary in a worker process."""
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(tokens, pattern)
    return _CODECS[key]


def slices(batch: pa.RecordBatch, text: str, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``size`` bytes of text each (one row at least)."""
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)))
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + size, "right")))
        yield batch.slice(at, to - at)
        at = to


def encode_decode(df: DataFrame, tokens: list[bytes], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes whole texts and decodes the ids again.

    Returns one row per input row: the id column, ``ids`` (binary, little-endian
    unsigned 32-bit) and ``decoded`` (binary).  A null text counts as empty: no
    ids, no bytes.  Repeated rows are encoded each; other columns are ignored.
    The vocabulary (a file of fixed size, read on the driver) is broadcast.
    """
    spark = df.sparkSession
    held = spark.sparkContext.broadcast(tokens)
    key = (len(tokens), xxhash.xxh64_intdigest(b"\0".join(tokens)), pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(key, held.value, pattern)
        for whole in batches:
            for b in slices(whole, "text"):
                ids = c.encode(texts_of(b.column("text")))
                yield pa.record_batch([b.column("id"), pa.array(ids, pa.binary()), pa.array(map(c.decode, ids), pa.binary())], names=[id_col, "ids", "decoded"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInArrow(run, f"`{id_col}` {kind}, ids binary, decoded binary")
