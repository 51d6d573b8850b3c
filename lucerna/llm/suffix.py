"""Exact substring deduplication: suffixes to a fixed depth, one bucket at a time.

A byte goes if it lies in a string of ``depth`` bytes that also starts elsewhere.
So suffixes matter to that depth only, and a suffix's rank is the rank of its
first ``depth`` bytes.  Three steps find the suffixes whose rank repeats:

1.  Equal texts are one class (by SHA-256); a repeated class goes whole.
2.  Of each distinct text the anchors are listed: the k-grams that are the least,
    by hash, of some window of ``depth`` bytes.  Equal windows have equal anchors,
    so a window whose anchor occurs once in the corpus can't repeat.
3.  The suffixes that are left get a rolling 64-bit rank.  Ranks are dealt into
    suffix buckets by value; a bucket is sorted on its own, and tells each chunk
    of texts which of its ranks occur elsewhere, one bit each.  A chunk sends a
    rank once, however often it holds it, so no bucket is swamped by a common
    passage.

Memory is bounded by a chunk (some MB of text) and by a bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.llm import repeats
from lucerna.llm.bpe import slices
from lucerna.llm.common import Scratch, bytes_of, fresh

DEPTH, GRAM = 400, 32
#: Bytes of text in a chunk, and ranks in a bucket, about.
CHUNK, BUCKET = 2 << 20, 2 << 20
_BASE = 0x5851F42D4C957F2D
_LETTER = np.random.default_rng(1729).integers(1, 1 << 63, 256, dtype=np.uint64)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def rolling(text: bytes, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """For each size, a 64-bit polynomial rank of every substring of that many bytes."""
    h, n, level = _LETTER[np.frombuffer(text, np.uint8)], len(text), {}
    width = 1
    while True:
        level[width] = h
        if 2 * width > max(sizes):
            break
        h = h[: max(0, n - 2 * width + 1)] * _power(width) + h[width : max(width, n - width + 1)]
        width *= 2
    out = []
    for size in sizes:
        count, at, acc = n - size + 1, 0, None
        if count <= 0:
            out.append(np.zeros(0, np.uint64))
            continue
        for w in sorted(level, reverse=True):
            if size & w:
                part = level[w][at : at + count]
                acc = part if acc is None else acc * _power(w) + part
                at += w
        out.append(acc)
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """The least (or greatest) of every ``width`` neighbours."""
    pick = np.minimum if least else np.maximum
    if len(x) < width:
        return x[:0]
    done = 1
    n, out = len(x) - width + 1, x
    while 2 * done <= width:
        out = pick(out[:-done], out[done:])
        done *= 2
    return pick(out[:n], out[width - done : width - done + n]) if done < width else out


def least_grams(grams: np.ndarray, depth: int) -> np.ndarray:
    """For each window of ``depth`` bytes the least of its k-grams."""
    return sliding(grams, depth - GRAM + 1, True)


def anchors(text: bytes, depth: int = DEPTH) -> np.ndarray:
    """The k-grams of a text, one for each place, that are the least of some window."""
    if len(text) < depth:
        return np.zeros(0, np.uint64)
    g = mixed(rolling(text, (GRAM,))[0])
    low = least_grams(g, depth)
    pad = np.zeros(depth - GRAM, np.uint64)
    return g[g == sliding(np.concatenate([pad, low, pad]), depth - GRAM + 1, False)]


def suspects(text: bytes, repeated: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows whose anchor is in ``repeated`` (sorted), and their ranks."""
    g, ranks = rolling(text, (GRAM, depth))
    low = least_grams(mixed(g), depth)
    at = np.flatnonzero(np.isin(low, repeated))
    return at, mixed(ranks[at])


def spans(starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by windows at sorted starts."""
    if not len(starts):
        return starts, starts
    cut = np.flatnonzero(np.diff(starts) > depth)
    return starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)] + depth


def kept(text: bytes, begin: list[int], end: list[int]) -> bytes:
    out, at = [], 0
    for b, e in zip(begin, end):
        out.append(text[at:b])
        at = e
    return b"".join([*out, text[at:]])


def chunk_ranks(texts: list[bytes], repeated: list[np.ndarray], depth: int):
    """Each text's suspect starts, all ranks in order, and the distinct ones with their places and counts."""
    found = [suspects(t, r, depth) for t, r in zip(texts, repeated)]
    ranks = np.concatenate([r for _, r in found]) if found else np.zeros(0, np.uint64)
    return [s for s, _ in found], *np.unique(ranks, return_inverse=True, return_counts=True)


def _decoded(row: dict) -> tuple[list[bytes], list[np.ndarray]]:
    return row["texts"], [np.frombuffer(a, np.uint64) for a in row["anchors"]]


def repeated_spans(df: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """(id, n_bytes, begins, ends, kept_sha256, digest) per row: the removed byte runs of the whole text, and its SHA-256.

    A null or empty text, or one shorter than ``depth`` bytes, loses nothing.
    Matches never cross texts; the same text may hold both.  Repeated rows are
    copies of each other and go whole if they are long enough.  Ids may be null
    or repeat; an empty table gives no rows; other columns are ignored.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                texts = bytes_of(b.column("text"))
                found = [pa.array(anchors(t, depth).view(np.int64)) for t in texts]
                ends = np.append(0, np.cumsum([len(a) for a in found])).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.concat_arrays(found))
                digests = [hashlib.sha256(t).digest() for t in texts]
                part = np.frombuffer(b"".join(digests), np.int64)[::4]
                yield pa.record_batch([b.column("id"), pa.array(digests, pa.binary()), pa.array(part), pa.array([len(t) for t in texts], pa.int64()), lists], names=["id", "digest", "part", "n_bytes", "anchors"])

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    of = scratch.save(source.mapInArrow(scan, f"id {kind}, digest binary, part long, n_bytes long, anchors array<long>"), "texts")
    first = [F.first(c).alias(c) for c in ("part", "n_bytes", "anchors")]
    classes = scratch.save(of.groupBy("digest").agg(F.count("*").alias("copies"), F.min("id").alias("_id"), *first), "classes")
    # classes that share 64 bits of their digests share what is wanted of them: too much, never too little
    listed = classes.select("part", F.explode("anchors").alias("anchor"))
    often = listed.groupBy("anchor").count().where("count > 1").select(F.col("anchor").alias("_a"), F.xxhash64("anchor").alias("_g"))
    hit = listed.withColumn("_h", F.xxhash64("anchor")).join(often, (F.col("_h") == F.col("_g")) & (F.col("anchor") == F.col("_a")))
    wanted = hit.groupBy(F.col("part").alias("_p")).agg(F.collect_set("anchor").alias("anchors"))

    # one text of each wanted class: the least row of those that hold it
    digest = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    wanted = classes.drop("anchors").join(wanted, F.col("part") == F.col("_p")).select(F.col("digest").alias("_d"), "_id", "anchors")
    texts = source.where(F.octet_length("text") >= depth).withColumn("digest", digest)
    texts = texts.join(wanted, (F.col("digest") == F.col("_d")) & F.col("id").eqNullSafe(F.col("_id"))).select("digest", "text", "anchors")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        seen: set[bytes] = set()
        for whole in batches:
            for b in slices(whole, "text", CHUNK):
                digests = b.column("digest").to_pylist()
                new = [i for i, d in enumerate(digests) if d not in seen]
                seen = set(digests)
                texts, lists = bytes_of(b.column("text")), b.column("anchors").to_pylist()
                lists = [np.sort(np.array(x, np.int64).view(np.uint64)) for x in lists]
                row = [[number], [[digests[i] for i in new]], [[texts[i] for i in new]], [[lists[i].tobytes() for i in new]], [sum(len(texts[i]) for i in new)]]
                number += 1
                kinds = [pa.int64(), *[pa.list_(pa.binary())] * 3, pa.int64()]
                yield pa.record_batch([pa.array(v, k) for v, k in zip(row, kinds)], names=["chunk", "digests", "texts", "anchors", "size"])

    chunks = scratch.save(texts.mapInArrow(bundle, "chunk long, digests array<binary>, texts array<binary>, anchors array<binary>, size long"), "chunks")
    total = chunks.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, -(-total // BUCKET))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for row in whole.to_pylist():
                _, ranks, _, counts = chunk_ranks(*_decoded(row), depth)
                yield repeats.question(row["chunk"], ranks, counts, buckets)

    told = repeats.told(chunks.mapInArrow(ask, "part long, chunk long, sent binary, twice binary"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for row in whole.to_pylist():
                texts, lists = _decoded(row)
                starts, ranks, place, _ = chunk_ranks(texts, lists, depth)
                again = repeats.heard(ranks, buckets, row["told"])
                again, at, out = again[place.ravel()], 0, [[], [], [], []]
                for d, text, s in zip(row["digests"], texts, starts):
                    b, e = spans(s[again[at : at + len(s)]], depth)
                    at += len(s)
                    if len(b):
                        out[0].append(d)
                        out[1].append(b.tolist())
                        out[2].append(e.tolist())
                        out[3].append(hashlib.sha256(kept(text, out[1][-1], out[2][-1])).hexdigest())
                kinds = [pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string()]
                yield pa.record_batch([pa.array(v, k) for v, k in zip(out, kinds)], names=["digest", "begins", "ends", "kept_sha256"])

    settled = chunks.select("chunk", "digests", "texts", "anchors").join(told, F.col("chunk") == F.col("_c"), "left").drop("_c")
    settled = settled.mapInArrow(settle, "digest binary, begins array<long>, ends array<long>, kept_sha256 string")
    # rows that repeat their id and text may lie in several chunks: one answer for each text
    settled = settled.dropDuplicates(["digest"])
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= depth)
    none = F.array().cast("array<long>")
    by_class = classes.join(settled, "digest", "left").select(
        F.col("digest").alias("_d"),
        F.xxhash64("digest").alias("_g"),
        F.when(whole, F.array(F.lit(0).cast("long"))).otherwise(F.coalesce("begins", none)).alias("begins"),
        F.when(whole, F.array("n_bytes")).otherwise(F.coalesce("ends", none)).alias("ends"),
        F.when(whole, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("digest")))).alias("kept_sha256"),
    )
    rows = of.select("id", "digest", "n_bytes").withColumn("_h", F.xxhash64("digest"))
    out = rows.join(by_class, (F.col("_h") == F.col("_g")) & (F.col("digest") == F.col("_d")))
    return out.select(F.col("id").alias(id_col), "n_bytes", "begins", "ends", "kept_sha256", "digest")


def cut(df: DataFrame, found: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with their texts less the removed runs.

    A row's runs are found by its text, so ids may be null, repeat, or stand for
    several texts, and every row is answered once.  A character of which a run
    takes some bytes goes whole.  Rows keep their columns, whatever their names.
    """
    digest, part, there, part_there, begins, ends = fresh(df, "digest", "part", "there", "part_there", "begins", "ends")
    some = found.where(F.size("begins") > 0).dropDuplicates(["digest"])
    some = some.select(F.col("digest").alias(there), F.xxhash64("digest").alias(part_there), F.col("begins").alias(begins), F.col("ends").alias(ends))
    rows = df.withColumn(digest, F.unhex(F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256)))
    rows = rows.withColumn(part, F.xxhash64(digest))
    joined = rows.join(some, (F.col(part) == F.col(part_there)) & (F.col(digest) == F.col(there)), "left").drop(digest, part, there, part_there)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text_col)
        for whole in batches:
            for b in slices(whole, text_col):
                texts, spans = b.column(at).to_pylist(), zip(b.column(len(names)).to_pylist(), b.column(len(names) + 1).to_pylist())
                for i, (s, e) in enumerate(spans):
                    if s:
                        texts[i] = kept(texts[i].encode(), s, e).decode("utf-8", "ignore")
                columns = [pa.array(texts, b.column(at).type) if i == at else b.column(i) for i in range(len(names))]
                yield pa.record_batch(columns, names=names)

    return joined.mapInArrow(run, df.schema)
