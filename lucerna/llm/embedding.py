"""Embedding near-duplicates: sign hashing in several tables, exact cosines, connected components.

Each table cuts space by random hyperplanes; vectors on the same side of all of
a table's planes share a bucket and are compared exactly, in double precision.
A bucket with more vectors than a tile holds is split, and its tiles meet each
other.  A pair that shares several buckets counts in the first table alone, so
links are counted without listing pairs: a tile hands on each vector's number of
links and a spanning forest.  Equal vectors are one class, compared once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucerna.llm.common import Scratch
from lucerna.llm.components import Forest, components, hang
from lucerna.llm.tiles import TILE, runs

COSINE = 0.95
#: Hyperplanes of a table: at least, and at most.
BITS = (12, 20)
#: The share of pairs at the least cosine that no table may bring together.
MISSED = 0.0015


def layout(n: int, least: float = COSINE, missed: float = MISSED) -> tuple[int, int]:
    """(tables, hyperplanes of each) for n vectors.

    There are so many hyperplanes that 2^bits buckets hold about 16 unlike vectors
    each, within BITS, and then as many tables as the recall asks for: at cosine
    0.95, 20 tables of 12 up to 65,536 vectors, 52 of 20 from some 17 million on;
    a pair at that cosine is found with probability 0.9985 in either case.
    """
    bits = min(BITS[1], max(BITS[0], math.ceil(math.log2(max(1, n) / 16))))
    same = 1 - math.acos(min(1.0, least)) / math.pi
    return max(1, math.ceil(math.log(missed) / math.log1p(-(same**bits)))) if same < 1 else 1, bits


def finite(v: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    return F.coalesce(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of a list column: for each length, the rows that have it and their values as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lens = np.asarray(column.value_lengths())
    flat, ends = np.asarray(column.flatten()).astype(np.float64), np.cumsum(lens)
    out = []
    for d in np.unique(lens).tolist():
        at = np.flatnonzero(lens == d)
        out.append((at, flat[(ends[at] - d)[:, None] + np.arange(d)]))
    return out


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, safely for very large and very small components."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def codes(v: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """The bucket of each vector in each table, (n, tables)."""
    planes = np.random.default_rng(97 + v.shape[1]).standard_normal((v.shape[1], tables * bits))
    side = (v @ planes > 0).reshape(len(v), tables, bits)
    return (side @ (1 << np.arange(bits))).astype(np.int32)


def bucket_keys(c: np.ndarray, dim: int) -> np.ndarray:
    """Length (12 bits), table (7) and bucket (20) in one number, (n, tables)."""
    return (((dim & 0xFFF) << 7) + np.arange(c.shape[1]) << 20) + c


#: Overfull buckets that are told to every task; more of them travel to the rows by a join.
TOLD = 100_000


def compare(bucket: int, ids: np.ndarray, mult: np.ndarray, code: np.ndarray, v: np.ndarray, left: np.ndarray | None, least: float):
    """Links of a tile that no earlier table has: (ids, their numbers of linked vectors), spanning edges.

    Between ``left`` and the other rows; within all rows if it is None.
    """
    table_no = (bucket >> 20) & 127
    u = unit(v)
    within = left is None
    a = np.arange(len(ids)) if within else np.flatnonzero(left)
    b = a if within else np.flatnonzero(~left)
    forest, found = Forest(len(ids)), np.zeros(len(ids), np.int64)
    step = max(1, (1 << 19) // max(1, len(b)))
    for at in range(0, len(a), step):
        i, j = np.nonzero(u[a[at : at + step]] @ u[b].T >= least)
        i, j = a[at + i], b[j]
        new = i != j
        for t in range(table_no):
            new &= code[i, t] != code[j, t]
        i, j = i[new], j[new]
        found += np.bincount(i, mult[j], len(ids)).astype(np.int64)
        if not within:
            found += np.bincount(j, mult[i], len(ids)).astype(np.int64)
        forest.link(i, j)
    some = np.flatnonzero(found)
    i, j = forest.edges()
    return (ids[some], found[some]), (ids[i], ids[j])


def near_duplicates(df: DataFrame, scratch: Scratch, id_col: str = "vec_id", vec_col: str = "embedding", least: float = COSINE) -> DataFrame:
    """(id, n_links, component_id, kept) per row.

    Vectors that are null, zero or hold null or non-finite components link with
    nothing and are their own component; so are vectors of another length to
    each other.  Equal vectors link with each other (cosine one).  Ids are
    integers; ties go to the least id; an empty table gives no rows; other
    columns are ignored.  An id that stands for several vectors is as many rows,
    each with the links of its own vector, and they link only if those do; rows
    without an id link with nothing.
    """
    v = F.col(vec_col)
    sound = finite(v) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.when(sound, v).alias("v"))
    rows = rows.select("id", "v", F.when(F.col("v").isNotNull(), F.xxhash64("v")).alias("h1"), F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(1), "v")).alias("h2"))
    classes = rows.where("v IS NOT NULL AND id IS NOT NULL").groupBy("h1", "h2").agg(F.min("id").alias("least"), F.count("*").alias("mult"), F.first("v").alias("v"))
    # a class has a number of its own: several may stand under one id
    classes = scratch.save(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    tables, bits = layout(classes.count(), least)

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x in matrix(b.column("v")):
                yield pa.record_batch([pa.array(bucket_keys(codes(x, tables, bits), x.shape[1]).ravel())], names=["bucket"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                b = whole.slice(start, 1000)
                for at, x in matrix(b.column("v")):
                    c = codes(x, tables, bits)
                    row = np.repeat(np.arange(len(c)), tables)
                    take = pa.array(at[row])
                    raw = pa.array([c[i].tobytes() for i in range(len(c))], pa.binary()).take(pa.array(row))
                    yield pa.record_batch([pa.array(bucket_keys(c, x.shape[1]).ravel()), b.column("rep").take(take), b.column("mult").take(take), raw, b.column("v").take(take)], names=["bucket", "id", "mult", "codes", "v"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], []]

        def ready() -> pa.RecordBatch:
            out = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in held]
            for x in held:
                x.clear()
            return pa.record_batch([pa.array(x) for x in out], names=["a", "b", "n"])

        for t in runs(batches, ["bucket", "tile"]):
            if t.num_rows < 2:
                continue
            bucket, tile = t.column("bucket")[0].as_py(), t.column("tile")[0].as_py()
            every, side, codes_of = t.column("id").to_numpy(), t.column("side").to_numpy(), np.frombuffer(b"".join(t.column("codes").to_pylist()), np.int32).reshape(-1, tables)
            # lengths that agree in their last 12 bits share buckets, no links
            for at, v in matrix(t.column("v")):
                left = side[at] == 0 if tile >> 24 != tile & 0xFFFFFF else None
                (some, n), (a, b) = compare(bucket, every[at], t.column("mult").to_numpy()[at], codes_of[at], v, left, least)
                held[0] += [some, a]
                held[1] += [np.full(len(some), -1), b]
                held[2] += [n, np.zeros(len(a), np.int64)]
            if sum(map(len, held[0])) > 100_000:
                yield ready()
        if held[0]:
            yield ready()

    kind = df.schema[vec_col].dataType.simpleString()
    # an overfull bucket is split by a hash of the class, and its parts meet each other
    wide = classes.select("v").mapInArrow(buckets, "bucket long").groupBy(F.col("bucket").alias("_b")).agg(F.count("*").alias("_n")).where(F.col("_n") > TILE)
    wide = scratch.save(wide, "wide")
    wide = F.broadcast(wide) if wide.count() <= TOLD else wide
    dealt = classes.select("rep", "mult", "v").mapInArrow(deal, f"bucket long, id long, mult long, codes binary, v {kind}").join(wide, F.col("bucket") == F.col("_b"), "left")
    dealt = dealt.withColumn("_k", F.coalesce(F.ceil(F.col("_n") / TILE), F.lit(1)).cast("long")).withColumn("_s", F.pmod(F.xxhash64("id"), F.col("_k")))
    dealt = dealt.withColumn("_t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1)))
    low = F.least("_s", "_t")
    dealt = dealt.select("bucket", F.shiftleft(low, 24).bitwiseOR(F.greatest("_s", "_t")).alias("tile"), (F.col("_s") != low).cast("int").alias("side"), "id", "mult", "codes", "v")
    dealt = dealt.repartition("bucket", "tile").sortWithinPartitions("bucket", "tile")
    found = scratch.save(dealt.mapInArrow(link, "a long, b long, n long"), "links")
    counts = found.where("n > 0").groupBy(F.col("a").alias("_c")).agg(F.sum("n").alias("links"))
    roots = components(found.where("n = 0").select("a", "b"), scratch)
    # a component goes by the least id of its classes
    rooted = scratch.save(classes.drop("v").join(roots, F.col("rep") == F.col("node"), "left").select("rep", "h1", "h2", "mult", "least", F.coalesce("root", "rep").alias("root")), "rooted")
    answer = hang(rooted, rooted.groupBy(F.col("root").alias("node")).agg(F.min("least").alias("m")), "root").join(counts, F.col("rep") == F.col("_c"), "left")
    answer = answer.select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.col("m").alias("root"))
    out = rows.drop("v").join(answer, F.col("id").isNotNull() & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")), "left")
    root = F.coalesce("root", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), (root == F.col("id")).alias("kept"))
