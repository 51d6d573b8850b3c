"""Sharding by rendezvous hashing of stable record keys over weighted shards.

A shard's score for a key is its weight over the negated logarithm of a uniform
hash of key and shard; the best score takes the row.  A shard that is added
changes no other score, so it takes rows only into itself; one that is removed
gives up its own rows only, and rows move in proportion to the weights.

Everything is built-in column work: the scan computes shards, one shuffle of
narrow rows numbers them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lucerna.llm.common import Scratch, fresh

SHARDS = 16


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard, 0 to len(weights) - 1, of each key; shards of weight zero take nothing.

    The key counts as text, so that an id keeps its shard when its column changes
    type.  A null key is a key like any other: all such rows share a shard.
    """
    if not any(w > 0 for w in weights) or any(w < 0 for w in weights):
        raise ValueError("weights must not be negative, and one must be positive")
    text, scores = key.cast("string"), []
    for s, w in enumerate(weights):
        if w > 0:
            # 52 bits and a half: strictly between 0 and 1, and exact in a double
            uniform = (F.shiftrightunsigned(F.xxhash64(text, F.lit(s)), 12) + F.lit(0.5)) / F.lit(float(1 << 52))
            scores.append(F.struct((F.lit(float(w)) / -F.log(uniform)).alias("score"), F.lit(s).alias("shard")))
    return F.array_max(F.array(*scores)).getField("shard")


def place(df: DataFrame, scratch: Scratch, weights: Sequence[float] = (1.0,) * SHARDS, added: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's shard, its place there, and its shard if one more of weight ``added`` came.

    Returns one row per input row: the id column, size (UTF-8 bytes of the text
    and one; a null text has none), text_crc32 (of those bytes; null: 0), law
    (``key``: key and weights alone decide, so copies of a text may lie apart),
    shard, slot (gapless from 0 in each shard), grown_shard.  Rows that repeat lie
    in one shard and have a slot each; so do rows without an id.  An empty table
    gives no rows, other columns are ignored.

    Slots are numbered by scan task and the row's place in it, from counts per
    task and shard, so that no task holds a shard; the rows are saved once before,
    which fixes their places however often tasks run again.
    """
    text, key = F.col(text_col).cast("string"), F.col(id_col)
    row = df.select(
        key,
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        rendezvous(key, weights).alias("shard"),
        rendezvous(key, [*weights, added]).alias("grown_shard"),
        F.spark_partition_id().alias("_task"),
        F.monotonically_increasing_id().alias("_at"),
    )
    rows = scratch.save(row, "placed")
    counts = rows.groupBy("_task", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_task", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    place_ = F.row_number().over(Window.partitionBy("_task", "shard").orderBy("_at")) - 1
    out = rows.join(offsets, ["_task", "shard"]).withColumn("slot", (F.col("_before") + place_).cast("long"))
    return out.select(id_col, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write(df: DataFrame, path: str, weights: Sequence[float] = (1.0,) * SHARDS, id_col: str = "doc_id", files: int = 1, mode: str = "errorifexists") -> None:
    """Writes whole rows as Parquet, a folder per shard, each dealt to about ``files`` files.

    The folders carry a column ``shard``, with underscores added if the table has one of that name.
    """
    (shard, part) = fresh(df, "shard", "part")
    dealt = df.withColumn(shard, rendezvous(F.col(id_col), weights)).withColumn(part, F.pmod(F.monotonically_increasing_id(), F.lit(files)))
    dealt.repartition(len(weights) * files, shard, part).drop(part).write.mode(mode).partitionBy(shard).parquet(path)
