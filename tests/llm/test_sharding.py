from __future__ import annotations

import math
import struct
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from lucerna.llm import sharding
from lucerna.llm.common import Scratch

SCHEMA = "doc_id long, text string, shard string, _TASK int"


def _shard(key, weights):
    best = None
    for s, w in enumerate(weights):
        if w > 0:
            seed = 42 if key is None else xxhash.xxh64_intdigest(str(key).encode(), 42)
            u = ((xxhash.xxh64_intdigest(struct.pack("<i", s), seed) >> 12) + 0.5) / 2**52
            best = max(best or (0, 0), (w / -math.log(u), s))
    return best[1]


@pytest.fixture(scope="module")
def rows():
    out = [(i, f"text {i % 50} " * (i % 9), "x", 1) for i in range(3000)]
    return out + [(None, "no id", "x", 1)] * 40 + [(None, f"{i}", "x", 1) for i in range(40)] + [(5, "again", "x", 1)] * 300 + [(6, None, None, None), (7, "", "x", 1), (8, "é🙂" * 20_000, "x", 1)]


def test_places_equal_brute_force(spark, rows):
    out = sharding.place(spark.createDataFrame(rows, SCHEMA).repartition(5), Scratch(spark, "test")).collect()
    want = sorted((i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "key", _shard(i, [1.0] * 16), _shard(i, [1.0] * 17)) for i, t, *_ in rows)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) for r in out) == want
    for s in range(16):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))


def test_a_new_shard_takes_rows_only_into_itself_and_few(spark):
    ids = spark.range(20_000).select(*(sharding.rendezvous(F.col("id"), w).alias(f"s{k}") for k, w in enumerate(([1.0] * 16, [1.0] * 17, [1.0] * 15 + [0.0], [1.0, 3.0, 0.0, 2.0])))).collect()
    moved = [r for r in ids if r["s0"] != r["s1"]]
    assert all(r["s1"] == 16 for r in moved) and abs(len(moved) - 20_000 / 17) < 150
    assert all(r["s0"] == 15 or r["s0"] == r["s2"] for r in ids) and all(r["s2"] < 15 for r in ids)
    shares = [sum(r["s3"] == s for r in ids) / 20_000 for s in range(4)]
    assert shares[2] == 0 and all(abs(a - b) < 0.015 for a, b in zip(shares, (1 / 6, 1 / 2, 0, 1 / 3)))


def test_an_id_keeps_its_shard_when_its_type_changes(spark):
    ids = spark.range(500).select(sharding.rendezvous(F.col("id"), [1.0] * 16).alias("a"), sharding.rendezvous(F.col("id").cast("int"), [1.0] * 16).alias("b"), sharding.rendezvous(F.col("id").cast("string"), [1.0] * 16).alias("c"))
    assert ids.where("a <> b OR a <> c").count() == 0


def test_edges(spark, tmp_path):
    assert sharding.place(spark.createDataFrame([], SCHEMA), Scratch(spark, "test")).count() == 0
    for bad in ([], [0.0], [1.0, -1.0]):
        with pytest.raises(ValueError):
            sharding.rendezvous(F.lit(1), bad)
    docs = spark.createDataFrame([(i, "t", "mine", 1) for i in range(100)], SCHEMA)
    sharding.write(docs, f"{tmp_path}/out", [1.0] * 4, files=2)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 100 and back.where("shard = 'mine'").count() == 100 and set(back.columns) == {*docs.columns, "shard_"}
    assert all(r["shard_"] == _shard(r["doc_id"], [1.0] * 4) for r in back.collect())
