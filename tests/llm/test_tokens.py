from __future__ import annotations

import base64
import random

import numpy as np
import public_tokenizers
import pytest

from lucerna.llm import bpe, packing

TEXTS = ["", "the", "  two  spaces \n\n end ", "Étion dans l'été 12345 !!!", "a" * 500, "日本語 text​ 🙂🙂", "x<|endoftext|>y", "don't I'LL\t\tgo\x1c.", " lead", "trail ", "\n", "a \nb", "naïve  space"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "extra") for i, t in enumerate(TEXTS)] + [(90, None, None), (91, "copy of a row", "x"), (91, "copy of a row", "x"), (92, "word " * 3000, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")


def test_perfect_hash_is_minimal_and_exact():
    keys = [str(i).encode() for i in range(5000)]
    h = bpe.PerfectHash(keys)
    assert h.find(keys) == list(range(5000)) and sorted(h.slot_of_key.tolist()) == list(range(5000))
    assert h.find([b"no", b""]) == [-1, -1]


def test_encoding_matches_the_library(docs):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = bpe.encode_decode(docs, bpe.read_ranks(path), public_tokenizers.PATTERN).collect()
    assert len(out) == docs.count()
    by_id = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in out:
        assert np.frombuffer(r["ids"], "<u4").tolist() == want.encode_ordinary(by_id[r["doc_id"]])
        assert bytes(r["decoded"]).decode() == by_id[r["doc_id"]]


def test_merging_takes_the_lowest_rank_leftmost():
    ranks = {b"a": 0, b"b": 1, b"aa": 2, b"ab": 3, b"aab": 4}
    assert bpe.merge_bytes(b"aaab", ranks) == [2, 3]
    assert bpe.merge_bytes(b"", ranks) == [] and bpe.merge_bytes(b"a", ranks) == [0]


def test_packing_is_whole_gapless_and_tight(docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    single = docs.where("doc_id <> 91").coalesce(1)
    rows = packing.pack(single, path, public_tokenizers.PATTERN).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in single.collect()}
    found: dict = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        own = found.setdefault(r["doc_id"], [])
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert r["start"] == len(own) and r["length"] == len(ids) > 0
        own += ids
    for i, text in texts.items():
        want = t.encode(text, add_special_tokens=False).ids + [0]
        assert found[i] == want and all(r["doc_tokens"] == len(want) for r in rows if r["doc_id"] == i)
    by: dict = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert len(packing.pack(docs, path, public_tokenizers.PATTERN).where("doc_id = 91").collect()) == 2
    assert packing.pack(docs.limit(0), path, public_tokenizers.PATTERN).count() == 0


def test_differencing_balances():
    rng = random.Random(5)
    sizes = [rng.randint(1, 256) for _ in range(400)]
    parts = packing.difference(sizes, 40)
    assert sorted(i for p in parts for i in p) == list(range(400))
    sums = [sum(sizes[i] for i in p) for p in parts]
    assert max(sums) - min(sums) <= 8
    w = packing.windows(sizes)
    assert max(sum(sizes[i] for i in p) for p in w) <= 1024 and len(w) <= sum(sizes) / 1024 * 1.03 + 1
