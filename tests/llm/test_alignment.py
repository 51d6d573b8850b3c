from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from lucerna.llm import alignment
from lucerna.llm.common import Scratch

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "   ", "\n", "\n\nx", " lead", "trail  ", "a  b   c\td", "line one\nline two\n\n  indented\r\n\tx\r y", "don't we'll I'M", "日本語のテキスト は 空白", "🙂🙂 emoji 🙂",
    "x<|endoftext|>y <s> </s> <unk> <0x41>", "under▁score ▁ x", "nb sp  em 　wide　", "\x1c x\x1fy \x85 z", "a᠎ b​ c﻿ d ᠎", "combining é ́x ﬁ Ⅷ ½", "a\x00b \x00", "don 't", "A" * 3000, "ab" * 700 + " " + "0123456789" * 90,
]
PATTERN = public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, n_a string, id string"


def _texts():
    rng = random.Random(8)
    alphabet = [*"abcXYZ .,'!\n\t", "the ", " of", "  ", "é", "ß", "日", "🙂", "\r\n", "12", " "]
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 200))) for _ in range(120)]


def _brute(rows):
    """Whole texts by the libraries, without segments."""
    from tokenizers import Tokenizer

    t, whole = alignment.loaded(A, PATTERN, B), Tokenizer.from_file(A)
    whole.encode_special_tokens = True
    held, links, out = Counter(), [], []
    for i, text, *_ in rows:
        a = whole.encode(" " + text, add_special_tokens=False).ids if text else []
        b = t.b.encode(text) if text else []
        raw = (" " + text).encode() if text else b""
        if not text or b"".join(t.bytes_a[x] for x in a) != raw or b"".join(t.bytes_b[x] for x in b) != raw:
            links.append(Counter())
            out.append((i, 0, 0, 0, 0, ""))
            continue
        own = {}
        for side, ids, table in (("a", a, t.bytes_a), ("b", b, t.bytes_b)):
            at, ends = 0, []
            for x in ids:
                at += len(table[x])
                ends.append(at)
            own[side] = list(zip(ids, ends))
        cuts = sorted({e for _, e in own["a"]} & {e for _, e in own["b"]})
        told, pairs, before = [], Counter(), 0
        for c in cuts:
            left, right = ([x for x, e in own[s] if before < e <= c] for s in "ab")
            told.append(",".join(map(str, left)) + "|" + ",".join(map(str, right)))
            pairs.update((x, y) for x in left for y in right)
            before = c
        held.update(set(pairs))
        links.append(pairs)
        out.append((i, len(a), len(b), len(cuts), sum(pairs.values()), hashlib.sha256(";".join(told).encode()).hexdigest()))
    best = Counter()
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    return sorted((*o[:5], sum(n for p, n in pairs.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in pairs.items()), o[5]) for o, pairs in zip(out, links)), held


@pytest.mark.parametrize("chunk_chars", [400, 8 << 20])
def test_documents_and_pairs_equal_whole_texts_by_the_libraries(spark, chunk_chars):
    rows = [(i, t, "x", "y") for i, t in enumerate(_texts())]
    rows += [(7, rows[9][1], "copy", ""), (9, rows[9][1], "x", "y"), (9, rows[9][1], "x", "y")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out, pairs = alignment.cross_align(docs, A, PATTERN, B, Scratch(spark, "test"), chunk_chars=chunk_chars, block=500)
    want, held = _brute(rows)
    order = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert out.columns == order
    assert sorted(tuple(r[c] for c in order) for r in out.collect()) == want
    assert {(r["a"], r["b"]): r["count"] for r in pairs.collect()} == dict(held)


def test_edge_tables(spark):
    assert alignment.cross_align(spark.createDataFrame([], SCHEMA), A, PATTERN, B, Scratch(spark, "test"))[0].count() == 0
    rows = [(None, "no id here", None, None), (1, None, None, None), (2, "", None, None)]
    out = alignment.cross_align(spark.createDataFrame(rows, SCHEMA), A, PATTERN, B, Scratch(spark, "test"))[0].collect()
    assert sorted((r["doc_id"] or 0, r["n_groups"] > 0, r["groups_sha256"] != "") for r in out) == [(0, True, True), (1, False, False), (2, False, False)]


def test_segments_join_to_the_text_and_cuts_are_proved():
    t = alignment.loaded(A, PATTERN, B)
    assert " " in t.breaks and "\n" in t.breaks and "\r" not in t.breaks
    held = alignment.Segments(t.breaks)
    numbers = [held.numbers(text).tolist() if text else [] for text in _texts()]
    own = held.texts()
    for text, found in zip(_texts(), numbers):
        cut = [own[i] for i in found]
        assert not text or "".join(cut) == " " + text
        assert all(s[0] in t.breaks for s in cut) and all(not s[-1].isspace() for s in cut[:-1])
        assert not text or cut == held.cut.findall(" " + text)
    # an entry that spans the cut, or one that binds the space put in front, rules a character out
    assert alignment.breaks([b"a b"], [b"x"], [False]) == "\n\t\v\f\r" and alignment.breaks([b"a"], [b" \n", b"\n"], [False, True]) == " \t\v\f\r"


def test_groups_are_read_back(monkeypatch):
    t = alignment.loaded(A, PATTERN, B)
    groups = alignment.aligned([" aaaaabaaab", " 日本語のテキスト", " plain", "\nx", " ", " wor​d"], t)
    want = alignment.read_groups(groups, 60_000)
    assert want["n_links"].tolist() == [sum((g.split("|")[0].count(",") + 1) * (g.split("|")[1].count(",") + 1) for g in x.split(";")) for x in groups]
    monkeypatch.setattr(alignment, "WIDE", 0)
    found = alignment.read_groups(groups, 60_000)
    assert all(found[k].tolist() == want[k].tolist() for k in want)
    assert alignment.read_groups(["", "1|2", ""], 10)["n_a"].tolist() == [0, 1, 0] and alignment.read_groups(["", ""], 10)["n_pairs"].tolist() == [0, 0]
    numbers = np.array([0, 5, 70_000, 2**31 - 1], "<i4")
    assert alignment.unlaid(alignment.laid(numbers)).tolist() == numbers.tolist() and alignment.unlaid(b"").tolist() == []
