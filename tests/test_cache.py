"""Puts, their representatives and the postings that follow them, against the reference order of one put after the other."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lucerna.operators import cache, dedup, retrieval

SCHEMA = "seq long, url string, content string, cache_control string, note string"


def _sequential(puts, near, known=None):
    """One put after the other.  Returns decisions, entries and aliases."""
    entries, aliases = known or ({}, {})
    out = {}
    for seq, url, content, control, note in sorted(puts):
        if control and "no-store" in control.lower():
            continue
        canonical = url.split("?utm")[0].rstrip("/")
        origin = "/".join(canonical.split("/")[:3])
        signature = _signature(content) if near is not None else None
        to, rule = aliases.get(canonical), "alias"
        if to is None and content is not None:
            same = sorted(u for u, e in entries.items() if e[0] == content and u.startswith(origin + "/"))
            if same:
                to, rule = same[0], "identical"
            elif near is not None and signature:
                alike = [(-np.mean(np.array(e[2]) == np.array(signature)), u) for u, e in entries.items() if e[2] and u.startswith(origin + "/")]
                alike = sorted(x for x in alike if -x[0] >= near)
                if alike:
                    to, rule = alike[0][1], "near"
        if to is None:
            to, rule = canonical, "itself"
        aliases[canonical] = to
        entries[to] = (content, note, signature)
        out[seq] = (canonical, to, rule)
    return out, entries, aliases


_SIGNED: dict = {}


def _signature(content):
    import re

    if content not in _SIGNED:
        words = re.findall(r"[^\W_]+", (content or "").lower())
        shingles = list(dict.fromkeys(" ".join(words[i : i + 3]) for i in range(len(words) - 2)))
        _SIGNED[content] = dedup.signature(shingles) if shingles else None
    return _SIGNED[content]


def _texts(rng, n):
    words = ["w%d" % i for i in range(300)]
    out = []
    for _ in range(n):
        base = [rng.choice(words) for _ in range(120)]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            other = list(base)
            other[rng.randrange(len(other))] = rng.choice(words)
            out.append(" ".join(other))
    return out + ["too short", "", None]


def _puts(rng, texts, n, start, pages):
    rows = []
    for i in range(n):
        host, page = rng.choice(["a", "a", "b"]), rng.randrange(pages)
        tail = rng.choice(["", "?utm_source=x", "/"])
        rows.append((start + i, f"https://{host}.example/p/{page}{tail}", rng.choice(texts), rng.choice([None, "public", "public", "No-Store"]), f"n{start + i}"))
    return rows


@pytest.mark.parametrize(("near", "round_size", "pages"), [(None, 4096, 200), (None, 3, 12), (0.9, 4096, 60), (0.9, 5, 200)])
def test_batches_equal_one_put_after_the_other(spark, monkeypatch, near, round_size, pages):
    monkeypatch.setattr(cache, "ROUND", round_size)
    rng = random.Random(round_size + pages)
    texts = _texts(rng, 9)
    now, state = None, ({}, {})
    for start, n in ((0, 40), (100, 40)):
        rows = _puts(rng, texts, n, start, pages)
        puts = spark.createDataFrame(rows, SCHEMA).repartition(3)
        now, decisions, written = cache.put(now or cache.empty(puts), puts, near)
        want, *state = _sequential(rows, near, state)
        assert {r["seq"]: (r["canonical_url"], r["representative"], r["rule"]) for r in decisions.collect()} == want
        assert {r["canonical_url"]: (r["content"], r["note"]) for r in now.entries.collect()} == {u: e[:2] for u, e in state[0].items()}
        assert {r["alias"]: r["canonical_url"] for r in now.aliases.collect()} == state[1]
        assert {r["canonical_url"] for r in written.collect()} == {w[1] for w in want.values()}
    if near:
        signed = {u for u, e in state[0].items() if e[2]}
        assert now.index.count() == cache.BANDS * len(signed) and {r["canonical_url"] for r in now.index.select("canonical_url").collect()} == signed


@pytest.mark.parametrize("near", [None, 0.9])
def test_batches_with_pages_that_change_and_return_equal_one_put_after_the_other(spark, near):
    """Pages that were put before, that show several texts, nothing at first, or near copies of what others show."""
    rng = random.Random(8)
    texts, now, state = _texts(rng, 6), None, ({}, {})
    for start in (0, 1000, 2000):
        rows = _puts(rng, texts, 60, start, 25) + [(start + 500, "https://a.example/none", None, None, ""), (start + 501, "https://a.example/none", texts[0], None, "")]
        puts = spark.createDataFrame(rows, SCHEMA)
        now, decisions, _ = cache.put(now or cache.empty(puts), puts, near)
        want, *state = _sequential(rows, near, state)
        assert {r["seq"]: (r["canonical_url"], r["representative"], r["rule"]) for r in decisions.collect()} == want


@pytest.mark.parametrize("near", [None, 0.9])
def test_puts_of_known_pages_need_no_round(spark, monkeypatch, near):
    """However many known pages change their texts: where they go is known, and nobody asks for what they show."""
    page = lambda i, add: (add + i, f"https://a.example/{i}", f"a text of its own {i * i} {add} {i}", None, "")
    puts = spark.createDataFrame([page(i, 0) for i in range(20)], SCHEMA)
    now, _, _ = cache.put(cache.empty(puts), puts, near)
    monkeypatch.setattr(cache, "_round", lambda *a: pytest.fail("a round"))
    now, decisions, _ = cache.put(now, spark.createDataFrame([page(i, 100) for i in range(20)], SCHEMA), near)
    assert {(r["representative"], r["rule"]) for r in decisions.collect()} == {(f"https://a.example/{i}", "alias") for i in range(20)}
    assert {r["seq"] for r in now.entries.collect()} == set(range(100, 120))


def test_groups_of_near_copies_share_a_round(spark, monkeypatch):
    """Puts of an origin that can't meet are folded at once, even where there are more of them than a round takes."""
    rounds = []
    real = cache._round
    monkeypatch.setattr(cache, "_round", lambda *a: rounds.append(a) or real(*a))
    monkeypatch.setattr(cache, "ROUND", 4)
    rng = random.Random(4)
    rows = []
    for g in range(8):
        base = [f"g{g}w{rng.randrange(10**6)}" for _ in range(120)]
        for k in range(3):
            rows.append((3 * g + k, f"https://a.example/{g}/{k}", " ".join(base + [f"end{k}"]), None, ""))
    puts = spark.createDataFrame(rows, SCHEMA)
    _, decisions, _ = cache.put(cache.empty(puts), puts, 0.9)
    want, *_ = _sequential(rows, 0.9)
    assert {r["seq"]: (r["canonical_url"], r["representative"], r["rule"]) for r in decisions.collect()} == want
    assert len(rounds) == 1 and "near" in {w[2] for w in want.values()}


@pytest.mark.parametrize(("words", "often", "step"), [(16384, 8, 1024), (5, 2, 64)])
def test_shingles_hash_alike_by_words_and_by_letters(monkeypatch, words, often, step):
    for name, value in (("WORDS", words), ("OFTEN", often), ("STEP", step)):
        monkeypatch.setattr(dedup, name, value)
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdeéßÿ") for _ in range(rng.randint(1, 9))) for _ in range(40)] + ["слово", "日本", "ā", "𝒳"]
    lists = [[rng.choice(vocabulary) for _ in range(n)] for n in (0, 1, 2, 3, 4, 63, 64, 65, 66, 700)] + [None, ["x"] * 5]
    kept, found = dedup._signatures(pa.array(lists, pa.list_(pa.string())), 64)
    want = {i: dedup.signature([" ".join(w[k : k + 3]) for k in range(len(w) - 2)]) for i, w in enumerate(lists) if w and len(w) > 2}
    assert dict(zip(kept.tolist(), found.tolist())) == want
    assert not len(dedup._signatures(pa.array([], pa.list_(pa.string())), 64)[0])


def test_settled_copies_need_no_round(spark, monkeypatch):
    """Any number of copies of a text that nothing else touches is decided by joins."""
    monkeypatch.setattr(cache, "_round", lambda *a: pytest.fail("a round"))
    rows = [(i, f"https://a.example/{i}", f"text {i % 3}", None, "") for i in range(60)]
    puts = spark.createDataFrame(rows, SCHEMA)
    now, decisions, _ = cache.put(cache.empty(puts), puts)
    assert now.entries.count() == 3 and decisions.where("rule = 'identical'").count() == 57
    assert {r["representative"] for r in decisions.collect()} == {f"https://a.example/{i}" for i in range(3)}


def test_ranks_count_within_groups(spark):
    rows = [(i % 7 and 1, (i * 37) % 1000) for i in range(1000)]
    out = cache.ranks(spark.createDataFrame(rows, "g int, v int"), "g", "v", "rank").collect()
    for g in (0, 1):
        own = sorted((r["v"], r["rank"]) for r in out if r["g"] == g)
        assert [r for _, r in own] == list(range(len(own)))


def test_empty_and_refused_batches(spark):
    none = spark.createDataFrame([], SCHEMA)
    now, decisions, written = cache.put(cache.empty(none), none, 0.9)
    assert now.entries.count() == decisions.count() == written.count() == 0
    rows = [(1, "not a url", "x", None, ""), (2, "https://a.example/x", "t", "no-store", ""), (3, "https://a.example/y", None, None, "")]
    now, decisions, _ = cache.put(now, spark.createDataFrame(rows, SCHEMA))
    assert [tuple(r) for r in decisions.collect()] == [(3, "https://a.example/y", "https://a.example/y", "itself")]
    assert [r["content"] for r in now.entries.collect()] == [None]


def test_postings_follow_any_sequence_of_writes(spark, tmp_path):
    rng = random.Random(6)
    words = ["alpha", "beta", "Gamma", "delta", "ε"]
    index, now = retrieval.Postings(spark, f"file://{tmp_path}/index", buckets=4), {}
    assert index.rows().count() == 0 and index.documents().count() == 0
    for step in range(7):
        if step == 4:
            index.merge()
        elif step == 2:
            gone = rng.sample(sorted(now), 3)
            index.delete(spark.createDataFrame([(k,) for k in gone], "k string"), "k")
            now = {k: v for k, v in now.items() if k not in gone}
        else:
            docs = {f"d{rng.randrange(12)}": rng.choice([None, "", " ".join(rng.choice(words) for _ in range(rng.randint(1, 9)))]) for _ in range(6)}
            version = index.upsert(spark.createDataFrame(list(docs.items()), "k string, t string"), "k", F.col("t"))
            now.update(docs)
            own = spark.read.parquet(f"file://{tmp_path}/index/documents/version={version}")
            assert {r["key"] for r in own.collect()} == set(docs)
        rebuilt = spark.createDataFrame([(k, v) for k, v in now.items() if v is not None], "key string, t string")
        want = sorted((r["term"], r["key"], r["tf"], r["length"]) for r in retrieval.postings(rebuilt, "key", "t").collect())
        assert sorted(tuple(r) for r in index.rows().collect()) == want
        assert index.documents().count() == sum(v is not None for v in now.values())
        terms = spark.createDataFrame([("q", "alpha"), ("q", "beta")], "q string, term string")
        assert sorted(tuple(r) for r in index.rows(terms).collect()) == [w for w in want if w[0] in ("alpha", "beta")]
    both = {k for k, v in now.items() if v and {"alpha", "beta"} <= set(v.split())}
    assert {r["key"] for r in index.search(terms, "q", 50).collect()} == both
