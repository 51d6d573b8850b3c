from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lucerna.llm import embedding, lines, simhash, suffix, tiles, topk
from lucerna.llm.common import Scratch
from lucerna.llm.components import Forest, components


def _classes(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, j) for j in range(101, 180)] + [(200, 200), (7, 3)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    want = _classes(400, pairs)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long"), Scratch(spark, "t")).collect()}
    assert all(got.get(i, i) == want[i] for i in range(400))
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def test_forest_spans_what_is_linked():
    f = Forest(6)
    f.link(np.array([0, 2]), np.array([1, 1]))
    f.link(np.array([4]), np.array([5]))
    assert f.root.tolist() == [0, 0, 0, 3, 4, 4]


@pytest.fixture()
def small_tiles(monkeypatch):
    for m in (tiles, simhash, embedding, lines):
        monkeypatch.setattr(m, "TILE", 3)
    monkeypatch.setattr(simhash, "WIDE_TILE", 3)
    monkeypatch.setattr(lines, "CHUNK", 7)
    monkeypatch.setattr(lines, "PART", 200)


def _near_texts(rng, n):
    base = [" ".join(f"w{rng.randrange(500)}" for _ in range(120)) for _ in range(6)]
    out = []
    for i in range(n):
        ws = base[i % 6].split()
        if i % 3:
            ws[rng.randrange(len(ws))] = f"z{rng.randrange(9)}"
        out.append(" ".join(ws))
    return out


def test_simhash_equals_brute_force(spark, small_tiles):
    rng = random.Random(7)
    texts = [None, "", "  \t ", "one two", "ONE two", *_near_texts(rng, 60), "long " * 20000]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] + [(3, "one two", "again")], "doc_id long, text string, fp string")
    got = simhash.near_duplicates(df, Scratch(spark, "t")).collect()
    assert len(got) == len(texts) + 1
    fps = [simhash.fingerprint((t or "").encode()) for t in texts]
    want = _classes(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 2])
    for r in got:
        assert r["fp"] % (1 << 64) == fps[r["doc_id"]] and r["component_id"] == want[r["doc_id"]]
    assert fps[0] == fps[1] == fps[2] == 0 and fps[3] == fps[4]
    assert simhash.near_duplicates(df.limit(0), Scratch(spark, "t")).count() == 0


def test_similar_texts_equal_brute_force(spark, small_tiles):
    rng = random.Random(17)
    texts = [None, "", " ", "one two", "ONE two", "one two three", *_near_texts(rng, 40), "long " * 20000, "long " * 20001]
    for n in (30, 90, 400):
        own = [f"v{rng.randrange(900)}" for _ in range(n)]
        texts += [" ".join(own), " ".join(own[: n - n // 12]), " ".join(own[: n // 2]), " ".join(own) + "\n" + " ".join(f"u{i}" for i in range(n // 3))]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(4, texts[4], 2), (None, "", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, name int")

    def shingles(t):
        w = (t or "").lower().split()
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for t in texts]
    alike = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = _classes(len(sets), alike)
    out = simhash.similar_texts(df, Scratch(spark, "t")).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == {**dict(enumerate(want)), None: 0} and len(alike) > 60 and len(out) == len(texts) + 1
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)
    assert simhash.similar_texts(df.limit(0), Scratch(spark, "t")).count() == 0


def test_fingerprint_bits():
    import xxhash

    words = "A b c d e".split()
    h = [xxhash.xxh64_intdigest(" ".join(x).lower(), 42) for x in zip(words, words[1:], words[2:])]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.fingerprint(b"A  b\x0bc\nd\te") == want


def test_embedding_equals_brute_force(spark, small_tiles):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((8, 16))
    v = np.concatenate([c + 0.08 * rng.standard_normal((12, 16)) for c in centres] + [centres[:1]] * 5).astype(np.float32)
    rows = [(int(i), [float(y) for y in x], 0) for i, x in enumerate(v)]
    odd = [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [1.0, None] + [0.0] * 14, 0), (904, [1.0, 2.0], 0), (905, [1.0, 2.0], 0), (906, [], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, n_links int")
    got = {r["vec_id"]: r for r in embedding.near_duplicates(df, Scratch(spark, "t")).collect()}
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    want = _classes(len(v), [(int(i), int(j)) for i, j in zip(*np.nonzero(link))])
    assert sum(link.sum(1)) > 500
    # hashing may miss a pair now and then; none below the bound is linked
    missed = sum(link[i].sum() - got[i]["n_links"] for i in range(len(v)))
    assert 0 <= missed <= 0.01 * link.sum()
    assert all(got[i]["component_id"] == want[i] and got[i]["kept"] == (want[i] == i) for i in range(len(v)))
    for i in (900, 901, 902, 903, 906):
        assert got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"]
    assert got[905]["component_id"] == 904 and got[905]["n_links"] == 1
    assert embedding.near_duplicates(df.limit(0), Scratch(spark, "t")).count() == 0


def test_ids_that_stand_for_several_vectors(spark):
    e = lambda k, x=0.0: [x] + [float(i == k) for i in range(5)]
    rows = [(1, e(0)), (2, e(0, 0.1)), (2, e(1)), (3, e(1, 0.1)), (4, e(2)), (4, e(2)), (5, e(3)), (None, e(3)), (7, e(4)), (3, e(4, 0.1))]
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0) for r in embedding.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), Scratch(spark, "t")).collect())
    assert got == sorted([(1, 1, 1), (2, 1, 1), (2, 1, 2), (3, 1, 2), (4, 1, 4), (4, 1, 4), (5, 0, 5), (0, 0, 0), (7, 1, 3), (3, 1, 3)])


def test_tables_follow_the_number_of_vectors(spark, monkeypatch):
    assert embedding.layout(0) == embedding.layout(60_000) == (20, 12) and embedding.layout(10**9) == (52, 20)
    for n in (10, 10**5, 10**6, 10**7, 10**10):
        tables, bits = embedding.layout(n)
        assert tables < 128 and 1 - (1 - (1 - np.arccos(0.95) / np.pi) ** bits) ** tables >= 0.998
    rng = np.random.default_rng(3)
    v = np.repeat(rng.standard_normal((30, 12)), 3, 0) + 0.02 * rng.standard_normal((90, 12))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(100, rng.standard_normal(12 + 4096).tolist())], "vec_id long, embedding array<double>")
    few = sorted(embedding.near_duplicates(df, Scratch(spark, "t")).collect())
    monkeypatch.setattr(embedding, "BITS", (18, 20))
    assert sorted(embedding.near_duplicates(df, Scratch(spark, "t")).collect()) == few and sum(r["n_links"] for r in few) >= 180


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", (40, 40))
    monkeypatch.setattr(topk, "QUERIES", 2)
    rng = np.random.default_rng(9)
    v = np.round(rng.standard_normal((230, 20)), 1)
    rows = [(i, [float(y) for y in x]) for i, x in enumerate(v)] + [(1000, None), (1050, [float("inf")] * 20), (1100, [1.0, 2.0])]
    got = {}
    for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 5, 50).collect():
        got[r["query_id"], r["rank"]] = (r["vec_id"], r["score"])
    w = np.floor(256 * v).astype(np.int64)
    for q in range(0, 230, 50):
        s = w @ w[q]
        order = sorted((j for j in range(230) if j != q), key=lambda j: (-s[j], j))[:5]
        assert [got[q, k + 1] for k in range(5)] == [(j, s[j]) for j in order]
    assert len(got) == 25
    few = topk.top_k(spark.createDataFrame([(0, [1.0]), (1, [1.0]), (2, [1.0])], "vec_id long, embedding array<double>"), 5, 50).collect()
    assert [(r["rank"], r["vec_id"]) for r in sorted(few)] == [(1, 1), (2, 2)]
    twice = topk.top_k(spark.createDataFrame([(0, [3.0, 1.0]), (0, [1.0, 3.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>").repartition(3), 5, 50).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(twice)] == [(1, 1, 3 << 16), (2, 2, 1 << 16)]


def _brute_spans(texts, depth):
    b = [(t or "").encode() for t in texts]
    n = Counter(x[i : i + depth] for x in b for i in range(len(x) - depth + 1))
    out = []
    for x in b:
        m = bytearray(len(x))
        for i in range(len(x) - depth + 1):
            if n[x[i : i + depth]] > 1:
                m[i : i + depth] = b"\1" * depth
        keep = bytes(c for c, y in zip(x, m) if not y)
        runs = [i for i in range(len(m)) if m[i] and (i == 0 or not m[i - 1])]
        out.append((len(x), sum(m), len(runs), hashlib.sha256(keep).hexdigest()))
    return out


def test_suffix_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffix, "CHUNK", 4000)
    monkeypatch.setattr(suffix, "BUCKET", 1500)
    rng = random.Random(11)
    prose = lambda n: "".join(rng.choice("abcdé fgh") for _ in range(n))
    p, q = prose(450), prose(700)
    texts = [None, "", "short", prose(399), prose(400), p, p, "x" * 900, "ab" * 300, prose(900)]
    texts += [prose(rng.randint(0, 300)) + p + prose(rng.randint(0, 300)) for _ in range(8)]
    texts += [prose(100) + q[:500], prose(50) + q[200:], q[100:650] + prose(70) + q[100:600], prose(3000)]
    texts += [p[:430] + "tail", p[25:] + "head", "same" + prose(10)]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, anchors string")
    got = {r["doc_id"]: r for r in suffix.repeated_spans(df, Scratch(spark, "t")).collect()}
    for i, (n, removed, runs, sha) in enumerate(_brute_spans(texts, 400)):
        r = got[i]
        assert (r["n_bytes"], sum(e - b for b, e in zip(r["begins"], r["ends"])), len(r["begins"]), r["kept_sha256"]) == (n, removed, runs, sha), i
    cut = {r["doc_id"]: r["text"] for r in suffix.cut(df, suffix.repeated_spans(df, Scratch(spark, "t"))).collect()}
    assert cut[5] == "" and cut[9] == texts[9] and cut[0] is None
    assert suffix.repeated_spans(df.limit(0), Scratch(spark, "t")).count() == 0
    # rows that repeat, and rows without an id, are answered once each
    some = [(1, p, 0), (1, p, 0), (1, q, 0), (None, q, 0), (2, "a" + q, 0), (3, "short", 0), (3, "short", 0)]
    again = spark.createDataFrame(some, "doc_id long, text string, begins int").repartition(5)
    found = suffix.repeated_spans(again, Scratch(spark, "t"))
    assert found.count() == len(some)
    out = suffix.cut(again, found)
    assert out.columns == again.columns and sorted(r["text"] for r in out.collect()) == ["", "", "", "", "a", "short", "short"]


def test_lines_equal_brute_force(spark, small_tiles):
    rng = random.Random(12)
    base = [" ".join(rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randrange(40)) for _ in range(rng.randint(3, 30))) for _ in range(25)]
    texts = [None, "", "\n\n", "ab cd", "ab cd"]
    for _ in range(40):
        own = []
        for _ in range(rng.randint(1, 6)):
            x = rng.choice(base)
            if rng.random() < 0.4:
                x = x.upper() + "!"
            if rng.random() < 0.3:
                x = x[:-1] + rng.choice("xyz")
            own.append(x)
        texts.append("\n".join(own))
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, dropped int")
    seen, occ = {}, []
    for i, t in enumerate(texts):
        for k, x in enumerate((t or "").split("\n")):
            n = lines.normal(x)
            if n:
                occ.append((i, k, seen.setdefault(n, len(seen))))
    names = list(seen)
    long = [len(n.split()) >= lines.WORDS for n in names]
    pairs = [(a, b) for a in range(len(names)) for b in range(a) if long[a] and long[b] and lines.within(names[a], names[b], 0.8)]
    group, first, want = _classes(len(names), pairs), set(), {}
    for i, k, n in occ:
        if group[n] in first:
            want.setdefault(i, []).append(k)
        first.add(group[n])
    got = {r["doc_id"]: r["dropped"] for r in lines.repeated_lines(df, Scratch(spark, "t")).collect()}
    assert got == want and pairs
    out = {r["doc_id"]: r["text"] for r in lines.drop_lines(df, lines.repeated_lines(df, Scratch(spark, "t"))).collect()}
    assert out[0] is None and out[1] == "" and out[2] == "\n\n" and out[4] == ""
    for i, drop in want.items():
        assert out[i] == "\n".join(x for k, x in enumerate(texts[i].split("\n")) if k not in drop)
    assert lines.repeated_lines(df.limit(0), Scratch(spark, "t")).count() == 0


def test_edit_similarity():
    rng = random.Random(1)

    def distance(a, b):
        p = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            q = [i]
            for j, e in enumerate(b, 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (c != e)))
            p = q
        return p[-1]

    for _ in range(500):
        a = "".join(rng.choice("ab c") for _ in range(rng.randint(1, 12)))
        b = "".join(rng.choice("abcd") if rng.random() < 0.2 else c for c in a) + rng.choice(["", "x", "yy"])
        near = 1 - distance(a, b) / max(len(a), len(b)) >= 0.8 - 1e-12
        assert lines.within(a, b, 0.8) == near
        if near:
            assert lines.possible(lines.letters(a)[None], lines.letters(b)[None], 0.8)[0]


def test_whole_search_finds_like_lines_of_any_length(spark, small_tiles):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 8)))
    rows, pairs = [], 0
    for n in (5, 7, 12, 25, 60, 120):
        for kind in range(4):
            ws = [word() for _ in range(n)]
            own = list(ws)
            at = rng.randrange(n)
            own[at : at + 1] = [[word()[: len(ws[at])]], [], ["#".join(ws[at]).replace("#", "")[:-1] + "q"], [ws[at], "so"]][kind]
            a, b = " ".join(ws), " ".join(own)
            if lines.within(a, b, 0.8) and a != b:
                rows += [(2 * pairs, a), (2 * pairs + 1, b)]
                pairs += 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["dropped"] for r in lines.repeated_lines(df, Scratch(spark, "t")).collect()}
    assert pairs > 18 and got == {2 * k + 1: [0] for k in range(pairs)}
    assert set(lines.deletions("abcdefghij", 0.8)) & set(lines.deletions("xbcdefghik", 0.8))


def test_short_and_unspaced_lines_repeat(spark):
    own = "这是一个没有空格的句子而且它会重复出现"
    texts = ["Les.", "LES!", "...", "...", own, own, own[:-1] + "了", "a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["dropped"] for r in lines.repeated_lines(df, Scratch(spark, "t")).collect()}
    assert got == {1: [0], 5: [0], 6: [0]}


def test_normal_lines_and_their_hashes():
    assert lines.normal("Foo_BAR 12,345 é!") == "foo bar 0 0 é" and lines.normal(" \t") == "" == lines.normal("")
    found = lines.Lines(["a b\n\nTHE 99 cats", "", "the 7 CATS", "\n这是一个句子"])
    assert found.number.tolist() == [0, 2, 4, 6] and found.line[1] == found.line[2] != found.line[0]
    assert found.units.tolist() == [2, 3, 3, 5] and found.size.tolist() == [3, 10, 10, 6]
    assert found.texts(np.array([1, 3])) == ["the 0 cats", "这是一个句子"]
    empty = lines.Lines([""])
    assert len(empty.line) == 0 and empty.search(0.8)[0] == []


def test_values_that_repeat():
    from lucerna.llm import repeats

    rng = np.random.default_rng(3)
    values = np.unique(rng.integers(0, 1 << 63, 50, dtype=np.uint64))
    by = repeats.places(values, 7)
    assert sorted(np.concatenate(list(by.values())).tolist()) == list(range(len(values)))
    assert all((values[o] % np.uint64(7) == p).all() for p, o in by.items()) and repeats.places(values[:0], 7) == {}
