"""Proofs of edit similarity: many pairs at once, with the answers of one at a time."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from lucerna.llm import lines


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row = row, [i]
        for j, d in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
    return row[-1]


def altered(rng: random.Random, text: str, share: float) -> str:
    put = lambda c: rng.choice(["", c + "q", rng.choice("abxyz語")]) if rng.random() < share else c
    return "".join(put(c) for c in text)


def test_pairs_side_by_side_equal_brute_force(monkeypatch):
    rng = random.Random(5)
    texts = []
    for _ in range(80):
        text = "".join(rng.choice("abcdefg 語é") for _ in range(rng.choice([3, 20, 63, 64, 65, 128, 129, 230])))
        texts += [text, altered(rng, text, rng.choice([0.05, 0.15, 0.2, 0.25, 0.4]))]
    i, j = np.arange(0, 160, 2), np.arange(1, 160, 2)
    want = [5 * distance(a, b) <= max(len(a), len(b)) for a, b in zip(texts[::2], texts[1::2])]
    assert 10 < sum(want) < 70
    for side in (0, lines.SIDE, 10**9):
        monkeypatch.setattr(lines, "SIDE", side)
        assert lines.all_within(texts, i, j, 0.8).tolist() == want


def test_a_tile_of_like_lines_is_not_proved_pair_by_pair(monkeypatch):
    rng, n, calls = random.Random(6), 48, []
    own = lines.bounded_distance
    monkeypatch.setattr(lines, "bounded_distance", lambda *a: calls.append(1) or own(*a))
    texts = []
    for _ in range(n // 2):
        text = "".join(rng.choice("ab") for _ in range(60)) + "".join(rng.choice("cd") for _ in range(60))
        texts += [text, altered(rng, text, 0.1)]
    zeros = pa.array(np.zeros(n, np.int64))
    columns = [pa.array([-7] * n), zeros, pa.array([0] * n, pa.int32()), pa.array(np.arange(n)), pa.array([len(t) for t in texts], pa.int32()), zeros, zeros, zeros, zeros, pa.array(texts), pa.array([[-7]] * n, pa.list_(pa.int64()))]
    names = ["bucket", "tile", "side", "line", "size", "s0", "s1", "s2", "s3", "norm", "buckets"]
    found = list(lines._links(iter([pa.record_batch(columns, names=names)]), 0.8))

    def roots(edges: list[tuple[int, int]]) -> list[int]:
        root = list(range(n))
        for a, b in edges:
            root = [min(root[a], root[b]) if x in (root[a], root[b]) else x for x in root]
        return root

    alike = [(a, b) for a in range(n) for b in range(a) if abs(len(texts[a]) - len(texts[b])) <= 30 and 5 * distance(texts[a], texts[b]) <= max(len(texts[a]), len(texts[b]))]
    assert roots([e for b in found for e in zip(b.column("a").to_pylist(), b.column("b").to_pylist())]) == roots(alike)
    # 1,128 pairs: one by one before
    assert len(calls) < 100


def test_distances_within_a_band_equal_brute_force():
    rng = random.Random(7)
    for _ in range(600):
        a = "".join(rng.choice("abc d") for _ in range(rng.choice([0, 1, 2, 9, 40, 90])))
        b = altered(rng, a, rng.choice([0, 0.05, 0.2, 0.5, 0.9]))[rng.choice([0, 0, 4]) :] + "ab" * rng.choice([0, 0, 3])
        most, want = rng.choice([0, 1, 2, 5, 13, 100]), distance(a, b)
        got = lines.bounded_distance(a, b, most)
        assert got == want if want <= most else got > most
    # pairs of unlike lengths and bounds share a band
    a, b = [], []
    for _ in range(60):
        text = "".join(rng.choice("abcdef ") for _ in range(rng.randint(240, 330)))
        a, b = [*a, text + "abc" * rng.choice([0, 0, 9])], [*b, altered(rng, text, rng.choice([0.02, 0.1, 0.2, 0.4]))]
    pairs = sorted((sorted(p, key=len, reverse=True) for p in zip(a, b)), key=lambda p: -len(p[0]))
    most = np.array([max(len(x) - len(y), rng.choice([10, 40, 60, 100])) for x, y in pairs])
    want = [distance(x, y) <= m for (x, y), m in zip(pairs, most.tolist())]
    assert 10 < sum(want) < 50
    assert lines._side_by_side([x for x, _ in pairs], [y for _, y in pairs], most, 8).tolist() == want


def test_tiles_of_few_rows_are_searched_together(monkeypatch):
    calls, own = [], lines._pairs
    monkeypatch.setattr(lines, "_pairs", lambda *a: calls.append(1) or own(*a))
    split = 1 << 24 | 2  # one part of a bucket meets another
    tiles = [(-9, 0), (-5, split), (3, 0), (3, split), (21 << 32 | 5, 0), (21 << 32 | 6, split), (36 << 32 | 1, 0)]
    text = ["some words here and", "some words here end", "nothing like it", "some wards here and"]
    rows = [(b, t, side, 10 * n + k, len(text[k]), 0, 0, 0, 0, text[k], [b] if b >= 0 else [b, 3]) for n, (b, t) in enumerate(tiles) for k, side in enumerate((0, 1, 0, 0))]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.string(), pa.list_(pa.int64())]
    names = ["bucket", "tile", "side", "line", "size", "s0", "s1", "s2", "s3", "norm", "buckets"]
    batch = pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)
    found = {tuple(sorted(e)) for b in lines._links(iter([batch]), 0.8) for e in zip(b.column("a").to_pylist(), b.column("b").to_pylist())}
    # lines 0, 1 and 3 are alike; where a bucket is split, all but 1 are on one side and meet only it
    assert found == {(10 * n, 10 * n + k) for n in range(len(tiles)) for k in (1, 3)}
    assert not calls
