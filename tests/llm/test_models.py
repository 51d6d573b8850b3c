from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lucerna.llm import language, quality, toxicity

WORDS = {"en": "the quick brown fox jumps over lazy dog and then runs home".split(), "fr": "le renard brun saute par dessus un chien paresseux et rentre".split()}


def _text(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(3)
    rows = [(i, _text(rng, "en" if i % 2 else "fr", rng.randint(5, 40)), "en" if i % 2 else "fr", "s") for i in range(200)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_language_backs_off_and_rejects(spark, spoken):
    m = language.train(spoken)
    tests = [(1, "the foxy browning", "x"), (2, None, "x"), (3, "123 !!! ²", None), (4, "renarde parlesse", None), (4, "renarde parlesse", None), (5, "", None), (6, "dog " * 30000, None), (7, "日本", None)]
    out = {(r[0]): r for r in language.identify(spark.createDataFrame(tests, "doc_id long, text string, lang string"), m).collect()}
    assert out[1]["lang_pred"] == "en" and out[4]["lang_pred"] == "fr" and out[6]["lang_pred"] == "en"
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (2, 3, 5))
    assert out[7]["lang_pred"] == "en" and 0 <= out[7]["score"] <= 1
    kept = language.keep(spark.createDataFrame(tests, "doc_id long, text string, lang string"), m, 0.6)
    assert kept.columns == ["doc_id", "text", "lang"] and {r[0] for r in kept.collect()} == {1, 4, 6}


def test_language_without_training_rows(spark, spoken):
    m = language.train(spoken.where("false"))
    assert {r["lang_pred"] for r in language.identify(spoken, m).collect()} == {"und"}


def test_trees_learn_a_threshold_and_handle_edges(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 5))
    y = ((x[:, 1] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    m = quality.grow(x[:2000], y[:2000])
    assert ((m.probability(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    assert len(quality.grow(x, np.ones(len(x))).leaf) == 0
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "word " * 50000), (3, "x")], "doc_id long, text string")
    model = quality.grow(np.stack([quality.features(t) for t in (b"a b c", b"###", b"x y", b"$$ $$") * 20]), np.array([1, 0, 1, 0] * 20, float))
    out = quality.score(docs, model).collect()
    assert len(out) == 4 and all(0 <= r["score"] <= 1 for r in out)
    assert quality.score(docs.limit(0), model).count() == 0


def test_traversal_equals_walking_each_tree():
    rng = np.random.default_rng(2)
    x, y = rng.standard_normal((500, 4)), rng.integers(0, 2, 500).astype(float)
    m = quality.grow(x, y, 7)
    for row in x[:50]:
        total = m.base
        for f, t, leaf in zip(m.feature, m.threshold, m.leaf):
            node = 0
            while node < 2**quality.DEPTH - 1:
                node = 2 * node + 1 + int(row[f[node]] > t[node])
            total += leaf[node - (2**quality.DEPTH - 1)]
        assert abs(total - m.margin(row[None])[0]) < 1e-9


def test_toxicity_finds_planted_words_and_leaves_clean_ones(spark):
    rng = random.Random(9)
    syllables = "ba co di fu ge ha jo ki lu me no pa ri so tu ve".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    rows = []
    for i in range(600):
        ws = [word() for _ in range(rng.randint(20, 120))]
        bad = i % 4 == 0
        if bad:
            for _ in range(2):
                ws.insert(rng.randrange(len(ws)), rng.choice(["wretch", "dimwit", "numbskull"]))
        rows.append((i, " ".join(ws).encode(), int(bad)))
    m = toxicity.fit(rows[:400])
    s = m.score(np.stack([m.features(t) for _, t, _ in rows[400:]]))
    y = np.array([r[2] for r in rows[400:]])
    assert ((s >= 0.5) == y).mean() > 0.95
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "wretch " * 30000), (3, "!!!")], "doc_id long, text string")
    out = toxicity.score(docs, m).collect()
    assert len(out) == 4 and all(0 <= r["score"] <= 1 for r in out)


def test_toxicity_reads_whole_runs_without_spaces():
    rng = random.Random(4)
    syllables = "ba co di fu ge ha jo ki lu me no pa ri so tu ve".split()
    rows = []
    for i in range(600):
        ws = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(40)]
        if i % 4 == 0:
            ws[rng.randrange(40)] = "numbskull"
        rows.append((i, " ".join(ws).encode(), int(i % 4 == 0)))
    m = toxicity.fit(rows)
    clean = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(200)).encode()
    for at in (0, 60, 99, 156, 390, 600):
        assert m.score(m.features(clean[:at] + b"numbskull" + clean[at:])[None])[0] > m.score(m.features(clean)[None])[0]
    run = ("汉字，" * 100).encode()
    cut = toxicity.windows([run])
    assert all(len(w) <= 66 and w.decode() for w in cut) and len(cut) > 20
    assert all(any(run[k : k + 33] in w for w in cut) for k in range(len(run) - 33))


def test_toxicity_without_both_classes():
    m = toxicity.fit([(1, b"a b", 0), (2, b"c", 0)])
    assert 0 < m.score(m.features(b"x")[None])[0] < 0.5
    assert toxicity.fit([]).score(toxicity.fit([]).features(b"")[None])[0] <= 0.5


def test_labels_are_sampled_once_per_id(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "c") for i in range(50)], "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(1, 1), (2, None), (None, 1)], "doc_id long, quality int")
    got = toxicity.labelled(docs, labels, "quality", lambda i: i % 4 != 2, 1000)
    assert got.count() == 38 and got.columns == ["id", "text", "y"]
    assert toxicity.labelled(docs, labels, "quality", lambda i: F.lit(True), 5).count() < 40
