"""Each query over small tables: its columns, one row where one is due, and what its contract fixes."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lucerna.llm import language, queries, toxicity

WORDS = {
    "en": "the and house river with from under light morning people walking".split(), "de": "der und haus fluss mit von unter licht morgen leute gehen".split(),
    "fr": "le et maison fleuve avec depuis sous lumière matin gens marche".split(),
}
BAD = "scumwort vilejunk hatemuck".split()


def _docs():
    rng = random.Random(21)
    rows, labels = [], []
    for i in range(240):
        lang = ("en", "de", "fr")[i % 3]
        words = [rng.choice(WORDS[lang]) for _ in range(rng.randint(20, 60))]
        toxic = i % 4 == 1
        if toxic:
            for _ in range(6):
                words[rng.randrange(len(words))] = rng.choice(BAD)
        rows.append((i, " ".join(words), lang if i % 7 else None, "hot" if i % 3 else "cold", 1))
        if i % 5:
            labels.append((i, i % 2, int(toxic)))
    rows += [(500, None, None, None, None), (501, "", "en", "hot", 0), (502, "12345 !!!", "en", "hot", 9), (503, rows[3][1], "en", "hot", 1), (504, "word " * 20_000, "en", "hot", 1), (504, "word " * 20_000, "en", "hot", 1)]
    return rows, labels


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    rows, labels = _docs()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    rng = np.random.default_rng(4)
    vectors = [(int(i), [float(x) for x in rng.standard_normal(8)]) for i in range(120)] + [(900, None), (950, [0.0] * 8)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{at}/embeddings.parquet")
    return at


COLUMNS = {
    "op1_language": [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")],
    "op3_simhash": [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")],
    "op4_quality": [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")],
    "op5_toxicity": [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")],
    "op6_byte_bpe": [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")],
    "op7_packing": [("doc_id", "bigint"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"), ("doc_tokens", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint")],
    "op8_topk": [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")],
    "op9_suffix": [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string")],
    "op10_embedding": [("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")],
}


@pytest.mark.parametrize("name", COLUMNS)
def test_contract(spark, sf_dir, name):
    out = queries.QUERIES[name](spark, sf_dir)
    assert out.dtypes[: len(COLUMNS[name])] == COLUMNS[name]
    got, (rows, _) = out.collect(), _docs()
    if name in ("op8_topk", "op10_embedding"):
        assert len(got) == (20 if name == "op8_topk" else 122)
        return
    per = {r["doc_id"] for r in got}
    assert per == {r[0] for r in rows} and (name == "op7_packing" or len(got) == len(rows))
    if "held_out" in out.columns:
        m, rest = (5, 0) if name == "op5_toxicity" else (4, 2)
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % m == rest) and 0 <= r["score"] <= 1 for r in got)
    if "predicted" in out.columns:
        assert all(r["predicted"] == (r["score"] >= (0.7 if name == "op4_quality" else 0.5)) for r in got)
    if name == "op1_language":
        by = {r["doc_id"]: r["lang_pred"] for r in got}
        assert by[500] == by[501] == by[502] == "und"
        held = [(by[i], ("en", "de", "fr")[i % 3]) for i in range(240) if zlib.crc32(str(i).encode()) % 4 == 2]
        assert sum(a == b for a, b in held) == len(held) > 30
    if name == "op5_toxicity":
        held = [(r["predicted"], r["doc_id"] % 4 == 1) for r in got if r["held_out"] and r["doc_id"] < 240]
        assert sum(p == t for p, t in held) >= 0.9 * len(held) and len(held) > 20


def test_lines_query(spark, sf_dir):
    got = {r["doc_id"]: r for r in queries.op2_lines(spark, sf_dir).collect()}
    assert got[503]["n_kept"] == 0 and got[3]["n_kept"] == 1 and got[500]["kept_bytes"] is None and got[502]["n_kept"] == 1


def test_language_scores_by_brute_force(spark):
    """Known words by their log frequencies, unseen ones by their longest known n-grams."""
    rows = [(i, " ".join(random.Random(i).choices(WORDS[g], k=30)), g) for i in range(60) for g in [("en", "de", "fr")[i % 3]]]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    counts = {(g, n): {} for g in WORDS for n in range(language.LONGEST + 1)}
    for _, text, g in rows:
        for w in language.words(text):
            for n, found in [(0, [w])] + [(n, language.grams(w, n)) for n in range(1, language.LONGEST + 1)]:
                for u in found:
                    counts[g, n][u] = counts[g, n].get(u, 0) + 1

    def value(unit, n):
        every = {u for g in WORDS for u in counts[g, n]}
        logs = np.array([np.log((counts[g, n].get(unit, 0) + 0.5) / (sum(counts[g, n].values()) + 0.5 * len(every))) for g in sorted(WORDS)])
        return logs - logs.mean()

    def word(w):
        known = [w] if any(w in counts[g, 0] for g in WORDS) else None
        n = 0
        while known is None or not known:
            n = language.LONGEST if n == 0 else n - 1
            if n == 0:
                return np.zeros(len(WORDS))
            known = [u for u in language.grams(w, n) if any(u in counts[g, n] for g in WORDS)]
        return np.mean([value(u, n) for u in known], 0)

    for text in ("the house unter", "lumiere marcher sousx", "gehenden leuten", "zzqq the", "xw"):
        found = language.words(text)
        total = sum(word(w) for w in found) * min(len(found), language.EVIDENCE) / len(found)
        p = np.exp(total - total.max())
        langs, scores = model.scores([text])
        assert langs == [sorted(WORDS)[int(p.argmax())]] and scores[0] == pytest.approx(p.max() / p.sum(), abs=1e-4)


def test_toxic_gains_by_brute_force():
    """What a window gains is what two plain compressions differ by; a document counts the windows that reach each step."""
    rows = [(r[0], (r[1] or "").encode(), int(r[0] % 4 == 1)) for r in _docs()[0] if r[0] < 240]
    model = toxicity.fit(rows)
    pair = [toxicity.compressor(model.toxic), toxicity.compressor(model.ordinary)]
    base = [len(c.compress(toxicity._HEAD + toxicity._TAIL)) for c in pair]
    text = "the scumwort house vilejunk " + "z" * 200 + " fin"
    gains = []
    for w in toxicity.windows(toxicity.words(text.encode())):
        t, o = (len(c.compress(toxicity._HEAD + toxicity.spell(w) + toxicity._TAIL)) - b for c, b in zip(pair, base))
        gains.append(max(-1, min(12, o - t)))
    hits = [sum(g >= s for g in gains) for s in toxicity.STEPS]
    assert model.features(text.encode())[1 : 1 + len(hits)].tolist() == pytest.approx(np.log1p(hits).tolist()) and hits[0] >= 2
    assert model.score(model.features(text.encode())[None])[0] > 0.5 > model.score(model.features(b"the house and the river")[None])[0]
