from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lucerna.operators import dedup, discovery, extraction, grading, matching, store
from lucerna.streaming import controller


def test_signature_goldens(spark):
    content = lambda n: " ".join(f"word{i}" if i < 200 - n else f"other{i}" for i in range(200))
    df = spark.createDataFrame([(0, "o", content(0)), (16, "o", content(16)), (18, "o", content(18)), (99, "p", content(0)), (7, "o", "a b")], "id long, origin string, text string")
    s = dedup.minhash(df, "id", "text").join(df.select("id", "origin"), "id")
    by = {r["id"]: r["signature"] for r in s.collect()}
    assert 7 not in by
    same = lambda a, b: sum(x == y for x, y in zip(by[a], by[b])) / 64
    assert same(0, 16) == 0.90625 and same(0, 18) == 0.890625
    pairs = {(r["left_id"], r["right_id"]) for r in dedup.near_pairs(s, "origin", "id", 0.9).collect()}
    assert (0, 16) in pairs and (0, 18) not in pairs and not any(99 in p for p in pairs)
    native = df.where("id = 0").select(F.array_min(F.transform(dedup.texts.shingles(F.col("text")), lambda x: dedup.slot_hash(x, 5))).alias("m")).first()["m"]
    assert native == by[0][5]
    folded = {r["id"]: r["representative"] for r in dedup.fold_sequential(s.withColumn("at", F.col("id")), "origin", "id", "at", "signature", 0.9).collect()}
    assert folded[0] == 0 and folded[16] == 0 and folded[99] == 99


def test_jaccard_pairs_miss_none(spark):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(300)}" for _ in range(60)] for _ in range(5)]
    rows = []
    for i in range(40):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            w[rng.randrange(60)] = "z"
        rows.append((i, "s", " ".join(w)))
    got = {(r["left_id"], r["right_id"]): r["jaccard"] for r in dedup.jaccard_pairs(spark.createDataFrame(rows, "id long, source string, text string"), "source", "text", "id", 0.8).collect()}
    first: dict = {}
    for i, _, t in rows:
        first.setdefault(t, i)
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(58)} for t, i in first.items()}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    assert got == pytest.approx({k: v for k, v in want.items() if v >= 0.8}) and got


def test_segmenting():
    text = "# One\n\nfirst para\nsecond line\n\nnext para\n\n## Two\n```py\ncode()\n```\nafter\n" + "Sentence here. " * 200
    got = extraction.segment(text)
    assert [g["heading"] for g in got][:3] == ["One", "Two", "Two"] and got[1]["code"] == "py" and got[1]["text"] == "code()"
    assert got[0]["text"] == "first para\nsecond line\n\nnext para" and got[1]["heading_path"] == ["One", "Two"]
    assert all(len(g["text"]) <= extraction.PASSAGE for g in got) and extraction.segment("") == []
    assert "".join(extraction.pieces("x" * 3000)) == "x" * 3000


def test_best_passages_take_one_per_heading(spark):
    df = spark.createDataFrame([(1, "# A\nalpha beta\n\n# B\n" + "gamma " * 30 + "\n\n# A\nshort\n\nplain")], "id long, text string")
    cut = extraction.blocks(df, "id", "text")
    got = extraction.best_passages(cut, "id", df.select("id", F.array(F.lit("alpha"), F.lit("beta")).alias("units")), 5).orderBy("rank").collect()
    assert got[0]["text"].startswith("alpha") and len({r["heading"] for r in got}) == len(got)


def test_result_pages(spark):
    links = [("https://www.google.com/url?q=https%3A%2F%2Fa.org%2Fpage", "A page"), ("https://a.org/page", "again"), ("https://ads.example/x", "Sponsored"), ("https://accounts.google.com/", "Sign"), ("https://b.org/login", "Log in"), ("http://10.0.0.1/", "inner"), ("https://c.org/doc.pdf", "A pdf"), ("https://www.google.com/search?q=more", "Related searches: more")]
    df = spark.createDataFrame([("s1", "ten results", links), ("s2", "our systems detected unusual traffic", links), ("s3", "did not match any documents", []), ("s4", "?", [])], "serp_id string, text string, links array<struct<url:string,text:string>>")
    got = discovery.candidates(df.where("serp_id = 's1'"), "google").orderBy("pos").collect()
    assert [(r["url"], r["source_type"]) for r in got] == [("https://a.org/page", "organic"), ("https://c.org/doc.pdf", "document")]
    status = {r["serp_id"]: (r["status"], r["reason"]) for r in discovery.serp_status(df, "google").collect()}
    assert status == {"s1": ("parsed", None), "s2": ("blocked", "captcha"), "s3": ("empty", None), "s4": ("parse_failure", "unrecognized_serp_markup")}
    assert discovery.suggestions(df.where("serp_id = 's1'")).first()["source"] == "google_related"


def test_follow_ups(spark):
    q = "How does the PDF.js generic build describe external content loading in the browser viewer?"
    df = spark.createDataFrame([(q,), ("short",)], "q string")
    got = [r[0] for r in df.select(discovery.follow_up(F.col("q"))).collect()]
    assert got[1] is None and got[0].split()[0] == "PDF.js" and len(got[0].split()) <= 4
    found = spark.createDataFrame([(q, i, u) for i, u in enumerate(["https://m.github.io/pdf.js/", "https://m.github.io/pdf.js/start/", "https://github.com/x", "https://z.org/"])], "question string, pos int, url string")
    scoped = discovery.scoped_question(found.select("question").distinct(), found).collect()
    assert scoped[0]["scoped"] == f"site:m.github.io {q}"


def test_units_match_without_pairs(spark, monkeypatch):
    rng = random.Random(8)
    parts = ["alp", "zz", "beta x", "ta", "①", "a", "ha z"]
    asked = [(q, rng.sample(parts, rng.randint(1, 5))) for q in range(12)] + [(99, [])]
    docs = [(0, None), (1, ""), (2, "the ALPHA zz"), (3, "beta x\nalpha zz\n\nta"), (4, "1 Ⓐ"), (5, "\n" + "zz " * 3000 + "\nBETA X")]
    docs += [(10 + i, "".join(rng.choice(["alp", "ha ", "zz", "be", "ta x", "\n", " "]) for _ in range(12))) for i in range(30)]
    q, d = spark.createDataFrame(asked, "q long, units array<string>"), spark.createDataFrame(docs, "d long, text string")
    want = set()
    for k, units in asked:
        units = [matching.folded(u) for u in units]
        for i, t in docs:
            t = matching.folded(t)
            hits = sum(u in t for u in units)
            if hits:
                want.add((k, i, len(units), hits, max(sum(u in x for u in units) for x in t.split("\n"))))
    folded = q.select("q", F.transform("units", lambda u: F.lower(matching_nfkc(u))).alias("units"))
    for limit in (500_000, 9):
        monkeypatch.setattr(matching, "LIMIT", limit)
        got = matching.matched_units(folded, "q", d, "text", ["d"])
        assert {(r["q"], r["d"], r["n_units"], r["n_hits"], r["n_best"]) for r in got.collect()} == want and len(want) > 60
        half = matching.matched_units(folded, "q", d, "text", ["d"], 0.5).collect()
        assert {(r["q"], r["d"]) for r in half} == {(k, i) for k, i, n, h, _ in want if h / n >= 0.5}
    plan = matching.matched_units(folded, "q", d, "text", ["d"])._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "Exchange" not in plan
    assert matching.matched_units(folded, "q", d.limit(0), "text", ["d"]).count() == 0


def matching_nfkc(column):
    return F.when(column == "①", "1").otherwise(column)


def test_passages_that_texts_contain(spark, monkeypatch):
    passages = spark.createDataFrame([("a", "One\ntwo"), ("b", "x"), ("c", ""), ("d", "x")], "k string, p string")
    docs = spark.createDataFrame([(1, "zero One\ntwo x"), (2, "one\ntwo"), (3, None)], "d int, text string")
    for limit in (500_000, 0.1):
        monkeypatch.setattr(matching, "LIMIT", limit)
        got = matching.containing(passages, "k", "p", docs, "text", ["d"]).collect()
        assert sorted((r["k"], r["d"]) for r in got) == [("a", 1), ("b", 1), ("d", 1)]


def test_evictions_follow_the_order(spark):
    rows = [(i, 10, i % 3, i == 5) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, size long, prio int, pinned boolean")
    gone = {r["id"] for r in store.evictions(df, "size", ["prio", "id"], "pinned", 120).collect()}
    assert gone == set(sorted((i for i in range(20) if i != 5), key=lambda i: (i % 3, i))[:8])


def test_grading(spark):
    claims = spark.createDataFrame(
        [("c", "1", 2.0, ["https://a.org/x#top"], ["must `declare`"], ["tool-use"], [("https://a.org/x", "We MUST declare .")]), ("c", "2", 1.0, ["https://b.org/"], ["nothing"], [], [])],
        "case_id string, claim_id string, weight double, source_urls array<string>, patterns array<string>, concepts array<string>, passages array<struct<url:string,text:string>>",
    )
    results = spark.createDataFrame([("c", 1, "https://z.org/", "other", 10), ("c", 2, "https://www.a.org/x/", "Tool use: we must declare.", 20)], "case_id string, pos int, url string, text string, token_count int")
    r = grading.grade(claims, results).first()
    assert (r["evidence_coverage"], r["source_recall"], r["rank"], r["extraction"], r["token_budget"]) == (26.667, 16.667, 5.0, 10.0, 5.0)
    assert r["classification"] == "degraded" and abs(r["total"] - (26.667 + 16.667 + 5 + 10 + 3.333 + 5)) < 1e-6


def test_controller_stream_equals_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = [("c", i * 700, float(rng.randint(100, 900)), rng.random() < (0.4 if 100 < i < 160 else 0.02), False) for i in range(300)]
    schema = "controller string, ms long, duration double, failed boolean, timed_out boolean"
    df = spark.createDataFrame(rows, schema)
    want = [tuple(r) for r in controller.capacity_batch(df).orderBy("closed_ms").collect()]
    for i in range(3):
        spark.createDataFrame(rows[i * 100 : i * 100 + 100], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = controller.capacity_stream(stream).writeStream.format("memory").queryName("caps").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [tuple(r) for r in spark.table("caps").orderBy("closed_ms").collect()] == want and len(want) > 5
    assert any(r[5] for r in want) and min(r[6] for r in want) < 16


def test_emission_happens_once(spark, tmp_path):
    rows = [(1, "u"), (1, "u"), (1, "v"), (2, "u")]
    for i in range(2):
        spark.createDataFrame(rows, "inv long, url string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("inv long, url string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = []
    q = controller.emit_into(stream, str(tmp_path / "done"), ["inv", "url"], lambda b, n: out.extend(tuple(r) for r in b.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(out) == [(1, "u"), (1, "v"), (2, "u")]


def test_a_failing_sink_never_emits_twice(spark, tmp_path):
    spark.createDataFrame([(1, "u"), (1, "v")], "inv long, url string").coalesce(1).write.parquet(str(tmp_path / "in"))
    out = []

    def sink(batch, number):
        out.extend(tuple(r) for r in batch.collect())
        raise RuntimeError("lost")

    def start(into):
        stream = spark.readStream.schema("inv long, url string").parquet(str(tmp_path / "in"))
        return controller.emit_into(stream, str(tmp_path / "done"), ["inv", "url"], into).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()

    with pytest.raises(Exception, match="lost"):
        start(sink).awaitTermination(120)
    again = []
    start(lambda b, n: again.extend(b.collect())).awaitTermination(120)
    assert sorted(out) == [(1, "u"), (1, "v")] and again == []


def test_sanitising(spark):
    from lucerna.operators import contracts

    df = spark.createDataFrame([(1, '{"a": [{"api_key": 5, "note": "Bearer abc"}]}'), (2, "not json Bearer x"), (3, None)], "id long, v string")
    got = {r["id"]: (r["clean"], r["valid"]) for r in contracts.sanitised_json(df, "id", "v").collect()}
    assert got == {1: ('{"a": [{"api_key": "[redacted]", "note": "[redacted]"}]}', True), 2: ("not json [redacted]", False), 3: (None, False)}


def test_words_within_reach(spark):
    docs = spark.createDataFrame([(1, "Alpha then beta."), (2, "alpha " + "x " * 100 + "beta"), (3, "alphabet beta"), (4, None)], "id long, text string")
    groups = spark.createDataFrame([("g", ["alpha", "beta"]), ("h", ["beta"]), ("i", ["beta", "nowhere"])], "group string, words array<string>")
    got = grading.near_texts(docs, "id", "text", groups, 160).collect()
    assert sorted(tuple(r) for r in got) == [(1, "g"), (1, "h"), (2, "h"), (3, "h")]


def test_documents_that_hold_all_words(spark):
    claims = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "zz"]), (3, []), (4, ["c"])], "c int, w array<string>")
    held = spark.createDataFrame([(10, "a"), (10, "b"), (11, "a"), (12, "b"), (12, "a"), (13, "c")], "d int, word string")
    assert sorted(tuple(r) for r in grading.holding_words(claims, held, "c", "d").collect()) == [(1, 10), (1, 12), (4, 13)]


def test_archive_entries_and_dates(spark):
    from lucerna.operators import contracts

    df = spark.createDataFrame([("a/b.txt", "2024-02-29"), ("/etc/x", "2023-02-29"), ("a/../b", "2024-2-9"), ("a/..b", None)], "n string, d string")
    got = df.select(contracts.safe_entry(F.col("n")).alias("s"), contracts.iso_date(F.col("d")).alias("d")).collect()
    assert [r["s"] for r in got] == [True, False, False, True]
    assert [str(r["d"]) for r in got] == ["2024-02-29", "None", "None", "None"]


def _documents(spark, path, texts):
    rows = [(i, t, "en", "s", None if i == 1 else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")


def test_answers_of_documents_of_any_length(spark, tmp_path):
    from lucerna.plans import contracts as plan

    _documents(spark, tmp_path, ["short", "unmeasured", "long " * 2000])
    got = {r["answer"]: r["n_chars"] for r in plan.answer_text(spark, str(tmp_path)).collect()}
    assert got.keys() == {0, 1, 2} and got[2] - got[0] == 10_000 - 5


def test_concepts_are_grounded_nearby():
    import itertools

    from lucerna.operators import runs

    rng = random.Random(5)
    for _ in range(200):
        text = " ".join(rng.choice(["aa", "bb", "cc", "x" * rng.randint(1, 60), "aab"]) for _ in range(rng.randint(1, 12)))
        words = rng.choice([["aa", "bb"], ["aa", "bb", "cc"], ["cc"], ["aa", "aa", "bb"]])
        places = [[m for m in range(len(text)) if text.startswith(w, m) and (m == 0 or text[m - 1] == " ") and text[m + len(w) : m + len(w) + 1] in ("", " ")] for w in sorted(set(words))]
        want = any(max(p) - min(p) <= 60 for p in itertools.product(*places))
        assert runs.near(text, words, 60) == want
    assert runs.concept_grounded("Generic_Build", "the generic -- build") and not runs.concept_grounded("!", "x")
    assert runs.concept_grounded("doc tf", "tf " + "y" * 150 + " doc") and not runs.concept_grounded("doc tf", "tf " + "y" * 170 + " doc")


def test_the_best_of_each_question_leave_the_scan(spark):
    rng = random.Random(13)
    words = [f"u{i}" for i in range(12)]
    texts = [(i, "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(1, 5))), f"t{rng.randrange(60):03d}", [round(rng.random() * 0.2, 1) if k % 20 < 10 else 0.0 for k in range(20)]) for i in range(400)]
    asked = [(q, rng.sample(words, rng.randint(1, 4)), rng.choice([0, 15])) for q in range(15)]
    t = spark.createDataFrame(texts, "id int, body string, tie string, prior array<double>").repartition(4)
    q = spark.createDataFrame(asked, "q int, units array<string>, kind int")
    every = matching.matched_units(q, "q", t, "body", ["id"]).collect()
    prior, kind, tie = {i: p for i, _, _, p in texts}, {n: k for n, _, k in asked}, {i: x for i, _, x, _ in texts}
    want: dict = {}
    for r in every:
        score = 0.5 * r["n_hits"] / r["n_units"] + 0.3 * r["n_best"] / r["n_units"] + prior[r["id"]][kind[r["q"]]]
        want.setdefault(r["q"], []).append((-round(score, 9), tie[r["id"]], r["id"], r["n_hits"], r["n_best"]))
    kept = matching.matched_units(q, "q", t, "body", ["id"], best=matching.Best(3, "prior", "kind", "tie", lambda cov, line, prior: 0.5 * cov + 0.3 * line + prior[:, 0])).collect()
    got: dict = {}
    for r in kept:
        got.setdefault(r["q"], {})[r["id"]] = (r["n_hits"], r["n_best"])
    for n, rows in want.items():
        lead = sorted(rows)[:3]
        # what ties in all stands for each other
        assert len(got[n]) >= min(3, len(rows)) and all(got[n].get(i) == (h, b) or sum(r[:2] == (s, x) for r in rows) > 1 for s, x, i, h, b in lead)
    assert len(kept) < len(every) / 3
