"""What the plans send through exchanges: texts once, and not with each row that meets them."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from lucerna import session
from lucerna.operators import cache, dedup, discovery, grading, retrieval


def exchanged(df) -> list[str]:
    """The columns of each exchange of a plan."""
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = df._jdf.queryExecution().explainString(mode)
    return re.findall(r"\(\d+\) (?:Exchange|Sort Exchange)\s*\nInput \[\d+\]: \[(.*?)\]\n", plan)


def test_a_cases_texts_are_not_dealt_with_each_of_its_claims(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        claims = spark.createDataFrame(
            [(1, 1, 1.0, ["https://a.example/x"], ["alpha"], [], [("https://a.example/x", "alpha  beta"), ("https://a.example/y", "delta")]), (1, 2, 3.0, ["https://c.example/x"], ["nothing"], [], [("https://b.example/x", "alpha")]), (2, 3, 1.0, [], ["alpha"], [], [])],
            "case_id long, claim_id long, weight double, source_urls array<string>, patterns array<string>, concepts array<string>, passages array<struct<url:string,text:string>>",
        )
        results = spark.createDataFrame([(1, 1, "https://a.example/x", "Alpha beta", None), (1, 2, "https://a.example/y/", "gamma delta .", None)], "case_id long, pos int, url string, text string, token_count int")
        out = grading.grade(claims, results)
        got = exchanged(out)
        assert got and not [x for x in got if re.search(r"\b(_said|_pages|have)#", x)]
        # the texts themselves go to their case once
        assert len([x for x in got if re.search(r"\b(buf|text)#", x)]) == 1
        r = {x["case_id"]: x for x in out.collect()}
        assert (r[1]["extraction"], r[1]["evidence_coverage"], r[2]["extraction"], r[2]["token_budget"]) == (2.5, 10.0, None, 5.0)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_the_chain_asks_engines_nothing_but_what_it_needs(spark):
    long = "Which retention rules does the archive of alpha registers apply to old tables"
    few = "retention archive alpha registers"
    pages = [[(f"https://docs.alpha{k}.example/{w}", w)] for k, w in enumerate(("one", "two"))]
    rows = [(q, e, k, "success", pages[k]) for q in (long, few, "never asked", f"site:alpha0.example {long}") for k, e in enumerate(("first", "second"))]
    answers = spark.createDataFrame(rows, "asked string, engine string, engine_order int, status string, candidates array<struct<url:string,title:string>>")
    asked = []

    def reached(wanted):
        asked.extend(r[0] for r in wanted.collect())
        return answers.join(wanted, "asked", "left_semi")

    questions = spark.createDataFrame([(long,)], "question string")
    told, found = discovery.chained(questions, reached)
    want, listed = discovery.chained(questions, answers)
    assert told.collect() == want.collect() and found.sort("pos").collect() == listed.sort("pos").collect() and found.count() == 2
    assert long in asked and "never asked" not in asked and len(asked) == len(set(asked)) <= 3


def test_a_put_leaves_nothing_but_its_results(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda _: f"file://{tmp_path}")
    monkeypatch.setattr(cache, "ROUND", 2)
    words = [f"w{k}" for k in range(60)]
    now = None
    for start in (0, 100):
        rows = [(start + i, f"https://a.example/{i}", " ".join(words[:50] + [words[50 + i % 3]]) + str(start * (i % 2)), None) for i in range(7)]
        puts = spark.createDataFrame(rows, "seq long, url string, content string, cache_control string")
        now, decisions, written = cache.put(now or cache.empty(puts), puts, 0.9)
    # decisions, entries written, aliases and index of each batch
    assert sorted(p.name.split("-")[1] for p in tmp_path.iterdir()) == sorted(["decisions", "written", "aliases", "index"] * 2)
    assert "signature" not in now.index.columns and now.entries.count() and decisions.count() == 7


def test_shingles_outside_the_prefixes_are_not_dealt(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(4000)]
    rows = []
    for k in range(40):
        text = ["all", "share", "these", "words"] + rng.sample(words, 120)
        rows += [(2 * k, "s", " ".join(text)), (2 * k + 1, "s", " ".join(text[: 124 - k % 20] + ["other"] * (k % 9)))]
    rows += [(100, "s", rows[0][2]), (101, "t", rows[0][2]), (102, "s", ""), (103, "s", None), (104, None, "a b c d"), (105, None, "a b c d e")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    monkeypatch.setattr(session, "shared_dir", lambda _: f"file://{tmp_path}")
    got = {(r.left_id, r.right_id): r.jaccard for r in dedup.jaccard_pairs(df, "source", "text", "doc_id", 0.8).collect()}
    cut = {k: {tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for k, s, t in rows if s == "s" and t and k not in (1, 100)}
    want = {(a, b): len(cut[a] & cut[b]) / len(cut[a] | cut[b]) for a in cut for b in cut if a < b}
    assert got == {p: j for p, j in want.items() if j >= 0.8} and 20 < len(got) < 40
    # two tables: the sets once, and no more of their shingles than the prefixes hold
    names = {p.name.split("-")[1]: f"file://{p}" for p in tmp_path.iterdir()}
    assert sorted(names) == ["probes", "sets"]
    sets = spark.read.parquet(names["sets"]).selectExpr("sum(size(s))").first()[0]
    assert spark.read.parquet(names["probes"]).count() < 0.25 * sets


def test_an_upsert_deals_nothing_by_document(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda _: f"file://{tmp_path}")
    docs = spark.createDataFrame([("a", "one Two two one one"), ("b", ""), ("c", None), ("d", "x"), ("e", "b a b")], "key string, text string")
    own = retrieval.row_postings(docs.where("text IS NOT NULL"), "key", "text")
    assert not exchanged(own) and own.dtypes == retrieval.postings(docs, "key", "text").dtypes
    want = sorted(map(tuple, retrieval.postings(docs.where("text IS NOT NULL"), "key", "text").collect()))
    assert sorted(map(tuple, own.collect())) == want and ("a", "two", 5, 2) in want
    index = retrieval.Postings(spark, f"file://{tmp_path}/index")
    index.upsert(docs, "key", F.col("text"))
    index.merge()
    assert [p.name for p in tmp_path.iterdir()] == ["index"] and index.rows().count() == len(want)


def test_postings_carry_a_documents_key_once_a_bucket(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    docs = [(f"d{k}", " ".join(f"t{rng.randrange(90)}" for _ in range(rng.choice([0, 1, 40, 300])))) for k in range(30)] + [("none", None)]
    index = retrieval.Postings(spark, f"file://{tmp_path}/index", buckets=4)
    monkeypatch.setattr(retrieval, "COUNTED", 100)
    rows = retrieval.packed_postings(spark.createDataFrame(docs[:-1], "k string, t string"), "k", "t", 4).collect()
    want = sorted((t, k, x.split().count(t), len(x.split())) for k, x in docs if x for t in set(x.split()))
    assert sorted((t, r["key"], n, r["length"]) for r in rows for t, n in zip(r["terms"], r["tfs"])) == want
    assert len(rows) == len({(r["key"], r["bucket"]) for r in rows}) < len(want) / 5
    index.upsert(spark.createDataFrame(docs[:20], "k string, t string"), "k", F.col("t"))
    index.upsert(spark.createDataFrame(docs[10:], "k string, t string"), "k", F.col("t"))
    version = index.merge()
    assert spark.read.parquet(f"file://{tmp_path}/index/postings/version={version}").count() == len(rows)
    assert sorted(map(tuple, index.rows().collect())) == want
    for term in ("t1", "t89", "elsewhere"):
        asked = spark.createDataFrame([(term,)], "term string")
        assert sorted(map(tuple, index.rows(asked).collect())) == [w for w in want if w[0] == term]
