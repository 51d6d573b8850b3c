"""The wired search: discovery, cache, preparation and quota in one plan, worked out by hand for a few questions."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from lucerna.plans import search

PAGE = "<html><title>x</title><body><p>{}</p></body></html>"


def test_answers_with_and_without_discovery(spark):
    q = spark.createDataFrame([(1, ["alpha", "guide"], "general", False, True), (2, ["alpha"], "general", False, False), (3, ["alpha"], "general", False, False), (4, ["alpha"], "general", False, False)], "question int, units array<string>, profile string, temporal boolean, asks boolean")
    discovered = spark.createDataFrame([(1, "success", None), (2, "blocked", "captcha"), (3, "error", "timeout"), (4, "empty", None)], "question int, status string, reason string")
    found = [(1, 1, "https://a.example/one", "organic", "alpha one"), (1, 2, "https://b.example/docs/two", "organic", "alpha guide"), (1, 3, "https://c.example/held", "organic", "alpha"), (1, 4, "https://d.example/shut", "organic", "alpha"), (1, 5, "https://a.example/given", "organic", "alpha"), (2, 1, "https://a.example/one", "organic", "never asked")]
    found = spark.createDataFrame(found, "question int, pos int, url string, source_type string, title string")
    local = spark.createDataFrame([(1, 1, "https://c.example/held"), (2, 1, "https://c.example/held"), (2, 2, "https://c.example/stale"), (2, 3, "https://c.example/lost")], "question int, rank int, url string")
    held = [("https://c.example/held", "alpha from the cache", "2026-01-09 23:00:00"), ("https://c.example/stale", "alpha of old", "2025-01-01"), ("https://c.example/lost", "alpha lost", "2025-01-01")]
    held = spark.createDataFrame(held, "canonical_url string, content string, fetched string").select("canonical_url", "content", F.col("fetched").cast("timestamp").alias("fetched"), F.lit(None).cast("string").alias("cache_control"), F.lit("general").alias("content_class"))
    robots = spark.createDataFrame([(f"{h}.example", 404, None) for h in "abc"] + [("d.example", 403, None)], "host string, status int, body string")
    renders = [("https://a.example/one", "text/html", PAGE.format("alpha body"), False, None), ("https://b.example/docs/two", "text/html", PAGE.format("guide to alpha"), False, None), ("https://a.example/given", "text/html", PAGE.format("alpha given"), False, None), ("https://c.example/stale", "text/html", None, True, None), ("https://c.example/lost", None, None, False, "timeout")]
    renders = spark.createDataFrame(renders, "url string, content_type string, body string, not_modified boolean, error string")
    consumed = spark.createDataFrame([(1, "https://a.example/given")], "question int, url string")
    results, status, puts = search.live(q, discovered, found, local, held, robots, renders, consumed, F.lit("2026-01-10").cast("timestamp"), 3)
    got = {(r["question"], r["place"]): (r["url"], r["outcome"], r["score"], r["content_hash"]) for r in results.collect()}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    # general profile: 0.45 coverage + 0.25 / place + 0.2 type + 0.1, documentation 0.15; cached pages follow what was found
    assert {k: v[:2] for k, v in got.items()} == {
        (1, 1): ("https://b.example/docs/two", "rendered"), (1, 2): ("https://a.example/one", "rendered"), (1, 3): ("https://c.example/held", "cached"), (2, 1): ("https://c.example/held", "cached"), (2, 2): ("https://c.example/stale", "confirmed"),
    }
    assert got[1, 1][2] == 1.0 and got[1, 2][2] == 0.775 and got[2, 1][2] == round(0.25 + 0.2 * 0.65 + 0.1, 9) and got[2, 1][3] == digest("alpha from the cache")
    assert sorted(tuple(r) for r in status.collect()) == [(1, "success", "high", None, 3), (2, "success", "high", None, 2), (3, "error", "low", "timeout", 0), (4, "no_relevant_results", "low", None, 0)]
    assert {r["url"] for r in puts.collect()} == {"https://a.example/one", "https://b.example/docs/two", "https://a.example/given"}
    assert all("alpha" in r["content"] and r["mime"] == "text/html" for r in puts.collect())
