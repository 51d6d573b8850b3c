"""Preparing candidates, filling a quota, answers when discovery fails: against plain folds."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lucerna.operators import answering

NOW = "2026-01-10 00:00:00"


def test_each_failing_candidate_says_why(spark):
    html = "<html><body><h1>T</h1><p>alpha beta</p></body></html>"
    rows = [
        (1, "https://open.example/fresh", "local_cache"), (1, "https://open.example/stale", "local_cache"), (1, "https://open.example/kept", "local_cache"), (1, "https://open.example/blank", "local_cache"),
        (1, "https://open.example/fresh2", "organic"), (1, "https://shut.example/x", "organic"), (1, "https://silent.example/x", "organic"), (1, "https://open.example/late", "organic"),
        (1, "https://open.example/never", "organic"), (1, "https://open.example/image", "organic"), (1, "https://open.example/scan", "organic"), (1, "https://open.example/empty", "organic"), (2, "https://open.example/page", "organic"),
    ]
    c = spark.createDataFrame(rows, "question int, url string, source_type string").withColumn("units", F.array(F.lit("alpha"))).withColumn("note", F.col("url"))
    robots = spark.createDataFrame([("open.example", 200, "User-agent: *\nDisallow: /no"), ("shut.example", 500, None)], "host string, status int, body string")
    cached = [("fresh", "old text", "2026-01-09 12:00:00"), ("stale", "old text", "2026-01-01"), ("kept", "old text", "2026-01-01"), ("blank", "", "2026-01-09 12:00:00"), ("fresh2", "old text", "2026-01-09 12:00:00")]
    cached = spark.createDataFrame([(f"https://open.example/{k}", t, at) for k, t, at in cached], "canonical_url string, content string, fetched string")
    cached = cached.select("canonical_url", "content", F.col("fetched").cast("timestamp").alias("fetched"), F.lit(None).cast("string").alias("cache_control"), F.lit("general").alias("content_class"))
    seen = [("stale", "text/html", html, False, None), ("kept", "text/html", None, True, None), ("blank", "text/html", html, True, None), ("fresh2", "text/html; charset=x", html, False, None), ("late", None, None, False, "timeout"), ("image", "image/png", "x", False, None), ("scan", "application/pdf", "%PDF-1.4 nothing", False, None), ("empty", "text/html", "<p> </p>", False, None), ("page", "text/plain", "alpha\n\nplain", False, None)]
    seen = spark.createDataFrame([(f"https://open.example/{k}", *r) for k, *r in seen], "url string, content_type string, body string, not_modified boolean, error string")
    out = {r["url"].split("/")[2].split(".")[0] + "/" + r["url"].rsplit("/", 1)[1]: r for r in answering.prepared(c, robots, cached, seen, F.lit(NOW).cast("timestamp")).collect()}
    assert len(out) == len(rows) and all(r["note"] == r["url"] for r in out.values())
    assert {k: (r["outcome"], r["reason"]) for k, r in out.items()} == {
        "open/fresh": ("cached", None), "open/stale": ("rendered", None), "open/kept": ("confirmed", None), "open/blank": ("rendered", None), "open/fresh2": ("rendered", None), "shut/x": ("dropped", "robots"), "silent/x": ("dropped", "robots"),
        "open/late": ("dropped", "timeout"), "open/never": ("dropped", "not_rendered"), "open/image": ("dropped", "unsupported_format"), "open/scan": ("dropped", "unsupported_or_ocr_required"), "open/empty": ("dropped", "unsupported_or_ocr_required"), "open/page": ("rendered", None),
    }
    assert [p["text"] for p in out["open/kept"]["passages"]] == ["old text"] and out["open/kept"]["content"] is None
    assert "alpha beta" in out["open/stale"]["content"] and out["open/shut" if False else "shut/x"]["passages"] is None


def _walk(hosts, works, pages, gone, wanted):
    """The same quota, written as a walk over a dict that grows while it is walked."""
    waiting, pending, fails, flying, out, given, turn = list(range(len(hosts))), {}, {}, {}, [], set(), 0

    def fill():
        while len(pending) < 8:
            open_ = [i for i in waiting if fails.get(hosts[i], 0) + flying.get(hosts[i], 0) < 2]
            if not open_:
                return
            waiting.remove(open_[0])
            pending[open_[0]] = True
            flying[hosts[open_[0]]] = flying.get(hosts[open_[0]], 0) + 1

    fill()
    while pending and len(out) < wanted:
        i = next(iter(pending))
        del pending[i]
        flying[hosts[i]] -= 1
        if not works[i]:
            fails[hosts[i]] = fails.get(hosts[i], 0) + 1
        fill()
        if works[i] and not gone[i] and pages[i] not in given:
            given.add(pages[i])
            out.append(i)
    return out


def test_quota_with_look_ahead(spark):
    assert answering.taken(["a", "a", "a", "b"], [False, False, True, True], ["1", "2", "3", "4"], [False] * 4, 5) == [3]
    assert answering.taken(["a", "a", "a"], [True, False, True], ["1", "2", "3"], [False] * 3, 5) == [0, 2]
    rng = random.Random(4)
    rows, want = [], {}
    for q in range(25):
        n = rng.randint(0, 40)
        own = sorted(((round(rng.random(), 2), f"https://h{rng.randrange(6)}.example/{q}/{i}", rng.random() < 0.6) for i in range(n)), key=lambda r: (-r[0], r[1]))
        rows += [(q, u, s, "rendered" if ok else "dropped") for s, u, ok in own]
        own = own[: answering.BUDGET]
        gone = [int(u.rsplit("/", 1)[1]) % 7 == 0 for _, u, _ in own]
        want[q] = {own[i][1] for i in _walk([u.split("/")[2] for _, u, _ in own], [ok for *_, ok in own], [u for _, u, _ in own], gone, 5)}
    pages = spark.createDataFrame(rows, "question int, url string, score double, outcome string")
    consumed = pages.where("CAST(element_at(split(url, '/'), -1) AS INT) % 7 = 0").select("question", "url")
    out = answering.filled(pages, consumed, 5).collect()
    assert {q: {r["url"] for r in out if r["question"] == q} for q in want} == want
    for q in want:
        own = sorted((r["place"], r["score"]) for r in out if r["question"] == q)
        assert [p for p, _ in own] == list(range(1, len(own) + 1)) and [s for _, s in own] == sorted((s for _, s in own), reverse=True)


def test_cached_pages_replace_found_ones_and_answer_alone(spark):
    found = spark.createDataFrame([(1, 1, "https://a.example/x", "organic", "x"), (1, 2, "https://b.example/y", "news", "y")], "question int, pos int, url string, source_type string, title string")
    local = spark.createDataFrame([(1, 1, "https://b.example/y"), (2, 1, "https://c.example/z")], "question int, rank int, url string")
    out = sorted(tuple(r) for r in answering.merged(found, local).collect())
    assert out == [(1, 1, "https://a.example/x", "organic", "x"), (1, 2, "https://b.example/y", "local_cache", "b.example"), (2, 1, "https://c.example/z", "local_cache", "c.example")]
    asked = [(1, "parsed", None), (2, "blocked", "captcha"), (3, "blocked", "waf: x"), (4, "error", None), (5, "parse_failure", "timeout"), (6, "empty", None), (7, "parsed", None)]
    results = [(1, 0.5)] * 2 + [(2, 0.1)] + [(7, 0.2)] * 5
    out = answering.answer_status(spark.createDataFrame(asked, "question int, status string, reason string"), spark.createDataFrame(results, "question int, score double"), 5)
    assert sorted(tuple(r) for r in out.collect()) == [
        (1, "partial", "medium", None, 2), (2, "success", "high", None, 1), (3, "blocked", "low", "waf", 0), (4, "error", "low", "network_error", 0), (5, "error", "low", "timeout", 0), (6, "no_relevant_results", "low", None, 0), (7, "success", "high", None, 5),
    ]
