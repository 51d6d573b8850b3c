"""Passages of cited pages, traces, readers, hops, segmentation: against plain versions."""

from __future__ import annotations

import itertools
import json
import random
import re

import pytest

from lucerna.operators import capture, runs, segmentation, store, traces
from lucerna.sources import readers


def _span_by_force(content, concepts, patterns):
    cuts, at = [], 0
    for m in re.finditer(r"(?:\r?\n)[^\S\r\n]*(?:\r?\n)+", content):
        cuts.append((at, m.start()))
        at = m.end()
    spans = [(a, b) for a, b in [*cuts, (at, len(content))] if content[a:b].strip()]
    holds = lambda t: all(runs.concept_grounded(c, t.lower()) for c in concepts) and any(re.search(p, t.lower(), re.I) for p in patterns)
    found = [(spans[j][1] - spans[i][0], i, j) for i in range(len(spans)) for j in range(i, len(spans)) if holds(content[spans[i][0] : spans[j][1]])]
    best = min(found, default=None)
    return best and content[spans[best[1]][0] : spans[best[2]][1]]


def test_smallest_support_equals_brute_force():
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "x1", "Delta", "the", "of", "filler words here"]
    hits = 0
    for _ in range(300):
        content = "".join(rng.choice(words) + rng.choice([" ", " ", ", ", "\n", "\n\n", "\r\n \r\n", "\n\n\n"]) for _ in range(rng.randint(1, 40)))
        concepts = rng.sample(["alpha", "beta_gamma", "Delta x1", "alpha alpha", "gamma"], rng.randint(1, 3))
        patterns = rng.sample(["beta", "the|of", "zzz", r"x\d"], rng.randint(1, 2))
        passage, reason = capture.support(content, concepts, patterns)
        assert passage == _span_by_force(content, concepts, patterns), (content, concepts, patterns)
        assert (passage is None) == (reason is not None)
        hits += passage is not None
    assert hits > 60
    assert capture.support("", ["a"], ["a"])[1] == "page does not contain required concept: a" and capture.support("a", [], ["("])[1].startswith("pattern is not")
    assert capture.support("alpha", ["alpha"], ["zz"])[1] == "page matches no acceptable pattern for this claim" and capture.support("x", [], [])[0] is None


def test_slow_patterns_end(monkeypatch):
    monkeypatch.setattr(capture, "PATIENCE", 0.2)
    assert capture.support("a" * 60 + "b", [], ["(a|aa)+$"])[1] == "pattern takes too long: (a|aa)+$"


def test_first_cited_page_that_supports(spark):
    src = "array<struct<url:string,equivalent_urls:array<string>>>"
    claims = [
        (1, "a", ["alpha"], ["alpha"], [("u1", ["u2", "u3"]), ("u4", None)]), (1, "b", ["nowhere"], ["x"], [("u3", None), ("u9", ["u5"])]), (1, "c", ["alpha"], ["alpha"], []), (2, "d", ["alpha"], ["alpha"], None),
    ]
    pages = spark.createDataFrame([("u1", None, "http 500"), ("u2", "no such word", None), ("u3", "long alpha paragraph\n\nalpha", None), ("u4", "alpha", None), ("u5", "alpha", "gone")], "url string, content string, error string")
    out = capture.captured(spark.createDataFrame(claims, f"case_id int, claim_id string, concepts array<string>, patterns array<string>, sources {src}"), pages)
    got = {r["claim_id"]: (r["url"], r["passage"], r["reason"]) for r in out.collect()}
    assert got == {
        "a": ("u3", "alpha", None), "b": (None, None, "u3: page does not contain required concept: nowhere; u9: unreachable (failed); u5: unreachable (gone)"),
        "c": (None, None, "claim cites no source"), "d": (None, None, "claim cites no source"),
    }
    assert sorted(tuple(r) for r in capture.capture_report(out).collect()) == [(1, 3, 1, 2), (2, 1, 0, 1)]


def test_runs_of_either_shape(spark):
    items = [
        {"type": "item.started", "item": {"type": "web_search", "query": "ignored"}}, {"type": "item.completed", "item": {"type": "web_search", "query": "q one", "action": {"type": "search"}}},
        {"type": "item.completed", "item": {"type": "web_search", "query": "see https://b.example/2 and https://a.example/1.", "action": {"type": "open", "url": "https://c.example/3"}}},
        {"type": "item.completed", "item": {"type": "agent_message", "text": "first"}}, {"type": "item.completed", "item": {"type": "agent_message", "text": "as https://d.example/4, says"}},
    ]
    messages = [
        {"type": "system", "subtype": "init", "model": "m-1"}, {"type": "assistant", "message": {"content": [{"type": "text"}, {"type": "tool_use", "name": "WebSearch", "input": {"query": "q two"}}, {"type": "tool_use", "name": "WebFetch", "input": {"url": "https://e.example/"}}]}},
        {"type": "user", "tool_use_result": {"query": "q two", "results": ["a text", {"content": [{"title": "T", "url": "https://f.example/"}, {"deep": {"url": "https://g.example/"}}]}]}},
        {"type": "user", "tool_use_result": {"url": "https://f.example/", "result": "r" * 600}}, {"type": "user", "tool_use_result": "plain"}, {"type": "user", "tool_use_result": ["listed"]}, {"type": "result", "result": "done https://g.example/"},
    ]
    rows = [(1, i, "items", json.dumps(e)) for i, e in enumerate(items)] + [(2, i, "messages", json.dumps(e)) for i, e in enumerate(messages)] + [(2, 90, "messages", "{bad"), (3, 0, "items", "[]")]
    got = {r["run"]: r for r in traces.normalised(spark.createDataFrame(rows, "run int, seq int, shape string, event string").repartition(3)).collect()}
    one, two, three = got[1], got[2], got[3]
    assert one["model"] == "unknown" and one["queries"] == ["q one"] and one["opened_urls"] == ["https://b.example/2", "https://a.example/1", "https://c.example/3"] and one["cited_urls"] == ["https://d.example/4"]
    assert [s["url"] for s in one["selected_sources"]] == [*one["opened_urls"], "https://d.example/4"] and one["final_answer"].startswith("as") and len(one["tool_results"]) == 2
    assert two["model"] == "m-1" and two["queries"] == ["q two"] and two["opened_urls"] == ["https://e.example/", "https://f.example/"] and two["n_unreadable"] == 1
    assert [tuple(s) for s in two["selected_sources"]] == [("https://f.example/", "https://f.example/"), ("https://e.example/", "https://e.example/"), ("https://g.example/", "https://g.example/")]
    assert [r["summary"] for r in two["tool_results"]] == ["a text", "T: https://f.example/", "https://g.example/: https://g.example/", "r" * 500, "plain", "listed"]
    assert [tuple(p) for p in two["evidence_passages"]] == [("https://f.example/", "r" * 600)] and three["n_unreadable"] == 1 and three["queries"] == []


def test_lines_are_numbered_and_bad_ones_kept(spark, tmp_path):
    rng = random.Random(1)
    want = {}
    for f in range(3):
        rows = [rng.choice(['{"a": 1, "b": "x"}', '{"a": 2}', "{broken", "", "[1]", '"text"', "null"]) + "" for _ in range(400)]
        (tmp_path / f"f{f}.jsonl").write_text("\n".join(rows))
        want[f"f{f}.jsonl"] = [r for r in rows if r]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    out = readers.jsonl_lines(spark, f"file://{tmp_path}", "a int, b string").collect()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")
    for name, rows in want.items():
        own = sorted((r for r in out if r["file"].endswith(name)), key=lambda r: r["line"])
        assert [r["line"] for r in own] == list(range(1, len(rows) + 1))
        for r, raw in zip(own, rows):
            good = raw.startswith('{"a"')
            assert r["corrupt"] == (None if good else raw) and (r["record"] is not None) == good
            assert not good or r["record"]["a"] == json.loads(raw)["a"]


def test_budget_passes_over_what_is_too_long(spark):
    rng = random.Random(9)
    rows = [(t, i, rng.choice([1, 5, 20, 60, 99, 150])) for t in ("a", "b", "c") for i in range(60)] + [("d", 0, 500), ("e", 1, 0)]
    want = set()
    for t in "abcde":
        used = 0
        for _, i, n in sorted(r for r in rows if r[0] == t):
            if n <= 100 - used:
                used += n
                want.add((t, i))
    got = readers.affordable(spark.createDataFrame(rows, "t string, i int, n int"), "t", "i", "n", 100).collect()
    assert {(r["t"], r["i"]) for r in got} == want and len(got) == len(want)


def test_every_hop_is_checked(spark):
    answers = [(f"https://a.example/{i}", 301, f"/{i + 1}") for i in range(7)] + [("https://a.example/7", 200, None), ("https://a.example/x", 302, "https://b.example/in"), ("https://b.example/in", 302, "http://127.0.0.1/"), ("https://a.example/y", 307, "https://c.example/p"), ("https://a.example/z", 301, "//d.example/q"), ("https://a.example/w", 200, "https://nowhere.example/")]
    robots = [("a.example", 404, None), ("b.example", 200, ""), ("c.example", 200, "User-agent: *\nDisallow: /p"), ("d.example", 404, None)]
    dns = [("a.example", ["8.8.8.8"], ["8.8.8.8"]), ("b.example", ["8.8.4.4"], ["8.8.4.4"]), ("c.example", ["9.9.9.9"], ["9.9.9.9"]), ("d.example", ["8.8.8.8"], ["8.8.4.4"])]
    start = [(1, "https://a.example/2", "automatic"), (2, "https://a.example/1", "automatic"), (3, "https://a.example/x", "automatic"), (4, "https://a.example/y", "automatic"), (5, "https://a.example/y", "explicit"), (6, "https://a.example/z", "automatic"), (7, "https://a.example/w", "automatic"), (8, "https://e.example/", "explicit"), (9, "ftp://a.example/", "explicit")]
    out = store.followed(
        spark.createDataFrame(start, "id int, url string, access string"), spark.createDataFrame(answers, "url string, status int, location string"), spark.createDataFrame(robots, "host string, status int, body string"),
        spark.createDataFrame(dns, "host string, first array<string>, second array<string>"),
    )
    got = {r["id"]: (r["url"], r["n_redirects"], r["reason"], r["robots_ignored"]) for r in out.collect()}
    assert got == {
        1: ("https://a.example/7", 5, None, False), 2: ("https://a.example/6", 5, "redirect_limit", False), 3: ("http://127.0.0.1/", 2, "non_public_address", False), 4: ("https://c.example/p", 1, "robots_disallowed", False),
        5: ("https://c.example/p", 1, None, True), 6: ("https://d.example/q", 1, "rebinding", False), 7: ("https://a.example/w", 0, None, False), 8: ("https://e.example/", 0, "non_public_dns_answer", True), 9: ("ftp://a.example/", 0, "non_http_scheme", False),
    }


def test_cheapest_words():
    words = [("東京", 2.0), ("京都", 2.5), ("東", 4.0), ("都", 3.0), ("東京都", 4.5), ("に", 1.0), ("行く", 2.0), ("行", 3.0)]
    lattice = segmentation.Lattice(words)
    assert lattice.cut("東京都に行く") == ["東京都", "に", "行く"] and lattice.cut("") == []
    cost, rng = dict(words), random.Random(3)
    for _ in range(60):
        run = "".join(rng.choice("東京都に行く他") for _ in range(rng.randint(1, 9)))
        total = lambda parts: sum(cost.get(p, lattice.dearest) for p in parts)
        ways = [[run[a:b] for a, b in zip((0, *cuts), (*cuts, len(run)))] for k in range(len(run)) for cuts in itertools.combinations(range(1, len(run)), k)]
        ways = [w for w in ways if all(p in cost or len(p) == 1 for p in w)]
        assert total(lattice.cut(run)) == pytest.approx(min(map(total, ways)))
    assert segmentation.terms("Ｎode.js 東京に行く v2 node.js", lattice) == ["node", "js", "東京", "行く", "v2", "node.js", "東京に行く"]


def test_segmenting_by_a_counted_dictionary(spark):
    words = spark.createDataFrame([("ねこ",)] * 5 + [("いぬ",)] * 3 + [("こい",)] + [("",)], "word string")
    d = segmentation.dictionary(words, 2)
    assert [r["word"] for r in d.orderBy("cost").collect()] == ["ねこ", "いぬ"]
    out = segmentation.segmented(spark.createDataFrame([(1, "ねこいぬ cat"), (2, None)], "id int, t string"), "id", "t", d).collect()
    assert {r["id"]: r["words"] for r in out} == {1: ["ねこ", "いぬ", "cat"], 2: []}


def test_circuit_stops_at_thirty(spark):
    rows = [(1, f"h{i % 3}", i, "blocked" if i % 3 == 0 else "success") for i in range(50)]
    got = sorted(r["rank"] for r in store.circuit(spark.createDataFrame(rows, "s int, h string, rank int, status string"), "s", "h", "rank", "status").collect())
    assert got == [i for i in range(30) if i % 3 or i < 6]
