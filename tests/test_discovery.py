"""The discovery chain as one plan, against a walk through it question by question."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lucerna.operators import discovery

ENGINES = ("one", "two", "three")
LONG = "how does the current streaming watermark behaviour of the pipeline engine apply to late events in windows"


def _walk(book, asked):
    last = None
    for order, engine in enumerate(ENGINES):
        if (asked, engine) in book:
            status, listed = book[asked, engine]
            last = (engine, order, status, listed)
            if status not in ("blocked", "error"):
                return last
    return last


def _chain(book, question, follow, scoped):
    got = _walk(book, question)
    if got is None:
        return None
    engine, order, status, found = got
    if status != "success":
        return engine, status, None, []
    found = list(dict.fromkeys(found))
    room = max(0, discovery.WIDENED - len(found))
    added = []
    for later in ENGINES[order + 1 :]:
        s, listed = book.get((question, later), ("error", []))
        if s == "success":
            added += [u for u in listed if u not in found and u not in added]
    found += added[:room]
    used = None
    if len(found) < discovery.THIN and follow:
        second = _walk(book, follow)
        if second and second[2] == "success":
            found += [u for u in dict.fromkeys(second[3]) if u not in found]
            used = follow
    ask = scoped(used or follow or question, found)
    third = _walk(book, ask) if ask else None
    if third and third[2] == "success":
        new = [u for u in dict.fromkeys(third[3]) if u not in found]
        if new:
            merged = []
            for k in range(max(len(new), len(found))):
                merged += new[k : k + 1] + found[k : k + 1]
            return engine, status, ask, merged
    return engine, status, used, found


def test_chain_equals_a_walk(spark):
    rng = random.Random(7)
    questions = [f"{LONG} number {i}" for i in range(24)] + ["short one", "evidence"]
    df = spark.createDataFrame([(q,) for q in questions], "question string")
    follow = {r[0]: r[1] for r in df.select("question", discovery.follow_up(F.col("question"))).collect()}
    book = {}

    def put(asked, least, most):
        for engine in ENGINES:
            if rng.random() < 0.85:
                status = rng.choice(["success", "success", "success", "blocked", "error", "empty"])
                listed = [f"https://{rng.choice(['docs', 'www'])}.site{rng.randrange(3)}.example/{rng.choice(['2024-05-01', '2025-06-02', 'guide', 'watermark'])}/{rng.randrange(30)}" for _ in range(rng.randint(least, most))] if status == "success" else []
                book[asked, engine] = (status, listed)

    for q in questions:
        put(q, 0, 18)
        if follow[q]:
            put(follow[q], 1, 6)
    table = lambda: spark.createDataFrame([(a, e, ENGINES.index(e), s, [(u, "t 2026-01-01" if k % 5 == 0 else "t") for k, u in enumerate(us)]) for (a, e), (s, us) in book.items()], "asked string, engine string, engine_order int, status string, candidates array<struct<url:string,title:string>>")

    def scope(asked, found, question):
        rows = [(question, k, u, "t 2026-01-01" if titled[question, u] else "t") for k, u in enumerate(found)]
        out = discovery.scoped_question(spark.createDataFrame([(question, asked)], "question string, asked string"), spark.createDataFrame(rows, "question string, pos int, url string, title string")).collect() if rows else []
        return out[0]["scoped"] if out else None

    # what is asked of a site depends on what was found: the walk tells, and the book answers some of it
    titled = _Titles(book, follow)
    for q in questions[:8]:
        seen = []
        _chain(book, q, follow[q], lambda a, f, q=q: seen.append(scope(a, f, q)))
        if seen and seen[0]:
            put(seen[0], 1, 5)
    told, found = discovery.chained(df, table())
    got = {r["question"]: (r["engine"], r["status"], r["follow_up"]) for r in told.collect()}
    lists: dict = {}
    for r in found.orderBy("question", "pos").collect():
        lists.setdefault(r["question"], []).append(r["url"])
    n_scoped = 0
    for q in questions[:10] + questions[-2:]:
        want = _chain(book, q, follow[q], lambda a, f, q=q: scope(a, f, q))
        assert got.get(q) == (want and want[:3]) and lists.get(q, []) == (want[3] if want else []), q
        n_scoped += bool(want and want[2] and want[2].startswith("site:"))
    assert n_scoped


class _Titles:
    """Whether an address carries a dated title where a question first meets it."""

    def __init__(self, book, follow):
        self.book, self.follow = book, follow

    def __getitem__(self, key):
        question, url = key
        for asked in (question, self.follow[question]):
            got = _walk(self.book, asked)
            order = ENGINES.index(got[0]) if got else 0
            for engine in ENGINES[order:] if asked == question else ENGINES[order : order + 1]:
                status, listed = self.book.get((asked, engine), ("error", []))
                if status == "success" and url in listed:
                    return listed.index(url) % 5 == 0
        return False
