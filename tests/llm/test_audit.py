from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lucerna.llm import audit
from lucerna.llm.common import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " ", "\t\n\x0b\x0c\r", "A", "aé é b\x1cc", "日本語 日本語 🙂", "word " * 300, "w" * 100_000, "x" * 70 + " " + "x" * 70 + " " + "x" * 69 + "y", "a\x00b a\x00b a", "100% #1", "UP " * 250 + "low " * 250]


def _numbers(text):
    words = WORD.findall(text or "")
    return len(words), len(set(words)), len(re.findall("[A-Z]", text or "")), len(text or ""), len(re.findall(r"[#$%&*|]", text or ""))


def _rows():
    rng = random.Random(3)
    vocabulary = [rng.choice("abcdefgh") * rng.randint(1, 12) for _ in range(60)] + ["Caps", "$5", "Ünï"]
    rows = []
    for i in range(150):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([5, 150, 199, 200, 260]))]
        rows.append((i, rng.choice([" ", "\n"]).join(words), rng.choice(["en", "de", None, ""]), i))
    rows += [(1000 + i, t, "odd", 0) for i, t in enumerate(ODD)]
    rows += [(2000 + i, rows[i % 5][1], "fr", 0) for i in range(40)] + [(3, rows[3][1], "en", 9), (2001, rows[1][1], "en", 9), (None, rows[0][1], "en", 1), (None, "alone", "en", 1), (-1, rows[7][1], "zz", 1)]
    return rows


SCHEMA = "doc_id long, text string, lang string, fails int"


def test_counts_by_prefix_sums_equal_plain_ones():
    texts = [r[1] for r in _rows()]
    for column in (pa.array(texts), pa.array(["skipped", *texts], pa.large_string()).slice(1), pa.array(texts[:1]), pa.array([], pa.string())):
        found = audit.scan(column)
        want = [_numbers(t) for t in column.to_pylist()]
        for k, name in enumerate(("words", "distinct_words", "capitals", "code_points", "symbols")):
            assert found[name].tolist() == [w[k] for w in want], name


def test_words_that_share_a_hash_are_told_apart():
    data = np.frombuffer(b" ".join(b"%d" % (i % 700) for i in range(2000)), np.uint8)
    ends = np.append(np.flatnonzero(data == 32), len(data))
    begins = np.append(0, ends[:-1] + 1)
    doc = np.repeat([0, 1], 1000)
    assert audit.distinct(data, begins, ends, doc, 2, hash_bits=3).tolist() == audit.distinct(data, begins, ends, doc, 2).tolist() == [700, 700]


def _brute(rows, labels):
    fails = []
    for i, text, lang, _ in rows:
        w, d, c, n, s = _numbers(text)
        copy = i is not None and any(j is not None and j < i and (t or "") == (text or "") for j, t, *_ in rows)
        fails.append((lang or "", {x for x, hit in zip("ABCDE", (w < 200, 100 * d < 50 * w, 100 * c > 3 * n, s > 0, copy)) if hit}, i))
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    out, shapley = {}, {}
    for part in {f[0] for f in fails}:
        own = [f for f in fails if f[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for k, x in enumerate(order):
                gone = [f for f in left if x in f[1]]
                failing = sum(x in f[1] for f in own)
                left = [f for f in left if x not in f[1]]
                shapley[part, x] = shapley.get((part, x), 0) + len(gone)
                out[part, order, k + 1] = [len(left), len(gone), failing - len(gone), sum(f[1] == {x} for f in own), sum(f[2] in good for f in gone), sum(f[2] in toxic for f in gone)]
    return {(p, o, k): (*v, shapley[p, o[k - 1]]) for (p, o, k), v in out.items()}


def test_every_order_equals_brute_force(spark):
    rows = _rows()
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 120, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (2001, 1, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), Scratch(spark, "test")).collect()
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in audit.COUNTS) for r in found}
    want = _brute(rows, labels)
    assert len(found) == len(got) == 600 * 6 and got == want


def test_nothing_in_nothing_out(spark):
    docs, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(docs, labels, Scratch(spark, "test")).count() == 0
    one = audit.audit(spark.createDataFrame([(1, None, None, 0)], SCHEMA), labels, Scratch(spark, "test")).collect()
    assert len(one) == 600 and {r["part"] for r in one} == {""} and sum(r["removed"] for r in one) == 120


def test_query_equals_its_sql(spark):
    import duckdb

    from lucerna.llm.queries import ORACLE_SQL, QUERIES

    at = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    try:
        names = ["part", "filter_order", "step", *audit.COUNTS]
        want = sorted(con.execute(f"SELECT {', '.join(names)} FROM ({ORACLE_SQL['op11_filters']})").fetchall())
    except duckdb.IOException:
        pytest.skip("no test data")
    assert sorted(tuple(r) for r in QUERIES["op11_filters"](spark, at).select(*names).collect()) == want
