"""Registered queries against their SQL, over small tables that hold what the given ones lack."""

from __future__ import annotations

from collections import Counter

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")


def same(spark, folder, name: str, **tables) -> Counter:
    """Runs a query and its SQL over these tables (rows and schema) and compares them; returns the rows."""
    con = duckdb.connect()
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    got = entry.queries()[name](spark, str(folder))
    want = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    found = Counter(map(tuple, got.select(*names).collect()))
    assert found == Counter(want.fetchall())
    return found


def test_a_planted_concept_is_named_before_a_text_that_has_no_words(spark, tmp_path):
    texts = {4: "word", 8: None, 14: "", 24: "", 44: None, 64: "!?", 84: "two words", 100: "one", 104: "!", 122: "", 2**60 + 4: "single", 2**60 + 10: "a b"}
    rows = [(i, texts.get(i, f"some words of document {i}"), "en") for i in [*range(130), 2**60 + 4, 2**60 + 10]]
    found = same(spark, tmp_path, "grounded_claims", documents=(rows, "doc_id long, text string, lang string"))
    reasons = {r[1]: r[2] for r in found}
    assert reasons[4] == reasons[44] == "required concept is absent from evidence: zebra_qux" and reasons[100] == "required concept is absent from evidence: "
