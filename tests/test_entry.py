from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from lucerna.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_contract():
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and set(catalogue.QUERIES) <= set(q)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["item_id", "rank", "page_id", "score", "confidence"] and df.count() > 0
