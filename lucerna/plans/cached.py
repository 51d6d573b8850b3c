"""Queries over the cache as it is written: puts and their representatives, entries, postings that follow."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucerna.operators import cache, retrieval
from lucerna.plans.registry import registry
from lucerna.session import shared_dir
from lucerna.sources.readers import table

QUERIES, ORACLE_SQL, query = registry()

# Three batches of puts, the same in both languages: even documents, odd ones, and some pages of the first two again with a
# text of their own.  A language is a host; some addresses carry trackers, some puts have no text, some must not be stored.
_URL = "'https://' || lang || '.example/d/' || doc_id"
_PUTS = f"""
    a AS (SELECT doc_id + CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1000000000000 END AS seq, {_URL} AS canonical_url, CASE WHEN doc_id % 11 <> 5 THEN text END AS content, lang FROM documents WHERE doc_id % 7 <> 0),
    b AS (SELECT doc_id + 2000000000000 AS seq, {_URL} AS canonical_url, coalesce(text, '') || ' revised ' || doc_id AS content, lang FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 5 = 4),
    f AS (SELECT seq, canonical_url, content, CASE WHEN content IS NULL THEN canonical_url ELSE first_value(canonical_url) OVER (PARTITION BY lang, content ORDER BY seq) END AS representative FROM a),
    p AS (SELECT *, CASE WHEN representative = canonical_url THEN 'itself' ELSE 'identical' END AS rule FROM f UNION ALL SELECT b.seq, b.canonical_url, b.content, f.representative, 'alias' FROM b JOIN f USING (canonical_url)),
    e AS (SELECT representative AS canonical_url, arg_max(coalesce(content, chr(0)), seq) AS content, max(seq) AS seq FROM p GROUP BY representative)"""


def _puts(spark: SparkSession, d: str) -> list[DataFrame]:
    i = F.col("doc_id")
    page = F.concat(F.lit("https://"), F.col("lang"), F.lit(".example/d/"), i.cast("string"))
    docs = table(spark, d, "documents").withColumn("cache_control", F.when(i % 7 == 0, "private, No-Store").otherwise("public"))
    tracked = F.concat(page, F.when(i % 4 == 0, "?utm_source=feed").otherwise(""))
    batch = lambda rows, add, url, text: rows.select((i + add).alias("seq"), url.alias("url"), text.alias("content"), "cache_control")
    text = F.when(i % 11 != 5, F.col("text"))
    revised = F.concat(F.coalesce("text", F.lit("")), F.lit(" revised "), i.cast("string"))
    return [
        batch(docs.where("doc_id % 2 = 0"), 0, tracked, text), batch(docs.where("doc_id % 2 = 1"), 1_000_000_000_000, tracked, text),
        batch(docs.where("doc_id % 5 = 4"), 2_000_000_000_000, F.concat(page, F.lit("/")), revised),
    ]


def _after(spark: SparkSession, d: str, near: float | None = None) -> tuple[cache.Cache, DataFrame, list[DataFrame]]:
    batches, out, written = _puts(spark, d), None, []
    now = cache.empty(batches[0])
    for b in batches:
        now, decisions, wrote = cache.put(now, b, near)
        out = decisions if out is None else out.unionByName(decisions)
        written.append(wrote)
    return now, out, written


@query("cache_put", f"WITH {_PUTS} SELECT seq, canonical_url, representative, rule FROM p")
def cache_put(spark: SparkSession, d: str) -> DataFrame:
    """Which entry speaks for each put, over three batches into one cache."""
    return _after(spark, d)[1]


@query("cache_entries_after", f"""
    WITH {_PUTS}, n AS (SELECT representative AS canonical_url, count(DISTINCT canonical_url) AS n_aliases FROM p GROUP BY 1)
    SELECT canonical_url, seq, CASE WHEN content <> chr(0) THEN sha256(content) END AS digest, CAST(n_aliases AS BIGINT) AS n_aliases FROM e JOIN n USING (canonical_url)""")
def cache_entries_after(spark: SparkSession, d: str) -> DataFrame:
    now, _, _ = _after(spark, d)
    n = now.aliases.groupBy("canonical_url").agg(F.count("*").alias("n_aliases"))
    return now.entries.join(n, "canonical_url").select("canonical_url", "seq", "digest", "n_aliases")


@query("postings_incremental", f"""
    WITH {_PUTS}, w AS (SELECT canonical_url, unnest(regexp_extract_all(lower(canonical_url || ' ' || content), '[\\p{{L}}\\p{{N}}]+')) AS term FROM e WHERE content <> chr(0) AND seq % 13 <> 3),
    t AS (SELECT term, canonical_url, count(*) AS tf FROM w GROUP BY term, canonical_url)
    SELECT term, CAST(count(*) AS BIGINT) AS n_documents, CAST(sum(tf) AS BIGINT) AS occurrences FROM t GROUP BY term""")
def postings_incremental(spark: SparkSession, d: str) -> DataFrame:
    """The index after three batches, each of which wrote its own entries' postings, a merge between, and the eviction of some."""
    now, _, written = _after(spark, d)
    index = retrieval.Postings(spark, f"{shared_dir(spark)}/lucerna-index-{uuid.uuid4().hex}")
    for n, wrote in enumerate(written):
        index.upsert(wrote, "canonical_url", F.when(F.col("content").isNotNull(), F.concat_ws(" ", "canonical_url", "content")))
        if n == 1:
            index.merge()
    index.delete(now.entries.where("seq % 13 = 3"), "canonical_url")
    return index.rows().groupBy("term").agg(F.count("*").alias("n_documents"), F.sum("tf").alias("occurrences"))


@query("cache_put_near")
def cache_put_near(spark: SparkSession, d: str) -> DataFrame:
    """The same puts with near copies of a host folded at a similarity of 0.9."""
    return _after(spark, d, 0.9)[1]
