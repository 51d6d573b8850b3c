"""Queries over runs: results as graded, cached pages, budgets, diagnostics, reports, grounded claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucerna.operators import runs
from lucerna.plans.registry import registry
from lucerna.sources.readers import table

QUERIES, ORACLE_SQL, query = registry()


@query("case_results", """
    WITH r AS (SELECT doc_id // 10 AS case_id, doc_id AS pos, 'https://h.example/' || doc_id AS url, CASE WHEN doc_id % 3 = 0 THEN 'https://h.example/moved/' || doc_id WHEN doc_id % 3 = 1 THEN 'https://h.example/' || doc_id END AS final, text || chr(10) AS text, n_chars FROM documents),
    u AS (SELECT case_id, 0 AS part, pos, url, text, CAST(n_chars AS BIGINT) AS token_count FROM r UNION ALL SELECT case_id, 1, pos, final, text, 0 FROM r WHERE final <> url)
    SELECT case_id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY part, pos) AS INTEGER) AS ordinal, url, sha256(text) AS text_sha256, token_count FROM u""")
def case_results(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    url = F.concat(F.lit("https://h.example/"), i.cast("string"))
    final = F.when(i % 3 == 0, F.concat(F.lit("https://h.example/moved/"), i.cast("string"))).when(i % 3 == 1, url)
    said = F.array(F.struct(F.col("text").alias("text")), F.struct(F.lit(None).cast("string").alias("text")))
    r = table(spark, d, "documents").select(F.floor(i / 10).alias("case_id"), i.alias("pos"), url.alias("url"), final.alias("final_url"), said.alias("passages"), F.col("n_chars").alias("token_count"))
    return runs.case_results(r).select("case_id", "ordinal", "url", F.sha2("text", 256).alias("text_sha256"), "token_count")


@query("cached_documents", """
    SELECT 'https://h.example/' || doc_id AS url, 1.0::DOUBLE AS score, sha256(coalesce(text, '')) AS content_hash, 1 AS n_passages, length(coalesce(text, ''))::INTEGER AS n_chars FROM documents""")
def cached_documents(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "documents").select(F.concat(F.lit("https://h.example/"), F.col("doc_id").cast("string")).alias("at"), "text")
    c = runs.cached_document(e, "at", "text")
    return c.select("url", "score", "content_hash", F.size("passages").alias("n_passages"), F.length(F.col("passages")[0]["text"]).alias("n_chars"))


@query("open_budgets", "SELECT event_id, least(coalesce(CASE WHEN event_id % 3 <> 0 THEN event_id % 40 END, 5), 20) AS budget FROM events")
def open_budgets(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, d, "events").select("event_id", runs.open_budget(F.when(i % 3 != 0, i % 40), 5, 20).alias("budget"))


@query("rank_diagnostics", """
    WITH c AS (SELECT doc_id // 20 AS question, 'https://h.example/' || doc_id AS url, doc_id % 20 / 20 AS score FROM documents), p AS (SELECT doc_id // 20 AS question, 'https://h.example/' || doc_id AS url, doc_id % 7 / 7 AS score FROM documents WHERE doc_id % 3 <> 0),
    i AS (SELECT doc_id // 20 AS question, 'https://h.example/' || (doc_id - doc_id % 2) AS url, lang AS source_type, doc_id AS pos FROM documents),
    f AS (SELECT question, url, arg_min(source_type, pos) AS source_type FROM i GROUP BY question, url)
    SELECT c.question, c.url, round(c.score, 9) AS score, round(p.score, 9) AS page_score, f.source_type FROM c LEFT JOIN p USING (question, url) LEFT JOIN f USING (question, url)""")
def rank_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    i, q = F.col("doc_id"), F.floor(F.col("doc_id") / 20).alias("question")
    url = lambda x: F.concat(F.lit("https://h.example/"), x.cast("string")).alias("url")
    docs = table(spark, d, "documents")
    c, p = docs.select(q, url(i), (i % 20 / 20).alias("score")), docs.where("doc_id % 3 <> 0").select(q, url(i), (i % 7 / 7).alias("score"))
    out = runs.diagnostics(c, p, docs.select(q, url(i - i % 2), F.col("lang").alias("source_type"), i.alias("pos")), "question")
    return out.select("question", "url", F.round("score", 9).alias("score"), F.round("page_score", 9).alias("page_score"), "source_type")


@query("run_report", """
    WITH r AS (SELECT DISTINCT doc_id // 8 AS case_id, (['success', 'partial', 'blocked', 'error', 'no_relevant_results'])[(doc_id // 8) % 5 + 1] AS status FROM documents),
    c AS (SELECT doc_id // 8 AS case_id, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS a, count(*) FILTER (WHERE toxic = 0) AS l FROM labels GROUP BY 1), x AS (SELECT r.*, c.n, c.a, c.l, status IN ('blocked', 'error') AS out FROM r LEFT JOIN c USING (case_id))
    SELECT count(*)::BIGINT AS cases, count(*) FILTER (WHERE n > 0)::BIGINT AS with_claims, coalesce(sum(n) FILTER (WHERE NOT out), 0)::BIGINT AS claims, coalesce(sum(a) FILTER (WHERE NOT out), 0)::BIGINT AS accepted, coalesce(sum(l) FILTER (WHERE NOT out), 0)::BIGINT AS located,
        count(*) FILTER (WHERE out)::BIGINT AS excluded, coalesce(sum(case_id) FILTER (WHERE out), 0)::BIGINT AS excluded_sum FROM x""")
def run_report(spark: SparkSession, d: str) -> DataFrame:
    case = F.floor(F.col("doc_id") / 8)
    status = F.element_at(F.array(*map(F.lit, ("success", "partial", "blocked", "error", "no_relevant_results"))), (case % 5 + 1).cast("int"))
    r = table(spark, d, "documents").select(case.alias("case_id"), status.alias("status")).distinct()
    c = table(spark, d, "labels").select(case.alias("case_id"), (F.col("quality") == 1).alias("accepted"), (F.col("toxic") == 0).alias("located"))
    return runs.report(r, c)


@query("grounded_claims", r"""
    WITH t AS (SELECT doc_id, doc_id // 6 AS case_id, text, regexp_extract(lower(text), '[a-z0-9]+[^a-z0-9]+[a-z0-9]+') AS pair, regexp_extract(text, '[A-Za-z0-9]+') AS word FROM documents),
    c AS (SELECT *, doc_id % 12 = 0 AS unread, doc_id % 20 = 4 OR pair = '' AS absent, doc_id % 8 = 0 AS unsaid, doc_id % 28 = 14 AS wrong, doc_id % 28 = 2 AS broken FROM t WHERE doc_id % 2 = 0)
    SELECT case_id, doc_id AS claim_id, CASE WHEN unread THEN 'claim source is absent from evidence: https://gone.example/' WHEN absent THEN 'required concept is absent from evidence: ' || CASE WHEN doc_id % 20 = 4 THEN 'zebra_qux' ELSE '' END
        WHEN unsaid THEN 'claim text is not lexically grounded in evidence' WHEN wrong THEN 'grading pattern matches no evidence: qqzz\d' WHEN broken THEN 'grading pattern is not a valid regular expression: (' END AS reason FROM c""")
def grounded_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims of every other document, some of them unfounded in one way or several, against all documents of their case."""
    i = F.col("doc_id")
    own = F.concat(F.lit("https://h.example/"), i.cast("string"))
    docs = table(spark, d, "documents").withColumn("case_id", F.expr("doc_id div 6"))
    read = docs.select("case_id", i.alias("run"), F.array(F.coalesce("text", F.lit(""))).alias("fragments"), F.array(own).alias("urls"))
    pair, word = F.regexp_extract(F.lower("text"), "[a-z0-9]+[^a-z0-9]+[a-z0-9]+", 0), F.regexp_extract("text", "[A-Za-z0-9]+", 0)
    # what a text without words leaves out is asked last, so that a planted concept is the one named; no text asks for nothing
    claims = docs.where("doc_id % 2 = 0").select(
        "case_id", i.alias("claim_id"), F.concat(F.coalesce("text", F.lit("")), F.when(i % 8 == 0, " zyxwvutq").otherwise("")).alias("text"), F.array(own, F.when(i % 12 == 0, "https://gone.example/").otherwise(own)).alias("sources"),
        F.array_compact(F.array(F.when(i % 20 == 4, "zebra_qux").otherwise(pair), pair)).alias("concepts"), F.array_compact(F.array(word, F.when(i % 28 == 14, r"qqzz\d").when(i % 28 == 2, "(").otherwise(word))).alias("patterns"),
    )
    return runs.verify_claims(claims, read)
