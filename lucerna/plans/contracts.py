"""Queries over contracts: what rows must satisfy, what may leave, what is asked again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucerna.functions import urls
from lucerna.operators import contracts, grading
from lucerna.plans.registry import registry
from lucerna.sources import sinks
from lucerna.sources.readers import table

QUERIES, ORACLE_SQL, query = registry()


@query("contract_violations", """
    WITH r AS (SELECT event_id, value / 50 AS score, CASE WHEN event_id % 9 = 0 THEN 'ftp://x.example/' WHEN event_id % 10 = 0 THEN 'http://10.1.1.1/' ELSE 'https://x.example/' END AS url,
        CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'success' WHEN 'view' THEN 'partial' ELSE event_type END AS status, CASE WHEN event_id % 2 = 0 THEN 'timeout' END AS reason FROM events)
    SELECT event_id, array_to_string(list_filter([CASE WHEN NOT score BETWEEN 0 AND 1 THEN 'score_range' END, CASE WHEN url <> 'https://x.example/' THEN 'url_public' END,
        CASE WHEN status NOT IN ('success', 'partial', 'no_relevant_results', 'blocked', 'error') THEN 'status_known' END, CASE WHEN status IN ('blocked', 'error') AND reason IS NULL THEN 'reason_given' END], lambda x: x IS NOT NULL), ',') AS violations FROM r""")
def contract_violations(spark: SparkSession, d: str) -> DataFrame:
    i, kind = F.col("event_id"), F.col("event_type")
    url = F.when(i % 9 == 0, "ftp://x.example/").when(i % 10 == 0, "http://10.1.1.1/").otherwise("https://x.example/")
    status = F.when(kind == "error", "error").when(kind == "click", "success").when(kind == "view", "partial").otherwise(kind)
    r = table(spark, d, "events").select("event_id", (F.col("value") / 50).alias("score"), url.alias("url"), status.alias("status"), F.when(i % 2 == 0, "timeout").alias("reason"))
    return r.select("event_id", F.array_join(contracts.violations(contracts.result_rules()), ",").alias("violations"))


@query("retry_outcomes", """
    WITH a AS (SELECT doc_id // 2 AS candidate, doc_id % 2 + 1 AS attempt, CASE (doc_id * 5) % 7 WHEN 0 THEN 'timeout' WHEN 1 THEN 'network_error' WHEN 2 THEN 'blocked' ELSE 'success' END AS status FROM documents),
    p AS (SELECT candidate, max(status) FILTER (WHERE attempt = 1) AS a, max(status) FILTER (WHERE attempt = 2) AS b FROM a GROUP BY candidate)
    SELECT candidate, CASE WHEN a IN ('timeout', 'network_error', 'target_error') THEN coalesce(b, a) ELSE a END AS status, CASE WHEN a IN ('timeout', 'network_error', 'target_error') AND b IS NOT NULL THEN 2 ELSE 1 END AS n_attempts FROM p""")
def retry_outcomes(spark: SparkSession, d: str) -> DataFrame:
    m = (F.col("doc_id") * 5) % 7
    status = F.when(m == 0, "timeout").when(m == 1, "network_error").when(m == 2, "blocked").otherwise("success")
    a = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 2).alias("candidate"), (F.col("doc_id") % 2 + 1).alias("attempt"), status.alias("status"))
    return contracts.retried(a, ["candidate"])


@query("urls_in_text", r"""
    SELECT page_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(t, 'https?://[^\s<>"''`]+'), lambda u: regexp_replace(u, '(\*+|[.,;:!?]+|\]\([^)]*\)?|[\])}]+)+$', '')))), ' ') AS found
    FROM (SELECT page_id, 'See (' || url || '), or **' || url || '**. Also ' || regexp_replace(url, '[?#].*$', '') || '!' AS t FROM pages)""")
def urls_in_text(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.lit("See ("), "url", F.lit("), or **"), "url", F.lit("**. Also "), urls.log_safe(F.col("url")), F.lit("!"))
    return table(spark, d, "pages").select("page_id", F.array_join(F.array_sort(contracts.urls_in(t)), " ").alias("found"))


@query("revalidation_headers", """
    SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'if-none-match=e' || event_id ELSE '' END || CASE WHEN event_id % 6 = 0 THEN ';' ELSE '' END || CASE WHEN event_id % 3 = 0 THEN 'if-modified-since=m' || event_id ELSE '' END AS asked,
        CAST(1 + (event_id % 2 = 0)::INT + (event_id % 3 = 0)::INT AS INTEGER) AS n_directives FROM events""")
def revalidation_headers(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    text = lambda p: F.concat(F.lit(p), i.cast("string"))
    pair = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    h = F.map_from_entries(F.array_compact(F.array(F.when(i % 2 == 0, pair("ETag", text("e"))), F.when(i % 3 == 0, pair("Last-Modified", text("m"))), pair("Content-Type", F.lit("text/html")), pair("X-Other", F.lit("1")))))
    e = table(spark, d, "events").select("event_id", h.alias("h"))
    asked = F.array_join(F.transform(F.map_entries(contracts.conditional(F.col("h"))), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";")
    return e.select("event_id", asked.alias("asked"), F.size(F.map_keys(contracts.directives(F.col("h")))).alias("n_directives"))


@query("log_lines", """
    SELECT sum(length(v))::BIGINT AS n_chars, count(*)::BIGINT AS n, count(DISTINCT v)::BIGINT AS n_distinct FROM (SELECT '{"event":"open","status":"' || lang || '","url":"https://h.example/' || doc_id || '"}' AS v FROM documents)""")
def log_lines(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "documents").select(F.lit("open").alias("event"), F.col("lang").alias("status"), F.concat(F.lit("https://h.example/"), F.col("doc_id").cast("string"), F.lit("?q=secret#x")).alias("url"), F.col("text").alias("private"))
    return sinks.log_lines(e).agg(F.sum(F.length("value")).alias("n_chars"), F.count("*").alias("n"), F.countDistinct("value").alias("n_distinct"))


_ANSWER = "'# https://h.example/' || doc_id || chr(10) || chr(10) || 'https://h.example/' || doc_id || chr(10) || chr(10) || text || chr(10) || chr(10) || '````txt' || chr(10) || 'a ``` b' || chr(10) || '````'"


@query("answer_text", f"SELECT doc_id AS answer, CAST(length({_ANSWER}) AS INTEGER) AS n_chars, sha256({_ANSWER}) AS body_sha256 FROM documents")
def answer_text(spark: SparkSession, d: str) -> DataFrame:
    """One answer per document, of any length: groups stay small."""
    r = table(spark, d, "documents").select(
        F.col("doc_id").alias("answer"), F.col("doc_id").alias("place"), F.lit(None).cast("string").alias("title"), F.concat(F.lit("https://h.example/"), "doc_id").alias("url"),
        F.array(F.struct(F.col("text"))).alias("passages"), F.array(F.struct(F.lit("txt").alias("language"), F.lit("a ``` b").alias("text"))).alias("code"),
    )
    return sinks.render(r, "answer").select("answer", F.length("body").alias("n_chars"), F.sha2("body", 256).alias("body_sha256"))


@query("sanitised_props", """
    SELECT event_id, '{"deep": [{"path": "[path]"}], "props": {"k": ' || (props->>'$.k') || '}, "token": "[redacted]"}' AS clean, true AS valid FROM events""")
def sanitised_props(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.concat(F.lit('{"token": "x", "deep": [{"path": "/home/u/f"}], "props": '), "props", F.lit("}")).alias("v"))
    return contracts.sanitised_json(e, "event_id", "v")


# Word pairs of each question: its first two longer words, or the same one twice.
_PAIRS = """SELECT item_id AS "group", list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}')[1:2]) AS words FROM benchmark WHERE len(regexp_extract_all(lower(text), '[a-z]{3,}')) > 1"""


@query("concept_windows", rf"""
    WITH g AS ({_PAIRS}), u AS (SELECT "group", words[1] AS x, words[len(words)] AS y FROM g), w AS (SELECT DISTINCT x AS w FROM u UNION SELECT DISTINCT y FROM u),
    p AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[^a-z0-9]*[a-z0-9]+')) AS piece, generate_subscripts(regexp_extract_all(lower(text), '[^a-z0-9]*[a-z0-9]+'), 1) AS k FROM documents),
    q AS (SELECT doc_id, regexp_extract(piece, '[a-z0-9]+$') AS word, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY k) - length(regexp_extract(piece, '[a-z0-9]+$')) AS pos FROM p),
    h AS (SELECT doc_id, word, pos FROM q WHERE word IN (SELECT w FROM w))
    SELECT DISTINCT a.doc_id, u."group" FROM u JOIN h a ON a.word = u.x JOIN h b ON b.doc_id = a.doc_id AND b.word = u.y AND abs(b.pos - a.pos) <= 20""")
def concept_windows(spark: SparkSession, d: str) -> DataFrame:
    """Documents in which two words of a question start within 20 characters of each other."""
    found = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))
    groups = table(spark, d, "benchmark").select(F.col("item_id").alias("group"), found.alias("w")).where(F.size("w") > 1).select("group", F.array_distinct(F.slice("w", 1, 2)).alias("words"))
    return grading.near_texts(table(spark, d, "documents"), "doc_id", "text", groups, 20)
