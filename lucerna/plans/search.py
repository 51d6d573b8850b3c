"""The whole search as one plan: rank before rendering, extract, rank again, fold, emit at most once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lucerna.functions import scoring, texts, urls
from lucerna.operators import answering, extraction, retrieval, runs, store
from lucerna.plans import evidence
from lucerna.plans.registry import registry
from lucerna.session import saved
from lucerna.sources.readers import table

QUERIES, ORACLE_SQL, query = registry()


def answers(questions: DataFrame, pages: DataFrame, ranked: DataFrame, consumed: DataFrame, wanted: int = 5) -> DataFrame:
    """(item_id, place, page_id, score, confidence, n_passages, content_hash): what each question is answered with.

    ``questions`` is (item_id, units), ``pages`` (page_id, url, html), ``ranked``
    the candidates (item_id, rank, page_id) that rendering is spent on, ``consumed``
    (item_id, url) what earlier answers of a question gave away.  Equal contents of
    one site fold to the best-placed page; a page is emitted once.
    """
    body = texts.html_to_text(F.col("html"))
    read = pages.select("page_id", "url", urls.site(urls.host(F.col("url"))).alias("site"), body.alias("body"))
    spent = ranked.select("item_id", "page_id", F.col("rank").alias("pos")).join(read, "page_id").join(questions, "item_id")
    spent = spent.withColumn("key", F.concat_ws("/", F.col("item_id").cast("string"), F.col("page_id").cast("string")))
    cut = extraction.blocks(spent, "key", "body")
    best = extraction.best_passages(cut, "key", spent.select("key", "units"))
    own = best.groupBy("key").agg(F.count("*").alias("n_passages"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n"), 256).alias("content_hash"), F.max_by("text", -F.col("rank")).alias("lead"))
    both = spent.join(own, "key")
    concept, passage = scoring.coverage(F.col("units"), F.lower("body")), scoring.coverage(F.col("units"), F.lower("lead"))
    one = F.lit(1.0)
    score = scoring.postrank(passage, concept, one, one, scoring.position(F.col("pos")), scoring.quality(F.col("body"), F.lit(0), F.lit(0), F.lit(0.0)), F.lit(0.5), F.lit("general"))
    both = both.withColumn("score", F.round(score, 9)).where(concept > 0)
    w = Window.partitionBy("item_id", "site", F.sha2("body", 256)).orderBy(F.desc("score"), "url", "page_id")
    both = both.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    both = store.reserve(both.drop("_n"), consumed, ["item_id", "url"], ["page_id"])
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), "url", "page_id")
    both = both.withColumn("place", F.row_number().over(w)).where(F.col("place") <= wanted)
    return both.select("item_id", "place", "page_id", F.round("score", 6).alias("score"), scoring.confidence(F.col("score")).alias("confidence"), "n_passages", "content_hash")


@query("search_full")
def search_full(spark: SparkSession, d: str) -> DataFrame:
    ranked = evidence.prerank_topk(spark, d, 30)
    pages = table(spark, d, "pages").select("page_id", "url", "html")
    # a user's turn of a conversation asked a question before; what it was given isn't given again
    n = pages.agg(F.count("*").alias("n"))
    seen = (F.col("conv_id") * 31 + F.col("turn") * 7) % F.col("n")
    before = table(spark, d, "conversations").where("role = 'user'").join(F.broadcast(n)).select(F.col("conv_id").alias("item_id"), seen.alias("page_id")).distinct()
    return answers(evidence._questions(spark, d).select("item_id", "units"), pages, ranked, before.join(pages, "page_id").select("item_id", "url"))


@query("search_summary")
def search_summary(spark: SparkSession, d: str) -> DataFrame:
    """Status and confidence of each question's answer, questions without one included."""
    a = search_full(spark, d).groupBy("item_id").agg(F.count("*").alias("n"), F.bool_or(F.col("score") >= 0.4).alias("fair"))
    q = table(spark, d, "benchmark").select("item_id").join(a, "item_id", "left")
    n = F.coalesce("n", F.lit(0))
    status, confidence = store.status(n, F.lit(5), F.coalesce("fair", F.lit(False)))
    return q.select("item_id", n.alias("n_results"), status.alias("status"), confidence.alias("confidence"))


# Questions' discovery, the same in both languages: engines that block, fail or answer nothing, by the question.
_DISCOVERY = """SELECT item_id, CASE item_id % 5 WHEN 0 THEN 'blocked' WHEN 1 THEN 'error' WHEN 2 THEN 'parse_failure' ELSE 'parsed' END AS status,
    CASE item_id % 5 WHEN 0 THEN CASE WHEN item_id % 2 = 0 THEN 'google_captcha' ELSE 'waf' END WHEN 1 THEN 'navigation_timeout' END AS reason FROM benchmark"""


def _discovery(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("item_id")
    m = i % 5
    status = F.when(m == 0, "blocked").when(m == 1, "error").when(m == 2, "parse_failure").otherwise("parsed")
    reason = F.when(m == 0, F.when(i % 2 == 0, "google_captcha").otherwise("waf")).when(m == 1, "navigation_timeout")
    return table(spark, d, "benchmark").select(i.alias("question"), status.alias("status"), reason.alias("reason"))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """(question, term): two words of each question, so that some entries hold them all."""
    words = F.slice(F.filter(texts.words(F.col("text")), lambda w: F.length(w) > 3), 1, 2)
    return table(spark, d, "benchmark").select(F.col("item_id").alias("question"), F.explode(F.array_distinct(words)).alias("term"))


def _held(spark: SparkSession, d: str) -> DataFrame:
    """Documents as entries of the cache."""
    i = F.col("doc_id")
    url = F.concat(F.lit("https://"), "source", F.lit(".example/d/"), i.cast("string"))
    fetched = F.timestamp_seconds(F.unix_seconds(F.to_timestamp(F.lit(_NOW))) - (i % 48) * 3600)
    return table(spark, d, "documents").select(url.alias("canonical_url"), F.col("text").alias("content"), fetched.alias("fetched"), F.lit(None).cast("string").alias("cache_control"), F.lit("general").alias("content_class"), "doc_id")


_NOW, _WANTED = "2024-06-01 12:00:00", 5


def _local(spark: SparkSession, d: str, held: DataFrame) -> DataFrame:
    """(question, rank, url, bm25): what the cache's index holds for each question."""
    docs = held.select("canonical_url", F.concat_ws(" ", "canonical_url", "content").alias("text"))
    totals = docs.agg(F.count("*"), F.avg(F.size(texts.words(F.col("text")))))
    return retrieval.bm25(_asked(spark, d), retrieval.postings(docs, "canonical_url", "text"), totals, "canonical_url", "question", _WANTED).select("question", "rank", F.col("canonical_url").alias("url"), F.col("score").alias("bm25"))


_CACHED = rf"""
    e AS (SELECT doc_id, 'https://' || source || '.example/d/' || doc_id AS url, text FROM documents), w AS (SELECT url, regexp_extract_all(lower(url || ' ' || text), '[\p{{L}}\p{{N}}]+') AS w FROM e),
    n AS (SELECT count(*) AS n, avg(len(w)) AS a FROM w), t AS (SELECT url, len(w) AS l, unnest(w) AS term FROM w), p AS (SELECT url, l, term, count(*) AS tf FROM t GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    q AS (SELECT item_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), lambda x: length(x) > 3)[1:2])) AS term FROM benchmark), k AS (SELECT item_id, count(*) AS k FROM q GROUP BY item_id),
    s AS (SELECT q.item_id, p.url, sum(greatest(ln((n.n - f.df + 0.5) / (f.df + 0.5)), 1e-6) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * p.l / n.a))) AS bm25, count(*) AS c FROM q JOIN p USING (term) JOIN f USING (term), n GROUP BY ALL),
    l AS (SELECT s.*, row_number() OVER (PARTITION BY item_id ORDER BY round(bm25, 9) DESC, url) AS rank FROM s JOIN k USING (item_id) WHERE c = k QUALIFY rank <= 5)"""


@query("cached_answer", f"""
    WITH d AS ({_DISCOVERY}), {_CACHED}
    SELECT item_id AS question, CAST(rank AS INTEGER) AS place, url, round(bm25, 6) AS bm25, sha256(e.text) AS content_hash FROM l JOIN d USING (item_id) JOIN e USING (url) WHERE d.status IN ('blocked', 'error', 'parse_failure') AND e.text <> ''""")
def cached_answer(spark: SparkSession, d: str) -> DataFrame:
    """What the cache alone offers each question whose discovery gave nothing: whole entries, by the index's order."""
    held = _held(spark, d)
    failed = _discovery(spark, d).where("status IN ('blocked', 'error', 'parse_failure')").select("question")
    hits = _local(spark, d, held).join(failed, "question", "left_semi").join(held.select(F.col("canonical_url").alias("url"), "content"), "url")
    whole = runs.cached_document(hits.where("content <> ''"), "url", "content").select("url", "content_hash").distinct()
    return hits.join(whole, "url").select("question", F.col("rank").alias("place"), "url", F.round("bm25", 6).alias("bm25"), "content_hash")


def live(questions: DataFrame, discovered: DataFrame, found: DataFrame, local: DataFrame, cached: DataFrame, robots: DataFrame, renders: DataFrame, consumed: DataFrame, now, wanted: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Answers as they are wired: one plan for questions that discovery answered and for those that only the cache can.

    ``questions``: question, units, profile, temporal, asks; ``discovered``: question,
    status, reason; ``found``: question, pos, url, source_type, title; ``local``:
    question, rank, url of the index's best entries; the others as ``answering``
    takes them.  Returns (question, place, url, score, outcome, content_hash,
    n_passages), the status of every question, and the pages to put into the cache
    (url, content, mime).
    """
    answered = discovered.where("status NOT IN ('blocked', 'error', 'parse_failure')").select("question")
    every = answering.merged(found.join(answered, "question", "left_semi"), local).join(questions, "question")
    path, said = urls.path(F.col("url")), F.lower(F.concat_ws(" ", "title", "url"))
    bonus = F.when(F.col("asks") & path.rlike(texts.DOCUMENTATION_PATH), 0.15).otherwise(0.0)
    score = scoring.prerank(scoring.coverage(F.col("units"), said), scoring.position(F.col("pos")), scoring.type_score(F.col("source_type"), F.col("profile")), F.lit(1.0), bonus)
    dated = urls.dated_version(F.col("url"))
    newest = F.max(dated).over(Window.partitionBy("question", urls.host(F.col("url"))))
    every = every.withColumn("score", score + F.when(F.col("temporal") & (dated == newest), 0.25).otherwise(0.0))
    first = F.row_number().over(Window.partitionBy("question").orderBy(F.desc(F.round("score", 9)), "url"))
    spent = every.withColumn("_n", first).where(F.col("_n") <= answering.BUDGET).select("question", "url", "source_type", "units", F.round("score", 9).alias("score"))
    pages = saved(answering.prepared(spent, robots, cached, renders, now), "prepared")
    results = answering.filled(pages, consumed, wanted)
    content = F.sha2(F.array_join(F.transform("passages", lambda p: p["text"]), "\n"), 256)
    out = results.select("question", "place", "url", "score", "outcome", content.alias("content_hash"), F.size("passages").alias("n_passages"))
    status = answering.answer_status(discovered, results, wanted)
    return out, status, pages.where("content IS NOT NULL").select("url", "content", "mime").distinct()


def _live(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every question against the pages; a page's number says how its host's robots file, its rendering and its type turn out."""
    questions = evidence._questions(spark, d).withColumnRenamed("item_id", "question")
    i, host = F.col("page_id"), F.floor(F.col("page_id") / 5)
    url = F.concat(F.lit("https://p"), host.cast("string"), F.lit(".example/"), F.when(i % 4 == 0, "private/").otherwise("docs/"), i.cast("string"))
    pages = table(spark, d, "pages").select("page_id", url.alias("url"), F.coalesce(texts.title_of(F.col("html")), F.lit("")).alias("title"), "html", evidence._kind(i).alias("source_type"))
    found = evidence.prerank_topk(spark, d, 12).select(F.col("item_id").alias("question"), F.col("rank").alias("pos"), "page_id").join(pages, "page_id").select("question", "pos", "url", "source_type", "title")
    held = _held(spark, d)
    local = _local(spark, d, held).select("question", "rank", "url")
    own, status, body = _robots(F.regexp_extract("url", "^https://p([0-9]+)", 1).cast("long"))
    robots = pages.select(urls.host(F.col("url")).alias("host"), status.alias("status"), body.alias("body"), own.alias("_own")).where("_own").drop("_own").distinct()
    # documents are asked for again too: their sites answer, one in three that nothing has changed
    sites = held.select(urls.host(F.col("canonical_url")).alias("host")).distinct().select("host", F.lit(404).alias("status"), F.lit(None).cast("string").alias("body"))
    rendered = pages.where("page_id % 7 <> 3").select("url", _type(i).alias("content_type"), F.when(i % 5 != 4, F.col("html")).alias("body"), F.lit(False).alias("not_modified"), F.when(i % 5 == 4, "timeout").alias("error"))
    again = held.where("doc_id % 3 <> 2").select(F.col("canonical_url").alias("url"), F.lit("text/plain").alias("content_type"), F.when(F.col("doc_id") % 3 == 1, F.col("content")).alias("body"), (F.col("doc_id") % 3 == 0).alias("not_modified"), F.lit(None).cast("string").alias("error"))
    before = table(spark, d, "conversations").where("role = 'user'").select(F.col("conv_id").alias("question"), F.col("turn").alias("doc_id")).join(held, "doc_id").select("question", F.col("canonical_url").alias("url"))
    return live(questions, _discovery(spark, d), found, local, held.drop("doc_id"), robots.unionByName(sites), rendered.unionByName(again), before, F.to_timestamp(F.lit(_NOW)), _WANTED)


def _robots(n):
    """Whether a host's robots file was asked for, the status and the body of the answer, by the host's number."""
    m = n % 6
    body = F.when(m == 2, "User-agent: *\nDisallow: /private/").when(m == 3, "User-agent: other\nDisallow: /").when(m == 4, "User-agent: Lucerna\nDisallow: /\nAllow: /docs/")
    return m != 5, F.when(m == 0, 404).when(m == 1, 500).otherwise(200), body


def _type(i):
    return F.when(i % 8 == 5, "image/png").when(i % 8 == 6, "application/pdf").otherwise("text/html; charset=utf-8")


@query("search_live")
def search_live(spark: SparkSession, d: str) -> DataFrame:
    return _live(spark, d)[0]


@query("search_live_status")
def search_live_status(spark: SparkSession, d: str) -> DataFrame:
    return _live(spark, d)[1]


@query("prepare_candidates", """
    WITH c AS (SELECT page_id, page_id // 5 AS h, CASE WHEN page_id % 4 = 0 THEN '/private/' ELSE '/docs/' END AS path, CASE WHEN page_id % 3 = 0 THEN 'local_cache' ELSE 'organic' END AS kind, html FROM pages),
    a AS (SELECT *, CASE h % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN path <> '/private/' WHEN 3 THEN true WHEN 4 THEN path = '/docs/' ELSE false END AS allowed,
        kind = 'local_cache' AND page_id % 15 <> 0 AS usable, page_id % 48 < 24 AS fresh, 'entry ' || page_id AS held FROM c),
    s AS (SELECT *, CASE WHEN NOT allowed THEN 'robots' WHEN usable AND fresh THEN 'cached' WHEN page_id % 7 = 3 THEN 'not_rendered' WHEN page_id % 5 = 4 THEN 'timeout'
        WHEN usable AND page_id % 2 = 0 THEN 'confirmed' WHEN page_id % 8 = 5 THEN 'unsupported_format' WHEN page_id % 8 = 6 THEN 'unsupported_or_ocr_required' ELSE 'rendered' END AS state FROM a)
    SELECT page_id, CASE WHEN state IN ('cached', 'confirmed', 'rendered') THEN state ELSE 'dropped' END AS outcome, CASE WHEN state NOT IN ('cached', 'confirmed', 'rendered') THEN state END AS reason,
        CASE WHEN state IN ('cached', 'confirmed') THEN sha256(held) END AS held_sha256, state = 'rendered' AS stored FROM s""")
def prepare_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Every page as a candidate, with all that can go wrong: each that drops out says why, and no other is touched."""
    i = F.col("page_id")
    h = F.floor(i / 5)
    url = F.concat(F.lit("https://p"), h.cast("string"), F.lit(".example"), F.when(i % 4 == 0, "/private/").otherwise("/docs/"), i.cast("string"))
    pages = table(spark, d, "pages").select("page_id", "html", url.alias("url"))
    c = pages.select("page_id", (i % 10).alias("question"), "url", F.when(i % 3 == 0, "local_cache").otherwise("organic").alias("source_type"), F.array(F.lit("the")).alias("units"))
    own, status, body = _robots(F.floor(i / 5))
    robots = pages.where(own).select(urls.host(F.col("url")).alias("host"), status.alias("status"), body.alias("body")).distinct()
    fetched = F.timestamp_seconds(F.unix_seconds(F.to_timestamp(F.lit(_NOW))) - (i % 48) * 3600)
    held = F.when(i % 15 != 0, F.concat(F.lit("entry "), i.cast("string"))).otherwise("")
    cached = pages.where("page_id % 3 = 0").select(F.col("url").alias("canonical_url"), held.alias("content"), fetched.alias("fetched"), F.lit(None).cast("string").alias("cache_control"), F.lit("general").alias("content_class"))
    shown = F.when(i % 8 == 6, "%PDF-1.4").otherwise(F.concat(F.lit("<p>page</p>"), "html"))
    renders = pages.where("page_id % 7 <> 3").select("url", _type(i).alias("content_type"), shown.alias("body"), (i % 2 == 0).alias("not_modified"), F.when(i % 5 == 4, "timeout").alias("error"))
    out = answering.prepared(c, robots, cached, renders, F.to_timestamp(F.lit(_NOW)))
    kept = F.col("outcome").isin("cached", "confirmed")
    return out.select("page_id", "outcome", "reason", F.when(kept, F.col("passages")[0]["hash"]).alias("held_sha256"), F.col("content").isNotNull().alias("stored"))
