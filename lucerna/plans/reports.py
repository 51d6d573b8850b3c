"""Queries over ranked pages, reports of runs, and the records that contracts and investigations keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lucerna.functions import scoring, texts, urls
from lucerna.operators import contracts, discovery, ranking, runs, store
from lucerna.plans import evidence
from lucerna.plans.registry import registry
from lucerna.session import saved
from lucerna.sources.readers import table

QUERIES, ORACLE_SQL, query = registry()

_N = "(SELECT count(*) FROM benchmark)"
_COVERED = "CAST(len(list_filter(units, lambda u: contains({0}, u))) AS DOUBLE) / len(units)"


@query("ranked_pages", rf"""
    WITH c AS (SELECT doc_id, doc_id % {_N} AS item_id, 'https://p.example/' || doc_id AS url, 'Title ' || source AS title, text AS content, ['Part ' || lang, 'End'] AS headings, CASE WHEN doc_id % 4 = 0 THEN ['see ' || source] END AS anchors,
        {evidence._KIND.format("doc_id")} AS kind, CASE WHEN doc_id % 6 <> 0 THEN doc_id % 7 + 1 END AS pos, doc_id % 2 = 0 AS author, doc_id % 3 = 0 AS citations, CASE WHEN doc_id % 5 = 0 THEN 0.4 END AS boilerplate FROM documents
        WHERE doc_id % 10 <> 1 AND doc_id % 10 <> 2 AND doc_id % 10 <> 3),
    p AS (SELECT doc_id, list_filter(string_split(lower(text), chr(10)), lambda l: l <> '') AS lines FROM documents WHERE doc_id % 5 <> 4),
    x AS (SELECT c.*, units, profile, temporal, lower(title || ' ' || array_to_string(headings, ' ') || CASE WHEN content <> '' THEN ' ' || content ELSE '' END || CASE WHEN anchors IS NOT NULL THEN ' ' || array_to_string(anchors, ' ') ELSE '' END) AS page, p.lines FROM c JOIN ({evidence._QUESTIONS}) q USING (item_id) LEFT JOIN p USING (doc_id)),
    s AS (SELECT item_id, url, kind, title, profile, {_COVERED.format("page")} AS concept, coalesce(list_max(list_transform(lines, lambda l: {_COVERED.format("l")})), 0) AS passage,
        CASE WHEN pos > 0 THEN 1.0 / pos ELSE 0.5 END AS place, least(1.0, greatest(0.0, 0.45 * (CASE WHEN length(trim(coalesce(content, ''))) >= 800 THEN 1 WHEN length(trim(coalesce(content, ''))) >= 200 THEN 0.6 ELSE 0.25 END) + 0.2 * 0.5 + 0.35 * ((author::INT + citations::INT) / 3) - 0.3 * coalesce(boilerplate, 0))) AS good,
        CASE WHEN temporal AND doc_id % 3 <> 0 THEN greatest(0.0, 1 - (doc_id % 400) / 365) ELSE 0.5 END AS fresh FROM x),
    b AS (SELECT *, 0.35 * passage + 0.2 * concept + 0.15 * {evidence._typed("'general'", "kind")} + 0.15 * place + 0.1 * good + 0.05 * fresh AS base FROM s WHERE concept > 0),
    r AS (SELECT item_id, url, kind, title, round(least(1.0, CASE WHEN profile = 'general' THEN base ELSE 0.7 * base + 0.3 * least(1.0, 0.7 * base + 0.3 * ({evidence._typed("profile", "kind")})) END), 9) AS score FROM b)
    SELECT item_id AS question, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, url) AS INTEGER) AS rank, round(score, 6) AS score, CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS confidence, url, kind AS source_type, title FROM r""")
def ranked_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a page found for one question: fields apart, lines as passages, some pages not eligible."""
    i = F.col("doc_id")
    n = table(spark, d, "benchmark").agg(F.count("*").alias("n"))
    url = F.concat(F.lit("https://p.example/"), i.cast("string"))
    docs = table(spark, d, "documents")
    published = F.timestamp_seconds(F.unix_seconds(F.to_timestamp(F.lit(evidence._OBSERVED))) - (i % 400) * 86400)
    c = docs.join(F.broadcast(n)).select(
        (i % F.col("n")).alias("question"), url.alias("url"), F.concat(F.lit("Title "), "source").alias("title"), F.col("text").alias("content"), F.array(F.concat(F.lit("Part "), "lang"), F.lit("End")).alias("headings"),
        F.when(i % 4 == 0, F.array(F.concat(F.lit("see "), "source"))).alias("anchors"), evidence._kind(i).alias("source_type"), F.when(i % 6 != 0, i % 7 + 1).alias("pos"), (i % 2 == 0).alias("has_author"), (i % 3 == 0).alias("has_citations"),
        F.lit(None).cast("boolean").alias("original"), F.when(i % 5 == 0, 0.4).alias("boilerplate"), F.when(i % 3 != 0, published).alias("published"),
        F.when(i % 10 == 1, False).alias("extractable"), F.when(i % 10 == 2, False).alias("supported"), F.when(i % 10 == 3, True).alias("duplicate"),
    )
    passages = docs.where("doc_id % 5 <> 4").select(url.alias("url"), F.explode(F.split("text", "\n")).alias("text")).where("text <> ''")
    questions = evidence._questions(spark, d).select(F.col("item_id").alias("question"), "units", "profile", "temporal")
    out = ranking.ranked_pages(c, passages, questions, F.to_timestamp(F.lit(evidence._OBSERVED)))
    return out.withColumn("score", F.round("score", 6))


_STATUS = "(['success', 'partial', 'blocked', 'error', 'no_relevant_results'])[(doc_id // 8) % 5 + 1]"


def _cases(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Cases of eight documents each, their grades, statuses and claims."""
    case = F.floor(F.col("doc_id") / 8)
    docs = table(spark, d, "documents")
    status = F.element_at(F.array(*map(F.lit, ("success", "partial", "blocked", "error", "no_relevant_results"))), (case % 5 + 1).cast("int"))
    cases = docs.groupBy(case.alias("case_id")).agg(F.min("lang").alias("category"), F.sum("n_chars").alias("n"))
    graded = cases.where("case_id % 7 <> 3").select("case_id", (F.col("n") % 101).cast("double").alias("total"))
    graded = graded.withColumn("classification", scoring.classification(F.col("total")))
    statuses = docs.where("doc_id % 3 <> 5").select(case.alias("case_id"), status.alias("status")).distinct()
    passage = F.array(F.struct(F.lit("https://h.example/").alias("url"), F.lit("x").alias("text")))
    claims = table(spark, d, "labels").select(case.alias("case_id"), F.col("doc_id").alias("claim_id"), F.when(F.col("quality") == 1, passage).otherwise(F.array().cast("array<struct<url:string,text:string>>")).alias("passages"))
    return cases.select("case_id", "category", (F.col("case_id") % 4 == 0).alias("calibration")), graded, statuses, claims


@query("report_scores", f"""
    WITH c AS (SELECT doc_id // 8 AS case_id, min(lang) AS category, sum(n_chars) % 101 AS total, min({_STATUS}) AS status FROM documents GROUP BY 1),
    g AS (SELECT *, CASE WHEN case_id % 7 <> 3 AND status NOT IN ('blocked', 'error') THEN total::DOUBLE END AS t FROM c)
    SELECT case_id, category, CASE WHEN case_id % 4 = 0 THEN 'calibration' ELSE 'validation' END AS split, status, t AS total, CASE WHEN t IS NULL THEN 'unmeasurable' WHEN t >= 85 THEN 'excellent' WHEN t >= 70 THEN 'relevant' WHEN t >= 50 THEN 'degraded' ELSE 'not_relevant' END AS classification FROM g""")
def report_scores(spark: SparkSession, d: str) -> DataFrame:
    cases, graded, statuses, _ = _cases(spark, d)
    return runs.report_scores(cases, graded, statuses, "full")


@query("report_left_out", "SELECT doc_id // 8 AS case_id, doc_id AS claim_id, 'no URL-located evidence passage' AS reason FROM labels WHERE quality <> 1")
def report_left_out(spark: SparkSession, d: str) -> DataFrame:
    return runs.left_out(_cases(spark, d)[3])


@query("report_verdict", f"""
    WITH s AS (SELECT doc_id // 8 AS case_id, min({_STATUS}) AS status FROM documents GROUP BY 1), a AS (SELECT count(*) AS cases, count(*) FILTER (WHERE status IN ('blocked', 'error')) AS blocked FROM s), b AS (SELECT count(*) AS accepted, count(*) FILTER (WHERE quality = 1) AS located FROM labels)
    SELECT cases, accepted, located, blocked, 'not_gateable: ' || located || ' of ' || accepted || ' accepted claims carry a URL-located evidence passage; the measured scores are published for observation and never gate a release.'
        || CASE WHEN blocked > 0 THEN ' ' || blocked || ' case(s) did not complete a search and are blocked rather than badly answered.' ELSE '' END AS verdict FROM a, b""")
def report_verdict(spark: SparkSession, d: str) -> DataFrame:
    cases, graded, statuses, claims = _cases(spark, d)
    return runs.verdict(runs.report_scores(cases, graded, statuses, "full"), claims, "full")


@query("override_records", """
    WITH o AS (SELECT user_id AS investigation_id, event_id AS seq, 'https://h.example/' || event_id AS url, ts FROM events WHERE event_type IN ('error', 'view'))
    SELECT investigation_id, CAST(row_number() OVER (PARTITION BY investigation_id ORDER BY seq) AS INTEGER) AS place, seq, url, CAST(floor(epoch(ts)) AS BIGINT) AS recorded_at FROM o""")
def override_records(spark: SparkSession, d: str) -> DataFrame:
    """Openings against robots rules, appended in two batches that share some, as each investigation lists them."""
    i, kind = F.col("event_id"), F.col("event_type")
    e = table(spark, d, "events").select(F.col("user_id").alias("investigation_id"), i.alias("seq"), F.concat(F.lit("https://h.example/"), i.cast("string")).alias("url"), F.col("ts").alias("recorded_at"), F.when(kind.isin("error", "view"), "ignored").otherwise("allowed").alias("decision"))
    log = store.override_log(store.override_log(None, e.where("seq % 3 <> 0")), e.where("seq % 2 = 0 OR seq % 3 = 0"))
    place = F.row_number().over(Window.partitionBy("investigation_id").orderBy("seq"))
    return log.select("investigation_id", place.alias("place"), "seq", "url", F.unix_seconds(F.col("recorded_at").cast("timestamp")).alias("recorded_at"))


@query("investigations_ensured", """
    SELECT user_id AS investigation_id, CAST(CASE WHEN user_id % 3 = 0 THEN -user_id ELSE min(event_id) END AS BIGINT) AS opened FROM events GROUP BY user_id""")
def investigations_ensured(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "events").select(F.col("user_id").alias("investigation_id"), F.col("event_id").alias("at"))
    known = calls.where("investigation_id % 3 = 0").select("investigation_id").distinct().select("investigation_id", (-F.col("investigation_id")).cast("long").alias("opened"))
    return store.ensured(store.ensured(known, calls), calls)


_KEYS = tuple(contracts.CATEGORIES)


@query("corpus_violations", f"""
    WITH c AS (SELECT CASE doc_id % 20 WHEN 3 THEN 'Case ' || doc_id WHEN 4 THEN 'case-' || (doc_id - 1) WHEN 5 THEN 'case-' || (doc_id - 2) ELSE 'case-' || doc_id END AS id, CASE WHEN doc_id % 13 = 0 THEN ' ' ELSE coalesce(text, '') END AS question,
        CASE WHEN doc_id % 17 = 0 THEN 'x' ELSE lang END AS locale, CASE WHEN doc_id % 19 = 0 THEN 'other' ELSE ([{", ".join(f"'{k}'" for k in _KEYS)}])[doc_id % 6 + 1] END AS category FROM documents),
    n AS (SELECT *, count(*) OVER (PARTITION BY id) AS n_same FROM c),
    v AS (SELECT id, list_filter([CASE WHEN NOT regexp_matches(id, '^[a-z0-9]+(-[a-z0-9]+)*$') THEN 'id_slug' END, CASE WHEN n_same > 1 THEN 'id_unique' END, CASE WHEN trim(question) = '' THEN 'question_given' END, CASE WHEN length(trim(locale)) < 2 THEN 'locale_given' END,
        CASE WHEN category = 'other' THEN 'category_known' END], lambda x: x IS NOT NULL) AS v FROM n),
    k AS (SELECT category AS id, count(*) AS n FROM c WHERE category <> 'other' GROUP BY category)
    SELECT id, array_to_string(v, ',') AS violations FROM v WHERE len(v) > 0 UNION ALL SELECT id, 'category_count' FROM k WHERE n <> CASE id {" ".join(f"WHEN '{k}' THEN {n}" for k, n in contracts.CATEGORIES.items())} END""")
def corpus_violations(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    m = i % 20
    name = lambda x: F.concat(F.lit("case-"), x.cast("string"))
    key = F.when(m == 3, F.concat(F.lit("Case "), i.cast("string"))).when(m == 4, name(i - 1)).when(m == 5, name(i - 2)).otherwise(name(i))
    category = F.when(i % 19 == 0, "other").otherwise(F.element_at(F.array(*map(F.lit, _KEYS)), (i % 6 + 1).cast("int")))
    c = table(spark, d, "documents").select(key.alias("id"), F.when(i % 13 == 0, " ").otherwise(F.coalesce("text", F.lit(""))).alias("question"), F.when(i % 17 == 0, "x").otherwise(F.col("lang")).alias("locale"), category.alias("category"))
    return contracts.corpus_violations(c).select("id", F.array_join("violations", ",").alias("violations"))


@query("concept_words", r"""
    WITH c AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[a-z]{3,}') AS w FROM documents WHERE text IS NOT NULL),
    k AS (SELECT doc_id, text, [coalesce(w[1], '') || '_' || coalesce(w[len(w)], ''), CASE WHEN doc_id % 3 = 0 THEN 'qqzz' ELSE coalesce(w[2], '') END] AS concepts FROM c)
    SELECT doc_id, len(list_filter(concepts, lambda c: len(list_filter(regexp_split_to_array(c, '[^\p{L}\p{N}]+'), lambda x: x <> '' AND NOT contains(lower(text), x))) > 0)) = 0 AS held FROM k""")
def concept_words(spark: SparkSession, d: str) -> DataFrame:
    """Whether each document holds the words of two concepts, in whatever order; every third lacks one."""
    w = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))
    docs = table(spark, d, "documents").where("text IS NOT NULL").withColumn("w", w)
    at = lambda k: F.coalesce(F.try_element_at("w", k), F.lit(""))
    last = F.when(F.size("w") > 0, F.element_at("w", -1)).otherwise("")
    both = F.array(F.concat(at(F.lit(1)), F.lit("_"), last), F.when(F.col("doc_id") % 3 == 0, "qqzz").otherwise(at(F.lit(2))))
    return docs.select("doc_id", texts.holds_concepts(F.col("text"), both).alias("held"))


@query("discovery_chain")
def discovery_chain(spark: SparkSession, d: str) -> DataFrame:
    """Users' questions through the whole chain; engines answer with pages, by the length of what is asked of them."""
    asked = table(spark, d, "conversations").where("role = 'user'").select(F.col("text").alias("question")).where("question <> ''").distinct()
    pages = table(spark, d, "pages").select(F.col("page_id"), "url", F.coalesce(texts.title_of(F.col("html")), F.lit("")).alias("title"))
    pages = saved(pages, "pages")
    n = pages.agg(F.count("*").alias("n_pages"))
    engines = F.explode(F.array(*[F.struct(F.lit(k).alias("engine_order"), F.lit(e).alias("engine")) for k, e in enumerate(("first", "second", "third"))])).alias("e")

    def answered(rows: DataFrame) -> DataFrame:
        # numbers, not the questions, meet the pages
        rows = saved(rows.select("asked").withColumn("n", F.monotonically_increasing_id()), "asked")
        h = F.pmod(F.xxhash64("asked", "e.engine"), F.lit(1_000_003))
        x = rows.select("n", "asked", engines).join(F.broadcast(n)).withColumn("h", h)
        status = F.when(F.col("h") % 9 < 2, "blocked").when(F.col("h") % 9 == 2, "error").when(F.col("h") % 9 == 3, "empty").otherwise("success")
        x = x.select("n", "e.engine", "e.engine_order", status.alias("status"), F.explode(F.transform(F.sequence(F.lit(0), 2 + F.col("h") % 9), lambda k: F.struct(k.alias("k"), F.pmod(F.col("h") + k * 37, F.col("n_pages")).alias("page_id")))).alias("c"))
        x = x.select("n", "engine", "engine_order", "status", "c.k", "c.page_id").join(pages, "page_id", "left")
        listed = F.transform(F.sort_array(F.collect_list(F.when(F.col("status") == "success", F.struct("k", "url", "title")))), lambda c: F.struct(c["url"].alias("url"), c["title"].alias("title")))
        x = x.groupBy("n", "engine", "engine_order", "status").agg(listed.alias("candidates"))
        return x.join(rows, "n").select("asked", "engine", "engine_order", "status", "candidates")

    few = asked.select(discovery.follow_up(F.col("question")).alias("asked")).where("asked IS NOT NULL")
    plain = saved(asked.select(F.col("question").alias("asked")).unionByName(few).distinct(), "plain")

    def reached(rows: DataFrame) -> DataFrame:
        """Answers to questions, and to what a dominant site may be asked: each site of what is found, with either wording."""
        rows = saved(rows, "reached")
        scoping = r"(?s)^site:([^ ]*) (.*)$"
        told = rows.where(F.col("asked").rlike(scoping)).select("asked", F.regexp_extract("asked", scoping, 1).alias("site"), F.regexp_extract("asked", scoping, 2).alias("wording"))
        worded = plain.join(told.select(F.col("wording").alias("asked")).distinct(), "asked", "left_semi")
        sites = answered(worded).select(F.col("asked").alias("wording"), F.explode("candidates").alias("c")).select("wording", urls.site(urls.host(F.col("c.url"))).alias("site"))
        scoped = told.join(sites, ["site", "wording"], "left_semi").select("asked")
        return answered(rows.join(plain, "asked", "left_semi").unionByName(scoped).distinct())

    told, found = discovery.chained(asked, reached)
    lists = found.groupBy("question").agg(F.count("*").alias("n_candidates"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "url"))), lambda x: x["url"]), " "), 256).alias("urls_sha256"))
    return told.join(lists, "question", "left").select(F.sha2("question", 256).alias("question_sha256"), "engine", "status", "follow_up", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), "urls_sha256")
