"""Queries over cached documents, investigations, grades and completions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lucerna.operators import discovery, extraction, grading, store
from lucerna.plans.registry import registry
from lucerna.sources.readers import table
from lucerna.streaming import controller

QUERIES, ORACLE_SQL, query = registry()

# Derived tables, the same in both languages: entries of the cache, attempts of a search.
_URL = "'https://' || source || '.example/d/' || doc_id"
_ENTRIES = f"""SELECT doc_id, {_URL} AS canonical_url, source, text, octet_length(encode(text)) AS byte_length,
    CASE doc_id % 3 WHEN 0 THEN 'binary' WHEN 1 THEN 'rendered' ELSE 'text' END AS body_kind, doc_id % 17 = 0 AS pinned, (doc_id * 7919) % 100003 AS last_accessed FROM documents"""


def _entries(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("doc_id") % 3 == 0, "binary").when(F.col("doc_id") % 3 == 1, "rendered").otherwise("text")
    return table(spark, d, "documents").select(
        "doc_id", F.concat(F.lit("https://"), "source", F.lit(".example/d/"), "doc_id").alias("canonical_url"), "source", "text", F.octet_length("text").cast("long").alias("byte_length"),
        kind.alias("body_kind"), (F.col("doc_id") % 17 == 0).alias("pinned"), ((F.col("doc_id") * 7919) % 100003).alias("last_accessed"),
    )


@query("cache_lookup_alias", f"""
    WITH e AS ({_ENTRIES}), a AS (SELECT canonical_url || '?ref=alias' AS alias, canonical_url FROM e WHERE doc_id % 5 = 0),
    w AS (SELECT CASE WHEN doc_id % 2 = 0 THEN canonical_url ELSE canonical_url || '?ref=alias' END AS asked FROM e)
    SELECT DISTINCT asked, e.canonical_url, e.doc_id FROM w JOIN e ON w.asked = e.canonical_url
    UNION SELECT asked, e.canonical_url, e.doc_id FROM w JOIN a ON w.asked = a.alias JOIN e ON e.canonical_url = a.canonical_url""")
def cache_lookup_alias(spark: SparkSession, d: str) -> DataFrame:
    e = _entries(spark, d).select("canonical_url", "doc_id")
    alias = F.concat("canonical_url", F.lit("?ref=alias"))
    aliases = e.where("doc_id % 5 = 0").select(alias.alias("alias"), "canonical_url")
    asked = e.select(F.when(F.col("doc_id") % 2 == 0, F.col("canonical_url")).otherwise(alias).alias("asked"))
    return store.lookup(e, aliases, asked)


@query("cache_freshness", """
    WITH c AS (SELECT event_id, ts, CASE event_id % 4 WHEN 0 THEN 'news' WHEN 1 THEN 'general' WHEN 2 THEN 'docs' ELSE 'versioned' END AS k,
        CASE WHEN event_type = 'error' THEN 'no-cache' WHEN event_id % 3 = 0 THEN 'public, max-age=' || (event_id % 5000) END AS cc FROM events),
    x AS (SELECT event_id, CASE WHEN cc = 'no-cache' THEN ts WHEN cc IS NOT NULL THEN ts + to_seconds(CAST(regexp_extract(cc, 'max-age=([0-9]+)', 1) AS BIGINT))
        ELSE ts + to_seconds(CASE k WHEN 'news' THEN 900 WHEN 'docs' THEN 604800 WHEN 'versioned' THEN 2592000 ELSE 86400 END) END AS expires FROM c)
    SELECT event_id, expires > TIMESTAMP '2024-01-20' AS fresh FROM x""")
def cache_freshness(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    m = F.col("event_id") % 4
    kind = F.when(m == 0, "news").when(m == 1, "general").when(m == 2, "docs").otherwise("versioned")
    control = F.when(F.col("event_type") == "error", F.lit("no-cache")).when(F.col("event_id") % 3 == 0, F.concat(F.lit("public, max-age="), (F.col("event_id") % 5000).cast("string")))
    return e.select("event_id", store.is_fresh(F.col("ts"), control, kind, F.to_timestamp(F.lit("2024-01-20"))).alias("fresh"))


@query("cache_lookup_fresh", """
    WITH e AS (SELECT event_id, 'https://e.example/' || event_id AS url, ts, CASE event_id % 4 WHEN 0 THEN 'news' WHEN 1 THEN 'general' WHEN 2 THEN 'docs' ELSE 'versioned' END AS k, CASE WHEN event_id % 5 = 0 THEN 'no-cache' WHEN event_id % 3 = 0 THEN 'public, max-age=' || (event_id * 31 % 900000) END AS cc FROM events),
    x AS (SELECT *, CASE WHEN cc = 'no-cache' THEN ts WHEN cc IS NOT NULL THEN ts + to_seconds(event_id * 31 % 900000) ELSE ts + to_seconds(CASE k WHEN 'news' THEN 900 WHEN 'docs' THEN 604800 WHEN 'versioned' THEN 2592000 ELSE 86400 END) END AS expires FROM e),
    w AS (SELECT url AS asked, event_id FROM e WHERE event_id % 6 = 0 UNION ALL SELECT url || '?alias', event_id FROM e WHERE event_id % 6 = 3)
    SELECT asked, event_id, expires > TIMESTAMP '2024-01-20' AS fresh, CAST(floor(epoch(greatest(ts, TIMESTAMP '2024-01-20'))) AS BIGINT) AS last_accessed FROM w JOIN x USING (event_id)""")
def cache_lookup_fresh(spark: SparkSession, d: str) -> DataFrame:
    i, now = F.col("event_id"), F.to_timestamp(F.lit("2024-01-20"))
    kind = F.when(i % 4 == 0, "news").when(i % 4 == 1, "general").when(i % 4 == 2, "docs").otherwise("versioned")
    control = F.when(i % 5 == 0, F.lit("no-cache")).when(i % 3 == 0, F.concat(F.lit("public, max-age="), (i * 31 % 900000).cast("string")))
    url = F.concat(F.lit("https://e.example/"), i.cast("string"))
    ts = F.col("ts").cast("timestamp")
    e = table(spark, d, "events").select("event_id", url.alias("canonical_url"), ts.alias("fetched"), ts.alias("last_accessed"), kind.alias("content_class"), control.alias("cache_control"))
    alias = e.where("event_id % 6 = 3").select(F.concat("canonical_url", F.lit("?alias")).alias("alias"), "canonical_url")
    wanted = e.where("event_id % 6 = 0").select(F.col("canonical_url").alias("asked")).unionByName(alias.select(F.col("alias").alias("asked")))
    return store.lookup_fresh(e, alias, wanted, now).select("asked", "event_id", "fresh", F.unix_seconds("last_accessed").alias("last_accessed"))


_ORDER = "CASE body_kind WHEN 'binary' THEN 0 WHEN 'rendered' THEN 1 ELSE 2 END, last_accessed, doc_id"


@query("cache_evict", f"""
    WITH e AS ({_ENTRIES}), t AS (SELECT sum(byte_length) AS total FROM e),
    r AS (SELECT doc_id, body_kind, byte_length, coalesce(sum(byte_length) OVER (ORDER BY {_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed FROM e WHERE NOT pinned)
    SELECT doc_id, body_kind, CAST(freed AS BIGINT) AS freed_before FROM r, t WHERE total - freed > 1000000""")
def cache_evict(spark: SparkSession, d: str) -> DataFrame:
    e = _entries(spark, d).withColumn("prio", F.when(F.col("body_kind") == "binary", 0).when(F.col("body_kind") == "rendered", 1).otherwise(2))
    gone = store.evictions(e.drop("text"), "byte_length", ["prio", "last_accessed", "doc_id"], "pinned", 1_000_000)
    return gone.select("doc_id", "body_kind", F.col("freed_before").cast("long").alias("freed_before"))


@query("orphan_blobs", "SELECT DISTINCT sha256(text) AS digest FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)")
def orphan_blobs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return store.orphans(docs.select("digest").distinct(), docs.where("doc_id % 2 = 0").select("digest"))


@query("cache_upsert", f"""
    WITH e AS ({_ENTRIES}), a AS (SELECT source AS key, doc_id AS seen_at, body_kind, 'public' AS cc FROM e WHERE doc_id % 2 = 0),
    p AS (SELECT source AS key, doc_id AS seen_at, body_kind, CASE WHEN doc_id % 7 = 0 THEN 'No-Store' ELSE 'public' END AS cc FROM e WHERE doc_id % 2 = 1)
    SELECT key, seen_at, body_kind FROM (SELECT * FROM a UNION ALL SELECT * FROM p WHERE NOT regexp_matches(cc, 'no-store', 'i')) QUALIFY row_number() OVER (PARTITION BY key ORDER BY seen_at DESC) = 1""")
def cache_upsert(spark: SparkSession, d: str) -> DataFrame:
    e = _entries(spark, d).select(F.col("source").alias("key"), F.col("doc_id").alias("seen_at"), "body_kind")
    old = e.where("seen_at % 2 = 0").withColumn("cc", F.lit("public"))
    new = e.where("seen_at % 2 = 1").withColumn("cc", F.when(F.col("seen_at") % 7 == 0, "No-Store").otherwise("public"))
    return store.upsert(old, new, "key", "seen_at", "cc").drop("cc")


@query("consumed_anti", """
    WITH c AS (SELECT conv_id, turn, page_id, url FROM conversations JOIN pages ON page_id = (conv_id * 31 + turn * 7) % (SELECT count(*) FROM pages)), k AS (SELECT DISTINCT conv_id, url FROM c WHERE turn = 0)
    SELECT conv_id, turn, page_id FROM c WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.conv_id = c.conv_id AND k.url = c.url) QUALIFY row_number() OVER (PARTITION BY conv_id, url ORDER BY turn) = 1""")
def consumed_anti(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", "url")
    n = pages.agg(F.count("*").alias("n"))
    calls = table(spark, d, "conversations").join(F.broadcast(n)).select("conv_id", "turn", ((F.col("conv_id") * 31 + F.col("turn") * 7) % F.col("n")).alias("page_id")).join(pages, "page_id")
    return store.reserve(calls, calls.where("turn = 0"), ["conv_id", "url"], ["turn"]).select("conv_id", "turn", "page_id")


@query("search_status", """
    WITH c AS (SELECT conv_id, count(*) FILTER (WHERE role = 'assistant') AS n, bool_or(length(text) > 400) AS fair FROM conversations GROUP BY conv_id),
    s AS (SELECT conv_id, CAST(n AS BIGINT) AS n_results, fair, CASE WHEN n = 0 THEN 'no_relevant_results' WHEN n < 3 THEN 'partial' ELSE 'success' END AS status FROM c)
    SELECT conv_id, n_results, status, CASE WHEN status = 'success' THEN 'high' WHEN fair THEN 'medium' ELSE 'low' END AS confidence FROM s""")
def search_status(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "assistant").alias("n_results"), F.bool_or(F.length("text") > 400).alias("fair"))
    status, confidence = store.status(F.col("n_results"), F.lit(3), F.col("fair"))
    return c.select("conv_id", "n_results", status.alias("status"), confidence.alias("confidence"))


@query("interleave_lists", """
    WITH t AS (SELECT doc_id // 20 AS search, doc_id, row_number() OVER (PARTITION BY doc_id // 20 ORDER BY n_chars DESC, doc_id) AS turn, 0 AS side FROM documents
        UNION ALL SELECT doc_id // 20, doc_id, row_number() OVER (PARTITION BY doc_id // 20 ORDER BY n_chars, doc_id) AS turn, 1 AS side FROM documents),
    k AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY search, doc_id ORDER BY turn, side) = 1)
    SELECT search, CAST(row_number() OVER (PARTITION BY search ORDER BY turn, side) AS INTEGER) AS place, doc_id FROM k""")
def interleave_lists(spark: SparkSession, d: str) -> DataFrame:
    """Two engines' orders of each search's results, in turns."""
    found = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 20).alias("search"), "doc_id", "n_chars")
    return store.interleave(found, found, "search", [F.desc("n_chars"), "doc_id"], "doc_id", ["n_chars", "doc_id"]).select("search", "place", "doc_id")


@query("quota_fill", """
    WITH a AS (SELECT doc_id // 40 AS search, lang AS host, doc_id AS rank, doc_id % 3 <> 0 AS ok FROM documents),
    f AS (SELECT *, coalesce(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY search, host ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM a),
    p AS (SELECT search, host, rank, CAST(row_number() OVER (PARTITION BY search ORDER BY rank) AS INTEGER) AS place FROM f WHERE f < 2 AND ok)
    SELECT search, host, rank, place FROM p WHERE place <= 3""")
def quota_fill(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 40).alias("search"), F.col("lang").alias("host"), F.col("doc_id").alias("rank"), (F.col("doc_id") % 3 != 0).alias("ok"))
    return store.quota(a, "search", "host", "rank", "ok", 3).select("search", "host", "rank", "place")


@query("chain_first_answer", """
    WITH o AS (SELECT doc_id // 3 AS question, source AS engine, doc_id % 3 AS engine_order, CASE (doc_id * 13) % 7 WHEN 0 THEN 'blocked' WHEN 1 THEN 'error' WHEN 2 THEN 'empty' ELSE 'parsed' END AS status FROM documents)
    SELECT question, coalesce(arg_min(engine, engine_order) FILTER (WHERE status NOT IN ('blocked', 'error')), arg_max(engine, engine_order)) AS engine,
        coalesce(arg_min(status, engine_order) FILTER (WHERE status NOT IN ('blocked', 'error')), arg_max(status, engine_order)) AS status FROM o GROUP BY question""")
def chain_first_answer(spark: SparkSession, d: str) -> DataFrame:
    m = (F.col("doc_id") * 13) % 7
    status = F.when(m == 0, "blocked").when(m == 1, "error").when(m == 2, "empty").otherwise("parsed")
    o = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 3).alias("question"), F.col("source").alias("engine"), (F.col("doc_id") % 3).alias("engine_order"), status.alias("status"))
    return discovery.first_answer(o)


@query("mrr_recall", """
    WITH q AS (SELECT DISTINCT doc_id // 25 AS asked FROM documents), r AS (SELECT doc_id // 25 AS asked, doc_id, row_number() OVER (PARTITION BY doc_id // 25 ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
    f AS (SELECT r.asked, min(rank) AS first FROM r JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY r.asked)
    SELECT round(avg(coalesce(1.0 / first, 0)), 6) AS mrr, round(avg(CASE WHEN first IS NOT NULL THEN 1 ELSE 0 END), 6) AS recall, CAST(count(*) AS BIGINT) AS n_queries FROM q LEFT JOIN f USING (asked)""")
def mrr_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whole rankings, without a cut-off."""
    docs = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 25).alias("asked"), "doc_id", "n_chars")
    ranked = docs.withColumn("rank", F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("n_chars"), "doc_id")))
    good = table(spark, d, "labels").where("quality = 1").select("doc_id", F.floor(F.col("doc_id") / 25).alias("asked"))
    out = grading.mrr_recall(ranked.drop("n_chars"), good, docs.select("asked").distinct(), "asked", "doc_id")
    return out.select(F.round("mrr", 6).alias("mrr"), F.round("recall", 6).alias("recall"), "n_queries")


@query("grade_components", r"""
    WITH l AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id), d AS (SELECT doc_id, text, doc_id // 40 AS case_id, row_number() OVER (PARTITION BY doc_id // 40 ORDER BY doc_id) AS rank FROM documents),
    f AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '\s+', ' ', 'g'), ' ([.,;:!?)\]])', '\1', 'g'), '([(\[]) ', '\1', 'g')) AS said, CAST(len(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '')) AS BIGINT) AS tokens FROM d),
    c AS (SELECT f.case_id, f.doc_id, CASE WHEN l.quality = 1 THEN 2.0 ELSE 1.0 END AS w, f.rank, f.doc_id % 3 <> 0 AS found, f.doc_id % 5 <> 0 AS has, lower(regexp_extract(text, '[A-Za-z]{4,}')) AS word FROM l JOIN f USING (doc_id)),
    p AS (SELECT case_id, string_agg(said, ' ' ORDER BY rank) AS every, sum(tokens) AS tokens FROM f WHERE doc_id % 3 <> 0 GROUP BY case_id),
    m AS (SELECT c.*, p.tokens, c.word <> '' AND coalesce(contains(p.every, c.word), false) AS evident FROM c LEFT JOIN p USING (case_id))
    SELECT case_id, floor(sum(CASE WHEN evident THEN w ELSE 0 END) / sum(w) * 40 * 1000 + 0.5) / 1000 AS evidence_coverage,
        floor(sum(CASE WHEN found THEN w ELSE 0 END) / sum(w) * 25 * 1000 + 0.5) / 1000 AS source_recall,
        floor(sum(CASE WHEN found THEN w / rank ELSE 0 END) / sum(w) * 15 * 1000 + 0.5) / 1000 AS rank,
        floor(sum(CASE WHEN found AND has THEN w ELSE 0 END) / nullif(sum(CASE WHEN has THEN w ELSE 0 END), 0) * 10 * 1000 + 0.5) / 1000 AS extraction,
        floor(sum(CASE WHEN found THEN w ELSE 0 END) / sum(w) * 5 * 1000 + 0.5) / 1000 AS diversity,
        floor(greatest(0.0, 1 - greatest(0, coalesce(max(tokens), 0) - 6000) / 6000) * 5 * 1000 + 0.5) / 1000 AS token_budget FROM m GROUP BY case_id""")
def grade_components(spark: SparkSession, d: str) -> DataFrame:
    """All six components: claims of labelled documents against the two thirds of them that a search returned."""
    i = F.col("doc_id")
    w = Window.partitionBy("case_id").orderBy("doc_id")
    docs = table(spark, d, "documents").select("doc_id", "text", F.floor(i / 40).alias("case_id"), F.concat(F.lit("https://h"), i.cast("string"), F.lit(".example/p")).alias("url"))
    word = F.regexp_extract("text", "[A-Za-z]{4,}", 0)
    passage = F.struct("url", F.substring("text", 1, 40).alias("text"))
    # what a claim takes of a text is cut where the text is read
    named = docs.select("doc_id", "case_id", "url", F.when(word != "", F.array(word)).otherwise(F.array().cast("array<string>")).alias("patterns"), passage.alias("passage"))
    claims = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality")).join(named, "doc_id").select(
        "case_id", F.col("doc_id").alias("claim_id"), F.when(F.col("quality") == 1, 2.0).otherwise(1.0).alias("weight"), F.array("url").alias("source_urls"),
        "patterns", F.array().cast("array<string>").alias("concepts"),
        F.when(i % 5 != 0, F.array("passage")).otherwise(F.array().cast("array<struct<url:string,text:string>>")).alias("passages"),
    )
    results = docs.withColumn("pos", F.row_number().over(w)).where(i % 3 != 0).select("case_id", "pos", "url", "text", F.lit(None).cast("int").alias("token_count"))
    return grading.grade(claims, results).drop("total", "classification")


_SCORED = """SELECT l.doc_id AS case_id, lang AS category, l.doc_id % 11 = 0 AS critical, CASE WHEN quality = 1 THEN 60.0 + l.doc_id % 40 ELSE 30.0 + l.doc_id % 20 END AS total FROM labels l JOIN documents USING (doc_id)"""


@query("promotion_gate", f"""
    WITH a AS ({_SCORED}), b AS (SELECT case_id, category, critical, least(100.0, total + 5) AS total FROM a),
    g AS (SELECT avg(b.total) AS m, (SELECT avg(total) FROM a) AS n, count(*) FILTER (WHERE b.total >= 70) / count(*) AS good, bool_or(critical AND b.total < 50) AS low FROM b),
    k AS (SELECT count(*) AS lost FROM (SELECT category, avg(total) AS x FROM b GROUP BY category) JOIN (SELECT category, avg(total) AS y FROM a GROUP BY category) USING (category) WHERE x - y < -5)
    SELECT round(m, 6) AS mean, round(n, 6) AS champion_mean, round(good, 6) AS good, array_to_string(list_filter([CASE WHEN m < 75 THEN 'mean below 75' END, CASE WHEN good < 0.8 THEN 'fewer than 80% of queries score 70+' END,
        CASE WHEN low THEN 'critical canary below 50' END, CASE WHEN m - n < 3 THEN 'overall gain below 3' END, CASE WHEN lost > 0 THEN 'a category lost more than 5' END], lambda x: x IS NOT NULL), '; ') AS failures,
        m >= 75 AND good >= 0.8 AND NOT low AND m - n >= 3 AND lost = 0 AS promoted FROM g, k""")
def promotion_gate(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    a = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    a = a.select(i.alias("case_id"), F.col("lang").alias("category"), (i % 11 == 0).alias("critical"), F.when(F.col("quality") == 1, 60.0 + i % 40).otherwise(30.0 + i % 20).alias("total"))
    out = grading.promotion(a, a.withColumn("total", F.least(F.lit(100.0), F.col("total") + 5)))
    return out.select(*[F.round(c, 6).alias(c) for c in ("mean", "champion_mean", "good")], "failures", "promoted")


#: Robots files of the hosts, one after the other, and the rules in them that hold for the agent: place, whether it allows, path.
ROBOTS = (
    ("User-agent: *\nDisallow: /private\nAllow: /private/open\n\nUser-agent: other\nDisallow: /", ((2, False, "/private"), (3, True, "/private/open"))), ("# all\nUser-agent: Lucerna\nDisallow: /\nAllow: /x", ((3, False, "/"), (4, True, "/x"))),
    ("User-agent: other\nDisallow: /", ()), ("", ()), ("User-agent: lucerna # us\nDisallow: /private/\nDisallow: /z\nAllow: /z", ((2, False, "/private/"), (3, False, "/z"), (4, True, "/z"))),
)
_PLACES = ("/", "/private", "/private/open/", "/x/y", "/z", "/private/")
_RULES = ", ".join(f"({k}, {p}, {str(a).lower()}, '{r}')" for k, (_, rules) in enumerate(ROBOTS) for p, a, r in rules)


@query("robots_permits", f"""
    WITH r(kind, pos, allow, rule) AS (VALUES {_RULES}), p AS (SELECT page_id, 's' || page_id // 6 || '.example' AS host, page_id // 6 % {len(ROBOTS)} AS kind, ([{", ".join(f"'{p}'" for p in _PLACES)}])[page_id % 6 + 1] || page_id AS path FROM pages),
    h AS (SELECT p.host, p.path, arg_max(r.allow, struct_pack(n := length(r.rule), pos := r.pos)) AS allow FROM p JOIN r ON r.kind = p.kind AND starts_with(p.path, r.rule) GROUP BY p.host, p.path)
    SELECT p.host, p.path, coalesce(h.allow, true) AS allowed FROM p LEFT JOIN h ON h.host = p.host AND h.path = p.path""")
def robots_permits(spark: SparkSession, d: str) -> DataFrame:
    """Pages as paths of hosts, six each, under five kinds of robots files."""
    i = F.col("page_id")
    host, kind = F.concat(F.lit("s"), F.floor(i / 6).cast("string"), F.lit(".example")), F.floor(i / 6) % len(ROBOTS)
    path = F.concat(F.element_at(F.array(*map(F.lit, _PLACES)), (i % 6 + 1).cast("int")), i.cast("string"))
    body = F.element_at(F.array(*[F.lit(b) for b, _ in ROBOTS]), (kind + 1).cast("int"))
    p = table(spark, d, "pages").select(host.alias("host"), path.alias("path"), body.alias("body"))
    return extraction.robots_permits(p.select("host", "body").distinct(), p.select("host", "path"), "lucerna")


@query("error_rate_windows", """
    WITH w AS (SELECT time_bucket(INTERVAL '10 minutes', ts) AS b, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS e, quantile_disc(value, 0.95) AS p, count(*) FILTER (WHERE value > 80) AS t FROM events GROUP BY 1)
    SELECT CAST(epoch(b) AS BIGINT) AS window_start, CAST(n AS BIGINT) AS n, CAST(e AS BIGINT) AS errors, round(e / n, 6) AS error_rate, round(t / n, 6) AS timeout_rate, p AS p95 FROM w""")
def error_rate_windows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").alias("failed"), F.col("value").alias("duration"), (F.col("value") > 80).alias("timed_out"))
    return controller.health(e).select(F.unix_seconds("window_start").alias("window_start"), "n", "errors", F.round("error_rate", 6).alias("error_rate"), F.round("timeout_rate", 6).alias("timeout_rate"), "p95")


@query("capacity_controller")
def capacity_controller(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("controller"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.col("value").alias("duration"), (F.col("event_type") == "error").alias("failed"), (F.col("value") > 80).alias("timed_out"))
    return controller.capacity_batch(e)


@query("cooldown_mask", """
    SELECT event_id, coalesce(date_diff('microsecond', max(CASE WHEN event_type = 'error' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ts) < 3600000000, false) AS suppressed FROM events""")
def cooldown_mask(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").alias("blocked"))
    return discovery.cooled(e, "user_id", "ts", "blocked", 3600).select("event_id", "suppressed")


@query("json_props", "SELECT event_type, CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE props->>'$.missing' IS NULL) AS BIGINT) AS absent FROM events GROUP BY event_type")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    p = F.from_json("props", "k bigint, missing string")
    return table(spark, d, "events").withColumn("p", p).groupBy("event_type").agg(F.sum("p.k").alias("total"), F.count_if(F.col("p.missing").isNull()).alias("absent"))


@query("redirect_closure", """
    WITH RECURSIVE e AS (SELECT doc_id AS f, doc_id + 1 AS t FROM documents WHERE doc_id % 8 < 4), s AS (SELECT doc_id AS url FROM documents WHERE doc_id % 8 = 0 OR doc_id % 8 = 5),
    c AS (SELECT url, url AS here FROM s UNION ALL SELECT c.url, e.t FROM c JOIN e ON e.f = c.here) SELECT url, max(here) AS final FROM c GROUP BY url""")
def redirect_closure(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "documents").select(F.col("doc_id").alias("i"))
    edges = i.where("i % 8 < 4").select(F.col("i").alias("from_url"), (F.col("i") + 1).alias("to_url"))
    return store.redirects(i.where("i % 8 = 0 OR i % 8 = 5").select(F.col("i").alias("url")), edges)


@query("transfer_totals", """
    SELECT user_id AS nav, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS bytes, sum(CAST(floor(value * 100) AS BIGINT)) > 100000 AS over, arg_min(event_type, event_id) AS content_type FROM events GROUP BY user_id""")
def transfer_totals(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "events").select(F.col("user_id").alias("nav"), F.col("event_id").alias("seq"), F.floor(F.col("value") * 100).alias("bytes"), F.lit(0).cast("long").alias("declared"), F.col("event_type").alias("content_type"), F.lit(200).alias("status"))
    return store.transfers(c, 100_000).drop("not_modified")


@query("settled_reads", """
    WITH r AS (SELECT user_id AS page, event_id AS ts, event_type AS text, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) = event_type AS same FROM events)
    SELECT page, coalesce(arg_min(text, ts) FILTER (WHERE same), arg_max(text, ts)) AS text FROM r GROUP BY page""")
def settled_reads(spark: SparkSession, d: str) -> DataFrame:
    return store.settled(table(spark, d, "events").select(F.col("user_id").alias("page"), F.col("event_id").alias("ts"), F.col("event_type").alias("text")))
