"""Queries over single functions: addresses, locales, texts, dates, names, scores, unions.

Rows of the tables are turned into inputs that reach every branch, in the same
way in both languages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lucerna.functions import scoring, texts, urls
from lucerna.operators import contracts, discovery, extraction, grading, store
from lucerna.plans.evidence import _removed
from lucerna.plans.registry import registry
from lucerna.sources import readers
from lucerna.sources.readers import table

QUERIES, ORACLE_SQL, query = registry()


def chosen(i, values: tuple) -> F.Column:
    """The value that a row's number picks."""
    return F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))


def picked(i: str, values: tuple) -> str:
    """The same in SQL."""
    quoted = ", ".join("NULL" if v is None else "'" + str(v).replace("'", "''") + "'" for v in values)
    return f"([{quoted}])[{i} % {len(values)} + 1]"


SCRIPTS = ("", " とは", " 한국", " 中文", " привет", " سلام", " שלום", " γεια", " ไทย", " नमस्ते")
_LOCALES = " ".join(
    f"WHEN regexp_matches(q, '{p}') THEN '{v}'"
    for p, v in ((r"[\p{Hiragana}\p{Katakana}]", "ja-JP"), (r"\p{Hangul}", "ko-KR"), (r"\p{Han}", "zh-CN"), (r"\p{Cyrillic}", "ru-RU"), (r"\p{Arabic}", "ar"), (r"\p{Hebrew}", "he-IL"), (r"\p{Greek}", "el-GR"), (r"\p{Thai}", "th-TH"), (r"\p{Devanagari}", "hi-IN"))
)


@query("search_urls", rf"""
    WITH q AS (SELECT conv_id, turn, text || {picked("conv_id", SCRIPTS)} AS q FROM conversations WHERE role = 'user'),
    l AS (SELECT *, CASE {_LOCALES} ELSE 'en-US' END AS locale, replace(replace(replace(url_encode(q), '%20', '+'), '~', '%7E'), '%2A', '*') AS e FROM q)
    SELECT conv_id, turn, locale, sha256('https://www.google.com/search?q=' || e || '&hl=' || locale) AS google, sha256('https://html.duckduckgo.com/html/?q=' || e || '&kl=' || locale) AS duckduckgo, sha256('https://www.bing.com/search?q=' || e || '&setlang=fr-FR') AS bing FROM l""")
def search_urls(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.concat("text", chosen(F.col("conv_id"), SCRIPTS)).alias("q"))
    url = lambda engine, locale=None: F.sha2(urls.search_url(engine, F.col("q"), locale), 256).alias(engine)
    return q.select("conv_id", "turn", urls.locale_of(F.col("q")).alias("locale"), url("google"), url("duckduckgo", F.lit("auto")), url("bing", F.lit("fr-FR")))


ADDRESSES = (
    ("::1", True), ("::", True), ("fe80::1", True), ("fc00::1", True), ("fd12:3456::9", True), ("ff02::1", True), ("2606:4700::1111", False), ("2001:4860:4860::8888", False),
    ("::ffff:10.0.0.1", True), ("::ffff:8.8.8.8", False), ("::ffff:c0a8:1", True), ("::ffff:808:808", False), ("8.8.8.8", False), ("10.1.2.3", True), ("172.31.0.1", True), ("172.32.0.1", False),
    ("100.64.0.1", True), ("169.254.169.254", True), ("198.51.100.7", True), ("203.0.113.9", True), ("224.0.0.1", True), ("93.184.216.34", False),
)
_ADDRESSES = "(VALUES " + ", ".join(f"('{a}', {str(b).lower()}, {i})" for i, (a, b) in enumerate(ADDRESSES)) + ") AS a(address, bad, i)"


# Addresses of the rows' own numbers, written as dotted, mapped in both forms, or as plain IPv6; SQL goes by the numbers.
_OCTETS = "CAST(event_id * 7919 % 256 AS INTEGER) AS a, CAST(event_id * 104729 // 8 % 256 AS INTEGER) AS b, CAST(event_id % 251 AS INTEGER) AS c, CAST(event_id * 31 % 253 AS INTEGER) AS d"
_BAD_V4 = "a IN (0, 10, 127) OR a >= 224 OR a = 100 AND b BETWEEN 64 AND 127 OR a = 169 AND b = 254 OR a = 172 AND b BETWEEN 16 AND 31 OR a = 192 AND b IN (0, 168) OR a = 198 AND b IN (18, 19, 51) OR a = 203 AND b = 0"


@query("forbidden_addresses", f"""
    WITH e AS (SELECT event_id, {_OCTETS} FROM events), w AS (SELECT *, printf('%04x', a * 256 + b) AS x, printf('%x', c * 256 + d) AS y FROM e),
    f AS (SELECT *, event_id % 4 AS m FROM w)
    SELECT event_id, CASE m WHEN 0 THEN a || '.' || b || '.' || c || '.' || d WHEN 1 THEN '::ffff:' || a || '.' || b || '.' || c || '.' || d WHEN 2 THEN '::FFFF:' || printf('%x', a * 256 + b) || ':' || y ELSE x || '::' || y END AS address,
        CASE WHEN m < 3 THEN {_BAD_V4} ELSE a * 256 + b BETWEEN 65152 AND 65152 OR a >= 252 END AS forbidden FROM f
    UNION ALL SELECT -1 - i, address, bad FROM {_ADDRESSES}""")
def forbidden_addresses(spark: SparkSession, d: str) -> DataFrame:
    """Addresses counted from the table's rows, and one of each special kind."""
    i = F.col("event_id")
    octets = [(i * 7919 % 256), F.floor(i * 104729 / 8) % 256, i % 251, i * 31 % 253]
    a, b, c, e = (o.cast("int") for o in octets)
    dotted, low = F.concat_ws(".", *(o.cast("string") for o in (a, b, c, e))), F.lower(F.hex(c * 256 + e))
    address = F.when(i % 4 == 0, dotted).when(i % 4 == 1, F.concat(F.lit("::ffff:"), dotted)).when(i % 4 == 2, F.concat(F.lit("::FFFF:"), F.lower(F.hex(a * 256 + b)), F.lit(":"), low)).otherwise(F.concat(F.lpad(F.lower(F.hex(a * 256 + b)), 4, "0"), F.lit("::"), low))
    rows = table(spark, d, "events").select("event_id", address.alias("address"))
    special = spark.createDataFrame([(-1 - k, x) for k, (x, _) in enumerate(ADDRESSES)], "event_id long, address string")
    return rows.unionByName(special).select("event_id", "address", urls.forbidden_address(F.col("address")).alias("forbidden"))


@query("dns_rebinding", f"""
    WITH e AS (SELECT event_id, a.address AS x, a.bad AS xb, b.address AS y, b.bad AS yb, event_id % 5 AS m FROM events JOIN {_ADDRESSES} ON event_id % {len(ADDRESSES)} = a.i JOIN {_ADDRESSES.replace("AS a(", "AS b(")} ON (event_id * 7) % {len(ADDRESSES)} = b.i)
    SELECT event_id, CASE WHEN m = 0 OR xb OR (m <> 1 AND yb) THEN 'non_public_address' WHEN m NOT IN (1, 2) AND x <> y THEN 'rebinding' END AS reason FROM e""")
def dns_rebinding(spark: SparkSession, d: str) -> DataFrame:
    """Two look-ups: none, the same one, the same two in another order, or others."""
    names, m = tuple(a for a, _ in ADDRESSES), F.col("event_id") % 5
    x, y = chosen(F.col("event_id"), names), chosen(F.col("event_id") * 7, names)
    first = F.when(m == 0, F.array().cast("array<string>")).when(m == 2, F.array(x, y)).otherwise(F.array(x))
    second = F.when(m.isin(0, 1), F.array(x)).when(m == 2, F.array(y, x, y)).otherwise(F.array(y))
    return table(spark, d, "events").select("event_id", urls.answers_reason(first, second).alias("reason"))


@query("robots_authority", f"""
    WITH e AS (SELECT event_id, {picked("event_id", ("200", "204", "404", "410", "500", "301"))} AS s, event_id % 2 = 0 AS open, {picked("event_id", ("automatic", "explicit", "automatic"))} AS access FROM events),
    r AS (SELECT *, CASE WHEN s IN ('404', '410') THEN true WHEN s LIKE '2%' THEN open ELSE false END AS allowed FROM e)
    SELECT event_id, CASE WHEN allowed THEN 'allowed' WHEN access = 'explicit' THEN 'ignored' ELSE 'disallowed' END AS decision FROM r""")
def robots_authority(spark: SparkSession, d: str) -> DataFrame:
    """What a robots answer stands for, and what an access makes of it."""
    i = F.col("event_id")
    e = table(spark, d, "events").select("event_id", chosen(i, ("200", "204", "404", "410", "500", "301")).cast("int").alias("s"), F.when(i % 2 == 0, "").otherwise("User-agent: *\nDisallow: /").alias("body"), chosen(i, ("automatic", "explicit", "automatic")).alias("access"))
    e = e.withColumn("host", F.concat(F.lit("h"), i)).withColumn("rules", readers.robots_status(F.col("s"), F.col("body")))
    permits = extraction.robots_permits(e.select("host", F.col("rules").alias("body")), e.select("host", F.lit("/a").alias("path")), "lucerna").select("host", "allowed")
    return e.join(permits, "host").select("event_id", contracts.robots_decision(F.col("allowed"), F.col("access")).alias("decision"))


WRAPPED = ("", "<script>alert(1)</script>", "[x](javascript:alert(1))", "</form>", "<SVG onload=1>", "[y] ( data:text/html )")


@query("safe_texts", rf"""
    SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(x, '</?(?:script|style|form|iframe|object|embed|svg|template)\b[^>]*>', '', 'gi'), '\]\s*\(\s*(?:javascript|data|vbscript):[^)]*\)', ']', 'gi'))) AS safe
    FROM (SELECT doc_id, text || {picked("doc_id", WRAPPED)} || ' end' AS x FROM documents)""")
def safe_texts(spark: SparkSession, d: str) -> DataFrame:
    x = F.concat("text", chosen(F.col("doc_id"), WRAPPED), F.lit(" end"))
    return table(spark, d, "documents").select("doc_id", F.sha2(texts.safe_text(x, False), 256).alias("safe"))


HEADS = ("%PDF-1.4 ", '{"a": 1} ', "[1] ", "<?xml version='1.0'?> ", "<rss xmlns:a='b'> ", "<!DOCTYPE html> ", "<HTML> ", "", "  {} ")
TYPES = (None, "", "text/plain; charset=utf-8", "application/octet-stream", "Application/JSON")
PLACES = ("https://raw.githubusercontent.com/a/b", "https://a.example/raw/x", "https://a.example/x")


@query("mime_types", rf"""
    WITH x AS (SELECT doc_id, lower(trim(string_split({picked("doc_id", TYPES)}, ';')[1])) AS named, regexp_replace(substring({picked("doc_id", HEADS)} || text, 1, 512), '^\s+', '') AS head, {picked("doc_id", PLACES)} AS url, doc_id % 2 = 0 AS md FROM documents)
    SELECT doc_id, CASE WHEN named <> '' AND named <> 'application/octet-stream' THEN named WHEN starts_with(head, '%PDF-') THEN 'application/pdf' WHEN regexp_matches(head, '^[\{{\[]') THEN 'application/json'
        WHEN regexp_matches(head, '^<\?xml\b|^<[^>]+xmlns[=:]', 'i') THEN 'application/xml' WHEN regexp_matches(head, '^<!doctype html\b|^<html\b', 'i') THEN 'text/html'
        WHEN regexp_matches(url, '^[a-z]+://raw\.githubusercontent\.com/|/raw/') THEN 'text/x-source-code' WHEN md THEN 'text/markdown' ELSE 'text/plain' END AS mime FROM x""")
def mime_types(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, d, "documents").select("doc_id", texts.mime_of(chosen(i, TYPES), F.concat(chosen(i, HEADS), "text"), chosen(i, PLACES), i % 2 == 0).alias("mime"))


@query("heading_slugs", r"""
    SELECT doc_id, CASE WHEN NOT regexp_matches(h, '^\s*\d+(\.\d+)*\.?\s') AND s <> '' THEN '#' || s END AS slug
    FROM (SELECT doc_id, h, regexp_replace(regexp_replace(lower(h), '[^\p{L}\p{N}]+', '-', 'g'), '^-|-$', '', 'g') AS s
        FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN doc_id || '.2 ' WHEN 1 THEN '!?' ELSE '' END || CASE doc_id % 5 WHEN 1 THEN '' ELSE string_split(text, chr(10))[1] END AS h FROM documents))""")
def heading_slugs(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("doc_id") % 5
    h = F.concat(F.when(m == 0, F.concat(F.col("doc_id").cast("string"), F.lit(".2 "))).when(m == 1, "!?").otherwise(""), F.when(m == 1, "").otherwise(F.split("text", "\n")[0]))
    return table(spark, d, "documents").select("doc_id", texts.slug(h).alias("slug"))


@query("pdf_texts", r"""
    SELECT doc_id, sha256(t || chr(10) || 'a(b)') AS shown FROM (SELECT doc_id, regexp_replace(text, '[()\\]|[^\x00-\x7F]', '', 'g') AS t FROM documents)""")
def pdf_texts(spark: SparkSession, d: str) -> DataFrame:
    t = F.regexp_replace("text", r"[()\\]|[^\x00-\x7F]", "")
    body = F.concat(F.lit("%PDF-1.4\nBT ("), t, F.lit(") Tj (skipped) TJ (a\\(b\\)) Tj ET")).cast("binary")
    return table(spark, d, "documents").select("doc_id", F.sha2(texts.pdf_text(body), 256).alias("shown"))


DATES = ("2024-02-29", "2023-02-29", "2024-13-01", "2024-1-05", "2024-01-05T00:00", "", None, "1999-12-31", "2024-04-31", "x2024-01-01")
ENTRIES = ("a/b.txt", "/etc/passwd", "..", "a/../b", "a..b/c", "\\x", "a\\..\\b", "x/..", "...", "ok")


@query("dates_and_entries", f"""
    SELECT event_id, strftime(CASE WHEN regexp_matches(v, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN try_cast(v AS DATE) END, '%Y-%m-%d') AS day,
        NOT regexp_matches(n, '^[/\\\\]') AND NOT regexp_matches(n, '(^|[\\\\/])\\.\\.([\\\\/]|$)') AS safe FROM (SELECT event_id, {picked("event_id", DATES)} AS v, {picked("event_id", ENTRIES)} AS n FROM events)""")
def dates_and_entries(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, d, "events").select("event_id", F.date_format(contracts.iso_date(chosen(i, DATES)), "yyyy-MM-dd").alias("day"), contracts.safe_entry(chosen(i, ENTRIES)).alias("safe"))


_LISTS = """SELECT doc_id // 30 AS question, CASE WHEN doc_id % 30 < 15 THEN 0 ELSE doc_id % 3 END AS src, doc_id % 30 AS pos, 'https://a.example/' || doc_id % 23 AS url FROM documents"""


def _lists(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, d, "documents").select(F.floor(i / 30).alias("question"), F.when(i % 30 < 15, 0).otherwise(i % 3).alias("src"), (i % 30).alias("pos"), F.concat(F.lit("https://a.example/"), i % 23).alias("url"))


@query("widened_candidates", f"""
    WITH l AS ({_LISTS}), u AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY question, url ORDER BY src, pos) = 1)
    SELECT question, url, CAST(row_number() OVER (PARTITION BY question ORDER BY src, pos) AS INTEGER) AS place FROM u QUALIFY place <= 8""")
def widened_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The first engine's list, then what later ones add to it."""
    every = _lists(spark, d)
    return discovery.widened(every.where("src = 0"), every.where("src > 0"), 8).select("question", "url", "place")


@query("uncached_candidates", f"""
    WITH l AS ({_LISTS}), k AS (SELECT DISTINCT question, url FROM l WHERE src = 0), n AS (SELECT DISTINCT question, url FROM l WHERE src > 0)
    SELECT question, url FROM n WHERE (question, url) NOT IN (SELECT question, url FROM k)""")
def uncached_candidates(spark: SparkSession, d: str) -> DataFrame:
    """What later lists found that the first, or the cache, doesn't hold: an anti-join on the pair."""
    every = _lists(spark, d)
    return every.where("src > 0").select("question", "url").distinct().join(every.where("src = 0").select("question", "url"), ["question", "url"], "left_anti")


@query("flattened_passages", r"""
    SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower('He said ( x ) "  a" , ' || text), '\s+', ' ', 'g'), ' ([.,;:!?)\]])', '\1', 'g'), '([(\[]) ', '\1', 'g'), '"\s+', '"', 'g'), '\s+"', '"', 'g'))) AS said FROM documents""")
def flattened_passages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(texts.flattened(F.concat(F.lit('He said ( x ) "  a" , '), "text")), 256).alias("said"))


PROFILES = ("general", "technical", "news", "academic", "community")
KINDS = ("organic", "news", "discussion", "video", "academic", "document", "other")
_TYPE = " ".join(f"WHEN p = '{p}' THEN CASE WHEN k IN ({', '.join(map(repr, e))}) THEN 1.0 ELSE 0.4 END" for p, e in scoring.EXPECTED.items())


@query("profile_scores", f"""
    WITH e AS (SELECT event_id, {picked("event_id", PROFILES)} AS p, {picked("event_id", KINDS)} AS k, event_id % 3 <> 0 AS novel, event_id % 101 / 100 AS base FROM events),
    t AS (SELECT *, CASE WHEN p = 'general' THEN CASE WHEN k = 'organic' THEN 1.0 ELSE 0.65 END {_TYPE} END AS kind, CASE WHEN k = 'organic' THEN 1.0 ELSE 0.65 END AS plain FROM e),
    s AS (SELECT *, (0.35 + 0.2) * base + 0.15 * plain + 0.15 * 0.5 + 0.1 * base + 0.05 * 0.5 AS b FROM t),
    r AS (SELECT *, CASE WHEN p = 'general' THEN b ELSE 0.7 * b + 0.3 * greatest(0.0, least(1.0, 0.7 * b + 0.3 * kind)) END AS score FROM s)
    SELECT event_id, kind AS type_score, CASE WHEN novel THEN 1.0 ELSE 0.0 END AS novelty, round(score, 9) AS score, CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS confidence,
        CASE WHEN event_id % 13 = 0 THEN 'unmeasurable' WHEN base >= 0.85 THEN 'excellent' WHEN base >= 0.7 THEN 'relevant' WHEN base >= 0.5 THEN 'degraded' ELSE 'not_relevant' END AS class FROM r""")
def profile_scores(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    e = table(spark, d, "events").select("event_id", chosen(i, PROFILES).alias("p"), chosen(i, KINDS).alias("k"), (i % 3 != 0).alias("novel"), (i % 101 / 100).alias("base"))
    kind, base, half = scoring.type_score(F.col("k"), F.col("p")), F.col("base"), F.lit(0.5)
    score = scoring.postrank(base, base, scoring.type_score(F.col("k"), F.lit("general")), kind, half, base, half, F.col("p"))
    label = scoring.classification(F.when(i % 13 != 0, i % 101))
    return e.select("event_id", kind.alias("type_score"), scoring.novelty(F.col("novel")).alias("novelty"), F.round(score, 9).alias("score"), scoring.confidence(score).alias("confidence"), label.alias("class"))


@query("dominant_sites", """
    WITH f AS (SELECT doc_id // 12 AS search, doc_id AS pos, ([ 'www.a.co.uk', 'b.a.co.uk', 'docs.c.org', 'c.org', 'github.com', 'x.github.io', 'gist.github.com'])[(doc_id * doc_id) % 7 + 1] AS host FROM documents),
    s AS (SELECT search, pos, CASE host WHEN 'www.a.co.uk' THEN 'a.co.uk' WHEN 'b.a.co.uk' THEN 'a.co.uk' WHEN 'docs.c.org' THEN 'c.org' ELSE host END AS site FROM f WHERE host NOT IN ('github.com', 'gist.github.com')),
    c AS (SELECT search, site, count(*) AS n, min(pos) AS first FROM s GROUP BY search, site)
    SELECT search, site, CAST(n AS BIGINT) AS n FROM c QUALIFY row_number() OVER (PARTITION BY search ORDER BY n DESC, first) = 1 AND n > 1""")
def dominant_sites(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    f = table(spark, d, "documents").select(F.floor(i / 12).alias("search"), i.alias("pos"), chosen(i * i, ("www.a.co.uk", "b.a.co.uk", "docs.c.org", "c.org", "github.com", "x.github.io", "gist.github.com")).alias("host"))
    return discovery.dominant_site(f, "search", "host", "pos")


@query("claim_urls_not_in_run", r"""
    WITH c AS (SELECT DISTINCT page_id // 5 AS run, regexp_replace(url, '[?#].*$', '') AS url FROM pages WHERE page_id % 3 <> 0), f AS (SELECT DISTINCT page_id // 5 AS run, regexp_replace(url, '[?#].*$', '') AS url FROM pages WHERE page_id % 2 = 0)
    SELECT run, count(*)::BIGINT AS n_claimed, count(*) FILTER (WHERE (run, url) NOT IN (SELECT run, url FROM f))::BIGINT AS n_missing FROM c GROUP BY run""")
def claim_urls_not_in_run(spark: SparkSession, d: str) -> DataFrame:
    """Addresses that a draft's claims name and its run never opened."""
    p = table(spark, d, "pages").select(F.floor(F.col("page_id") / 5).alias("run"), urls.log_safe(F.col("url")).alias("url"), "page_id")
    found = p.where("page_id % 2 = 0").select("run", "url")
    return grading.unread_sources(p.where("page_id % 3 <> 0").select("run", "url"), found, "run", "url")


@query("sample_spread", """
    SELECT event_type, min(value) AS low, quantile_disc(value, 0.5) AS middle, max(value) AS high, count(*)::BIGINT AS n, count(*) FILTER (WHERE value > 50)::BIGINT AS n_over FROM events GROUP BY event_type""")
def sample_spread(spark: SparkSession, d: str) -> DataFrame:
    return grading.spread(table(spark, d, "events"), ["event_type"], "value", 50.0)


@query("category_counts", """
    WITH s AS (SELECT lang AS category, CASE WHEN quality IS NULL THEN NULL WHEN quality = 1 THEN 60 + l.doc_id % 40 ELSE 30 + l.doc_id % 25 END AS total FROM labels l JOIN documents USING (doc_id)),
    k AS (SELECT category, CASE WHEN total IS NULL THEN 'unmeasurable' WHEN total >= 85 THEN 'excellent' WHEN total >= 70 THEN 'relevant' WHEN total >= 50 THEN 'degraded' ELSE 'not_relevant' END AS c FROM s)
    SELECT category, count(*)::BIGINT AS n, count(*) FILTER (WHERE c = 'excellent')::BIGINT AS excellent, count(*) FILTER (WHERE c = 'relevant')::BIGINT AS relevant, count(*) FILTER (WHERE c = 'degraded')::BIGINT AS degraded,
        count(*) FILTER (WHERE c = 'not_relevant')::BIGINT AS not_relevant, count(*) FILTER (WHERE c = 'unmeasurable')::BIGINT AS unmeasurable FROM k GROUP BY category""")
def category_counts(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    s = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    s = s.select(F.col("lang").alias("category"), F.when(F.col("quality") == 1, 60 + i % 40).when(F.col("quality").isNotNull(), 30 + i % 25).alias("total"))
    return grading.category_counts(s)


@query("canonical_links", r"""
    SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'https://c.example/' || event_id WHEN 1 THEN 'https://d.example/p' END AS canonical FROM events""")
def canonical_links(spark: SparkSession, d: str) -> DataFrame:
    """The address that a response's Link header names as canonical."""
    i = F.col("event_id")
    link = (
        F.when(i % 4 == 0, F.concat(F.lit("<https://x.example/next>; rel=\"next\", <https://c.example/"), i, F.lit(">; rel=\"canonical\""))).when(i % 4 == 1, "<https://d.example/p>;rel=canonical")
        .when(i % 4 == 2, "<https://e.example/>; rel=\"alternate\"")
    )
    return table(spark, d, "events").select("event_id", urls.canonical_link(link).alias("canonical"))


@query("citations", r"""
    WITH m AS (SELECT conv_id, turn, CAST(x AS INTEGER) AS cited FROM (SELECT conv_id, turn, unnest(list_distinct(regexp_extract_all('see [' || turn % 4 || '] and [' || conv_id % 6 || '][9] ' || 'x[0]', '\[([0-9]+)\]', 1))) AS x FROM conversations WHERE role = 'assistant'))
    SELECT m.conv_id, m.turn, m.cited, c.turn IS NOT NULL AS resolved FROM m LEFT JOIN (SELECT DISTINCT conv_id, turn FROM conversations) c ON c.conv_id = m.conv_id AND c.turn = m.cited""")
def citations(spark: SparkSession, d: str) -> DataFrame:
    """The marks [n] of an answer against the numbered sources of its run."""
    c = table(spark, d, "conversations")
    said = F.concat(F.lit("see ["), (F.col("turn") % 4).cast("string"), F.lit("] and ["), (F.col("conv_id") % 6).cast("string"), F.lit("][9] x[0]"))
    answers = c.where("role = 'assistant'").select("conv_id", "turn", said.alias("text"))
    return contracts.cited(answers, c.select("conv_id", F.col("turn").alias("number")).distinct(), ["conv_id"], "turn", "text")


@query("retention", """
    WITH e AS (SELECT event_id, user_id, value, event_type FROM events)
    SELECT user_id, count(*) FILTER (WHERE event_type = 'error')::BIGINT AS n_overridden, max(event_id) FILTER (WHERE event_type = 'error') AS last_override FROM e GROUP BY user_id HAVING count(*) FILTER (WHERE event_type = 'error') > 0""")
def retention(spark: SparkSession, d: str) -> DataFrame:
    """Openings that went on against a robots rule, per investigation: what the override log keeps."""
    e = table(spark, d, "events").select(F.col("user_id").alias("investigation_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "ignored").otherwise("allowed").alias("decision"))
    return store.overrides(e).select(F.col("investigation_id").alias("user_id"), "n_overridden", F.col("last").alias("last_override"))


_CLEAN = r"trim(regexp_replace(regexp_replace({0}, '</?(?:script|style|form|iframe|object|embed|svg|template)\b[^>]*>', '', 'gi'), '\]\s*\(\s*(?:javascript|data|vbscript):[^)]*\)', ']', 'gi'))"
_MARKUP = "'<p>' || text || ' and <b>more</b></p><script>x()</script>'"


@query("document_texts", f"""
    WITH d AS (SELECT doc_id, regexp_replace(text, '[<>]', '', 'g') AS text FROM documents)
    SELECT doc_id, sha256(CASE doc_id % 6 WHEN 0 THEN {_CLEAN.format(_removed(_MARKUP))} WHEN 1 THEN '```py' || chr(10) || text || chr(10) || '```'
        WHEN 2 THEN '{{' || chr(10) || '  "a": ' || doc_id || ',' || chr(10) || '  "b": [' || chr(10) || '    "x",' || chr(10) || '    []' || chr(10) || '  ]' || chr(10) || '}}'
        WHEN 4 THEN {_CLEAN.format(_removed(_MARKUP))} ELSE {_CLEAN.format("text")} END) AS said FROM d""")
def document_texts(spark: SparkSession, d: str) -> DataFrame:
    """Pages, raw code, JSON, what only claims to be JSON, XML, and plain texts with a rendering."""
    i, m = F.col("doc_id"), F.col("doc_id") % 6
    t = table(spark, d, "documents").select("doc_id", F.regexp_replace("text", "[<>]", "").alias("t"))
    mark = F.concat(F.lit("<p>"), "t", F.lit(" and <b>more</b></p><script>x()</script>"))
    body = F.when(m.isin(0, 4), mark).when(m == 2, F.concat(F.lit('{"a":'), i.cast("string"), F.lit(', "b": ["x", []]}'))).when(m == 5, "ignored").otherwise(F.col("t"))
    mime, url = chosen(i, ("text/html", "text/plain", "application/json", "application/json", "text/xml", "text/plain")), F.when(m == 1, "https://raw.githubusercontent.com/a/b/x.py").otherwise("https://a.example/x.json")
    said = texts.document_text(mime, url, body, F.when(m == 5, F.col("t")), F.lit(None).cast("string"))
    return t.select("doc_id", F.sha2(said, 256).alias("said"))


# Result pages of sixteen links each, the same in both languages: plain links, redirects, the engine's own pages, log-ins,
# advertisements, private addresses, links without a text, repeats.
_LINKED = """SELECT page_id // 16 AS serp_id, page_id % 16 AS pos, page_id AS n, page_id % 8 AS m, CASE page_id % 3 WHEN 0 THEN 'Top stories ' WHEN 1 THEN 'A video ' ELSE 'Result ' END || page_id AS title FROM pages"""
_STATES = ("plain", "No results found", "Our systems have detected unusual traffic", "An anomaly occurred", "")


def _result_pages(spark: SparkSession, d: str) -> DataFrame:
    i, m = F.col("page_id"), F.col("page_id") % 8
    at = lambda before, n: F.concat(F.lit(before), n.cast("string"))
    url = (
        F.when(m == 0, at("https://r.example/", i)).when(m == 1, F.concat(at("https://www.google.com/url?q=https%3A%2F%2Fd.example%2F", i), F.lit("&sa=U"))).when(m == 2, at("https://accounts.google.com/", i)).when(m == 3, at("https://x.example/login/", i))
        .when(m == 4, at("https://s.example/", i)).when(m == 5, at("http://10.0.0.1/", i)).when(m == 6, at("https://b.example/", i)).otherwise(at("https://d.example/", i - 6))
    )
    said = F.concat(F.when(i % 3 == 0, "Top stories  ").when(i % 3 == 1, " A video ").otherwise("Result "), i.cast("string"))
    link = F.struct(url.alias("url"), F.when(m == 4, F.concat(said, F.lit(" Sponsored"))).when(m == 6, "  ").otherwise(said).alias("text"))
    serp = F.floor(i / 16)
    links = table(spark, d, "pages").groupBy(serp.alias("serp_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("page_id", link.alias("l")))), lambda x: x["l"]).alias("links"))
    return links.select("serp_id", chosen(F.col("serp_id"), _STATES).alias("text"), F.when(F.col("serp_id") % 5 < 1, F.col("links")).otherwise(F.slice("links", 1, 0)).alias("few"), "links")


@query("serp_admission", f"""
    WITH l AS ({_LINKED}), a AS (SELECT serp_id, pos, CASE m WHEN 0 THEN 'https://r.example/' || n WHEN 1 THEN 'https://d.example/' || n WHEN 7 THEN 'https://d.example/' || (n - 6) END AS url, title, n FROM l WHERE m IN (0, 1, 7)),
    u AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY serp_id, url ORDER BY pos) = 1)
    SELECT serp_id, pos, url, CASE n % 3 WHEN 0 THEN 'news' WHEN 1 THEN 'video' ELSE 'organic' END AS source_type, title FROM u""")
def serp_admission(spark: SparkSession, d: str) -> DataFrame:
    return discovery.candidates(_result_pages(spark, d), "google").select("serp_id", F.col("pos").cast("long").alias("pos"), "url", "source_type", "title")


@query("serp_outcomes", """
    WITH s AS (SELECT DISTINCT page_id // 16 AS serp_id, page_id // 16 % 5 AS k FROM pages)
    SELECT serp_id, CASE k WHEN 2 THEN 'blocked' WHEN 3 THEN 'blocked' WHEN 0 THEN 'parsed' WHEN 1 THEN 'empty' ELSE 'parse_failure' END AS status, CASE k WHEN 2 THEN 'captcha' WHEN 3 THEN 'waf' WHEN 4 THEN 'unrecognized_serp_markup' END AS reason FROM s""")
def serp_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Pages with links are parsed; without any they say that there are none, refuse, or can't be read."""
    pages = _result_pages(spark, d).select("serp_id", "text", F.col("few").alias("links"))
    return discovery.serp_status(pages, "duckduckgo").select("serp_id", "status", "reason")
