"""Queries over cited pages, logs of runs, redirects, budgets and unspaced texts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucerna.functions import texts
from lucerna.operators import capture, segmentation, store, traces
from lucerna.plans.registry import registry
from lucerna.session import shared_dir
from lucerna.sources import readers
from lucerna.sources.readers import table

QUERIES, ORACLE_SQL, query = registry()

# Claims, the same in both languages: each question's first longer word, sought in four documents under two sources.
_WORD = "lower(regexp_extract(text, '[A-Za-z]{4,}'))"
_CITED = "(item_id * 13 + k * 7) % (SELECT count(*) FROM documents)"
_HOLDS = "regexp_matches(lower(p), '(^|[^a-z0-9])' || word || '($|[^a-z0-9])')"


def _claims(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Claims over benchmark items, and documents as the pages they cite: every third one can't be read, lines are paragraphs."""
    docs = table(spark, d, "documents")
    n = docs.agg(F.count("*").alias("n"))
    page = lambda k: F.concat(F.lit("https://h.example/"), ((F.col("item_id") * 13 + k * 7) % F.col("n")).cast("string"))
    word = F.lower(F.regexp_extract("text", "[A-Za-z]{4,}", 0))
    source = lambda a, b: F.struct(page(a).alias("url"), F.array(page(b)).alias("equivalent_urls"))
    claims = table(spark, d, "benchmark").where(F.regexp_extract("text", "[A-Za-z]{4,}", 0) != "").join(F.broadcast(n)).select(F.floor(F.col("item_id") / 8).alias("case_id"), F.col("item_id").alias("claim_id"), F.array(word).alias("concepts"), F.array(word).alias("patterns"), F.array(source(0, 1), source(2, 3)).alias("sources"))
    i = F.col("doc_id")
    content = F.regexp_replace(F.coalesce("text", F.lit("")), "\n", "\n\n")
    pages = docs.select(F.concat(F.lit("https://h.example/"), i.cast("string")).alias("url"), F.when(i % 3 != 0, content).alias("content"), F.when(i % 3 == 0, "http 500").alias("error"))
    return claims, pages


_CAPTURED = f"""
    c AS (SELECT item_id, {_WORD} AS word FROM benchmark WHERE regexp_extract(text, '[A-Za-z]{{4,}}') <> ''), a AS (SELECT item_id, word, k, {_CITED} AS doc_id FROM c, unnest([0, 1, 2, 3]) AS u(k)),
    b AS (SELECT item_id, k, doc_id, word, CASE WHEN doc_id % 3 <> 0 THEN list_filter(string_split(coalesce(text, ''), chr(10)), lambda p: {_HOLDS}) END AS found FROM a JOIN documents USING (doc_id)),
    f AS (SELECT *, CASE WHEN len(found) > 0 THEN list_filter(found, lambda p: length(p) = list_min(list_transform(found, lambda q: length(q))))[1] END AS passage,
        'https://h.example/' || doc_id || CASE WHEN found IS NULL THEN ': unreachable (http 500)' ELSE ': page does not contain required concept: ' || word END AS said FROM b),
    o AS (SELECT item_id, arg_min(doc_id, k) FILTER (WHERE passage IS NOT NULL) AS doc_id, arg_min(passage, k) FILTER (WHERE passage IS NOT NULL) AS passage, string_agg(said, '; ' ORDER BY k) AS said FROM f GROUP BY item_id)"""


@query("capture_passages", f"""
    WITH {_CAPTURED} SELECT item_id AS claim_id, 'https://h.example/' || doc_id AS url, passage, CASE WHEN passage IS NULL THEN said END AS reason FROM o""")
def capture_passages(spark: SparkSession, d: str) -> DataFrame:
    return capture.captured(*_claims(spark, d)).select("claim_id", "url", "passage", "reason")


@query("capture_totals", f"""
    WITH {_CAPTURED} SELECT item_id // 8 AS case_id, count(*) AS total_claims, count(passage) AS captured, count(*) - count(passage) AS excluded FROM o GROUP BY 1""")
def capture_totals(spark: SparkSession, d: str) -> DataFrame:
    return capture.capture_report(capture.captured(*_claims(spark, d)))


@query("smallest_spans", r"""
    WITH w AS (SELECT doc_id, string_split(text, chr(10)) AS lines, regexp_extract_all(lower(text), '[a-z]{4,}') AS w FROM documents),
    b AS (SELECT doc_id, lines, '(^|[^a-z0-9])' || w[1] || '($|[^a-z0-9])' AS x, '(^|[^a-z0-9])' || w[len(w) // 2 + 1] || '($|[^a-z0-9])' AS y FROM w WHERE len(w) > 1),
    l AS (SELECT doc_id, x, y, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM b), k AS (SELECT *, sum(length(line) + 2) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM l WHERE trim(line) <> ''),
    s AS (SELECT i.doc_id, i.pos AS first, j.pos AS last, j.upto - i.upto + length(i.line) AS n FROM k i JOIN k j ON i.doc_id = j.doc_id AND i.pos <= j.pos
        AND (regexp_matches(lower(i.line), i.x) AND regexp_matches(lower(j.line), j.y) OR regexp_matches(lower(i.line), i.y) AND regexp_matches(lower(j.line), j.x))),
    t AS (SELECT doc_id, arg_min(struct_pack(f := first, l := last), struct_pack(n := n, f := first)) AS s FROM s GROUP BY doc_id)
    SELECT b.doc_id, sha256(array_to_string(list_filter(lines[s.f + 1:s.l + 1], lambda z: trim(z) <> ''), chr(10) || chr(10))) AS span_sha256 FROM b JOIN t USING (doc_id)""")
def smallest_spans(spark: SparkSession, d: str) -> DataFrame:
    """The smallest run of each document's lines that holds its first longer word and its middle one."""
    found = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))
    docs = table(spark, d, "documents").withColumn("w", found).where(F.size("w") > 1)
    two = F.array(F.col("w")[0], F.element_at("w", F.floor(F.size("w") / 2).cast("int") + 1))
    pairs = docs.select("doc_id", F.regexp_replace("text", "\n", "\n\n").alias("content"), two.alias("concepts"), F.slice("w", 1, 1).alias("patterns"))
    hit = capture.supported(pairs, ["doc_id"]).where("passage IS NOT NULL")
    return hit.select("doc_id", F.sha2(F.regexp_replace("passage", r"\n\s*\n", "\n\n"), 256).alias("span_sha256"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as logs: of even ones in the shape of items, of odd ones in that of messages, every ninth line cut short."""
    c, t, said = F.col("conv_id"), F.col("turn"), F.col("text")
    at = F.concat(F.lit("https://h.example/"), c.cast("string"), F.lit("/"), t.cast("string"))
    user, even = F.col("role") == "user", c % 2 == 0
    none = F.lit(None).cast("string")
    item = F.when(user, F.to_json(F.struct(F.lit("item.completed").alias("type"), F.struct(F.lit("web_search").alias("type"), said.alias("query"), F.struct(F.lit("search").alias("type"), F.when(t % 4 == 2, at).otherwise(none).alias("url")).alias("action")).alias("item"))))
    item = item.otherwise(F.to_json(F.struct(F.lit("item.completed").alias("type"), F.struct(F.lit("agent_message").alias("type"), F.concat(said, F.lit(" see "), at, F.lit(".")).alias("text")).alias("item"))))
    call = F.array(F.struct(F.lit("tool_use").alias("type"), F.lit("WebSearch").alias("name"), F.struct(said.alias("query")).alias("input")))
    message = F.when(user, F.to_json(F.struct(F.lit("assistant").alias("type"), F.struct(call.alias("content")).alias("message"))))
    message = message.otherwise(F.to_json(F.struct(F.lit("result").alias("type"), F.concat(said, F.lit(" see "), at, F.lit(".")).alias("result"))))
    result = F.to_json(F.struct(F.lit("user").alias("type"), F.struct(at.alias("url"), said.alias("result")).alias("tool_use_result")))
    rows = table(spark, d, "conversations")
    main = rows.select(c.alias("run"), (t * 2).alias("seq"), F.when(even, "items").otherwise("messages").alias("shape"), F.when(even, item).otherwise(message).alias("event"))
    read = rows.where(user & ~even).select(c.alias("run"), (t * 2 + 1).alias("seq"), F.lit("messages").alias("shape"), result.alias("event"))
    broken = rows.where("(conv_id + turn) % 9 = 0").select(c.alias("run"), (t * 2 + 1000).alias("seq"), F.when(even, "items").otherwise("messages").alias("shape"), F.substring(result, 1, 20).alias("event"))
    return main.unionByName(read).unionByName(broken)


@query("normalised_runs", """
    WITH c AS (SELECT *, conv_id % 2 = 0 AS even, role = 'user' AS asks, 'https://h.example/' || conv_id || '/' || turn AS page FROM conversations),
    q AS (SELECT conv_id, text, min(turn) AS turn FROM c WHERE asks GROUP BY conv_id, text), u AS (SELECT conv_id, sha256(string_agg(text, chr(10) ORDER BY turn)) AS queries_sha256, count(*) AS n_queries FROM q GROUP BY conv_id),
    o AS (SELECT conv_id, string_agg(page, ' ' ORDER BY turn) AS opened FROM c WHERE asks AND (even AND turn % 4 = 2 OR NOT even) GROUP BY conv_id),
    a AS (SELECT conv_id, arg_max(text || ' see ' || page || '.', turn) AS answer, arg_max(page, turn) AS cited FROM c WHERE NOT asks GROUP BY conv_id),
    n AS (SELECT conv_id, count(*) FILTER (WHERE asks) AS n_results, count(*) FILTER (WHERE asks AND NOT even) AS n_passages, count(*) FILTER (WHERE (conv_id + turn) % 9 = 0) AS n_unreadable FROM c GROUP BY conv_id)
    SELECT conv_id AS run, coalesce(n_queries, 0)::BIGINT AS n_queries, coalesce(queries_sha256, sha256('')) AS queries_sha256, coalesce(opened, '') AS opened, coalesce(cited, '') AS cited, sha256(coalesce(answer, '')) AS answer_sha256, n_results::BIGINT AS n_results, n_passages::BIGINT AS n_passages,
        trim(coalesce(opened, '') || ' ' || coalesce(cited, '')) AS sources, n_unreadable::BIGINT AS n_unreadable FROM n LEFT JOIN u USING (conv_id) LEFT JOIN o USING (conv_id) LEFT JOIN a USING (conv_id)""")
def normalised_runs(spark: SparkSession, d: str) -> DataFrame:
    r = traces.normalised(_events(spark, d))
    size = lambda c: F.size(c).cast("long")
    return r.select(
        "run", size("queries").alias("n_queries"), F.sha2(F.array_join("queries", "\n"), 256).alias("queries_sha256"), F.array_join("opened_urls", " ").alias("opened"), F.array_join("cited_urls", " ").alias("cited"),
        F.sha2("final_answer", 256).alias("answer_sha256"), size("tool_results").alias("n_results"), size("evidence_passages").alias("n_passages"), F.array_join(F.transform("selected_sources", lambda s: s["url"]), " ").alias("sources"), "n_unreadable",
    )


@query("jsonl_records", """
    SELECT event_id, CASE WHEN event_id % 11 = 3 THEN left(line, 12) ELSE line END AS line, event_id % 11 <> 3 AS sound, true AS numbered
    FROM (SELECT event_id, '{"event_id":' || event_id || ',"kind":"' || event_type || '"}' AS line FROM events)""")
def jsonl_records(spark: SparkSession, d: str) -> DataFrame:
    """Events written as lines, some cut short, read back with their numbers: lines of a file count from 1 without a gap."""
    at = f"{shared_dir(spark)}/lucerna-lines-{uuid.uuid4().hex}"
    line = F.concat(F.lit('{"event_id":'), F.col("event_id").cast("string"), F.lit(',"kind":"'), "event_type", F.lit('"}'))
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 11 == 3, F.substring(line, 1, 12)).otherwise(line).alias("value"))
    e.select("value").write.text(at)
    rows = readers.jsonl_lines(spark, at, "event_id long, kind string")
    files = rows.groupBy("file").agg(F.count("*").alias("n"), F.max("line").alias("last"), F.countDistinct("line").alias("k"))
    told = rows.join(files.select("file", ((F.col("n") == F.col("last")) & (F.col("n") == F.col("k"))).alias("numbered")), "file")
    raw = F.coalesce("corrupt", F.concat(F.lit('{"event_id":'), F.col("record.event_id").cast("string"), F.lit(',"kind":"'), F.col("record.kind"), F.lit('"}')))
    told = told.select(raw.alias("value"), F.col("corrupt").isNull().alias("sound"), "numbered")
    # a line cut short no longer tells its event: lines of one wording stand for each other
    return e.join(told.dropDuplicates(["value"]), "value").select("event_id", F.col("value").alias("line"), "sound", "numbered")


@query("affordable_files", """
    WITH RECURSIVE f AS (SELECT source AS target, doc_id, octet_length(encode(text)) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
    r AS (SELECT target, doc_id, k, n <= 20000 AS kept, CASE WHEN n <= 20000 THEN n ELSE 0 END AS used FROM f WHERE k = 1
        UNION ALL SELECT f.target, f.doc_id, f.k, f.n <= 20000 - r.used, r.used + CASE WHEN f.n <= 20000 - r.used THEN f.n ELSE 0 END FROM r JOIN f ON f.target = r.target AND f.k = r.k + 1)
    SELECT target, doc_id FROM r WHERE kept""")
def affordable_files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files of their sources, 20,000 bytes a source."""
    files = table(spark, d, "documents").select(F.col("source").alias("target"), "doc_id", F.octet_length("text").cast("long").alias("length"))
    return readers.affordable(files, "target", "doc_id", "length", 20_000).select("target", "doc_id")


# Redirects, the same in both languages: most documents lead to the next one; sites' rules and addresses go by number.
@query("redirects_checked", """
    WITH RECURSIVE p AS (SELECT doc_id AS i, doc_id // 4 AS h, doc_id % 17 = 4 AS private, doc_id % 9 < 7 AS moves FROM documents),
    s AS (SELECT i AS id, i AS here, i % 2 = 1 AS explicit, 0 AS n FROM p WHERE i % 3 = 0),
    w AS (SELECT id, here, explicit, n, private, moves, CASE WHEN private THEN 'non_public_address' WHEN h % 6 IN (1, 5) AND NOT explicit THEN 'robots_disallowed' WHEN h % 4 = 2 THEN 'rebinding' WHEN moves AND n = 5 AND here + 1 IN (SELECT i FROM p) THEN 'redirect_limit' END AS reason,
            NOT private AND h % 6 IN (1, 5) AND explicit AS ignored FROM s JOIN p ON p.i = s.here
        UNION ALL SELECT w.id, p.i, w.explicit, w.n + 1, p.private, p.moves, CASE WHEN p.private THEN 'non_public_address' WHEN p.h % 6 IN (1, 5) AND NOT w.explicit THEN 'robots_disallowed' WHEN p.h % 4 = 2 THEN 'rebinding' WHEN p.moves AND w.n + 1 = 5 AND p.i + 1 IN (SELECT i FROM p) THEN 'redirect_limit' END,
            w.ignored OR NOT p.private AND p.h % 6 IN (1, 5) AND w.explicit FROM w JOIN p ON p.i = w.here + 1 WHERE w.reason IS NULL AND w.moves AND w.n < 5),
    e AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC) = 1)
    SELECT id, CASE WHEN private THEN 'http://10.0.0.' || here % 200 || '/' || here ELSE 'https://s' || here // 4 || '.example/' || here END AS url, n AS n_redirects, reason, ignored AS robots_ignored FROM e""")
def redirects_checked(spark: SparkSession, d: str) -> DataFrame:
    """Every third document asked for, odd ones explicitly: rules, addresses and the number of redirects are checked at each hop."""
    def url(i):
        return F.when(i % 17 == 4, F.concat(F.lit("http://10.0.0."), (i % 200).cast("string"), F.lit("/"), i.cast("string"))).otherwise(F.concat(F.lit("https://s"), F.floor(i / 4).cast("string"), F.lit(".example/"), i.cast("string")))

    docs = table(spark, d, "documents").select(F.col("doc_id").alias("i"))
    later = docs.select((F.col("i") - 1).alias("i")).withColumn("more", F.lit(True))
    i, h = F.col("i"), F.floor(F.col("i") / 4)
    answers = docs.join(later, "i", "left").select(url(i).alias("url"), F.when((i % 9 < 7) & F.coalesce("more", F.lit(False)), 302).otherwise(200).alias("status"), url(i + 1).alias("location"))
    site = docs.select(h.alias("h"), F.concat(F.lit("s"), h.cast("string"), F.lit(".example")).alias("host")).distinct()
    robots = site.where("h % 6 <> 5").select("host", F.when(F.col("h") % 6 == 1, 503).when(F.col("h") % 6 == 0, 404).otherwise(200).alias("status"), F.when(F.col("h") % 6 > 1, "User-agent: *\nDisallow: /private").alias("body"))
    resolved = site.select("host", F.array(F.lit("8.8.8.8")).alias("first"), F.when(F.col("h") % 4 == 2, F.array(F.lit("8.8.4.4"))).otherwise(F.array(F.lit("8.8.8.8"))).alias("second"))
    start = docs.where("i % 3 = 0").select(i.alias("id"), url(i).alias("url"), F.when(i % 2 == 1, "explicit").otherwise("automatic").alias("access"))
    return store.followed(start, answers, robots, resolved)


@query("host_circuit", """
    WITH a AS (SELECT doc_id // 40 AS search, lang AS host, doc_id AS rank, CASE doc_id % 4 WHEN 0 THEN 'blocked' WHEN 1 THEN 'timeout' ELSE 'success' END AS status FROM documents),
    f AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY search ORDER BY rank) <= 30),
    b AS (SELECT *, coalesce(sum(CASE WHEN status = 'blocked' THEN 1 ELSE 0 END) OVER (PARTITION BY search, host ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM f)
    SELECT search, host, rank, status FROM b WHERE b < 2""")
def host_circuit(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    status = F.when(i % 4 == 0, "blocked").when(i % 4 == 1, "timeout").otherwise("success")
    a = table(spark, d, "documents").select(F.floor(i / 40).alias("search"), F.col("lang").alias("host"), i.alias("rank"), status.alias("status"))
    return store.circuit(a, "search", "host", "rank", "status")


_LETTERS, _KANA = "abcdefghijklmnopqrstuvwxyz", "あいうえおかきくけこさしすせそたちつてとなにぬねのは"


@query("segmented_words")
def segmented_words(spark: SparkSession, d: str) -> DataFrame:
    """Questions in letters of an unspaced script, cut by a dictionary counted over all documents."""
    kana = lambda c: F.regexp_replace(F.translate(F.lower(c), _LETTERS, _KANA), f"[^{_KANA}\n]", "")
    words = table(spark, d, "documents").select(F.explode(texts.words(F.col("text"))).alias("w")).select(kana(F.col("w")).alias("word"))
    asked = table(spark, d, "benchmark").select("item_id", kana(F.col("text")).alias("text"))
    out = segmentation.segmented(asked, "item_id", "text", segmentation.dictionary(words))
    return out.select("item_id", F.size("words").alias("n_words"), F.array_join("words", " ").alias("words"))
