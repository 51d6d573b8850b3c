"""From candidates to an answer: preparing pages with a reason for each that drops out, filling a quota, answering from the cache."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType

from lucerna.functions import texts, urls
from lucerna.operators import extraction, store

# Candidates that a search spends itself on, those in preparation at once, and failures that close a host.
BUDGET, IN_FLIGHT, FAILURES = 30, 8, 2
# Types whose text can be read.
READABLE = ("text/html", "application/xhtml+xml", "text/plain", "text/markdown", "text/x-source-code", "application/json", "application/xml", "text/xml", "application/pdf")
PASSAGES = "array<struct<text:string,score:double,heading:string,hash:string>>"


def _passage(whole: Column) -> Column:
    return F.array(F.struct(whole.alias("text"), F.lit(1.0).alias("score"), F.lit(None).cast("string").alias("heading"), F.sha2(whole, 256).alias("hash"))).cast(PASSAGES)


def prepared(candidates: DataFrame, robots: DataFrame, cached: DataFrame, renders: DataFrame, now: Column, agent: str = "lucerna", limit: int = extraction.DEFAULT_PASSAGES) -> DataFrame:
    """Each candidate with outcome, reason, passages, mime and content: one that fails drops out alone, and says why.

    ``candidates``: question, url (unique in a question), source_type, units; other
    columns stay.  ``cached``: canonical_url, content, fetched, cache_control,
    content_class; asked for candidates of type local_cache only.  ``renders``:
    url, content_type, body, not_modified, error; no row: not rendered.

    outcome is ``cached`` (a fresh entry stands for the page), ``confirmed`` (a
    stale one that its origin says is unchanged), ``rendered`` (extracted anew,
    ``content`` is what the cache is to hold) or ``dropped``: by robots, as
    not_rendered, for the rendering's error, as unsupported_format or, without any
    text, unsupported_or_ocr_required.
    """
    c = candidates.withColumn("_host", urls.host(F.col("url"))).withColumn("_path", urls.path(F.col("url")))
    allowed = extraction.permitted(c.select(F.col("_host").alias("host"), F.col("_path").alias("path")).distinct(), *extraction.answered_rules(robots, agent))
    entry = cached.select(F.col("canonical_url").alias("_key"), F.struct("content", "fetched", "cache_control", "content_class").alias("_entry"))
    seen = renders.select(F.col("url").alias("_url"), F.struct("content_type", "body", "not_modified", "error").alias("_render"))
    x = c.join(allowed.select(F.col("host").alias("_host"), F.col("path").alias("_path"), "allowed"), ["_host", "_path"], "left")
    x = x.withColumn("_local", F.when(F.col("source_type") == "local_cache", urls.canonical(F.col("url")))).join(entry, F.col("_local") == F.col("_key"), "left").join(seen, F.col("url") == F.col("_url"), "left")
    usable = F.coalesce(F.col("_entry.content") != "", F.lit(False))
    fresh = usable & store.is_fresh(F.col("_entry.fetched"), F.col("_entry.cache_control"), F.coalesce("_entry.content_class", F.lit("general")), now)
    mime = texts.mime_of(F.coalesce("_render.content_type", F.lit("")), F.coalesce("_render.body", F.lit("")), F.col("url"), F.lit(False))
    state = (
        F.when(~F.coalesce("allowed", F.lit(False)), "robots").when(fresh, "cached").when(F.col("_render").isNull(), "not_rendered").when(F.col("_render.error").isNotNull(), F.col("_render.error"))
        .when(usable & F.coalesce("_render.not_modified", F.lit(False)), "confirmed").when(~mime.isin(*READABLE), "unsupported_format").otherwise("extract")
    )
    x = x.withColumn("_state", state).withColumn("mime", F.when(F.col("_state") == "extract", mime)).withColumn("_row", F.struct("question", "url"))

    read = x.where("_state = 'extract'")
    body = F.when(F.col("mime") == "application/pdf", texts.pdf_text(F.coalesce("_render.body", F.lit("")).cast("binary"))).otherwise(texts.document_text(F.col("mime"), F.col("url"), F.col("_render.body"), F.lit(None).cast("string"), F.col("_render.body")))
    read = read.select(F.to_json("_row").alias("_key"), "units", body.alias("_text"))
    best = extraction.best_passages(extraction.blocks(read, "_key", "_text"), "_key", read.select("_key", F.coalesce("units", F.array().cast("array<string>")).alias("units")), limit)
    found = F.transform(F.sort_array(F.collect_list(F.struct("rank", "text", "score", "heading", "passage_hash"))), lambda p: F.struct(p["text"].alias("text"), p["score"].cast("double").alias("score"), p["heading"].alias("heading"), p["passage_hash"].alias("hash")))
    best = best.groupBy("_key").agg(found.cast(PASSAGES).alias("_found"))
    x = x.drop("_key").join(best.select(F.col("_key").alias("_best"), "_found"), (F.col("_state") == "extract") & (F.to_json("_row") == F.col("_best")), "left")

    kept = F.col("_state").isin("cached", "confirmed")
    rendered = (F.col("_state") == "extract") & F.col("_found").isNotNull()
    outcome = F.when(kept, F.col("_state")).when(rendered, "rendered").otherwise("dropped")
    reason = F.when((F.col("_state") == "extract") & ~rendered, "unsupported_or_ocr_required").when(~kept & ~rendered, F.col("_state"))
    passages = F.when(kept, _passage(F.col("_entry.content"))).when(rendered, F.col("_found"))
    content = F.when(rendered, F.array_join(F.transform("_found", lambda p: p["text"]), "\n"))
    return x.select(*candidates.columns, outcome.alias("outcome"), reason.alias("reason"), passages.alias("passages"), "mime", content.alias("content"))


def taken(hosts: list[str], works: list[bool], pages: list[str], gone: list[bool], wanted: int) -> list[int]:
    """Which of a search's candidates, best first, are answered with.

    Eight are in preparation at once: the best whose host isn't closed come in as
    others settle.  A host with two pages failed or in preparation is closed until
    one of them succeeds.  They are taken in the order they came in; a page that
    was given away before (``gone``, or taken here) counts for nothing.
    """
    failed: dict[str, int] = {}
    flying: dict[str, int] = {}
    waiting, pending, out, given = list(range(len(hosts))), [], [], set()

    def admit() -> None:
        while len(pending) < IN_FLIGHT:
            at = next((k for k, i in enumerate(waiting) if failed.get(hosts[i], 0) + flying.get(hosts[i], 0) < FAILURES), None)
            if at is None:
                return
            i = waiting.pop(at)
            flying[hosts[i]] = flying.get(hosts[i], 0) + 1
            pending.append(i)

    admit()
    while pending and len(out) < wanted:
        i = pending.pop(0)
        flying[hosts[i]] -= 1
        failed[hosts[i]] = failed.get(hosts[i], 0) + (not works[i])
        admit()
        if works[i] and not gone[i] and pages[i] not in given:
            given.add(pages[i])
            out.append(i)
    return out


@pandas_udf(ArrayType(IntegerType()))
def _taken(hosts: pd.Series, works: pd.Series, pages: pd.Series, gone: pd.Series, wanted: pd.Series) -> pd.Series:
    return pd.Series([taken(list(h), list(w), list(p), list(g), n) for h, w, p, g, n in zip(hosts, works, pages, gone, wanted)], dtype=object)


def filled(pages: DataFrame, consumed: DataFrame, wanted: int) -> DataFrame:
    """The prepared pages that each question is answered with, ``place`` by score.

    ``pages``: question, url, score, outcome; ``consumed``: question, url
    (canonical) of what earlier answers gave away.  A question has at most BUDGET
    candidates, so what one call folds stays small.
    """
    page = urls.canonical(F.col("url"))
    x = pages.withColumn("_page", F.coalesce(page, F.col("url"))).withColumn("_works", F.col("outcome") != "dropped")
    gone = consumed.select(F.col("question").alias("_q"), F.col("url").alias("_u")).distinct().withColumn("_gone", F.lit(True))
    x = x.join(gone, (F.col("question") == F.col("_q")) & (F.col("_page") == F.col("_u")), "left").drop("_q", "_u").withColumn("_gone", F.coalesce("_gone", F.lit(False)))
    x = x.withColumn("_n", F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), "url"))).where(F.col("_n") <= BUDGET)
    every = F.sort_array(F.collect_list(F.struct("_n", urls.host(F.col("url")).alias("host"), "_works", "_page", "_gone")))
    lists = x.groupBy("question").agg(every.alias("e"))
    of = lambda name: F.transform("e", lambda p: p[name])
    chosen = lists.select("question", F.explode(_taken(of("host"), of("_works"), of("_page"), of("_gone"), F.lit(wanted))).alias("_i"))
    out = x.join(chosen.select("question", (F.col("_i") + 1).alias("_n")), ["question", "_n"])
    return out.withColumn("place", F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), "_n"))).drop("_page", "_works", "_gone", "_n")


def merged(found: DataFrame, local: DataFrame) -> DataFrame:
    """(question, pos, url, source_type, title): what discovery found without what the cache holds as well, then the cache's own.

    ``found``: question, pos, url, source_type, title; ``local``: question, rank,
    url.  Without ``found`` of a question its cached pages stand alone.
    """
    rest = found.join(local.select("question", "url"), ["question", "url"], "left_anti").select("question", F.lit(0).alias("_part"), F.col("pos").alias("_at"), "url", "source_type", "title")
    own = local.select("question", F.lit(1).alias("_part"), F.col("rank").alias("_at"), "url", F.lit("local_cache").alias("source_type"), urls.host(F.col("url")).alias("title"))
    place = F.row_number().over(Window.partitionBy("question").orderBy("_part", "_at", "url"))
    return rest.unionByName(own).withColumn("pos", place).select("question", "pos", "url", "source_type", "title")


def answer_status(discovered: DataFrame, results: DataFrame, wanted: int) -> DataFrame:
    """(question, status, confidence, reason, n_results).

    ``discovered``: question, status, reason.  A question whose discovery was
    blocked or failed is answered from the cache with full confidence, or with
    discovery's own failure if the cache holds nothing.
    """
    n = results.groupBy("question").agg(F.count("*").alias("n_results"), F.bool_or(F.col("score") >= 0.4).alias("_fair"))
    x = discovered.join(n, "question", "left").withColumn("n_results", F.coalesce("n_results", F.lit(0)))
    failed = F.col("status").isin("blocked", "error", "parse_failure")
    status, confidence = store.status(F.col("n_results"), F.lit(wanted), F.coalesce("_fair", F.lit(False)))
    why = (
        F.when(F.col("reason").contains("renderer_unavailable"), "renderer_unavailable").when(F.col("reason").contains("captcha"), "captcha")
        .when(F.col("reason").contains("waf"), "waf").when(F.col("reason").contains("timeout"), "timeout").otherwise("network_error")
    )
    none = failed & (F.col("n_results") == 0)
    said = F.when(none, F.when(F.col("status") == "blocked", "blocked").otherwise("error")).when(failed, "success").otherwise(status)
    sure = F.when(none, "low").when(failed, "high").otherwise(confidence)
    return x.select("question", said.alias("status"), sure.alias("confidence"), F.when(none, why).alias("reason"), "n_results")
