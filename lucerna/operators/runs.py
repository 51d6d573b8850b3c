"""Runs of searches as data: results, budgets, diagnostics, reports, and whether a draft's claims are grounded in them."""

from __future__ import annotations

import re

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from lucerna.operators import grading

#: Characters between the outermost words of a concept that isn't written in one piece.
REACH = 160
#: Seconds that a pattern may take over one text.
PATIENCE = 2.0
# The statuses of a run that never searched.
DID_NOT_SEARCH = ("blocked", "error")


def case_results(results: DataFrame) -> DataFrame:
    """(case_id, ordinal, url, text, token_count): ranked pages, then the addresses that redirected ones ended at, free of tokens.

    ``results`` is (case_id, pos, url, final_url, passages array<struct<text>>, token_count).
    """
    text = F.array_join(F.transform("passages", lambda p: F.coalesce(p["text"], F.lit(""))), "\n")
    ranked = results.select("case_id", F.lit(0).alias("part"), "pos", "url", text.alias("text"), F.col("token_count").cast("long").alias("token_count"))
    moved = results.where("final_url IS NOT NULL AND final_url <> url")
    aliases = moved.select("case_id", F.lit(1).alias("part"), "pos", F.col("final_url").alias("url"), text.alias("text"), F.lit(0).cast("long").alias("token_count"))
    w = Window.partitionBy("case_id").orderBy("part", "pos")
    return ranked.unionByName(aliases).withColumn("ordinal", F.row_number().over(w)).select("case_id", "ordinal", "url", "text", "token_count")


def cached_document(entries: DataFrame, url: str, text: str) -> DataFrame:
    """A cached page as a result of its own: the whole text is its one passage, with full score."""
    whole = F.coalesce(F.col(text), F.lit(""))
    passage = F.struct(whole.alias("text"), F.sha2(whole, 256).alias("hash"), F.lit(1.0).alias("score"))
    return entries.select(F.col(url).alias("url"), F.lit(1.0).alias("score"), F.sha2(whole, 256).alias("content_hash"), F.array(passage).alias("passages"))


def open_budget(asked: Column, default: int, most: int) -> Column:
    return F.least(F.coalesce(asked, F.lit(default)), F.lit(most))


def diagnostics(candidates: DataFrame, pages: DataFrame, inputs: DataFrame, query: str) -> DataFrame:
    """Each candidate's score before rendering, its page's after, and what its first input said; candidates without a page stay."""
    page = pages.groupBy(query, "url").agg(F.max("score").alias("page_score"))
    first = inputs.groupBy(query, "url").agg(F.min_by("source_type", "pos").alias("source_type"))
    return candidates.join(page, [query, "url"], "left").join(first, [query, "url"], "left").select(query, "url", "score", "page_score", "source_type")


def report(runs: DataFrame, claims: DataFrame) -> DataFrame:
    """One row: how many cases there are, searched, and have claims; how many claims were accepted and located; who was left out.

    ``runs`` is (case_id, status), ``claims`` (case_id, accepted, located).  The
    list of left-out cases is cut into their number and a digest: it has no bound.
    """
    own = claims.groupBy("case_id").agg(F.count("*").alias("n"), F.count_if("accepted").alias("a"), F.count_if("located").alias("l"))
    x = runs.join(own, "case_id", "left").withColumn("out", F.col("status").isin(*DID_NOT_SEARCH))
    searched = lambda c: F.coalesce(F.sum(F.when(~F.col("out"), F.coalesce(c, F.lit(0)))), F.lit(0))
    return x.agg(
        F.count("*").alias("cases"), F.count_if(F.col("n") > 0).alias("with_claims"), searched(F.col("n")).alias("claims"), searched(F.col("a")).alias("accepted"), searched(F.col("l")).alias("located"),
        F.count_if("out").alias("excluded"), F.coalesce(F.sum(F.when(F.col("out"), F.col("case_id"))), F.lit(0)).alias("excluded_sum"),
    )


# Why a claim is left out of a report, and the mode that measures no quality.
NO_PASSAGE, PROBE = "no URL-located evidence passage", "offline-source-only-mechanics-probe"


def left_out(claims: DataFrame) -> DataFrame:
    """(case_id, claim_id, reason): every claim that no passage locates; ``claims`` is (case_id, claim_id, passages)."""
    return claims.where(F.coalesce(F.size("passages"), F.lit(0)) <= 0).select("case_id", "claim_id", F.lit(NO_PASSAGE).alias("reason"))


def report_scores(cases: DataFrame, graded: DataFrame, statuses: DataFrame, mode: str) -> DataFrame:
    """(case_id, category, split, status, total, classification) of every case of a corpus, one that was never searched unmeasurable.

    ``cases``: case_id, category, calibration; ``graded``: case_id, total,
    classification; ``statuses``: case_id, status.
    """
    x = cases.join(graded, "case_id", "left").join(statuses, "case_id", "left")
    mute = F.lit(mode == PROBE) | F.coalesce(F.col("status").isin(*DID_NOT_SEARCH), F.lit(False)) | F.col("total").isNull()
    split = F.when(F.col("calibration"), "calibration").otherwise("validation")
    return x.select("case_id", "category", split.alias("split"), "status", F.when(~mute, F.col("total")).alias("total"), F.when(mute, "unmeasurable").otherwise(F.col("classification")).alias("classification"))


def verdict(scores: DataFrame, claims: DataFrame, mode: str) -> DataFrame:
    """One row (cases, accepted, located, blocked, verdict): how much of a corpus its scores cover, in words."""
    a = scores.agg(F.count("*").alias("cases"), F.count_if(F.col("status").isin(*DID_NOT_SEARCH)).alias("blocked"))
    b = claims.agg(F.count("*").alias("accepted"), F.count_if(F.size("passages") > 0).alias("located"))
    number = lambda c: F.col(c).cast("string")
    probe = F.concat(F.lit("not_gateable: source-only mechanics probe over "), number("accepted"), F.lit(" accepted claims; it exercises URL, equivalence and rank mechanics and measures no answer quality."))
    blocked = F.when(F.col("blocked") > 0, F.concat(F.lit(" "), number("blocked"), F.lit(" case(s) did not complete a search and are blocked rather than badly answered."))).otherwise("")
    full = F.concat(F.lit("not_gateable: "), number("located"), F.lit(" of "), number("accepted"), F.lit(" accepted claims carry a URL-located evidence passage; the measured scores are published for observation and never gate a release."), blocked)
    return a.withColumn("k", F.lit(1)).join(b.withColumn("k", F.lit(1)), "k").select("cases", "accepted", "located", "blocked", (probe if mode == PROBE else full).alias("verdict"))


def near(corpus: str, words: list[str], reach: int = REACH) -> bool:
    """Whether all words start within ``reach`` characters of each other somewhere: a sweep over their places in order."""
    need, last, found = set(words), {}, re.finditer(r"[a-z0-9]+", corpus)
    for m in found:
        if m[0] in need:
            last[m[0]] = m.start()
            if len(last) == len(need) and m.start() - min(last.values()) <= reach:
                return True
    return False


def concept_grounded(concept: str, corpus: str) -> bool:
    """Whether a lower-case text writes a concept's words one after the other, whatever stands between, or close together."""
    words = re.findall(r"[a-z0-9]+", concept.lower())
    if not words:
        return False
    adjacent = "(?<![a-z0-9])" + "[^a-z0-9]+".join(words) + "(?![a-z0-9])"
    return re.search(adjacent, corpus) is not None or near(corpus, words)


@pandas_udf(StringType())
def _absent_concept(concepts: pd.Series, corpus: pd.Series) -> pd.Series:
    return pd.Series([next((c for c in cs if not concept_grounded(c, x)), None) for cs, x in zip(concepts, corpus)], dtype=object)


@pandas_udf(StringType())
def _absent_pattern(patterns: pd.Series, corpus: pd.Series) -> pd.Series:
    def fault(p: str, x: str) -> str | None:
        try:
            return None if regex.search(p, x, regex.I, timeout=PATIENCE) else f"grading pattern matches no evidence: {p}"
        except regex.error:
            return f"grading pattern is not a valid regular expression: {p}"
        except TimeoutError:
            return f"grading pattern takes too long: {p}"

    return pd.Series([next((f for p in ps if (f := fault(p, x))), None) for ps, x in zip(patterns, corpus)], dtype=object)


def verify_claims(claims: DataFrame, runs: DataFrame) -> DataFrame:
    """(case_id, claim_id, reason): why a draft's claim isn't grounded in what its case's runs saw; null if it is.

    ``claims``: case_id, claim_id, text, sources, concepts, patterns (arrays of
    strings); ``runs``: case_id, run, fragments, urls (arrays of strings).  The
    first reason holds: a source that no run read, a concept that no run
    expressed, words that no run used, a pattern that matches nothing.
    """
    said = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("run", "fragments"))), lambda x: x["fragments"]))
    seen = runs.groupBy("case_id").agg(F.lower(F.array_join(said, "\n")).alias("corpus"), F.array_distinct(F.flatten(F.collect_list("urls"))).alias("urls"))
    seen = seen.withColumn("words", grading.word_set(F.col("corpus")))
    x = claims.join(seen, "case_id", "left").withColumn("corpus", F.coalesce("corpus", F.lit("")))
    none = F.array().cast("array<string>")
    unread = F.try_element_at(F.array_except("sources", F.coalesce("urls", none)), F.lit(1))
    unsaid = F.size(F.array_except(grading.content_words(F.col("text")), F.coalesce("words", none))) > 0
    concept = _absent_concept("concepts", "corpus")
    reason = F.coalesce(
        F.concat(F.lit("claim source is absent from evidence: "), unread), F.concat(F.lit("required concept is absent from evidence: "), concept),
        F.when(unsaid, F.lit("claim text is not lexically grounded in evidence")), _absent_pattern("patterns", "corpus"),
    )
    return x.select("case_id", "claim_id", reason.alias("reason"))
