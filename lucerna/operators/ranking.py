"""Ranking of rendered pages from what extraction tells of them, in separate fields and passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lucerna.functions import scoring, texts

#: What an answer shows of a candidate; the rest only ranks it.
VISIBLE = ("url", "source_type", "title")


def corpus(*fields: Column) -> Column:
    """Fields that say something as one text, in the form that units are compared in."""
    some = F.filter(F.array(*[F.nullif(f, F.lit("")) for f in fields]), lambda x: x.isNotNull())
    return F.lower(texts.nfkc(F.array_join(some, " ")))


def eligible(page: Column, units: Column) -> Column:
    """Pages that could be read, are of a supported type, repeat no other, and hold some unit."""
    flag = lambda name, otherwise: F.coalesce(F.col(name), F.lit(otherwise))
    return flag("extractable", True) & flag("supported", True) & ~flag("duplicate", False) & (scoring.coverage(units, page) > 0)


def visible(candidates: DataFrame, *more: str) -> DataFrame:
    return candidates.select(*more, *VISIBLE)


def ranked_pages(candidates: DataFrame, evidence: DataFrame, questions: DataFrame, observed: Column) -> DataFrame:
    """(question, rank, url, source_type, title, score, confidence): eligible pages by their final score.

    ``candidates``: question, url, source_type, title, headings and anchors (arrays),
    content, pos, published, has_author, has_citations, original, boilerplate,
    extractable, supported, duplicate; nulls say that nothing is known.
    ``evidence``: url, text, the passages that were taken from pages; a page
    without one has no passage coverage.  ``questions``: question, units, profile,
    temporal.  Ties go to the lesser URL.
    """
    x = candidates.join(questions, "question")
    page = corpus(F.col("title"), F.array_join("headings", " "), F.col("content"), F.array_join("anchors", " "))
    x = x.withColumn("_page", page).where(eligible(F.col("_page"), F.col("units")))
    said = x.select("question", "url", "units").join(evidence.select("url", F.lower(texts.nfkc(F.col("text"))).alias("_said")), "url")
    best = said.groupBy("question", "url").agg(F.max(scoring.coverage(F.col("units"), F.col("_said"))).alias("_passage"))
    x = x.join(best, ["question", "url"], "left")
    positives = sum((F.coalesce(F.col(c), F.lit(False)).cast("int") for c in ("has_author", "has_citations", "original")), F.lit(0))
    good = scoring.quality(F.col("content"), F.coalesce(F.size("headings"), F.lit(0)), positives, F.col("boilerplate"))
    score = scoring.postrank(
        F.coalesce("_passage", F.lit(0.0)), scoring.coverage(F.col("units"), F.col("_page")), scoring.type_score(F.col("source_type"), F.lit("general")), scoring.type_score(F.col("source_type"), F.col("profile")),
        scoring.position(F.coalesce("pos", F.lit(0))), good, scoring.freshness(F.col("published"), F.col("temporal"), observed), F.col("profile"),
    )
    out = x.withColumn("score", F.round(scoring.clamp(score), 9)).withColumn("confidence", scoring.confidence(F.col("score")))
    rank = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), "url"))
    return visible(out.withColumn("rank", rank), "question", "rank", "score", "confidence")
