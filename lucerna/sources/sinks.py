"""Sinks: redacted logs, structured answers, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucerna.functions import texts, urls

# The fields that a log line may carry.
LOG_FIELDS = ("ts", "event", "investigation_id", "status", "reason", "duration_ms", "url", "message")


def log_lines(events: DataFrame) -> DataFrame:
    """JSON lines of the allowed fields: URLs without query, messages without secrets."""
    own = [c for c in LOG_FIELDS if c in events.columns]
    clean = {"url": lambda c: urls.log_safe(c), "message": lambda c: texts.redact(c)}
    return events.select(F.to_json(F.struct(*[clean.get(c, lambda x: x)(F.col(c)).alias(c) for c in own])).alias("value"))


def fence(text: Column) -> Column:
    """A code fence longer than any run of backticks in the text."""
    longest = F.array_max(F.transform(F.regexp_extract_all(text, F.lit("(`+)"), F.lit(1)), F.length))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(longest, F.lit(0)) + 1))


def content_hash(passages: Column) -> Column:
    return F.sha2(F.array_join(F.transform(passages, lambda p: p["text"]), "\n"), 256)


def render(results: DataFrame, key: str) -> DataFrame:
    """(key, body): the canonical text of each answer, from (key, place, title, url, passages array<struct<text>>, code array<struct<language,text>>)."""
    block = lambda c: F.concat(fence(c["text"]), F.coalesce(c["language"], F.lit("")), F.lit("\n"), c["text"], F.lit("\n"), fence(c["text"]))
    body = F.concat_ws("\n\n", F.concat(F.lit("# "), F.coalesce("title", "url")), F.col("url"), F.array_join(F.transform("passages", lambda p: p["text"]), "\n\n"), F.array_join(F.transform("code", block), "\n\n"))
    each = F.transform(F.sort_array(F.collect_list(F.struct("place", body.alias("t")))), lambda x: x["t"])
    return results.groupBy(key).agg(F.array_join(each, "\n\n").alias("body"))


def write_once(df: DataFrame, path: str, digest: str = "digest") -> None:
    df.dropDuplicates([digest]).write.mode("append").parquet(path)
