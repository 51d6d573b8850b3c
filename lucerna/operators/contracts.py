"""Validation, retries, headers, and what may leave: URLs of a text, sanitised JSON."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucerna.functions import urls

# The cache headers that matter, and the names that mark a secret.
DIRECTIVES = ("cache-control", "etag", "expires", "last-modified", "content-type")
SENSITIVE = r"(?i)(password|passwd|secret|token|api[_-]?key|access[_-]?key|authorization|cookie|credential|private[_-]?key)"


def violations(checks: dict[str, Column]) -> Column:
    """The names of the rules that a row breaks, in order."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))


def result_rules() -> dict[str, Column]:
    """What a result row must satisfy to be answered."""
    return {
        "score_range": F.col("score").between(0, 1), "url_public": urls.policy_reason(F.col("url")).isNull(), "status_known": F.col("status").isin("success", "partial", "no_relevant_results", "blocked", "error"),
        "reason_given": ~F.col("status").isin("blocked", "error") | F.col("reason").isNotNull(),
    }


# How many cases of each category a corpus holds.
CATEGORIES = {"technical_docs": 4, "current_news": 3, "academic_primary": 3, "community_contradictory": 3, "multilingual": 4, "ambiguous_difficult": 3}


def _text(column: str) -> Column:
    return F.trim(F.col(column)) != ""


def case_rules() -> dict[str, Column]:
    """What a case of a corpus must satisfy: id, question, locale, category; ``n_same`` counts the rows of its id."""
    return {
        "id_slug": F.col("id").rlike("^[a-z0-9]+(-[a-z0-9]+)*$"), "id_unique": F.col("n_same") == 1, "question_given": _text("question"), "locale_given": F.length(F.trim("locale")) >= 2, "category_known": F.col("category").isin(*CATEGORIES),
    }


def claim_rules() -> dict[str, Column]:
    """What a fixture's claim must satisfy: text, concepts, patterns, weight, sources by public addresses, passages from its own sources."""
    own = F.flatten(F.transform("sources", lambda s: F.concat(F.array(s["url"]), F.coalesce(s["equivalent_urls"], F.array().cast("array<string>")))))
    said = lambda c: (F.size(c) > 0) & F.forall(c, lambda x: F.coalesce(F.trim(x) != "", F.lit(False)))
    return {
        "claim_given": _text("text"), "concepts_given": said("required_concepts"), "patterns_given": said("acceptable_patterns"), "weight_positive": F.col("weight") > 0,
        "sources_public": (F.size("sources") > 0) & F.forall(own, lambda u: urls.is_url(u)), "passages_cited": F.forall("evidence_passages", lambda p: F.array_contains(own, p["url"]) & (F.trim(p["text"]) != "")),
    }


def run_rules() -> dict[str, Column]:
    """What a run must satisfy: a model, a search, an answer, opened and cited addresses on the web."""
    web = lambda c: F.forall(c, lambda u: urls.is_url(u))
    return {"model_given": _text("model"), "searched": F.size("queries") > 0, "answered": _text("final_answer"), "opened_web": web("opened_urls"), "cited_web": web("cited_urls")}


def corpus_violations(cases: DataFrame) -> DataFrame:
    """(id, violations) of the cases that break a rule, and (category, counted violation) of categories with another number of cases than they must have."""
    same = cases.groupBy("id").agg(F.count("*").alias("n_same"))
    rows = cases.join(same, cases.id.eqNullSafe(same.id)).drop(same.id).withColumn("violations", violations(case_rules())).where(F.size("violations") > 0).select("id", "violations")
    want = F.map_from_arrays(F.array(*map(F.lit, CATEGORIES)), F.array(*map(F.lit, CATEGORIES.values())))
    counts = cases.groupBy("category").agg(F.count("*").alias("n")).where("category IS NOT NULL")
    odd = counts.where(F.coalesce(F.try_element_at(want, F.col("category")) != F.col("n"), F.lit(False)))
    return rows.unionByName(odd.select(F.col("category").alias("id"), F.array(F.lit("category_count")).alias("violations")))


def retried(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """The outcome of each candidate: an error or a time-out gets one more attempt, anything else none."""
    again = F.col("status").isin("network_error", "target_error", "timeout")
    first, second = F.max(F.when(F.col("attempt") == 1, F.col("status"))), F.max(F.when(F.col("attempt") == 2, F.col("status")))
    may = F.coalesce(F.max(F.when(F.col("attempt") == 1, again)), F.lit(False))
    return attempts.groupBy(*keys).agg(F.when(may, F.coalesce(second, first)).otherwise(first).alias("status"), F.when(may & second.isNotNull(), 2).otherwise(1).alias("n_attempts"))


def robots_decision(allowed: Column, access: Column) -> Column:
    """An automatic search obeys; an explicit opening goes on, and says so."""
    return F.when(allowed, "allowed").when(access == "explicit", "ignored").otherwise("disallowed")


def header(headers: Column, name: str) -> Column:
    return F.try_element_at(F.transform_keys(headers, lambda k, _: F.lower(k)), F.lit(name))


def directives(headers: Column) -> Column:
    return F.map_filter(F.transform_keys(headers, lambda k, _: F.lower(k)), lambda k, _: k.isin(*DIRECTIVES))


def conditional(headers: Column) -> Column:
    """The headers that ask whether an entry is still good; an empty map without a validator."""
    pairs = F.array_compact(F.array(*[F.when(header(headers, have).isNotNull(), F.struct(F.lit(ask).alias("k"), header(headers, have).alias("v"))) for have, ask in (("etag", "if-none-match"), ("last-modified", "if-modified-since"))]))
    return F.map_from_entries(pairs)


def urls_in(text: Column) -> Column:
    """Distinct web addresses of a text, without the marks and unpaired brackets that prose puts after them."""
    found = F.regexp_extract_all(text, F.lit(r"https?://[^\s<>\"'`]+"), F.lit(0))
    bare = F.transform(found, lambda u: F.regexp_replace(u, r"(\*+|[.,;:!?]+|\]\([^)]*\)?|[\])}]+)+$", ""))
    return F.array_distinct(F.filter(bare, lambda u: urls.is_url(u)))


def _clean(value, key: str = ""):
    if isinstance(value, dict):
        return {k: _clean(v, k) for k, v in value.items()}
    if isinstance(value, list):
        return [_clean(v, key) for v in value]
    if re.search(SENSITIVE, key) and not isinstance(value, bool):
        return "[redacted]"
    if isinstance(value, str):
        value = re.sub(r"(?i)bearer\s+\S+|(AKIA|ASIA)[0-9A-Z]{16}", "[redacted]", value)
        return re.sub(r"(?<![\w/])(/home|/Users|/root)/[^\s\"']+", "[path]", value)
    return value


def sanitised_json(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, clean, valid): JSON texts without secrets at any depth; a text that isn't JSON is redacted as prose."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, valid = [], []
            for x in b.column("v").to_pylist():
                try:
                    out.append(None if x is None else json.dumps(_clean(json.loads(x)), ensure_ascii=False, sort_keys=True))
                    valid.append(x is not None)
                except ValueError:
                    out.append(_clean(x))
                    valid.append(False)
            yield pa.record_batch([b.column("k"), pa.array(out, pa.string()), pa.array(valid, pa.bool_())], names=[key, "clean", "valid"])

    return df.select(F.col(key).alias("k"), F.col(column).alias("v")).mapInArrow(run, f"`{key}` {kind}, clean string, valid boolean")


def safe_entry(name: Column) -> Column:
    """Whether an archive entry stays inside the folder that it is unpacked to."""
    return ~name.rlike(r"^[/\\]") & ~name.rlike(r"(^|[\\/])\.\.([\\/]|$)")


def iso_date(value: Column) -> Column:
    """The calendar date that a text writes as yyyy-MM-dd, exactly; null otherwise."""
    parsed = F.try_to_date(value, "yyyy-MM-dd")
    return F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$") & (F.date_format(parsed, "yyyy-MM-dd") == value), parsed)


def cited(answers: DataFrame, sources: DataFrame, run: list[str], answer: str, text: str) -> DataFrame:
    """(run, answer, cited, resolved): each distinct mark [n] of an answer, and whether its run has a source of that number."""
    marks = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"\[([0-9]+)\]"), F.lit(1)))
    said = answers.select(*run, answer, F.explode(marks).alias("m")).select(*run, answer, F.col("m").try_cast("int").alias("cited"))
    have = sources.select(*run, F.col("number").alias("cited")).distinct().withColumn("_have", F.lit(True))
    return said.join(have, [*run, "cited"], "left").select(*run, answer, "cited", F.col("_have").isNotNull().alias("resolved"))
