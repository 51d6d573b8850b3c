"""Offline grading: claims against results, promotion, retrieval measures, grounding."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lucerna.functions import scoring, texts, urls
from lucerna.session import saved

# Points of each component, and the token budget.
POINTS = {"evidence_coverage": 40, "source_recall": 25, "rank": 15, "extraction": 10, "diversity": 5, "token_budget": 5}
TOKENS = 6000
# Words that ground nothing.
STOP_WORDS = tuple(
    "that this these those with from into than then when while where which their there them they also have has had been being does not but and for are its it the only each both same such over under after before because however rather still some more most other another every must should would could will can may using used use".split()
)


def source_ranks(claims: DataFrame, results: DataFrame) -> DataFrame:
    """(case_id, claim_id, rank, host) of results that a claim's sources name, by page identity."""
    wanted = claims.select("case_id", "claim_id", F.explode("source_urls").alias("u")).select("case_id", "claim_id", urls.page_identity(F.col("u")).alias("page")).distinct()
    have = results.select("case_id", F.col("pos").alias("rank"), urls.page_identity(F.col("url")).alias("page"), urls.host(F.col("url")).alias("host"))
    return wanted.join(have, ["case_id", "page"]).select("case_id", "claim_id", "rank", "host").distinct()


def grade(claims: DataFrame, results: DataFrame) -> DataFrame:
    """One row per case with its six components (null: unmeasurable), total and class.

    ``claims``: case_id, claim_id, weight, source_urls, patterns, concepts,
    passages array<struct<url,text>>; ``results``: case_id, pos, url, text, token_count.
    """
    ranks = source_ranks(claims, results).groupBy("case_id", "claim_id").agg(F.min("rank").alias("first"), F.countDistinct("rank").alias("n"), F.countDistinct("host").alias("hosts"))
    # a case's texts are gathered once and meet its claims there; nothing that carries a text is dealt again
    row = F.struct("pos", "text", urls.page_identity(F.col("url")).alias("page"))
    page = results.groupBy("case_id").agg(F.sort_array(F.collect_list(row)).alias("_rows"), F.sum(F.coalesce("token_count", texts.lexical_tokens(F.col("text")))).alias("tokens"))
    pattern = lambda p: F.replace(F.replace(p, F.lit("\\`"), F.lit("`")), F.lit("`"), F.lit("`?"))
    # flattened once for each case, not for each of its claims
    page = page.select("case_id", "tokens", texts.flattened(F.array_join(F.transform("_rows", lambda x: x.text), "\n")).alias("_said"), F.transform("_rows", lambda x: F.struct(x.page.alias("page"), texts.flattened(x.text).alias("have"))).alias("_pages"))
    said = F.coalesce("_said", F.lit(""))
    concept = lambda c: F.regexp_like(said, F.concat(F.lit("(?<![a-z0-9])"), F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "[^\\\\p{L}\\\\p{N}]+"), F.lit("(?![a-z0-9])")))
    evident = F.forall("concepts", concept) & F.exists("patterns", lambda p: F.regexp_like(said, F.concat(F.lit("(?iu)"), pattern(p))))
    wanted = F.transform("passages", lambda p: F.struct(urls.page_identity(p.url).alias("page"), texts.flattened(p.text).alias("want")))
    hit = lambda p: F.coalesce(F.exists("_pages", lambda x: (x.page == p.page) & F.contains(x.have, p.want)), F.lit(False))
    c = claims.select("case_id", "claim_id", "weight", "patterns", "concepts", (F.size("passages") > 0).alias("expects"), wanted.alias("_wanted")).join(page, "case_id", "left")
    c = c.select("case_id", "claim_id", "weight", "tokens", "expects", evident.alias("evident"), F.when(F.col("expects"), F.forall("_wanted", hit)).alias("extracted")).join(ranks, ["case_id", "claim_id"], "left")
    w = F.col("weight")
    total_w, passage_w = F.nullif(F.sum(w), F.lit(0.0)), F.nullif(F.sum(F.when(F.col("expects"), w)), F.lit(0.0))
    share = lambda cond: F.sum(F.when(cond, w).otherwise(0.0)) / total_w
    out = c.groupBy("case_id").agg(
        share(F.col("evident")).alias("evidence_coverage"),
        share(F.col("first").isNotNull()).alias("source_recall"),
        (F.sum(F.coalesce(w / F.col("first"), F.lit(0.0))) / total_w).alias("rank"),
        (F.sum(F.when(F.col("extracted"), w).otherwise(0.0)) / passage_w).alias("extraction"),
        (F.sum(F.coalesce(w * F.col("hosts") / F.col("n"), F.lit(0.0))) / total_w).alias("diversity"),
        F.greatest(F.lit(0.0), 1.0 - F.greatest(F.lit(0), F.coalesce(F.max("tokens"), F.lit(0)) - TOKENS) / TOKENS).alias("token_budget"),
    )
    out = out.select("case_id", *[scoring.round3(F.col(k) * p).alias(k) for k, p in POINTS.items()])
    total = sum((F.col(k) for k in POINTS), F.lit(0.0))
    return out.withColumn("total", total).withColumn("classification", scoring.classification(F.col("total")))


def promotion(champion: DataFrame, challenger: DataFrame) -> DataFrame:
    """One row: whether the challenger is promoted, and each failed condition.

    Both are (case_id, category, critical, total).
    """
    m = F.coalesce(F.avg("total"), F.lit(0.0))
    a = champion.agg(m.alias("champion_mean"), F.count_if(F.col("total").isNull()).alias("gaps_a"))
    b = challenger.agg(
        m.alias("mean"), (F.count_if(F.col("total") >= 70) / F.greatest(F.count("total"), F.lit(1))).alias("good"), F.coalesce(F.max(F.col("critical") & (F.col("total") < 50)), F.lit(False)).alias("critical_low"),
        F.count_if(F.col("total").isNull()).alias("gaps_b"),
    )
    by = lambda df, name: df.groupBy("category").agg(m.alias(name))
    lost = by(challenger, "x").join(by(champion, "y"), "category", "full").agg(F.count_if(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0)) < -5).alias("lost"))
    one = a.withColumn("k", F.lit(1)).join(b.withColumn("k", F.lit(1)), "k").join(lost.withColumn("k", F.lit(1)), "k")
    failures = F.array_compact(
        F.array(
            F.when((F.col("gaps_a") > 0) | (F.col("gaps_b") > 0), F.lit("unmeasurable component prevents promotion")), F.when(F.col("mean") < 75, F.lit("mean below 75")),
            F.when(F.col("good") < 0.8, F.lit("fewer than 80% of queries score 70+")), F.when(F.col("critical_low"), F.lit("critical canary below 50")),
            F.when(F.col("mean") - F.col("champion_mean") < 3, F.lit("overall gain below 3")), F.when(F.col("lost") > 0, F.lit("a category lost more than 5")),
        )
    )
    return one.select("mean", "champion_mean", "good", F.array_join(failures, "; ").alias("failures"), (F.size(failures) == 0).alias("promoted"))


def mrr_recall(ranked: DataFrame, relevant: DataFrame, queries: DataFrame, query: str, doc: str) -> DataFrame:
    """One row: mean reciprocal rank and recall over the queries."""
    first = ranked.join(relevant, [query, doc]).groupBy(query).agg(F.min("rank").alias("first"))
    return queries.join(first, query, "left").agg(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"), F.avg(F.col("first").isNotNull().cast("int")).alias("recall"), F.count("*").alias("n_queries"))


def content_words(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.lower(text), "[^a-z0-9]+")), lambda w: (F.length(w) > 3) & ~w.isin(*STOP_WORDS))


def word_set(text: Column) -> Column:
    return F.array_distinct(F.split(F.lower(text), "[^a-z0-9]+"))


def holding_words(claims: DataFrame, held: DataFrame, claim: str, doc: str) -> DataFrame:
    """(claim, doc) of the documents that hold every word of a claim; ``claims`` is (claim, w: distinct words), ``held`` (doc, word).

    A claim meets the documents of its rarest word only, and those meet its other
    words by document and word, so a common word is nobody's join key.
    """
    words = claims.where(F.size("w") > 0).select(claim, F.size("w").alias("n"), F.explode("w").alias("word"))
    own = saved(held.join(words.select("word").distinct(), "word", "left_semi"), "held")
    told = words.join(own.groupBy("word").agg(F.count("*").alias("df")), "word", "left")
    rare = told.groupBy(claim, "n").agg(F.count("df").alias("known"), F.min_by("word", F.struct("df", "word")).alias("rarest")).where("known = n")
    likely = rare.join(own.select(F.col("word").alias("rarest"), doc), "rarest").select(claim, "n", doc)
    found = likely.join(words.select(claim, "word"), claim).join(own, ["word", doc]).groupBy(claim, doc).agg(F.count("*").alias("k"), F.first("n").alias("n"))
    return found.where("k = n").select(claim, doc)


def near_texts(df: DataFrame, key: str, text: str, groups: DataFrame, reach: int = 160) -> DataFrame:
    """(key, group) of the texts in which all words of a group start within ``reach`` characters of each other.

    ``groups`` is (group, words), few enough to be told to every task.  A text is
    swept once where it is read; nothing is shuffled.
    """
    told = sorted((r[0], sorted(set(r[1]))) for r in groups.select("group", "words").collect())
    held = df.sparkSession.sparkContext.broadcast(told)
    kinds = f"`{key}` {df.schema[key].dataType.simpleString()}, group {groups.schema['group'].dataType.simpleString()}"
    arrow = to_arrow_type(groups.schema["group"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[str, list[int]] = {}
        for g, (_, words) in enumerate(held.value):
            for w in words:
                by.setdefault(w, []).append(g)
        for b in batches:
            out = []
            for i, t in enumerate(b.column("t").to_pylist()):
                last: dict[int, dict[str, int]] = {}
                hit: set[int] = set()
                for m in re.finditer(r"[a-z0-9]+", (t or "").lower()):
                    for g in by.get(m[0], ()):
                        if g not in hit:
                            own = last.setdefault(g, {})
                            own[m[0]] = m.start()
                            if len(own) == len(held.value[g][1]) and m.start() - min(own.values()) <= reach:
                                hit.add(g)
                out += [(i, g) for g in sorted(hit)]
            yield pa.record_batch([b.column("k").take(pa.array([i for i, _ in out], pa.int64())), pa.array([held.value[g][0] for _, g in out], arrow)], names=[key, "group"])

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, kinds)


def unread_sources(claimed: DataFrame, read: DataFrame, run: str, url: str) -> DataFrame:
    """(run, n_claimed, n_missing): the distinct addresses that a run's claims name, and those it never read."""
    both = claimed.select(run, url).distinct().join(read.select(run, url).distinct().withColumn("_read", F.lit(True)), [run, url], "left")
    return both.groupBy(run).agg(F.count("*").alias("n_claimed"), F.count_if(F.col("_read").isNull()).alias("n_missing"))


def spread(samples: DataFrame, keys: list[str], value: str, bound: float) -> DataFrame:
    """Least, middle (by nearest rank) and greatest value of each group, its size, and how many exceed the bound."""
    v = F.col(value)
    return samples.groupBy(*keys).agg(
        F.min(v).alias("low"), F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{value}`)").alias("middle"), F.max(v).alias("high"), F.count("*").alias("n"), F.count_if(v > bound).alias("n_over")
    )


def category_counts(scored: DataFrame) -> DataFrame:
    """(category, n, one column for each class): how the totals of each category fall."""
    label = scoring.classification(F.col("total"))
    return scored.groupBy("category").agg(F.count("*").alias("n"), *[F.count_if(label == c).alias(c) for c in ("excellent", "relevant", "degraded", "not_relevant", "unmeasurable")])
