"""Ranking columns.  All of it is expressions over built-in functions, so a ranking is one projection and one window."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lucerna.functions import texts

# Source types that a profile expects.
EXPECTED = {"technical": ("document", "organic"), "news": ("news",), "academic": ("academic", "document"), "community": ("discussion",)}


@dataclass(frozen=True)
class Weights:
    passage: float = 0.35
    concept: float = 0.2
    source_type: float = 0.15
    position: float = 0.15
    quality: float = 0.1
    freshness: float = 0.05
    general: float = 0.7
    specialized: float = 0.3


def clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def coverage(units: Column, corpus: Column) -> Column:
    """The share of units that the lower-case corpus contains as substrings; 0 without units."""
    hits = F.size(F.filter(units, lambda u: F.coalesce(F.contains(corpus, u), F.lit(False))))
    return F.when(F.size(units) > 0, hits / F.size(units)).otherwise(0.0)


def position(pos: Column) -> Column:
    return F.when(pos > 0, 1.0 / pos).otherwise(0.5)


def type_score(source_type: Column, profile: Column) -> Column:
    out = F.when(profile.isin("general", "auto"), F.when(source_type == "organic", 1.0).otherwise(0.65))
    for name, expected in EXPECTED.items():
        out = out.when(profile == name, F.when(source_type.isin(*expected), 1.0).otherwise(0.4))
    return out.otherwise(0.4)


def novelty(is_novel: Column) -> Column:
    return F.when(F.coalesce(is_novel, F.lit(True)), 1.0).otherwise(0.0)


def quality(content: Column, headings: Column, positives: Column, boilerplate: Column) -> Column:
    n = F.coalesce(F.length(F.trim(content)), F.lit(0))
    substantial = F.when(n >= 800, 1.0).when(n >= 200, 0.6).otherwise(0.25)
    return clamp(0.45 * substantial + 0.2 * F.least(headings / 4.0, F.lit(1.0)) + 0.35 * (positives / 3.0) - 0.3 * clamp(F.coalesce(boilerplate, F.lit(0.0))))


def freshness(published: Column, temporal: Column, observed: Column) -> Column:
    days = F.greatest(F.lit(0.0), (F.unix_micros(observed) - F.unix_micros(published)) / 8.64e10)
    return F.when(~temporal | published.isNull() | observed.isNull(), 0.5).otherwise(clamp(1.0 - days / 365.0))


def documentation_bonus(units: Column, path: Column) -> Column:
    asks = F.exists(units, lambda t: t.isin(*texts.DOCUMENTATION_WORDS))
    return F.when(asks & path.rlike(texts.DOCUMENTATION_PATH), 0.15).otherwise(0.0)


def prerank(cov: Column, pos: Column, kind: Column, novel: Column, bonus: Column) -> Column:
    return clamp(0.45 * cov + 0.25 * pos + 0.2 * kind + 0.1 * novel + bonus)


def postrank(passage: Column, concept: Column, general_type: Column, profile_type: Column, pos: Column, qual: Column, fresh: Column, profile: Column, w: Weights = Weights()) -> Column:
    base = w.passage * passage + w.concept * concept + w.source_type * general_type + w.position * pos + w.quality * qual + w.freshness * fresh
    special = clamp(0.7 * base + 0.3 * profile_type)
    return F.when(profile == "general", base).otherwise(w.general * base + w.specialized * special)


def confidence(score: Column) -> Column:
    return F.when(score >= 0.7, "high").when(score >= 0.4, "medium").otherwise("low")


def round3(x: Column) -> Column:
    """Half-up to three decimals."""
    return F.floor(x * 1000 + 0.5) / 1000


def classification(total: Column) -> Column:
    return F.when(total.isNull(), "unmeasurable").when(total >= 85, "excellent").when(total >= 70, "relevant").when(total >= 50, "degraded").otherwise("not_relevant")
