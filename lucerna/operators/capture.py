"""What a cited page says in support of a claim: the smallest run of paragraphs that holds all of it, and the first cited page that has one."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.operators.runs import PATIENCE, REACH

# What stands between paragraphs.
_BREAK = re.compile(r"(?:\r?\n)[^\S\r\n]*(?:\r?\n)+")
_WORD = re.compile(r"[a-z0-9]+")


def _normal(text: str) -> str:
    return text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).lower()


class Page:
    """A page's paragraphs, and what it says in its normal form, by paragraph."""

    def __init__(self, content: str):
        cuts, at = [], 0
        for m in _BREAK.finditer(content):
            cuts.append((at, m.start()))
            at = m.end()
        self.spans = [(a, b) for a, b in [*cuts, (at, len(content))] if content[a:b].strip()]
        self.content, self.said, starts, at = content, [], [], 0
        for k, (a, b) in enumerate(self.spans):
            gap = _normal(content[self.spans[k - 1][1] : a]) if k else ""
            self.said.append(_normal(content[a:b]))
            at += len(gap)
            starts.append(at)
            at += len(self.said[-1])
        self.starts = np.array(starts, np.int64)
        gaps = [_normal(content[x[1] : y[0]]) for x, y in zip(self.spans, self.spans[1:])]
        self.text = "".join(p for pair in zip(self.said, [*gaps, ""]) for p in pair)
        # code units, as lengths of passages are compared
        self.size = [len(content[a:b].encode("utf-16-le", "surrogatepass")) // 2 for a, b in self.spans]
        self.gap = [len(content[x[1] : y[0]].encode("utf-16-le", "surrogatepass")) // 2 for x, y in zip(self.spans, self.spans[1:])]
        self._words: dict[str, list[int]] | None = None

    def words(self) -> dict[str, list[int]]:
        if self._words is None:
            self._words = {}
            for m in _WORD.finditer(self.text):
                self._words.setdefault(m[0], []).append(m.start())
        return self._words

    def latest(self, found: list[tuple[int, int]]) -> np.ndarray:
        """For each paragraph the last one from which a span to it holds one of these runs of characters; -1: none does."""
        out = np.full(len(self.spans), -1, np.int64)
        if found:
            at = np.array(found, np.int64)
            first, last = (np.searchsorted(self.starts, x, "right") - 1 for x in (at[:, 0], at[:, 1] - 1))
            np.maximum.at(out, last, first)
        return np.maximum.accumulate(out)

    def concept(self, concept: str) -> list[tuple[int, int]]:
        """Where a concept's words stand one after the other, whatever is between, or all start within REACH characters."""
        words = _WORD.findall(concept.lower())
        if not words:
            return []
        joined = "[^a-z0-9]+".join(words)
        out = [(m.start(1), m.end(1)) for m in re.finditer(f"(?<![a-z0-9])(?=({joined})(?![a-z0-9]))", self.text)]
        need = sorted(set(words))
        places = sorted((p, w) for w in need for p in self.words().get(w, []))
        last: dict[str, int] = {}
        for p, w in places:
            last[w] = p
            if len(last) == len(need) and p - min(last.values()) <= REACH:
                out.append((min(last.values()), p + len(w)))
        return out

    def pattern(self, pattern: str) -> list[tuple[int, int]]:
        """Where a pattern matches, within each paragraph and across paragraphs from left to right."""
        ready = regex.compile(pattern, regex.I)
        out = [(int(at), int(at) + max(1, len(p))) for at, p in zip(self.starts, self.said) if ready.search(p, timeout=PATIENCE)]
        return out + [(m.start(), max(m.end(), m.start() + 1)) for m in ready.finditer(self.text, timeout=PATIENCE)]


def support(content: str, concepts: list[str], patterns: list[str]) -> tuple[str | None, str | None]:
    """(passage, reason): the shortest run of whole paragraphs that holds every concept and some pattern, the earliest of equals; or why there is none."""
    page = Page(content)
    reach = np.arange(len(page.spans))
    for c in concepts:
        found = page.latest(page.concept(c))
        if not len(found) or found[-1] < 0:
            return None, f"page does not contain required concept: {c}"
        reach = np.minimum(reach, found)
    some = np.full(len(page.spans), -1, np.int64)
    for p in patterns:
        try:
            some = np.maximum(some, page.latest(page.pattern(p)))
        except regex.error:
            return None, f"pattern is not a valid regular expression: {p}"
        except TimeoutError:
            return None, f"pattern takes too long: {p}"
    if not len(some) or some[-1] < 0:
        return None, "page matches no acceptable pattern for this claim"
    reach = np.minimum(reach, some)
    ends = np.flatnonzero(reach >= 0)
    total = np.concatenate([[0], np.cumsum(np.array(page.size) + np.array([*page.gap, 0]))])
    size = total[ends] + np.array(page.size)[ends] - total[reach[ends]]
    best = int(ends[np.argmin(size)])
    return content[page.spans[int(reach[best])][0] : page.spans[best][1]], None


def supported(pairs: DataFrame, key: list[str]) -> DataFrame:
    """(key, passage, reason) of claims and pages: ``pairs`` is key, content, concepts, patterns.  A page is in memory alone."""
    kinds = ", ".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("content", "concepts", "patterns")))
            found = [support(t or "", [x for x in c or [] if x is not None], [x for x in p or [] if x is not None]) for t, c, p in rows]
            columns = [*(b.column(c) for c in key), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string())]
            yield pa.record_batch(columns, names=[*key, "passage", "reason"])

    return pairs.select(*key, "content", "concepts", "patterns").mapInArrow(run, f"{kinds}, passage string, reason string")


def captured(claims: DataFrame, pages: DataFrame) -> DataFrame:
    """(case_id, claim_id, url, passage, content_sha256, reason): the first cited page that supports each claim, or why none does.

    ``claims``: case_id, claim_id, concepts, patterns, sources
    array<struct<url,equivalent_urls>>; ``pages``: url, content, error, where no
    row, or one with an error, is a page that couldn't be read.  A claim's addresses
    are tried in order, each source's own before its equivalents; every reason is
    told if all fail.
    """
    cited = F.flatten(F.transform("sources", lambda s: F.concat(F.array(s["url"]), F.coalesce(s["equivalent_urls"], F.array().cast("array<string>")))))
    asked = claims.select("case_id", "claim_id", "concepts", "patterns", F.posexplode(cited).alias("at", "url"))
    read = asked.join(pages.select("url", "content", "error"), "url", "left")
    key = ["case_id", "claim_id", "at", "url"]
    hits = supported(read.where("content IS NOT NULL AND error IS NULL").withColumn("digest", F.sha2("content", 256)), key)
    digests = pages.select("url", F.sha2("content", 256).alias("content_sha256"))
    failed = read.where("content IS NULL OR error IS NOT NULL").select(*key, F.lit(None).cast("string").alias("passage"), F.concat(F.lit("unreachable ("), F.coalesce("error", F.lit("failed")), F.lit(")")).alias("reason"))
    tried = hits.unionByName(failed)
    first = F.min_by(F.struct("url", "passage"), F.when(F.col("passage").isNotNull(), F.col("at")))
    every = F.transform(F.sort_array(F.collect_list(F.struct("at", F.concat("url", F.lit(": "), "reason").alias("said")))), lambda x: x["said"])
    told = tried.groupBy("case_id", "claim_id").agg(first.alias("hit"), F.array_join(every, "; ").alias("said"))
    out = claims.select("case_id", "claim_id").join(told, ["case_id", "claim_id"], "left").withColumn("url", F.col("hit.url")).join(digests, "url", "left")
    reason = F.when(F.col("hit.passage").isNull(), F.coalesce("said", F.lit("claim cites no source")))
    return out.select("case_id", "claim_id", "url", F.col("hit.passage").alias("passage"), "content_sha256", reason.alias("reason"))


def capture_report(outcomes: DataFrame) -> DataFrame:
    """(case_id, total_claims, captured, excluded) of each case."""
    return outcomes.groupBy("case_id").agg(F.count("*").alias("total_claims"), F.count("passage").alias("captured"), F.count("reason").alias("excluded"))
