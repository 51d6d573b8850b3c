"""Structure of a page: blocks, passages, code, links."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lucerna.functions import texts, urls
from lucerna.session import dealt
from lucerna.sources.readers import robots_status

PASSAGE, DEFAULT_PASSAGES = 1200, 2
_HEADING = re.compile(r"(#{1,6})\s+(.+)")
_ENDS = (". ", "! ", "? ", "\n")


@dataclass
class _Passages:
    """Gathers blocks into passages of at most ``PASSAGE`` characters under one heading."""

    out: list[dict] = field(default_factory=list)
    held: list[str] = field(default_factory=list)
    path: tuple[str, ...] = ()

    def flush(self) -> None:
        text = "\n\n".join(self.held).strip()
        self.held = []
        if text:
            self.out.append({"text": text, "heading": self.path[-1] if self.path else None, "heading_path": list(self.path), "code": None})

    def paragraph(self, text: str, path: tuple[str, ...]) -> None:
        if path[-1:] != self.path[-1:] or (self.held and sum(len(x) + 2 for x in self.held) + len(text) > PASSAGE):
            self.flush()
        self.path = path
        if len(text) <= PASSAGE:
            self.held.append(text)
            return
        self.flush()
        for piece in pieces(text):
            self.held.append(piece)
            self.flush()

    def code(self, language: str, text: str, path: tuple[str, ...]) -> None:
        self.flush()
        self.path = path
        self.out.append({"text": text, "heading": path[-1] if path else None, "heading_path": list(path), "code": language})


def pieces(text: str) -> Iterator[str]:
    """Cuts a long run into passages, at the last sentence end of the window's second half if it has one."""
    rest = text.strip()
    while len(rest) > PASSAGE:
        at = max(rest.rfind(e, 0, PASSAGE) for e in _ENDS)
        at = at + 1 if at > PASSAGE // 2 else PASSAGE
        yield rest[:at].strip()
        rest = rest[at:].strip()
    if rest:
        yield rest


def segment(markdown: str) -> list[dict]:
    """Passages and code blocks of a Markdown text, in order."""
    found, path, paragraph, code, language = _Passages(), (), [], None, ""

    def done() -> None:
        if paragraph:
            found.paragraph("\n".join(paragraph), path)
            paragraph.clear()

    for raw in markdown.replace("\r", "").split("\n"):
        line = raw.strip()
        if code is not None:
            if line.startswith("```"):
                found.code(language, "\n".join(code), path)
                code = None
            else:
                code.append(raw)
        elif line.startswith("```"):
            done()
            code, language = [], line[3:].strip()
        elif m := _HEADING.fullmatch(line):
            done()
            path = (*path[: len(m[1]) - 1], m[2].strip())
        elif line:
            paragraph.append(line)
        else:
            done()
    done()
    if code is not None:
        found.code(language, "\n".join(code), path)
    found.flush()
    return found.out


def blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, text, heading, heading_path, code): a text crosses into Arrow once."""
    kind = df.schema[key].dataType.simpleString()
    item = pa.struct([("text", pa.string()), ("heading", pa.string()), ("heading_path", pa.list_(pa.string())), ("code", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [segment(t or "") for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("key"), pa.array(found, pa.list_(item))], names=["key", "blocks"])

    cut = dealt(df.select(F.col(key).alias("key"), F.col(text).alias("text"))).mapInArrow(run, f"key {kind}, blocks array<struct<text:string,heading:string,heading_path:array<string>,code:string>>")
    return cut.select(F.col("key").alias(key), F.posexplode("blocks").alias("pos", "b")).select(key, "pos", "b.*")


def best_passages(cut: DataFrame, key: str, focus: DataFrame | None = None, limit: int = DEFAULT_PASSAGES) -> DataFrame:
    """The best passages of each text, one per heading: (key, rank, pos, score, heading, passage_hash, text).

    ``focus`` is (key, units); without it a passage scores by its length.
    """
    own = cut.where("code IS NULL")
    if focus is None:
        score = F.least(F.length("text"), F.lit(PASSAGE)) / PASSAGE
    else:
        own = own.join(focus, key)
        low = F.lower(F.col("text"))
        matched = F.size(F.filter("units", lambda u: F.contains(low, u))).cast("double")
        score = F.when(F.size("units") == 0, F.least(F.length("text"), F.lit(PASSAGE)) / PASSAGE).otherwise(matched * F.when(texts.is_navigation(F.col("text")), 0.1).otherwise(1.0))
    own = own.withColumn("score", score)
    alone = F.coalesce("heading", F.concat(F.lit("\0"), F.col("pos").cast("string")))
    w = Window.partitionBy(key, alone).orderBy(F.desc("score"), "pos")
    own = own.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    w = Window.partitionBy(key).orderBy(F.desc("score"), "pos")
    own = own.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    return own.select(key, "rank", "pos", "score", "heading", F.sha2("text", 256).alias("passage_hash"), "text")


def code_blocks(cut: DataFrame, key: str) -> DataFrame:
    own = cut.where("code IS NOT NULL")
    return own.select(key, "pos", F.nullif("code", F.lit("")).alias("language"), "text", texts.code_warnings(F.col("text")).alias("warnings"), F.sha2("text", 256).alias("content_hash"))


def links(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """(key, kind, rank, url, title) of a page's links: trackers stripped, first of each URL, at most 20 content and 10 navigation ones."""
    found = pages.select(key, F.col(url).alias("page"), F.posexplode(texts.anchors_of(F.col(html))).alias("pos", "a"))
    source = urls.scheme(F.col("page")), urls.host(F.col("page"))
    whole = F.when(F.col("a.url").rlike("^https?://"), F.col("a.url")).when(F.col("a.url").startswith("/"), F.concat(source[0], F.lit("://"), source[1], F.col("a.url")))
    found = found.select(key, "page", "pos", urls.safe_link(whole).alias("link"), F.col("a.text").alias("title")).where("link IS NOT NULL")
    w = Window.partitionBy(key, "link").orderBy("pos")
    found = found.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    same = (urls.scheme(F.col("link")) == urls.scheme(F.col("page"))) & (urls.host(F.col("link")) == urls.host(F.col("page")))
    menu = F.col("title").rlike("(?i)^(home|menu|navigation|next|previous|sign in|log in)$")
    found = found.withColumn("kind", F.when(same | menu, "navigation").otherwise("content"))
    w = Window.partitionBy(key, "kind").orderBy("pos")
    found = found.withColumn("rank", F.row_number().over(w)).where(F.when(F.col("kind") == "navigation", F.col("rank") <= 10).otherwise(F.col("rank") <= 20))
    return found.select(key, "kind", "rank", F.col("link").alias("url"), F.when(F.col("title") != "", F.col("title")).otherwise(urls.host(F.col("link"))).alias("title"))


def robots_rules(bodies: DataFrame, agent: str) -> DataFrame:
    """(host, pos, allow, rule) of the lines of robots files (host, body) that hold for an agent.

    A group applies from a User-agent line that names everyone or the agent, up to
    the next User-agent line.
    """
    lines = bodies.select("host", F.posexplode(F.split("body", "\n")).alias("pos", "line"))
    clean = F.trim(F.regexp_replace("line", "#.*", ""))
    lines = lines.select("host", "pos", F.lower(F.trim(F.substring_index(clean, ":", 1))).alias("name"), F.trim(F.regexp_replace(clean, "^[^:]*:?", "")).alias("value")).where(clean.contains(":"))
    applies = F.when(F.col("name") == "user-agent", (F.col("value") == "*") | (F.lower("value") == agent.lower()))
    w = Window.partitionBy("host").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("applies", F.last(applies, ignorenulls=True).over(w))
    return lines.where("applies AND name IN ('allow', 'disallow') AND value <> ''").select("host", "pos", (F.col("name") == "allow").alias("allow"), F.col("value").alias("rule"))


def rules_permit(rules: DataFrame, paths: DataFrame) -> DataFrame:
    """(host, path, allowed): the longest matching rule decides, the later of equals; allowed without one."""
    hit = paths.join(rules, "host").where(F.startswith(F.col("path"), F.col("rule")))
    best = hit.groupBy("host", "path").agg(F.max_by("allow", F.struct(F.length("rule"), F.col("pos"))).alias("allow"))
    return paths.distinct().join(best, ["host", "path"], "left").select("host", "path", F.coalesce("allow", F.lit(True)).alias("allowed"))


def robots_permits(rules: DataFrame, paths: DataFrame, agent: str) -> DataFrame:
    """(host, path, allowed) under the robots files (host, body)."""
    return rules_permit(robots_rules(rules, agent), paths)


def answered_rules(robots: DataFrame, agent: str) -> tuple[DataFrame, DataFrame]:
    """The rules of robots answers (host, status, body), and the hosts that gave one (host)."""
    bodies = robots.select("host", robots_status(F.col("status"), F.coalesce("body", F.lit(""))).alias("body"))
    return robots_rules(bodies, agent), robots.select("host").distinct()


def permitted(pages: DataFrame, rules: DataFrame, asked: DataFrame) -> DataFrame:
    """(host, path, allowed) of the distinct pages (host, path), by ``answered_rules``; a host that gave no answer is closed."""
    open_ = rules_permit(rules, pages)
    return open_.join(asked.withColumn("_asked", F.lit(True)), "host", "left").select("host", "path", (F.col("allowed") & F.coalesce("_asked", F.lit(False))).alias("allowed"))
