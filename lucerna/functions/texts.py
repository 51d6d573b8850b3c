"""Text columns: markup removal, questions, navigation, secrets, shingles."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Elements whose content never counts.
ACTIVE = ("script", "style", "form", "iframe", "object", "embed", "svg", "template", "noscript")
_NAMES = "|".join(ACTIVE)
# Profiles by the words that name them, in order.
PROFILES = (
    ("technical", "api|typescript|javascript|python|rust|code|sdk|cli|bug|error"),
    ("news", "news|breaking|today|latest|recent|actualité"),
    ("academic", "paper|research|study|journal|doi|arxiv|citation"),
    ("community", "reddit|forum|community|discussion|opinions?"),
)
TEMPORAL = ("latest", "recent", "today", "current", "news", "nouveau", "actualité")
CURRENT = r"(?i)(?<![A-Za-z0-9_])(current|currently|latest|newest|now|today|up-to-date)(?![A-Za-z0-9_])"
DOCUMENTATION_WORDS = ("documentation", "docs", "guide", "manual", "handbook")
DOCUMENTATION_PATH = r"(?i)(^|/)(docs?|documentation|guide|guides|manual|handbook)(/|$)"
# Invisible characters and their warnings.
INVISIBLE = (
    (r"\x{200B}", "zero_width_space"), (r"\x{200C}", "zero_width_non_joiner"), (r"\x{200D}", "zero_width_joiner"),
    (r"[\x{202A}\x{202B}\x{202D}\x{202E}\x{2066}-\x{2069}]", "bidirectional_control"),
)
# What a refusal says, and what it means, in order.
BLOCKED = (
    ("unusual traffic|recaptcha|not a robot", "captcha"), ("access denied|web application firewall|temporarily blocked", "waf"),
    (r"before you continue|consent\.google", "consent_required"), ("通常と異なるトラフィック|ロボットではない|私はロボットではありません", "captcha"),
    ("트래픽이 감지되었습니다|로봇이 아닙니다", "captcha"), ("necesitamos comprobar|tráfico inusual", "captcha"),
    ("trafic inhabituel|je ne suis pas un robot", "captcha"), ("ungewöhnlicher datenverkehr|ich bin kein roboter", "captcha"),
)
BLOCKED_BY = {"google": (), "duckduckgo": (("anomaly|blocked for abuse", "waf"),), "bing": (("made us think you were a bot|unusual activity", "captcha"),)}
# Source types by what a link says, in order.
SOURCE_TYPES = (
    ("news", "news|top stories|headline"), ("discussion", "discussion|forum|reddit|stack overflow|stackoverflow"), ("video", "video|youtube|vimeo"),
    ("academic", r"academic|scholar|journal|doi\.org|arxiv"), ("document", r"document|pdf|filetype:|\.pdf"), ("other", "other results|shopping|images|maps"),
)
# Where raw code is served.
RAW_HOST = r"(?i)^[a-z]+://raw\.githubusercontent\.com/"
_EDGE, _NOT_AFTER = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


@pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(value: Column) -> Column:
    """Unicode NFKC; no built-in function does it.  Only texts beyond ASCII travel to Python: the others go as nulls."""
    wide = value.rlike(r"[^\x00-\x7F]")
    return F.when(wide, _nfkc(F.when(wide, value))).otherwise(value)


@pandas_udf(StringType())
def _entities(values: pd.Series) -> pd.Series:
    import re

    named = {"&colon;": ":", "&semi;": ";", "&lpar;": "(", "&rpar;": ")"}

    def one(m: re.Match) -> str:
        found = named.get(m[0].lower())
        if found or m[3] is None:
            return found or m[0]
        try:
            code = int(m[3], 16 if m[2] else 10)
        except ValueError:
            return m[0]
        return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]

    pattern = re.compile(r"&(#(x)?([0-9a-f]+)|[a-z]+);", re.I)
    return values.map(lambda x: None if x is None else pattern.sub(one, x))


def decode_entities(value: Column) -> Column:
    """The entities that can disguise markup: four named ones and all numeric ones.  Texts without one don't leave the JVM."""
    some = value.rlike(r"(?i)&(#x?[0-9a-f]+|colon|semi|lpar|rpar);")
    return F.when(some, _entities(F.when(some, value))).otherwise(value)


def html_to_text(value: Column, entities: bool = True) -> Column:
    """What a reader sees of markup: active and hidden elements gone, tags as spaces, blank lines kept once."""
    x = decode_entities(value) if entities else value
    hidden = r"(?:\shidden(?=[\s>=])|aria-hidden\s*=\s*[\"']?true|style\s*=\s*(?:[\"'][^\"']*|[^\s\"'>]*)(?:display\s*:\s*none|visibility\s*:\s*hidden))"
    for pattern, to in (
        (rf"(?is)<({_NAMES}).*?</\1\s*>", ""), (rf"(?i)<(?:{_NAMES})\b[^>]*/?\s*>", ""), (rf"(?is)<[^>]*{hidden}[^>]*>.*?</[^>]+>", ""),
        (r"(?is)\s(?:on\w+|href|src)\s*=\s*([\"'])\s*(?:javascript|data|vbscript):.*?\1", ""), (r"<[^>]+>", " "), (r"[^\S\n]+", " "),
        (r" *\n[ \n]*\n *", "\n\n"), (r" *\n *", "\n"),
    ):
        x = F.regexp_replace(x, pattern, to)
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def title_of(html: Column) -> Column:
    """The title element's text with white space collapsed; null without one."""
    found = F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))
    return F.when(found != "", found)


def anchors_of(html: Column) -> Column:
    """array<struct<url,text>> of the links of a page, in order."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<a\s[^>]*href\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"), F.lit(0))
    pattern = r"(?is)<a\s[^>]*href\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"
    return F.transform(found, lambda a: F.struct(F.regexp_extract(a, pattern, 1).alias("url"), F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(a, pattern, 2), "<[^>]+>", " "), r"\s+", " ")).alias("text")))


def phrases(question: Column) -> Column:
    return F.transform(F.regexp_extract_all(nfkc(question), F.lit('"([^"\\n]+)"'), F.lit(1)), F.lower)


def tokens(question: Column) -> Column:
    """Distinct lower-case terms of a question without its phrases and operators: words, then whole identifiers."""
    bare = F.regexp_replace(F.regexp_replace(question, r"(^|\s)-?\w+:[^\s]+", " "), '"[^"\\n]+"', " ")
    bare = nfkc(bare)
    words = F.regexp_extract_all(bare, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    identifiers = F.regexp_extract_all(bare, F.lit(r"[\p{L}\p{N}_./:+#\-]{2,}"), F.lit(0))
    return F.filter(F.array_distinct(F.transform(F.concat(words, identifiers), F.lower)), lambda t: F.length(t) > 1)


def units(question: Column) -> Column:
    """What coverage counts: the terms of a question, then its phrases."""
    return F.concat(tokens(question), phrases(question))


def profile(question: Column, terms: Column | None = None) -> Column:
    said = F.lower(question) if terms is None else F.concat(F.array_join(terms, " "), F.lit(" "), F.lower(question))
    out = None
    for name, words in PROFILES:
        hit = said.rlike(f"{_EDGE}({words}){_NOT_AFTER}")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("general")


def temporal(question: Column, terms: Column, chosen: Column) -> Column:
    dated = question.rlike(rf"(?i){_EDGE}(before|after):\d{{4}}-\d{{2}}-\d{{2}}{_NOT_AFTER}|{_EDGE}(v|version)\d+")
    return (chosen == "news") | F.exists(terms, lambda t: t.isin(*TEMPORAL) | t.rlike(r"^(19|20)\d{2}$")) | dated


def asks_for_current(question: Column) -> Column:
    return question.rlike(CURRENT)


def is_navigation(text: Column) -> Column:
    """Whether a passage is a menu: glued labels, or a list of short lines.  The thresholds are fixed values."""
    joins = F.regexp_count(text, F.lit(r"\p{Ll}\p{Lu}"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    short = F.size(F.filter(lines, lambda x: F.length(F.trim(x)) <= 70))
    return (F.length(text) >= 200) & ((joins / (F.length(text) / 100) >= 2) | ((F.size(lines) >= 8) & (short >= 0.9 * F.size(lines))))


def code_warnings(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(w)) for p, w in INVISIBLE]))


def blocked_reason(engine: str, text: Column) -> Column:
    out = None
    for pattern, reason in (*BLOCKED, *BLOCKED_BY[engine]):
        hit = text.rlike(f"(?iu){pattern}")
        out = F.when(hit, reason) if out is None else out.when(hit, reason)
    return out


def empty_results(text: Column) -> Column:
    """Whether a result page says that it has none; the wording is a fixed value."""
    return text.rlike("(?i)did not match any documents|no results found")


def source_type(text: Column, host: Column, path: Column) -> Column:
    said = F.lower(F.concat(text, F.lit(" "), host, path))
    out = None
    for name, words in SOURCE_TYPES:
        hit = said.rlike(f"{_EDGE}({words}){_NOT_AFTER}")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("organic")


# What a secret looks like, the names that it is given under, and the header lines that carry one.
_SECRET = r"[^\s,;'\"]*(?:[A-Za-z][0-9]|[0-9][A-Za-z]|[\-_./+])[^\s,;'\"]*"
_SECRET_NAMES = "password|passwd|token|secret|api[_-]?key|access[_-]?key|auth[_-]?token"
COOKIE = r"(?i)(cookie|set-cookie)[^\n]*"
CREDENTIAL = rf"(?i)Bearer\s+{_SECRET}|({_SECRET_NAMES})\s*=\s*[^\s,;'\"]+|({_SECRET_NAMES})\s*:\s*{_SECRET}"


def redact(text: Column) -> Column:
    """Without cookies and credentials: a name alone, or prose about one, stays."""
    return F.regexp_replace(F.regexp_replace(text, COOKIE, "[redacted-cookie]"), CREDENTIAL, "[redacted-secret]")


def secret_kinds(text: Column) -> Column:
    """Kinds of credentials that a text holds."""
    kinds = {
        "aws_key": r"(AKIA|ASIA)[0-9A-Z]{16}", "bearer": rf"(?i)bearer\s+{_SECRET}", "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
        "assignment": rf"(?i)({_SECRET_NAMES})\s*[=:]\s*[^\s,;'\"]+", "basic": r"(?i)basic\s+[A-Za-z0-9+/]{16,}={0,2}",
    }
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in kinds.items()]))


def safe_text(value: Column, markup: bool) -> Column:
    x = html_to_text(value) if markup else value
    x = F.regexp_replace(x, r"(?i)</?(?:script|style|form|iframe|object|embed|svg|template)\b[^>]*>", "")
    return F.trim(F.regexp_replace(x, r"(?i)\]\s*\(\s*(?:javascript|data|vbscript):[^)]*\)", "]"))


def let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it (also inside lambdas)."""
    return F.transform(F.array(value), f)[0]


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def shingles(text: Column, k: int = 3) -> Column:
    """Distinct k-word shingles; none for a text of fewer words."""

    def cut(w: Column) -> Column:
        n = F.size(w) - (k - 1)
        runs = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat_ws(" ", *[F.try_element_at(w, i + j) for j in range(k)]))
        return F.when(n > 0, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))

    return let(words(text), cut)


def flattened(text: Column) -> Column:
    """What a passage says, however its source wraps it."""
    x = F.lower(text)
    for pattern, to in ((r"\s+", " "), (r" ([.,;:!?)\]])", "$1"), (r"([(\[]) ", "$1"), (r"\"\s+", '"'), (r"\s+\"", '"')):
        x = F.regexp_replace(x, pattern, to)
    return F.trim(x)


def holds_concepts(text: Column, concepts: Column) -> Column:
    """Whether a text holds every word of every concept, in whatever order and place."""
    low = F.lower(text)
    return F.forall(concepts, lambda c: F.forall(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: F.contains(low, w)))


def lexical_tokens(text: Column) -> Column:
    return F.size(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda x: x != ""))


def utf16_length(text: Column) -> Column:
    return F.length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def slug(heading: Column) -> Column:
    """A heading's fragment; null for numbered headings and for those without a letter."""
    s = F.regexp_replace(F.regexp_replace(F.lower(heading), r"[^\p{L}\p{N}]+", "-"), "^-|-$", "")
    return F.when(~heading.rlike(r"^\s*\d+(\.\d+)*\.?\s") & (s != ""), F.concat(F.lit("#"), s))


def pdf_text(body: Column) -> Column:
    """The literal strings that a plain PDF shows."""
    found = F.regexp_extract_all(F.decode(body, "ISO-8859-1"), F.lit(r"\(([^\\)]*+(?:\\.[^\\)]*+)*+)\)\s*Tj"), F.lit(1))
    return F.array_join(F.transform(found, lambda x: F.regexp_replace(x, r"\\([()\\])", "$1")), "\n")


def mime_of(header: Column, body: Column, url: Column, has_markdown: Column) -> Column:
    """The MIME type by its header, or by the first 512 characters; the marks looked for are fixed values."""
    named = F.lower(F.trim(F.substring_index(header, ";", 1)))
    head = F.regexp_replace(F.substring(body, 1, 512), r"^\s+", "")
    sniffed = (
        F.when(head.startswith("%PDF-"), "application/pdf").when(head.rlike(r"^[\{\[]"), "application/json")
        .when(head.rlike(r"(?i)^<\?xml\b|^<[^>]+xmlns[=:]"), "application/xml").when(head.rlike(r"(?i)^<!doctype html\b|^<html\b"), "text/html")
        .when(url.rlike(r"^[a-z]+://raw\.githubusercontent\.com/|/raw/"), "text/x-source-code").when(has_markdown, "text/markdown").otherwise("text/plain")
    )
    return F.when((named != "") & (named != "application/octet-stream"), named).otherwise(sniffed)


@pandas_udf(StringType())
def _pretty(values: pd.Series) -> pd.Series:
    import json

    def one(x: str | None) -> str | None:
        try:
            return None if x is None else json.dumps(json.loads(x), ensure_ascii=False, indent=2)
        except ValueError:
            return None

    return values.map(one)


def sniffed_text(value: Column) -> Column:
    """Cleaned as markup only if it carries some, whatever its declared type."""
    return F.when(value.rlike(r"(?i)</?[a-z][^>]*>"), safe_text(value, True)).otherwise(safe_text(value, False))


def document_text(mime: Column, url: Column, body: Column, markdown: Column, rendered: Column) -> Column:
    """What a document says, by its type.

    Markup is cleaned, raw code is fenced under its extension, JSON is laid out
    (or cleaned as a text if it is none), anything else is what its rendering
    says.  Only JSON travels to Python.
    """
    some = lambda *xs: F.coalesce(*[F.nullif(x, F.lit("")) for x in xs], F.lit(""))
    last = F.regexp_replace(F.element_at(F.split(F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1), r"\."), -1), "(?i)[^a-z0-9]", "")
    code = F.concat(F.lit("```"), last, F.lit("\n"), some(body, rendered), F.lit("\n```"))
    json = (mime == "application/json") & ~url.rlike(RAW_HOST)
    return (
        F.when(mime == "text/html", sniffed_text(some(markdown, rendered, body))).when(url.rlike(RAW_HOST), code)
        .when(json, F.coalesce(_pretty(F.when(json, some(body, rendered))), sniffed_text(some(body, rendered))))
        .when(mime.isin("application/xml", "text/xml"), safe_text(some(body, rendered), True)).otherwise(sniffed_text(some(markdown, body, rendered)))
    )
