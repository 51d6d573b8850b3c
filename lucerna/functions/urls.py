"""URL columns: parts, canonical forms, sites, policy.  Everything is a ``Column`` built from built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_URL = r"^([A-Za-z][A-Za-z0-9+.\-]*):(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#([\s\S]*))?$"

# Names of tracking parameters.
TRACKERS = r"(?i)^(utm_.+|gclid|dclid|fbclid|igshid|msclkid|ttclid|yclid|mc_[a-z]+)(=.*)?$"
# Suffixes under which each name is a site of its own.
COMPOUND_SUFFIXES = (
    "co.uk", "ac.jp", "ad.jp", "ne.jp", "or.jp", "go.jp", "co.kr", "or.kr", "com.cn", "co.in", "co.za",
    "co.nz", "com.au", "com.br", "co.jp", "github.io", "gitlab.io", "netlify.app", "pages.dev", "readthedocs.io", "vercel.app",
)
# Hosts that carry a subject's material without being its home.
GENERAL_HOSTS = (
    "github.com", "gitlab.com", "stackoverflow.com", "stackexchange.com", "wikipedia.org", "wikimedia.org", "reddit.com",
    "medium.com", "npmjs.com", "deepwiki.com", "youtube.com", "x.com", "twitter.com", "facebook.com", "linkedin.com",
    "quora.com", "blogspot.com", "wordpress.com", "substack.com", "dev.to", "hashnode.dev",
)
# Hosts that serve the same pages under two names, the one that stands for both first.
MIRRORS = {"bun.com": "bun.sh"}
# Hosts of engines and of their own surfaces.
ENGINE_HOSTS = {"google": r"(?i)(^|\.)google\.[a-z.]+$", "duckduckgo": r"(?i)(^|\.)duckduckgo\.com$", "bing": r"(?i)(^|\.)bing\.com$"}
ENGINE_CHROME = (
    r"(?i)(^|\.)(consent|accounts|policies|support|myaccount)\.google\.[a-z.]+$",
    r"(?i)(^|\.)(spreadprivacy\.com|duck\.com)$",
    r"(?i)^(help\.bing|myaccount|account|login|privacy|support|go|www)\.microsoft\.com$",
)
AD_HOSTS = r"(?i)(^|\.)(doubleclick\.net|googlesyndication\.com|googleadservices\.com)$"
METADATA_HOSTS = ("metadata.google.internal", "metadata", "instance-data")
# Scripts and the locale that they ask in, in order.
SCRIPT_LOCALES = (
    (r"[\p{IsHiragana}\p{IsKatakana}]", "ja-JP"), (r"\p{IsHangul}", "ko-KR"), (r"\p{IsHan}", "zh-CN"), (r"\p{IsCyrillic}", "ru-RU"),
    (r"\p{IsArabic}", "ar"), (r"\p{IsHebrew}", "he-IL"), (r"\p{IsGreek}", "el-GR"), (r"\p{IsThai}", "th-TH"), (r"\p{IsDevanagari}", "hi-IN"),
)
_ENGINES = {"google": ("https://www.google.com/search", "hl"), "duckduckgo": ("https://html.duckduckgo.com/html/", "kl"), "bing": ("https://www.bing.com/search", "setlang")}


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _URL, group)


def is_url(url: Column) -> Column:
    return F.coalesce(url.rlike(_URL) & (host(url) != ""), F.lit(False))


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def authority(url: Column) -> Column:
    return _part(url, 2)


def host(url: Column) -> Column:
    """Lower-case host without user, port and trailing dot."""
    bare = F.regexp_replace(F.regexp_replace(authority(url), r"^.*@", ""), r":\d*$", "")
    return F.regexp_replace(F.lower(bare), r"\.$", "")


def port(url: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(authority(url), r"^.*@", ""), r":(\d*)$", 1)


def path(url: Column) -> Column:
    return F.when(_part(url, 3) == "", F.lit("/")).otherwise(_part(url, 3))


def query(url: Column) -> Column:
    return _part(url, 4)


def parameter(url: Column, name: str) -> Column:
    """The decoded value of the first parameter of that name; null without one."""
    found = F.filter(F.split(query(url), "&"), lambda p: p.startswith(name + "="))
    return F.try_url_decode(F.substring_index(F.try_element_at(found, F.lit(1)), "=", -1)) if name == "" else F.try_url_decode(F.regexp_replace(F.try_element_at(found, F.lit(1)), "^[^=]*=", ""))


def strip_trackers(url: Column) -> Column:
    """Without tracking parameters and fragment; the parameters that stay are unchanged."""
    kept = F.array_join(F.filter(F.split(query(url), "&"), lambda p: ~p.rlike(TRACKERS) & (p != "")), "&")
    return F.concat(F.regexp_replace(url, r"[?#][\s\S]*$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))


def _normal_path(p: Column) -> Column:
    """Escapes of unreserved characters decoded, the others in upper case, one trailing slash dropped."""
    pieces = F.split(p, "%")

    def piece(x: Column, i: Column) -> Column:
        code = F.substring(x, 1, 2)
        escape = (i > 0) & code.rlike("^[0-9A-Fa-f]{2}$")
        letter = F.unhex(F.when(escape, code)).cast("string")
        decoded = F.when(letter.rlike(r"^[A-Za-z0-9\-._~]$"), letter).otherwise(F.concat(F.lit("%"), F.upper(code)))
        return F.when(escape, F.concat(decoded, F.substring(x, 3, 1 << 20))).when(i > 0, F.concat(F.lit("%"), x)).otherwise(x)

    out = F.array_join(F.transform(pieces, piece), "")
    return F.when(F.length(out) > 1, F.regexp_replace(out, "/$", "")).otherwise(out)


def canonical(url: Column) -> Column:
    """The cache key of a URL: U1, lower scheme and host, default port dropped, path escapes settled."""
    clean = strip_trackers(url)
    p = port(clean)
    default = ((scheme(clean) == "http") & (p == "80")) | ((scheme(clean) == "https") & (p == "443")) | (p == "")
    tail = F.when(query(clean) != "", F.concat(F.lit("?"), query(clean))).otherwise(F.lit(""))
    out = F.concat(scheme(clean), F.lit("://"), host(clean), F.when(default, F.lit("")).otherwise(F.concat(F.lit(":"), p)), _normal_path(path(clean)), tail)
    return F.when(is_url(url), out)


def site(h: Column) -> Column:
    """The registrable name of a host: its last two labels, three under a compound suffix."""
    labels = F.split(F.regexp_replace(F.lower(h), r"^www\.", ""), r"\.")
    n = F.size(labels)
    last = lambda k: F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), k), ".")
    return F.when(n <= 2, F.array_join(labels, ".")).when(last(2).isin(*COMPOUND_SUFFIXES), last(3)).otherwise(last(2))


def is_general_host(h: Column) -> Column:
    return F.exists(F.array(*map(F.lit, GENERAL_HOSTS)), lambda g: (F.lower(h) == g) | F.endswith(F.lower(h), F.concat(F.lit("."), g)))


def _v4(a: Column) -> tuple[Column, Column, Column]:
    parts = F.transform(F.split(a, r"\."), lambda x: x.try_cast("int"))
    sound = (F.size(parts) == 4) & ~F.exists(parts, lambda x: x.isNull() | (x > 255))
    return parts[0], parts[1], F.coalesce(sound, F.lit(False))


def forbidden_address(a: Column) -> Column:
    """Whether an IPv4 or IPv6 address isn't public (dotted or hexadecimal v4-mapped ones included)."""
    mapped = F.regexp_extract(F.lower(a), r"(?:^|:)ffff:([0-9a-f]{1,4}):([0-9a-f]{1,4})\]?$", 1)
    low = F.regexp_extract(F.lower(a), r"(?:^|:)ffff:([0-9a-f]{1,4}):([0-9a-f]{1,4})\]?$", 2)
    octet = lambda x, shift: F.shiftright(F.conv(x, 16, 10).cast("int"), shift).bitwiseAND(F.lit(255)).cast("string")
    dotted = F.when(mapped != "", F.concat_ws(".", octet(mapped, 8), octet(mapped, 0), octet(low, 8), octet(low, 0)))
    bare = F.regexp_replace(F.lower(a), r"^\[|\]$", "")
    plain = F.when(~a.contains(":"), F.when(a.rlike(r"^\d+(\.\d+){3}$"), a)).when(bare.rlike(r"^(0*:){0,6}ffff:\d+\.\d+\.\d+\.\d+$"), F.substring_index(bare, ":", -1)).otherwise(dotted)
    one, two, sound = _v4(plain)
    v4 = (
        ~sound | one.isin(0, 10, 127) | (one >= 224) | ((one == 100) & two.between(64, 127)) | ((one == 169) & (two == 254))
        | ((one == 172) & two.between(16, 31)) | ((one == 192) & two.isin(0, 168)) | ((one == 198) & two.isin(18, 19, 51)) | ((one == 203) & (two == 0))
    )
    v6 = bare.isin("::", "::1") | bare.rlike("^(fe80:|fc|fd|ff)")
    return F.coalesce(F.when(a.contains(":") & v6, F.lit(True)).when(plain.isNotNull(), v4).when(a.contains(":"), ~bare.rlike("^[0-9a-f:]+$")), F.lit(False))


def policy_reason(url: Column) -> Column:
    """Why a URL isn't public, the first reason that holds; null if it is."""
    h, p = host(url), port(url)
    local = (h == "localhost") | F.endswith(h, F.lit(".localhost")) | F.endswith(h, F.lit(".local")) | h.isin(*METADATA_HOSTS)
    bad_port = (p != "") & ~F.coalesce(p.try_cast("int").between(1, 65535), F.lit(False))
    return (
        F.when(~scheme(url).isin("http", "https"), "non_http_scheme")
        .when(authority(url).contains("@"), "embedded_credentials")
        .when(bad_port, "invalid_port")
        .when(local, "local_hostname")
        .when(forbidden_address(h), "non_public_address")
    )


def answers_reason(first: Column, second: Column) -> Column:
    """DNS answers of two look-ups: forbidden, empty or not the same set."""
    bad = lambda x: F.coalesce(F.size(x) <= 0, F.lit(True)) | F.exists(x, forbidden_address)
    return F.when(bad(first) | bad(second), "non_public_address").when(F.array_sort(F.array_distinct(first)) != F.array_sort(F.array_distinct(second)), "rebinding")


def owns_host(engine: str, h: Column) -> Column:
    return h.rlike(ENGINE_HOSTS[engine])


def engine_chrome(h: Column) -> Column:
    return h.rlike(ENGINE_CHROME[0]) | h.rlike(ENGINE_CHROME[1]) | h.rlike(ENGINE_CHROME[2])


def dereference(engine: str, url: Column) -> Column:
    """Where an engine's redirect link leads; the link itself elsewhere; null without a destination."""
    if engine == "google":
        to = F.when(path(url).rlike("^/(url|imgres)$"), F.coalesce(parameter(url, "q"), parameter(url, "url")))
    elif engine == "duckduckgo":
        to = F.when(path(url) == "/l/", parameter(url, "uddg"))
    else:
        raw = F.regexp_extract(parameter(url, "u"), "^a1(.*)$", 1)
        text = F.try_to_binary(F.rpad(F.translate(raw, "-_", "+/"), (F.ceil(F.length(raw) / 4) * 4).cast("int"), F.lit("=")), F.lit("base64")).cast("string")
        to = F.when((path(url) == "/ck/a") & text.startswith("http"), text)
    return F.when(owns_host(engine, host(url)), F.when(is_url(to), to)).otherwise(url)


def locale_of(question: Column) -> Column:
    """The locale that a question's script asks in; en-US by default."""
    out = None
    for pattern, locale in SCRIPT_LOCALES:
        out = F.when(question.rlike(pattern), locale) if out is None else out.when(question.rlike(pattern), locale)
    return out.otherwise("en-US")


def search_url(engine: str, question: Column, locale: Column | None = None) -> Column:
    base, name = _ENGINES[engine]
    asked = locale_of(question) if locale is None else F.when(locale.isNull() | (locale == "auto") | (locale == ""), locale_of(question)).otherwise(locale)
    return F.concat(F.lit(f"{base}?q="), F.url_encode(question), F.lit(f"&{name}="), asked)


def page_identity(url: Column) -> Column:
    """What page a URL names: no fragment, lower host, mirrors folded, no trailing slash."""
    h = F.regexp_replace(host(url), r"^www\.", "")
    for other, own in MIRRORS.items():
        h = F.when(h == own, F.lit(other)).otherwise(h)
    p = path(url)
    p = F.when(F.length(p) > 1, F.regexp_replace(p, "/$", "")).otherwise(p)
    tail = F.when(query(url) != "", F.concat(F.lit("?"), query(url))).otherwise(F.lit(""))
    return F.when(is_url(url), F.concat(scheme(url), F.lit("://"), h, F.when(port(url) != "", F.concat(F.lit(":"), port(url))).otherwise(F.lit("")), p, tail)).otherwise(url)


def dated_version(url: Column) -> Column:
    found = F.regexp_extract(path(url), r"/((?:19|20)\d{2}-\d{2}-\d{2})(?:/|$)", 1)
    return F.when(found != "", found)


def safe_link(url: Column) -> Column:
    """The link without trackers; null for other schemes and for ad hosts."""
    return F.when(scheme(url).isin("http", "https") & ~host(url).rlike(AD_HOSTS), strip_trackers(url))


def log_safe(url: Column) -> Column:
    return F.regexp_replace(url, r"[?#][\s\S]*$", "")


def canonical_link(header: Column) -> Column:
    """The address that a Link header gives the relation canonical; null without one."""
    links = F.split(F.coalesce(header, F.lit("")), r",\s*(?=<)")
    own = F.filter(links, lambda x: x.rlike(r"(?i);\s*rel\s*=\s*\"?([^\"]*\s)?canonical(\s[^\"]*)?\"?\s*(;|$)"))
    return F.nullif(F.regexp_extract(F.try_element_at(own, F.lit(1)), r"^\s*<([^>]*)>", 1), F.lit(""))
