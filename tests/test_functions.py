from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lucerna.functions import scoring, texts, urls


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTPS://Ex.com:443/a/b/?utm_source=x&id=1#f", "https://ex.com/a/b?id=1"), ("http://ex.com./%7euser/%2f", "http://ex.com/~user/%2F"), ("https://ex.com", "https://ex.com/"),
        ("https://ex.com/?gclid=1", "https://ex.com/"), ("https://ex.com:8443/x", "https://ex.com:8443/x"), ("not a url", None),
    ],
)
def test_canonical(spark, url, want):
    assert one(spark, urls.canonical(F.lit(url))) == want


@pytest.mark.parametrize(
    ("address", "bad"),
    [
        ("8.8.8.8", False), ("127.0.0.1", True), ("10.0.0.1", True), ("172.15.0.1", False), ("172.16.0.1", True), ("198.20.0.1", False), ("::1", True), ("[fe80::1]", True),
        ("2606:4700::1111", False), ("::ffff:127.0.0.1", True), ("::ffff:7f00:1", True), ("::ffff:8.8.8.8", False), ("300.1.1.1", True), ("example.org", False),
    ],
)
def test_addresses(spark, address, bad):
    assert one(spark, urls.forbidden_address(F.lit(address))) is bad


def test_redirects_and_sites(spark):
    assert one(spark, urls.dereference("google", F.lit("https://www.google.com/url?q=https%3A%2F%2Fa.org%2Fx&sa=U"))) == "https://a.org/x"
    assert one(spark, urls.dereference("duckduckgo", F.lit("https://duckduckgo.com/l/?uddg=https%3A%2F%2Fa.org%2F"))) == "https://a.org/"
    assert one(spark, urls.dereference("bing", F.lit("https://www.bing.com/ck/a?u=a1aHR0cHM6Ly9hLm9yZy94&n=1"))) == "https://a.org/x"
    assert one(spark, urls.dereference("bing", F.lit("https://www.bing.com/ck/a?u=a1L2ltYWdlcw"))) is None
    assert one(spark, urls.dereference("google", F.lit("https://b.org/"))) == "https://b.org/"
    for host, want in (("www.a.b.com", "b.com"), ("docs.x.co.uk", "x.co.uk"), ("x.github.io", "x.github.io"), ("a.x.github.io", "x.github.io")):
        assert one(spark, urls.site(F.lit(host))) == want
    assert one(spark, urls.page_identity(F.lit("https://www.BUN.com/docs/#a"))) == "https://bun.com/docs"
    assert one(spark, urls.page_identity(F.lit("https://bun.sh/docs"))) == "https://bun.com/docs"
    assert one(spark, urls.locale_of(F.lit("これは何ですか"))) == "ja-JP" and one(spark, urls.locale_of(F.lit("what"))) == "en-US"


def test_questions(spark):
    q = F.lit('latest "Exact Phrase" site:x.org API_v2 error in tools/list')
    assert one(spark, texts.phrases(q)) == ["exact phrase"]
    assert one(spark, texts.tokens(q)) == ["latest", "api_v2", "error", "in", "tools", "list", "tools/list"]
    assert one(spark, texts.profile(q)) == "technical"
    assert one(spark, texts.temporal(q, texts.tokens(q), F.lit("general"))) is True
    assert one(spark, texts.temporal(F.lit("plain"), F.array(F.lit("plain")), F.lit("general"))) is False


def test_markup(spark):
    page = "<title>A &amp; B</title><p>Hi <b>there</b><script>var x='</p>'</script><div style=\"display&#58;none\">gone</div><span aria-hidden='false'>kept</span>\n\n\n<p>end"
    got = one(spark, texts.html_to_text(F.lit(page)))
    assert "gone" not in got and "var x" not in got and "kept" in got and got.endswith("\n\nend")
    assert one(spark, texts.nfkc(F.lit("ﬁn①"))) == "fin1"
    assert one(spark, texts.utf16_length(F.lit("a😀"))) == 3
    assert one(spark, texts.slug(F.lit("Hello, World!"))) == "#hello-world" and one(spark, texts.slug(F.lit("4.4. URL parsing"))) is None


@pytest.mark.parametrize(
    ("value", "want"),
    [("how does bearer token authentication work", "how does bearer token authentication work"), ("token: aGVsbG8x", "[redacted-secret]"), ("api_key=abc", "[redacted-secret]"), ("Cookie: a=b", "[redacted-cookie]"), ("Bearer abc123", "[redacted-secret]")],
)
def test_redaction(spark, value, want):
    assert one(spark, texts.redact(F.lit(value))) == want


def test_scores(spark):
    assert one(spark, scoring.coverage(F.array(F.lit("a"), F.lit("zz")), F.lit("xxa"))) == 0.5
    assert one(spark, scoring.quality(F.lit("x" * 800), F.lit(4), F.lit(3), F.lit(0.0))) == 1.0
    assert one(spark, scoring.prerank(F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(0.15))) == 1.0
    assert one(spark, scoring.round3(F.lit(0.0005))) == 0.001
    assert one(spark, scoring.freshness(F.lit(None).cast("timestamp"), F.lit(True), F.current_timestamp())) == 0.5
    assert [one(spark, scoring.confidence(F.lit(x))) for x in (0.7, 0.4, 0.1)] == ["high", "medium", "low"]
