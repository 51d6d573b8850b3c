"""Result pages of search engines: parsing, admission, chaining, follow-up questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lucerna.functions import texts, urls
from lucerna.session import saved

# Words of a question that name no subject.
QUESTION_WORDS = tuple(
    "a about according an and any apply are as at be browser but by can current currently describe do does during explain for from how in including into is it its of on or over require requires several should sources that the their them then there these they this to under use used using what when where which who why will with within would".split()
)
GENERIC_WORDS = tuple(
    "api build case content data detail details document documentation example examples feature file general generic guide information official page primary reference source text type value version way 情報 公式 一次 仕様 文書 資料 内容 詳細 例 参考 説明 정보 공식 문서 자료".split()
)
FRAGMENTS = tuple("って して され れる する ある など よう どの ため こと もの くだ さい 日本語 한국어 中文".split())
STRUCTURAL = tuple("api blog doc docs documentation en guide guides html index latest learn main manual page pages reference site web www".split())
# Parts of an address that ask for a login; how many terms a follow-up keeps, and which questions are short.
AUTH = r"(?i)(?:^|[./_-])(login|signin|sign-in|auth|account)(?:[./_-]|$)"
TERMS, SHORT = 4, 60


def admitted(engine: str, url: Column, original: Column, text: Column) -> Column:
    h = urls.host(url)
    ad = urls.path(original).contains("aclk") | urls.query(original).rlike("(^|&)adurl=")
    spoken = (F.trim(text) != "") & ~text.rlike(r"(?i)(?<![A-Za-z0-9_])(ad|sponsored)(?![A-Za-z0-9_])")
    return urls.policy_reason(url).isNull() & ~urls.owns_host(engine, h) & ~urls.engine_chrome(h) & ~ad & spoken & ~F.concat(h, urls.path(url)).rlike(AUTH)


def candidates(serps: DataFrame, engine: str) -> DataFrame:
    """(serp_id, pos, url, source_type, title): admitted links of result pages (serp_id, text, links), first of each URL."""
    found = serps.select("serp_id", F.posexplode("links").alias("pos", "l")).select("serp_id", "pos", F.col("l.url").alias("original"), F.col("l.text").alias("said"))
    found = found.withColumn("url", urls.dereference(engine, F.col("original"))).where(F.col("url").isNotNull())
    found = found.where(admitted(engine, F.col("url"), F.col("original"), F.col("said")))
    w = Window.partitionBy("serp_id", "url").orderBy("pos")
    found = found.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    kind = texts.source_type(F.col("said"), urls.host(F.col("url")), urls.path(F.col("url")))
    return found.select("serp_id", "pos", "url", kind.alias("source_type"), F.trim(F.regexp_replace("said", r"\s+", " ")).alias("title"))


def suggestions(serps: DataFrame, limit: int = 8) -> DataFrame:
    """(serp_id, rank, query, source): related questions of a page, without repeats whatever the case."""
    found = serps.select("serp_id", F.posexplode("links").alias("pos", "l"))
    link, said = F.col("l.url"), F.trim(F.regexp_replace(F.col("l.text"), r"\s+", " "))
    source = F.when(said.rlike("(?i)people also ask"), "google_question").when(said.rlike("(?i)related"), "google_related")
    found = found.where(urls.owns_host("google", urls.host(link)) & (urls.path(link) == "/search") & urls.query(link).rlike("(^|&)q=") & source.isNotNull())
    found = found.select("serp_id", "pos", said.alias("query"), source.alias("source"))
    w = Window.partitionBy("serp_id", F.lower("query")).orderBy("pos")
    found = found.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    w = Window.partitionBy("serp_id").orderBy("pos")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("serp_id", "rank", "query", "source")


def serp_status(serps: DataFrame, engine: str) -> DataFrame:
    """(serp_id, status, reason, n_candidates)."""
    n = candidates(serps, engine).groupBy("serp_id").agg(F.count("*").alias("n"))
    x = serps.select("serp_id", "text").join(n, "serp_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    blocked = texts.blocked_reason(engine, F.col("text"))
    s = F.when(blocked.isNotNull(), "blocked").when(F.col("n") > 0, "parsed").when(texts.empty_results(F.col("text")), "empty").otherwise("parse_failure")
    reason = F.coalesce(blocked, F.when(s == "parse_failure", "unrecognized_serp_markup"))
    return x.select("serp_id", s.alias("status"), reason.alias("reason"), F.when(blocked.isNull(), F.col("n")).otherwise(0).alias("n_candidates"))


def first_answer(outcomes: DataFrame) -> DataFrame:
    """(question, engine, status): the first engine in order that neither blocks nor fails, else the last one asked."""
    usable = ~F.col("status").isin("blocked", "error")
    best = F.coalesce(F.min_by(F.struct("engine", "status"), F.when(usable, F.col("engine_order"))), F.max_by(F.struct("engine", "status"), F.col("engine_order")))
    return outcomes.groupBy("question").agg(best.alias("b")).select("question", "b.engine", "b.status")


def widened(first: DataFrame, later: DataFrame, limit: int = 14) -> DataFrame:
    """First-seen union of candidate lists (question, src, pos, url), capped per question."""
    every = first.unionByName(later)
    w = Window.partitionBy("question", "url").orderBy("src", "pos")
    every = every.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    w = Window.partitionBy("question").orderBy("src", "pos")
    return every.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).drop("_n")


def cooled(events: DataFrame, engine: str, ts: str, blocked: str, seconds: int) -> DataFrame:
    """Rows with ``suppressed``: whether an earlier block of the engine is less than ``seconds`` ago."""
    w = Window.partitionBy(engine).orderBy(ts).rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col(blocked), F.col(ts))).over(w)
    return events.withColumn("suppressed", F.coalesce(F.unix_micros(F.col(ts)) - F.unix_micros(last) < seconds * 1_000_000, F.lit(False)))


def follow_up(question: Column) -> Column:
    """A question's distinctive terms, at most four, with its phrases and operators; null if it is short or nothing is gained."""
    kept = F.transform(F.regexp_extract_all(question, F.lit('"[^"\\n]+"|(?:^|\\s)-?\\w+:[^\\s]+'), F.lit(0)), F.trim)
    rest = F.regexp_replace(F.regexp_replace(question, '"[^"\\n]+"', " "), r"(?:^|\s)-?\w+:[^\s]+", " ")
    whole = F.reverse(F.array_distinct(F.regexp_extract_all(rest, F.lit(r"[\p{L}\p{N}][\p{L}\p{N}_.:+#\-]*[./][\p{L}\p{N}_.:+#\-]+"), F.lit(0))))
    words = F.array_distinct(F.concat(whole, F.regexp_extract_all(rest, F.lit(r"[\p{L}\p{N}_']+"), F.lit(0))))
    naming = F.filter(words, lambda w: (F.length(w) >= 2) & ~F.lower(w).isin(*QUESTION_WORDS))
    lower = lambda x: F.transform(x, F.lower)
    once = texts.let(naming, lambda x: texts.let(lower(x), lambda low: F.filter(x, lambda w, i: F.array_position(low, F.lower(w)) == i + 1)))

    def pick(x: Column) -> Column:
        terms, said = x["terms"], x["kept"]
        subject = F.filter(terms, lambda w: ~F.lower(w).isin(*GENERIC_WORDS) & ~w.isin(*FRAGMENTS))
        want = F.greatest(F.lit(TERMS) - F.size(said), F.lit(0))
        return texts.let(F.slice(F.when(F.size(subject) > 0, subject).otherwise(terms), F.lit(1), want), lambda c: F.trim(F.array_join(F.concat(said, F.filter(terms, lambda w: F.array_contains(c, w))), " ")))

    out = texts.let(F.struct(once.alias("terms"), kept.alias("kept")), pick)
    return F.when(F.length(question) > SHORT, texts.let(out, lambda o: F.when((o != "") & (F.length(o) < F.length(question)), o)))


def dominant_site(found: DataFrame, group: str, host: str, order: str) -> DataFrame:
    """(group, site, n): the site that most of a group's hosts share, first seen on ties; only if more than one page agrees."""
    own = found.where(~urls.is_general_host(F.col(host))).withColumn("site", urls.site(F.col(host)))
    counts = own.groupBy(group, "site").agg(F.count("*").alias("n"), F.min(order).alias("first"))
    w = Window.partitionBy(group).orderBy(F.desc("n"), "first")
    return counts.withColumn("_n", F.row_number().over(w)).where("_n = 1 AND n > 1").select(group, "site", "n")


# Results below which a question is asked again in a few words; candidates up to which later engines add theirs.
THIN, WIDENED = 6, 14
#: A release date in a title, anywhere.
_DATE = r"(?:19|20)\d{2}-\d{2}-\d{2}"


def scoped_question(questions: DataFrame, found: DataFrame) -> DataFrame:
    """(question, scoped): the question asked of its dominant site, unless it is scoped, too short or already answered there.

    ``found`` is (question, pos, url) and may have ``title``; ``questions`` may have
    ``asked``, what is to be asked in the question's place.  A question for what is
    current names the newest dated version that the site's pages, or any title, show.
    """
    x = found.withColumn("host", urls.host(F.col("url")))
    top = dominant_site(x, "question", "host", "pos").select("question", F.col("site").alias("top"))
    said = F.array_max(F.regexp_extract_all("title", F.lit(f"({_DATE})"), F.lit(1))) if "title" in found.columns else F.lit(None).cast("string")
    titled = x.groupBy("question").agg(F.max(said).alias("said"))
    reached = x.join(top, "question").where(urls.site(F.col("host")) == F.col("top"))
    seen = reached.groupBy("question", "top").agg(F.collect_set(F.lower(urls.path(F.col("url")))).alias("paths"), F.max(urls.dated_version(F.col("url"))).alias("newest")).join(titled, "question")
    own = questions.select("question", F.col("asked") if "asked" in questions.columns else F.col("question").alias("asked")).join(seen, "question")
    q = F.col("asked")
    version = F.when(texts.asks_for_current(F.col("question")), F.greatest("newest", "said"))
    paths = F.when(version.isNotNull(), F.filter("paths", lambda p: F.contains(p, version))).otherwise(F.col("paths"))
    terms = F.filter(F.array_distinct(F.regexp_extract_all(F.lower(q), F.lit(r"[\p{L}\p{N}]{3,}"), F.lit(0))), lambda t: ~t.isin(*STRUCTURAL))
    arrived = F.exists(terms, lambda t: ~F.contains(F.col("top"), t) & F.exists(paths, lambda p: F.contains(p, t)) & ~F.forall(paths, lambda p: F.contains(p, t)))
    enough = F.size(F.flatten(F.sentences(q))) >= 3
    out = F.concat_ws(" ", F.concat(F.lit("site:"), F.col("top")), version, q)
    return own.where(~q.rlike(r"(?i)(^|\s)-?site:") & enough & ~arrived).select("question", out.alias("scoped"))


def walked(asked: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first engine that neither blocks nor fails, for each (asked): its answer (asked, engine, engine_order, status) and its candidates (asked, pos, url, title).

    ``answers``: asked, engine, engine_order, status, candidates
    array<struct<url,title>> in order; an engine without a row wasn't reached.
    """
    own = answers.join(asked.select("asked").distinct(), "asked", "left_semi")
    usable = ~F.col("status").isin("blocked", "error")
    row = F.struct("engine", "engine_order", "status", "candidates")
    best = own.groupBy("asked").agg(F.coalesce(F.min_by(row, F.when(usable, F.col("engine_order"))), F.max_by(row, F.col("engine_order"))).alias("b")).select("asked", "b.*")
    best = saved(best, "walked")
    listed = best.where("status = 'success'").select("asked", F.posexplode("candidates").alias("pos", "c")).select("asked", "pos", F.col("c.url").alias("url"), F.col("c.title").alias("title"))
    return best.select("asked", "engine", "engine_order", "status"), listed


def _joined(lists: list[DataFrame]) -> DataFrame:
    """(question, pos, url, title): lists one after the other, each address at its first place."""
    every = None
    for k, rows in enumerate(lists):
        part = rows.select("question", F.lit(k).alias("part"), "pos", "url", "title")
        every = part if every is None else every.unionByName(part)
    first = every.groupBy("question", "url").agg(F.min(F.struct("part", "pos", "title")).alias("f")).select("question", "url", "f.*")
    place = F.row_number().over(Window.partitionBy("question").orderBy("part", "pos"))
    return first.select("question", place.alias("pos"), "url", "title")


def chained(questions: DataFrame, answers: DataFrame | Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Discovery as one plan: engines in turn, later ones to widen, a few words where results are thin, the dominant site last.

    ``questions``: question (the text, unique); ``answers`` as ``walked`` takes them,
    of the questions and of what is derived from them, or a function that gives the
    answers to what is asked (asked, distinct), so that nothing else is.  Returns (question, engine,
    status, follow_up) and the candidates (question, pos, url, title).  A question's
    lists are a search's, so they stay small.
    """
    asked = saved(questions.select(F.col("question").alias("asked")).where("asked IS NOT NULL").distinct(), "asked")
    ask = answers if callable(answers) else lambda rows: answers.join(rows, "asked", "left_semi")
    got = saved(ask(asked), "answers")
    first, own = walked(asked, got)
    own = own.withColumnRenamed("asked", "question")
    # later engines add what is new, up to a ceiling that the first list may exceed
    answering = first.where("status = 'success'").select("asked", F.col("engine_order").alias("_at"))
    later = got.where("status = 'success'").join(answering, "asked").where("engine_order > _at").select(F.col("asked").alias("question"), "engine_order", F.posexplode("candidates").alias("k", "c"))
    later = later.groupBy("question", F.col("c.url").alias("url")).agg(F.min(F.struct("engine_order", "k", F.col("c.title").alias("title"))).alias("f"))
    later = later.join(own.select("question", "url"), ["question", "url"], "left_anti").select("question", "url", "f.title", F.row_number().over(Window.partitionBy("question").orderBy("f.engine_order", "f.k")).alias("pos"))
    held = own.groupBy("question").agg(F.countDistinct("url").alias("n"))
    room = later.join(held, "question", "left").where(F.col("pos") <= WIDENED - F.coalesce("n", F.lit(0))).select("question", "pos", "url", "title")
    wide = saved(_joined([own, room]), "widened")

    good = first.where("status = 'success'").select(F.col("asked").alias("question"))
    thin = good.join(wide.groupBy("question").agg(F.count("*").alias("n")), "question", "left").where(F.coalesce("n", F.lit(0)) < THIN).select("question", follow_up(F.col("question")).alias("asked")).where("asked IS NOT NULL")
    thin = saved(thin, "thin")
    second, more = walked(thin, ask(thin.select("asked").distinct()))
    spent = thin.join(second.where("status = 'success'").select("asked"), "asked")
    wide = saved(_joined([wide, more.join(thin, "asked").select("question", "pos", "url", "title")]), "followed")

    again = good.join(spent.withColumnRenamed("asked", "spent"), "question", "left").select("question", F.coalesce("spent", follow_up(F.col("question")), "question").alias("asked"), "spent")
    scoped = saved(scoped_question(again, wide).select("question", F.col("scoped").alias("asked")), "scoped")
    _, deep = walked(scoped, ask(scoped.select("asked").distinct()))
    deep = deep.join(scoped, "asked").select("question", "asked", "pos", "url", "title").join(wide.select("question", "url"), ["question", "url"], "left_anti")
    # what the site adds leads, in turns with what was there
    turn = lambda order: F.row_number().over(Window.partitionBy("question").orderBy(order))
    both = deep.select("question", turn("pos").alias("turn"), F.lit(0).alias("side"), "url", "title").unionByName(wide.select("question", F.col("pos").alias("turn"), F.lit(1).alias("side"), "url", "title"))
    found = both.select("question", F.row_number().over(Window.partitionBy("question").orderBy("turn", "side")).alias("pos"), "url", "title")
    used = deep.groupBy("question").agg(F.first("asked").alias("scoped"))
    told = first.select(F.col("asked").alias("question"), "engine", "status").join(spent.withColumnRenamed("asked", "spent"), "question", "left").join(used, "question", "left")
    return told.select("question", "engine", "status", F.coalesce("scoped", "spent").alias("follow_up")), found
