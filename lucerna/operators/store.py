"""The evidence cache and investigations as tables: upsert, freshness, eviction, at-most-once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lucerna.functions import urls
from lucerna.operators import extraction
from lucerna.session import saved


@dataclass(frozen=True)
class Ttl:
    news: int = 900
    general: int = 86_400
    docs: int = 604_800
    versioned: int = 2_592_000


def expiry(fetched: Column, cache_control: Column, content_class: Column, ttl: Ttl = Ttl()) -> Column:
    """When an entry expires: its own directive first, else its class."""
    age = F.regexp_extract(F.lower(cache_control), r"max-age=(\d+)", 1)
    own = F.when(cache_control.rlike("(?i)no-cache"), fetched).when(age != "", F.timestamp_seconds(F.unix_micros(fetched) / 1e6 + age.try_cast("long")))
    seconds = F.when(content_class == "news", ttl.news).when(content_class == "docs", ttl.docs).when(content_class == "versioned", ttl.versioned).otherwise(ttl.general)
    return F.coalesce(own, F.timestamp_seconds(F.unix_micros(fetched) / 1e6 + seconds))


def is_fresh(fetched: Column, cache_control: Column, content_class: Column, now: Column, ttl: Ttl = Ttl()) -> Column:
    return expiry(fetched, cache_control, content_class, ttl) > now


def refuses_storage(cache_control: Column) -> Column:
    return F.coalesce(cache_control.rlike("(?i)no-store"), F.lit(False))


def upsert(entries: DataFrame, puts: DataFrame, key: str, at: str, cache_control: str) -> DataFrame:
    """Entries after the puts: the latest of each key; what must not be stored isn't."""
    every = entries.unionByName(puts.where(~refuses_storage(F.col(cache_control))))
    # an aggregate, not a window: versions of a hot key are reduced before they are shuffled
    latest = every.groupBy(key).agg(F.max_by(F.struct(*every.columns), at).alias("_e"))
    return latest.select(*[F.col(f"_e.{c}").alias(c) for c in every.columns])


def lookup(entries: DataFrame, aliases: DataFrame, wanted: DataFrame) -> DataFrame:
    """Entries by canonical URL or by alias: two equi-joins instead of one disjunction; (asked, entry columns)."""
    direct = wanted.join(entries, F.col("asked") == F.col("canonical_url")).select("asked", *entries.columns)
    through = wanted.join(aliases, F.col("asked") == F.col("alias")).select("asked", F.col("canonical_url").alias("_c"))
    through = through.join(entries, F.col("_c") == F.col("canonical_url")).select("asked", *entries.columns)
    return direct.unionByName(through).distinct()


def lookup_fresh(entries: DataFrame, aliases: DataFrame, wanted: DataFrame, now: Column, ttl: Ttl = Ttl()) -> DataFrame:
    """The entries that are found, each with ``fresh`` and its last access moved to now.

    Entries have fetched, cache_control, content_class and last_accessed.
    """
    found = lookup(entries, aliases, wanted)
    return found.withColumn("fresh", is_fresh(F.col("fetched"), F.col("cache_control"), F.col("content_class"), now, ttl)).withColumn("last_accessed", F.greatest("last_accessed", now))


def evictions(entries: DataFrame, size: str, order: list, pinned: str, limit: int) -> DataFrame:
    """Entries to remove, first by order, until the total fits: prefix sums over ranges, no single task.

    The total before an entry is the sum of the earlier ranges plus the sum
    within its own range; ranges come from a range partitioning by the order.
    """
    total = entries.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    free = entries.where(~F.col(pinned))
    ranged = saved(free.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy("_p").agg(F.sum(size).alias("_s"))
    before = sums.select("_p", F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    w = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    run = ranged.withColumn("_r", F.coalesce(F.sum(size).over(w), F.lit(0))).join(before, "_p")
    return run.withColumn("freed_before", F.col("_r") + F.col("_b")).where(F.lit(total) - F.col("freed_before") > limit).drop("_p", "_r", "_b")


def orphans(blobs: DataFrame, entries: DataFrame, digest: str = "digest") -> DataFrame:
    return blobs.join(entries, digest, "left_anti")


def sound_blobs(blobs: DataFrame) -> Column:
    return (F.sha2("content", 256) == F.col("digest")) & (F.octet_length("content") == F.col("byte_length"))


def reserve(calls: DataFrame, consumed: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Calls that may emit: the first of each key that wasn't consumed before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return calls.join(consumed.select(*keys).distinct(), keys, "left_anti").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def quota(attempts: DataFrame, search: str, host: str, rank: str, ok: str, wanted: int) -> DataFrame:
    """Best-first fill: a host closes after two failures ahead; the first ``wanted`` successes of open hosts stay."""
    ahead = Window.partitionBy(search, host).orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)
    failed = F.coalesce(F.sum((~F.col(ok)).cast("int")).over(ahead), F.lit(0))
    open_ = attempts.withColumn("_f", failed).where("_f < 2").where(F.col(ok)).drop("_f")
    w = Window.partitionBy(search).orderBy(rank)
    return open_.withColumn("place", F.row_number().over(w)).where(F.col("place") <= wanted)


def status(n: Column, wanted: Column, any_fair: Column) -> tuple[Column, Column]:
    """(status, confidence) of an answer with n results, whether some score is 0.4 or more."""
    s = F.when(n == 0, "no_relevant_results").when(n < wanted, "partial").otherwise("success")
    return s, F.when(s == "success", "high").when(any_fair, "medium").otherwise("low")


def interleave(first: DataFrame, second: DataFrame, group: str, order: list, key: str, second_order: list | None = None) -> DataFrame:
    """Two ranked lists in turns, the first leading; a key keeps its first place.  A group is one search's lists, so it stays small."""
    turn = lambda o: F.row_number().over(Window.partitionBy(group).orderBy(*o))
    both = first.withColumn("turn", turn(order)).withColumn("side", F.lit(0)).unionByName(second.withColumn("turn", turn(second_order or order)).withColumn("side", F.lit(1)))
    w = Window.partitionBy(group, key).orderBy("turn", "side")
    both = both.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    w = Window.partitionBy(group).orderBy("turn", "side")
    return both.withColumn("place", F.row_number().over(w)).drop("_n", "turn", "side")


def redirects(start: DataFrame, edges: DataFrame, hops: int = 5) -> DataFrame:
    """(url, final): where each URL leads in at most ``hops`` steps; null if it leads further."""
    at = start.select("url", F.col("url").alias("final"))
    step = edges.select(F.col("from_url").alias("_f"), F.col("to_url").alias("_t"))
    for _ in range(hops):
        at = at.join(step, at.final == step._f, "left").select("url", F.coalesce("_t", "final").alias("final"))
    more = step.select(F.col("_f").alias("final"), F.lit(True).alias("more")).distinct()
    return at.join(more, "final", "left").select("url", F.when(F.col("more").isNull(), F.col("final")).alias("final"))


def followed(start: DataFrame, answers: DataFrame, robots: DataFrame, resolved: DataFrame, agent: str = "lucerna", hops: int = 5) -> DataFrame:
    """(id, url, n_redirects, reason, robots_ignored): where each request ends, every hop checked before it is made.

    ``start``: id, url, access (``explicit`` goes on against robots rules and says
    so); ``answers``: url, status, location; ``robots``: host, status, body;
    ``resolved``: host, first, second (the addresses that two look-ups gave).  At
    each hop a row stops with a reason where its URL isn't public, robots rules or
    the host's addresses refuse it, or it would be redirected once more than
    ``hops`` times; a row that answers stops with none.  Rows that have stopped
    take no part in later hops.
    """
    going = start.select("id", "url", "access", F.lit(0).alias("n_redirects"), F.lit(False).alias("robots_ignored"))
    next_ = answers.select(F.col("url").alias("_u"), F.when(F.col("status").isin(301, 302, 303, 307, 308), F.col("location")).alias("_to"))
    names = resolved.select(F.col("host").alias("_h"), urls.answers_reason(F.col("first"), F.col("second")).alias("_dns"), F.lit(True).alias("_known"))
    # each hop reads these again
    rules, told = extraction.answered_rules(robots, agent)
    next_, names, rules, told, out = saved(next_, "answers"), saved(names, "resolved"), saved(rules, "rules"), saved(told, "told"), None
    for hop in range(hops + 1):
        # each step is computed once: its columns occur in many places below
        x = saved(going.withColumn("url", urls.strip_trackers(F.col("url"))), "going")
        x = saved(x.withColumn("_public", urls.policy_reason(F.col("url"))).withColumn("_host", urls.host(F.col("url"))).withColumn("_path", urls.path(F.col("url"))), "checked")
        public = F.col("_public")
        asked = x.where(public.isNull()).select(F.col("_host").alias("host"), F.col("_path").alias("path")).distinct()
        allowed = extraction.permitted(asked, rules, told).select(F.col("host").alias("_rh"), F.col("path").alias("_rp"), "allowed")
        x = x.join(allowed, (F.col("_host") == F.col("_rh")) & (F.col("_path") == F.col("_rp")), "left").join(names, F.col("_host") == F.col("_h"), "left").join(next_, F.col("url") == F.col("_u"), "left")
        closed = ~F.coalesce("allowed", F.lit(False))
        dns = F.when(F.col("_known").isNull(), "non_public_dns_answer").otherwise(F.col("_dns"))
        reason = F.coalesce(public, F.when(closed & (F.col("access") != "explicit"), F.lit("robots_disallowed")), dns, F.when(F.col("_to").isNotNull() & F.lit(hop == hops), F.lit("redirect_limit")))
        x = x.withColumn("reason", reason).withColumn("robots_ignored", F.col("robots_ignored") | (public.isNull() & closed & (F.col("access") == "explicit")))
        x = saved(x.select("id", "url", "access", "n_redirects", "reason", "robots_ignored", "_to"), "hop")
        ended = x.where(F.col("reason").isNotNull() | F.col("_to").isNull()).select("id", "url", "n_redirects", "reason", "robots_ignored")
        out = ended if out is None else out.unionByName(ended)
        whole = F.when(F.col("_to").rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.col("_to")).when(F.col("_to").startswith("//"), F.concat(urls.scheme(F.col("url")), F.lit(":"), F.col("_to"))).when(F.col("_to").startswith("/"), F.concat(F.regexp_extract("url", "^[^:]+://[^/?#]*", 0), F.col("_to")))
        whole = F.coalesce(whole, F.concat(F.regexp_extract("url", "^[^:]+://[^/?#]*", 0), F.regexp_replace(urls.path(F.col("url")), "[^/]*$", ""), F.col("_to")))
        going = x.where(F.col("reason").isNull() & F.col("_to").isNotNull())
        if not going.head(1):
            break
        going = going.select("id", whole.alias("url"), "access", (F.col("n_redirects") + 1).alias("n_redirects"), "robots_ignored")
    return out


def circuit(attempts: DataFrame, search: str, host: str, rank: str, status: str, budget: int = 30, most: int = 30) -> DataFrame:
    """Attempts that a search makes: its first ``budget`` candidates, at most ``most``, without those of hosts that have blocked it twice before."""
    place = F.row_number().over(Window.partitionBy(search).orderBy(rank))
    first = attempts.withColumn("_n", place).where(F.col("_n") <= min(budget, most))
    blocked = F.sum((F.col(status) == "blocked").cast("int")).over(Window.partitionBy(search, host).orderBy(rank).rowsBetween(Window.unboundedPreceding, -1))
    return first.withColumn("_b", F.coalesce(blocked, F.lit(0))).where("_b < 2").drop("_n", "_b")


def transfers(chunks: DataFrame, limit: int) -> DataFrame:
    """(nav, bytes, over, content_type, not_modified) of a navigation's chunks."""
    return chunks.groupBy("nav").agg(
        F.sum("bytes").alias("bytes"), (F.greatest(F.sum("bytes"), F.coalesce(F.max("declared"), F.lit(0))) > limit).alias("over"),
        F.min_by("content_type", F.when(F.col("content_type").isNotNull(), F.col("seq"))).alias("content_type"), F.max(F.col("status") == 304).alias("not_modified"),
    )


def settled(reads: DataFrame) -> DataFrame:
    """(page, text): the first of two equal successive non-empty reads, else the last read."""
    w = Window.partitionBy("page").orderBy("ts")
    seen = reads.withColumn("same", (F.lag("text").over(w) == F.col("text")) & (F.col("text") != ""))
    return seen.groupBy("page").agg(F.coalesce(F.min_by("text", F.when(F.col("same"), F.col("ts"))), F.max_by("text", "ts")).alias("text"))


def overrides(openings: DataFrame) -> DataFrame:
    """(investigation_id, n_overridden, last): how often an investigation went on against a robots rule, and when last."""
    return openings.where("decision = 'ignored'").groupBy("investigation_id").agg(F.count("*").alias("n_overridden"), F.max("seq").alias("last"))


def override_log(log: DataFrame | None, openings: DataFrame) -> DataFrame:
    """(investigation_id, seq, url, recorded_at) of openings against robots rules, after those of the log; one of equal seq stays."""
    new = openings.where("decision = 'ignored'").select("investigation_id", "seq", "url", "recorded_at")
    return new if log is None else log.unionByName(new.join(log.select("investigation_id", "seq"), ["investigation_id", "seq"], "left_anti"))


def ensured(investigations: DataFrame, calls: DataFrame) -> DataFrame:
    """Investigations with those that calls name for the first time, as of their first call; (investigation_id, opened)."""
    new = calls.groupBy("investigation_id").agg(F.min("at").alias("opened")).join(investigations.select("investigation_id"), "investigation_id", "left_anti")
    return investigations.select("investigation_id", "opened").unionByName(new)
