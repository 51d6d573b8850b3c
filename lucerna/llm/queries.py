"""The thin queries over the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucerna.llm.common import Scratch, crc_mod, table


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lucerna.llm import language

    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    model = language.train(docs.where(~held_out))
    return language.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lucerna.llm.lines import drop_lines, repeated_lines

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = drop_lines(docs.withColumn("n_lines", F.size(F.split("text", "\n", -1))), repeated_lines(docs, Scratch(spark, "op2")))
    kept = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n", -1)))
    return out.select("doc_id", "n_lines", kept.alias("n_kept"), F.octet_length("text").alias("kept_bytes"), F.sha2("text", 256).alias("kept_sha256"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lucerna.llm.simhash import near_duplicates

    out = near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "op3"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _scored(spark: SparkSession, sf_dir: str, label: str, held_out, learn, score, bound: int, least: float) -> DataFrame:
    from lucerna.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    sample = toxicity.labelled(docs, table(spark, sf_dir, "labels"), label, lambda i: ~held_out(i), bound)
    out = score(docs, learn(sample))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lucerna.llm import quality

    return _scored(spark, sf_dir, "quality", lambda i: crc_mod(i, 4) == 2, quality.fit, quality.score, quality.SAMPLE, 0.7)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lucerna.llm import toxicity

    def learn(sample: DataFrame) -> toxicity.Model:
        return toxicity.fit(sorted((r[0], (r[1] or "").encode(), r[2]) for r in sample.collect()))

    return _scored(spark, sf_dir, "toxic", lambda i: crc_mod(i, 5) == 0, learn, toxicity.score, toxicity.SAMPLE, 0.5)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lucerna.llm.bpe import encode_decode, read_ranks

    tokens = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    out = encode_decode(table(spark, sf_dir, "documents"), tokens, public_tokenizers.PATTERN)
    return out.select(
        "doc_id",
        F.expr("CAST(octet_length(ids) DIV 4 AS LONG)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lucerna.llm.packing import pack

    out = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lucerna.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op9_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lucerna.llm.suffix import repeated_spans

    out = repeated_spans(table(spark, sf_dir, "documents"), Scratch(spark, "op9"))
    removed = F.aggregate(F.zip_with("begins", "ends", lambda b, e: e - b), F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("begins").cast("long").alias("n_spans"), "kept_sha256")


def op10_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lucerna.llm.embedding import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"), Scratch(spark, "op10"))


def op11_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lucerna.llm.audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Scratch(spark, "op11"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lucerna.llm.alignment import cross_align

    at = public_tokenizers.path
    return cross_align(table(spark, sf_dir, "documents"), at("byte_bpe_50k.json"), public_tokenizers.PATTERN, at("piece_bpe_32k.model"), Scratch(spark, "op12"))[0]


def op13_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lucerna.llm.sharding import place

    return place(table(spark, sf_dir, "documents"), Scratch(spark, "op13"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "op2_lines": op2_lines,
    "op3_simhash": op3_simhash,
    "op4_quality": op4_quality,
    "op5_toxicity": op5_toxicity,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_packing": op7_packing,
    "op8_topk": op8_topk,
    "op9_suffix": op9_suffix,
    "op10_embedding": op10_embedding,
    "op11_filters": op11_filters,
    "op12_alignment": op12_alignment,
    "op13_shards": op13_shards,
}

OP8_SQL = """
WITH sound AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
           CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM sound q JOIN sound c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
), ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP11_SQL = r"""
WITH texts AS (
    SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents
), words AS (
    SELECT doc_id, part, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
           length(regexp_replace(text, '[^A-Z]', '', 'g')) AS capitals, min(doc_id) OVER (PARTITION BY text) AS first
    FROM texts
), good AS (
    SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), failing AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
           CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
           || CASE WHEN 100 * capitals > 3 * length(text) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
           || CASE WHEN words.doc_id > first THEN 'E' ELSE '' END AS fails
    FROM words LEFT JOIN good USING (doc_id)
), counts AS (
    SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failing GROUP BY part, fails
), l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
    FROM l a JOIN l b ON b.x <> a.x JOIN l c ON c.x NOT IN (a.x, b.x) JOIN l d ON d.x NOT IN (a.x, b.x, c.x) JOIN l e ON e.x NOT IN (a.x, b.x, c.x, d.x)
), steps AS (
    SELECT filter_order, k AS step, filter_order[k:k] AS letter, filter_order[1:k] AS upto, CASE WHEN k = 1 THEN '' ELSE filter_order[1:k - 1] END AS before
    FROM orders, unnest([1, 2, 3, 4, 5]) AS u(k)
), told AS (
    SELECT *, contains(fails, letter) AS hit, len(list_intersect(string_split(fails, ''), string_split(before, ''))) > 0 AND fails <> '' AND before <> '' AS gone,
           fails <> '' AND len(list_intersect(string_split(fails, ''), string_split(upto, ''))) > 0 AS out
    FROM counts, steps
), summed AS (
    SELECT part, filter_order, step, letter, sum(CASE WHEN out THEN 0 ELSE n END) AS kept, sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS removed,
           sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = letter THEN n ELSE 0 END) AS unique_fails,
           sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
    FROM told GROUP BY part, filter_order, step, letter
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM summed
"""

ORACLE_SQL: dict[str, str] = {"op8_topk": OP8_SQL, "op11_filters": OP11_SQL}
