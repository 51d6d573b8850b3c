"""Corpus pipeline: language ID, line dedup, SimHash near-dedup, suffix dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all
that its predecessor kept.  All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucerna.llm import language, lines, packing, simhash, suffix
from lucerna.llm.common import Scratch, crc_mod, fresh, text_hash

#: Texts whose best language has a lower posterior are rejected, like those without a letter.
LEAST_SCORE = 0.4
#: Bytes of a passage that may not repeat: those of 50 words of three letters and a space, so that a repeated passage
#: of more than 50 words is found unless its words are shorter still (op9's contract asks for 400 bytes instead).
PASSAGE = 200


def _counted(df: DataFrame) -> DataFrame:
    """With n_chars brought up to date, if the column is there."""
    if "n_chars" not in df.columns:
        return df
    return df.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(df.schema["n_chars"].dataType))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter or without a clear language."""
    model = language.train(docs.where(crc_mod(F.col("doc_id"), 4) != 2))
    return language.keep(docs, model, LEAST_SCORE)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one occurrence of each group of like lines; documents stay, if only as an empty text."""
    return _counted(lines.drop_lines(docs, lines.repeated_lines(docs, Scratch(spark, "stage2"))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group whose 5-word shingles are alike to 0.8 or more: that of the least id.

    A document is an id with a text: what else stands under the same id is judged
    by its own text, and texts without an id are too.  Rows that repeat the kept
    document all stay.
    """
    found, (there, told) = simhash.similar_texts(docs, Scratch(spark, "stage3")), fresh(docs, "there", "told")
    goes = found.where(~F.col("kept")).select(F.col("doc_id").alias(there), F.col("text_hash").alias(told))
    return docs.join(goes, F.col("doc_id").eqNullSafe(F.col(there)) & (text_hash(F.col("text")) == F.col(told)), "left_anti")


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts what lies in strings of PASSAGE bytes that also start elsewhere; documents stay, if only as an empty text."""
    return _counted(suffix.cut(docs, suffix.repeated_spans(docs, Scratch(spark, "stage9"), depth=PASSAGE)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts into sequences of at most 1024 ids: a row per piece."""
    import public_tokenizers

    out = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("packing", pack),
]

#: SQL can't express these stages' learned and hashed decisions; tests/llm/test_pipeline.py compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents; each but the last is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
