"""Typed readers; no schema is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lucerna.session import saved

SERPS = "serp_id string, engine string, query string, text string, links array<struct<url:string,text:string>>"
FIXTURES = (
    "case_id string, claims array<struct<id:string,text:string,required_concepts:array<string>,acceptable_patterns:array<string>,"
    "sources:array<struct<url:string,equivalent_urls:array<string>>>,evidence_passages:array<struct<url:string,text:string>>,weight:double>>"
)
RESULTS = "case_id string, results array<struct<url:string,text:string,token_count:bigint>>"
SCIFACT = (
    "qrels array<struct<queryId:string,corpusId:string,relevance:int>>, queries map<string,string>, documents map<string,struct<title:string,text:string>>"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def strict_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One document per file; a malformed one fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path)


def fixtures(spark: SparkSession, path: str) -> DataFrame:
    return strict_json(spark, path, FIXTURES)


def jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(value, body): each line with its parsed form; a bad line has a null body instead of failing the file."""
    lines = spark.read.text(path)
    return lines.select("value", F.try_parse_json("value").alias("body"), F.input_file_name().alias("file")).where(F.trim("value") != "")


def jsonl_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, line, record, corrupt): every line that isn't empty, numbered from 1 within its file, however the file is split.

    A line that is no JSON object of the schema has no record and is kept as
    ``corrupt``; no line fails the others.  Lines are counted by the blocks that
    the scan reads: a block's lines follow those of the file's earlier blocks.
    """
    meta = F.col("_metadata")
    rows = spark.read.text(path).select("value", meta.getField("file_path").alias("file"), meta.getField("file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")).where(F.length("value") > 0)
    rows = saved(rows, "lines")
    counts = rows.groupBy("file", "block").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("file", "block").orderBy("at"))
    parsed = F.from_json("value", schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    out = rows.join(before, ["file", "block"]).withColumn("line", (F.col("before") + place).cast("long")).withColumn("p", parsed)
    bad = F.col("p").isNull() | F.col("p._corrupt").isNotNull()
    names = [f.name for f in out.schema["p"].dataType.fields if f.name != "_corrupt"]
    return out.select("file", "line", F.when(~bad, F.struct(*[F.col(f"p.{c}").alias(c) for c in names])).alias("record"), F.when(bad, F.col("value")).alias("corrupt"))


def blobs(spark: SparkSession, path: str, limit: int = 25 << 20) -> DataFrame:
    """(digest, content, byte_length) of files no longer than the limit."""
    files = spark.read.format("binaryFile").load(path).where(F.col("length") <= limit)
    return files.select(F.sha2("content", 256).alias("digest"), "content", F.col("length").alias("byte_length"))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files, whose contents aren't read."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def affordable(files: DataFrame, target: str, order: str, length: str, limit: int) -> DataFrame:
    """The files of each target that its byte budget admits, in order: one that exceeds what is left is passed over.

    Prefix sums by ranges admit all up to the first that is too long; what exceeds
    the rest goes with it, and the sums go on after it, until nothing is too long.
    Only lengths are looked at.  A target of ever smaller overruns takes a round for
    each; a round is a few shuffles of (target, order, length).
    """
    # what exceeds the whole budget never fits
    left = saved(files.where(F.col(length) <= limit).select(F.col(target).alias("_t"), F.col(order).alias("_o"), F.col(length).alias("_l")), "lengths")
    while True:
        dealt = saved(left.repartitionByRange("_t", "_o").withColumn("_p", F.spark_partition_id()), "dealt")
        sums = dealt.groupBy("_t", "_p").agg(F.sum("_l").alias("_s"))
        earlier = Window.partitionBy("_t").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
        before = sums.select(F.col("_t").alias("_bt"), F.col("_p").alias("_bp"), F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_b"))
        own = F.sum("_l").over(Window.partitionBy("_t", "_p").orderBy("_o").rowsBetween(Window.unboundedPreceding, 0))
        total = dealt.join(before, (F.col("_t") == F.col("_bt")) & (F.col("_p") == F.col("_bp"))).select("_t", "_o", "_l", (F.col("_b") + own).alias("_sum"))
        total = saved(total, "totals")
        first = total.where(F.col("_sum") > limit).groupBy("_t").agg(F.min(F.struct("_o", (F.col("_sum") - F.col("_l")).alias("used"))).alias("f"))
        first = saved(first.select(F.col("_t").alias("_ft"), F.col("f._o").alias("_fo"), (F.lit(limit) - F.col("f.used")).alias("_rest")), "firsts")
        if not first.head(1):
            kept = total.select(F.col("_t").alias(target), F.col("_o").alias(order))
            return files.join(kept, [target, order], "left_semi")
        on = total.join(first, F.col("_t") == F.col("_ft"), "left")
        left = on.where(F.col("_fo").isNull() | (F.col("_o") < F.col("_fo")) | (F.col("_l") <= F.col("_rest"))).select("_t", "_o", "_l")


def scifact(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(qrels, queries, documents) of one evaluation file."""
    one = strict_json(spark, path, SCIFACT)
    qrels = one.select(F.explode("qrels").alias("q")).select(F.col("q.queryId").alias("query_id"), F.col("q.corpusId").alias("doc_id"), F.col("q.relevance").alias("relevance"))
    queries = one.select(F.explode("queries").alias("query_id", "query"))
    documents = one.select(F.explode("documents").alias("doc_id", "d")).select("doc_id", "d.title", "d.text")
    return qrels, queries, documents


def robots_status(status, body):
    """The rules that a robots answer stands for: none if it is missing, all closed on any other failure."""
    return F.when(status.isin(404, 410), F.lit("")).when(status.between(200, 299), body).otherwise(F.lit("User-agent: *\nDisallow: /"))
