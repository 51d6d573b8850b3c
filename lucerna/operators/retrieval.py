"""BM25 over an inverted index of postings."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lucerna.functions import texts
from lucerna.session import dealt, dropped, saved

K1, B = 1.2, 0.75


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, length): one row per distinct term of a document."""
    terms = dealt(docs.select(key, text)).select(key, texts.words(F.col(text)).alias("w"))
    terms = terms.select(key, F.size("w").alias("length"), F.explode("w").alias("term"))
    return terms.groupBy(key, "term", "length").agg(F.count("*").alias("tf"))


#: Words of texts that are counted at once.
COUNTED = 1 << 20


def packed_postings(docs: DataFrame, key: str, text: str, buckets: int) -> DataFrame:
    """(key, bucket, length, terms, tfs) where ``key`` is unique: a row for each bucket of a document's distinct terms, by their CRC-32.

    Each text is counted where it is read, in Arrow batches, and nothing is dealt
    by document; a document's key goes with a bucket's terms, not with each term.
    """
    kind = docs.schema[key].dataType.simpleString()
    names = ["key", "bucket", "length", "terms", "tfs"]

    def counted(keys: pa.Array, lists: pa.Array) -> pa.RecordBatch:
        size = lists.value_lengths().fill_null(0).to_numpy()
        coded = lists.flatten().dictionary_encode()
        bucket = np.array([crc32(t.encode()) % buckets for t in coded.dictionary.to_pylist()], np.int32)
        # terms in the order of their buckets
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        found, n = np.unique(np.repeat(np.arange(len(size)), size) * len(order) + place[coded.indices.to_numpy()], return_counts=True)
        doc, term = found // max(1, len(order)), order[found % max(1, len(order))]
        at = bucket[term]
        first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])][: len(doc)])
        cut = pa.array(np.r_[first, len(doc)].astype(np.int32))
        terms, tfs = coded.dictionary.take(pa.array(term)), pa.array(n.astype(np.int64))
        columns = [keys.take(pa.array(doc[first])), pa.array(at[first]), pa.array(size[doc[first]], pa.int32())]
        return pa.record_batch([*columns, pa.ListArray.from_arrays(cut, terms), pa.ListArray.from_arrays(cut, tfs)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = np.cumsum(b.column("w").value_lengths().fill_null(0).to_numpy(), dtype=np.int64) // COUNTED
            cuts = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]][: len(part)]), len(part)]
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                own = b.slice(i, j - i)
                yield counted(own.column("k"), own.column("w"))

    some = dealt(docs.select(F.col(key).alias("k"), F.col(text).alias("t"))).select("k", texts.words(F.col("t")).alias("w"))
    return some.mapInArrow(run, f"key {kind}, bucket int, length int, terms array<string>, tfs array<long>")


def unpacked(rows: DataFrame, *keep: str) -> DataFrame:
    """``keep``, term and tf of packed postings: a row for each term."""
    return rows.select(*keep, F.explode(F.arrays_zip("terms", "tfs")).alias("_r")).select(*keep, F.col("_r.terms").alias("term"), F.col("_r.tfs").alias("tf"))


def row_postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The same as ``postings`` where ``key`` is unique: each text is counted where it is read, and nothing is dealt by document."""
    return unpacked(packed_postings(docs, key, text, 1), "key", "length").select(F.col("key").alias(key), "term", "length", "tf")


def query_terms(question, limit: int | None = None):
    found = F.array_distinct(texts.words(question))
    return F.slice(found, 1, limit) if limit else found


def bm25(queries: DataFrame, index: DataFrame, totals: DataFrame, key: str, query_key: str, k: int) -> DataFrame:
    """The k best documents of each query that hold all its terms, ties to the lesser key.

    ``queries`` is (query_key, term); ``totals`` one row (n_docs, avg_length).
    Only postings of asked terms are kept before anything else is joined, and a
    question's documents are those of its rarest term.
    """
    asked = queries.select("term").distinct()
    hit = saved(index.join(asked, "term", "left_semi"), "hits")
    df = saved(hit.groupBy("term").agg(F.count("*").alias("df")), "terms")
    n_docs, avg_length = totals.first()
    idf = F.greatest(F.log((F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(float(avg_length or 1.0))))
    # a document holds all terms only if it holds the rarest: those alone meet the other terms, by term and document
    told = queries.join(df.withColumn("idf", idf), "term", "left")
    needed = told.groupBy(query_key).agg(F.count("*").alias("n_terms"), F.count("df").alias("n_known"), F.min_by("term", F.struct("df", "term")).alias("rarest")).where("n_known = n_terms")
    likely = needed.join(hit.select(F.col("term").alias("rarest"), key), "rarest").select(query_key, "n_terms", key)
    pairs = likely.join(told.select(query_key, "term", "idf"), query_key).join(hit, ["term", key])
    found = pairs.groupBy(query_key, key).agg(F.sum(weight).alias("score"), F.count("*").alias("n"), F.first("n_terms").alias("n_terms")).where("n = n_terms")
    w = Window.partitionBy(query_key).orderBy(F.desc(F.round("score", 9)), key)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(query_key, "rank", key, "score")


PACKED = "key string, length int, terms array<string>, tfs array<long>"


class Postings:
    """Postings that follow upserts and deletions without being rebuilt: two Parquet tables under one folder.

    ``postings`` holds (bucket, key, length, terms, tfs) by version and by bucket of
    the terms' hash, a row for a document's terms of a bucket, ``documents`` (key, length) by version; a null length says
    that the document is gone.  An upsert writes a version with its own documents
    only; a posting counts if its version is its document's last.  ``merge`` writes
    what counts as one new version and drops the older ones.  One writer at a time:
    the version of a write that died midway is not among the documents, and the
    next write replaces it.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _folder(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        path, files = self._folder("documents")
        return sorted(int(x.getPath().getName().split("=")[1]) for x in files.listStatus(path) if files.exists(self._folder(f"documents/{x.getPath().getName()}/_SUCCESS")[0])) if files.exists(path) else []

    def _write(self, rows: DataFrame, documents: DataFrame) -> int:
        version = max(self._versions(), default=0) + 1
        rows = rows.select("key", "length", "terms", "tfs", "bucket")
        rows.repartition("bucket").sortWithinPartitions("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/version={version}")
        documents.select("key", "length").write.mode("overwrite").parquet(f"{self.path}/documents/version={version}")
        return version

    def upsert(self, docs: DataFrame, key: str, text: Column) -> int:
        """Replaces the postings of these documents; a null text leaves none.  ``key`` is unique; returns the version."""
        own = saved(docs.select(F.col(key).cast("string").alias("key"), text.alias("text")), "upsert")
        rows = packed_postings(own.where("text IS NOT NULL"), "key", "text", self.buckets)
        length = F.when(F.col("text").isNotNull(), F.size(texts.words(F.col("text"))))
        version = self._write(rows, own.select("key", length.alias("length")))
        dropped(self.spark, own)
        return version

    def delete(self, keys: DataFrame, key: str) -> int:
        gone = keys.select(F.col(key).cast("string").alias("key"), F.lit(None).cast("int").alias("length"))
        return self._write(self.spark.createDataFrame([], f"{PACKED}, bucket int"), gone)

    def documents(self) -> DataFrame:
        """(key, version, length): the last version of each document that is there."""
        parts = [self.spark.read.schema("key string, length int").parquet(f"{self.path}/documents/version={v}").withColumn("version", F.lit(v)) for v in self._versions()]
        every = reduce(DataFrame.unionByName, parts, self.spark.createDataFrame([], "key string, length int, version int"))
        return every.groupBy("key").agg(F.max_by(F.struct("version", "length"), "version").alias("d")).select("key", "d.version", "d.length").where("length IS NOT NULL")

    def _packed(self, only: list[int] | None = None) -> DataFrame:
        """(key, length, terms, tfs, bucket, version) of all versions, whether they count or not; with ``only``, of these buckets."""
        found = []
        for v in self._versions():
            path, files = self._folder(f"postings/version={v}")
            if any(x.getPath().getName().startswith("bucket=") for x in files.listStatus(path)):
                own = self.spark.read.schema(f"{PACKED}, bucket int").parquet(f"{self.path}/postings/version={v}")
                found.append((own.where(F.col("bucket").isin(only)) if only is not None else own).withColumn("version", F.lit(v)))
        return reduce(DataFrame.unionByName, found, self.spark.createDataFrame([], f"{PACKED}, bucket int, version int"))

    def rows(self, terms: DataFrame | None = None) -> DataFrame:
        """(term, key, tf, length) of the documents that are there; with ``terms`` (term), those terms' only, read from their buckets."""
        documents = self.documents().select("key", "version")
        if terms is None:
            return unpacked(self._packed().join(documents, ["key", "version"]), "key", "length").select("term", "key", "tf", "length")
        only = [r[0] for r in terms.select((F.crc32("term") % self.buckets).cast("int")).distinct().collect()]
        every = unpacked(self._packed(only), "key", "length", "version").join(terms.select("term").distinct(), "term", "left_semi")
        return every.join(documents, ["key", "version"]).select("term", "key", "tf", "length")

    def merge(self) -> int:
        """One version with all that counts."""
        older, documents = self._versions(), saved(self.documents(), "documents")
        version = self._write(self._packed().join(documents.select("key", "version"), ["key", "version"]), documents)
        for name in ("documents", "postings"):
            for v in older:
                path, files = self._folder(f"{name}/version={v}")
                files.delete(path, True)
        dropped(self.spark, documents)
        return version

    def search(self, queries: DataFrame, query_key: str, k: int) -> DataFrame:
        """The k best documents of each question that hold all its terms: (query_key, rank, key, score); ``queries`` is (query_key, term)."""
        totals = self.documents().agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
        return bm25(queries, self.rows(queries), totals, "key", query_key, k)
