"""Shared plumbing of the training-data operators.

Tables that cut lineage are written as Parquet into the folder that the
session names in ``spark.checkpoint.dir``: every executor and the driver can
read it, so a lost executor costs at most the re-run of its own tasks.
"""

from __future__ import annotations

import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lucerna.session import shared_dir


class Scratch:
    """Parquet tables in the shared folder, under one run's own sub-folder.

    ``save`` writes a table and reads it back (lineage ends there); ``drop``
    deletes one that no later step reads.  What is left goes when the driver's
    JVM ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/lucerna-{label}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        path = self._path(self.root)
        path.getFileSystem(self._hadoop()).deleteOnExit(path)

    def _hadoop(self):
        return self.spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, at: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)

    def save(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        at = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.option("compression", codec).parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        self.paths[id(out)] = at
        out._lucerna_at = at
        return out

    def drop(self, df: DataFrame | None) -> None:
        at = getattr(df, "_lucerna_at", None)
        if at:
            path = self._path(at)
            path.getFileSystem(self._hadoop()).delete(path, True)
            # the cleaner deletes shuffle files of queries that the driver's JVM has collected: let it notice now
            self.spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m: the split of rows into learned and held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % m


def text_hash(text: Column) -> Column:
    """64 bits that, beside an id, tell a row by its text; null and empty texts are told apart too."""
    return F.xxhash64(text.cast("string"), text.isNull())


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, altered where the table has a column of that name (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def texts_of(column: pa.Array) -> list[str]:
    """Python strings; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def bytes_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column without decoding it; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def own_crc(text: str) -> int:
    return zlib.crc32(text.encode())
