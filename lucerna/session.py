"""Sessions, and shipping this package to the executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_OWN_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which driver and executors share.

    Where it is unset, a session on one machine takes a temporary folder; on a
    cluster that would be a folder of the driver's own, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
    if not _OWN_DIR:
        _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="spark-"))
    return _OWN_DIR[0]


#: Bytes of a table that a core reads at least before it is worth dealing anew, and those above which files are cut finely enough.
SMALL, ENOUGH = 1 << 20, 4 << 20


def dealt(df: DataFrame) -> DataFrame:
    """The rows dealt to all cores, if they come from a table too small to be cut by its files.

    A file is read by row groups, and a small one has one: whatever is done to its
    texts would be one task's work.  By Catalyst's estimate of its size, tables of
    more than ENOUGH bytes a core are left as they are, so nothing large is shuffled.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if SMALL <= size <= ENOUGH * cores else df


def saved(df: DataFrame, label: str) -> DataFrame:
    """The table written to the shared folder and read back: its lineage ends there.  It goes when the driver ends."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/lucerna-{label}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._lucerna_at = at
    return out


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes saved tables that nothing reads any more, and lets the driver notice which shuffle files it no longer needs."""
    for df in tables:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._lucerna_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    spark.sparkContext._jvm.System.gc()


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package wherever they run: once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="lucerna-")) / "lucerna.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"lucerna/{f.relative_to(root)}")
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def local(cores: str = "8", **conf: str) -> SparkSession:
    """A session for one machine."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("lucerna").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
    b = b.config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()
