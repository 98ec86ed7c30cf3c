"""Scratch tables in the folder that driver and executors share.

The folder is ``spark.checkpoint.dir``.  Only a session on one machine may have none (tests, a laptop);
one is then made under the machine's temporary folder.  On a cluster its absence is an error.
A written table cuts the lineage and is read again after the loss of an executor.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []
_own: list[str] = []


def root(spark: SparkSession) -> str:
    """The shared scratch folder, as a URI or path."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="vecspark-"))
        base = _own[0]
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the scratch folder that nothing has used yet; removed when the driver ends."""
    path = f"{root(spark)}/vecspark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return path


def filesystem(spark: SparkSession, path: str):
    """Hadoop's file system that ``path`` is on."""
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder that nothing reads any more."""
    filesystem(spark, path).delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), True)


def _clean() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # the session may be gone by now; the folder's owner cleans up then
            pass


def write(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a parquet scratch table and returns the table."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop(table: DataFrame) -> None:
    """Deletes a table that ``write`` returned, once a later one has taken its place."""
    remove(table.sparkSession, table._scratch_path)


#: Rows of a written table of a few numbers a row that may go to every executor (some 100 MB when hashed).
BROADCAST_ROWS = 1_000_000


def lookup(table: DataFrame) -> DataFrame:
    """``table`` (written, at most three numbers a row) marked to be broadcast if it is small enough, else to be merged."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table.hint("merge")
