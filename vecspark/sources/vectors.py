"""Vector tables: reading, checking, splitting, generating, writing.

A vector table has vec_id (long, unique) and v (array<double>).  Ids are explicit; nothing depends on
the order in which rows are read.
"""

from __future__ import annotations

import atexit
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Provider:
    """Where a kind of embeddings is kept: a path under the data folder, its columns and the vectors' length.

    ``derive`` is an SQL expression over the stored vector ``v``, for kinds that are made from others.
    """

    path: str
    column: str = "embedding"
    id_column: str = "vec_id"
    dim: int | None = None
    derive: str | None = None


CATALOGUE = {
    "default": Provider("embeddings.parquet", dim=64),
    # longer than a word of a code, and not a whole number of words
    "wide": Provider("embeddings.parquet", dim=100, derive="concat(v, slice(v, 1, 36))"),
}


def load(spark: SparkSession, base: str, provider: Provider | str = "default") -> DataFrame:
    """(vec_id, v) of a provider; a null vector or one of the wrong length fails the query."""
    p = CATALOGUE[provider] if isinstance(provider, str) else provider
    rows = spark.read.parquet(f"{base}/{p.path}").select(F.col(p.id_column).cast("long").alias("vec_id"), F.col(p.column).cast("array<double>").alias("v"))
    v = F.expr(p.derive) if p.derive else F.col("v")
    if p.dim is not None:
        ok = F.coalesce(F.size(v) == p.dim, F.lit(False))
        v = F.when(ok, v).otherwise(F.raise_error(F.lit(f"vectors must have {p.dim} dimensions")).cast("array<double>"))
    return rows.select("vec_id", v.alias("v"))


def chunk(vectors: DataFrame, offset: int, size: int) -> DataFrame:
    """The rows with ids in [offset, offset + size); reaches the scan as a filter."""
    return vectors.filter((F.col("vec_id") >= offset) & (F.col("vec_id") < offset + size))


def with_chunk(vectors: DataFrame, size: int) -> DataFrame:
    return vectors.withColumn("chunk", F.expr(f"cast(vec_id div {size} as int)"))


def split(vectors: DataFrame, share: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """(documents, queries): the first ``share`` of contiguous ids and the rest."""
    n = int(vectors.count() * share + 1e-9)
    return vectors.filter(F.col("vec_id") < n), vectors.filter(F.col("vec_id") >= n)


def load_split(spark: SparkSession, base: str, provider: Provider | str = "default", share: float = 0.9) -> tuple[DataFrame, DataFrame]:
    return split(load(spark, base, provider), share)


def random_vectors(spark: SparkSession, n: int, dim: int, normal: bool = False, seed: int = 0) -> DataFrame:
    """Uniform [0, 1) or standard normal vectors; each value hangs on the seed, the id and the position alone.

    Normal values are made from two uniform ones (Box and Muller).
    """
    def uniform(salt: int):
        return lambda d: (F.pmod(F.xxhash64("id", d, F.lit(seed), F.lit(salt)), F.lit(1 << 52)) + 0.5) / float(1 << 52)

    u, w = uniform(1), uniform(2)
    one = (lambda d: F.sqrt(-2 * F.log(u(d))) * F.cos(2 * F.pi() * w(d))) if normal else u
    return spark.range(n).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), one).alias("v"))


def write_csv(rows: DataFrame, path: str) -> None:
    """Result rows as CSV files with a header."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_clusters(vectors: DataFrame, path: str, keys: tuple[str, ...] = ("shard", "cluster")) -> None:
    """Vectors by cluster: a folder for each key, so that reading some clusters reads only those."""
    vectors.repartition(*keys).write.mode("overwrite").partitionBy(*keys).parquet(path)


def read_clusters(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """All clusters, or those of the (shard, cluster) rows ``wanted``; then partitions are pruned while running."""
    rows = spark.read.parquet(path)
    return rows if wanted is None else rows.join(wanted.distinct(), ["shard", "cluster"], "left_semi")


_made: list[tuple[SparkSession, str]] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, ``spark.checkpoint.dir``; removed when the driver ends.

    Only a session on one machine may do without that setting; it uses its warehouse.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    if not _made:
        atexit.register(_clean)
    path = f"{base.rstrip('/')}/vecspark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    _made.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if there is one."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # the session may be gone by now; the folder's owner cleans up then
            pass
