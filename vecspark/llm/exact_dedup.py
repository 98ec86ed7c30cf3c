"""Exact deduplication against a persistent digest index.

The index is a parquet table bucketed by digest, each file sorted.  A batch is reduced to one row per
digest, compared with the index by a sort-merge anti-join for which the index is not shuffled, and what is
new is appended, a file a bucket.  Spark does not rely on the order of files and sorts a bucket's rows once
more for the join; ``compact`` keeps buckets from having many files.  Everything is DataFrame code.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.llm import scratch

#: The characters that do not count when texts are compared.
WHITE_SPACE = " \t\n\v\f\r"


def normalised(text: Column) -> Column:
    """``text`` without white space; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for ch in WHITE_SPACE:
        out = F.replace(out, F.lit(ch), F.lit(""))
    return out


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, n_chars) of each row: SHA-256 of the normalised text, code points of the original."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.sha2(normalised(F.col(text_col)), 256).alias("digest"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_chars"),
    )


def _order_id(c: Column) -> Column:
    """Null ids come after all others."""
    return F.coalesce(c, F.lit(9223372036854775807))


def winners(digest_rows: DataFrame) -> DataFrame:
    """One row per digest: the id that stays (longest original, then smallest id) and the group's size.

    Grouping is by digest with partial aggregation, so a group of copies reaches the shuffle as one
    row per task however large it is.
    """
    best = F.min(F.struct((-F.col("n_chars")).alias("neg"), _order_id(F.col("doc_id")).alias("ord"), F.col("doc_id").alias("id")))
    return digest_rows.groupBy("digest").agg(best.alias("w"), F.count(F.lit(1)).alias("group_size")).select(
        "digest", F.col("w.id").alias("keep_id"), (-F.col("w.neg")).alias("keep_chars"), "group_size"
    )


class DigestIndex:
    """Digests seen so far, as a bucketed and sorted table at ``path``.

    The number of buckets is fixed when the index is made and stored beside it; opening an existing
    index ignores ``buckets``.  Appending the same batch twice adds nothing the second time, so a
    failed append is simply repeated.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.buckets = self._stored_buckets()
        if self.buckets is None:
            self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.range(1).select(F.lit(self.buckets).alias("buckets")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/meta")
        self.table = f"digest_index_{hashlib.md5(self.path.encode()).hexdigest()[:16]}"
        location = f"{self.path}/data".replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest STRING, keep_id BIGINT, keep_chars BIGINT, group_size BIGINT) "
            f"USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{location}'"
        )

    def _stored_buckets(self) -> int | None:
        jvm = self.spark.sparkContext._jvm
        if not scratch.filesystem(self.spark, self.path).exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/meta/_SUCCESS")):
            return None
        return self.spark.read.parquet(f"{self.path}/meta").first()["buckets"]

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def unseen(self, groups: DataFrame) -> DataFrame:
        """The groups whose digest the index lacks, by a sort-merge anti-join on the buckets."""
        return groups.hint("merge").join(self.read().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, groups: DataFrame) -> None:
        """Adds the groups that are new: one file per bucket, sorted by digest."""
        new = self.unseen(groups).select("digest", "keep_id", "keep_chars", "group_size")
        new.repartition(self.buckets, "digest").write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)

    def compact(self) -> None:
        """Rewrites each bucket's files as one, beside the old ones, which go when the new ones are whole."""
        beside = DigestIndex(self.spark, f"{self.path}.{uuid.uuid4().hex[:8]}", self.buckets)
        # read as plain files: a bucketed scan would count as dealt already
        rows = self.spark.read.schema(self.read().schema).parquet(f"{self.path}/data")
        rows.repartition(self.buckets, "digest").write.insertInto(beside.table)
        beside.close()
        fs = scratch.filesystem(self.spark, self.path)
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        scratch.remove(self.spark, f"{self.path}/old")
        fs.rename(at(f"{self.path}/data"), at(f"{self.path}/old"))
        fs.rename(at(f"{beside.path}/data"), at(f"{self.path}/data"))
        scratch.remove(self.spark, f"{self.path}/old")
        scratch.remove(self.spark, beside.path)
        self.spark.catalog.refreshTable(self.table)

    def close(self) -> None:
        """Takes the index out of the session's catalogue; the files stay, and opening it again finds them."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def deduplicate(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Decides each row of a batch against the index and the batch itself, and appends what is new.

    Returns one row per input row: doc_id, keep_id, group_size (rows of this batch with the text),
    kept, text_sha256.  Of equal texts the index's earlier one stays, else the longest original, then
    the smallest id.  Null texts are empty texts; empty texts are equal to each other.  A null id
    counts as the largest.  Rows that repeat both an id and a text stand or fall together.  An empty
    table gives an empty result; other columns are not looked at.
    """
    rows = scratch.write(digests(docs, id_col, text_col), "digests")
    groups = scratch.write(winners(rows), "groups")
    before = index.read().select("digest", F.lit(True).alias("seen"), F.col("keep_id").alias("old_id"))
    verdict = scratch.write(
        groups.hint("merge").join(before.hint("merge"), "digest", "left").select(
            "digest", F.when(F.col("seen"), F.col("old_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            "keep_chars", "group_size", F.coalesce("seen", F.lit(False)).alias("seen"),
        ), "verdicts",
    )  # written, for the append below changes what the index says
    index.append(groups)
    return rows.join(verdict, "digest").select(
        "doc_id", "keep_id", "group_size",
        (~F.col("seen") & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def survivors(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; the batch is appended to the index.

    Rows that go are looked up by id and 60 bits of the digest; texts move only where they are too many
    to be broadcast.
    """
    def head(digest: Column) -> Column:
        return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")

    verdict = deduplicate(docs, index, id_col, text_col)
    drop = verdict.filter(~F.col("kept")).select(F.col("doc_id").alias("_id"), head(F.col("text_sha256")).alias("_digest"))
    drop = scratch.lookup(scratch.write(drop.distinct(), "dropped"))
    same = docs[id_col].eqNullSafe(drop["_id"]) & (head(F.sha2(normalised(docs[text_col]), 256)) == drop["_digest"])
    return docs.join(drop, same, "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = DigestIndex(spark, scratch.new_path(spark, "digest-index"))
    out = deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"), index)
    index.close()
    return out


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id)
"""
