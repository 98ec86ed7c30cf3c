"""A corpus pipeline: quality, exact copies, near copies, mix, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and is
written as parquet before the next one reads it.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vecspark.llm import exact_dedup, mixing, packing, quality, scratch, simhash


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality scorer rejects go.

    Null, empty and blank texts go too; rows that repeat an id, or have none, are judged one by one.  An
    empty table stays empty.
    """
    return quality.survivors(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for white space one stays: the longest, then that of the smallest id.

    Null texts are empty ones, and empty ones are equal; a null id counts as the largest; rows that repeat
    id and text stand or fall together.  An empty table stays empty.
    """
    index = exact_dedup.DigestIndex(spark, scratch.new_path(spark, "digest-index"))
    kept = exact_dedup.survivors(docs, index)
    index.close()
    return kept


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by their fingerprints the one of smallest id stays.

    Texts without a word link to each other; rows without an id stay, and rows that share one stay or go
    together.  An empty table stays empty.
    """
    return simhash.survivors(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are dropped or repeated so that languages get their target shares of words.

    Languages without a row get no share, rows of unknown language the rate of their words' languages; rows
    without an id draw as id 0, and rows that share one draw alike.  An empty table stays empty.
    """
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are tokenised and packed into windows: a row a piece.

    A null or empty text is its end token alone; rows that repeat an id are documents of their own, and a
    null id stays null.  An empty table gives no pieces.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the classifier nor the tokens; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
