"""Recall, candidate share, quantiles and histograms of search results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall(reference: DataFrame, found: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """(query_id, recall): the share of a query's reference rows that are among the found ones; 0 where none are.

    ``queries`` (vec_id) adds queries without reference rows, with recall 0.
    """
    hits = found.select("query_id", "vec_id").distinct().withColumn("_hit", F.lit(1.0))
    out = reference.join(hits, ["query_id", "vec_id"], "left").groupBy("query_id").agg(F.avg(F.coalesce("_hit", F.lit(0.0))).alias("recall"))
    if queries is not None:
        out = queries.select(F.col("vec_id").alias("query_id")).join(out, "query_id", "left").withColumn("recall", F.coalesce("recall", F.lit(0.0)))
    return out


def mean_recall(reference: DataFrame, found: DataFrame) -> DataFrame:
    return recall(reference, found).agg(F.round(F.avg("recall"), 6).alias("recall"))


def recall_curve(reference: DataFrame, found: DataFrame, k: int, factors: list[int]) -> DataFrame:
    """(oversample, recall) from one search that went as deep as the largest factor: ranks up to k times each factor."""
    steps = found.sparkSession.createDataFrame([(f,) for f in factors], "oversample int")
    wide = found.join(F.broadcast(steps), F.col("rank") <= k * F.col("oversample")).select("oversample", "query_id", "vec_id")
    hits = wide.withColumn("_hit", F.lit(1.0))
    grid = reference.select("query_id", "vec_id").join(F.broadcast(steps))  # one row a factor
    return grid.join(hits, ["oversample", "query_id", "vec_id"], "left").groupBy("oversample").agg(F.round(F.avg(F.coalesce("_hit", F.lit(0.0))), 3).alias("recall"))


def candidate_share(candidates: DataFrame, queries: DataFrame, n_docs: int) -> DataFrame:
    """(query_id, n_candidates, share): distinct candidates of each query and their per cent of all documents."""
    return shares(candidates.select("query_id", "vec_id").distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), queries, n_docs)


def shares(counts: DataFrame, queries: DataFrame, n_docs: int) -> DataFrame:
    """As ``candidate_share``, from counts (query_id, n); queries without one have none."""
    return queries.select(F.col("vec_id").alias("query_id")).join(counts, "query_id", "left").select(
        "query_id", F.coalesce("n", F.lit(0)).alias("n_candidates"), F.round(F.coalesce("n", F.lit(0)) * 100.0 / n_docs, 6).alias("share"))


def quantiles(rows: DataFrame, col: str) -> DataFrame:
    """p10, p50, p95 and mean, exact with linear interpolation."""
    return rows.agg(*(F.round(F.percentile(col, p / 100), 6).alias(f"p{p}") for p in (10, 50, 95)), F.round(F.avg(col), 6).alias("mean"))


def histogram(rows: DataFrame, col: str, bins: int = 20, low: float = 0.0, high: float = 100.0) -> DataFrame:
    """(bin, n) of equal bins over [low, high], values beyond clipped, the last bin closed."""
    x = F.greatest(F.lit(low), F.least(F.lit(high), F.col(col)))
    at = F.least(F.floor((x - low) * bins / (high - low)), F.lit(bins - 1)).cast("int")
    return rows.select(at.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
