"""Timing and reports of searches."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.operators import metrics
from vecspark.operators.topk import top_k
from vecspark.sources.vectors import CATALOGUE, load_split, random_vectors


def milliseconds(df: DataFrame) -> float:
    """Wall time of computing all rows, without keeping them."""
    start = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return (time.perf_counter() - start) * 1000


def warm_up(spark: SparkSession, dim: int = 64) -> None:
    """Starts Python workers and compiles what a search needs."""
    x = random_vectors(spark, 64, dim, normal=True)
    milliseconds(top_k(x, x, 1))


def latency_curve(spark: SparkSession, sizes: list[int], dim: int, k: int = 10, queries: int = 1, seed: int = 0) -> DataFrame:
    """(n_vecs, time_ms) of exact search over random vectors that are made and cached before."""
    warm_up(spark, dim)
    q = random_vectors(spark, queries, dim, seed=seed + 1)
    rows = []
    for n in sizes:
        x = random_vectors(spark, n, dim, seed=seed).persist()
        x.count()
        rows.append((n, milliseconds(top_k(x, q, k))))
        x.unpersist()
    return spark.createDataFrame(rows, "n_vecs long, time_ms double")


def per_provider(spark: SparkSession, base: str, one: Callable[[DataFrame, DataFrame, int], DataFrame], share: float = 0.9) -> DataFrame:
    """The rows of ``one`` (documents, queries, length of the vectors) for each provider of the catalogue, with its name in front."""
    parts = [one(*load_split(spark, base, p, share), p.dim).select(F.lit(name).alias("provider"), "*") for name, p in sorted(CATALOGUE.items())]
    return reduce(DataFrame.union, parts)


def report(reference: DataFrame, candidates: DataFrame, queries: DataFrame, n_docs: int) -> DataFrame:
    """One row: quantiles of the candidates' share of all documents and of their recall."""
    share = metrics.quantiles(metrics.candidate_share(candidates, queries, n_docs), "share")
    recall = metrics.quantiles(metrics.recall(reference, candidates, queries), "recall")
    return share.toDF(*(f"share_{c}" for c in share.columns)).join(recall.toDF(*(f"recall_{c}" for c in recall.columns)))  # one row each
