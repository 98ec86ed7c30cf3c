"""Connected components of an edge table, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm import scratch


def _state(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(h.bitwiseAND(F.lit(0x7FFFFFFF))), F.sum(F.shiftrightunsigned(h, 33))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of each node of ``edges`` (u, v longs); a component is named by its smallest node.

    Each round points the larger neighbours of every node at its smallest one, then the smaller ones,
    which halves distances or better and never adds edges; it ends when a round changes nothing.
    Every round is a written table.  Self-edges and edges with a null end are dropped; an empty table
    gives an empty one.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter(
        F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v"))
    )
    e = scratch.write(e.distinct(), "edges")
    before = _state(e)
    while before[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = large.join(low, F.col("u") == F.col("k")).filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, e = e, scratch.write(small.union(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct(), "edges")
        scratch.drop(last)
        after = _state(e)
        if after == before:
            break
        before = after
    ends = e.groupBy("v").count().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(ends)
