"""Compression: rotation, sign and LSH codes, int8, half precision, PCA, and the named variants of search."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.functions import kernels
from vecspark.functions import vectors as V
from vecspark.operators.topk import top_k


def project(vectors: DataFrame, matrix: np.ndarray) -> DataFrame:
    """(vec_id, v): vectors times ``matrix``, in Arrow blocks; the matrix is dim x dim at most."""
    return kernels.map_vectors(vectors, lambda x: x @ matrix)


def rotate(vectors: DataFrame, dim: int, bits: int | None = None, seed: int = 0) -> DataFrame:
    return project(vectors, kernels.rotation(dim, bits, seed))


def binary_codes(vectors: DataFrame, dim: int, bits: int | None = None, seed: int = 0, strict: bool = False) -> DataFrame:
    """(vec_id, code): signs after a random rotation (or a projection to fewer ``bits``), packed into longs."""
    make = V.strict_code if strict else V.sign_code
    return rotate(vectors, dim, bits, seed).select("vec_id", make("v", bits or dim).alias("code"))


def int8_vectors(vectors: DataFrame, dim: int, bits: int = 8, seed: int = 0) -> DataFrame:
    """(vec_id, q array<tinyint>) after a random rotation."""
    return rotate(vectors, dim, None, seed).select("vec_id", V.int8(F.col("v"), bits).alias("q"))


def half_vectors(vectors: DataFrame) -> DataFrame:
    """Values rounded to half precision, held as doubles."""
    return kernels.map_vectors(vectors, kernels.half)


def half_bytes(vectors: DataFrame) -> DataFrame:
    """(vec_id, v binary): two bytes a dimension, for storage."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r.astype("<f2").tobytes() for r in kernels.matrix(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], names=["vec_id", "v"])

    return vectors.select("vec_id", "v").mapInArrow(run, "vec_id long, v binary")


@dataclass
class PCA:
    mean: np.ndarray
    components: np.ndarray  # (dim, dim), columns by falling variance
    variance: np.ndarray

    def reduce(self, vectors: DataFrame, factor: int = 1) -> DataFrame:
        """Centred vectors on the first dim // factor components."""
        w = self.components[:, : reduced(len(self.mean), factor)]
        mean = self.mean
        return kernels.map_vectors(vectors, lambda x: (x - mean) @ w)


def reduced(dim: int, factor: int) -> int:
    if factor <= 0:
        raise ValueError("the factor must be positive")
    if dim // factor < 1:
        raise ValueError("the factor leaves no dimension")
    return dim // factor


def moments(vectors: DataFrame, fan_in: int = 16) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, sum and second moments, added up in a tree so that no task gets more than ``fan_in`` partial matrices."""
    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, g = 0, None, None
        for b in batches:
            if b.num_rows:
                x = kernels.matrix(b.column(0))
                n, s, g = n + len(x), x.sum(0) + (0 if s is None else s), x.T @ x + (0 if g is None else g)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([np.concatenate([s, g.ravel()]).tobytes()], pa.binary())], names=["n", "m"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, m = 0, 0.0
        for b in batches:
            for i, blob in zip(b.column(0).to_pylist(), b.column(1)):
                n, m = n + i, m + np.frombuffer(blob.as_buffer())
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([m.tobytes()], pa.binary())], names=["n", "m"])

    parts = vectors.select("v").mapInArrow(start, "n long, m binary")
    width = vectors.rdd.getNumPartitions()
    while width > fan_in:
        width = -(-width // fan_in)
        parts = parts.repartition(width).mapInArrow(add, "n long, m binary")
    rows = parts.collect()  # at most fan_in rows
    if not rows:
        raise ValueError("no vectors to fit on")
    m = sum(np.frombuffer(r["m"]) for r in rows)
    d = int((np.sqrt(4 * len(m) + 1) - 1) / 2)
    return sum(r["n"] for r in rows), m[:d], m[d:].reshape(d, d)


def fit_pca(vectors: DataFrame) -> PCA:
    """Principal components of the documents; signs make each component's largest entry positive."""
    n, s, g = moments(vectors)
    return pca_of(s / n, (g - np.outer(s, s) / n) / max(n - 1, 1))


def pca_of(mean: np.ndarray, covariance: np.ndarray) -> PCA:
    values, w = np.linalg.eigh((covariance + covariance.T) / 2)
    values, w = values[::-1], w[:, ::-1]
    signs = np.sign(w[np.abs(w).argmax(0), np.arange(w.shape[1])])
    return PCA(mean, w * np.where(signs == 0, 1, signs), values)


#: Names of variants: precision, and in which order PCA and int8 are applied.
VARIANTS = ("fp32", "fp16", "fp32_int8", "fp16_int8", "fp32_pca4", "fp16_pca4", "fp32_int8_pca4", "fp16_int8_pca4", "fp32_pca4_int8", "fp16_pca4_int8")


def variant(name: str, docs: DataFrame, queries: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """Documents and queries after a variant's steps, in the order of its name; "int8_pca4" quantises first."""
    precision, *steps = name.split("_")
    for step in steps:
        if step == "int8":
            def to_int8(x: DataFrame, d: int = dim) -> DataFrame:
                return rotate(x, d).select("vec_id", F.transform(V.int8(F.col("v")), lambda q: q.cast("double")).alias("v"))

            docs, queries = to_int8(docs), to_int8(queries)
        elif step.startswith("pca"):
            factor = int(step[3:])
            model = fit_pca(docs)
            docs, queries, dim = model.reduce(docs, factor), model.reduce(queries, factor), reduced(dim, factor)
        else:
            raise ValueError(f"no such step: {step}")
    if precision == "fp16":
        docs, queries = half_vectors(docs), half_vectors(queries)
    elif precision != "fp32":
        raise ValueError(f"no such precision: {precision}")
    return docs, queries


def search_variant(name: str, docs: DataFrame, queries: DataFrame, k: int, dim: int) -> DataFrame:
    return top_k(*variant(name, docs, queries, dim), k)
