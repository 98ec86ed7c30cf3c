"""NumPy kernels that run in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    """The rows of a list column as a matrix; raises on null or ragged vectors."""
    n = len(column)
    if not n:
        return np.zeros((0, 0), dtype)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if column.null_count or (sizes != sizes[0]).any():
        raise ValueError("vectors must not be null and must all have one length")
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(n, int(sizes[0]))


def lists(x: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    n, d = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(np.ascontiguousarray(x).reshape(-1), kind))


def map_vectors(df: DataFrame, fn: Callable[[np.ndarray], np.ndarray], col: str = "v", keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """Replaces the double vectors of ``col`` by ``fn`` of a block of them; keeps the named columns too."""
    fields = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), lists(fn(matrix(b.column(len(keep)))), pa.float64())], names=[*keep, col])

    schema = ", ".join([*(f"`{c}` {fields[c]}" for c in keep), f"`{col}` array<double>"])
    return df.select(*keep, col).mapInArrow(run, schema)


def rotation(dim: int, bits: int | None = None, seed: int = 0) -> np.ndarray:
    """Random orthonormal columns: (dim, dim), or (dim, bits) for fewer."""
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, bits or dim)))
    return q


def pack_bits(positive: np.ndarray) -> np.ndarray:
    """Boolean rows as 64-bit words, lowest bit first."""
    n, d = positive.shape
    padded = np.zeros((n, -(-d // 64) * 64), bool)
    padded[:, :d] = positive
    return np.packbits(padded, axis=1, bitorder="little").view("<i8")


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances of code rows (n, words) and (m, words)."""
    a, b = a.view(np.uint64), b.view(np.uint64)
    out = np.zeros((len(a), len(b)), np.int32)
    for w in range(a.shape[1]):
        out += np.bitwise_count(a[:, w, None] ^ b[None, :, w])
    return out


def squared_l2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0.0)


def unit_rows(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1.0, n)


def half(x: np.ndarray) -> np.ndarray:
    """Rounded to half precision and back."""
    return x.astype(np.float16).astype(np.float64)


def greedy_centers(distance: Callable[[int], np.ndarray], n: int, k: int, start: int = 0) -> list[int]:
    """Farthest-first selection: each next center is the point farthest from all before, the lowest index on ties.

    On fewer than ``k`` distinct points index 0 is chosen again and again, as every distance is 0 then.
    """
    if not n or k <= 0:
        return []
    chosen, near = [start], distance(start)
    for _ in range(min(k, n) - 1):
        i = int(np.argmax(near))
        chosen.append(i)
        near = np.minimum(near, distance(i))
    return chosen


def majority(codes: np.ndarray) -> np.ndarray:
    """The bitwise majority of code rows, ties set."""
    bits = np.unpackbits(np.ascontiguousarray(codes).view(np.uint8), axis=1, bitorder="little")
    return np.packbits(bits.sum(0) * 2 >= len(codes), bitorder="little").view(codes.dtype)
