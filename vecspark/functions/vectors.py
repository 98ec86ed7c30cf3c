"""Vector functions as Column expressions over array<double>; null in, null out.

They stay inside the JVM and are meant for projections and small pair tables; scoring many pairs is
the block kernels' work (``vecspark.operators.topk``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_l2(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def unit_squared_l2(a, b) -> Column:
    """Squared distance of unit vectors, 2 - 2 a.b."""
    return F.lit(2.0) - F.lit(2.0) * dot(a, b)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def normalise(a) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: x / F.when(n == 0, F.lit(1.0)).otherwise(n))


def cosine_distance(a, b) -> Column:
    n = norm(a) * norm(b)
    return F.lit(1.0) - dot(a, b) / F.when(n == 0, F.lit(1.0)).otherwise(n)


def _pack(a: str, test: str, size: int | None) -> Column:
    words = f"cast(ceil(size({a}) / 64) as int)" if size is None else str(-(-size // 64))
    return F.expr(
        f"transform(sequence(0, {words} - 1), w -> aggregate(sequence(0, 63), 0L, (acc, j) -> "
        f"acc | shiftleft(cast(coalesce(get({a}, w * 64 + j) {test}, false) as bigint), j)))"
    )


def sign_code(a: str, size: int | None = None) -> Column:
    """Sign bits (x >= 0) of array column ``a`` in 64-bit words, lowest bit first, the last one padded with zeros."""
    return _pack(a, ">= 0", size)


def strict_code(a: str, size: int | None = None) -> Column:
    """As ``sign_code`` with x > 0."""
    return _pack(a, "> 0", size)


def hamming(a, b) -> Column:
    """Differing bits of two codes (arrays of longs)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def int8(a, bits: int = 8) -> Column:
    """Steps of 2 / 2^bits, rounded half to even and clipped to the signed range."""
    width, low, high = 2.0 / (1 << bits), -(1 << (bits - 1)), (1 << (bits - 1)) - 1
    return F.transform(a, lambda x: F.greatest(F.least(F.rint(x / width), F.lit(float(high))), F.lit(float(low))).cast("byte"))


def quantisation_error(a) -> Column:
    """Distance of a projection from its signs (+1, -1), relative to the signs' length."""
    signs = F.transform(a, lambda x: F.when(x >= 0, 1.0).otherwise(-1.0))
    return F.sqrt(squared_l2(a, signs)) / F.sqrt(F.size(a).cast("double"))


def global_normalise(df: DataFrame, col: str = "v") -> DataFrame:
    """Divides all vectors by the norm of the whole table (one scalar, joined as one row)."""
    total = df.agg(F.sqrt(F.sum(dot(col, col))).alias("_n"))
    return df.crossJoin(F.broadcast(total)).withColumn(col, F.transform(col, lambda x: x / F.col("_n"))).drop("_n")


def means(df: DataFrame, col: str = "v") -> DataFrame:
    """(pos, mean) of each dimension."""
    return df.select(F.posexplode(col)).groupBy("pos").agg(F.avg("col").alias("mean"))


def centre(df: DataFrame, col: str = "v") -> DataFrame:
    """Subtracts the table's mean vector, a single row."""
    mean = means(df, col).agg(F.array_sort(F.collect_list(F.struct("pos", "mean"))).alias("_m")).select(F.col("_m.mean").alias("_m"))
    return df.crossJoin(F.broadcast(mean)).withColumn(col, F.zip_with(col, "_m", lambda x, m: x - m)).drop("_m")


def register(spark: SparkSession) -> None:
    """SQL functions vec_dot, vec_l2, vec_norm, vec_hamming over arrays (temporary, expanded by the analyser)."""
    for name, out, body in (
        ("vec_dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>)", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
        ("vec_l2(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>)", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)"),
        ("vec_norm(a ARRAY<DOUBLE>)", "DOUBLE", "sqrt(aggregate(transform(a, x -> x * x), 0D, (s, x) -> s + x))"),
        ("vec_hamming(a ARRAY<BIGINT>, b ARRAY<BIGINT>)", "INT", "aggregate(zip_with(a, b, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} RETURNS {out} RETURN {body}")


def byte_code(a: str) -> Column:
    """Bits x > 0 as bytes, highest bit first, padded with zeros to whole bytes."""
    one = f"lpad(hex(aggregate(sequence(0, 7), 0, (acc, j) -> acc * 2 + int(coalesce(get({a}, b * 8 + j) > 0, false)))), 2, '0')"
    return F.expr(f"unhex(array_join(transform(sequence(0, cast(ceil(size({a}) / 8) as int) - 1), b -> {one}), ''))")
