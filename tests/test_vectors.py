import numpy as np
import pytest
from helpers import vector_frame
from pyspark.sql import functions as F

from vecspark.functions import kernels
from vecspark.functions import vectors as V
from vecspark.operators import compress
from vecspark.sources import vectors as src

RNG = np.random.default_rng(1)


def rows(df, col="v"):
    return {r["vec_id"]: r[col] for r in df.select("vec_id", col).collect()}


def test_scalar_functions(spark):
    x = np.vstack([RNG.standard_normal((5, 6)), np.zeros(6)])
    df = vector_frame(spark, x)
    got = df.select("vec_id", V.norm("v").alias("n"), V.normalise("v").alias("u"), V.cosine_distance("v", "v").alias("c"), V.squared_l2("v", V.normalise("v")).alias("l")).collect()
    for r in got:
        v = x[r["vec_id"]]
        n = np.linalg.norm(v)
        assert r["n"] == pytest.approx(n)
        assert np.allclose(r["u"], v / (n or 1))
        assert r["c"] == pytest.approx(0 if n else 1)
        assert r["l"] == pytest.approx(((v - v / (n or 1)) ** 2).sum())


@pytest.mark.parametrize("dim", [64, 100, 128])
def test_codes_match_numpy_and_pad_with_zeros(spark, dim):
    x = RNG.standard_normal((7, dim))
    x[0], x[1, ::2], x[2] = 1.0, -0.0, 0.0  # all ones (bit 63 set), negative zero, zero
    df = vector_frame(spark, x)
    assert np.array_equal([rows(df.select("vec_id", V.sign_code("v").alias("c")), "c")[i] for i in range(7)], kernels.pack_bits(x >= 0))
    assert np.array_equal([rows(df.select("vec_id", V.strict_code("v", dim).alias("c")), "c")[i] for i in range(7)], kernels.pack_bits(x > 0))


def test_hamming_is_a_metric(spark):
    c = kernels.pack_bits(RNG.standard_normal((9, 128)) >= 0)
    d = kernels.hamming(c, c)
    assert (d == d.T).all() and (np.diag(d) == 0).all()
    assert (d[:, None, :] <= d[:, :, None] + d[None, :, :]).all()
    df = spark.createDataFrame([(int(i), r.tolist(), c[0].tolist()) for i, r in enumerate(c)], "i int, a array<long>, b array<long>")
    assert {r["i"]: r["h"] for r in df.select("i", V.hamming("a", "b").alias("h")).collect()} == dict(enumerate(d[0].tolist()))


def test_int8_rounds_half_to_even_and_clips(spark):
    steps = [0.5, 1.5, 2.5, -0.5, -1.5, 127.4, 200.0, -128.0, -300.0]
    df = vector_frame(spark, [[s * 2 / 256 for s in steps]])
    assert df.select(V.int8(F.col("v")).alias("q")).first()["q"] == [0, 2, 2, 0, -2, 127, 127, -128, -128]


def test_global_norm_and_centre(spark):
    x = RNG.standard_normal((6, 3))
    df = vector_frame(spark, x)
    got = rows(V.global_normalise(df))
    assert np.allclose([got[i] for i in range(6)], x / np.linalg.norm(x))
    got = rows(V.centre(df))
    assert np.allclose([got[i] for i in range(6)], x - x.mean(0))


def test_rotation_keeps_inner_products():
    q = kernels.rotation(16)
    assert np.allclose(q @ q.T, np.eye(16))
    p = kernels.rotation(16, 5)
    assert p.shape == (16, 5) and np.allclose(p.T @ p, np.eye(5))


def test_pca_matches_numpy_whatever_the_partitioning(spark):
    x = RNG.standard_normal((40, 5)) * [5, 4, 3, 2, 1] + 7
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    for n in (1, 3, 40):
        p = compress.fit_pca(vector_frame(spark, x).repartition(n))
        assert np.allclose(p.mean, x.mean(0)) and np.allclose(p.variance, values)
    got = rows(p.reduce(vector_frame(spark, x), 2))
    assert np.allclose([got[i] for i in range(40)], (x - x.mean(0)) @ p.components[:, :2])
    for factor in (0, -1, 6):
        with pytest.raises(ValueError):
            p.reduce(vector_frame(spark, x), factor)


def test_half_precision(spark):
    x = RNG.standard_normal((3, 4))
    got = rows(compress.half_vectors(vector_frame(spark, x)))
    assert all(np.array_equal(got[i], x[i].astype(np.float16).astype(float)) for i in range(3))
    stored = rows(compress.half_bytes(vector_frame(spark, x)))
    assert all(np.array_equal(np.frombuffer(stored[i], "<f2"), x[i].astype(np.float16)) for i in range(3))


def test_unknown_variant(spark):
    df = vector_frame(spark, np.eye(4))
    with pytest.raises(ValueError):
        compress.variant("fp64", df, df, 4)


def test_loading_checks_vectors(spark, tmp_path):
    for i, bad in enumerate(([1.0, 2.0], None)):
        base = str(tmp_path / str(i))
        spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (1, bad)], "vec_id long, embedding array<float>").write.parquet(f"{base}/e.parquet")
        p = src.Provider("e.parquet", dim=3)
        with pytest.raises(Exception, match="3 dimensions"):
            src.load(spark, base, p).collect()


def test_split_chunks_and_scan_filter(spark):
    df = vector_frame(spark, np.zeros((20, 2))).repartition(3)
    docs, queries = src.split(df)
    assert {r[0] for r in queries.select("vec_id").collect()} == {18, 19} and docs.count() == 18
    assert {r[0] for r in src.chunk(df, 5, 3).select("vec_id").collect()} == {5, 6, 7}


def test_random_vectors_do_not_depend_on_partitions(spark):
    a, b = (rows(src.random_vectors(spark, 50, 3, normal=True).repartition(n)) for n in (1, 7))
    assert a == b
    x = np.array(list(rows(src.random_vectors(spark, 4000, 2, normal=True)).values()))
    assert abs(x.mean()) < 0.05 and abs(x.std() - 1) < 0.05


def test_cluster_files_are_pruned(spark, tmp_path):
    df = spark.createDataFrame([(i, [float(i)], i % 2, i % 3) for i in range(12)], "vec_id long, v array<double>, shard int, cluster int")
    path = str(tmp_path / "clusters")
    src.write_clusters(df, path)
    wanted = spark.createDataFrame([(0, 0), (1, 1)], "shard int, cluster int")
    assert {r["vec_id"] for r in src.read_clusters(spark, path, wanted).collect()} == {i for i in range(12) if (i % 2, i % 3) in ((0, 0), (1, 1))}
    assert src.read_clusters(spark, path).count() == 12


def test_sql_functions(spark):
    V.register(spark)
    r = spark.sql("select vec_dot(array(1D, 2D), array(3D, 4D)) d, vec_l2(array(1D, 2D), array(3D, 4D)) l, vec_norm(array(3D, 4D)) n, vec_hamming(array(1L), array(2L)) h").first()
    assert (r["d"], r["l"], r["n"], r["h"]) == (11.0, 8.0, 5.0, 2)


def test_csv_sink(spark, tmp_path):
    src.write_csv(spark.createDataFrame([(1, 0.5)], "k int, recall double"), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).collect()[0]["recall"] == "0.5"


def test_byte_codes(spark):
    x = RNG.standard_normal((5, 20))
    x[0, :3] = 0.0
    got = rows(vector_frame(spark, x).select("vec_id", V.byte_code("v").alias("c")), "c")
    assert [bytes(got[i]) for i in range(5)] == [np.packbits(r > 0).tobytes() for r in x]
