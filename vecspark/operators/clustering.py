"""K-means and greedy k-center.

Both keep their centers on the driver (they are few by definition).  K-means adds up partial sums over
all documents in each round.  Greedy k-center reads the documents in passes: a pass brings the farthest
ones to the driver, a bounded number, which then picks centers among them for as long as none of those
left behind could be farther.  The result is that of picking one by one over the whole table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecspark.functions import kernels
from vecspark.sources.vectors import shared_path

#: Decimals on which squared distances to centroids are compared, and points that a pass of k-center brings to the driver at most.
DECIMALS, PASS_POINTS = 9, 1 << 14


def nearest(x: np.ndarray, centroids: np.ndarray, metric: str = "l2") -> tuple[np.ndarray, np.ndarray]:
    """(label, squared distance) of each row; the lowest centroid on ties of rounded distances."""
    if metric == "hamming":
        d = kernels.hamming(x, centroids)
    else:
        d = np.round(kernels.squared_l2(x, centroids), DECIMALS)
    label = d.argmin(1)
    return label, d[np.arange(len(x)), label]


def assign(vectors: DataFrame, centroids: np.ndarray, col: str = "v", metric: str = "l2") -> DataFrame:
    """(vec_id, label, distance)."""
    kind = np.int64 if metric == "hamming" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                label, d = nearest(kernels.matrix(b.column(1), kind), centroids, metric)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(label.astype(np.int32)), pa.array(d.astype(float))], names=["vec_id", "label", "distance"])

    return vectors.select("vec_id", col).mapInArrow(run, "vec_id long, label int, distance double")


def _partial(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, d = centroids.shape
        n, s, inertia = np.zeros(k, np.int64), np.zeros((k, d)), np.zeros(k)
        for b in batches:
            if b.num_rows:
                x = kernels.matrix(b.column(0))
                label, dist = nearest(x, centroids)
                n += np.bincount(label, minlength=k)
                inertia += np.bincount(label, dist, k)
                np.add.at(s, label, x)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(n[used]), pa.array(inertia[used]), kernels.lists(s[used].reshape(-1, d))], names=["label", "n", "inertia", "sums"])

    return run


def _round(vectors: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    parts = vectors.select("v").mapInArrow(_partial(centroids), "label int, n long, inertia double, sums array<double>")
    width = centroids.shape[1]
    totals = parts.groupBy("label").agg(F.sum("n").alias("n"), F.sum("inertia").alias("inertia"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width))) if width <= 128 else None
    n, s, inertia = np.zeros(len(centroids), np.int64), np.zeros_like(centroids), 0.0
    if totals is not None:
        rows = [(r[0], r[1], r[2], r[3:]) for r in totals.collect()]
    else:  # many columns: by position
        pos = parts.select("label", F.posexplode("sums")).groupBy("label", "pos").agg(F.sum("col").alias("s")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("p"))
        rows = [(r["label"], r["n"], r["inertia"], [x["s"] for x in r["p"]]) for r in parts.groupBy("label").agg(F.sum("n").alias("n"), F.sum("inertia").alias("inertia")).join(pos, "label").collect()]
    for label, count, e, sums in rows:  # one row a cluster
        n[label], s[label] = count, sums
        inertia += e
    return n, s, inertia


def first_rows(vectors: DataFrame, k: int) -> np.ndarray:
    return np.array([r["v"] for r in vectors.orderBy("vec_id").limit(k).collect()])


def random_rows(vectors: DataFrame, k: int, seed: int = 1234) -> np.ndarray:
    return np.array([r["v"] for r in vectors.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(k).collect()])


#: Rounds in which k-means++ draws candidates, twice as many as clusters in each.
DRAWS = 5


def plus_plus(vectors: DataFrame, k: int, seed: int = 1234) -> np.ndarray:
    """Spread-out first centroids, in a few passes whatever ``k``.

    Each pass draws 2 k vectors with probability proportional to the squared distance to those drawn
    before; of all that were drawn, weighted by how many vectors are nearest to each, ``k`` are picked one
    after the other in the same way.  Fewer than ``k`` distinct vectors are repeated.
    """
    drawn = random_rows(vectors, 1, seed)
    for i in range(DRAWS if k > 1 else 0):
        u = (F.pmod(F.xxhash64("vec_id", F.lit(seed), F.lit(i)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        far = assign(vectors, drawn).filter("distance > 0").select("vec_id", (-F.log(u) / F.col("distance")).alias("key")).orderBy("key", "vec_id").limit(2 * k).select("vec_id")
        new = vectors.join(F.broadcast(far), "vec_id").select("vec_id", "v").toArrow().sort_by("vec_id").combine_chunks()  # 2 k rows
        if not new.num_rows:
            break
        drawn = np.vstack([drawn, kernels.matrix(new.column("v").combine_chunks())])
    weight = np.zeros(len(drawn))
    for r in assign(vectors, drawn).groupBy("label").count().collect():  # a row a drawn vector
        weight[r["label"]] = r["count"]
    rng = np.random.default_rng(seed)
    chosen = [int(rng.choice(len(drawn), p=weight / weight.sum()))]
    near = kernels.squared_l2(drawn, drawn[chosen])[:, 0]
    while len(chosen) < k:
        p = weight * np.round(near, DECIMALS)
        chosen.append(int(rng.choice(len(drawn), p=p / p.sum())) if p.sum() > 0 else chosen[0])
        near = np.minimum(near, kernels.squared_l2(drawn, drawn[chosen[-1:]])[:, 0])
    return drawn[chosen]


INIT = {"first": first_rows, "random": random_rows, "k-means++": plus_plus}


def kmeans(vectors: DataFrame, k: int, max_iter: int = 20, tol: float = 1e-4, init: str = "k-means++", reseed: bool = False, seed: int = 1234) -> tuple[np.ndarray, float]:
    """(centroids, inertia).  Stops when the inertia's relative change is within ``tol``.

    An empty cluster keeps its centroid, or with ``reseed`` moves to the documents farthest from theirs.
    """
    if init not in INIT:
        raise ValueError(f"init must be one of {sorted(INIT)}")
    c = INIT[init](vectors, k) if init == "first" else INIT[init](vectors, k, seed)
    before, inertia = np.inf, np.inf
    for _ in range(max_iter):
        n, s, inertia = _round(vectors, c)
        c = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], c)
        if reseed and (n == 0).any():
            far = assign(vectors, c).orderBy(F.desc("distance"), "vec_id").limit(int((n == 0).sum())).select("vec_id")
            found = [r["v"] for r in vectors.join(F.broadcast(far), "vec_id").orderBy("vec_id").select("v").collect()]
            c[np.flatnonzero(n == 0)[: len(found)]] = found
        if np.isfinite(before) and abs(before - inertia) <= tol * max(before, 1e-300):
            break
        before = inertia
    return c, inertia


def inertia(vectors: DataFrame, centroids: np.ndarray) -> float:
    return _round(vectors, centroids)[2]


def centroid_frame(spark, centroids: np.ndarray) -> DataFrame:
    rows = pa.table({"vec_id": pa.array(np.arange(len(centroids))), "v": kernels.lists(np.asarray(centroids, np.float64))})
    return spark.createDataFrame(rows, "vec_id long, v array<double>")


def _lloyd(x: np.ndarray, k: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    c = x[:k].copy()
    for _ in range(rounds):
        label, _ = nearest(x, c)
        for j in range(len(c)):
            if (label == j).any():
                c[j] = x[label == j].mean(0)
    return c, nearest(x, c)[0]


def chunked_kmeans(vectors: DataFrame, chunk_rows: int, k: int, rounds: int = 3, vectors_too: bool = False) -> tuple[DataFrame, DataFrame]:
    """K-means of each chunk of ids on its own, run once and written.

    Returns (center_id, v) and (vec_id, center_id), or with ``vectors_too`` (vec_id, center_id, v), with
    center_id = chunk * k + local number.  A chunk is a range of ``chunk_rows`` ids, which bounds what a task
    holds.
    """
    chunked = vectors.withColumn("chunk", F.expr(f"cast(vec_id div {chunk_rows} as int)"))

    def run(key, table):
        table = table.take(pa.array(np.argsort(table.column("vec_id").to_numpy())))
        x = kernels.matrix(table.column("v").combine_chunks())
        c, label = _lloyd(x, k, rounds)
        first = key[0].as_py() * k
        center = np.concatenate([first + label, first + np.arange(len(c))])
        ids = pa.concat_arrays([table.column("vec_id").combine_chunks(), pa.nulls(len(c), pa.int64())])
        return pa.table({"vec_id": ids, "center_id": pa.array(center.astype(np.int64)), "v": kernels.lists(np.vstack([x, c]))})

    path = shared_path(vectors.sparkSession, "chunks")
    chunked.groupBy("chunk").applyInArrow(run, "vec_id long, center_id long, v array<double>").write.parquet(path)
    rows = vectors.sparkSession.read.parquet(path)
    labels = rows.filter("vec_id is not null")
    return rows.filter("vec_id is null").select("center_id", "v"), labels if vectors_too else labels.select("vec_id", F.col("center_id").cast("int").alias("center_id"))


def _between(metric: str, unit: bool) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Distances of the rows of two blocks, as k-center compares them."""
    if metric == "hamming":
        return kernels.hamming
    if unit:
        return lambda a, b: np.round(2.0 - 2.0 * (a @ b.T), DECIMALS)
    return lambda a, b: np.round(kernels.squared_l2(a, b), DECIMALS)


def _farthest(chosen: dict[int, np.ndarray], group: Callable[[np.ndarray], np.ndarray], between, dtype, most: int):
    """Sends on each group's ``most`` points of this task that are farthest from the centers chosen so far."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

        def cut(d, ids, x):
            order = np.lexsort((ids, -d))[:most]
            return d[order], ids[order], x[order]

        for b in batches:
            if not b.num_rows:
                continue
            ids, x = b.column(0).to_numpy(), kernels.matrix(b.column(1), dtype)
            label = group(x)
            for g in np.unique(label).tolist():
                at = np.flatnonzero(label == g)
                d = between(x[at], chosen[g]).min(1).astype(float) if g in chosen else np.full(len(at), np.inf)
                new = (d, ids[at], x[at])
                best[g] = cut(*(np.concatenate(p) for p in zip(best[g], new))) if g in best else cut(*new)
        for g, (d, ids, x) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), g, np.int64)), pa.array(d), pa.array(ids), kernels.lists(np.ascontiguousarray(x))], names=["g", "d", "vec_id", "x"])

    return run


def farthest_first(
    points: DataFrame, k: int, metric: str = "hamming", col: str = "code", start: int = 0, unit: bool = False,
    group: Callable[[np.ndarray], np.ndarray] | None = None, pass_points: int = PASS_POINTS,
) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(ids, points) of up to ``k`` farthest-first centers of each group of points, exactly as if picked one by one.

    The first center is the one of smallest id (or, without groups, the one at position ``start``); each next
    one is farthest from all before, the smallest id on ties.  Groups (numbers that ``group`` gives a block of
    points; all are one without it) are few and share a pass's points.  On fewer than ``k`` distinct points the
    smallest id is picked again and again, as all distances are 0 then.
    """
    dtype = np.int64 if metric == "hamming" else np.float64
    kind = "array<long>" if metric == "hamming" else "array<double>"
    between, one = _between(metric, unit), group is None
    label = group or (lambda x: np.zeros(len(x), np.int64))
    if k <= 0:
        return {}
    sizes: dict[int, int] = {}
    picked: dict[int, tuple[list[int], np.ndarray]] = {}
    if one:
        first = points.select("vec_id", col).orderBy("vec_id").limit(start + 1).collect()
        if not first:
            return {}
        picked[0] = ([first[-1][0]], np.array([first[-1][1]], dtype))
        sizes[0] = points.count() if k > 1 else 1
    else:
        sizes = _group_sizes(points, col, label, dtype)
    open_ = bool(sizes)
    most = max(1, pass_points // max(1, len(sizes)))
    while open_ and not (one and min(k, sizes[0]) == 1):
        def by_group(batches: Iterator[pa.RecordBatch], done=frozenset(g for g, (i, _) in picked.items() if len(i) >= min(k, sizes[g]))) -> Iterator[pa.RecordBatch]:
            run = _farthest({g: x for g, (_, x) in picked.items()}, label, between, dtype, most)
            for b in run(batches):
                if b.column(0)[0].as_py() not in done:
                    yield b

        found = points.select("vec_id", col).mapInArrow(by_group, f"g long, d double, vec_id long, x {kind}")
        if one:
            found = found.orderBy(F.desc("d"), "vec_id").limit(most)
        else:
            found = found.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("d"), "vec_id"))).filter(F.col("r") <= most).drop("r")
        rows = found.toArrow()
        g_col = rows.column("g").to_numpy()
        open_ = False
        for g in np.unique(g_col).tolist():
            part = rows.filter(pa.array(g_col == g))
            d, ids = part.column("d").to_numpy().copy(), part.column("vec_id").to_numpy()
            x = kernels.matrix(part.column("x").combine_chunks(), dtype)
            whole = len(ids) == sizes[g]
            order = np.lexsort((ids, -d))
            last = (-d[order[-1]], ids[order[-1]])  # nothing left behind is better than this
            chosen, centers = picked.get(g, ([], np.zeros((0, x.shape[1]), dtype)))
            new = []
            while len(chosen) < min(k, sizes[g]):
                top = np.flatnonzero(d == d.max())
                i = top[ids[top].argmin()]
                if not whole and (-d[i], ids[i]) > last:
                    break
                chosen.append(int(ids[i]))
                new.append(x[i])
                d = np.minimum(d, between(x[i : i + 1], x)[0])
            picked[g] = (chosen, np.vstack([centers, *new]).astype(dtype))
            open_ |= len(chosen) < min(k, sizes[g])
    return {g: (np.array(i, np.int64), x) for g, (i, x) in picked.items()}


def _group_sizes(points: DataFrame, col: str, label, dtype) -> dict[int, int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                g, n = np.unique(label(kernels.matrix(b.column(0), dtype)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int64)), pa.array(n.astype(np.int64))], names=["g", "n"])

    return {r["g"]: r["n"] for r in points.select(col).mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).collect()}  # a row a group


def slots(x: np.ndarray, centers: np.ndarray, top: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """(position, distance) of the ``top`` nearest centers of each row, by (distance, position)."""
    d = kernels.hamming(x, centers) if metric == "hamming" else np.round(kernels.squared_l2(x, centers), DECIMALS)
    order = np.argsort(d, axis=1, kind="stable")[:, : min(top, len(centers))]
    return order, np.take_along_axis(d, order, 1)


@dataclass
class Centers:
    """Chosen centers, in order of selection: the points' ids and the centers themselves (few, on the driver)."""

    ids: np.ndarray
    points: np.ndarray
    metric: str = "hamming"
    col: str = "code"

    def frame(self, spark: SparkSession) -> DataFrame:
        """(center_id, vec_id, code or v)."""
        kind = "array<long>" if self.metric == "hamming" else "array<double>"
        return spark.createDataFrame([(i, int(v), c.tolist()) for i, (v, c) in enumerate(zip(self.ids, self.points))], f"center_id long, vec_id long, {self.col} {kind}")

    def first(self, k: int) -> Centers:
        """The first ``k``: what a selection of ``k`` would have given."""
        return Centers(self.ids[:k], self.points[:k], self.metric, self.col)

    def assign(self, points: DataFrame, top: int = 1) -> DataFrame:
        """(vec_id, slot, center_id, distance): the ``top`` nearest centers of each point, by (distance, center)."""
        centers, metric = self.points, self.metric

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows and len(centers):
                    order, d = slots(kernels.matrix(b.column(1), centers.dtype), centers, top, metric)
                    n = order.shape[1]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.repeat(b.column(0).to_numpy(), n)), pa.array(np.tile(np.arange(n, dtype=np.int32), b.num_rows)),
                        pa.array(order.ravel().astype(np.int64)), pa.array(d.ravel().astype(float))], names=["vec_id", "slot", "center_id", "distance"])

        return points.select("vec_id", self.col).mapInArrow(run, "vec_id long, slot int, center_id long, distance double")

    def listed(self, points: DataFrame, top: int = 1) -> DataFrame:
        """(vec_id, lists): the ``top`` nearest centers of each point, as ``assign`` gives them, in one row."""
        centers, metric = self.points, self.metric

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows and len(centers):
                    order = slots(kernels.matrix(b.column(1), centers.dtype), centers, top, metric)[0]
                    yield pa.RecordBatch.from_arrays([b.column(0), kernels.lists(order.astype(np.int64))], names=["vec_id", "lists"])

        return points.select("vec_id", self.col).mapInArrow(run, "vec_id long, lists array<long>")

    def majority(self, points: DataFrame) -> Centers:
        """Each center as the bitwise majority of the codes nearest to it, ties set; counted by task and added up."""
        centers = self.points

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits, n = np.zeros((len(centers), centers.shape[1] * 64), np.int64), np.zeros(len(centers), np.int64)
            for b in batches:
                if b.num_rows:
                    x = kernels.matrix(b.column(0), np.int64)
                    label = nearest(x, centers, "hamming")[0]
                    np.add.at(bits, label, np.unpackbits(np.ascontiguousarray(x).view(np.uint8), axis=1, bitorder="little"))
                    n += np.bincount(label, minlength=len(n))
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used]), kernels.lists(bits[used])], names=["label", "n", "bits"])

        parts = points.select(self.col).mapInArrow(run, "label long, n long, bits array<long>")
        bit = F.element_at(F.col("bits"), F.col("pos") + 1)
        counted = parts.select("label", "n", F.explode(F.sequence(F.lit(0), F.size("bits") - 1)).alias("pos"), "bits").groupBy("label", "pos").agg((F.sum(bit) * 2 >= F.sum("n")).alias("set"))
        rows = counted.toArrow()  # a row a center and bit
        out = centers.copy()
        label, pos, is_set = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("label", "pos", "set"))
        new = np.zeros((len(centers), centers.shape[1] * 64), bool)
        new[label, pos] = is_set
        used = np.unique(label)
        out[used] = kernels.pack_bits(new[used])
        return Centers(self.ids, out, self.metric, self.col)


def kcenter(points: DataFrame, k: int, metric: str = "hamming", col: str = "code", start: int = 0, unit: bool = False, pass_points: int = PASS_POINTS) -> Centers:
    """``k`` greedy centers of all points (vec_id, code or v); see ``farthest_first``."""
    found = farthest_first(points, k, metric, col, start, unit, pass_points=pass_points)
    if not found:
        return Centers(np.zeros(0, np.int64), np.zeros((0, 1), np.int64 if metric == "hamming" else np.float64), metric, col)
    return Centers(*found[0], metric, col)
