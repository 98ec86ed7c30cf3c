"""Exact and quantised top-k search.

Documents stay where they are read.  Queries go to every task in blocks of bounded size, one block after
the other where they are many; a task scores a block of documents against a block of queries at once and
sends on k rows per query, which a window with a rank limit merges.  Once a task has k documents of each
query, it ranks of later blocks only what is no worse than the k-th.  Where all of a few documents are asked
for, or documents are expected to be few, queries stay instead and documents go to every task.  Ranks are
total: rounded score, then id.  Only ``rerank``, which gets its pairs from elsewhere, fetches documents by id
and so moves them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecspark.functions import kernels
from vecspark.sources.vectors import shared_path

#: Numbers of a block of queries that is sent to every task, and decimals on which scores are ranked.
BLOCK_NUMBERS, DECIMALS = 1 << 21, 6
#: Documents scored at once at most, scores made at once, and queries that are fetched without being counted first.
ROWS, SCORES, FEW = 4096, 1 << 22, 4096
#: Results that a task holds for a block of queries, and results that it ranks at once where all are asked for.
HELD, RANKED = 1 << 21, 1 << 20
FOUND = "query_id long, rank int, vec_id long, score double"

Score = Callable[[np.ndarray, np.ndarray], np.ndarray]


def inner_product(queries: np.ndarray, docs: np.ndarray) -> np.ndarray:
    return queries @ -docs.T


def cosine(queries: np.ndarray, docs: np.ndarray) -> np.ndarray:
    return -(kernels.unit_rows(queries) @ kernels.unit_rows(docs).T)


#: Distances to be made small, and the sign that turns them back into the reported score.
METRICS: dict[str, tuple[Score, float]] = {
    "ip": (inner_product, -1.0), "cosine": (cosine, -1.0), "l2": (kernels.squared_l2, 1.0), "hamming": (kernels.hamming, 1.0),
}


def query_blocks(queries: DataFrame, col: str, numbers: int = BLOCK_NUMBERS, *, most: int = 1 << 62) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of blocks of at most about ``numbers`` numbers and ``most`` rows, by ranges of ids."""
    rows = queries.select("vec_id", col)
    few = rows.limit(FEW + 1).toArrow()
    if few.num_rows <= min(FEW, most) and sum(len(x) for c in few.column(col).chunks for x in [c.flatten()]) <= numbers:
        parts = [few] if few.num_rows else []
    else:
        size = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(col)).alias("d")).first()
        blocks = max(1, -(-size["n"] * size["d"] // numbers), -(-size["n"] // most))
        edges = [] if blocks == 1 else sorted(set(queries.select(F.percentile_approx("vec_id", [i / blocks for i in range(1, blocks)], 10_000)).first()[0]))
        between = zip([None, *edges], [*edges, None])
        parts = (rows.filter((F.lit(low is None) | (F.col("vec_id") > F.lit(low))) & (F.lit(high is None) | (F.col("vec_id") <= F.lit(high)))).toArrow() for low, high in between)
    for part in parts:
        if part.num_rows:
            part = part.sort_by("vec_id").combine_chunks()
            x = part.column(col).combine_chunks()
            yield part.column("vec_id").to_numpy(), kernels.matrix(x, np.int64 if pa.types.is_integer(x.type.value_type) else np.float64)


def over_blocks(queries: DataFrame, col: str, one: Callable[[np.ndarray, np.ndarray], DataFrame], schema: str, k: int = 1) -> DataFrame:
    """The rows that ``one`` makes of each block of queries, so few that ``k`` results of each fit in a task.

    A single block is answered when its rows are asked for.  Several are answered one after the other and
    written, so that the driver never holds more than two of them.
    """
    spark = queries.sparkSession
    blocks = query_blocks(queries, col, most=HELD // max(1, k) if k <= FEW else FEW)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return spark.createDataFrame([], schema)
    if second is None:
        return one(*first)
    path = shared_path(spark, "answers")
    for block in chain((first, second), blocks):
        one(*block).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def best(distance: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of distances the k smallest by (distance, id): (row, column) indices."""
    k = min(k, distance.shape[1])
    if k <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(ids, kind="stable")
    d = distance[:, order]
    if k < d.shape[1]:
        limit = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
        below, at = d < limit, d == limit
        room = k - below.sum(1, keepdims=True)
        keep = below | (at & (np.cumsum(at, axis=1) <= room))
    else:
        keep = np.ones(d.shape, bool)
    row, col = np.nonzero(keep)
    return row, order[col]


class Best:
    """The k best (distance, id) of each query among all that a task has seen; holds a few times that many.

    Where ``k`` is more than ``FEW`` it holds no more than a few times ``HELD``: ``surplus`` gives what is beyond.
    """

    def __init__(self, queries: int, k: int):
        self.room, self.k = 2 * (queries * k if k <= FEW else HELD) + SCORES // 16, k
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held, self.queries = 0, queries
        self.last: tuple[np.ndarray, np.ndarray] | None = None  # (distance, id) of each query's k-th, once all have k

    def add_block(self, distance: np.ndarray, ids: np.ndarray, decimals: int) -> None:
        """Adds what can be among the k best of a block of distances (a row a query) that are not rounded yet.

        Only those no farther than the k-th so far are rounded and compared with it, unless they are more than
        twice the k best of the block.
        """
        if self.last is not None:
            worst, last = self.last
            near = np.flatnonzero(distance <= (worst + 10.0 ** -decimals + 1e-14 * np.abs(worst))[:, None])  # rounding moves by less
            if len(near) <= 2 * self.queries * self.k:
                row, col = np.divmod(near, len(ids))
                d, found = np.round(distance.ravel()[near], decimals) + 0.0, ids[col]
                keep = (d < worst[row]) | ((d == worst[row]) & (found < last[row]))
                self.add(row[keep], d[keep], found[keep])
                return self._settle()
        d = np.round(distance, decimals) + 0.0
        row, col = best(d, ids, self.k)
        self.add(row, d[row, col], ids[col])
        self._settle()

    def _settle(self) -> None:
        """Cuts when k of each query are held for the first time, and whenever twice as many are."""
        if 0 < self.k <= FEW and self.held >= (1 if self.last is None else 2) * self.queries * self.k:
            row, distance, ids = self.cut()
            if self.held == self.queries * self.k:
                self.last = distance[self.k - 1 :: self.k], ids[self.k - 1 :: self.k]

    def add(self, row: np.ndarray, distance: np.ndarray, ids: np.ndarray) -> None:
        self.parts.append((row, distance, ids))
        self.held += len(row)
        if self.held > self.room:
            self.cut()

    def surplus(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """All that is held, if that is too much even after a cut; who merges the tasks' rows cuts again."""
        if self.k > FEW and self.held > HELD:
            yield self.cut()
            self.parts, self.held = [], 0

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        row, distance, ids = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((ids, distance, row))
        row, distance, ids = row[order], distance[order], ids[order]
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, int)
        rank = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
        keep = rank < self.k
        self.parts = [(row[keep], distance[keep], ids[keep])]
        self.held = int(keep.sum())
        return self.parts[0]


def _batch(query_ids: np.ndarray, doc_ids: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(query_ids), pa.array(doc_ids), pa.array(score + 0.0)], names=["query_id", "vec_id", "score"])


def _results(query_ids: np.ndarray, found: tuple[np.ndarray, np.ndarray, np.ndarray], metric: str) -> pa.RecordBatch:
    row, distance, doc_ids = found
    return _batch(query_ids[row], doc_ids, distance * METRICS[metric][1])


def _matrices(ids: np.ndarray, q: np.ndarray, metric: str, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document ids, distances of all queries from them, not rounded), SCORES at once at most."""
    score, dtype = METRICS[metric][0], np.int64 if metric == "hamming" else np.float64
    step = max(1, min(ROWS, SCORES // max(1, len(ids))))
    for b in batches:
        for at in range(0, b.num_rows, step):
            part = b.slice(at, step)
            yield part.column(0).to_numpy(), score(q, kernels.matrix(part.column(1), dtype))


def _local(ids: np.ndarray, q: np.ndarray, metric: str, k: int, decimals: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Best(len(ids), k)
        for doc_ids, distance in _matrices(ids, q, metric, batches):
            found.add_block(distance, doc_ids, decimals)
            for part in found.surplus():
                yield _results(ids, part, metric)
        yield _results(ids, found.cut(), metric)

    return run


def _all_ranked(doc_ids: np.ndarray, docs: np.ndarray, metric: str, k: int, decimals: int):
    """The k best of few documents, which come in order of id, for each query of a task; ``RANKED`` scores at once."""
    score, sign = METRICS[metric]
    step, k = max(1, RANKED // len(doc_ids)), min(k, len(doc_ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                distance = np.round(score(kernels.matrix(part.column(1), docs.dtype), docs).astype(np.float64), decimals) + 0.0
                order = np.argsort(distance, axis=1, kind="stable")[:, :k]
                columns = [np.repeat(part.column(0).to_numpy(), k), np.tile(np.arange(1, k + 1, dtype=np.int32), part.num_rows),
                           doc_ids[order].ravel(), np.take_along_axis(distance, order, 1).ravel() * sign + 0.0]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "rank", "vec_id", "score"])

    return run


def pair_scores(docs: DataFrame, queries: DataFrame, metric: str = "ip", col: str = "v", decimals: int = DECIMALS) -> DataFrame:
    """(query_id, vec_id, score) of every document against every query of a stated set, in blocks."""
    def one(ids: np.ndarray, q: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for doc_ids, distance in _matrices(ids, q, metric, batches):
                score = (np.round(distance.astype(np.float64), decimals) + 0.0).ravel() * METRICS[metric][1]
                yield _batch(np.repeat(ids, len(doc_ids)), np.tile(doc_ids, len(ids)), score)

        return docs.select("vec_id", col).mapInArrow(run, "query_id long, vec_id long, score double")

    return over_blocks(queries, col, one, "query_id long, vec_id long, score double")


def top_k(docs: DataFrame, queries: DataFrame, k: int, metric: str = "ip", col: str = "v", decimals: int = DECIMALS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best documents of each query, fewer where there are fewer.

    Score is the inner product, cosine, squared distance or Hamming distance, rounded; ties go to the
    smaller id.  No queries or k < 1 give no rows.
    """
    def one(ids: np.ndarray, q: np.ndarray) -> DataFrame:
        found = docs.select("vec_id", col).mapInArrow(_local(ids, q, metric, k, decimals), "query_id long, vec_id long, score double")
        return ranked(found, k, metric)

    if k > FEW:
        size = docs.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(col)).alias("d")).first()
        if 0 < size["n"] <= k and size["n"] * size["d"] <= BLOCK_NUMBERS:
            return queries.select("vec_id", col).mapInArrow(_all_ranked(*next(query_blocks(docs, col)), metric, k, decimals), FOUND)
    return over_blocks(queries, col, one, FOUND, k)


def few_top_k(docs: DataFrame, queries: DataFrame, k: int, metric: str = "ip", col: str = "v", decimals: int = DECIMALS) -> DataFrame:
    """What ``top_k`` gives, for documents that are expected to be few: they are fetched and queries stay where they are read.

    Documents that turn out to be many are searched by ``top_k``.
    """
    few = docs.select("vec_id", col).limit(FEW + 1).toArrow().sort_by("vec_id").combine_chunks()
    if few.num_rows > FEW or few.num_rows and len(few.column(col).combine_chunks().flatten()) > BLOCK_NUMBERS:
        return top_k(docs, queries, k, metric, col, decimals)
    if not few.num_rows or k < 1:
        return docs.sparkSession.createDataFrame([], FOUND)
    points = kernels.matrix(few.column(col).combine_chunks(), np.int64 if metric == "hamming" else np.float64)
    return queries.select("vec_id", col).mapInArrow(_all_ranked(few.column("vec_id").to_numpy(), points, metric, k, decimals), FOUND)


def ranked(found: DataFrame, k: int, metric: str) -> DataFrame:
    """The k best rows (query_id, vec_id, score) of each query with their ranks."""
    best_first = F.col("score").asc() if METRICS[metric][1] > 0 else F.col("score").desc()
    return rank_limit(found, k, ["query_id"], [best_first, "vec_id"]).select("query_id", "rank", "vec_id", "score")


def rank_limit(rows: DataFrame, k: int, by: list, order: list) -> DataFrame:
    """Adds rank (int) within ``by`` and keeps ranks up to k; Spark cuts to k rows before and after the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w).cast("int")).filter(F.col("rank") <= k)


def hamming_top_k(docs: DataFrame, queries: DataFrame, k: int, col: str = "code") -> DataFrame:
    """(query_id, rank, vec_id, distance) by Hamming distance of codes."""
    found = top_k(docs, queries, k, "hamming", col)
    return found.select("query_id", "rank", "vec_id", F.col("score").cast("int").alias("distance"))


def _score_pairs(ids: np.ndarray, q: np.ndarray, metric: str):
    """Scores of (query_id, vec_id, v) rows, with the queries at hand."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = q[np.searchsorted(ids, b.column(0).to_numpy())]
                d = kernels.matrix(b.column(2))
                if metric == "cosine":
                    x, d = kernels.unit_rows(x), kernels.unit_rows(d)
                score = ((x - d) ** 2).sum(1) if metric == "l2" else (x * d).sum(1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.round(score, DECIMALS) + 0.0)], names=["query_id", "vec_id", "score"])

    return run


def rerank(candidates: DataFrame, docs: DataFrame, queries: DataFrame, k: int, metric: str = "ip") -> DataFrame:
    """Exact top-k among (query_id, vec_id) candidates: documents are fetched by id, queries come in blocks.

    Where candidates are the members of lists, ``list_top_k`` finds the same without fetching.
    """
    pairs = candidates.select("query_id", "vec_id").distinct()

    def one(ids: np.ndarray, q: np.ndarray) -> DataFrame:
        asked = pairs.filter(F.col("query_id").between(int(ids[0]), int(ids[-1])))
        rows = asked.join(docs.select("vec_id", "v"), "vec_id").select("query_id", "vec_id", "v")
        return ranked(rows.mapInArrow(_score_pairs(ids, q, metric), "query_id long, vec_id long, score double"), k, metric)

    return over_blocks(queries, "v", one, FOUND)


def _in_lists(ids: np.ndarray, q: np.ndarray, askers: dict[int, np.ndarray], metric: str, k: int):
    score = METRICS[metric][0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Best(len(ids), k)
        for b in batches:
            center, doc_ids = b.column(1).to_numpy(), b.column(0).to_numpy()
            order = np.argsort(center, kind="stable")
            lists, first = np.unique(center[order], return_index=True)
            asked = [(c, at) for c, at in zip(lists.tolist(), np.split(order, first[1:])) if c in askers]
            if not asked:
                continue
            x = kernels.matrix(b.column(2))
            for c, at in asked:
                for rows in np.array_split(askers[c], -(-len(askers[c]) * len(at) // SCORES)):
                    distance = np.round(score(q[rows], x[at]).astype(np.float64), DECIMALS) + 0.0
                    row, col = best(distance, doc_ids[at], k)
                    found.add(rows[row], distance[row, col], doc_ids[at[col]])
                    for part in found.surplus():
                        yield _results(ids, part, metric)
        yield _results(ids, found.cut(), metric)

    return run


def list_askers(probes: DataFrame | Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], ids: np.ndarray, q: np.ndarray) -> dict[int, np.ndarray]:
    """The rows of a block of queries that probe each list; ``probes`` as in ``list_top_k``."""
    if isinstance(probes, DataFrame):
        asked = probes.filter(F.col("query_id").between(int(ids[0]), int(ids[-1]))).select("query_id", "center_id").toArrow()  # some lists a query
        row, center = np.searchsorted(ids, asked.column(0).to_numpy()), asked.column(1).to_numpy()
    else:
        row, center = probes(ids, q)
    order = np.lexsort((row, center))
    cuts = np.flatnonzero(np.diff(center[order])) + 1
    return {int(center[p[0]]): row[p] for p in np.split(order, cuts) if len(p)}


def list_top_k(members: DataFrame, probes: DataFrame | Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], queries: DataFrame, k: int, metric: str = "ip", lists: int = 1) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best members (vec_id, center_id, v) of the lists that each query probes.

    ``probes`` is a table (query_id, center_id) or gives (row of the block, center) of a block's ids and
    vectors.  Members stay where they are read: a task scores each list's rows against the queries that
    probe it in one matrix product.  A document may be in up to ``lists`` lists.
    """
    def one(ids: np.ndarray, q: np.ndarray) -> DataFrame:
        askers = list_askers(probes, ids, q)
        rows = members.select("vec_id", "center_id", "v")
        if len(askers) <= FEW:  # reaches the scan, which skips what is not asked for
            rows = rows.filter(F.col("center_id").isin(sorted(askers)))
        found = rows.mapInArrow(_in_lists(ids, q, askers, metric, k * lists), "query_id long, vec_id long, score double")
        return ranked(found.distinct() if lists > 1 else found, k, metric)

    return over_blocks(queries, "v", one, FOUND, k * lists)
