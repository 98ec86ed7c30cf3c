"""SimHash near-duplicate detection by a self-join of the fingerprints' binary trie.

Distinct fingerprints form a trie.  Its upper part, down to nodes of at most ``leaf_rows``
fingerprints, is a table; a frontier of node pairs is taken down level by level, adding up the bits
in which two nodes differ and dropping a pair once they exceed the budget.  A leaf meets the leaves it
survived with in one task, where the same traversal goes on to single fingerprints.  A task reports a
spanning forest of its links, never all pairs, so large groups stay linear.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.llm import scratch
from vecspark.llm.graph import connected_components

SHINGLE_WORDS, SEED, MAX_BITS = 3, 42, 2
#: Fingerprints of a leaf at most, and bits that one level of the table takes.
LEAF_ROWS, LEVEL_BITS = 1 << 14, 4
#: Node pairs that a task holds at once.
FRONTIER = 1 << 18
#: Pairs of nodes with at most this many candidate pairs are compared directly.
DIRECT = 16


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of a whole text.

    A-Z are lower-cased; words are runs without the six ASCII white-space characters; shingles repeat
    as often as they occur.  A text of fewer words is one shingle, one without words gives 0.
    """
    import xxhash

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(b" ".join(tokens), SEED)
    whole = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(tokens) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(whole[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist())], dtype="<u8")
    set_bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) with fp the fingerprint as a signed long."""
    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").mapInArrow(_fingerprints, "doc_id long, fp long")


def _within(a: np.ndarray, b: np.ndarray, same: bool, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of two sorted arrays of distinct values that differ in at most ``max_bits`` bits; i < j when ``same``."""
    ones: dict[tuple[int, int], np.ndarray] = {}

    def split(side: int, values: np.ndarray, depth: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        if (side, depth) not in ones:
            bits = ((values >> np.uint64(63 - depth)) & np.uint64(1)).astype(np.int32)
            ones[side, depth] = np.concatenate(([0], np.cumsum(bits, dtype=np.int32)))
        c = ones[side, depth]
        return hi - (c[hi] - c[lo])

    def start(n):
        return np.array([0]), np.array([n])

    todo = [(0, *start(len(a)), *start(len(b)), np.array([0]), np.array([same]))]
    while todo:
        depth, alo, ahi, blo, bhi, diff, own = todo.pop()
        if len(alo) > FRONTIER:
            cut = len(alo) // 2
            todo += [(depth, *(x[s] for x in (alo, ahi, blo, bhi, diff, own))) for s in (slice(cut, None), slice(cut))]
            continue
        small = (ahi - alo) * (bhi - blo) <= DIRECT
        if small.any():
            na, nb = (ahi - alo)[small], (bhi - blo)[small]
            n = na * nb
            first = np.repeat(np.cumsum(n) - n, n)
            k = np.arange(n.sum()) - first
            wide = np.repeat(nb, n)
            i, j = np.repeat(alo[small], n) + k // wide, np.repeat(blo[small], n) + k % wide
            near = (np.bitwise_count(a[i] ^ b[j]) <= max_bits) & (~np.repeat(own[small], n) | (i < j))
            if near.any():
                yield i[near], j[near]
            rest = ~small
            alo, ahi, blo, bhi, diff, own = (x[rest] for x in (alo, ahi, blo, bhi, diff, own))
        if not len(alo):
            continue
        amid, bmid = split(0, a, depth, alo, ahi), split(0 if same else 1, b, depth, blo, bhi)
        children = []
        for x in (0, 1):
            for y in (0, 1):
                cal, cah = (amid, ahi) if x else (alo, amid)
                cbl, cbh = (bmid, bhi) if y else (blo, bmid)
                keep = (cah > cal) & (cbh > cbl) & (diff + (x != y) <= max_bits)
                if (x, y) == (1, 0):
                    keep &= ~own
                children.append((cal[keep], cah[keep], cbl[keep], cbh[keep], diff[keep] + (x != y), own[keep] & (x == y)))
        todo.append((depth + 1, *(np.concatenate(c) for c in zip(*children))))


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the classes of i and j; a class is labelled by its smallest member."""
    while True:
        x, y = label[i], label[j]
        differ = x != y
        if not differ.any():
            return
        i, j, x, y = i[differ], j[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def forest(a: np.ndarray, ra: np.ndarray, b: np.ndarray | None = None, rb: np.ndarray | None = None, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Edges (id, smallest id of its class) of the link graph of sorted fingerprints ``a``, or between ``a`` and ``b``."""
    same = b is None
    ids = ra if same else np.concatenate([ra, rb])
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    label = np.arange(len(ids))
    for i, j in _within(a, a if same else b, same, max_bits):
        _merge(label, rank[i], rank[j if same else j + len(a)])
    linked = np.flatnonzero(label != np.arange(len(ids)))
    return ids[order[linked]], ids[order[label[linked]]]


def _pack_leaf(key, table):
    fp = table.column("fp").to_numpy().view(np.uint64)
    order = np.argsort(fp)
    blob = fp[order].tobytes() + table.column("rep").to_numpy()[order].tobytes()
    return pa.table({"node": pa.array([key[0].as_py()], pa.int64()), "blob": pa.array([blob], pa.binary())})


def _traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads (a, b, blob) sorted by a, then b: a leaf's own blob (b null), then those of the leaves it meets.  Holds one leaf."""
    def unpack(blob):
        x = np.frombuffer(blob.as_buffer(), np.uint64)
        return x[: len(x) // 2], x[len(x) // 2 :].view(np.int64)

    own = ()
    for batch in batches:
        for b, blob in zip(batch.column(1), batch.column(2)):
            if b.is_valid:
                u, v = forest(*own, *unpack(blob))
            else:
                own = tuple(x.copy() for x in unpack(blob))
                u, v = forest(*own)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _prefix(depth: int):
    """The node at ``depth`` above a fingerprint: its first bits behind a leading 1."""
    return F.lit(1).cast("long") if depth == 0 else F.shiftrightunsigned("fp", 64 - depth).bitwiseOR(F.lit(1 << depth))


def upper_trie(points: DataFrame, leaf_rows: int = LEAF_ROWS, level_bits: int = LEVEL_BITS) -> tuple[DataFrame, DataFrame, int]:
    """The trie down to nodes of at most ``leaf_rows`` points.

    Returns the edges (node, child, bits) of inner nodes, the points with their leaf, and the number of levels.
    """
    spark = points.sparkSession
    total = points.count()
    edges = spark.createDataFrame([], "node long, child long, bits long")
    leaf = F.lit(1).cast("long")
    if total <= leaf_rows:
        return edges, points.withColumn("node", leaf), 0
    big = spark.createDataFrame([(1,)], "node long")
    placed, pending, depth = [], points, 0
    while True:
        depth += level_bits
        counts = pending.groupBy(_prefix(depth).alias("child")).count()
        counts = scratch.write(counts, "trie-level")
        edges = edges.union(counts.select(
            F.shiftrightunsigned("child", level_bits).alias("node"), "child", F.col("child").bitwiseAND(F.lit((1 << level_bits) - 1)).alias("bits")))
        big = counts.filter(F.col("count") > leaf_rows).select(F.col("child").alias("node"))
        tagged = pending.withColumn("node", _prefix(depth))
        placed.append(tagged.join(counts.filter(F.col("count") <= leaf_rows).select(F.col("child").alias("node")), "node", "left_semi").select("fp", "rep", "node"))
        if big.isEmpty():
            break
        pending = scratch.write(tagged.join(big, "node", "left_semi").select("fp", "rep"), "trie-pending")
    out = placed[0]
    for p in placed[1:]:
        out = out.union(p)
    return edges, out, depth // level_bits


def node_pairs(spark: SparkSession, edges: DataFrame, levels: int, max_bits: int = MAX_BITS) -> DataFrame:
    """The pairs of leaves (a, b) that at most ``max_bits`` differing bits have not ruled out, each pair once."""
    pairs = spark.createDataFrame([(1, 1, 0)], "a long, b long, diff int")
    for _ in range(levels):
        def down(side: str):
            return edges.select(F.col("node").alias(side), F.col("child").alias(f"{side}_child"), F.col("bits").alias(f"{side}_bits"))

        nxt = pairs.join(down("a"), "a", "left").join(down("b"), "b", "left").select(
            F.coalesce("a_child", "a").alias("x"), F.coalesce("b_child", "b").alias("y"), (F.col("a") == F.col("b")).alias("own"),
            (F.col("diff") + F.coalesce(F.bit_count(F.col("a_bits").bitwiseXOR(F.col("b_bits"))), F.lit(0))).cast("int").alias("diff"))
        nxt = nxt.filter((F.col("diff") <= max_bits) & (~F.col("own") | (F.col("x") <= F.col("y")))).select(F.col("x").alias("a"), F.col("y").alias("b"), "diff")
        last, pairs = pairs, scratch.write(nxt, "node-pairs")
        if hasattr(last, "_scratch_path"):
            scratch.drop(last)
    return pairs


def links(points: DataFrame, max_bits: int = MAX_BITS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Edges (u, v) over the ids ``rep`` of distinct fingerprints ``fp`` that span every class of linked ones."""
    edges, members, levels = upper_trie(points, leaf_rows)
    blobs = scratch.write(members.groupBy("node").applyInArrow(_pack_leaf, "node long, blob binary"), "leaves")
    pairs = node_pairs(points.sparkSession, edges, levels, max_bits).select("a", "b").filter("a <> b")
    met = pairs.join(blobs.select(F.col("node").alias("b"), "blob"), "b").select("a", "b", "blob")
    own = blobs.select(F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), "blob")
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return own.union(met).repartition(n, "a").sortWithinPartitions("a", F.asc_nulls_first("b")).mapInArrow(_traverse, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row.

    Fingerprints link when at most ``max_bits`` bits differ; a component is named by its smallest
    doc_id.  Null, empty and blank texts have fingerprint 0, which links like any other.  A null id
    counts as the largest; a component of null ids only has a null name.  Repeated rows are rows of
    their own.  An empty table gives an empty result; other columns are not looked at.
    """
    rows = scratch.write(fingerprints(docs, id_col, text_col), "fingerprints")
    last = F.lit(9223372036854775807)
    points = scratch.write(rows.groupBy("fp").agg(F.min(F.coalesce("doc_id", last)).alias("rep")), "points")
    component = connected_components(links(points, max_bits, leaf_rows))
    named = points.join(component, points["rep"] == component["node"], "left").select("fp", F.coalesce("component", "rep").alias("component"))
    return rows.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.nullif("component", last).alias("component_id"))


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component, with all their columns.

    Rows that share an id stay if one of them does; rows without an id stay.
    """
    first = F.max(F.col("doc_id").eqNullSafe(F.col("component_id")))
    drop = near_duplicates(docs, id_col, text_col).filter("doc_id is not null").groupBy("doc_id").agg(first.alias("first"))
    drop = scratch.lookup(scratch.write(drop.filter("not first").select(F.col("doc_id").alias("_id")), "near-copies"))
    return docs.join(drop, docs[id_col] == drop["_id"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
