"""Toxicity scores from the nearest labelled examples.

Terms (words and their beginnings) that are likelier among toxic examples make the vocabulary, all of them.
A text is its TF-IDF vector over the vocabulary: document frequencies are counted over all documents, and a
term weighs the more the farther it leans to the toxic label, so that terms that lean by chance hardly count.
Neighbours are exact by cosine: examples are laid out in blocks, an inverted index keeps each term's postings
block by block with the largest weight of each, and only those blocks' postings are read whose bound can
still reach a nearer neighbour.  Votes weighted by similarity are calibrated on the examples themselves, each
without its own vote.  Examples with one vector are one entry with their mean label.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.llm import scratch

#: Labelled rows that are learned from at most.
SAMPLE_ROWS = 20_000
#: A term must occur in so many sample rows, and be so many times likelier among toxic ones.
MIN_ROWS, MIN_LIFT = 3, 1.5
#: The power of a term's lean (log-likelihood ratio) in its weight; chosen by cross-validation on learning rows.
LEAN = 1.5
NEIGHBOURS, BLOCK, FIRST_BLOCKS, SHARPNESS = 24, 64, 8, 4.0
PREFIXES = (5, 6, 7)
THRESHOLD = 0.3
CACHE = 300_000

_WORD = re.compile(r"\w+")


def terms_of(word: str) -> list[str]:
    """The terms of a lower-case word: itself, and its beginnings (marked by a dash)."""
    return [word] + [f"{word[:n]}-" for n in PREFIXES if len(word) > n]


def _bag(text: str | None) -> Counter:
    return Counter(_WORD.findall((text or "").lower()))


class Featurizer:
    """Counts of the chosen terms in a text, as ids in order and their counts."""

    def __init__(self, terms: list[str]):
        self.ids = {t: i for i, t in enumerate(terms)}
        self.known: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        counts: dict[int, int] = {}
        known, ids = self.known, self.ids
        for word, n in _bag(text).items():
            found = known.get(word)
            if found is None:
                if len(known) > CACHE:
                    known.clear()
                found = known[word] = tuple(ids[t] for t in terms_of(word) if t in ids)
            for i in found:
                counts[i] = counts.get(i, 0) + n
        at = np.fromiter(counts, np.int32, len(counts))
        order = np.argsort(at)
        return at[order], np.fromiter(counts.values(), np.int32, len(counts))[order]


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(v) for v in values], dtype=np.int32)))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*values, np.zeros(0, np.int32)]), pa.int32()))


def _arrays(column: pa.Array) -> list[np.ndarray]:
    """The rows of a list column."""
    if not len(column):
        return []
    ends = column.offsets.to_numpy()
    return np.split(column.values.to_numpy()[ends[0] : ends[-1]], ends[1:-1] - ends[0])


@dataclass
class BlockMaxIndex:
    """An inverted index of unit vectors whose postings are grouped by blocks of ``BLOCK`` entries.

    An entry is a vector with the number of examples that have it, how many of them are toxic, and the
    smallest of their ids.
    """

    scale: np.ndarray  # of each term: inverse document frequency times lean
    count: np.ndarray
    toxic: np.ndarray
    doc_id: np.ndarray
    entry: np.ndarray  # postings by term, then entry
    weight: np.ndarray
    cells: np.ndarray  # where a term's cells begin; a cell is the postings of a term in a block
    block: np.ndarray  # of each cell: its block, its largest weight, and where its postings begin
    most: np.ndarray
    begin: np.ndarray

    @staticmethod
    def vector(ids: np.ndarray, counts: np.ndarray, scale: np.ndarray) -> np.ndarray:
        w = (1 + np.log(counts)) * scale[ids]
        norm = math.sqrt(float(w @ w))
        return w / norm if norm else w

    @classmethod
    def build(cls, ids: list[np.ndarray], counts: list[np.ndarray], labels: np.ndarray, doc_ids: np.ndarray, scale: np.ndarray) -> tuple[BlockMaxIndex, np.ndarray]:
        """From examples' term ids, counts, labels and ids; also returns the entry of each.  Vectors with like leading terms share blocks."""
        members: dict[bytes, list[int]] = {}
        for r, (i, n) in enumerate(zip(ids, counts)):
            members.setdefault(i.tobytes() + n.tobytes(), []).append(r)
        groups = list(members.values())
        vectors = [cls.vector(ids[g[0]], counts[g[0]], scale) for g in groups]
        leading = [ids[g[0]][np.argsort(-v.round(12), kind="stable")[:3]].tolist() for g, v in zip(groups, vectors)]
        whole = [np.column_stack([ids[g[0]], counts[g[0]]]).astype(">u4").tobytes() for g in groups]  # compare as their numbers do
        order = sorted(range(len(groups)), key=lambda k: (leading[k], whole[k]))
        groups, vectors = [groups[k] for k in order], [vectors[k] for k in order]
        none = np.zeros(0, np.int32)
        term = np.concatenate([*(ids[g[0]] for g in groups), none])
        weight = np.concatenate([*vectors, np.zeros(0)])
        entry = np.repeat(np.arange(len(groups), dtype=np.int32), [len(v) for v in vectors])
        by = np.argsort(term, kind="stable")
        term, weight, entry = term[by], weight[by], entry[by]
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (entry[1:] // BLOCK != entry[:-1] // BLOCK)
        first = np.flatnonzero(new)
        index = cls(
            scale, np.array([len(g) for g in groups], float), np.array([labels[g].sum() for g in groups], float), np.array([doc_ids[g].min() for g in groups], np.int64), entry, weight,
            np.searchsorted(term[first], np.arange(len(scale) + 1)), entry[first] // BLOCK, np.maximum.reduceat(weight, first) if len(first) else np.zeros(0), np.append(first, len(term)))
        own = np.zeros(len(ids), np.int64)
        for e, g in enumerate(groups):
            own[g] = e
        return index, own

    @staticmethod
    def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The numbers of all ranges [begin, begin + size), one behind the other."""
        ends = np.cumsum(size)
        return np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)

    def _cosines(self, cells: np.ndarray, q: np.ndarray) -> np.ndarray:
        """What the postings of ``cells``, and no others, add to the cosines of all entries."""
        size = self.begin[cells + 1] - self.begin[cells]
        at = self._ranges(self.begin[cells], size)
        return np.bincount(self.entry[at], self.weight[at] * np.repeat(q, size), len(self.count))

    def nearest(self, ids: np.ndarray, counts: np.ndarray, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """The k entries of the largest cosine above zero (ties: the lower position) and their cosines.

        The blocks of the largest bounds are scored first; then all whose bound reaches the k-th cosine found.
        Postings of other blocks are not read.
        """
        q = self.vector(ids, counts, self.scale)
        size = self.cells[ids + 1] - self.cells[ids]
        cells, q = self._ranges(self.cells[ids], size), np.repeat(q, size)
        block = self.block[cells]
        bound = np.bincount(block, q * self.most[cells], -(-len(self.count) // BLOCK))
        first = np.zeros(len(bound), bool)
        first[np.argsort(-bound, kind="stable")[:FIRST_BLOCKS]] = True
        now = first[block]
        s = self._cosines(cells[now], q[now])
        hit = np.flatnonzero(s > 0)
        floor = np.partition(s[hit], len(hit) - k)[len(hit) - k] if len(hit) > k else 0.0
        rest = (~first & (bound > 0) & (bound >= floor - 1e-9))[block]
        if rest.any():
            s += self._cosines(cells[rest], q[rest])
            hit = np.flatnonzero(s > 0)
        if len(hit) > 4 * k:
            hit = hit[s[hit] >= np.partition(s[hit], len(hit) - k)[len(hit) - k] - 1e-9]
        best = hit[np.lexsort((hit, -s[hit].round(9)))[:k]]
        return best, s[best]

    def vote(self, found: np.ndarray, cosines: np.ndarray, own: int = -1, label: int = 0) -> float:
        """The weighted share of toxic examples, drawn a little towards the share of all; without one example of entry ``own``."""
        n, t = self.count[found], self.toxic[found]
        n, t = n - (found == own), t - label * (found == own)
        w = cosines**SHARPNESS
        return float((w @ t + 0.05 * self.toxic.sum() / self.count.sum()) / (w @ n + 0.05))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares fit of y on x."""
    order = np.argsort(x, kind="stable")
    level: list[list[float]] = []  # mean, weight, first x, last x
    for a, b in zip(x[order], y[order]):
        level.append([b, 1.0, a, a])
        while len(level) > 1 and (level[-2][0] >= level[-1][0] or level[-2][3] == level[-1][2]):
            m, w, _, last = level.pop()
            p = level[-1]
            p[0], p[1], p[3] = (p[0] * p[1] + m * w) / (p[1] + w), p[1] + w, last
    return np.array([v for p in level for v in (p[2], p[3])]), np.array([p[0] for p in level for _ in (0, 1)])


@dataclass
class Calibration:
    """From votes to scores, and the score of a text that has none of the terms."""

    knots: tuple[np.ndarray, np.ndarray]
    without_terms: float

    def score(self, index: BlockMaxIndex | None, ids: np.ndarray, counts: np.ndarray) -> tuple[float, list[tuple[int, float, float]]]:
        if not len(ids) or index is None:
            return self.without_terms, []
        found, cosines = index.nearest(ids, counts)
        if not len(found):
            return self.without_terms, []
        value = float(np.interp(index.vote(found, cosines), *self.knots))
        return value, [(int(index.doc_id[i]), float(s), float(index.toxic[i] / index.count[i])) for i, s in zip(found[:5], cosines[:5])]


def is_held_out(doc_id):
    """Whether the row is never learned from: crc32 of the id's text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text")


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, toxic = Counter(), Counter()
        for text, y in zip(b.column(0), b.column(1).to_pylist()):
            found = {t for w in _bag(text.as_py()) for t in terms_of(w)}
            rows.update(found)
            if y:
                toxic.update(found)
        yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.string()), pa.array(list(rows.values()), pa.int64()), pa.array([toxic[t] for t in rows], pa.int64())], names=["term", "n", "t"])


def choose_terms(sample: DataFrame) -> dict[str, float]:
    """All terms that are likelier among toxic examples and how far each leans (log-likelihood ratio), from (text, toxic) rows."""
    rows, toxic = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not toxic or toxic == rows:
        return {}
    counts = sample.select("text", "toxic").mapInArrow(_term_rows, "term string, n long, t long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    share = toxic / rows

    def part(o, e):
        return F.when(o > 0, o * F.log(o / e)).otherwise(0.0)

    n, t = F.col("n"), F.col("t")
    lean = part(t, n * share) + part(n - t, n * (1 - share)) + part(toxic - t, (rows - n) * share) + part(rows - n - toxic + t, (rows - n) * (1 - share))
    chosen = counts.filter((n >= MIN_ROWS) & (t > MIN_LIFT * share * n)).select("term", F.greatest(F.round(lean, 9), F.lit(0.0)).alias("lean"))
    got = chosen.toArrow().sort_by("term")  # bounded by the sample's words
    return dict(zip(got.column("term").to_pylist(), got.column("lean").to_pylist()))


def _featurize(terms: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Featurizer(terms)
        for b in batches:
            rows = [f(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), _lists([i for i, _ in rows]), _lists([n for _, n in rows])], names=["doc_id", "ids", "counts"])

    return run


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, toxic) of at most ``sample_rows`` labelled rows outside the held-out fold, those of smallest hashed id; of rows that repeat an id one."""
    marked = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marked = marked.filter(~is_held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # at most sample_rows ids and labels, 16 bytes each: a bounded broadcast
    rows = _text(docs, id_col, text_col).join(F.broadcast(marked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    return scratch.write(rows, "labelled")


def _examples(features: DataFrame, sample: DataFrame) -> pa.Table:
    """(doc_id, toxic, ids, counts) of the examples, by id, at most as many as the sample has rows."""
    found = features.join(F.broadcast(sample.select("doc_id", "toxic")), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct("ids", "counts")).alias("f"))
    return found.select("doc_id", "toxic", "f.*").toArrow().sort_by("doc_id").combine_chunks()


def _own_votes(shared):
    """The vote on each example without its own part in it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            out = [index.vote(*index.nearest(i, n), e, y) for i, n, e, y in zip(_arrays(b.column(0)), _arrays(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.float64()), b.column(3)], names=["vote", "toxic"])

    return run


def fit(features: DataFrame, sample: DataFrame, terms: dict[str, float]):
    """(the broadcast index or None, its calibration); terms are weighted by document frequencies over all rows of ``features``."""
    spark = features.sparkSession
    rows = _examples(features, sample)
    toxic = rows.column("toxic").to_numpy().astype(float)
    prior = (toxic.sum() + 0.1) / (len(toxic) + 1)
    if not terms:
        return None, Calibration((np.array([0.0, 1.0]), np.array([prior, prior])), prior)
    df = np.zeros(len(terms))
    counted = features.select(F.explode("ids").alias("id")).groupBy("id").count().toArrow()  # a row a term
    df[counted.column("id").to_numpy()] = counted.column("count").to_numpy()
    scale = (np.log((1 + features.count()) / (1 + df)) + 0.1) * np.array([terms[t] for t in sorted(terms)]) ** LEAN
    has = np.array([x > 0 for x in rows.column("ids").combine_chunks().value_lengths().to_pylist()], bool)
    none = toxic[~has]
    rows, toxic = rows.filter(pa.array(has)).combine_chunks(), toxic[has]
    ids, counts = (rows.column(c).combine_chunks() for c in ("ids", "counts"))
    index, entry = BlockMaxIndex.build(_arrays(ids), _arrays(counts), toxic, rows.column("doc_id").to_numpy(), scale)
    shared = spark.sparkContext.broadcast(index)  # bounded by the sample and its terms
    own = spark.createDataFrame(pa.table([ids, counts, pa.array(entry), pa.array(toxic)], names=["ids", "counts", "entry", "toxic"]))
    votes = own.repartition(spark.sparkContext.defaultParallelism).mapInArrow(_own_votes(shared), "vote double, toxic double").toArrow().sort_by([("vote", "ascending"), ("toxic", "ascending")])
    x, v = isotonic(votes.column("vote").to_numpy(), votes.column("toxic").to_numpy())
    return shared, Calibration((x, np.clip(v, 0.001, 0.999)), (none.sum() + 0.1) / (len(none) + 1))


def _score(shared, calibration: Calibration):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None if shared is None else shared.value
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.float64())]))
        for b in batches:
            out = [calibration.score(index, i, n) for i, n in zip(_arrays(b.column(1)), _arrays(b.column(2)))]
            evidence = [[{"doc_id": d, "cosine": s, "toxic": y} for d, s, y in e] for _, e in out]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s for s, _ in out], pa.float64()), pa.array(evidence, kind)], names=["doc_id", "score", "evidence"])

    return run


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence of each row; evidence is the five nearest entries
    (an example's id, the cosine, the share of toxic examples with that vector).

    Texts are read once for the terms and once, after choosing them, for all vectors; scoring reads only
    those.  A text without any of the terms, also a null or empty one, gets the share of toxic examples
    among those without terms.  Labels without an id or a value are not learned from; of several for one
    id the toxic one counts; without labels of either kind every text gets the same score.  Repeated rows
    and null ids (never held out) are kept; an empty table gives an empty result; other columns are not read.
    """
    sample = labelled(docs, labels, id_col, text_col, sample_rows)
    terms = choose_terms(sample)
    features = scratch.write(_text(docs, id_col, text_col).mapInArrow(_featurize(sorted(terms)), "doc_id long, ids array<int>, counts array<int>"), "features")
    rows = features.mapInArrow(_score(*fit(features, sample, terms)), "doc_id long, score double, evidence array<struct<doc_id: long, cosine: double, toxic: double>>")
    return rows.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
