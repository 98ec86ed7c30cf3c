"""Removal of repeated word sequences by recompression.

Words get 128-bit names.  Rounds then name runs of a word and pairs of neighbouring symbols; a pair is
merged when the names' own bits say so, so names are global without a dictionary and equal sequences
get equal symbols, except near their ends.  For each symbol the words that its making depended on
are tracked: a symbol whose dependence lies inside a window is the same in every equal window.

Every window of the given length takes the longest such symbol as its anchor (a window without one is
its own anchor).  Neighbouring windows with one anchor form a segment, about one per ten words, and
only segments are exchanged, dealt by the names of all their words:

- a segment equal to an earlier one holds repeated windows only;
- a segment whose anchor has no other surroundings holds no repeated window besides;
- what is left, a few segments at the ends of repeats, is compared window by window.

Equality is always that of 128-bit names of whole segments or windows.  Each task first compares what
it holds itself and sends the earliest of equals on, so that a passage in a third of all documents is
one row for each task.  Groups are read as sorted runs and never held.  An anchor with very many
surroundings, as a common line has, is dealt to as many tasks as they are: anchors are only counted, and the
few with several surroundings are looked up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.llm import scratch

WINDOW = 20
ROUNDS = 4
#: Words that a task parses at once; longer documents are parsed in overlapping pieces.
CHUNK_WORDS = 1 << 20

_U = np.uint64
_MIX1, _MIX2, _BASE1, _BASE2 = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _MIX2
    x = (x ^ (x >> _U(32))) * _MIX2
    return x ^ (x >> _U(32))


def word_names(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    import xxhash

    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), _U).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


class Segments:
    """Segments of consecutive windows with one anchor: anchor name, 128-bit name of the words, first window, windows."""

    __slots__ = ("anchor", "name1", "name2", "start", "count")

    def __init__(self, *arrays: np.ndarray):
        self.anchor, self.name1, self.name2, self.start, self.count = arrays


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, _U)
    if n:
        p[0] = _U(1)
    return np.multiply.accumulate(p)


def _prefix_names(x: np.ndarray, base: np.uint64):
    """A function naming the words [a, b) for arrays a, b; sums of powers, so equal words get equal names anywhere."""
    inverse = _U(pow(int(base), -1, 1 << 64))
    total = np.concatenate((np.zeros(1, _U), np.add.accumulate(x * _powers(base, len(x)))))
    down = _powers(inverse, len(x) + 1)
    return lambda a, b: _mix((total[b] - total[a]) * down[a])


def parse(x: np.ndarray, piece: np.ndarray, rounds: int = ROUNDS):
    """Symbols of words ``x`` of pieces ``piece`` after naming runs and ``rounds`` rounds of pairs.

    Returns names, first words, ends, and the interval [lo, hi) of words that each symbol depends on.
    """
    n = len(x)
    edge = np.ones(n, bool)
    edge[1:] = (x[1:] != x[:-1]) | (piece[1:] != piece[:-1])
    st = np.flatnonzero(edge)
    en = np.append(st[1:], n)
    run = (en - st).astype(_U)
    name = np.where(run > 1, _mix(x[st] + run * _MIX1), x[st])
    lo, hi, own = st - 1, en + 1, piece[st]  # a run ends where its neighbours differ
    for t in range(rounds):
        coin = _U((t + 1) * int(_MIX1) % (1 << 64))
        right = (_mix(name + coin) >> _U(63)).astype(bool)
        joined = own[1:] == own[:-1]
        first = np.append(~right[:-1] & right[1:] & joined, False)
        second = np.append(False, first[:-1])
        new_lo, new_hi = lo.copy(), hi.copy()
        alone = ~first & ~second
        # one that stays alone depends on the neighbour it might have been merged with
        left_of = np.append(-1, np.where(joined, lo[:-1], st[1:] - 1))
        right_of = np.append(np.where(joined, hi[1:], en[:-1] + 1), n + 1)
        np.copyto(new_lo, np.minimum(lo, left_of), where=alone & right)
        np.copyto(new_hi, np.maximum(hi, right_of), where=alone & ~right)
        i = np.flatnonzero(first)
        name, en = name.copy(), en.copy()
        name[i] = _mix(name[i] * _MIX1 + _mix(name[i + 1] + _U(t + 7)))
        en[i], new_hi[i] = en[i + 1], hi[i + 1]
        keep = ~second
        name, st, en, lo, hi, own = name[keep], st[keep], en[keep], new_lo[keep], new_hi[keep], own[keep]
    return name, st, en, lo, hi


def segments(x1: np.ndarray, x2: np.ndarray, sizes: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS) -> Segments:
    """The segments of consecutive pieces of ``sizes`` words with names ``x1``, ``x2``."""
    n = len(x1)
    ends = np.cumsum(sizes)
    piece = np.repeat(np.arange(len(sizes)), sizes)
    name, st, en, lo, hi = parse(x1, piece, rounds)
    usable = hi - lo <= window
    name, st, en, lo, hi = name[usable], st[usable], en[usable], lo[usable], hi[usable]
    worst = _U(0xFFFFFFFFFFFFFFFF)
    rank = np.full(n + window, worst, _U)
    rank[st] = ((_U(63) - np.minimum(en - st, 63).astype(_U)) << _U(58)) | (_mix(name ^ _MIX1) >> _U(6))
    first_ok, last_ok, named = np.zeros(n + window, np.int64), np.full(n + window, -1, np.int64), np.zeros(n + window, _U)
    first_ok[st], last_ok[st], named[st] = hi - window, lo, name
    valid = np.arange(n) + window <= np.repeat(ends, sizes)
    at = np.flatnonzero(valid)
    best, anchor = np.full(len(at), worst, _U), np.full(len(at), -1, np.int64)
    for o in range(window):
        j = at + o
        better = (rank[j] < best) & (at >= first_ok[j]) & (at <= last_ok[j])
        best[better] = rank[j][better]
        anchor[better] = j[better]
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (anchor[1:] < 0) | (at[1:] != at[:-1] + 1) | (piece[at[1:]] != piece[at[:-1]])
    k = np.flatnonzero(new)
    start, count, pos = at[k], np.diff(np.append(k, len(at))), anchor[k]
    inside = np.where(pos >= 0, pos - start + 1, 0)
    tag = _mix((inside * (2 * window) + count).astype(_U) + _MIX2)
    a, b = start, start + count + window - 1
    name1, name2 = _prefix_names(x1, _BASE1)(a, b) ^ tag, _prefix_names(x2, _BASE2)(a, b) + tag
    return Segments(np.where(pos >= 0, named[pos], name1), name1, name2, start, count)


def window_names(x1: np.ndarray, x2: np.ndarray, at: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    return tuple(_prefix_names(x, base)(at, at + window) for x, base in ((x1, _BASE1), (x2, _BASE2)))


def _earliest(name1, name2, doc, start) -> tuple[np.ndarray, np.ndarray]:
    """Of rows with equal names: indices of the earliest of each, and of those that lie elsewhere than it."""
    order = np.lexsort((start, doc, name2, name1))
    a, b, d, s = name1[order], name2[order], doc[order], start[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    return order[new], order[(d != d[lead]) | (s != s[lead])]


_ROW = "anchor long, name1 long, name2 long, doc long, start int, count int, mark boolean"
_ARROW = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())


def _batch(*arrays, names: str = _ROW, types=_ARROW) -> pa.RecordBatch:
    cols = [x.view(np.int64) if x.dtype == _U else x for x in map(np.asarray, arrays)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[c.split()[0] for c in names.split(", ")])


def _rows(anchor, name1, name2, doc, start, count) -> Iterator[pa.RecordBatch]:
    """What a task sends on: the earliest of equal rows, and as marks, dealt by document, the rest."""
    lead, repeated = _earliest(name1, name2, doc, start)
    yield _batch(anchor[lead], name1[lead], name2[lead], doc[lead], start[lead], count[lead], np.zeros(len(lead), bool))
    zero = np.zeros(len(repeated), np.int64)
    yield _batch(zero, doc[repeated], zero, doc[repeated], start[repeated], count[repeated], np.ones(len(repeated), bool))


def _texts(column: pa.Array) -> Iterator[list[bytes]]:
    for t in column.cast(pa.large_binary()):
        yield (t.as_py() or b"").split()


def _segments(window: int, rounds: int):
    def flush(words, docs, offsets, sizes):
        x1, x2 = word_names(words)
        sizes = np.array(sizes)
        s = segments(x1, x2, sizes, window, rounds)
        piece = np.repeat(np.arange(len(sizes)), sizes)[s.start]
        base = np.array(offsets) - (np.cumsum(sizes) - sizes)
        yield from _rows(s.anchor, s.name1, s.name2, np.array(docs)[piece], s.start + base[piece], s.count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, docs, offsets, sizes = [], [], [], []
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), _texts(b.column(1))):
                for at in range(0, max(len(text) - window + 1, 0), CHUNK_WORDS):
                    part = text[at : at + CHUNK_WORDS + window - 1]
                    words += part
                    docs.append(doc)
                    offsets.append(at)
                    sizes.append(len(part))
                    if len(words) >= CHUNK_WORDS:
                        yield from flush(words, docs, offsets, sizes)
                        words, docs, offsets, sizes = [], [], [], []
        if words:
            yield from flush(words, docs, offsets, sizes)

    return run


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads rows sorted by (names, place): passes on the earliest of each name, and marks the rest as repeats.
    Only the last lead is kept between batches."""
    last = None  # name1, name2, doc, start of the last lead
    for b in batches:
        anchor, name1, name2, doc, start, count, mark = (b.column(i).to_numpy(zero_copy_only=False) for i in range(7))
        yield _out(np.zeros(mark.sum(), np.int64), doc[mark], start[mark], count[mark], np.ones(mark.sum(), bool))
        anchor, name1, name2, doc, start, count = (x[~mark] for x in (anchor, name1, name2, doc, start, count))
        if not len(doc):
            continue
        new = np.ones(len(doc), bool)
        new[1:] = (name1[1:] != name1[:-1]) | (name2[1:] != name2[:-1])
        goes_on = last is not None and (name1[0], name2[0]) == last[:2]
        leads = np.flatnonzero(new)
        own = leads[np.cumsum(new) - 1]
        lead_doc, lead_start = doc[own], start[own]
        if goes_on:
            first = own == 0
            lead_doc, lead_start = np.where(first, last[2], lead_doc), np.where(first, last[3], lead_start)
        again = (doc != lead_doc) | (start != lead_start)
        passed = leads[1:] if goes_on else leads
        yield _out(anchor[passed], doc[passed], start[passed], count[passed], np.zeros(len(passed), bool))
        yield _out(np.zeros(again.sum(), np.int64), doc[again], start[again], count[again], np.ones(again.sum(), bool))
        i = leads[-1]
        if not (goes_on and i == 0):
            last = (name1[i], name2[i], doc[i], start[i])


_MARKS = "anchor long, doc long, start int, count int, mark boolean"


def _out(*arrays) -> pa.RecordBatch:
    return _batch(*arrays, names=_MARKS, types=(_ARROW[0], *_ARROW[3:]))


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, words, at, owner, base, total = [], [], [], [], [], 0
            for row, (doc, text) in enumerate(zip(b.column(0).to_pylist(), _texts(b.column(1)))):
                places = b.column(2)[row].values
                first, count = places.field("start").to_numpy(), places.field("count").to_numpy()
                i = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
                i = i[i + window <= len(text)]
                at.append(i + total)
                owner.append(np.full(len(i), doc, np.int64))
                base.append(np.full(len(i), total, np.int64))
                words += text
                total += len(text)
                if total >= CHUNK_WORDS or row == b.num_rows - 1:
                    i, d, z = np.concatenate(at), np.concatenate(owner), np.concatenate(base)
                    name1, name2 = window_names(*word_names(words), i, window)
                    yield from _rows(name1, name1, name2, d, i - z, np.ones(len(i), np.int64))
                    words, at, owner, base, total = [], [], [], [], 0

    return run


def _keep(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, digest = [], [], []
            for row, text in enumerate(_texts(b.column(1))):
                n, gone = len(text), 0
                places = b.column(2)[row]
                if places.is_valid and n:
                    change = np.zeros(n + 1, np.int64)
                    first = np.minimum(places.values.field("start").to_numpy(), n)
                    np.add.at(change, first, 1)
                    np.add.at(change, np.minimum(first + places.values.field("count").to_numpy() + window - 1, n), -1)
                    covered = np.cumsum(change[:-1]) > 0
                    gone = int(covered.sum())
                    if gone:
                        text = [text[i] for i in np.flatnonzero(~covered)]
                n_words.append(n)
                n_removed.append(gone)
                digest.append((b" ".join(text).decode("utf-8")))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_text"])

    return run


def _sorted_runs(rows: DataFrame) -> DataFrame:
    return rows.repartition("name1").sortWithinPartitions("name1", "name2", "doc", "start").mapInArrow(_resolve, _MARKS)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text of each row.

    A word is removed when a window of ``window`` consecutive words that covers it also starts earlier,
    in a document of smaller id or earlier in the same one.  Words are runs without the six ASCII
    white-space characters; kept ones are joined by a space.  Null and empty texts have no words; texts
    shorter than a window lose nothing.  A null id counts as the largest.  Rows that repeat an id are
    versions of one document: a place in one is a place in each, so equal rows are kept or cut alike.
    An empty table gives an empty result; other columns are not read.
    """
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(9223372036854775807))
    texts = docs.select(order.alias("doc"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    first = scratch.write(_sorted_runs(texts.select("doc", "text").mapInArrow(_segments(window, rounds), _ROW)), "segments")

    def places(rows: DataFrame) -> DataFrame:
        return rows.groupBy("doc").agg(F.collect_list(F.struct("start", "count")).alias("places"))

    leads = first.filter("not mark")
    shared = leads.groupBy("anchor").count().filter("count > 1").select(F.col("anchor").alias("_anchor"))
    shared = scratch.lookup(scratch.write(shared, "shared-anchors"))
    opened = texts.join(places(leads.join(shared, F.col("anchor") == F.col("_anchor"), "left_semi")), "doc").select("doc", "text", "places")
    second = _sorted_runs(opened.mapInArrow(_windows(window), _ROW)).filter("mark")
    marks = places(first.filter("mark").union(second).select("doc", "start", "count"))
    return texts.join(marks, "doc", "left").select("doc_id", "text", "places").mapInArrow(
        _keep(window), "doc_id long, n_words long, n_removed long, kept_text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = f"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS words FROM (SELECT *, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)),
repeated AS MATERIALIZED (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY words ORDER BY doc_id, i) > 1),
gone AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS pos FROM repeated),
cut AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d SEMI JOIN gone USING (doc_id))
  ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id),
hit AS (SELECT DISTINCT doc_id FROM gone)
SELECT d.doc_id, len(w) AS n_words, CASE WHEN hit.doc_id IS NULL THEN 0 ELSE len(w) - coalesce(n, 0) END AS n_removed,
       sha256(CASE WHEN hit.doc_id IS NULL THEN array_to_string(w, ' ') ELSE coalesce(kept, '') END) AS kept_sha256
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN cut USING (doc_id)
"""
