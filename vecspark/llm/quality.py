"""Quality scores without labels: heuristic labellers, their accuracies by EM, and a hashed linear scorer.

Each labeller votes good, bad or abstains.  Rows are counted by vote pattern, at most three to the
power of the number of labellers whatever the input, and EM over the counts estimates how often each
labeller says what of good and bad texts.  The posterior labels of a bounded sample train a logistic
scorer over hashed word shapes, which then scores every text.  Texts are read once: votes and features,
some twenty numbers a text, are written, and fitting and scoring read those.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.llm import scratch

#: Rows whose posterior labels train the scorer at most (those of smallest hashed id), and its features.
SAMPLE_ROWS, FEATURES = 20_000, 1 << 13
ROUNDS, STEPS, RATE, RIDGE = 100, 200, 0.1, 1e-5
#: Texts of fewer words get no vote from most labellers.
FEW_WORDS = 8
KEEP = 0.5
GOOD, BAD, NONE = 1, 0, 2

_SYMBOLS = re.compile(r"[#$%&*@~^=<>{}\\]{2,}|[!?]{2,}")
#: A word of lower-case Latin letters, perhaps a capital before and a mark behind.
_COMMON = re.compile("([A-ZÀ-ÖØ-Þ]?)([a-zß-öø-ÿ]+)([.,;:!?]?)")
#: What a word can be, as bits.
SYMBOLS, CAPITALS, SEPARATOR, END, PLAIN = 1, 2, 4, 8, 16
CACHE_WORDS = 300_000
_kinds: dict[str, int] = {}


def kinds(w: str) -> int:
    """SYMBOLS: runs of symbols.  CAPITALS: throughout.  SEPARATOR: no letter or digit.  END: ends a clause or
    sentence.  PLAIN: lower-case letters, but for the first and last character."""
    if _COMMON.fullmatch(w):  # as below, sooner
        return PLAIN | (END if w[-1] in ".,;:" else 0)
    return (
        SYMBOLS * bool(_SYMBOLS.search(w)) | CAPITALS * (len(w) > 1 and w.isupper()) | SEPARATOR * (not any(map(str.isalnum, w)))
        | END * (w[-1] in ".,;:" and w[:-1].isalpha()) | PLAIN * (w[0].isalpha() and (len(w) < 3 or w[1:-1].isalpha() and w[1:-1].islower()))
    )


class Text:
    """What labellers look at: the words, how often each occurs, and the share of words of each kind."""

    def __init__(self, text: str | None):
        self.words = (text or "").split()
        self.n = len(self.words)
        self.counts = Counter(self.words)
        if len(_kinds) > CACHE_WORDS:
            _kinds.clear()
        total: Counter = Counter()
        known = _kinds.get
        for w, n in self.counts.items():
            k = known(w)
            if k is None:
                k = _kinds[w] = kinds(w)
            total[k] += n
        self.shares = {b: sum(n for k, n in total.items() if k & b) / max(self.n, 1) for b in (SYMBOLS, CAPITALS, SEPARATOR, END, PLAIN)}
        self.again = sum(map(eq, self.words, self.words[1:])) / max(self.n, 1)


def _between(x: float, bad: float, good: float) -> int:
    """Bad from ``bad`` on, good up to ``good``."""
    return BAD if x >= bad else GOOD if x <= good else NONE


def symbols(t: Text) -> int:
    """Words with runs of symbols."""
    return _between(t.shares[SYMBOLS], 0.15, 0.02)


def capitals(t: Text) -> int:
    """Words in capitals throughout."""
    return _between(t.shares[CAPITALS], 0.3, 0.05)


def separators(t: Text) -> int:
    """Words without a letter or digit, as in tables and menus."""
    return _between(t.shares[SEPARATOR], 0.12, 0.02)


def repeats(t: Text) -> int:
    """Words that repeat the word before."""
    return _between(t.again, 0.2, 0.06)


def sentences(t: Text) -> int:
    """Words that end a clause or sentence."""
    return GOOD if 0.03 <= t.shares[END] <= 0.4 else BAD if t.n >= 40 and t.shares[END] < 0.01 else NONE


def vocabulary(t: Text) -> int:
    """Long texts with few different words."""
    if t.n < 50:
        return NONE
    return BAD if len(t.counts) < 0.15 * min(t.n, 400) else GOOD if len(t.counts) > 0.3 * min(t.n, 400) else NONE


def plain_words(t: Text) -> int:
    """Words of lower-case letters only, but for a capital before and one mark behind."""
    return GOOD if t.shares[PLAIN] >= 0.9 else BAD if t.shares[PLAIN] < 0.6 else NONE


LABELLERS = (symbols, capitals, separators, repeats, sentences, vocabulary, plain_words)


def votes(text: str | None | Text) -> str:
    """One digit per labeller: 1 good, 0 bad, 2 abstains."""
    t = text if isinstance(text, Text) else Text(text)
    return "".join(str(f(t) if t.n >= FEW_WORDS else NONE) for f in LABELLERS)


def estimate(patterns: dict[str, int], rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, dict[str, float]]:
    """EM over counted vote patterns.

    Returns the shares of (bad, good), the table (labeller, class, vote) of probabilities and, for each
    pattern, the posterior of good.  An abstention says nothing.  Heuristics are made to be right when
    they call a text bad: EM starts there, and pseudo-counts hold each labeller's false alarms low.
    """
    keys = sorted(patterns)
    n = np.array([patterns[k] for k in keys], float)
    v = np.array([[int(c) for c in k] for k in keys]).reshape(len(keys), len(LABELLERS))
    post = np.where((v == BAD).any(1), 0.1, 0.95)
    share, table = np.array([0.5, 0.5]), np.full((len(LABELLERS), 2, 3), 0.5)
    table[:, :, NONE] = 1.0
    before = n.sum() * np.array([[0.02 * 0.5, 0.02 * 0.5], [0.2 * 0.004, 0.2 * 0.996]])
    for _ in range(rounds if len(keys) else 0):
        w = np.stack([n * (1 - post), n * post])
        share = (w.sum(1) + 1) / (w.sum() + 2)
        for j in range(len(LABELLERS)):
            for c in (0, 1):
                said = np.bincount(v[:, j], w[c], minlength=3)[:2] + before[c]
                table[j, c, :2] = said / said.sum()
        log = np.log(share)[:, None] + sum(np.log(table[j][:, v[:, j]]) for j in range(len(LABELLERS)))
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        if np.abs(new - post).max() < 1e-6:
            break
        post = new
    return share, table, dict(zip(keys, post.tolist()))


def _shape(word: str) -> str:
    """Letters become x or X, digits 0; runs are cut to three, marks stay."""
    if m := _COMMON.fullmatch(word):  # as below, sooner
        return (m[1] and "X") + "xxx"[: len(m[2])] + m[3]
    out = []
    for c in word:
        k = "x" if c.islower() else "X" if c.isupper() else "0" if c.isdigit() else "l" if c.isalpha() else c
        if out[-3:] != [k] * 3:
            out.append(k)
    return "".join(out[:12])


class Hasher:
    """Hashed counts of word shapes and text-level marks, scaled to unit length."""

    def __init__(self, size: int = FEATURES):
        self.size = size
        self.known: dict[str, str] = {}

    def __call__(self, text: str | None | Text) -> tuple[np.ndarray, np.ndarray]:
        import xxhash

        t = text if isinstance(text, Text) else Text(text)
        words, counts, known = t.words, t.counts, self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        shapes: Counter = Counter()
        for w, n in counts.items():
            s = known.get(w)
            if s is None:
                s = known[w] = _shape(w)
            shapes[s] += n
        n = max(len(words), 1)
        marks = {
            f"words:{len(words).bit_length()}": n, f"kinds:{int(10 * len(counts) / n)}": n,
            f"again:{min(9, int(20 * t.again))}": n,
        }
        f: dict[int, float] = {}
        for s, c in (shapes | marks).items():
            i = xxhash.xxh32_intdigest(s) % self.size
            f[i] = f.get(i, 0.0) + c / n
        ids = np.array(sorted(f), np.int32)
        x = np.sqrt(np.array([f[i] for i in ids.tolist()]))
        return ids, x / max(float(np.sqrt(x @ x)), 1e-12)


def train(rows: list[tuple[np.ndarray, np.ndarray, float]], size: int = FEATURES, steps: int = STEPS) -> np.ndarray:
    """Weights of a logistic scorer (the last is the bias) from (ids, values, posterior) rows, by Adam."""
    w = np.zeros(size + 1)
    if not rows:
        return w
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    ids, x = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    y = np.array([r[2] for r in rows])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-(np.bincount(row, x * w[ids], minlength=len(rows)) + w[-1])))
        e = (p - y) / len(rows)
        g = np.append(np.bincount(ids, x * e[row], minlength=size), e.sum()) + RIDGE * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w


#: What is kept of each text: votes, features, and whether it has a word at all.
FEATURE_COLUMNS = "_votes string, _ids array<int>, _x array<double>, _blank boolean"


def _features(text_at: int, keep: list[int]):
    """Columns ``keep`` of a batch and the features of the text in column ``text_at``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = Hasher()
        for b in batches:
            rows = []
            for t in b.column(text_at):
                seen = Text(t.as_py())
                rows.append((votes(seen), *h(seen), seen.n == 0))
            v, ids, x, blank = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([
                *(b.column(i) for i in keep), pa.array(v, pa.string()), pa.array(ids, pa.list_(pa.int32())), pa.array(x, pa.list_(pa.float64())), pa.array(blank, pa.bool_())],
                names=[*(b.schema.names[i] for i in keep), "_votes", "_ids", "_x", "_blank"])

    return run


def fit(seen: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, dict[str, float]]:
    """The scorer's weights and the posterior of each vote pattern, from written features (_id, FEATURE_COLUMNS)."""
    counts = {r["_votes"]: r["count"] for r in seen.groupBy("_votes").count().collect()}  # at most 3 ** len(LABELLERS) rows
    _, _, posterior = estimate(counts)
    chosen = seen.filter("_id is not null").select("_id").orderBy(F.xxhash64("_id"), "_id").limit(sample_rows).distinct()
    # at most sample_rows ids: a bounded broadcast, and as many rows
    got = seen.join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.min(F.struct("_ids", "_x", "_votes")).alias("f")).select("f.*").collect()
    rows = sorted((tuple(r["_ids"]), tuple(r["_x"]), posterior[r["_votes"]]) for r in got)
    return train([(np.array(i, np.int64), np.array(x), y) for i, x, y in rows]), posterior


def _score(w: np.ndarray) -> Column:
    """The scorer's verdict on the columns _ids and _x, 0 for texts without a word."""
    weights = F.from_json(F.lit(json.dumps(w[:-1].tolist())), "array<double>")  # a constant
    z = F.aggregate(F.zip_with("_ids", "_x", lambda i, x: x * F.element_at(weights, i + 1)), F.lit(float(w[-1])), lambda s, x: s + x)
    return F.when(F.col("_blank"), 0.0).otherwise(1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(50.0)), F.lit(-50.0)))))


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, keep: float = KEEP) -> DataFrame:
    """doc_id, votes, posterior (of good, from the votes alone), score (of the scorer) and kept (score >= ``keep``) of each row.

    Null, empty and blank texts score 0.  Repeated rows and null ids are kept as rows, ids that are null
    train nothing; an empty table gives an empty result; only the two named columns are read.
    """
    rows = docs.selectExpr(f"cast(`{id_col}` as long) as _id", f"`{text_col}` as _text")
    seen = scratch.write(rows.mapInArrow(_features(1, [0]), f"_id long, {FEATURE_COLUMNS}"), "features")
    w, posterior = fit(seen, sample_rows)
    by_votes = F.create_map(*(F.lit(v) for kv in sorted(posterior.items()) for v in kv)) if posterior else F.lit(None).cast("map<string,double>")
    out = seen.select(F.col("_id").alias("doc_id"), F.col("_votes").alias("votes"), by_votes[F.col("_votes")].alias("posterior"), _score(w).alias("score"))
    return out.withColumn("kept", F.col("score") >= keep)


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, keep: float = KEEP) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, with all their columns.

    Rows are written once with their features, so that a verdict is found beside its row and no text moves.
    Columns of ``docs`` may have any names.
    """
    named = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    columns, at = named.columns, docs.columns.index(text_col)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in named.schema)
    seen = scratch.write(named.mapInArrow(_features(at, list(range(len(columns)))), f"{kinds}, {FEATURE_COLUMNS}"), "documents-with-features")
    w, _ = fit(seen.select(F.col(columns[docs.columns.index(id_col)]).cast("long").alias("_id"), "_votes", "_ids", "_x"), sample_rows)
    return seen.filter(_score(w) >= keep).select(*columns).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
