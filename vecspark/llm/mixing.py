"""Mixing of sources to target weights with soft domain membership.

A classifier learned from the table's own labelled rows gives each document a posterior over domains.
Document rates (not negative, and without an upper bound) minimise the weighted squared distance of the
domains' expected token totals from their targets, plus a small pull towards rate 1, by projected gradient
steps.  All steps add to rate 1 a multiple of the domains' errors weighted with the document's posterior,
and the projection cuts at 0, so that a rate is known from its document's posterior and one number per
domain: a step aggregates one total per domain over all documents, and nothing is kept for each document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.llm import scratch

#: Labelled rows that the classifier learns from at most (those of smallest hashed id), and its hashed features.
SAMPLE_ROWS, FEATURES = 20_000, 1 << 14
#: Words of a document beyond which evidence counts for no more; keeps posteriors soft.
EVIDENCE_WORDS = 30
#: Pull towards rate 1, steps at most (an error beyond), and the gradient at which the fit has converged, as a share of tokens.
PULL, STEPS, TOLERANCE = 1e-3, 200, 1e-7
#: The default domain column and the shares of all tokens that its values should get.
DOMAIN, TARGETS = "lang", {"en": 0.5, "de": 0.2, "fr": 0.18, "es": 0.12}


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed lower-case words of a text and their counts."""
    from zlib import crc32

    words = (text or "").lower().encode("utf-8", "surrogatepass").split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ids = np.fromiter(map(crc32, words), np.uint32, len(words)).astype(np.int64) % FEATURES
    return np.unique(ids, return_counts=True)


def _count(domains: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(domains), FEATURES), np.int64)
        at = {d: i for i, d in enumerate(domains)}
        for b in batches:
            for text, d in zip(b.column(0), b.column(1).to_pylist()):
                i, n = features(text.as_py())
                total[at[d], i] += n
        d, i = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(i), pa.array(total[d, i])], names=["d", "i", "n"])

    return run


def fit(docs: DataFrame, domain_col: str, domains: list[str], id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Log-probabilities (domain, feature) and, in the last column, log prior, from labelled rows."""
    known = F.col(domain_col).isin(domains)
    chosen = docs.filter(known & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(domain_col).alias("_domain"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows).groupBy("_id").agg(F.min("_domain").alias("_domain"))
    # at most sample_rows ids and labels: a bounded broadcast
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id").select("_text", "_domain")
    counts = sample.mapInArrow(_count(domains), "d long, i long, n long").groupBy("d", "i").agg(F.sum("n").alias("n")).collect()  # at most domains x FEATURES rows
    total = np.full((len(domains), FEATURES), 0.2)
    for r in counts:
        total[r["d"], r["i"]] += r["n"]
    logs = np.log(total / total.sum(1, keepdims=True))
    return np.column_stack([logs, np.log(np.full(len(domains), 1 / max(len(domains), 1)))])


def _posteriors(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = shared.value
        prior = logs[:, -1]
        for b in batches:
            tokens, post = [], []
            for text in b.column(1):
                i, n = features(text.as_py())
                s = prior.copy()
                if len(i):
                    s += logs[:, i] @ n * (min(n.sum(), EVIDENCE_WORDS) / n.sum())
                e = np.exp(s - s.max())
                tokens.append(int(n.sum()))
                post.append(e / e.sum())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tokens, pa.int64()), pa.array(post, pa.list_(pa.float64()))], names=["doc_id", "tokens", "posterior"])

    return run


def posteriors(docs: DataFrame, logs: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(logs)  # domains x FEATURES numbers
    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").mapInArrow(
        _posteriors(shared), "doc_id long, tokens long, posterior array<double>")


def _rate(p: Column, level: np.ndarray, pull: float) -> Column:
    """The best rate under one number per domain."""
    return F.greatest(F.lit(0.0), sum((F.lit(float(x / pull)) * p[k] for k, x in enumerate(level)), F.lit(1.0)))


def fit_rates(members: DataFrame, targets: list[float], total: float | None = None, pull: float = PULL, steps: int = STEPS) -> DataFrame:
    """(doc_id, tokens, posterior, rate, residual): rates whose expected domain totals come nearest to ``targets`` x total tokens.

    ``residual`` is each domain's expected total less its target, as a share of all tokens.  ``members``
    is read once a step.  Steps are scaled by how far domains' posteriors overlap while no rate is cut at 0,
    which is the most that curvature can be, so they are safe without a search along them; they have
    momentum, which ends where it leads uphill.  A fit that has not converged after ``steps`` is an error.
    """
    n = len(targets)
    p, tokens = F.col("posterior"), F.col("tokens").cast("double")
    pairs = [(i, j) for i in range(n) for j in range(i + 1)]
    sums = members.agg(F.sum(tokens).alias("all"), *(F.sum(tokens * p[i]).alias(f"t{i}") for i in range(n)), *(F.sum(tokens * p[i] * p[j]).alias(f"m{i}_{j}") for i, j in pairs)).first()
    have = sums["all"] or 0.0
    if not have:
        return members.withColumn("rate", F.lit(1.0)).withColumn("residual", F.array(*(F.lit(0.0) for _ in range(n))))
    goal = np.array(targets) * (have if total is None else total) / have
    share = np.maximum(np.array([sums[f"t{i}"] for i in range(n)]) / have, 1e-6)  # a domain's weight is the inverse
    scale = np.diag(share)
    for i, j in pairs:
        scale[i, j] += sums[f"m{i}_{j}"] / have / pull
        scale[j, i] = scale[i, j]

    def totals(level: np.ndarray) -> np.ndarray:
        """The domains' expected totals, as shares of all tokens."""
        row = members.agg(*(F.sum(tokens * _rate(p, level, pull) * p[i]).alias(f"t{i}") for i in range(n))).first()
        return np.array(list(row)) / have

    level = at = np.zeros(n)
    momentum = 1.0
    for step in range(steps + 1):
        now = totals(at)
        slope = share * at - goal + now
        if np.abs(slope).max() <= TOLERANCE:
            break
        if step == steps:
            raise RuntimeError(f"rates have not converged after {steps} steps: gradient {np.abs(slope).max():.1e}")
        new = at - np.linalg.solve(scale, slope)
        if slope @ (new - level) > 0:
            momentum = 1.0
        grown = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        level, at, momentum = new, new + (momentum - 1) / grown * (new - level), grown
    return scratch.write(members.withColumn("rate", _rate(p, at, pull)).withColumn("residual", F.array(*(F.lit(float(x)) for x in now - goal))), "rates")


def mix(docs: DataFrame, targets: dict[str, float] = TARGETS, domain_col: str = DOMAIN, id_col: str = "doc_id", text_col: str = "text", total: float | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, tokens, domains, posterior, rate, residual and copies of each row.

    ``targets`` are shares by domain, not negative; those of domains without a row are left out (unless all
    are), and the rest are scaled to sum to 1, or are equal if all of them are 0.  Copies are the rate rounded up or down at
    random with the rate as their mean; the draw hangs on the id alone.  Rows without a known domain
    take no part in learning but get posteriors and rates as all others.  Null and empty texts have no
    tokens, an even posterior, and the rate that goes with it.  A null id draws as id 0; rows that
    repeat an id draw alike; an empty table gives an empty result.
    """
    present = {r[0] for r in docs.filter(F.col(domain_col).isin(list(targets))).select(domain_col).distinct().collect()}  # at most one row a target
    domains = sorted(present or targets)
    if min(targets.values()) < 0:
        raise ValueError("targets must not be negative")
    whole = sum(targets[d] for d in domains)
    weights = [targets[d] / whole if whole else 1 / len(domains) for d in domains]
    logs = fit(docs, domain_col, domains, id_col, text_col, sample_rows)
    members = scratch.write(posteriors(docs, logs, id_col, text_col), "posteriors")
    rates = fit_rates(members, weights, total)
    draw = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    return rates.select("doc_id", "tokens", F.array(*map(F.lit, domains)).alias("domains"), "posterior", "rate", "residual", F.floor(F.col("rate") + draw).cast("int").alias("copies"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as its copies say."""
    id_col = options.get("id_col", "doc_id")
    copies = mix(docs, **options).groupBy(F.col("doc_id").alias("_id")).agg(F.max("copies").alias("_copies")).filter("_copies != 1")
    copies = scratch.lookup(scratch.write(copies, "copies"))
    times = F.coalesce(copies["_copies"], F.lit(1))
    rows = docs.join(copies, docs[id_col].eqNullSafe(copies["_id"]), "left")
    return rows.select(F.explode(F.array_repeat(F.struct(*(docs[c] for c in docs.columns)), times)).alias("r")).select("r.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
