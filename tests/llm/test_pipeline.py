import re
import subprocess
import sys
from collections import Counter
from zlib import crc32

import duckdb
import numpy as np
import pytest
from helpers import DATA, ROOT
from pyspark.sql import functions as F
from test_dedup import brute_fingerprint
from test_files import check_pieces

import corpus_pipeline
from vecspark.llm import catalogue, exact_dedup, mixing, quality, simhash


def test_stages_pass_documents_on(spark, edges, empty):
    for df in (edges, empty):
        docs = df
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, DATA)
            path = corpus_pipeline.scratch.write(out, name)
            if name != "packing":
                assert path.columns == df.columns
            docs = path


def test_pipeline_on_documents(spark, documents):
    docs = documents
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.scratch.write(stage(spark, docs, DATA), name)
        counts.append(docs.count())
        if name == "exact_dedup":
            assert docs.select(exact_dedup.normalised(docs["text"]).alias("t")).distinct().count() == counts[-1]
        if name == "simhash_near_dedup":
            again = simhash.near_duplicates(docs).collect()
            assert len({r["component_id"] for r in again}) == counts[-1]
    assert counts[0] > counts[1] > counts[2] >= counts[3] and abs(counts[4] - counts[3]) < 0.1 * counts[3]
    rows = corpus_pipeline.packing_stage(spark, docs, DATA)
    assert rows.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def good(rows):
    """What the quality scorer keeps, by a run over lists."""
    patterns = Counter(quality.votes(t) for _, t, _ in rows)
    posterior = quality.estimate(dict(patterns))[2]
    h = quality.Hasher()
    seen = {i: (*h(t), quality.votes(t)) for i, t, _ in rows}
    w = quality.train([(np.array(i), np.array(x), y) for i, x, y in sorted((ids.tolist(), x.tolist(), posterior[v]) for ids, x, v in seen.values())])
    return [r for r in rows if (r[1] or "").split() and seen[r[0]][1] @ w[seen[r[0]][0]] + w[-1] >= 0]


def first_of_equals(rows):
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r[1] or ""), []).append(r)
    return [min(g, key=lambda r: (-len(r[1] or ""), r[0])) for g in groups.values()]


def first_of_near(rows):
    rows = sorted(rows)
    fp = np.array([brute_fingerprint(t) for _, t, _ in rows], np.uint64)
    label = np.arange(len(rows))
    for i, j in np.argwhere(np.triu(np.bitwise_count(fp[:, None] ^ fp[None]) <= 2, 1)):
        label[label == max(label[i], label[j])] = min(label[i], label[j])
    return [r for k, r in enumerate(rows) if label[k] == k]


def copies(rows, draw):
    """(copies, how far the draw was from deciding otherwise) by the definition of the rates, solved densely."""
    domains, n = sorted(mixing.TARGETS), len(rows)
    counts = np.full((4, mixing.FEATURES), 0.2)
    hashed = [np.array([crc32(w) % mixing.FEATURES for w in (t or "").lower().encode().split()], int) for _, t, _ in rows]
    for (_, _, lang), h in zip(rows, hashed):
        if lang in domains:
            np.add.at(counts[domains.index(lang)], h, 1)
    logs = np.log(counts / counts.sum(1, keepdims=True))
    s = np.array([logs[:, h].sum(1) * (min(len(h), 30) / len(h)) if len(h) else np.zeros(4) for h in hashed])
    p = np.exp(s - s.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    tokens = np.array([len(h) for h in hashed], float)
    tokens /= tokens.sum()
    goal, weight = np.array([mixing.TARGETS[d] for d in domains]), 1 / (tokens @ p)
    rate = np.ones(n)
    for _ in range(200_000):  # projected gradient on sum w (totals - goal)^2 + pull sum tokens (rate - 1)^2
        new = np.maximum(0, rate - 0.2 * ((weight * ((tokens * rate) @ p - goal)) @ p.T + mixing.PULL * (rate - 1)))
        if np.abs(new - rate).max() < 1e-10:
            break
        rate = new
    x = rate + draw
    return np.floor(x).astype(int), np.abs(x - np.rint(x))


def test_pipeline_against_plain_loops(spark, documents):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in documents.collect()]
    rows = first_of_near(first_of_equals(good(rows)))
    draws = {r[0]: r[1] for r in documents.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)).collect()}
    n, sure = copies(rows, np.array([draws[r[0]] for r in rows]))
    sure = sure > 1e-4
    pieces = corpus_pipeline.run(spark, DATA).collect()
    tokens = Counter()
    for p in pieces:
        tokens[p["doc_id"]] += p["length"]
    size = {p["doc_id"]: p["doc_tokens"] for p in pieces}
    assert 600 < len(rows) < 1000 and sure.mean() > 0.99
    assert all(tokens[r[0]] == k * size.get(r[0], 0) and (k == 0) == (r[0] not in size) for r, k, s in zip(rows, n.tolist(), sure) if s)
    assert set(size) <= {r[0] for r in rows}
    texts = {r[0]: r[1] for r in rows}
    assert check_pieces(pieces, Counter({(i, texts[i]): tokens[i] // size[i] for i in size})) <= 4096 * documents.rdd.getNumPartitions() * 4


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_gives_what_the_sql_gives(spark, name):
    a = catalogue.QUERIES[name](spark, DATA).toPandas()
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    b = con.execute(catalogue.ORACLES[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    a, b = (x[cols].astype({c: "Int64" for c in ("refers_to",) if c in cols}).astype(str) for x in (a, b))
    key = "doc_id" if "doc_id" in cols else "page_id"
    a, b = (x.sort_values(key).reset_index(drop=True) for x in (a, b))
    assert a.equals(b)


BROKEN = """
import sys, warnings
sys.modules["vecspark.llm.media"] = None
with warnings.catch_warnings(record=True) as said:
    warnings.simplefilter("always")
    import __spark_entry__ as e
assert "exact_topk_cosine" in e.queries() and len([w for w in said if "vecspark.llm.media" in str(w.message)]) == 1
"""


def test_entry_says_what_keeps_the_operators_out():
    subprocess.run([sys.executable, "-c", BROKEN], cwd=ROOT, check=True)
