import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from vecspark.llm import exact_dedup, graph, scratch, simhash, substring_dedup

WORD = re.compile("[^\x20\x09-\x0d]+")


def frame(spark, texts, start=0):
    return spark.createDataFrame(list(enumerate(texts, start)), "doc_id long, text string")


# ---- exact


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), float("inf") if i is None else i, i))
    return {(i, t): (min(g)[2], len(g)) for t, g in groups.items() for _, _, i in g}


def test_exact_matches_brute_force_on_edges(spark, edges, empty):
    index = exact_dedup.DigestIndex(spark, scratch.new_path(spark, "i"))
    got = exact_dedup.deduplicate(edges, index).collect()
    rows = [(r["doc_id"], r["text"]) for r in edges.collect()]
    want = brute_exact(rows)
    assert len(got) == len(rows)
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): t for _, t in want}
    for r in got:
        assert (r["keep_id"], r["group_size"]) == want[r["doc_id"], by_digest[r["text_sha256"]]]
    assert {r["doc_id"] for r in got if r["kept"]} == {6, None, 7, 8, 9, 10, 5}
    fresh = exact_dedup.DigestIndex(spark, scratch.new_path(spark, "i"))
    assert exact_dedup.deduplicate(empty, fresh).count() == 0 and fresh.read().count() == 0


def test_index_survives_reopening_and_later_batches_lose(spark):
    path = scratch.new_path(spark, "i")
    index = exact_dedup.DigestIndex(spark, path, buckets=3)
    exact_dedup.deduplicate(frame(spark, ["a b", "c"]), index)
    spark.sql(f"DROP TABLE {index.table}")
    again = exact_dedup.DigestIndex(spark, path)
    assert again.buckets == 3
    got = {r["doc_id"]: r for r in exact_dedup.deduplicate(frame(spark, ["a  b   ", "d", "d"], 10), again).collect()}
    assert (got[10]["kept"], got[10]["keep_id"]) == (False, 0)
    assert got[11]["kept"] and not got[12]["kept"] and again.read().count() == 3
    exact_dedup.deduplicate(frame(spark, ["a b", "d"], 20), again)
    assert again.read().count() == 3


def test_a_compacted_index_has_one_file_a_bucket(spark):
    path = scratch.new_path(spark, "i")
    index = exact_dedup.DigestIndex(spark, path, buckets=3)
    for k in range(4):
        exact_dedup.deduplicate(frame(spark, [f"text {k} {i}" for i in range(40)], 100 * k), index)
    before = sorted(map(tuple, index.read().collect()))
    assert len(index.read().inputFiles()) > 3
    index.compact()
    assert len(index.read().inputFiles()) <= 3 and sorted(map(tuple, index.read().collect())) == before
    again = {r["doc_id"]: r["kept"] for r in exact_dedup.deduplicate(frame(spark, ["text 2 7", "new"], 900), index).collect()}
    assert again == {900: False, 901: True}
    index.close()
    assert exact_dedup.DigestIndex(spark, path).read().count() == 161


def test_index_side_of_the_join_is_not_shuffled(spark):
    index = exact_dedup.DigestIndex(spark, scratch.new_path(spark, "i"), buckets=4)
    groups = exact_dedup.winners(exact_dedup.digests(frame(spark, ["a"])))
    plan = index.unseen(groups)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.split("Scan parquet")[-2].count("Exchange") <= 1


def test_exact_survivors_keep_all_columns(spark, edges):
    kept = exact_dedup.survivors(edges, exact_dedup.DigestIndex(spark, scratch.new_path(spark, "i")))
    assert kept.columns == edges.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 5, 6, 7, 8, 9, 10]


# ---- near


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def brute_components(fps, ids):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("text", ["", None, "a", "A b", "a b c", "X y Z x Y z X y z", "Über Ü a", " lead  and\ttrail \n"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


@pytest.mark.parametrize("leaf_rows", [1 << 14, 8])
def test_near_matches_brute_force(spark, leaf_rows):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 300))] for _ in range(40)]
    texts = [" ".join(w) for w in base]
    for w in base * 2:
        copy = list(w)
        copy[rng.randrange(len(copy))] = "changed"
        texts.append(" ".join(copy))
    texts += ["", None, "  "]
    fps = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    got = {r["doc_id"]: r for r in simhash.near_duplicates(frame(spark, texts), leaf_rows=leaf_rows).collect()}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: r["component_id"] for i, r in got.items()} == brute_components(fps, list(fps))


def test_trie_join_finds_each_pair_once():
    rng = np.random.default_rng(4)
    a = np.unique(np.concatenate([rng.integers(0, 2**63, 300, dtype=np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64), np.arange(40, dtype=np.uint64)]))
    b = np.unique(a[::3] ^ np.uint64(1 << 40))
    for x, y, same in ((a, a, True), (a, b, False)):
        got = [(int(i), int(j)) for p, q in simhash._within(x, y, same, 2) for i, j in zip(p, q)]
        i, j = np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= 2)
        assert len(got) == len(set(got)) and set(got) == {(int(p), int(q)) for p, q in zip(i, j) if not same or p < q}


def test_near_edges(spark, edges, empty):
    got = simhash.near_duplicates(edges).collect()
    assert len(got) == edges.count()
    by = {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None}
    assert by[2] == by[6] == 1 and by[4] == by[5] == 3
    assert {r["component_id"] for r in got if r["doc_id"] is None and r["fingerprint"] == "0" * 16} == {3}
    assert {r["component_id"] for r in got if r["doc_id"] is None and r["fingerprint"] != "0" * 16} == {None}
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.survivors(edges)
    assert kept.columns == edges.columns and [r for r in kept.collect() if r["doc_id"] in (2, 6, 4, 5)] == []


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    got = dict(graph.connected_components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 160)}
    assert graph.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---- substrings


def brute_repeats(rows, window):
    """rows: (doc_id, text) with distinct ids."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        words = WORD.findall(t or "")
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            if key in seen:
                gone[k : k + window] = [True] * window
            seen.add(key)
        out[i] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g))
    return out


def repeats(df, **options):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup.remove_repeats(df, **options).collect()}


@pytest.mark.parametrize("words", [2, 5, 3000])
def test_repeats_match_brute_force(spark, words):
    rng = random.Random(words)
    make = lambda n: [f"w{rng.randrange(words)}" for _ in range(n)]
    passages = [make(rng.randrange(15, 60)) for _ in range(6)]
    texts = []
    for _ in range(50):
        text = make(rng.randrange(0, 40))
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            text += p[a:] + make(rng.randrange(0, 30))
        texts.append(rng.choice([" ", "\n", "\t "]).join(text))
    texts += [texts[7], texts[7], "a " * 500, "a b " * 200, None, ""]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert repeats(df) == brute_repeats(rows, 20)


@pytest.mark.parametrize("rows_at_once", [1, 7, 10_000])
def test_a_common_line_with_many_surroundings(spark, rows_at_once):
    rng = random.Random(rows_at_once)
    line = "this very line of a dozen words stands in most of all".split()
    make = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    shared = make(9)  # with it the line makes repeats of a whole window
    rows = [(i, " ".join(make(rng.randrange(25)) + (shared if i % 7 == 0 else []) + line + make(rng.randrange(25)))) for i in range(150)]
    df = spark.createDataFrame(rows + [(200 + i, rows[3][1]) for i in range(20)], "doc_id long, text string").repartition(6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_at_once)
    try:
        assert repeats(df) == brute_repeats(rows + [(200 + i, rows[3][1]) for i in range(20)], 20)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_long_documents_are_parsed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK_WORDS", 50)
    rng = random.Random(9)
    words = [f"w{rng.randrange(30)}" for _ in range(400)]
    x1, x2 = substring_dedup.word_names([w.encode() for w in words])
    whole = substring_dedup.segments(x1, x2, np.array([400]))
    assert whole.count.sum() == 381
    part = substring_dedup.segments(x1[:69], x2[:69], np.array([69]))
    # windows that lie in a piece take the same anchors as in the whole
    assert set(zip(part.start.tolist(), part.anchor.tolist())) - set(zip(whole.start.tolist(), whole.anchor.tolist())) == set()


def test_repeat_edges(spark, edges, empty):
    got = substring_dedup.remove_repeats(edges).collect()
    assert len(got) == edges.count()
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert by[3][0]["n_words"] == by[5][0]["n_words"] == 0 and by[9][0]["kept_text"] == "a"
    assert by[7][0]["n_words"] == 30_000 and by[8][0]["n_removed"] == 30_000 and by[8][0]["kept_text"] == "end"
    assert [r["n_removed"] for r in by[2]] == [0, 0]  # shorter than a window
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_equal_rows_under_one_id_are_kept_alike(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_removed"]) for r in substring_dedup.remove_repeats(df).collect()) == [(1, 0), (1, 0), (2, 30)]
