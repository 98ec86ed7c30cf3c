import re

import numpy as np
import pyarrow as pa
import pytest
from helpers import DATA, vector_frame
from pyspark.sql import functions as F

from vecspark.functions import kernels
from vecspark.operators import clustering, compress, metrics, search, topk
from vecspark.plans.queries import QUERIES
from vecspark.sources import vectors as src

RNG = np.random.default_rng(2)


def found(df, value="score"):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r[value]))
    return out


def code_frame(spark, c, ids=None):
    ids = range(len(c)) if ids is None else ids
    return spark.createDataFrame([(int(i), r.tolist()) for i, r in zip(ids, c)], "vec_id long, code array<long>")


@pytest.mark.parametrize("metric", ["ip", "cosine", "l2"])
def test_top_k_with_ties_over_partitions(spark, metric):
    x = np.round(RNG.standard_normal((60, 4)))  # many ties
    q = RNG.standard_normal((5, 4)).round()
    q[0] = 0
    score, sign = topk.METRICS[metric]
    d = np.round(score(q, x), 6)
    for n in (1, 7):
        got = found(topk.top_k(vector_frame(spark, x).repartition(n), vector_frame(spark, q, range(100, 105)), 9, metric))
        for i in range(5):
            order = np.lexsort((np.arange(60), d[i]))[:9]
            assert [v for v, _ in got[100 + i]] == order.tolist()
            assert np.allclose([s for _, s in got[100 + i]], d[i][order] * sign)


def test_top_k_edges(spark):
    x = vector_frame(spark, np.eye(3))
    assert topk.top_k(x, x, 0).count() == 0
    assert topk.top_k(x, x.limit(0), 3).count() == 0
    assert topk.top_k(x.limit(0), x, 3).count() == 0
    assert topk.top_k(x, x, 99).count() == 9


def test_queries_in_blocks_give_the_same(spark, monkeypatch):
    x, q = vector_frame(spark, RNG.standard_normal((30, 4))), vector_frame(spark, RNG.standard_normal((20, 4)), range(5, 25))
    whole = found(topk.top_k(x, q, 3))
    monkeypatch.setattr(topk.query_blocks, "__defaults__", (24,))
    assert found(topk.top_k(x, q, 3)) == whole


@pytest.mark.parametrize("metric", ["ip", "cosine", "l2"])
def test_all_of_few_documents_are_ranked_without_a_shuffle(spark, metric):
    x, q = np.round(RNG.standard_normal((40, 4))), np.round(RNG.standard_normal((25, 4)))  # many ties
    docs, queries = vector_frame(spark, x, range(39, -1, -1)).repartition(3), vector_frame(spark, q, range(100, 125)).repartition(5)
    got = topk.top_k(docs, queries, topk.FEW + 1, metric)
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.dtypes == topk.top_k(docs, queries, 40, metric).dtypes
    assert sorted(got.collect()) == sorted(topk.top_k(docs, queries, 40, metric).collect()) and got.count() == 1000


def test_a_task_holds_few_of_very_many_results(monkeypatch):
    import pyarrow as pa

    for name, value in (("FEW", 6), ("HELD", 100), ("SCORES", 160), ("ROWS", 4)):
        monkeypatch.setattr(topk, name, value)
    most, hold = [], topk.Best.add
    monkeypatch.setattr(topk.Best, "add", lambda self, *x: (hold(self, *x), most.append(self.held)))
    x, q = RNG.standard_normal((200, 4)), RNG.standard_normal((10, 4))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(200)), kernels.lists(x)], names=["vec_id", "v"])
    sent = pa.Table.from_batches(topk._local(np.arange(10), q, "ip", 150, 6)(iter([batch]))).to_pandas()
    assert max(most) <= 250 and not sent.duplicated(["query_id", "vec_id"]).any()
    for i in range(10):
        rows = sent[sent.query_id == i].sort_values(["score", "vec_id"], ascending=[False, True])[:150]
        assert rows.vec_id.tolist() == np.lexsort((np.arange(200), -np.round(x @ q[i], 6)))[:150].tolist()


def test_recall_of_nothing_is_zero_and_row_is_kept(spark):
    ref = spark.createDataFrame([(1, 10), (1, 11), (2, 10)], "query_id long, vec_id long")
    got = {r["query_id"]: r["recall"] for r in metrics.recall(ref, spark.createDataFrame([(1, 10), (1, 10)], "query_id long, vec_id long")).collect()}
    assert got == {1: 0.5, 2: 0.0}


def test_quantiles_and_histogram(spark):
    x = RNG.random(101) * 100
    df = spark.createDataFrame([(float(v),) for v in x] + [(100.0,), (120.0,)], "share double")
    y = np.append(x, [100.0, 120.0])
    r = metrics.quantiles(df, "share").first()
    assert np.allclose([r["p10"], r["p50"], r["p95"]], np.percentile(y, [10, 50, 95]), atol=1e-6)
    n, _ = np.histogram(np.clip(y, 0, 100), 20, (0, 100))
    assert {r["bin"]: r["n"] for r in metrics.histogram(df, "share").collect()} == {i: c for i, c in enumerate(n.tolist()) if c}


def test_kmeans_converges_and_keeps_empty_clusters(spark):
    x = np.vstack([RNG.normal(c, 0.1, (30, 2)) for c in (0, 5, 10)])
    df = vector_frame(spark, x)
    for init in ("k-means++", "random"):
        c, inertia = clustering.kmeans(df, 3, init=init, reseed=True, max_iter=30, tol=0.0)
        label, d = clustering.nearest(x, c)
        assert c.shape == (3, 2) and clustering.inertia(df, c) == pytest.approx(d.sum()) and inertia == pytest.approx(d.sum())
        assert all(np.allclose(c[j], x[label == j].mean(0)) for j in range(3))  # nothing is left to move
    c, _ = clustering.kmeans(df, 3, init="k-means++")
    assert sorted(np.round(c[:, 0]).tolist()) == [0, 5, 10]
    same = vector_frame(spark, np.ones((6, 2)))
    assert np.array_equal(clustering.kmeans(same, 3, init="first")[0], np.ones((3, 2)))
    with pytest.raises(ValueError):
        clustering.kmeans(df, 3, init="best")


def test_wide_vectors_use_sums_by_position(spark):
    x = RNG.standard_normal((20, 130))
    c, _ = clustering.kmeans(vector_frame(spark, x), 2, max_iter=2, tol=-1, init="first")
    d, _ = clustering._lloyd(x, 2, 2)
    assert np.allclose(c, d)


def test_greedy_centers_repeat_the_first_when_points_run_out():
    x = np.array([[0], [0], [9], [0], [4]], float)
    got = kernels.greedy_centers(lambda i: kernels.squared_l2(x[i : i + 1], x)[0], 5, 5)
    assert got == [0, 2, 4, 0, 0]
    assert kernels.greedy_centers(None, 0, 3) == []


def test_kcenter_radius_never_grows(spark):
    c = kernels.pack_bits(RNG.standard_normal((50, 64)) >= 0)
    df = code_frame(spark, c).repartition(5)
    radius = [clustering.kcenter(df, k).assign(df).agg(F.max("distance")).first()[0] for k in (1, 4, 16, 60)]
    assert radius == sorted(radius, reverse=True) and radius[-1] == 0


@pytest.mark.parametrize("bits", [4, 64, 130])  # many ties, few, two and a half words
def test_kcenter_in_passes_is_the_greedy_choice(spark, bits):
    x = RNG.standard_normal((90, bits)) >= 0
    c = kernels.pack_bits(x)
    ids = RNG.permutation(500)[:90]
    order = np.argsort(ids)
    want = kernels.greedy_centers(lambda i: kernels.hamming(c[order][i : i + 1], c[order])[0], 90, 24)
    for most in (1, 7, 40, 1000):
        got = clustering.kcenter(code_frame(spark, c, ids).repartition(4), 24, pass_points=most)
        assert got.ids.tolist() == ids[order][want].tolist() and np.array_equal(got.points, c[order][want])
    v = np.round(RNG.standard_normal((60, 3)), 1)
    want = kernels.greedy_centers(lambda i: np.round(kernels.squared_l2(v[i : i + 1], v)[0], 9), 60, 12, 5)
    assert clustering.kcenter(vector_frame(spark, v).repartition(3), 12, "l2", "v", start=5, pass_points=8).ids.tolist() == want


def test_kcenter_edges(spark):
    c = np.array([[7], [7], [7], [9]])
    df = code_frame(spark, c)
    assert clustering.kcenter(df, 9).ids.tolist() == [0, 3, 0, 0]
    assert clustering.kcenter(df.limit(0), 3).ids.tolist() == [] and clustering.kcenter(df, 0).ids.tolist() == []
    assert clustering.kcenter(df, 3, start=99).ids.tolist()[0] == 3


def test_kcenter_of_groups(spark):
    c = kernels.pack_bits(RNG.standard_normal((80, 64)) >= 0)
    group = lambda x: (x[:, 0] & 3).astype(np.int64)
    for most in (8, 10_000):
        got = clustering.farthest_first(code_frame(spark, c).repartition(3), 30, group=group, pass_points=most)
        for g in range(4):
            at = np.flatnonzero(group(c) == g)
            want = kernels.greedy_centers(lambda i: kernels.hamming(c[at][i : i + 1], c[at])[0], len(at), 30)
            assert got[g][0].tolist() == at[want].tolist()


def test_majority_counts_all_members(spark):
    c = kernels.pack_bits(RNG.standard_normal((70, 100)) >= 0)
    centers = clustering.kcenter(code_frame(spark, c), 5)
    label = clustering.nearest(c, centers.points, "hamming")[0]
    got = centers.majority(code_frame(spark, c).repartition(3)).points
    assert all(np.array_equal(got[j], kernels.majority(c[label == j])) for j in range(5))


def test_majority_breaks_ties_upwards():
    codes = kernels.pack_bits(np.array([[1, 0, 1, 0], [1, 1, 0, 0]], bool))
    assert kernels.majority(codes).tolist() == [0b0111]


def test_recall_is_one_when_all_lists_are_probed_and_never_falls(spark):
    docs, queries = src.load_split(spark, DATA)
    c = clustering.kmeans(docs, 8, max_iter=2, tol=-1, init="first")[0]
    post = clustering.assign(docs, c).select("vec_id", F.col("label").cast("long").alias("center_id"))
    probes = search.probe(clustering.centroid_frame(spark, c).withColumnRenamed("vec_id", "center_id"), queries, 8)
    exact = topk.top_k(docs, queries, 10)
    recalls = [metrics.recall(exact, search.candidates(probes.filter(F.col("rank") <= n), post)).agg(F.avg("recall")).first()[0] for n in (1, 4, 8)]
    assert recalls == sorted(recalls) and recalls[-1] == 1.0


def test_two_layers_and_or(spark):
    docs, queries = (compress.binary_codes(x, 64) for x in src.load_split(spark, DATA))
    index = search.two_layer_index(docs, 8, 24)
    both = {tuple(r) for r in search.cascade(index, queries, 3, 6, True).collect()}
    either = {tuple(r) for r in search.cascade(index, queries, 3, 6, False).collect()}
    assert both < either
    local = search.local_index(docs, 8, 4)
    assert local.assigned.count() == docs.count()  # the inner lists split the documents
    assert {tuple(r) for r in search.local_cascade(local, queries, 3, 99, True).collect()} == {tuple(r) for r in search.local_cascade(local, queries, 3, 1, False).collect()}


def test_index_round_trip(spark, tmp_path):
    docs, queries = (compress.binary_codes(x, 64) for x in src.load_split(spark, DATA))
    index = search.two_layer_index(docs, 4, 8)
    index.save(str(tmp_path / "two"))
    again = search.TwoLayerIndex.load(spark, str(tmp_path / "two"))
    assert set(search.cascade(again, queries, 2, 3, True).collect()) == set(search.cascade(index, queries, 2, 3, True).collect())


def test_diversify():
    ranked, near = [7, 3, 5, 1, 9, 2], {7: [2, 8, 9, 1], 3: [9, 1, 5, 0]}
    assert search.diversify(ranked, 4, near) == [7, 3, 5, 2]  # three nearest, then a neighbour of the best
    assert search.diversify(ranked, 4, near, alpha=0.5) == [7, 3, 2, 9]
    assert search.diversify(ranked, 4, {}, alpha=0.5) == [7, 3, 5, 1]
    assert search.diversify(ranked, 99, near) == [7, 3, 5, 1, 9, 2]
    assert search.diversify([], 4, near) == [] and search.diversify(ranked, 0, near) == []


def test_tree_opens_more_with_a_wider_beam(spark):
    docs, queries = src.load_split(spark, DATA)
    tree = search.kmeans_tree(docs, 16, 4, 2)
    exact = topk.top_k(docs, queries, 10, "cosine")
    recalls = []
    for beam in (1, 100, 10_000):
        cand = search.candidates(search.tree_probes(tree, queries, beam), tree.postings)
        recalls.append(metrics.recall(exact, cand, queries).agg(F.avg("recall")).first()[0])
    assert recalls == sorted(recalls) and recalls[-1] == 1.0


def test_tree_round_trip(spark, tmp_path):
    docs, queries = src.load_split(spark, DATA)
    tree = search.kmeans_tree(docs, 16, 4, 2)
    tree.save(str(tmp_path / "tree"))
    again = search.KMeansTree.load(spark, str(tmp_path / "tree"))
    assert again.search(queries, 60, 5).collect() and set(again.search(queries, 60, 5).collect()) == set(tree.search(queries, 60, 5).collect())


def test_descents_on_the_driver_and_on_executors_are_the_same(spark, monkeypatch):
    docs, queries = src.load_split(spark, DATA)
    tree = search.kmeans_tree(docs, 16, 4, 2)
    here = set(tree.search(queries, 60, 5).collect())
    monkeypatch.setattr(search, "FEW_DESCENTS", 0)
    assert here and set(tree.search(queries, 60, 5).collect()) == here


@pytest.mark.parametrize("metric", ["ip", "cosine", "l2"])
def test_search_in_lists_is_the_same_as_fetching(spark, metric):
    x, q = RNG.standard_normal((200, 5)).round(1), RNG.standard_normal((30, 5)).round(1)
    docs, queries = vector_frame(spark, x).repartition(5), vector_frame(spark, q, range(500, 530))
    centers = x[:12]
    for lists in (1, 3):
        members = search.members(docs, centers, lists)
        probes = search.probe(clustering.centroid_frame(spark, centers).withColumnRenamed("vec_id", "center_id"), queries, 4)
        listed = found(topk.list_top_k(members, probes, queries, 7, metric, lists))
        assert listed == found(topk.rerank(search.candidates(probes, members), docs, queries, 7, metric)) and len(listed) == 30


@pytest.mark.parametrize("lists", [1, 3])
def test_candidates_are_counted_without_being_listed(spark, lists):
    docs, queries = src.load_split(spark, DATA)
    centers = clustering.kmeans(docs, 8, max_iter=2, tol=-1, init="first")[0]
    members = search.members(docs, centers, lists)
    probes = search.probe(clustering.centroid_frame(spark, centers).withColumnRenamed("vec_id", "center_id"), queries.limit(20), 3)
    got = metrics.shares(search.candidate_counts(probes, members, lists), queries, docs.count())
    assert sorted(got.collect()) == sorted(metrics.candidate_share(search.candidates(probes, members), queries, docs.count()).collect())


@pytest.mark.parametrize("name", ["candidate_share", "share_histogram"])
def test_shares_make_no_pairs(spark, name):
    """Pairs of a query and a candidate grow with the square of the table."""
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [query_id" in plan and not re.search(r"Aggregate \[query_id#\d+L, vec_id#", plan)


@pytest.mark.parametrize("lists", [1, 3])
def test_reference_rows_look_up_their_lists(spark, lists):
    docs, queries = src.load_split(spark, DATA)
    centers = clustering.kmeans(docs, 8, max_iter=2, tol=-1, init="first")[0]
    members = search.members(docs, centers, lists)
    probes = search.probe(clustering.centroid_frame(spark, centers).withColumnRenamed("vec_id", "center_id"), queries.limit(30), 4)
    exact = topk.top_k(docs, queries, 7)
    got = {(r["query_id"], r["vec_id"]): r["rank"] for r in search.hit_ranks(exact, probes, members).collect()}
    assert set(got) == {(r["query_id"], r["vec_id"]) for r in exact.collect()}
    for top in (1, 2, 4):
        want = {(r["query_id"], r["vec_id"]) for r in search.candidates(probes.filter(f"rank <= {top}"), members).collect()} & set(got)
        assert {p for p, rank in got.items() if rank is not None and rank <= top} == want


@pytest.mark.parametrize("name", ["ivf_recall_curve", "ivf_recall_curve_binary", "kcenter_recall"])
def test_recall_looks_up_the_reference_only(spark, name):
    """The lists' members meet the exact results by id; met with the probes alone they would make all candidates."""
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    joins = re.findall(r"Join (?:Inner|LeftOuter), \(+(\w+)#", plan)
    assert "vec_id" in joins and not re.search(r"Join \w+, \(center_id#\d+L = center_id#\d+L\)", plan)


@pytest.mark.parametrize("lists", [1, 3])
@pytest.mark.parametrize("pairs", [1 << 19, 7])
def test_listed_documents_give_each_candidate_once(spark, lists, pairs, monkeypatch):
    docs, queries = (compress.binary_codes(x, 64) for x in src.load_split(spark, DATA))
    centers = clustering.kcenter(docs, 8)
    probes = search.probe(centers.frame(spark), queries.limit(20), 2, "hamming", "code")
    want = sorted(tuple(r) for r in search.candidates(probes, centers.assign(docs, lists)).collect())
    got = search.list_candidates(centers.listed(docs, lists), probes, queries, "code")
    assert sorted(tuple(r) for r in got.collect()) == want
    monkeypatch.setattr(search, "PAIRS", pairs)
    rows = centers.listed(docs, lists).toArrow().combine_chunks()
    ids, q = next(topk.query_blocks(queries, "code"))
    found = [b for b in search._pairs_in_lists(ids, topk.list_askers(probes, ids, q))(iter(rows.to_batches()))]
    assert sorted((x["query_id"], x["vec_id"]) for b in found for x in b.to_pylist()) == want and max(b.num_rows for b in found) < 2 * pairs + docs.count()


def test_probed_candidates_are_not_shuffled(spark):
    plan = QUERIES["kcenter_probe"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "HashAggregate" not in plan


def test_list_index_round_trip(spark, tmp_path):
    docs, queries = src.load_split(spark, DATA)
    index = search.list_index(docs, clustering.kmeans(docs, 8, max_iter=2, tol=-1, init="first")[0])
    index.save(str(tmp_path / "lists"))
    assert set(search.ListIndex.load(spark, str(tmp_path / "lists")).search(queries, 2, 5).collect()) == set(index.search(queries, 2, 5).collect())


def test_many_scores_are_cut_as_they_come(monkeypatch):
    best = topk.Best(3, 4)
    monkeypatch.setattr(best, "room", 20)
    rows = []
    for _ in range(40):
        part = [(int(r), float(d), int(i)) for r, d, i in zip(RNG.integers(0, 3, 9), RNG.integers(0, 5, 9), RNG.integers(0, 10_000, 9))]
        rows += part
        best.add(*(np.array(c) for c in zip(*part)))
        assert best.held <= 29
    want = [x for r in range(3) for x in sorted(p for p in rows if p[0] == r)[:4]]
    assert list(zip(*(c.tolist() for c in best.cut()))) == want


@pytest.mark.parametrize("metric", ["ip", "cosine", "l2", "hamming"])
def test_later_blocks_are_only_looked_at_up_to_the_worst_result(metric, monkeypatch):
    """Documents come in any order of ids, with ties and with scores that are equal after rounding only."""
    rng, calls, whole = np.random.default_rng(5), [], topk.best
    x = np.vstack([np.round(rng.standard_normal((600, 4))), rng.standard_normal((300, 4))])
    x[500:560] = x[500] + rng.standard_normal((60, 4)) * 1e-7
    x = kernels.pack_bits(rng.standard_normal((900, 64)) >= 0) if metric == "hamming" else x
    ids, q = rng.permutation(len(x)) * 7, x[::20]
    batches = [pa.RecordBatch.from_arrays([pa.array(ids[i : i + 90]), kernels.lists(x[i : i + 90])], names=["vec_id", "v"]) for i in range(0, len(x), 90)]
    monkeypatch.setattr(topk, "SCORES", 30 * len(q))
    monkeypatch.setattr(topk, "best", lambda *a: calls.append(0) or whole(*a))
    for k, most in ((1, 15), (12, 15), (30, 30), (2000, 30)):  # of 30 blocks
        calls.clear()
        got = list(topk._local(np.arange(len(q)), q, metric, k, 6)(iter(batches)))
        distance = np.round(topk.METRICS[metric][0](q, x).astype(float), 6) + 0.0
        want = [(i, int(ids[j]), distance[i, j] * topk.METRICS[metric][1] + 0.0) for i in range(len(q)) for j in np.lexsort((ids, distance[i]))[:k]]
        assert [tuple(r.values()) for b in got for r in b.to_pylist()] == want and len(calls) <= most


def test_very_many_ties_are_cut_block_by_block(monkeypatch):
    held, add = [], topk.Best.add
    monkeypatch.setattr(topk.Best, "add", lambda self, row, *x: held.append(len(row)) or add(self, row, *x))
    found = topk.Best(2, 3)
    for ids in np.split(np.arange(400)[::-1], 8):  # all are as near, and those that come later go before
        found.add_block(np.zeros((2, 50)), ids, 6)
    assert max(held) <= 6 and found.cut()[2].tolist() == [0, 1, 2] * 2


@pytest.mark.parametrize("metric", ["l2", "hamming"])
def test_centers_are_probed_where_the_queries_lie(spark, metric, monkeypatch):
    docs, queries = src.load_split(spark, DATA)
    col, (a, b) = ("v", (docs, queries)) if metric == "l2" else ("code", (compress.binary_codes(x, 64) for x in (docs, queries)))
    centers = a.filter("vec_id < 20").withColumnRenamed("vec_id", "center_id")
    want = topk.top_k(a.filter("vec_id < 20"), b, 6, metric, col).selectExpr("query_id", "rank", "vec_id as center_id")
    got = search.probe(centers, b, 6, metric, col)
    assert got.dtypes == want.dtypes and sorted(got.collect()) == sorted(want.collect())
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert search.probe(centers, b, 99, metric, col).count() == 20 * b.count()
    assert not search.probe(centers, b, 0, metric, col).count() and not search.probe(centers.limit(0), b, 6, metric, col).count()
    monkeypatch.setattr(topk, "FEW", 19)
    assert sorted(search.probe(centers, b, 6, metric, col).collect()) == sorted(want.collect())


def test_graph_finds_itself_and_nearly_all(spark, tmp_path):
    docs, _ = src.load_split(spark, DATA)
    codes = compress.binary_codes(docs, 64)
    exact = topk.hamming_top_k(codes, codes, 3)
    for rows in (10_000, 100):  # one graph, several
        index = search.graph_index(codes, rows=rows)
        got = search.graph_search(index, codes, 3)
        hits = found(got, "distance")
        assert len(hits) == docs.count() and all(h[0][1] == 0 for h in hits.values())
        assert metrics.recall(exact, got).agg(F.avg("recall")).first()[0] > 0.97
    index.save(str(tmp_path / "graph"))
    assert set(search.graph_search(search.GraphIndex.load(spark, str(tmp_path / "graph")), codes, 3).collect()) == set(got.collect())


def test_graph_layers_and_links():
    x = kernels.pack_bits(RNG.standard_normal((600, 128)) >= 0)
    level, layers = search.layered_graph(np.arange(600), x, 8)
    assert len(layers) == level.max() + 1 > 1 and 600 / 16 < (level > 0).sum() < 600 / 4
    for k, links in enumerate(layers):
        assert set(links) == set(np.flatnonzero(level >= k).tolist())
        assert all(len(n) <= (16 if k == 0 else 8) and len(set(n)) == len(n) and i not in n for i, n in links.items())
    d = kernels.hamming(x, x)
    hit = 0
    for i in range(0, 600, 5):
        walk = search.walk_graph(x[i], x, layers, int(level.argmax()), 40)
        assert walk == sorted(walk) and len(walk) == 40 and all(d[i, j] == e for e, j in walk)
        hit += len({j for _, j in walk[:5]} & set(np.lexsort((np.arange(600), d[i]))[:5].tolist()))
    assert hit / (120 * 5) > 0.9


def test_codes_can_be_added_to_a_graph(spark):
    x = kernels.pack_bits(RNG.standard_normal((90, 64)) >= 0)
    index = search.graph_index(code_frame(spark, x[:60]), rows=25)
    more = search.add(index, code_frame(spark, x[60:], range(60, 90)))
    assert more.nodes.count() == 90 and more.nodes.select("shard").distinct().count() > index.nodes.select("shard").distinct().count()
    hits = found(search.graph_search(more, code_frame(spark, x), 1), "distance")
    assert all(hits[i][0] == (i, 0) for i in range(90))


def test_streaming_encode(spark, tmp_path):
    from vecspark.streaming import encode

    x = RNG.standard_normal((12, 64))
    vector_frame(spark, x).write.parquet(str(tmp_path / "in"))
    c = x[:3]
    encode.start(encode.read(spark, str(tmp_path / "in")), c, 64, str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out" / "codes")).count() == 12
    got = {r["vec_id"]: r["label"] for r in spark.read.parquet(str(tmp_path / "out" / "postings")).collect()}
    assert [got[i] for i in range(12)] == clustering.nearest(x, c)[0].tolist()


def test_latency_curve_and_warm_up(spark):
    from vecspark.operators import harness

    rows = harness.latency_curve(spark, [50, 100], 8).collect()
    assert [r["n_vecs"] for r in rows] == [50, 100] and all(r["time_ms"] > 0 for r in rows)


def test_knn_graph_crosses_ranges_of_ids(spark):
    rng = np.random.default_rng(12)
    c = rng.integers(0, 1 << 6, (40, 1))
    ids = np.arange(40) * 5000  # several shards
    df = spark.createDataFrame([(int(i), [int(v) for v in r]) for i, r in zip(ids, c)], "vec_id long, code array<long>")
    d = np.bitwise_count(c[:, None, 0] ^ c[None, :, 0]).astype(int)
    want = {(int(ids[i]), r + 1, int(ids[j]), int(d[i, j])) for i in range(40) for r, j in enumerate(sorted((j for j in range(40) if j != i), key=lambda j: (d[i, j], j))[:4])}
    got = [tuple(r) for r in search.knn_graph(df, 4).select("vec_id", "rank", "nbr", "distance").collect()]
    assert len(got) == len(want) and set(got) == want
