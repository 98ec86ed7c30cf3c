"""The registered queries over the embeddings table: documents are the first 90 % of the ids, queries the rest."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecspark.functions import vectors as V
from vecspark.operators import clustering, compress, harness, metrics, search
from vecspark.operators.topk import hamming_top_k, list_top_k, pair_scores, rerank, top_k
from vecspark.sources import vectors as src

DIM, K = 64, 10
OVERSAMPLE = [1, 2, 5, 10]
PCA_FACTOR, LSH_BITS = 4, (16, 32)
IVF_K, IVF_PROBES, IVF_STEPS, ROUNDS = 16, 4, [1, 2, 4, 8, 16], 3
CHUNK_ROWS, CHUNK_K = 150, 5
KCENTER_K, KCENTER_TOP, KCENTER_SLOTS = 16, 4, 3
TWO = {"k1": 16, "k2": 64, "p1": 4, "p2": 10}
LOCAL = {"k1": 16, "k2": 4, "p1": 4, "p2": 8}
TREE = {"n1": 32, "n2": 8, "n3": 3, "beam": 60}
GRAPH_M, GRAPH_TOP, GRAPH_BEAM = 16, 3, 256
WIDE = src.CATALOGUE["wide"].dim

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str | None = None, **fixed):
    def add(f):
        QUERIES[name or f.__name__] = partial(f, **fixed) if fixed else f
        return f

    return add


def _split(spark, d):
    return src.load_split(spark, d)


def _r(c, n=6):
    return F.round(c, n) + F.lit(0.0)


def _codes(x, bits=None, strict=False):
    return compress.binary_codes(x, DIM, bits, strict=strict)


def _word(codes):
    return codes.select("vec_id", F.col("code")[0].alias("code"))


# ---- reading and vector functions


@register()
def scan_split(spark, d):
    docs, queries = _split(spark, d)
    return docs.select(F.lit("docs").alias("part"), "vec_id").union(queries.select(F.lit("queries"), "vec_id")).groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first_id"), F.max("vec_id").alias("last_id"))


@register()
def chunk_range(spark, d):
    return src.with_chunk(src.load(spark, d), CHUNK_ROWS).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first_id"))


@register()
def vec_norms(spark, d):
    return src.load(spark, d).select("vec_id", _r(V.norm("v")).alias("norm"))


@register()
def row_normalize(spark, d):
    return src.load(spark, d).select("vec_id", F.posexplode(V.normalise("v")).alias("pos", "x")).select("vec_id", "pos", _r(F.col("x")).alias("x"))


@register()
def global_norm(spark, d):
    return V.global_normalise(src.load(spark, d)).select("vec_id", _r(V.norm("v"), 9).alias("norm"))


@register("dot_pairs", metric="ip")
@register("l2_pairs", metric="l2")
@register("unitnorm_l2", metric="unit")
@register("cosine_distance", metric="cosine")
def all_pairs(spark, d, metric):
    """The scores of all documents against the queries, a stated set, in blocks."""
    scores = pair_scores(*_split(spark, d), "ip" if metric == "unit" else metric, decimals=12)
    s = F.col("score")
    value = {"ip": s, "l2": s, "unit": 2 - 2 * s, "cosine": 1 - s}[metric]
    return scores.select("query_id", "vec_id", _r(value).alias("score" if metric == "ip" else "distance"))


@register()
def vector_functions(spark, d):
    """The column functions on one pair for each document: it and a query, dealt in turn."""
    docs, queries = _split(spark, d)
    size = queries.agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n")).first()
    pairs = docs.withColumn("query_id", F.col("vec_id") % F.lit(size["n"]) + F.lit(size["first"])).join(queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")
    return pairs.select("query_id", "vec_id", _r(V.dot("v", "q")).alias("dot"), _r(V.squared_l2("v", "q")).alias("l2"), _r(V.unit_squared_l2("v", "q")).alias("unit_l2"), _r(V.cosine_distance("v", "q")).alias("cosine_distance"))


@register()
def dim_means(spark, d):
    return V.means(src.load(spark, d)).select("pos", _r(F.col("mean"), 9).alias("mean"))


@register()
def center_vectors(spark, d):
    return V.centre(src.load(spark, d)).select("vec_id", F.posexplode("v").alias("pos", "x")).select("vec_id", "pos", _r(F.col("x")).alias("x"))


@register("random_uniform", normal=False)
@register("random_normal", normal=True)
def random_values(spark, d, normal):
    """Values hang on the seed, the id and the position alone; of all of them the mean and spread per position too."""
    x = src.random_vectors(spark, 1000, 8, normal).select("vec_id", F.posexplode("v").alias("pos", "x"))
    total = x.groupBy("pos").agg(_r(F.avg("x")).alias("mean"), _r(F.stddev("x")).alias("spread"))
    return x.filter("vec_id < 50").join(total, "pos").select("vec_id", "pos", _r(F.col("x"), 9).alias("x"), "mean", "spread")


# ---- exact search


@register("exact_topk_ip", metric="ip")
@register("exact_topk_cosine", metric="cosine")
@register("exact_topk_l2", metric="l2")
def exact_topk(spark, d, metric):
    return top_k(*_split(spark, d), K, metric)


@register()
def topk_clamped(spark, d):
    """More results are asked for than there are documents."""
    docs, queries = _split(spark, d)
    return top_k(queries, docs, 1_000_000).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("last_rank"))


# ---- compression


@register()
def rotate(spark, d):
    return compress.rotate(src.load(spark, d), DIM).select("vec_id", F.posexplode("v").alias("pos", "x")).select("vec_id", "pos", _r(F.col("x")).alias("x"))


@register()
def int8_quantize(spark, d):
    return compress.int8_vectors(src.load(spark, d), DIM).select("vec_id", F.posexplode("q").alias("pos", "q")).select("vec_id", "pos", F.col("q").cast("int").alias("q"))


@register()
def int8_topk(spark, d):
    return compress.search_variant("fp32_int8", *_split(spark, d), K, DIM)


@register()
def sign_codes(spark, d):
    return _word(_codes(src.load(spark, d)))


@register()
def sign_codes_strict(spark, d):
    return _word(_codes(src.load(spark, d), strict=True))


@register("lsh_codes_16", bits=16)
@register("lsh_codes_32", bits=32)
def lsh_codes(spark, d, bits):
    return _word(_codes(src.load(spark, d), bits))


@register()
def quant_error(spark, d):
    return compress.rotate(src.load(spark, d), DIM).select("vec_id", _r(V.quantisation_error("v")).alias("error"))


@register()
def fp16_roundtrip(spark, d):
    return compress.half_vectors(src.load(spark, d)).select("vec_id", F.posexplode("v").alias("pos", "x"))


@register()
def fp16_topk(spark, d):
    return compress.search_variant("fp16", *_split(spark, d), K, DIM)


@register()
def pca_explained(spark, d):
    p = compress.fit_pca(_split(spark, d)[0])
    rows = [(i, float(x)) for i, x in enumerate(p.variance)]
    return spark.createDataFrame(rows, "component int, variance double").select("component", _r(F.col("variance"), 9).alias("variance"))


@register("pca_topk", factor=PCA_FACTOR)
@register("pca_topk_full", factor=1)
def pca_topk(spark, d, factor):
    docs, queries = _split(spark, d)
    p = compress.fit_pca(docs)
    return top_k(p.reduce(docs, factor), p.reduce(queries, factor), K)


@register()
def pca_binary_topk(spark, d):
    docs, queries = _split(spark, d)
    p = compress.fit_pca(docs)
    n = compress.reduced(DIM, PCA_FACTOR)
    return hamming_top_k(*(compress.binary_codes(p.reduce(x, PCA_FACTOR), n) for x in (docs, queries)), K)


@register()
def int8_pca_topk(spark, d):
    return compress.search_variant("fp32_int8_pca4", *_split(spark, d), K, DIM)


@register()
def variant_matrix(spark, d):
    """Recall of every variant against exact search."""
    docs, queries = _split(spark, d)
    exact = top_k(docs, queries, K)
    out = None
    for name in compress.VARIANTS:
        row = metrics.mean_recall(exact, compress.search_variant(name, docs, queries, K, DIM)).select(F.lit(name).alias("variant"), "recall")
        out = row if out is None else out.union(row)
    return out.orderBy("variant")


# ---- binary search


@register()
def hamming_pairs(spark, d):
    found = pair_scores(*(_codes(x) for x in _split(spark, d)), "hamming", "code")
    return found.select("query_id", "vec_id", F.col("score").cast("int").alias("distance"))


@register("hamming_topk", k=K, bits=None)
@register("hamming_oversample", k=K * max(OVERSAMPLE), bits=None)
@register("lsh_topk", k=K, bits=LSH_BITS[1])
def hamming_search(spark, d, k, bits):
    docs, queries = _split(spark, d)
    return hamming_top_k(_codes(docs, bits), _codes(queries, bits), k)


@register("binary_recall_curve", bits=None)
@register("lsh_recall_curve", bits=LSH_BITS[1])
def recall_curve(spark, d, bits):
    docs, queries = _split(spark, d)
    deep = hamming_top_k(_codes(docs, bits), _codes(queries, bits), K * max(OVERSAMPLE))
    return metrics.recall_curve(top_k(docs, queries, K), deep, K, OVERSAMPLE)


@register()
def wide_codes(spark, d):
    """Codes with a second word, partly filled."""
    codes = compress.binary_codes(src.load(spark, d, "wide"), WIDE)
    return codes.select("vec_id", F.posexplode("code").alias("word", "bits"))


@register()
def wide_hamming_topk(spark, d):
    docs, queries = (compress.binary_codes(x, WIDE) for x in src.load_split(spark, d, "wide"))
    return hamming_top_k(docs, queries, K)


@register()
def wide_kcenter(spark, d):
    return clustering.kcenter(compress.binary_codes(src.load_split(spark, d, "wide")[0], WIDE), KCENTER_K).frame(spark).select("center_id", "vec_id")


@register()
def provider_recall(spark, d):
    """Recall of codes against exact search for each provider of the catalogue."""
    def one(docs, queries, dim):
        found = hamming_top_k(*(compress.binary_codes(x, dim) for x in (docs, queries)), K)
        return metrics.mean_recall(top_k(docs, queries, K), found)

    return harness.per_provider(spark, d, one)


@register()
def pca_recall_curve(spark, d):
    """Oversampled search over reduced vectors."""
    docs, queries = _split(spark, d)
    p = compress.fit_pca(docs)
    deep = top_k(p.reduce(docs, PCA_FACTOR), p.reduce(queries, PCA_FACTOR), K * max(OVERSAMPLE))
    return metrics.recall_curve(top_k(docs, queries, K), deep, K, OVERSAMPLE)


@register()
def binary_rerank(spark, d):
    """Oversampled codes, then exact scores."""
    docs, queries = _split(spark, d)
    return rerank(hamming_top_k(_codes(docs), _codes(queries), 5 * K), docs, queries, K)


# ---- evaluation


@register()
def recall_at_k(spark, d):
    docs, queries = _split(spark, d)
    return metrics.recall(top_k(docs, queries, K), hamming_top_k(_codes(docs), _codes(queries), K)).select("query_id", _r(F.col("recall")).alias("recall"))


@register()
def recall_oversample(spark, d):
    docs, queries = _split(spark, d)
    found = metrics.recall(top_k(docs, queries, K), hamming_top_k(_codes(docs), _codes(queries), 5 * K))
    return found.select("query_id", _r(F.col("recall"), 3).alias("recall"))


# ---- inverted lists


def _centroids(docs, k=IVF_K, rounds=ROUNDS):
    return clustering.kmeans(docs, k, max_iter=rounds, tol=-1.0, init="first")[0]


def _ivf(spark, d):
    """Documents, queries, and an index of lists under centroids that start from the first rows."""
    docs, queries = _split(spark, d)
    return docs, queries, search.list_index(docs, _centroids(docs))


@register()
def kmeans_lloyd_fixed(spark, d):
    c = _centroids(_split(spark, d)[0])
    return clustering.centroid_frame(spark, c).select(F.col("vec_id").cast("int").alias("label"), F.posexplode("v").alias("pos", "x")).select("label", "pos", _r(F.col("x")).alias("x"))


@register()
def kmeans_inertia(spark, d):
    docs = _split(spark, d)[0]
    return clustering.assign(docs, _centroids(docs)).agg(_r(F.sum("distance"), 6).alias("inertia"))


@register()
def ivf_assign(spark, d):
    docs = _split(spark, d)[0]
    return clustering.assign(docs, _centroids(docs)).select("vec_id", "label")


@register()
def ivf_list_offsets(spark, d):
    """Sizes of the lists and where each begins."""
    docs = _split(spark, d)[0]
    sizes = clustering.assign(docs, _centroids(docs)).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return sizes.withColumn("begin", F.coalesce(F.sum("n").over(Window.orderBy("label").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a list


@register()
def ivf_probe_float(spark, d):
    _, queries, index = _ivf(spark, d)
    return index.probe(queries, IVF_PROBES)


def _center_codes(centers):
    return _codes(centers.select(F.col("center_id").alias("vec_id"), "v")).select(F.col("vec_id").alias("center_id"), "code")


@register()
def ivf_probe_binary(spark, d):
    _, queries, index = _ivf(spark, d)
    return search.probe(_center_codes(index.centers), _codes(queries), IVF_PROBES, "hamming", "code")


@register()
def ivf_candidates(spark, d):
    _, queries, index = _ivf(spark, d)
    return search.candidates(index.probe(queries, IVF_PROBES), index.members)


@register()
def ivf_rerank(spark, d):
    _, queries, index = _ivf(spark, d)
    return index.search(queries, IVF_PROBES, K)


@register()
def ivf_saved_search(spark, d):
    """As ivf_rerank, from an index that was written and is read again."""
    _, queries, index = _ivf(spark, d)
    path = src.shared_path(spark, "lists")
    index.save(path)
    return search.ListIndex.load(spark, path).search(queries, IVF_PROBES, K)


def _probe_curve(spark, d, binary):
    docs, queries, index = _ivf(spark, d)
    top = max(IVF_STEPS)
    probes = search.probe(_center_codes(index.centers), _codes(queries), top, "hamming", "code") if binary else index.probe(queries, top)
    hits = search.hit_ranks(top_k(docs, queries, K), probes, index.members).select("rank", F.explode(F.array(*map(F.lit, IVF_STEPS))).alias("top"))  # a row a step
    return hits.groupBy("top").agg(_r(F.avg(F.when(F.col("rank") <= F.col("top"), 1.0).otherwise(0.0))).alias("recall"))


@register("ivf_recall_curve", binary=False)
@register("ivf_recall_curve_binary", binary=True)
def ivf_recall_curve(spark, d, binary):
    return _probe_curve(spark, d, binary)


def _share(spark, d):
    docs, queries, index = _ivf(spark, d)
    return metrics.shares(search.candidate_counts(index.probe(queries, IVF_PROBES), index.members), queries, docs.count())


@register()
def candidate_share(spark, d):
    return _share(spark, d)


@register()
def recall_quantiles(spark, d):
    docs, queries, index = _ivf(spark, d)
    found = search.candidates(index.probe(queries, IVF_PROBES), index.members)
    return metrics.quantiles(metrics.recall(top_k(docs, queries, K), found, queries), "recall")


@register()
def share_histogram(spark, d):
    return metrics.histogram(_share(spark, d), "share")


@register()
def global_kmeans(spark, d):
    """Clusters of vectors that were divided by the norm of the whole table."""
    docs = V.global_normalise(_split(spark, d)[0])
    return clustering.assign(docs, _centroids(docs)).select("vec_id", "label")


@register()
def chunked_ivf(spark, d):
    _, labels = clustering.chunked_kmeans(_split(spark, d)[0], CHUNK_ROWS, CHUNK_K, ROUNDS)
    return labels


@register()
def chunked_ivf_search(spark, d):
    docs, queries = _split(spark, d)
    centers, labels = clustering.chunked_kmeans(docs, CHUNK_ROWS, CHUNK_K, ROUNDS, vectors_too=True)
    probes = search.probe(_center_codes(centers), _codes(queries), IVF_PROBES, "hamming", "code")
    return list_top_k(labels, probes, queries, K)


@register()
def sharded_cluster_sizes(spark, d):
    _, labels = clustering.chunked_kmeans(_split(spark, d)[0], 225, 8, ROUNDS)
    return labels.select((F.col("center_id") / 8).cast("int").alias("shard"), (F.col("center_id") % 8).alias("cluster")).groupBy("shard", "cluster").agg(F.count(F.lit(1)).alias("n"))


# ---- k-center


def _kc(spark, d):
    codes = _codes(_split(spark, d)[0])
    return codes, clustering.kcenter(codes, KCENTER_K)


@register("kcenter_hamming")
@register("kcenter_many_passes", pass_points=100)
def kcenter_hamming(spark, d, pass_points=clustering.PASS_POINTS):
    """The same centers whether a pass brings all points or a few."""
    return clustering.kcenter(_codes(_split(spark, d)[0]), KCENTER_K, pass_points=pass_points).frame(spark).select("center_id", "vec_id")


@register()
def kcenter_l2(spark, d):
    return clustering.kcenter(_split(spark, d)[0], KCENTER_K, "l2", "v").frame(spark).select("center_id", "vec_id")


@register()
def kcenter_distinct(spark, d):
    """Centers that differ from each other."""
    return _kc(spark, d)[1].frame(spark).agg(F.count(F.lit(1)).alias("centers"), F.countDistinct("code").alias("distinct_centers"))


@register("kcenter_assign_top1", top=1)
@register("kcenter_assign_topL", top=KCENTER_SLOTS)
def kcenter_assigned(spark, d, top):
    codes, centers = _kc(spark, d)
    return centers.assign(codes, top).select("vec_id", "slot", "center_id", F.col("distance").cast("int").alias("distance"))


@register()
def kcenter_sizes(spark, d):
    codes, centers = _kc(spark, d)
    return centers.assign(codes).groupBy("center_id").agg(F.count(F.lit(1)).alias("n"))


@register()
def kcenter_majority(spark, d):
    codes, centers = _kc(spark, d)
    return centers.majority(codes).frame(spark).select("center_id", F.col("code")[0].alias("code"))


def _kcenter_search(spark, d):
    docs, queries = _split(spark, d)
    codes, q = _codes(docs), _codes(queries)
    centers = clustering.kcenter(codes, KCENTER_K)
    probes = search.probe(centers.frame(spark), q, KCENTER_TOP, "hamming", "code")
    return docs, queries, codes, q, centers, probes


@register()
def kcenter_probe(spark, d):
    _, _, codes, q, centers, probes = _kcenter_search(spark, d)
    return search.list_candidates(centers.listed(codes, KCENTER_SLOTS), probes, q, "code")


@register()
def kcenter_recall(spark, d):
    docs, queries, codes, _, centers, probes = _kcenter_search(spark, d)
    hits = search.hit_ranks(top_k(docs, queries, K), probes, centers.assign(codes, KCENTER_SLOTS))
    return hits.groupBy("query_id").agg(_r(F.avg(F.when(F.col("rank").isNotNull(), 1.0).otherwise(0.0))).alias("recall"))


# ---- two layers


def _two(spark, d):
    docs, queries = _split(spark, d)
    return search.two_layer_index(_codes(docs), TWO["k1"], TWO["k2"]), _codes(queries)


@register()
def two_layer_adjacency(spark, d):
    return _two(spark, d)[0].adjacency


@register()
def two_layer_neighbors(spark, d):
    return _two(spark, d)[0].neighbours


@register("two_layer_or", both=False)
@register("two_layer_and", both=True)
@register("two_layer_diversified", both=True, diversified=True)
def two_layer(spark, d, both, diversified=False):
    index, q = _two(spark, d)
    return search.cascade(index, q, TWO["p1"], TWO["p2"], both, diversified)


@register("local_l2_or", both=False)
@register("local_l2_and", both=True)
def local_l2(spark, d, both):
    docs, queries = _split(spark, d)
    return search.local_cascade(search.local_index(_codes(docs), LOCAL["k1"], LOCAL["k2"]), _codes(queries), LOCAL["p1"], LOCAL["p2"], both)


# ---- tree and graph


def _tree(spark, d):
    docs, queries = _split(spark, d)
    return docs, queries, search.kmeans_tree(docs, TREE["n1"], TREE["n2"], TREE["n3"], rounds=ROUNDS)


@register()
def kmeans_tree_levels(spark, d):
    return _tree(spark, d)[2].edges(spark)


@register()
def kmeans_tree_postings(spark, d):
    return _tree(spark, d)[2].postings.groupBy("center_id").agg(F.count(F.lit(1)).alias("n"))


@register()
def kmeans_tree_search(spark, d):
    docs, queries, tree = _tree(spark, d)
    return tree.search(queries, TREE["beam"], K)


@register()
def tree_stats(spark, d):
    _, queries, tree = _tree(spark, d)
    probes = search.tree_probes(tree, queries, TREE["beam"])
    n = search.candidates(probes, tree.postings).groupBy("query_id").agg(F.count(F.lit(1)).alias("candidates"))
    return probes.filter("rank = 1").drop("rank", "center_id").join(n, "query_id")


@register()
def knn_graph(spark, d):
    return search.knn_graph(_codes(_split(spark, d)[0]), GRAPH_M)


@register("graph_search", rows=search.GRAPH_ROWS)
@register("graph_search_shards", rows=200)
def graph_search(spark, d, rows):
    """A walk over layered graphs; with a beam this wide it finds what exact search finds on small tables."""
    docs, queries = _split(spark, d)
    return search.graph_search(search.graph_index(_codes(docs), GRAPH_M, rows=rows), _codes(queries), GRAPH_TOP, GRAPH_BEAM)


# ---- stores, byte codes, reports


@register()
def byte_codes(spark, d):
    return src.load(spark, d).select("vec_id", F.hex(V.byte_code("v")).alias("code"))


@register()
def latency_curve(spark, d):
    """Wall time of exact search by the number of random vectors."""
    return harness.latency_curve(spark, [1000, 2000], DIM)


@register()
def csv_results(spark, d):
    """Search results written as CSV and read again."""
    path = src.shared_path(spark, "csv")
    src.write_csv(hamming_search(spark, d, K, None), path)
    return spark.read.option("header", True).schema("query_id long, rank int, vec_id long, distance int").csv(path)


@register()
def rotated_kmeans(spark, d):
    """Clusters of rotated vectors are those of the vectors."""
    docs = compress.rotate(_split(spark, d)[0], DIM)
    return clustering.assign(docs, _centroids(docs)).select("vec_id", "label")


@register()
def stored_clusters(spark, d):
    """K-means of each shard, written by cluster; a query reads the files of its two best clusters."""
    docs, queries = _split(spark, d)
    centers, labels = clustering.chunked_kmeans(docs, 225, 8, ROUNDS)
    path = src.shared_path(spark, "clusters")
    src.write_clusters(search.clusters_of(labels, docs, 8), path)
    return search.stored_cluster_search(path, centers, queries, 8, 2, K)


@register()
def union_and_intersection(spark, d):
    """Candidates of two probes: in either, in both, appended."""
    _, queries, index = _ivf(spark, d)
    a = search.candidates(index.probe(queries, 2), index.members)
    b = search.candidates(index.probe(queries, 2, "ip"), index.members)
    return a.union(b).groupBy("query_id").agg(F.count(F.lit(1)).alias("appended"), F.countDistinct("vec_id").alias("in_either")).join(
        a.intersect(b).groupBy("query_id").agg(F.count(F.lit(1)).alias("in_both")), "query_id", "left").select("query_id", "appended", "in_either", F.coalesce("in_both", F.lit(0)).alias("in_both"))


@register("cascade_report_and", both=True)
@register("cascade_report_or", both=False)
def cascade_report(spark, d, both):
    docs, queries = _split(spark, d)
    index, q = search.two_layer_index(_codes(docs), TWO["k1"], TWO["k2"]), _codes(queries)
    found = search.cascade(index, q, TWO["p1"], TWO["p2"], both)
    return harness.report(top_k(docs, queries, 5, "cosine"), found, queries, docs.count())
