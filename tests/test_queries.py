import duckdb
import pytest
from helpers import DATA

from vecspark.plans.oracles import oracles
from vecspark.plans.queries import QUERIES

SQL = oracles()
#: One or more of each kind; the driver compares all of them.
NAMES = [
    "scan_split", "row_normalize", "dim_means", "exact_topk_l2", "int8_topk", "lsh_codes_16", "binary_recall_curve", "pca_topk_full", "ivf_rerank",
    "recall_quantiles", "chunked_ivf", "kcenter_l2", "kcenter_majority", "two_layer_or", "two_layer_neighbors", "local_l2_and", "knn_graph",
    "fp16_topk", "variant_matrix", "vector_functions", "wide_hamming_topk", "ivf_recall_curve_binary", "chunked_ivf_search", "kcenter_many_passes",
    "two_layer_diversified", "kmeans_tree_levels", "kmeans_tree_search", "tree_stats", "graph_search_shards", "csv_results", "union_and_intersection",
]


@pytest.mark.parametrize("name", NAMES)
def test_query_gives_what_the_sql_gives(spark, name):
    a = QUERIES[name](spark, DATA).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    b = con.execute(SQL[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (a, b))
    assert len(a) == len(b) and all((a[c].to_numpy() == b[c].to_numpy()).all() for c in cols)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_rank_limit_reaches_the_plan(spark):
    plan = QUERIES["exact_topk_ip"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_id_filter_reaches_the_scan(spark):
    from vecspark.sources import vectors as src

    plan = src.chunk(src.load(spark, DATA), 10, 5).select("vec_id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(vec_id,10)" in plan and "embedding" not in plan.split("ReadSchema")[1]
