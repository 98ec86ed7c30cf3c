import subprocess
import sys

from helpers import ROOT

WITHOUT = """
import sys, warnings
warnings.simplefilter("error")
sys.modules["vecspark.llm"] = None
sys.modules["corpus_pipeline"] = None
import __spark_entry__ as e
assert "exact_topk_cosine" in e.queries() and set(e.oracle_sql()) <= set(e.queries())
assert not [q for q in e.queries() if q.startswith("op1_") or q == "pipeline"]
"""


def test_entry_stands_without_the_training_data_operators():
    subprocess.run([sys.executable, "-c", WITHOUT], cwd=ROOT, check=True)


def test_entry_query(spark):
    sys.path.insert(0, ROOT)
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["query_id", "rank", "vec_id", "score"]
    assert set(e.oracle_sql()) <= set(e.queries())
