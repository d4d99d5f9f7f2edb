"""The registered queries and their SQL twins fit together."""

import os
import subprocess
import sys
import warnings

import __spark_entry__ as contract
from newsloom.plans import load_registry

ROWS_ONLY = {"a9_prune_html", "e2_batch_model_map", "k3_threshold_sweep", "k6_claim_recall"}


def test_every_query_has_a_twin_or_is_known_without():
    without = set(contract.queries()) - set(contract.oracle_sql())
    assert {n for n in without if n in load_registry()} == ROWS_ONLY


def test_core_queries_stay_without_the_subpackage(monkeypatch):
    monkeypatch.setitem(sys.modules, "newsloom.llm.queries", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    with warnings.catch_warnings(record=True):
        assert set(contract.queries()) == set(load_registry()) >= set(contract.oracle_sql())


def test_workers_have_the_package_from_any_folder(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {os.path.dirname(os.path.abspath(contract.__file__))!r})
import __spark_entry__ as contract
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.ui.enabled", "false").config(
    "spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate()
print("rows", contract.queries()["a9_prune_html"](spark, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "rows" in done.stdout, done.stderr[-2000:]


def test_entry_gives_ranked_lists(spark):
    df = contract.entry(spark)
    assert {"user_id", "rank", "article_id", "total_score"} <= set(df.columns)
    rows = df.collect()
    assert rows and min(r["rank"] for r in rows) == 1


def test_streams_read_back_what_they_wrote(spark):
    folder = "/root/testdata/sf0.001"
    got = contract.queries()["m5_stream_expiry"](spark, folder)
    batch = contract.queries()["i2_drop_expired"](spark, folder)
    assert got.columns == ["call_id", "run_id"] and got.count() > 0 and batch.count() == 5
