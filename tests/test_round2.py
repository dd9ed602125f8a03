"""Round 2: nothing is capped, cut or truncated."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from riskloom.operators import graph as G
from riskloom.operators import preprocess as P
from riskloom.operators.split import stratified_folds


def chain(spark, n):
    v = spark.range(n).select(F.format_string("card:%05d", "id").alias("id"), F.lit("card").alias("type"), F.lit("x").alias("value"))
    e = spark.range(n - 1).select(F.format_string("card:%05d", "id").alias("src"), F.format_string("card:%05d", F.col("id") + 1).alias("dst"),
                                  F.lit("co_device").alias("edge_type"), F.lit(None).cast("string").alias("shared_device"))
    return G.Graph(v, lambda: e)


def test_long_chain_is_one_component(spark):
    out = G.components(chain(spark, 150)).agg(F.countDistinct("component"), F.min("graph_component_size")).first()
    assert tuple(out) == (1, 150)


def test_pagerank_raises_without_convergence(spark):
    with pytest.raises(RuntimeError):
        G.pagerank(chain(spark, 30), max_iter=5, tol=0.0)


def test_encode_many_values_and_unseen(spark):
    enc = spark.range(60000).select(F.lit("c").alias("column"), F.concat(F.lit("v"), "id").alias("value"), F.col("id").cast("int").alias("code"))
    prep = P.Preprocessor(enc, None, ["c"], [])
    df = spark.createDataFrame([("v7",), ("v59999",), ("new",), (None,)], "c string")
    assert sorted(r["c"] for r in P.encode(df, prep).collect()) == [-1, -1, 7, 59999]


def test_median_of_integers_is_not_truncated(spark):
    med = spark.createDataFrame([("n", 1.5)], "column string, median double")
    prep = SimpleNamespace(medians=med, num_cols=["n"], cat_cols=[])
    out = P.impute(spark.createDataFrame([(1,), (2,), (None,)], "n int"), prep)
    assert sorted(r["n"] for r in out.collect()) == [1.0, 1.5, 2.0]


def test_folds_keep_rows_without_label(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else i % 2) for i in range(20)], "TransactionID long, isFraud int")
    assert stratified_folds(df, 5).count() == 20


def test_walk_queries_and_trees_use_the_full_parameters(monkeypatch):
    from riskloom.config import GbtParams, WalkParams
    from riskloom.plans import queries as Q
    monkeypatch.setattr(Q, "_graph", lambda spark, sf_dir: None)
    monkeypatch.setattr(Q.embed, "random_walks", lambda g, params: params)
    monkeypatch.setattr(Q.embed, "word2vec_embeddings", lambda walks, params: walks)
    for query in (Q.graph_walks, Q.node_embeddings):
        assert query(None, "") == WalkParams() and query(None, "").num_walks == 50
    assert GbtParams().max_depth == 8


def test_latency_histogram_follows_the_data(spark, monkeypatch):
    from riskloom.plans import queries as Q
    rows = spark.createDataFrame([(1, 100, 0.0), (1, 102, 0.0), (1, 99, 0.0), (2, 50, 0.0)], "batch_id long, ts long, latency_ms double")
    monkeypatch.setattr(Q, "fixed_predictions", lambda spark, sf_dir: rows)
    got = {r["le"]: (r["count"], r["sum_seconds"]) for r in Q.latency_histogram(spark, "").collect()}
    assert got["0.01"] == (2, 5.0) and got["2.5"] == (3, 5.0) and got["+Inf"] == (4, 5.0)
