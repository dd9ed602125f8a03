"""Round 4: results are worked out once, and steps grow no faster than their input."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F


def full_tree(rng, depth, n_feat, tree=0):
    """Nodes of a full tree with random splits, its ids counted in pre-order."""
    rows = []

    def grow(d, cover):
        at = len(rows)
        rows.append(None)
        if d == 0:
            rows[at] = (tree, at, rng.normal(), -1, -1, -1, 0.0, cover)
        else:
            part = rng.uniform(0.2, 0.8)
            left, right = grow(d - 1, cover * part), grow(d - 1, cover * (1 - part))
            rows[at] = (tree, at, 0.0, left, right, int(rng.integers(n_feat)), rng.normal(), cover)
        return at

    grow(depth, 100.0)
    return pd.DataFrame(rows, columns=["treeID", "id", "prediction", "leftChild", "rightChild", "feature", "threshold", "cover"])


@pytest.mark.parametrize("depth, n_feat", [(0, 2), (4, 3), (8, 40), (9, 40)])
def test_shared_value_tables_and_patterns_equal_those_of_each_leaf(depth, n_feat):
    from riskloom.operators import explain
    rng = np.random.default_rng(depth)
    nodes = pd.concat([full_tree(rng, depth, n_feat, t) for t in range(3)], ignore_index=True)
    every, x = explain.leaves(nodes), rng.normal(size=(50, n_feat))
    most = max(len(leaf.features) for leaf in every)
    tables, codes = explain.value_tables(every, at_once=100), list(explain.patterns(nodes, x.T, most))
    assert len(codes) == len(tables) == len(every) == 3 * 2 ** depth
    for leaf, table, code in zip(every, tables, codes):
        assert (leaf.pattern(x) == code).all()
        if len(leaf.features):
            assert np.allclose(leaf.values(), table.T, atol=1e-12, rtol=0)


def test_value_tables_share_their_steps():
    from riskloom.operators import explain
    rng = np.random.default_rng(1)
    every = explain.leaves(pd.concat([full_tree(rng, 8, 40, t) for t in range(4)], ignore_index=True))
    began = time.process_time()
    one = [leaf.values() for leaf in every]
    alone = time.process_time() - began
    began = time.process_time()
    explain.value_tables(every)
    assert time.process_time() - began < 0.6 * alone and len(one) == 1024


def test_trained_state_and_report_are_files(spark):
    """What scores and reports read again is not computed again."""
    from riskloom.config import Config, ForestParams, GbtParams
    from riskloom.operators import graph as G
    from riskloom.plans import train as tr
    from riskloom.sources.tables import merged_transactions
    df = merged_transactions(spark, "/root/testdata/sf0.001")
    art, report = tr.train(spark, df, Config(gbt=GbtParams(max_iter=2, max_depth=2), forest=ForestParams(n_trees=5)))
    e = art.entity_stats
    for t in (report, art.card_stats.table, e.device, e.email, e.addr, e.card, art.node_features, art.graph.vertices, art.graph.edges,
              G.degrees(art.graph)):
        assert t.inputFiles() and "events.parquet" not in "".join(t.inputFiles())
        assert "Exchange" not in t._jdf.queryExecution().executedPlan().toString()


def small_graph(spark):
    from riskloom.operators import graph as G
    edges = [("card:a", "card:b"), ("card:a", "card:c"), ("card:b", "card:c"), ("card:c", "card:d"), ("card:d", "device:x"), ("card:a", "device:x")]
    v = spark.createDataFrame([(n, n[:4], n[-1]) for n in sorted({x for e in edges for x in e} | {"card:z"})], "id string, type string, value string")
    e = spark.createDataFrame([(a, b, "t", None) for a, b in edges], "src string, dst string, edge_type string, shared_device string")
    return G.Graph(v, lambda: e), edges


@pytest.mark.parametrize("p, q, per_pass", [(1.0, 0.5, 8), (0.25, 4.0, 2), (20.0, 20.0, 1)])
def test_walks_take_the_first_accepted_attempt(spark, monkeypatch, p, q, per_pass):
    from riskloom.config import WalkParams
    from riskloom.operators import embed
    writes = []
    for name in ("cut_lineage", "written"):
        if hasattr(embed, name):
            monkeypatch.setattr(embed, name, lambda df, f=getattr(embed, name): writes.append(1) or f(df))
    g, edges = small_graph(spark)
    got = {r["walk"]: r["path"] for r in embed.random_walks(g, WalkParams(walk_length=5, num_walks=2, p=p, q=q), per_pass).collect()}
    if per_pass == 8:
        assert len(writes) <= 4 + 5         # one table a step
    assert len(got) == 12 and got["card:z#0"] == ["card:z"]
    nbrs = {n: sorted({b for a, b in edges if a == n} | {a for a, b in edges if b == n}) for e in edges for n in e}
    draws = spark.createDataFrame([(w,) for w in got], "walk string").crossJoin(spark.range(1, 5).select(F.col("id").cast("int").alias("step"))) \
        .crossJoin(spark.range(400).select(F.col("id").cast("int").alias("a")))
    draws = draws.select("walk", "step", "a", embed._u(F.col("walk"), F.col("step"), F.col("a"), F.lit(42)).alias("u"),
                         embed._u(F.col("walk"), F.col("step"), F.col("a"), F.lit(49)).alias("s")).toPandas()
    draws = {key: d.sort_values("a")[["u", "s"]].to_numpy() for key, d in draws.groupby(["walk", "step"])}
    top = max(1 / p, 1.0, 1 / q)
    for walk, path in got.items():
        cur, prev = walk.split("#")[0], None
        want = [cur]
        for step in range(1, 5 if cur in nbrs else 1):
            for u, s in draws[walk, step]:
                cand = nbrs[cur][int(u * len(nbrs[cur]))]
                w = top if prev is None else 1 / p if cand == prev else 1.0 if cand in nbrs[prev] else 1 / q
                if s * top < w:
                    break
            prev, cur = cur, cand
            want.append(cur)
        assert path == want


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("parts", [1, 40])
def test_co_device_links_go_over_partitions_without_a_join(spark, parts):
    from riskloom.operators import graph as G
    rows = [("hot", f"{i * 7919 % 1000}") for i in range(300)] + [(f"d{i % 90}", f"{i}") for i in range(180)] + [("d1", None), (None, "1"), ("d1", "1")]
    pairs = sorted({(d, c) for d, c in rows if d is not None and c is not None})
    lists = spark.createDataFrame(pairs, "dev string, card string").repartitionByRange(parts, "dev", "card") \
        .sortWithinPartitions("dev", "card").withColumn("_pid", F.spark_partition_id()).localCheckpoint()
    want = {(d, c, pairs[j][1]) for i, (d, c) in enumerate(pairs) for j in range(i + 1, min(i + 5, len(pairs))) if pairs[j][0] == d}
    got = [tuple(r) for r in G.co_device_links(lists).collect()]
    assert len(got) == len(want) and set(got) == want
    df = spark.createDataFrame(rows, "DeviceInfo string, card1 string")
    edges = G.co_device_edges(df)
    assert {tuple(r) for r in edges.collect()} == {("card:" + a, "card:" + b, d) for d, a, b in want}
    assert "Join" not in executed(edges)
    # degrees of a graph of cards and devices: the pairs are made distinct once, each edge is read once
    assert executed(G.degrees(G.build(df))).count("Union") <= 4


@pytest.mark.parametrize("hubs_linked", [False, True])
def test_clustering_equals_brute_force_and_makes_no_wedges_of_hubs(spark, monkeypatch, hubs_linked):
    from riskloom.operators import graph as G
    rng = np.random.default_rng(3)
    cards, hubs = [f"card:{i}" for i in range(14)], [f"{k}:{i}" for k in ("device", "email") for i in range(6)]
    edges = {tuple(sorted((a, b))) for a in cards for b in cards + hubs if a != b and rng.random() < 0.4}
    if hubs_linked:
        edges |= {tuple(sorted((a, b))) for a in hubs for b in hubs if a < b and rng.random() < 0.4}
    v = spark.createDataFrame([(n, n.split(":")[0], n) for n in cards + hubs], "id string, type string, value string")
    e = spark.createDataFrame([(a, b, "t", None) for a, b in edges], "src string, dst string, edge_type string, shared_device string")
    nbrs = {n: {b for a, b in edges if a == n} | {a for a, b in edges if b == n} for n in cards + hubs}
    got = {r["node"]: r["graph_clustering"] for r in G.clustering(G.Graph(v, lambda: e)).collect()}
    for n, near in nbrs.items():
        d = len(near)
        t = sum(b in nbrs[a] for a in near for b in near) / 2
        assert got[n] == pytest.approx(2 * t / (d * (d - 1)) if d > 1 else 0.0)


def test_pagerank_of_lists_equals_power_iteration(spark, monkeypatch):
    from riskloom.operators import graph as G
    monkeypatch.setattr(G, "LIST", 2)
    g, edges = small_graph(spark)
    nodes = sorted({n for e in edges for n in e} | {"card:z"})
    at, n = {x: i for i, x in enumerate(nodes)}, len(nodes)
    m = np.zeros((n, n))
    for a, b in edges:
        m[at[a], at[b]] = m[at[b], at[a]] = 1
    out = m.sum(axis=0)
    pr = np.full(n, 1 / n)
    for _ in range(200):
        pr = 0.15 / n + 0.85 * (m @ (pr / np.maximum(out, 1)) + pr[out == 0].sum() / n)
    got = {r["node"]: r["graph_pagerank"] for r in G.pagerank(g, tol=1e-12).collect()}
    assert [got[x] for x in nodes] == pytest.approx(list(pr), abs=1e-9)


def test_vectors_of_devices_reach_rows_without_a_shuffle_by_device(spark, monkeypatch):
    from riskloom.operators import embed
    df = spark.createDataFrame([(i, i % 7, None if i % 4 else f"d{i % 8}") for i in range(200)], "TransactionID long, card1 long, DeviceInfo string")
    emb = spark.createDataFrame([(f"card:{i}", [float(i), 1.0]) for i in range(5)] + [("device:d4", [8.0, 9.0]), ("device:Unknown", [7.0, 7.0])],
                                "node_id string, emb array<float>")
    want = [(i, [float(i % 7), 1.0] if i % 7 < 5 else [0.0, 0.0], [7.0, 7.0] if i % 4 else [8.0, 9.0] if i % 8 == 4 else [0.0, 0.0]) for i in range(200)]
    for few in (10_000, 1):
        monkeypatch.setattr(embed, "BROADCAST_DEVICES", few, raising=False)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            out = embed.transaction_embeddings(df, emb, dim=2).select("TransactionID", "emb_card", "emb_device")
            got = sorted(tuple(r) for r in out.collect())
            keys = [line for line in executed(out).split("\n") if "Exchange hashpartitioning" in line]
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert got == want
        assert all("device:" not in line.split("ENSURE")[0] or "_own" in line or "pmod" in line for line in keys), keys


def test_a_bucket_of_cards_answers_each_card_alone_and_forgets_idle_ones():
    from riskloom.streaming.velocity_state import BLOCK, CardVelocity

    class Value:
        v = None
        def exists(self): return self.v is not None
        def get(self): return self.v
        def update(self, v): self.v = v
        def clear(self): self.v = None

    class Blocks:
        v = ()
        def get(self): return iter(self.v)
        def put(self, v): self.v = list(v)
        def appendValue(self, v): self.v = [*self.v, v]
        def clear(self): self.v = ()

    class Handle:
        timers = ()
        def registerTimer(self, ms): self.timers = (*self.timers, ms)

    class Now:
        def __init__(self, s): self.s = s
        def getCurrentWatermarkInMs(self): return self.s * 1000

    assert BLOCK.names == ["times", "ids", "cards"]
    rng, windows = np.random.default_rng(5), ((10, "1h"), (20, "24h"), (30, "7d"))
    v = CardVelocity(windows, 60, 0)
    v.handle, v.blocks, v.last = Handle(), Blocks(), Value()
    seen = []
    for k in range(30):
        new = [(int(rng.integers(20)) * 1000, 7 * k + int(rng.integers(7)), 100 * k + j) for j in range(12)]
        out = next(v.handleInputRows((3,), iter([pd.DataFrame(new, columns=["card", "t", "i"])]), Now(7 * k - 1)))
        seen += new
        got = {r.TransactionID: r for r in out.itertuples()}
        assert len(got) == 12
        for card, t, i in new:
            before = [x for c, x, j in seen if c == card and (x, j) < (t, i)]
            assert got[i].card1 == card and got[i].time_since_last_tx == (t - max(before) if before else 0)
            assert [got[i].card_tx_count_1h, got[i].card_tx_count_24h, got[i].card_tx_count_7d] == [sum(x >= t - w for x in before) for w, _ in windows]
        # fire what the watermark has passed: idle cards are forgotten
        list(v.handleExpiredTimer((3,), Now(7 * k + 6), None))
        last = {c: max(x for d, x, _ in seen if d == c) for c in {c for c, _, _ in seen}}
        seen = [r for r in seen if last[r[0]] + 60 > 7 * k + 6]
    list(v.handleExpiredTimer((3,), Now(10 ** 6), None))
    assert not v.blocks.v and not v.last.exists()
