"""Exact quantiles, probe-row velocity and what follows them against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators.ordinal import ranks_within
from riskloom.operators.quantile import quantile_row, quantile_table, quantiles


def test_quantiles_by_rank(spark):
    """Groups with null keys, nulls, a value that most rows share, weights."""
    rng = np.random.default_rng(1)
    rows = [(int(g) if g < 3 else None, float(v), None if v % 5 == 0 else float(-v), int(w))
            for g, v, w in zip(rng.integers(0, 4, 3000), rng.integers(0, 400, 3000) * (rng.random(3000) < 0.6), rng.integers(0, 4, 3000))]
    df = spark.createDataFrame(rows, "g int, a double, b double, w int")
    probs = [0.0, 0.01, 0.25, 0.5, 0.95, 1.0]
    for weight in (None, "w"):
        got = {(r["g"], r["column"], r["p"]): r["value"] for r in quantiles(df, ["a", "b"], probs, ["g"], weight).collect()}
        for g in (0, 1, 2, None):
            for k, c in ((1, "a"), (2, "b")):
                x = np.concatenate([[r[k]] * (r[3] if weight else 1) for r in rows if r[0] == g and r[k] is not None])
                for p in probs:
                    assert got[(g, c, p)] == pytest.approx(np.quantile(x, p))
    row = quantile_row(df.withColumn("none", F.lit(None).cast("double")), {"m": ("a", 0.5), "e": ("none", 0.5)}).collect()
    assert len(row) == 1 and row[0]["m"] == np.median([r[1] for r in rows]) and row[0]["e"] is None
    assert quantile_row(df.limit(0), {"m": ("a", 0.5)}).collect()[0]["m"] is None
    assert quantile_table(df, {"m": ("a", 0.5)}, ["g"]).count() == 4


def test_quantile_of_one_value_is_spread(spark):
    """A value that all rows share is one row behind the first aggregation."""
    from riskloom.operators.quantile import _long
    df = spark.range(0, 20000, 1, 8).select(F.lit(7.0).alias("v"))
    assert _long(df, ["v"], [], None).collect() == [(0, 7.0, 20000)]


def test_ranks_within(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(None if i % 3 == 0 else "hot" if i % 3 == 1 else f"k{i % 50}", int(v)) for i, v in enumerate(rng.permutation(3000))],
                               "k string, v int").repartition(7)
    groups = {}
    for r in df.collect():
        groups.setdefault(r["k"], []).append(r["v"])
    want = {(k, v): i for k, vs in groups.items() for i, v in enumerate(sorted(vs))}
    assert {(r["k"], r["v"]): r["rank"] for r in ranks_within(df, ["k"], ["v"]).collect()} == want


def velocity_rows(spark, n=4000):
    """One card with a third of all rows, ties, null cards and amounts, far-off times, text ids."""
    import random
    rnd = random.Random(11)
    rows = [(f"i{i:05d}", None if i % 17 == 0 else 1 if i % 3 == 0 else rnd.randint(2, 400), rnd.choice([0, 5, rnd.randint(0, 30 * 86400)]),
             None if i % 13 == 0 else rnd.choice([5.0, 99999.99, rnd.randint(1, 10**7) / 100]), "W") for i in range(n)]
    return rows, spark.createDataFrame(rows, "TransactionID string, card1 int, TransactionDT long, TransactionAmt double, ProductCD string").repartition(5)


def test_probe_rows_equal_brute_force(spark):
    from riskloom.operators.velocity import velocity_features
    rows, df = velocity_rows(spark)
    wins = ((1, "1s"), (3600, "1h"), (604800, "7d"))
    got = {r["TransactionID"]: r for r in velocity_features(df, windows=wins, amount="TransactionAmt").collect()}
    assert len(got) == len(rows)
    cards = {}
    for i, c, t, a, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        r, prior = got[i], cards.setdefault(c, []) if c is not None else []
        assert r["time_since_last_tx"] == (t - prior[-1][0] if prior else 0)
        for w, label in wins:
            inside = [x for pt, x in prior if pt >= t - w]
            known = [x for x in inside if x is not None]
            assert r[f"card_tx_count_{label}"] == len(inside)
            assert (r[f"card_tx_mean_amt_{label}"] is None) == (not known)
            if known:
                assert r[f"card_tx_mean_amt_{label}"] == pytest.approx(np.mean(known))
            if len(known) > 1:
                assert r[f"card_tx_std_amt_{label}"] == pytest.approx(np.std(known, ddof=1), abs=1e-9)
        if c is not None:
            prior.append((t, a))


def test_a_hot_card_is_spread_over_all_tasks(spark):
    from riskloom.operators.velocity import _sorted_rows
    _, df = velocity_rows(spark, 12000)
    hot = df.withColumn("card1", F.lit(1))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        per_task = [r["n"] for r in _sorted_rows(hot, "card1", "TransactionDT", "TransactionID", ((3600, "1h"),), None)
                    .groupBy("_part").agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(per_task) == 4 and max(per_task) < sum(per_task) / 2


def test_repeated_rows_share_the_first_ones_values(spark):
    from riskloom.operators.velocity import velocity_features
    df = spark.createDataFrame([(1, 1, 10, 1.0), (1, 1, 10, 1.0), (2, 1, 12, 1.0)], "TransactionID long, card1 long, TransactionDT long, TransactionAmt double")
    got = [(r["TransactionID"], r["time_since_last_tx"], r["card_tx_count_1h"]) for r in velocity_features(df).collect()]
    assert sorted(got) == [(1, 0.0, 0), (1, 0.0, 0), (2, 2.0, 2)]
    assert velocity_features(df.limit(0)).count() == 0


def consume(spark, log, out):
    from riskloom.sources.message_log import read_log
    q = (read_log(spark, log).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/ckpt")
         .trigger(availableNow=True).start())
    q.awaitTermination()


def test_message_log_is_read_once_over_restarts(spark, tmp_path):
    """Offsets go on behind the last append; an append without a manifest is not seen."""
    from riskloom.sources.message_log import append_messages, ends, manifests
    log, out = f"{tmp_path}/log", f"{tmp_path}/out"
    frame = spark.range(0, 500).select(F.col("id").cast("string").alias("key"), F.concat(F.lit("v"), "id").alias("value"))
    append_messages(frame, log, 3)
    consume(spark, log, out)
    consume(spark, log, out)
    append_messages(frame.filter("id % 2 = 0"), log, 3)
    frame.withColumn("partition", F.lit(0)).withColumn("offset", F.lit(9999).cast("long")).write.partitionBy("partition").parquet(f"{log}/append=torn")
    consume(spark, log, out)
    rows = spark.read.parquet(f"{out}/rows").collect()
    assert len(rows) == 750 and len({(r["partition"], r["offset"]) for r in rows}) == 750
    for p, n in ends(manifests(log)).items():
        assert sorted(r["offset"] for r in rows if r["partition"] == int(p)) == list(range(n))
    assert sorted(r["value"] for r in rows if int(r["key"]) % 2) == sorted(f"v{i}" for i in range(1, 500, 2))


def test_message_log_ranges(tmp_path, monkeypatch):
    """A range of offsets is cut into tasks and keeps to its borders."""
    import json
    import os
    from riskloom.sources import message_log as m
    monkeypatch.setattr(m, "TASK_MESSAGES", 40)
    os.makedirs(f"{tmp_path}/_commits")
    for n, ranges in enumerate([{"0": [0, 100], "1": [0, 5]}, {"0": [100, 130]}]):
        with open(f"{tmp_path}/_commits/{n:08d}.json", "w") as f:
            json.dump({"append": f"append={n}", "ranges": ranges}, f)
    r = m.LogStreamReader(str(tmp_path), None, False)
    assert r.initialOffset() == {} and r.latestOffset() == {"0": 130, "1": 5}
    got = [(p.partition, p.start, p.end, p.appends[0]) for p in r.partitions({"0": 50}, {"0": 120, "1": 5})]
    assert got == [(0, 50, 90, "append=0"), (0, 90, 100, "append=0"), (1, 0, 5, "append=0"), (0, 100, 120, "append=1")]
    limited = m.LogStreamReader(str(tmp_path), 60, False)
    assert limited.latestOffset() == {"0": 60, "1": 5}
    limited.partitions({}, {"0": 60, "1": 5})
    assert limited.latestOffset() == {"0": 120, "1": 5}
    assert m.LogStreamReader(str(tmp_path), None, True).initialOffset() == {"0": 130, "1": 5}


def velocity_batches(spark, base, batches, **kw):
    """Rows (id, card, time) of each batch through the keyed state; (since, count in 1 h) by id."""
    from riskloom.streaming.velocity_state import card_velocity_stream
    schema = "TransactionID long, card1 long, TransactionDT long"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{base}/in")
        stream = spark.readStream.schema(schema).json(f"{base}/in")
        (card_velocity_stream(stream, **kw).writeStream.format("parquet").option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/ck").trigger(availableNow=True).start().awaitTermination())
    return {r["TransactionID"]: (r["time_since_last_tx"], r["card_tx_count_1h"]) for r in spark.read.parquet(f"{base}/out").collect()}


def test_late_rows_and_idle_cards(spark, tmp_path):
    """Out of order within the watermark: counted; behind it: dropped; idle
    cards start anew; rows without a card get zeros."""
    day = 86400
    got = velocity_batches(spark, tmp_path, [
        [(1, 7, 10 * day), (2, 7, 10 * day + 60), (3, 8, 10 * day), (4, None, 10 * day)],
        [(5, 7, 10 * day + 30), (6, 8, 10 * day + 1800), (7, 9, 9 * day)],     # 5: out of order; 7: behind the watermark
        [(8, 9, 13 * day)],                                                   # time passes: 7 and 8 are idle for over a day
        [(9, 9, 13 * day + 10)],
        [(10, 7, 13 * day + 20), (11, 9, 13 * day + 20)],
    ], idle_seconds=day)
    assert got == {1: (0, 0), 2: (60, 1), 3: (0, 0), 4: (0, 0), 5: (30, 1), 6: (1800, 1), 8: (0, 0), 9: (10, 1), 10: (0, 0), 11: (10, 2)}


def test_state_forgets_what_no_window_needs():
    """Old pairs go when they are the larger part; the last one stays."""
    from riskloom.streaming.velocity_state import CardVelocity

    class Value:
        def __init__(self): self.v = None
        def exists(self): return self.v is not None
        def get(self): return self.v
        def update(self, v): self.v = v

    class Blocks:
        def __init__(self): self.v = []
        def get(self): return iter(self.v)
        def put(self, v): self.v = list(v)
        def appendValue(self, v): self.v.append(v)

    class Handle:
        def registerTimer(self, ms): self.timer = ms

    class Now:
        def __init__(self, s): self.s = s
        def getCurrentWatermarkInMs(self): return self.s * 1000

    import pandas as pd
    c = CardVelocity(((10, "1h"), (20, "24h"), (30, "7d")), 1000, 0)
    c.handle, c.blocks, c.last = Handle(), Blocks(), Value()
    for t in range(0, 500, 5):
        out = next(c.handleInputRows((1,), iter([pd.DataFrame({"t": [t, t + 1], "i": [t, t + 1]})]), Now(t)))
        assert out["card_tx_count_7d"].tolist() == [min(2 * (t // 5), 12), min(2 * (t // 5) + 1, 12)]
        assert sum(len(b[0]) for b in c.blocks.v) < 40
    assert c.handle.timer == (496 + 1000) * 1000


def brute_isotonic(points):
    xs = sorted({x for x, _ in points})
    mean = lambda a, b: np.mean([y for x, y in points if xs[a] <= x <= xs[b]])
    return {xs[k]: max(min(mean(a, b) for b in range(k, len(xs))) for a in range(k + 1)) for k in range(len(xs))}


@pytest.mark.parametrize("rows,knots", [(1 << 20, 1 << 20), (4, 1)])
def test_isotonic_equals_min_max_formula(spark, monkeypatch, rows, knots):
    """Many small blocks give the regression of one; both ways to predict."""
    from riskloom.operators import isotonic
    monkeypatch.setattr(isotonic, "ROWS", rows)
    monkeypatch.setattr(isotonic, "BROADCAST_KNOTS", knots)
    rng = np.random.default_rng(4)
    points = [(float(round(x, 2)), float(rng.random() < x)) for x in rng.random(150)] + [(0.5, 1.0)] * 80
    df = spark.createDataFrame(points + [(None, 1.0), (0.3, None)], "score double, label double").repartition(3)
    model = isotonic.fit(df)
    want = brute_isotonic(points)
    got = {r["score"]: r["calibrated"] for r in model.transform(df.select("score")).collect()}
    assert got.pop(None) is None
    assert {x for x in got} == set(want) | {0.3} and all(got[x] == pytest.approx(want[x]) for x in want)
    xs = sorted(want)
    probe = spark.createDataFrame([(-1.0, "a"), (2.0, "b"), ((xs[3] + xs[4]) / 2, "c")], "score double, part string")
    out = {r["part"]: r["calibrated"] for r in model.transform(probe).collect()}
    assert out["a"] == pytest.approx(want[xs[0]]) and out["b"] == pytest.approx(want[xs[-1]])
    assert want[xs[3]] - 1e-9 <= out["c"] <= want[xs[4]] + 1e-9
    assert isotonic.fit(df.limit(0)).transform(probe).count() == 3


def random_tree(rng, depth, n_feat):
    rows = []

    def grow(level, cover):
        at = len(rows)
        rows.append(None)
        if level == depth or rng.random() < 0.2:
            rows[at] = (0, at, rng.normal(), -1, -1, -1, 0.0, cover)
        else:
            part = rng.uniform(0.1, 0.9)
            f, t = int(rng.integers(n_feat)), rng.normal()
            left, right = grow(level + 1, cover * part), grow(level + 1, cover * (1 - part))
            rows[at] = (0, at, 0.0, left, right, f, t, cover)
        return at

    grow(0, 100.0)
    from riskloom.operators.explain import NODES
    import pandas as pd
    return pd.DataFrame(rows, columns=NODES)


def test_tree_shapley_values_equal_all_coalitions():
    from itertools import combinations
    from math import factorial
    from riskloom.operators.explain import leaves
    rng, n = np.random.default_rng(6), 4
    for _ in range(12):
        nodes = random_tree(rng, 5, n)
        rows = {r.id: r for r in nodes.itertuples()}

        def expect(x, known, at=0):
            r = rows[at]
            if r.leftChild < 0:
                return r.prediction
            if r.feature in known:
                return expect(x, known, r.leftChild if x[r.feature] <= r.threshold else r.rightChild)
            return sum(rows[c].cover / r.cover * expect(x, known, c) for c in (r.leftChild, r.rightChild))

        every = leaves(nodes)
        for x in rng.normal(size=(5, n)):
            got = np.zeros(n)
            for leaf in every:
                got[leaf.features] += leaf.values()[leaf.pattern(x[None, :])[0]] if len(leaf.features) else 0
            for i in range(n):
                rest = [j for j in range(n) if j != i]
                want = sum(factorial(k) * factorial(n - 1 - k) / factorial(n) * (expect(x, {*s, i}) - expect(x, set(s)))
                           for k in range(n) for s in combinations(rest, k))
                assert got[i] == pytest.approx(want, abs=1e-12)
            assert got.sum() + sum(leaf.expected() for leaf in every) == pytest.approx(expect(x, set(range(n))))


def test_store_gives_the_state_back(spark, tmp_path):
    """Newest whole version, changed schemas, missing state; a batch of one
    row reads no training table."""
    import os
    from riskloom.config import Config, ForestParams, GbtParams
    from riskloom.plans import store
    from riskloom.plans import train as tr
    from riskloom.sources.tables import merged_transactions
    df = merged_transactions(spark, "/root/testdata/sf0.001")
    art, _ = tr.train(spark, df, Config(gbt=GbtParams(max_iter=3, max_depth=3), forest=ForestParams(n_trees=10)), embeddings=True)
    assert any(c.startswith("emb_card_") for c in art.features)
    base = str(tmp_path / "store")
    with pytest.raises(tr.NotFittedError):
        store.load(spark, base)
    with pytest.raises(tr.NotFittedError):
        tr.score(df, tr.Artifacts(art.prep, art.card_stats, art.entity_stats, None, None))
    first = store.save(spark, art, base)
    second = store.save(spark, store.load(spark, base), base)
    assert store.versions(base) == [first, second]
    back = store.load(spark, base)
    key = lambda rows: sorted((r["prediction"]["transaction_id"], round(r["prediction"]["fraud_score"], 9), r["prediction"]["risk_level"]) for r in rows)
    assert key(tr.score(df, back).collect()) == key(tr.score(df, art).collect())
    one = spark.createDataFrame(df.limit(1).collect(), df.schema)
    plan = tr.score(one, back)._jdf.queryExecution().executedPlan().toString()
    assert "events.parquet" not in plan and "rdd_" not in plan
    spark.range(1).write.mode("overwrite").parquet(f"{base}/{second}/medians")
    with pytest.raises(store.StoreError):
        store.load(spark, base)
    assert store.load(spark, base, first).features == art.features
    os.unlink(f"{base}/_manifests/{second}.json")
    assert store.versions(base) == [first]
