"""Hand-worked cases (FIXTURES.md section 5) on tiny in-memory frames."""

import math

import pytest
from pyspark.sql import functions as F

from riskloom.functions import risk
from riskloom.functions.time import add_time_features, night_flag, weekend_flag
from riskloom.operators import behavioral, cross, device, graph, metrics, preprocess, profiling, split
from riskloom.operators.velocity import velocity_features

TX = "TransactionID long, card1 long, TransactionDT long, TransactionAmt double, ProductCD string"


def test_time_features(spark):
    df = spark.createDataFrame([(1, 513000, 10.0), (2, 21600, 1.0), (3, 21636, 1.0)],
                               "TransactionID long, TransactionDT long, TransactionAmt double")
    out = add_time_features(df).withColumns({"n": night_flag(F.col("tx_hour")),
                                             "w": weekend_flag(F.col("tx_day_of_week"))})
    r = {x.TransactionID: x for x in out.collect()}
    assert r[1].tx_hour == pytest.approx(22.5) and r[1].tx_day_of_week == pytest.approx(5.9375)
    assert (r[1].tx_day, r[1].tx_week, r[1].n, r[1].w) == (5, 0, 1, 1)
    assert r[2].tx_hour == pytest.approx(6.0) and r[2].n == 1
    assert r[3].tx_hour == pytest.approx(6.01) and r[3].n == 0
    for x in out.collect():   # reference invariants
        assert 0 <= x.tx_hour <= 24 and 0 <= x.tx_day_of_week <= 7 and x.tx_amount_log >= 0
        assert abs(x.tx_hour_sin) <= 1.01 and abs(x.tx_dow_cos) <= 1.01


def _velocity_rows(spark):
    rows = [(1, 1, 0, 10.0, "W"), (2, 1, 0, 20.0, "W"), (3, 1, 3600, 30.0, "H"), (4, 1, 3601, 40.0, "W"),
            (5, 2, 100, 5.0, "W"), (6, None, 50, 7.0, "W")]
    return spark.createDataFrame(rows, TX)


def test_velocity_and_card_stats(spark):
    df = _velocity_rows(spark)
    out, _ = behavioral.fit_transform(df)
    r = {x.TransactionID: x for x in out.collect()}
    expect = {1: (0, 0, 0), 2: (0, 1, 1), 3: (3600, 2, 2), 4: (1, 1, 3), 5: (0, 0, 0), 6: (0, 0, 0)}
    for i, (since, n1h, n24h) in expect.items():
        assert (r[i].time_since_last_tx, r[i].card_tx_count_1h, r[i].card_tx_count_24h) == (since, n1h, n24h), i
    assert r[1].card_tx_count == 4 and r[1].card_tx_mean_amt == pytest.approx(25)
    assert r[1].card_tx_std_amt == pytest.approx(12.909944, abs=1e-6)
    assert r[1].amount_zscore == pytest.approx(-1.161895, abs=1e-6) and r[1].card_amount_ratio == pytest.approx(0.4)
    assert r[5].card_tx_std_amt == pytest.approx(12.909944, abs=1e-6)     # one-row card: median fill
    assert r[5].amount_zscore == pytest.approx(0.0) and r[5].card_amount_ratio == pytest.approx(1.0)
    assert r[6].card_tx_count == 4 and r[6].amount_zscore == pytest.approx(-1.394274, abs=1e-6)
    assert r[6].card_amount_ratio == pytest.approx(0.28)
    assert r[1].card_merchant_entropy == pytest.approx(0.562335, abs=1e-6)   # shares .75 / .25
    assert abs(r[5].card_merchant_entropy) < 1e-6
    assert r[1].card_freq_product_W == pytest.approx(0.75) and r[5].card_freq_product_H == 0.0


def test_velocity_matches_brute_force(spark):
    """Prefix sums vs the O(n^2) definition on a skewed card."""
    import random
    rnd = random.Random(7)
    rows = []
    for i in range(400):
        card = 1 if i % 3 else rnd.randint(2, 6)          # one hot card
        rows.append((i, card, rnd.randint(0, 40 * 86400), 1.0, "W"))
    df = spark.createDataFrame(rows, TX)
    wins = ((3600, "1h"), (86400, "24h"), (604800, "7d"))
    got = {x.TransactionID: x for x in velocity_features(df, windows=wins).collect()}
    for i, c, t, _, _ in rows:
        prior = [(pt, pid) for pid, pc, pt, _, _ in rows if pc == c and (pt, pid) < (t, i)]
        assert got[i].card_tx_count_7d == sum(1 for pt, _ in prior if pt >= t - 604800)
        assert got[i].card_tx_count_1h == sum(1 for pt, _ in prior if pt >= t - 3600)
        assert got[i].time_since_last_tx == (t - max(prior)[0] if prior else 0)


def test_device_features(spark):
    rows = [(1, 1, 1, "D", "desktop", "a.com", 1.0), (2, 2, 0, "D", "MOBILE", None, 2.0),
            (3, 2, 1, "D", "tablet", "a.com", 3.0), (4, None, 1, "D", None, "b.com", 4.0)]
    df = spark.createDataFrame(rows, "TransactionID long, card1 long, isFraud int, DeviceInfo string, "
                                     "DeviceType string, P_emaildomain string, addr1 double")
    out, st = device.fit_transform(df)
    d = st.device.first()
    assert (d.device_user_count, d.device_tx_count) == (2, 3)
    assert d.device_fraud_rate == pytest.approx(0.75) and d.device_risk_score == pytest.approx(0.15)
    r = {x.TransactionID: x for x in out.collect()}
    assert r[1].device_type_risk == 0.2 and r[2].device_type_risk == 0.4
    assert r[3].device_type_risk == 0.5 and r[4].device_type_risk == 0.6
    for x in out.collect():
        assert x.device_user_count >= 0 and 0 <= x.device_risk_score <= 1 and x.identity_mismatch_score >= 0


def test_cross_entity(spark):
    df = spark.createDataFrame([(0.5, 0.2, 0.1, 2.0), (0.5, None, 0.1, 2.0)],
                               "device_fraud_rate double, email_domain_fraud_rate double, "
                               "addr_fraud_rate double, card_amount_ratio double")
    a, b = cross.add_cross_entity_features(df).collect()
    assert (a.device_x_email_risk, a.addr_x_device_risk) == pytest.approx((0.1, 0.05))
    assert (a.total_entity_risk, a.max_entity_risk, a.high_amt_x_entity_risk) == pytest.approx((0.8, 0.5, 1.0))
    assert b.device_x_email_risk is None and b.total_entity_risk == pytest.approx(0.6) and b.max_entity_risk == 0.5


def test_encoder_unseen(spark):
    fit_df = spark.createDataFrame([("b",), ("a",), (None,), ("B",)], "c string")
    prep = preprocess.fit(fit_df)
    codes = {r.value: r.code for r in prep.encoders.collect()}
    assert codes == {"B": 0, "Unknown": 1, "a": 2, "b": 3}
    out = preprocess.transform(spark.createDataFrame([("zz",), ("a",), (None,)], "c string"), prep)
    assert [r.c for r in out.collect()] == [-1, 2, 1]


def test_quantile_and_rolling(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, 4.0)], "x double")
    assert df.agg(F.percentile("x", 0.95)).first()[0] == pytest.approx(3.85)
    days = spark.createDataFrame([(d * 86400, d % 2) for d in range(1, 9)], "TransactionDT long, isFraud int")
    r = {x.tx_day: x.rolling_fraud_rate for x in profiling.rolling_daily_fraud_rate(days).collect()}
    assert all(r[d] is None for d in range(1, 7))
    assert r[7] == pytest.approx(sum(d % 2 for d in range(1, 8)) / 7)
    assert r[8] == pytest.approx(sum(d % 2 for d in range(2, 9)) / 7)


def test_graph_one_device_seven_cards(spark):
    df = spark.createDataFrame([(c, "D") for c in range(1, 8)], "card1 long, DeviceInfo string")
    g = graph.build(df)
    assert g.vertices.count() == 8
    types = {r.edge_type: r.n for r in g.edges.groupBy("edge_type").agg(F.count("*").alias("n")).collect()}
    assert types == {"card_device": 7, "co_device": 18}
    feats = {r.node: r for r in graph.node_features(g).collect()}
    assert feats["device:D"].graph_degree == 7
    assert [feats[f"card:{c}"].graph_degree for c in range(1, 8)] == [5, 6, 7, 7, 7, 6, 5]
    assert feats["card:1"].graph_component_size == 8 and feats["card:1"].graph_clustering == pytest.approx(1.0)
    assert all(r.graph_is_hub == 0 for r in feats.values())
    assert sum(r.graph_pagerank for r in feats.values()) == pytest.approx(1.0)
    probe = spark.createDataFrame([(1, 1), (2, 99)], "TransactionID long, card1 long")
    s = {r.TransactionID: r.graph_score for r in graph.graph_score(probe, g).collect()}
    assert s[1] == pytest.approx(5 / 7) and s[2] == 0.0
    z = graph.transaction_graph_features(probe, graph.node_features(g)).filter("TransactionID = 2").first()
    assert (z.graph_degree, z.graph_component_size, z.graph_is_hub) == (0, 1, 0)


def test_blend_level_reasons(spark):
    df = spark.createDataFrame([(0.8, 0.5, 0.9, 6000.0)], "l double, g double, a double, amt double")
    p = df.select(risk.prediction_struct(F.lit(None), F.col("l"), F.col("g"), F.col("a"), F.col("amt")).alias("p")) \
        .select("p.*").first()
    assert p.fraud_score == pytest.approx(0.74) and p.risk_level == "CRITICAL" and p.transaction_id == "UNKNOWN"
    assert p.reasons == ["High ML fraud probability (80%)",
                         "Transaction pattern is statistically anomalous (anomaly score: 90%)",
                         "Unusually large transaction amount ($6,000)"]
    levels = [(0, "LOW"), (.10, "LOW"), (.19, "LOW"), (.20, "MEDIUM"), (.30, "MEDIUM"), (.39, "MEDIUM"),
              (.40, "HIGH"), (.52, "HIGH"), (.64, "HIGH"), (.65, "CRITICAL"), (.80, "CRITICAL"), (1.0, "CRITICAL")]
    s = spark.createDataFrame([(float(x),) for x, _ in levels], "s double")
    assert [r[0] for r in s.select(risk.risk_level(F.col("s"))).collect()] == [lv for _, lv in levels]
    q = spark.createDataFrame([(0.1, 0.1, 0.1, 10.0)], "l double, g double, a double, amt double")
    assert q.select(risk.reasons(*[F.col(c) for c in ("l", "g", "a", "amt")])).first()[0] == \
        ["No specific high-risk indicators detected"]


def test_ranking_metrics(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.7, 0), (0.1, 0)], "score double, label int")
    m = metrics.ranking_metrics(df).first()
    assert m.roc_auc == pytest.approx(0.75) and m.pr_auc == pytest.approx(0.75)
    assert m.optimal_threshold == pytest.approx(0.7) and m.fraud_recall_at_threshold == pytest.approx(1.0)
    assert m.f1_optimal == pytest.approx(2 / 3)


def test_confusion_fixture(spark):
    conf = spark.createDataFrame([(2097, 1284, 1967, 112760)], "true_positives long, false_positives long, "
                                 "false_negatives long, true_negatives long")
    m = metrics.confusion_metrics(conf).first()
    assert round(m.fraud_precision, 6) == 0.620231 and round(m.fraud_recall, 6) == 0.515994
    assert round(m.f1, 6) == 0.563331 and round(m.accuracy, 6) == 0.972474


def test_isotonic(spark):
    from riskloom.operators.model import isotonic
    df = spark.createDataFrame([(0.1, 0), (0.2, 1), (0.3, 0), (0.9, 1)], "score double, label int")
    m = isotonic(df)
    probe = spark.createDataFrame([(x,) for x in (0.1, 0.2, 0.3, 0.9, 0.0, 0.6, 2.0)], "score double")
    got = [r.calibrated for r in m.transform(probe).collect()]
    assert got == pytest.approx([0, .5, .5, 1, 0, .75, 1])


def test_split_small_and_large(spark):
    ten = spark.createDataFrame([(i, i * 10) for i in range(10)], "TransactionID long, TransactionDT long")
    flags = split.time_split_flags(ten).collect()
    assert sum(r.is_validation for r in flags) == 2
    assert {r.TransactionID for r in flags if r.is_validation} == {8, 9}
    four = spark.createDataFrame([(i, i) for i in range(4)], "TransactionID long, TransactionDT long")
    assert sum(r.is_validation for r in split.time_split_flags(four).collect()) == 0   # T28


def test_prefix_sums_cover_partitions(spark):
    from riskloom.operators.ordinal import prefix_sums
    df = spark.range(0, 5000).select((F.col("id") % 97).alias("k"), F.col("id"), F.lit(2.0).alias("v"))
    out = prefix_sums(df, [F.col("k"), F.col("id")], ["v"], num_partitions=7).collect()
    out.sort(key=lambda r: (r.k, r.id))
    assert [r.cum__n for r in out] == list(range(1, 5001))
    assert math.isclose(out[-1].cum_v, 10000.0)


def test_entropy_two_thirds(spark):
    df = spark.createDataFrame([(1, 1, 0, 1.0, "W"), (2, 1, 1, 1.0, "W"), (3, 1, 2, 1.0, "H")], TX)
    st = behavioral.fit_card_stats(df).table.first()
    assert st.card_merchant_entropy == pytest.approx(0.636514, abs=1e-6)
    assert st.card_freq_product_W == pytest.approx(0.666667, abs=1e-6)


def test_prefix_sums_inside_union(spark):
    """Ordinals stay right when the result is consumed inside a union (task
    partition indices shift there)."""
    from riskloom.operators.ordinal import prefix_sums
    df = spark.range(0, 3000).select(F.col("id"), F.lit(1.0).alias("v"))
    r = prefix_sums(df, [F.col("id")], [], num_partitions=5)
    a = r.filter(F.col("id") < 1500)
    b = r.filter(F.col("id") >= 1500)
    u = spark.range(0, 10).select(F.col("id"), F.lit(0).cast("long").alias("cum__n")).unionByName(a.select("id", "cum__n")) \
        .unionByName(b.select("id", "cum__n"))
    got = {x.id: x.cum__n for x in u.collect() if x.cum__n}
    assert all(got[i] == i + 1 for i in range(3000))
