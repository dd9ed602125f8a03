"""Registered query plans: one callable ``(spark, sf_dir) -> DataFrame`` per
operator group of the inventory.  Each reads the driver tables through the
canonical views, so its work grows with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.operators import behavioral
from riskloom.plans.common import round_doubles, timed_transactions
from riskloom.session import written

REGISTRY: dict = {}


def register(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


BEHAVIOUR_COLS = [
    "TransactionID", "card1", "TransactionDT", "TransactionAmt",
    "tx_hour", "tx_day_of_week", "tx_day", "tx_week", "tx_amount_log",
    "card_tx_count", "card_tx_mean_amt", "card_tx_std_amt", "card_tx_max_amt", "card_tx_min_amt",
    "card_hour_mean", "card_merchant_entropy",
    "amount_zscore", "card_amount_ratio",
    "time_since_last_tx", "card_tx_count_1h", "card_tx_count_24h", "card_tx_count_7d",
    "tx_is_night", "tx_is_weekend",
]


@register("card_behaviour")
def card_behaviour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: J1 -> F1-F4 -> A1-A4 -> J3 (+T3 fill) -> F5/F6 -> W1/W2 -> F7."""
    df = timed_transactions(spark, sf_dir)
    out, stats = behavioral.fit_transform(df)
    shares = [c for c in stats.stat_cols if c.startswith(behavioral.SHARE_PREFIX)]
    return round_doubles(out.select(*BEHAVIOUR_COLS, *shares))


# ---- device / email / address / card identity (A5-A8, J6-J10, F8-F11) ----
from riskloom.operators import cross, device  # noqa: E402
from riskloom.sources.tables import merged_transactions  # noqa: E402


@register("device_stats")
def device_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5 per-device table."""
    return round_doubles(device.fit_entity_stats(merged_transactions(spark, sf_dir)).device)


@register("email_stats")
def email_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6 per-email-domain table."""
    return round_doubles(device.fit_entity_stats(merged_transactions(spark, sf_dir)).email)


@register("addr_stats")
def addr_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7 per-address table."""
    return round_doubles(device.fit_entity_stats(merged_transactions(spark, sf_dir)).addr)


@register("card_identity_counts")
def card_identity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8 distinct devices and e-mail domains per card (J10 as one aggregate)."""
    return device.fit_entity_stats(merged_transactions(spark, sf_dir)).card


DEVICE_COLS = ["TransactionID", "device_user_count", "device_tx_count", "device_fraud_rate", "device_risk_score",
               "email_user_count", "email_domain_fraud_rate", "addr_user_count", "addr_fraud_rate",
               "card_device_count", "card_email_count", "device_type_risk", "identity_mismatch_score",
               "device_is_high_risk"]


@register("device_features")
def device_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-transaction J6-J9 joins with fills, F9-F11."""
    out, _ = device.fit_transform(merged_transactions(spark, sf_dir))
    return round_doubles(out.select(*DEVICE_COLS))


CROSS_COLS = ["TransactionID", "card_amount_ratio", "device_x_email_risk", "addr_x_device_risk",
              "total_entity_risk", "max_entity_risk", "high_amt_x_entity_risk"]


@register("entity_risk")
def entity_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F12/F13 on top of the behaviour and device stages."""
    df = timed_transactions(spark, sf_dir)
    out = behavioral.add_amount_features(df)
    out, _ = device.fit_transform(out)
    return round_doubles(cross.add_cross_entity_features(out).select(*CROSS_COLS))


# ---- preprocessing (P1-P10, S7) ----
from riskloom.operators import preprocess  # noqa: E402


@register("time_features")
def time_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1-F4 plus F7 flags."""
    from riskloom.functions.time import night_flag, weekend_flag
    df = timed_transactions(spark, sf_dir)
    return round_doubles(df.select(
        "TransactionID", "tx_hour", "tx_day_of_week", "tx_day", "tx_week", "tx_hour_sin", "tx_hour_cos",
        "tx_dow_sin", "tx_dow_cos", "tx_amount_log",
        night_flag(F.col("tx_hour")).alias("tx_is_night"), weekend_flag(F.col("tx_day_of_week")).alias("tx_is_weekend")))


@register("label_encoders")
def label_encoders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1 + P8 + P9: (column, value, code) dimension table."""
    df = timed_transactions(spark, sf_dir)
    return preprocess.fit_encoders(df, preprocess.categorical_columns(df))


@register("numeric_medians")
def numeric_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2 + P7: (column, median) dimension table."""
    df = timed_transactions(spark, sf_dir)
    return round_doubles(preprocess.fit_medians(df, preprocess.numeric_columns(df, preprocess.categorical_columns(df))))


PREP_COLS = ["TransactionID", "isFraud", "ProductCD", "P_emaildomain", "DeviceType", "DeviceInfo",
             "addr1", "TransactionAmt", "card1"]


@register("preprocessed")
def preprocessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imputed and encoded table (P7, P8, P10) fitted on the whole frame."""
    df = timed_transactions(spark, sf_dir)
    return round_doubles(preprocess.transform(df, preprocess.fit(df)).select(*PREP_COLS))


@register("encode_unseen")
def encode_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoders fitted on the first 20 days, applied to every row: values
    first seen later map to -1 (P10); medians likewise come from the fit part."""
    df = timed_transactions(spark, sf_dir)
    prep = preprocess.fit(df.filter(F.col("TransactionDT") < 20 * 86400))
    return round_doubles(preprocess.transform(df, prep).select(*PREP_COLS))


# ---- profiling (A9-A22, W3, F23, F27, F30, J14, L9, L11) ----
from riskloom.operators import profiling as prof  # noqa: E402


def _merged(spark, sf_dir):
    return merged_transactions(spark, sf_dir)


def _tx(spark, sf_dir):
    """Transaction columns only: identity has at most one row per id, so
    queries that read no identity column skip the join (same rows)."""
    from riskloom.sources.tables import events_transactions
    return events_transactions(spark, sf_dir)


@register("class_balance")
def class_balance(spark, sf_dir):
    return round_doubles(prof.class_balance(_tx(spark, sf_dir)))


@register("fraud_by_hour")
def fraud_by_hour(spark, sf_dir):
    return round_doubles(prof.fraud_by_hour(_tx(spark, sf_dir)))


@register("fraud_by_day_of_week")
def fraud_by_day_of_week(spark, sf_dir):
    return round_doubles(prof.fraud_by_day_of_week(_tx(spark, sf_dir)))


@register("rolling_daily_fraud_rate")
def rolling_daily_fraud_rate(spark, sf_dir):
    return round_doubles(prof.rolling_daily_fraud_rate(_tx(spark, sf_dir)))


@register("fraud_by_category")
def fraud_by_category(spark, sf_dir):
    return round_doubles(prof.fraud_by_category(_merged(spark, sf_dir)))


@register("device_table")
def device_table(spark, sf_dir):
    return round_doubles(prof.device_table(_merged(spark, sf_dir)))


@register("device_sharing_summary")
def device_sharing_summary(spark, sf_dir):
    return round_doubles(prof.device_sharing_summary(_merged(spark, sf_dir)))


@register("device_card_bucket_rate")
def device_card_bucket_rate(spark, sf_dir):
    return round_doubles(prof.device_card_bucket_rate(_merged(spark, sf_dir)))


@register("describe_by_class")
def describe_by_class(spark, sf_dir):
    return round_doubles(prof.describe_by_class(_tx(spark, sf_dir)))


@register("amount_percentiles")
def amount_percentiles(spark, sf_dir):
    return round_doubles(prof.amount_percentiles(_tx(spark, sf_dir)))


@register("missing_rates")
def missing_rates(spark, sf_dir):
    return round_doubles(prof.missing_rates(_merged(spark, sf_dir)))


@register("missing_summary")
def missing_summary(spark, sf_dir):
    return prof.missing_summary(_merged(spark, sf_dir))


@register("top_missing")
def top_missing(spark, sf_dir):
    return round_doubles(prof.top_missing(_merged(spark, sf_dir), 50))


@register("correlation_matrix")
def correlation_matrix(spark, sf_dir):
    return round_doubles(prof.correlation_matrix(_tx(spark, sf_dir),
                                                 ["TransactionAmt", "isFraud", "card1", "addr1"]))


@register("label_correlations")
def label_correlations(spark, sf_dir):
    frame, _ = device.fit_transform(timed_transactions(spark, sf_dir))
    return round_doubles(prof.label_correlations(frame, 30))


@register("amount_log_histogram")
def amount_log_histogram(spark, sf_dir):
    return round_doubles(prof.class_histogram(_tx(spark, sf_dir), F.log1p("TransactionAmt"), 50))


@register("clipped_amount_histogram")
def clipped_amount_histogram(spark, sf_dir):
    df = prof.clip_to_quantiles(_tx(spark, sf_dir), "TransactionAmt")
    return round_doubles(prof.class_histogram(df, F.col("TransactionAmt"), 40))


@register("cards_per_device_histogram")
def cards_per_device_histogram(spark, sf_dir):
    dt = prof.device_table(_merged(spark, sf_dir)).withColumn("group", F.lit(0))
    return round_doubles(prof.class_histogram(dt, F.least(F.col("n_cards"), F.lit(20)), 20, by="group"))


@register("risk_bucket_fraud_rate")
def risk_bucket_fraud_rate(spark, sf_dir):
    frame, _ = device.fit_transform(_merged(spark, sf_dir))
    return round_doubles(prof.equal_width_buckets(frame, "device_risk_score", 10))


@register("preview")
def preview(spark, sf_dir):
    return round_doubles(prof.preview(_merged(spark, sf_dir), 3))


# ---- split and metrics (L2-L4, X1, W5, M6-M11) ----
from riskloom.operators import metrics, split  # noqa: E402


def fixed_scores(spark, sf_dir):
    """Fixed component score per transaction: (amount mod 100) / 100, label = isFraud."""
    from riskloom.sources.tables import events_transactions
    tx = events_transactions(spark, sf_dir)
    return tx.select("TransactionID", (F.pmod(F.col("TransactionAmt"), F.lit(100.0)) / 100).alias("score"),
                     F.col("isFraud").alias("label"))


@register("score_curve")
def score_curve(spark, sf_dir):
    return round_doubles(metrics.score_curve(fixed_scores(spark, sf_dir)))


@register("ranking_metrics")
def ranking_metrics(spark, sf_dir):
    return round_doubles(metrics.ranking_metrics(fixed_scores(spark, sf_dir), threshold=0.5))


@register("confusion_at_threshold")
def confusion_at_threshold(spark, sf_dir):
    return round_doubles(metrics.confusion_metrics(metrics.confusion(fixed_scores(spark, sf_dir), 0.5)))


@register("classification_report")
def classification_report(spark, sf_dir):
    return round_doubles(metrics.classification_report(metrics.confusion(fixed_scores(spark, sf_dir), 0.5)))


@register("threshold_f1")
def threshold_f1(spark, sf_dir):
    return round_doubles(metrics.threshold_f1(fixed_scores(spark, sf_dir)))


@register("time_split")
def time_split(spark, sf_dir):
    from riskloom.sources.tables import events_transactions
    return split.time_split_flags(events_transactions(spark, sf_dir)).select("TransactionID", "is_validation")


@register("stratified_fold_sizes")
def stratified_fold_sizes(spark, sf_dir):
    from riskloom.sources.tables import events_transactions
    folds = split.stratified_folds(events_transactions(spark, sf_dir), k=5)
    return folds.groupBy("isFraud", "fold").agg(F.count(F.lit(1)).alias("n"))


# ---- entity graph (G1-G12, J11, J15, U2, U3, F14, F16) ----
from riskloom.operators import graph as gr  # noqa: E402


def _graph(spark, sf_dir):
    return gr.build(merged_transactions(spark, sf_dir))


@register("graph_vertices")
def graph_vertices(spark, sf_dir):
    return _graph(spark, sf_dir).vertices


@register("graph_edges")
def graph_edges(spark, sf_dir):
    return _graph(spark, sf_dir).edges


@register("graph_counts")
def graph_counts(spark, sf_dir):
    return gr.graph_counts(_graph(spark, sf_dir))


@register("graph_node_metrics")
def graph_node_metrics(spark, sf_dir):
    return round_doubles(gr.node_features(_graph(spark, sf_dir), with_pagerank=False))


@register("graph_pagerank")
def graph_pagerank(spark, sf_dir):
    return gr.pagerank(_graph(spark, sf_dir))


@register("graph_transaction_features")
def graph_transaction_features(spark, sf_dir):
    df = merged_transactions(spark, sf_dir)
    feats = gr.node_features(gr.build(df), with_pagerank=False)
    out = gr.transaction_graph_features(df, feats)
    return round_doubles(out.select("TransactionID", *[c for c in gr.ZERO_FEATURES if c in out.columns]))


@register("graph_score")
def graph_score(spark, sf_dir):
    df = merged_transactions(spark, sf_dir)
    return round_doubles(gr.graph_score(df, gr.build(df)).select("TransactionID", "graph_score"))


@register("supplier_graph_degrees")
def supplier_graph_degrees(spark, sf_dir):
    """Large bipartite graph (customer = card, supplier = device): degrees
    and neighbour counts including the next-4 co-device links."""
    from riskloom.sources.tables import card_device_pairs
    return gr.degrees(gr.build(card_device_pairs(spark, sf_dir)))


# ---- scoring and monitoring on fixed component scores (F15-F19, F24, F29, P12-P16, A23-A30, L6-L8) ----
from riskloom.functions import risk  # noqa: E402
from riskloom.operators import monitor  # noqa: E402
from riskloom.sources.tables import EPOCH_OFFSET  # noqa: E402


def fixed_predictions(spark, sf_dir):
    """Prediction rows from fixed component scores derived from the tables:
    lgbm = (amount mod 100) / 100, graph = F16 degree score, anomaly =
    ((id * 37) mod 100) / 100."""
    df = merged_transactions(spark, sf_dir)
    df = gr.graph_score(df, gr.build(df))
    lgbm = F.pmod(F.col("TransactionAmt"), F.lit(100.0)) / 100
    anomaly = F.pmod(F.col("TransactionID") * 37, F.lit(100)).cast("double") / 100
    pred = risk.prediction_struct(F.col("TransactionID"), lgbm, F.col("graph_score"), anomaly,
                                  F.col("TransactionAmt"))
    return df.select(pred.alias("p"), F.col("TransactionDT").alias("ts"), F.col("DeviceInfo").alias("device"),
                     "TransactionAmt", F.col("isFraud").alias("label"),
                     F.floor(F.col("TransactionID") / 100).alias("batch_id")).select("p.*", "*").drop("p")


@register("scored_fixed")
def scored_fixed(spark, sf_dir):
    p = fixed_predictions(spark, sf_dir)
    return round_doubles(p.select("transaction_id", "fraud_score", "risk_level", "component_scores.*",
                                  F.array_join("reasons", " | ").alias("reasons_text")))


@register("risk_counts")
def risk_counts(spark, sf_dir):
    return monitor.risk_counts(fixed_predictions(spark, sf_dir))


@register("dashboard_kpis")
def dashboard_kpis(spark, sf_dir):
    return round_doubles(monitor.kpis(fixed_predictions(spark, sf_dir)))


@register("mean_component_scores")
def mean_component_scores(spark, sf_dir):
    return round_doubles(monitor.mean_component_scores(fixed_predictions(spark, sf_dir)))


@register("batch_summary")
def batch_summary(spark, sf_dir):
    return round_doubles(monitor.batch_summary(fixed_predictions(spark, sf_dir)))


@register("request_counters")
def request_counters(spark, sf_dir):
    p = fixed_predictions(spark, sf_dir).withColumn("endpoint", F.lit("/predict/batch"))
    return monitor.request_counters(p)


@register("last_score")
def last_score(spark, sf_dir):
    return round_doubles(monitor.last_score(fixed_predictions(spark, sf_dir)))


@register("consumer_stats")
def consumer_stats(spark, sf_dir):
    from riskloom.sources.tables import events_transactions
    valid, bad = monitor.validate_requests(events_transactions(spark, sf_dir))
    return round_doubles(monitor.consumer_stats(fixed_predictions(spark, sf_dir), bad))


@register("top_alert_devices")
def top_alert_devices(spark, sf_dir):
    return monitor.top_alert_devices(fixed_predictions(spark, sf_dir))


@register("latest_alerts")
def latest_alerts(spark, sf_dir):
    p = fixed_predictions(spark, sf_dir).filter(monitor.is_high_risk(F.col("risk_level")))
    out = monitor.latest_alerts(p, 20)
    return round_doubles(out.select("transaction_id", "fraud_score", risk.badge(F.col("risk_level")).alias("badge"),
                                    risk.clock_text(F.col("ts") + F.lit(EPOCH_OFFSET)).alias("clock"),
                                    F.array_join("reasons", " | ").alias("reasons_text")))


@register("alert_buffer")
def alert_buffer(spark, sf_dir):
    out = monitor.latest_alerts(fixed_predictions(spark, sf_dir), 200)
    return round_doubles(out.select("transaction_id", "fraud_score", "risk_level", "ts"))


@register("alert_filter")
def alert_filter(spark, sf_dir):
    out = monitor.filter_alerts(fixed_predictions(spark, sf_dir), ["MEDIUM", "HIGH", "CRITICAL"], 0.3)
    return round_doubles(out.select("transaction_id", "fraud_score", "risk_level"))


@register("request_quarantine")
def request_quarantine(spark, sf_dir):
    from riskloom.sources.tables import events_transactions
    valid, bad = monitor.validate_requests(events_transactions(spark, sf_dir))
    counts = valid.agg(F.count(F.lit(1)).alias("n_valid")).crossJoin(bad.agg(F.count(F.lit(1)).alias("n_quarantined")))
    return counts


@register("batch_quarantine")
def batch_quarantine(spark, sf_dir):
    """Requests by the verdict on their batch (all requests of an hour)."""
    from riskloom.sources.tables import events_transactions
    t = events_transactions(spark, sf_dir).select("TransactionID", F.floor(F.col("TransactionDT") / 3600).alias("hour"))
    valid, bad = monitor.validate_batches(t, "hour", 10)
    both = valid.withColumn("quarantine_reason", F.lit("")).unionByName(bad)
    return both.groupBy("quarantine_reason").agg(F.count(F.lit(1)).alias("n_requests"),
                                                 F.countDistinct("hour").alias("n_batches"))


@register("prediction_quarantine")
def prediction_quarantine(spark, sf_dir):
    """P15 on responses: the score is the amount over 100 (so some lie outside
    [0, 1]), the level the event type for every tenth row."""
    from riskloom.sources.tables import events_transactions
    t = events_transactions(spark, sf_dir)
    score = F.col("TransactionAmt") / 100
    level = F.when(F.col("TransactionID") % 10 == 0, F.col("ProductCD")).otherwise(risk.risk_level(score))
    valid, bad = monitor.validate_predictions(t.select(score.alias("fraud_score"), level.alias("risk_level")))
    both = valid.withColumn("quarantine_reason", F.lit("")).unionByName(bad)
    return both.groupBy("quarantine_reason").agg(F.count(F.lit(1)).alias("n_predictions"))


@register("entity_distinct_weeks")
def entity_distinct_weeks(spark, sf_dir):
    """A5, A6 as merged daily states: cards per device and e-mail domain and
    week.  The estimate itself is compared with the exact count here; the row
    says whether it lies within the stated bound."""
    from riskloom.operators import distinct
    df = merged_transactions(spark, sf_dir)
    day, week = F.floor(F.col("TransactionDT") / 86400), F.floor(F.col("TransactionDT") / 604800)
    out = None
    for entity in ("DeviceInfo", "P_emaildomain"):
        states = distinct.daily_states(df, entity, "card1", day, "isFraud")
        got = distinct.over_days(states, F.floor(F.col("day") / 7)).withColumnRenamed("span", "week")
        exact = df.where(F.col(entity).isNotNull()).groupBy(F.col(entity).alias("entity"), week.alias("week")).agg(
            F.countDistinct("card1").alias("n_cards"))
        off = F.abs(F.col("n_members") - F.col("n_cards"))
        part = got.join(exact, ["entity", "week"]).select(
            "entity", "week", "n_cards", "n_rows", "n_labels",
            (off <= F.ceil(distinct.error_bound() * F.col("n_cards"))).alias("within_bound"))
        out = part if out is None else out.unionByName(part)
    return out


@register("alert_windows_10s")
def alert_windows_10s(spark, sf_dir):
    p = fixed_predictions(spark, sf_dir)
    t = F.timestamp_seconds(F.col("ts") + F.lit(EPOCH_OFFSET))
    out = monitor.event_time_windows(p, t, "10 seconds")
    return round_doubles(out.select(F.unix_seconds("window_start").alias("window_start"), "processed", "alerts",
                                    "fraud_rate"))


@register("rolling_fraud_rate_60s")
def rolling_fraud_rate_60s(spark, sf_dir):
    p = fixed_predictions(spark, sf_dir)
    t = F.timestamp_seconds(F.col("ts") + F.lit(EPOCH_OFFSET))
    out = monitor.event_time_windows(p, t, "60 seconds", "10 seconds")
    return round_doubles(out.select(F.unix_seconds("window_start").alias("window_start"), "processed", "alerts",
                                    "fraud_rate"))


@register("latency_histogram")
def latency_histogram(spark, sf_dir):
    """A28 over the time that a row waits for the last row of its batch."""
    p = fixed_predictions(spark, sf_dir).drop("latency_ms")
    last = p.groupBy("batch_id").agg(F.max("ts").alias("last"))
    p = p.join(last, "batch_id").withColumn("latency_ms", (F.col("last") - F.col("ts")).cast("double") * 1000)
    return round_doubles(monitor.latency_histogram(p))


@register("alert_messages")
def alert_messages(spark, sf_dir):
    p = fixed_predictions(spark, sf_dir).filter(monitor.is_high_risk(F.col("risk_level")))
    pred = F.struct(*[F.col(c) for c in ("transaction_id", "fraud_score", "risk_level", "component_scores",
                                         "reasons")])
    return p.select(F.col("transaction_id").alias("key"),
                    F.to_json(risk.alert_message(pred, F.col("TransactionAmt"))).alias("value"))


# ---- models and scoring pipeline (M1-M5, M12-M17, M20; rows / invariant checks) ----
_ARTIFACTS: dict = {}


def trained(spark, sf_dir):
    """Train once per (session, data dir) and reuse the artifacts for the
    model queries below."""
    from riskloom.plans import train as tr
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _ARTIFACTS:
        df = merged_transactions(spark, sf_dir)
        out = _stream_dir(spark, "train")          # shared folder (S5-S12 artifacts, runs table)
        art, report = tr.train(spark, df, out_dir=out)
        _ARTIFACTS[key] = (art, report, out)
    return _ARTIFACTS[key][:2]


def _train_dir(spark, sf_dir):
    trained(spark, sf_dir)
    return _ARTIFACTS[(spark.sparkContext.applicationId, sf_dir)][2]


@register("anomaly_scores")
def anomaly_scores(spark, sf_dir):
    from riskloom.operators import anomaly
    from riskloom.plans import train as tr
    art, _ = trained(spark, sf_dir)
    frame = tr._features(timed_transactions(spark, sf_dir), art)
    return anomaly.score(frame, art.forest).select("TransactionID", "anomaly_score", "anomaly_pred")


@register("evaluation_report")
def evaluation_report(spark, sf_dir):
    _, report = trained(spark, sf_dir)
    an = report.select("anomaly.*").columns
    return report.select("lightgbm.*", *[F.col(f"anomaly.{c}").alias(f"anomaly_{c}") for c in an],
                         "val_set_size", "val_fraud_rate")


@register("scored_transactions")
def scored_transactions(spark, sf_dir):
    from riskloom.plans import train as tr
    art, _ = trained(spark, sf_dir)
    p = tr.score(merged_transactions(spark, sf_dir), art)
    return p.select("prediction.transaction_id", "prediction.fraud_score", "prediction.risk_level",
                    "prediction.component_scores.*", F.array_join("prediction.reasons", " | ").alias("reasons_text"),
                    F.size("prediction.top_shap_features").alias("n_top_features"))


@register("feature_importance")
def feature_importance(spark, sf_dir):
    from riskloom.operators import model
    art, _ = trained(spark, sf_dir)
    return model.feature_importance(art.classifier, 25)


@register("contribution_summary")
def contribution_summary(spark, sf_dir):
    from riskloom.operators import explain
    from riskloom.plans import train as tr
    art, _ = trained(spark, sf_dir)
    frame = tr._features(timed_transactions(spark, sf_dir), art)
    return explain.global_importance(explain.contributions(art.classifier, frame), art.features, 20)


@register("contribution_checks")
def contribution_checks(spark, sf_dir):
    """M13 + W6: each row's contributions and bias are the model's margin, and
    its top five are its largest by absolute value."""
    from pyspark.ml.functions import vector_to_array
    from riskloom.operators import explain, model
    from riskloom.plans import train as tr
    art, _ = trained(spark, sf_dir)
    frame = tr._features(timed_transactions(spark, sf_dir), art)
    c = explain.top_contributions(explain.contributions(art.classifier, frame), art.features, 5)
    out = art.classifier.model.transform(model._assemble(c, art.features))
    margin = vector_to_array("rawPrediction")[1]
    total = F.aggregate("contrib", F.col("bias"), lambda a, x: a + x)
    ranked = F.slice(F.sort_array(F.transform("contrib", F.abs), asc=False), 1, 5)
    return out.select("TransactionID", (F.abs(total - margin) < 1e-9).alias("sums_to_margin"),
                      F.forall(F.arrays_zip(F.transform("top_shap_features", lambda t: F.abs(t["shap_impact"])).alias("a"), ranked.alias("b")),
                               lambda p: F.abs(p["a"] - p["b"]) <= 0.00005 + 1e-12).alias("top_five"))


@register("scored_from_store")
def scored_from_store(spark, sf_dir):
    """Scores from a stored and reloaded state equal those
    of the state in memory."""
    from riskloom.plans import store
    from riskloom.plans import train as tr
    art, _ = trained(spark, sf_dir)
    base = _stream_dir(spark, "store")
    store.save(spark, art, base)
    tx = merged_transactions(spark, sf_dir)
    cols = ["prediction.transaction_id", "prediction.fraud_score", "prediction.risk_level"]
    a = tr.score(tx, art).select(*cols)
    b = tr.score(tx, store.load(spark, base)).select(F.col(cols[0]).alias("id"), F.col(cols[1]).alias("s"), F.col(cols[2]).alias("l"))
    return a.join(b, F.col("transaction_id") == F.col("id"), "left").select(
        F.col("transaction_id").cast("long").alias("TransactionID"), (F.abs(F.col("fraud_score") - F.col("s")) < 1e-9).alias("same_score"),
        (F.col("risk_level") == F.col("l")).alias("same_level"))


@register("isotonic_calibration")
def isotonic_calibration(spark, sf_dir):
    """M2 on the fixed scores: calibrated value per distinct score."""
    from riskloom.operators import model
    s = fixed_scores(spark, sf_dir)
    iso = model.isotonic(s)
    scores = s.select(F.col("score").cast("double").alias("score")).filter(F.col("score").isNotNull()).distinct()
    return round_doubles(iso.transform(scores))


@register("hash_sample")
def hash_sample(spark, sf_dir):
    """L3: repeatable sample of 2 000 transactions."""
    from riskloom.sources.tables import events_transactions
    return split.hash_sample(events_transactions(spark, sf_dir), 2000)


# ---- streaming (V7 checked against the batch definition; S14 / S17 / S18 codec) ----
def _stream_dir(spark, name):
    import uuid
    from riskloom.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:8]}"


@register("stream_card_velocity")
def stream_card_velocity(spark, sf_dir):
    """Canonical rows -> time-ordered JSON files -> file stream -> keyed
    velocity state -> Parquet sink in the shared folder -> read back."""
    from riskloom.streaming import stream as st
    from riskloom.streaming.velocity_state import card_velocity_stream
    from riskloom.sources.tables import events_transactions
    base = _stream_dir(spark, "stream-velocity")
    st.write_time_ordered_files(events_transactions(spark, sf_dir), f"{base}/in", 6)
    q = (card_velocity_stream(st.transaction_stream(spark, f"{base}/in"))
         .writeStream.format("parquet").option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/ckpt").outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out")


SCORED_MESSAGE = "transaction_id long, risk_level string, ts long, label int, invalid boolean"


def _scored_log(spark, sf_dir, base, run):
    """Fixed predictions as messages of a log, appended in three slices of
    event time; ``run(log)`` consumes what has come, from where it stopped."""
    from riskloom.session import cut_lineage
    from riskloom.sources.message_log import append_messages
    amount = F.col("TransactionAmt")
    p = cut_lineage(fixed_predictions(spark, sf_dir).select(
        "transaction_id", "risk_level", "ts", "label", (amount.isNull() | ~(amount > 0)).alias("invalid")))
    low, high = p.agg(F.min("ts"), F.max("ts")).first()
    for k in range(3):
        a, b = low + (high + 1 - low) * k // 3, low + (high + 1 - low) * (k + 1) // 3
        part = p.filter((F.col("ts") >= a) & (F.col("ts") < b))
        append_messages(part.select(F.col("transaction_id").cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"), "ts"),
                        f"{base}/log", 4, order="ts")
        run(f"{base}/log")


def _scored_stream(spark, log):
    from riskloom.sources.message_log import read_log
    return read_log(spark, log).select(F.from_json("value", SCORED_MESSAGE).alias("m")).select("m.*")


def _stream_windows(spark, sf_dir, name, duration, slide=None):
    from riskloom.streaming import stats
    base = _stream_dir(spark, name)
    shape = []

    def run(log):
        w = stats.window_updates(_scored_stream(spark, log), F.timestamp_seconds(F.col("ts") + F.lit(EPOCH_OFFSET)), duration, slide)
        shape[:] = [w.schema]
        stats.start_updates(w, f"{base}/out", f"{base}/ckpt").awaitTermination()

    _scored_log(spark, sf_dir, base, run)
    out = stats.latest_windows(spark, f"{base}/out", shape[0])
    return round_doubles(out.select(F.unix_seconds("window_start").alias("window_start"), "processed", "alerts", "fraud_rate"))


@register("stream_alert_windows_10s")
def stream_alert_windows_10s(spark, sf_dir):
    """V4: message log -> watermarked tumbling windows in update mode, the
    query stopped and started again from its offsets between appends."""
    return _stream_windows(spark, sf_dir, "stream-windows", "10 seconds")


@register("stream_rolling_fraud_rate_60s")
def stream_rolling_fraud_rate_60s(spark, sf_dir):
    """V6: the same with sliding windows of 60 seconds."""
    return _stream_windows(spark, sf_dir, "stream-rolling", "60 seconds", "10 seconds")


@register("stream_consumer_stats")
def stream_consumer_stats(spark, sf_dir):
    """V2 + A30: counters of a consuming query, added up by its listener over
    two restarts."""
    from riskloom.streaming import stats
    base = _stream_dir(spark, "stream-consumer")
    listener = stats.ConsumerListener()
    spark.streams.addListener(listener)
    try:
        def run(log):
            s = stats.observed(_scored_stream(spark, log), F.col("invalid"))
            q = (s.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/ckpt")
                 .trigger(availableNow=True).start())
            listener.query_id = str(q.id)
            q.awaitTermination()
            listener.wait(str(q.runId))

        _scored_log(spark, sf_dir, base, run)
    finally:
        spark.streams.removeListener(listener)
    return round_doubles(stats.totals_frame(spark, listener))


@register("message_log_offsets")
def message_log_offsets(spark, sf_dir):
    """S13 + S14 + V5: every message read once over two restarts, with
    gapless offsets in each partition of the log."""
    base = _stream_dir(spark, "stream-offsets")

    def run(log):
        from riskloom.sources.message_log import read_log
        (read_log(spark, log).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/ckpt")
         .trigger(availableNow=True).start().awaitTermination())

    _scored_log(spark, sf_dir, base, run)
    seen = spark.read.parquet(f"{base}/out")
    return seen.select(F.col("key").cast("long").alias("transaction_id"), F.from_json("value", SCORED_MESSAGE)["ts"].alias("ts"),
                       (F.count(F.lit(1)).over(Window.partitionBy("partition", "offset")) == 1).alias("once"),
                       (F.max("offset").over(Window.partitionBy("partition")) + 1 ==
                        F.count(F.lit(1)).over(Window.partitionBy("partition"))).alias("gapless"))


@register("message_roundtrip")
def message_roundtrip(spark, sf_dir):
    """S17 encode -> S18 decode of the merged rows (values must survive)."""
    from riskloom.streaming import stream as st
    df = merged_transactions(spark, sf_dir)
    back = st.decode_messages(st.encode_messages(df))
    return round_doubles(back.select(*df.columns))


# ---- embeddings (G13, G14, J12; invariant checks) ----
from riskloom.config import WalkParams  # noqa: E402
from riskloom.operators import embed  # noqa: E402


@register("graph_walks")
def graph_walks(spark, sf_dir):
    """G13 walks (50 walks of length 20 per vertex on the canonical graph)."""
    return embed.random_walks(_graph(spark, sf_dir), WalkParams())


@register("node_embeddings")
def node_embeddings(spark, sf_dir):
    """Word2Vec (dim 64, window 10) over the walks."""
    walks = embed.random_walks(_graph(spark, sf_dir), WalkParams())
    return embed.word2vec_embeddings(walks, WalkParams())


@register("fallback_embeddings")
def fallback_embeddings(spark, sf_dir):
    return embed.fallback_embeddings(_graph(spark, sf_dir))


@register("transaction_embeddings")
def transaction_embeddings(spark, sf_dir):
    """J12 with the fallback vectors: card / device vectors per transaction."""
    df = merged_transactions(spark, sf_dir)
    emb = written(embed.fallback_embeddings(gr.build(df)))
    return embed.transaction_embeddings(df, emb).select("TransactionID", "emb_card", "emb_device")


# ---- file sources (S1-S4) ----
@register("csv_source")
def csv_source(spark, sf_dir):
    """S1 + S2 + J1: both tables written as CSV to the shared folder, read
    back with explicit schemas, then merged."""
    from riskloom.operators.merge import merge_identity
    from riskloom.sources import files
    from riskloom.sources.tables import ID_SCHEMA, TX_SCHEMA, events_identity, events_transactions
    base = _stream_dir(spark, "csv")
    files.write_csv(events_transactions(spark, sf_dir), f"{base}/tx")
    files.write_csv(events_identity(spark, sf_dir), f"{base}/id")
    tx = files.read_csv(spark, f"{base}/tx", TX_SCHEMA)
    idn = files.read_csv(spark, f"{base}/id", ID_SCHEMA)
    return round_doubles(merge_identity(tx, idn))


@register("bounded_scan")
def bounded_scan(spark, sf_dir):
    from riskloom.sources import files
    return round_doubles(files.bounded_scan(merged_transactions(spark, sf_dir), 100))


@register("identity_match")
def identity_match(spark, sf_dir):
    """Identity rows matched in the transaction table."""
    from riskloom.operators.merge import identity_match as im
    from riskloom.sources.tables import events_identity, events_transactions
    return round_doubles(im(events_transactions(spark, sf_dir), events_identity(spark, sf_dir)))


@register("card_amount_windows")
def card_amount_windows(spark, sf_dir):
    """Trailing 1 h / 24 h / 7 d mean and sample std of earlier amounts
    per card.  Reported at 4 dp: a square root lands arbitrarily close to a
    6-dp boundary, where summation-order noise would flip the last digit."""
    from riskloom.operators.velocity import velocity_features
    from riskloom.sources.tables import events_transactions
    out = velocity_features(events_transactions(spark, sf_dir), amount="TransactionAmt")
    cols = [f"card_tx_{m}_amt_{w}" for w in ("1h", "24h", "7d") for m in ("mean", "std")]
    return out.select("TransactionID", *[F.round(F.col(c) * F.lit(1.0 + 1e-11), 4).alias(c) for c in cols])


@register("best_run")
def best_run(spark, sf_dir):
    """Best training run by calibrated ROC-AUC from the runs table."""
    from riskloom.plans import train as tr
    return tr.best_run(spark, f"{_train_dir(spark, sf_dir)}/runs").drop("start_time", "run_id", "duration_s")


@register("recent_runs")
def recent_runs(spark, sf_dir):
    """The last runs by start time."""
    from riskloom.plans import train as tr
    return tr.recent_runs(spark, f"{_train_dir(spark, sf_dir)}/runs", 10).select(
        "param_max_iter", "param_max_depth", "cal_roc_auc", "cal_pr_auc")
