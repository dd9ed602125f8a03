"""Monitoring queries over prediction tables
and request validation (P15, P16).  Predictions are rows with columns
transaction_id, fraud_score, risk_level, component_scores, ts (epoch
seconds) and optional device / latency_ms / batch_id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIGH = ("HIGH", "CRITICAL")
# fixed values: requests of a batch, risk levels
MAX_BATCH = 100
RISK_LEVELS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
LATENCY_BUCKETS = (0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0)


def is_high_risk(level: Column) -> Column:
    """P13."""
    return level.isin(*HIGH)


def filter_alerts(df: DataFrame, levels: Sequence[str], min_score: float) -> DataFrame:
    """P12."""
    return df.filter(F.col("risk_level").isin(*levels) & (F.col("fraud_score") >= min_score))


def risk_counts(df: DataFrame) -> DataFrame:
    """A23."""
    return df.groupBy("risk_level").agg(F.count(F.lit(1)).alias("count"))


def kpis(df: DataFrame, processed: DataFrame | None = None) -> DataFrame:
    """Processed, high/critical, critical, mean score, alert rate."""
    total = (processed if processed is not None else df).agg(F.count(F.lit(1)).alias("total_processed"))
    a = df.agg(F.count_if(is_high_risk(F.col("risk_level"))).alias("n_high"),
               F.count_if(F.col("risk_level") == "CRITICAL").alias("n_critical"),
               F.avg("fraud_score").alias("avg_fraud_score"))
    return total.crossJoin(a).withColumn(
        "alert_rate", F.try_divide(F.col("n_high").cast("double"), F.greatest(F.col("total_processed"), F.lit(1))))


def mean_component_scores(df: DataFrame) -> DataFrame:
    """A25 + F28: struct flatten, mean per component, wide -> long."""
    wide = df.select("component_scores.*").agg(F.avg("lgbm").alias("LightGBM"), F.avg("graph").alias("Graph"),
                                               F.avg("anomaly").alias("Anomaly"))
    return wide.unpivot([], ["LightGBM", "Graph", "Anomaly"], "model", "average_score")


def batch_summary(df: DataFrame, batch_col: str = "batch_id") -> DataFrame:
    """Per batch total, high-risk count and mean score (4 dp)."""
    return df.groupBy(batch_col).agg(
        F.count(F.lit(1)).alias("total_processed"),
        F.count_if(is_high_risk(F.col("risk_level"))).alias("high_risk_count"),
        # 4 dp; the 1e-11 relative nudge makes exact decimal ties round the
        # same way whatever the summation order
        F.round(F.avg("fraud_score") * F.lit(1.0 + 1e-11), 4).alias("avg_fraud_score"))


def request_counters(df: DataFrame, endpoint_col: str = "endpoint") -> DataFrame:
    """Request count by (endpoint, risk level) and the alert counter."""
    return df.groupBy(endpoint_col, "risk_level").agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(is_high_risk(F.col("risk_level"))).alias("alerts"))


def latency_histogram(df: DataFrame, latency_ms: str = "latency_ms") -> DataFrame:
    """Cumulative bucket counts (seconds), one aggregate."""
    sec = F.col(latency_ms) / 1000.0
    wide = df.agg(*[F.count_if(sec <= b).alias(f"le_{i}") for i, b in enumerate(LATENCY_BUCKETS)],
                  F.count(F.lit(1)).alias("le_inf"), F.sum(sec).alias("sum_seconds"))
    rows = [F.struct(F.lit(str(b)).alias("le"), F.col(f"le_{i}").alias("count")) for i, b in enumerate(LATENCY_BUCKETS)]
    rows.append(F.struct(F.lit("+Inf").alias("le"), F.col("le_inf").alias("count")))
    return wide.select(F.explode(F.array(*rows)).alias("b"), "sum_seconds").select("b.*", "sum_seconds")


def last_score(df: DataFrame, ts: str = "ts", id_col: str = "transaction_id") -> DataFrame:
    """Most recent fraud score (ties on time broken by id)."""
    return df.agg(F.max_by("fraud_score", F.struct(F.col(ts), F.col(id_col))).alias("last_fraud_score"))


def consumer_stats(df: DataFrame, errors: DataFrame, ts: str = "ts") -> DataFrame:
    """A30 batch form: processed, high risk, errors, rate per second of event time."""
    a = df.agg(F.count(F.lit(1)).alias("processed"),
               F.count_if(is_high_risk(F.col("risk_level"))).alias("high_risk"),
               F.min(ts).alias("_t0"), F.max(ts).alias("_t1"))
    e = errors.agg(F.count(F.lit(1)).alias("errors"))
    return a.crossJoin(e).withColumn(
        "tps", F.col("processed") / F.greatest(F.col("_t1") - F.col("_t0"), F.lit(1.0))).drop("_t0", "_t1")


def top_alert_devices(df: DataFrame, device: str = "device", k: int = 8) -> DataFrame:
    """Devices with the most HIGH/CRITICAL alerts (ties by name)."""
    return df.filter(is_high_risk(F.col("risk_level")) & F.col(device).isNotNull()) \
        .groupBy(device).agg(F.count(F.lit(1)).alias("alert_count")) \
        .orderBy(F.desc("alert_count"), device).limit(k)


def latest_alerts(df: DataFrame, n: int = 20, ts: str = "ts", id_col: str = "transaction_id") -> DataFrame:
    """Newest n alerts (event time, then id)."""
    return df.orderBy(F.desc(ts), F.desc(id_col)).limit(n)


def validate_requests(df: DataFrame, amount: str = "TransactionAmt") -> tuple[DataFrame, DataFrame]:
    """P15 + P16: defaults for absent fields, then split valid / quarantine
    (amount must be > 0) with a reason column."""
    cols = {"TransactionDT": F.coalesce(F.col("TransactionDT").cast("double"), F.lit(86400.0)).cast("bigint")
            if "TransactionDT" in df.columns else F.lit(86400).cast("bigint"),
            "ProductCD": F.coalesce(F.col("ProductCD"), F.lit("W")) if "ProductCD" in df.columns else F.lit("W")}
    d = df.withColumns(cols)
    bad = F.col(amount).isNull() | ~(F.col(amount) > 0)
    reason = F.when(F.col(amount).isNull(), F.lit("missing TransactionAmt")).when(
        ~(F.col(amount) > 0), F.lit("TransactionAmt must be > 0"))
    return d.filter(~bad), d.filter(bad).withColumn("quarantine_reason", reason)


def validate_batches(df: DataFrame, batch: str, max_size: int = MAX_BATCH) -> tuple[DataFrame, DataFrame]:
    """Requests of batches of at most ``max_size`` rows, and those of
    larger ones with a reason column.  A batch goes or stays whole; rows
    without a batch are single requests and stay.  Only sizes of batches that
    are too large take part in the join."""
    large = df.where(F.col(batch).isNotNull()).groupBy(batch).agg(F.count(F.lit(1)).alias("_n")) \
        .where(F.col("_n") > max_size).select(F.col(batch).alias("_batch"), "_n")
    marked = df.join(large, F.col(batch) == F.col("_batch"), "left").drop("_batch")
    reason = F.concat(F.lit("batch of "), F.col("_n").cast("string"), F.lit(f" requests, at most {max_size} allowed"))
    return marked.where(F.col("_n").isNull()).drop("_n"), \
        marked.where(F.col("_n").isNotNull()).withColumn("quarantine_reason", reason).drop("_n")


def validate_predictions(df: DataFrame, score: str = "fraud_score", level: str = "risk_level") -> tuple[DataFrame, DataFrame]:
    """Predictions with a score within [0, 1] and a known level, and the
    others with a reason column (the first rule that fails)."""
    x, lv = F.col(score), F.col(level)
    reason = F.when(x.isNull() | F.isnan(x), F.lit("missing score")) \
        .when(~x.between(0.0, 1.0), F.lit("score outside [0, 1]")) \
        .when(~F.coalesce(lv.isin(*RISK_LEVELS), F.lit(False)), F.lit("unknown risk level"))
    marked = df.withColumn("quarantine_reason", reason)
    return marked.where(F.col("quarantine_reason").isNull()).drop("quarantine_reason"), \
        marked.where(F.col("quarantine_reason").isNotNull())


def event_time_windows(df: DataFrame, ts: Column, duration: str, slide: str | None = None) -> DataFrame:
    """V4 / V6 batch form: tumbling or sliding event-time windows with
    processed / alert counts and alert rate."""
    w = F.window(ts, duration, slide) if slide else F.window(ts, duration)
    return df.groupBy(w.alias("w")).agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if(is_high_risk(F.col("risk_level"))).alias("alerts"),
        F.avg(F.col("label").cast("double")).alias("fraud_rate") if "label" in df.columns else F.lit(None).alias("fraud_rate"),
    ).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "processed", "alerts",
             "fraud_rate")
