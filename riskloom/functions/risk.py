"""Scoring expressions: ensemble blend (F15), risk level (F17), reasons
(F18), prediction record (F19), alert message / log record (F25, F26),
risk badge (F29), clock text (F24).  All are Column expressions, so a
scoring plan stays inside whole-stage codegen.

Fixed texts (must equal the reference service's output):
  "High ML fraud probability ({lgbm%})"                                   lgbm > 0.40
  "Card appears in a high-risk device-sharing network (graph risk: {g%})"  graph > 0.5
  "Transaction pattern is statistically anomalous (anomaly score: {a%})"   anomaly > 0.7
  "Unusually large transaction amount (${amount, thousands, 0 dp})"       amount > 5000
  "Suspicious {feature} = {value 2 dp} ({high|low} fraud impact)"          |impact| > 0.05, first two contributions
  "No specific high-risk indicators detected"                             otherwise
Badges: CRITICAL "🟣 CRITICAL", HIGH "🔴 HIGH", MEDIUM "🟠 MEDIUM", LOW "🟢 LOW".
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.config import ENSEMBLE_WEIGHTS, RISK_THRESHOLDS

BADGES = (("CRITICAL", "🟣 CRITICAL"), ("HIGH", "🔴 HIGH"), ("MEDIUM", "🟠 MEDIUM"), ("LOW", "🟢 LOW"))


def blend(lgbm: Column, graph: Column, anomaly: Column, weights=ENSEMBLE_WEIGHTS) -> Column:
    """weighted sum clipped to [0, 1]."""
    s = lgbm * weights["lgbm"] + graph * weights["graph"] + anomaly * weights["anomaly"]
    # greatest / least skip nulls: a missing component keeps the score null
    return F.when(s.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)))


def risk_level(score: Column) -> Column:
    """F17."""
    expr = F.lit("LOW")
    for name, t in reversed(RISK_THRESHOLDS):
        expr = F.when(score >= t, F.lit(name)).otherwise(expr)
    return expr


def pct(x: Column) -> Column:
    """Whole percent text, e.g. 0.8 -> '80%'."""
    return F.concat(F.round(x * 100, 0).cast("bigint").cast("string"), F.lit("%"))


def reasons(lgbm: Column, graph: Column, anomaly: Column, amount: Column, shap: Column | None = None) -> Column:
    """array of reason texts (array filter, no UDF)."""
    items = [
        F.when(lgbm > 0.40, F.concat(F.lit("High ML fraud probability ("), pct(lgbm), F.lit(")"))),
        F.when(graph > 0.5, F.concat(F.lit("Card appears in a high-risk device-sharing network (graph risk: "),
                                     pct(graph), F.lit(")"))),
        F.when(anomaly > 0.7, F.concat(F.lit("Transaction pattern is statistically anomalous (anomaly score: "),
                                       pct(anomaly), F.lit(")"))),
        F.when(F.coalesce(amount, F.lit(0.0)) > 5000,
               F.concat(F.lit("Unusually large transaction amount ($"), F.format_number(F.round(amount, 0), 0),
                        F.lit(")"))),
    ]
    arr = F.filter(F.array(*items), lambda x: x.isNotNull())
    if shap is not None:
        top2 = F.filter(F.slice(F.coalesce(shap, F.array().cast("array<struct<feature:string,value:double,shap_impact:double>>")), 1, 2),
                        lambda s: F.abs(s["shap_impact"]) > 0.05)
        arr = F.concat(arr, F.transform(top2, lambda s: F.concat(
            F.lit("Suspicious "), s["feature"], F.lit(" = "), F.format_number(s["value"], 2), F.lit(" ("),
            F.when(s["shap_impact"] > 0, F.lit("high")).otherwise(F.lit("low")), F.lit(" fraud impact)"))))
    return F.when(F.size(arr) == 0, F.array(F.lit("No specific high-risk indicators detected"))).otherwise(arr)


def prediction_struct(tx_id: Column, lgbm: Column, graph: Column, anomaly: Column, amount: Column,
                      shap: Column | None = None, latency_ms: Column | None = None) -> Column:
    """the prediction record (scores rounded to 4 dp, latency to 2 dp,
    missing id -> 'UNKNOWN', timestamp = processing time in epoch seconds)."""
    score = blend(lgbm, graph, anomaly)
    empty_shap = F.array().cast("array<struct<feature:string,value:double,shap_impact:double>>")
    return F.struct(
        F.coalesce(tx_id.cast("string"), F.lit("UNKNOWN")).alias("transaction_id"),
        F.round(score, 4).alias("fraud_score"),
        risk_level(score).alias("risk_level"),
        F.struct(F.round(lgbm, 4).alias("lgbm"), F.round(graph, 4).alias("graph"),
                 F.round(anomaly, 4).alias("anomaly")).alias("component_scores"),
        reasons(lgbm, graph, anomaly, amount, shap).alias("reasons"),
        (shap if shap is not None else empty_shap).alias("top_shap_features"),
        F.round(latency_ms if latency_ms is not None else F.lit(0.0), 2).alias("latency_ms"),
        F.unix_micros(F.current_timestamp()).cast("double").__truediv__(1e6).alias("timestamp"),
    )


def alert_message(pred: Column, amount: Column) -> Column:
    """alert topic message."""
    return F.struct(
        F.lit("fraud_detection").alias("alert_type"), pred["transaction_id"].alias("transaction_id"),
        pred["fraud_score"].alias("fraud_score"), pred["risk_level"].alias("risk_level"),
        pred["reasons"].alias("reasons"), pred["component_scores"].alias("component_scores"),
        amount.alias("original_amount"),
        (F.unix_micros(F.current_timestamp()) / 1e6).alias("alert_timestamp"))


def badge(level: Column) -> Column:
    """F29."""
    expr = level
    for k, v in BADGES:
        expr = F.when(level == k, F.lit(v)).otherwise(expr)
    return expr


def clock_text(epoch_seconds: Column) -> Column:
    """HH:MM:SS of an epoch time (UTC, zone-independent arithmetic)."""
    s = F.pmod(F.floor(epoch_seconds).cast("bigint"), F.lit(86400))
    return F.format_string("%02d:%02d:%02d", (s / 3600).cast("int"), ((s % 3600) / 60).cast("int"),
                           (s % 60).cast("int"))
