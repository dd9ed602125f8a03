"""Device / email / address / card-identity statistics (A5-A8), their joins
with fills (J6-J10), device-type risk (F9, T10 fixed), identity mismatch
(F10) and the high-risk-device flag (F11, J16).

All four statistics tables are ``groupBy(entity)`` aggregates with partial
(map-side) aggregation, so a hot device or domain costs one combined row per
map task, not a hot reducer.  ``countDistinct`` deduplicates (entity, card)
pairs first; a hot entity then holds at most its distinct cards.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.config import DEVICE_TYPE_RISK, DEVICE_TYPE_RISK_DEFAULT, ROLES
from riskloom.operators.merge import safe_join
from riskloom.operators.quantile import quantile_row


@dataclass
class EntityStats:
    device: DataFrame | None
    email: DataFrame | None
    addr: DataFrame | None
    card: DataFrame | None
    high_risk: DataFrame | None = None      # one row, _p95: stored threshold of F11 for rows that come one by one


def _rate(df: DataFrame, target: str, name: str):
    if target in df.columns:
        return F.avg(F.col(target).cast("double")).alias(name)
    return F.lit(0.0).alias(name)


def fit_entity_stats(df: DataFrame, roles=ROLES) -> EntityStats:
    card, dev, email, addr, target = roles.card, roles.device, roles.email, roles.addr, roles.target
    device = email_t = addr_t = card_t = None
    if dev in df.columns:
        device = (
            df.filter(F.col(dev).isNotNull()).groupBy(dev).agg(
                F.countDistinct(card).cast("bigint").alias("device_user_count"),
                F.count(card).cast("bigint").alias("device_tx_count"),
                _rate(df, target, "device_fraud_rate"),
            )
            # F8: min(users x rate, 10) / 10
            .withColumn("device_risk_score",
                        F.least(F.col("device_user_count") * F.col("device_fraud_rate"), F.lit(10.0)) / 10)
        )
    if email in df.columns:
        email_t = df.filter(F.col(email).isNotNull()).groupBy(email).agg(
            F.countDistinct(card).cast("bigint").alias("email_user_count"),
            _rate(df, target, "email_domain_fraud_rate"))
    if addr in df.columns:
        addr_t = df.filter(F.col(addr).isNotNull()).groupBy(addr).agg(
            F.countDistinct(card).cast("bigint").alias("addr_user_count"),
            _rate(df, target, "addr_fraud_rate"))
    parts = []
    if dev in df.columns:
        parts.append(F.countDistinct(dev).cast("bigint").alias("card_device_count"))
    if email in df.columns:
        parts.append(F.countDistinct(email).cast("bigint").alias("card_email_count"))
    if parts:
        # One aggregate instead of aligning two per-card series
        card_t = df.filter(F.col(card).isNotNull()).groupBy(card).agg(*parts)
    return EntityStats(device, email_t, addr_t, card_t)


def device_type_risk(col: F.Column) -> F.Column:
    """F9 with T10 fixed: lower-cased keys; null (filled 'Unknown') -> unknown."""
    key = F.coalesce(F.lower(col.cast("string")), F.lit("unknown"))
    expr = F.lit(DEVICE_TYPE_RISK_DEFAULT)
    for k, v in DEVICE_TYPE_RISK.items():
        expr = F.when(key == k, F.lit(v)).otherwise(expr)
    return expr


def transform(df: DataFrame, stats: EntityStats, roles=ROLES) -> DataFrame:
    card, dev, email, addr = roles.card, roles.device, roles.email, roles.addr
    out = df
    if stats.device is not None and dev in out.columns:
        out = safe_join(out, stats.device, on=dev).na.fill(
            0, subset=["device_user_count", "device_tx_count", "device_fraud_rate", "device_risk_score"])
    if stats.email is not None and email in out.columns:
        out = safe_join(out, stats.email, on=email).na.fill(
            {"email_user_count": 1, "email_domain_fraud_rate": 0.0})
    if stats.addr is not None and addr in out.columns:
        out = safe_join(out, stats.addr, on=addr).na.fill({"addr_user_count": 1, "addr_fraud_rate": 0.0})
    if stats.card is not None:
        out = safe_join(out, stats.card, on=card)
        fills = {c: 1 for c in ("card_device_count", "card_email_count") if c in out.columns}
        out = out.na.fill(fills)

    cols = {}
    if roles.device_type in out.columns:
        cols["device_type_risk"] = device_type_risk(F.col(roles.device_type))
    else:
        cols["device_type_risk"] = F.lit(DEVICE_TYPE_RISK_DEFAULT)
    if "card_device_count" in out.columns and "card_email_count" in out.columns:
        cols["identity_mismatch_score"] = (F.log1p(F.col("card_device_count")) * 0.5
                                           + F.log1p(F.col("card_email_count")) * 0.5)
    else:
        cols["identity_mismatch_score"] = F.lit(0.0)
    out = out.withColumns(cols)

    if "device_user_count" in out.columns and stats.high_risk is not None:
        out = out.crossJoin(F.broadcast(stats.high_risk)).withColumn(
            "device_is_high_risk", F.coalesce((F.col("device_user_count") > F.col("_p95")).cast("int"), F.lit(0))).drop("_p95")
    elif "device_user_count" in out.columns and stats.device is not None and dev in df.columns:
        # 95th percentile (linear) of device_user_count over the
        # rows of the frame being transformed, taken as a row-weighted
        # percentile over the per-device table (rows of unseen / null devices
        # carry the filled 0): no second pass through the joined frame
        p95 = high_risk_threshold(df, stats, roles)
        out = out.crossJoin(F.broadcast(p95)).withColumn(
            "device_is_high_risk", (F.col("device_user_count") > F.col("_p95")).cast("int")).drop("_p95")
    elif "device_user_count" in out.columns:
        p95 = df_p95(out, "device_user_count")
        out = out.crossJoin(F.broadcast(p95)).withColumn(
            "device_is_high_risk", (F.col("device_user_count") > F.col("_p95")).cast("int")).drop("_p95")
    else:
        out = out.withColumn("device_is_high_risk", F.lit(0))
    return out


def high_risk_threshold(df: DataFrame, stats: EntityStats, roles=ROLES) -> DataFrame:
    """One row, _p95: the 95th percentile of device_user_count over df's rows."""
    per_dev = df.groupBy(roles.device).agg(F.count(F.lit(1)).alias("_rows"))
    ud = stats.device.select(roles.device, "device_user_count")
    vals = per_dev.join(ud, on=roles.device, how="left").select(
        F.coalesce(F.col("device_user_count"), F.lit(0)).alias("_v"), "_rows")
    return quantile_row(vals, {"_p95": ("_v", 0.95)}, weight="_rows")


def df_p95(df: DataFrame, col: str) -> DataFrame:
    return quantile_row(df, {"_p95": (col, 0.95)})


def fit_transform(df: DataFrame, fit_df: DataFrame | None = None, roles=ROLES) -> tuple[DataFrame, EntityStats]:
    stats = fit_entity_stats(fit_df if fit_df is not None else df, roles)
    return transform(df, stats, roles), stats
