"""Profiling aggregates from the exploration notebooks (A9-A22, W3, F23, F27,
F30, J14, L9, L11).  Every one is a grouped aggregate with partial
aggregation or a one-row global aggregate; windows only run on tables that
are already aggregated to one row per day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.config import ROLES
from riskloom.functions.time import int_day_of_week
from riskloom.operators.ordinal import same
from riskloom.operators.quantile import quantile_row, quantile_table, quantiles

T = ROLES.target


def class_balance(df: DataFrame, target: str = T) -> DataFrame:
    """Counts, fraud rate and the neg/pos weight used for class weighting."""
    y = F.col(target)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(y).cast("bigint").alias("n_fraud"),
        F.count_if(y == 0).cast("bigint").alias("n_legit"),
        F.avg(y.cast("double")).alias("fraud_rate"),
    ).withColumn("scale_pos_weight", F.try_divide(F.col("n_legit").cast("double"), F.col("n_fraud")))


def fraud_rate_by(df: DataFrame, key, name: str, target: str = T) -> DataFrame:
    return df.groupBy(key.alias(name)).agg(
        F.avg(F.col(target).cast("double")).alias("fraud_rate"), F.count(F.lit(1)).alias("n"))


def fraud_by_hour(df: DataFrame, time_col: str = ROLES.time) -> DataFrame:
    """A10: integer hour of day."""
    hour = F.floor(F.pmod(F.col(time_col) / 3600.0, F.lit(24.0))).cast("int")
    return fraud_rate_by(df, hour, "hour")


def fraud_by_day_of_week(df: DataFrame, time_col: str = ROLES.time) -> DataFrame:
    """A11 with the notebook's integer day of week."""
    return fraud_rate_by(df, int_day_of_week(F.col(time_col)), "day_of_week")


def rolling_daily_fraud_rate(df: DataFrame, time_col: str = ROLES.time, days: int = 7) -> DataFrame:
    """Daily fraud rate, then a 7-row trailing mean (null until 7 rows).
    The window runs on the per-day table (one row per day)."""
    daily = df.groupBy(F.floor(F.col(time_col) / 86400).cast("bigint").alias("tx_day")).agg(
        F.avg(F.col(T).cast("double")).alias("fraud_rate"))
    w = Window.orderBy("tx_day").rowsBetween(-(days - 1), 0)
    return daily.withColumn(
        "rolling_fraud_rate",
        F.when(F.count(F.lit(1)).over(w) >= days, F.avg("fraud_rate").over(w)))


def fraud_by_category(df: DataFrame, cols: Sequence[str] = ("ProductCD", "card4", "card6", "DeviceType")) -> DataFrame:
    """Fraud rate and count per value of each categorical column, all
    columns in one aggregate through unpivot; null values dropped."""
    cols = [c for c in cols if c in df.columns]
    long = df.select(F.col(T), *[F.col(c).cast("string") for c in cols]).unpivot(
        [T], cols, "column", "value").filter(F.col("value").isNotNull())
    return long.groupBy("column", "value").agg(
        F.avg(F.col(T).cast("double")).alias("fraud_rate"), F.count(F.lit(1)).alias("n"))


def device_table(df: DataFrame, device: str = ROLES.device, card: str = ROLES.card) -> DataFrame:
    """Distinct cards, transactions and fraud rate per device."""
    return df.filter(F.col(device).isNotNull()).groupBy(device).agg(
        F.countDistinct(card).alias("n_cards"),
        F.count(ROLES.id).alias("n_transactions"),
        F.avg(F.col(T).cast("double")).alias("fraud_rate"))


def device_sharing_summary(df: DataFrame) -> DataFrame:
    """Device counts over thresholds, plus J14: fraud rate of
    transactions on devices used by more than 5 cards."""
    dt = device_table(df)
    counts = dt.agg(F.count(F.lit(1)).alias("n_devices"),
                    F.count_if(F.col("n_cards") > 1).alias("n_devices_multi_card"),
                    F.count_if(F.col("n_cards") > 5).alias("n_devices_over_5_cards"))
    # Join the per-device count back to the rows (the device table is
    # one row per device; AQE broadcasts it only when measured small)
    back = df.join(dt.select(ROLES.device, "n_cards"), on=ROLES.device, how="inner")
    rate = back.agg(F.avg(F.when(F.col("n_cards") > 5, F.col(T).cast("double"))).alias("fraud_rate_high_device"))
    overall = df.agg(F.avg(F.col(T).cast("double")).alias("fraud_rate_overall"))
    return counts.crossJoin(rate).crossJoin(overall)


def device_card_bucket_rate(df: DataFrame) -> DataFrame:
    """Mean of per-device fraud rates by right-closed card-count bucket
    (0,1] (1,2] (2,5] (5,10] (10,50] (50, inf)."""
    n = F.col("n_cards")
    bucket = (F.when(n <= 0, None).when(n <= 1, "1").when(n <= 2, "2").when(n <= 5, "3-5")
              .when(n <= 10, "6-10").when(n <= 50, "11-50").otherwise("50+"))
    return device_table(df).withColumn("card_bucket", bucket).filter(F.col("card_bucket").isNotNull()) \
        .groupBy("card_bucket").agg(F.avg("fraud_rate").alias("mean_device_fraud_rate"),
                                    F.count(F.lit(1)).alias("n_devices"))


def describe_by_class(df: DataFrame, col: str = ROLES.amount) -> DataFrame:
    """Count, mean, std, min, quartiles, max per class."""
    x = F.col(col)
    stats = df.groupBy(T).agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
                              F.min(x).alias("min"), F.max(x).alias("max"))
    q = quantile_table(df, {"p25": (col, 0.25), "p50": (col, 0.5), "p75": (col, 0.75)}, [T]).withColumnRenamed(T, "r" + T)
    return stats.join(q, same([T], "r"), "left").select(T, "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def amount_percentiles(df: DataFrame, col: str = ROLES.amount,
                       pcts: Sequence[int] = (25, 50, 75, 90, 95, 99)) -> DataFrame:
    """Linear-interpolated percentiles per class, long format."""
    q = quantiles(df, [col], [p / 100 for p in pcts], [T])
    return q.select(T, F.round(F.col("p") * 100).cast("int").alias("percentile"), "value")


def missing_rates(df: DataFrame) -> DataFrame:
    """Share of nulls per column (one aggregate over all columns)."""
    cols = df.columns
    wide = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols])
    return wide.unpivot([], cols, "column", "missing_rate")


def missing_summary(df: DataFrame) -> DataFrame:
    m = missing_rates(df)
    return m.agg(F.count_if(F.col("missing_rate") > 0.5).alias("n_over_half"),
                 F.count_if(F.col("missing_rate") > 0).alias("n_any"),
                 F.count(F.lit(1)).alias("n_columns"))


def top_missing(df: DataFrame, k: int = 50) -> DataFrame:
    """The k columns with the highest missing rate (ties by name)."""
    return missing_rates(df).orderBy(F.desc("missing_rate"), "column").limit(k)


def pearson(x, y):
    """Pairwise-complete Pearson correlation; null (not an ANSI error) when a
    side has zero variance."""
    x, y = x.cast("double"), y.cast("double")
    both = x.isNotNull() & y.isNotNull()
    xs, ys = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_samp(xs, ys), F.stddev_samp(xs) * F.stddev_samp(ys))


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pairwise-complete Pearson correlation, lower triangle, one aggregate."""
    cols = [c for c in cols if c in df.columns]
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[:i]]
    wide = df.agg(*[pearson(F.col(a), F.col(b)).alias(f"{a}|{b}") for a, b in pairs])
    long = wide.unpivot([], [f"`{a}|{b}`" for a, b in pairs], "pair", "corr")
    return long.select(F.split("pair", r"\|")[0].alias("feature_a"), F.split("pair", r"\|")[1].alias("feature_b"),
                       "corr")


def label_correlations(df: DataFrame, k: int = 30, deny: Sequence[str] = ("TransactionID", "isFraud")) -> DataFrame:
    """Correlation of every numeric column with the label, NaN/null
    dropped, top k by absolute value."""
    from pyspark.sql import types as TT
    cols = [f.name for f in df.schema.fields
            if isinstance(f.dataType, TT.NumericType) and f.name not in deny]
    wide = df.agg(*[pearson(F.col(c), F.col(T)).alias(c) for c in cols])
    long = wide.unpivot([], cols, "feature", "correlation")
    long = long.filter(F.col("correlation").isNotNull() & ~F.isnan("correlation"))
    return long.orderBy(F.desc(F.abs("correlation")), "feature").limit(k)


def class_histogram(df: DataFrame, value, bins: int, by: str = T) -> DataFrame:
    """Equal-width histogram per class over that class's own [min, max]
    (numpy semantics: last bin closed, degenerate range widened by 0.5),
    with density = count / (n * width)."""
    x = df.select(F.col(by), value.cast("double").alias("_x")).filter(F.col("_x").isNotNull() & F.col(by).isNotNull())
    rng = x.groupBy(by).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    rng = rng.withColumns({
        "_lo": F.when(F.col("_lo") == F.col("_hi"), F.col("_lo") - 0.5).otherwise(F.col("_lo")),
        "_hi": F.when(F.col("_lo") == F.col("_hi"), F.col("_hi") + 0.5).otherwise(F.col("_hi")),
    }).withColumn("_w", (F.col("_hi") - F.col("_lo")) / bins)
    # per-class range table has one row per class: fixed size
    j = x.join(F.broadcast(rng), on=by)
    b = F.least(F.floor((F.col("_x") - F.col("_lo")) / F.col("_w")), F.lit(bins - 1)).cast("int")
    h = j.groupBy(by, b.alias("bin")).agg(F.count(F.lit(1)).alias("count"), F.first("_n").alias("_n"),
                                          F.first("_w").alias("_w"), F.first("_lo").alias("_lo"))
    return h.select(by, "bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("bin_start"), "count",
                    (F.col("count") / (F.col("_n") * F.col("_w"))).alias("density"))


def clip_to_quantiles(df: DataFrame, col: str, lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """clip a column to its [1 %, 99 %] quantiles (one row, broadcast)."""
    q = quantile_row(df, {"_lo": (col, lo), "_hi": (col, hi)})
    return df.crossJoin(F.broadcast(q)).withColumn(
        col, F.when(F.col(col).isNotNull(), F.least(F.greatest(F.col(col), F.col("_lo")), F.col("_hi")))
    ).drop("_lo", "_hi")


def equal_width_buckets(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """``pd.cut(x, bins)`` labels: right-closed equal-width buckets over
    [min, max] (lowest edge lowered), returned as 0..bins-1, then fraud rate."""
    mm = df.agg(F.min(col).alias("_mn"), F.max(col).alias("_mx"))
    j = df.crossJoin(F.broadcast(mm))
    step = (F.col("_mx") - F.col("_mn")) / bins
    bucket = F.lit(0)
    for k in range(1, bins):
        bucket = bucket + (F.col(col) > F.col("_mn") + F.lit(k) * step).cast("int")
    return j.filter(F.col(col).isNotNull()).groupBy(bucket.alias("bucket")).agg(
        F.avg(F.col(T).cast("double")).alias("fraud_rate"), F.count(F.lit(1)).alias("n"))


def preview(df: DataFrame, n: int = 3, order: str = ROLES.id) -> DataFrame:
    """First rows by id."""
    return df.orderBy(order).limit(n)
