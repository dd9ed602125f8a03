"""Distinct counts that merge over days (A5-A8 as a maintained state).

``daily_states`` keeps one HyperLogLog sketch, row count and label sum per
(entity, day): a new day is appended without reading the days before it, and
``over_days`` merges any range of days.  A sketch holds 2^lg_k registers
whatever the number of members; ``error_bound`` is three standard errors of a
merged sketch.  Rows with a null entity or day are left out, null members are not
counted; a range without rows gives no row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K = 14


def error_bound(lg_k: int = LG_K) -> float:
    """Relative error that three standard errors of a merged sketch allow."""
    return 3 * 1.04 / math.sqrt(2 ** lg_k)


def daily_states(df: DataFrame, entity: str, member: str, day: Column, label: str | None = None,
                 lg_k: int = LG_K) -> DataFrame:
    """(entity, day) -> members (sketch), n_rows, n_labels.  Sketches of a
    task's rows are merged before the shuffle, so a hot entity sends one state
    per task and day."""
    y = F.sum(F.col(label).cast("bigint")) if label else F.lit(0).cast("bigint")
    d = df.withColumn("day", day).where(F.col(entity).isNotNull() & F.col("day").isNotNull())
    return d.groupBy(F.col(entity).alias("entity"), "day").agg(
        F.hll_sketch_agg(member, F.lit(lg_k)).alias("members"), F.count(member).alias("n_rows"),
        F.coalesce(y, F.lit(0)).cast("bigint").alias("n_labels"))


def over_days(states: DataFrame, span: Column | None = None) -> DataFrame:
    """Per entity (and span, a column of ``day``, such as its week):
    distinct members (estimate), rows and label sum of all days of the range.
    Choose a range by filtering ``states`` on day first."""
    keys = [F.col("entity")] + ([span.alias("span")] if span is not None else [])
    return states.groupBy(*keys).agg(
        F.hll_sketch_estimate(F.hll_union_agg("members")).alias("n_members"),
        F.sum("n_rows").cast("bigint").alias("n_rows"), F.sum("n_labels").cast("bigint").alias("n_labels"))
