"""Helpers shared by the registered query plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.time import add_time_features
from riskloom.sources.tables import merged_transactions


def round6(c):
    """Round to 6 decimals after a 1e-11 relative nudge away from zero, so
    values sitting exactly on a decimal tie round the same way whatever the
    last-bit noise of the summation order (same rule in the oracle SQL)."""
    return F.round(c.cast("double") * F.lit(1.0 + 1e-11), 6)


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every DOUBLE / FLOAT column (output formatting for comparisons)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(round6(F.col(f"`{f.name}`")).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def timed_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical merged transactions with F1-F4 time features."""
    return add_time_features(merged_transactions(spark, sf_dir))
