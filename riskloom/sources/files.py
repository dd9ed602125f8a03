"""File sources and sinks (S1-S5): CSV with explicit schemas, bounded scan,
Parquet read / partitioned write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.config import ROLES


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Header CSV with a declared schema (no inference pass);
    malformed rows are kept with nulls (PERMISSIVE)."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def bounded_scan(df: DataFrame, n: int, order: str = ROLES.id) -> DataFrame:
    """S3: the first n rows by id (deterministic; the limit is the feature)."""
    return df.orderBy(order).limit(n)


def read_processed(spark: SparkSession, path: str, columns: list[str] | None = None,
                   weeks: list[int] | None = None) -> DataFrame:
    """Processed Parquet; the projection and the week filter reach the
    scan (column pruning, partition pruning on ``tx_week``)."""
    df = spark.read.parquet(path)
    if weeks is not None:
        df = df.filter(F.col("tx_week").isin(weeks))
    return df.select(*columns) if columns else df


def write_processed(df: DataFrame, path: str) -> None:
    """Parquet partitioned by week."""
    df.write.mode("overwrite").partitionBy("tx_week").parquet(path)
