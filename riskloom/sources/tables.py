"""Driver tables and the canonical transaction model derived from them.

The canonical mapping from ``events`` to transaction / identity columns is a
fixed contract (same rule in the Spark plan and in the DuckDB oracle):

  TransactionID  = event_id
  TransactionDT  = whole epoch seconds of ts - 1704067200 + 86400
  TransactionAmt = value
  ProductCD      = event_type
  card1          = user_id
  k              = first integer in props
  addr1          = null when k % 10 = 9, else 100 + k % 40 (double)
  P_emaildomain  = k % 4: 0 gmail.com, 1 yahoo.com, 2 hotmail.com, 3 null
  isFraud        = 1 when (event_type = 'error' and value >= 60) or k = 13
  identity rows  = events with event_id % 4 = 0
  DeviceType     = event_id % 3: 0 desktop, 1 mobile, 2 null
  DeviceInfo     = null when k % 20 = 19, else 'Device_' || (1 + k % 20)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values of the canonical mapping
EPOCH_OFFSET = 1704067200 - 86400
EMAIL_DOMAINS = ("gmail.com", "yahoo.com", "hotmail.com")
DEVICE_TYPES = ("desktop", "mobile")

TX_SCHEMA = T.StructType([
    T.StructField("TransactionID", T.LongType()),
    T.StructField("TransactionDT", T.LongType()),
    T.StructField("TransactionAmt", T.DoubleType()),
    T.StructField("ProductCD", T.StringType()),
    T.StructField("card1", T.LongType()),
    T.StructField("addr1", T.DoubleType()),
    T.StructField("P_emaildomain", T.StringType()),
    T.StructField("isFraud", T.IntegerType()),
])

ID_SCHEMA = T.StructType([
    T.StructField("TransactionID", T.LongType()),
    T.StructField("DeviceType", T.StringType()),
    T.StructField("DeviceInfo", T.StringType()),
])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _epoch_seconds(df: DataFrame, col: str) -> Column:
    """Whole epoch seconds, independent of the session time zone for
    zone-less timestamps."""
    dtype = df.schema[col].dataType
    if isinstance(dtype, T.TimestampNTZType):
        return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {col})")
    return F.unix_seconds(F.col(col).cast("timestamp"))


def _k() -> Column:
    return F.regexp_extract("props", r"([0-9]+)", 1).try_cast("int")


def events_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    k = _k()
    email = (F.when(k % 4 == 0, F.lit(EMAIL_DOMAINS[0]))
             .when(k % 4 == 1, F.lit(EMAIL_DOMAINS[1]))
             .when(k % 4 == 2, F.lit(EMAIL_DOMAINS[2])))
    fraud = F.when(((F.col("event_type") == "error") & (F.col("value") >= 60)) | (k == 13), 1).otherwise(0)
    return ev.select(
        F.col("event_id").cast("bigint").alias("TransactionID"),
        (_epoch_seconds(ev, "ts") - F.lit(EPOCH_OFFSET)).cast("bigint").alias("TransactionDT"),
        F.nanvl(F.col("value"), F.lit(None).cast("double")).alias("TransactionAmt"),
        F.col("event_type").alias("ProductCD"),
        F.col("user_id").cast("bigint").alias("card1"),
        F.when(k % 10 == 9, F.lit(None)).otherwise((100 + k % 40).cast("double")).alias("addr1"),
        email.alias("P_emaildomain"),
        fraud.cast("int").alias("isFraud"),
    )


def events_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events").filter(F.col("event_id") % 4 == 0)
    k = _k()
    dtype = (F.when(F.col("event_id") % 3 == 0, F.lit(DEVICE_TYPES[0]))
             .when(F.col("event_id") % 3 == 1, F.lit(DEVICE_TYPES[1])))
    dinfo = F.when(k % 20 == 19, F.lit(None)).otherwise(F.concat(F.lit("Device_"), (1 + k % 20).cast("string")))
    return ev.select(
        F.col("event_id").cast("bigint").alias("TransactionID"),
        dtype.alias("DeviceType"),
        dinfo.alias("DeviceInfo"),
    )


def merged_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions LEFT JOIN identity on TransactionID."""
    from riskloom.operators.merge import merge_identity
    return merge_identity(events_transactions(spark, sf_dir), events_identity(spark, sf_dir))


def card_device_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large bipartite graph input: card = o_custkey, device = l_suppkey."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    return o.join(li, o.o_orderkey == li.l_orderkey).select(
        F.col("o_custkey").alias("card1"), F.col("l_suppkey").cast("string").alias("DeviceInfo"))
