"""Structured Streaming: transaction source, codec, scoring with alert
sinks, windowed statistics and keyed per-card velocity state (V1-V7,
S13-S18).

* Source (S13): Kafka when its connector is on the classpath, else a JSON
  file directory read with ``maxFilesPerTrigger`` (the tested stand-in).
* Scoring (V1, V3, V5): ``foreachBatch`` runs the batch scoring plan on each
  micro-batch (joins with stored statistics are static-stream safe there),
  writes HIGH / CRITICAL alerts, the alert log and the quarantine under
  ``batch_id=<n>`` with overwrite, so a replayed batch replaces itself.
* Windowed stats (V4, V6): event-time tumbling / sliding windows with a
  watermark.
* Velocity state (V7): velocity_state.py.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.config import ROLES
from riskloom.operators import monitor
from riskloom.sources.tables import EPOCH_OFFSET, ID_SCHEMA, TX_SCHEMA

MESSAGE_SCHEMA = T.StructType(TX_SCHEMA.fields + [f for f in ID_SCHEMA.fields if f.name != "TransactionID"]
                              + [T.StructField("_produced_at", T.DoubleType()),
                                 T.StructField("_corrupt_record", T.StringType())])


# ---------------------------------------------------------------- codec
def encode_messages(df: DataFrame, key: str = ROLES.id) -> DataFrame:
    """key = id text, value = JSON of the row with NaN -> null and
    ``_produced_at`` stamped (nulls written as JSON null)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.nanvl(c, F.lit(None).cast(f.dataType))
        cols.append(c.alias(f.name))
    stamped = df.select(*cols, (F.unix_micros(F.current_timestamp()) / 1e6).alias("_produced_at"))
    return stamped.select(F.col(key).cast("string").alias("key"),
                          F.to_json(F.struct(*[F.col(c) for c in stamped.columns]),
                                    {"ignoreNullFields": "false"}).alias("value"))


def decode_messages(df: DataFrame, value: str = "value") -> DataFrame:
    """JSON text -> typed columns; unparsable text kept in ``_corrupt_record``."""
    parsed = F.from_json(F.col(value).cast("string"), MESSAGE_SCHEMA,
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return df.select(parsed.alias("m")).select("m.*")


# ---------------------------------------------------------------- sources / sinks
def transaction_stream(spark: SparkSession, path: str | None = None, kafka_servers: str | None = None,
                       topic: str = "fraud-transactions", max_per_trigger: int | None = None, log: str | None = None) -> DataFrame:
    """Streaming transactions (decoded).  Kafka: ``startingOffsets``
    latest, ``max_per_trigger`` as ``maxOffsetsPerTrigger``; None: no
    limit.  ``log``: a message log with offsets (sources/message_log.py).
    File stand-in: JSON lines, ``max_per_trigger`` files (None: one)."""
    if log:
        from riskloom.sources.message_log import read_log
        return decode_messages(read_log(spark, log, max_per_trigger))
    if kafka_servers:
        raw = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", kafka_servers)
               .option("subscribe", topic).option("startingOffsets", "latest"))
        if max_per_trigger:
            raw = raw.option("maxOffsetsPerTrigger", max_per_trigger)
        return decode_messages(raw.load())
    files = spark.readStream.schema(MESSAGE_SCHEMA).option("columnNameOfCorruptRecord", "_corrupt_record")
    return files.option("maxFilesPerTrigger", max_per_trigger or 1).json(path)


def write_messages(df: DataFrame, path: str | None = None, kafka_servers: str | None = None,
                   topic: str = "fraud-transactions") -> None:
    """Keyed JSON messages to Kafka, or JSON files as the stand-in."""
    msgs = encode_messages(df)
    if kafka_servers:
        msgs.write.format("kafka").option("kafka.bootstrap.servers", kafka_servers).option("topic", topic).save()
    else:
        msgs.select(F.from_json("value", MESSAGE_SCHEMA).alias("m")).select("m.*").drop("_corrupt_record") \
            .write.mode("append").json(path)


def write_time_ordered_files(df: DataFrame, path: str, n_files: int, time_col: str = ROLES.time) -> None:
    """Producer stand-in: the canonical rows as ``n_files`` JSON files in
    event-time order (one append per time slice, cut on day boundaries so
    equal times never straddle two files)."""
    bounds = df.agg(F.min(time_col), F.max(time_col)).first()
    lo, hi = int(bounds[0]), int(bounds[1]) + 1
    day = 86400
    edges = sorted({lo + (hi - lo) * i // n_files // day * day for i in range(n_files)} | {hi})
    for a, b in zip(edges[:-1], edges[1:]):
        part = df.filter((F.col(time_col) >= a) & (F.col(time_col) < b))
        write_messages(part.coalesce(1), path)


def alert_writer(out_dir: str, art, high_levels: Sequence[str] = monitor.HIGH, kafka_servers: str | None = None,
                 alert_topic: str = "fraud-alerts"):
    """V1 / V2 / V3: foreachBatch function: validate, score once, write the
    scored rows, and from them the alert messages (S15), the alert log (S16)
    and the quarantine, each under ``batch_id=<n>`` with overwrite
    (replay-safe).  With ``kafka_servers`` the alerts go to a topic instead,
    keyed by transaction, where a replayed batch may repeat them."""
    from riskloom.functions.risk import alert_message
    from riskloom.plans.train import score

    def run(batch: DataFrame, batch_id: int) -> None:
        good = batch.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record", "_produced_at")
        valid, bad = monitor.validate_requests(good)
        corrupt = batch.filter(F.col("_corrupt_record").isNotNull()).select(
            "_corrupt_record", F.lit("unparsable message").alias("quarantine_reason"))
        bad.select(F.to_json(F.struct("*")).alias("_corrupt_record"), "quarantine_reason").unionByName(corrupt) \
            .write.mode("overwrite").json(f"{out_dir}/quarantine/batch_id={batch_id}")
        score(valid, art).write.mode("overwrite").parquet(f"{out_dir}/scored/batch_id={batch_id}")
        scored = batch.sparkSession.read.parquet(f"{out_dir}/scored/batch_id={batch_id}")
        alerts = scored.filter(F.col("prediction.risk_level").isin(*high_levels))
        messages = alerts.select(F.col("prediction.transaction_id").cast("string").alias("key"),
                                 F.to_json(alert_message(F.col("prediction"), F.col("TransactionAmt"))).alias("value"))
        if kafka_servers:
            messages.write.format("kafka").option("kafka.bootstrap.servers", kafka_servers).option("topic", alert_topic).save()
        else:
            messages.select("value").write.mode("overwrite").text(f"{out_dir}/alerts/batch_id={batch_id}")
        alerts.select("prediction.*", F.struct("ts", "TransactionAmt", "device").alias("original_tx")) \
            .write.mode("overwrite").json(f"{out_dir}/alert_log/batch_id={batch_id}")
    return run


def start_scoring(stream: DataFrame, art, out_dir: str, checkpoint: str, available_now: bool = True, **alerts):
    """V1 + V5: offsets / files are committed through the checkpoint after
    each batch's sinks are written (at-least-once sinks made idempotent)."""
    w = stream.writeStream.foreachBatch(alert_writer(out_dir, art, **alerts)).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")).start()


# ---------------------------------------------------------------- windowed stats (V4, V6)
def event_time(df: DataFrame, time_col: str = ROLES.time) -> Column:
    return F.timestamp_seconds(F.col(time_col) + F.lit(EPOCH_OFFSET))


def windowed_counts(stream: DataFrame, duration: str = "10 seconds", slide: str | None = None,
                    watermark: str = "1 hour") -> DataFrame:
    """V4 (tumbling) / V6 (sliding 60 s every 10 s): processed and fraud
    counts per event-time window, late rows dropped after the watermark."""
    s = stream.withColumn("event_time", event_time(stream)).withWatermark("event_time", watermark)
    w = F.window("event_time", duration, slide) if slide else F.window("event_time", duration)
    return s.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("processed"),
                                       F.sum(F.col(ROLES.target)).alias("frauds")) \
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "processed", "frauds",
                (F.col("frauds") / F.col("processed")).alias("fraud_rate"))
