"""Running statistics of a scoring stream: event-time windows (V4, V6) and the
consumer's counters (V2, A30).

* Windows are aggregated with a watermark in update mode: a batch emits the
  windows it changed, written under ``batch_id=<n>`` with overwrite, so a
  replayed batch replaces itself; the newest version of a window is its value.
  State holds the windows that the watermark has not closed.
* Counters are observed metrics of the running query: they cost no pass of
  their own, and a listener adds them up by batch, so a repeated batch counts
  once.
"""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

from riskloom.operators.monitor import event_time_windows, is_high_risk

METRICS = "consumer"


def window_updates(scored: DataFrame, time: Column, duration: str, slide: str | None = None, watermark: str = "1 hour") -> DataFrame:
    """V4 (tumbling) / V6 (sliding): counts and rates of the windows of a
    stream; rows behind the watermark are dropped and counted by Spark."""
    timed = scored.withColumn("event_time", time).withWatermark("event_time", watermark)
    return event_time_windows(timed, F.col("event_time"), duration, slide)


def start_updates(updates: DataFrame, path: str, checkpoint: str):
    """Write the changed windows of each batch to a folder of its own."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (updates.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def latest_windows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The newest version of every window."""
    keys = ["window_start", "window_end"]
    rest = [c for c in schema.names if c not in keys]
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])).parquet(path)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("v")).select(*keys, "v.*")


def observed(scored: DataFrame, error: Column, ts: str = "ts") -> DataFrame:
    """The stream with the consumer's counters as observed metrics."""
    return scored.observe(METRICS, F.count(F.lit(1)).alias("processed"), F.count_if(is_high_risk(F.col("risk_level"))).alias("high_risk"),
                          F.count_if(error).alias("errors"), F.min(ts).alias("first"), F.max(ts).alias("last"))


class ConsumerListener(StreamingQueryListener):
    """Adds up the counters of one query, over its restarts."""

    def __init__(self, query_id: str | None = None):
        self.query_id = query_id
        self.batches: dict[tuple[str, int], dict] = {}
        self.dropped: dict[tuple[str, int], int] = {}
        self.ended: dict[str, threading.Event] = {}

    def _end(self, run_id: str) -> threading.Event:
        return self.ended.setdefault(run_id, threading.Event())

    def onQueryStarted(self, event) -> None:
        self._end(str(event.runId))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if self.query_id in (None, str(p.id)):
            row = (p.observedMetrics or {}).get(METRICS)
            at = (str(p.id), p.batchId)
            if row is not None:
                self.batches[at] = row.asDict()
            self.dropped[at] = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)

    def onQueryIdle(self, event) -> None:
        """Nothing to count."""

    def onQueryTerminated(self, event) -> None:
        self._end(str(event.runId)).set()

    def wait(self, run_id: str, seconds: float = 60.0) -> None:
        """Until all events of a finished run have come."""
        if not self._end(run_id).wait(seconds):
            raise TimeoutError(f"the listener has not heard of the end of run {run_id}")

    def totals(self) -> dict:
        """processed, high_risk, errors, late rows, rows a second of event time."""
        rows = list(self.batches.values())
        out = {c: sum(r[c] for r in rows) for c in ("processed", "high_risk", "errors")}
        first = min((r["first"] for r in rows if r["first"] is not None), default=0)
        last = max((r["last"] for r in rows if r["last"] is not None), default=0)
        return out | {"late": sum(self.dropped.values()), "tps": out["processed"] / max(last - first, 1.0)}


def totals_frame(spark: SparkSession, listener: ConsumerListener) -> DataFrame:
    t = listener.totals()
    return spark.createDataFrame([(t["processed"], t["high_risk"], t["errors"], float(t["tps"]))],
                                 "processed long, high_risk long, errors long, tps double")
