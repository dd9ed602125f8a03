"""A keyed message log in shared files: batch writer and streaming source with
offsets (S13, S14, V5 where no broker is at hand).

Messages (key, value) are dealt to the log's partitions by the hash of their
key and numbered there, like a broker's.  An append writes its messages as
Parquet under ``append=<n>/partition=<p>`` and then one small manifest with the
range of offsets of each partition; only what a manifest names can be read, so
an append that failed half-way is never seen and a repeated one gets a number
of its own.

The source's offset is the next message of each partition.  Spark keeps it in
the checkpoint, plans each batch from one offset to the next, and asks again
for the same range after a restart, so every message is read once.  Ranges are
cut into tasks of ``TASK_MESSAGES``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from riskloom.operators.ordinal import ranks_within

SCHEMA = "key string, value string, partition int, offset long"
TASK_MESSAGES = 1_000_000


def _files(path: str):
    from pyarrow import fs
    if path.startswith("file:"):
        path = path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), "/" + path.lstrip("/"))


def manifests(path: str) -> list[dict]:
    """Committed appends in order: {"append": n, "ranges": {partition: [first, end]}}."""
    from pyarrow import fs
    store, root = _files(path)
    if store.get_file_info(f"{root}/_commits").type == fs.FileType.NotFound:
        return []
    names = sorted(f.path for f in store.get_file_info(fs.FileSelector(f"{root}/_commits")) if f.path.endswith(".json"))
    out = []
    for name in names:
        with store.open_input_file(name) as f:
            out.append(json.loads(f.read()))
    return out


def ends(commits: list[dict]) -> dict[str, int]:
    """Next offset of every partition."""
    out: dict[str, int] = {}
    for m in commits:
        out.update({p: r[1] for p, r in m["ranges"].items()})
    return out


def append_messages(messages: DataFrame, path: str, partitions: int = 8, order: str | None = None) -> None:
    """Number the messages (key, value) of each log partition, by
    ``order`` if given, behind those that are there, and commit them."""
    commits = manifests(path)
    first = ends(commits)
    store, root = _files(path)
    dealt = messages.withColumn("partition", F.pmod(F.xxhash64("key"), F.lit(partitions)).cast("int"))
    by = [order, "key", "value"] if order else ["key", "value"]
    dealt = dealt.select("key", "value", "partition", *([order] if order and order not in ("key", "value") else []))
    ranked = ranks_within(dealt, ["partition"], by, "offset")
    base = F.coalesce(*[F.when(F.col("partition") == int(p), F.lit(n)) for p, n in first.items()], F.lit(0)) if first else F.lit(0)
    name = f"append={len(commits):08d}-{uuid.uuid4().hex[:8]}"
    out = ranked.select("key", "value", "partition", (F.col("offset") + base).cast("long").alias("offset"))
    out.write.partitionBy("partition").parquet(f"{path}/{name}")
    spark = messages.sparkSession
    written = spark.read.schema(SCHEMA).parquet(f"{path}/{name}")
    ranges = {str(r["partition"]): [r["a"], r["b"] + 1] for r in
              written.groupBy("partition").agg(F.min("offset").alias("a"), F.max("offset").alias("b")).collect()}
    store.create_dir(f"{root}/_commits", recursive=True)
    with store.open_output_stream(f"{root}/_commits/{len(commits):08d}.json") as f:
        f.write(json.dumps({"append": name, "ranges": ranges}).encode())


class LogRange(InputPartition):
    """Messages [start, end) of one log partition, in some appends."""

    def __init__(self, partition: int, start: int, end: int, appends: list[str]):
        self.partition, self.start, self.end, self.appends = partition, start, end, appends


class LogStreamReader(DataSourceStreamReader):
    def __init__(self, path: str, limit: int | None, latest: bool):
        self.path, self.limit, self.latest = path, limit, latest
        self.seen: dict[str, int] | None = None

    def initialOffset(self) -> dict:
        return ends(manifests(self.path)) if self.latest else {}

    def latestOffset(self) -> dict:
        """All that is committed, or ``limit`` more messages of each partition."""
        there = ends(manifests(self.path))
        if self.limit:
            seen = self.seen or {}
            there = {p: min(n, seen.get(p, 0) + self.limit) for p, n in there.items()}
        return there

    def partitions(self, start: dict, end: dict) -> list[LogRange]:
        self.seen = end
        out = []
        for m in manifests(self.path):
            for p, (a, b) in m["ranges"].items():
                lo, hi = max(a, start.get(p, 0)), min(b, end.get(p, 0))
                out += [LogRange(int(p), k, min(k + TASK_MESSAGES, hi), [m["append"]]) for k in range(lo, hi, TASK_MESSAGES)]
        return out

    def read(self, part: LogRange) -> Iterator:
        import pyarrow as pa
        import pyarrow.dataset as ds
        store, root = _files(self.path)
        for name in part.appends:
            data = ds.dataset(f"{root}/{name}/partition={part.partition}", filesystem=store, format="parquet")
            here = (ds.field("offset") >= part.start) & (ds.field("offset") < part.end)
            for b in data.to_batches(columns=["key", "value", "offset"], filter=here):
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [b.column("key").cast(pa.string()), b.column("value").cast(pa.string()),
                         pa.array([part.partition] * b.num_rows, pa.int32()), b.column("offset")], ["key", "value", "partition", "offset"])

    def commit(self, end: dict) -> None:
        """Spark has written the offsets; the log keeps its messages."""


class MessageLog(DataSource):
    """``spark.readStream.format("message_log").option("path", ...)``; options
    maxMessagesPerPartition (default: no limit) and startingOffsets
    (earliest or latest)."""

    @classmethod
    def name(cls) -> str:
        return "message_log"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> LogStreamReader:
        limit = self.options.get("maxMessagesPerPartition")
        return LogStreamReader(self.options["path"], int(limit) if limit else None, self.options.get("startingOffsets") == "latest")


def read_log(spark: SparkSession, path: str, limit: int | None = None, starting: str = "earliest") -> DataFrame:
    """The log as a stream of key, value, partition, offset."""
    spark.dataSource.register(MessageLog)
    r = spark.readStream.format("message_log").option("path", path).option("startingOffsets", starting)
    return (r.option("maxMessagesPerPartition", limit) if limit else r).load()
