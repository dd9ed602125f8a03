"""V7: per-card velocity of a stream as keyed state with timers.

Cards are dealt by hash into ``BUCKETS`` keys, so that a batch costs a few calls
per bucket and not per card.  A bucket keeps the (time, id, card) rows of its
cards in a list state, one element per micro-batch, so a batch appends and does
not rewrite.  Rows are answered at once, in (time, id) order within their batch:
counts come from binary searches over the sorted rows, without a loop over rows
or cards.  Rows that lie more than the largest window before the watermark can
no longer be asked for and go when they are the larger part of the state; the
last one of a card stays for time since last.

* Rows behind the watermark are late: Spark drops them, and counts them in the
  query's progress.  Rows that are out of order but not late see the rows
  before them that have come so far.
* A card that is idle for ``idle_seconds`` of event time is forgotten by an
  event-time timer, which a bucket sets for the first of its cards; the card's
  next row counts as its first.
* Rows without a card get zeros and no state.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from riskloom.config import ROLES, TIME_WINDOWS

VELOCITY_OUT = T.StructType([
    T.StructField(ROLES.id, T.LongType()), T.StructField(ROLES.card, T.LongType()),
    T.StructField("time_since_last_tx", T.DoubleType()),
] + [T.StructField(f"card_tx_count_{label}", T.IntegerType()) for _, label in TIME_WINDOWS])
BLOCK = T.StructType([T.StructField(n, T.ArrayType(T.LongType())) for n in ("times", "ids", "cards")])
BUCKETS = 4096
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class CardVelocity(StatefulProcessor):
    def __init__(self, windows: Sequence[tuple[int, str]], idle_seconds: int, epoch: int):
        self.windows, self.idle, self.epoch = list(windows), idle_seconds, epoch

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.blocks = handle.getListState("rows", BLOCK)
        self.last = handle.getValueState("last", T.StructType([T.StructField("t", T.LongType())]))

    def _stored(self) -> list[tuple[np.ndarray, ...]]:
        return [tuple(np.array(x, np.int64) for x in b) for b in self.blocks.get()]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """``key`` is a bucket; rows that name no card are those of the card ``key``."""
        new = pd.concat(list(rows), ignore_index=True)
        t, i = new["t"].to_numpy(np.int64), new["i"].to_numpy(np.int64)
        c = new["card"].to_numpy(np.int64) if "card" in new.columns else np.full(len(t), int(key[0]), np.int64)
        times, ids, cards = (np.concatenate(x) for x in zip(*self._stored(), (t, i, c)))
        mine = np.arange(len(times)) >= len(times) - len(t)
        order = np.lexsort((ids, times, cards))
        times, ids, cards, mine = times[order], ids[order], cards[order], mine[order]
        first = np.concatenate([[True], cards[1:] != cards[:-1]])
        group, start = np.cumsum(first) - 1, np.flatnonzero(first)
        at, own, low = np.flatnonzero(mine), times[mine], times.min()
        out = {ROLES.id: ids[mine], ROLES.card: cards[mine],
               "time_since_last_tx": np.where(at > start[group[at]], own - times[np.maximum(at - 1, 0)], 0).astype(np.float64)}
        # one ascending number for (card, time)
        span = times.max() - low + 1
        place = group * span + (times - low)
        for w, label in self.windows:
            asked = group[at] * span + np.maximum(own - w - low, 0)
            out[f"card_tx_count_{label}"] = (at - np.searchsorted(place, asked, "left")).astype(np.int32)
        self._keep(times, ids, cards, np.concatenate([first[1:], [True]]), (t, i, c), timerValues)
        yield pd.DataFrame(out, columns=[f.name for f in VELOCITY_OUT.fields])

    def _keep(self, times, ids, cards, final, new, timerValues) -> None:
        """Sorted rows of the bucket; ``final``: the last row of its card."""
        watermark = timerValues.getCurrentWatermarkInMs() // 1000 - self.epoch
        passed = times <= watermark
        needed = (times >= watermark - max(w for w, _ in self.windows)) | (passed & (final | ~np.concatenate([passed[1:], [False]])))
        if 2 * needed.sum() < len(times):
            self.blocks.put([tuple(x[needed].tolist() for x in (times, ids, cards))])
        else:
            self.blocks.appendValue(tuple(x.tolist() for x in new))
        self._set_timer(int(times[final].min()))

    def _set_timer(self, last: int) -> None:
        """``last``: the oldest of the cards' last times."""
        if not self.last.exists() or self.last.get()[0] != last:
            self.last.update((last,))
            self.handle.registerTimer(self._expiry(last))

    def _expiry(self, t: int) -> int:
        return (t + self.epoch + self.idle) * 1000

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Cards whose idle time is over go.  A timer set before a card came
        again finds none and does nothing."""
        now = timerValues.getCurrentWatermarkInMs()
        if self.last.exists() and self._expiry(self.last.get()[0]) <= now:
            times, ids, cards = (np.concatenate(x) for x in zip(*self._stored()))
            order = np.argsort(times, kind="stable")
            last = dict(zip(cards[order].tolist(), times[order].tolist()))
            stay = {c: t for c, t in last.items() if self._expiry(t) > now}
            if stay:
                kept = np.isin(cards, np.array(list(stay), np.int64))
                self.blocks.put([tuple(x[kept].tolist() for x in (times, ids, cards))])
                self._set_timer(min(stay.values()))
            else:
                self.blocks.clear()
                self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def card_velocity_stream(stream: DataFrame, windows: Sequence[tuple[int, str]] = TIME_WINDOWS,
                         idle_seconds: int = 90 * 86400, watermark: str = "1 hour") -> DataFrame:
    """W1 / W2 of every row of a stream."""
    from riskloom.sources.tables import EPOCH_OFFSET
    from riskloom.streaming.stream import event_time
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    timed = stream.withColumn("event_time", event_time(stream)).withWatermark("event_time", watermark)
    keyed = timed.filter(F.col(ROLES.card).isNotNull()).select(
        F.col(ROLES.card).cast("long").alias("card"), F.col(ROLES.time).cast("long").alias("t"), F.col(ROLES.id).cast("long").alias("i"), "event_time")
    keyed = keyed.withColumn("bucket", F.pmod(F.xxhash64("card"), F.lit(BUCKETS)).cast("int"))
    out = keyed.groupBy("bucket").transformWithStateInPandas(
        CardVelocity(windows, idle_seconds, EPOCH_OFFSET), VELOCITY_OUT, "Append", "EventTime")
    without = stream.filter(F.col(ROLES.card).isNull()).select(
        *[F.col(f.name).cast(f.dataType) if f.name in (ROLES.id, ROLES.card) else F.lit(0).cast(f.dataType).alias(f.name)
          for f in VELOCITY_OUT.fields])
    return out.unionByName(without)
