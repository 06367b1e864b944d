"""The limiter as a stateful stream, and resumable batches.

Late rows are a Spark-side addition: with a watermark, keys that were idle for a
window of event time are evicted by timeout; without one, a key's state stays, of
``limit`` numbers at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..config import Settings
from ..operators.limiter import DECISION, admit
from ..sources.tables import CommittedLines

#: Keys that the table of ``rate_limit_evicting`` holds, idle ones included, and the buckets that share it.
MOST_KEYS = 10_000
BUCKETS = 64


def rate_limit_stream(events: DataFrame, limit: int = Settings.rate_limit_requests, window: float = Settings.rate_limit_window_seconds, watermark: str | None = None) -> DataFrame:
    """Decisions for a stream of (key, ts double, event_id); rows of a batch are taken by time within the key.

    A key's state is its admitted hits of one window: ``limit`` numbers at most.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        hits = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for ts, event in zip(rows["ts"], rows["event_id"]):
            hits, *decision = admit(hits, ts, limit, window)
            out.append((key[0], ts, event, *decision))
        state.update((hits,))
        if watermark:
            state.setTimeoutTimestamp(max(int((rows["ts"].max() + window) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "ts", "event_id", "allowed", "remaining", "retry_after"])

    keyed = events.select(F.coalesce(F.col("key").cast("string"), F.lit("unknown")).alias("key"), F.col("ts").cast("double").alias("ts"), "event_id")
    if watermark:
        keyed = keyed.withColumn("_time", F.timestamp_micros((F.col("ts") * 1_000_000).cast("long"))).withWatermark("_time", watermark)
    timeout = GroupStateTimeout.EventTimeTimeout if watermark else GroupStateTimeout.NoTimeout
    return keyed.groupBy("key").applyInPandasWithState(run, DECISION, "hits array<double>", "append", timeout)


class _KeyTable(StatefulProcessor):
    """The admitted hits of the keys of one bucket; idle keys go when the table is full and, with a watermark, by timers."""

    def __init__(self, limit: int, window: float, most: int, timed: bool) -> None:
        self.limit, self.window, self.most, self.timed = limit, window, most, timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hits = handle.getMapState("hits", "key string", "at array<double>")
        self.size = handle.getValueState("size", "n long, newest double")

    def _sweep(self, now: float, n: int) -> int:
        """Drop the keys without a hit in the window before ``now``: the only ones whose state says nothing."""
        idle = [k[0] for k, v in self.hits.iterator() if not v[0] or max(v[0]) <= now - self.window]
        for key in idle:
            self.hits.removeKey((key,))
        return n - len(idle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, newest = self.size.get() if self.size.exists() else (0, float("-inf"))
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        out = []
        for name, group in batch.groupby("key", sort=False):
            known = self.hits.containsKey((name,))
            hits, n = list(self.hits.getValue((name,))[0]) if known else [], n + (not known)
            for ts, event in zip(group["ts"], group["event_id"]):
                hits, *decision = admit(hits, ts, self.limit, self.window)
                out.append((name, ts, event, *decision))
            self.hits.updateValue((name,), (hits,))
        newest = max(newest, float(batch["ts"].max()))
        if n > self.most:
            n = self._sweep(newest, n)
        self.size.update((n, newest))
        if self.timed:
            self.handle.registerTimer(max(int((newest + self.window) * 1000) + 1, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame(out, columns=["key", "ts", "event_id", "allowed", "remaining", "retry_after"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The watermark is a window past the newest hit of then: what is idle by it stays idle."""
        n, newest = self.size.get()
        self.size.update((self._sweep(timerValues.getCurrentWatermarkInMs() / 1000, n), newest))
        yield from ()


def rate_limit_evicting(events: DataFrame, limit: int = Settings.rate_limit_requests, window: float = Settings.rate_limit_window_seconds, most_keys: int = MOST_KEYS, buckets: int = BUCKETS, watermark: str | None = None) -> DataFrame:
    """As ``rate_limit_stream``, with a bounded table of keys for any number of clients.

    Keys are dealt into ``buckets``, each of which keeps ``most_keys / buckets``.  A bucket
    that has more drops its idle keys, those without a hit in the window, whose next hit
    finds an empty window with their state or without: no decision changes.  Live keys
    stay, however many.  A micro-batch should hold the hits of a moment, as it is taken
    by time within each key.  With a ``watermark``, a timer drops a bucket's idle keys a
    window after its newest hit, full or not, and later rows are left out.  There is no
    time to live by the clock: a stream that is behind would lose live keys to it.
    Needs the RocksDB state store.
    """
    keyed = events.select(F.coalesce(F.col("key").cast("string"), F.lit("unknown")).alias("key"), F.col("ts").cast("double").alias("ts"), "event_id").filter("ts IS NOT NULL")
    keyed = keyed.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    if watermark:
        keyed = keyed.withColumn("_time", F.timestamp_micros((F.col("ts") * 1_000_000).cast("long"))).withWatermark("_time", watermark)
    table = _KeyTable(limit, window, max(1, most_keys // buckets), watermark is not None)
    return keyed.groupBy("bucket").transformWithStateInPandas(table, DECISION, "Append", "EventTime" if watermark else "None")


def resumable(jobs: DataFrame, work: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str):
    """Run ``work`` on each micro-batch and append its lines; a restart goes on after the last commit.

    A micro-batch that was written and not committed, or committed and not noted in the
    stream's checkpoint, is run again under its own number: its lines count once.
    ``CommittedLines`` reads them.
    """
    lines = CommittedLines(sink)
    return jobs.writeStream.foreachBatch(lambda batch, n: lines.append(work(batch), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
