"""Per-key sliding-window admission.

A hit is admitted if fewer than ``limit`` admitted hits lie in the window before
it; rejected hits leave no trace.  So whether a hit counts depends on earlier
decisions, and a window count would be wrong.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings

DECISION = "key string, ts double, event_id long, allowed boolean, remaining int, retry_after double"


def client_key(forwarded: Column, host: Column, trusted: bool = Settings.trust_forwarded_for) -> Column:
    """The first forwarded address if it is trusted, else the host, else ``unknown``."""
    first = F.trim(F.split_part(forwarded, F.lit(","), F.lit(1)))
    return F.coalesce(*([F.when(first != "", first)] if trusted else []), F.when(host != "", host), F.lit("unknown"))


def retry_header(seconds: Column) -> Column:
    """Whole seconds, one at least."""
    return F.greatest(F.floor(seconds + 0.999), F.lit(1)).cast("long")


def admit(hits: list[float], ts: float, limit: int, window: float) -> tuple[list[float], bool, int, float]:
    """The hits that are kept, and the decision, the quota left and the seconds to wait."""
    hits = [h for h in hits if h > ts - window]
    if len(hits) >= limit:
        return hits, False, 0, max(hits[0] + window - ts, 0.0)
    return [*hits, ts], True, limit - len(hits) - 1, 0.0


def rate_limit(events: DataFrame, limit: int = Settings.rate_limit_requests, window: float = Settings.rate_limit_window_seconds) -> DataFrame:
    """Decisions for events (key, ts, event_id), by time within each key, events of one time by id.

    Keys are partitioned and sorted by Spark and streamed through in Arrow
    batches; the state is one key's admitted hits in the window, ``limit`` at
    most, so a key with a third of all events needs no more memory than another.
    Its events are one task's work all the same, as each decision hangs on the last.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, hits = None, []
        for batch in batches:
            out = []
            for k, ts, event in zip(batch["key"], batch["ts"], batch["event_id"]):
                if k != key:
                    key, hits = k, []
                hits, *decision = admit(hits, ts, limit, window)
                out.append((k, ts, event, *decision))
            yield pd.DataFrame(out, columns=["key", "ts", "event_id", "allowed", "remaining", "retry_after"])

    ordered = events.select(F.coalesce(F.col("key").cast("string"), F.lit("unknown")).alias("key"), F.col("ts").cast("double").alias("ts"), "event_id").filter("ts IS NOT NULL")
    return ordered.repartition("key").sortWithinPartitions("key", "ts", "event_id").mapInPandas(run, DECISION)


def limiter_summary(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("key").agg(F.count("*").alias("n_hits"), F.count_if("allowed").alias("n_allowed"), F.round(F.max("retry_after"), 3).alias("longest_wait"))
