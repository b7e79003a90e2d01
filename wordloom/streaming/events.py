"""Structured Streaming forms of the append-only logs (STR-*), and event-time windows as a labelled extra (STR-5)."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique_requests(requests: DataFrame, delay: str = "30 minutes") -> DataFrame:
    """Each request hash once within the watermark (STR-3)."""
    return requests.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["request_hash"])


def undo_stream(events: DataFrame) -> DataFrame:
    """key, live: how many decisions of a store stand after each batch of events(key, seq, operation) (STR-1)."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        live = list(state.get[0]) if state.exists else []
        for op, seq in sorted(((f.seq, f.operation) for frame in frames for f in frame.itertuples()), key=lambda x: x[0]):
            if seq == "undo":
                live = live[:-1]
            else:
                live.append(int(op))
        state.update((live,))
        yield pd.DataFrame({"key": [key[0]], "live": [len(live)]})

    return events.groupBy("key").applyInPandasWithState(fold, "key string, live long", "live array<long>", "update", "NoTimeout")


def leases(claims: DataFrame, now, minutes: int = 30) -> DataFrame:
    """batch_id, holder of claims(batch_id, claim_token, claimed_at) that still hold at now (STR-2, AUD-5)."""
    live = claims.filter(F.col("claimed_at") + F.make_interval(mins=F.lit(minutes)) > F.lit(now))
    return live.groupBy("batch_id").agg(F.max_by("claim_token", F.struct("claimed_at", "claim_token")).alias("holder"))


def pending_rows(source: DataFrame, done: DataFrame, key: str, most: int = 500) -> DataFrame:
    """The next batch of rows not yet done, in key order (STR-4, FOR-15); most is the batch size."""
    return source.join(done.filter("status = 'done'").select(key), key, "left_anti").orderBy(key).limit(most)


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by tumbling window and type; works on a batch or a stream."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type")
    return rows.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
