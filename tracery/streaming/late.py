"""Late verdicts as state with time limits (J19, L6): verdict events of raters that answer over hours, on a stream and on a table.

A case's verdict by a rater is its first one; an error may still be patched by the first valid verdict that comes within `limit` of it.  On a stream the row is held as state until it is
certain: at once if it is valid, else when it is patched or its timer ends.  A rater's breaker is state of the rater alone: after so many failures in a row its further verdicts don't count for a while.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "case_id string, provider string, status string, patched boolean"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Patch(StatefulProcessor):
    """State of (case_id, provider): (the first verdict's time in ms, whether the row is out)."""

    def __init__(self, limit_ms: int):
        self.limit_ms = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "at long, out boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(rows).sort_values(["ts", "event_id"])
        held = self.first.get() if self.first.exists() else None
        for ts, status in zip(events["ts"], events["status"], strict=True):
            now = int(pd.Timestamp(ts).timestamp() * 1000)
            if held is None:
                held = (now, status != "error")
                if held[1]:
                    yield _row(key, status, False)
                else:
                    self.handle.registerTimer(now + self.limit_ms)
            elif not held[1] and status != "error" and now <= held[0] + self.limit_ms:
                held = (held[0], True)
                yield _row(key, status, True)
        if held is not None:
            self.first.update(held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.first.exists() and not self.first.get()[1]:
            self.first.update((self.first.get()[0], True))
            yield _row(key, "error", False)

    def close(self) -> None:
        pass


def _row(key, status: str, patched: bool) -> pd.DataFrame:
    return pd.DataFrame({"case_id": [key[0]], "provider": [key[1]], "status": [status], "patched": [patched]})


def patched_stream(events: DataFrame, limit_seconds: int = 3600, late: str = "10 minutes") -> DataFrame:
    """(case_id, provider, status, patched) of a stream of verdict events (case_id, provider, status, ts, event_id), each row once.  Needs the state store PROVIDER.  Events of a key that a batch brings
    together are taken in the order of ts and event_id; what is later than the watermark is dropped."""
    keyed = events.select("case_id", "provider", "status", "ts", "event_id").withWatermark("ts", late).groupBy("case_id", "provider")
    return keyed.transformWithStateInPandas(_Patch(limit_seconds * 1000), OUT, "append", "eventTime")


def patched_table(events: DataFrame, limit_seconds: int = 3600) -> DataFrame:
    """The same of a table."""
    own = Window.partitionBy("case_id", "provider")
    first = F.min(F.struct("ts", "event_id", "status")).over(own)
    e = events.withColumn("_first", first)
    fits = (F.col("status") != "error") & (F.unix_millis(F.col("ts").cast("timestamp")) <= F.unix_millis(F.col("_first.ts").cast("timestamp")) + limit_seconds * 1000)
    out = e.groupBy("case_id", "provider").agg(F.min("_first").alias("f"), F.min(F.when(fits, F.struct("ts", "event_id", "status"))).alias("v"))
    good = F.col("f.status") != "error"
    return out.select("case_id", "provider", F.when(good, F.col("f.status")).otherwise(F.coalesce("v.status", F.lit("error"))).alias("status"), (~good & F.col("v").isNotNull()).alias("patched"))


class _Breaker(StatefulProcessor):
    """State of a rater: (failures in a row, when it opened in ms, or -1)."""

    def __init__(self, most: int, ttl_ms: int):
        self.most, self.ttl_ms = most, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("breaker", "failures int, opened long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(rows).sort_values(["ts", "event_id"])
        failures, opened = self.state.get() if self.state.exists() else (0, -1)
        counts = []
        for ts, status in zip(events["ts"], events["status"], strict=True):
            now = int(pd.Timestamp(ts).timestamp() * 1000)
            if opened >= 0 and now - opened >= self.ttl_ms:
                failures, opened = 0, -1
            counts.append(opened < 0)
            if opened < 0:
                failures = failures + 1 if status == "error" else 0
                if failures >= self.most:
                    opened = now
        self.state.update((failures, opened))
        yield pd.DataFrame({"event_id": events["event_id"].to_numpy(), "provider": key[0], "counts": counts})

    def close(self) -> None:
        pass


def breaker_stream(events: DataFrame, most: int = 3, ttl_seconds: int = 300) -> DataFrame:
    """(event_id, provider, counts) of a stream of verdict events: whether the rater's breaker was closed when the verdict came.  It opens after `most` errors in a row and closes after `ttl_seconds`; all
    tasks share it, as it is state of the rater."""
    return events.select("provider", "status", "ts", "event_id").groupBy("provider").transformWithStateInPandas(_Breaker(most, ttl_seconds * 1000), "event_id long, provider string, counts boolean", "append", "none")
