"""Calls of a key paired with their returns, from events in order of time: as a stream with state and timers, and as a table.

A start opens a call; the next event that ends one closes it. A call that is not closed within the time allowed, or before the
next start, is lost; the next start is then another attempt, and a return begins anew at attempt 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds for which a call may be open.
LIMIT = 6 * 3600
PAIRS = "key string, started timestamp, ended timestamp, elapsed_seconds double, outcome string, attempt bigint"
_ZERO = datetime(1970, 1, 1)


def marked(events: DataFrame, key: Column, time: Column, order: Column, start: Column, end: Column, failed: Column) -> DataFrame:
    """Events as (key, time, order, kind): kind is start, returned or error; others are left out."""
    kind = F.when(start, "start").when(failed, "error").when(end, "returned")
    return events.select(key.cast("string").alias("key"), time.cast("timestamp").alias("time"), order.cast("bigint").alias("order"), kind.alias("kind")).where("kind is not null and key is not null and time is not null")


def paired(rows: DataFrame, limit: float = LIMIT) -> DataFrame:
    """All calls of a table of marked() events."""
    of = Window.partitionBy("key").orderBy("time", "order")
    after = F.lead(F.struct("kind", "time")).over(of)
    each = rows.withColumn("_next", after).where("kind = 'start'")
    apart = (F.unix_micros("_next.time") - F.unix_micros("time")) / 1e6
    closed = F.col("_next").isNotNull() & (F.col("_next.kind") != "start") & (apart <= limit)
    out = each.withColumn("outcome", F.when(closed, F.col("_next.kind")).otherwise("lost")).withColumn("_apart", apart)
    # Attempts count from the call after the last one that returned.
    done = F.coalesce(F.sum(F.when(F.col("outcome") == "returned", 1).otherwise(0)).over(of.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    attempt = F.row_number().over(Window.partitionBy("key", "_done").orderBy("time", "order"))
    ended = F.when(F.col("outcome") != "lost", F.col("_next.time"))
    return out.withColumn("_done", done).select("key", F.col("time").alias("started"), ended.alias("ended"), F.when(ended.isNotNull(), F.col("_apart")).alias("elapsed_seconds"), "outcome", attempt.cast("bigint").alias("attempt"))


def _micros(t: pd.Timestamp | datetime) -> int:
    t = t.to_pydatetime() if isinstance(t, pd.Timestamp) else t
    return round((t.replace(tzinfo=None) - _ZERO) / timedelta(microseconds=1))


def _time(micros: int) -> datetime:
    return (_ZERO + timedelta(microseconds=micros)).replace(tzinfo=timezone.utc)


class Pairs(StatefulProcessor):
    """One key's events: those that have come and are not past the watermark wait in order; the open call and its attempt are state."""

    def __init__(self, limit: float):
        self.limit = round(limit * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "started bigint, attempt bigint")
        self.waiting = handle.getMapState("waiting", "time bigint, order bigint", "kind string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for time, order, kind in zip(part["time"], part["order"], part["kind"]):
                at = _micros(time)
                self.waiting.updateValue((at, int(order)), (kind,))
                # An event's turn comes once nothing before it can come any more.
                self.handle.registerTimer(at // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs() * 1000
        out: list[tuple] = []
        state = self.open.get() if self.open.exists() else None
        started, attempt = (state[0], state[1]) if state else (None, 1)
        due = sorted(tuple(k) for k in self.waiting.keys() if k[0] < until)
        kinds = [self.waiting.getValue(k)[0] for k in due]
        for (at, order), kind in zip(due, kinds):
            self.waiting.removeKey((at, order))
            if started is not None and (kind == "start" or at - started > self.limit):
                out.append((started, None, "lost", attempt))
                started, attempt = None, attempt + 1
            if kind == "start":
                started = at
                self.handle.registerTimer((at + self.limit) // 1000 + 1)
            elif started is not None:
                out.append((started, at, kind, attempt))
                started, attempt = None, 1 if kind == "returned" else attempt + 1
        if started is not None and until > started + self.limit:
            out.append((started, None, "lost", attempt))
            started, attempt = None, attempt + 1
        self.open.update((started, attempt))
        if out:
            columns = ["key", "started", "ended", "elapsed_seconds", "outcome", "attempt"]
            yield pd.DataFrame([(key[0], _time(s), None if e is None else _time(e), None if e is None else (e - s) / 1e6, kind, n) for s, e, kind, n in out], columns=columns)

    def close(self) -> None:
        pass


def paired_stream(rows: DataFrame, limit: float = LIMIT, late: str = "1 hour") -> DataFrame:
    """The same calls from a stream of marked() events that come at most `late` behind the newest; later ones are left out.

    A call comes out once the watermark has passed its end, or the time allowed for it. State is kept by RocksDB, so set
    spark.sql.streaming.stateStore.providerClass to Spark's RocksDB provider.
    """
    known = rows.withWatermark("time", late)
    return known.groupBy("key").transformWithStateInPandas(statefulProcessor=Pairs(limit), outputStructType=PAIRS, outputMode="append", timeMode="eventTime")
