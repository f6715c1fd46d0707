"""Streams with state of their own: open streaks by backend, content dedup that keeps the last, open sessions, late rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from txcompact.streaming.usage import timed

#: The state store that arbitrary state and timers need.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Breaker(StatefulProcessor):
    """For each backend a run of failures: ``open`` when it reaches ``min_run``, ``half_open`` once ``cool_ms`` of event time have
    gone by since its last failure, ``closed`` with the next success. A call takes the state before it into account, so what the
    events of one micro-batch say is the same as over several, as long as each brings later events than the one before."""

    def __init__(self, min_run: int, cool_ms: int):
        self.min_run, self.cool_ms = min_run, cool_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.streak = handle.getValueState("streak", "failures int, last_ms long, status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        failures, last, status = self.streak.get() if self.streak.exists() else (0, None, "closed")
        calls = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")
        out = []
        for ms, ok in zip(calls["ms"].tolist(), calls["ok"].tolist()):
            if status == "open" and ms - last >= self.cool_ms:
                status = "half_open"
                out.append((key[0], last + self.cool_ms, status, failures))
            if ok:
                if status != "closed":
                    out.append((key[0], ms, "closed", failures))
                failures, status = 0, "closed"
            else:
                failures, last = failures + 1, ms
                if failures >= self.min_run and status != "open":
                    status = "open"
                    out.append((key[0], ms, status, failures))
        self.streak.update((failures, last, status))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if status == "open":
            self.handle.registerTimer(last + self.cool_ms)
        yield self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The cool-down is over and no call came meanwhile."""
        failures, last, status = self.streak.get()
        if status == "open" and expiredTimerInfo.getExpiryTimeInMs() == last + self.cool_ms:
            self.streak.update((failures, last, "half_open"))
            yield self._rows([(key[0], last + self.cool_ms, "half_open", failures)])

    @staticmethod
    def _rows(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["backend", "ms", "status", "failures"]).astype({"ms": "int64", "failures": "int32"})

    def close(self) -> None:
        pass


def breaker_changes(calls: DataFrame, min_run: int = 3, cool_seconds: int = 60, late: str = "0 seconds") -> DataFrame:
    """``backend, ts, status, failures`` whenever a backend's breaker changes, of a stream of calls (``backend, ts, event_id, ok``).

    The session must use the RocksDB state store (``ROCKSDB``). A backend's calls of a batch meet in one task, in order; state
    is three values a backend. Times are rounded to milliseconds, halves away from 1970; half a millisecond is added before the watermark
    is taken, which Spark cuts off, so that timers go by the same times and no call of a later batch falls behind it."""
    half = F.when(F.col("ts").cast("timestamp") < F.timestamp_micros(F.lit(0)), F.expr("INTERVAL '0.000499' SECOND")).otherwise(F.expr("INTERVAL '0.000500' SECOND"))
    stream = timed(calls.withColumn("ts", F.col("ts").cast("timestamp") + half), late).select("backend", "ts", "event_id", F.coalesce("ok", F.lit(False)).alias("ok"), F.unix_millis(F.col("ts")).alias("ms"))
    made = stream.groupBy("backend").transformWithStateInPandas(Breaker(min_run, cool_seconds * 1000), "backend long, ms long, status string, failures int", "Append", "EventTime")
    return made.select("backend", F.timestamp_millis("ms").alias("ts"), "status", "failures")


def keep_last(keys: list[str], order: list[str]):
    """For ``available``'s ``merge``: of rows equal in ``keys`` only the last by ``order`` stays, and rows kept before are taken back.

    Each batch gives its last row of every key; where the store's is later, that stays."""
    at = F.struct(*order)

    def merge(rows: DataFrame, before: DataFrame | None) -> DataFrame:
        every = rows if before is None else before.unionByName(rows)
        rest = [c for c in rows.columns if c not in keys]
        return every.groupBy(*keys).agg(F.max_by(F.struct(*rest), at).alias("_r")).select(*keys, "_r.*").select(*rows.columns)

    return merge


def sessions_with_open(by: str = "client", gap: str = "30 minutes"):
    """For ``available``'s ``carry``: sessions by gap as batches bring them. What a batch leaves are the sessions that may still grow,
    those that end within the gap before the newest call; its rows are the others. At a stream's end ``available`` adds the rest.

    No batch may bring calls of before a session that an earlier one has closed."""

    def run(calls: DataFrame, before: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        new = calls.select(by, F.col("ts").cast("timestamp").alias("a"), F.col("ts").cast("timestamp").alias("b"), F.lit(1).cast("long").alias("requests"))
        every = new if before is None else new.unionByName(before.select(by, "a", "b", "requests"))
        # Calls within a gap become one piece first, so that a busy client's calls are added up before they meet.
        pieces = every.groupBy(by, F.session_window("a", gap).alias("w")).agg(F.min("a").alias("a"), F.max("b").alias("b"), F.sum("requests").alias("requests")).drop("w")
        w = Window.partitionBy(by).orderBy("a", "b")
        reach = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
        first = F.when(F.col("a") < F.coalesce(F.col("_reach"), F.to_timestamp(F.lit("0001-01-01"))) + F.expr(f"INTERVAL {gap}"), 0).otherwise(1)
        joined = pieces.withColumn("_reach", reach).withColumn("_new", first).withColumn("_s", F.sum("_new").over(w))
        sessions = joined.groupBy(by, "_s").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.sum("requests").alias("requests")).drop("_s")
        newest = every.agg(F.max("b")).first()[0]
        still = F.col("b") + F.expr(f"INTERVAL {gap}") > F.lit(newest)
        placed = sessions.withColumn("open", F.coalesce(still, F.lit(False)))
        return placed.where(~F.col("open")), placed.where("open")

    return run
