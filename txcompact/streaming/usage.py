"""Streaming aggregates with watermarks. Event times without a zone are cast, as watermarks need them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txcompact.operators.savings import slot, with_earlier


def timed(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def usage_by_day(stream: DataFrame) -> DataFrame:
    return timed(stream).groupBy(F.window("ts", "1 day").alias("w"), "client").agg(F.sum("input_tokens").alias("input_tokens"), F.count(F.lit(1)).alias("requests")).select("client", F.to_date("w.start").alias("day"), "input_tokens", "requests")


def savings_by_slot(stream: DataFrame) -> DataFrame:
    """The window lets the watermark close state; the slot restarts at midnight."""
    t = timed(stream)
    return t.groupBy(F.window("ts", "1 day").alias("w"), slot(F.col("ts")).alias("slot")).agg(F.sum("saved_chars").alias("saved_chars")).select(F.to_date("w.start").alias("day"), "slot", "saved_chars")


def sessions_by_gap(stream: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return timed(stream).groupBy(F.session_window("ts", gap).alias("w"), "client").agg(F.count(F.lit(1)).alias("requests")).select("client", F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "requests")


def first_of_each(stream: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Content dedup that keeps the first of each key; the batch form keeps the last."""
    return timed(stream, late).dropDuplicatesWithinWatermark(keys)


def failure_alerts(by: str = "backend", min_run: int = 3) -> Callable[[DataFrame, DataFrame | None], tuple[DataFrame, DataFrame]]:
    """For ``available``'s ``carry``: a row when a backend's failures in sequence reach ``min_run`` (``by, ts, failures``), and the
    failures at the end of each backend's calls, up to ``min_run``, which later batches go on from.

    Successes before a call are counted within hours and added up over hours, so no task holds a backend's calls together; of
    a run's failures each hour gives its first ``min_run`` only."""

    def run(calls: DataFrame, before: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        ok = F.coalesce(F.col("ok"), F.lit(False))
        if before is None:
            before = calls.select(by, F.lit(0).alias("streak")).limit(0)
        before = before.withColumnRenamed(by, "_by")
        same = F.col(by).eqNullSafe(F.col("_by"))
        rows = with_earlier(calls.withColumn("ts", F.col("ts").cast("timestamp")), [by], "hour", F.sum(ok.cast("long")), F.sum)
        so_far = Window.partitionBy(by, "_bucket").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
        runs = rows.withColumn("_run", F.coalesce("_earlier", F.lit(0)) + F.sum(ok.cast("long")).over(so_far))
        first = F.row_number().over(Window.partitionBy(by, "_bucket", "_run").orderBy("ts", "event_id"))
        few = runs.where(~ok).withColumn("_k", first).where(F.col("_k") <= min_run)
        place = F.row_number().over(Window.partitionBy(by, "_run").orderBy("ts", "event_id")) + F.when(F.col("_run") == 0, F.coalesce("streak", F.lit(0))).otherwise(0)
        alerts = few.join(before, same, "left").withColumn("_place", place).where(F.col("_place") == min_run)
        last = runs.groupBy(by, "_run").agg(F.count_if(~ok).alias("failures")).groupBy(by).agg(F.max(F.struct("_run", "failures")).alias("last"))
        streak = F.coalesce("last.failures", F.lit(0)) + F.when(F.coalesce("last._run", F.lit(0)) == 0, F.coalesce("streak", F.lit(0))).otherwise(0)
        state = last.join(before, same, "full").select(F.when(F.col("last").isNull(), F.col("_by")).otherwise(F.col(by)).alias(by), F.least(streak, F.lit(min_run)).cast("int").alias("streak"))
        return alerts.select(by, "ts", F.lit(min_run).alias("failures")), state

    return run
