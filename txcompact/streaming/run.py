"""Runs a stream over all that its source holds now and gives the result as a table.

Each micro-batch overwrites a folder of its own number, so a batch that runs twice after a failure counts once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txcompact.sources.steps import shared_dir, stored


def in_batches(table: DataFrame, by: str, batches: int = 4, cuts: list[float] | None = None) -> DataFrame:
    """A stream that brings a table in several micro-batches: its rows in ``batches`` parts by the value of ``by``, one after
    another; ``cuts``: the least values of all parts but the first, quantiles if None. The table is worked out and stored once, by many
    tasks; what writes a part in one task only copies rows."""
    spark, table = table.sparkSession, stored(table, "to-deal")
    at = f"{shared_dir(spark)}/batches-{uuid.uuid4().hex}"
    value = F.col(by).cast("double") if dict(table.dtypes)[by] != "timestamp_ntz" else F.col(by).cast("timestamp").cast("double")
    if cuts is None:
        cuts = table.select(value.alias("v")).approxQuantile("v", [k / batches for k in range(1, batches)], 0.01)
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = table if low is None else table.where(value >= low)
        (part if high is None else part.where(F.coalesce(value < high, F.lit(low is None)))).coalesce(1).write.mode("append").parquet(at)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(at)


def available(
    result: DataFrame,
    mode: str = "append",
    keys: list[str] | None = None,
    each: Callable[[DataFrame], DataFrame] = lambda rows: rows,
    carry: Callable[[DataFrame, DataFrame | None], tuple[DataFrame, DataFrame]] | None = None,
    merge: Callable[[DataFrame, DataFrame | None], DataFrame] | None = None,
    rest: bool = False,
    progress: list | None = None,
) -> DataFrame:
    """All rows that a streaming ``result`` gives, each micro-batch put through ``each``. In mode ``update`` a key's row of the last batch counts.

    ``carry`` makes of a micro-batch and what the one before left (None at first) its rows and what it leaves itself, which
    is stored by the batch's number; with ``rest``, what the last batch left is added. ``merge`` makes of a batch and the result so far the new
    result, in which earlier rows may be taken back. ``progress`` gets the query's progress reports."""
    spark = result.sparkSession
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    numbers = []

    def before(number: int, folder: str) -> DataFrame | None:
        return spark.read.parquet(f"{at}/{folder}/{number - 1}") if number else None

    def sink(rows: DataFrame, number: int) -> None:
        numbers.append(number)
        if merge:
            merge(each(rows), before(number, "merged")).write.mode("overwrite").parquet(f"{at}/merged/{number}")
            return
        if carry:
            rows, left = carry(rows, before(number, "left"))
            left.write.mode("overwrite").parquet(f"{at}/left/{number}")
        each(rows).write.mode("overwrite").parquet(f"{at}/rows/batch={number}")

    run = result.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    if progress is not None:
        progress += run.recentProgress
    none = spark.createDataFrame([], result.schema)
    if merge:
        return spark.read.parquet(f"{at}/merged/{max(numbers)}") if numbers else merge(each(none), None)
    if not numbers:
        each(carry(none, None)[0] if carry else none).write.mode("overwrite").parquet(f"{at}/rows/batch=-1")
    rows = spark.read.parquet(f"{at}/rows")
    if rest and numbers:
        return rows.drop("batch").unionByName(spark.read.parquet(f"{at}/left/{max(numbers)}"))
    if mode != "update":
        return rows.drop("batch")
    values = [c for c in result.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v")).select(*keys, "_v.*")


def dropped_late(progress: list) -> int:
    """Rows that came behind the watermark, by a query's progress reports."""
    return sum(s.numRowsDroppedByWatermark for p in progress for s in p.stateOperators)
