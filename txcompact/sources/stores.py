"""Stores as Parquet tables that only grow: summaries and originals by hash, and a row of facts for each request.

An append adds what the store lacks. Two appends that run at once may write an entry twice, so reading takes each once.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def opened(spark: SparkSession, path: str) -> DataFrame | None:
    """The store at ``path``; None where there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def append_new(rows: DataFrame, path: str, key: str = "hash") -> None:
    """Appends the rows of which the store at ``path`` has no ``key`` yet, each key once."""
    have = opened(rows.sparkSession, path)
    new = rows.dropDuplicates([key])
    (new if have is None else new.join(have.select(key), key, "left_anti")).write.mode("append").parquet(path)


def read_store(spark: SparkSession, path: str, key: str = "hash", newest: str | None = None) -> DataFrame:
    """Every entry once; of one written twice the ``newest`` by that column, or any, as they are equal."""
    rows = spark.read.parquet(path)
    if newest is None:
        return rows.dropDuplicates([key])
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), newest).alias("_r")).select(key, "_r.*")


def append_requests(requests: DataFrame, path: str) -> None:
    """Facts of requests, by day. Totals are always worked out from them, so nothing counts twice."""
    requests.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def newest_sessions(sessions: DataFrame, keep: int = 500) -> DataFrame:
    """The ``keep`` sessions that started last, newest first; ties by id."""
    return sessions.orderBy(F.desc("start_ts"), "session_id").limit(keep)


def retained_sessions(sessions: DataFrame, per: str, keep: int) -> DataFrame:
    """The last ``keep`` sessions of each ``per``."""
    nth = F.row_number().over(Window.partitionBy(per).orderBy(F.desc("start_ts"), "session_id"))
    return sessions.withColumn("_nth", nth).where(F.col("_nth") <= keep).drop("_nth")


class Generations:
    """A store that is compacted while it is read and appended to: a compacted generation, the batches appended since, and a
    pointer that names the generation in force.

    Appends go to the log of the generation that the pointer names, each as a batch of its own. A compaction writes the next generation, and
    which batches it took in, to a folder of its own, and only then adds its number to the pointer, so a reader sees the old
    one or the new one whole. Reading takes the generation and those batches of its log and of the log before that it did not take in:
    an append that began before the switch is not lost, unless it outlasts two compactions. Of entries with one key the
    newest counts. Old folders stay until they are cleared."""

    def __init__(self, spark: SparkSession, path: str, key: str, newest: str):
        self.spark, self.path, self.key, self.newest = spark, path.rstrip("/"), key, newest

    def current(self) -> int:
        numbers = opened(self.spark, f"{self.path}/pointer")
        return 0 if numbers is None else numbers.agg(F.max("number")).first()[0]

    def append(self, rows: DataFrame) -> None:
        rows.withColumn("batch", F.lit(uuid.uuid4().hex)).write.mode("append").partitionBy("batch").parquet(f"{self.path}/log/{self.current()}")

    def _log(self, number: int) -> DataFrame | None:
        """Batches that the generation did not take in."""
        found, taken = None, opened(self.spark, f"{self.path}/generation/{number}/batches")
        for n in (number, number - 1):
            part = opened(self.spark, f"{self.path}/log/{n}") if n >= 0 else None
            if part is not None:
                found = part if found is None else found.unionByName(part)
        # As folders' names, so that the files of batches taken in are not opened.
        names = [] if taken is None else [r.batch for r in taken.collect()]
        return found if found is None or not names else found.where(~F.col("batch").isin(names))

    def _newest(self, number: int, log: DataFrame | None) -> DataFrame | None:
        kept, new = opened(self.spark, f"{self.path}/generation/{number}/entries"), None if log is None else log.drop("batch")
        rows = kept if new is None else new if kept is None else kept.unionByName(new)
        if rows is None:
            return None
        rest = [c for c in rows.columns if c != self.key]
        return rows.groupBy(self.key).agg(F.max_by(F.struct(*rest), self.newest).alias("_r")).select(self.key, "_r.*").select(*rows.columns)

    def read(self) -> DataFrame | None:
        """Every entry once; None before the first append."""
        number = self.current()
        return self._newest(number, self._log(number))

    def compact(self, keep: int | None = None) -> int:
        """Writes the next generation, with the ``keep`` newest entries (all if None; ties by key), and puts it in force."""
        number = self.current()
        log = self._log(number)
        if log is None:
            return number
        # The batches are listed first, so one that comes meanwhile is in neither and stays for the next time.
        names = [r.batch for r in log.select("batch").distinct().collect()]
        rows = self._newest(number, log.where(F.col("batch").isin(names)))
        at = f"{self.path}/generation/{number + 1}"
        (rows if keep is None else rows.orderBy(F.desc(self.newest), self.key).limit(keep)).write.mode("overwrite").parquet(f"{at}/entries")
        self.spark.createDataFrame([(n,) for n in names], "batch string").coalesce(1).write.mode("overwrite").parquet(f"{at}/batches")
        self.spark.range(1).select(F.lit(number + 1).alias("number")).coalesce(1).write.mode("append").parquet(f"{self.path}/pointer")
        return number + 1

    def files(self) -> int:
        """Files of entries that a reader opens."""
        number = self.current()
        parts = (opened(self.spark, f"{self.path}/generation/{number}/entries"), self._log(number))
        return sum(p.select(F.input_file_name()).distinct().count() for p in parts if p is not None)


def upsert_sessions(store: Generations, sessions: DataFrame, keep: int = 500) -> None:
    """A history of sessions: rows replace those of their id, and the ``keep`` last ones stay."""
    store.append(sessions)
    store.compact(keep)
