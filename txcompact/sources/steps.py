"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only where that is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (found or tempfile.mkdtemp(prefix="spark-steps-")).rstrip("/")


def stored(df: DataFrame, name: str, by: str | None = None, packed: bool = False) -> DataFrame:
    """``df`` written and read again, so that what follows starts from files which outlive executors, and is planned apart.
    ``by``: a column of few values, each of which gets a folder, so that a filter on it reads no others.
    ``packed``: for texts, which a slower codec brings to a third of the size."""
    at = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df.write if by is None else df.write.partitionBy(by)).parquet(at, compression="zstd" if packed else None)
    return df.sparkSession.read.schema(df.schema).parquet(at)
