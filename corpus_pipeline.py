"""A corpus pipeline of four filters and a packing. Each stage works on what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txcompact.llm import decontam, line_dedup, near_copies, packing, toxicity
from txcompact.llm.common import stored, table


def _apart(docs: DataFrame) -> DataFrame:
    """Id and text, and the other columns in a struct, where their names meet no others."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*rest).alias("_rest") if rest else F.lit(0).alias("_rest"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit on the labelled documents at hand; those that the classifier rejects go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.toxic_rows(docs, model).where(~F.col("rejected")).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten or more documents go; ``n_chars`` follows the text."""
    kept = line_dedup.drop_repeated_lines(_apart(docs))
    n_chars = F.length("text").cast(dict(docs.dtypes).get("n_chars", "long")).alias("n_chars")
    return kept.select(*[F.col(c) if c in ("doc_id", "text") else n_chars if c == "n_chars" else F.col("_rest")[c].alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (similarity 0.8 on five-word shingles, or four bits) one row with the least id stays."""
    return near_copies.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more are benchmark words go."""
    hits = decontam.phrase_hits(_apart(docs), table(spark, sf_dir, "benchmark"))
    clean = hits.where(~decontam.contaminated(F.col("n_hit"), F.col("n_words")))
    return clean.select(*[F.col(c) if c in ("doc_id", "text") else F.col("_rest")[c].alias(c) for c in docs.columns])


def pack_best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 words."""
    return packing.pack(packing.packable(docs), 4096).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("best_fit_packing", pack_best_fit),
]

#: Fitting, fingerprints and best fit have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
