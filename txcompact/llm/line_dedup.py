"""Line dedup: drop the lines whose normalised key is found in many documents.

Lines are exploded once with their places, normalised and hashed to 128 bits, and stored. Distinct documents are counted
for each hash (first over hash and document, so that a line found everywhere is counted by many tasks). The hashes over the
threshold are joined back to the stored lines, and each document is put together again by position, from the
places that none of its dropped lines has. Only hashes are shuffled for the counting, texts once. In the join a hash is
salted: the few over the threshold are copied to ``SALTS`` places, a line goes to one of them by its document.

Defined results: a null or empty text is one empty line; an empty key is never dropped (its length is
below ``min_chars``); rows with a null document id count as one document; repeated rows of one id count
once and each keeps its row; of a text all of whose lines go, the empty text stays; an empty table gives no rows;
columns of the documents named like a result are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txcompact.llm.common import ascii_lower, let, stored, table

#: What counts as white space at the ends of a line.
EDGE = " \t\n\x0b\x0c\r"
SALTS = 16


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(EDGE)))


def _lines(text_col: str) -> Column:
    return F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``docs`` with the kept text in ``text_col`` and ``n_lines``, ``n_dropped`` added."""
    key = line_key(F.col("line"))
    lines = stored(
        docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("part"), _lines(text_col).alias("l"))
        .select("id", "part", F.posexplode("l").alias("pos", "line"))  # beside the explode itself the text would be hashed for each line
        .select("id", "part", "pos", key.alias("key"))
        .where(F.length("key") >= max(1, min_chars))
        .select("id", "part", "pos", F.xxhash64("key").alias("a"), F.xxhash64(F.lit(1), "key").alias("b")),
        "lines",
    )
    often = lines.select("id", "a", "b").distinct().groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= min_docs)
    copied = often.select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = lines.withColumn("salt", F.pmod(F.xxhash64("id", "part"), F.lit(SALTS)).cast("int"))
    gone = salted.join(copied, ["a", "b", "salt"], "left_semi").groupBy("id", "part").agg(F.collect_set("pos").alias("gone"))
    gone = gone.select(F.col("id").alias("_id"), F.col("part").alias("_part"), F.col("gone").alias("_gone"))
    joined = docs.join(gone, docs[id_col].eqNullSafe(gone["_id"]) & (F.xxhash64(docs[text_col]) == gone["_part"]), "left").drop("_id", "_part")

    # Lines and the places of those that stay are worked out once for a text, so that its cost is linear in its lines.
    places = lambda whole: F.array_except(F.sequence(F.lit(0), F.size(whole) - 1), F.col("_gone"))
    kept = let(_lines(text_col), lambda whole: F.array_join(F.transform(places(whole), lambda i: F.get(whole, i)), "\n"))
    return (
        joined.withColumn("n_lines", F.size(_lines(text_col)).cast("long"))
        .withColumn("n_dropped", F.coalesce(F.size("_gone"), F.lit(0)).cast("long"))
        .withColumn(text_col, F.when(F.col("_gone").isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(kept))
        .drop("_gone")
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP4_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
