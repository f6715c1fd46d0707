"""Benchmark decontamination by a positional inverted index over the training documents.

1. Benchmark items become windows of ``width`` consecutive words (an item of fewer words is one window).
2. Corpus frequencies of the benchmark's words are counted over all documents; they name the rarest
   terms of each window, which are the ones looked up.
3. The index is stored: postings ``term, document, position`` for every looked-up term.
4. Lists are intersected from the rarest term on. A posting minus its term's place in a window is the
   start at which the whole window would stand; a start survives if the next-rarest list has it too.
5. Surviving starts are held against the documents' words (exact phrases, by 128 bits of hash of the window), or, with ``slop``, lists may
   disagree by some words (proximity matches).

The vocabulary and the lookups are stored tables, so Spark knows their size and broadcasts them only
below its threshold; beyond it they are joined by a shuffle. No step gathers one term's or document's
postings in a task except the candidate starts of a single document.

Defined results: a null or wordless text has no words, no hits and is not contaminated; items that are
null, wordless or without an id are ignored; windows shared by several items count for each; repeated
documents each keep their row; columns of the documents named like a result are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txcompact.llm.common import ascii_lower, let, stored, table

#: All that is no word character after lower-casing: ASCII but for digits and a-z.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows to a task and a file in the tables of vocabulary and lookups, so that small ones are one file and large ones many.
TASK_WINDOWS = 10_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), "")


def _proof(words: Column) -> Column:
    return F.struct(F.xxhash64(words).alias("a"), F.xxhash64(F.lit(1), words).alias("b"))


def windows_of(items: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = 13) -> DataFrame:
    """Distinct windows: ``window_id, proof`` (two hashes), ``words, items`` (the sorted ids of the items that hold it)."""
    return (
        items.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("item"), words_of(F.col(text_col)).alias("w"))
        .where(F.size("w") > 0)
        .select("item", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (width - 1)))).alias("at"))
        .select("item", F.slice("w", F.col("at"), F.lit(width)).alias("words"))
        .groupBy("words")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
        .select(F.xxhash64("words").alias("window_id"), _proof(F.col("words")).alias("proof"), "words", "items")
    )


def _tokens(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Each word of each document with its place. ``part`` tells apart different texts under one id."""
    return docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("part"), words_of(F.col(text_col)).alias("w")).select("doc", "part", F.posexplode("w").alias("pos", "term"))


def _lookups(windows: DataFrame, frequency: DataFrame, lists: int) -> DataFrame:
    """For each window its ``lists`` rarest places: ``window_id, rank, term, place``. Windows of fewer words repeat their last."""
    placed = windows.select("window_id", "words", F.posexplode("words").alias("place", "term")).join(frequency, "term", "left")
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "place", "term")))
    ranked = placed.groupBy("window_id", "words").agg(order.alias("o"))
    return ranked.select("window_id", F.explode(F.sequence(F.lit(1), F.lit(lists))).alias("rank"), "o").select(
        "window_id", "rank", F.expr("o[least(rank, size(o)) - 1].term").alias("term"), F.expr("o[least(rank, size(o)) - 1].place").alias("place")
    )


def build_index(docs: DataFrame, windows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lists: int = 3) -> tuple[DataFrame, DataFrame]:
    """The stored postings and the stored lookups."""
    tasks = 1 + windows.count() // TASK_WINDOWS
    vocabulary = stored(windows.select(F.explode("words").alias("term")).distinct().coalesce(tasks), "vocabulary")
    frequency = stored(_tokens(docs, id_col, text_col).select("term").join(vocabulary, "term").groupBy("term").agg(F.count(F.lit(1)).alias("n")), "frequency")
    lookups = stored(_lookups(windows, frequency, lists).coalesce(tasks), "lookups")
    wanted = stored(lookups.select("term").distinct().coalesce(tasks), "terms")
    postings = stored(_tokens(docs, id_col, text_col).join(wanted, "term"), "postings")
    return postings, lookups


def candidate_starts(postings: DataFrame, lookups: DataFrame, lists: int = 3, slop: int = 0) -> DataFrame:
    """``doc, part, window_id, start``: where the lists of a window's rarest terms agree, to within ``slop`` words."""

    def listed(rank: int) -> DataFrame:
        return postings.join(lookups.where(F.col("rank") == rank), "term").select("doc", "part", "window_id", (F.col("pos") - F.col("place")).alias("start"))

    found = listed(1)
    if not slop:
        found = found.where("start >= 0")
    for rank in range(2, lists + 1):
        a, b = found.alias("a"), listed(rank).alias("b")
        near = (F.col("a.start") == F.col("b.start")) if not slop else (F.abs(F.col("a.start") - F.col("b.start")) <= slop)
        found = a.join(b, F.col("a.doc").eqNullSafe(F.col("b.doc")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.window_id") == F.col("b.window_id")) & near, "left_semi")
    return found


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int, width: int = 13, lists: int = 3, id_col: str = "doc_id") -> DataFrame:
    """``doc, item, start``: places where the ``lists`` rarest terms of an item's window stand within ``slop`` words of
    their places in the window. With slop 0 and all terms as lists these are the exact phrases."""
    windows = stored(windows_of(items, width=width), "windows")
    postings, lookups = build_index(docs, windows, id_col, "text", lists)
    return candidate_starts(postings, lookups, lists, slop).join(windows.select("window_id", F.explode("items").alias("item")), "window_id").select("doc", "item", "start").distinct()


def phrase_hits(docs: DataFrame, items: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", lists: int = 3) -> DataFrame:
    """Every row of ``docs`` with ``n_words``, ``n_hit`` (words inside any occurrence of a window) and
    ``hit_items`` (sorted ids of the items that have an occurring window)."""
    docs = docs.drop("n_words", "n_hit", "hit_items")
    windows = stored(windows_of(items, item_col, item_text, width), "windows")
    postings, lookups = build_index(docs, windows, id_col, text_col, lists)
    starts = (
        candidate_starts(postings, lookups, lists)
        .join(windows.select("window_id", "proof", F.size("words").alias("n"), "items"), "window_id")
        .groupBy("doc", "part")
        .agg(F.collect_set(F.struct("start", "n", "proof", "items")).alias("_found"))
    )
    kind, none = dict(items.dtypes)[item_col], F.lit(0).cast("long")

    def covered(hits: Column) -> Column:
        spans = F.array_sort(F.transform(hits, lambda c: F.struct(c["start"].alias("start"), (c["start"] + c["n"]).alias("end"))))
        return F.aggregate(
            spans,
            F.struct(none.alias("n"), F.lit(0).alias("end")),
            lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["end"]))).cast("long").alias("n"), F.greatest(a["end"], s["end"]).alias("end")),
            lambda a: a["n"],
        )

    def judged(words: Column) -> Column:
        exact = F.filter("_found", lambda c: _proof(F.slice(words, c["start"] + 1, c["n"])) == c["proof"])
        named = lambda hits: F.array_sort(F.array_distinct(F.flatten(F.transform(hits, lambda c: c["items"]))))
        return let(exact, lambda hits: F.struct(F.size(words).cast("long").alias("n_words"), covered(hits).alias("n_hit"), named(hits).alias("hit_items")))

    # The words are made once for a text and the hits once, so that its cost grows with both as n log n at most.
    words = words_of(F.col(text_col))
    clean = F.struct(F.size(words).cast("long").alias("n_words"), none.alias("n_hit"), F.array().cast(f"array<{kind}>").alias("hit_items"))
    keyed = docs.withColumn("_part", F.xxhash64(text_col))
    return (
        keyed.join(starts, keyed[id_col].eqNullSafe(starts["doc"]) & (keyed["_part"] == starts["part"]), "left")
        .select(*[keyed[c] for c in docs.columns], F.when(F.col("_found").isNull(), clean).otherwise(let(words, judged)).alias("_judged"))
        .select(*docs.columns, "_judged.*")
    )


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least a twentieth of the words are hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = phrase_hits(docs, table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("hit_items", lambda i: i.cast("string")))
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


OP3_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT item_id, array_to_string(w[i : i + 12], ' ') AS k, least(len(w), 13) AS n FROM b, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS k FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n),
hit AS (SELECT DISTINCT dw.doc_id, dw.i, dw.n, win.item_id FROM dw JOIN win ON dw.k = win.k AND dw.n = win.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
