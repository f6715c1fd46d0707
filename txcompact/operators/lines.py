"""Operators on the line relation ``block_id, pos, line``. All windows share the partitioning by block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txcompact.functions.text import trimmed


def by_block(*more: str) -> Window:
    return Window.partitionBy("block_id", *more)


def in_order() -> Window:
    return by_block().orderBy("pos")


def so_far() -> Window:
    return in_order().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def to_lines(blocks: DataFrame, id_col: str = "block_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``block_id, pos, line``, and of each block the columns ``keep``."""
    split = blocks.select(F.col(id_col).alias("block_id"), *keep, F.split(text_col, "\n", -1).alias("_l"))
    return split.select("block_id", *keep, F.posexplode("_l").alias("pos", "line"))


def to_texts(lines: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``block_id, text`` from lines in the order of ``pos``, and the blocks' columns ``keep``."""
    same = [F.first(c).alias(c) for c in keep]
    return lines.groupBy("block_id").agg(*same, F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))


def keep_lines(lines: DataFrame, predicate: Column) -> DataFrame:
    return lines.where(predicate)


def keep_islands(lines: DataFrame, opens: Column, closes: Column, ends: Column | None = None, keep: Column | None = None) -> DataFrame:
    """Lines from one that ``opens`` on until one that ``closes`` (not kept) or ``ends`` (kept); ``keep`` lines always."""
    never = F.lit(False)
    ends, keep = ends if ends is not None else never, keep if keep is not None else never
    event = F.when(opens, 1).when(ends | closes, 0)
    marked = lines.withColumn("_event", event).withColumn("_state", F.last("_event", ignorenulls=True).over(so_far()))
    blank = F.col("line").rlike(r"^\s*\z")
    return marked.where(opens | ends | keep | (F.col("_event").isNull() & (F.col("_state") == 1) & ~blank)).drop("_event", "_state")


def group_and_cap(lines: DataFrame, key: Column, per_group: int, max_groups: int | None = None) -> DataFrame:
    """Up to ``per_group`` lines of each key and the first ``max_groups`` keys by appearance, with ``key, nth, group_no, n_in_group``."""
    keyed = lines.withColumn("key", key)
    w = by_block("key")
    numbered = keyed.withColumn("nth", F.row_number().over(w.orderBy("pos"))).withColumn("n_in_group", F.count(F.lit(1)).over(w)).withColumn("_first", F.min("pos").over(w))
    ranked = numbered.withColumn("group_no", F.dense_rank().over(by_block().orderBy("_first"))).drop("_first")
    kept = ranked.where(F.col("nth") <= per_group)
    return kept if max_groups is None else kept.where(F.col("group_no") <= max_groups)


def head_tail(lines: DataFrame, head: int, tail: int, longer_than: int | None = None) -> DataFrame:
    """First and last lines of blocks of more than ``longer_than`` lines (head + tail by default), with a line that says how many went."""
    least = head + tail if longer_than is None else longer_than
    counted = lines.withColumn("_n", F.count(F.lit(1)).over(by_block())).withColumn("_rn", F.row_number().over(in_order()))
    kept = counted.where((F.col("_n") <= least) | (F.col("_rn") <= head) | (F.col("_rn") > F.col("_n") - tail))
    note = F.when((F.col("_n") > least) & (F.col("_rn") == head), F.array(F.col("line"), F.format_string("... [%d lines omitted] ...", F.col("_n") - head - tail))).otherwise(F.array("line"))
    return kept.select("block_id", F.col("pos").alias("_p"), F.posexplode(note).alias("_k", "line")).select("block_id", (F.col("_p") * 2 + F.col("_k")).alias("pos"), "line")


def rewrite_lines(lines: DataFrame, pattern: str, replacement: str) -> DataFrame:
    return lines.withColumn("line", F.regexp_replace("line", pattern, replacement))


def keep_with_context(lines: DataFrame, match: Column, before: int = 1, after: int = 1) -> DataFrame:
    """Matching lines and their neighbours, each once; blank neighbours go."""
    flag = F.when(match, 1).otherwise(0)
    near = F.max("_m").over(in_order().rowsBetween(-after, before))
    return lines.withColumn("_m", flag).withColumn("_near", near).where((F.col("_m") == 1) | ((F.col("_near") == 1) & ~F.col("line").rlike(r"^\s*\z"))).drop("_m", "_near")


def fold_records(lines: DataFrame, starts: Column, *fields: Column) -> DataFrame:
    """One row for each record that a ``starts`` line begins: ``block_id, pos, *fields`` (aggregates over its lines)."""
    numbered = lines.withColumn("record", F.sum(F.when(starts, 1).otherwise(0)).over(so_far()))
    return numbered.where("record > 0").groupBy("block_id", "record").agg(F.min("pos").alias("pos"), *fields)


def context_budget(lines: DataFrame, changed: Column, allowed: int = 1) -> DataFrame:
    """``changed`` lines and at most ``allowed`` lines after each."""
    last = F.last(F.when(changed, F.col("pos")), ignorenulls=True).over(so_far())
    return lines.withColumn("_last", last).where(F.col("pos") - F.col("_last") <= allowed).drop("_last")


def _relined(lines: DataFrame, shown: Column, columns: list[str]) -> DataFrame:
    """For each line those of ``shown`` (an array); the other ``columns`` are carried."""
    rest = [c for c in columns if c not in ("pos", "line")]
    return lines.select(*rest, F.col("pos").alias("_p"), F.posexplode(shown).alias("_k", "line")).select(*rest, (F.col("_p") * 2 + F.col("_k")).alias("pos"), "line")


def dedup_lines(lines: DataFrame, min_count: int = 3, consecutive_only: bool = False) -> DataFrame:
    """Of a line found ``min_count`` times or more in its block (trimmed; blank lines never) the first stays, followed by
    a line that says how many went. ``consecutive_only`` looks at unbroken runs only."""
    keyed = lines.withColumn("_key", trimmed(F.col("line")))
    parts = ["block_id", "_key"]
    if consecutive_only:
        broke = F.when(F.lag("_key").over(in_order()).eqNullSafe(F.col("_key")), 0).otherwise(1)
        keyed = keyed.withColumn("_broke", broke).withColumn("_run", F.sum("_broke").over(so_far())).drop("_broke")
        parts.append("_run")
    w = Window.partitionBy(*parts).orderBy("pos")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counted = keyed.withColumn("_n", F.count(F.lit(1)).over(whole)).withColumn("_rn", F.row_number().over(w))
    often = (F.col("_key") != "") & (F.col("_n") >= min_count)
    shown = F.when(often, F.array(F.col("line"), F.format_string("  ... [repeated %d more times]", F.col("_n") - 1))).otherwise(F.array("line"))
    return _relined(counted.where(~often | (F.col("_rn") == 1)), shown, lines.columns)


def dedup_islands(lines: DataFrame, flag: Column, min_len: int = 3) -> DataFrame:
    """Unbroken runs of at least ``min_len`` flagged lines; a run equal to an earlier one of its block becomes one line. All by
    windows within blocks, so lines that are dealt by block stay where they are."""
    start = F.when(F.lag("_f").over(in_order()).eqNullSafe(F.col("_f")), 0).otherwise(1)
    islands = lines.withColumn("_f", flag).withColumn("_start", start).withColumn("_island", F.sum("_start").over(so_far()))
    run = by_block("_island").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    body = F.md5(F.array_join(F.collect_list(F.when(F.col("_f"), F.col("line"))).over(run), "\n"))
    sized = islands.withColumn("_len", F.count(F.lit(1)).over(run)).withColumn("_begin", F.min("pos").over(run)).withColumn("_body", body)
    long = F.col("_f") & (F.col("_len") >= min_len)
    first = F.min(F.when(long, F.col("_island"))).over(by_block("_body", "_len"))
    again = F.coalesce(long & (F.col("_island") > F.col("_first")), F.lit(False))
    marked = sized.withColumn("_first", first).withColumn("_again", again).where(~F.col("_again") | (F.col("pos") == F.col("_begin")))
    line = F.when(F.col("_again"), F.format_string("  ... [same %d-frame stack trace repeated]", F.col("_len"))).otherwise(F.col("line"))
    return marked.withColumn("line", line).select(*lines.columns)
