"""Dedup across turns, selection of blocks, summaries by content hash, and whole conversations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txcompact.config import CompactionConfig
from txcompact.functions import text as t
from txcompact.operators.clean import clean, cleaned
from txcompact.sources import stores
from txcompact.sources.steps import stored
from txcompact.sources.transcripts import input_fields

#: Most characters of a block, and of a system prompt, that a summariser sees.
SUMMARY_INPUT, PROMPT_INPUT = 4000, 10_000


def dedup_blocks(blocks: DataFrame, scope: list[str] = ["conv_id"], order: list[str] = ["turn", "part"], keep: str = "last", min_len: int = 200) -> DataFrame:
    """Adds ``hash``, ``kept_ref`` (id of the kept text, null where the block stays) and ``saved_chars``.

    Which block of equal texts stays is worked out by partial aggregates, so a text that fills a third of all blocks meets in
    no single task; blocks equal in ``order`` too stay together."""
    at = F.struct(*order)
    out = blocks.withColumn("hash", F.md5("text")).withColumn("chars", F.length("text"))
    groups = out.where(F.col("chars") >= min_len).groupBy(*scope, "hash").agg((F.max if keep == "last" else F.min)(at).alias("_kept"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    kept = groups.select("_kept", *[F.col(c).alias(f"_k_{c}") for c in [*scope, "hash"]])
    same = F.lit(True)
    for c in [*scope, "hash"]:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    again = F.col("_kept").isNotNull() & ~at.eqNullSafe(F.col("_kept"))
    marked = out.join(kept, same, "left").withColumn("kept_ref", F.when(again, F.substring("hash", 1, 6))).withColumn("saved_chars", F.when(again, F.col("chars")).otherwise(0))
    return marked.drop("_kept", *[f"_k_{c}" for c in [*scope, "hash"]])


def placeholder(tool: Column, ref: Column, tag: str = "tx") -> Column:
    what = F.when(F.lower(tool) == "read", "file content").when(F.lower(tool) == "grep", "search result").otherwise("output")
    return F.concat(F.lit(f"[{tag}:"), ref, F.lit("] same "), what, F.lit(" as in a later turn"))


def build_store(blocks: DataFrame) -> DataFrame:
    """``hash, block_id6, text``: each distinct text once."""
    return blocks.select(F.md5("text").alias("hash"), t.content_id(F.col("text")).alias("block_id6"), "text").dropDuplicates(["hash"])


def id_collisions(store: DataFrame) -> DataFrame:
    return store.groupBy("block_id6").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def _by_ref(rows: DataFrame, store: DataFrame) -> DataFrame:
    """``rows`` with ``_original``: the stored text that ``_ref`` names, a whole hash or its first six digits. Short ids that
    several texts share name none of them, so a row stays one row."""
    alone = store.join(id_collisions(store).select("block_id6"), "block_id6", "left_anti")
    by_hash = store.select(F.col("hash").alias("_ref"), F.col("text").alias("_whole"))
    by_id = alone.select(F.col("block_id6").alias("_ref"), F.col("text").alias("_short"))
    return rows.join(by_hash, "_ref", "left").join(by_id, "_ref", "left").withColumn("_original", F.coalesce("_whole", "_short")).drop("_whole", "_short")


def reinflate(blocks: DataFrame, store: DataFrame, tag: str = "tx") -> DataFrame:
    """Texts that begin with a tag or placeholder get the original back, where its id names one text only."""
    ref = F.nullif(F.regexp_extract("text", rf"^\[{tag}:([0-9a-f]{{6}}|[0-9a-f]{{32}})[ \]]", 1), F.lit(""))
    marked = blocks.withColumn("_ref", ref)
    found = _by_ref(marked.where("_ref is not null"), store).withColumn("text", F.coalesce("_original", "text")).select(*blocks.columns)
    return found.unionByName(marked.where("_ref is null").select(*blocks.columns))


#: Answers of a model in two shapes: blocks of content, or choices with calls.
ANSWER = (
    "struct<content:array<struct<type:string,name:string,input:string>>,"
    "choices:array<struct<message:struct<tool_calls:array<struct<function:struct<name:string,arguments:string>>>>>>>"
)


def calls_in(answers: DataFrame, body_col: str = "body") -> DataFrame:
    """A row for each tool call in answers (JSON), with ``name`` and ``input`` (JSON) and the other columns."""
    parsed = answers.withColumn("_a", F.from_json(body_col, ANSWER))
    empty = F.array().cast("array<struct<name:string,input:string>>")
    blocks = F.transform(F.filter("_a.content", lambda b: b["type"] == "tool_use"), lambda b: F.struct(b["name"].alias("name"), b["input"].alias("input")))
    choices = F.flatten(F.transform("_a.choices", lambda c: F.transform(c["message"]["tool_calls"], lambda x: F.struct(x["function"]["name"].alias("name"), x["function"]["arguments"].alias("input")))))
    return parsed.select(*[c for c in answers.columns if c != body_col], F.inline(F.concat(F.coalesce(blocks, empty), F.coalesce(choices, empty))))


def expand_calls(calls: DataFrame, store: DataFrame) -> DataFrame:
    """Calls of the tool ``expand`` (``name``, ``input`` as JSON with an id or hash) with ``found`` and the original."""
    asked = calls.where("name = 'expand'").withColumn("_ref", F.get_json_object("input", "$.id"))
    found = _by_ref(asked, store).withColumn("found", F.col("_original").isNotNull())
    return found.withColumnRenamed("_ref", "block_id6").withColumnRenamed("_original", "original")


def eligible_mark(cfg: CompactionConfig, block: Column | None = None) -> Column:
    """By the lists of tools (an allow list wins) and the inline skip mark, of a row or of ``block``."""
    of = F.col if block is None else block.getItem
    tool = F.lower(F.coalesce(of("tool"), F.lit("unknown")))
    allowed = tool.isin(*[x.lower() for x in cfg.only_tools]) if cfg.only_tools else ~tool.isin(*[x.lower() for x in cfg.skip_tools]) if cfg.skip_tools else F.lit(True)
    return allowed & ~F.coalesce(of("skip"), F.lit(False))


def eligible(blocks: DataFrame, cfg: CompactionConfig) -> DataFrame:
    return blocks.where(eligible_mark(cfg))


def with_pressure(blocks: DataFrame, context_chars: int = 800_000) -> DataFrame:
    """Adds ``pressure``: the conversation's characters by the context's, at most 1."""
    total = F.sum(F.length("text")).over(Window.partitionBy("conv_id"))
    return blocks.withColumn("pressure", F.least(total / context_chars, F.lit(1.0)))


def threshold_at(pressure: Column, cfg: CompactionConfig) -> Column:
    if cfg.threshold is not None:
        return F.lit(cfg.threshold)
    out = None
    for least, size in cfg.bands:
        out = F.when(pressure >= least, size) if out is None else out.when(pressure >= least, size)
    return out


def with_threshold(blocks: DataFrame, cfg: CompactionConfig) -> DataFrame:
    return blocks.withColumn("threshold", threshold_at(F.col("pressure"), cfg))


def rank_from_end(blocks: DataFrame) -> DataFrame:
    """Adds ``from_end``: 1 for the last block of its kind in a conversation."""
    return blocks.withColumn("from_end", F.row_number().over(Window.partitionBy("conv_id", "kind").orderBy(F.desc("turn"), F.desc("part"))))


#: Roles of the model's own turns in the four shapes.
MODEL_ROLES = ("assistant", "model")


def _last_turns(blocks: DataFrame, most: int) -> DataFrame:
    """``conv_id, _turns``: the last ``most`` turns of each conversation, newest first. Ranks beyond are dropped before the
    exchange, so a conversation of any length brings few rows."""
    nth = F.dense_rank().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return blocks.select("conv_id", "turn").withColumn("_n", nth).where(F.col("_n") <= max(1, most)).groupBy("conv_id").agg(F.sort_array(F.collect_set("turn"), asc=False).alias("_turns"))


def _beyond(turn: Column, turns: Column, spared: int) -> Column:
    """Whether a turn is older than the last ``spared``; where there are no more than these, none is."""
    return F.lit(True) if spared <= 0 else F.coalesce(turn < F.get(turns, F.lit(spared - 1)), F.lit(False))


#: What ``to_conversations`` gives: a row for each conversation, its blocks an array of the row.
NESTED = "blocks"


def _each(blocks: str) -> Column:
    """A row for each block of an array. Of a bare column Spark would first ask for its size, by working out once more what is in it."""
    return F.inline(F.when(F.size(blocks) > 0, F.col(blocks)))


def _bounds(cfg: CompactionConfig) -> Column:
    """What decides the place of blocks in their conversation, worked out within its row."""
    blocks = F.col(NESTED)
    turns = lambda among: F.transform(F.filter(blocks, among) if among else blocks, lambda b: b["turn"])
    model, user = turns(lambda b: b["role"].isin(*MODEL_ROLES)), turns(lambda b: b["role"] == "user")
    results = F.transform(F.filter(blocks, lambda b: (b["kind"] == "tool_result") & eligible_mark(cfg, b)), lambda b: F.struct(b["turn"], b["part"]))
    fields = {
        "chars": F.aggregate(blocks, F.lit(0).cast("long"), lambda n, b: n + F.coalesce(F.length(b["text"]), F.lit(0))),
        "last": F.array_max(turns(None)),
        "model": F.array_max(model),
        "user": F.array_max(user),
        "models": F.slice(F.sort_array(F.array_distinct(model), asc=False), 1, max(1, cfg.prose_recent, cfg.keep_recent)),
        "cut": F.get(F.sort_array(results, asc=False), F.lit(max(1, cfg.keep_recent) - 1)),
    }
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def _flat_bounds(blocks: DataFrame, cfg: CompactionConfig) -> DataFrame:
    """The same for conversations whose blocks are rows: by partial aggregates and ranks that are cut off early."""
    model, user = F.col("role").isin(*MODEL_ROLES), F.col("role") == "user"
    bounds = blocks.groupBy("conv_id").agg(F.sum(F.length("text")).alias("chars"), F.max("turn").alias("last"), F.max(F.when(model, F.col("turn"))).alias("model"), F.max(F.when(user, F.col("turn"))).alias("user"))
    models = _last_turns(blocks.where(model), max(cfg.prose_recent, cfg.keep_recent)).withColumnRenamed("_turns", "models")
    nth, most = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("part"))), max(1, cfg.keep_recent)
    recent = blocks.where((F.col("kind") == "tool_result") & eligible_mark(cfg)).select("conv_id", "turn", "part").withColumn("_n", nth).where(F.col("_n") <= most)
    results = recent.groupBy("conv_id").agg(F.when(F.count(F.lit(1)) >= most, F.min(F.struct("turn", "part"))).alias("cut"))
    for more in (models, results):
        own = more.withColumnRenamed("conv_id", "_c")
        bounds = bounds.join(own, F.col("conv_id").eqNullSafe(F.col("_c")), "left").drop("_c")
    return bounds.select(F.col("conv_id").alias("_c"), F.struct("chars", "last", "model", "user", "models", "cut").alias("_b"))


def _place(cfg: CompactionConfig, bounds: Column) -> dict[str, Column]:
    """The columns that ``in_context`` adds, by a conversation's bounds."""
    model, user, turn, is_result = F.col("role").isin(*MODEL_ROLES), F.col("role") == "user", F.col("turn"), F.col("kind") == "tool_result"
    pressure, ok = F.least(bounds["chars"] / cfg.context_chars, F.lit(1.0)), eligible_mark(cfg)
    past = F.lit(True) if cfg.keep_recent <= 0 else F.struct("turn", "part") < bounds["cut"]
    new = {None: F.lit(True), "last_message": turn == bounds["last"], "after_model": turn > F.coalesce(bounds["model"], F.lit(-1))}[cfg.new_rule]
    old = F.when(model, _beyond(turn, bounds["models"], cfg.prose_recent)).when(user, turn < bounds["user"]).otherwise(False)
    flags = {
        "old_result": is_result & ok & F.coalesce(past, F.lit(False)),
        "new": new,
        "old_prose": (F.col("kind") == "text") & old & (F.length("text") >= cfg.prose_min),
        "old_input": (F.col("kind") == "tool_use") & model & _beyond(turn, bounds["models"], cfg.keep_recent),
    }
    return {"ok": ok, "pressure": pressure, "threshold": threshold_at(pressure, cfg)} | {k: F.coalesce(v, F.lit(False)) for k, v in flags.items()}


def in_context(blocks: DataFrame, cfg: CompactionConfig) -> DataFrame:
    """Adds what a block's place in its conversation decides: ``pressure``, ``threshold``, ``ok`` (tools' lists and skip mark),
    ``old_result`` (eligible, and not among the last ``keep_recent`` eligible ones), ``new`` (by ``cfg.new_rule``), ``old_prose``, ``old_input``.

    Messages count by role, whatever they hold, so the live message of a user is spared also where it is a result only. Of
    conversations that are a row each nothing is exchanged; else a conversation's bounds are joined to its blocks."""
    if NESTED in blocks.columns:
        known = blocks.select("conv_id", _bounds(cfg).alias("_b"), NESTED).select("conv_id", "_b", _each(NESTED))
    else:
        known = blocks.join(_flat_bounds(blocks, cfg), F.col("conv_id").eqNullSafe(F.col("_c")), "left").drop("_c")
    return known.withColumns(_place(cfg, F.col("_b"))).drop("_b")


def _large(place: dict[str, Column] | None = None) -> Column:
    of = F.col if place is None else place.__getitem__
    return of("old_result") & (F.length("text") >= of("threshold"))


def _fresh(cfg: CompactionConfig, new: Column | None = None) -> Column:
    """What a summariser may see, other than a stored summary's text: new results, but of no tool that gets no summary."""
    return (F.col("new") if new is None else new) & ~F.lower(F.coalesce("tool", F.lit(""))).isin(*cfg.no_summary)


def select_candidates(blocks: DataFrame, cfg: CompactionConfig) -> DataFrame:
    """Old, large, eligible tool results that a summariser may see. ``cfg.new_rule`` keeps only new ones: those of the last
    message, or those after the model's last turn."""
    return in_context(blocks, cfg).where(_large() & _fresh(cfg))


def count_candidates(conversations: DataFrame, settings: dict[str, CompactionConfig]) -> DataFrame:
    """``rule, n``: how many results ``select_candidates`` gives by each setting, of conversations that are a row each, in one pass
    over them."""
    bounds = [_bounds(cfg).alias(f"_b{k}") for k, cfg in enumerate(settings.values())]
    places = [(cfg, _place(cfg, F.col(f"_b{k}"))) for k, cfg in enumerate(settings.values())]
    blocks = conversations.select(*bounds, NESTED).select(*[f"_b{k}" for k in range(len(bounds))], _each(NESTED)).where("kind = 'tool_result'")
    counts = [F.count_if(_large(at) & _fresh(cfg, at["new"])).alias(f"n{k}") for k, (cfg, at) in enumerate(places)]
    rows = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"n{k}").alias("n")) for k, name in enumerate(settings)])
    return blocks.agg(*counts).select(F.inline(rows))


def prose_candidates(blocks: DataFrame, roles: str | tuple[str, ...], keep_recent: int, min_len: int) -> DataFrame:
    """Texts of a role but those of its last ``keep_recent`` messages."""
    own = blocks.where(F.col("role").isin(*((roles,) if isinstance(roles, str) else roles)))
    turns = _last_turns(own, keep_recent).withColumnRenamed("conv_id", "_c")
    texts = own.where((F.col("kind") == "text") & (F.length("text") >= min_len)).join(turns, F.col("conv_id").eqNullSafe(F.col("_c")), "left")
    return texts.where(_beyond(F.col("turn"), F.col("_turns"), keep_recent)).drop("_c", "_turns")


def shorter_prose(cleaned: Column, was: Column) -> Column:
    """The prose rules on a cleaned text; the text as it was where that gets no shorter."""
    return t.shorter(t.clean_prose(cleaned), was)


def clean_prose_blocks(blocks: DataFrame, id_col: str = "block_id") -> DataFrame:
    """``block_id, text``: the base clean, then the prose rules; a text that gets no shorter stays as it is."""
    made = clean(blocks.withColumn("_was", F.col("text")), id_col=id_col, keep=("_was",))
    return made.select("block_id", shorter_prose(F.col("text"), F.col("_was")).alias("text"))


def _written_back(min_len: int) -> Column:
    """A tool's input (JSON) with those long fields replaced which the base clean makes shorter; null where it makes none so. An input is
    first written as Spark writes JSON, so that what is replaced stands in it, however it was escaped before."""
    quoted = lambda x: t.let(F.to_json(F.struct(x.alias("x"))), lambda w: F.substring(w, F.lit(6), F.length(w) - 6))
    pair = lambda x: t.let(cleaned(x["value"], F.lit(False)), lambda made: F.when(F.length(made) < F.length(x["value"]), F.struct(x["field"].alias("field"), quoted(x["value"]).alias("old"), quoted(made).alias("new"))))
    pairs = F.array_sort(F.filter(F.transform(input_fields(min_len), pair), lambda p: p.isNotNull()))
    canonical = F.coalesce(F.to_json(F.try_parse_json("text")), F.col("text"))
    return t.let(pairs, lambda ps: F.when(F.size(ps) > 0, F.aggregate(ps, canonical, lambda acc, p: F.replace(acc, p["old"], p["new"]))))


def block_id() -> Column:
    return F.concat_ws(":", "conv_id", "turn", "part")


def clean_tool_inputs(blocks: DataFrame, keep_recent: int = 3, min_len: int = 200) -> DataFrame:
    """``block_id, text`` with ``conv_id, turn, part``: inputs (JSON) of the model's older messages whose long fields the base clean makes
    shorter, written back. A row stays a row."""
    own = in_context(blocks, CompactionConfig(keep_recent=keep_recent)).where("old_input")
    made = own.select(block_id().alias("block_id"), _written_back(min_len).alias("_made"), "conv_id", "turn", "part")
    # Inline, as a filter would work each text out once more.
    return made.select("block_id", "conv_id", "turn", "part", F.explode(F.filter(F.array("_made"), lambda x: x.isNotNull())).alias("text"))


def split_known(blocks: DataFrame, summaries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks with a stored summary, and those without."""
    hashed = blocks if "hash" in blocks.columns else blocks.withColumn("hash", F.md5("text"))
    return hashed.join(summaries.select("hash", "summary"), "hash"), hashed.join(summaries.select("hash"), "hash", "left_anti")


def retain(summaries: DataFrame, max_entries: int = 1000) -> DataFrame:
    """The newest entries; ties by hash."""
    return summaries.orderBy(F.desc("ts"), "hash").limit(max_entries)


def extractive(text: Column) -> Column:
    """A local summary: first and last lines and lines that speak of errors."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    said = F.slice(F.filter(lines, lambda x: x.rlike(r"(?i)\b(error|failed|exception|fatal)\b")), 1, 3)
    return F.array_join(F.array_distinct(F.concat(F.slice(lines, 1, 2), said, F.when(F.size(lines) > 0, F.array(F.element_at(lines, -1))).otherwise(F.array().cast("array<string>")))), "\n")


def summarise(misses: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]] | None = None, limit: int = SUMMARY_INPUT) -> DataFrame:
    """``hash, summary, original_chars``: each distinct text goes to ``fn`` (frames ``hash, text`` to ``hash, summary``;
    null: failed) once, cut to the ``limit`` that a summariser sees; without ``fn`` the local summary of the whole text is taken."""
    distinct = misses.select(F.md5("text").alias("hash"), "text").dropDuplicates(["hash"])
    sizes = distinct.withColumn("original_chars", F.length("text"))
    if fn is None:
        return sizes.select("hash", extractive(F.col("text")).alias("summary"), "original_chars")
    made = sizes.select("hash", F.substring("text", 1, limit).alias("text")).mapInPandas(fn, "hash string, summary string")
    return sizes.select("hash", "original_chars").join(made, "hash", "left")


def tagged(ref: Column, summary: Column, original: Column, tag: str = "tx") -> Column:
    """``[tag:id -R%] summary``."""
    percent = t.half_up((1 - F.length(summary) / original) * 100).cast("string")
    return F.concat(F.lit(f"[{tag}:"), ref, F.lit(" -"), percent, F.lit("%] "), summary)


def compact_prompts(prompts: DataFrame, fn=None, min_len: int = 2000, enough: float = 0.25) -> DataFrame:
    """``hash, text, original_chars, compact_chars, by`` for distinct system prompts: short ones stay, others are cleaned,
    and summarised only where cleaning saves no more than ``enough``."""
    distinct = prompts.select("text").distinct().withColumn("hash", F.md5("text")).withColumn("original_chars", F.length("text"))
    made = clean(distinct.withColumn("_was", F.col("text")), id_col="hash", keep=("_was", "original_chars"))
    cleaned = made.select(F.col("block_id").alias("hash"), F.col("_was").alias("text"), "original_chars", F.col("text").alias("clean"))
    saves = 1 - F.length("clean") / F.col("original_chars")
    marked = cleaned.withColumn("by", F.when(F.col("original_chars") < min_len, "untouched").when(saves > enough, "clean").otherwise("summary"))
    made = summarise(marked.where("by = 'summary'").select(F.col("clean").alias("text")), fn, PROMPT_INPUT).select(F.col("hash").alias("_h"), "summary")
    out = marked.join(made, (F.col("by") == "summary") & (F.md5("clean") == F.col("_h")), "left")
    text = F.when(F.col("by") == "untouched", F.col("text")).when(F.col("by") == "clean", F.col("clean")).otherwise(F.coalesce("summary", "clean"))
    return out.select("hash", text.alias("text"), "original_chars", F.length(text).alias("compact_chars"), "by")


def compact_conversations(blocks: DataFrame, cfg: CompactionConfig = CompactionConfig(), summaries: DataFrame | None = None, fn=None) -> tuple[DataFrame, DataFrame]:
    """Compacted blocks and a row of savings for each block, by one source: dedup, summary, clean, prose or input. ``blocks`` are rows, or
    conversations of ``to_conversations``, of which nothing is exchanged."""
    out, savings, _ = _compacted(blocks, cfg, summaries, fn)
    return out, savings


def compact_growing(blocks: DataFrame, path: str, cfg: CompactionConfig = CompactionConfig(), fn=None) -> tuple[DataFrame, DataFrame]:
    """The same for conversations that are compacted again as they grow: old results take the summaries in the store at ``path``, and
    what the summariser makes this time is appended to it, so a result keeps the tag that it once got."""
    have = stores.opened(blocks.sparkSession, path)
    out, savings, fresh = _compacted(blocks, cfg, have, fn)
    stores.append_new(fresh.where("summary is not null"), path)
    return out, savings


def _repeats(cfg: CompactionConfig) -> Column:
    """A conversation's blocks with ``dup``: a result's hash, where a later one of the conversation has the same text."""
    blocks = F.col(NESTED)
    may = lambda b: (b["kind"] == "tool_result") & eligible_mark(cfg, b) & F.lower(F.coalesce(b["tool"], F.lit(""))).isin(*cfg.dedup_tools) & (F.length(b["text"]) >= cfg.dedup_min)
    keys = F.transform(blocks, lambda b: F.when(may(b), F.md5(b["text"])).otherwise(""))
    # Equal keys stand side by side once they are sorted, the last one behind; sorted back, a mark has its place.
    again = lambda rows, x, i: F.when((x["key"] != "") & (F.get(rows, i + 1)["key"] == x["key"]), x["key"])
    rows = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("key"), i.alias("pos"))))
    marks = t.let(rows, lambda rows: F.sort_array(F.transform(rows, lambda x, i: F.struct(x["pos"].alias("pos"), again(rows, x, i).alias("dup")))))
    return F.arrays_zip(blocks, F.transform(marks, lambda m: m["dup"]))


def _placed(blocks: DataFrame, cfg: CompactionConfig) -> DataFrame:
    """Blocks in their context with ``dup``: the hash of a result that a later one repeats."""
    if NESTED in blocks.columns:
        # In two steps, as what stands beside a generator is worked out behind it, for each block.
        known = blocks.select("conv_id", _bounds(cfg).alias("_b"), _repeats(cfg).alias("_r")).select("conv_id", "_b", _each("_r").alias("_x", "dup")).select("conv_id", "_b", "_x.*", "dup")
        return known.withColumns(_place(cfg, F.col("_b"))).drop("_b")
    # Stored, as their context reads them four times, and with it again for the repeats.
    keyed = stored(in_context(stored(blocks, "blocks", packed=True), cfg), "context", packed=True)
    may = (F.col("kind") == "tool_result") & F.col("ok") & F.lower(F.coalesce("tool", F.lit(""))).isin(*cfg.dedup_tools)
    found = dedup_blocks(keyed.where(may), min_len=cfg.dedup_min).where("kept_ref is not null").select(block_id().alias("_id"), F.col("hash").alias("dup"))
    return keyed.join(found, block_id() == F.col("_id"), "left").drop("_id")


def _compacted(blocks: DataFrame, cfg: CompactionConfig, summaries: DataFrame | None, fn) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Compacted blocks, savings, and the summaries made.

    Old, large results take a stored summary where ``summaries`` (``hash, summary``) has one; of the others only those that the
    new-block rule and the tools' list allow go to the summariser, each text once. ``overhead`` is the length of the tag in front of
    a summary. Where the shapes differ in what they spare, ``cfg.for_shape`` says so.

    A block stays a row from its context through clean and classification to what replaces it; that is stored once. Texts are joined to
    summaries by their hash only, and savings need sizes only, so no text is exchanged for them."""
    from txcompact.operators.rules import classified, left_of

    placed = _placed(blocks, cfg).withColumns({"was": F.col("text"), "name": F.col("tool")})
    ruled = (F.col("kind") == "tool_result") & F.col("ok")
    # By itself, as expressions in lambdas would take the columns made beside it for their own.
    asked = placed.withColumn("input", F.when(F.col("old_input"), _written_back(200)))
    asked = asked.withColumns({"block_id": block_id(), "tool": F.when(ruled, F.col("tool")), "text": F.when(ruled | F.col("old_prose"), F.col("text"))})
    kept = ("conv_id", "turn", "part", "kind", "role", "name", "call_id", "skip", "was", "input", "ok", "pressure", "threshold", "old_result", "new", "old_prose", "dup")
    clean_ = classified(asked, keep=kept)
    # Of a text that the clean leaves as it is no second copy is stored.
    changed = F.nullif(F.when(F.col("ok") & (F.col("kind") == "tool_result"), F.col("text")), F.col("was"))
    other = F.when(F.col("old_prose"), shorter_prose(F.col("text"), F.col("was"))).otherwise(F.col("input"))
    rows = stored(clean_.select("block_id", *[c for c in kept if c != "input"], "pattern", changed.alias("clean"), other.alias("other")), "placed", packed=True)

    found = rows.withColumns({"text": F.coalesce("clean", "was"), "hash": F.md5("was")})
    found = found.withColumns({"made": left_of(found), "tool": F.col("name")}).drop("clean", "name", "pattern").withColumn("text", F.col("was")).drop("was")
    sizes = {"chars": F.length("text"), "made_chars": F.length("made"), "other_chars": F.length("other")}
    found = found.withColumns(sizes | {"chosen": F.coalesce(_large() & F.col("dup").isNull(), F.lit(False)), "fresh": _fresh(cfg)})
    # Without a summariser's function a summary is made from the row itself.
    found = found.withColumn("summary", F.when(F.col("chosen") & F.col("fresh"), extractive(F.col("text"))) if fn is None else F.lit(None).cast("string"))
    here = F.col("hash") == F.col("_h")
    known = None if summaries is None else summaries.select(F.col("hash").alias("_h"), F.col("summary").alias("_s")).dropDuplicates(["_h"]).withColumn("_known", F.lit(True))
    misses = found.where("chosen and fresh")
    fresh = summarise((misses if known is None else misses.join(known, here, "left_anti")).select("text"), fn)
    if fn is not None:
        fresh = stored(fresh, "summaries", packed=True)  # so that no text goes to the summariser again
        made = fresh.select(F.col("hash").alias("_h"), F.col("summary").alias("_s")).withColumn("_known", F.lit(False))
        known = made if known is None else known.unionByName(made)
    if known is not None:
        takes = F.col("_known") | (F.col("_known").isNotNull() & F.col("fresh"))
        looked_up = found.where("chosen").join(known, here, "left").withColumn("summary", F.when(takes, F.col("_s")).otherwise(F.col("summary"))).drop("_h", "_s", "_known")
        found = looked_up.unionByName(found.where("not chosen"))

    by, is_result = F.col("by"), F.col("kind") == "tool_result"
    ref = lambda x: F.substring(x, 1, cfg.ref_chars)
    all_ = found.withColumn("short", tagged(ref("hash"), F.col("summary"), F.col("chars"), cfg.tag)).withColumn("short_chars", F.length("short"))
    shorter = lambda x: F.coalesce(F.col(x) < F.col("chars"), F.lit(False))
    source = (
        F.when(is_result & ~F.col("ok"), "none")
        .when(F.col("dup").isNotNull(), "dedup")
        .when(is_result & shorter("short_chars"), "summary")
        .when(is_result & shorter("made_chars"), "clean")
        .when(F.lit(cfg.prose) & (F.col("kind") == "text") & shorter("other_chars"), "prose")
        .when(F.lit(cfg.prose) & (F.col("kind") == "tool_use") & shorter("other_chars"), "input")
        .otherwise("none")
    )
    gone = placeholder(F.col("tool"), ref("dup"), cfg.tag)
    text = F.when(by == "dedup", gone).when(by == "summary", F.col("short")).when(by == "clean", F.col("made")).when(by.isin("prose", "input"), F.col("other")).otherwise(F.col("text"))
    chars = F.when(by == "dedup", F.length(gone)).when(by == "summary", F.col("short_chars")).when(by == "clean", F.col("made_chars")).when(by.isin("prose", "input"), F.col("other_chars")).otherwise(F.col("chars"))
    out = all_.withColumn("by", source)
    overhead = F.when(by == "summary", F.col("short_chars") - F.length("summary")).otherwise(0)
    savings = out.select("conv_id", "turn", "part", "tool", by.alias("source"), F.col("chars").alias("original_chars"), chars.alias("compact_chars"), (F.col("chars") - chars).alias("saved_chars"), overhead.alias("overhead"))
    return out.select("conv_id", "turn", "part", "kind", "role", "tool", "call_id", text.alias("text"), "skip"), savings, fresh


#: Variants of a training pair; the share of non-blank lines is that of the local summary.
VARIANTS = (("conservative", 0.65), ("balanced", 0.45), ("aggressive", 0.25))


def training_pairs(texts: DataFrame, fn=None, min_len: int = 10) -> DataFrame:
    """``hash, text, variant, compressed, ratio`` for each distinct text and variant, ready for ``write.json``.

    ``fn`` maps frames ``hash, variant, text`` to ``hash, variant, compressed`` (null: failed); without it a variant is the text's first non-blank lines."""
    distinct = texts.select(F.md5("text").alias("hash"), "text").dropDuplicates(["hash"]).where(F.length("text") >= min_len)
    named = F.array(*[F.struct(F.lit(v).alias("variant"), F.lit(k).alias("share")) for v, k in VARIANTS])
    rows = distinct.select("hash", "text", F.inline(named))
    if fn is None:
        lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
        made = rows.withColumn("compressed", F.array_join(F.slice(lines, F.lit(1), F.ceil(F.size(lines) * F.col("share")).cast("int")), "\n"))
    else:
        made = rows.join(rows.select("hash", "variant", "text").mapInPandas(fn, "hash string, variant string, compressed string"), ["hash", "variant"], "left")
    return made.select("hash", "text", "variant", "compressed", (1 - F.length("compressed") / F.length("text")).alias("ratio"))
