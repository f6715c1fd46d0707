"""Adapters from transcript shapes to the table of text blocks, and usage from event streams.

``blocks``: conv_id, turn, part, kind (tool_result, tool_use, text, other), role, tool, call_id, text, skip.

A message's content may be a string or a list of parts, and so may a result's; both are read as variants. Text parts of one
result are joined by newlines. A message without any text keeps its place by a block of kind ``other`` without text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txcompact.functions.text import let
from txcompact.operators.blocks import by_key, cut, spans

SKIP = r"(?i)#\s*tx:\s*skip"
CALLS = "array<struct<id:string,name:string,arguments:string,function:struct<name:string,arguments:string>>>"
ANTHROPIC = "conv_id string, messages array<struct<role:string,content:variant>>"
OPENAI = f"conv_id string, messages array<struct<role:string,content:variant,tool_call_id:string,tool_calls:{CALLS}>>"
GEMINI = "conv_id string, contents array<struct<role:string,parts:array<struct<text:string,functionCall:struct<name:string,args:variant>,functionResponse:struct<name:string,response:variant>>>>>"
RESPONSES = "conv_id string, input variant, messages variant"
SCHEMAS = {"anthropic": ANTHROPIC, "openai": OPENAI, "gemini": GEMINI, "responses": RESPONSES}
#: An item of the responses form, or a chat message in its place.
ITEM = f"struct<type:string,role:string,call_id:string,tool_call_id:string,name:string,arguments:string,output:variant,content:variant,tool_calls:{CALLS}>"
#: Types of parts that hold text.
TEXT_PARTS = ("text", "input_text", "output_text")


def _list(v: Column, of: str = "variant") -> Column:
    """A variant's elements; null where it is no list."""
    return F.try_variant_get(v, "$", f"array<{of}>")


def _field(v: Column, name: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def content_text(v: Column) -> Column:
    """A string as it is, the text parts of a list joined by newlines, anything else as JSON."""
    texts = F.transform(F.filter(_list(v), lambda p: _field(p, "type").isin(*TEXT_PARTS)), lambda p: F.coalesce(_field(p, "text"), F.lit("")))
    return F.when(_list(v).isNotNull(), F.array_join(texts, "\n")).otherwise(F.try_variant_get(v, "$", "string"))


def _block(part: Column | int, kind: Column | str, tool: Column | None, call: Column | None, text: Column) -> Column:
    none = F.lit(None).cast("string")
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    fields = {"part": lit(part).cast("int"), "kind": lit(kind).cast("string"), "tool": none if tool is None else tool, "call_id": none if call is None else call, "text": text}
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def _called(calls: Column) -> Column:
    """A block for each entry of ``tool_calls``, behind the message's own."""
    name, given = lambda c: F.coalesce(c["function"]["name"], c["name"]), lambda c: F.coalesce(c["function"]["arguments"], c["arguments"])
    return F.transform(calls, lambda c, i: _block(i + 1, "tool_use", name(c), c["id"], given(c)))


def _anthropic(m: Column) -> Column:
    def block(p: Column, i: Column) -> Column:
        kind = _field(p, "type")
        text = F.when(kind == "tool_result", content_text(_field(p, "content", "variant"))).when(kind == "tool_use", content_text(_field(p, "input", "variant"))).otherwise(_field(p, "text"))
        return _block(i, kind, _field(p, "name"), F.coalesce(_field(p, "tool_use_id"), _field(p, "id")), text)

    return F.when(_list(m["content"]).isNotNull(), F.transform(_list(m["content"]), block)).otherwise(F.array(_block(0, "text", None, None, content_text(m["content"]))))


def _chat(m: Column, call: Column, tool: Column, text: Column) -> Column:
    """A chat message, its text first and then its calls."""
    own = F.array(_block(0, F.when(tool, "tool_result").otherwise("text"), None, call, text))
    return F.when(m["tool_calls"].isNull(), own).otherwise(F.concat(own, _called(m["tool_calls"])))


def _gemini(m: Column) -> Column:
    def block(p: Column, i: Column) -> Column:
        answer, call = p["functionResponse"], p["functionCall"]
        kind = F.when(answer.isNotNull(), "tool_result").when(call.isNotNull(), "tool_use").otherwise("text")
        said = lambda v: F.try_variant_get(v, "$", "string")
        return _block(i, kind, F.coalesce(answer["name"], call["name"]), None, F.coalesce(said(answer["response"]), said(call["args"]), p["text"]))

    return F.transform(m["parts"], block)


def _response(m: Column) -> Column:
    result = (m["type"] == "function_call_output") | m["role"].isin("tool", "function")
    call, calls = F.coalesce(m["call_id"], m["tool_call_id"]), m["type"] == "function_call"
    one = _block(0, F.when(calls, "tool_use").otherwise("text"), m["name"], call, F.coalesce(m["arguments"], content_text(m["content"])))
    text = F.coalesce(content_text(m["output"]), content_text(m["content"]))
    return F.when(F.coalesce(result, F.lit(False)) | m["tool_calls"].isNotNull(), _chat(m, call, F.coalesce(result, F.lit(False)), text)).otherwise(F.array(one))


def attach_calls(blocks: DataFrame) -> DataFrame:
    """Results take name and skip mark of the call with their id; without one the tool is ``unknown``."""
    calls = blocks.where("kind = 'tool_use' and call_id is not null").groupBy("conv_id", "call_id").agg(F.max_by("tool", F.struct("turn", "part")).alias("called"), F.max(F.coalesce(F.col("text"), F.lit("")).rlike(SKIP)).alias("marked"))
    joined = blocks.join(calls, ["conv_id", "call_id"], "left")
    is_result = F.col("kind") == "tool_result"
    return joined.select(
        "conv_id", "turn", "part", "kind", "role", F.when(is_result, F.coalesce("called", "tool", F.lit("unknown"))).otherwise(F.col("tool")).alias("tool"), "call_id", "text", (is_result & F.coalesce("marked", F.lit(False))).alias("skip")
    )


def _shaped(shape: str) -> tuple[Column, Callable[[Column], Column]]:
    """A transcript's messages, and the blocks of a message."""
    if shape == "anthropic":
        return F.col("messages"), _anthropic
    if shape == "openai":
        return F.col("messages"), lambda m: _chat(m, m["tool_call_id"], F.coalesce(m["role"] == "tool", F.lit(False)), content_text(m["content"]))
    if shape == "gemini":
        return F.col("contents"), _gemini
    if shape != "responses":
        raise ValueError(f"unknown shape {shape!r}: one of {sorted(SCHEMAS)}")
    # Items, or chat messages in their place; a lone string is a user's message.
    alone = F.array(F.parse_json(F.to_json(F.struct(F.lit("user").alias("role"), F.try_variant_get("input", "$", "string").alias("content")))))
    items = F.coalesce(_list(F.col("input")), F.when(F.try_variant_get("input", "$", "string").isNotNull(), alone), _list(F.col("messages")))
    return F.transform(items, lambda v: F.from_json(v.cast("string"), ITEM)), _response


def _told(found: Column) -> Column:
    """Blocks with a text, or one of kind ``other``."""
    silent = F.array(_block(0, "other", None, None, F.lit("")))
    return let(F.filter(found, lambda b: F.length(b["text"]) > 0), lambda said: F.when(F.size(said) > 0, said).otherwise(silent))


def to_blocks(df: DataFrame, shape: str) -> DataFrame:
    """Transcripts of one of the shapes in ``SCHEMAS`` as blocks. Empty texts are left out; a message that has no other text
    leaves one block of kind ``other``."""
    turns, found = _shaped(shape)
    messages = df.select("conv_id", F.posexplode(turns).alias("turn", "m"))
    each = messages.select("conv_id", "turn", F.col("m.role").alias("role"), F.inline(_told(found(F.col("m")))))
    return attach_calls(each.select("conv_id", "turn", "part", "kind", "role", "tool", "call_id", "text"))


def _call_of_each(blocks: Column) -> Column:
    """``pos, called, marked`` for each block (bound), in order: name and skip mark of the calls with its id; nulls where there is none."""

    def calls(rows: Column, starts: Column) -> Column:
        at = lambda x: F.get(blocks, x["pos"])

        def told(own: Column, made: Column) -> Column:
            marked = F.exists(made, lambda x: F.coalesce(at(x)["text"], F.lit("")).rlike(SKIP))
            last = let(at(F.try_element_at(made, F.lit(-1)))["tool"], lambda tool: let(marked, lambda m: F.transform(own, lambda x: F.struct(x["pos"].alias("pos"), tool.alias("called"), m.alias("marked")))))
            return F.when(F.size(made) > 0, last).otherwise(F.transform(own, lambda x: F.struct(x["pos"].alias("pos"), F.lit(None).cast("string").alias("called"), F.lit(False).alias("marked"))))

        group = lambda s, n, j: let(cut(rows, s, n), lambda own: let(F.filter(own, lambda x: (x["key"] != "") & (at(x)["kind"] == "tool_use")), lambda made: told(own, made)))
        return F.sort_array(F.flatten(spans(starts, F.size(rows), group)))

    return by_key(F.transform(blocks, lambda b: F.coalesce(F.concat(F.lit("c"), b["call_id"]), F.lit(""))), calls)


def to_conversations(df: DataFrame, shape: str) -> DataFrame:
    """Transcripts, a row each, as ``conv_id, blocks``: an array of what ``to_blocks`` gives, in order. Calls are found within the row, so
    nothing is exchanged; a conversation must not be spread over rows."""
    turns, found = _shaped(shape)
    names = ("part", "kind", "tool", "call_id", "text")
    of_turn = lambda m, turn: F.transform(_told(found(m)), lambda b: F.struct(turn.alias("turn"), m["role"].alias("role"), *[b[n].alias(n) for n in names]))

    def named(b: Column, call: Column) -> Column:
        is_result = b["kind"] == "tool_result"
        fields = {n: b[n] for n in ("turn", "part", "kind", "role")}
        fields |= {"tool": F.when(is_result, F.coalesce(call["called"], b["tool"], F.lit("unknown"))).otherwise(b["tool"]), "call_id": b["call_id"], "text": b["text"]}
        return F.struct(*[v.alias(k) for k, v in fields.items()], F.coalesce(is_result & call["marked"], F.lit(False)).alias("skip"))

    whole = let(F.flatten(F.transform(turns, of_turn)), lambda bs: let(_call_of_each(bs), lambda calls: F.transform(bs, lambda b, i: named(b, F.get(calls, i)))))
    return df.select("conv_id", whole.alias("blocks"))


def _parsed(bodies: DataFrame, shape: str, body_col: str) -> DataFrame:
    fields = SCHEMAS[shape].split(", ", 1)[1].replace(" array", ":array").replace(" variant", ":variant")
    return bodies.select("conv_id", F.from_json(body_col, f"struct<{fields}>").alias("_b")).select("conv_id", "_b.*")


def blocks_of_json(bodies: DataFrame, shape: str, body_col: str = "body") -> DataFrame:
    """Request bodies (``conv_id``, JSON text) of a shape as blocks; bodies that do not parse give none."""
    return to_blocks(_parsed(bodies, shape, body_col), shape)


def conversations_of_json(bodies: DataFrame, shape: str, body_col: str = "body") -> DataFrame:
    """The same as ``to_conversations`` gives it: a body is a whole conversation."""
    return to_conversations(_parsed(bodies, shape, body_col), shape)


def from_turns(turns: DataFrame) -> DataFrame:
    """Plain turns (conv_id, turn, role, text) as blocks of text."""
    return turns.select("conv_id", F.col("turn").cast("int").alias("turn"), F.lit(0).alias("part"), F.lit("text").alias("kind"), "role", F.lit(None).cast("string").alias("tool"), F.lit(None).cast("string").alias("call_id"), "text", F.lit(False).alias("skip"))


def input_fields(min_len: int = 200) -> Column:
    """``field, value`` of the long fields of a tool's input (JSON), of rows with ``tool`` and ``text``."""
    fields = {"bash": ["command"], "edit": ["old_string", "new_string"], "write": ["content"], "notebookedit": ["new_source"]}  # fixed values
    tool = F.lower("tool")
    plain = [F.when(tool == t, F.struct(F.lit(f).alias("field"), F.get_json_object("text", f"$.{f}").alias("value"))) for t, names in fields.items() for f in names]
    edits = F.from_json(F.get_json_object("text", "$.edits"), "array<struct<old_string:string,new_string:string>>")
    multi = F.when(tool == "multiedit", F.flatten(F.transform(edits, lambda e, i: F.array(F.struct(F.concat(F.lit("edits."), i, F.lit(".old_string")).alias("field"), e["old_string"].alias("value")), F.struct(F.concat(F.lit("edits."), i, F.lit(".new_string")).alias("field"), e["new_string"].alias("value"))))))
    every = F.concat(F.array(*plain), F.coalesce(multi, F.array().cast("array<struct<field:string,value:string>>")))
    return F.filter(every, lambda x: x.isNotNull() & (F.length(x["value"]) >= min_len))


def tool_input_fields(blocks: DataFrame, min_len: int = 200) -> DataFrame:
    """Long fields of tool inputs (JSON): ``conv_id, turn, part, tool, field, value``."""
    return blocks.where("kind = 'tool_use'").select("conv_id", "turn", "part", "tool", F.inline(input_fields(min_len)))


def stitched_lines(chunks: DataFrame, by: list[str], order: str, chunk: str) -> DataFrame:
    """``by``, ``no`` and ``line``: whole lines of texts that came in chunks cut anywhere; a last line without its end is not given.

    A line's number is the count of line ends before it, so only counts pass the window; its pieces then meet by number."""
    pieces = chunks.select(*by, order, F.split(F.coalesce(F.col(chunk), F.lit("")), "\n", -1).alias("_p"))
    ends = F.sum(F.size("_p") - 1).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counts = pieces.select(*by, order, (F.size("_p") - 1).alias("_n"), "_p").withColumn("_before", ends - F.col("_n"))
    total = F.max(F.col("_before") + F.col("_n")).over(Window.partitionBy(*by))
    each = counts.withColumn("_all", total).select(*by, order, "_before", "_all", F.posexplode("_p").alias("_k", "piece")).withColumn("no", F.col("_before") + F.col("_k"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "piece"))), lambda x: x["piece"]), "")
    return each.where(F.col("no") < F.col("_all")).groupBy(*by, "no").agg(joined.alias("line"))


USAGE = "struct<type:string,message:struct<usage:struct<input_tokens:long,output_tokens:long>>,usage:struct<input_tokens:long,output_tokens:long,prompt_tokens:long,completion_tokens:long>,usageMetadata:struct<promptTokenCount:long,candidatesTokenCount:long>>"


def usage_from_events(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """Adds ``input_tokens, output_tokens`` to event-stream lines (``data: {json}``) that carry usage. Works on streams."""
    data = lines.where(F.col(line_col).startswith("data: ") & ~F.col(line_col).contains("[DONE]")).withColumn("_e", F.from_json(F.expr(f"substring({line_col}, 7)"), USAGE))
    both = data.withColumn("input_tokens", F.coalesce("_e.message.usage.input_tokens", "_e.usage.input_tokens", "_e.usage.prompt_tokens", "_e.usageMetadata.promptTokenCount")).withColumn("output_tokens", F.coalesce("_e.usage.output_tokens", "_e.usage.completion_tokens", "_e.usageMetadata.candidatesTokenCount", "_e.message.usage.output_tokens"))
    return both.where("input_tokens is not null or output_tokens is not null").drop("_e")
