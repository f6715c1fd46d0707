"""Transcripts as clients write them: string and list content side by side, several tools, skip marks and stored summaries."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txcompact.config import CompactionConfig
from txcompact.operators import compact as c
from txcompact.plans.compaction import COMMAND, CONTEXT, N, ORDERS, SAID, SHORT_SAID, lines_of, of_each_order
from txcompact.plans.outputs import customers
from txcompact.plans.queries import query, read
from txcompact.sources.steps import shared_dir, stored
from txcompact.sources.transcripts import blocks_of_json, conversations_of_json

#: How the turn of a conversation is written: as a string, as two text parts, as a result with a string or with parts
#: around a picture, or as a picture alone.
FORM = "turn % 5"


def _cut(text: Column) -> tuple[Column, Column]:
    half = F.floor(F.length(text) / 2).cast("int")
    return F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text))


def _object(**fields: Column) -> Column:
    """A JSON object as text; a value is JSON text already. Fields whose value is null are left out."""
    each = [F.concat(F.lit(f'"{k}":'), v) for k, v in fields.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *each), F.lit("}"))


def _string(x: Column) -> Column:
    """A JSON string."""
    whole = F.to_json(F.struct(x.alias("x")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def _array(*items: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *items), F.lit("]"))


def _bodies(turns: DataFrame, message: Column, name: str) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", message.alias("m")))), lambda x: x["m"])
    return turns.groupBy(F.col("conv_id").cast("string").alias("conv_id")).agg(F.concat(F.lit(f'{{"{name}":['), F.array_join(ordered, ","), F.lit("]}")).alias("body"))


def _mixed(turns: DataFrame, shape: str) -> DataFrame:
    """The turns as request bodies of a shape, their content in the form that ``FORM`` names."""
    q = lambda x: F.lit(f'"{x}"')
    role, form = F.col("role"), F.expr(FORM)
    first, second = _cut(F.col("text"))
    part = lambda x, kind="text": _object(type=q(kind), text=_string(x))
    picture, whole, call = _object(type=q("image")), _string(F.col("text")), _string(F.concat(F.lit("c"), F.col("turn").cast("string")))
    spread = _array(part(first), picture, part(second))
    result = form.isin(2, 3)
    if shape == "anthropic":
        answer = _object(type=q("tool_result"), tool_use_id=call, content=F.when(form == 2, whole).otherwise(spread))
        content = F.when(form == 0, whole).when(form == 1, _array(part(first), part(second))).when(result, _array(answer)).otherwise(_array(picture))
        return _bodies(turns, _object(role=_string(role), content=content), "messages")
    if shape == "openai":
        content = F.when(form.isin(0, 2), whole).when(form == 4, _array(picture)).otherwise(spread)
        return _bodies(turns, _object(role=F.when(result, q("tool")).otherwise(_string(role)), tool_call_id=F.when(result, call), content=content), "messages")
    if shape == "gemini":
        text = lambda x: _object(text=_string(x))
        answer = _object(functionResponse=_object(name=q("Look"), response=F.when(form == 2, whole).otherwise(_object(output=whole))))
        parts = F.when(form == 0, _array(text(F.col("text")))).when(form == 1, _array(text(first), text(second))).when(result, _array(answer)).otherwise(_array(_object(inlineData=q("x"))))
        return _bodies(turns, _object(role=_string(role), parts=parts), "contents")
    output = _object(type=q("function_call_output"), call_id=call, output=F.when(form == 2, whole).otherwise(_array(part(first, "output_text"), part(second, "output_text"))))
    content = F.when(form == 0, whole).when(form == 4, _array(picture)).otherwise(_array(part(first, "input_text"), part(second, "input_text")))
    item = F.when(result, output).otherwise(_object(type=q("message"), role=_string(role), content=content))
    chat = F.when(result, _object(role=q("tool"), tool_call_id=call, content=whole)).otherwise(_object(role=_string(role), content=content))
    even = turns.where("conv_id % 2 = 0")
    return _bodies(even, item, "input").unionByName(_bodies(turns.where("conv_id % 2 = 1"), chat, "messages"))


HALF = "CAST(floor(length(text) / 2) AS BIGINT)"
JOINED = f"concat(substr(text, 1, {HALF}), {N}, substr(text, {HALF} + 1))"


@query(
    f"""WITH c AS (SELECT CAST(conv_id AS VARCHAR) AS conv_id, conv_id % 2 AS odd, turn, role, text, {FORM} AS form FROM conversations),
t AS (
  SELECT 'anthropic' AS shape, conv_id, turn, 0 AS part, form, CASE form WHEN 1 THEN substr(text, 1, {HALF}) WHEN 3 THEN {JOINED} WHEN 4 THEN '' ELSE text END AS text FROM c
  UNION ALL SELECT 'anthropic', conv_id, turn, 1, form, substr(text, {HALF} + 1) FROM c WHERE form = 1
  UNION ALL SELECT 'openai', conv_id, turn, 0, form, CASE WHEN form IN (1, 3) THEN {JOINED} WHEN form = 4 THEN '' ELSE text END FROM c
  UNION ALL SELECT 'gemini', conv_id, turn, 0, form, CASE form WHEN 1 THEN substr(text, 1, {HALF}) WHEN 3 THEN to_json({{'output': text}})::VARCHAR WHEN 4 THEN '' ELSE text END FROM c
  UNION ALL SELECT 'gemini', conv_id, turn, 1, form, substr(text, {HALF} + 1) FROM c WHERE form = 1
  UNION ALL SELECT 'responses', conv_id, turn, 0, form, CASE WHEN form = 1 OR (form = 3 AND odd = 0) THEN {JOINED} WHEN form = 4 THEN '' ELSE text END FROM c)
SELECT shape, conv_id, CAST(turn AS INTEGER) AS turn, CAST(part AS INTEGER) AS part, CASE WHEN form = 4 THEN 'other' WHEN form IN (2, 3) THEN 'tool_result' ELSE 'text' END AS kind,
  CASE WHEN form NOT IN (2, 3) THEN NULL WHEN shape = 'gemini' THEN 'Look' ELSE 'unknown' END AS tool, md5(text) AS body FROM t WHERE text <> '' OR form = 4"""
)
def transcript_mixed(spark, sf_dir):
    """The conversations in all four shapes with strings, lists of parts and pictures by turns: every message gives its blocks."""
    turns, out = read(spark, sf_dir, "conversations"), None
    for shape in ("anthropic", "openai", "gemini", "responses"):
        got = blocks_of_json(_mixed(turns, shape), shape)
        got = got.select(F.lit(shape).alias("shape"), "conv_id", "turn", "part", "kind", "tool", F.md5("text").alias("body"))
        out = got if out is None else out.unionByName(got)
    return out


TOOL = "['Bash', 'Read', 'Grep', 'WebFetch'][CAST(key % 4 AS INT) + 1]"
MARKED = f"CASE WHEN key % 5 = 0 THEN '# tx: skip ' ELSE '' END || {COMMAND}"
LINES = "CASE WHEN key % 4 = 2 THEN key % 18 + 2 ELSE key % 120 + 2 END"
MANY = f"CASE WHEN i % 3 = 0 THEN 'the common output of ' || blk || repeat(' word', 60) ELSE array_to_string(list_transform(range(1, {LINES}), lambda j: 'plain line ' || key || ' ' || j || ' of this output'), {N}) END"


def tool_conversations(spark: SparkSession, sf_dir: str, without: int = 0) -> DataFrame:
    """A conversation (a row) for each customer with calls of four tools, some marked to be spared; results are strings or lists of
    parts. ``without``: how many of the last calls have not been made yet."""
    lines = lines_of("CASE WHEN key % 4 = 2 THEN key % 18 + 1 ELSE key % 120 + 1 END")
    fields = {"key": "key", "i": "i", "said": SAID, "marked": MARKED, "plain": lines, "common": "'the common output of ' || blk || repeat(' word', 60)"}
    orders = of_each_order(f"named_struct({', '.join(f'{chr(39)}{k}{chr(39)}, {v}' for k, v in fields.items())})")
    q = lambda x: F.lit(f'"{x}"')
    text = lambda x: _object(type=q("text"), text=_string(x))

    def turns(o: Column) -> Column:
        call, plain = _string(F.concat(F.lit("c"), o["key"].cast("string"))), o["plain"]
        tool = F.get(F.array(*[F.lit(x) for x in ("Bash", "Read", "Grep", "WebFetch")]), (o["key"] % 4).cast("int"))
        asked = _array(text(o["said"]), _object(type=q("tool_use"), id=call, name=_string(tool), input=_object(command=_string(o["marked"]))))
        cut = F.instr(plain, "\n")
        listed = F.when(cut > 0, _array(text(F.substring(plain, F.lit(1), cut - 1)), text(F.substring(plain, cut + 1, F.length(plain))))).otherwise(_array(text(plain)))
        answer = F.when(o["i"] % 3 == 0, _string(o["common"])).when(o["key"] % 2 == 0, _string(plain)).otherwise(listed)
        given = _array(_object(type=q("tool_result"), tool_use_id=call, content=answer))
        return F.array(_object(role=q("assistant"), content=asked), _object(role=q("user"), content=given))

    known = customers(spark, sf_dir).where(F.col("m") > without).withColumn("keys", F.slice("keys", F.lit(1), F.size("keys") - without))
    messages = F.array_join(F.flatten(F.transform(orders, turns)), ",")
    bodies = known.select(F.col("blk").cast("string").alias("conv_id"), F.concat(F.lit('{"messages":['), messages, F.lit("]}")).alias("body"))
    return conversations_of_json(bodies, "anthropic")


def _tools_sql(keep: int) -> str:
    """What is left with stored summaries, the new-block rule and ``keep`` recent results spared."""
    return f"""SELECT {keep} AS keep, source, count(*) AS blocks, CAST(sum(o) AS BIGINT) AS original_chars, CAST(sum(n) AS BIGINT) AS compact_chars, CAST(sum(e) AS BIGINT) AS overhead FROM (
  WITH v AS (SELECT *, ok AND nth > {keep} AND length(output) >= threshold AND NOT dup AS chosen, length(output) % 3 <> 0 AS hit FROM u),
  s AS (SELECT *, CASE WHEN NOT chosen THEN NULL WHEN hit THEN 'stored summary of ' || length(output) WHEN i = m AND tool <> 'Read' THEN local END AS summary FROM v),
  g AS (SELECT *, '[tx:' || md5(output) || ' -' || CAST(floor((1 - length(summary) / length(output)) * 100 + 0.5) AS BIGINT) || '%] ' || summary AS tagged FROM s),
  w AS (SELECT *, CASE WHEN NOT ok THEN 'none' WHEN dup THEN 'dedup' WHEN length(tagged) < length(output) THEN 'summary' WHEN length(ruled) < length(output) THEN 'clean' ELSE 'none' END AS how FROM g)
  SELECT how AS source, length(output) AS o, CASE how WHEN 'dedup' THEN length('[tx:' || md5(output) || '] same ' || CASE tool WHEN 'Read' THEN 'file content' WHEN 'Grep' THEN 'search result' ELSE 'output' END || ' as in a later turn')
    WHEN 'summary' THEN length(tagged) WHEN 'clean' THEN length(ruled) ELSE length(output) END AS n, CASE how WHEN 'summary' THEN length(tagged) - length(summary) ELSE 0 END AS e FROM w
  UNION ALL SELECT CASE WHEN i <= m - 3 THEN 'prose' ELSE 'none' END, length(said), CASE WHEN i <= m - 3 THEN length(short_said) ELSE length(said) END, 0 FROM w
  UNION ALL SELECT CASE WHEN old THEN 'input' ELSE 'none' END, length(command) + 14, CASE WHEN old THEN length(command) + 13 ELSE length(command) + 14 END, 0 FROM (SELECT *, tool = 'Bash' AND i <= m - {keep} AND length(command) >= 200 AS old FROM w))
GROUP BY source"""


ALL_TOOLS = f"b AS (SELECT *, {TOOL} AS tool, {SAID} AS said, {SHORT_SAID} AS short_said, {MARKED} AS command, {MANY} AS output FROM r)"
TOOLS_SQL = f"""WITH {ORDERS}, {ALL_TOOLS},
p AS (SELECT *, key % 5 <> 0 AND tool <> 'WebFetch' AS ok, sum(length(said) + length(command) + 14 + length(output)) OVER (PARTITION BY blk) / {CONTEXT}.0 AS pressure FROM b),
k AS (SELECT *, row_number() OVER (PARTITION BY blk, ok ORDER BY i DESC) AS nth, ok AND length(output) >= 200 AND i < max(i) OVER (PARTITION BY blk, ok, output) AS dup, string_split(output, {N}) AS ls,
  CASE WHEN pressure >= 0.9 THEN 150 WHEN pressure >= 0.75 THEN 400 WHEN pressure >= 0.5 THEN 800 ELSE 1500 END AS threshold, CASE WHEN pressure >= 0.9 THEN 50 ELSE 80 END AS longest, CASE WHEN pressure >= 0.9 THEN 30 ELSE 50 END AS last FROM p),
u AS (SELECT *, array_to_string(CASE WHEN len(ls) <= 2 THEN ls ELSE list_append(ls[1:2], ls[-1]) END, {N}) AS local,
  CASE WHEN tool = 'Bash' AND len(ls) > longest THEN '... [' || (len(ls) - last) || ' earlier lines omitted]' || {N} || array_to_string(ls[len(ls) - last + 1 :], {N}) ELSE output END AS ruled FROM k)
{_tools_sql(3)} UNION ALL {_tools_sql(0)}"""


@query(TOOLS_SQL)
def compacted_tools(spark, sf_dir):
    """Conversations of four tools, one of them denied, with skip marks and a store of summaries for some texts, when only
    results of the last message may be summarised anew: with three results spared, and with none."""
    blocks, out = stored(tool_conversations(spark, sf_dir), "conversations", packed=True), None
    texts = blocks.select(F.inline("blocks")).where("kind = 'tool_result'")
    store = texts.where("length(text) % 3 <> 0").select(F.md5("text").alias("hash"), F.concat(F.lit("stored summary of "), F.length("text").cast("string")).alias("summary")).distinct()
    for keep in (3, 0):
        cfg = CompactionConfig(context_chars=CONTEXT, prose_min=50, skip_tools=("webfetch",), new_rule="last_message", keep_recent=keep)
        _, saved = c.compact_conversations(blocks, cfg, store)
        sums = [F.sum(x).cast("long").alias(x) for x in ("original_chars", "compact_chars", "overhead")]
        one = saved.groupBy("source").agg(F.count(F.lit(1)).alias("blocks"), *sums).select(F.lit(keep).alias("keep"), "source", "blocks", *("original_chars", "compact_chars", "overhead"))
        out = one if out is None else out.unionByName(one)
    return out


def _grown_sql(name: str, fewer: int, known: str) -> str:
    """Results that one run summarises: those of the last message, and those whose text an earlier run's did."""
    return f"""p{name} AS (SELECT *, m - {fewer} AS n, key % 5 <> 0 AND tool <> 'WebFetch' AS ok, sum(length(said) + length(command) + 14 + length(output)) OVER (PARTITION BY blk) / {CONTEXT}.0 AS pressure FROM b WHERE i <= m - {fewer}),
c{name} AS (SELECT *, ok AND length(output) >= CASE WHEN pressure >= 0.9 THEN 150 WHEN pressure >= 0.75 THEN 400 WHEN pressure >= 0.5 THEN 800 ELSE 1500 END
  AND NOT (length(output) >= 200 AND i < max(i) OVER (PARTITION BY blk, ok, output)) AS chosen FROM p{name}),
s{name} AS (SELECT blk, i, output, md5(output) AS h, i = n AND tool <> 'Read' AND NOT ({known}) AS fresh FROM c{name} WHERE chosen AND (({known}) OR (i = n AND tool <> 'Read')))"""


@query(f"""WITH {ORDERS}, {ALL_TOOLS}, {_grown_sql("a", 1, "FALSE")}, {_grown_sql("z", 0, "md5(output) IN (SELECT h FROM sa)")}
SELECT 1 AS run, count(*) AS summarised, (SELECT count(DISTINCT h) FROM sa) AS stored FROM sa UNION ALL SELECT 2, count(*), (SELECT count(*) FROM (SELECT h FROM sa UNION SELECT h FROM sz)) FROM sz""")
def compacted_growing(spark, sf_dir):
    """Conversations compacted before and after their last call: the second run summarises its last message only, and all that the
    first summarised keeps its tag."""
    at, out = f"{shared_dir(spark)}/growing-{uuid.uuid4().hex}", None
    cfg = CompactionConfig(context_chars=CONTEXT, skip_tools=("webfetch",), new_rule="last_message", keep_recent=0)
    for run in (1, 2):
        _, saved = c.compact_growing(tool_conversations(spark, sf_dir, 2 - run), at, cfg, fn=first_words)
        size = spark.read.parquet(at).count()
        one = saved.agg(F.count_if(F.col("source") == "summary").alias("summarised")).select(F.lit(run).alias("run"), "summarised", F.lit(size).cast("long").alias("stored"))
        out = one if out is None else out.unionByName(one)
    return out


def first_words(frames):
    """A stand-in for a summariser: the first twenty characters."""
    for f in frames:
        yield f.assign(summary=f["text"].str.slice(0, 20))[["hash", "summary"]]
