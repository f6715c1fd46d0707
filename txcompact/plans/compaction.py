"""Cleaning, prose, whole conversations, stores and their streams, over texts and conversations that Spark writes from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txcompact.config import CompactionConfig
from txcompact.functions import text as t
from txcompact.operators import compact as c
from txcompact.operators import savings as s
from txcompact.operators.clean import clean
from txcompact.plans.outputs import customers
from txcompact.plans.queries import PRICE_SQL, REQ, SQL, document_blocks, prices, query, read, read_stream, requests
from txcompact.sources import stores
from txcompact.sources.steps import shared_dir
from txcompact.sources.transcripts import SCHEMAS, to_conversations
from txcompact.streaming.run import available

N = "chr(10)"
ORDERS = "r AS (SELECT o_custkey AS blk, o_orderkey AS key, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS m FROM orders)"


def of_each_order(expr: str) -> Column:
    """``expr`` (over ``key``, ``i`` and the customer's columns) of each order of a customer: texts are written behind the exchange of the keys."""
    return F.expr(f"transform(keys, (key, j) -> aggregate(array(0), j + 1, (a_, b_) -> a_, i -> {expr}))")


JSON_OBJECT = f"'{{' || {N} || '  \"a\": ' || key || ',' || {N} || '  \"b\": \"' || repeat('x', 220) || '\"' || {N} || '}}'"
FRAMES = f"'  at first (a.js)' || {N} || '  at second (b.js)' || {N} || '  at third (c.js)'"


def noisy(spark: SparkSession, sf_dir: str, new_line: str) -> DataFrame:
    """Blocks with colours, bars, blank lines, times, repeated traces and lines, and JSON; for each order some lines."""
    line = f"concat_ws({N}, chr(27) || '[32mgreen ' || key || chr(27) || '[0m   ', repeat('=', 20 + i), '2024-01-15T10:30:00Z event ' || key || ' at [10:30:00] now', '', 'Error: ' || key, {FRAMES}, 'same line of all', CASE WHEN i = 1 THEN {JSON_OBJECT} END)"
    texts = customers(spark, sf_dir).select("blk", F.array_join(of_each_order(line), "\n").alias("text"))
    return texts.select(F.col("blk").alias("block_id"), F.replace("text", F.lit("\n"), F.lit(new_line)).alias("text"))


def _noisy_sql(read_profile: bool) -> str:
    bar = "repeat('=', 20 + i), ' event ' || key || ' at  now', ''" if read_profile else "' event ' || key || ' at  now'"
    return f"""WITH {ORDERS}, x AS (SELECT *, concat_ws({N}, 'green ' || key, {bar}, 'Error: ' || key,
      CASE WHEN i = 1 THEN {FRAMES} WHEN i = 2 THEN '  ... [same 3-frame stack trace repeated]' || CASE WHEN m >= 4 THEN {N} || '  ... [repeated ' || (m - 2) || ' more times]' ELSE '' END WHEN m < 4 THEN '  ... [same 3-frame stack trace repeated]' END,
      CASE WHEN m < 3 THEN 'same line of all' WHEN i = 1 THEN 'same line of all' || {N} || '  ... [repeated ' || (m - 1) || ' more times]' END,
      CASE WHEN i = 1 THEN '{{"a":' || key || ',"b":"' || repeat('x', 220) || '"}}' END) AS part FROM r)
    SELECT blk AS block_id, string_agg(part, {N} ORDER BY i) AS text FROM x GROUP BY blk"""


@query(_noisy_sql(False))
def clean_outputs(spark, sf_dir):
    """The base clean: line ends, colours, bars and blank lines, times, traces, repeated lines, JSON, blanks."""
    return clean(noisy(spark, sf_dir, "\r\n"))


@query(_noisy_sql(True))
def clean_reads(spark, sf_dir):
    """The clean of files read, which leaves bars and blank lines."""
    return clean(noisy(spark, sf_dir, "\n"), "read")


#: The base clean of documents without stack traces.
CLEAN_SQL = rf"""WITH d AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(replace(coalesce(text, ''), chr(13) || {N}, {N}), chr(13), {N}), '\x1B\[[0-9;]*[mGKHF]', '', 'g'), '\x1B\][^\x07]*\x07', '', 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g') AS text FROM documents),
b AS (SELECT doc_id, list_filter(string_split(text, {N}), lambda l: length(regexp_replace(l, '[\s=\-#░█▓▒▌▐►◄|]', '', 'g')) > length(l) * 0.3 OR length(regexp_replace(l, '[\s=\-#░█▓▒▌▐►◄|]', '', 'g')) > 5) AS ls FROM d),
s AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(array_to_string(ls, {N}), '\d{{4}}-\d{{2}}-\d{{2}}T\d{{2}}:\d{{2}}:\d{{2}}(\.\d+)?(Z|[+-]\d{{2}}:\d{{2}})?', '', 'g'), '\[\d{{2}}:\d{{2}}:\d{{2}}(\.\d+)?\]', '', 'g'), '\d{{2}}:\d{{2}}:\d{{2}}(\.\d+)?\s', '', 'g') AS text FROM b),
l AS (SELECT doc_id, unnest(string_split(text, {N})) AS line, generate_subscripts(string_split(text, {N}), 1) AS pos FROM s),
k AS (SELECT *, trim(line, ' ' || chr(9) || {N} || chr(11) || chr(12) || chr(13)) AS key FROM l),
n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, key) AS n, row_number() OVER (PARTITION BY doc_id, key ORDER BY pos) AS nth FROM k),
o AS (SELECT doc_id, pos, CASE WHEN key <> '' AND n >= 3 THEN line || {N} || '  ... [repeated ' || (n - 1) || ' more times]' ELSE line END AS line FROM n WHERE key = '' OR n < 3 OR nth = 1),
j AS (SELECT doc_id, trim(regexp_replace(array_to_string(list_transform(string_split(string_agg(line, {N} ORDER BY pos), {N}), lambda l: rtrim(l, ' ' || chr(9))), {N}), '\n{{3,}}', {N} || {N}, 'g'), ' ' || chr(9) || {N} || chr(11) || chr(12) || chr(13)) AS text FROM o GROUP BY doc_id)
SELECT doc_id AS block_id, length(coalesce(j.text, '')) AS chars, md5(coalesce(j.text, '')) AS body FROM documents LEFT JOIN j USING (doc_id)"""


@query(CLEAN_SQL)
def clean_text(spark, sf_dir):
    """Documents after the base clean."""
    return clean(document_blocks(spark, sf_dir)).select("block_id", F.length("text").alias("chars"), F.md5("text").alias("body"))


@query(CLEAN_SQL)
def stream_clean(spark, sf_dir):
    """Documents as a stream, cleaned batch by batch."""
    docs = read_stream(spark, sf_dir, "documents").select(F.col("doc_id").alias("block_id"), "text")
    each = lambda rows: clean(rows).select("block_id", F.length("text").alias("chars"), F.md5("text").alias("body"))
    return available(docs, each=each)


PROSE = f"""concat('Let me see order ', key, '. We did this in order to finish it at this point in time, with regard to ', key, '. **Bold ', key, '** and _italic ', key, '_ stay .', {N}, {N},
 '```', {N}, 'keep in order to **this** ', key, {N}, '```', {N}, {N}, 'Basically, please note that ', key, ' is done', {N}, {N}, 'To summarize, ', repeat('all was done ', 6))"""
FIRST = "concat('see order ', key, '. We did this to finish it now, about ', key, '. Bold ', key, ' and italic ', key, ' stay.')"
CODE = f"concat('```', {N}, 'keep in order to **this** ', key, {N}, '```')"


def prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key")).select(F.col("key").alias("block_id"), F.expr(PROSE).alias("text"))


@query(f"SELECT o_orderkey AS block_id, concat({FIRST}, {N}, {N}, {CODE}, {N}, {N}, ' ', key, ' is done') AS text FROM (SELECT *, o_orderkey AS key FROM orders)")
def prose_texts(spark, sf_dir):
    """Prose without markers, phrases, emphasis and closing summary; code stays."""
    return prose(spark, sf_dir).select("block_id", t.clean_prose(F.col("text")).alias("text"))


@query(f"SELECT o_orderkey AS block_id, concat({FIRST}, {N}, {CODE}, {N}, ' ', key, ' is done', {N}, rtrim(concat('To summarize, ', repeat('all was done ', 6)))) AS text FROM (SELECT *, o_orderkey AS key FROM orders)")
def prose_blocks(spark, sf_dir):
    """The same after the base clean, which takes the blank lines by which a closing summary is known."""
    return c.clean_prose_blocks(prose(spark, sf_dir))


SAID = "concat('We did all this in order to finish the order ', key, ' at this point in time, with regard to all that was asked for.')"
SHORT_SAID = "concat('We did all this to finish the order ', key, ' now, about all that was asked for.')"
COMMAND = "repeat('run ' || key || ' ', CAST(key % 80 AS INT))"
OUTPUT = f"CASE WHEN i % 3 = 0 THEN 'the common output of ' || blk || repeat(' word', 60) ELSE array_to_string(list_transform(range(1, key % 120 + 2), lambda j: 'plain line ' || key || ' ' || j || ' of this output'), {N}) END"


def lines_of(count: str) -> str:
    """As many plain lines of an order's output."""
    return f"array_join(transform(sequence(1L, {count}), l -> 'plain line ' || key || ' ' || l || ' of this output'), {N})"


def conversations(spark: SparkSession, sf_dir: str, shape: str = "anthropic") -> DataFrame:
    """A conversation for each customer: for each order the model says something and calls a tool, and the user's turn is the result. Keys
    only are exchanged."""
    output = f"CASE WHEN i % 3 = 0 THEN 'the common output of ' || blk || repeat(' word', 60) ELSE {lines_of('key % 120 + 1')} END"
    fields = {"called": "'c' || key", "said": SAID, "command": f"to_json(named_struct('command', {COMMAND}))", "output": output}
    orders = of_each_order(f"named_struct({', '.join(f'{chr(39)}{k}{chr(39)}, {v}' for k, v in fields.items())})")
    none = F.lit(None).cast("string")
    part = lambda **kw: F.struct(*[kw.get(k, none).alias(k) for k in ("type", "text", "id", "name", "input", "tool_use_id", "content")])
    message = lambda **kw: F.struct(*[v.alias(k) for k, v in kw.items()])

    def turns(o: Column) -> Column:
        called, said, command, output = (o[k] for k in fields)
        if shape == "anthropic":
            model = message(role=F.lit("assistant"), content=F.array(part(type=F.lit("text"), text=said), part(type=F.lit("tool_use"), id=called, name=F.lit("Bash"), input=command)))
            return F.array(model, message(role=F.lit("user"), content=F.array(part(type=F.lit("tool_result"), tool_use_id=called, content=output))))
        if shape == "openai":
            calls = F.array(F.struct(called.alias("id"), F.lit("Bash").alias("name"), command.alias("arguments")))
            return F.array(message(role=F.lit("assistant"), content=said, tool_call_id=none, tool_calls=calls), message(role=F.lit("tool"), content=output, tool_call_id=called, tool_calls=F.when(F.lit(False), calls)))
        call, answer = F.struct(F.lit("Bash").alias("name"), command.alias("args")), F.struct(F.lit("Bash").alias("name"), output.alias("response"))
        no_call, no_answer = F.when(F.lit(False), call), F.when(F.lit(False), answer)
        gpart = lambda text, x, y: F.struct(text.alias("text"), x.alias("functionCall"), y.alias("functionResponse"))
        return F.array(message(role=F.lit("model"), parts=F.array(gpart(said, no_call, no_answer), gpart(none, call, no_answer))), message(role=F.lit("user"), parts=F.array(gpart(none, no_call, answer))))

    name = "contents" if shape == "gemini" else "messages"
    per = customers(spark, sf_dir).select(F.col("blk").cast("string").alias("conv_id"), F.flatten(F.transform(orders, turns)).alias(name))
    return per.select(F.from_json(F.to_json(F.struct("conv_id", name)), SCHEMAS[shape]).alias("x")).select("x.*")


#: So small a context that every band of pressure occurs.
CONTEXT = 60_000


def _compaction_sql(prose_recent: int) -> str:
    """What compaction leaves of these conversations: by source, worked out from the orders."""
    return f"""WITH {ORDERS}, b AS (SELECT *, {SAID} AS said, {SHORT_SAID} AS short_said, {COMMAND} AS command, {OUTPUT} AS output FROM r),
p AS (SELECT *, sum(length(said) + length(command) + 14 + length(output)) OVER (PARTITION BY blk) / {CONTEXT}.0 AS pressure, max(CASE WHEN i % 3 = 0 THEN i END) OVER (PARTITION BY blk) AS last_common FROM b),
q AS (SELECT *, CASE WHEN pressure >= 0.9 THEN 150 WHEN pressure >= 0.75 THEN 400 WHEN pressure >= 0.5 THEN 800 ELSE 1500 END AS threshold, string_split(output, {N}) AS ls,
  CASE WHEN pressure >= 0.9 THEN 50 ELSE 80 END AS longest, CASE WHEN pressure >= 0.9 THEN 30 ELSE 50 END AS last FROM p),
u AS (SELECT *, array_to_string(CASE WHEN len(ls) <= 2 THEN ls ELSE list_append(ls[1:2], ls[-1]) END, {N}) AS summary,
  CASE WHEN len(ls) > longest THEN '... [' || (len(ls) - last) || ' earlier lines omitted]' || {N} || array_to_string(ls[len(ls) - last + 1 :], {N}) ELSE output END AS ruled FROM q),
v AS (SELECT *, '[tx:' || md5(output) || ' -' || CAST(floor((1 - length(summary) / length(output)) * 100 + 0.5) AS BIGINT) || '%] ' || summary AS tagged FROM u),
w AS (SELECT *, CASE WHEN i % 3 = 0 AND i < last_common THEN 'dedup' WHEN i <= m - 3 AND length(output) >= threshold AND length(tagged) < length(output) THEN 'summary' WHEN length(ruled) < length(output) THEN 'clean' ELSE 'none' END AS how FROM v),
z AS (SELECT how AS source, length(output) AS o, CASE how WHEN 'dedup' THEN length('[tx:' || md5(output) || '] same output as in a later turn') WHEN 'summary' THEN length(tagged) WHEN 'clean' THEN length(ruled) ELSE length(output) END AS n, CASE how WHEN 'summary' THEN length(tagged) - length(summary) ELSE 0 END AS e FROM w
  UNION ALL SELECT CASE WHEN i <= m - {prose_recent} THEN 'prose' ELSE 'none' END, length(said), CASE WHEN i <= m - {prose_recent} THEN length(short_said) ELSE length(said) END, 0 FROM w
  UNION ALL SELECT CASE WHEN i <= m - 3 AND length(command) >= 200 THEN 'input' ELSE 'none' END, length(command) + 14, CASE WHEN i <= m - 3 AND length(command) >= 200 THEN length(command) + 13 ELSE length(command) + 14 END, 0 FROM w)
SELECT source, count(*) AS blocks, CAST(sum(o) AS BIGINT) AS original_chars, CAST(sum(n) AS BIGINT) AS compact_chars, CAST(sum(e) AS BIGINT) AS overhead FROM z GROUP BY source"""


def _compacted(spark, sf_dir, shape):
    cfg = CompactionConfig(context_chars=CONTEXT, prose_min=50).for_shape(shape)
    _, saved = c.compact_conversations(to_conversations(conversations(spark, sf_dir, shape), shape), cfg)
    sums = [F.sum(x).cast("long").alias(x) for x in ("original_chars", "compact_chars", "overhead")]
    return saved.groupBy("source").agg(F.count(F.lit(1)).alias("blocks"), *sums)


@query(_compaction_sql(3))
def compacted_conversations(spark, sf_dir):
    """Whole conversations: dedup, summaries, rules by pressure, prose and tool inputs, with the source of every saving."""
    return _compacted(spark, sf_dir, "anthropic")


@query(_compaction_sql(0))
def compacted_conversations_openai(spark, sf_dir):
    return _compacted(spark, sf_dir, "openai")


@query(_compaction_sql(3))
def compacted_conversations_gemini(spark, sf_dir):
    return _compacted(spark, sf_dir, "gemini")


@query(f"""WITH {ORDERS}, b AS (SELECT *, {COMMAND} AS command FROM r) SELECT CAST(blk AS VARCHAR) AS conv_id, CAST(2 * i - 2 AS INTEGER) AS turn, '{{"command":"' || rtrim(command) || '"}}' AS text FROM b WHERE i <= m - 3 AND length(command) >= 200""")
def tool_inputs_written_back(spark, sf_dir):
    """Long fields of the model's older calls, cleaned and put back where that makes them shorter."""
    return c.clean_tool_inputs(to_conversations(conversations(spark, sf_dir), "anthropic")).select("conv_id", "turn", "text")


NEW = "SELECT 'last_message' AS rule, count(*) AS n FROM x WHERE i = m AND length(output) >= 800 UNION ALL SELECT 'after_model', count(*) FROM x WHERE i = m AND length(output) >= 800"


@query(f"WITH {ORDERS}, x AS (SELECT *, {OUTPUT} AS output FROM r) {NEW} UNION ALL SELECT 'soft', count(*) FROM x WHERE i <= m - 10 AND length(output) >= 3000 UNION ALL SELECT 'aggressive', count(*) FROM x WHERE i <= m - 1 AND length(output) >= 200 UNION ALL SELECT 'other_tools', 0 UNION ALL SELECT 'only_bash', count(*) FROM x WHERE i <= m - 3 AND length(output) >= 800 UNION ALL SELECT 'no_summary', 0")
def selections(spark, sf_dir):
    """How many results each setting selects: new ones only, presets, lists of tools, tools that get no summary."""
    settings = {
        "last_message": CompactionConfig(threshold=800, keep_recent=0, new_rule="last_message"),
        "after_model": CompactionConfig(threshold=800, keep_recent=0, new_rule="after_model"),
        "soft": CompactionConfig().with_mode("soft"),
        "aggressive": CompactionConfig().with_mode("aggressive"),
        "other_tools": CompactionConfig(threshold=800, skip_tools=("BASH",)),
        "only_bash": CompactionConfig(threshold=800, only_tools=("bash",), skip_tools=("bash",)),
        "no_summary": CompactionConfig(threshold=800, no_summary=("bash",)),
    }
    return c.count_candidates(to_conversations(conversations(spark, sf_dir), "anthropic"), settings)


@query("SELECT doc_id, md5(text) AS body FROM documents WHERE text IS NOT NULL")
def reinflate_by_hash(spark, sf_dir):
    """Every text is replaced by a tag with its whole hash and looked up again: one row for each, whatever short ids are shared."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").where("text is not null")
    short = docs.withColumn("text", c.tagged(F.md5("text"), F.lit("a summary"), F.greatest(F.length("text"), F.lit(1))))
    return c.reinflate(short, c.build_store(docs)).select("doc_id", F.md5("text").alias("body"))


@query("SELECT doc_id, lang = 'en' OR md5(text) IN (SELECT md5(text) FROM documents WHERE lang = 'en') AS found FROM documents WHERE text IS NOT NULL")
def expand_lookups(spark, sf_dir):
    """Answers of models in two shapes that ask for a stored text by its hash; the store holds the English ones."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source").where("text is not null")
    ask = F.to_json(F.struct(F.md5("text").alias("id")))
    blocks = F.to_json(F.struct(F.array(F.struct(F.lit("tool_use").alias("type"), F.lit("expand").alias("name"), F.struct(F.md5("text").alias("id")).alias("input"))).alias("content")))
    choices = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct(F.struct(F.lit("expand").alias("name"), ask.alias("arguments")).alias("function"))).alias("tool_calls")).alias("message"))).alias("choices")))
    answers = docs.select("doc_id", F.when(F.length("text") % 2 == 0, blocks).otherwise(choices).alias("body"))
    return c.expand_calls(c.calls_in(answers), c.build_store(docs.where("lang = 'en'"))).select("doc_id", "found")


@query("SELECT DISTINCT md5(text) AS hash, substr(md5(text), 1, 6) AS block_id6, length(text) AS chars FROM documents WHERE text IS NOT NULL")
def originals_store(spark, sf_dir):
    """A store written in two appends that overlap, and read again."""
    at = f"{shared_dir(spark)}/originals-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents").where("text is not null")
    stores.append_new(c.build_store(docs.where("lang = 'en'")), at)
    stores.append_new(c.build_store(docs), at)
    return stores.read_store(spark, at).select("hash", "block_id6", F.length("text").alias("chars"))


@query("WITH x AS (SELECT md5(text) AS hash, max(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY 1) SELECT hash, doc_id, (SELECT count(*) FROM x) >= 100 AS full FROM x ORDER BY doc_id DESC, hash LIMIT 100")
def compacted_store(spark, sf_dir):
    """A store of a hundred entries: two appends that overlap, a compaction, one more append, and a compaction that evicts the oldest."""
    store = stores.Generations(spark, f"{shared_dir(spark)}/generations-{uuid.uuid4().hex}", "hash", "doc_id")
    docs = read(spark, sf_dir, "documents").where("text is not null").select(F.md5("text").alias("hash"), "doc_id")
    store.append(docs.where("doc_id % 3 = 0"))
    store.append(docs.where("doc_id % 3 <> 2"))
    store.compact()
    store.append(docs.where("doc_id % 3 = 2"))
    store.compact(100)
    return store.read().select("hash", "doc_id", F.lit(store.read().count() == 100).alias("full"))


@query(f"{REQ}, x AS (SELECT session_id, count(*) AS requests, max(ts) AS last_ts FROM req GROUP BY session_id) SELECT session_id, requests FROM x ORDER BY last_ts DESC, session_id LIMIT 50")
def session_history(spark, sf_dir):
    """A history of sessions written twice, first with the log's first half: later rows replace earlier ones, the last fifty stay."""
    store = stores.Generations(spark, f"{shared_dir(spark)}/history-{uuid.uuid4().hex}", "session_id", "last_ts")
    log = requests(spark, sf_dir)
    for part in (log.where(F.col("ts") < F.lit("2024-01-15").cast("timestamp")), log):
        stores.upsert_sessions(store, part.groupBy("session_id").agg(F.count(F.lit(1)).alias("requests"), F.max("ts").alias("last_ts")), 50)
    return store.read().select("session_id", "requests")


@query(f"{REQ} SELECT tool, count(*) AS requests, CAST(sum(saved_chars) AS BIGINT) AS saved_chars FROM req GROUP BY tool")
def request_facts(spark, sf_dir):
    """Facts of requests appended in two parts; totals are worked out from them."""
    at = f"{shared_dir(spark)}/requests-{uuid.uuid4().hex}"
    log = requests(spark, sf_dir)
    late = F.col("ts") >= F.lit("2024-01-15").cast("timestamp")
    stores.append_requests(log.where(~late), at)
    stores.append_requests(log.where(late), at)
    return spark.read.parquet(at).groupBy("tool").agg(F.count(F.lit(1)).alias("requests"), F.sum("saved_chars").alias("saved_chars"))


@query(f"{REQ}, x AS (SELECT session_id, count(*) AS requests, min(ts) AS start_ts FROM req GROUP BY session_id) SELECT session_id, requests FROM x ORDER BY start_ts DESC, session_id LIMIT 20")
def sessions_newest_first(spark, sf_dir):
    """The history keeps the sessions that started last, as many as it is told to."""
    return stores.newest_sessions(s.sessions(requests(spark, sf_dir)), 20).select("session_id", "requests")


COST = """p AS (SELECT model, arg_max(input, length(key)) AS price FROM (SELECT DISTINCT model FROM req) JOIN prices ON contains(model, key) GROUP BY model),
t AS (SELECT model, floor(sum(saved_chars) / 3.5 + 0.5) AS tokens, sum(saved_chars) AS saved FROM req GROUP BY model),
a AS (SELECT sum(tokens * coalesce(price, 3.0) / 1e6) AS cost, sum(saved) AS saved FROM t LEFT JOIN p USING (model))"""


@query(f"{REQ.replace('WITH ', 'WITH ' + PRICE_SQL + ', ', 1)}, {COST} SELECT date_trunc('month', ts)::DATE::VARCHAR AS month, count(*) AS requests, round(any_value(cost) * sum(saved_chars) / any_value(saved), 6) AS saved_cost FROM req, a GROUP BY 1")
def cost_period_scaled(spark, sf_dir):
    """Saved cost by the models' prices over all time, divided among months by what they saved."""
    return s.period_cost(requests(spark, sf_dir), prices(spark)).select(F.col("month").cast("string").alias("month"), "requests", F.round("saved_cost", 6).alias("saved_cost"))


LOG_PROMPT = f"'You are helper ' || blk || '. ' || repeat('Work with care. ', 10) || string_agg({N} || repeat('-', 60 + i) || {N} || 'rule ' || key || ' must hold', '' ORDER BY i)"
PROMPTS = f"WITH {ORDERS}, x AS (SELECT blk, {LOG_PROMPT} AS text, 'You are helper ' || blk || '. ' || trim(repeat('Work with care. ', 10)) || string_agg({N} || 'rule ' || key || ' must hold', '' ORDER BY i) AS clean FROM r GROUP BY blk)"


@query(f"{PROMPTS}, y AS (SELECT *, CASE WHEN length(text) < 700 THEN 'untouched' WHEN 1 - length(clean) / length(text) > 0.6 THEN 'clean' ELSE 'summary' END AS how FROM x) SELECT how AS \"by\", count(*) AS prompts, CAST(sum(length(text)) AS BIGINT) AS original_chars, CAST(sum(CASE how WHEN 'untouched' THEN length(text) WHEN 'clean' THEN length(clean) ELSE length(array_to_string(list_append(string_split(clean, {N})[1:2], string_split(clean, {N})[-1]), {N})) END) AS BIGINT) AS compact_chars FROM y GROUP BY how")
def system_prompts(spark, sf_dir):
    """Prompts with rules from orders between bars: short ones stay, those that cleaning shortens by much are cleaned, others summarised."""
    rule = of_each_order(f"{N} || repeat('-', 60 + i) || {N} || 'rule ' || key || ' must hold'")
    prompts = customers(spark, sf_dir).select(F.concat(F.expr("'You are helper ' || blk || '. ' || repeat('Work with care. ', 10)"), F.array_join(rule, "")).alias("text"))
    made = c.compact_prompts(prompts, min_len=700, enough=0.6)
    return made.groupBy("by").agg(F.count(F.lit(1)).alias("prompts"), F.sum("original_chars").cast("long").alias("original_chars"), F.sum("compact_chars").cast("long").alias("compact_chars"))


@query(f"{REQ}, spine AS (SELECT unnest(generate_series((SELECT min(ts) FROM req)::DATE, (SELECT max(ts) FROM req)::DATE, INTERVAL 1 DAY))::DATE AS day), t AS (SELECT DISTINCT session_id FROM req), d AS (SELECT session_id, ts::DATE AS day, count(*) AS n FROM req GROUP BY 1, 2) SELECT session_id, day::VARCHAR AS day, coalesce(n, 0) AS requests FROM t CROSS JOIN spine LEFT JOIN d USING (session_id, day)")
def day_spine(spark, sf_dir):
    """Every session has every day, with or without requests."""
    r = requests(spark, sf_dir)
    days = r.agg(F.min(F.to_date("ts")), F.max(F.to_date("ts"))).first()
    per = r.groupBy("session_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    spine = r.select("session_id").distinct().select("session_id", F.explode(F.sequence(F.lit(days[0]), F.lit(days[1]))).alias("day"))
    return spine.join(per, ["session_id", "day"], "left").select("session_id", F.col("day").cast("string").alias("day"), F.coalesce("n", F.lit(0)).alias("requests"))


PROJECT_PATHS = ["C:\\Users\\Ann\\Documents\\shop{}\\src", "see /home/me/x/shop{}/a", "/Users/dev/repos/shop{}", "cwd: D:\\work\\shop{}", "<cwd>/home/me/shop{}/</cwd>", "at https://host/shop{}", "/workspace/src/tmp"]


@query("SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN 'Ann' WHEN 1 THEN 'me' WHEN 2 THEN 'shop' || o_orderkey WHEN 3 THEN 'shop' || o_orderkey WHEN 4 THEN 'shop' || o_orderkey WHEN 5 THEN 'unknown' ELSE 'tmp' END AS project FROM orders")
def project_paths(spark, sf_dir):
    """Projects by paths of several kinds."""
    kinds = F.array(*[F.lit(p) for p in PROJECT_PATHS])
    prompt = F.replace(F.get(kinds, (F.col("o_orderkey") % 7).cast("int")), F.lit("{}"), F.col("o_orderkey").cast("string"))
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), t.project_of(prompt).alias("project"))
