"""Further queries: reports over the log, transcript shapes, tool inputs, training pairs, names and numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from txcompact.functions import text as t
from txcompact.operators import compact as c
from txcompact.operators import savings as s
from txcompact.plans.queries import CARRIED, PERCENT, REQ, query, read, requests
from txcompact.sources.transcripts import SCHEMAS, to_blocks, tool_input_fields

WHEN = "yyyy-MM-dd HH:mm:ss"
DAY = "%Y-%m-%d %H:%M:%S"


@query(f"{REQ} SELECT client, count(*) FILTER (request_id % 3 > 0) AS hits, count(*) AS lookups, floor(count(*) FILTER (request_id % 3 > 0) * 1.0::DOUBLE / count(*) * 1000 + 0.5) / 10 AS hit_percent FROM req GROUP BY client")
def cache_hit_rate(spark, sf_dir):
    return s.hit_rate(requests(spark, sf_dir).withColumn("hit", F.col("request_id") % 3 > 0), ["client"])


@query(f"{REQ}, x AS (SELECT greatest(count(*), (SELECT count(*) FROM lineitem)) AS requests, greatest(sum(original_chars), (SELECT sum(CAST(floor(l_extendedprice) AS BIGINT)) FROM lineitem)) AS o, greatest(sum(saved_chars), (SELECT sum(CAST(floor(l_extendedprice * l_discount) AS BIGINT)) FROM lineitem)) AS s FROM req), y AS (SELECT requests, CAST(floor(o / 3.5 + 0.5) AS BIGINT) AS original_tokens, CAST(floor(s / 3.5 + 0.5) AS BIGINT) AS saved_tokens FROM x) SELECT *, floor(saved_tokens::DOUBLE / original_tokens * 1000 + 0.5) / 10 AS saving_percent FROM y")
def all_time_totals(spark, sf_dir):
    """Two logs that overlap: the greater total of each counts."""
    total = lambda log: log.agg(F.count(F.lit(1)).alias("requests"), F.sum("original_chars").alias("original_chars"), F.sum("saved_chars").alias("saved_chars"))
    other = read(spark, sf_dir, "lineitem").select(F.floor("l_extendedprice").alias("original_chars"), F.floor(F.col("l_extendedprice") * F.col("l_discount")).alias("saved_chars"))
    return s.all_time(total(requests(spark, sf_dir)), total(other))


@query(f"{REQ}, x AS (SELECT session_id, min(ts) AS start_ts, count(*) AS n, sum(original_chars) AS o, sum(saved_chars) AS s FROM req GROUP BY session_id) SELECT count(*) AS sessions, CAST(coalesce(sum(n), 0) AS BIGINT) AS requests, CAST(floor(coalesce(sum(s), 0) / 3.5 + 0.5) AS BIGINT) AS saved_tokens, CASE WHEN sum(o) > 0 THEN floor(CAST(sum(s) AS DOUBLE) / sum(o) * 1000 + 0.5) / 10 ELSE 0.0 END AS saving_percent FROM x WHERE start_ts >= TIMESTAMP '2024-01-01' AND start_ts < TIMESTAMP '2024-01-02'")
def period_summary(spark, sf_dir):
    at = lambda x: F.lit(x).cast("timestamp")
    return s.period_summary(s.sessions(requests(spark, sf_dir)), at("2024-01-01 00:00:00"), at("2024-01-02 00:00:00"))


@query(f"SELECT user_id % 4 AS client, count(*) FILTER (event_type = 'error') AS refused, strftime(max(ts) FILTER (event_type = 'error'), '{DAY}') AS last_ts FROM events GROUP BY 1")
def refused_calls(spark, sf_dir):
    e = read(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("client"), "ts", F.when(F.col("event_type") == "error", 429).otherwise(200).alias("status"))
    return s.refused_calls(e).withColumn("last_ts", F.date_format("last_ts", WHEN))


@query(f"{REQ}, b(client, budget) AS (VALUES ('client0', 1000000), ('client1', 50000000)) SELECT client, date_trunc('month', ts)::DATE::VARCHAR AS month, CAST(sum(original_chars) AS BIGINT) AS tokens, CAST(any_value(budget) AS BIGINT) AS budget, floor(CAST(sum(original_chars) AS DOUBLE) / any_value(budget) * 1000 + 0.5) / 10 AS share_percent FROM req LEFT JOIN b USING (client) GROUP BY 1, 2")
def monthly_budget(spark, sf_dir):
    budgets = spark.createDataFrame([("client0", 1_000_000), ("client1", 50_000_000)], "client string, budget long")
    out = s.budget_share(requests(spark, sf_dir).withColumn("input_tokens", F.col("original_chars")), budgets)
    return out.withColumn("month", F.col("month").cast("string")).select("client", "month", "tokens", "budget", "share_percent")


UPSERTED = """h AS (SELECT session_id, count(*) AS requests FROM req WHERE ts < TIMESTAMP '2024-01-28' GROUP BY 1),
n AS (SELECT session_id, count(*) AS requests FROM req GROUP BY 1 HAVING max(ts) >= TIMESTAMP '2024-01-28')"""


@query(f"{REQ}, {UPSERTED} SELECT * FROM h WHERE session_id NOT IN (SELECT session_id FROM n) UNION ALL SELECT * FROM n")
def session_upsert(spark, sf_dir):
    """A history up to a moment, and all that the sessions active since have done, in place of their earlier state."""
    r, mid = requests(spark, sf_dir), F.lit("2024-01-28").cast("timestamp")
    history = s.sessions(r.where(F.col("ts") < mid))
    return s.upsert_sessions(history, s.sessions(r).where(F.col("end_ts") >= mid)).select("session_id", "requests")


@query(f"SELECT user_id % 6 AS client, strftime(min(ts + to_seconds(CAST(floor(value) AS BIGINT))) FILTER (ts + to_seconds(CAST(floor(value) AS BIGINT)) > TIMESTAMP '2024-01-20'), '{DAY}') AS next_ts FROM events GROUP BY 1")
def next_reset(spark, sf_dir):
    """Resets come as durations from each event; the next after a moment counts."""
    e = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    limits = e.select((F.col("user_id") % 6).alias("client"), t.reset_time(F.concat(F.floor("value").cast("string"), F.lit("s")), F.col("ts")).alias("reset_ts"))
    return s.next_reset(limits, F.lit("2024-01-20").cast("timestamp")).withColumn("next_ts", F.date_format("next_ts", WHEN))


@query("SELECT session_id, saved_chars, concat(CASE WHEN saved_chars >= 1000000 THEN CAST(floor(saved_chars / 1000000 * 10 + 0.5) / 10 AS VARCHAR) || 'M' WHEN saved_chars >= 1000 THEN CAST(floor(saved_chars / 1000 * 10 + 0.5) / 10 AS VARCHAR) || 'k' ELSE CAST(saved_chars AS VARCHAR) END) AS short, CASE WHEN secs < 60 THEN secs || 's' WHEN secs < 3600 THEN (secs // 60) || 'm ' || (secs % 60) || 's' ELSE (secs // 3600) || 'h ' || ((secs % 3600) // 60) || 'm' END AS up, CASE WHEN saved_chars = 0 THEN '—' WHEN saved_chars * 3 / 1000000::DOUBLE < 0.01 THEN '<$0.01' ELSE '$' || (CAST(floor(saved_chars * 3 / 1000000::DOUBLE * 100 + 0.5) AS BIGINT) // 100) || '.' || lpad(CAST(CAST(floor(saved_chars * 3 / 1000000::DOUBLE * 100 + 0.5) AS BIGINT) % 100 AS VARCHAR), 2, '0') END AS cost, CAST(greatest(0, least(100, floor(first_value / 3 + 0.5))) AS INTEGER) AS used FROM (SELECT session_id, CAST(sum(saved_chars) AS BIGINT) AS saved_chars, CAST(sum(saved_chars) AS BIGINT) % 10000 AS secs, CAST(max(ms) AS DOUBLE) AS first_value FROM (" + REQ + " SELECT * FROM req) GROUP BY session_id)")
def report_numbers(spark, sf_dir):
    """Totals of sessions as a report shows them."""
    per = requests(spark, sf_dir).groupBy("session_id").agg(F.sum("saved_chars").alias("saved_chars"), F.max("ms").alias("m"))
    saved = F.col("saved_chars")
    return per.select(
        "session_id",
        "saved_chars",
        t.short_number(saved).alias("short"),
        t.uptime(saved % 10000).alias("up"),
        t.money(saved * 3 / F.lit(1e6)).alias("cost"),
        t.used_window(F.col("m") / 3).alias("used"),
    )


@query("WITH d AS (SELECT DISTINCT md5(text) AS hash, text, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS lines FROM documents WHERE length(text) >= 10), p AS (SELECT hash, text, variant, array_to_string(lines[1 : CAST(ceil(len(lines) * share) AS BIGINT)], chr(10)) AS compressed FROM d, (VALUES ('conservative', 0.65::DOUBLE), ('balanced', 0.45::DOUBLE), ('aggressive', 0.25::DOUBLE)) v(variant, share)) SELECT hash, variant, md5(compressed) AS compressed_md5, round(1 - length(compressed) / length(text), 9) AS ratio FROM p")
def training_pairs(spark, sf_dir):
    return c.training_pairs(read(spark, sf_dir, "documents")).select("hash", "variant", F.md5("compressed").alias("compressed_md5"), F.round("ratio", 9).alias("ratio"))


def _shaped(turns, shape: str):
    """Whole conversations in one of the four shapes: an assistant's turn is also a call, the user's next turn its result."""
    schema = SCHEMAS[shape]
    called = F.when(F.col("role") == "assistant", F.concat(F.lit("call"), F.col("turn").cast("string")))
    answered = F.when((F.col("role") == "user") & (F.col("before") == "assistant"), F.concat(F.lit("call"), (F.col("turn") - 1).cast("string")))
    s_ = lambda **kw: F.struct(*[v.alias(k) for k, v in kw.items()])
    kind = F.when(answered.isNotNull(), "tool_result").when(called.isNotNull(), "tool_use").otherwise("text")
    if shape == "anthropic":
        message = s_(role=F.col("role"), content=F.array(s_(type=kind, text=F.when(kind == "text", F.col("text")), id=called, name=F.when(called.isNotNull(), F.lit("Bash")), input=F.when(kind == "tool_use", F.col("text")), tool_use_id=answered, content=F.when(kind == "tool_result", F.col("text")))))
    elif shape == "openai":
        message = s_(role=F.when(answered.isNotNull(), "tool").otherwise(F.col("role")), content=F.when(called.isNull(), F.col("text")), tool_call_id=answered, tool_calls=F.when(called.isNotNull(), F.array(s_(id=called, name=F.lit("Bash"), arguments=F.col("text")))))
    elif shape == "gemini":
        message = s_(role=F.col("role"), parts=F.array(s_(text=F.when(kind == "text", F.col("text")), functionCall=F.when(kind == "tool_use", s_(name=F.lit("Bash"), args=F.col("text"))), functionResponse=F.when(kind == "tool_result", s_(name=F.lit("Bash"), response=F.col("text"))))))
    else:
        message = s_(type=F.when(kind == "tool_result", "function_call_output").when(kind == "tool_use", "function_call").otherwise("message"), role=F.when(kind == "text", F.col("role")), call_id=F.coalesce(called, answered), name=F.when(called.isNotNull(), F.lit("Bash")), arguments=F.when(kind == "tool_use", F.col("text")), output=F.when(kind == "tool_result", F.col("text")), content=F.when(kind == "text", F.col("text")))
    name = {"gemini": "contents", "responses": "input"}.get(shape, "messages")
    per = turns.groupBy(F.col("conv_id").cast("string").alias("conv_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", message.alias("m")))), lambda x: x["m"]).alias(name))
    return per.select(F.from_json(F.to_json(F.struct("conv_id", name)), schema).alias("x")).select("x.*")


@query("WITH p AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations), k AS (SELECT CASE WHEN role = 'user' AND before = 'assistant' THEN 'tool_result' WHEN role = 'assistant' THEN 'tool_use' ELSE 'text' END AS kind, text FROM p WHERE length(text) > 0) SELECT shape, kind, CASE WHEN kind = 'text' THEN NULL ELSE 'Bash' END AS tool, count(*) AS blocks, CAST(sum(length(text)) AS BIGINT) AS chars FROM k, (VALUES ('anthropic'), ('openai'), ('gemini'), ('responses')) s(shape) GROUP BY ALL")
def transcript_shapes(spark, sf_dir):
    """The conversations as JSON in all four shapes, read again: the same blocks, and every result finds its call."""
    turns = read(spark, sf_dir, "conversations")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("before"))
    turns = turns.join(before, ["conv_id", "turn"], "left")
    out = None
    for shape in SCHEMAS:
        got = to_blocks(_shaped(turns, shape), shape).groupBy("kind", "tool").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.length("text")).alias("chars")).withColumn("shape", F.lit(shape))
        out = got if out is None else out.unionByName(got)
    return out


@query("WITH x AS (SELECT doc_id, ['command', 'old_string', 'content', 'new_source'][doc_id % 4 + 1] AS field, ['Bash', 'Edit', 'Write', 'NotebookEdit'][doc_id % 4 + 1] AS tool, text AS value FROM documents) SELECT CAST(doc_id AS VARCHAR) AS conv_id, tool, field, md5(value) AS value_md5 FROM x WHERE length(value) >= 200")
def tool_inputs(spark, sf_dir):
    """Documents as long fields of four tools' inputs."""
    k = (F.col("doc_id") % 4).cast("int")
    pick = lambda *names: F.get(F.array(*[F.lit(n) for n in names]), k)
    docs = read(spark, sf_dir, "documents")
    inputs = F.to_json(F.map_from_arrays(F.array(pick("command", "old_string", "content", "new_source")), F.array("text")))
    calls = docs.select(F.col("doc_id").cast("string").alias("conv_id"), F.lit(0).alias("turn"), F.lit(0).alias("part"), F.lit("tool_use").alias("kind"), pick("Bash", "Edit", "Write", "NotebookEdit").alias("tool"), inputs.alias("text"))
    return tool_input_fields(calls).select("conv_id", "tool", "field", F.md5("value").alias("value_md5"))


PATH = "regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', '')"


@query(f"WITH p AS (SELECT page_id, url, {PATH} AS path FROM pages), o AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN regexp_extract(rtrim('/work/x' || path, '/'), '([^/]*)$', 1) WHEN page_id % 3 = 1 THEN regexp_extract(rtrim('/work/y' || path, '/'), '([^/]*)$', 1) ELSE 'unknown' END AS project FROM p) SELECT page_id, CASE WHEN page_id % 10 = 0 THEN 'named' ELSE project END AS project FROM o")
def project_names(spark, sf_dir):
    """Projects from prompts that name a folder in one of two ways or not at all; a manual name goes first."""
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*", ""), "[?#].*$", "")
    k = F.col("page_id") % 3
    prompt = F.when(k == 0, F.concat(F.lit("<cwd>/work/x"), path, F.lit("</cwd>"))).when(k == 1, F.concat(F.lit("cwd: /work/y"), path, F.lit("\n"))).otherwise("no folder here")
    manual = F.when(F.col("page_id") % 10 == 0, F.lit("named"))
    pages = read(spark, sf_dir, "pages")
    overrides = pages.select("page_id", manual.alias("manual")).where("manual is not null")
    return s.override_projects(pages.select("page_id", t.project_of(prompt).alias("project")), overrides, "page_id")


@query("WITH e AS (SELECT event_id, ['Claude-Code/1', 'app Electron', 'aider x', 'Roo', 'none'][event_id % 5 + 1] AS ua, CASE WHEN event_id % 7 = 0 THEN 'windsurf' WHEN event_id % 7 = 1 THEN 'bogus' END AS hint FROM events) SELECT coalesce(CASE WHEN hint = 'windsurf' THEN hint END, ['claude_code', 'claude_desktop', 'aider', 'cline', 'claude_code'][event_id % 5 + 1]) AS client, coalesce(CASE WHEN hint = 'windsurf' THEN hint END, ['openai_other', 'openai_other', 'aider', 'cline', 'openai_other'][event_id % 5 + 1]) AS other, ['google', 'openai', 'anthropic', 'anthropic'][event_id % 4 + 1] AS upstream, event_id % 4 = 3 AS local, 'm' || (event_id % 3) AS model, count(*) AS n FROM e GROUP BY ALL")
def call_classes(spark, sf_dir):
    """Clients by hint and user agent, services by header, local keys and models by path."""
    k = lambda n: (F.col("event_id") % n).cast("int")
    pick = lambda n, *x: F.get(F.array(*[F.lit(v) for v in x]), k(n))
    agent, hint = pick(5, "Claude-Code/1", "app Electron", "aider x", "Roo", "none"), F.when(k(7) == 0, "windsurf").when(k(7) == 1, "bogus")
    headers = F.create_map(pick(4, "x-goog-api-key", "authorization", "x-api-key", "accept"), F.lit("v"))
    e = read(spark, sf_dir, "events").select(
        t.client_of(agent, hint).alias("client"), t.client_of(agent, hint, "completions").alias("other"), t.upstream_of(headers).alias("upstream"), t.is_local_key(pick(4, "AIza1", "sk-2", "eyJ3", "ollama")).alias("local"), t.model_of_path(F.concat(F.lit("m"), k(3).cast("string"), F.lit(":generateContent"))).alias("model"),
    )
    return e.groupBy("client", "other", "upstream", "local", "model").agg(F.count(F.lit(1)).alias("n"))


@query(f"{CARRIED} SELECT tool, count(*) AS requests, CAST(sum(CASE WHEN request_id % 4 = 0 THEN 0 ELSE saved_chars END) AS BIGINT) AS saved_chars FROM c GROUP BY tool")
def bypassed_requests(spark, sf_dir):
    """A bypassed request is counted and saves nothing."""
    r = s.bypass(s.carry_project(requests(spark, sf_dir)), F.col("request_id") % 4 == 0)
    return s.savings_by(r, ["tool"]).where("dim = 'tool'").select(F.col("value").alias("tool"), "requests", "saved_chars")


def _shares(dim: str) -> str:
    share = "CAST(sum(saved_chars) AS DOUBLE) / max(sum(saved_chars)) OVER () AS share_of_max"
    return f"SELECT {dim} AS name, '{dim}' AS what, CAST(sum(saved_chars) AS BIGINT) AS saved_chars, {PERCENT}, {share} FROM req GROUP BY {dim}"


@query(f"{REQ} {_shares('model')} UNION ALL {_shares('client')}")
def savings_by_model_and_client(spark, sf_dir):
    """Savings of models and of clients, each with its share of the greatest of its kind."""
    found = s.with_share(s.savings_by(requests(spark, sf_dir), ["model", "client"]).where("dim <> 'all'"))
    return found.select(F.col("value").alias("name"), F.col("dim").alias("what"), "saved_chars", "saving_percent", "share_of_max")
