"""Queries over the given tables and their SQL.

The tables hold no request logs and no command output. ``requests`` reads ``events`` as a log: the event type is the
tool, the user the session, the value the latency in ms and, times 100, the characters. ``lineitem`` is a second, larger
log: price and discount are characters and saving. Conversations give blocks; documents give texts and lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txcompact.config import CompactionConfig
from txcompact.functions import text as t
from txcompact.operators import compact as c
from txcompact.operators import lines as ln
from txcompact.operators import rules, savings as s
from txcompact.operators.clean import clean
from txcompact.sources.transcripts import from_turns, usage_from_events

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # A glob, as a stream's plain path must be a folder, and a table may be one file.
    return spark.readStream.schema(read(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}[.]parquet")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_turns(read(spark, sf_dir, "conversations"))


def document_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("block_id"), "text", "lang", "source")


MODELS = ["gpt-4o-mini-2024-07-18", "gpt-4o", "o1-mini-x", "gemini-1.5-pro", "other"]


def requests(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    e = read_stream(spark, sf_dir, "events") if stream else read(spark, sf_dir, "events")
    models = F.array(*[F.lit(m) for m in MODELS])
    return e.select(
        F.col("event_id").alias("request_id"), "event_id", F.col("user_id").cast("string").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("tool"), F.concat(F.lit("client"), (F.col("user_id") % 3).cast("string")).alias("client"),
        F.get(models, (F.col("event_id") % 5).cast("int")).alias("model"), F.when(F.col("event_id") % 5 < 2, "unknown").otherwise(F.concat(F.lit("p"), (F.col("user_id") % 4).cast("string"))).alias("project"), F.col("value").alias("ms"), F.floor(F.col("value") * 100).alias("original_chars"), F.expr("(cast(floor(value * 100) as bigint) * (event_id % 10)) div 20").alias("saved_chars"),
    )


REQ = """WITH req AS (SELECT event_id AS request_id, CAST(user_id AS VARCHAR) AS session_id, ts, event_type AS tool, 'client' || (user_id % 3) AS client,
  ['gpt-4o-mini-2024-07-18', 'gpt-4o', 'o1-mini-x', 'gemini-1.5-pro', 'other'][(event_id % 5) + 1] AS model,
  CASE WHEN event_id % 5 < 2 THEN 'unknown' ELSE 'p' || (user_id % 4) END AS project, value AS ms, CAST(floor(value * 100) AS BIGINT) AS original_chars,
  (CAST(floor(value * 100) AS BIGINT) * (event_id % 10)) // 20 AS saved_chars FROM events)"""
#: The context of the test conversations, small enough that all bands occur.
SMALL = 6000
BAND = "CASE WHEN p >= 0.9 THEN 150 WHEN p >= 0.75 THEN 400 WHEN p >= 0.5 THEN 800 ELSE 1500 END"
PRESSED = f"WITH a AS (SELECT *, length(text) AS chars, least(sum(length(text)) OVER (PARTITION BY conv_id) / 6000.0, 1.0) AS p, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS from_end FROM conversations WHERE length(text) > 0), b AS (SELECT *, {BAND} AS threshold FROM a)"


def pressed(spark, sf_dir, cfg=CompactionConfig(context_chars=SMALL)):
    return c.rank_from_end(c.with_threshold(c.with_pressure(blocks(spark, sf_dir).where("length(text) > 0"), cfg.context_chars), cfg))


@query(f"{PRESSED} SELECT role, count(*) AS candidates, CAST(sum(chars) AS BIGINT) AS potential_chars, CAST(floor(sum(chars) / 3.5 + 0.5) AS BIGINT) AS potential_tokens FROM b WHERE from_end > 3 AND chars >= threshold GROUP BY role")
def dry_run_potential(spark, sf_dir):
    """Blocks that a compaction would pick, by role: nothing is changed."""
    return pressed(spark, sf_dir).where((F.col("from_end") > 3) & (F.length("text") >= F.col("threshold"))).groupBy("role").agg(F.count(F.lit(1)).alias("candidates"), F.sum(F.length("text")).alias("potential_chars"), t.tokens_of(F.sum(F.length("text"))).alias("potential_tokens"))


@query(f"{PRESSED} SELECT threshold, count(DISTINCT conv_id) AS conversations, count(*) AS blocks FROM b GROUP BY threshold")
def conv_pressure_bands(spark, sf_dir):
    return pressed(spark, sf_dir).groupBy("threshold").agg(F.count_distinct("conv_id").alias("conversations"), F.count(F.lit(1)).alias("blocks"))


@query("SELECT conv_id, turn, from_end FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS from_end FROM conversations) WHERE from_end > 3")
def recent_exclusion(spark, sf_dir):
    return c.rank_from_end(blocks(spark, sf_dir)).where("from_end > 3").select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("from_end").cast("long").alias("from_end"))


@query("SELECT conv_id, turn, role, length(text) AS chars FROM (SELECT *, dense_rank() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS r FROM conversations) WHERE role IN ('user', 'assistant') AND r > 1 AND length(text) >= 300")
def prose_candidates(spark, sf_dir):
    b = blocks(spark, sf_dir)
    both = c.prose_candidates(b, "user", 1, 300).unionByName(c.prose_candidates(b, "assistant", 1, 300))
    return both.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.length("text").cast("long").alias("chars"))


LINES = "l AS (SELECT doc_id AS block_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)"
KEYED = f"WITH {LINES}, k AS (SELECT *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS key FROM l), n AS (SELECT *, count(*) OVER (PARTITION BY block_id, key) AS n, row_number() OVER (PARTITION BY block_id, key ORDER BY pos) AS rn FROM k)"


@query(f"{KEYED} SELECT block_id, count(*) AS lines, md5(string_agg(CASE WHEN key <> '' AND n >= 3 THEN line || chr(10) || '  ... [repeated ' || (n - 1) || ' more times]' ELSE line END, chr(10) ORDER BY pos)) AS body FROM n WHERE key = '' OR n < 3 OR rn = 1 GROUP BY block_id")
def line_dedup_in_block(spark, sf_dir):
    """Repeated lines of a block become one line and a count; the text is put together again."""
    kept = ln.dedup_lines(ln.to_lines(document_blocks(spark, sf_dir)))
    marked = kept.groupBy("block_id").agg(F.count_if(F.col("pos") % 2 == 0).alias("lines"))
    return marked.join(ln.to_texts(kept), "block_id").select("block_id", "lines", F.md5("text").alias("body"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY lang, md5(text) ORDER BY doc_id DESC) AS rn FROM documents) SELECT doc_id, substr(md5(text), 1, 6) AS kept_ref, length(text) AS saved_chars FROM r WHERE length(text) >= 200 AND rn > 1")
def block_dedup_latest(spark, sf_dir):
    """Of equal texts of a scope the latest stays; the others refer to it."""
    out = c.dedup_blocks(read(spark, sf_dir, "documents").select("doc_id", "lang", "text"), ["lang"], ["doc_id"])
    return out.where("kept_ref is not null").select("doc_id", "kept_ref", F.col("saved_chars").cast("long").alias("saved_chars"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY lang, md5(text) ORDER BY doc_id DESC) AS rn FROM documents) SELECT lang, count(*) AS blocks, count(*) FILTER (rn > 1 AND length(text) >= 200) AS repeated, CAST(coalesce(sum(length(text)) FILTER (rn > 1 AND length(text) >= 200), 0) AS BIGINT) AS saved_chars FROM r GROUP BY lang")
def dedup_savings(spark, sf_dir):
    out = c.dedup_blocks(read(spark, sf_dir, "documents").select("doc_id", "lang", "text"), ["lang"], ["doc_id"])
    return out.groupBy("lang").agg(F.count(F.lit(1)).alias("blocks"), F.count("kept_ref").alias("repeated"), F.sum("saved_chars").alias("saved_chars"))


@query("SELECT DISTINCT md5(text) AS hash, substr(md5(text), 1, 6) AS block_id6, length(text) AS chars FROM documents")
def content_store(spark, sf_dir):
    return c.build_store(document_blocks(spark, sf_dir)).select("hash", "block_id6", F.length("text").cast("long").alias("chars"))


@query("SELECT block_id6, count(*) AS n FROM (SELECT DISTINCT md5(CAST(l_orderkey AS VARCHAR) || ':' || l_partkey) AS h, substr(md5(CAST(l_orderkey AS VARCHAR) || ':' || l_partkey), 1, 6) AS block_id6 FROM lineitem) GROUP BY block_id6 HAVING count(*) > 1")
def id6_collision_audit(spark, sf_dir):
    """Six digits are few: different texts that share an id."""
    texts = read(spark, sf_dir, "lineitem").select(F.concat_ws(":", "l_orderkey", "l_partkey").alias("text"))
    return c.id_collisions(c.build_store(texts))


@query(f"WITH {LINES}, n AS (SELECT *, count(*) OVER (PARTITION BY block_id) AS n FROM l) SELECT block_id, count(*) AS lines, md5(string_agg(CASE WHEN n > 6 AND pos = 2 THEN line || chr(10) || '... [' || (n - 5) || ' lines omitted] ...' ELSE line END, chr(10) ORDER BY pos)) AS body FROM n WHERE n <= 6 OR pos < 3 OR pos >= n - 2 GROUP BY block_id")
def head_tail(spark, sf_dir):
    kept = ln.head_tail(ln.to_lines(document_blocks(spark, sf_dir)), 3, 2, 6)
    return kept.groupBy("block_id").agg(F.count_if(F.col("pos") % 2 == 0).alias("lines")).join(ln.to_texts(kept), "block_id").select("block_id", "lines", F.md5("text").alias("body"))


@query("WITH d AS (SELECT regexp_replace(split_part(url, '?', 1), '/[^/]*$', '') AS dir FROM pages) SELECT dir, count(*) AS files FROM d GROUP BY dir")
def dir_summary(spark, sf_dir):
    return read(spark, sf_dir, "pages").select(F.regexp_replace(F.substring_index("url", "?", 1), "/[^/]*$", "").alias("dir")).groupBy("dir").agg(F.count(F.lit(1)).alias("files"))


OPEN, CLOSE = "(?i)^(th|en)", "(?i)^(an|le)"


@query(f"WITH {LINES}, e AS (SELECT *, CASE WHEN regexp_matches(line, '{OPEN}') THEN 1 WHEN regexp_matches(line, '{CLOSE}') THEN 0 END AS event FROM l), s AS (SELECT *, last_value(event IGNORE NULLS) OVER (PARTITION BY block_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS state FROM e) SELECT block_id, count(*) AS kept, CAST(sum(pos) AS BIGINT) AS places FROM s WHERE event = 1 OR (event IS NULL AND state = 1 AND NOT regexp_matches(line, '^\\s*$')) GROUP BY block_id")
def keep_islands(spark, sf_dir):
    kept = ln.keep_islands(ln.to_lines(document_blocks(spark, sf_dir)), F.col("line").rlike(OPEN), F.col("line").rlike(CLOSE))
    return kept.groupBy("block_id").agg(F.count(F.lit(1)).alias("kept"), F.sum("pos").alias("places"))


@query(f"WITH {LINES}, m AS (SELECT *, CASE WHEN regexp_matches(line, '[0-9]') THEN 1 ELSE 0 END AS m FROM l), w AS (SELECT *, max(m) OVER (PARTITION BY block_id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM m) SELECT block_id, count(*) AS kept, CAST(sum(pos) AS BIGINT) AS places FROM w WHERE m = 1 OR (near = 1 AND NOT regexp_matches(line, '^\\s*$')) GROUP BY block_id")
def error_context(spark, sf_dir):
    """Matching lines with a neighbour on each side, each once."""
    kept = ln.keep_with_context(ln.to_lines(document_blocks(spark, sf_dir)), F.col("line").rlike("[0-9]"))
    return kept.groupBy("block_id").agg(F.count(F.lit(1)).alias("kept"), F.sum("pos").alias("places"))


@query(
    f"WITH {LINES} SELECT block_id, count(*) AS lines, md5(string_agg(regexp_replace(line, '[0-9]+', '#', 'g'), chr(10) ORDER BY pos)) AS body "
    "FROM l WHERE regexp_matches(line, '[AEIOUaeiou]') GROUP BY block_id"
)
def lines_kept_and_rewritten(spark, sf_dir):
    """Lines that a predicate picks, their numbers masked."""
    kept = ln.keep_lines(ln.to_lines(document_blocks(spark, sf_dir)), F.col("line").rlike("[AEIOUaeiou]"))
    masked = ln.rewrite_lines(kept, "[0-9]+", "#")
    counts = masked.groupBy("block_id").agg(F.count(F.lit(1)).alias("lines"))
    return counts.join(ln.to_texts(masked), "block_id").select("block_id", "lines", F.md5("text").alias("body"))


@query(f"WITH {LINES}, k AS (SELECT *, substr(line, 1, 2) AS key FROM l), f AS (SELECT *, row_number() OVER (PARTITION BY block_id, key ORDER BY pos) AS nth, count(*) OVER (PARTITION BY block_id, key) AS n, min(pos) OVER (PARTITION BY block_id, key) AS first FROM k), g AS (SELECT *, dense_rank() OVER (PARTITION BY block_id ORDER BY first) AS group_no FROM f) SELECT block_id, key, group_no, n AS n_in_group, count(*) AS shown FROM g WHERE nth <= 2 AND group_no <= 5 GROUP BY ALL")
def group_and_cap(spark, sf_dir):
    kept = ln.group_and_cap(ln.to_lines(document_blocks(spark, sf_dir)), F.substring("line", 1, 2), 2, 5)
    return kept.groupBy("block_id", "key", F.col("group_no").cast("long").alias("group_no"), "n_in_group").agg(F.count(F.lit(1)).alias("shown"))


@query(f"WITH {LINES}, r AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^[AEIOU]') THEN 1 ELSE 0 END) OVER (PARTITION BY block_id ORDER BY pos) AS record FROM l) SELECT block_id, CAST(record AS BIGINT) AS record, min(pos) AS pos, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM r WHERE record > 0 GROUP BY ALL")
def fold_records(spark, sf_dir):
    found = ln.fold_records(ln.to_lines(document_blocks(spark, sf_dir)), F.col("line").rlike("^[AEIOU]"), F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("chars"))
    return found.withColumn("pos", F.col("pos").cast("long"))


@query(f"WITH {LINES}, m AS (SELECT *, regexp_matches(line, '^[AEIOU]') AS ch FROM l), w AS (SELECT *, last_value(CASE WHEN ch THEN pos END IGNORE NULLS) OVER (PARTITION BY block_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS lastc FROM m) SELECT block_id, count(*) AS kept, CAST(sum(pos) AS BIGINT) AS places FROM w WHERE pos - lastc <= 1 GROUP BY block_id")
def diff_context(spark, sf_dir):
    kept = ln.context_budget(ln.to_lines(document_blocks(spark, sf_dir)), F.col("line").rlike("^[AEIOU]"))
    return kept.groupBy("block_id").agg(F.count(F.lit(1)).alias("kept"), F.sum("pos").alias("places"))


CUT = """WITH d AS (SELECT len(string_split(text, chr(10))) AS k FROM documents WHERE text IS NOT NULL)
SELECT CASE WHEN k > 80 THEN 'cut' ELSE 'whole' END AS kind, count(*) AS n, CAST(sum(CASE WHEN k > 80 THEN 30 ELSE k END) AS BIGINT) AS lines FROM d GROUP BY 1"""


@query(CUT)
def truncation_audit(spark, sf_dir):
    """Texts that a cut to their first 20 and last 10 lines shortens, those that it leaves whole, and the lines that stay."""
    kept = ln.head_tail(ln.to_lines(document_blocks(spark, sf_dir)), 20, 10, 80)
    notes = F.count_if(F.col("pos") % 2 == 1)
    per = kept.groupBy("block_id").agg(notes.alias("notes"), (F.count(F.lit(1)) - notes).alias("lines"))
    return per.groupBy(F.when(F.col("notes") > 0, "cut").otherwise("whole").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum("lines").alias("lines"))


@query()
def pattern_coverage(spark, sf_dir):
    """How often each rule fires, documents taken for command output. ``rule_coverage`` counts rules on output of commands."""
    return rules.coverage(rules.classify(document_blocks(spark, sf_dir).withColumn("tool", F.lit("bash")))).select("pattern", "n")


@query()
def rule_compaction(spark, sf_dir):
    """Documents compacted as output of four tools in turn."""
    tool = F.get(F.array(F.lit("bash"), F.lit("read"), F.lit("grep"), F.lit("glob")), (F.col("block_id") % 4).cast("int"))
    return rules.compact_blocks(document_blocks(spark, sf_dir).withColumn("tool", tool)).select("block_id", "pattern", "original_chars", "compact_chars", F.md5("text").alias("body"))


def _short_phrases_sql(text: str) -> str:
    for phrase, short in t.VERBOSE:
        text = f"regexp_replace({text}, '(?i)\\b{phrase}\\b', '{short}', 'g')"
    return text


PHRASES = "[" + ", ".join(f"'{phrase}'" for phrase, _ in t.VERBOSE) + "]"
GROWN = f"replace(text, ' the ', ' ' || {PHRASES}[turn % {len(t.VERBOSE)} + 1] || ' ')"


@query(f"SELECT conv_id, turn, md5({_short_phrases_sql(GROWN)}) AS body FROM conversations")
def verbose_phrases(spark, sf_dir):
    """Every verbose phrase in turn is put into the texts and shortened again."""
    phrase = F.get(F.array(*[F.lit(p) for p, _ in t.VERBOSE]), F.col("turn") % len(t.VERBOSE))
    grown = blocks(spark, sf_dir).withColumn("text", F.replace("text", F.lit(" the "), F.concat(F.lit(" "), phrase, F.lit(" "))))
    return grown.select("conv_id", F.col("turn").cast("long").alias("turn"), F.md5(t.short_phrases(F.col("text"))).alias("body"))


TOTAL = "count(*) AS requests, CAST(sum(original_chars) AS BIGINT) AS original_chars, CAST(sum(saved_chars) AS BIGINT) AS saved_chars"
PERCENT = "CASE WHEN sum(original_chars) > 0 THEN floor(CAST(sum(saved_chars) AS DOUBLE) / sum(original_chars) * 1000 + 0.5) / 10 ELSE 0.0 END AS saving_percent"
TOKENS = "CAST(floor(sum(saved_chars) / 3.5 + 0.5) AS BIGINT) AS saved_tokens"


@query(f"{REQ} SELECT {TOTAL}, {PERCENT}, {TOKENS} FROM req")
def savings_totals(spark, sf_dir):
    return s.savings_by(requests(spark, sf_dir), []).drop("dim", "value")


def _dims(name: str) -> str:
    return f"SELECT '{name}' AS dim, {name} AS value, {TOTAL}, {PERCENT}, {TOKENS} FROM req GROUP BY {name}"


@query(f"{REQ} {_dims('tool')} UNION ALL {_dims('project')} UNION ALL {_dims('client')} UNION ALL {_dims('model')} UNION ALL SELECT 'all', NULL, {TOTAL}, {PERCENT}, {TOKENS} FROM req")
def savings_by_dim_sets(spark, sf_dir):
    """By tool, project, client, model and overall, in one pass over the log."""
    return s.savings_by(requests(spark, sf_dir), ["tool", "project", "client", "model"])


LINEITEM = "SELECT l_returnflag AS tool, l_linestatus AS project, CAST(floor(l_extendedprice) AS BIGINT) AS original_chars, CAST(floor(l_extendedprice * l_discount) AS BIGINT) AS saved_chars FROM lineitem"


@query(f"WITH req AS ({LINEITEM}) {_dims('tool')} UNION ALL {_dims('project')} UNION ALL SELECT 'all', NULL, {TOTAL}, {PERCENT}, {TOKENS} FROM req")
def savings_lineitem_sets(spark, sf_dir):
    log = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("tool"), F.col("l_linestatus").alias("project"), F.floor("l_extendedprice").alias("original_chars"), F.floor(F.col("l_extendedprice") * F.col("l_discount")).alias("saved_chars"))
    return s.savings_by(log, ["tool", "project"])


@query(f"{REQ} SELECT tool, CAST(sum(saved_chars) AS BIGINT) AS saved_chars, count(*) AS n, CAST(sum(saved_chars) AS DOUBLE) / max(sum(saved_chars)) OVER () AS share_of_max FROM req GROUP BY tool ORDER BY saved_chars DESC, tool LIMIT 8")
def savings_top_tools(spark, sf_dir):
    """A top list is what is asked for: eight tools."""
    per = requests(spark, sf_dir).groupBy("tool").agg(F.sum("saved_chars").alias("saved_chars"), F.count(F.lit(1)).alias("n"))
    return per.withColumn("share_of_max", F.col("saved_chars") / F.max("saved_chars").over(Window.partitionBy())).orderBy(F.desc("saved_chars"), "tool").limit(8)


CARRIED = f"{REQ}, c AS (SELECT * REPLACE (coalesce(last_value(nullif(project, 'unknown') IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ts, request_id ROWS UNBOUNDED PRECEDING), 'unknown') AS project) FROM req)"


@query(f"{CARRIED} SELECT session_id, arg_max(project, (ts, request_id)) AS project, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS end_ts, {TOTAL} FROM c GROUP BY session_id")
def session_rollup(spark, sf_dir):
    when = lambda x: F.date_format(x, "yyyy-MM-dd HH:mm:ss").alias(x)
    return s.sessions(s.carry_project(requests(spark, sf_dir))).select("session_id", "project", when("start_ts"), when("end_ts"), "requests", "original_chars", "saved_chars")


@query(f"{CARRIED}, x AS (SELECT session_id, arg_max(project, (ts, request_id)) AS project, count(*) AS n, sum(saved_chars) AS s FROM c GROUP BY session_id) SELECT project, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS requests, CAST(floor(sum(s) / 3.5 + 0.5) AS BIGINT) AS saved_tokens FROM x GROUP BY project")
def project_aggregates(spark, sf_dir):
    return s.project_aggregates(s.sessions(s.carry_project(requests(spark, sf_dir)))).drop("last_ts")


@query(f"{CARRIED} SELECT request_id, project FROM c")
def project_carry_forward(spark, sf_dir):
    return s.carry_project(requests(spark, sf_dir)).select("request_id", "project")


@query("WITH r AS (SELECT value AS ms, ts, event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 200) SELECT count(*) AS n, quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.95) AS p95, quantile_disc(ms, 0.99) AS p99, round(avg(ms), 6) AS mean, arg_max(ms, (ts, event_id)) AS last FROM r")
def latency_last_200(spark, sf_dir):
    """The window of the last 200 samples is what is asked for."""
    return s.latency_summary(requests(spark, sf_dir)).withColumn("mean", F.round("mean", 6))


LAST = "(ORDER BY ts, event_id ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)"


@query(
    f"SELECT event_id AS request_id, count(*) OVER {LAST} AS n, quantile_disc(value, 0.5) OVER {LAST} AS p50, quantile_disc(value, 0.95) OVER {LAST} AS p95, "
    f"quantile_disc(value, 0.99) OVER {LAST} AS p99, value AS last FROM events"
)
def latency_rolling(spark, sf_dir):
    """Percentiles of the last 200 samples as each request saw them."""
    return s.rolling_latency(requests(spark, sf_dir))


@query("WITH x AS (SELECT user_id % 3 AS client, count(*) FILTER (event_type = 'purchase') AS calls, count(*) FILTER (event_type = 'view') AS compressions FROM events GROUP BY 1), r AS (SELECT *, CASE WHEN compressions > 0 THEN floor(calls::DOUBLE / compressions * 1000 + 0.5) / 10 ELSE 0.0 END AS rate FROM x) SELECT *, CASE WHEN rate > 25 THEN 'red' WHEN rate > 10 THEN 'yellow' ELSE 'green' END AS band FROM r")
def expand_rate(spark, sf_dir):
    e = read(spark, sf_dir, "events").groupBy((F.col("user_id") % 3).alias("client")).agg(F.count_if(F.col("event_type") == "purchase").alias("calls"), F.count_if(F.col("event_type") == "view").alias("compressions"))
    return e.withColumn("rate", s.expand_rate(F.col("compressions"), F.col("calls"))).withColumn("band", s.rate_band(F.col("rate")))


@query(f"{REQ}, x AS (SELECT sum(saved_chars) AS all_saved, count(*) FILTER (tool = 'view') AS calls FROM req), g AS (SELECT CAST(floor(all_saved / 3.5 + 0.5) AS BIGINT) AS gross_tokens, calls * 1650 AS call_tokens FROM x) SELECT gross_tokens, call_tokens, greatest(0, gross_tokens - call_tokens) AS net_tokens, call_tokens > greatest(0, gross_tokens - call_tokens) AS warning FROM g")
def gain_net(spark, sf_dir):
    part = lambda x: F.sum(F.when(x, F.col("saved_chars")).otherwise(0))
    tool = F.col("tool")
    totals = requests(spark, sf_dir).agg(part(tool == "click").alias("det_saved"), part(tool == "error").alias("dedup_saved"), part(tool == "view").alias("ai_saved"), part(~tool.isin("click", "error", "view")).alias("sysprompt_saved"), F.count_if(tool == "view").alias("calls"))
    return s.gain(totals).withColumn("net_tokens", F.col("net_tokens").cast("long"))


PRICES = [(0, "gpt-4o", 2.5), (1, "gpt-4o-mini", 0.15), (2, "o1", 15.0), (3, "o1-mini", 3.0), (4, "gemini-1.5-pro", 1.25)]
PRICE_SQL = "prices(ord, key, input) AS (VALUES (0, 'gpt-4o', 2.5::DOUBLE), (1, 'gpt-4o-mini', 0.15), (2, 'o1', 15.0), (3, 'o1-mini', 3.0), (4, 'gemini-1.5-pro', 1.25))"
COST = "WITH {prices}, m AS (SELECT model, CAST(floor(sum(original_chars) / 3.5 + 0.5) AS BIGINT) AS tokens, CAST(floor(sum(saved_chars) / 3.5 + 0.5) AS BIGINT) AS saved FROM req GROUP BY model), p AS (SELECT model, arg_max(input, {order}) AS price FROM m JOIN prices ON contains(lower(model), key) GROUP BY model) SELECT m.model, coalesce(price, 3.0) AS price, round(tokens * coalesce(price, 3.0) / 1e6, 9) AS without, round(saved * coalesce(price, 3.0) / 1e6, 9) AS saved, round((tokens - saved) * coalesce(price, 3.0) / 1e6, 9) AS with_saving FROM m LEFT JOIN p ON m.model = p.model"


def prices(spark):
    return spark.createDataFrame(PRICES, "ord int, key string, input double")


@query(REQ + ", " + COST.format(prices=PRICE_SQL, order="length(key)").removeprefix("WITH "))
def model_cost(spark, sf_dir):
    cost = s.model_cost(requests(spark, sf_dir), prices(spark))
    return cost.select("model", "price", *[F.round(x, 9).alias(x) for x in ("without", "saved", "with_saving")])


@query(f"WITH {PRICE_SQL}, m AS (SELECT DISTINCT ['gpt-4o-mini-2024-07-18', 'gpt-4o', 'o1-mini-x', 'gemini-1.5-pro', 'other'][(event_id % 5) + 1] AS model FROM events), p AS (SELECT model, arg_min(input, ord) AS price FROM m JOIN prices ON contains(model, key) GROUP BY model) SELECT m.model, coalesce(price, 3.0) AS price FROM m LEFT JOIN p ON m.model = p.model")
def price_match_legacy(spark, sf_dir):
    return s.match_prices(requests(spark, sf_dir), prices(spark), legacy_order=True)


@query(f"{REQ} SELECT CAST(hour(ts) // 5 AS BIGINT) AS bucket, {TOTAL}, {PERCENT} FROM req GROUP BY 1")
def slots_5h(spark, sf_dir):
    return s.savings_over_time(requests(spark, sf_dir), s.slot(F.col("ts")))


@query(f"{REQ} SELECT (CAST(ts AS DATE) - CAST(dayofweek(ts) AS INTEGER))::VARCHAR AS bucket, {TOTAL}, {PERCENT} FROM req GROUP BY 1")
def week_sunday(spark, sf_dir):
    return s.savings_over_time(requests(spark, sf_dir), s.week_start(F.col("ts")).cast("string"))


@query(f"{REQ}, c AS (SELECT session_id, CASE tool WHEN 'view' THEN 'read' WHEN 'click' THEN 'bash' ELSE tool END AS tool, original_chars AS hash, original_chars, saved_chars, request_id % 3 > 0 AS hit FROM req), p AS (SELECT session_id, count(*) FILTER (tool = 'read') AS r, count(*) FILTER (tool = 'bash') AS b, count(*) FILTER (tool = 'read') - count(DISTINCT hash) FILTER (tool = 'read') AS d, sum(saved_chars) FILTER (tool = 'read') AS s, sum(original_chars) FILTER (tool = 'read') AS o, avg(CAST(hit AS INT)) AS h FROM c GROUP BY session_id), f AS (SELECT session_id, list_filter([CASE WHEN r > 20 THEN 'reads_red' WHEN r > 5 THEN 'reads' END, CASE WHEN d > 0 THEN 'repeated_reads' END, CASE WHEN b > 30 THEN 'bash' END, CASE WHEN r > 3 AND s * 10 < o THEN 'reads_save_little' END, CASE WHEN h > 0.5 THEN 'cache_works' END], lambda x: x IS NOT NULL) AS fs FROM p) SELECT session_id, unnest(CASE WHEN len(fs) = 0 THEN ['none'] ELSE fs END) AS flag FROM f")
def habit_flags(spark, sf_dir):
    calls = requests(spark, sf_dir).withColumn("tool", F.when(F.col("tool") == "view", "read").when(F.col("tool") == "click", "bash").otherwise(F.col("tool"))).withColumn("hash", F.col("original_chars")).withColumn("hit", F.col("request_id") % 3 > 0)
    return s.habit_flags(calls)


@query("WITH l AS (SELECT 'c' || (user_id % 10) AS client, ts, event_id, CASE WHEN event_type = 'view' THEN 0 ELSE 1000 + user_id END AS lim, CAST(floor(value * 3) AS BIGINT) % 1000 AS remaining FROM events), x AS (SELECT client, arg_max(lim, (ts, event_id)) FILTER (lim > 0) AS \"limit\", arg_max(remaining, (ts, event_id)) AS remaining FROM l GROUP BY client), u AS (SELECT *, floor(CAST(\"limit\" - remaining AS DOUBLE) / \"limit\" * 1000 + 0.5) / 10 AS used_percent FROM x) SELECT *, CASE WHEN used_percent > 90 THEN 'crit' WHEN used_percent > 70 THEN 'warn' ELSE 'ok' END AS severity FROM u")
def limits_latest_sticky(spark, sf_dir):
    """A zero limit keeps the last known one; what remains is the latest."""
    e = read(spark, sf_dir, "events")
    return s.limits_latest(e.select(F.concat(F.lit("c"), (F.col("user_id") % 10).cast("string")).alias("client"), "ts", "event_id", F.when(F.col("event_type") == "view", 0).otherwise(1000 + F.col("user_id")).alias("limit"), (F.floor(F.col("value") * 3) % 1000).alias("remaining")))


USED = "CAST(sum(saved_chars) AS BIGINT) AS input_tokens, CAST(sum(original_chars) AS BIGINT) AS output_tokens"
COUNTED = "count(*) FILTER (saved_chars > 0 OR (client = 'client1' AND original_chars > 0)) AS requests"


@query(f"{REQ} SELECT client, CAST(ts AS DATE)::VARCHAR AS day, {USED}, {COUNTED} FROM req GROUP BY 1, 2")
def usage_daily(spark, sf_dir):
    """One client's requests count with any tokens, those of the others with input only."""
    usage = requests(spark, sf_dir).withColumnsRenamed({"saved_chars": "input_tokens", "original_chars": "output_tokens"})
    return s.usage_daily(usage, F.col("client") == "client1").withColumn("day", F.col("day").cast("string"))


@query("SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS input_tokens FROM events WHERE event_type <> 'view'")
def usage_from_stream_lines(spark, sf_dir):
    """Event-stream lines made of the events' JSON; end marks carry no usage."""
    lines = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "view", "data: [DONE]").otherwise(F.concat(F.lit('data: {"usage": '), F.replace("props", F.lit('"k"'), F.lit('"input_tokens"')), F.lit("}"))).alias("value"))
    return usage_from_events(lines).select("event_id", "input_tokens")


@query("WITH c AS (SELECT user_id % 5 AS backend, ts, event_id, event_type <> 'error' AS ok FROM events), w AS (SELECT *, sum(CAST(ok AS INT)) OVER (PARTITION BY backend ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM c) SELECT backend, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS end_ts, count(*) AS failures FROM w WHERE NOT ok GROUP BY backend, k HAVING count(*) >= 3")
def outage_streaks(spark, sf_dir):
    calls = read(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("backend"), F.col("ts").cast("timestamp").alias("ts"), "event_id", (F.col("event_type") != "error").alias("ok"))
    when = lambda x: F.date_format(x, "yyyy-MM-dd HH:mm:ss").alias(x)
    return s.outage_streaks(calls).select("backend", when("start_ts"), when("end_ts"), "failures")


def known_summaries(spark, sf_dir):
    return read(spark, sf_dir, "documents").where("lang = 'en'").select(F.md5("text").alias("hash"), F.concat(F.lit("known: "), "text").alias("summary")).dropDuplicates(["hash"])


KNOWN = "k AS (SELECT md5(text) AS hash, any_value(md5('known: ' || text)) AS summary FROM documents WHERE lang = 'en' GROUP BY 1)"


@query(f"WITH {KNOWN} SELECT doc_id, md5(text) AS hash, summary FROM documents JOIN k ON md5(text) = hash")
def cache_hits_join(spark, sf_dir):
    hits, _ = c.split_known(read(spark, sf_dir, "documents").select("doc_id", "text"), known_summaries(spark, sf_dir))
    return hits.select("doc_id", "hash", F.md5("summary").alias("summary"))


@query(f"WITH {KNOWN} SELECT doc_id, md5(text) AS hash FROM documents WHERE md5(text) NOT IN (SELECT hash FROM k)")
def cache_misses_anti(spark, sf_dir):
    _, misses = c.split_known(read(spark, sf_dir, "documents").select("doc_id", "text"), known_summaries(spark, sf_dir))
    return misses.select("doc_id", "hash")


@query("SELECT md5(CAST(event_id AS VARCHAR)) AS hash, event_id FROM events ORDER BY ts DESC, md5(CAST(event_id AS VARCHAR)) LIMIT 1000")
def cache_retention(spark, sf_dir):
    """A store keeps its newest thousand entries, which is what is asked for."""
    return c.retain(read(spark, sf_dir, "events").select(F.md5(F.col("event_id").cast("string")).alias("hash"), "ts", "event_id")).drop("ts")


@query("WITH d AS (SELECT DISTINCT md5(text) AS hash, text FROM documents), l AS (SELECT hash, length(text) AS original_chars, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS lines FROM d) SELECT hash, original_chars, len(lines) AS lines, lines[1] AS first_line FROM l")
def summary_inputs(spark, sf_dir):
    """What the local summary starts from: each distinct text once, its non-blank lines and the first of them."""
    d = read(spark, sf_dir, "documents").select(F.md5("text").alias("hash"), "text").dropDuplicates(["hash"])
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return d.select("hash", F.length("text").cast("long").alias("original_chars"), F.size(lines).cast("long").alias("lines"), F.get(lines, F.lit(0)).alias("first_line"))


@query(
    "WITH d AS (SELECT DISTINCT md5(text) AS hash, text FROM documents), l AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS lines FROM d), "
    r"c AS (SELECT *, list_concat(list_concat(lines[1:2], list_filter(lines, lambda x: regexp_matches(x, '(?i)\b(error|failed|exception|fatal)\b'))[1:3]), lines[-1:]) AS x FROM l) "
    "SELECT hash, CASE WHEN text IS NOT NULL THEN md5(coalesce(array_to_string(list_filter(x, lambda v, i: list_position(x, v) = i), chr(10)), '')) END AS summary_md5, length(text) AS original_chars FROM c"
)
def summarise_extractive(spark, sf_dir):
    """Local summaries of all distinct documents."""
    return c.summarise(read(spark, sf_dir, "documents")).select("hash", F.md5("summary").alias("summary_md5"), "original_chars")


@query("SELECT doc_id, md5(text) AS body FROM documents")
def reinflate(spark, sf_dir):
    """Texts are replaced by tags with their id and their local summary, then looked up in the store: all must come back."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    short = docs.withColumn("text", c.tagged(t.content_id(F.col("text")), c.extractive(F.col("text")), F.greatest(F.length("text"), F.lit(1))))
    # Ids that two texts share are not used as tags, as they could not tell them apart.
    unique = c.build_store(docs).join(c.id_collisions(c.build_store(docs)).select("block_id6"), "block_id6", "left_anti")
    kept = docs.withColumn("ref", t.content_id(F.col("text"))).join(unique.select(F.col("block_id6").alias("ref")), "ref", "left_anti").select("doc_id", "text")
    tagged = short.join(kept.select("doc_id"), "doc_id", "left_anti").unionByName(kept)
    return c.reinflate(tagged, unique).select("doc_id", F.md5("text").alias("body"))
