"""Streaming queries: ``events`` as a stream, run over all that there is, with the SQL of the batch that they must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from txcompact.operators import savings as s
from txcompact.operators.rules import compact_blocks
from txcompact.plans import outputs
from txcompact.plans.queries import REQ, SQL, query, read, read_stream, requests
from txcompact.sources.transcripts import stitched_lines, usage_from_events
from txcompact.streaming import streaks, usage
from txcompact.streaming.run import available, dropped_late, in_batches

WHEN = "yyyy-MM-dd HH:mm:ss"
DAY = "%Y-%m-%d %H:%M:%S"


@query(f"{REQ} SELECT client, ts::DATE::VARCHAR AS day, CAST(sum(original_chars) AS BIGINT) AS input_tokens, count(*) AS requests FROM req GROUP BY 1, 2")
def stream_usage_by_day(spark, sf_dir):
    log = requests(spark, sf_dir, stream=True).withColumn("input_tokens", F.col("original_chars"))
    return available(usage.usage_by_day(log), "update", ["client", "day"]).withColumn("day", F.col("day").cast("string"))


@query(f"{REQ} SELECT ts::DATE::VARCHAR AS day, CAST(hour(ts) // 5 AS BIGINT) AS slot, CAST(sum(saved_chars) AS BIGINT) AS saved_chars FROM req GROUP BY 1, 2")
def stream_savings_by_slot(spark, sf_dir):
    return available(usage.savings_by_slot(requests(spark, sf_dir, stream=True)), "update", ["day", "slot"]).withColumn("day", F.col("day").cast("string"))


SESSIONS = f"""{REQ}, g AS (SELECT client, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY client ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM req),
n AS (SELECT *, sum(new) OVER (PARTITION BY client ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
x AS (SELECT client, min(ts) AS a, max(ts) + INTERVAL 30 MINUTE AS b, count(*) AS requests FROM n GROUP BY client, k)"""


@query(f"{SESSIONS} SELECT client, strftime(a, '{DAY}') AS start_ts, strftime(b, '{DAY}') AS end_ts, requests FROM x WHERE b <= (SELECT max(ts) FROM req) - INTERVAL 1 HOUR")
def stream_sessions(spark, sf_dir):
    """Sessions by gap that the watermark has closed; ``stream_sessions_open`` gives the others too."""
    when = lambda x: F.date_format(x, WHEN).alias(x)
    return available(usage.sessions_by_gap(requests(spark, sf_dir, stream=True))).select("client", when("start_ts"), when("end_ts"), "requests")


@query(f"{SESSIONS} SELECT client, strftime(a, '{DAY}') AS start_ts, strftime(b, '{DAY}') AS end_ts, requests, b > (SELECT max(ts) FROM req) AS open FROM x")
def stream_sessions_open(spark, sf_dir):
    """All sessions by gap, over four micro-batches; those that the end of the stream leaves open are marked."""
    log = in_batches(requests(spark, sf_dir).select("client", "ts"), "ts")
    when = lambda x: F.date_format(x, WHEN)
    found = available(log, carry=streaks.sessions_with_open(), rest=True)
    return found.select("client", when("a").alias("start_ts"), when(F.col("b") + F.expr("INTERVAL 30 MINUTES")).alias("end_ts"), "requests", "open")


CALLS = "c AS (SELECT user_id % 5 AS backend, epoch_ms(ts) AS ms, ts, event_id, event_type <> 'error' AS ok FROM events)"


@query(f"""WITH {CALLS}, g AS (SELECT *, sum(CAST(ok AS INT)) OVER w AS run, lead(ms) OVER w AS next, lag(ms) OVER w AS prev, max(ms) OVER () AS newest FROM c WINDOW w AS (PARTITION BY backend ORDER BY ts, event_id)),
k AS (SELECT *, CASE WHEN ok THEN 0 ELSE row_number() OVER (PARTITION BY backend, run, ok ORDER BY ts, event_id) END AS n FROM g),
p AS (SELECT *, lag(n) OVER (PARTITION BY backend ORDER BY ts, event_id) AS before FROM k),
e AS (SELECT backend, ms, 'open' AS status, n FROM p WHERE n = 3 OR (n > 3 AND ms - prev >= 1800000)
  UNION ALL SELECT backend, ms + 1800000, 'half_open', n FROM p WHERE n >= 3 AND (next - ms >= 1800000 OR (next IS NULL AND ms + 1800000 <= newest))
  UNION ALL SELECT backend, ms, 'closed', before FROM p WHERE ok AND before >= 3)
SELECT backend, strftime(make_timestamp(ms * 1000), '{DAY}') AS ts, status, CAST(n AS INTEGER) AS failures FROM e""")
def stream_breakers(spark, sf_dir):
    """Breakers of five backends over four micro-batches: opened by three failures, half open after thirty minutes, closed by a success."""
    e = read(spark, sf_dir, "events")
    calls = e.select((F.col("user_id") % 5).alias("backend"), F.col("ts").cast("timestamp").alias("ts"), "event_id", (F.col("event_type") != "error").alias("ok"))
    name, provider = streaks.ROCKSDB
    was = spark.conf.get(name)
    spark.conf.set(name, provider)
    try:
        found = available(streaks.breaker_changes(in_batches(calls, "ts"), cool_seconds=1800))
    finally:
        spark.conf.set(name, was)
    return found.select("backend", F.date_format("ts", WHEN).alias("ts"), "status", "failures")


@query("SELECT md5(text) AS hash, max(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY 1")
def stream_last_of_each(spark, sf_dir):
    """Equal texts over four micro-batches, in no order of their ids: the last by id stays, earlier ones are taken back."""
    docs = read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.md5("text").alias("hash"), (F.xxhash64("doc_id") % 1000).alias("at"))
    return available(in_batches(docs, "at").drop("at"), merge=streaks.keep_last(["hash"], ["doc_id"])).select("hash", "doc_id")


@query("""WITH e AS (SELECT ts, event_id % 4 AS batch FROM events), b AS (SELECT batch, max(ts) AS newest FROM e GROUP BY batch),
w AS (SELECT batch, max(newest) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) - INTERVAL 20 DAY AS mark FROM b)
SELECT count(*) AS calls, count(*) FILTER (mark IS NULL OR ts > mark) AS kept, count(*) FILTER (ts <= mark) AS late FROM e JOIN w USING (batch)""")
def stream_late_rows(spark, sf_dir):
    """Events dealt to four micro-batches whatever their times, with twenty days' patience: those kept and those that the
    query's reports count as late are all there are. Lateness is judged by the mark that the batch before began with."""
    events, reports = read(spark, sf_dir, "events"), []
    stream = usage.timed(in_batches(events.select("event_id", "ts", (F.col("event_id") % 4).alias("batch")), "batch", cuts=[1, 2, 3]), "20 days")
    kept = available(stream.dropDuplicatesWithinWatermark(["event_id"]).select("event_id"), progress=reports)
    return kept.agg(F.count(F.lit(1)).alias("kept")).select(F.lit(events.count()).alias("calls"), "kept", F.lit(dropped_late(reports)).cast("long").alias("late"))


@query(f"{REQ} SELECT DISTINCT session_id, tool FROM req")
def stream_first_of_each(spark, sf_dir):
    """Keys that a stream let through, each once: what was seen is held for ten years of event time."""
    log = requests(spark, sf_dir, stream=True).select("ts", "session_id", "tool")
    return available(usage.first_of_each(log, ["session_id", "tool"], "3650 days")).select("session_id", "tool")


@query(f"WITH c AS (SELECT user_id % 5 AS backend, ts, event_id, event_type <> 'error' AS ok FROM events), w AS (SELECT *, sum(CAST(ok AS INT)) OVER (PARTITION BY backend ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM c), n AS (SELECT *, row_number() OVER (PARTITION BY backend, k ORDER BY ts, event_id) AS r FROM w WHERE NOT ok) SELECT backend, strftime(ts, '{DAY}') AS ts, CAST(3 AS INTEGER) AS failures FROM n WHERE r = 3")
def stream_failure_alerts(spark, sf_dir):
    calls = read_stream(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("backend"), F.col("ts").cast("timestamp").alias("ts"), "event_id", (F.col("event_type") != "error").alias("ok"))
    return available(calls, carry=usage.failure_alerts()).withColumn("ts", F.date_format("ts", WHEN))


@query(SQL["limits_latest_sticky"])
def stream_latest_limits(spark, sf_dir):
    e = read_stream(spark, sf_dir, "events")
    limits = e.select(F.concat(F.lit("c"), (F.col("user_id") % 10).cast("string")).alias("client"), "ts", "event_id", F.when(F.col("event_type") == "view", 0).otherwise(1000 + F.col("user_id")).alias("limit"), (F.floor(F.col("value") * 3) % 1000).alias("remaining"))
    return available(s.limits_latest(limits), "update", ["client"])


@query(SQL["rules_git"])
def stream_rules(spark, sf_dir):
    """Command output over four micro-batches, classified and compacted batch by batch."""
    blocks = outputs.together(spark, sf_dir, outputs.FAMILIES["rules_git"]).withColumn("at", F.xxhash64("block_id") % 1000)
    # A batch comes in one file, which one task would read and compact.
    dealt = lambda rows: rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "block_id")
    each = lambda rows: compact_blocks(dealt(rows), pressure=F.col("pressure")).select("block_id", "pattern", "text")
    return available(in_batches(blocks, "at"), each=each)


EVENT_LINE = "'data: {\"usage\":{\"prompt_tokens\":' || event_id % 100 || ',\"completion_tokens\":' || user_id || '}}'"


@query("SELECT user_id, count(*) AS lines, CAST(sum(event_id % 100) AS BIGINT) AS input_tokens, CAST(sum(user_id) AS BIGINT) AS output_tokens FROM events GROUP BY user_id")
def usage_from_chunks(spark, sf_dir):
    """Usage lines of each user's event stream, cut into chunks of forty characters wherever that falls, and stitched again."""
    lines = read(spark, sf_dir, "events").select("user_id", "event_id", F.expr(EVENT_LINE).alias("line"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "line"))), lambda x: F.concat(x["line"], F.lit("\n\n")))
    whole = lines.groupBy("user_id").agg(F.concat(F.lit(": begin\n"), F.array_join(ordered, ""), F.lit("data: {unfinished")).alias("text"))
    chunks = whole.select("user_id", "text", F.posexplode(F.sequence(F.lit(1), F.length("text"), F.lit(40))).alias("n", "at")).select("user_id", "n", F.substring("text", F.col("at"), F.lit(40)).alias("chunk"))
    found = usage_from_events(stitched_lines(chunks, ["user_id"], "n", "chunk"), "line")
    return found.groupBy("user_id").agg(F.count(F.lit(1)).alias("lines"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
