"""Sources, conversations, line operators and streams."""

import json

from pyspark.sql import functions as F

from txcompact.config import CompactionConfig
from txcompact.functions import text as t
from txcompact.operators import compact as c
from txcompact.operators import lines as ln
from txcompact.operators import savings as s
from txcompact.operators.clean import clean
from txcompact.plans import queries
from txcompact.sources.transcripts import SCHEMAS, to_blocks, tool_input_fields, usage_from_events
from txcompact.streaming import usage
from txcompact.streaming.run import available


def rows(spark, shape, *docs):
    return spark.createDataFrame([(json.dumps(d),) for d in docs], "v string").select(F.from_json("v", "struct<" + SCHEMAS[shape].replace(" string", ":string").replace(" array", ":array") + ">").alias("x")).select("x.*")


def test_shapes_give_the_same_results(spark):
    a = rows(spark, "anthropic", {"conv_id": "1", "messages": [{"role": "assistant", "content": [{"type": "tool_use", "id": "t1", "name": "Bash", "input": "{\"command\": \"ls\"}"}]}, {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "content": "out"}, {"type": "tool_result", "tool_use_id": "t9", "content": "lost"}]}]})
    o = rows(spark, "openai", {"conv_id": "1", "messages": [{"role": "assistant", "content": None, "tool_calls": [{"id": "t1", "name": "Bash", "arguments": "{}"}]}, {"role": "tool", "tool_call_id": "t1", "content": "out"}, {"role": "tool", "tool_call_id": "t9", "content": "lost"}]})
    r = rows(spark, "responses", {"conv_id": "1", "input": [{"type": "function_call", "call_id": "t1", "name": "Bash", "arguments": "{}"}, {"type": "function_call_output", "call_id": "t1", "output": "out"}, {"role": "tool", "call_id": "t9", "content": "lost"}]})
    g = rows(spark, "gemini", {"conv_id": "1", "contents": [{"role": "user", "parts": [{"functionResponse": {"name": "Bash", "response": "out"}}, {"functionResponse": {"response": "lost"}}]}]})
    for shape, df in (("anthropic", a), ("openai", o), ("responses", r), ("gemini", g)):
        got = {(x.tool, x.text) for x in to_blocks(df, shape).where("kind = 'tool_result'").collect()}
        assert got == {("Bash", "out"), ("unknown", "lost")}, shape


def test_skip_mark_and_long_inputs(spark):
    long = "x" * 250
    a = rows(spark, "anthropic", {"conv_id": "1", "messages": [{"role": "assistant", "content": [{"type": "tool_use", "id": "t1", "name": "Bash", "input": "ls # tx: skip"}, {"type": "tool_use", "id": "t2", "name": "Edit", "input": json.dumps({"old_string": long, "new_string": "short"})}, {"type": "tool_use", "id": "t3", "name": "MultiEdit", "input": json.dumps({"edits": [{"old_string": "a", "new_string": long}]})}]}, {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "content": "out"}]}]})
    b = to_blocks(a, "anthropic")
    assert [r.skip for r in b.where("kind = 'tool_result'").collect()] == [True]
    assert {(r.tool, r.field) for r in tool_input_fields(b).collect()} == {("Edit", "old_string"), ("MultiEdit", "edits.0.new_string")}


def test_base_clean_literals(spark):
    frames = "Error: ECONNREFUSED\n    at one (a.js:1)\n    at two (b.js:2)\n    at three (c.js:3)"
    pretty = json.dumps({f"key_{i}": i for i in range(20)}, indent=2)
    cases = {
        "\x1b[32mhello\x1b[0m world": "hello world",
        "\x1b]0;title\x07text": "text",
        "result\n=================\nresult2": "result\nresult2",
        "alpha\n\n\n\n\nbeta": "alpha\nbeta",
        "hello   \nworld  ": "hello\nworld",
        "same line\n" * 4 + "same line": "same line\n  ... [repeated 4 more times]",
        "aaa\nbbb\naaa": "aaa\nbbb\naaa",
        "log: 2024-01-15T10:30:00Z event happened": "log:  event happened",
        "[10:30:00] something happened": "something happened",
        "": "",
        frames + "\n" + frames: frames + "\nError: ECONNREFUSED\n  ... [same 3-frame stack trace repeated]",
    }
    got = {r.block_id: r.text for r in clean(spark.createDataFrame(list(enumerate([*cases, pretty])), "block_id int, text string")).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    assert json.loads(got[len(cases)]) == json.loads(pretty) and "\n" not in got[len(cases)]


def test_prose_spares_code(spark):
    text = "So, I'll look. In order to **win** we _must_ try.\n```\nin order to **keep**\n```\nDone.\n\nIn summary, " + "x" * 60
    out = spark.createDataFrame([(text,)], "x string").select(t.clean_prose(F.col("x"))).first()[0]
    assert "in order to **keep**" in out and "to win we must try" in out and "summary" not in out


def test_numbers_and_times(spark):
    row = spark.sql("select -2.5D as x, timestamp'2024-01-07 23:59:00' as ts, timestamp'2024-01-01' as now").select(
        t.half_up(F.col("x")), s.slot(F.col("ts")), s.week_start(F.col("ts")).cast("string"), t.duration_seconds(F.lit("6m0s")), t.duration_seconds(F.lit("120ms")), t.reset_time(F.lit("1h"), F.col("now")).cast("string"),
        t.project_of(F.lit("x <cwd>/home/me/thing</cwd>")), t.project_of(F.lit("see /home/me/proj/deep/file.py")), t.project_of(F.lit("nothing")), t.project_of(F.lit("see C:\\\\Users\\\\dev\\\\shop\\\\src")),
    ).first()
    assert tuple(row) == (-2, 4, "2024-01-07", 360.0, 0.12, "2024-01-01 01:00:00", "thing", "me", "unknown", "shop")


def test_conversations_save_and_reinflate(spark):
    body = "\n".join(f"plain line number {i} of the output" for i in range(120))
    other = "\n".join(f"second output has number {i} of these" for i in range(120))
    blocks = spark.createDataFrame([("c", i, 0, "tool_result", "user", "bash", f"t{i}", x, False) for i, x in enumerate([body, other, body, other, "short end", "other end", "last end"])], "conv_id string, turn int, part int, kind string, role string, tool string, call_id string, text string, skip boolean")
    out, savings = c.compact_conversations(blocks, CompactionConfig(threshold=500, keep_recent=2))
    by = {r.turn: r.source for r in savings.collect()}
    assert by == {0: "dedup", 1: "dedup", 2: "summary", 3: "summary", 4: "none", 5: "none", 6: "none"}
    assert all(r.saved_chars == r.original_chars - r.compact_chars for r in savings.collect())
    back = {r.turn: r.text for r in c.reinflate(out, c.build_store(blocks)).collect()}
    assert back[0] == body == back[2] and back[1] == other == back[3]


def test_each_distinct_text_is_summarised_once(spark):
    def fn(frames):
        for f in frames:
            yield f.assign(summary=[None if x.startswith("bad") else str(len(f)) for x in f["text"]])[["hash", "summary"]]

    got = c.summarise(spark.createDataFrame([("good",), ("good",), ("bad",)], "text string").coalesce(1), fn).collect()
    assert len(got) == 2 and sorted(str(r.summary) for r in got)[-1] == "None"


def test_totals_of_grouping_sets_agree(spark, sf_dir):
    got = s.savings_by(queries.requests(spark, sf_dir), ["tool", "client", "model"]).groupBy("dim").agg(F.sum("saved_chars").alias("x"), F.sum("requests").alias("n")).collect()
    assert len({(r.x, r.n) for r in got}) == 1 and len(got) == 4


def test_usage_lines(spark):
    lines = ['data: {"type": "message_start", "message": {"usage": {"input_tokens": 5}}}', "data: [DONE]", "data: {broken", 'data: {"usageMetadata": {"promptTokenCount": 7, "candidatesTokenCount": 3}}', "event: x"]
    got = usage_from_events(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert sorted((r.input_tokens, r.output_tokens) for r in got) == [(5, None), (7, 3)]


def streamed(spark, tmp_path, make, mode):
    source = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    q = make(source).writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", str(tmp_path / mode / make.__name__)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return [tuple(r) for r in spark.table("out").collect()]


def test_streams_equal_batches(spark, sf_dir, tmp_path):
    log = queries.requests(spark, sf_dir).withColumn("input_tokens", F.col("original_chars")).withColumn("output_tokens", F.col("saved_chars")).withColumn("backend", F.col("client")).withColumn("ok", F.col("tool") != "error")
    log.coalesce(1).write.parquet(str(tmp_path / "in"))
    want = {(r.client, r.day, r.input_tokens) for r in s.usage_daily(log).collect()}
    assert {r[:3] for r in streamed(spark, tmp_path, usage.usage_by_day, "complete")} == want
    slots = streamed(spark, tmp_path, usage.savings_by_slot, "complete")
    assert sum(r[2] for r in slots) == log.agg(F.sum("saved_chars")).first()[0]
    source = spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
    alerts = available(source, carry=usage.failure_alerts()).collect()
    streaks = s.outage_streaks(log.withColumn("event_id", F.col("request_id"))).collect()
    assert len(alerts) == len(streaks)


def test_islands_of_lines(spark):
    text = "x\nstart\nbody\n\nlost\nstart\nmore\nstop\nlost"
    lines = ln.to_lines(spark.createDataFrame([(1, text)], "block_id int, text string"))
    kept = ln.keep_islands(lines, F.col("line") == "start", F.col("line").isin("stop", ""))
    assert ln.to_texts(kept).first().text == "start\nbody\nstart\nmore"
    assert ln.to_texts(ln.dedup_lines(ln.to_lines(spark.createDataFrame([(1, "a\na\na\nb\na")], "block_id int, text string")), consecutive_only=True)).first().text == "a\n  ... [repeated 2 more times]\nb\na"


def test_money_and_counted_requests(spark):
    got = [r.x for r in spark.createDataFrame([(0.0,), (None,), (0.004,), (0.01,), (1.5,), (12.345,), (1234.999,)], "d double").select(t.money(F.col("d")).alias("x")).collect()]
    assert got == ["—", "—", "<$0.01", "$0.01", "$1.50", "$12.35", "$1235.00"]
    rows = [("a", 0, 5), ("a", 1, 0), ("b", 0, 5), ("b", 0, 0), (None, 0, 5)]
    usage_ = spark.createDataFrame(rows, "client string, input_tokens long, output_tokens long").withColumn("ts", F.lit("2024-01-01 10:00:00").cast("timestamp"))
    assert {r.client: r.requests for r in s.usage_daily(usage_, F.col("client") == "b").collect()} == {"a": 1, "b": 1, None: 0}


def test_overrides_bypasses_and_shares(spark):
    rows = spark.createDataFrame([(1, "x", 10), (2, "y", 0), (None, "z", 5)], "id int, project string, saved_chars long")
    named = s.override_projects(rows, spark.createDataFrame([(1, "mine"), (7, "none")], "id int, manual string"), "id")
    assert {r.id: r.project for r in named.collect()} == {1: "mine", 2: "y", None: "z"}
    assert {r.id: r.saved_chars for r in s.bypass(rows, F.col("id") == 1).collect()} == {1: 0, 2: 0, None: 5}
    assert {r.project: r.share_of_max for r in s.with_share(rows.withColumn("dim", F.lit("project"))).collect()} == {"x": 1.0, "y": 0.0, "z": 0.5}


def test_stores_are_compacted_under_their_readers(spark, tmp_path):
    from txcompact.sources.stores import Generations

    store = Generations(spark, str(tmp_path / "store"), "k", "v")
    assert store.read() is None and store.compact() == 0
    rows = lambda *pairs: spark.createDataFrame(list(pairs), "k string, v int").coalesce(1)
    got = lambda: {(r.k, r.v) for r in store.read().collect()}
    store.append(rows(("a", 1), ("b", 2)))
    store.append(rows(("a", 3), ("c", 1)))
    assert got() == {("a", 3), ("b", 2), ("c", 1)} and store.files() == 2
    reader = store.read()
    assert store.compact(2) == 1 and got() == {("a", 3), ("b", 2)} and store.files() == 1
    assert {r.k for r in reader.collect()} == {"a", "b", "c"}  # one that began before sees all of the old
    rows(("d", 9)).withColumn("batch", F.lit("slow")).write.mode("append").partitionBy("batch").parquet(f"{store.path}/log/0")  # began before the switch
    assert got() == {("a", 3), ("b", 2), ("d", 9)}
    assert store.compact(2) == 2 and got() == {("a", 3), ("d", 9)} and store.compact() == 2 and got() == {("a", 3), ("d", 9)}


def test_lines_are_stitched_over_many_chunks(spark):
    from txcompact.sources.transcripts import stitched_lines

    text = "first line\n\na line of some length\nlast without end"
    for size in (1, 3, 7, 100):
        rows = [(s, i // size, text[i : i + size]) for s in ("x", "y") for i in range(0, len(text), size)] + [("z", 0, None)]
        got = stitched_lines(spark.createDataFrame(rows, "s string, n int, c string"), ["s"], "n", "c").orderBy("s", "no").collect()
        assert [(r.s, r.line) for r in got] == [(s, x) for s in ("x", "y") for x in text.split("\n")[:-1]]


def test_mixed_content_loses_no_message(spark):
    from txcompact.sources.transcripts import blocks_of_json

    messages = [
        {"role": "user", "content": "a plain string message"},
        {"role": "assistant", "content": [{"type": "text", "text": "hi"}, {"type": "tool_use", "id": "t", "name": "Bash", "input": {"command": "ls"}}]},
        {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t", "content": [{"type": "text", "text": "one"}, {"type": "image"}, {"type": "text", "text": "two"}]}]},
        {"role": "user", "content": None},
    ]
    chat = [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}, {"role": "assistant", "content": None, "tool_calls": [{"id": "t", "function": {"name": "Bash", "arguments": "{}"}}]}, {"role": "tool", "tool_call_id": "t", "content": "out"}]
    rows = {
        "anthropic": ({"messages": messages}, [("text", None, "a plain string message"), ("text", None, "hi"), ("tool_use", "Bash", '{"command":"ls"}'), ("tool_result", "Bash", "one\ntwo"), ("other", None, "")]),
        "openai": ({"messages": chat}, [("text", None, "a\nb"), ("tool_use", "Bash", "{}"), ("tool_result", "Bash", "out")]),
        "responses": ({"messages": chat}, [("text", None, "a\nb"), ("tool_use", "Bash", "{}"), ("tool_result", "Bash", "out")]),
        "gemini": ({"contents": [{"role": "user", "parts": [{"functionResponse": {"name": "Bash", "response": {"output": "x"}}}]}]}, [("tool_result", "Bash", '{"output":"x"}')]),
    }
    for shape, (body, want) in rows.items():
        df = spark.createDataFrame([("c", json.dumps(body)), ("bad", "{broken")], "conv_id string, body string")
        assert [(r.kind, r.tool, r.text) for r in blocks_of_json(df, shape).orderBy("turn", "part").collect()] == want, shape
    lone = spark.createDataFrame([("c", json.dumps({"input": "just this"}))], "conv_id string, body string")
    assert [(r.role, r.text) for r in blocks_of_json(lone, "responses").collect()] == [("user", "just this")]


def test_json_keeps_keys_and_numbers(spark):
    body = '{ "z": 1.0,\n  "a": "two  words \\" { }",  "n": [1, 2.50 ],' + ' "pad": "' + "x" * 200 + '" }'
    text = f"before {body} after {{ {{ {{ \n" + "{ " * 50_000
    got = spark.createDataFrame([(text,)], "x string").select(t.minify_json(F.col("x"))).first()[0]
    assert got == text.replace(body, '{"z":1.0,"a":"two  words \\" { }","n":[1,2.50],"pad":"' + "x" * 200 + '"}')


def test_recency_counts_eligible_results_and_whole_messages(spark):
    schema = "conv_id string, turn int, part int, kind string, role string, tool string, call_id string, text string, skip boolean"
    body = lambda i: "\n".join(f"result {i} has line {j} of this output" for j in range(40))
    rows = [("c", i, 0, "tool_result", "user", "webfetch" if i > 3 else "bash", f"t{i}", body(i), False) for i in range(7)]
    picked = c.select_candidates(spark.createDataFrame(rows, schema), CompactionConfig(threshold=100, keep_recent=3, skip_tools=("webfetch",)))
    assert [r.turn for r in picked.collect()] == [0]
    twice = [("c", i, 0, "tool_result", "user", tool, None, body(0), False) for i, tool in enumerate(["webfetch", "webfetch", "Read", "Bash"])]
    _, saved = c.compact_conversations(spark.createDataFrame(twice, schema), CompactionConfig(threshold=100_000))
    assert {r.turn: r.source for r in saved.collect()} == {0: "none", 1: "none", 2: "dedup", 3: "none"}
    long = "We did all this in order to finish, with regard to it. " * 10
    prose = [("c", 0, 0, "text", "user", None, None, long, False), ("c", 1, 0, "text", "assistant", None, None, "ok", False), ("c", 2, 0, "tool_result", "user", "bash", "t", "short", False)]
    _, saved = c.compact_conversations(spark.createDataFrame(prose, schema), CompactionConfig())
    assert {r.turn: r.source for r in saved.collect()} == {0: "prose", 1: "none", 2: "none"}  # the live message is the result
    stored_ = spark.createDataFrame([(r[7],) for r in rows[:3]], "text string").select(F.md5("text").alias("hash"), F.lit("kept").alias("summary"))
    _, saved = c.compact_conversations(spark.createDataFrame([(*r[:5], "bash", *r[6:]) for r in rows], schema), CompactionConfig(threshold=100, keep_recent=0, new_rule="last_message"), stored_)
    assert {r.turn: r.source for r in saved.collect()} == {0: "summary", 1: "summary", 2: "summary", 3: "none", 4: "none", 5: "none", 6: "summary"}
