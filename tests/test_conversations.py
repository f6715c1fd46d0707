"""Conversations that are a row each: the same blocks and results as of rows, and nothing but keys is exchanged for them."""

from pyspark.sql import functions as F

from txcompact.config import CompactionConfig
from txcompact.operators import compact as c
from txcompact.plans import compaction, mixed
from txcompact.plans.queries import read
from txcompact.sources.transcripts import blocks_of_json, conversations_of_json

BLOCK = "turn int, part int, kind string, role string, tool string, call_id string, text string, skip boolean"
ASKED = """{"messages":[{"role":"assistant","content":[{"type":"tool_use","id":"a","name":"Bash","input":{"command":"x"}},{"type":"tool_use","id":"b","name":"Read","input":{"path":"# tx: skip"}},{"type":"tool_use","name":"Write","input":{}}]},
 {"role":"user","content":[{"type":"tool_result","tool_use_id":"b","content":"two"},{"type":"tool_result","tool_use_id":"a","content":[{"type":"text","text":"one"},{"type":"image"}]},{"type":"tool_result","tool_use_id":"c","content":"lost"},{"type":"tool_result","content":"no id"}]},
 {"role":"assistant","content":[{"type":"tool_use","id":"a","name":"Grep","input":{}}]},{"role":"user","content":[{"type":"image"}]},{"role":"user"},{"role":"user","content":"said"}]}"""


def rows(df):
    return sorted(map(tuple, df.select("conv_id", "turn", "part", "kind", "role", "tool", "call_id", "text", "skip").collect()), key=repr)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_blocks_of_a_row_are_those_of_rows(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").where("conv_id < 40")
    bodies = [(mixed._mixed(turns, shape), shape) for shape in ("anthropic", "openai", "gemini", "responses")]
    bodies.append((spark.createDataFrame([("1", ASKED), ("2", '{"messages":[]}'), ("3", "no json")], "conv_id string, body string"), "anthropic"))
    for made, shape in bodies:
        nested = conversations_of_json(made, shape)
        want = rows(blocks_of_json(made, shape))
        assert rows(nested.select("conv_id", F.inline("blocks"))) == want and want
    named = {(r[1], r[2]): (r[5], r[8]) for r in rows(nested.select("conv_id", F.inline("blocks")))}
    assert named[1, 0] == ("Read", True) and named[1, 1] == ("Grep", False) and named[1, 2] == named[1, 3] == ("unknown", False)


def some_conversations(spark):
    long, json = "\n".join(f"plain line {i} of output" for i in range(100)), '{"command":"' + "run it " * 40 + '"}'
    said = "We did all this in order to finish it at this point in time. " * 6
    turn = lambda t, *parts: [(t, i, kind, role, tool, None, text, skip) for i, (kind, role, tool, text, skip) in enumerate(parts)]
    use = lambda x=json: ("tool_use", "assistant", "Bash", x, False)
    edits = '{"edits":[{"old_string":"' + "a \\\\n" * 60 + '","new_string":"' + "b  " * 90 + '"}]}'
    result = lambda text, tool="Bash", skip=False: ("tool_result", "user", tool, text, skip)
    prose = ("text", "assistant", None, said, False)
    one = turn(0, prose, use(), ("tool_use", "assistant", "MultiEdit", edits, False)) + turn(1, result(long), result(long + "x"), result(long, "Read"))
    one += turn(2, prose, use()) + turn(3, result(long)) + turn(4, prose, use("no json " * 40)) + turn(5, result(long, skip=True), ("text", "user", None, said, False))
    one += turn(6, prose) + turn(7, result("short"), result(long + "y", "WebFetch")) + turn(8, prose) + turn(9, ("text", "user", None, said, False))
    two = turn(0, result("only a result")) + turn(1, ("other", "assistant", None, "", False))
    return spark.createDataFrame([("one", one), ("two", two), ("none", [])], f"conv_id string, blocks array<struct<{BLOCK.replace(' ', ':').replace(',:', ',')}>>")


def test_compaction_of_rows_and_of_conversations_agree(spark):
    nested = some_conversations(spark)
    flat = nested.select("conv_id", F.inline("blocks"))
    known = spark.createDataFrame([(r.h, s) for r, s in zip(flat.where("kind = 'tool_result'").select(F.md5("text").alias("h")).distinct().orderBy("h").collect(), ["a stored one", None])], "hash string, summary string")
    sources = set()
    for cfg, summaries, fn in (
        (CompactionConfig(threshold=500), None, None),
        (CompactionConfig(context_chars=9000, keep_recent=0, skip_tools=("webfetch",), new_rule="last_message"), known, None),
        (CompactionConfig(threshold=100, keep_recent=1, prose_recent=0, new_rule="after_model", dedup_tools=("read",), no_summary=()), known, mixed.first_words),
        (CompactionConfig(threshold=10_000, keep_recent=2, prose=False, prose_min=10), None, mixed.first_words),
    ):
        results = [[sorted(map(tuple, x.collect()), key=repr) for x in c.compact_conversations(blocks, cfg, summaries, fn)] for blocks in (flat, nested)]
        assert results[0] == results[1]
        out, saved = results[1]
        assert len(out) == len(saved) == flat.count()
        assert {(r[0], r[1], r[2]): len(r[7]) for r in out} == {(r[0], r[1], r[2]): r[6] for r in saved}
        sources |= {r[4] for r in saved}
    assert sources == {"none", "dedup", "summary", "clean", "prose", "input"}


def test_only_keys_are_exchanged_for_conversations(spark, sf_dir):
    for shape in ("anthropic", "openai", "gemini"):
        made = compaction.conversations(spark, sf_dir, shape)
        assert exchanges(made) == 1 and "Window" not in made._jdf.queryExecution().executedPlan().toString()
    nested = some_conversations(spark)
    for cfg in (CompactionConfig(), CompactionConfig(keep_recent=0, new_rule="after_model")):
        placed = c._placed(nested, cfg)
        plan = placed._jdf.queryExecution().optimizedPlan().toString()
        # A conversation's bounds are worked out once, below the rows of its blocks, and its blocks are not asked for their number first.
        above, _, below = plan.partition("Generate ")
        assert exchanges(placed) == 0 and "aggregate(" not in above and plan.count(", last, array_max(") == 1 and "Filter" not in below


def test_only_keys_are_exchanged_for_conversations_of_tools(spark, sf_dir):
    made = mixed.tool_conversations(spark, sf_dir, 1)
    assert exchanges(made) == 1 and "Window" not in made._jdf.queryExecution().executedPlan().toString()
    orders = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("conv_id")).count()
    sizes = made.join(orders, "conv_id").select("conv_id", F.array_max(F.transform("blocks", lambda b: b["turn"])).alias("last"), "count").collect()
    assert len(sizes) == orders.where("count > 1").count() and all(r["last"] == 2 * (r["count"] - 1) - 1 for r in sizes)


def test_settings_are_counted_in_one_pass(spark, sf_dir):
    settings = {f"{mode} {rule}": CompactionConfig(new_rule=rule, skip_tools=("webfetch",)).with_mode(mode) for mode in ("soft", "normal", "critical") for rule in (None, "last_message", "after_model")}
    settings["bands"] = CompactionConfig(context_chars=9000, keep_recent=1, no_summary=("bash",))
    nested = some_conversations(spark)
    got = {r.rule: r.n for r in c.count_candidates(nested, settings).collect()}
    assert got == {name: c.select_candidates(nested.select("conv_id", F.inline("blocks")), cfg).count() for name, cfg in settings.items()} and sum(got.values()) > 0
    plan = compaction.selections(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_inputs_are_written_back_within_their_row(spark, sf_dir):
    nested = some_conversations(spark)
    made = [sorted(map(tuple, c.clean_tool_inputs(x, 1).collect())) for x in (nested, nested.select("conv_id", F.inline("blocks")))]
    assert made[0] == made[1] and len(made[0]) == 3
    plan = compaction.tool_inputs_written_back(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan
