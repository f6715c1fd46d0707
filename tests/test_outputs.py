"""How command output is written, and that it is classified once."""

from pyspark.sql import functions as F

from txcompact.operators import rules
from txcompact.plans import compaction, outputs


def test_lines_written_once_for_a_block_are_those_written_one_by_one(spark, sf_dir):
    rows, made = outputs.customers(spark, sf_dir), [o for o in outputs.OUTPUTS if outputs.key_is_text(o.line)]
    assert {"code_languages", "read", "other_tool", "grep"} <= {o.name for o in made} and not {"cargo_test", "lockfile", "git_log", "tsc"} & {o.name for o in made}
    both = [F.struct(*[outputs.written(o, once)["text"].alias(name) for name, once in (("a", True), ("b", False))]) for o in made]
    assert rows.select(F.inline(F.array(*both))).where("not (a <=> b)").count() == 0


def test_coverage_works_patterns_out_once(spark):
    rows = [("bash", "\n".join(["x"] * 29)), ("bash", "\n".join(["an error"] + ["x"] * 29)), ("bash", None), ("fetch", "x"), ("glob", "\n".join("ab" * 15)), ("glob", "a\n" * 30), ("read", "a\n" * 199), ("read", "a\n" * 200)]
    found = rules.coverage(rules.classify(spark.createDataFrame(rows, "tool string, text string")))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("THEN gitDiff") == 1
    assert {r.pattern: r.n for r in found.collect()} == {"truncated": 2, "errorExtracted": 1, "globCompacted": 1, "readHeadTail": 1}


def test_keys_only_are_exchanged_and_a_tasks_part_is_bounded(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(outputs, "TASK_ROWS", 10)
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    assert outputs.customers(spark, sf_dir).rdd.getNumPartitions() == -(-rows // 10)
    for made in (compaction.clean_reads(spark, sf_dir), compaction.clean_outputs(spark, sf_dir), compaction.system_prompts(spark, sf_dir)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "Exchange hashpartitioning(o_custkey" in plan


def test_coverage_counts_cleaned_outputs(spark, sf_dir, monkeypatch):
    colour = lambda word: f"chr(27) || '[32m' || '{word}' || chr(27) || '[0m'"
    coloured = outputs.Output("coloured", "gitStatus", "'  file ' || key || '.ts'", "''", head=(f"{colour('On')} || ' branch main'",))
    monkeypatch.setattr(outputs, "BY_NAME", {"coloured": coloured})
    n = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey").distinct().count()
    assert [(r.pattern, r.n) for r in outputs.rule_coverage(spark, sf_dir).collect()] == [("gitStatus", n)]
