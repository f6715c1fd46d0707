"""Clean and rules work within a block's row, so nothing is exchanged, however many lines there are."""

from pyspark.sql import functions as F

from txcompact.functions import text as t
from txcompact.operators.blocks import once_each
from txcompact.operators.clean import OTHER_BLANKS, clean
from txcompact.operators.rules import classify, compact_blocks


def test_clean_and_rules_exchange_nothing(spark):
    frames = "  at a (x.js)\n  at b (x.js)\n  at c (x.js)"
    rows = [("1", "fetch", f"{frames}\none\n{frames}\nsame\nsame\nsame"), ("2", "bash", "\n".join(f"plain line {i}" for i in range(100)))]
    blocks = spark.createDataFrame(rows, "block_id string, tool string, text string")
    for made in (clean(blocks), compact_blocks(blocks)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan
    first = clean(blocks).where("block_id = '1'").first().text
    assert first == "at a (x.js)\n  at b (x.js)\n  at c (x.js)\none\n  ... [same 3-frame stack trace repeated]\nsame\n  ... [repeated 2 more times]"


def test_guarded_passes_change_nothing_and_lets_ask_no_types(spark):
    rows = ["", "\n", "abcdefg\n", "---", "abcdefg\n\nhijklmn", "\x07bell \x7f\x0b\tx", "\x1b[32mgreen\x1b[0m \x1b]0;t\x07", "one \t\n two\n\n\n\nthree ", "a:1\n10:30:00 x", "a\r\nb\rc", "ab ░░ cdéf g", "é==\né é é é é é", None]
    df = spark.createDataFrame([(x,) for x in rows], "text string")
    plain = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, t.ANSI[0], ""), t.ANSI[1], ""), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    rest = lambda line: F.length(F.regexp_replace(line, t.BAR, ""))
    bars = lambda x: F.array_join(F.filter(F.split(x, "\n", -1), lambda line: (rest(line) > F.length(line) * 0.3) | (rest(line) > 5)), "\n")
    ends = lambda x: t.trimmed(F.regexp_replace(F.array_join(F.transform(F.split(x, "\n", -1), lambda line: F.rtrim(line, F.lit(" \t"))), "\n"), r"\n{3,}", "\n\n"))
    x = F.col("text")
    pairs = [(t.strip_ansi(x), plain(x)), (t.without_bars(x), bars(x)), (t.collapse_whitespace(x), ends(x)), (t.unix_lines(x), F.regexp_replace(x, r"\r\n?", "\n"))]
    for got, want in pairs:
        assert df.where(~got.eqNullSafe(want)).count() == 0
    assert "transform(array(" not in df.select(t.let(x, F.upper))._jdf.queryExecution().optimizedPlan().toString()


def test_only_rules_that_some_block_asks_for_are_planned(spark):
    rows = [("1", "bash", "\n".join(f"plain line {i}" for i in range(100))), ("2", "fetch", "x"), ("3", "bash", "added 3 packages in 2s\nnoise")]
    made = compact_blocks(spark.createDataFrame(rows, "block_id string, tool string, text string"))
    plan = made._jdf.queryExecution().analyzed().toString()
    assert "truncated" in plan and "pkgInstall" in plan and "cargoTest" not in plan and "readLockfile" not in plan
    assert {(r.block_id, r.pattern): r.text[:22] for r in made.collect()} == {("1", "truncated"): "... [50 earlier lines ", ("2", None): "x", ("3", "pkgInstall"): "added 3 packages in 2s"}
    none = compact_blocks(spark.createDataFrame(rows[1:2], "block_id string, tool string, text string"))
    assert none.select("block_id", "pattern", "text").first() == ("2", None, "x")


def test_classification_takes_lines_apart_where_a_look_finds_something(spark):
    odd = ["abcdef1\nabcdef12 x\nabcdef123 y\nabcdef1 z", "abcdef1\n\nabcdef1", "  a\n* b\n  c -> d", "\n* b", "> 1\n> 2\n> 3\n> 4", "x\n> 1\n> 2\n> 3", "\n".join(["// error here"] * 40), "\n".join(["an error"] + ["x"] * 29), None, ""]
    found = classify(spark.createDataFrame([(i, "bash", x) for i, x in enumerate(odd)], "block_id int, tool string, text string")).orderBy("block_id").collect()
    assert [r.pattern for r in found] == ["gitLog", "truncated", "gitBranch", "truncated", "curl", "truncated", "truncated", "errorExtracted", "truncated", "truncated"]
    plan = classify(spark.createDataFrame([("bash", "x")], "tool string, text string"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("{7,12}") == 1


def test_prose_rules_are_worked_out_once(spark):
    df = spark.createDataFrame([("in order to see `x`\n```\nin order to\n```\nlet me go, in order to end",), ("plain",), (None,)], "text string")
    plan = df.select(t.clean_prose(F.col("text")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("in order to") == 1
    assert [r.x for r in df.select(t.clean_prose(F.col("text")).alias("x")).collect()] == ["to see `x`\n```\nin order to\n```\ngo, to end", "plain", None]


def test_lines_of_spaces_only_are_trimmed_faster_with_the_same_result(spark):
    lines = lambda *xs: ("\n".join(xs),)
    df = spark.createDataFrame([lines("a ", " a", "a", "b"), lines("", " ", "", "x", "x"), lines("a", "\ta", " a\r", "b"), lines("a\x0b", "a", "\x0ca"), lines("", "", "", "a", " a ", "a"), (None,), ("",)], "text string")
    x, plain = F.split("text", "\n", -1), ~F.col("text").rlike(OTHER_BLANKS)
    same = t.let(x, lambda ls: F.array_join(once_each(ls, spaces=plain), "|")).eqNullSafe(t.let(x, lambda ls: F.array_join(once_each(ls), "|")))
    assert df.where(~same).count() == 0
    assert df.select(t.let(x, lambda ls: F.array_join(once_each(ls, spaces=plain), "|")).alias("x")).first().x == "a \n  ... [repeated 2 more times]|b"
