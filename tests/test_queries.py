"""Every core query against its SQL, and operators that work in two levels against one plain window."""

import datetime as dt
import math
import random

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from txcompact.operators import compact as c
from txcompact.operators import savings as s
from txcompact.plans import queries as core
from txcompact.plans import compaction, mixed, outputs, reports, streams  # noqa: F401
from txcompact.streaming import usage
from txcompact.streaming.run import available

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    return None if isinstance(value, float) and math.isnan(value) else value


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    got = core.QUERIES[name](spark, sf_dir)
    found = duck.execute(core.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted((tuple(plain(v) for v in r) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(v) for v in r) for r in got.select(*names).collect()), key=repr) == want


@pytest.fixture(scope="module")
def skewed_log(spark):
    """Most rows belong to one key; keys, times and values may be null."""
    rng, start = random.Random(3), dt.datetime(2024, 1, 1)
    rows = []
    for i in range(3000):
        key = None if i % 97 == 0 else "hot" if i % 3 else f"k{i % 11}"
        at = None if i % 101 == 0 else start + dt.timedelta(minutes=rng.randrange(20_000))
        rows.append((i, key, at, rng.choice(["unknown", "unknown", None, "a", "b"]), rng.choice([True, False, False, None])))
    return spark.createDataFrame(rows, "event_id long, key string, ts timestamp, project string, ok boolean")


def test_carry_in_two_levels(skewed_log):
    log = skewed_log.withColumnRenamed("key", "session_id").withColumn("request_id", F.col("event_id"))
    w = Window.partitionBy("session_id").orderBy("ts", "request_id").rowsBetween(Window.unboundedPreceding, 0)
    want = log.withColumn("project", F.coalesce(F.last(F.nullif("project", F.lit("unknown")), ignorenulls=True).over(w), F.lit("unknown")))
    got = s.carry_project(log)
    rows = lambda x: sorted((r.request_id, r.project) for r in x.where("ts is not null").collect())
    assert rows(got) == rows(want) and got.count() == 3000


def test_rolling_percentiles_over_many_runs(spark):
    """Equal times, repeated and empty rows; runs and windows of several sizes against one plain list."""
    rng, start = random.Random(5), dt.datetime(2024, 1, 1)
    rows = [(i % 900, None if i % 83 == 0 else start + dt.timedelta(seconds=rng.randrange(40)), None if i % 71 == 0 else float(rng.randrange(50))) for i in range(1000)]
    log = spark.createDataFrame(rows, "request_id long, ts timestamp, ms double")
    plain_rows = sorted((r for r in rows if r[1] is not None and r[2] is not None), key=lambda r: (r[1], r[0], r[2]))
    for last_n, run_rows in ((200, 64), (7, 50), (1, 1), (5000, 10)):
        want = []
        for i, (key, _, v) in enumerate(plain_rows):
            window = sorted(r[2] for r in plain_rows[max(0, i - last_n + 1) : i + 1])
            want.append((key, len(window), *(window[max(0, math.ceil(p * len(window) / 100) - 1)] for p in (50, 95, 99)), v))
        assert sorted(map(tuple, s.rolling_latency(log, last_n, run_rows=run_rows).collect())) == sorted(want)
    assert s.rolling_latency(log.limit(0)).count() == 0
    with pytest.raises(ValueError):
        s.rolling_latency(log, 0)


def test_outages_in_two_levels(skewed_log):
    calls = skewed_log.withColumnRenamed("key", "backend").where("ts is not null")
    want = []
    for backend in {r.backend for r in calls.select("backend").distinct().collect()}:
        run = []
        for r in sorted(calls.where(F.col("backend").eqNullSafe(F.lit(backend))).collect(), key=lambda r: (r.ts, r.event_id)):
            if r.ok:
                want += [(backend, run[0], run[-1], len(run))] if len(run) >= 3 else []
                run = []
            else:
                run.append(r.ts)
        want += [(backend, run[0], run[-1], len(run))] if len(run) >= 3 else []
    assert sorted(map(tuple, s.outage_streaks(calls).collect()), key=repr) == sorted(want, key=repr)


def test_alerts_of_a_hot_backend_over_three_batches(skewed_log):
    calls = skewed_log.withColumnRenamed("key", "backend").where("ts is not null")
    rows = sorted(calls.collect(), key=lambda r: (r.ts, r.event_id))
    want, streak = [], {}
    for r in rows:
        streak[r.backend] = 0 if r.ok else streak.get(r.backend, 0) + 1
        want += [(r.backend, r.ts)] if streak[r.backend] == 3 else []
    cuts, got, left = [rows[700].ts, rows[1500].ts], [], None
    for part in (F.col("ts") < cuts[0], (F.col("ts") >= cuts[0]) & (F.col("ts") < cuts[1]), F.col("ts") >= cuts[1]):
        found, left = usage.failure_alerts()(calls.where(part), left)
        got += [(r.backend, r.ts) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(want) > 100


def test_dedup_of_a_hot_text(spark):
    rows = [(i, None if i % 5 == 0 else "x", "hot" * 100 if i % 3 else None if i % 6 else f"text {i} " * 50) for i in range(600)]
    blocks = spark.createDataFrame(rows, "turn int, conv_id string, text string")
    last, first = {}, {}
    for i, conv, text in rows:
        last[conv, text] = i
        first.setdefault((conv, text), i)
    for keep, stays in (("last", last), ("first", first)):
        got = c.dedup_blocks(blocks, order=["turn"], keep=keep).collect()
        assert len(got) == 600
        assert all((r.kept_ref is None) == (r.text is None or stays[r.conv_id, r.text] == r.turn) for r in got)
        assert all(r.saved_chars == (len(r.text) if r.kept_ref else 0) for r in got)


def test_alerts_go_on_over_batches(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    for k, oks in enumerate([[False, True, False, False], [False, False, True], [False, False, False]]):
        rows = [("b", start + dt.timedelta(minutes=10 * k + i), 10 * k + i, ok) for i, ok in enumerate(oks)]
        spark.createDataFrame(rows, "backend string, ts timestamp, event_id long, ok boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("backend string, ts timestamp, event_id long, ok boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = [(r.ts - start).seconds // 60 for r in available(source, carry=usage.failure_alerts()).collect()]
    assert sorted(got) == [10, 22]
    totals = source.groupBy("backend").agg(F.count(F.lit(1)).alias("n"))
    assert [tuple(r) for r in available(totals, "update", ["backend"]).collect()] == [("b", 10)]


def test_training_pairs_by_a_users_function(spark):
    docs = spark.createDataFrame([("one\n\ntwo\nthree\nfour",), ("short",), (None,), ("one\n\ntwo\nthree\nfour",)], "text string")
    assert sorted((r.variant, r.compressed) for r in c.training_pairs(docs).collect()) == [("aggressive", "one"), ("balanced", "one\ntwo"), ("conservative", "one\ntwo\nthree")]

    def half(frames):
        for f in frames:
            yield f.assign(compressed=[t[: len(t) // 2] if v == "balanced" else None for t, v in zip(f["text"], f["variant"])]).drop(columns="text")

    assert [(r.variant, r.ratio) for r in c.training_pairs(docs, half).where("compressed is not null").collect()] == [("balanced", 1 - 9 / 19)]


def test_short_ids_that_texts_share_name_none_of_them(spark):
    store = spark.createDataFrame([("abcdef" + "0" * 26, "abcdef", "one"), ("abcdef" + "1" * 26, "abcdef", "two"), ("123456" + "0" * 26, "123456", "three")], "hash string, block_id6 string, text string")
    blocks = spark.createDataFrame([(1, "[tx:abcdef -90%] x"), (2, "[tx:" + "abcdef" + "1" * 26 + " -90%] x"), (3, "[tx:123456] same output"), (4, "plain")], "turn int, text string")
    assert {r.turn: r.text for r in c.reinflate(blocks, store).collect()} == {1: "[tx:abcdef -90%] x", 2: "two", 3: "three", 4: "plain"}
    assert c.reinflate(blocks, store).count() == 4
    calls = spark.createDataFrame([("expand", '{"id": "abcdef"}'), ("expand", '{"id": "123456"}'), ("other", '{"id": "123456"}')], "name string, input string")
    assert sorted((r.block_id6, r.found, r.original) for r in c.expand_calls(calls, store).collect()) == [("123456", True, "three"), ("abcdef", False, None)]


def test_pressure_tightens_the_rules(spark):
    from txcompact.operators.rules import compact_blocks

    text = "\n".join(f"plain line number {i}" for i in range(70))
    blocks = spark.createDataFrame([(str(p), "bash", text, p) for p in (0.0, 0.75, 0.9, 1.0)], "block_id string, tool string, text string, p double")
    got = {float(r.block_id): len(r.text.split("\n")) for r in compact_blocks(blocks, pressure=F.col("p")).collect()}
    assert got == {0.0: 70, 0.75: 70, 0.9: 31, 1.0: 31}
    assert len(compact_blocks(blocks, pressure=0.95).first().text.split("\n")) == 31


def test_trims_are_linear(spark):
    from txcompact.functions import text as t

    blanks = "x" + " " * 1_000_000 + "y" + "\t" * 1_000_000
    df = spark.createDataFrame([(blanks,)], "text string").select(t.trimmed(F.col("text")).alias("a"), t.collapse_whitespace(F.col("text")).alias("b"))
    assert df.select(F.length("a"), F.length("b")).first() == (1_000_002, 1_000_002)


def test_a_users_summariser_sees_a_bounded_part_and_prompts_more(spark):
    def echo(frames):
        for f in frames:
            yield f.assign(summary=f["text"].map(lambda x: str(len(x)))).drop(columns="text")

    prompts = spark.createDataFrame([("word " * 5000,)], "text string")
    assert c.compact_prompts(prompts, echo).first().text == "10000"
    assert c.summarise(prompts, echo).first().summary == "4000"
