"""Savings, latency, cost, habits, limits and outages over request logs."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txcompact.functions.text import half_up, saving_percent, tokens_of
from txcompact.sources.steps import stored


def savings_by(requests: DataFrame, dims: list[str]) -> DataFrame:
    """Totals for each of ``dims`` and overall in one pass (grouping sets): ``dim, value, requests, original_chars, saved_chars,
    saved_tokens, saving_percent``."""
    every = F.array(F.struct(F.lit("all").alias("dim"), F.lit(None).cast("string").alias("value")), *[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims])
    return (
        requests.groupBy(*dims).agg(F.count(F.lit(1)).alias("n"), F.sum("original_chars").alias("o"), F.sum("saved_chars").alias("s"))
        .select(F.inline(every), "n", "o", "s")
        .groupBy("dim", "value")
        .agg(F.sum("n").alias("requests"), F.sum("o").alias("original_chars"), F.sum("s").alias("saved_chars"))
        .withColumn("saved_tokens", tokens_of(F.col("saved_chars")))
        .withColumn("saving_percent", saving_percent(F.col("saved_chars"), F.col("original_chars")))
    )


def with_share(found: DataFrame) -> DataFrame:
    """Rows of ``savings_by`` with ``share_of_max``: their saving by the greatest of their dimension."""
    most = F.max("saved_chars").over(Window.partitionBy("dim"))
    return found.withColumn("share_of_max", F.when(most > 0, F.col("saved_chars") / most).otherwise(0.0))


def bypass(requests: DataFrame, bypassed: Column) -> DataFrame:
    """A bypassed request goes through as it is: it counts and saves nothing."""
    return requests.withColumn("saved_chars", F.when(bypassed, 0).otherwise(F.col("saved_chars")))


def override_projects(rows: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """``project`` as ``overrides`` (``key, manual``) name it, else as it is."""
    return rows.join(overrides.select(key, "manual"), key, "left").withColumn("project", F.coalesce("manual", "project")).drop("manual")


def with_earlier(rows: DataFrame, keys: list[str], unit: str, of_bucket: Column, of_earlier) -> DataFrame:
    """Adds ``_bucket`` (``ts`` cut to ``unit``) and ``_earlier``: what all earlier buckets of the row's keys amount to.

    ``of_bucket`` is an aggregate, so a key that holds most rows is reduced before the shuffle; ``of_earlier`` combines
    the few rows that are left of each key. Windows over the rows themselves then need the keys and the bucket only."""
    rows = rows.withColumn("_bucket", F.date_trunc(unit, "ts"))
    w = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = rows.groupBy(*keys, "_bucket").agg(of_bucket.alias("_of"))
    before = per.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_bucket").alias("_k__bucket"), of_earlier(F.col("_of")).over(w).alias("_earlier"))
    same = F.lit(True)
    for k in [*keys, "_bucket"]:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return rows.join(before, same, "left").drop(*[f"_k_{k}" for k in [*keys, "_bucket"]])


def carry_project(requests: DataFrame, unit: str = "day") -> DataFrame:
    """An unknown project is the last known one of its session."""
    known = F.nullif("project", F.lit("unknown"))
    rows = with_earlier(requests, ["session_id"], unit, F.max_by(known, F.when(known.isNotNull(), F.struct("ts", "request_id"))), lambda x: F.last(x, ignorenulls=True))
    w = Window.partitionBy("session_id", "_bucket").orderBy("ts", "request_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("project", F.coalesce(F.last(known, ignorenulls=True).over(w), "_earlier", F.lit("unknown"))).drop("_bucket", "_earlier")


def sessions(requests: DataFrame) -> DataFrame:
    return requests.groupBy("session_id").agg(F.max_by("project", F.struct("ts", "request_id")).alias("project"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count(F.lit(1)).alias("requests"), F.sum("original_chars").alias("original_chars"), F.sum("saved_chars").alias("saved_chars"))


def project_aggregates(sessions_: DataFrame) -> DataFrame:
    return sessions_.where("requests > 0").groupBy("project").agg(F.count(F.lit(1)).alias("sessions"), F.sum("requests").alias("requests"), tokens_of(F.sum("saved_chars")).alias("saved_tokens"), F.max("end_ts").alias("last_ts"))


def latency_summary(requests: DataFrame, last_n: int = 200, value: str = "ms") -> DataFrame:
    """Nearest-rank percentiles over the last samples."""
    recent = requests.orderBy(F.desc("ts"), F.desc("request_id")).limit(last_n)
    rank = lambda p: F.expr(f"percentile_disc({p}) within group (order by {value})")
    return recent.agg(F.count(F.lit(1)).alias("n"), rank(0.5).alias("p50"), rank(0.95).alias("p95"), rank(0.99).alias("p99"), F.avg(value).alias("mean"), F.max_by(value, F.struct("ts", "request_id")).alias("last"))


def rolling_latency(requests: DataFrame, last_n: int = 200, value: str = "ms", id_col: str = "request_id", run_rows: int = 65_536) -> DataFrame:
    """``request_id, n, p50, p95, p99, last``: nearest-rank percentiles of the last samples at each request, by time over all of them.

    Samples are sorted by ranges and numbered by their place in a range and the sizes of those before it, then dealt to runs of equal
    numbers of rows, each led by the ``last_n - 1`` samples before it; so no task sees more, whatever the log or its busiest second holds.
    A run slides over one ordered list of ``last_n`` values. Rows without a value or a time are no samples and are left out; equal times
    go by id, repeated rows count each."""
    if last_n < 1:
        raise ValueError("last_n must be positive")
    run_rows, lead = max(run_rows, last_n), last_n - 1
    samples = requests.where(F.col(value).isNotNull() & F.col("ts").isNotNull()).select(F.col(id_col).alias("request_id"), "ts", F.col(value).cast("double").alias("_v"))
    parts = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["ts", "request_id", "_v"]
    sorted_ = stored(samples.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "samples")
    range_ = F.shiftright("_at", 33)
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sorted_.groupBy(range_.alias("_range")).agg(F.count(F.lit(1)).alias("_rows")).select("_range", before.alias("_before"))  # a row for each range
    number = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = sorted_.withColumn("_range", range_).join(F.broadcast(sizes), "_range").withColumn("_no", number)
    own, near_end = F.expr(f"_no div {run_rows}"), F.col("_no") % run_rows >= run_rows - lead
    dealt = numbered.withColumn("_run", F.explode(F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))))

    def slide(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_no", ignore_index=True)
        window, ranked, out = deque(), [], []
        for v in rows["_v"].tolist():
            window.append(v)
            insort(ranked, v)
            if len(window) > last_n:
                del ranked[bisect_left(ranked, window.popleft())]
            n = len(ranked)
            out.append((n, *(ranked[max(0, -(-p * n // 100) - 1)] for p in (50, 95, 99)), v))
        found = pd.DataFrame(out, columns=["n", "p50", "p95", "p99", "last"])
        found.insert(0, "request_id", rows["request_id"])
        return found[rows["_no"] >= key[0] * run_rows]

    kind = sorted_.schema["request_id"].dataType.simpleString()
    return dealt.select("_run", "_no", "request_id", "_v").groupBy("_run").applyInPandas(slide, f"request_id {kind}, n long, p50 double, p95 double, p99 double, last double")


def expand_rate(compressions: Column, calls: Column) -> Column:
    return F.when(compressions > 0, half_up(calls / compressions * 1000) / 10).otherwise(F.lit(0.0))


def rate_band(rate: Column) -> Column:
    return F.when(rate > 25, "red").when(rate > 10, "yellow").otherwise("green")


def gain(totals: DataFrame, call_tokens: int = 1650) -> DataFrame:
    """From ``det_saved, dedup_saved, ai_saved, sysprompt_saved, calls``: gross, cost of calls and net tokens."""
    gross = tokens_of(F.col("det_saved") + F.col("dedup_saved") + F.col("ai_saved") + F.col("sysprompt_saved"))
    cost = F.col("calls") * call_tokens
    return totals.select(gross.alias("gross_tokens"), cost.alias("call_tokens"), F.greatest(F.lit(0), gross - cost).alias("net_tokens"), (cost > F.greatest(F.lit(0), gross - cost)).alias("warning"))


def match_prices(models: DataFrame, prices: DataFrame, default: float = 3.0, legacy_order: bool = False) -> DataFrame:
    """``model, price``: an exact key, else the longest key in the model's name (``legacy_order``: the first in table order).

    Keys are looked up as substrings of the distinct models, by equality, so no cross join is needed."""
    lower = F.lower("model")
    longest = prices.agg(F.coalesce(F.max(F.length("key")), F.lit(0))).first()[0]
    parts = models.select("model").distinct().withColumn("m", lower).withColumn("at", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("m"))))).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(max(1, longest))))).where(F.col("at") + F.col("n") - 1 <= F.length("m"))
    keyed = parts.select("model", "m", F.expr("substring(m, at, n)").alias("key")).distinct().join(prices, "key")
    order = F.struct((F.col("m") == F.col("key")).alias("exact"), (-F.col("ord") if legacy_order else F.length("key")).alias("first"), (-F.col("ord")).alias("o"))
    best = keyed.groupBy("model").agg(F.max_by("input", order).alias("price"))
    return models.select("model").distinct().join(best, "model", "left").withColumn("price", F.coalesce("price", F.lit(default)))


def model_cost(requests: DataFrame, prices: DataFrame) -> DataFrame:
    per = requests.groupBy("model").agg(tokens_of(F.sum("original_chars")).alias("tokens"), tokens_of(F.sum("saved_chars")).alias("saved"))
    priced = per.join(match_prices(per, prices), "model")
    return priced.select("model", "price", (F.col("tokens") * F.col("price") / 1e6).alias("without"), (F.col("saved") * F.col("price") / 1e6).alias("saved"), ((F.col("tokens") - F.col("saved")) * F.col("price") / 1e6).alias("with_saving"))


def slot(ts: Column) -> Column:
    """Five-hour slots from midnight; the last has four."""
    return F.floor(F.hour(ts) / 5)


def week_start(ts: Column) -> Column:
    """The Sunday on or before."""
    return F.date_sub(F.to_date(ts), F.dayofweek(F.to_date(ts)) - 1)


def savings_over_time(requests: DataFrame, bucket: Column) -> DataFrame:
    return requests.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("requests"), F.sum("original_chars").alias("original_chars"), F.sum("saved_chars").alias("saved_chars")).withColumn("saving_percent", saving_percent(F.col("saved_chars"), F.col("original_chars")))


def habit_flags(calls: DataFrame) -> DataFrame:
    """``session_id, flag`` from calls with ``tool, hash, original_chars, saved_chars, hit``."""
    count = lambda tool: F.count_if(F.col("tool") == tool)
    reads = F.col("tool") == "read"
    per = calls.groupBy("session_id").agg(count("read").alias("r"), count("bash").alias("b"), (count("read") - F.count_distinct(F.when(reads, F.col("hash")))).alias("d"), F.sum(F.when(reads, F.col("saved_chars"))).alias("s"), F.sum(F.when(reads, F.col("original_chars"))).alias("o"), F.avg(F.col("hit").cast("int")).alias("h"))
    flags = F.array_compact(F.array(F.when(F.col("r") > 20, "reads_red").when(F.col("r") > 5, "reads"), F.when(F.col("d") > 0, "repeated_reads"), F.when(F.col("b") > 30, "bash"), F.when((F.col("r") > 3) & (F.col("s") * 10 < F.col("o")), "reads_save_little"), F.when(F.col("h") > 0.5, "cache_works")))
    return per.select("session_id", F.explode(F.when(F.size(flags) == 0, F.array(F.lit("none"))).otherwise(flags)).alias("flag"))


def limits_latest(limit_events: DataFrame) -> DataFrame:
    """Per client the last non-zero limit and the last remaining: ``limit, remaining, used_percent, severity``."""
    at = F.struct("ts", "event_id")
    used = F.when(F.col("limit") > 0, half_up((F.col("limit") - F.col("remaining")) / F.col("limit") * 1000) / 10)
    latest = limit_events.groupBy("client").agg(F.max_by("limit", F.when(F.col("limit") > 0, at)).alias("limit"), F.max_by("remaining", at).alias("remaining"))
    return latest.withColumn("used_percent", used).withColumn("severity", F.when(F.col("used_percent") > 90, "crit").when(F.col("used_percent") > 70, "warn").otherwise("ok"))


def usage_daily(usage: DataFrame, any_tokens: Column | None = None) -> DataFrame:
    """Tokens by client and UTC day; a request counts if it has input or, where ``any_tokens`` holds, any tokens."""
    counts = F.col("input_tokens") > 0
    if any_tokens is not None:
        counts = counts | (any_tokens & (F.col("output_tokens") > 0))
    return usage.groupBy("client", F.to_date("ts").alias("day")).agg(
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.count_if(counts).alias("requests"),
    )


def outage_streaks(calls: DataFrame, by: str = "backend", min_run: int = 3, unit: str = "hour") -> DataFrame:
    """Runs of at least ``min_run`` failures without a success between: ``by, start_ts, end_ts, failures``.

    Backends are few, so successes are counted within hours and added up over hours."""
    ok = F.coalesce(F.col("ok"), F.lit(False))
    rows = with_earlier(calls, [by], unit, F.sum(ok.cast("long")), F.sum)
    w = Window.partitionBy(by, "_bucket").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    runs = rows.withColumn("_ok_so_far", F.coalesce("_earlier", F.lit(0)) + F.sum(ok.cast("long")).over(w)).where(~ok)
    return runs.groupBy(by, "_ok_so_far").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count(F.lit(1)).alias("failures")).where(F.col("failures") >= min_run).drop("_ok_so_far")


def hit_rate(calls: DataFrame, by: list[str]) -> DataFrame:
    """``hits, lookups, hit_percent`` of a cache, from calls with a boolean ``hit``."""
    return calls.groupBy(*by).agg(F.count_if("hit").alias("hits"), F.count(F.lit(1)).alias("lookups")).withColumn("hit_percent", saving_percent(F.col("hits"), F.col("lookups")))


def all_time(*totals: DataFrame) -> DataFrame:
    """The greatest of several one-row totals (``requests, original_chars, saved_chars``), for logs that overlap, and the saving of those."""
    every = totals[0]
    for x in totals[1:]:
        every = every.unionByName(x)
    top = every.agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("requests", "original_chars", "saved_chars")])
    return top.select("requests", tokens_of(F.col("original_chars")).alias("original_tokens"), tokens_of(F.col("saved_chars")).alias("saved_tokens")).withColumn("saving_percent", saving_percent(F.col("saved_tokens"), F.col("original_tokens")))


def period_summary(sessions: DataFrame, start: Column, end: Column) -> DataFrame:
    """Sessions that start in ``[start, end)``: their number, requests, tokens and saving."""
    inside = sessions.where((F.col("start_ts") >= start) & (F.col("start_ts") < end))
    out = inside.agg(F.count(F.lit(1)).alias("sessions"), F.coalesce(F.sum("requests"), F.lit(0)).alias("requests"), F.coalesce(F.sum("original_chars"), F.lit(0)).alias("o"), F.coalesce(F.sum("saved_chars"), F.lit(0)).alias("s"))
    return out.select("sessions", "requests", tokens_of(F.col("s")).alias("saved_tokens"), saving_percent(F.col("s"), F.col("o")).alias("saving_percent"))


def refused_calls(calls: DataFrame, by: str = "client") -> DataFrame:
    """Number and last time of calls with status 429."""
    return calls.groupBy(by).agg(F.count_if(F.col("status") == 429).alias("refused"), F.max(F.when(F.col("status") == 429, F.col("ts"))).alias("last_ts"))


def budget_share(usage: DataFrame, budgets: DataFrame, by: str = "client") -> DataFrame:
    """Tokens of each month against the ``budget`` of its ``by``; without a budget the share is null."""
    month = F.trunc(F.to_date("ts"), "month")
    per = usage.groupBy(by, month.alias("month")).agg(F.sum("input_tokens").alias("tokens"))
    return per.join(budgets, by, "left").withColumn("share_percent", F.when(F.col("budget") > 0, saving_percent(F.col("tokens"), F.col("budget"))))


def upsert_sessions(history: DataFrame, current: DataFrame) -> DataFrame:
    """History with the sessions of ``current`` in place of those with the same id."""
    return history.join(current.select("session_id"), "session_id", "left_anti").unionByName(current)


def next_reset(limit_events: DataFrame, now: Column, by: str = "client") -> DataFrame:
    """The least reset time after ``now``; null if there is none."""
    return limit_events.groupBy(by).agg(F.min(F.when(F.col("reset_ts") > now, F.col("reset_ts"))).alias("next_ts"))


def period_cost(requests: DataFrame, prices: DataFrame, unit: str = "month") -> DataFrame:
    """``<unit>, requests, saved_chars, saved_cost``: the saved cost of all requests by their models' prices, divided among the
    periods by what each of them saved."""
    total = model_cost(requests, prices).agg(F.sum("saved").alias("_cost"))
    per = requests.groupBy(F.date_trunc(unit, "ts").cast("date").alias(unit)).agg(F.count(F.lit(1)).alias("requests"), F.sum("saved_chars").alias("saved_chars"))
    whole = per.agg(F.sum("saved_chars").alias("_all"))
    both = per.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(whole))  # one row each
    return both.select(unit, "requests", "saved_chars", F.when(F.col("_all") != 0, F.col("_cost") * F.col("saved_chars") / F.col("_all")).otherwise(0.0).alias("saved_cost"))
