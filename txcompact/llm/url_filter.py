"""URL filters: longest matching host-and-path rule for every url, by a sorted interval sweep.

A rule ``host/path`` fits its host and all its subdomains if the url's path starts with the rule's
path. Keys are canonical: the host's labels reversed, a zero byte, then the path; as bytes, all
that a rule fits for one host suffix is the interval from its own key to the key followed by 0xFF,
and such intervals nest. Every url puts one point for each of its host suffixes (no longer than the
longest rule's host). Events (a rule opens, a rule closes) and points are sorted together; each
event carries the rule on top of the stack after it, so the last event before a point names the
innermost active rule. Points are dealt to buckets by a hash of the url, and the events, which are
few beside the urls, go to each bucket: a host that holds a third of the urls is spread evenly.

Defined results: a null url, or one without ``://``, has an empty host and path and fits no rule; an
empty rule list gives the default verdict to all; of rules with the same host and path, block wins; of fitting rules of
one length the one with the longer host wins, then block; repeated urls and repeated page ids each keep their row;
columns of the input named ``host``, ``path``, ``rule`` or ``verdict`` are replaced by the results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txcompact.llm.common import UPPER, LOWER, table


def url_host(url: Column) -> Column:
    """From after the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def _key(labels: Column, path: Column) -> Column:
    return F.concat(F.array_join(labels, ".").cast("binary"), F.lit(b"\x00"), path.cast("binary"))


def compile_rules(rules: DataFrame) -> DataFrame:
    """``rule string, action string`` -> ``host_key, path, rule, action, depth`` with one row for each host and path."""
    slash = F.instr("rule", "/")
    return (
        rules.where(F.col("rule").isNotNull() & (F.col("rule") != "") & (slash != 1))
        .select(
            F.translate(F.when(slash > 0, F.substring_index("rule", "/", 1)).otherwise(F.col("rule")), UPPER, LOWER).alias("host"),
            F.when(slash > 0, F.expr("substring(rule, instr(rule, '/'))")).otherwise("").alias("path"),
            "rule",
            "action",
        )
        .groupBy("host", "path")
        .agg(F.max(F.struct("action", "rule")).alias("best"))
        .select(F.array_join(_labels(F.col("host")), ".").alias("host_key"), "path", "best.rule", "best.action", F.size(F.split("host", r"\.")).alias("depth"))
    )


def _events(compiled: DataFrame) -> DataFrame:
    """Opening and closing of each rule, with the rule that is innermost afterwards."""
    own = compiled.select("host_key", "path", F.struct("rule", "action", F.length("rule").alias("long"), F.length("host_key").alias("deep")).alias("top"))
    lengths = own.select("host_key", F.length("path").alias("n")).distinct()
    outer = own.select("host_key", F.col("path").alias("outer_path"), F.col("top").alias("outer_top"))
    parents = (
        own.join(lengths, "host_key")
        .where(F.col("n") < F.length("path"))
        .withColumn("outer_path", F.expr("substring(path, 1, n)"))
        .join(outer, ["host_key", "outer_path"])
        .groupBy("host_key", "path")
        .agg(F.max_by("outer_top", "n").alias("parent"))
    )
    start = F.concat(F.col("host_key").cast("binary"), F.lit(b"\x00"), F.col("path").cast("binary"))
    return own.join(parents, ["host_key", "path"], "left").select(
        F.inline(
            F.array(
                F.struct(start.alias("key"), F.lit(0).alias("is_point"), F.struct(F.lit(True).alias("event"), F.col("top").alias("rule")).alias("state")),
                F.struct(F.concat(start, F.lit(b"\xff")).alias("key"), F.lit(0).alias("is_point"), F.struct(F.lit(True).alias("event"), F.col("parent").alias("rule")).alias("state")),
            )
        )
    )


def judge_urls(urls: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", buckets: int | None = None) -> DataFrame:
    """Each row of ``urls`` with ``host, path, rule, verdict`` of the longest rule that fits."""
    spark = urls.sparkSession
    buckets = buckets or max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    compiled = compile_rules(rules)
    deepest = compiled.agg(F.max("depth")).first()[0] or 0
    keyed = urls.drop(*[c for c in ("host", "path", "rule", "verdict") if c != url_col]).withColumn("_url", F.col(url_col)).withColumn("host", url_host(F.col("_url"))).withColumn("path", url_path(F.col("_url"))).drop("_url")
    if not deepest:
        return keyed.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    places = keyed.where(F.col("host") != "").select("host", "path").distinct()
    points = (
        places.withColumn("labels", _labels(F.col("host")))
        .select("host", "path", "labels", F.explode(F.sequence(F.lit(1), F.least(F.size("labels"), F.lit(deepest)))).alias("depth"))
        .select(
            F.pmod(F.hash("host", "path"), F.lit(buckets)).alias("bucket"),
            _key(F.expr("slice(labels, 1, depth)"), F.col("path")).alias("key"),
            F.lit(1).alias("is_point"),
            F.lit(None).cast("struct<event:boolean,rule:struct<rule:string,action:string,long:int,deep:int>>").alias("state"),
            "host",
            "path",
        )
    )
    events = _events(compiled).select(F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), "key", "is_point", "state", F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"))
    sweep = Window.partitionBy("bucket").orderBy("key", "is_point").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    judged = (
        points.unionByName(events)
        .withColumn("active", F.last("state", ignorenulls=True).over(sweep))
        .where((F.col("is_point") == 1) & F.col("active.rule").isNotNull())
        .groupBy("host", "path")
        .agg(F.max(F.struct("active.rule.long", "active.rule.deep", "active.rule.action", "active.rule.rule")).alias("best"))
    )
    # Urls without a host fit no rule and need no join, where they would share one key.
    with_host = keyed.where(F.col("host") != "").join(judged, ["host", "path"], "left")
    out = lambda df, rule, action: df.select(*[F.col(c) for c in keyed.columns], rule.alias("rule"), F.coalesce(action, F.lit(default)).alias("verdict"))
    none = F.lit(None).cast("string")
    return out(with_host, F.col("best.rule"), F.col("best.action")).unionByName(out(keyed.where(F.col("host") == ""), none, none))


#: The rules that the query judges by.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(a).alias("action")) for r, a in RULES])))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = """
WITH p AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(rule, rhost, rpath, action) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
  ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow'))
SELECT page_id, host, path,
       (SELECT arg_max(rule, length(rule)) FROM r WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS rule,
       coalesce((SELECT arg_max(action, length(rule)) FROM r WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)), 'allow') AS verdict
FROM p
"""
