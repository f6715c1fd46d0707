"""The rules on command output that Spark writes from ``orders``: a block for each customer, some lines for each of their orders.

The output of a command is rendered as text, cleaned, classified and compacted by the operators. The SQL never reads that
text: it works out from the table what each rule must leave of it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txcompact.operators import rules
from txcompact.plans.queries import QUERIES, SQL, read

N = "chr(10)"
#: One row for each line to be: ``blk`` (customer), ``key`` (order), ``k`` (its line), ``i`` (place of the order), ``m`` (orders), ``n`` (place of the line), ``total`` (lines).
ROWS = """WITH r AS (SELECT o_custkey AS blk, o_orderkey AS key, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS m FROM orders),
x AS (SELECT *, k.k, {n} AS n, m * {reps} AS total FROM r, (SELECT unnest(range(1, {reps} + 1)) AS k) k)"""


@dataclass(frozen=True)
class Output:
    """Expressions in SQL that Spark and the other engine read alike: ``head`` and ``tail`` over a block, ``line`` over a row (null: no line)."""

    name: str
    pattern: str
    line: str
    want: str  #: what must be left, over all rows of a block
    head: tuple[str, ...] = ()
    tail: tuple[str, ...] = ()
    reps: int = 3
    tool: str = "bash"
    by_k: bool = False  #: lines stand by ``k``, then order
    pressure: str = "0.0"
    got: str | None = None  #: the expected pattern, where it differs by block
    more: str = ""  #: further tables for the SQL; the last must be ``y``


#: Orders whose keys one task sorts, about.
TASK_ROWS = 200_000


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``blk`` (customer), ``keys`` (their orders in order) and ``m`` (how many): one exchange of two columns.

    Its number of partitions is given, as texts of many times the keys' size are written from it, which their size does not tell; it
    grows with the orders, so that a task's part does not."""
    orders = read(spark, sf_dir, "orders")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-orders.count() // TASK_ROWS))
    keys = F.transform(F.sort_array(F.collect_list(F.struct(F.col("o_orderkey").alias("key")))), lambda x: x["key"])
    return orders.repartition(parts, "o_custkey").groupBy(F.col("o_custkey").alias("blk")).agg(keys.alias("keys")).withColumn("m", F.size("keys").cast("long"))


#: Stands for the key in lines that are written once for a block; no output holds such a character.
MARK = "chr(1)"


def names_in(expr: str) -> set[str]:
    """Names of an expression, outside of its literals."""
    return set(re.findall(r"[a-z_]+", re.sub(r"'[^']*'", "", expr)))


def key_is_text(line: str) -> bool:
    """Whether the lines of an order are the same for all orders of a block but for the key, which is put between other texts."""
    bare = re.sub(r"'[^']*'", "''", line)
    return not names_in(line) & {"i", "n", "rpad", "substr", "repeat"} and not re.search(r"key\s*[-+*/%<>=]|[-+*/%<>=(]\s*key", bare)


def written(o: Output, once: bool = True) -> Column:
    """``block_id, tool, pressure, text`` of a customer. The names that ``line`` uses are variables of lambdas over orders and their lines.

    ``once``: lines in which only the key changes from order to order are written once for a block, with a mark that each key replaces."""
    bound = lambda expr, **names: "".join(f"aggregate(array(0), {v}, (a_, b_) -> a_, {k} -> " for k, v in names.items()) + expr + ")" * len(names)
    used = {"i": "j + 1", "n": "m * (k - 1) + i" if o.by_k else f"(i - 1) * {o.reps} + k"}
    asked = names_in(o.line) | ({"i"} if "n" in names_in(o.line) else set())
    line = bound(o.line, **{name: value for name, value in used.items() if name in asked})
    reps, total = f"sequence(1, {o.reps})", f"m * {o.reps}"
    ends = [f"array({', '.join(xs)})" if xs else "array()" for xs in (o.head, o.tail)]
    join = lambda lines: f"array_join(concat({ends[0]}, {lines}, {ends[1]}), {N})"
    if once and not o.by_k and key_is_text(o.line):
        lines = bound(f"array_join(transform({reps}, k -> {o.line}), {N})", key=MARK)
        text = bound(join(f"transform(keys, key -> replace(lines, {MARK}, cast(key as string)))"), total=total, lines=lines)
    else:
        each = f"transform({reps}, k -> transform(keys, (key, j) -> {line}))" if o.by_k else f"transform(keys, (key, j) -> transform({reps}, k -> {line}))"
        text = bound(join(f"flatten({each})"), total=total)
    name = F.concat(F.lit(f"{o.name}:"), F.col("blk").cast("string"))
    return F.struct(name.alias("block_id"), F.lit(o.tool).alias("tool"), F.expr(o.pressure).cast("double").alias("pressure"), F.expr(text).alias("text"))


def _rows_sql(o: Output) -> str:
    return ROWS.format(reps=o.reps, n="(k.k - 1) * m + i" if o.by_k else f"(i - 1) * {o.reps} + k.k")


def _expected(o: Output) -> str:
    pattern = o.got or f"'{o.pattern}'"
    source = "y" if o.more else "x"
    return f"{_rows_sql(o)}{o.more} SELECT blk AS block_id, {pattern} AS pattern, {o.want} AS text FROM {source} GROUP BY blk, m, total"


def head(o: tuple[str, ...]) -> str:
    return "".join(f"{x} || {N} || " for x in o)


def agg(expr: str, where: str = "true") -> str:
    return f"string_agg({expr}, {N} ORDER BY n) FILTER ({where})"


def block(*parts: str) -> str:
    """Lines and groups of lines, where they are not null."""
    return f"concat_ws({N}, {', '.join(parts)})"


def note(count: str, what: str) -> str:
    return f"CASE WHEN {count} > 0 THEN '... [' || ({count}) || ' {what}]' END"


PRESSURE = "(blk % 20) / 20.0"
BAND = "CASE WHEN blk % 20 >= 18 THEN {} WHEN blk % 20 >= 15 THEN {} ELSE {} END"
ID = "rpad(key || 'a' || k, 64, 'b')"
FAIL = "(key + k) % 7 = 0"
#: From the first failure on, as blank lines that would end a block are gone by then.
FAILED = ", y AS (SELECT *, min(CASE WHEN " + FAIL + " THEN n END) OVER (PARTITION BY blk) AS bad FROM x)"

#: Lines of code whose language goes by the block.
CODE = """CASE WHEN k > 1 THEN '  body of ' || key || ' ' || k WHEN blk % 3 = 0 THEN 'def f' || key || '(x):'
    WHEN blk % 3 = 1 THEN 'func F' || key || '() error {' ELSE 'pub fn f' || key || '() {' END"""
D = "'diff --git a/f' || blk || ' b/f' || blk", "'index 1..2 of ' || blk", "'--- a/file' || blk", "'+++ b/file' || blk"
HUNK = "'@@ -' || n || ',5 +' || n || ',5 @@ export async function fn' || key || '_' || k || '(x) {'"
CHANGED = "' context one ' || n", "'-old value ' || n", "'+new value ' || n", "' context two ' || n"
SHORT = f"{HUNK} || {N} || CASE WHEN blk % 20 < 18 THEN {CHANGED[0]} || {N} ELSE '' END || {CHANGED[1]} || {N} || {CHANGED[2]} || CASE WHEN blk % 20 < 18 THEN {N} || {CHANGED[3]} ELSE '' END"

OUTPUTS = [
    Output(
        "git_diff", "gitDiff",
        f"concat_ws({N}, {HUNK}, {CHANGED[0]}, ' even more before ' || n, {CHANGED[1]}, {CHANGED[2]}, {CHANGED[3]}, ' even more after ' || n)",
        block(f"CASE WHEN 4 + total * (CASE WHEN blk % 20 >= 18 THEN 3 ELSE 5 END) > 100 THEN 'Changed: ' || string_agg('fn' || key || '_' || k, ', ' ORDER BY n) END", *D, f"string_agg({SHORT}, {N} ORDER BY n)"),
        head=D, reps=2, pressure=PRESSURE,
    ),
    Output(
        "git_log", "gitLog",
        f"concat_ws({N}, 'commit ' || rpad('a' || key || 'b' || k, 20, '0'), 'Author: Name' || key || '-' || k || ' <a@b.c>', 'Date:   Day ' || key || '-' || k, '', '    message ' || key || ' ' || k, '')",
        block(agg("substr(rpad('a' || key || 'b' || k, 20, '0'), 1, 7) || ' message ' || key || ' ' || k || ' (Name' || key || '-' || k || ', Day ' || key || '-' || k || ')'", f"n <= {BAND.format(10, 20, 30)}"), note(f"total - {BAND.format(10, 20, 30)}", "more commits")),
        reps=4, pressure=PRESSURE,
    ),
    Output(
        "git_log_short", "gitLog", "rpad('a' || key || 'b' || k, 9, '0') || ' subject of ' || key || ' ' || k",
        block(agg("rpad('a' || key || 'b' || k, 9, '0') || ' subject of ' || key || ' ' || k", f"n <= {BAND.format(10, 20, 30)}"), note(f"total - {BAND.format(10, 20, 30)}", "more commits")),
        reps=4, pressure=PRESSURE,
    ),
    Output(
        "git_status", "gitStatus",
        f"concat_ws({N}, CASE WHEN i > 1 THEN NULL WHEN k = 1 THEN 'Changes to be committed:' WHEN k = 2 THEN 'Changes not staged for commit:' ELSE 'Untracked files:' END, CASE WHEN i = 1 THEN '  (use \"git restore\" on ' || k || ')' END, chr(9) || CASE WHEN k = 1 THEN 'new file:   ' WHEN k = 2 THEN 'modified:   ' ELSE '' END || 'src/f' || key || '.ts')",
        block("'* main' || blk || ' [Your branch is ahead of origin by ' || blk || ' commits.]'", *[f"'{s}: ' || m || ' file' || CASE WHEN m = 1 THEN '' ELSE 's' END || {N} || " + agg("'   src/f' || key || '.ts'", f"k = {k}") for k, s in ((1, "+ Staged"), (2, "~ Modified"), (3, "? Untracked"))]),
        head=("'On branch main' || blk", "'Your branch is ahead of origin by ' || blk || ' commits.'"), by_k=True,
    ),
    Output(
        "git_branch", "gitBranch", "'  feature/branch-' || key || '-' || k",
        block("'* main-line-' || blk", agg("'  feature/branch-' || key || '-' || k", "total <= 19 OR n <= 15"), note("CASE WHEN total > 19 THEN total - 15 ELSE 0 END", "more branches")),
        head=("'* main-line-' || blk",),
    ),
    Output(
        "cargo_test", "cargoTest", f"'test case_' || key || '_' || k || ' ... ' || CASE WHEN {FAIL} THEN 'FAILED' ELSE 'ok' END",
        block(agg(f"'test case_' || key || '_' || k || ' ... ' || CASE WHEN {FAIL} THEN 'FAILED' ELSE 'ok' END", "n >= bad"), "'failures: see above'", "'test result: ' || total || ' tests run'"),
        head=("'running ' || total || ' tests'",), tail=("'failures: see above'", "'test result: ' || total || ' tests run'"), more=FAILED,
    ),
    Output(
        "cargo_build", "cargoBuild",
        "CASE k WHEN 1 THEN 'error[E' || (1000 + key % 9000) || ']: mismatched types ' || key WHEN 2 THEN '  --> src/m' || key || '.rs:4:5' WHEN 3 THEN '   = note: expected ' || key ELSE '   Compiling crate_' || key || ' v0.1.0' END",
        block(agg("CASE k WHEN 1 THEN 'error[E' || (1000 + key % 9000) || ']: mismatched types ' || key WHEN 2 THEN '  --> src/m' || key || '.rs:4:5' ELSE '   = note: expected ' || key END", "k < 4"), "'error: could not compile crate ' || blk"),
        head=("'   Compiling first_' || blk || ' v0.1.0'",), tail=("'error: could not compile crate ' || blk",), reps=4,
    ),
    Output(
        "vitest", "vitest", f"CASE WHEN {FAIL} THEN '× failing case ' ELSE '✓ suite number ' END || key || ' ' || k",
        block(agg(f"CASE WHEN {FAIL} THEN '× failing case ' ELSE '✓ suite number ' END || key || ' ' || k", "n >= bad"), "'Test Files  ' || m || ' run'", "'Duration  1.' || blk || 's'"),
        tail=("'Test Files  ' || m || ' run'", "'Duration  1.' || blk || 's'"), more=FAILED,
    ),
    Output(
        "playwright", "playwright", f"CASE WHEN {FAIL} THEN '  ✘ b' || key || '_' || k || '.spec.ts bad' || {N} || '    detail of ' || key || ' ' || k ELSE '  ✓ t' || key || '_' || k || '.spec.ts good' END",
        block(agg(f"'  ✘ b' || key || '_' || k || '.spec.ts bad' || {N} || '    detail of ' || key || ' ' || k", FAIL), "'  ' || m || ' failed'", "'  ' || total || ' passed'"),
        head=("'Running ' || total || ' tests using playwright'",), tail=("'  ' || m || ' failed'", "'  ' || total || ' passed'"),
    ),
    Output(
        "py_traceback", "pyTraceback",
        f"CASE WHEN k = 1 AND i <= 2 THEN concat_ws({N}, 'Traceback (most recent call last):', '  File \"f' || key || '.py\", line ' || i, '    call_' || key || '()', 'Oops: ' || key || ' went wrong') ELSE 'log line ' || key || ' ' || k END",
        block(agg(f"concat_ws({N}, 'Traceback (most recent call last):', '  File \"f' || key || '.py\", line ' || i, '    call_' || key || '()', 'Oops: ' || key || ' went wrong')", "k = 1 AND i <= 2"), "'FAILED tests/t' || blk || '.py::case'", "'    assert ' || blk", "'== ' || m || ' failed in 2s'"),
        head=("'collected ' || total || ' items'",), tail=("'FAILED tests/t' || blk || '.py::case'", "'    assert ' || blk", "'== ' || m || ' failed in 2s'"),
    ),
    Output(
        "go_test", "goTest", f"CASE WHEN {FAIL} THEN '--- FAIL: Test' || key || '_' || k || {N} || '    f_test.go:' || k || ': wrong ' || key ELSE '--- PASS: Test' || key || '_' || k END",
        block(agg(f"'--- FAIL: Test' || key || '_' || k || {N} || '    f_test.go:' || k || ': wrong ' || key", FAIL), "'FAIL' || chr(9) || 'pkg/x' || blk || chr(9) || '0.01s'"),
        head=("'--- PASS: TestFirst' || blk",), tail=("'FAIL' || chr(9) || 'pkg/x' || blk || chr(9) || '0.01s'",),
    ),
    Output(
        "tsc", "tsc", "'src/f' || key || '.ts(' || (key % 90) || ',' || k || '): error TS' || (2000 + k) || ': bad thing ' || key || ' ' || k",
        f"string_agg(CASE WHEN k = 1 THEN 'src/f' || key || '.ts: 7 error(s)' || {N} ELSE '' END || '  error TS' || (2000 + k) || ': bad thing ' || key || ' ' || k, {N} ORDER BY n) FILTER (k <= 5)",
        reps=7,
    ),
    Output(
        "eslint", "eslint", "CASE WHEN k = 2 THEN 'chatter about ' || key ELSE '  ' || n || ':10  ' || CASE WHEN k = 1 THEN 'error' ELSE 'warning' END || '  Missing ' || key || '  https://lint.org/r' || k END",
        block("'/home/me/file' || blk || '.js'", agg("'  ' || n || ':10  ' || CASE WHEN k = 1 THEN 'error' ELSE 'warning' END || '  Missing ' || key", "k <> 2"), "total || ' problems'"),
        head=("'/home/me/file' || blk || '.js'",), tail=("total || ' problems'",),
    ),
    Output(
        "prettier", "prettier", "CASE WHEN k = 2 THEN 'chatter about ' || key ELSE '[warn] src/f' || key || '_' || k || '.ts' END",
        block(agg("'[warn] src/f' || key || '_' || k || '.ts'", "k <> 2"), "'Code style issues found in ' || total || ' files'"),
        head=("'Checking formatting now'",), tail=("'Code style issues found in ' || total || ' files'",),
    ),
    Output(
        "next_build", "nextBuild", "'○ /page' || key || '_' || k || '  5 kB'",
        block("'info  - Linting of ' || blk", "'Route (app) of ' || blk", agg("'○ /page' || key || '_' || k || '  5 kB'"), "'+ First Load JS shared by ' || blk"),
        head=("'Next.js 14.0.' || blk", "'Creating the build ' || blk", "'info  - Linting of ' || blk", "'Route (app) of ' || blk"), tail=("'+ First Load JS shared by ' || blk",),
    ),
    Output(
        "pkg_install", "pkgInstall", "'http fetch GET 200 /r/' || key || '_' || k", block("'added ' || total || ' packages in 3s'", "'found 0 vulnerabilities in ' || blk"),
        tail=("'added ' || total || ' packages in 3s'", "'found 0 vulnerabilities in ' || blk"),
    ),
    Output(
        "pkg_list", "pkgList", "CASE WHEN k <= 4 THEN '├── direct-' || key || '-' || k || '@1.0.0' ELSE '│   ├── nested-' || key || '-' || k || '@2.0.0' END",
        block("'project' || blk || '@1.0.0'", agg("'├── direct-' || key || '-' || k || '@1.0.0'", "k <= 4 AND (i - 1) * 4 + k <= 59"), note("2 * m", "nested packages omitted"), note("4 * m - 59", "more direct packages")),
        head=("'project' || blk || '@1.0.0'",), reps=6,
    ),
    Output(
        "pkg_outdated", "pkgOutdated", "'pkg-' || key || '-' || k || '  1.0.' || k || '  1.1.' || k || '  2.0.' || k",
        block("'Package  Current  Wanted  Latest'", agg("'pkg-' || key || '-' || k || '  1.0.' || k || '  1.1.' || k || '  2.0.' || k", "n <= 29"), note("total - 29", "more outdated packages")),
        head=("'Package  Current  Wanted  Latest'",), reps=4,
    ),
    Output(
        "terraform", "terraform", "CASE k WHEN 1 THEN '  # res.r' || key || ' will be created' WHEN 2 THEN '      name = ' || key ELSE '  # res.s' || key || ' must be replaced' END",
        block(agg("CASE k WHEN 1 THEN '# res.r' || key || ' will be created' ELSE '# res.s' || key || ' must be replaced' END", "k <> 2"), "'Plan: ' || m || ' to add'"),
        head=("'Terraform will perform these actions on ' || blk",), tail=("'  Plan: ' || m || ' to add'",),
    ),
    Output(
        "npx", "npx", "'real output of ' || key || ' ' || k",
        block("CASE WHEN blk % 2 = 0 THEN 'npm warn something about ' || blk END", agg("'real output of ' || key || ' ' || k")),
        head=("'npm warn deprecated old-' || blk || '@1.0.0: gone'", "CASE WHEN blk % 2 = 1 THEN 'npx: installed ' || blk || ' in 2s' END", "'npm warn something about ' || blk"),
    ),
    Output(
        "docker_ps", "dockerPs", f"{ID} || ' nginx:' || key || '  web-' || k", block("'CONTAINER ID   IMAGE   NAMES'", agg(f"substr({ID}, 1, 12) || '  nginx:' || key || '  web-' || k")),
        head=("'CONTAINER ID   IMAGE   NAMES'",),
    ),
    Output(
        "docker_images", "dockerImages", f"CASE WHEN k = 1 THEN 'repo' || key || '  latest  ' || {ID} ELSE '<none>  <none>  ' || {ID} END", block("'REPOSITORY   TAG   IMAGE ID'", agg(f"'repo' || key || '  latest  ' || substr({ID}, 1, 12)", "k = 1")),
        head=("'REPOSITORY   TAG   IMAGE ID'",),
    ),
    Output(
        "kubectl", "kubectl", "'pod-' || key || '-' || k || '      1/1         Running'", block("'NAME  READY  STATUS'", agg("'pod-' || key || '-' || k || '  1/1  Running'")),
        head=("'NAME         READY       STATUS'",),
    ),
    Output(
        "prisma", "prisma", "CASE k WHEN 1 THEN 'Generated client ' || key WHEN 2 THEN '┌── box ' || key || ' ──┐' WHEN 3 THEN '│ boxed text ' || key || ' │' ELSE '└── box ' || key || ' ──┘' END",
        block("'Prisma schema loaded for ' || blk", agg("'Generated client ' || key", "k = 1")), head=("'Prisma schema loaded for ' || blk",), reps=4,
    ),
    Output(
        "gh_checks", "ghPrChecks", "'check-' || key || '-' || k || '  completed  success'", block("'NAME  STATE  CONCLUSION'", agg("'check-' || key || '-' || k || '  completed  success'", "n <= 24"), note("total - 24", "more checks")),
        head=("'NAME  STATE  CONCLUSION'",),
    ),
    Output(
        "gh_pr", "ghPr", "CASE k WHEN 1 THEN 'A body that says much about ' || key WHEN 2 THEN '#' || key || ' is linked' ELSE '✗ check of ' || key END",
        block("'title: Mend ' || blk", "'state: OPEN'", "'url: https://github.com/o/r/pull/' || blk", agg("CASE k WHEN 2 THEN '#' || key || ' is linked' ELSE '✗ check of ' || key END", "k > 1")),
        head=("'title: Mend ' || blk", "'state: OPEN'", "'url: https://github.com/o/r/pull/' || blk"),
    ),
    Output(
        "gh_runs", "ghRunList", "'completed  success  flow-' || key || '-' || k", block("'STATUS  CONCLUSION  WORKFLOW'", agg("'completed  success  flow-' || key || '-' || k", "n <= 19"), note("total - 19", "more")),
        head=("'STATUS  CONCLUSION  WORKFLOW'",),
    ),
    Output(
        "gh_issues", "ghIssueList", "'number ' || key || '-' || k || '  subject  OPEN'", block("'ISSUE  TITLE  STATE'", agg("'number ' || key || '-' || k || '  subject  OPEN'", "n <= 24"), note("total - 24", "more")),
        head=("'ISSUE  TITLE  STATE'",),
    ),
    Output(
        "curl", "curl", "CASE k WHEN 1 THEN '> Header-' || key || ': v' WHEN 2 THEN '* info on ' || key ELSE '< Answer-' || key || ': v' END",
        block("'% Total of ' || blk", "'Trying host ' || blk", "'on port ' || blk", agg("'< Answer-' || key || ': v'", "k = 3"), "'{\"result\": ' || blk || '}'"),
        head=("'% Total of ' || blk", "'Trying host ' || blk", "'on port ' || blk", "'* Connected to ' || blk || ' port 80'"), tail=("'{\"result\": ' || blk || '}'",),
    ),
    Output(
        "wget", "wget", "CASE k WHEN 1 THEN 'Resolving h' || key || '.com... 1.2.3.4' WHEN 2 THEN 'Connecting to h' || key ELSE '2024-01-01 saved [' || key || ']' END",
        agg("'2024-01-01 saved [' || key || ']'", "k = 3"), head=("'--2024-- http://x' || blk",),
    ),
    Output(
        "errors_or_tail", "errorExtracted", "CASE WHEN k = 4 AND key % 3 = 0 THEN 'Error: broke at ' || key ELSE 'ordinary line ' || key || ' ' || k END",
        f"CASE WHEN {{dense}} AND total - max(near_n) > 10 THEN concat_ws({N}, {agg('line', 'near = 1')}, '... [' || (total - max(near_n)) || ' non-error lines omitted]') WHEN total > {{longest}} THEN concat_ws({N}, '... [' || (total - {{last}}) || ' earlier lines omitted]', {agg('line', 'n > total - {last}')}) ELSE {agg('line')} END".format(
            dense="total >= 30 AND max(err_n) > 0", longest=BAND.format(50, 80, 80), last=BAND.format(30, 50, 50)
        ),
        reps=10, pressure=PRESSURE, got="CASE WHEN total >= 30 AND max(err_n) > 0 THEN 'errorExtracted' ELSE 'truncated' END",
        more=""", e AS (SELECT *, CASE WHEN k = 4 AND key % 3 = 0 THEN 'Error: broke at ' || key ELSE 'ordinary line ' || key || ' ' || k END AS line, CASE WHEN k = 4 AND key % 3 = 0 THEN 1 ELSE 0 END AS err FROM x),
f AS (SELECT *, max(err) OVER (PARTITION BY blk ORDER BY n ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM e), y AS (SELECT *, sum(near) OVER (PARTITION BY blk) AS near_n, sum(err) OVER (PARTITION BY blk) AS err_n FROM f)""",
    ),
    Output(
        "truncated", "truncated", "'plain line ' || key || ' ' || k",
        block(note(f"CASE WHEN total > {BAND.format(50, 80, 80)} THEN total - {BAND.format(30, 50, 50)} ELSE 0 END", "earlier lines omitted"), agg("'plain line ' || key || ' ' || k", f"total <= {BAND.format(50, 80, 80)} OR n > total - {BAND.format(30, 50, 50)}")),
        reps=10, pressure=PRESSURE,
    ),
    Output(
        "grep", "grepCompacted", "'src/f' || key || '_' || (CASE WHEN k <= 9 THEN 0 ELSE 1 END) || '.ts:' || k || ':  match ' || key || ' ' || k",
        f"CASE WHEN total < 20 THEN {agg('''('src/f' || key || '_' || (CASE WHEN k <= 9 THEN 0 ELSE 1 END) || '.ts:' || k || ':  match ' || key || ' ' || k)''')} ELSE concat_ws({N}, {agg('shown', 'f <= 30 AND nth <= most + 1')}, CASE WHEN m > 15 THEN {N} || '... [' || (2 * m - 30) || ' more files]' END) END",
        tool="grep", reps=11, pressure=PRESSURE, got="CASE WHEN total >= 20 THEN 'grepCompacted' END",
        more=f""", g AS (SELECT *, CASE WHEN k <= 9 THEN k ELSE k - 9 END AS nth, CASE WHEN k <= 9 THEN 2 * i - 1 ELSE 2 * i END AS f, CASE WHEN k <= 9 THEN 9 ELSE 2 END AS hits, {BAND.format(4, 6, 8)} AS most FROM x),
y AS (SELECT *, CASE WHEN nth = 1 THEN CASE WHEN f > 1 THEN {N} ELSE '' END || 'src/f' || key || '_' || (CASE WHEN k <= 9 THEN 0 ELSE 1 END) || '.ts (' || hits || ' matches):' || {N} ELSE '' END || CASE WHEN nth > most THEN '    ... (+more)' ELSE '  match ' || key || ' ' || k END AS shown FROM g)""",
    ),
    Output(
        "glob", "globCompacted", "'src/d' || k || '/file' || key || '.ts'",
        f"CASE WHEN total > 30 THEN concat_ws({N}, total || ' files total:', string_agg('src/d' || k || '/ (' || m || ' files)', {N} ORDER BY n) FILTER (i = 1)) ELSE {agg('''('src/d' || k || '/file' || key || '.ts')''')} END",
        tool="glob", reps=4, got="CASE WHEN total > 30 THEN 'globCompacted' END",
    ),
    Output(
        "lockfile", "readLockfile", "'\"pkg-' || key || '-' || k || '@1\": \"resolved\" ' || n",
        f"CASE WHEN total > 200 THEN '[lockfile — ' || total || ' lines, ~' || total || ' packages — omitted to save tokens]' ELSE {agg('''('\"pkg-' || key || '-' || k || '@1\": \"resolved\" ' || n)''')} END",
        tool="read", reps=25, got="CASE WHEN total > 200 THEN 'readLockfile' END",
    ),
    Output(
        "code", "readSemantic", "CASE WHEN k = 1 THEN 'export function f' || key || '() {' ELSE '  body of ' || key || ' ' || k END",
        f"""CASE WHEN total > 500 THEN concat_ws({N}, {agg("'export function f' || key || '() {'", 'k = 1')}, '... [' || (total - m) || ' implementation lines omitted]')
        WHEN total > 200 THEN concat_ws({N}, {agg('line', 'n <= 100')}, {N} || '... [' || (total - 180) || ' lines omitted] ...' || {N}, {agg('line', 'n > total - 80')}) ELSE {agg('line')} END""",
        tool="read", reps=60, got="CASE WHEN total > 500 THEN 'readSemantic' WHEN total > 200 THEN 'readHeadTail' END",
        more=", y AS (SELECT *, CASE WHEN k = 1 THEN 'export function f' || key || '() {' ELSE '  body of ' || key || ' ' || k END AS line FROM x)",
    ),
    Output(
        "read", "readHeadTail", "'line of ' || key || ' ' || k",
        f"CASE WHEN total > 200 THEN concat_ws({N}, {agg('''('line of ' || key || ' ' || k)''', 'n <= 100')}, {N} || '... [' || (total - 180) || ' lines omitted] ...' || {N}, {agg('''('line of ' || key || ' ' || k)''', 'n > total - 80')}) ELSE {agg('''('line of ' || key || ' ' || k)''')} END",
        tool="read", reps=40, got="CASE WHEN total > 200 THEN 'readHeadTail' END",
    ),
    Output(
        "code_languages", "readSemantic", CODE,
        f"""CASE WHEN total > 500 THEN concat_ws({N}, {agg('line', 'k = 1')}, '... [' || (total - m) || ' implementation lines omitted]')
        WHEN total > 200 THEN concat_ws({N}, {agg('line', 'n <= 100')}, {N} || '... [' || (total - 180) || ' lines omitted] ...' || {N}, {agg('line', 'n > total - 80')}) ELSE {agg('line')} END""",
        tool="read", reps=60, got="CASE WHEN total > 500 THEN 'readSemantic' WHEN total > 200 THEN 'readHeadTail' END", more=f", y AS (SELECT *, {CODE} AS line FROM x)",
    ),
    # Outputs of which a rule keeps nothing, so that its closing lines stay instead.
    Output(
        "go_passed", "goTest", "'--- PASS: Test' || key || '_' || k", "'ok' || chr(9) || 'pkg/x' || blk || chr(9) || '0.01s'",
        tail=("'ok' || chr(9) || 'pkg/x' || blk || chr(9) || '0.01s'",),
    ),
    Output(
        "playwright_passed", "playwright", "'  ✓ t' || key || '_' || k || '.spec.ts good'", "'All ' || total || ' passed'",
        head=("'Running ' || total || ' tests using playwright'",), tail=("'All ' || total || ' passed'",),
    ),
    Output(
        "cargo_built", "cargoBuild", "'   Compiling crate_' || key || '_' || k || ' v0.1.0'", "'Finished dev of ' || total || ' crates'",
        tail=("'no warnings of ' || blk", "'Finished dev of ' || total || ' crates'"),
    ),
    Output("py_short", "pyTraceback", "'tests/t' || key || '_' || k || '.py::case FAILED'", "total || ' failed today'", tail=("total || ' failed today'",)),
    Output("other_tool", "none", "'CONTAINER ID IMAGE ' || key || ' ' || k", agg("'CONTAINER ID IMAGE ' || key || ' ' || k"), tool="fetch", reps=30, got="CAST(NULL AS VARCHAR)"),
]


#: Queries by family of rules; each runs one compaction over the outputs of all its rules.
FAMILIES = {
    "rules_git": ("git_diff", "git_log", "git_log_short", "git_status", "git_branch"),
    "rules_tests": ("cargo_test", "cargo_build", "vitest", "playwright", "py_traceback", "go_test"),
    "rules_lint": ("tsc", "eslint", "prettier", "next_build"),
    "rules_packages": ("pkg_install", "pkg_list", "pkg_outdated", "npx", "prisma"),
    "rules_containers": ("terraform", "docker_ps", "docker_images", "kubectl"),
    "rules_forge": ("gh_checks", "gh_pr", "gh_runs", "gh_issues"),
    "rules_transfer_and_fallback": ("curl", "wget", "errors_or_tail", "truncated"),
    "rules_languages": ("code_languages",),
    "rules_closing_lines": ("go_passed", "playwright_passed", "cargo_built", "py_short"),
    "rules_search_and_read": ("grep", "glob", "lockfile", "code", "read", "other_tool"),
}
BY_NAME = {o.name: o for o in OUTPUTS}


def together(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> DataFrame:
    """Blocks of several outputs, their ids led by the output's name, all written from one pass over the orders."""
    return customers(spark, sf_dir).select(F.inline(F.array(*[written(BY_NAME[name]) for name in names])))


def _compacted(names: tuple[str, ...]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """What the rules leave of outputs written from orders."""
        return rules.compact_blocks(together(spark, sf_dir, names), pressure=F.col("pressure")).select("block_id", "pattern", "text")

    return run


for _name, _members in FAMILIES.items():
    QUERIES[_name] = _compacted(_members)
    SQL[_name] = " UNION ALL ".join(f"SELECT '{o.name}:' || block_id AS block_id, pattern, text FROM ({_expected(o)})" for o in map(BY_NAME.get, _members))


def rule_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each rule fired over all outputs together, cleaned as before a compaction, most often first."""
    every = together(spark, sf_dir, tuple(BY_NAME))
    return rules.coverage(rules.classified(every)).select("pattern", "n", "section", "fallback").orderBy(F.desc("n"), "pattern")


def _coverage_sql() -> str:
    each = " UNION ALL ".join(f"SELECT pattern, blk FROM ({_rows_sql(o)}{o.more} SELECT blk, {o.got or repr(o.pattern)} AS pattern FROM {'y' if o.more else 'x'} GROUP BY blk, m, total)" for o in OUTPUTS)
    return f"SELECT pattern, count(*) AS n, CASE WHEN pattern LIKE 'read%' THEN 'read' WHEN pattern LIKE 'grep%' THEN 'grep' WHEN pattern LIKE 'glob%' THEN 'glob' ELSE 'bash' END AS section, pattern IN ('errorExtracted', 'truncated') AS fallback FROM ({each}) WHERE pattern IS NOT NULL GROUP BY pattern"


QUERIES["rule_coverage"] = rule_coverage
SQL["rule_coverage"] = _coverage_sql()
