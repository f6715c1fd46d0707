"""Classification of tool output by an ordered rule table, and its compaction by the matching rule.

A rule is data: when it applies, and for its lines which open an island, close it, end it, are kept in any
case, how kept lines are rewritten, and how many stay. A block's lines are an array of its row, and ``CASE`` on the block's
pattern picks the one rule whose expressions run over them, so nothing is exchanged.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txcompact.functions import text as t
from txcompact.functions.text import let
from txcompact.operators.blocks import by_key, cut, places, segments, spans
from txcompact.operators.clean import clean
from txcompact.sources.steps import stored


def T() -> Column:  # noqa: N802
    return F.col("text")


def L() -> Column:  # noqa: N802
    return F.col("line")


def holds(x: Column, word: str) -> Column:
    """Whether a word stands in a text. A pattern that is one word of four letters or more skips ahead; ``contains`` looks at every byte."""
    return x.rlike(rf"\Q{word}\E") if len(word) >= 4 else x.contains(word)


def has(*words: str) -> Column:
    out = holds(T(), words[0])
    for w in words[1:]:
        out = out & holds(T(), w)
    return out


def some(*words: str) -> Column:
    out = holds(T(), words[0])
    for w in words[1:]:
        out = out | holds(T(), w)
    return out


def more_lines(x: Column, n: int) -> Column:
    """Whether a text has more than ``n`` lines; nothing behind these is read."""
    return F.octet_length(F.substring_index(x, "\n", n)) < F.octet_length(x)


def starts(*words: str) -> Column:
    out = T().startswith(words[0])
    for w in words[1:]:
        out = out | T().startswith(w)
    return out


def line_share(pattern: str, test: Callable[[Column, Column], Column], among: str = r"\S") -> Column:
    """``test`` of how many lines match, and how many there are with ``among`` in them; lines are taken apart once."""
    count = lambda lines, p: F.size(F.filter(lines, lambda x: x.rlike(p)))
    counts = lambda lines: F.struct(count(lines, pattern).alias("n"), count(lines, among).alias("total"))
    return let(let(F.split("text", "\n", -1), counts), lambda c: test(c["n"], c["total"]))


@dataclass(frozen=True)
class Rule:
    """Patterns are regular expressions over a line; None never matches. Kinds: ``islands`` (opens, closes, ends and
    keep), ``lines`` (keep only), ``drop`` (keep all but), ``cap`` (first ``cap`` non-blank lines), or one with code of its own."""

    name: str
    applies: Callable[[], Column]
    kind: str = "lines"
    opens: str | None = None
    closes: str | None = None
    ends: str | None = None
    keep: str | None = None
    drop: str | None = None
    within: str | None = None  #: lines of an island that stay; None: all
    rewrite: tuple[str, str] | None = None
    cap: int | None = None
    fallback: str | None = None  #: lines that stay if nothing else does
    what: str = "lines"


def _git_log() -> Column:
    short = line_share(r"^[a-f0-9]{7,12}[^a-f0-9]", lambda n, total: (total >= 3) & (n >= 3) & (n / total > 0.6))
    return (T().startswith("commit ") & has("Author:", "Date:")) | (T().rlike("(?m)^[a-f0-9]{7}") & short)


def _git_branch() -> Column:
    return T().rlike(r"(?m)^[* ]{1,2}[\w/.\-]") & line_share(r"^[* ]{1,2}[\w/.\-]+(?: -> [\w/.\-]+)?$", lambda n, total: (total >= 2) & (n / total > 0.8))


# The rule table in its order (first match wins), with the words and patterns that the rules look for. Words are
# sought before patterns, as most texts hold none of them.
RULES = [
    Rule("gitDiff", lambda: some("diff --git") | has("--- a/", "+++ b/"), "diff"),
    Rule("gitLog", _git_log, "log"),
    Rule("gitStatus", lambda: T().startswith("On branch ") | T().startswith("HEAD detached at"), "status"),
    Rule("gitBranch", _git_branch, "branch"),
    Rule("cargoTest", lambda: has("test ", "... ") & T().rlike(r"test .+\.\.\. (ok|FAILED)"), "islands", opens=r"FAILED|error\[|panicked at|^---- .* stdout ----$", ends=r"^(test result:|failures:|error: test failed)", fallback=r"^test result:"),
    Rule("cargoBuild", lambda: (has("error[E") & T().rlike(r"error\[E\d+\]")) | (has("Compiling") & some("error", "warning")), "islands", opens=r"^error(\[E\d+\])?:(?! aborting| could not compile)|^warning(\[.*?\])?:", ends=r"^error: (aborting|could not compile)", within=r"^(  -->|   \||   =)", fallback=r"Finished|error: could not compile"),
    Rule("vitest", lambda: some("✓", "✕", "×") & some("Test Files", "PASS", "FAIL"), "islands", opens=r"[×✕]|\bFAIL\b|AssertionError|Error:|Expected|Received", ends=r"^(Test Files|Tests|Duration|Suites)", fallback=r"^(Test Files|Tests|Duration)"),
    Rule("playwright", lambda: some("passed", "failed", "Error", "FAILED") & (some("playwright") | T().rlike(r"\.(spec|test)\.(ts|js)")), "islands", opens=r"^\s*([✘×✕]|FAILED)\s", closes=r"^\s*[✓✔]\s", ends=r"^\s*\d+\s+(passed|failed|skipped|flaky)|^Finished in", keep=r"Error:|TimeoutError|Slowest", fallback=r"\d+\s+(passed|failed)"),
    Rule("pyTraceback", lambda: some("Traceback (most recent call last)") | has("FAILED", ".py::"), "islands", opens=r"^Traceback \(most recent call last\)|^(FAILED|ERROR) .+::", ends=r"^(PASSED|passed \d+|failed \d+|error \d+|=+ \d+ (passed|failed|error))", fallback=r"\d+ (passed|failed|error)"),
    Rule("goTest", lambda: starts("--- PASS:", "--- FAIL:") | (starts("ok", "FAIL") & T().rlike(r"^(ok|FAIL)\s+\S+\s+[\d.]+s")), "islands", opens=r"^(--- FAIL:|FAIL|panic:)", closes=r"^(--- PASS:|ok\s)", fallback=r"^(ok|FAIL)\s"),
    Rule("tsc", lambda: has("error TS") & T().rlike(r"error TS\d+:"), "tsc"),
    Rule("eslint", lambda: some("error", "warning") & T().rlike(r"\d:\d+\s+(error|warning)\s+"), keep=r"\d+:\d+\s+(error|warning)|^[/\\]|^\w:[/\\]|\d+ (problem|error|warning)", rewrite=(r"\s+https?://\S+", "")),
    Rule("prettier", lambda: has("[warn]") & some("needs formatting", "Code style issues"), keep=r"^\[warn\]|needs formatting|^\s{2}\S|Code style issues|All matched files"),
    Rule("nextBuild", lambda: has("Next.js") & some("Route (", "Failed to compile"), "islands", opens=r"Route \(|[○●λ]", keep=r"Error:|error TS|Failed to compile|^(info|warn|error)\s+-|First Load JS|Total size"),
    Rule("pkgInstall", lambda: (has("added ", " package") & T().rlike(r"added \d+ package")) | (some("packages are looking for funding") & (F.size(F.split("text", "\n")) > 5)), keep=r"added \d+|removed \d+|Done in|\d+ packages? in \d|warn|vulnerabilit|up to date"),
    Rule("pkgList", lambda: has("├──") & (some("@") | T().rlike(r"\bv\d+\.\d+")), "packages", cap=60),
    Rule("pkgOutdated", lambda: T().rlike(r"(?i)Current\s+Wanted\s+Latest"), "cap", cap=30, what="outdated packages"),
    Rule("terraform", lambda: (has("# ") & some("will be created", "will be destroyed", "must be replaced")) | some("Terraform will perform"), keep=r"^\s*#.*(will be|must be|has been)|Plan:|Apply complete|No changes|Destroy complete|[Ee]rror:", rewrite=(r"^\s+(?=#|.*(Plan:|Apply complete|No changes|Destroy complete))", "")),
    Rule("npx", lambda: starts("npm warn", "npm error") | some("npx: installed") | (has("Packages: ", "installed") & T().rlike("Packages: .*installed")), "banner"),
    Rule("dockerPs", lambda: has("CONTAINER ID", "IMAGE"), "drop", drop=r"^$", rewrite=(r"^([a-f0-9]{12})[a-f0-9]{52}\s", "$1  ")),
    Rule("dockerImages", lambda: has("REPOSITORY", "TAG", "IMAGE ID"), "drop", drop=r"^(?!REPOSITORY).*<none>|^$", rewrite=(r"\b([a-f0-9]{12})[a-f0-9]{52}\b", "$1")),
    Rule("kubectl", lambda: starts("NAME") & T().rlike(r"^NAME\s+(READY\s+STATUS|STATUS\s+ROLES|TYPE\b|AGE\b|SHORTNAMES\b)"), "drop", drop=r"^$", rewrite=(r"\s{2,}", "  ")),
    Rule("prisma", lambda: some("┌", "└─", "Prisma schema") & T().rlike("(?i)prisma"), "box"),
    Rule("ghPrChecks", lambda: has("CONCLUSION") & T().rlike(r"\bCONCLUSION\b") & T().rlike(r"(?i)(success|failure|neutral|cancelled|skipped)") & ~some("WORKFLOW"), "cap", cap=25, what="checks"),
    Rule("ghPr", lambda: some("github.com") & T().rlike(r"(?im)^(title|state|url):?\s"), keep=r"(?i)^(title|state|author|url|number|labels|milestone|draft|checks)|^#\d+|[✓✗●○]|https://github\.com"),
    Rule("ghRunList", lambda: has("STATUS", "CONCLUSION", "WORKFLOW"), "cap", cap=20, what="more"),
    Rule("ghIssueList", lambda: has("ISSUE", "TITLE", "STATE"), "cap", cap=25, what="more"),
    Rule("curl", lambda: some("* Connected to") | (some("\n>") & line_share("^>", lambda n, total: n > 3)), "curl"),
    Rule("wget", lambda: has("--") & some("Resolving ", "Connecting to ", "HTTP request sent", "saved ["), keep=r"saved \[|200 OK|404 Not Found|Error|ERROR|^\d{4}-\d{2}-\d{2}.*saved"),
]
# Words of error lines, and the wider list by which output counts as dense in errors. First letters are looked at
# before anything else.
ERROR = r"(?=[EFef])\b(Error|ERROR|error|FATAL|fatal|Exception|exception|failed|FAILED)\b"
DENSE = r"(?=[EFWefw])\b(Error|ERROR|error|FATAL|fatal|WARN|Warning|warning|Exception|exception|failed|FAILED)\b"
#: One of these is in every word of that list.
DENSE_PARTS = ("rror", "ERROR", "FATAL", "fatal", "WARN", "arning", "xception", "failed", "FAILED")
COMMENT = r"^\s*//"
#: Structural lines by language, and how a language shows in the first 30 lines.
LANGUAGES = [
    ("ts", r"(?m)^import .+ from ['\"]|^export (function|class|const|type|interface|default)\b|: (string|number|boolean|void|unknown)\b", r"^(import |export |async function |function |class |const |let |var |type |interface |enum |@\w)"),
    ("py", r"(?m)^from \S+ import |^def \w+\(|^class \w+[:(]", r"^(import |from .+ import|def |class |@\w)"),
    ("go", r"(?m)^package \w+|^func \w+\(|^\s*import \(", r"^(import|func |type |var |const |package )\b"),
    ("rs", r"(?m)^use (std|crate|self)::|^(pub\s+)?fn \w+\(|^impl\s+", r"^(use |pub |fn |struct |enum |impl |trait |mod |const |static )\b"),
]


def _bash_pattern(rules: list[Rule]) -> Column:
    out = None
    for r in rules:
        out = F.when(r.applies(), r.name) if out is None else out.when(r.applies(), r.name)
    dense = line_share(rf"^(?!\s*//).*{DENSE}", lambda errors, total: (errors > 0) & (errors <= total * 0.5), "(?s)^.*")
    return out.when(more_lines(T(), 29) & some(*DENSE_PARTS) & T().rlike(DENSE) & dense, "errorExtracted").otherwise("truncated")


def classify(blocks: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Adds ``pattern``: the first rule that fits a block's (cleaned) text, by its tool; null: base clean only."""
    tool = F.lower(F.coalesce("tool", F.lit("")))
    filled = F.size(F.filter(F.split("text", "\n", -1), lambda x: x != ""))
    sample = F.substring_index("text", "\n", 30)
    language = None
    for name, shows, _ in LANGUAGES:
        language = F.when(sample.rlike(shows), name) if language is None else language.when(sample.rlike(shows), name)
    lock = some("integrity sha", '"resolved"', "# yarn lockfile")
    read = F.when(more_lines(T(), 200), F.when(lock, "readLockfile").when(more_lines(T(), 500) & language.isNotNull(), F.concat(F.lit("readSemantic:"), language)).otherwise("readHeadTail"))
    return blocks.withColumn("pattern", F.when(tool == "bash", _bash_pattern(rules)).when(tool == "read", read).when((tool == "grep") & (filled >= 20), "grepCompacted").when((tool == "glob") & more_lines(T(), 30), "globCompacted"))


def classified(blocks: DataFrame, rules: list[Rule] = RULES, keep: tuple[str, ...] = ()) -> DataFrame:
    """``block_id, text`` (cleaned, by its tool), ``tool``, the columns ``keep`` and ``pattern``."""
    return classify(clean(blocks, F.lower(F.coalesce("tool", F.lit(""))) == "read", keep=("tool", *keep)), rules)


def coverage(classified: DataFrame) -> DataFrame:
    """``pattern, n, section, fallback, cut``: how often each rule fired, most often first in a report.

    ``section`` tells command output from searches and file reads; ``fallback`` marks the rules for output of no known command;
    ``cut`` counts the blocks that the rule made shorter, where ``classified`` has ``compact_chars`` (as ``compact_blocks`` gives it)."""
    shorter = F.count_if(F.col("compact_chars") < F.col("original_chars")) if "compact_chars" in classified.columns else F.lit(None).cast("long")
    name = F.regexp_replace("pattern", ":.*", "")
    section = F.when(name.startswith("read"), "read").when(name.startswith("grep"), "grep").when(name.startswith("glob"), "glob").otherwise("bash")
    # Blocks of no rule go after they are counted: a filter before that would work out each pattern a second time.
    hits = classified.groupBy(name.alias("pattern")).agg(F.count("pattern").alias("n"), shorter.alias("cut")).where("n > 0")
    return hits.select("pattern", "n", section.alias("section"), name.isin("errorExtracted", "truncated").alias("fallback"), "cut")


def _band(critical: int, high: int, normal: int) -> Column:
    """A number by pressure."""
    return F.when(F.col("pressure") >= 0.9, critical).when(F.col("pressure") >= 0.75, high).otherwise(normal)


def _is(pattern: str | None) -> Callable[[Column], Column]:
    """Whether a line matches; None never does."""
    return lambda x: F.lit(False) if pattern is None else x.rlike(pattern)


def _filled(x: Column) -> Column:
    return x.rlike(r"\S")


def _blank(x: Column) -> Column:
    return x.rlike(r"^\s*\z")


def _place(lines: Column, which: Callable[..., Column]) -> Column:
    """The place of the first such line, from 1 on; 0 if there is none."""
    return F.array_position(F.transform(lines, which), F.lit(True)).cast("int")


def _kept(lines: Column, before: Column | None = None, after: Column | None = None, names: Column | None = None) -> Column:
    """Lines that stay, texts before and behind them, and names to list."""
    fields = ((lines, "array<string>", "kept"), (before, "string", "before"), (after, "string", "after"), (names, "array<string>", "names"))
    return F.struct(*[(F.lit(None) if x is None else x).cast(kind).alias(name) for x, kind, name in fields])


def _omitted(n: Column, what: str) -> Column:
    return F.when(n > 0, F.format_string(f"... [%d {what}]", n.cast("long")))


def rule_lines(r: Rule, lines: Column) -> Column:
    """Rules of islands, kept and dropped lines."""
    opens, closes, ends, keep, drop = (_is(getattr(r, f)) for f in ("opens", "closes", "ends", "keep", "drop"))
    if r.kind == "drop":
        found = F.filter(lines, lambda x: ~drop(x))
    elif not r.opens:
        found = F.filter(lines, lambda x: ends(x) | keep(x))
    else:
        found = _islands(r, lines, opens, closes, ends, keep)
    rest = F.filter(lines, _is(r.fallback)) if r.fallback else lines
    kept = let(found, lambda k: F.when(F.size(k) > 0, k).otherwise(rest))
    return _kept(F.transform(kept, lambda x: F.regexp_replace(x, *r.rewrite)) if r.rewrite else kept)


def _islands(r: Rule, lines: Column, opens, closes, ends, keep) -> Column:
    """An event line opens an island (1), begins a traceback (2) or ends either (0); the lines up to the next one go by it."""
    python = r.name == "pyTraceback"

    def kind(x: Column) -> Column:
        trace = x.startswith("Traceback (most recent call last)") if python else F.lit(False)
        return F.when(trace, 2).when(opens(x), 1).when(ends(x) | closes(x) | _blank(x), 0)

    def traced(rest: Column) -> Column:
        """A traceback goes on up to its first line without an indent."""
        loose = _place(rest, lambda x: ~x.rlike(r"^[ \t]"))
        return let(loose, lambda n: F.filter(rest, lambda x, i: (n == 0) | (i < n) | keep(x)))

    def island(value: Column, line: Column, rest: Column) -> Column:
        first = F.when((value == 1) | opens(line) | ends(line) | keep(line), F.array(line)).otherwise(F.array().cast("array<string>"))
        inside = rest if r.within is None else F.filter(rest, lambda x: x.rlike(r.within) | keep(x))
        after = F.when(value == 1, inside)
        after = after.when(value == 2, let(rest, traced)) if python else after
        return F.concat(first, after.otherwise(F.filter(rest, keep)))

    return segments(lines, kind, lambda xs: F.filter(xs, keep), island)


def capped_lines(lines: Column, limit: Column | int, what: str) -> Column:
    """The first ``limit`` lines that are not blank."""
    most = limit if isinstance(limit, Column) else F.lit(limit)
    after = lambda n: F.when(n > most, F.concat(F.lit("... ["), (n - most).cast("string"), F.lit(f" {what if what.startswith('more') else f'more {what}'}]")))
    return let(F.filter(lines, _filled), lambda xs: _kept(F.slice(xs, F.lit(1), most), after=after(F.size(xs))))


def diff_lines(lines: Column) -> Column:
    """Changes with the line behind each, and the functions that hunks name."""
    context = lambda x: ~x.rlike(r"^(diff --git|index |--- |\+\+\+ |@@|[+-])")
    beside = lambda flags, i: (i > 0) & ~F.get(flags, i - 1) & ~F.coalesce(F.col("pressure") >= 0.9, F.lit(False))
    kept = let(F.transform(lines, context), lambda flags: F.filter(lines, lambda x, i: ~F.get(flags, i) | (x.startswith(" ") & beside(flags, i))))
    heading = lambda x: F.trim(F.regexp_extract(x, r"^@@[^@]+@@\s+(.+)", 1))
    function = lambda x: F.regexp_extract(F.regexp_replace(heading(x), r"^(export\s+)?(default\s+)?(async\s+)?(function\s+)?", ""), r"^(\w[^\s(:{<]*)", 1)
    names = lambda xs: F.array_distinct(F.filter(F.transform(F.filter(xs, lambda x: x.startswith("@@")), function), lambda x: x != ""))
    return let(kept, lambda xs: _kept(xs, names=names(xs)))


def branch_lines(lines: Column) -> Column:
    """All branches, or the current one and fifteen others."""
    current = lambda x: x.startswith("* ")

    def some_of(xs: Column) -> Column:
        own, other = F.filter(xs, current), F.filter(xs, lambda x: ~current(x))
        few = _kept(F.concat(F.slice(own, 1, 1), F.slice(other, 1, 15)), after=_omitted(F.size(xs) - 1 - F.least(F.lit(15), F.size(other)), "more branches"))
        return F.when(F.size(xs) > 20, few).otherwise(_kept(xs))

    return let(F.filter(lines, _filled), some_of)


def package_lines(lines: Column) -> Column:
    """Direct packages, where others are nested in them."""

    def direct(xs: Column) -> Column:
        own = F.filter(xs, lambda x: ~x.rlike(r"^[\s│]"))
        nested = F.size(xs) - F.size(own)
        after = F.concat_ws("\n", _omitted(nested, "nested packages omitted"), _omitted(F.size(own) - 60, "more direct packages"))
        return F.when(nested > 0, _kept(F.slice(own, 1, 60), after=after)).otherwise(_kept(xs))

    return let(F.filter(lines, _filled), direct)


def banner_lines(lines: Column) -> Column:
    """What follows the installer's remarks; without these all but its warnings."""
    banner = _place(lines, lambda x: x.rlike(r"^npx: installed \d+|^Packages: \d+"))
    output = lambda at: F.when(at > 0, _place(lines, lambda x, i: (i >= at) & _filled(x) & ~x.rlike("^npm (warn|error)"))).otherwise(0)
    rest = F.filter(lines, lambda x: ~x.rlike("^npm warn (deprecated|WARN)"))
    return _kept(let(banner, lambda at: let(output(at), lambda n: F.when(n > 0, F.slice(lines, F.greatest(n, F.lit(1)), F.size(lines))).otherwise(rest))))


def box_lines(lines: Column) -> Column:
    """Lines outside of drawn boxes."""
    edge = lambda x: F.when(x.rlike(r"^\s*[┌╔]"), 1).when(x.rlike(r"^\s*[└╚]"), 0)
    return _kept(segments(lines, edge, lambda xs: F.filter(xs, _filled), lambda value, line, rest: F.when(value == 0, F.filter(rest, _filled)).otherwise(F.array().cast("array<string>"))))


def transfer_lines(lines: Column) -> Column:
    """A transfer without its chatter, where that is much of it and comes before the body."""
    share = F.size(F.filter(lines, lambda x: x.rlike("^[><*]"))) / F.size(lines)
    body = _place(lines, lambda x: x.rlike(r"^(\* Connected|\z|\{|\[|<)"))
    return _kept(F.when((body < 4) | (share <= 0.4), lines).otherwise(F.filter(lines, lambda x: ~x.rlike(r"^[>*]|^\s*\z"))))


def last_lines(lines: Column) -> Column:
    """The end of long output."""
    n, longest, last = F.size(lines), _band(50, 80, 80), _band(30, 50, 50)
    return F.when(n > longest, _kept(cut(lines, n - last, last), before=_omitted(n - last, "earlier lines omitted"))).otherwise(_kept(lines))


def error_lines(lines: Column) -> Column:
    """Errors with their neighbours, where that leaves out more than ten lines."""
    error = lambda x: x.rlike(ERROR) & ~x.rlike(COMMENT)
    near = lambda flags: F.filter(lines, lambda x, i: F.get(flags, i) | ((((i > 0) & F.get(flags, i - 1)) | F.coalesce(F.get(flags, i + 1), F.lit(False))) & _filled(x)))
    rest = lambda xs: F.size(lines) - F.size(xs)
    found = let(F.transform(lines, error), near)
    return let(found, lambda xs: F.when(rest(xs) > 10, _kept(xs, after=_omitted(rest(xs), "non-error lines omitted"))).otherwise(last_lines(lines)))


def lock_line(lines: Column) -> Column:
    # Fixed value: the sentence that stands for a lock file.
    packages = F.size(F.filter(lines, lambda x: x.rlike('^"?[a-z@]')))
    return _kept(F.array(F.format_string("[lockfile — %d lines, ~%d packages — omitted to save tokens]", F.size(lines), packages)))


def end_lines(lines: Column) -> Column:
    """The first hundred and last eighty lines."""
    n = F.size(lines)
    middle = F.concat(F.get(lines, F.lit(99)), F.lit("\n\n"), _omitted(n - 180, "lines omitted"), F.lit(" ...\n"))
    return F.when(n > 180, _kept(F.concat(cut(lines, F.lit(0), F.lit(99)), F.array(middle), cut(lines, n - 80, F.lit(80))))).otherwise(_kept(lines))


def code_lines(pattern: str, lines: Column) -> Column:
    """Structural lines, where there are two or more."""
    found = F.filter(lines, lambda x: x.rlike(pattern))
    return let(found, lambda xs: F.when(F.size(xs) >= 2, _kept(xs, after=_omitted(F.size(lines) - F.size(xs), "implementation lines omitted"))).otherwise(end_lines(lines)))


def commit_lines(lines: Column) -> Column:
    """Verbose logs as a line for each commit, of which the first stay."""
    head = lambda x: x.startswith("commit ")
    value = lambda xs, head: F.array_max(F.transform(F.filter(xs, lambda x: x.startswith(head)), lambda x: F.substring(x, F.lit(len(head) + 1), F.length(x))))
    none, most = F.lit(""), _band(10, 20, 30)

    def folded(xs: Column) -> Column:
        message = F.get(F.filter(xs, lambda x: ~x.rlike(r"^(commit |Author:|Date:)|^\s*\z")), F.lit(0))
        author = t.trimmed(F.split_part(F.coalesce(value(xs, "Author:"), none), F.lit("<"), F.lit(1)))
        return F.format_string("%s %s (%s, %s)", F.substring(value(xs, "commit "), 1, 7), F.coalesce(t.trimmed(message), none), author, t.trimmed(F.coalesce(value(xs, "Date:"), none)))

    starts = F.filter(places(lines), lambda i: head(F.get(lines, i)))
    shown = lambda at: F.transform(F.slice(at, F.lit(1), most), lambda s, j: let(cut(lines, s, F.coalesce(F.get(at, j + 1), F.size(lines)) - s), folded))
    return let(starts, lambda at: _kept(shown(at), after=_omitted(F.size(at) - most, "more commits")))


def status_text(lines: Column) -> Column:
    """A status as branch, files by section with counts, or the remark that nothing changed."""
    sections = (("staged", "+ Staged"), ("modified", "~ Modified"), ("untracked", "? Untracked"))
    remark = lambda x: x.rlike("ahead|behind|diverged") & ~x.rlike("^(On branch |HEAD detached at)")
    section = lambda x: F.when(x.startswith("Changes to be committed"), "staged").when(x.startswith("Changes not staged"), "modified").when(x.startswith("Untracked files:"), "untracked").when(x.rlike("^(nothing to commit|no changes added)"), "")
    is_file = lambda x: ~remark(x) & x.rlike(r"^(\t|  )\s*[^\s(]")
    file = lambda x: F.regexp_replace(t.trimmed(x), r"^(modified|new file|deleted|renamed|both modified|copied):\s+", "")
    none = F.array().cast("array<struct<s:string,f:string>>")
    named = lambda value, line, rest: F.transform(F.filter(rest, is_file), lambda x: F.struct(value.alias("s"), file(x).alias("f")))
    found = segments(lines, lambda x: F.when(~remark(x), section(x)), lambda xs: none, named)
    branch = F.array_max(F.transform(F.filter(lines, lambda x: x.rlike("^(On branch |HEAD detached at)")), lambda x: F.when(x.startswith("On branch "), t.trimmed(F.substring(x, F.lit(11), F.length(x)))).otherwise(t.trimmed(x))))
    remarks, clean_ = F.filter(lines, remark), F.get(F.filter(lines, lambda x: x.rlike("nothing to commit|working tree clean")), F.lit(0))
    title = F.concat(F.lit("* "), branch, F.coalesce(F.concat(F.lit(" ["), t.trimmed(F.try_element_at(remarks, F.lit(-1))), F.lit("]")), F.lit("")))

    def whole(files: Column) -> Column:
        def shown(s: str, title: str) -> Column:
            own = lambda xs: F.concat(F.format_string(f"{title}: %d file%s\n", F.size(xs), F.when(F.size(xs) == 1, "").otherwise("s")), F.array_join(F.transform(xs, lambda x: F.concat(F.lit("   "), x["f"])), "\n"))
            return let(F.filter(files, lambda x: x["s"] == s), lambda xs: F.when(F.size(xs) > 0, own(xs)))

        nothing = F.when(~F.exists(files, lambda x: x["s"] != ""), t.trimmed(clean_))
        return F.array(F.concat_ws("\n", title, *[shown(s, title) for s, title in sections], nothing))

    return _kept(let(found, whole))


def _grouped(lines: Column, key: Callable[[Column], Column], order: Callable[[Column, Column], Column], shown: Callable[..., Column]) -> Column:
    """``shown(key, places, n, number)`` of the groups of lines by ``key``, sorted by ``order(n, first place)``; ``n`` counts a group's lines."""

    def groups(rows: Column, starts: Column) -> Column:
        ordered = F.sort_array(spans(starts, F.size(rows), lambda s, n, j: F.struct(order(n, F.get(rows, s)["pos"]).alias("o"), s.alias("s"), n.alias("n"))))
        return F.flatten(F.transform(ordered, lambda g, no: shown(F.get(rows, g["s"])["key"], lambda most: F.transform(cut(rows, g["s"], F.least(g["n"], most)), lambda x: x["pos"]), g["n"], no)))

    return by_key(F.transform(lines, key), groups)


def compiler_lines(lines: Column) -> Column:
    """Compiler errors by file, in the order of appearance, five of each."""

    def whole(xs: Column) -> Column:
        file = lambda x: F.trim(F.regexp_extract(x, r"^(.+?)\(\d+,\d+\):", 1))
        body = lambda x: t.trimmed(F.regexp_replace(x, r"^.+?\(\d+,\d+\):\s*", ""))
        title = lambda key, n, i: F.when(i == 0, F.format_string("%s: %d error(s)\n", key, n)).otherwise("")
        shown = lambda key, at, n, no: F.transform(at(F.lit(5)), lambda pos, i: F.concat(title(key, n, i), F.lit("  "), body(F.get(xs, pos))))
        return _grouped(xs, lambda x: F.coalesce(F.nullif(file(x), F.lit("")), F.lit("unknown")), lambda n, first: first, shown)

    return _kept(let(F.filter(lines, lambda x: x.rlike(r"(error|warning) TS\d+:")), whole))


def search_lines(lines: Column) -> Column:
    """Searches by file: of the first thirty files a few matches each, with true counts."""

    def whole(xs: Column) -> Column:
        most = _band(4, 6, 8)
        file = lambda x: F.when(x.rlike("^[^:]+:"), F.split_part(x, F.lit(":"), F.lit(1))).otherwise("")
        body = lambda key, x, i: F.when(i >= most, "  ... (+more)").when(key == "", x).otherwise(t.trimmed(F.regexp_replace(x, r"^[^:]+:(\d+:)?", "")))
        title = lambda key, n: F.when(key == "", "").otherwise(F.format_string("%s (%d match%s):\n", key, n, F.when(n == 1, "").otherwise("es")))
        line = lambda key, n, no, x, i: F.concat(F.when((i == 0) & (no > 0), "\n").otherwise(""), F.when(i == 0, title(key, n)).otherwise(""), F.when(key == "", "").otherwise("  "), body(key, x, i))
        none = F.array().cast("array<string>")
        shown = lambda key, at, n, no: F.array(F.struct(F.when(no < 30, F.transform(at(most + 1), lambda pos, i: line(key, n, no, F.get(xs, pos), i))).otherwise(none).alias("ls")))
        groups = _grouped(xs, file, lambda n, first: first, shown)
        return let(groups, lambda gs: _kept(F.flatten(F.transform(gs, lambda g: g["ls"])), after=F.when(F.size(gs) > 30, F.concat(F.lit("\n"), _omitted(F.size(gs) - 30, "more files")))))

    return let(F.filter(lines, _filled), whole)


def path_lines(lines: Column) -> Column:
    """Paths as counts by directory, most files first."""
    path = lambda x: F.replace(x, F.lit("\\"), F.lit("/"))
    folder = lambda x: F.when(x.contains("/"), F.regexp_replace(x, "/[^/]*$", "")).otherwise(".")
    shown = lambda key, at, n, no: F.array(F.format_string("%s/ (%d files)", key, n))
    groups = lambda xs: _grouped(xs, lambda x: folder(path(x)), lambda n, first: F.struct(-n, first), shown)
    return let(F.filter(lines, _filled), lambda xs: _kept(groups(xs), before=F.format_string("%d files total:", F.size(xs))))


def _chosen(rules: list[Rule], lines: Column, found: set[str]) -> Column:
    """What the rule of the block's pattern leaves of its lines; null where none cuts. Only the patterns ``found`` have a branch."""
    verbose = F.col("text").startswith("commit ") & F.col("text").contains("Author:") & F.col("text").contains("Date:")
    own = {
        "gitDiff": diff_lines, "gitStatus": status_text, "gitBranch": branch_lines, "pkgList": package_lines, "npx": banner_lines, "prisma": box_lines, "curl": transfer_lines, "tsc": compiler_lines,
        "gitLog": lambda ls: F.when(verbose, commit_lines(ls)).otherwise(capped_lines(ls, _band(10, 20, 30), "more commits")),
        "errorExtracted": error_lines, "truncated": last_lines, "grepCompacted": search_lines, "globCompacted": path_lines, "readLockfile": lock_line, "readHeadTail": end_lines,
        **{f"readSemantic:{name}": lambda ls, p=p: code_lines(p, ls) for name, _, p in LANGUAGES},
    }
    for r in rules:
        if r.kind in ("islands", "lines", "drop"):
            own[r.name] = lambda ls, r=r: rule_lines(r, ls)
        elif r.kind == "cap":
            own[r.name] = lambda ls, r=r: capped_lines(ls, r.cap, r.what)
    out = None
    for name, made in own.items():
        if name not in found:
            continue
        here = F.col("pattern") == name
        out = F.when(here, made(lines)) if out is None else out.when(here, made(lines))
    return out


def compact_blocks(blocks: DataFrame, rules: list[Rule] = RULES, pressure: Column | float = 0.0, id_col: str = "block_id") -> DataFrame:
    """``block_id, pattern, text, original_chars, compact_chars`` for blocks with ``tool`` and ``text``.

    ``pressure`` (a number, or a column of ``blocks``) tightens the caps. A row stays a row through clean, classification and rule; only a
    block's own lines are taken apart. Classified texts are stored, so that the rules' ``CASE`` finds the pattern worked out, and holds the
    rules only that some block asks for: to describe and plan all of them takes longer than small tables do."""
    at = pressure if isinstance(pressure, Column) else F.lit(float(pressure))
    named = blocks.select(F.col(id_col).alias("block_id"), "tool", "text", F.coalesce(at, F.lit(0.0)).alias("pressure")).withColumn("original_chars", F.length("text"))
    found = stored(classified(named, rules, ("pressure", "original_chars")), "classified", packed=True)
    # Before the pattern's alias, which expressions in lambdas would take for the column.
    made = found.select("block_id", "pattern", left_of(found, rules).alias("text"), "original_chars")
    return made.select("block_id", F.regexp_replace("pattern", ":.*", "").alias("pattern"), "text", "original_chars", F.length("text").alias("compact_chars"))


def left_of(found: DataFrame, rules: list[Rule] = RULES) -> Column:
    """What a block's rule leaves of its text, or the text; for stored rows with ``pattern``, (cleaned) ``text`` and ``pressure``."""

    def short(r: Column) -> Column:
        changed = F.when((F.size(r["kept"]) > 100) & (F.size(r["names"]) > 0), F.concat(F.lit("Changed: "), F.array_join(r["names"], ", ")))
        return let(F.array_join(r["kept"], "\n"), lambda body: F.when(body != "", F.concat_ws("\n", changed, r["before"], body, r["after"])))

    asked = {row["pattern"] for row in found.select("pattern").where("pattern is not null").distinct().collect()}
    shorter = F.when(F.col("pattern").isNotNull(), let(F.split("text", "\n", -1), lambda ls: let(_chosen(rules, ls, asked), short))) if asked else F.lit(None).cast("string")
    return F.coalesce(shorter, F.col("text"))
