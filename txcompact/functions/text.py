"""Column functions on texts and sizes. Sizes are code points (Spark's ``length``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 3.5
CONTEXT_CHARS = 800_000

# What the cleaning stages look for.
BLANKS = " \t\n\x0b\x0c\r"
ANSI = [r"\x1B\[[0-9;]*[mGKHF]", r"\x1B\][^\x07]*\x07", r"(?![\t\n\r])\p{Cntrl}"]
#: What the last of them finds, one by one: a class without ranges is looked up in one table.
CONTROL = "[" + "".join(rf"\x{i:02X}" for i in (*range(32), 127) if chr(i) not in "\t\n\r") + "]"
#: These, and ends of lines that are not Unix's.
CONTROL_OR_CR = CONTROL[:-1] + r"\x0D]"
BAR = r"[\s=\-#░█▓▒▌▐►◄|]"
#: A line with six word characters is no bar.
NO_BAR = r"(?:[^\w\n]*+\w){6}"
TIMESTAMPS = [r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?", r"\[\d{2}:\d{2}:\d{2}(\.\d+)?\]", r"\d{2}:\d{2}:\d{2}(\.\d+)?\s"]
FRAME = r"^[ \t]{2,}(at |File \"|in <)"
JSON_OBJECT = r"(\{[\s\S]{200,}?\})"
JSON_BLANKS = r'("[^"\\]*+(?:\\.[^"\\]*+)*+")|\s+'
VERBOSE = [
    ("in order to", "to"),
    ("due to the fact that", "because"),
    ("in spite of the fact that", "although"),
    ("with regard to", "about"),
    ("at this point in time", "now"),
    ("in the event that", "if"),
    ("for the purpose of", "to"),
    ("in a manner that", "how"),
    ("in the process of", ""),
    ("as a matter of fact", ""),
    ("it is important to note that", "note:"),
    ("it should be noted that", "note:"),
    ("please note that", ""),
    ("keep in mind that", ""),
]
OPENERS = r"(^|\.\s+|\n)([Ll]et me |[Ii]'ll |[Ii] will |[Ii]'m going to |[Nn]ow,? |[Ss]o,? )"
MARKERS = r"(?i)\b(let me |i'll |i will |i'm going to |i'm now |i am now |i shall |now |so,? |so let's |well,? |alright,? |actually,? |basically,? |essentially,? |fundamentally,? )"
CLOSING = r"(?is)\n\n(?:Here'?s a (?:summary|brief recap)|To summarize|In summary|Summary:|Recap:|To recap|In conclusion)\b.{50,}\z"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, worked out once for each row; a lambda that uses a column works it out for each element.

    As the end of an aggregation: an element taken out of an array asks all of ``body`` for its type, each time."""
    return F.aggregate(F.array(F.lit(0)), value, lambda acc, _: acc, body)


def half_up(x: Column) -> Column:
    """Rounding with halves towards plus infinity."""
    return F.floor(x + 0.5)


def tokens_of(chars: Column) -> Column:
    return half_up(chars / CHARS_PER_TOKEN)


def saving_percent(saved: Column, original: Column) -> Column:
    """One decimal; 0 without input."""
    return F.when(original > 0, F.floor(saved / original * 1000 + 0.5) / 10).otherwise(F.lit(0.0))


def trimmed(x: Column) -> Column:
    return F.btrim(x, F.lit(BLANKS))


def blank_ends(x: Column) -> Column:
    """Whether ``trimmed`` has something to do."""
    out = F.lit(False)
    for blank in BLANKS:
        out = out | x.startswith(blank) | x.endswith(blank)
    return out


def where_found(x: Column, found: Callable[[Column], Column], body: Callable[[Column], Column]) -> Column:
    """``body`` of the texts in which there is something to do, which a cheap ``found`` tells; the others as they are."""
    return let(x, lambda x: F.when(found(x), body(x)).otherwise(x))


def shorter(text: Column, was: Column) -> Column:
    """``text`` (worked out once), or ``was`` where that is no longer."""
    return let(text, lambda x: F.when(F.length(x) < F.length(was), x).otherwise(was))


def unix_lines(x: Column) -> Column:
    return where_found(x, lambda x: x.contains("\r"), lambda x: F.regexp_replace(x, r"\r\n?", "\n"))


def strip_ansi(x: Column) -> Column:
    codes = lambda x: F.regexp_replace(F.regexp_replace(x, ANSI[0], ""), ANSI[1], "")
    return where_found(where_found(x, lambda x: x.contains("\x1b"), codes), lambda x: x.rlike(CONTROL), lambda x: F.regexp_replace(x, ANSI[2], ""))


def strip_timestamps(x: Column) -> Column:
    def stripped(x: Column) -> Column:
        for p in TIMESTAMPS:
            x = F.regexp_replace(x, p, "")
        return x

    return where_found(x, lambda x: x.contains(":") & x.rlike(r"\d:\d{2}:\d"), stripped)


def is_bar(line: Column) -> Column:
    """Lines of little but bars and blanks."""
    rest = F.length(F.regexp_replace(line, BAR, ""))
    return ~line.rlike(f"^{NO_BAR}") & ~((rest > F.length(line) * 0.3) | (rest > 5))


def without_bars(x: Column) -> Column:
    """The text's lines but bars and blank ones."""
    return where_found(x, lambda x: ~x.rlike(f"^{NO_BAR}") | x.rlike(rf"\n(?!{NO_BAR})"), lambda x: F.array_join(F.filter(F.split(x, "\n", -1), lambda line: ~is_bar(line)), "\n"))


def collapse_whitespace(x: Column) -> Column:
    ends = lambda x: F.array_join(F.transform(F.split(x, "\n", -1), lambda line: F.rtrim(line, F.lit(" \t"))), "\n")
    x = where_found(x, lambda x: x.rlike(r"[ \t](?:\n|\z)"), ends)
    x = where_found(x, lambda x: x.contains("\n\n\n"), lambda x: F.regexp_replace(x, r"\n{3,}", "\n\n"))
    return where_found(x, blank_ends, trimmed)


def minify_json(x: Column) -> Column:
    """Objects of 200 characters or more that parse lose the blanks outside of their strings; keys keep their order and
    numbers their digits. Pieces are found once, from left to right, and nothing is sought behind the last closing brace, so the
    cost is linear."""
    short = lambda m: F.when(F.try_parse_json(m).isNotNull(), F.regexp_replace(m, JSON_BLANKS, "$1")).otherwise(m)

    def minified(x: Column, last: Column) -> Column:
        head, tail = F.substring(x, F.lit(1), last), F.substring(x, last + 1, F.length(x))
        pieces = lambda head, found: F.transform(F.split(head, JSON_OBJECT, -1), lambda between, i: F.concat(between, F.coalesce(short(F.get(found, i)), F.lit(""))))
        return F.concat(let(head, lambda h: let(F.regexp_extract_all(h, F.lit(JSON_OBJECT), F.lit(1)), lambda found: F.array_join(pieces(h, found), ""))), tail)

    last = lambda x: F.length(x) - F.instr(F.reverse(x), "}") + 1
    return let(x, lambda x: F.when(x.contains("{") & x.contains("}"), let(last(x), lambda n: minified(x, n))).otherwise(x))


def short_phrases(x: Column) -> Column:
    """Verbose phrases by short ones."""
    for phrase, short in VERBOSE:
        x = F.regexp_replace(x, rf"(?i)\b{phrase}\b", short)
    return x


def shorten_prose(x: Column) -> Column:
    """Discourse markers, verbose phrases and emphasis go."""
    x = F.regexp_replace(F.regexp_replace(x, OPENERS, "$1"), MARKERS, "")
    x = F.regexp_replace(F.regexp_replace(short_phrases(x), r"\*\*([^*\n]+)\*\*", "$1"), r"(?<!\w)_([^_\n]+)_(?!\w)", "$1")
    return F.regexp_replace(F.regexp_replace(x, r"  +", " "), r" +([.,;:!?])", "$1")


def clean_prose(x: Column) -> Column:
    """``shorten_prose`` outside of code fences, without a closing summary; the text itself where that is not shorter."""
    fences = lambda x: F.regexp_extract_all(x, F.lit(r"(?s)(```.*?```)"), F.lit(1))
    prose = lambda x: F.transform(F.split(x, r"(?s)```.*?```", -1), shorten_prose)
    joined = lambda x: let(fences(x), lambda fs: F.array_join(F.flatten(F.transform(prose(x), lambda p, i: F.filter(F.array(p, F.get(fs, i)), lambda y: y.isNotNull()))), ""))
    short = lambda x: collapse_whitespace(F.regexp_replace(joined(x), CLOSING, ""))
    return let(x, lambda x: shorter(short(x), x))


def content_id(x: Column) -> Column:
    """Six hex digits of the text's md5."""
    return F.substring(F.md5(x), 1, 6)


def duration_seconds(x: Column) -> Column:
    """``6m0s``, ``1h2m3.5s``, ``120ms`` as seconds."""
    part = lambda p: F.coalesce(F.regexp_extract(x, p, 1).try_cast("double"), F.lit(0.0))
    return part(r"(\d+)h") * 3600 + part(r"(\d+)m(?!s)") * 60 + part(r"([\d.]+)s$") * F.when(x.rlike(r"ms$"), 0).otherwise(1) + part(r"([\d.]+)ms$") / 1000


def reset_time(x: Column, now: Column) -> Column:
    """A reset given as ISO time, epoch seconds, or a duration from ``now``."""
    return F.when(x.rlike(r"^\d{4}-"), F.try_to_timestamp(x)).when(x.rlike(r"^\d+$"), F.timestamp_seconds(x.try_cast("long"))).otherwise(F.timestamp_micros((F.unix_micros(now) + duration_seconds(x) * 1_000_000).cast("long")))


# Where projects lie, and folders that are none.
PROJECT_ROOTS = r"(?i)((?:[a-z]:[\\/]|/(?:users|home|workspace|projects|documents)[\\/])[^\s<>\"*?|]+)"
NO_PROJECTS = (
    "users", "home", "documents", "workspace", "projects", "desktop", "dev", "src", "repos", "mnt", "c", "var", "tmp", "opt", "usr", "lib", "bin", "etc", "node_modules", ".claude", ".config",
)


def project_of(text: Column) -> Column:
    """Project name: the last folder of a ``<cwd>`` tag or a working-directory remark; else the first folder of a path under a
    usual root that is none of the common ones, else its last; else ``unknown``."""
    parts = lambda p: F.filter(F.split(F.replace(trimmed(p), F.lit("\\"), F.lit("/")), "/"), lambda x: x != "")
    last = lambda xs: F.when(F.size(xs) > 0, F.element_at(xs, -1))
    tag = parts(F.regexp_extract(text, r"<cwd>([^<]+)</cwd>", 1))
    said = parts(F.regexp_extract(text, r"(?i)(?:current working directory|cwd)[:\s]+([^\n<]+)", 1))
    path = F.regexp_extract(text, PROJECT_ROOTS, 1)
    names = F.when(~path.contains("://"), parts(path))
    skip = F.array(*[F.lit(s) for s in NO_PROJECTS])
    own = F.get(F.filter(names, lambda x: ~F.array_contains(skip, F.lower(x)) & ~x.rlike("^(?i)[a-z]:$") & (F.length(x) > 1)), F.lit(0))
    return F.coalesce(last(tag), last(said), own, last(names), F.lit("unknown"))


# Clients that a hint may name, and for each family of calls the words of a user agent in their order.
HINTS = ("claude_code", "claude_desktop", "codex_cli", "codex_desktop", "aider", "opencode", "cursor", "cline", "windsurf", "continue")
AGENTS = {
    "messages": (
        [(("claude-code", "claude_code"), "claude_code"), (("claude-desktop", "claude desktop", "electron"), "claude_desktop"), (("aider",), "aider"), (("opencode", "open-code"), "opencode"), (("cursor",), "cursor"), (("cline", "roo"), "cline"), (("windsurf",), "windsurf")],
        "claude_code",
    ),
    "completions": ([(("codex",), "codex_desktop"), (("cursor",), "cursor"), (("continue",), "continue"), (("cline", "roo"), "cline"), (("windsurf",), "windsurf"), (("aider",), "aider")], "openai_other"),
}


def client_of(user_agent: Column, hint: Column | None = None, family: str = "messages") -> Column:
    """A client's name by a known hint, else by its user agent."""
    ua = F.lower(F.coalesce(user_agent, F.lit("")))
    words, default = AGENTS[family]
    name = F.lit(default)
    for any_of, client in reversed(words):
        seen = F.lit(False)
        for w in any_of:
            seen = seen | ua.contains(w)
        name = F.when(seen, client).otherwise(name)
    return name if hint is None else F.when(hint.isin(*HINTS), hint).otherwise(name)


def is_local_key(key_prefix: Column, dummies: tuple[str, ...] = ()) -> Column:
    """Whether a key (its first characters will do) belongs to a local model: a listed dummy, or of no hosted service's form."""
    k = F.lower(F.trim(F.coalesce(key_prefix, F.lit(""))))
    listed = k.isin(*dummies) if dummies else F.lit(False)
    return listed | ((k != "") & ~k.rlike("^(sk-|aiza|eyj)"))


def upstream_of(headers: Column) -> Column:
    """Family of services by a map of lower-case headers."""
    has = lambda name: F.coalesce(headers[name], F.lit("")) != ""
    return F.when(has("x-goog-api-key"), "google").when(has("authorization") & ~has("x-api-key"), "openai").otherwise("anthropic")


def model_of_path(segment: Column) -> Column:
    """``model:method`` as the model."""
    return F.split_part(segment, F.lit(":"), F.lit(1))


def used_window(used: Column) -> Column:
    """A used share in percent, rounded and within 0 and 100."""
    return F.greatest(F.lit(0), F.least(F.lit(100), half_up(used))).cast("int")


def short_number(n: Column) -> Column:
    """``1234567`` as ``1.2M``, ``1234`` as ``1.2k``; a null as a dash."""
    one = lambda unit: (F.floor(n / unit * 10 + 0.5) / 10).cast("string")
    return F.when(n.isNull(), "—").when(n >= 1_000_000, F.concat(one(1_000_000), F.lit("M"))).when(n >= 1000, F.concat(one(1000), F.lit("k"))).otherwise(half_up(n.cast("double")).cast("string"))


def money(dollars: Column) -> Column:
    """``$1.50``; less than a cent as ``<$0.01``; nothing as a dash."""
    cents = F.floor(dollars * 100 + 0.5)
    shown = F.concat(F.lit("$"), F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    return F.when(dollars.isNull() | (dollars == 0), "—").when(dollars < 0.01, "<$0.01").otherwise(shown)


def uptime(seconds: Column) -> Column:
    whole = lambda x: F.floor(x).cast("string")
    return F.when(seconds < 60, F.concat(whole(seconds), F.lit("s"))).when(seconds < 3600, F.concat(whole(seconds / 60), F.lit("m "), (seconds % 60).cast("string"), F.lit("s"))).otherwise(F.concat(whole(seconds / 3600), F.lit("h "), whole((seconds % 3600) / 60), F.lit("m")))
