"""Operators on the lines of a block as an array of its row: runs, repeats, segments and groups, by sorts and slices of that array.

Costs grow with a block's lines (those of the sorts by their logarithm more); none compares every line with every other. Arrays that lambdas
use are bound by ``let``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from txcompact.functions.text import let, trimmed


def places(xs: Column) -> Column:
    """0 and up, for each element."""
    return F.transform(xs, lambda x, i: i)


def spans(starts: Column, size: Column, body: Callable[[Column, Column, Column], Column]) -> Column:
    """``body(start, length, number)`` of the stretches that begin at ``starts`` (bound, ascending) and end before the next."""
    return F.transform(starts, lambda s, j: let(F.coalesce(F.get(starts, j + 1), size) - s, lambda n: body(s, n, j)))


def cut(xs: Column, start: Column, n: Column) -> Column:
    """``n`` elements from ``start`` (0 and up) on."""
    return F.slice(xs, start + 1, F.greatest(n, F.lit(0)))


def runs_once(lines: Column, flag: str, min_len: int = 3) -> Column:
    """Unbroken runs of at least ``min_len`` lines that match ``flag``; one equal to an earlier one becomes one line. ``lines`` is bound."""

    def shown(flags: Column, starts: Column) -> Column:
        size = F.size(lines)
        body = lambda s, n: F.when(F.get(flags, s) & (n >= min_len), F.array_join(cut(lines, s, n), "\n"))
        # Equal runs stand side by side once they are sorted, the first in front; sorted back, a run's mark has its place.
        by_body = F.sort_array(spans(starts, size, lambda s, n, j: F.struct(body(s, n).alias("body"), j.alias("j"))))
        again = lambda xs: F.sort_array(F.transform(xs, lambda x, i: F.struct(x["j"].alias("j"), F.coalesce((i > 0) & (F.get(xs, i - 1)["body"] == x["body"]), F.lit(False)).alias("again"))))
        note = lambda n: F.array(F.format_string("  ... [same %d-frame stack trace repeated]", n))
        return let(by_body, lambda xs: let(again(xs), lambda marks: F.flatten(spans(starts, size, lambda s, n, j: F.when(F.get(marks, j)["again"], note(n)).otherwise(cut(lines, s, n))))))

    starts = lambda flags: F.filter(places(flags), lambda i: (i == 0) | (F.get(flags, i) != F.get(flags, i - 1)))
    return let(F.transform(lines, lambda x: x.rlike(flag)), lambda flags: let(starts(flags), lambda at: shown(flags, at)))


def by_key(keys: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``body(rows, starts)``: structs ``key, pos`` sorted by both, and where each key's rows begin."""
    rows = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("key"), i.alias("pos"))))
    starts = lambda rows: F.filter(places(rows), lambda i: (i == 0) | (F.get(rows, i)["key"] != F.get(rows, i - 1)["key"]))
    return let(rows, lambda rows: let(starts(rows), lambda at: body(rows, at)))


def once_each(lines: Column, min_count: int = 3, spaces: Column | None = None) -> Column:
    """Of a line found ``min_count`` times or more (trimmed; blank lines never) the first stays, with a line behind it that says how
    many went. ``lines`` is bound. ``spaces`` tells that they hold no blanks but spaces, which are trimmed faster."""

    def shown(rows: Column, starts: Column) -> Column:
        often = lambda s, n: (n >= min_count) & (F.get(rows, s)["key"] != "")
        one = lambda pos, n: F.struct(pos.alias("pos"), n.alias("n"))
        kept = spans(starts, F.size(rows), lambda s, n, j: F.when(often(s, n), F.array(one(F.get(rows, s)["pos"], n))).otherwise(F.transform(cut(rows, s, n), lambda x: one(x["pos"], F.lit(0)))))
        line = lambda x: F.when(x["n"] == 0, F.get(lines, x["pos"])).otherwise(F.format_string("%s\n  ... [repeated %d more times]", F.get(lines, x["pos"]), x["n"] - 1))
        return F.transform(F.sort_array(F.flatten(kept)), line)

    filled = lambda keys: F.filter(keys, lambda k: k != "")
    again = lambda ks: F.size(ks) - F.size(F.array_distinct(ks)) >= min_count - 1
    repeats = lambda keys: again(keys) & let(filled(keys), again)
    keys = F.transform(lines, trimmed)
    keys = keys if spaces is None else F.when(spaces, F.transform(lines, lambda x: F.trim(x))).otherwise(keys)
    return let(keys, lambda keys: F.when(repeats(keys), by_key(keys, shown)).otherwise(lines))


def segments(lines: Column, event: Callable[[Column], Column], before: Callable[[Column], Column], body: Callable[[Column, Column, Column], Column]) -> Column:
    """What the lines before the first event leave (``before``), and each event (``body`` of its value, its line and the lines up to the
    next event), in order. An event is a line of which ``event`` is not null; ``lines`` is bound."""

    def parts(values: Column, at: Column) -> Column:
        size = F.size(lines)
        each = spans(at, size, lambda s, n, j: body(F.get(values, s), F.get(lines, s), cut(lines, s + 1, n - 1)))
        return F.flatten(F.concat(F.array(before(cut(lines, F.lit(0), F.coalesce(F.get(at, F.lit(0)), size)))), each))

    return let(F.transform(lines, event), lambda values: let(F.filter(places(values), lambda i: F.get(values, i).isNotNull()), lambda at: parts(values, at)))
