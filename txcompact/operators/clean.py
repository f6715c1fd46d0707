"""The base clean of blocks: noise, stack traces, repeated lines, JSON, blanks, in this order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txcompact.functions import text as t
from txcompact.operators.blocks import once_each, runs_once

# Fixed value: what ends of lines are trimmed of besides spaces.
OTHER_BLANKS = r"[\t\x0B\f\r]"


def cleaned(text: Column, read: Column) -> Column:
    """The base clean of a text. ``read``: files read keep their line ends and blank lines.

    A text's lines are an array of its row: nothing is exchanged or joined, and only texts that hold stack traces, or a line
    several times, are searched for these."""
    x = F.coalesce(text, F.lit(""))
    plain = lambda x: t.strip_ansi(F.when(read, x).otherwise(t.unix_lines(x)))
    x = t.let(t.where_found(x, lambda x: x.rlike(t.CONTROL_OR_CR), plain), lambda x: t.strip_timestamps(F.when(read, x).otherwise(t.without_bars(x))))
    lines = lambda s: t.let(F.split(s, "\n", -1), lambda ls: t.let(F.when(s.rlike(r"[ \t](?:at |File \"|in <)"), runs_once(ls, t.FRAME)).otherwise(ls), lambda ls: once_each(ls, spaces=~s.rlike(OTHER_BLANKS))))
    return t.collapse_whitespace(t.minify_json(F.array_join(t.let(x, lines), "\n")))


def clean(blocks: DataFrame, profile: str | Column = "default", id_col: str = "block_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """``block_id, text`` and the columns ``keep``. The profile ``read`` leaves line ends and blank lines as they are; a
    column of booleans says for each block whether that holds. Ids name one block each."""
    read = profile if isinstance(profile, Column) else F.lit(profile == "read")
    return blocks.select(F.col(id_col).alias("block_id"), cleaned(F.col("text"), read).alias("text"), *keep)
