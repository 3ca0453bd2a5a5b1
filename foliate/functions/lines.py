"""Column functions on the lines of a text: rewriting of spans, and marks that let a pattern see what kind of line follows.

A rule over neighbouring lines is written as a pattern: each line gets one
mark in front that tells its kind, the pattern matches runs of kinds, and the
marks go again. So a text is rewritten in one narrow step, in time linear in
its length, however many lines a rule looks at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks of lines, and their class in patterns. Only the first character of a marked line is read as a mark.
MARKS = ("\u0001", "\u0002", "\u0003", "\u0004", "\u0005")
#: A fence and what it holds, up to a fence of the same sign or the end; and fences of backquotes alone.
FENCED = r"(?dms)^[^\S\n]*([`~])\1{2}.*?(?:\n[^\S\n]*\1{3}[^\n]*|\z)"
QUOTED = r"(?dms)^[^\S\n]*```.*?(?:\n[^\S\n]*```[^\n]*|\z)"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of the value, which is computed once. ``get`` would find out the type of all of ``then`` anew at every value, ``element_at`` does so once."""
    return F.element_at(F.transform(F.array(value), then), F.lit(1))


def rewrite(text: Column, pattern: str, inside: Callable[[Column], Column] | None = None, outside: Callable[[Column], Column] | None = None) -> Column:
    """The text with what matches the pattern, or all between the matches, rewritten; unchanged without a match but for the ``outside``."""
    inside, outside = inside or (lambda x: x), outside or (lambda x: x)

    def parted(whole: Column) -> Column:
        spans = F.transform(F.regexp_extract_all(whole, F.lit(pattern), F.lit(0)), inside)
        pieces = F.split(whole, pattern)
        joined = let(spans, lambda found: F.array_join(F.transform(pieces, lambda piece, i: F.concat(outside(piece), F.coalesce(F.get(found, i), F.lit("")))), ""))
        return F.when(whole.rlike(pattern), joined).otherwise(outside(whole))

    return let(text, parted)


def unfenced(text: Column, change: Callable[[Column], Column], fence: str = FENCED) -> Column:
    """The text with all outside its fences changed; an open fence reaches to the end."""
    return rewrite(text, fence, outside=change)


def each_line(text: Column, change: Callable[[Column, Column], Column]) -> Column:
    """Every line changed, given all lines and its number from 0."""
    return let(F.split(text, "\n"), lambda lines: F.array_join(F.transform(lines, lambda line, i: change(lines, i)), "\n"))


def mark(text: Column, kind: Callable[[Column], Column]) -> Column:
    """The text with ``kind``, marks, before each line."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda line: F.concat(kind(line), line)), "\n")


def unmark(text: Column, marks: int = 1) -> Column:
    return F.regexp_replace(text, f"(?dm)^[{''.join(MARKS)}]{{{marks}}}", "")


def is_blank(line: Column) -> Column:
    # the first byte tells of most lines
    return (line < "!") & ~line.rlike(r"\S")
