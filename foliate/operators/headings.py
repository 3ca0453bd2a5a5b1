"""Headings rebuilt from numbers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliate.functions.lines import each_line, is_blank, let
from foliate.functions.text import strip

#: The longest title, and that of a title with text after it on its line.
LONGEST, LONGEST_INLINE = 120, 60
#: I to XX.
ROMAN = "(?:X?(?:IX|IV|VI{0,3}|I{1,3})|XX?)"
ALONE = r"^(\d+(?:\.\d+)*)\.?\s+([A-Z][^.]+?)\.?\s*$"
INLINE = r"^(\d+(?:\.\d+)*)\.?\s+([A-Z][^.]{2,50})\.\s+(.+)$"
ITEM = r"^\s*\d+\.?\s+\S"


def is_title(title: Column) -> Column:
    """Whether words after a number are a title: short, no mark at the end that announces more, one full stop inside at most, fewer than two words in lower case."""
    stops = F.regexp_count(title, F.lit(r"\. "))
    low = F.regexp_count(title, F.lit(r"(?<!\S)\p{IsLowercase}"))
    return (F.length(title) <= LONGEST) & ~title.rlike(r"[:,;]\s*$") & (stops <= 1) & (low < 2)


def _split_abstract(text: Column, name: str) -> Column:
    """The first line that begins with the name and a dash, as a header and a paragraph."""
    split = F.regexp_replace(text, rf"(?dimsu)\A(.*?)^(?:#+\s*)?{name}\s*[-–—]\s*", f"$1## {name}\n\n")
    return F.when(text.rlike(rf"(?iu){name}"), split).otherwise(text)


def _header(number: Column, title: Column) -> Column:
    depth = F.regexp_count(number, F.lit(r"\.")) + 1
    return F.concat(F.repeat(F.lit("#"), F.least(depth + 1, F.lit(6))), F.lit(" "), number, F.when(depth == 1, ".").otherwise(""), F.lit(" "), title)


def _starts(line: Column, below: str, pattern: str) -> Column:
    """Whether the line begins as the pattern, whose first byte is one before ``below``; that byte alone tells of most lines."""
    return (line < below) & line.rlike(pattern)


def _numbered(lines: Column, i: Column) -> Column:
    line = F.get(lines, i)

    def inline(bare: Column) -> Column:
        first, name, body = F.regexp_extract(bare, INLINE, 1), strip(F.regexp_extract(bare, INLINE, 2)), strip(F.regexp_extract(bare, INLINE, 3))
        good = bare.rlike(INLINE) & (F.length(name) <= LONGEST_INLINE) & is_title(name)
        return F.when(good, F.concat(_header(first, name), F.lit("\n\n"), body)).otherwise(line)

    def change(bare: Column) -> Column:
        number, title = F.regexp_extract(bare, ALONE, 1), strip(F.regexp_extract(bare, ALONE, 2))
        beside = F.coalesce(_starts(F.get(lines, i - 1), ":", ITEM), F.lit(False)) | F.coalesce(_starts(F.get(lines, i + 1), ":", ITEM), F.lit(False))
        good = bare.rlike(ALONE) & let(title, is_title) & (F.contains(number, F.lit(".")) | ~beside)
        gap = F.when(F.coalesce(~is_blank(F.get(lines, i + 1)), F.lit(False)), "\n").otherwise("")
        return F.when(good, F.concat(_header(number, title), gap)).otherwise(inline(bare))

    return F.when(_starts(line, ":", r"^\s*[0-9]"), let(strip(line), change)).otherwise(line)


def _roman(lines: Column, i: Column) -> Column:
    line, pattern = F.get(lines, i), rf"^({ROMAN})\.\s+([A-Z][^.]+?)\.?\s*$"

    def change(bare: Column) -> Column:
        title = strip(F.regexp_extract(bare, pattern, 2))
        return F.when(bare.rlike(pattern) & let(title, is_title), F.concat(F.lit("## "), F.regexp_extract(bare, pattern, 1), F.lit(". "), title)).otherwise(line)

    return F.when(_starts(line, "Y", r"^\s*[IVX]+\."), let(strip(line), change)).otherwise(line)


def rebuild_headings(text: Column) -> Column:
    """The text with headings in place of the lines that were headings once.

    In this order: a dash after the first "Abstract" and "Index Terms";
    numbers with a title alone on their line, whose dots give the level,
    unless a neighbour is numbered too and the number has no dot, or with a
    title and text after it; Roman numbers up to XX; bullets with a number and
    a title before a colon that a paragraph follows, other numbered bullets
    become items. Each looks at the lines as the one before has left them.
    Null stays null, a text without such lines stays as it is.
    """
    out = _split_abstract(_split_abstract(text, "Abstract"), "Index Terms")
    out = let(out, lambda t: F.when(t.rlike(r"(?m)^\s*\d"), each_line(t, _numbered)).otherwise(t))
    out = let(out, lambda t: F.when(t.rlike(r"(?m)^\s*[IVX]+\."), each_line(t, _roman)).otherwise(t))
    # blank lines may come between a titled bullet and the paragraph that makes it a heading
    out = F.regexp_replace(out, r"(?dm)^-[^\S\n]*(\d+[).])[^\S\n]*([^\n]+):[^\S\n]*$(?=\n\s*+(?!(?:[-*•]|\d+[).])[^\S\n]+\S)\S)", "### $1 $2\n")
    return F.regexp_replace(out, r"(?dm)^-[^\S\n]*(\d+)\)[^\S\n]*([^\n]+)$", "$1. $2")
