"""Repair of formulas, inside their signs only, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliate.functions.lines import let, rewrite
from foliate.operators.repair import space_equations

# What stands for a formula that was not read, commands that lose a blank after the backslash, names of two kinds of papers.
PLACEHOLDER = "*[Formula - see original PDF]*"
COMMANDS = "frac|sqrt|sum|prod|int|partial|nabla|begin|end|left|right|text"
NAMES = ("MultiHead",)
SUBSCRIPTS = (("d", "k"), ("d", "model"), ("p", "data"), ("p", "g"))
DISPLAY, INLINE = r"(?s)\$\$.+?\$\$", r"\$[^$\n]+?\$"


def _tightened(span: Column) -> Column:
    """No blanks around sub- and superscripts and braces, nor between digits."""
    out = F.regexp_replace(F.regexp_replace(span, r"\s*+([_^])\s*+", "$1"), r"\s*+([{}])\s*+", "$1")
    return F.regexp_replace(out, r"(?<=\d)\s+(?=\d)", "")


def _within(open_: str, change):
    """A span without its signs changed, the signs put back."""
    n = len(open_)
    return lambda span: F.concat(F.lit(open_), change(F.substring(span, F.lit(n + 1), F.length(span) - 2 * n)), F.lit(open_))


def _aligned(body: Column) -> Column:
    bare = F.regexp_replace(body, r"\A\n+|\n+\z", "")
    breaks = bare.rlike(r"\\\\\s*\n") & ~bare.rlike(r"aligned|\\begin")
    return F.when(breaks, F.concat(F.lit("\n\\begin{aligned}\n"), bare, F.lit("\n\\end{aligned}\n"))).otherwise(body)


def _spelled(word: str) -> str:
    return r"\s*".join(word)


def repair_equations(text: Column, names: bool = False) -> Column:
    """The text with its formulas repaired; prose, and a formula that is not closed, stay as they are.

    Placeholders of formulas become readable; in formulas blanks around
    scripts and braces and between digits go; commands get back to their
    backslash; with ``names`` some spaced-out names are joined, in all of the
    text; display formulas with line breaks become ``aligned``; a blank line
    comes before a display formula. Null stays null.
    """
    out = F.regexp_replace(text, r"(?i)<!--\s*formula-not-decoded\s*-->", F.lit(PLACEHOLDER))
    out = rewrite(out, DISPLAY, inside=_within("$$", _tightened))
    out = rewrite(out, INLINE, inside=_within("$", _tightened))
    out = F.regexp_replace(out, rf"\\\s+({COMMANDS})", r"\\$1")
    if names:
        for name in NAMES:
            out = F.regexp_replace(out, rf"\b{_spelled(name)}\b", name)
        for base, index in SUBSCRIPTS:
            out = F.regexp_replace(out, rf"\b{base}\s*_\s*\{{\s*{_spelled(index)}\s*\}}", f"{base}_{{{index}}}")
    out = rewrite(out, r"(?s)\$\$.*?\$\$", inside=_within("$$", _aligned))
    return let(out, lambda t: F.when(F.contains(t, F.lit("$$")), space_equations(t)).otherwise(t))
