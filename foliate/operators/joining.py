"""Joining of words and paragraphs that lines have cut, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliate.functions.lines import MARKS, QUOTED, is_blank, let, mark, unfenced, unmark

FIRST, GAP, NEXT, HYPHEN, NONE = MARKS
#: Where a word was joined, until it is known how; a code point that is not a character.
SEAM = "\ufdd0"


def join_hyphens(text: Column) -> Column:
    """The text with a word that a hyphen cuts at a line's end joined with its rest, which begins in lower case on the next line, or beyond one blank line.

    A rest that has a hyphen of its own keeps the first one too. Headings,
    fences and table rows stay, and so does a line that was joined to the one
    before it. Null stays null.
    """

    def kind(line: Column) -> Column:
        guarded = line.rlike(r"^\s*[#|]")
        cut = line.rlike(r"\w-\s*$") & ~guarded
        follows = F.when(is_blank(line), GAP).when(guarded, NONE).when(line.rlike(r"^\s*[a-z]\w*-"), HYPHEN).when(line.rlike(r"^\s*\p{IsLowercase}"), NEXT).otherwise(NONE)
        return F.concat(F.when(cut, FIRST).otherwise(NONE), follows)

    def piece(part: Column) -> Column:
        pattern = rf"(?dm)^{FIRST}(.[^\n]*?)-+[^\S\n]*\n(?:{NONE}{GAP}[^\n]*\n)?.([{NEXT}{HYPHEN}])[^\S\n]*([^\n]*?)[^\S\n]*$"
        joined = F.regexp_replace(mark(part, kind), pattern, f"{NONE}$1{SEAM}$2$3")
        whole = F.replace(F.replace(joined, F.lit(SEAM + HYPHEN), F.lit("-")), F.lit(SEAM + NEXT), F.lit(""))
        return F.when(part.rlike(r"\w-\s*\n"), unmark(whole, 2)).otherwise(part)

    return unfenced(text, piece, QUOTED)


def join_paragraphs(text: Column) -> Column:
    """The text with paragraphs that a page break cut joined by a blank.

    The first ends without a mark that ends a sentence, one blank line
    follows, and the next begins in lower case or with a bracket. Headings,
    images, items and table rows are left alone, and captions are not taken
    in. What was joined is not joined further. Null stays null.
    """

    def kind(line: Column) -> Column:
        plain = line.rlike(r"\S") & ~line.rlike(r"^\s*(?:[#\-*|]|!\[|\d+[.)]\s)")
        opens = plain & ~line.rlike(r"""[.!?:;")>]\s*$""")
        follows = F.when(is_blank(line), GAP).when(plain & line.rlike(r"^\s*(?:\p{IsLowercase}|\()"), NEXT).otherwise(NONE)
        return F.concat(F.when(opens, FIRST).otherwise(NONE), follows)

    pattern = rf"(?dm)^{FIRST}(.[^\n]*?)[^\S\n]*\n.{GAP}[^\n]*\n.{NEXT}[^\S\n]*([^\n]*?)[^\S\n]*$"
    joined = let(text, lambda t: unmark(F.regexp_replace(mark(t, kind), pattern, f"{NONE}$1 $2"), 2))
    return F.when(text.rlike(r"\n[^\S\n]*\n"), joined).otherwise(text)
