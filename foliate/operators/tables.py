"""Repair of pipe tables as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliate.functions.lines import MARKS, is_blank, let, mark, rewrite, unfenced, unmark
from foliate.functions.text import strip

ROW, BLANK, OTHER = MARKS[:3]
#: Rows that follow each other, or with one other line between them.
BLOCK = rf"(?dm)^{ROW}[^\n]*(?:\n(?:[{BLANK}{OTHER}][^\n]*\n)?{ROW}[^\n]*)*+"
LIST_ITEM = r"^\s*(?:[-*+>]\s|\d+[.)]\s)"
SEPARATOR = "^:?-+:?$"
BLANKS = " \t\r\x0b\f"


def masked(line: Column) -> Column:
    """The line with code, formulas and the sign of divisibility blanked, whose pipes part no cells."""
    code = F.when(F.contains(line, F.lit("`")), F.regexp_replace(line, r"(?d)(`+)(?:.*?)\1", " ")).otherwise(line)
    bare = let(code, lambda c: F.when(F.contains(c, F.lit("$")), F.regexp_replace(c, r"\$[^$\n]*\$", " ")).otherwise(c))
    return F.replace(bare, F.lit(r"\mid"), F.lit(" "))


def is_row(line: Column) -> Column:
    # a pipe that begins the line is not masked, and then the line is no item
    return F.contains(line, F.lit("|")) & (F.startswith(line, F.lit("|")) | (~line.rlike(LIST_ITEM) & F.contains(masked(line), F.lit("|"))))


def cells(row: Column) -> Column:
    """The trimmed cells of a row, whether pipes enclose it or not."""
    inner = F.regexp_replace(F.trim(row, F.lit(BLANKS)), r"^\||\|$", "")
    return F.transform(F.split(inner, r"\|"), lambda c: F.trim(c, F.lit(BLANKS)))


def is_separator(row: Column) -> Column:
    # the first byte tells of most cells
    return F.forall(row, lambda c: (c < ";") & c.rlike(SEPARATOR))


def is_table(block: Column) -> Column:
    """Whether marked lines are a table: a separator beside other rows, or two rows of several cells without a blank line between."""
    kinds = F.transform(
        block,
        lambda line: let(cells(masked(F.substring(line, 2, 1 << 30))), lambda c: F.when(~F.startswith(line, F.lit(ROW)), F.when(F.startswith(line, F.lit(BLANK)), "b").otherwise("o")).when(is_separator(c), "s").when(F.size(c) >= 2, "w").otherwise("n")),
    )
    return let(F.array_join(kinds, ""), lambda k: (k.contains("s") & k.rlike("[wn]")) | k.rlike("w[^b]*w"))


def _render(row: Column, width: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.concat(row, F.array_repeat(F.lit(""), width - F.size(row))), " | "), F.lit(" |"))


def normalize(block: Column) -> Column:
    """The marked lines of a table as rows of equal width under one separator.

    A line without a pipe goes on in the last cell of the row above it, blank
    lines go. A separator in the first or second row is made anew, else one is
    put under the first row. Short rows are filled up, extra cells stay.
    """

    def whole(line: Column, i: Column) -> Column:
        after = F.get(block, i + 1)
        more = F.when(F.startswith(after, F.lit(OTHER)), strip(F.substring(after, 2, 1 << 30)))

        def joined(row: Column) -> Column:
            last = F.element_at(row, -1)
            longer = F.when(last != "", F.concat(last, F.lit(" "), more)).otherwise(more)
            return F.when(more.isNull(), row).otherwise(F.concat(F.slice(row, F.lit(1), F.size(row) - 1), F.array(longer)))

        return F.when(F.startswith(line, F.lit(ROW)), let(cells(F.substring(line, 2, 1 << 30)), joined))

    def table(rows: Column) -> Column:
        at = F.when(is_separator(F.get(rows, F.lit(0))), 0).when((F.size(rows) >= 2) & is_separator(F.get(rows, F.lit(1))), 1).otherwise(-1)

        def lines(place: Column) -> Column:
            width = F.greatest(F.lit(1), F.array_max(F.transform(rows, lambda row, i: F.when(i == place, 0).otherwise(F.size(row)))))

            def out(width: Column) -> Column:
                rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
                line = F.transform(rows, lambda row, i: F.when(i == place, rule).when((i == 0) & (place < 0), F.concat(_render(row, width), F.lit("\n"), rule)).otherwise(_render(row, width)))
                return F.array_join(line, "\n")

            return let(width, out)

        return let(at, lines)

    return let(F.filter(F.transform(block, whole), lambda row: row.isNotNull()), table)


def repair_tables(text: Column) -> Column:
    """The text with every pipe table outside fences repaired; all else, and a text that was repaired before, stays as it is.

    Null stays null. Pipes in code, formulas, list items and quotes part no
    cells. A table begins with a row and takes in one blank or other line
    between two rows.
    """

    def block(lines: Column) -> Column:
        return let(F.split(lines, "\n"), lambda found: F.when(is_table(found), normalize(found)).otherwise(unmark(lines)))

    def piece(part: Column) -> Column:
        marked = mark(part, lambda line: F.when(is_row(line), ROW).when(is_blank(line), BLANK).otherwise(OTHER))
        return F.when(F.contains(part, F.lit("|")), let(marked, lambda m: rewrite(m, BLOCK, inside=block, outside=unmark))).otherwise(part)

    return F.when(F.contains(text, F.lit("|")), unfenced(text, piece)).otherwise(text)
