"""Repairs of extracted markdown as column expressions: citations, references, cleanup, metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.functions.lines import MARKS, is_blank, let, mark, rewrite, unmark

# Headers of the references, tried in this order; typographic signs and their replacements; names of Greek glyphs.
REFERENCE_HEADERS = (r"(?m)^## References\s*$", r"(?m)^## REFERENCES\s*$", r"(?m)^# References\s*$", r"(?m)^References\s*$")
SIGNS = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ft", "ﬆ": "st", "–": "-"}
GLYPHS = {
    "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ε", "epsilon1": "ε", "zeta": "ζ", "eta": "η", "theta": "θ", "iota": "ι", "kappa": "κ", "lambda": "λ", "mu": "μ", "nu": "ν", "xi": "ξ", "omicron": "ο", "pi": "π", "rho": "ρ",
    "sigma": "σ", "sigma1": "ς", "tau": "τ", "upsilon": "υ", "phi": "φ", "phi1": "φ", "chi": "χ", "psi": "ψ", "omega": "ω", "Gamma": "Γ", "Delta": "Δ", "Theta": "Θ", "Lambda": "Λ", "Xi": "Ξ", "Pi": "Π", "Sigma": "Σ", "Upsilon": "Υ", "Phi": "Φ", "Psi": "Ψ", "Omega": "Ω",
}
ENTRY = r"^\s*(?:<a[^>]*></a>)?(?:-\s*)?\[(\d{1,3})\]"
#: A range of citations wider than this stays as it is.
WIDEST_RANGE = 50


def references_at(text: Column) -> Column:
    """Where the references begin, counted from 1: at the first header of the list that occurs. Null if none does."""
    found = [F.regexp_instr(text, F.lit(h)) for h in REFERENCE_HEADERS]
    return F.coalesce(*(F.when(x > 0, x) for x in found))


def split_references(text: Column) -> tuple[Column, Column]:
    """The text before the references, and the references with their header, empty if there are none."""
    at = references_at(text)
    body = F.coalesce(F.substring(text, F.lit(1), at - 1), text)
    return body, F.coalesce(F.substring(text, at, F.length(text)), F.lit(""))


def expand_ranges(text: Column) -> Column:
    """[3]-[5] becomes [3], [4], [5]; the ends may stand in either order."""
    dash = r"\[(\d+)\]\s*[-–—]\s*\[(\d+)\]"

    def items(span: Column) -> Column:
        a, b = (F.regexp_extract(span, dash, k).try_cast("bigint") for k in (1, 2))
        start, end = F.least(a, b), F.greatest(a, b)
        numbers = F.transform(F.sequence(start, end), lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]")))
        return F.when((end - start) <= WIDEST_RANGE, F.array_join(numbers, ", ")).otherwise(span)

    return rewrite(text, dash, inside=items)


def link_numbers(text: Column) -> Column:
    """[7] becomes a link to its reference, unless it is part of a link or image already."""
    return F.regexp_replace(text, r"(?<![\]\[])(?<!\]\()(?<!!\[)\[(\d{1,3})\](?!\()", "[[$1]](#ref-$1)")


def anchor_references(text: Column) -> Column:
    """Entries of the references get an anchor, once; bullets before them go."""
    bare = F.regexp_replace(text, r"(?m)^-\s*\[(\d{1,3})\]", "[$1]")
    return F.regexp_replace(bare, r"(?m)^(\s*)\[(\d{1,3})\]", '$1<a id="ref-$2"></a>[$2]')


def _by_parts(text: Column, body: Callable[[Column], Column], references: Callable[[Column], Column]) -> Column:
    """The text before its references and the references changed, each in its way."""

    def changed(at: Column) -> Column:
        before, after = F.substring(text, F.lit(1), at - 1), F.substring(text, at, F.length(text))
        return F.when(at.isNull(), body(text)).otherwise(F.concat(body(before), references(after)))

    return let(references_at(text), changed)


def process_citations(text: Column) -> Column:
    return _by_parts(text, lambda body: link_numbers(expand_ranges(body)), anchor_references)


def space_bibliography(text: Column) -> Column:
    """A blank line before each entry that follows the lines of another entry without one.

    A blank line, of white space too, ends an entry; lines after it are free
    text until the next entry begins.
    """
    entry, gap, other = MARKS[:3]

    def spaced(run: Column) -> Column:
        # the first entry of lines without a gap follows no other
        apart = F.replace(run, F.lit(f"\n{entry}"), F.lit(f"\n\n{entry}"))
        return F.when(F.startswith(run, F.lit(entry)), apart).otherwise(F.regexp_replace(apart, rf"(?s)\A(.*?)\n(\n{entry})", "$1$2"))

    def entries(references: Column) -> Column:
        marked = mark(references, lambda line: F.when(line.rlike(ENTRY), entry).when(is_blank(line), gap).otherwise(other))
        return unmark(rewrite(marked, rf"(?dm)^[{entry}{other}][^\n]*(?:\n[{entry}{other}][^\n]*)*+", inside=spaced))

    return _by_parts(text, lambda body: body, entries)


def reference_count(text: Column) -> Column:
    """Distinct numbers of the entries after the references header; 0 without a header."""
    _, references = split_references(text)
    numbers = F.regexp_extract_all(references, F.lit(f"(?m){ENTRY}"), F.lit(1))
    return F.size(F.array_distinct(F.transform(numbers, lambda n: n.cast("int")))).cast("long")


def cleanup(text: Column) -> Column:
    """Image comments, ligatures, glyph names, runs of blank lines and blanks at line ends."""
    return clean_blanks(clean_signs(text))


def clean_blanks(text: Column) -> Column:
    """One blank line where there are more, no blanks at line ends."""
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"[ \t\x0B\f\r]++(?=\n|$)", "")


def clean_signs(text: Column) -> Column:
    """Without comments for images, ligatures as letters, glyphs by name as signs; those without a name go."""
    image = r"^\s*<!-- image -->\s*$"
    out = F.when(F.contains(text, F.lit("<!-- image -->")), F.array_join(F.filter(F.split(text, "\n"), lambda line: ~(F.contains(line, F.lit("<!-- image -->")) & line.rlike(image))), "\n")).otherwise(text)
    for sign, letters in SIGNS.items():
        out = F.replace(out, F.lit(sign), F.lit(letters))
    glyph = r"(?i)glyph\[([A-Za-z0-9]+)\]"
    names = F.create_map(*(F.lit(x) for kv in GLYPHS.items() for x in kv))
    out = rewrite(out, glyph, inside=lambda g: F.coalesce(F.element_at(names, F.regexp_extract(g, glyph, 1)), F.lit("")))
    return let(out, lambda t: F.when(F.contains(t, F.lit("GLYPH")), F.regexp_replace(t, r"GLYPH<\d+>|GLYPH&lt;\d+&gt;", "")).otherwise(t))


def table_count(text: Column) -> Column:
    """Tables outside fences: unbroken rows with pipes that have a separator row beside others, or two rows of several cells.

    Pipes in code and formulas do not count, list items and quotes are no
    rows. The lines are folded in the row of their document; the state is the
    open fence, the counts of the block at hand, and the tables so far.
    """
    integer = F.lit(0)

    def state(fence: Column, rows: Column, marks: Column, wide: Column, found: Column) -> Column:
        return F.struct(fence.alias("fence"), rows.cast("int").alias("rows"), marks.cast("int").alias("marks"), wide.cast("int").alias("wide"), found.cast("int").alias("found"))

    def closed(s: Column) -> Column:
        table = ((s["marks"] > 0) & (s["marks"] < s["rows"])) | (s["wide"] >= 2)
        return s["found"] + table.cast("int")

    def step(s: Column, line: Column) -> Column:
        fence = F.substring(F.regexp_extract(line, r"^\s*(`{3,}|~{3,})", 1), 1, 1)
        masked = F.replace(F.regexp_replace(F.regexp_replace(line, "`[^`]*`", ""), r"\$[^$]*\$", ""), F.lit(r"\mid"), F.lit(""))
        is_row = F.contains(masked, F.lit("|")) & ~line.rlike(r"^\s*(?:[-*+>]\s|\d+[.)]\s)")
        inner = F.regexp_replace(F.trim(masked), r"^\||\|$", "")
        cells = F.split(inner, r"\|")
        mark = F.forall(cells, lambda c: F.trim(c).rlike("^:?-+:?$"))
        wide = (F.size(cells) >= 2) & ~mark
        flush = state(s["fence"], integer, integer, integer, closed(s))
        return (
            F.when((s["fence"] != "") & (fence == s["fence"]), state(F.lit(""), integer, integer, integer, closed(s)))
            .when(s["fence"] != "", flush)
            .when(fence != "", state(fence, integer, integer, integer, closed(s)))
            .when(is_row, state(s["fence"], s["rows"] + 1, s["marks"] + mark.cast("int"), s["wide"] + wide.cast("int"), s["found"]))
            .otherwise(flush)
        )

    return F.aggregate(F.split(text, "\n"), state(F.lit(""), integer, integer, integer, integer), step, closed).cast("long")


def metrics(documents: DataFrame, paper_id: str = "paper_id", text: str = "markdown") -> DataFrame:
    """Counts of headings, linked citations, images, tables and references of a document."""
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    return documents.select(
        paper_id,
        count(r"(?m)^#{1,6}\s+\S").alias("sections"),
        count(r"\[\[\d+\]\]\(#ref-\d+\)").alias("linked_citations"),
        count(r"!\[").alias("figures"),
        table_count(F.col(text)).alias("tables"),
        reference_count(F.col(text)).alias("refs"),
    )
