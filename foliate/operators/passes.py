"""All repairs of extracted markdown, one after another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.operators import equations, headings, joining, markdown, repair, tables


def process(papers: DataFrame, files: DataFrame | None = None, text: str = "markdown", *, names: bool = False, hyphens: bool = False, paragraphs: bool = False) -> DataFrame:
    """Papers with their text repaired: headings, citations, formulas, figures, bibliography, tables, signs and blanks, in this order.

    ``files`` (paper_id, ord, file) are images to show above their captions.
    ``names`` joins some spaced-out names in formulas, ``hyphens`` and
    ``paragraphs`` join what lines and pages have cut. All steps but figures
    are column expressions, so papers are never moved. Null texts stay null.
    """
    out = papers
    for change in (headings.rebuild_headings, markdown.process_citations, lambda t: equations.repair_equations(t, names)):
        out = out.withColumn(text, change(F.col(text)))
    if files is not None:
        out = repair.embed_figures(out, files, text)
    for change in (markdown.space_bibliography, tables.repair_tables, lambda t: cleaned(t, hyphens, paragraphs)):
        out = out.withColumn(text, change(F.col(text)))
    return out


def cleaned(text, hyphens: bool, paragraphs: bool):
    """Signs and blanks put right; words and paragraphs are joined before blank lines are, as asked."""
    out = markdown.clean_signs(text)
    out = joining.join_hyphens(out) if hyphens else out
    out = joining.join_paragraphs(out) if paragraphs else out
    return markdown.clean_blanks(out)
