"""Typed blocks of documents: headers to sections, rendering, selection.

A block row has paper_id, ord, kind (section, figure, equation, code) and the
columns of its kind. Sections come from a table of lines (paper_id, line_no,
line), so that a long document is spread over windows, never parsed in one go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliate.functions.text import shorten, slug, strip

HEADER = r"^(#{1,6})\s+(.*?)\s*$"
#: Arabic, dotted or Roman numbering before a title.
NUMBERING = r"^(?:\d+(?:\.\d+)*|[IVXLCDM]+)\.?\s+"


def to_lines(documents: DataFrame, paper_id: str = "paper_id", markdown: str = "markdown") -> DataFrame:
    """A row a line, numbered from 1. Null texts have no line."""
    return documents.select(F.col(paper_id).alias("paper_id"), F.posexplode(F.split(markdown, "\n")).alias("_at", "line")).select("paper_id", (F.col("_at") + 1).alias("line_no"), "line")


def build_sections(lines: DataFrame) -> DataFrame:
    """A row a header: ord, level, title, section_path, text, start_line.

    The path holds the titles of the headers above that no later header of
    their level or less has closed. The text runs to the next header. What
    comes before the first header is dropped.
    """
    level = F.length(F.regexp_extract("line", HEADER, 1))
    raw = F.regexp_extract("line", HEADER, 2)
    bare = strip(F.regexp_replace(raw, NUMBERING, ""))
    marked = lines.withColumn("level", level).withColumn("title", F.when(F.col("level") > 0, F.when(bare != "", bare).otherwise(strip(raw))))
    order = Window.partitionBy("paper_id").orderBy("line_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for k in range(1, 6):
        here = F.when(F.col("level") == k, F.struct("line_no", "title"))
        marked = marked.withColumn(f"_last{k}", F.last(here, ignorenulls=True).over(before))
    marked = marked.withColumn("ord", F.sum((F.col("level") > 0).cast("int")).over(upto)).where("ord > 0")
    path: list[Column] = []
    for k in range(1, 6):
        shallower = [F.coalesce(F.col(f"_last{j}.line_no"), F.lit(0)) for j in range(1, k)]
        newest = F.greatest(*shallower, F.lit(0)) if shallower else F.lit(0)
        alive = (F.col("level") > k) & (F.col(f"_last{k}.line_no") > newest)
        path.append(F.when(alive, F.col(f"_last{k}.title")))
    header = F.col("level") > 0
    body = F.array_sort(F.collect_list(F.when(~header, F.struct("line_no", "line"))))
    return (
        marked.withColumn("_path", F.concat_ws(" > ", *path, "title"))
        .groupBy("paper_id", "ord")
        .agg(
            F.max(F.when(header, F.col("level"))).alias("level"),
            F.max(F.when(header, F.col("title"))).alias("title"),
            F.max(F.when(header, F.col("_path"))).alias("section_path"),
            F.max(F.when(header, F.col("line_no"))).alias("start_line"),
            strip(F.array_join(F.transform(body, lambda x: x["line"]), "\n")).alias("text"),
        )
    )


def split_level(lines: DataFrame, level: int = 2) -> DataFrame:
    """Sections of one header level: ord, title, draft. Deeper headers stay in the draft; what comes before is dropped."""
    title = F.regexp_extract("line", rf"^#{{{level}}}\s+(?!#)(.*)$", 1)
    is_header = F.col("line").rlike(rf"^#{{{level}}}\s+(?!#)")
    upto = Window.partitionBy("paper_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = lines.select("*", is_header.alias("_h"), strip(title).alias("_t")).withColumn("ord", F.sum(F.col("_h").cast("int")).over(upto)).where("ord > 0")
    body = F.array_sort(F.collect_list(F.when(~F.col("_h"), F.struct("line_no", "line"))))
    return marked.groupBy("paper_id", "ord").agg(F.max(F.when(F.col("_h"), F.col("_t"))).alias("title"), strip(F.array_join(F.transform(body, lambda x: x["line"]), "\n")).alias("draft"))


def block_id(kind: Column, path: Column, number: Column) -> Column:
    """section: and the path's slug; of other kinds the kind and the number."""
    named = slug(path)
    return F.when(kind == "section", F.concat(F.lit("section:"), F.when(named != "", named).otherwise("untitled"))).otherwise(F.concat(kind, F.lit(":"), number.cast("string")))


def render(detail: str, kind: str = "kind", path: str = "section_path", text: str = "text", number: str = "number", caption: str = "caption", language: str = "language") -> Column:
    """A block as text for a prompt: ``ref``, ``summary`` or ``full``. Equations hold their LaTeX in the text column."""
    k, ident = F.col(kind), block_id(F.col(kind), F.col(path), F.col(number))
    lang = F.coalesce(F.col(language), F.lit(""))
    body = F.coalesce(F.col(text), F.lit(""))
    head = F.concat(F.lit("Figure "), F.col(number).cast("string"), F.coalesce(F.concat(F.lit(": "), F.when(F.col(caption) != "", F.col(caption))), F.lit("")))
    end = lambda c: F.regexp_replace(c, r"\s+$", "")
    ref = F.concat(F.lit("["), ident, F.lit("]"))
    if detail == "ref":
        extra = F.when(k == "section", F.col(path)).when(k == "figure", F.concat(F.lit("Figure "), F.col(number).cast("string"))).when(k == "code", lang).otherwise("")
        return end(F.concat(ref, F.lit(" "), extra))
    brief = detail == "summary"
    section = end(F.concat(F.lit("## "), F.col(path), F.lit("\n"), shorten(body) if brief else body))
    code = F.concat(F.lit("```"), lang, F.lit("\n"), shorten(body) if brief else body, F.lit("\n```"))
    equation = F.concat(F.lit("$$ "), shorten(body, 120) if brief else body, F.lit(" $$"))
    return F.when(k == "section", section).when(k == "figure", shorten(head) if brief else head).when(k == "equation", equation).otherwise(code)


def select(blocks: DataFrame, *, kinds: list[str] | None = None, prefix: str | None = None, most: int | None = None) -> DataFrame:
    """Blocks of some kinds, of sections whose path begins so, and of these the first ones of each document."""
    if kinds is not None:
        blocks = blocks.where(F.col("kind").isin(kinds))
    if prefix is not None:
        blocks = blocks.where((F.col("kind") == "section") & F.col("section_path").startswith(prefix))
    if most is not None:
        first = F.row_number().over(Window.partitionBy("paper_id").orderBy("ord"))
        blocks = blocks.withColumn("_n", first).where(F.col("_n") <= most).drop("_n")
    return blocks
