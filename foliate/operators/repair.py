"""Repairs of markdown that need a look at the lines around: display equations and figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.functions.lines import let
from foliate.functions.text import strip

# How a caption begins a line, and what names of image files give the figure's number.
CAPTION = r"(?i)^\s*(?:\*\*)?Fig(?:ure)?\.?\s*(\d+)[.:\s]"
FILE_NAMES = (r"(?i)(?:figure|fig)[_-]?(\d+)", r"(?i)_img[_-]?0*(\d+)")


def space_equations(markdown: Column) -> Column:
    """A blank line before each line that opens, closes or holds display math, unless one is there."""

    def opens(line: Column) -> Column:
        delimiter = let(strip(line), lambda bare: (bare == "$$") | (bare.startswith("$$") & bare.endswith("$$") & (F.length(bare) > 2)))
        return F.contains(line, F.lit("$$")) & delimiter

    def spaced(lines: Column) -> Column:
        one = lambda line, i: F.when(opens(line) & F.coalesce(F.get(lines, i - 1).rlike(r"\S"), F.lit(False)), F.concat(F.lit("\n"), line)).otherwise(line)
        return F.array_join(F.transform(lines, one), "\n")

    return let(F.split(markdown, "\n"), spaced)


def figure_files(files: DataFrame) -> DataFrame:
    """The first file of each figure number of a paper, from files (paper_id, ord, file); names without a number are left out."""
    number = F.coalesce(*(F.nullif(F.regexp_extract("file", p, 1), F.lit("")) for p in FILE_NAMES)).try_cast("long")
    first = F.min_by("file", F.struct("ord", "file"))
    return files.select("paper_id", "ord", "file", number.alias("number")).where("number is not null").groupBy("paper_id", "number").agg(first.alias("file"))


def _embedded(markdown: Column) -> Column:
    return F.transform(F.regexp_extract_all(markdown, F.lit(r"!\[Figure (\d+)\]"), F.lit(1)), lambda n: n.try_cast("long"))


def embed_figures(papers: DataFrame, files: DataFrame, markdown: str = "markdown") -> DataFrame:
    """Papers with each image above the first caption of its number, unless the text has it already."""
    named = figure_files(files).groupBy("paper_id").agg(F.map_from_entries(F.collect_list(F.struct("number", "file"))).alias("_files"))
    both = papers.join(named, "paper_id", "left")
    lines = F.split(F.col(markdown), "\n")
    numbers = F.transform(lines, lambda x: F.nullif(F.regexp_extract(x, CAPTION, 1), F.lit("")).try_cast("long"))
    both = both.withColumn("_numbers", numbers).withColumn("_had", _embedded(F.col(markdown)))

    def shown(line: Column, i: Column) -> Column:
        number = F.get("_numbers", i)
        file = F.try_element_at("_files", number)
        first = F.array_position("_numbers", number) == i + 1
        wanted = F.coalesce(file.isNotNull() & first & ~F.array_contains("_had", number), F.lit(False))
        image = F.concat(F.lit("![Figure "), number.cast("string"), F.lit("](./img/"), file, F.lit(")"))
        return F.when(wanted, F.array(image, F.lit(""), line)).otherwise(F.array(line))

    out = F.when(F.col("_files").isNull(), F.col(markdown)).otherwise(F.array_join(F.flatten(F.transform(lines, shown)), "\n"))
    return both.withColumn(markdown, out).select(papers.columns)


def unembedded_figures(papers: DataFrame, files: DataFrame, markdown: str = "markdown") -> DataFrame:
    """The numbers and files of figures that a paper's text does not show."""
    shown = papers.select("paper_id", F.explode(_embedded(F.col(markdown))).alias("number")).distinct()
    return figure_files(files).join(shown, ["paper_id", "number"], "left_anti")
