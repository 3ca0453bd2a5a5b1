"""Sources: what a source string names, files and folders as blocks, records of scholarly services."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from foliate.functions.text import strip
from foliate.operators.blocks import build_sections, to_lines

# Hosts of repositories, suffixes of documents, the mark of a text that was cut.
GIT_HOSTS = ("github.com", "gitlab.com", "bitbucket.org")
DOCUMENTS = r"(?i)\.(md|markdown|rst|txt|tex)$"
CUT_MARK = "\n\n[... truncated ...]"
ARXIV_ID, ARXIV_NAME = r"^\d{4}\.\d{4,5}(v\d+)?$", r"^(?i:arxiv:)?\d{4}\.\d{4,5}(v\d+)?$"


def _host(source: Column) -> Column:
    return F.lower(F.try_parse_url(F.when(source.rlike(r"(?i)^https?://"), source), F.lit("HOST")))


def _of_arxiv(host: Column) -> Column:
    return F.coalesce((host == "arxiv.org") | host.endswith(".arxiv.org"), F.lit(False))


def source_kind(source: Column, folders: list[str] | None = None) -> Column:
    """git, pdf, glob, dir, markdown, text, url or unknown, the first that fits. Folders are told by whoever can list them."""
    source = F.trim(source)
    url = source.rlike(r"(?i)^https?://")
    host, path = _host(source), F.coalesce(F.try_parse_url(F.when(url, source), F.lit("PATH")), F.lit(""))
    parts = F.size(F.filter(F.split(path, "/"), lambda p: p != ""))
    pdf_path = F.lower(path).endswith(".pdf")
    hosted = F.lit(False)
    for known in GIT_HOSTS:
        hosted = hosted | F.coalesce((host == known) | host.endswith(f".{known}"), F.lit(False))
    git = source.endswith(".git") | source.startswith("git@") | (hosted & (parts >= 2) & ~pdf_path)
    pdf = source.rlike(ARXIV_ID) | F.lower(source).endswith(".pdf") | _of_arxiv(host) | pdf_path
    folder = source.isin(*folders) if folders else F.lit(False)
    return (
        F.when(git, "git").when(pdf, "pdf").when(source.rlike(r"[*?\[]") & ~url, "glob").when(folder, "dir")
        .when(source.rlike(r"(?i)\.(md|markdown)$") & ~url, "markdown").when(url, "url")
        .when(source.rlike(r"\.[A-Za-z0-9]+$"), "text").otherwise("unknown")
    )


def arxiv_pdf(source: Column) -> Column:
    """The address of the PDF of an arXiv id or page; other addresses without blanks around, anything else as it is."""
    bare = F.trim(source)
    own = F.when(bare.rlike(ARXIV_NAME), F.regexp_replace(bare, "(?i)^arxiv:", ""))
    page = F.when(_of_arxiv(_host(bare)), F.nullif(F.regexp_extract(bare, r"(\d{4}\.\d{4,5}(?:v\d+)?)", 1), F.lit("")))
    pdf = F.concat(F.lit("https://arxiv.org/pdf/"), F.coalesce(own, page), F.lit(".pdf"))
    return F.coalesce(pdf, F.when(bare.rlike("(?i)^https?://"), bare), source)


def cap_text(text: Column, most: int) -> Column:
    """At most so many characters; what is cut is marked."""
    return F.when(F.length(text) > most, F.concat(F.regexp_replace(F.substring(text, 1, most), r"\s+$", ""), F.lit(CUT_MARK))).otherwise(text)


def read_folder(spark: SparkSession, path: str, most_files: int = 50, most_chars: int = 200_000) -> DataFrame:
    """The documents below a folder as label and text: README first, then by path; hidden folders and those of packages and builds are left out."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    name = F.element_at(F.split("file", "/"), -1)
    root = path.rstrip("/")
    inside = F.substring(F.col("file"), F.instr("file", root) + F.lit(len(root) + 1), F.length("file"))
    readme = F.upper(name).startswith("README")
    wanted = (name.rlike(DOCUMENTS) | readme) & ~inside.rlike(r"(^|/)(\.[^/]*|node_modules|site-packages|venv|__pycache__|build|dist)/")
    rows = files.where(wanted).select(inside.alias("label"), (~readme).alias("_later"), cap_text(F.col("value"), most_chars).alias("text"))
    return rows.orderBy("_later", "label").limit(most_files).drop("_later")


def read_glob(spark: SparkSession, pattern: str, most_files: int = 50, most_chars: int = 200_000) -> DataFrame:
    """The files of a pattern as label (the path) and text, the first ones by path."""
    files = spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("label"), cap_text(F.col("value"), most_chars).alias("text"))
    return files.orderBy("label").limit(most_files)


def text_blocks(files: DataFrame) -> DataFrame:
    """A section for each text or code file (label, text), named by its stem; marks of headers in it are text."""
    stem = F.regexp_replace(F.element_at(F.split("label", "/"), -1), r"(?<=.)\.[^.]*$", "")
    return files.select("label", F.lit(1).cast("long").alias("ord"), F.lit(0).alias("level"), stem.alias("title"), F.lit("").alias("section_path"), F.lit(None).cast("int").alias("start_line"), strip(F.col("text")).alias("text"))


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """The sources that a file lists, with ``ord``: an array in JSON, or lines without blank ones and those that begin with #."""
    whole = spark.read.text(path, wholetext=True).select("value")
    listed = F.from_json("value", "array<string>")
    lines = F.transform(F.filter(F.split("value", r"\r?\n"), lambda x: (F.trim(x) != "") & ~x.startswith("#")), lambda x: F.trim(x))
    return whole.select(F.posexplode(F.when(F.trim("value").startswith("["), listed).otherwise(lines)).alias("ord", "source"))


def append_lines(rows: DataFrame, path: str) -> None:
    """Appends the rows to a folder of JSON Lines."""
    rows.write.mode("append").json(path)


def markdown_blocks(files: DataFrame) -> DataFrame:
    """Sections of markdown files (label, text); a file without a header is one section of its name and no path."""
    sections = build_sections(to_lines(files, "label", "text")).withColumnRenamed("paper_id", "label")
    bare = files.join(sections.select("label").distinct(), "label", "left_anti")
    stem = F.regexp_replace(F.element_at(F.split("label", "/"), -1), r"\.[^.]*$", "")
    whole = bare.select("label", F.lit(1).cast("long").alias("ord"), F.lit(0).alias("level"), stem.alias("title"), F.lit("").alias("section_path"), F.lit(None).cast("int").alias("start_line"), "text")
    return sections.select(whole.columns).unionAll(whole)


def number_figures(blocks: DataFrame) -> DataFrame:
    """Figures numbered from 1 through all sources, in the order of source, file and number.

    The files' figures are counted first, so that only these counts are put in
    one order; each file's figures are then numbered by themselves.
    """
    figures = F.col("kind") == "figure"
    counts = blocks.where(figures).groupBy("source_ord", "file_ord").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("source_ord", "file_ord").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("source_ord", "file_ord", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("source_ord", "file_ord", figures).orderBy("figure_id"))
    kept = blocks.withColumn("_at", inside).join(counts, ["source_ord", "file_ord"], "left")
    return kept.withColumn("figure_id", F.when(figures, (F.col("_before") + F.col("_at")).cast("int")).otherwise(F.col("figure_id"))).drop("_at", "_before")


def gather(contributions: DataFrame, budget: int) -> tuple[DataFrame, DataFrame]:
    """Blocks of many sources in one: paths begin with the source's label, figures are numbered through; the budget counts files.

    ``contributions`` has source_ord, label, file_ord, kind and section_path, and figure_id if there are figures.
    A source is taken while the files of those before it leave some of the
    budget, and then as many files as are left. Returns blocks, and sources
    with how many files they gave; those that gave none were skipped.
    """
    files = contributions.select("source_ord", "label", "file_ord").distinct()
    order = Window.orderBy("source_ord").rowsBetween(Window.unboundedPreceding, -1)
    sizes = files.groupBy("source_ord", "label").agg(F.count(F.lit(1)).alias("files"))
    left = F.greatest(F.lit(budget) - F.coalesce(F.sum("files").over(order), F.lit(0)), F.lit(0))
    sizes = sizes.withColumn("taken", F.least("files", left))
    at = F.dense_rank().over(Window.partitionBy("source_ord").orderBy("file_ord"))
    kept = contributions.withColumn("_at", at).join(sizes.select("source_ord", "taken"), "source_ord").where(F.col("_at") <= F.col("taken")).drop("_at", "taken")
    if "figure_id" in kept.columns:
        kept = number_figures(kept)
    path = F.concat(F.lit("["), "label", F.lit("] "), F.coalesce("section_path", F.lit("")))
    return kept.withColumn("section_path", F.when(F.col("kind") == "section", F.rtrim(path)).otherwise(F.col("section_path"))), sizes


@F.pandas_udf(StringType())
def _unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def unescape(text: Column) -> Column:
    """Entities, by name or number, as the signs they stand for; the names are those of the standard."""
    return F.when(F.contains(text, F.lit("&")), _unescaped(text)).otherwise(text)


def _one_line(text: Column) -> Column:
    """White space of all kinds as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def _none(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def _named(people: Column) -> Column:
    return F.filter(people, lambda name: name != "")


def semantic_scholar_records(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Records of Semantic Scholar papers."""
    w = F.from_json(column, "paperId string, title string, authors array<struct<name: string>>, venue string, year int, abstract string, citationCount long, journal struct<name: string>, publicationDate string, externalIds map<string, string>")
    return raw.select(
        *raw.columns, F.coalesce(w["paperId"], F.lit("")).alias("record_id"), F.coalesce(w["title"], F.lit("")).alias("title"), F.coalesce(_named(w["authors"]["name"]), F.array().cast("array<string>")).alias("authors"),
        _none(w["venue"]).alias("venue"), w["year"].alias("year"), _none(w["abstract"]).alias("abstract"), w["citationCount"].alias("citation_count"), _none(w["journal"]["name"]).alias("journal"),
        _none(w["publicationDate"]).alias("publication_date"), F.coalesce(F.map_filter(w["externalIds"], lambda k, v: v.isNotNull()), F.create_map().cast("map<string, string>")).alias("external_ids"),
    )


def openalex_records(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Records of OpenAlex works: the abstract is put together from its inverted index; the source is a journal if its type says so."""
    schema = "id string, display_name string, publication_year int, publication_date string, cited_by_count long, authorships array<struct<author: struct<display_name: string>>>, primary_location struct<source: struct<display_name: string, type: string>>, abstract_inverted_index map<string, array<int>>"
    w = F.from_json(column, schema)
    pairs = F.flatten(F.transform(F.map_entries(w["abstract_inverted_index"]), lambda e: F.transform(e["value"], lambda i: F.struct(i.alias("i"), e["key"].alias("w")))))
    abstract = F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")
    source = w["primary_location"]["source"]
    venue = _none(source["display_name"])
    return raw.select(
        *raw.columns, F.concat(F.lit("openalex:"), F.coalesce(w["id"], F.lit(""))).alias("record_id"), F.coalesce(w["display_name"], F.lit("")).alias("title"),
        F.coalesce(_named(F.transform(w["authorships"], lambda a: a["author"]["display_name"])), F.array().cast("array<string>")).alias("authors"), venue.alias("venue"), w["publication_year"].alias("year"),
        _none(abstract).alias("abstract"), w["cited_by_count"].alias("citation_count"), F.when(F.lower(source["type"]) == "journal", venue).alias("journal"), _none(w["publication_date"]).alias("publication_date"),
    )


def crossref_records(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Records of Crossref works: first title and container that are not empty, year and date of the first field that has them, the abstract without tags."""
    date = "struct<`date-parts`: array<array<int>>>"
    schema = f"DOI string, URL string, type string, title array<string>, `container-title` array<string>, author array<struct<given: string, family: string>>, abstract string, `is-referenced-by-count` long, `published-print` {date}, `published-online` {date}, published {date}, issued {date}, created {date}"
    w = F.from_json(column, schema)
    first = lambda x: F.coalesce(F.get(F.filter(x, lambda t: t != ""), F.lit(0)), F.lit(""))
    parts = [F.get(w[f]["date-parts"], F.lit(0)) for f in ("published-print", "published-online", "published", "issued", "created")]
    at = lambda p, i: F.coalesce(F.get(p, F.lit(i)), F.lit(1))
    year = F.coalesce(*(F.get(p, F.lit(0)) for p in parts))
    day = F.coalesce(*(F.when(F.get(p, F.lit(0)).isNotNull(), F.format_string("%04d-%02d-%02d", F.get(p, F.lit(0)), at(p, 1), at(p, 2))) for p in parts))
    names = _named(F.transform(w["author"], lambda a: F.concat_ws(" ", _none(F.trim(a["given"])), _none(F.trim(a["family"])))))
    title, container = first(w["title"]), first(w["container-title"])
    ident = F.coalesce(_none(w["DOI"]), _none(w["URL"]), title)
    return raw.select(
        *raw.columns, F.concat(F.lit("crossref:"), ident).alias("record_id"), title.alias("title"), F.coalesce(names, F.array().cast("array<string>")).alias("authors"), container.alias("venue"),
        year.alias("year"), day.alias("publication_date"), _none(_one_line(unescape(F.regexp_replace(w["abstract"], "<[^>]+>", " ")))).alias("abstract"),
        w["is-referenced-by-count"].alias("citation_count"), F.when(F.lower(w["type"]) == "journal-article", container).alias("journal"),
    )


ATOM = "http://www.w3.org/2005/Atom"


def atom_records(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Records of the entries of Atom feeds of preprints, one row an entry: id, year and day of publication, authors, abstract.

    The feeds are parsed as XML, so entities, sections of raw text and a prefix
    of the feed's names come out right; entries may also come without a feed
    around them. A text that is no XML has no entries.
    """
    prefix = F.regexp_extract(column, rf"""xmlns:([A-Za-z_][\w.-]*)\s*=\s*["']{re.escape(ATOM)}["']""", 1)
    bare = F.when(prefix != "", F.regexp_replace(F.col(column), F.concat(F.lit("(</?)"), prefix, F.lit(":")), F.lit("$1"))).otherwise(F.col(column))
    feed = F.when(bare.rlike(r"<feed\b"), bare).otherwise(F.concat(F.lit("<feed>"), bare, F.lit("</feed>")))
    text = "struct<_VALUE: string, _type: string>"
    schema = f"entry array<struct<id: {text}, title: {text}, published: {text}, summary: {text}, author: array<struct<name: {text}>>>>"
    rows = raw.withColumn("_e", F.explode(F.from_xml(feed, schema)["entry"]))
    line = lambda x: _one_line(F.coalesce(x["_VALUE"], F.lit("")))
    e, day = F.col("_e"), F.trim(F.col("_e.published._VALUE"))
    ident = F.element_at(F.split(F.regexp_replace(line(e["id"]), "/+$", ""), "/"), -1)
    names = F.coalesce(_named(F.transform(e["author"], lambda a: line(a["name"]))), F.array().cast("array<string>"))
    return rows.select(
        *raw.columns, F.concat(F.lit("arxiv:"), ident).alias("record_id"), line(e["title"]).alias("title"), names.alias("authors"), F.lit("arXiv").alias("venue"),
        F.when(day.rlike(r"^[0-9]{4}"), F.substring(day, 1, 4).try_cast("int")).alias("year"), F.when(F.length(day) >= 10, F.substring(day, 1, 10)).alias("publication_date"), _none(line(e["summary"])).alias("abstract"),
    )


def write_new(df: DataFrame, path: str, overwrite: bool = False) -> str | None:
    """Writes Parquet unless the path exists; the refusal comes back as text, never as a failure of the job."""
    try:
        df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)
    except Exception as refused:  # noqa: BLE001
        if "PATH_ALREADY_EXISTS" in str(refused):
            return f"exists: {path}"
        raise
    return None
