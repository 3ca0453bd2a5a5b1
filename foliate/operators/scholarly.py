"""Bibliographic records: gates, matching, ranking, grading, keys and entries."""

from __future__ import annotations

import difflib
import functools

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from foliate.storage import settled, spread

# Words that citation keys leave out; scores of a match and of an exact one; the bonus of a matching year.
STOPWORDS = ["a", "an", "the", "of", "on", "in", "and", "for", "to", "with"]
THRESHOLD, EXACT, YEAR_BONUS = 70, 92, 10
#: Bins of characters for the bound of a ratio; letters have one each.
BINS = 32


@functools.lru_cache(1 << 16)
def _ratio(a: str, b: str) -> int:
    return round(difflib.SequenceMatcher(None, a, b).ratio() * 100)


@F.pandas_udf(IntegerType())
def fuzzy_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """0 to 100: twice the matched characters over all, rounded half to even."""
    return pd.Series([None if x is None or y is None else _ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def date_valid(published: Column, year: Column, cutoff: str | None) -> Column:
    """Whether a record is from before the cutoff's month (YYYY-MM); without a date by its year; true if nothing can be told."""
    parts = (cutoff or "").split("-")
    if len(parts) != 2 or not all(p.strip().isdigit() for p in parts) or not 1 <= int(parts[1]) <= 12 or not 1 <= int(parts[0]) <= 9999:
        return F.lit(True)
    y, m = int(parts[0]), int(parts[1])
    day = F.when(published.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(published, "yyyy-M-d"))
    by_year = (year < y) | ((year == y) & F.lit(m > 1))
    return F.when(day.isNotNull(), day < F.make_date(F.lit(y), F.lit(m), F.lit(1))).when(year.isNotNull(), by_year).otherwise(True)


def score(references: DataFrame, records: DataFrame, on: str = "search_key") -> DataFrame:
    """References joined to the records that a search found for them, with the ratio of their titles. Records without a title are left out."""
    both = references.join(records.where("title != ''"), on)
    return both.withColumn("ratio", fuzzy_ratio(F.lower("query_title"), F.lower("title")))


def _letters(text: Column) -> Column:
    """How many characters of a text fall into each of BINS bins."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.pmod(F.ascii(c), F.lit(BINS)))
    return F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.size(F.filter(codes, lambda c: c == b)))


def bounded(references: DataFrame, records: DataFrame, on: str = "search_key") -> DataFrame:
    """As ``score``, with ``bound`` in place of the ratio: at least as much, from the letters that titles share, and computed without Python."""
    left = references.withColumns({"_a": F.lower("query_title"), "_la": _letters(F.lower("query_title"))})
    right = records.where("title != ''").withColumns({"_b": F.lower("title"), "_lb": _letters(F.lower("title"))})
    both = left.join(right, on)
    shared = F.aggregate(F.zip_with("_la", "_lb", lambda x, y: F.least(x, y)), F.lit(0), lambda a, x: a + x)
    length = F.length("_a") + F.length("_b")
    return both.withColumn("bound", F.when(length == 0, 100).otherwise(F.bround(200 * shared / length)).cast("int")).drop("_a", "_b", "_la", "_lb")


def _compared(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("ratio", fuzzy_ratio(F.lower("query_title"), F.lower("title"))).drop("bound")


def score_matches(references: DataFrame, records: DataFrame, on: str = "search_key") -> DataFrame:
    """Of ``score`` the pairs that ``best_match`` may choose: titles are compared only where the bound, with the bonus of the year, is above the threshold."""
    bonus = F.when(F.col("year") == F.col("year_hint"), YEAR_BONUS).otherwise(0)
    return _compared(bounded(references, records, on).where(F.col("bound") + bonus > THRESHOLD))


def score_best(references: DataFrame, records: DataFrame, on: str = "search_key", most: int = 4) -> DataFrame:
    """Of ``score`` the pairs that ``grade`` reads: the ``most`` best records of a reference, and those that may be exact.

    The records with the highest bounds are compared first; the least of their
    ratios is what a record must reach by its bound to be compared as well.
    """
    pairs = settled(bounded(references, records, on))
    place = F.row_number().over(Window.partitionBy("ref_id").orderBy(F.col("bound").desc(), "rec_ord"))
    first = _compared(pairs.withColumn("_i", place).where(F.col("_i") <= most))
    least = first.groupBy("ref_id").agg(F.when(F.count(F.lit(1)) == most, F.min("ratio")).otherwise(0).alias("_least"))
    return _compared(pairs.join(least, "ref_id").where((F.col("bound") >= F.col("_least")) | (F.col("bound") >= EXACT)).drop("_least"))


def _asked(references: DataFrame, on: str) -> DataFrame:
    """References that ask the same, by their first: a row for each search, title and hinted year."""
    return references.groupBy(on, "query_title", "year_hint").agg(F.min("ref_id").alias("ref_id"))


def _answered(references: DataFrame, answers: DataFrame, on: str) -> DataFrame:
    """Every reference with the answers to the one that asks the same; those without are left out."""
    same = [on, "query_title", "year_hint"]
    named = answers.drop("ref_id").withColumnsRenamed({c: f"_same_{c}" for c in same})
    return references.join(named, [F.col(c).eqNullSafe(F.col(f"_same_{c}")) for c in same]).drop(*(f"_same_{c}" for c in same))


def _title_pairs(references: DataFrame, records: DataFrame, on: str) -> DataFrame:
    """(on, query_title, title, n, bound): each title asked with each title found, once however often they come; n records have it."""
    found = records.where("title != ''").groupBy(on, "title").agg(F.count(F.lit(1)).alias("n"))
    return bounded(spread(references.select(on, "query_title").distinct(), on), spread(found, on), on)


def _asking(asked: DataFrame, pairs: DataFrame, on: str) -> DataFrame:
    """The pairs of titles, with each of the references that ask with that title, be it null."""
    same = (F.col(f"a.{on}") == F.col(f"p.{on}")) & F.col("a.query_title").eqNullSafe(F.col("p.query_title"))
    return asked.alias("a").join(pairs.alias("p"), same).select("a.*", *(f"p.{c}" for c in pairs.columns if c not in (on, "query_title")))


def bound_counts(references: DataFrame, records: DataFrame, on: str = "search_key") -> DataFrame:
    """(ref_id, found, compared, best_bound): the records found for a reference, those whose titles ``match`` compares, and the highest bound."""
    years = records.where("title != ''").groupBy(on, "title", "year").agg(F.count(F.lit(1)).alias("_of"))
    pairs = _asking(_asked(references, on), _title_pairs(references, records, on), on).join(years, [on, "title"])
    bonus = F.when(F.col("year") == F.col("year_hint"), YEAR_BONUS).otherwise(0)
    compared = F.sum(F.when(F.col("bound") + bonus > THRESHOLD, F.col("_of")).otherwise(0))
    counted = pairs.groupBy(on, "query_title", "year_hint").agg(F.sum("_of").alias("found"), compared.alias("compared"), F.max("bound").alias("best_bound"))
    return _answered(references, counted, on).select("ref_id", "found", "compared", "best_bound")


def match(references: DataFrame, records: DataFrame, cutoff: str | None = None, on: str = "search_key") -> DataFrame:
    """``best_match`` of all references and records, with titles compared once: equal questions have equal answers, and of records alike in title and year only the first can be the best."""
    valid = records.where("title != ''").where(_valid(cutoff))
    first = valid.groupBy(on, "title", "year").agg(F.min_by(F.struct(*(c for c in records.columns if c not in (on, "title", "year"))), "rec_ord").alias("_r")).select(on, "title", "year", "_r.*")
    pairs = _compared(_title_pairs(references, first, on).where(F.col("bound") + YEAR_BONUS > THRESHOLD)).drop("n")
    scored = _asking(_asked(references, on), pairs.where(F.col("ratio") + YEAR_BONUS > THRESHOLD), on).join(first, [on, "title"])
    return _answered(references, best_match(scored, cutoff), on)


def match_grade(references: DataFrame, records: DataFrame, on: str = "search_key", most: int = 4) -> DataFrame:
    """``grade`` of all references and records, with titles compared once: of records alike in title and year the first ``most`` are ranked.

    The titles with the highest bounds that have ``most`` records together are
    compared first, then those whose bound reaches the least of their ratios.
    """
    pairs = settled(_title_pairs(references, records, on))
    order = Window.partitionBy(on, "query_title").orderBy(F.col("bound").desc(), "title")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = _compared(pairs.withColumn("_before", before).where(F.col("_before") < most))
    least = first.groupBy(on, "query_title").agg(F.when(F.sum("n") >= most, F.min("ratio")).otherwise(0).alias("_least"))
    reach = F.coalesce("bound", F.lit(0))
    near = _asking(least, pairs, on).where((reach >= F.coalesce("_least", F.lit(0))) | (reach >= EXACT)).drop("_least")
    alike = records.where("title != ''").withColumn("_i", F.row_number().over(Window.partitionBy(on, "title", "year").orderBy("rec_ord"))).where(F.col("_i") <= most)
    asked = _asked(references, on)
    scored = _asking(asked, _compared(near).drop("n"), on).join(alike.select(on, "title", "year", "rec_ord"), [on, "title"])
    graded = grade(asked, scored)
    return _answered(references, graded, on).select(*references.columns, *(c for c in graded.columns if c not in asked.columns))


def ranked(scored: DataFrame, points: Column) -> DataFrame:
    """Records of a reference from the best: points, then the earlier year, records without one last, then the order found."""
    order = Window.partitionBy("ref_id").orderBy(points.desc(), F.coalesce("year", F.lit(9999)), "rec_ord")
    return scored.withColumn("points", points).withColumn("rank", F.row_number().over(order))


def _valid(cutoff: str | None) -> Column:
    return date_valid(F.col("publication_date"), F.col("year"), cutoff) & (F.trim("abstract") != "")


def best_match(scored: DataFrame, cutoff: str | None = None) -> DataFrame:
    """The best record of each reference above the threshold: with an abstract, of valid date, with a bonus for the hinted year."""
    valid = scored.where(_valid(cutoff))
    points = F.col("ratio") + F.when(F.col("year") == F.col("year_hint"), YEAR_BONUS).otherwise(0)
    return ranked(valid, points).where(f"rank = 1 and points > {THRESHOLD}").drop("rank")


def grade(references: DataFrame, scored: DataFrame) -> DataFrame:
    """Each reference as exact, minor or major, with its match, up to three other titles, and conflicting years.

    Unlike best_match this asks for no abstract or date and gives no bonus.
    """
    rows = ranked(scored, F.col("ratio"))
    top = F.array_sort(F.collect_list(F.when(F.col("rank") <= 4, F.struct("rank", "title", "year", "ratio"))))
    years = F.array_sort(F.collect_set(F.when(F.col("ratio") >= EXACT, F.col("year"))))
    out = references.join(rows.groupBy("ref_id").agg(top.alias("_t"), years.alias("_y")), "ref_id", "left")
    best = F.get("_t", F.lit(0))
    found = F.coalesce(best["ratio"] > THRESHOLD, F.lit(False))
    same_year = F.col("year_hint").isNull() | F.coalesce(best["year"] == F.col("year_hint"), F.lit(False))
    titles = lambda first: F.transform(F.slice("_t", first, 3), lambda x: x["title"])
    severity = F.when(~found, "major").when((best["ratio"] >= EXACT) & same_year, "exact").otherwise("minor")
    return out.select(
        *references.columns,
        severity.alias("severity"),
        F.coalesce(best["ratio"], F.lit(0)).cast("double").alias("score"),
        F.when(found, best["title"]).alias("matched_title"),
        F.when(found, best["year"]).alias("matched_year"),
        F.coalesce(F.when(found, titles(2)).otherwise(titles(1)), F.array().cast("array<string>")).alias("alternatives"),
        F.when(found & (F.size("_y") > 1), F.col("_y")).otherwise(F.array().cast("array<int>")).alias("year_conflict"),
    )


def mint_key(authors: Column, year: Column, title: Column) -> Column:
    """Last name of the first author, year, and the first two title words that are no stopwords; letters and digits alone."""
    last = F.element_at(F.filter(F.split(F.get(authors, F.lit(0)), r"\s+"), lambda w: w != ""), -1)
    clean = lambda c: F.regexp_replace(c, r"[^\p{L}\p{N}]", "")
    name = F.lower(clean(last))
    words = F.slice(F.filter(F.split(F.lower(title), r"\s+"), lambda w: (w != "") & ~w.isin(STOPWORDS)), 1, 2)
    return F.concat(F.when(name != "", name).otherwise("anon"), F.coalesce(year.cast("string"), F.lit("nd")), F.array_join(F.transform(words, clean), ""))


def _char(code: Column) -> Column:
    """The character of a code point; ``char`` of Spark knows 256 of them. Surrogates are no characters and are passed over."""
    code = code.cast("long")
    known = F.when(code < 0xD800, code).otherwise(code + 0x800)
    return F.decode(F.unhex(F.lpad(F.hex(known), 8, "0")), "UTF-32")


def suffix_keys(citations: DataFrame, by: list[str], key: str = "citation_key", order: str = "ord") -> DataFrame:
    """Keys that several citations share get a, b, c and so on by code points, the first one too."""
    same = Window.partitionBy(*by, key)
    n, at = F.count(F.lit(1)).over(same), F.row_number().over(same.orderBy(order))
    return citations.select("*", n.alias("_n"), at.alias("_i")).withColumn(key, F.when(F.col("_n") > 1, F.concat(F.col(key), _char(F.lit(96) + F.col("_i")))).otherwise(F.col(key))).drop("_n", "_i")


def dedupe(citations: DataFrame, by: list[str], ident: str = "record_id", order: str = "ord") -> DataFrame:
    """The first citation of each record; those without an id all stay."""
    first = F.row_number().over(Window.partitionBy(*by, ident).orderBy(order))
    return citations.withColumn("_i", first).where((F.col("_i") == 1) | F.col(ident).isNull() | (F.col(ident) == "")).drop("_i")


def discover(records: DataFrame, by: list[str], limit: int, cutoff: str | None = None) -> DataFrame:
    """The first record of each title, blanks and case aside, of valid date; of these the first ``limit`` of a group."""
    valid = records.where((F.trim("title") != "") & date_valid(F.col("publication_date"), F.col("year"), cutoff))
    title = F.lower(F.trim(F.regexp_replace("title", r"\s+", " ")))
    first = valid.withColumn("_t", title).withColumn("_i", F.row_number().over(Window.partitionBy(*by, "_t").orderBy("ord"))).where("_i = 1")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("ord"))).where(F.col("rank") <= limit).drop("_t", "_i")


def bibtex(key: Column, authors: Column, title: Column, year: Column, venue: Column, journal: Column, arxiv: Column) -> Column:
    """An entry of the type that the record supports: article, misc for preprints, inproceedings, else misc with a note."""
    given = lambda c: F.coalesce(c != "", F.lit(False))
    preprint = given(arxiv) | F.coalesce(F.lower(F.trim(venue)).isin("arxiv", "arxiv.org"), F.lit(False))
    kind = F.when(given(journal), "article").when(preprint, "misc").when(given(venue), "inproceedings").otherwise("misc")
    field = lambda name, value, when: F.when(when, F.concat(F.lit(f"  {name} = {{"), value, F.lit("}")))
    misc = kind == "misc"
    fields = F.array_compact(
        F.array(
            field("author", F.array_join(authors, " and "), F.size(authors) > 0),
            field("title", title, given(title)),
            field("journal", journal, given(journal)),
            field("booktitle", venue, ~given(journal) & given(venue) & (kind == "inproceedings")),
            field("year", year.cast("string"), year.isNotNull()),
            field("eprint", arxiv, misc & given(arxiv)),
            field("archivePrefix", F.lit("arXiv"), misc & given(arxiv)),
            field("note", F.lit("venue not reported by the scholarly backend"), misc & ~given(arxiv) & ~given(journal)),
        )
    )
    return F.concat(F.lit("@"), kind, F.lit("{"), key, F.lit(",\n"), F.array_join(fields, ",\n"), F.lit("\n}"))
